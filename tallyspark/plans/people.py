"""Employee queries. Columns: id, name, department, salary, joining_date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import safe_ratio
from tallyspark.operators import ranking

c = F.col


def salary_by_department(employees: DataFrame) -> DataFrame:
    return (
        employees.groupBy("department")
        .agg(F.sum("salary").alias("total_salary"))
        .orderBy(F.desc("total_salary"))
    )


def joined_after(employees: DataFrame, day: dt.date) -> DataFrame:
    return (
        employees.where(c("joining_date") > F.lit(day))
        .select("name", "joining_date")
        .orderBy("joining_date")
    )


def average_and_headcount(employees: DataFrame) -> DataFrame:
    return employees.groupBy("department").agg(
        safe_ratio(F.sum("salary"), F.count("salary")).alias("avg_salary"),
        F.count("*").alias("headcount"),
    )


def top_earners(employees: DataFrame, above, n: int = 5) -> DataFrame:
    return (
        employees.where(c("salary") > F.lit(above))
        .select("name", "salary")
        .orderBy(F.desc("salary"), "name")
        .limit(n)
    )


def company_totals(employees: DataFrame, as_of: dt.date) -> DataFrame:
    """One row: headcount, salary totals, best and least paid, latest hire, mean tenure in years."""
    pay = F.struct("salary", "id")
    hired = F.struct("joining_date", "id")
    days = F.datediff(F.lit(as_of), "joining_date")
    return employees.agg(
        F.count("*").alias("headcount"),
        F.sum("salary").alias("total_salary"),
        safe_ratio(F.sum("salary"), F.count("salary")).alias("avg_salary"),
        F.max_by("name", pay).alias("highest_paid"),
        F.min_by("name", pay).alias("lowest_paid"),
        F.max_by("name", hired).alias("latest_hire"),
        (safe_ratio(F.sum(days), F.count(days)) / 365.25).alias("mean_tenure_years"),
    )


def department_headcount(employees: DataFrame) -> DataFrame:
    return employees.groupBy("department").agg(F.count("*").alias("headcount"))


def roster(employees: DataFrame) -> DataFrame:
    """Department and name, a row each: a department's names need not fit one cell."""
    return employees.select("department", "name").orderBy("department", "name")


def ranked_top(employees: DataFrame, n: int = 10) -> DataFrame:
    """The n best paid per department, with pay quartile and running cost by hire date.

    Quartile and running cost are over the whole department, before the cut.
    """
    by_pay = [("salary", "desc"), ("id", "asc")]
    ranked = ranking.keyed_row_number(employees, ["department"], by_pay, "salary_rank", "__rows")
    ranked = ranked.withColumn(
        "salary_quartile", ranking.tile(c("salary_rank"), c("__rows"), 4)
    ).drop("__rows")
    running = ranking.running_by_bucket(
        ranked,
        ["department"],
        "joining_date",
        [("joining_date", "asc"), ("id", "asc")],
        sums={"salary": "running_cost"},
    )
    return running.where(c("salary_rank") <= n)


def batches(df: DataFrame, order: ranking.Order, size: int, name: str = "batch") -> DataFrame:
    """Rows numbered into batches of ``size`` in the given order, from 0."""
    numbered = ranking.global_row_number(df, order, "__rn")
    return numbered.withColumn(name, F.floor((c("__rn") - 1) / size)).drop("__rn")
