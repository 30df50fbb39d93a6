"""Customer facts: two revenue paths, scores, benchmarks, payload, final table.

Frames and their columns:

* orders: order_id, customer_id, address_id, order_date, total_due, sub_total, tax_amt, freight, online
* addresses: address_id, state, country
* lines: order_id, line_no, product_id, order_qty, unit_price, unit_price_discount, line_total;
  where a function takes lines with product columns, ``order_categories`` will do, too
* products: product_id, product_name, category_name
* customers: customer_id, first_name, last_name
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import MONEY, all_of, optional_equals, safe_ratio
from tallyspark.operators import quality
from tallyspark.operators.joins import join_dimension
from tallyspark.operators.topn import top_groups_per_key
from tallyspark.plans.commission import chosen_customers, rfm_scores, with_dates
from tallyspark.session import materialise

c = F.col

PAYLOAD_CATEGORIES = 5


@dataclass(frozen=True)
class FactsParams:
    start: dt.date | None = None
    end: dt.date | None = None
    as_of: dt.date | None = None
    customer_ids_csv: str | None = None
    region: str | None = None
    recent_months: int = 6
    tolerance: Decimal = Decimal("0.0100")


def resolve(orders: DataFrame, p: FactsParams) -> FactsParams:
    """Dates from the data where missing; the reporting day defaults to the end."""
    p = with_dates(orders, p)
    return p if p.as_of is not None else replace(p, as_of=p.end)


def fact_orders(orders: DataFrame, addresses: DataFrame, p: FactsParams) -> DataFrame:
    """Orders of the period; the region falls back from state to country."""
    kept = orders.where(c("order_date").between(F.lit(p.start), F.lit(p.end)))
    kept = chosen_customers(kept, p.customer_ids_csv, loose=True)
    placed = join_dimension(kept, addresses, "address_id", "left").withColumn(
        "region_name", F.coalesce("state", "country", F.lit("Unknown Region"))
    )
    return placed.where(all_of(optional_equals(c("region_name"), p.region))).drop(
        "address_id", "state", "country"
    )


def fact_lines(lines: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Lines of the kept orders with product columns and the order's customer."""
    return lines.join(orders.select("order_id", "customer_id"), "order_id").join(products, "product_id")


def path_a(orders: DataFrame) -> DataFrame:
    """Totals per customer from order headers."""
    return orders.groupBy("customer_id").agg(
        F.count("*").alias("order_count"),
        F.sum("total_due").alias("total_revenue_path_a"),
        F.sum("sub_total").alias("sub_total_path_a"),
        F.sum("tax_amt").alias("tax_path_a"),
        F.sum("freight").alias("freight_path_a"),
        F.sum(F.when(c("online"), 1).otherwise(0)).alias("online_order_count"),
        F.sum(F.when(~c("online"), 1).otherwise(0)).alias("offline_order_count"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.max("region_name").alias("primary_region_name"),
    )


_LINE_SUMS = ["line_total", "discount", "lines", "qty"]


def _product_sums(lines: DataFrame, *keys: str) -> DataFrame:
    discount = c("unit_price") * c("order_qty") * c("unit_price_discount")
    return lines.groupBy(*keys, "product_id").agg(
        F.sum("line_total").alias("line_total"),
        F.sum(discount).alias("discount"),
        F.count("*").alias("lines"),
        F.sum("order_qty").alias("qty"),
    )


def _category_sums(products: DataFrame, *keys: str) -> DataFrame:
    return products.groupBy(*keys, "category_name").agg(
        *[F.sum(name).alias(name) for name in _LINE_SUMS], F.count("product_id").alias("products")
    )


def order_categories(lines: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """One row per kept order and category: sums, and how many products.

    Lines are summed per order and product before any join, so the join with
    products moves one row for each of them and a product that is in a third
    of the lines is split by AQE: no aggregate rests on that join's layout.
    Then rows travel to their orders once, where categories are summed and the orders are met.
    """
    named = _product_sums(lines, "order_id").join(
        products.select("product_id", "category_name"), "product_id"
    )
    named = named.where(c("order_id").isNotNull()).repartition("order_id")
    return _category_sums(named, "order_id").join(orders.select("order_id", "customer_id"), "order_id")


def category_grain(lines: DataFrame) -> DataFrame:
    """Lines with product columns as ``order_categories``; those themselves are left as they are."""
    if "products" in lines.columns:
        return lines
    order = ["customer_id", "order_id"]
    return _category_sums(_product_sums(lines, *order, "category_name"), *order)


def path_b(lines: DataFrame) -> DataFrame:
    """Totals per customer from lines, per order first.

    Distinct products and categories are counted within an order and then
    added up, so a product bought in two orders counts twice. Rows of one
    (order, category) make that a sum and a count.
    """
    return category_grain(lines).groupBy("customer_id").agg(
        F.sum("line_total").alias("total_revenue_path_b"),
        F.sum("discount").alias("total_discount_path_b"),
        F.sum("lines").alias("total_lines"),
        F.sum("qty").alias("total_qty"),
        F.sum("products").alias("distinct_products"),
        F.count("category_name").alias("distinct_categories"),
    )


def customer_facts(orders: DataFrame, lines: DataFrame, customers: DataFrame, p: FactsParams) -> DataFrame:
    """Both paths side by side with their difference."""
    joined = (
        path_a(orders).join(customers, "customer_id").join(path_b(lines), "customer_id", "left")
    )
    a, b = c("total_revenue_path_a"), c("total_revenue_path_b")
    delta = F.abs(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))
    return joined.select(
        "customer_id",
        F.concat("first_name", F.lit(" "), "last_name").alias("customer_name"),
        c("primary_region_name").alias("region_name"),
        "first_order_date",
        "last_order_date",
        "order_count",
        "online_order_count",
        "offline_order_count",
        "total_revenue_path_a",
        "total_revenue_path_b",
        c("freight_path_a").alias("total_freight"),
        c("tax_path_a").alias("total_tax"),
        F.when(c("order_count") > 0, safe_ratio(a, c("order_count"))).otherwise(0.0).alias("avg_order_value"),
        "total_discount_path_b",
        "total_lines",
        "total_qty",
        "distinct_products",
        "distinct_categories",
        F.datediff(F.lit(p.as_of), "last_order_date").alias("recency_days"),
        F.datediff("last_order_date", "first_order_date").alias("customer_tenure_days"),
        delta.alias("revenue_delta_ab"),
        safe_ratio(delta, a).alias("revenue_pct_delta_ab"),
    )


def within_tolerance(pct_delta: Column, tolerance: Decimal) -> Column:
    """1 when the paths agree; an unknown difference is a failure."""
    return F.when(pct_delta <= F.lit(float(tolerance)), 1).otherwise(0)


def paths_agree(tolerance: Decimal) -> Column:
    """``within_tolerance`` of the two revenues, decided in decimals.

    The difference is held against the tolerated part of the first revenue, so
    no quotient is rounded. Without a first revenue, or one of 0, it is unknown.
    """
    whole = F.abs(F.nullif(c("total_revenue_path_a"), F.lit(0)))
    signed = F.when(c("total_revenue_path_a") > 0, c("revenue_delta_ab")).otherwise(-c("revenue_delta_ab"))
    return F.when(signed <= whole * F.lit(tolerance), 1).otherwise(0)


def fact_scores(facts: DataFrame) -> DataFrame:
    return rfm_scores(facts, "recency_days", "order_count", "total_revenue_path_a")


def rfm_total() -> Column:
    return c("r_score") + c("f_score") + c("m_score")


def region_benchmark(scored: DataFrame) -> DataFrame:
    def mean(value: Column) -> Column:
        return safe_ratio(F.sum(value), F.count(value))

    return scored.groupBy("region_name").agg(
        mean(c("total_revenue_path_a")).alias("region_avg_revenue"),
        mean(c("order_count")).alias("region_avg_order_count"),
        mean(c("recency_days")).alias("region_avg_recency"),
        mean(rfm_total()).alias("region_avg_rfm"),
    )


def customer_payload(scored: DataFrame, lines: DataFrame) -> DataFrame:
    """One JSON text per customer with the top categories nested; NULL fields are left out."""
    top = top_groups_per_key(category_grain(lines), "customer_id", "category_name", "line_total", PAYLOAD_CATEGORIES)
    # at most PAYLOAD_CATEGORIES entries per customer
    entries = F.sort_array(
        F.collect_list(F.struct((-c("revenue")).alias("o"), c("category_name").alias("category"), "revenue"))
    )
    nested = top.groupBy("customer_id").agg(
        F.transform(entries, lambda e: F.struct(e["category"].alias("category"), e["revenue"].alias("revenue"))).alias(
            "top_categories"
        )
    )
    fields = F.struct(
        c("customer_id").alias("customerId"),
        c("customer_name").alias("customerName"),
        c("region_name").alias("region"),
        c("total_revenue_path_a").alias("revenueA"),
        c("total_revenue_path_b").alias("revenueB"),
        c("order_count").alias("orders"),
        c("recency_days").alias("recencyDays"),
        rfm_total().alias("rfmScore"),
        c("top_categories").alias("topCategories"),
    )
    return scored.join(nested, "customer_id", "left").select(
        "customer_id", F.to_json(fields).alias("payload_json")
    )


def parse_payload(payload: DataFrame) -> DataFrame:
    """Read four fields back as text and convert; what does not convert is NULL."""
    schema = "revenueA string, revenueB string, orders string, rfmScore string"
    parsed = payload.select("*", F.from_json("payload_json", schema).alias("p"))
    return parsed.select(
        "customer_id",
        "payload_json",
        c("p.revenueA").try_cast(MONEY).alias("revenue_a_json"),
        c("p.revenueB").try_cast(MONEY).alias("revenue_b_json"),
        c("p.orders").try_cast("int").alias("orders_json"),
        c("p.rfmScore").try_cast("int").alias("rfm_score_json"),
    )


def payload_differences(scored: DataFrame, parsed: DataFrame) -> DataFrame:
    """The fields read back from the payloads, and the names of those that differ from the facts."""
    pairs = {
        "revenue_a_json": c("total_revenue_path_a"),
        "revenue_b_json": c("total_revenue_path_b"),
        "orders_json": c("order_count"),
        "rfm_score_json": rfm_total(),
    }
    wrong = [F.when(~c(name).eqNullSafe(value.cast(parsed.schema[name].dataType)), F.lit(name)) for name, value in pairs.items()]
    joined = scored.join(parsed.drop("payload_json"), "customer_id", "left")
    return joined.select("customer_id", *pairs, F.concat_ws(",", *wrong).alias("different"))


def final_table(
    orders: DataFrame,
    lines: DataFrame,
    customers: DataFrame,
    quality_rules: DataFrame,
    p: FactsParams,
) -> DataFrame:
    """One wide row per customer, ordered by region, score, revenue and name."""
    lines = materialise(category_grain(lines), "categories")
    scored = materialise(fact_scores(customer_facts(orders, lines, customers, p)))
    parsed = parse_payload(customer_payload(scored, lines))
    failures = quality.fail_counts(quality.evaluate(scored, quality_rules))
    revenue, score = c("total_revenue_path_a").cast("double"), rfm_total()
    return (
        scored.join(region_benchmark(scored), "region_name")
        .join(parsed, "customer_id")
        .join(F.broadcast(failures))  # one row
        .select(
            *scored.columns,
            score.alias("rfm_score"),
            paths_agree(p.tolerance).alias("qc_pass_revenue_ab"),
            "region_avg_revenue",
            "region_avg_order_count",
            "region_avg_recency",
            "region_avg_rfm",
            safe_ratio(revenue - c("region_avg_revenue"), c("region_avg_revenue")).alias(
                "revenue_vs_region_pct_delta"
            ),
            safe_ratio(score - c("region_avg_rfm"), c("region_avg_rfm")).alias("rfm_vs_region_pct_delta"),
            "revenue_a_json",
            "revenue_b_json",
            "orders_json",
            "rfm_score_json",
            "payload_json",
            c("severity_3").alias("qc_fail_count_severity3"),
            c("severity_2").alias("qc_fail_count_severity2"),
            F.lit(p.start).alias("snapshot_start_date"),
            F.lit(p.end).alias("snapshot_end_date"),
            F.lit(p.as_of).alias("snapshot_as_of_date"),
            F.lit(p.tolerance).alias("revenue_tolerance_pct_used"),
            F.lit(p.recent_months).alias("recent_months_window_used"),
        )
        .orderBy("region_name", F.desc("rfm_score"), F.desc("total_revenue_path_a"), "customer_name")
    )
