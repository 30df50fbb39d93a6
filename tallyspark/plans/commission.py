"""Salesperson commission and pricing.

Frames and their columns:

* orders: order_id, customer_id, seller_id, territory_id, order_date, ship_date,
  sub_total, tax_amt, freight, total_due, online
* territories: territory_id, territory_name, country_code, territory_group
* persons: person_id, first_name, last_name (and person_type, title)
* employees: person_id, job_title; quotas: person_id, quota_date, sales_quota
* lines: order_id, line_no, product_id, order_qty, unit_price, unit_price_discount, line_total
* products: product_id, product_name, color, list_price, standard_cost,
  category_name, subcategory_name, model_name

Money is multiplied at full scale and never rounded in between.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import rules
from tallyspark.functions.scalars import all_of, optional_equals, safe_ratio, split_csv_int
from tallyspark.operators.cuts import with_tiles
from tallyspark.operators.joins import join_dimension, join_effective_date
from tallyspark.session import materialise
from tallyspark.sources import seeds

c = F.col

CATEGORIES = {
    "Bikes": "bike_revenue",
    "Components": "comp_revenue",
    "Clothing": "clothing_revenue",
    "Accessories": "access_revenue",
}
#: What a line takes from its order.
HEADER = [
    "order_id",
    "order_date",
    "territory_group",
    "territory_name",
    "country_code",
    "customer_id",
    "seller_id",
    "seller_name",
    "sales_quota",
    "online",
]
ALLOWANCE = "0.02"
TITLES = ("Mr.", "Ms.", "Mrs.", "Dr.")


@dataclass(frozen=True)
class CommissionParams:
    start: dt.date | None = None
    end: dt.date | None = None
    territory_group: str | None = None
    customer_ids_csv: str | None = None
    min_order_amount: Decimal = Decimal("0")
    top_sellers: int = 10
    threshold_scale: int = 1


def with_dates(orders: DataFrame, p):
    """Fill a missing start or end from the orders: one row comes to the driver."""
    if p.start is not None and p.end is not None:
        return p
    bounds = orders.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi")).first()
    return replace(p, start=p.start or bounds["lo"], end=p.end or bounds["hi"])


def chosen_customers(orders: DataFrame, csv: str | None, loose: bool = False) -> DataFrame:
    """Orders of the listed customers; a list without any integer selects all."""
    if csv is None:
        return orders
    listed = orders.sparkSession.range(1).select(
        F.explode(split_csv_int(F.lit(csv), loose)).alias("customer_id")
    )
    if listed.isEmpty():
        return orders
    return orders.join(F.broadcast(listed), "customer_id", "left_semi")


def base_orders(
    orders: DataFrame,
    territories: DataFrame,
    persons: DataFrame,
    employees: DataFrame,
    quotas: DataFrame,
    p: CommissionParams,
) -> DataFrame:
    """Orders of the period with territory, seller and the seller's quota in it."""
    inside = c("order_date").between(F.lit(p.start), F.lit(p.end))
    kept = orders.where(all_of(inside, c("total_due") >= F.lit(p.min_order_amount)))
    kept = chosen_customers(kept, p.customer_ids_csv)
    where = all_of(optional_equals(c("territory_group"), p.territory_group))
    in_period = c("quota_date").between(F.lit(p.start), F.lit(p.end))
    quota = quotas.where(in_period).groupBy("person_id").agg(F.sum("sales_quota").alias("sales_quota"))
    sellers = (
        persons.join(employees, "person_id", "full")
        .join(quota, "person_id", "full")
        .select(
            c("person_id").alias("seller_id"),
            F.concat("first_name", F.lit(" "), "last_name").alias("seller_name"),
            c("job_title").alias("seller_title"),
            "sales_quota",
        )
    )
    # a few hundred territories; as a join of tables their size is overestimated
    placed = F.broadcast(territories.where(where))
    if p.territory_group is None:
        # nothing is left out by territory, so orders travel to their sellers without its names
        joined = join_dimension(join_dimension(kept, sellers, "seller_id", "left"), placed, "territory_id")
    else:
        joined = join_dimension(join_dimension(kept, placed, "territory_id"), sellers, "seller_id", "left")
    return joined.select(
        *orders.columns,
        "territory_name",
        "country_code",
        "territory_group",
        F.coalesce("seller_name", F.lit("Online/Unknown")).alias("seller_name"),
        "seller_title",
        F.coalesce("sales_quota", F.lit(0)).alias("sales_quota"),
    )


def order_lines(lines: DataFrame, base: DataFrame, products: DataFrame) -> DataFrame:
    """Lines of the base orders with the product hierarchy."""
    return (
        lines.join(base.select(*HEADER), "order_id")
        .join(products, "product_id")
        .withColumn("gross_margin_unit", c("list_price") - c("standard_cost"))
    )


def _territory_key() -> Column:
    known = c("territory_group").isin(*[t for t in seeds.TERRITORIES if t != seeds.OTHER])
    return F.when(known, c("territory_group")).otherwise(seeds.OTHER)


def _category_sums(value: Column) -> list[Column]:
    return [
        F.sum(F.when(c("category_name") == category, value).otherwise(0)).alias(name)
        for category, name in CATEGORIES.items()
    ]


def customer_tiers(lines: DataFrame, scale: int = 1) -> DataFrame:
    """Revenue per customer and territory group, and the tier it earns."""
    sums = lines.groupBy("customer_id", "territory_group").agg(
        F.sum("line_total").alias("total_revenue"),
        *_category_sums(c("line_total")),
        F.countDistinct("order_id").alias("order_count"),
    )
    bounds = F.broadcast(seeds.tier_thresholds(lines.sparkSession, scale))  # 4 rows
    revenue = c("total_revenue")
    tier = (
        F.when(revenue >= c("gold"), "Gold")
        .when(revenue >= c("silver"), "Silver")
        .when(revenue >= c("bronze"), "Bronze")
        .otherwise("Standard")
    )
    return (
        sums.withColumn("territory_key", _territory_key())
        .join(bounds, "territory_key")
        .withColumn("customer_tier", tier)
        .drop("territory_key", "gold", "silver", "bronze")
    )


def with_customer_tier(orders: DataFrame, tiers: DataFrame) -> DataFrame:
    """Orders (or anything with customer and territory group) with the customer's tier there, if any."""
    keys = ["customer_id", "territory_group"]
    return orders.join(tiers.select(*keys, "customer_tier"), keys, "left")


def priced_lines(lines: DataFrame, base: DataFrame, products: DataFrame, needed: list[str], scale: int = 1) -> DataFrame:
    """Priced lines with ``needed`` of their own and their products' columns, and their orders' columns.

    Tiers come from all lines and go back to all lines. So what is read twice
    is written: the orders, and the lines with what is needed of their
    products. A tier belongs to an order's customer and territory, so the
    orders take it, and lines travel to their orders once more, with no column
    of an order on them. Both are written in the order of their names, which
    then take next to nothing in the files and in the shuffles that read them.
    """
    always = ["order_id", "line_total", "category_name", "subcategory_name"]
    chosen = lines.join(products, "product_id").select(*dict.fromkeys([*always, *needed]))
    # strings last: the other columns then stand at fixed places and compress better in a shuffle
    chosen = chosen.select(*sorted(chosen.columns, key=lambda name: chosen.schema[name].dataType == T.StringType()))
    header = base.select(*HEADER).sortWithinPartitions("territory_name", "seller_id")
    header = materialise(header, "orders", "zstd")
    items = materialise(chosen.sortWithinPartitions("category_name", "subcategory_name", "order_id"), "lines", "zstd")
    tiers = customer_tiers(items.join(header, "order_id"), scale)
    return price_lines(items.join(with_customer_tier(header, tiers), "order_id"))


def price_lines(lines: DataFrame) -> DataFrame:
    """Discount, commission and tax override per line from the rate table; lines hold their customer's tier."""
    group = F.when(
        (c("category_name") == "Bikes") & c("subcategory_name").isin(*seeds.BIKE_GROUPS),
        c("subcategory_name"),
    ).when(c("category_name").isin(*CATEGORIES), c("category_name"))
    tier = F.when(c("customer_tier").isin(*seeds.TIERS), c("customer_tier"))
    keyed = lines.select(
        "*",
        F.coalesce(group, F.lit(seeds.OTHER)).alias("rate_group"),
        _territory_key().alias("territory_key"),
        F.coalesce(tier, F.lit("Standard")).alias("tier_key"),
    )
    rates = F.broadcast(seeds.rate_table(lines.sparkSession))  # 128 rows
    keys = ["rate_group", "territory_key", "tier_key"]
    tax = F.lit(None).cast("decimal(5,4)")
    for country, rate in seeds.COUNTRY_TAX.items():
        tax = F.when(c("country_code") == country, F.lit(rate).cast("decimal(5,4)")).otherwise(tax)
    for territory, rate in seeds.TERRITORY_TAX.items():
        tax = F.when(c("territory_group") == territory, F.lit(rate).cast("decimal(5,4)")).otherwise(tax)
    return keyed.join(rates, keys).drop(*keys).withColumn("tax_override_pct", tax)


def line_finals(priced: DataFrame) -> DataFrame:
    """Adjusted revenue, discount, commission, margin and estimated tax per line.

    Columns of the line, order and product are kept where the lines hold them.
    """
    adjusted = c("line_total") * (1 - c("applied_discount_pct"))
    kept = [
        "order_id",
        "line_no",
        "customer_id",
        "seller_id",
        "seller_name",
        "sales_quota",
        "order_date",
        "territory_group",
        "territory_name",
        "category_name",
        "subcategory_name",
        "product_name",
        "customer_tier",
        "order_qty",
        "list_price",
        "standard_cost",
    ]
    computed = priced.select(
        *[name for name in kept if name in priced.columns],
        c("line_total").alias("original_line_total"),
        "applied_discount_pct",
        "applied_commission_pct",
        "tax_override_pct",
        adjusted.alias("adjusted_revenue"),
        (c("line_total") * c("applied_discount_pct")).alias("discount_amount"),
        (adjusted - c("standard_cost") * c("order_qty")).alias("gross_margin"),
    )
    pct = safe_ratio(c("gross_margin"), c("adjusted_revenue"))
    return computed.select(
        "*",
        (c("adjusted_revenue") * c("applied_commission_pct")).alias("commission_earned"),
        pct.cast("decimal(28,10)").alias("gross_margin_pct"),
        (c("adjusted_revenue") * c("tax_override_pct")).alias("estimated_tax"),
    )


def seller_summary(finals: DataFrame) -> DataFrame:
    """Totals per seller and territory, quota band, and revenue quartile."""
    keys = ["seller_id", "seller_name", "territory_group", "territory_name"]
    totals = finals.where(c("seller_id").isNotNull()).groupBy(*keys).agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("original_line_total").alias("total_original_revenue"),
        F.sum("adjusted_revenue").alias("total_adjusted_revenue"),
        F.sum("discount_amount").alias("total_discount_given"),
        F.sum("commission_earned").alias("total_commission_earned"),
        F.sum("gross_margin").alias("total_gross_margin"),
        safe_ratio(F.sum("gross_margin_pct"), F.count("gross_margin_pct")).alias("avg_gross_margin_pct"),
        *_category_sums(c("adjusted_revenue")),
        F.max("sales_quota").alias("sales_quota"),
    )
    banded = totals.withColumn(
        "quota_attainment_band", rules.quota_band(c("total_adjusted_revenue"), c("sales_quota"))
    )
    order = [("total_adjusted_revenue", "desc"), ("seller_id", "asc"), ("territory_name", "asc")]
    return with_tiles(materialise(banded, "sellers"), {"revenue_quartile": (order, 4)})


def customer_rfm(finals: DataFrame, persons: DataFrame, end: dt.date) -> DataFrame:
    """Recency, frequency and monetary quintiles; 1 is best in each."""
    sums = finals.groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("order_count"),
        F.sum("adjusted_revenue").alias("total_revenue"),
        safe_ratio(F.sum("adjusted_revenue"), F.count("adjusted_revenue")).alias("avg_line_revenue"),
        F.max("order_date").alias("last_order_date"),
        F.min("order_date").alias("first_order_date"),
        F.sum("discount_amount").alias("total_discount"),
        F.sum("commission_earned").alias("total_commission"),
        F.max("customer_tier").alias("customer_tier"),
        F.max("territory_group").alias("territory_group"),
    )
    named = sums.join(persons.withColumnRenamed("person_id", "customer_id"), "customer_id").select(
        *sums.columns,
        F.datediff(F.lit(end), "last_order_date").alias("recency_days"),
        F.concat("first_name", F.lit(" "), "last_name").alias("customer_name"),
    )
    return rfm_scores(named, "recency_days", "order_count", "total_revenue")


def rfm_scores(customers: DataFrame, recency: str, frequency: str, monetary: str) -> DataFrame:
    """Three quintiles: fewest days, most orders, most revenue come first.

    The customers are written once; the cut rows of all three scores are found
    on four of their columns.
    """
    ranked = {
        name: ([(column, way), ("customer_id", "asc")], 5)
        for column, way, name in (
            (recency, "asc", "r_score"),
            (frequency, "desc", "f_score"),
            (monetary, "desc", "m_score"),
        )
    }
    return with_tiles(materialise(customers, "customers"), ranked)


def territory_benchmark(sellers: DataFrame) -> DataFrame:
    def mean(name: str) -> Column:
        return safe_ratio(F.sum(name), F.count(name))

    return sellers.groupBy("territory_group").agg(
        F.countDistinct("seller_id").alias("seller_count"),
        F.sum("total_adjusted_revenue").alias("territory_total_revenue"),
        mean("total_adjusted_revenue").alias("territory_avg_revenue"),
        mean("total_commission_earned").alias("territory_avg_commission"),
        F.avg("avg_gross_margin_pct").alias("territory_avg_margin_pct"),
        *[F.sum(name).alias(f"territory_{name}") for name in CATEGORIES.values()],
    )


def final_report(finals: DataFrame, persons: DataFrame, p: CommissionParams) -> DataFrame:
    """The top sellers against their territory, with their customers' mean RFM score.

    The finals are read three times, so the columns needed are written once.
    Customers are counted once per seller; the mean weighs a customer by the
    seller's lines for them, so lines are counted per (seller, customer) first.
    """
    finals = materialise(
        finals.select(
            "order_id",
            "customer_id",
            "seller_id",
            "seller_name",
            "sales_quota",
            "order_date",
            "territory_group",
            "territory_name",
            "category_name",
            "customer_tier",
            "original_line_total",
            "adjusted_revenue",
            "discount_amount",
            "commission_earned",
            "gross_margin",
            "gross_margin_pct",
        ),
        "finals",
    )
    sellers = materialise(seller_summary(finals), "ranked-sellers")
    rfm = customer_rfm(finals, persons, p.end)
    top = sellers.orderBy(
        F.desc("total_adjusted_revenue"), "seller_id", "territory_name"
    ).limit(p.top_sellers)
    scored = rfm.select(
        "customer_id", (c("r_score") + c("f_score") + c("m_score")).alias("score")
    )
    served = (
        finals.join(F.broadcast(top.select("seller_id").distinct()), "seller_id")  # top n
        .groupBy("seller_id", "customer_id")
        .agg(F.count("*").alias("n"))
        .join(scored, "customer_id")
        .groupBy("seller_id")
        .agg(
            F.count("*").alias("unique_customers"),
            safe_ratio(F.sum(c("n") * c("score")), F.sum("n")).alias("avg_customer_rfm_score"),
        )
    )
    benchmark = territory_benchmark(sellers)
    revenue = c("total_adjusted_revenue").cast("double")
    return (
        top.join(benchmark, "territory_group")
        .join(served, "seller_id", "left")
        .select(
            *top.columns,
            (revenue - c("territory_avg_revenue")).alias("revenue_vs_territory_avg"),
            safe_ratio(revenue - c("territory_avg_revenue"), c("territory_avg_revenue")).alias(
                "revenue_vs_territory_pct_delta"
            ),
            (c("total_commission_earned").cast("double") - c("territory_avg_commission")).alias(
                "commission_vs_territory_avg"
            ),
            "territory_total_revenue",
            "territory_avg_margin_pct",
            F.coalesce("unique_customers", F.lit(0)).alias("unique_customers"),
            "avg_customer_rfm_score",
            F.lit(p.start).alias("snapshot_start_date"),
            F.lit(p.end).alias("snapshot_end_date"),
        )
    )


# --- tier override ---------------------------------------------------------------------


def tier_override(
    customers: DataFrame, persons: DataFrame, phones: DataFrame, emails: DataFrame
) -> DataFrame:
    """Promote or demote tiers by contact counts and person type, all customers at once.

    ``customers`` holds customer_id and customer_tier; phones and emails hold
    person_id. A customer without a person row keeps the tier unless a rule
    on contacts alone applies.
    """

    def counted(contacts: DataFrame, name: str) -> DataFrame:
        return contacts.groupBy(c("person_id").alias("customer_id")).agg(F.count("*").alias(name))

    people = persons.select(c("person_id").alias("customer_id"), "person_type", "title")
    joined = (
        customers.join(people, "customer_id", "left")
        .join(counted(phones, "phone_count"), "customer_id", "left")
        .join(counted(emails, "email_count"), "customer_id", "left")
        .fillna(0, ["phone_count", "email_count"])
    )
    tier, phone, email = c("customer_tier"), c("phone_count"), c("email_count")
    resolved = (
        F.when((tier == "Standard") & (phone >= 3) & (email >= 2), "Bronze")
        .when((tier == "Bronze") & (c("person_type") == "SC") & (phone >= 2), "Silver")
        .when((tier == "Silver") & c("title").isin(*TITLES) & (email >= 3), "Gold")
        .when((tier == "Gold") & (phone == 0), "Silver")
        .otherwise(tier)
    )
    return joined.select(*customers.columns, "phone_count", "email_count", resolved.alias("resolved_tier"))


# --- pricing audit ------------------------------------------------------------------------

# Violation, severity; the first that applies names the row.
VIOLATIONS = [
    ("OVER_DISCOUNT", 3),
    ("NEGATIVE_DISCOUNT", 3),
    ("ZERO_PRICE", 3),
    ("NEGATIVE_LINE_TOTAL", 2),
    ("ZERO_QTY", 2),
]


def audit_violations(
    lines: DataFrame,
    orders: DataFrame,
    territories: DataFrame,
    products: DataFrame,
    pricing_rules: DataFrame,
    start: dt.date,
    end: dt.date,
) -> DataFrame:
    """Lines that break a pricing rule, one row per rule they are held against.

    Rules match on category, territory group and date only, so a line meets
    the rules of all tiers and subcategories of its category.
    """
    kept = orders.where(c("order_date").between(F.lit(start), F.lit(end))).select(
        "order_id", "order_date", "territory_id"
    )
    dated = join_dimension(
        lines.join(kept, "order_id"), territories.select("territory_id", "territory_group"), "territory_id"
    ).join(products.select("product_id", "category_name"), "product_id")
    allowed = pricing_rules.select(
        c("category_name").alias("rule_category"),
        c("territory_group").alias("rule_territory"),
        "discount_pct",
        "effective_date",
        "expiry_date",
    )
    keys = [("category_name", "rule_category"), ("territory_group", "rule_territory")]
    held = join_effective_date(dated, allowed, keys, "order_date")
    limit = F.coalesce(c("discount_pct"), F.lit(0))
    tests = {
        "OVER_DISCOUNT": c("unit_price_discount") > limit + F.lit(Decimal(ALLOWANCE)),
        "NEGATIVE_DISCOUNT": c("unit_price_discount") < 0,
        "ZERO_PRICE": c("unit_price") <= 0,
        "NEGATIVE_LINE_TOTAL": c("line_total") < 0,
        "ZERO_QTY": c("order_qty") <= 0,
    }
    kind = F.lit(None).cast("string")
    severity = F.lit(None).cast("int")
    for name, level in reversed(VIOLATIONS):
        kind = F.when(tests[name], name).otherwise(kind)
        severity = F.when(tests[name], level).otherwise(severity)
    return held.select(
        "order_id",
        "line_no",
        "product_id",
        c("unit_price_discount").alias("applied_discount_on_record"),
        limit.alias("max_allowed_discount"),
        kind.alias("violation_type"),
        severity.alias("severity"),
        "category_name",
        "territory_group",
        "order_date",
    ).where(c("violation_type").isNotNull())


def audit_status(violations: DataFrame) -> DataFrame:
    """One row: violation count, WARN or OK, and the log message."""
    counted = violations.agg(F.count("*").alias("violation_count"))
    return counted.select(
        "violation_count",
        F.when(c("violation_count") > 0, "WARN").otherwise("OK").alias("status"),
        F.concat(F.lit("Violations found: "), c("violation_count").cast("string")).alias("message"),
    )
