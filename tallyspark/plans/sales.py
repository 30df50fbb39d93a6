"""Order staging, daily summary, customer profile, revenue and the report.

Frames and their columns:

* products: product_id, product_name, category_name, unit_price, units_in_stock,
  description, is_active, is_deleted, created_date
* orders: order_id, customer_id, order_date, shipping_cost, order_status
* lines: order_id, line_no, product_id, quantity, line_total, discount, shipped_date
* customers: customer_id, customer_name, email, region, registration_date, is_active

Shipping cost is per order but counted on every line of it, and a customer's
history is ordered by date; where the source rule leaves ties open they are
broken by the line's own columns.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.scalars import MONEY, all_of, months_crossed, safe_ratio
from tallyspark.operators import ranking, trend
from tallyspark.operators.cuts import with_tiles
from tallyspark.operators.joins import join_dimension
from tallyspark.operators.levels import spread
from tallyspark.session import materialise

c = F.col

# Lower bounds (exclusive) of price tiers and order value segments.
PRICE_TIERS = [("Premium", 100), ("Standard", 50), ("Budget", 10)]
VALUE_SEGMENTS = [("High Value", 500), ("Medium Value", 100)]

TIE_BREAK = [
    ("order_id", "asc"),
    ("line_no", "asc"),
    ("product_id", "asc"),
    ("line_total", "asc"),
    ("discount_applied", "asc"),
    ("days_to_ship", "asc"),
]


@dataclass(frozen=True)
class SalesParams:
    start: dt.date
    end: dt.date
    as_of: dt.date
    min_amount: Decimal = Decimal("0")
    tier_scale: int = 1


def active_products(products: DataFrame, as_of: dt.date) -> DataFrame:
    """Products on sale, with price tier and days since listing."""
    on_sale = c("is_active") & ~c("is_deleted") & (c("units_in_stock") > 0)
    return products.where(on_sale).select(
        "product_id",
        "product_name",
        "category_name",
        "unit_price",
        "units_in_stock",
        F.coalesce("description", F.lit("No description")).alias("description"),
        rules.first_above(c("unit_price"), PRICE_TIERS, "Clearance").alias("price_tier"),
        F.datediff(F.lit(as_of), "created_date").alias("days_since_listed"),
    )


def sales_lines(orders: DataFrame, lines: DataFrame, products: DataFrame, p: SalesParams) -> DataFrame:
    """Order lines of the period with product, shipping speed and date parts."""
    kept = orders.where(
        all_of(
            c("order_date").between(F.lit(p.start), F.lit(p.end)), c("order_status") != "Cancelled"
        )
    )
    listed = active_products(products, p.as_of).select(
        "product_id", "product_name", "category_name", "price_tier"
    )
    joined = (
        lines.where(c("line_total") >= F.lit(p.min_amount))
        .join(kept, "order_id")
        .join(listed, "product_id")
    )
    shipped = F.coalesce("shipped_date", F.lit(p.as_of))
    days = F.datediff(shipped, "order_date")
    return joined.select(
        "order_id",
        "line_no",
        "customer_id",
        "order_date",
        "product_id",
        "product_name",
        "category_name",
        "price_tier",
        "quantity",
        "line_total",
        F.coalesce("discount", F.lit(0)).alias("discount_applied"),
        "shipping_cost",
        "order_status",
        days.alias("days_to_ship"),
        rules.first_within(days, rules.SHIPPING_SPEEDS, "Delayed").alias("shipping_speed"),
        F.year("order_date").alias("order_year"),
        F.month("order_date").alias("order_month"),
        F.dayofweek("order_date").alias("order_weekday"),
    )


def with_history(lines: DataFrame, rank: str | None = None) -> DataFrame:
    """Each customer's running total, a day of a customer at a time.

    ``rank`` names the customer's line rank, newest day first, on request.
    """
    return ranking.running_by_bucket(
        lines,
        ["customer_id"],
        "order_date",
        [("order_date", "asc"), *TIE_BREAK],
        sums={"line_total": "running_customer_total"},
        count_down=rank,
    )


def stage_sales(orders: DataFrame, lines: DataFrame, products: DataFrame, p: SalesParams) -> DataFrame:
    """Sales lines plus history, category count and revenue quartile columns.

    The lines are joined once and written. The quartile ranks all lines of the
    period by three cut rows; no wide row is sorted for it.
    """
    base = materialise(sales_lines(orders, lines, products, p), "sales")
    tiled = with_tiles(base, {"revenue_quartile": ([("line_total", "desc"), *TIE_BREAK], 4)})
    counts = tiled.groupBy("category_name").agg(F.count("*").alias("category_order_count"))
    return with_history(tiled, "customer_order_rank").join(counts, "category_name")


def daily_summary(lines: DataFrame) -> DataFrame:
    """One row per day with orders, customers, revenue, shipping and categories.

    Lines are summed per order first: an order has one day and one customer,
    so days then count orders by rows and only customers need a distinct
    count. The category names of a day are collected from distinct
    (day, category) pairs.
    """

    def count_where(speed: str) -> Column:
        return F.sum(F.when(c("shipping_speed") == speed, 1).otherwise(0))

    per_order = lines.groupBy("order_date", "order_id", "customer_id").agg(
        F.sum("line_total").alias("total"),
        F.count("line_total").alias("lines"),
        F.min("line_total").alias("smallest"),
        F.max("line_total").alias("largest"),
        count_where("Fast").alias("fast"),
        count_where("Delayed").alias("delayed"),
        F.sum("discount_applied").alias("discounts"),
        F.sum("shipping_cost").alias("shipping"),
    )
    days = per_order.groupBy("order_date").agg(
        F.count("*").alias("order_count"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.sum("total").alias("daily_revenue"),
        safe_ratio(F.sum("total"), F.sum("lines")).alias("avg_order_value"),
        F.min("smallest").alias("min_order_value"),
        F.max("largest").alias("max_order_value"),
        F.sum("fast").alias("fast_ship_count"),
        F.sum("delayed").alias("delayed_ship_count"),
        F.sum("discounts").alias("total_discounts"),
        F.sum("shipping").alias("total_shipping"),
    )
    sold = lines.select("order_date", "category_name").distinct()
    names = sold.groupBy("order_date").agg(
        F.array_join(F.sort_array(F.collect_list("category_name")), ", ").alias("categories_sold")
    )
    return days.join(names, "order_date").withColumnRenamed("order_date", "summary_date")


# --- customers --------------------------------------------------------------------


def customer_history(lines: DataFrame, running: bool = False) -> DataFrame:
    """Sums, days and distinct orders and categories per customer, counted by levels.

    Orders are rows of (customer, order), which hold the set of their
    categories, bounded by an order's lines; categories are rows of (customer,
    category). The lifetime value is the sum, or with ``running`` the highest
    running total.
    """
    adds = {
        "spend": F.sum("line_total"),
        "line_count": F.count("line_total"),
        "ship_days": F.sum("days_to_ship"),
        "ship_count": F.count("days_to_ship"),
    }
    highest = [F.max("running_customer_total").alias("__highest")] if running else []
    per_order = lines.groupBy("customer_id", "order_id").agg(
        *[value.alias(name) for name, value in adds.items()],
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        *highest,
        F.collect_set("category_name").alias("__categories"),
    )
    counted = per_order.withColumn("orders", F.when(c("order_id").isNotNull(), 1).otherwise(0).cast("bigint"))
    rows = spread(counted, "__categories", "category_name", [*adds, "orders"])
    merged = [
        *[F.sum(name).alias(name) for name in [*adds, "orders"]],
        F.min("first_order_date").alias("first_order_date"),
        F.max("last_order_date").alias("last_order_date"),
        *([F.max("__highest").alias("__highest")] if running else []),
    ]
    per_category = rows.groupBy("customer_id", "category_name").agg(*merged)
    per_customer = per_category.groupBy("customer_id").agg(*merged, F.count("category_name").alias("categories"))
    spend = c("spend").cast("decimal(29,4)")
    lifetime = c("__highest") if running else spend
    return per_customer.withColumn("lifetime_value", lifetime).withColumn("spend", spend).drop("__highest")


def customer_profile(
    customers: DataFrame, lines: DataFrame, p: SalesParams, show_tier: bool = True
) -> DataFrame:
    """One row per active customer; the tier is appended to the engagement label.

    The lifetime value is the highest running total. Lines below the minimum
    amount were dropped, so unless that is negative totals only grow and the
    highest is the sum.
    """
    if p.min_amount < 0:
        history = customer_history(with_history(lines), running=True)
    else:
        history = customer_history(lines)
    joined = customers.where("is_active").join(history, "customer_id", "left")
    idle = F.datediff(F.lit(p.as_of), "last_order_date")
    zero = F.lit(0.0)
    profile = joined.select(
        "customer_id",
        "customer_name",
        "email",
        F.coalesce("region", F.lit("Unknown")).alias("region"),
        "registration_date",
        F.datediff(F.lit(p.as_of), "registration_date").alias("account_age_days"),
        F.coalesce("orders", F.lit(0)).alias("total_orders"),
        F.coalesce("spend", F.lit(0).cast(MONEY)).alias("total_spend"),
        F.coalesce(safe_ratio(c("spend"), c("line_count")), zero).alias("avg_order_value"),
        "first_order_date",
        "last_order_date",
        idle.alias("days_since_last_order"),
        F.coalesce(safe_ratio(c("ship_days"), c("ship_count")), zero).alias("avg_days_to_ship"),
        F.coalesce("categories", F.lit(0)).alias("unique_categories_purchased"),
        "lifetime_value",
        rules.first_within(idle, rules.ENGAGEMENT, "Dormant").alias("engagement_status"),
    )
    tier = rules.customer_tier(
        c("total_spend"), c("total_orders"), c("account_age_days"), p.tier_scale
    )
    profile = profile.withColumn("customer_tier", tier)
    if show_tier:
        label = F.concat("engagement_status", F.lit(" ("), "customer_tier", F.lit(")"))
        profile = profile.withColumn("engagement_status", label)
    return profile


def rank_customers(profile: DataFrame) -> DataFrame:
    """Spend rank and percentile overall, rank and neighbours within the region.

    The profile is written once; the ranking passes carry three columns. The
    percentile follows from the spend rank: customers behind the last one
    with the same spend are those who spend less.
    """
    profile = materialise(profile, "profile")
    by_spend = [("total_spend", "desc"), ("customer_id", "asc")]
    slim = profile.select("customer_id", "region", "total_spend")
    placed = ranking.global_row_number(slim, by_spend, "spend_rank", "__n")
    last = placed.groupBy("total_spend").agg(F.max("spend_rank").alias("__last"))
    less = F.when(c("__n") > 1, (c("__n") - c("__last")) / (c("__n") - 1)).otherwise(F.lit(0.0))
    overall = placed.join(last, "total_spend").select(
        "customer_id", "spend_rank", less.alias("spend_percentile")
    )
    beside = ranking.with_neighbours(
        slim, ["region"], by_spend, "total_spend", "prev_customer_spend", "next_customer_spend"
    ).drop("region", "total_spend")
    regional = ranking.value_ranks(slim, ["region"], [("total_spend", "desc")]).select(
        "region", "total_spend", c("dense_rank").alias("regional_rank")
    )
    return (
        profile.join(overall, "customer_id")
        .join(beside, "customer_id")
        .join(regional, ["region", "total_spend"])
    )


# --- revenue ------------------------------------------------------------------------


def customer_tiers(profile: DataFrame) -> DataFrame:
    return profile.select("customer_id", "customer_tier")


def revenue_calc(lines: DataFrame, p: SalesParams, tiers: DataFrame | None = None) -> DataFrame:
    """Discount, net revenue and profit per line.

    With ``tiers`` (customer_id, customer_tier) the discount follows the
    customer's tier. Without, it is looked up by price tier as the source
    rule literally does; those names never match, so only the seasonal rate
    and the minimum apply.
    """
    if tiers is not None:
        lines = lines.join(tiers, "customer_id", "left")
        tier = c("customer_tier")
    else:
        tier = c("price_tier")
    discount = rules.order_discount(c("line_total"), tier, rules.in_season(c("order_date")))
    priced = lines.withColumn("calculated_discount", discount)
    net = c("line_total") - c("calculated_discount")
    return priced.select(
        "order_id",
        "customer_id",
        "order_date",
        "product_id",
        "category_name",
        "line_total",
        "calculated_discount",
        net.alias("net_revenue"),
        "shipping_cost",
        (net - c("shipping_cost")).alias("profit"),
        rules.first_above(c("line_total"), VALUE_SEGMENTS, "Low Value").alias("order_value_segment"),
        "order_year",
        "order_month",
        months_crossed(F.lit(p.start), c("order_date")).alias("months_from_start"),
    )


def monthly_revenue(revenue: DataFrame) -> DataFrame:
    """Totals per month with cumulative, three-month and month-on-month figures.

    The windows run over one row per calendar month.
    """
    monthly = revenue.groupBy("order_year", "order_month").agg(
        F.countDistinct("order_id").alias("orders"),
        F.sum("line_total").alias("total_gross"),
        F.sum("calculated_discount").alias("total_discounts"),
        F.sum("net_revenue").alias("total_net"),
        F.sum("profit").alias("total_profit"),
    )
    by_month = Window.orderBy("order_year", "order_month")
    so_far = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    three = by_month.rowsBetween(-2, Window.currentRow)
    return monthly.select(
        "*",
        (safe_ratio(c("total_profit"), c("total_gross")) * 100).alias("profit_margin_pct"),
        F.sum("total_net").over(so_far).alias("cumulative_revenue"),
        safe_ratio(F.sum("total_net").over(three), F.count("total_net").over(three)).alias(
            "three_month_avg"
        ),
        (c("total_net") - F.lag("total_net").over(by_month)).alias("mom_growth"),
    )


def revenue_pivot(revenue: DataFrame) -> DataFrame:
    months = list(range(1, 13))
    return (
        revenue.groupBy("category_name").pivot("order_month", months).agg(F.sum("net_revenue"))
    )


def revenue_projection(revenue: DataFrame) -> DataFrame:
    """Next quarter from the linear trend of the monthly totals."""
    monthly = revenue.groupBy("order_year", "order_month").agg(F.sum("net_revenue").alias("total"))
    fit = trend.linear_trend(monthly, ["order_year", "order_month"], "total")
    growth = F.coalesce("slope", F.lit(0.0)) * (c("points") + 1.5) * 3
    return fit.select(
        F.lit("Next Quarter Projection").alias("label"),
        (c("mean") * 3 + growth).alias("projected_revenue"),
        c("mean").alias("baseline_monthly"),
        c("slope").alias("monthly_trend"),
        c("points").alias("months_analyzed"),
    )


# --- report -------------------------------------------------------------------------


def report_summary(revenue: DataFrame, p: SalesParams, staged: DataFrame | None = None) -> DataFrame:
    """One row of totals: counts and gross revenue of the staged lines, and the calculated revenue.

    Without ``staged`` the revenue lines, which are the staged lines, serve for
    both. Customers, orders and categories are counted by levels.
    """
    staged = revenue if staged is None else staged
    per_order = staged.groupBy("customer_id", "order_id").agg(
        F.sum("line_total").alias("gross"),
        F.count("line_total").alias("lines"),
        F.collect_set("category_name").alias("__categories"),
    )
    counted = per_order.withColumn("orders", F.when(c("order_id").isNotNull(), 1).otherwise(0))
    adds = ["gross", "lines", "orders"]
    added = [F.sum(name).alias(name) for name in adds]
    rows = spread(counted, "__categories", "category_name", adds)
    per_category = rows.groupBy("customer_id", "category_name").agg(*added)
    # at most one member per category of the dimension
    per_customer = per_category.groupBy("customer_id").agg(*added, F.collect_set("category_name").alias("__categories"))
    counted = per_customer.withColumn("customers", F.when(c("customer_id").isNotNull(), 1).otherwise(0))
    rows = spread(counted.drop("customer_id"), "__categories", "category_name", [*adds, "customers"])
    totals = (
        rows.groupBy("category_name")
        .agg(*added, F.sum("customers").alias("customers"))
        .agg(*added, F.sum("customers").alias("customers"), F.count("category_name").alias("categories"))
    )
    calculated = revenue.agg(
        F.sum("line_total").alias("gross_revenue_calc"),
        F.sum("net_revenue").alias("net_revenue"),
        F.sum("profit").alias("total_profit"),
    )
    # one row each
    return totals.join(F.broadcast(calculated)).select(
        F.lit(p.start).alias("report_start_date"),
        F.lit(p.end).alias("report_end_date"),
        F.lit((p.end - p.start).days).alias("report_days"),
        F.coalesce("customers", F.lit(0)).alias("total_customers"),
        F.coalesce("orders", F.lit(0)).alias("total_orders"),
        c("gross").alias("gross_revenue"),
        "gross_revenue_calc",
        "net_revenue",
        "total_profit",
        safe_ratio(c("gross"), c("lines")).alias("avg_order_value"),
        c("categories").alias("categories_active"),
    )


def report_top_customers(profile: DataFrame, n: int = 20, scale: int = 1) -> DataFrame:
    """The n customers of largest spend with rank, percentile and action.

    Only n customers and n distinct spends are ranked. The percentile needs
    how many customers spend less, which the counts of those spends tell.
    """
    top = profile.orderBy(F.desc_nulls_last("total_spend"), "customer_id").limit(n)
    top = top.withColumn(
        "spend_rank", F.row_number().over(Window.orderBy(F.desc("total_spend"), "customer_id"))
    )
    spends = profile.groupBy("total_spend").agg(F.count("*").alias("__same"))
    largest = spends.orderBy(F.desc("total_spend")).limit(n)
    so_far = Window.orderBy(F.desc("total_spend")).rowsBetween(Window.unboundedPreceding, 0)
    largest = largest.select("total_spend", F.sum("__same").over(so_far).alias("__at_least"))
    everyone = profile.agg(F.count("*").alias("__all"))
    percentile = F.when(
        c("__all") > 1, (c("__all") - c("__at_least")) / (c("__all") - 1)
    ).otherwise(F.lit(0.0))
    idle, spend = c("days_since_last_order"), c("total_spend")
    action = (
        F.when((idle <= 30) & (spend > 1000 * scale), "Retain (VIP Active)")
        .when((idle <= 90) & (spend > 500 * scale), "Engage (High Potential)")
        .when((idle > 180) & (spend > 1000 * scale), "Win Back (Lapsed VIP)")
        .when(idle > 90, "Re-engage")
        .otherwise("Monitor")
    )
    return (
        top.join(F.broadcast(largest), "total_spend")
        .join(F.broadcast(everyone))
        .select(
            "customer_id",
            "customer_name",
            "region",
            "total_orders",
            "total_spend",
            "avg_order_value",
            "engagement_status",
            "spend_rank",
            percentile.alias("spend_percentile"),
            "days_since_last_order",
            action.alias("action_recommendation"),
        )
    )


def report_categories(revenue: DataFrame) -> DataFrame:
    """Share, rank and margin per category.

    The rule joins lines to lines of the same order and product, so a product
    on n lines of an order counts n times per line. Grouping by order and
    product first gives the same sums without that join. The grouping leaves
    the customer out, so it does not rest on the layout of the join with tiers,
    in which a busy customer lies in one task; AQE can split that join.
    """
    grain = revenue.groupBy("category_name", "order_id", "product_id").agg(
        F.count("*").alias("n"),
        F.sum("line_total").alias("lines"),
        F.sum("profit").alias("profit"),
        F.max("customer_id").alias("customer_id"),
    )
    weight = c("n").cast("decimal(10,0)")
    adds = {
        "revenue": (c("lines") * weight).cast("decimal(28,4)"),
        "__pairs": c("n") * c("n"),
        "category_profit": (c("profit") * weight).cast("decimal(28,4)"),
    }
    # an order has one customer: orders and customers are counted as rows, a level at a time
    per_order = grain.groupBy("category_name", "customer_id", "order_id").agg(
        *[F.sum(value).alias(name) for name, value in adds.items()]
    )
    per_customer = per_order.groupBy("category_name", "customer_id").agg(
        *[F.sum(name).alias(name) for name in adds], F.count("order_id").alias("orders")
    )
    sums = per_customer.groupBy("category_name").agg(
        *[F.sum(name).alias(name) for name in adds],
        F.sum("orders").alias("orders"),
        F.count("customer_id").alias("unique_customers"),
    )
    # one row per category
    by_revenue = Window.orderBy(F.desc("revenue"), "category_name")
    return sums.select(
        "category_name",
        "orders",
        "unique_customers",
        "revenue",
        safe_ratio(c("revenue"), c("__pairs")).alias("avg_order_value"),
        (safe_ratio(c("revenue"), F.sum("revenue").over(Window.partitionBy())) * 100).alias(
            "revenue_share_pct"
        ),
        F.row_number().over(by_revenue).alias("revenue_rank"),
        "category_profit",
        (safe_ratio(c("category_profit"), c("revenue")) * 100).alias("margin_pct"),
    )


def report(
    orders: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    p: SalesParams,
    kind: str = "Full",
) -> dict[str, DataFrame]:
    """The sections of one report kind: Full, Summary, Customers or Categories.

    Sections that were not asked for are never planned.
    """
    sections: dict[str, DataFrame] = {}
    # joined once, read by the profile, the revenue and the summary
    staged = materialise(sales_lines(orders, lines, products, p), "sales")
    profile = customer_profile(customers, staged, p)
    if kind in ("Full", "Customers"):
        profile = materialise(profile, "profile")
        sections["top_customers"] = report_top_customers(profile, scale=p.tier_scale)
    if kind in ("Full", "Summary", "Categories"):
        revenue = revenue_calc(staged, p, customer_tiers(profile))
        if kind in ("Full", "Summary"):
            sections["summary"] = report_summary(revenue, p, staged)
        if kind in ("Full", "Categories"):
            sections["categories"] = report_categories(revenue)
    return sections
