"""The sales workload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.catalog import bindings as b
from tallyspark.catalog.registry import query
from tallyspark.functions import rules
from tallyspark.functions.scalars import as_money
from tallyspark.plans import sales
from tallyspark.session import materialise

P = b.SALES_PARAMS


def _lines(t):
    return sales.sales_lines(b.sales_orders(t), b.sales_order_lines(t), b.sales_products(t), P)


def _profile(t):
    return sales.customer_profile(b.sales_customers(t), _lines(t), P)


def _revenue(t, by_customer_tier: bool = True):
    if not by_customer_tier:
        return sales.revenue_calc(_lines(t), P)
    # read twice: for the customers' tiers and for their lines
    lines = materialise(_lines(t), "sales")
    tiers = sales.customer_tiers(sales.customer_profile(b.sales_customers(t), lines, P))
    return sales.revenue_calc(lines, P, tiers)


@query(
    "view_active_products",
    b.SALES_SQL
    + """
    SELECT product_id, product_name, category_name, CAST(unit_price AS DOUBLE) AS unit_price,
           CAST(units_in_stock AS BIGINT) AS units_in_stock, description, price_tier,
           CAST(days_since_listed AS BIGINT) AS days_since_listed FROM active
    """,
)
def _(t):
    return sales.active_products(b.sales_products(t), P.as_of)


@query(
    "sales_staging",
    b.SALES_SQL
    + f"""
    SELECT order_id, CAST(line_no AS BIGINT) AS line_no, customer_id, CAST(order_date AS VARCHAR) AS order_date,
           product_id, product_name, category_name, price_tier, quantity, CAST(line_total AS DOUBLE) AS line_total,
           CAST(discount_applied AS DOUBLE) AS discount_applied, CAST(shipping_cost AS DOUBLE) AS shipping_cost,
           order_status, days_to_ship, shipping_speed, order_year, order_month, order_weekday,
           row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, {b.TIE_SQL}) AS customer_order_rank,
           CAST(sum(line_total) OVER (PARTITION BY customer_id ORDER BY order_date, {b.TIE_SQL}
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_customer_total,
           count(*) OVER (PARTITION BY category_name) AS category_order_count,
           ntile(4) OVER (ORDER BY line_total DESC, {b.TIE_SQL}) AS revenue_quartile
    FROM sales
    """,
)
def _(t):
    return sales.stage_sales(b.sales_orders(t), b.sales_order_lines(t), b.sales_products(t), P)


@query(
    "daily_summary",
    b.SALES_SQL
    + """
    SELECT CAST(order_date AS VARCHAR) AS summary_date, count(DISTINCT order_id) AS order_count,
           count(DISTINCT customer_id) AS unique_customers, CAST(sum(line_total) AS DOUBLE) AS daily_revenue,
           CAST(sum(line_total) AS DOUBLE) / count(*) AS avg_order_value,
           CAST(min(line_total) AS DOUBLE) AS min_order_value, CAST(max(line_total) AS DOUBLE) AS max_order_value,
           count(*) FILTER (WHERE shipping_speed = 'Fast') AS fast_ship_count,
           count(*) FILTER (WHERE shipping_speed = 'Delayed') AS delayed_ship_count,
           string_agg(DISTINCT category_name, ', ' ORDER BY category_name) AS categories_sold,
           CAST(sum(discount_applied) AS DOUBLE) AS total_discounts,
           CAST(sum(shipping_cost) AS DOUBLE) AS total_shipping
    FROM sales GROUP BY order_date
    """,
)
def _(t):
    return sales.daily_summary(_lines(t))


_PROFILE_COLUMNS = """
    customer_id, customer_name, email, region, CAST(registration_date AS VARCHAR) AS registration_date,
    CAST(account_age_days AS BIGINT) AS account_age_days, total_orders, CAST(spend AS DOUBLE) AS total_spend,
    avg_order_value, CAST(first_order_date AS VARCHAR) AS first_order_date,
    CAST(last_order_date AS VARCHAR) AS last_order_date,
    CAST(days_since_last_order AS BIGINT) AS days_since_last_order, avg_days_to_ship,
    categories AS unique_categories_purchased, CAST(lifetime_value AS DOUBLE) AS lifetime_value,
    engagement || ' (' || customer_tier || ')' AS engagement_status, customer_tier
"""


@query(
    "customer_profile",
    b.PROFILE_SQL
    + f"""
    SELECT {_PROFILE_COLUMNS},
           row_number() OVER (ORDER BY spend DESC, customer_id) AS spend_rank,
           percent_rank() OVER (ORDER BY spend) AS spend_percentile,
           dense_rank() OVER (PARTITION BY region ORDER BY spend DESC) AS regional_rank,
           CAST(lag(spend) OVER r AS DOUBLE) AS prev_customer_spend,
           CAST(lead(spend) OVER r AS DOUBLE) AS next_customer_spend
    FROM profile WINDOW r AS (PARTITION BY region ORDER BY spend DESC, customer_id)
    """,
)
def _(t):
    return sales.rank_customers(_profile(t))


@query(
    "customer_tier_rule",
    b.PROFILE_SQL + "SELECT customer_tier, count(*) AS customers FROM profile GROUP BY 1",
)
def _(t):
    return _profile(t).groupBy("customer_tier").agg(F.count("*").alias("customers"))


@query(
    "discount_rule",
    """
    WITH x AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(19,4)) / 1000 AS raw, o_orderdate,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Platinum' WHEN '2-HIGH' THEN 'Gold' WHEN '3-MEDIUM' THEN 'Silver'
             WHEN '4-NOT SPECIFIED' THEN 'Bronze' ELSE 'Standard' END AS tier FROM orders),
    y AS (SELECT o_orderkey, CAST(floor(raw) AS DECIMAL(19,4)) AS amount,
        CAST(CASE tier WHEN 'Platinum' THEN 0.15 WHEN 'Gold' THEN 0.10 WHEN 'Silver' THEN 0.05 WHEN 'Bronze' THEN 0.02 ELSE 0 END
        + CASE WHEN month(o_orderdate) IN (11, 12) THEN 0.05 ELSE 0 END AS DECIMAL(6,4)) AS rate FROM x)
    SELECT o_orderkey AS order_id, CAST(CASE WHEN amount > 50 AND amount * rate < 1 THEN 1 ELSE amount * rate END AS DOUBLE) AS discount FROM y
    """,
)
def _(t):
    amount = F.floor(as_money(F.col("o_totalprice")) / 1000)
    tiers = {
        "1-URGENT": "Platinum",
        "2-HIGH": "Gold",
        "3-MEDIUM": "Silver",
        "4-NOT SPECIFIED": "Bronze",
    }
    tier = rules.lookup(F.col("o_orderpriority"), tiers, "Standard")
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        rules.order_discount(as_money(amount), tier, rules.in_season(F.col("o_orderdate"))).alias("discount"),
    )


_REVENUE_COLUMNS = """
    SELECT order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date, product_id, category_name,
           CAST(line_total AS DOUBLE) AS line_total, CAST(discount AS DOUBLE) AS calculated_discount,
           CAST(net AS DOUBLE) AS net_revenue, CAST(shipping_cost AS DOUBLE) AS shipping_cost,
           CAST(profit AS DOUBLE) AS profit,
           CASE WHEN line_total > 500 THEN 'High Value' WHEN line_total > 100 THEN 'Medium Value' ELSE 'Low Value' END AS order_value_segment,
           order_year, order_month, datediff('month', DATE '1996-01-01', order_date) AS months_from_start
    FROM revenue
"""


@query("revenue_calc", b.revenue_sql(True) + _REVENUE_COLUMNS)
def _(t):
    return _revenue(t)


@query("revenue_calc_by_price_tier", b.revenue_sql(False) + _REVENUE_COLUMNS)
def _(t):
    return _revenue(t, by_customer_tier=False)


@query(
    "monthly_revenue",
    b.revenue_sql(True)
    + """, m AS (
        SELECT order_year, order_month, count(DISTINCT order_id) AS orders, sum(line_total) AS gross,
               sum(discount) AS discounts, sum(net) AS net, sum(profit) AS profit FROM revenue GROUP BY 1, 2)
    SELECT order_year, order_month, orders, CAST(gross AS DOUBLE) AS total_gross, CAST(discounts AS DOUBLE) AS total_discounts,
           CAST(net AS DOUBLE) AS total_net, CAST(profit AS DOUBLE) AS total_profit,
           CAST(profit AS DOUBLE) / CAST(gross AS DOUBLE) * 100 AS profit_margin_pct,
           CAST(sum(net) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cumulative_revenue,
           CAST(sum(net) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE)
               / count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three_month_avg,
           CAST(net - lag(net) OVER w AS DOUBLE) AS mom_growth
    FROM m WINDOW w AS (ORDER BY order_year, order_month)
    """,
)
def _(t):
    return sales.monthly_revenue(_revenue(t))


@query(
    "revenue_pivot",
    b.revenue_sql(True)
    + "SELECT category_name, "
    + ", ".join(
        f'CAST(sum(net) FILTER (WHERE order_month = {m}) AS DOUBLE) AS "{m}"' for m in range(1, 13)
    )
    + " FROM revenue GROUP BY category_name",
)
def _(t):
    return sales.revenue_pivot(_revenue(t))


@query(
    "revenue_projection",
    b.revenue_sql(True)
    + """, m AS (SELECT order_year, order_month, CAST(sum(net) AS DOUBLE) AS v FROM revenue GROUP BY 1, 2),
    s AS (SELECT row_number() OVER (ORDER BY order_year, order_month) AS x, v FROM m),
    f AS (SELECT count(*) AS n, avg(v) AS mean, regr_slope(v, x) AS slope FROM s)
    SELECT 'Next Quarter Projection' AS label, round(mean * 3 + coalesce(slope, 0) * (n + 1.5) * 3, 2) AS projected_revenue,
           round(mean, 2) AS baseline_monthly, round(slope, 2) AS monthly_trend, n AS months_analyzed FROM f
    """,
)
def _(t):
    projection = sales.revenue_projection(_revenue(t))
    return projection.select(
        "label",
        *[F.round(n, 2).alias(n) for n in ("projected_revenue", "baseline_monthly", "monthly_trend")],
        "months_analyzed",
    )


def _report(t, kind: str):
    return sales.report(
        b.sales_orders(t), b.sales_order_lines(t), b.sales_products(t), b.sales_customers(t), P, kind
    )


_SUMMARY_SQL = (
    b.revenue_sql(True)
    + f"""
    SELECT '{P.start}' AS report_start_date, '{P.end}' AS report_end_date,
           CAST(DATE '{P.end}' - DATE '{P.start}' AS BIGINT) AS report_days,
           count(DISTINCT customer_id) AS total_customers, count(DISTINCT order_id) AS total_orders,
           CAST(sum(line_total) AS DOUBLE) AS gross_revenue, CAST(sum(line_total) AS DOUBLE) AS gross_revenue_calc,
           CAST(sum(net) AS DOUBLE) AS net_revenue,
           CAST(sum(profit) AS DOUBLE) AS total_profit, CAST(sum(line_total) AS DOUBLE) / count(*) AS avg_order_value,
           count(DISTINCT category_name) AS categories_active
    FROM revenue
    """
)


@query("report_summary", _SUMMARY_SQL)
def _(t):
    return _report(t, "Summary")["summary"]


@query(
    "report_top_customers",
    b.PROFILE_SQL
    + """, r AS (SELECT *, row_number() OVER (ORDER BY spend DESC, customer_id) AS spend_rank,
                       percent_rank() OVER (ORDER BY spend) AS spend_percentile FROM profile)
    SELECT customer_id, customer_name, region, total_orders, CAST(spend AS DOUBLE) AS total_spend, avg_order_value,
           engagement || ' (' || customer_tier || ')' AS engagement_status, spend_rank, spend_percentile,
           CAST(days_since_last_order AS BIGINT) AS days_since_last_order,
           CASE WHEN days_since_last_order <= 30 AND spend > 100000 THEN 'Retain (VIP Active)'
                WHEN days_since_last_order <= 90 AND spend > 50000 THEN 'Engage (High Potential)'
                WHEN days_since_last_order > 180 AND spend > 100000 THEN 'Win Back (Lapsed VIP)'
                WHEN days_since_last_order > 90 THEN 'Re-engage' ELSE 'Monitor' END AS action_recommendation
    FROM r WHERE spend_rank <= 20
    """,
)
def _(t):
    return _report(t, "Customers")["top_customers"]


@query(
    "report_categories",
    b.revenue_sql(True)
    + """, j AS (
        SELECT s.category_name, s.order_id, s.customer_id, s.line_total, r.profit
        FROM revenue s LEFT JOIN revenue r ON s.order_id = r.order_id AND s.product_id = r.product_id
    ), g AS (
        SELECT category_name, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS unique_customers,
               sum(line_total) AS revenue, count(*) AS n, sum(profit) AS profit FROM j GROUP BY 1)
    SELECT category_name, orders, unique_customers, CAST(revenue AS DOUBLE) AS revenue,
           CAST(revenue AS DOUBLE) / n AS avg_order_value,
           CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE) * 100 AS revenue_share_pct,
           row_number() OVER (ORDER BY revenue DESC, category_name) AS revenue_rank,
           CAST(profit AS DOUBLE) AS category_profit, CAST(profit AS DOUBLE) / CAST(revenue AS DOUBLE) * 100 AS margin_pct
    FROM g
    """,
)
def _(t):
    return _report(t, "Categories")["categories"]


def _section_rows(t, kind: str):
    """Rows of the sections that one kind of report has: section, name, orders, customers."""
    columns = {
        "categories": [F.col("category_name"), F.col("orders"), F.col("unique_customers")],
        "summary": [F.lit("all"), F.col("total_orders"), F.col("total_customers")],
        "top_customers": [F.col("customer_id").cast("string"), F.col("total_orders"), F.lit(1)],
    }
    rows = []
    for section, df in sorted(_report(t, kind).items()):
        name, orders, customers = columns[section]
        rows.append(
            df.select(
                F.lit(kind).alias("kind"),
                F.lit(section).alias("section"),
                name.alias("name"),
                orders.cast("bigint").alias("orders"),
                customers.cast("bigint").alias("customers"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


@query(
    "branch_by_param",
    b.revenue_sql(True)
    + """, sections AS (
        SELECT 'categories' AS section, category_name AS name, count(DISTINCT order_id) AS orders,
               count(DISTINCT customer_id) AS customers FROM revenue GROUP BY category_name
        UNION ALL SELECT 'summary', 'all', count(DISTINCT order_id), count(DISTINCT customer_id) FROM revenue
        UNION ALL SELECT 'top_customers', CAST(customer_id AS VARCHAR), total_orders, 1
            FROM (SELECT *, row_number() OVER (ORDER BY spend DESC, customer_id) AS n FROM profile) WHERE n <= 20)
    SELECT 'Full' AS kind, * FROM sections
    UNION ALL SELECT 'Summary', * FROM sections WHERE section = 'summary'
    """,
)
def _(t):
    return _section_rows(t, "Full").unionByName(_section_rows(t, "Summary"))


@query(
    "cte_chain",
    b.SALES_SQL
    + """, per_day AS (SELECT order_date, sum(line_total) AS total FROM sales GROUP BY 1),
    per_month AS (SELECT date_trunc('month', order_date) AS month, max(total) AS best FROM per_day GROUP BY 1)
    SELECT CAST(CAST(month AS DATE) AS VARCHAR) AS month, CAST(best AS DOUBLE) AS best FROM per_month
    """,
)
def _(t):
    per_day = _lines(t).groupBy("order_date").agg(F.sum("line_total").alias("total"))
    month = F.trunc("order_date", "month")
    return per_day.groupBy(month.alias("month")).agg(F.max("total").alias("best"))


@query(
    "temp_materialize",
    b.SALES_SQL
    + """
    SELECT category_name, count(*) AS lines, CAST(max(line_total) AS DOUBLE) AS largest, 'all' AS part FROM sales GROUP BY 1
    UNION ALL
    SELECT category_name, count(*), CAST(max(line_total) AS DOUBLE), 'fast' FROM sales WHERE shipping_speed = 'Fast' GROUP BY 1
    """,
)
def _(t):
    # staged once, read twice; lineage ends at the shared folder
    staged = materialise(_lines(t).select("category_name", "line_total", "shipping_speed"))

    def summed(df, part):
        return df.groupBy("category_name").agg(
            F.count("*").alias("lines"), F.max("line_total").alias("largest")
        ).withColumn("part", F.lit(part))

    return summed(staged, "all").union(summed(staged.where("shipping_speed = 'Fast'"), "fast"))
