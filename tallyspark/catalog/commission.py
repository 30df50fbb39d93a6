"""The commission workload."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.catalog import bindings as b
from tallyspark.catalog.registry import query
from tallyspark.operators import joins
from tallyspark.plans import commission as plan
from tallyspark.sources import seeds

P = b.COMMISSION_PARAMS
c = F.col
RULES_START = dt.date(1998, 1, 1)


def d4(expression: str, name: str) -> str:
    """A decimal rounded to four places, as a double."""
    return f"CAST(round({expression}, 4) AS DOUBLE) AS {name}"


def _base(t):
    return plan.base_orders(
        b.commission_orders(t),
        b.commission_territories(t),
        b.seller_persons(t),
        b.seller_employees(t),
        b.seller_quotas(t),
        P,
    )


def _lines(t):
    return plan.order_lines(b.commission_lines(t), _base(t), b.commission_products(t))


def _priced(t, *needed):
    return plan.priced_lines(
        b.commission_lines(t), _base(t), b.commission_products(t), list(needed), P.threshold_scale
    )


def _finals(t, *needed):
    """Line finals; ``needed`` are the line's own and its product's columns beyond those computed from."""
    return plan.line_finals(_priced(t, "order_qty", "standard_cost", *needed))


@query(
    "comm_base_orders",
    b.COMMISSION_SQL
    + """
    SELECT order_id, customer_id, seller_id, CAST(territory_id AS BIGINT) AS territory_id, CAST(order_date AS VARCHAR) AS order_date,
           CAST(total_due AS DOUBLE) AS total_due, CAST(online AS BIGINT) AS online, territory_name, country_code,
           territory_group, seller_name, seller_title, CAST(sales_quota AS DOUBLE) AS sales_quota FROM base
    """,
)
def _(t):
    return _base(t)


@query(
    "comm_lines",
    b.COMMISSION_SQL
    + """
    SELECT order_id, CAST(line_no AS BIGINT) AS line_no, product_id, order_qty, unit_price,
           CAST(unit_price_discount AS DOUBLE) AS unit_price_discount, CAST(line_total AS DOUBLE) AS line_total,
           product_name, CAST(list_price AS DOUBLE) AS list_price, CAST(standard_cost AS DOUBLE) AS standard_cost,
           category_name, subcategory_name, CAST(order_date AS VARCHAR) AS order_date, territory_group, territory_name,
           country_code, customer_id, seller_id, seller_name, CAST(sales_quota AS DOUBLE) AS sales_quota,
           CAST(online AS BIGINT) AS online, CAST(gross_margin_unit AS DOUBLE) AS gross_margin_unit FROM lines
    """,
)
def _(t):
    return _lines(t)


@query(
    "comm_customer_tier",
    b.COMMISSION_SQL
    + """
    SELECT customer_id, territory_group, CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(bike_revenue AS DOUBLE) AS bike_revenue,
           CAST(comp_revenue AS DOUBLE) AS comp_revenue, CAST(clothing_revenue AS DOUBLE) AS clothing_revenue,
           CAST(access_revenue AS DOUBLE) AS access_revenue, order_count, customer_tier FROM tiers
    """,
)
def _(t):
    return plan.customer_tiers(_lines(t), P.threshold_scale)


_PRICING_SQL = b.commission_sql() + """
    SELECT order_id, CAST(line_no AS BIGINT) AS line_no, product_id, customer_tier, CAST(disc AS DOUBLE) AS applied_discount_pct,
           CAST(comm AS DOUBLE) AS applied_commission_pct, CAST(tax AS DOUBLE) AS tax_override_pct FROM priced
"""


@query("comm_pricing", _PRICING_SQL)
def _(t):
    return _priced(t, "line_no", "product_id").select(
        "order_id", "line_no", "product_id", "customer_tier",
        "applied_discount_pct", "applied_commission_pct", "tax_override_pct",
    )


@query(
    "case_nested_3",
    b.commission_sql()
    + """
    SELECT category_name, territory_group, customer_tier, CAST(disc AS DOUBLE) AS discount, CAST(comm AS DOUBLE) AS commission,
           count(*) AS lines FROM priced GROUP BY ALL
    """,
)
def _(t):
    return _priced(t).groupBy(
        "category_name",
        "territory_group",
        "customer_tier",
        c("applied_discount_pct").alias("discount"),
        c("applied_commission_pct").alias("commission"),
    ).agg(F.count("*").alias("lines"))


@query(
    "comm_line_finals",
    b.commission_sql()
    + f"""
    SELECT order_id, CAST(line_no AS BIGINT) AS line_no, customer_id, seller_id, seller_name, CAST(sales_quota AS DOUBLE) AS sales_quota,
           CAST(order_date AS VARCHAR) AS order_date, territory_group, territory_name, category_name, subcategory_name, product_name,
           customer_tier, order_qty, CAST(list_price AS DOUBLE) AS list_price, CAST(standard_cost AS DOUBLE) AS standard_cost,
           CAST(line_total AS DOUBLE) AS original_line_total, CAST(disc AS DOUBLE) AS applied_discount_pct,
           CAST(comm AS DOUBLE) AS applied_commission_pct, CAST(tax AS DOUBLE) AS tax_override_pct,
           {d4('adjusted', 'adjusted_revenue')}, {d4('discount_amount', 'discount_amount')}, {d4('margin', 'gross_margin')},
           {d4('earned', 'commission_earned')}, {d4('margin_pct', 'gross_margin_pct')}, {d4('estimated_tax', 'estimated_tax')}
    FROM finals
    """,
)
def _(t):
    return _finals(t, "line_no", "product_name", "list_price")


_SELLER_COLUMNS = f"""
    seller_id, seller_name, territory_group, territory_name, total_orders, {d4('original', 'total_original_revenue')},
    {d4('adjusted', 'total_adjusted_revenue')}, {d4('discounts', 'total_discount_given')},
    {d4('earned', 'total_commission_earned')}, {d4('margin', 'total_gross_margin')},
    round(margin_pct, 6) AS avg_gross_margin_pct, {d4('bike_revenue', 'bike_revenue')}, {d4('comp_revenue', 'comp_revenue')},
    {d4('clothing_revenue', 'clothing_revenue')}, {d4('access_revenue', 'access_revenue')},
    CAST(sales_quota AS DOUBLE) AS sales_quota, band AS quota_attainment_band, quartile AS revenue_quartile
"""


def rounded(df, *names: str, digits: int = 6):
    return df.withColumns({name: F.round(name, digits) for name in names})


@query("comm_seller_summary", b.commission_sql() + f"SELECT {_SELLER_COLUMNS} FROM seller_ranked")
def _(t):
    return rounded(plan.seller_summary(_finals(t)), "avg_gross_margin_pct")


_RFM_COLUMNS = f"""
    customer_id, order_count, {d4('total_revenue', 'total_revenue')}, round(avg_line, 6) AS avg_line_revenue,
    CAST(last_day AS VARCHAR) AS last_order_date, CAST(first_day AS VARCHAR) AS first_order_date,
    {d4('discounts', 'total_discount')}, {d4('earned', 'total_commission')}, customer_tier, territory_group,
    CAST(recency_days AS BIGINT) AS recency_days, customer_name, r_score, f_score, m_score
"""


@query("rfm_score", b.commission_sql() + f"SELECT {_RFM_COLUMNS} FROM rfm")
def _(t):
    rfm = plan.customer_rfm(_finals(t), b.customer_persons(t), P.end)
    return rounded(rfm, "avg_line_revenue")


@query(
    "territory_benchmark",
    b.commission_sql()
    + f"""
    SELECT territory_group, seller_count, {d4('total', 'territory_total_revenue')}, round(avg_revenue, 4) AS territory_avg_revenue,
           round(avg_commission, 4) AS territory_avg_commission, round(avg_margin, 6) AS territory_avg_margin_pct,
           {d4('bike', 'territory_bike_revenue')}, {d4('comp', 'territory_comp_revenue')},
           {d4('clothing', 'territory_clothing_revenue')}, {d4('access', 'territory_access_revenue')} FROM bench
    """,
)
def _(t):
    bench = plan.territory_benchmark(plan.seller_summary(_finals(t)))
    bench = rounded(bench, "territory_avg_revenue", "territory_avg_commission", digits=4)
    return rounded(bench, "territory_avg_margin_pct")


@query(
    "comm_final",
    b.commission_sql()
    + f""", top AS (SELECT * FROM seller_ranked ORDER BY adjusted DESC, seller_id, territory_name LIMIT 10),
    served AS (
        SELECT f.seller_id, count(DISTINCT f.customer_id) AS unique_customers,
               CAST(sum(r_score + f_score + m_score) AS DOUBLE) / count(*) AS avg_score
        FROM finals f JOIN rfm ON rfm.customer_id = f.customer_id GROUP BY 1)
    SELECT {_SELLER_COLUMNS.replace('seller_id,', 'top.seller_id,', 1).replace(' territory_group,', ' top.territory_group,', 1)},
           round(CAST(adjusted AS DOUBLE) - avg_revenue, 4) AS revenue_vs_territory_avg,
           round((CAST(adjusted AS DOUBLE) - avg_revenue) / avg_revenue, 6) AS revenue_vs_territory_pct_delta,
           round(CAST(earned AS DOUBLE) - avg_commission, 4) AS commission_vs_territory_avg,
           {d4('total', 'territory_total_revenue')}, round(avg_margin, 6) AS territory_avg_margin_pct,
           coalesce(unique_customers, 0) AS unique_customers, round(avg_score, 6) AS avg_customer_rfm_score,
           '{P.start}' AS snapshot_start_date, '{P.end}' AS snapshot_end_date
    FROM top JOIN bench ON bench.territory_group = top.territory_group LEFT JOIN served ON served.seller_id = top.seller_id
    """,
)
def _(t):
    final = plan.final_report(_finals(t), b.customer_persons(t), P)
    final = rounded(final, "revenue_vs_territory_avg", "commission_vs_territory_avg", digits=4)
    return rounded(
        final,
        "avg_gross_margin_pct",
        "revenue_vs_territory_pct_delta",
        "territory_avg_margin_pct",
        "avg_customer_rfm_score",
    )


@query(
    "tier_override",
    b.COMMISSION_SQL
    + """, contacts AS (
        SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS phones,
               count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS emails FROM orders GROUP BY 1
    ), x AS (
        SELECT t.customer_id, customer_tier, coalesce(phones, 0) AS phone_count, coalesce(emails, 0) AS email_count,
               CASE WHEN c_acctbal >= -900 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'SC' ELSE 'IN' END END AS kind,
               CASE WHEN c_acctbal >= -900 AND c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'Mr.' END AS title
        FROM tiers t JOIN customer ON c_custkey = t.customer_id LEFT JOIN contacts ON o_custkey = t.customer_id)
    SELECT customer_id, customer_tier, phone_count, email_count,
           CASE WHEN customer_tier = 'Standard' AND phone_count >= 3 AND email_count >= 2 THEN 'Bronze'
                WHEN customer_tier = 'Bronze' AND kind = 'SC' AND phone_count >= 2 THEN 'Silver'
                WHEN customer_tier = 'Silver' AND title IN ('Mr.', 'Ms.', 'Mrs.', 'Dr.') AND email_count >= 3 THEN 'Gold'
                WHEN customer_tier = 'Gold' AND phone_count = 0 THEN 'Silver' ELSE customer_tier END AS resolved_tier
    FROM x
    """,
)
def _(t):
    tiers = plan.customer_tiers(_lines(t), P.threshold_scale).select("customer_id", "customer_tier")
    return plan.tier_override(tiers, b.customer_persons(t), b.phones(t), b.emails(t))


def rules_values() -> str:
    """The pricing rules as a VALUES list, in force from RULES_START."""

    def cell(text, quote):
        return "NULL" if text is None else (f"'{text}'" if quote else text)

    rows = [
        f"({i}, {cell(cat, 1)}, {cell(sub, 1)}, {cell(group, 1)}, {cell(tier, 1)}, {disc}, {comm}, {cell(tax, 0)})"
        for i, (cat, sub, group, tier, disc, comm, tax) in enumerate(seeds.PRICING_RULES, 1)
    ]
    return (
        f"(SELECT rule_id::BIGINT AS rule_id, cat, sub, grp, tier, CAST(disc AS DECIMAL(5,4)) AS disc, CAST(comm AS DECIMAL(5,4)) AS comm, "
        f"CAST(tax AS DECIMAL(5,4)) AS tax, DATE '{RULES_START}' AS effective FROM (VALUES {', '.join(rows)}) "
        f"v(rule_id, cat, sub, grp, tier, disc, comm, tax)) rules"
    )


def _rules(t):
    return seeds.pricing_rules(t.spark, RULES_START)


def _violations(t):
    return plan.audit_violations(
        b.commission_lines(t),
        b.commission_orders(t),
        b.commission_territories(t),
        b.commission_products(t),
        _rules(t),
        P.start,
        P.end,
    )


_VIOLATIONS_SQL = (
    b.COMMISSION_SQL
    + f""", held AS (
        SELECT l.order_id, line_no, l.product_id, unit_price_discount AS d, coalesce(disc, 0) AS allowed, unit_price, line_total,
               order_qty, category_name, territory_group, order_date
        FROM all_lines l JOIN all_orders o ON o.order_id = l.order_id JOIN terr ON terr.territory_id = o.territory_id
        JOIN products p ON p.product_id = l.product_id
        LEFT JOIN {rules_values()} ON cat = category_name AND grp = territory_group AND effective <= order_date
        WHERE order_date BETWEEN DATE '{P.start}' AND DATE '{P.end}'
    ), violations AS (
        SELECT *, CASE WHEN d > allowed + 0.02 THEN 'OVER_DISCOUNT' WHEN d < 0 THEN 'NEGATIVE_DISCOUNT' WHEN unit_price <= 0 THEN 'ZERO_PRICE'
                       WHEN line_total < 0 THEN 'NEGATIVE_LINE_TOTAL' WHEN order_qty <= 0 THEN 'ZERO_QTY' END AS kind
        FROM held)
    """
)


@query(
    "audit_violations",
    _VIOLATIONS_SQL
    + """
    SELECT order_id, CAST(line_no AS BIGINT) AS line_no, product_id, CAST(d AS DOUBLE) AS applied_discount_on_record,
           CAST(allowed AS DOUBLE) AS max_allowed_discount, kind AS violation_type,
           CASE WHEN kind IN ('NEGATIVE_LINE_TOTAL', 'ZERO_QTY') THEN 2 ELSE 3 END::BIGINT AS severity,
           category_name, territory_group, CAST(order_date AS VARCHAR) AS order_date
    FROM violations WHERE kind IS NOT NULL
    """,
)
def _(t):
    return _violations(t)


@query(
    "audit_status",
    _VIOLATIONS_SQL
    + """
    SELECT count(*) AS violation_count, CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END AS status,
           'Violations found: ' || count(*) AS message FROM violations WHERE kind IS NOT NULL
    """,
)
def _(t):
    return plan.audit_status(_violations(t))


def _line_rules(t):
    """Lines with what a rule is chosen by; the tier follows the order's size."""
    big = c("total_due")
    tier = F.when(big >= 300000, "Gold").when(big >= 200000, "Silver").when(big >= 100000, "Bronze")
    orders = b.commission_orders(t).join(b.commission_territories(t), "territory_id")
    return (
        b.commission_lines(t)
        .join(orders, "order_id")
        .join(b.commission_products(t), "product_id")
        .select(
            "order_id", "line_no", "product_id", "line_total", "order_date", "category_name",
            "subcategory_name", "territory_group", tier.otherwise("Standard").alias("tier"),
        )
    )


_LINE_RULES_SQL = (
    b.COMMISSION_SQL
    + """, x AS (
        SELECT l.order_id, line_no, l.product_id, line_total, order_date, category_name, subcategory_name, territory_group,
               CASE WHEN total_due >= 300000 THEN 'Gold' WHEN total_due >= 200000 THEN 'Silver' WHEN total_due >= 100000 THEN 'Bronze'
                    ELSE 'Standard' END AS line_tier
        FROM all_lines l JOIN all_orders o ON o.order_id = l.order_id JOIN terr ON terr.territory_id = o.territory_id
        JOIN products p ON p.product_id = l.product_id)
    """
)
_RULE_KEYS = [("category_name", "rule_category"), ("territory_group", "rule_territory")]


def _named_rules(t):
    return _rules(t).withColumnsRenamed(
        {
            "category_name": "rule_category",
            "territory_group": "rule_territory",
            "subcategory_name": "rule_subcategory",
            "customer_tier": "rule_tier",
        }
    )


@query(
    "join_effective_date",
    _LINE_RULES_SQL
    + f"""
    SELECT order_id, CAST(line_no AS BIGINT) AS line_no, product_id, rule_id, CAST(disc AS DOUBLE) AS discount_pct
    FROM x LEFT JOIN {rules_values()} ON cat = category_name AND grp = territory_group AND effective <= order_date
    """,
)
def _(t):
    held = joins.join_effective_date(_line_rules(t), _named_rules(t), _RULE_KEYS, "order_date")
    return held.select("order_id", "line_no", "product_id", "rule_id", "discount_pct")


@query(
    "join_effective_date_best",
    _LINE_RULES_SQL
    + f"""
    SELECT order_id, CAST(line_no AS BIGINT) AS line_no, product_id, CAST(line_total AS DOUBLE) AS line_total, rule_id,
           CAST(disc AS DOUBLE) AS discount_pct
    FROM (SELECT *, row_number() OVER () AS rid FROM x)
    LEFT JOIN {rules_values()} ON cat = category_name AND grp = territory_group AND effective <= order_date
        AND (sub IS NULL OR sub = subcategory_name) AND tier = line_tier
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY sub IS NULL, effective DESC, rule_id) = 1
    """,
)
def _(t):
    best = joins.best_rule_per_day(
        _line_rules(t),
        _named_rules(t),
        _RULE_KEYS,
        [("subcategory_name", "rule_subcategory"), ("tier", "rule_tier")],
        "order_date",
        ["discount_pct"],
    )
    return best.select("order_id", "line_no", "product_id", "line_total", "rule_id", "discount_pct")


@query(
    "src_literal_rules",
    _LINE_RULES_SQL
    + f"""
    SELECT rule_id, coalesce(cat, '') AS category, tier, count(order_id) AS lines, CAST(coalesce(sum(line_total), 0) AS DOUBLE) AS revenue
    FROM {rules_values()} LEFT JOIN x ON cat = category_name AND grp = territory_group AND tier = line_tier
        AND (sub IS NULL OR sub = subcategory_name)
    GROUP BY ALL
    """,
)
def _(t):
    sums = _line_rules(t).groupBy("category_name", "subcategory_name", "territory_group", "tier").agg(
        F.count("*").alias("n"), F.sum("line_total").alias("total")
    )
    matches = (
        (c("rule_category") == c("category_name"))
        & (c("rule_territory") == c("territory_group"))
        & (c("rule_tier") == c("tier"))
        & (c("rule_subcategory").isNull() | (c("rule_subcategory") == c("subcategory_name")))
    )
    return (
        _named_rules(t)
        .join(sums, matches, "left")
        .groupBy("rule_id", c("rule_category").alias("category"), c("rule_tier").alias("tier"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("lines"),
            F.coalesce(F.sum("total"), F.lit(0)).alias("revenue"),
        )
    )


@query(
    "param_defaults",
    """
    SELECT CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS start_date, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS end_date,
           count(*) AS orders FROM orders
    """,
)
def _(t):
    orders = b.sales_orders(t)
    p = plan.with_dates(orders, plan.CommissionParams())
    inside = orders.where(c("order_date").between(F.lit(p.start), F.lit(p.end)))
    return inside.agg(F.count("*").alias("orders")).select(
        F.lit(p.start).alias("start_date"), F.lit(p.end).alias("end_date"), "orders"
    )


@query(
    "subq_correlated_scalar",
    """
    SELECT s_suppkey, (SELECT count(DISTINCT o_custkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
                       WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 48) AS customers,
           (SELECT avg(l_quantity) FROM lineitem WHERE l_suppkey = s_suppkey) AS mean_quantity FROM supplier
    """,
)
def _(t):
    returned = t.lineitem.where((c("l_returnflag") == "R") & (c("l_quantity") > 48))
    customers = (
        returned.join(t.orders, c("l_orderkey") == c("o_orderkey"))
        .groupBy(c("l_suppkey").alias("s_suppkey"))
        .agg(F.countDistinct("o_custkey").alias("customers"))
    )
    quantity = t.lineitem.groupBy(c("l_suppkey").alias("s_suppkey")).agg(
        F.avg("l_quantity").alias("mean_quantity")
    )
    return (
        t.supplier.join(customers, "s_suppkey", "left")
        .join(quantity, "s_suppkey", "left")
        .select("s_suppkey", F.coalesce("customers", F.lit(0)).alias("customers"), "mean_quantity")
    )
