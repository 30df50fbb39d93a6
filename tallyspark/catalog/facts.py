"""The customer-facts workload, its quality rules and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog import bindings as b
from tallyspark.catalog.registry import query
from tallyspark.operators import quality
from tallyspark.plans import facts as plan
from tallyspark.session import materialise
from tallyspark.sources import seeds

c = F.col


def _orders(t):
    return plan.fact_orders(b.fact_header(t), b.fact_addresses(t), b.FACTS_PARAMS)


def _categories(t, orders):
    return plan.order_categories(b.fact_order_lines(t), orders, b.fact_products(t))


def _facts(t):
    orders = _orders(t)
    return plan.customer_facts(orders, _categories(t, orders), b.fact_customers(t), b.FACTS_PARAMS)


def _scored(t):
    return plan.fact_scores(_facts(t))


@query(
    "lt_orders",
    b.FACTS_SQL
    + """
    SELECT order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date, CAST(total_due AS DOUBLE) AS total_due,
           CAST(sub_total AS DOUBLE) AS sub_total, CAST(tax_amt AS DOUBLE) AS tax_amt, CAST(freight AS DOUBLE) AS freight,
           CAST(online AS BIGINT) AS online, region_name FROM orders0
    """,
)
def _(t):
    return _orders(t)


@query(
    "lt_lines",
    b.FACTS_SQL
    + """
    SELECT order_id, CAST(line_no AS BIGINT) AS line_no, product_id, order_qty, CAST(unit_price AS DOUBLE) AS unit_price,
           CAST(unit_price_discount AS DOUBLE) AS unit_price_discount, CAST(line_total AS DOUBLE) AS line_total, customer_id,
           product_name, category_name FROM lines0
    """,
)
def _(t):
    return plan.fact_lines(b.fact_order_lines(t), _orders(t), b.fact_products(t))


@query(
    "agg_path_a",
    b.FACTS_SQL
    + """
    SELECT customer_id, order_count, CAST(revenue_a AS DOUBLE) AS total_revenue_path_a, CAST(sub_total_a AS DOUBLE) AS sub_total_path_a,
           CAST(tax_a AS DOUBLE) AS tax_path_a, CAST(freight_a AS DOUBLE) AS freight_path_a, online_orders AS online_order_count,
           offline_orders AS offline_order_count, CAST(first_day AS VARCHAR) AS first_order_date,
           CAST(last_day AS VARCHAR) AS last_order_date, region_name AS primary_region_name FROM a
    """,
)
def _(t):
    return plan.path_a(_orders(t))


@query(
    "agg_path_b",
    b.FACTS_SQL
    + """
    SELECT customer_id, CAST(revenue_b AS DOUBLE) AS total_revenue_path_b, CAST(round(discount_b, 4) AS DOUBLE) AS total_discount_path_b,
           total_lines, total_qty, products AS distinct_products, categories AS distinct_categories FROM b
    """,
)
def _(t):
    return plan.path_b(_categories(t, _orders(t)))


@query("customer_facts", b.FACTS_SQL + f"SELECT {b.FACT_COLUMNS} FROM facts")
def _(t):
    return _facts(t)


@query(
    "reconcile_two_paths",
    b.FACTS_SQL
    + """
    SELECT customer_id, CAST(delta AS DOUBLE) AS revenue_delta_ab, pct_delta AS revenue_pct_delta_ab,
           CASE WHEN revenue_a <> 0 AND CASE WHEN revenue_a > 0 THEN delta ELSE -delta END <= 0.5 * abs(revenue_a) THEN 1 ELSE 0 END::BIGINT AS passed FROM facts
    """,
)
def _(t):
    passed = plan.paths_agree(b.FACTS_PARAMS.tolerance)
    return _facts(t).select("customer_id", "revenue_delta_ab", "revenue_pct_delta_ab", passed.alias("passed"))


@query("lt_rfm", b.FACTS_SQL + "SELECT customer_id, r_score, f_score, m_score FROM scored")
def _(t):
    return _scored(t).select("customer_id", "r_score", "f_score", "m_score")


@query(
    "region_benchmark",
    b.FACTS_SQL
    + """
    SELECT region_name, avg_revenue AS region_avg_revenue, avg_orders AS region_avg_order_count,
           avg_recency AS region_avg_recency, avg_rfm AS region_avg_rfm FROM bench
    """,
)
def _(t):
    return plan.region_benchmark(_scored(t))


@query(
    "customer_payload",
    b.FACTS_SQL
    + """
    SELECT customer_id, CAST(revenue_a AS DOUBLE) AS revenue_a_json, CAST(revenue_b AS DOUBLE) AS revenue_b_json,
           order_count AS orders_json, rfm AS rfm_score_json, CAST(revenue_b IS NOT NULL AS BIGINT) AS has_revenue_b, top_category, top_revenue, entries
    FROM scored LEFT JOIN (
        SELECT cid, min(category_name) FILTER (WHERE n = 1) AS top_category, CAST(max(revenue) AS DOUBLE) AS top_revenue, count(*) AS entries
        FROM (SELECT customer_id AS cid, category_name, sum(line_total) AS revenue,
                     row_number() OVER (PARTITION BY customer_id ORDER BY sum(line_total) DESC, category_name) AS n
              FROM lines0 GROUP BY 1, 2) WHERE n <= 5 GROUP BY 1) ON cid = customer_id
    """,
)
def _(t):
    orders = _orders(t)
    lines = materialise(_categories(t, orders), "categories")
    scored = plan.fact_scores(plan.customer_facts(orders, lines, b.fact_customers(t), b.FACTS_PARAMS))
    parsed = plan.parse_payload(plan.customer_payload(scored, lines))
    schema = "topCategories array<struct<category:string,revenue:double>>"
    top = F.from_json("payload_json", schema)["topCategories"]
    return parsed.select(
        *[n for n in parsed.columns if n != "payload_json"],
        c("payload_json").contains('"revenueB"').alias("has_revenue_b"),
        top[0]["category"].alias("top_category"),
        top[0]["revenue"].alias("top_revenue"),
        F.when(top.isNotNull(), F.size(top)).alias("entries"),
    )


@query(
    "json_roundtrip_check",
    b.FACTS_SQL
    + """
    SELECT customer_id, CAST(revenue_a AS DOUBLE) AS revenue_a_json, CAST(revenue_b AS DOUBLE) AS revenue_b_json,
           order_count AS orders_json, rfm AS rfm_score_json, '' AS different FROM scored
    """,
)
def _(t):
    # the payload read back, beside the facts it was written from
    orders = _orders(t)
    lines = materialise(_categories(t, orders), "categories")
    scored = materialise(
        plan.fact_scores(plan.customer_facts(orders, lines, b.fact_customers(t), b.FACTS_PARAMS)), "scored"
    )
    return plan.payload_differences(scored, plan.parse_payload(plan.customer_payload(scored, lines)))


_RULES_SQL = """
    SELECT i::BIGINT AS qc_id, CASE WHEN i <= 100 THEN 'Nulls' WHEN i <= 200 THEN 'Ranges' ELSE 'Reconcile' END AS check_group,
           'QC_' || lpad(i::VARCHAR, 4, '0') AS check_name,
           CASE WHEN i % 25 = 0 THEN 1 WHEN i % 9 = 0 THEN 2 ELSE 3 END::BIGINT AS severity FROM range(1, 261) r(i)
"""

_QC_SQL = (
    b.FACTS_SQL
    + f""", hits AS (
        SELECT bool_or(customer_id IS NULL) AS h1, bool_or(revenue_a < 0 OR avg_order_value < 0) AS h2,
               bool_or(abs(coalesce(revenue_a, 0) - coalesce(revenue_b, 0)) > coalesce(revenue_a, 0) * 0.01) AS h3 FROM facts),
    results AS (SELECT r.*, CASE check_group WHEN 'Nulls' THEN h1 WHEN 'Ranges' THEN h2 ELSE h3 END AS failed FROM ({_RULES_SQL}) r, hits)
    """
)


@query("qc_rules", _QC_SQL + "SELECT qc_id, check_group, check_name, severity, failed::BIGINT AS failed FROM results")
def _(t):
    return quality.evaluate(_facts(t), seeds.quality_rules(t.spark)).drop("predicate")


@query(
    "qc_fail_counts",
    _QC_SQL
    + """
    SELECT count(*) FILTER (WHERE failed AND severity = 1) AS severity_1, count(*) FILTER (WHERE failed AND severity = 2) AS severity_2,
           count(*) FILTER (WHERE failed AND severity = 3) AS severity_3 FROM results
    """,
)
def _(t):
    return quality.fail_counts(quality.evaluate(_facts(t), seeds.quality_rules(t.spark)))


@query(
    "dynamic_predicates",
    """
    SELECT predicate, failed::BIGINT AS failed FROM (
        SELECT 'l_quantity > 50' AS predicate, bool_or(l_quantity > 50) AS failed FROM lineitem
        UNION ALL SELECT 'l_discount BETWEEN 0.05 AND 0.06', bool_or(l_discount BETWEEN 0.05 AND 0.06) FROM lineitem
        UNION ALL SELECT 'l_returnflag = ''X'' OR l_tax < 0', bool_or(l_returnflag = 'X' OR l_tax < 0) FROM lineitem)
    """,
)
def _(t):
    texts = ["l_quantity > 50", "l_discount BETWEEN 0.05 AND 0.06", "l_returnflag = 'X' OR l_tax < 0"]
    rules = t.spark.createDataFrame([(text,) for text in texts], "predicate string")
    return quality.evaluate(t.lineitem, rules)


@query(
    "lt_final",
    _QC_SQL
    + f""", counts AS (
        SELECT count(*) FILTER (WHERE failed AND severity = 2) AS s2, count(*) FILTER (WHERE failed AND severity = 3) AS s3 FROM results)
    SELECT {b.FACT_COLUMNS.replace('region_name,', 's.region_name,', 1)}, r_score, f_score, m_score, rfm AS rfm_score,
           CASE WHEN revenue_a <> 0 AND CASE WHEN revenue_a > 0 THEN delta ELSE -delta END <= 0.5 * abs(revenue_a) THEN 1 ELSE 0 END::BIGINT AS qc_pass_revenue_ab, avg_revenue AS region_avg_revenue,
           avg_orders AS region_avg_order_count, avg_recency AS region_avg_recency, avg_rfm AS region_avg_rfm,
           (CAST(revenue_a AS DOUBLE) - avg_revenue) / avg_revenue AS revenue_vs_region_pct_delta, (rfm - avg_rfm) / avg_rfm AS rfm_vs_region_pct_delta,
           CAST(revenue_a AS DOUBLE) AS revenue_a_json, CAST(revenue_b AS DOUBLE) AS revenue_b_json, order_count AS orders_json, rfm AS rfm_score_json,
           s3 AS qc_fail_count_severity3, s2 AS qc_fail_count_severity2, '{b.FACTS_PARAMS.start}' AS snapshot_start_date,
           '{b.FACTS_PARAMS.end}' AS snapshot_end_date, '{b.FACTS_PARAMS.as_of}' AS snapshot_as_of_date,
           0.5::DOUBLE AS revenue_tolerance_pct_used, 6::BIGINT AS recent_months_window_used
    FROM scored s JOIN bench ON bench.region_name = s.region_name, counts
    """,
)
def _(t):
    orders = _orders(t)
    # payload text is left out: engines print JSON differently
    return plan.final_table(
        orders, _categories(t, orders), b.fact_customers(t), seeds.quality_rules(t.spark), b.FACTS_PARAMS
    ).drop("payload_json")


@query(
    "dq_constraints",
    """
    SELECT 'NOT NULL' AS constraint_kind, 'segment' AS constraint_name, CAST(c_custkey AS VARCHAR) AS row_key FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 'CHECK', 'balance_not_negative', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT 'UNIQUE', 'l_orderkey,l_linenumber', l_orderkey || '|' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'FOREIGN KEY', 'o_orderkey', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    """,
)
def _(t):
    customers = t.customer.withColumn("segment", F.nullif(c("c_mktsegment"), F.lit("BUILDING")))
    found = [
        quality.not_null(customers, "segment", "c_custkey"),
        quality.check(customers, "balance_not_negative", c("c_acctbal") >= 0, "c_custkey"),
        quality.unique(t.lineitem, ["l_orderkey", "l_linenumber"]),
        quality.foreign_key(t.orders, "o_orderkey", t.lineitem, "l_orderkey", "o_orderkey"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out
