"""Sources, sinks, change capture, logs, streams, people and script jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.catalog import bindings as b
from tallyspark.catalog.registry import query
from tallyspark.functions import rules
from tallyspark.functions.scalars import as_money, safe_ratio
from tallyspark.operators import changes, graph
from tallyspark.plans import commission, corpus, facts, people, runs, sales
from tallyspark.runlog import RunLog
from tallyspark.session import fresh_path
from tallyspark.sources import files
from tallyspark.sources.keyed import KeyedTable
from tallyspark.streaming import daily, keyed

c, lit = F.col, F.lit

# --- sources and sinks ------------------------------------------------------------------


@query(
    "src_table",
    "SELECT o_orderstatus AS status, count(*) AS n, max(o_totalprice) AS largest FROM orders GROUP BY 1",
)
def _(t):
    return t.orders.groupBy(c("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("largest")
    )


_CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("src_csv", _CUSTOMER_SQL)
def _(t):
    path = fresh_path(t.spark, "csv")
    files.write_csv(t.customer, path)
    return files.read_csv(t.spark, path, t.customer.schema)


@query("snk_parquet", "SELECT o_orderkey, o_totalprice, year(o_orderdate) AS year FROM orders")
def _(t):
    path = fresh_path(t.spark, "orders")
    files.write_parquet(t.orders.withColumn("year", F.year("o_orderdate")), path, ["year"])
    return t.spark.read.parquet(path).select("o_orderkey", "o_totalprice", "year")


@query(
    "snk_single_csv",
    "SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS largest FROM orders GROUP BY 1",
)
def _(t):
    path = fresh_path(t.spark, "export")
    nested = F.struct(F.count("*").alias("orders"), F.max("o_totalprice").alias("largest"))
    files.write_csv(t.orders.groupBy("o_custkey").agg(nested.alias("facts")), path)
    read = files.read_csv(t.spark, path, "o_custkey bigint, facts string")
    parsed = F.from_json("facts", "orders bigint, largest double")
    return read.select("o_custkey", parsed.alias("f")).select("o_custkey", "f.*")


@query(
    "snk_append_log",
    """
    SELECT 'orders' AS report_type, count(*) AS n FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem
    """,
)
def _(t):
    path = fresh_path(t.spark, "log")
    for name, df in (("orders", t.orders), ("lines", t.lineitem)):
        files.append_rows(df.agg(F.count("*").alias("n")).select(lit(name).alias("report_type"), "n"), path)
    return t.spark.read.parquet(path)


@query("snk_truncate_reload", "SELECT n_name FROM nation WHERE n_regionkey <> 2")
def _(t):
    path = fresh_path(t.spark, "reference")
    files.reload_table(t.nation.select("n_name"), path)
    files.reload_table(t.nation.where("n_regionkey <> 2").select("n_name"), path)
    return t.spark.read.parquet(path)


@query(
    "run_log",
    """
    SELECT 'START' AS step_name, 'START' AS step_status, NULL AS message, 0::BIGINT AS completed
    UNION ALL SELECT 'orders', 'OK', 'rows: ' || count(*), 0 FROM orders
    UNION ALL SELECT 'lines', 'OK', 'rows: ' || count(*), 1 FROM lineitem
    UNION ALL SELECT 'END', 'SUCCESS', 'Completed', 1
    """,
)
def _(t):
    path = fresh_path(t.spark, "runlog")
    with RunLog(t.spark, "counts", path) as log:
        log.step("orders", "OK", f"rows: {t.orders.count()}")
        log.step("lines", "OK", f"rows: {t.lineitem.count()}", complete=True)
    return t.spark.read.parquet(path).select(
        "step_name", "step_status", "message", c("completed_utc").isNotNull().alias("completed")
    )


@query(
    "try_catch_log",
    """
    SELECT 'START' AS step_name, 'START' AS step_status, 0::BIGINT AS published
    UNION ALL SELECT 'END', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'SUCCESS' END, 0 FROM part WHERE TRY_CAST(p_brand AS INT) IS NULL
    """,
)
def _(t):
    # the cast fails on the brands; nothing is published and the failure is logged
    log_path, target = fresh_path(t.spark, "runlog"), fresh_path(t.spark, "result")
    published = 0
    try:
        with RunLog(t.spark, "brands", log_path):
            files.commit(t.part.select(c("p_brand").cast("int").alias("brand")), target)
            published = 1
    except Exception as error:
        if "CAST_INVALID_INPUT" not in str(error):
            raise
    return t.spark.read.parquet(log_path).select(
        "step_name", "step_status", lit(published).alias("published")
    )


@query(
    "run_log_workloads",
    f"""
    WITH steps AS (
        SELECT 'sales' AS proc_name, 'staged' AS step_name, n FROM ({b.SALES_SQL} SELECT count(*) AS n FROM sales)
        UNION ALL SELECT 'sales', 'days', n FROM ({b.SALES_SQL} SELECT count(DISTINCT order_date) AS n FROM sales)
        UNION ALL SELECT 'commission', 'lines', n FROM ({b.COMMISSION_SQL} SELECT count(*) AS n FROM lines)
        UNION ALL SELECT 'commission', 'tiers', n FROM ({b.COMMISSION_SQL} SELECT count(*) AS n FROM tiers)
        UNION ALL SELECT 'facts', 'facts', n FROM ({b.FACTS_SQL} SELECT count(*) AS n FROM facts)
        UNION ALL SELECT 'facts', 'regions', n FROM ({b.FACTS_SQL} SELECT count(*) AS n FROM bench))
    SELECT proc_name, step_name, 'OK' AS step_status, 'Rows: ' || n AS message FROM steps
    UNION ALL SELECT DISTINCT proc_name, 'START', 'START', NULL FROM steps
    UNION ALL SELECT DISTINCT proc_name, 'END', 'SUCCESS', 'Completed' FROM steps
    """,
)
def _(t):
    log, P, C = fresh_path(t.spark, "runlog"), b.SALES_PARAMS, b.COMMISSION_PARAMS
    frames = b.sales_orders(t), b.sales_order_lines(t), b.sales_products(t)
    runs.logged_run(
        t.spark,
        "sales",
        [
            ("staged", lambda made: sales.sales_lines(*frames, P)),
            ("days", lambda made: sales.daily_summary(made["staged"])),
        ],
        log,
    )
    sellers = b.seller_persons(t), b.seller_employees(t), b.seller_quotas(t)
    base = commission.base_orders(b.commission_orders(t), b.commission_territories(t), *sellers, C)
    runs.logged_run(
        t.spark,
        "commission",
        [
            ("lines", lambda made: commission.order_lines(b.commission_lines(t), base, b.commission_products(t))),
            ("tiers", lambda made: commission.customer_tiers(made["lines"], C.threshold_scale)),
        ],
        log,
    )
    orders = facts.fact_orders(b.fact_header(t), b.fact_addresses(t), b.FACTS_PARAMS)
    categories = facts.order_categories(b.fact_order_lines(t), orders, b.fact_products(t))
    runs.logged_run(
        t.spark,
        "facts",
        [
            ("facts", lambda made: facts.customer_facts(orders, categories, b.fact_customers(t), b.FACTS_PARAMS)),
            ("regions", lambda made: facts.region_benchmark(facts.fact_scores(made["facts"]))),
        ],
        log,
    )
    return t.spark.read.parquet(log).select("proc_name", "step_name", "step_status", "message")


# --- set-based forms of loops, recursion, changes -------------------------------------------


@query(
    "cursor_to_set",
    """
    SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'Active' ELSE 'Dormant' END || ' (' ||
        CASE WHEN c_acctbal * 10 >= 50000 THEN 'Bronze' WHEN c_nationkey >= 3 THEN 'Bronze'
             WHEN c_acctbal * 10 >= 100 THEN 'Bronze' ELSE 'Standard' END || ')' AS label FROM customer
    """,
)
def _(t):
    orders = F.when(c("c_nationkey") >= 3, 3).otherwise(0)
    tier = rules.customer_tier(c("c_acctbal") * 10, orders, lit(0))
    status = F.when(c("c_acctbal") > 5000, "Active").otherwise("Dormant")
    return t.customer.select("c_custkey", F.concat(status, lit(" ("), tier, lit(")")).alias("label"))


@query(
    "status_label",
    """
    SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'Pending' WHEN '2' THEN 'Shipped' WHEN '3' THEN 'Delivered'
        WHEN '4' THEN 'Cancelled' ELSE 'Unknown' END AS status_label FROM orders
    """,
)
def _(t):
    status = F.left("o_orderpriority", lit(1)).cast("int")
    return t.orders.select("o_orderkey", rules.status_label(status).alias("status_label"))


@query(
    "cte_recursive",
    """
    WITH RECURSIVE tree AS (
        SELECT n_nationkey AS k, n_name AS root, 0 AS depth FROM nation WHERE n_nationkey < 2
        UNION ALL SELECT n_nationkey, root, depth + 1 FROM tree JOIN nation ON n_nationkey // 2 = k AND n_nationkey >= 2)
    SELECT root, depth::BIGINT AS depth, count(*) AS customers FROM tree JOIN customer ON c_nationkey = k GROUP BY 1, 2
    """,
)
def _(t):
    return t.spark.sql(
        """
        WITH RECURSIVE tree (k, root, depth) AS (
            SELECT n_nationkey, n_name, 0 FROM {nation} WHERE n_nationkey < 2
            UNION ALL
            SELECT n_nationkey, root, depth + 1 FROM tree JOIN {nation} ON n_nationkey div 2 = k AND n_nationkey >= 2)
        SELECT root, depth, count(*) AS customers FROM tree JOIN {customer} ON c_nationkey = k GROUP BY root, depth
        """,
        nation=t.nation,
        customer=t.customer,
    )


@query(
    "merge_upsert",
    """
    SELECT c_custkey AS id, CASE WHEN c_acctbal > 9000 THEN 'promoted' ELSE c_mktsegment END AS segment FROM customer
    UNION ALL SELECT s_suppkey + 1000000000, 'supplier' FROM supplier
    """,
)
def _(t):
    target = t.customer.select(c("c_custkey").alias("id"), c("c_mktsegment").alias("segment"))
    promoted = t.customer.where("c_acctbal > 9000").select(c("c_custkey").alias("id"), lit("promoted").alias("segment"))
    added = t.supplier.select((c("s_suppkey") + 1000000000).alias("id"), lit("supplier").alias("segment"))
    table = KeyedTable(t.spark, fresh_path(t.spark, "customers"), ["id"])
    table.create(target)
    table.merge(promoted.unionByName(added))
    return table.read()


@query(
    "merge_upsert_counts",
    """
    SELECT (SELECT count(*) FROM supplier) AS inserted, (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS updated
    """,
)
def _(t):
    promoted = t.customer.where("c_acctbal > 9000").select(c("c_custkey").alias("id"), lit("promoted").alias("segment"))
    added = t.supplier.select((c("s_suppkey") + 1000000000).alias("id"), lit("supplier").alias("segment"))
    table = KeyedTable(t.spark, fresh_path(t.spark, "customers"), ["id"])
    table.create(t.customer.select(c("c_custkey").alias("id"), c("c_mktsegment").alias("segment")))
    return table.merge(promoted.unionByName(added))


@query(
    "dml_update",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'BLOCKED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def _(t):
    table = KeyedTable(t.spark, fresh_path(t.spark, "customers"), ["c_custkey"])
    table.create(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"))
    table.update(c("c_acctbal") < 0, c_mktsegment=lit("BLOCKED"))
    return table.read().select("c_custkey", "c_mktsegment")


# status and amount compare with <>, so NULL is no change there; the day has a stand-in
_FIELDS = {"status": None, "shipped": "1900-01-01", "amount": None}
_IMAGE_ORDER = [("ts", "asc"), ("event_id", "asc")]


def _images(events):
    return events.select(
        "event_id",
        "ts",
        "user_id",
        F.nullif(c("event_type"), lit("error")).alias("status"),
        F.when(c("event_type") != "view", c("ts").cast("date")).alias("shipped"),
        c("value").cast("decimal(18,2)").alias("amount"),
    )


_AUDIT_SQL = """
    WITH i AS (
        SELECT event_id, user_id, nullif(event_type, 'error') AS status,
               CASE WHEN event_type <> 'view' THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS shipped,
               CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS amount,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
    ), p AS (
        SELECT a.*, b.status AS old_status, b.shipped AS old_shipped, b.amount AS old_amount
        FROM i a JOIN i b ON a.user_id = b.user_id AND a.n = b.n + 1)
    SELECT event_id, user_id, 'status' AS field_changed, old_status AS old_value, status AS new_value FROM p WHERE status <> old_status
    UNION ALL SELECT event_id, user_id, 'shipped', old_shipped, shipped FROM p
        WHERE coalesce(shipped, '1900-01-01') <> coalesce(old_shipped, '1900-01-01')
    UNION ALL SELECT event_id, user_id, 'amount', old_amount, amount FROM p WHERE amount <> old_amount
"""


@query("trigger_change_audit", _AUDIT_SQL)
def _(t):
    day = c("ts").cast("date")
    return changes.audit_feed(
        _images(t.events), "user_id", _IMAGE_ORDER, _FIELDS, ["event_id", "user_id"], day
    )


@query(
    "audit_update",
    """
    SELECT o_orderkey, 'o_orderstatus' AS field_changed, o_orderstatus AS old_value, 'X' AS new_value FROM orders WHERE o_totalprice > 400000
    """,
)
def _(t):
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    after = changes.update_where(orders, c("o_totalprice") > 400000, o_orderstatus=lit("X"))
    return changes.audit_update(orders, after, "o_orderkey", {"o_orderstatus": None, "o_orderpriority": None})


# --- streams ------------------------------------------------------------------------------------


def _stream(t):
    return (
        t.spark.readStream.schema(t.events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(t.directory)
    )


_DAILY_SQL = """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
           min(value) AS smallest, max(value) AS largest, count(*) FILTER (WHERE event_type = 'purchase') AS purchases
    FROM events GROUP BY CAST(ts AS DATE)
"""


@query("daily_events", _DAILY_SQL)
def _(t):
    return daily.summarise(t.events)


@query(
    "st_daily_summary",
    _DAILY_SQL + " HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)",
)
def _(t):
    return daily.run_once(daily.summarise(_stream(t)), t.spark)


@query("st_change_audit", _AUDIT_SQL)
def _(t):
    # settled rows, and those of the images that the watermark has not passed at the stream's end
    auditor = keyed.KeyedAudit(t.spark, "user_id", _IMAGE_ORDER, _FIELDS, ["event_id", "user_id"])
    auditor.run_once(_images(_stream(t)))
    return auditor.settled().unionByName(auditor.waiting())


# --- people ---------------------------------------------------------------------------------------

# A customer plays the employee: segment = department, balance = salary, first order = hire date.
_PEOPLE_SQL = """
    WITH hired AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS joining_date FROM orders GROUP BY 1),
    people AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS department, CAST(c_acctbal AS DECIMAL(19,4)) AS salary, joining_date
               FROM customer JOIN hired ON o_custkey = c_custkey)
"""


def _people(t):
    hired = t.orders.groupBy(c("o_custkey").alias("id")).agg(
        F.min(c("o_orderdate").cast("date")).alias("joining_date")
    )
    staff = t.customer.select(
        c("c_custkey").alias("id"),
        c("c_name").alias("name"),
        c("c_mktsegment").alias("department"),
        as_money(c("c_acctbal")).alias("salary"),
    )
    return staff.join(hired, "id")


@query(
    "emp_salary_by_dept",
    _PEOPLE_SQL + "SELECT department, CAST(sum(salary) AS DOUBLE) AS total_salary FROM people GROUP BY 1",
)
def _(t):
    return people.salary_by_department(_people(t))


@query(
    "emp_joined_after",
    _PEOPLE_SQL + "SELECT name, CAST(joining_date AS VARCHAR) AS joining_date FROM people WHERE joining_date > DATE '1995-09-01'",
)
def _(t):
    return people.joined_after(_people(t), dt.date(1995, 9, 1))


@query(
    "emp_avg_headcount",
    _PEOPLE_SQL
    + "SELECT department, CAST(sum(salary) AS DOUBLE) / count(*) AS avg_salary, count(*) AS headcount FROM people GROUP BY 1",
)
def _(t):
    return people.average_and_headcount(_people(t))


@query(
    "emp_top_earners",
    _PEOPLE_SQL
    + "SELECT name, CAST(salary AS DOUBLE) AS salary FROM people WHERE salary > 9000 ORDER BY salary DESC, name LIMIT 5",
)
def _(t):
    return people.top_earners(_people(t), 9000)


@query(
    "emp_report",
    _PEOPLE_SQL
    + """
    SELECT count(*) AS headcount, CAST(sum(salary) AS DOUBLE) AS total_salary, CAST(sum(salary) AS DOUBLE) / count(*) AS avg_salary,
           arg_max(name, (salary, id)) AS highest_paid, arg_min(name, (salary, id)) AS lowest_paid,
           arg_max(name, (joining_date, id)) AS latest_hire,
           CAST(sum(DATE '2001-12-31' - joining_date) AS DOUBLE) / count(*) / 365.25 AS mean_tenure_years FROM people
    """,
)
def _(t):
    return people.company_totals(_people(t), dt.date(2001, 12, 31))


@query("emp_report_departments", _PEOPLE_SQL + "SELECT department, count(*) AS headcount FROM people GROUP BY 1")
def _(t):
    return people.department_headcount(_people(t))


@query("emp_report_roster", _PEOPLE_SQL + "SELECT department, name FROM people")
def _(t):
    return people.roster(_people(t))


@query(
    "ranked_employees_top10",
    _PEOPLE_SQL
    + """
    SELECT id, name, department, CAST(salary AS DOUBLE) AS salary, CAST(joining_date AS VARCHAR) AS joining_date,
           row_number() OVER (PARTITION BY department ORDER BY salary DESC, id) AS salary_rank,
           ntile(4) OVER (PARTITION BY department ORDER BY salary DESC, id) AS salary_quartile,
           CAST(sum(salary) OVER (PARTITION BY department ORDER BY joining_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_cost
    FROM people QUALIFY salary_rank <= 10
    """,
)
def _(t):
    return people.ranked_top(_people(t))


@query(
    "order_summary_by_customer",
    """
    SELECT c_custkey AS customer_id, c_name AS customer_name, coalesce(region, 'Unknown') AS region, count(*) AS order_count,
           CAST(sum(CAST(o_totalprice AS DECIMAL(19,4))) AS DOUBLE) AS total_revenue,
           CAST(sum(CAST(o_totalprice AS DECIMAL(19,4))) AS DOUBLE) / nullif(count(o_totalprice), 0) AS avg_order_value
    FROM (SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS region FROM customer WHERE c_acctbal > 0)
    LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'F'
    GROUP BY c_custkey, c_name, region ORDER BY total_revenue DESC NULLS LAST, c_custkey LIMIT 100
    """,
)
def _(t):
    customers = t.customer.where("c_acctbal > 0").select(
        c("c_custkey").alias("customer_id"),
        c("c_name").alias("customer_name"),
        F.nullif(c("c_mktsegment"), lit("BUILDING")).alias("region"),
    )
    recent = t.orders.where(
        (c("o_orderdate") >= lit("1998-01-01").cast("timestamp_ntz")) & (c("o_orderstatus") != "F")
    ).select(c("o_custkey").alias("customer_id"), as_money(c("o_totalprice")).alias("total"))
    return (
        customers.join(recent, "customer_id", "left")
        .groupBy("customer_id", "customer_name", "region")
        .agg(
            F.count("*").alias("order_count"),
            F.sum("total").alias("total_revenue"),
            safe_ratio(F.sum("total"), F.count("total")).alias("avg_order_value"),
        )
        .withColumn("region", F.coalesce("region", lit("Unknown")))
        .orderBy(F.desc_nulls_last("total_revenue"), "customer_id")
        .limit(100)
    )


@query(
    "bonus_rule",
    """
    SELECT c_custkey, c_acctbal * CASE c_mktsegment WHEN 'BUILDING' THEN 0.1::DOUBLE WHEN 'MACHINERY' THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS bonus FROM customer
    """,
)
def _(t):
    rating = F.when(c("c_mktsegment") == "BUILDING", "good").when(c("c_mktsegment") == "MACHINERY", "average")
    return t.customer.select(
        "c_custkey", rules.bonus(c("c_acctbal"), rating.otherwise("poor")).alias("bonus")
    )


@query(
    "batch_number",
    "SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 500 AS batch FROM orders",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    order = [("o_totalprice", "asc"), ("o_orderkey", "asc")]
    return people.batches(rows, order, 500).drop("o_totalprice")


# --- scripts ----------------------------------------------------------------------------------------

# One script per document, in a dialect that follows its language.
_BODIES = {
    "en": "SET NOCOUNT ON\nDECLARE @x INT\nDECLARE c CURSOR FOR SELECT * FROM #t\nEXEC (@x)\nBEGIN TRAN\nGO\n",
    "de": "CREATE OR REPLACE FUNCTION f AS\nBEGIN x := DBMS_RANDOM.value; END\nPRAGMA y\n",
    "fr": "CREATE FUNCTION pl.g() RETURNS SETOF t AS $$\nSELECT rank() OVER (ORDER BY 1)\n$$ LANGUAGE plpgsql",
}


def _scripts(t):
    body = lit("plain words only\n")
    for lang, text in _BODIES.items():
        body = F.when(c("lang") == lang, text).otherwise(body)
    head = F.when(
        c("lang") == "en", F.concat(lit("ALTER PROCEDURE [dbo].[p_"), "doc_id", lit("]\nAS\n"))
    ).otherwise("-- note\n")
    return t.documents.select("doc_id", F.concat(head, body, lit("-- "), "source").alias("text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_SCRIPTS_SQL = (
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 'ALTER PROCEDURE [dbo].[p_' || doc_id || ']' || chr(10) || 'AS' || chr(10) "
    "ELSE '-- note' || chr(10) END || CASE lang "
    + " ".join(f"WHEN '{lang}' THEN {_quoted(text)}" for lang, text in _BODIES.items())
    + f" ELSE {_quoted('plain words only' + chr(10))} END || '-- ' || source AS text FROM documents"
)


def _hits(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}', 0, 'im'))"


def _prescan_sql(source: str, dialects: dict[str, list[str]], constructs: dict[str, str]) -> str:
    scores = ", ".join(
        f"{' + '.join(_hits(p) for p in patterns)} AS score_{name}" for name, patterns in dialects.items()
    )
    counts = ", ".join(f"{_hits(p)} AS {name}" for name, p in constructs.items())
    best = f"greatest({', '.join('score_' + name for name in dialects)})"
    cases = " ".join(f"WHEN score_{name} = {best} THEN '{name}'" for name in dialects)
    return f"""
    WITH s AS (SELECT doc_id, len(regexp_extract_all(text, '\\r\\n|\\n|\\r'))
                 + CASE WHEN text <> '' AND right(text, 1) NOT IN (chr(10), chr(13)) THEN 1 ELSE 0 END AS total_lines, {scores}, {counts} FROM ({source}))
    SELECT *, CASE WHEN {best} = 0 THEN 'unknown' {cases} END AS detected_dialect FROM s
    """


@query("script_prescan", _prescan_sql(_SCRIPTS_SQL, corpus.DIALECTS, corpus.CONSTRUCTS))
def _(t):
    return corpus.prescan(_scripts(t))


# The same scan over the whole document texts, with words of four languages.
_LANGUAGES = {
    "english": [" the ", " and "],
    "german": [" der ", " und "],
    "french": [" le ", " la "],
    "spanish": [" el ", " los "],
}
_COUNTED = {"digits": "[0-9]+", "addresses": "[a-z0-9._-]+@[a-z0-9.-]+", "questions": "[?]"}


@query("script_prescan_documents", _prescan_sql("SELECT doc_id, text FROM documents", _LANGUAGES, _COUNTED))
def _(t):
    return corpus.prescan(t.documents.select("doc_id", "text"), _LANGUAGES, _COUNTED)


@query(
    "script_objects",
    f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM ({_SCRIPTS_SQL}))
    SELECT doc_id, regexp_extract(line, '(?i)(?:PROCEDURE|FUNCTION)\\s+(?:\\[?\\w+\\]?\\.)?\\[?(\\w+)', 1) AS object_name,
           lower(regexp_extract(line, '(?i)(PROCEDURE|FUNCTION)', 1)) AS object_type, n::BIGINT AS start_line
    FROM l WHERE regexp_matches(line, '(?i)(CREATE|ALTER|REPLACE)\\s+(PROCEDURE|FUNCTION)')
    """,
)
def _(t):
    return corpus.script_objects(_scripts(t))


_FACTORS_SQL = """
    SELECT doc_id, len(regexp_extract_all(text, '\\n')) AS line_count, len(regexp_extract_all(text, '[0-9]+')) AS dependency_count,
           len(regexp_extract_all(text, ' the ')) AS temp_table_count, len(regexp_extract_all(text, '@')) AS cursor_or_dynamic_count,
           len(regexp_extract_all(text, '[?]')) AS window_count, len(regexp_extract_all(text, ' and ')) AS control_depth,
           len(regexp_extract_all(text, '!')) AS transaction_depth FROM documents
"""


def _step_sql(value: str, steps, beyond) -> str:
    cases = " ".join(f"WHEN {value} <= {bound} THEN {score}" for bound, score in steps)
    return f"CASE {cases} ELSE {beyond} END"


_SCORE_SQL = " + ".join(
    f"({_step_sql(name, steps, beyond)}) * {weight}" for name, (weight, steps, beyond) in corpus.FACTORS.items()
)


@query(
    "complexity_score",
    f"""
    SELECT *, CASE WHEN floor(complexity + 0.5) <= 3 THEN 'Simple' WHEN floor(complexity + 0.5) <= 6 THEN 'Moderate'
                   WHEN floor(complexity + 0.5) <= 8 THEN 'Complex' ELSE 'Very Complex' END AS complexity_level,
           CASE WHEN dependency_count > 15 OR line_count > 5000 THEN 'Enterprise script'
                WHEN dependency_count <= 1 AND line_count < 500 THEN 'Simple script'
                WHEN dependency_count <= 5 AND line_count < 2000 THEN 'Standard script' ELSE 'Complex script' END AS file_class
    FROM (SELECT *, ({_SCORE_SQL}) / 100 AS complexity FROM ({_FACTORS_SQL}))
    """,
)
def _(t):
    counted = {
        "line_count": "\n",
        "dependency_count": "[0-9]+",
        "temp_table_count": " the ",
        "cursor_or_dynamic_count": "@",
        "window_count": "[?]",
        "control_depth": " and ",
        "transaction_depth": "!",
    }
    factors = t.documents.select(
        "doc_id", *[F.regexp_count("text", lit(pattern)).alias(name) for name, pattern in counted.items()]
    )
    return corpus.complexity_score(factors).withColumn(
        "file_class", corpus.file_class(c("dependency_count"), c("line_count"))
    )


# One review issue per order line: severity from its flags, message from its line number.
_MESSAGES = {
    1: "Cursor loop needs a rewrite",
    2: "Delta table must exist",
    3: "unionAll is deprecated",
    4: "MERGE has no direct form",
    5: "uses a JDBC source",
    6: "Dynamic SQL found",
}
_ISSUES_SQL = (
    "SELECT l_orderkey AS file, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'ERROR' WHEN l_returnflag = 'A' THEN 'high' "
    "WHEN l_linestatus = 'O' THEN 'MEDIUM' ELSE 'INFO' END AS severity, CASE l_linenumber "
    + " ".join(f"WHEN {n} THEN '{text}'" for n, text in _MESSAGES.items())
    + " ELSE 'missing annotation' END AS message FROM lineitem"
)


def _issues(t):
    severity = F.when(c("l_returnflag") == "R", "ERROR").when(c("l_returnflag") == "A", "high")
    severity = severity.when(c("l_linestatus") == "O", "MEDIUM").otherwise("INFO")
    return t.lineitem.select(
        c("l_orderkey").alias("file"),
        "l_partkey",
        severity.alias("severity"),
        rules.lookup(c("l_linenumber"), _MESSAGES, "missing annotation").alias("message"),
    )


@query(
    "issue_classify",
    f"""
    SELECT file, l_partkey, CASE WHEN message LIKE 'Delta table%' OR message LIKE '%JDBC%' THEN 'infrastructure'
        WHEN severity IN ('ERROR', 'high') AND regexp_matches(lower(message), 'cursor|merge|dynamic sql') THEN 'manual'
        WHEN severity IN ('ERROR', 'high') THEN 'auto_fix' ELSE 'review' END AS category FROM ({_ISSUES_SQL})
    """,
)
def _(t):
    category = corpus.classify_issue(c("severity"), c("message"))
    return _issues(t).select("file", "l_partkey", category.alias("category"))


@query(
    "confidence_score",
    f"""
    WITH f AS (
        SELECT o_orderkey AS file, o_orderstatus <> 'F' AS ok, o_orderpriority <> '1-URGENT' AS logic, o_orderstatus = 'O' AS deps,
               CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 0 END AS todo, CASE WHEN o_orderpriority = '2-HIGH' THEN 4 ELSE 0 END AS fixed,
               o_orderstatus = 'P' AS reverted, o_totalprice > 250000 AS lim FROM orders
    ), i AS (
        SELECT file, count(*) FILTER (WHERE severity IN ('ERROR', 'high') AND regexp_matches(lower(message), 'cursor|merge|dynamic sql')) AS man,
               count(*) FILTER (WHERE NOT infra AND severity = 'ERROR') AS err, count(*) FILTER (WHERE NOT infra AND severity = 'high') AS hi,
               count(*) FILTER (WHERE NOT infra AND severity = 'MEDIUM') AS med
        FROM (SELECT *, message LIKE 'Delta table%' OR message LIKE '%JDBC%' AS infra FROM ({_ISSUES_SQL})) GROUP BY 1
    ), s AS (
        SELECT f.file,
            greatest(0, least(100, 40 + CASE WHEN ok THEN 25 ELSE 0 END + CASE WHEN logic THEN 15 ELSE 0 END + CASE WHEN deps THEN 5 ELSE 0 END
                + CASE WHEN todo = 0 THEN 5 ELSE -least(todo * 3, 15) END - coalesce(man, 0) * 5 + least(fixed * 2, 10))) AS completion_pct,
            greatest(0, least(100, CASE WHEN ok THEN 50 ELSE 0 END + CASE WHEN logic THEN 20 ELSE 0 END + CASE WHEN deps THEN 10 ELSE 0 END
                + CASE WHEN coalesce(err, 0) = 0 AND coalesce(hi, 0) = 0 THEN 15 ELSE -coalesce(err, 0) * 8 - coalesce(hi, 0) * 5 END
                - least(coalesce(med, 0) * 2, 10) + CASE WHEN NOT reverted THEN least(fixed * 3, 10) ELSE 0 END - CASE WHEN lim THEN 5 ELSE 0 END)) AS confidence_pct
        FROM f LEFT JOIN i ON i.file = f.file)
    SELECT file, completion_pct::BIGINT AS completion_pct, confidence_pct::BIGINT AS confidence_pct,
           CASE WHEN g >= 95 THEN 'A+' WHEN g >= 90 THEN 'A' WHEN g >= 80 THEN 'B' WHEN g >= 70 THEN 'C' WHEN g >= 60 THEN 'D' ELSE 'F' END AS grade
    FROM (SELECT *, least(completion_pct, confidence_pct) AS g FROM s)
    """,
)
def _(t):
    reviewed = t.orders.select(
        c("o_orderkey").alias("file"),
        (c("o_orderstatus") != "F").alias("syntax_valid"),
        (c("o_orderpriority") != "1-URGENT").alias("logic_valid"),
        (c("o_orderstatus") == "O").alias("dependencies_resolved"),
        F.when(c("o_orderpriority") == "5-LOW", 2).otherwise(0).alias("todo_count"),
        F.when(c("o_orderpriority") == "2-HIGH", 4).otherwise(0).alias("issues_fixed"),
        (c("o_orderstatus") == "P").alias("was_reverted"),
        (c("o_totalprice") > 250000).alias("known_limitation"),
    )
    return corpus.confidence_scores(reviewed, _issues(t))


def _edges(t):
    """Orders need customers, customers and suppliers nations, nations regions."""

    def edge(df, kind, key, parent, parent_key):
        name = F.concat(lit(f"{kind}:"), c(key).cast("string"))
        return df.select(
            name.alias("node"), F.concat(lit(f"{parent}:"), c(parent_key).cast("string")).alias("depends_on")
        )

    return (
        edge(t.orders, "order", "o_orderkey", "customer", "o_custkey")
        .union(edge(t.customer, "customer", "c_custkey", "nation", "c_nationkey"))
        .union(edge(t.supplier, "supplier", "s_suppkey", "nation", "s_nationkey"))
        .union(edge(t.nation, "nation", "n_nationkey", "region", "n_regionkey"))
    )


@query(
    "dependency_levels",
    """
    SELECT 'order:' || o_orderkey AS node, 3::BIGINT AS level FROM orders
    UNION ALL SELECT 'customer:' || c_custkey, 2 FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 2 FROM supplier
    UNION ALL SELECT 'nation:' || n_nationkey, 1 FROM nation UNION ALL SELECT 'region:' || r_regionkey, 0 FROM region
    """,
)
def _(t):
    return graph.dependency_levels(_edges(t))


@query(
    "dependency_in_degree",
    """
    SELECT 'customer:' || o_custkey AS node, count(*) AS in_degree FROM orders GROUP BY o_custkey
    UNION ALL SELECT 'nation:' || k, count(*) FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k
    UNION ALL SELECT 'region:' || n_regionkey, count(*) FROM nation GROUP BY n_regionkey
    """,
)
def _(t):
    return graph.in_degree(_edges(t))


@query(
    "phase_cost_rollup",
    """
    WITH k AS (
        SELECT role AS phase, CASE WHEN turn = 0 THEN 'small' WHEN turn <= 3 THEN 'large' ELSE 'medium' END AS size,
               CAST(sum(length(text)) AS DOUBLE) AS i, CAST(sum(octet_length(encode(text))) AS DOUBLE) AS o, count(*) AS n, CAST(sum(turn) AS BIGINT) AS s
        FROM conversations GROUP BY 1, 2
    ), p AS (
        SELECT *, (i * CASE size WHEN 'small' THEN 0.8::DOUBLE WHEN 'large' THEN 15::DOUBLE ELSE 3::DOUBLE END
                 + o * CASE size WHEN 'small' THEN 4::DOUBLE WHEN 'large' THEN 75::DOUBLE ELSE 15::DOUBLE END) / 1000000 AS cost FROM k)
    SELECT coalesce(phase, 'total') AS phase, CAST(sum(n) AS BIGINT) AS calls, round(sum(cost), 6) AS cost, CAST(sum(s) AS BIGINT) AS seconds
    FROM p GROUP BY ROLLUP (phase)
    """,
)
def _(t):
    size = F.when(c("turn") == 0, "small").when(c("turn") <= 3, "large").otherwise("unlisted")
    calls = t.conversations.select(
        c("role").alias("phase"),
        size.alias("model_size"),
        F.length("text").alias("input_tokens"),
        F.octet_length("text").alias("output_tokens"),
        c("turn").alias("seconds"),
    )
    return corpus.phase_costs(calls)
