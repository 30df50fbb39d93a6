"""Projection, filters, joins, sorting and set operations."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.catalog.registry import query
from tallyspark.functions.scalars import (
    MONEY,
    all_of,
    as_money,
    equals_ignoring_case,
    equals_ignoring_trailing_space,
    flag_not_set,
    optional_equals,
)
from tallyspark.operators import joins, topn
from tallyspark.operators.ranking import global_row_number, neighbours_by_bucket

# --- projection and filters -----------------------------------------------------


@query(
    "prj_select_expr",
    """
    SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no,
           CAST(CAST(l_extendedprice AS DECIMAL(19,4)) AS DOUBLE) AS line_total,
           CAST(round(CAST(l_extendedprice AS DECIMAL(19,4)) * (1 - CAST(l_discount AS DECIMAL(5,4))), 4) AS DOUBLE) AS net_total
    FROM lineitem
    """,
)
def _(t):
    line_total = as_money(F.col("l_extendedprice"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        line_total.alias("line_total"),
        (line_total * (1 - F.col("l_discount").cast("decimal(5,4)"))).alias("net_total"),
    )


@query("prj_distinct", "SELECT DISTINCT p_type, p_brand FROM part")
def _(t):
    return t.part.select("p_type", "p_brand").distinct()


@query(
    "flt_and_or_not",
    """
    SELECT l_returnflag, count(*) AS n FROM lineitem
    WHERE (l_quantity > 25 OR l_discount > 0.05) AND NOT (l_linestatus = 'F' AND l_tax = 0)
    GROUP BY l_returnflag
    """,
)
def _(t):
    c = F.col
    big = (c("l_quantity") > 25) | (c("l_discount") > 0.05)
    untaxed = (c("l_linestatus") == "F") & (c("l_tax") == 0)
    return t.lineitem.where(big & ~untaxed).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "flt_between_dates",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-09-30'
    """,
)
def _(t):
    day = F.col("o_orderdate").cast("date")
    inside = day.between(F.lit("1996-03-01").cast("date"), F.lit("1996-09-30").cast("date"))
    return t.orders.where(inside).select("o_orderkey", "o_custkey")


@query(
    "flt_in_list",
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH') GROUP BY ALL",
)
def _(t):
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return t.orders.where(urgent).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "flt_like_ilike",
    """
    SELECT p_partkey, CAST(p_name LIKE 'red%' AS BIGINT) AS starts_red,
           CAST(p_name ILIKE '%WIDGET%' AS BIGINT) AS has_widget
    FROM part WHERE p_name LIKE 'red%' OR p_name ILIKE '%WIDGET%'
    """,
)
def _(t):
    starts, has = F.col("p_name").like("red%"), F.col("p_name").ilike("%WIDGET%")
    return t.part.where(starts | has).select(
        "p_partkey", starts.alias("starts_red"), has.alias("has_widget")
    )


@query(
    "flt_optional_param",
    """
    SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL
    """,
)
def _(t):
    chosen = all_of(
        optional_equals(F.col("c_mktsegment"), "BUILDING"),
        optional_equals(F.col("c_nationkey"), None),
    )
    return t.customer.where(chosen).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


_FLAGGED = """
    SELECT *, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal > 5000 END AS is_vip FROM customer
"""


@query(
    "flt_bit_three_valued",
    f"""
    SELECT count(*) FILTER (WHERE NOT is_vip) AS dropped_null,
           count(*) FILTER (WHERE NOT is_vip OR is_vip IS NULL) AS kept_null,
           count(*) AS total
    FROM ({_FLAGGED})
    """,
)
def _(t):
    vip = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") > 5000)
    return t.customer.select(vip.alias("is_vip")).agg(
        F.count_if(flag_not_set(F.col("is_vip"), keep_null=False)).alias("dropped_null"),
        F.count_if(flag_not_set(F.col("is_vip"), keep_null=True)).alias("kept_null"),
        F.count("*").alias("total"),
    )


@query(
    "flt_null_safe_eq",
    """
    SELECT n.n_name AS nation, count(*) AS n
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE nullif(c.c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM
          (CASE WHEN n.n_regionkey = 1 THEN NULL ELSE 'MACHINERY' END)
    GROUP BY n.n_name
    """,
)
def _(t):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    wanted = F.when(F.col("n_regionkey") != 1, F.lit("MACHINERY"))
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        joined.where(segment.eqNullSafe(wanted))
        .groupBy(F.col("n_name").alias("nation"))
        .agg(F.count("*").alias("n"))
    )


@query("flt_ci_eq", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def _(t):
    return t.customer.where(
        equals_ignoring_case(F.col("c_mktsegment"), F.lit("Building"))
    ).select("c_custkey")


@query(
    "flt_trailing_space_eq",
    "SELECT c_custkey FROM customer WHERE rtrim(c_mktsegment || '  ') = rtrim('FURNITURE ')",
)
def _(t):
    padded = F.concat("c_mktsegment", F.lit("  "))
    return t.customer.where(equals_ignoring_trailing_space(padded, F.lit("FURNITURE "))).select(
        "c_custkey"
    )


@query(
    "case_tiering",
    """
    SELECT CASE WHEN p_retailprice > 980 THEN 'Premium' WHEN p_retailprice > 950 THEN 'Standard'
                WHEN p_retailprice > 910 THEN 'Budget' ELSE 'Clearance' END AS tier, count(*) AS n
    FROM part GROUP BY 1
    """,
)
def _(t):
    price = F.col("p_retailprice")
    tier = (
        F.when(price > 980, "Premium")
        .when(price > 950, "Standard")
        .when(price > 910, "Budget")
        .otherwise("Clearance")
    )
    return t.part.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query(
    "case_simple",
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Processing'
           ELSE 'Unknown' END AS label
    FROM orders
    """,
)
def _(t):
    status = F.col("o_orderstatus")
    label = F.when(status == "O", "Open").when(status == "P", "Processing").otherwise("Unknown")
    return t.orders.select("o_orderkey", label.alias("label"))


@query(
    "iif",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size FROM orders",
)
def _(t):
    return t.orders.select(
        "o_orderkey", F.when(F.col("o_totalprice") > 200000, "large").otherwise("small").alias("size")
    )


# --- joins ----------------------------------------------------------------------


@query(
    "join_inner",
    """
    SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus
    """,
)
def _(t):
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderstatus")
        .agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"))
    )


@query(
    "join_left",
    """
    SELECT o_orderkey, count(l_orderkey) AS lines
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
    """,
)
def _(t):
    return (
        t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .groupBy("o_orderkey")
        .agg(F.count("l_orderkey").alias("lines"))
    )


_BIG_ORDERS = "(SELECT o_custkey, count(*) AS orders FROM orders WHERE o_totalprice > 300000 GROUP BY 1)"
_RICH = "(SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000)"


def _big_orders(t):
    return (
        t.orders.where(F.col("o_totalprice") > 300000)
        .groupBy("o_custkey")
        .agg(F.count("*").alias("orders"))
    )


def _rich(t):
    return t.customer.where(F.col("c_acctbal") > 5000).select("c_custkey", "c_name")


@query(
    "join_right",
    f"SELECT o_custkey, orders, c_custkey, c_name FROM {_BIG_ORDERS} RIGHT JOIN {_RICH} ON o_custkey = c_custkey",
)
def _(t):
    return _big_orders(t).join(_rich(t), F.col("o_custkey") == F.col("c_custkey"), "right")


@query(
    "join_full",
    f"SELECT o_custkey, orders, c_custkey, c_name FROM {_BIG_ORDERS} FULL JOIN {_RICH} ON o_custkey = c_custkey",
)
def _(t):
    return _big_orders(t).join(_rich(t), F.col("o_custkey") == F.col("c_custkey"), "full")


@query(
    "join_cross",
    """
    SELECT r_name, n_name, coalesce(customers, 0) AS customers
    FROM region CROSS JOIN nation
    LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) c
           ON c_nationkey = n_nationkey AND n_regionkey = r_regionkey
    """,
)
def _(t):
    # the product is asked for by name, and of two dimensions only
    grid = t.region.crossJoin(t.nation)
    customers = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    inside = (F.col("c_nationkey") == F.col("n_nationkey")) & (
        F.col("n_regionkey") == F.col("r_regionkey")
    )
    return grid.join(customers, inside, "left").select(
        "r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers")
    )


_PER_DAY = """
    (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, count(*) AS orders FROM orders GROUP BY 1, 2)
"""
_SHIPPED = """
    (SELECT o_custkey AS k2, CAST(l_shipdate AS DATE) AS d2, count(*) AS shipped
     FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
"""


@query(
    "join_multi_key",
    f"SELECT k AS customer_id, CAST(d AS VARCHAR) AS day, orders, shipped FROM {_PER_DAY} JOIN {_SHIPPED} ON k = k2 AND d = d2",
)
def _(t):
    ordered = t.orders.groupBy(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("day")
    ).agg(F.count("*").alias("orders"))
    shipped = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.col("o_custkey").alias("customer_id"), F.col("l_shipdate").cast("date").alias("day")
        )
        .agg(F.count("*").alias("shipped"))
    )
    return ordered.join(shipped, ["customer_id", "day"])


_NULL_SEGMENT = "nullif(c_mktsegment, 'MACHINERY')"


@query(
    "join_null_safe",
    f"""
    WITH a AS (SELECT {_NULL_SEGMENT} AS segment, count(*) AS customers FROM customer GROUP BY 1),
         b AS (SELECT {_NULL_SEGMENT} AS segment,
                      CAST(sum(CAST(c_acctbal AS DECIMAL(19,4))) AS DOUBLE) AS balance FROM customer GROUP BY 1)
    SELECT a.segment, customers, balance FROM a JOIN b ON a.segment IS NOT DISTINCT FROM b.segment
    """,
)
def _(t):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))
    counts = t.customer.groupBy(segment.alias("segment")).agg(F.count("*").alias("customers"))
    sums = t.customer.groupBy(segment.alias("other")).agg(
        F.sum(as_money(F.col("c_acctbal"))).alias("balance")
    )
    return counts.join(sums, F.col("segment").eqNullSafe(F.col("other"))).drop("other")


@query(
    "join_semi",
    """
    SELECT c_custkey FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
    """,
)
def _(t):
    large = t.orders.where(F.col("o_totalprice") > 400000)
    return t.customer.join(
        large, F.col("o_custkey") == F.col("c_custkey"), "left_semi"
    ).select("c_custkey")


@query(
    "join_anti",
    """
    SELECT o_orderkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
)
def _(t):
    return t.orders.join(
        t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"
    ).select("o_orderkey")


@query(
    "join_not_in",
    """
    SELECT 'known values' AS against, count(*) AS customers FROM customer
        WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
    UNION ALL SELECT 'a null value', count(*) FROM customer
        WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)
    UNION ALL SELECT 'null rows', count(*) FROM customer
        WHERE nullif(c_nationkey, 3) NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 5)
    UNION ALL SELECT 'no values', count(*) FROM customer
        WHERE nullif(c_nationkey, 3) NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 0)
    """,
)
def _(t):
    nation, seller = F.col("c_nationkey"), F.col("s_nationkey")
    cases = [
        ("known values", nation, t.supplier.where("s_acctbal > 9000").select(seller.alias("x"))),
        ("a null value", nation, t.supplier.select(F.nullif(seller, F.lit(3)).alias("x"))),
        ("null rows", F.nullif(nation, F.lit(3)), t.supplier.where(seller < 5).select(seller.alias("x"))),
        ("no values", F.nullif(nation, F.lit(3)), t.supplier.where(seller < 0).select(seller.alias("x"))),
    ]
    counts = [
        joins.join_not_in(t.customer.select(value.alias("k")), "k", excluded, "x")
        .agg(F.count("*").alias("customers"))
        .select(F.lit(name).alias("against"), "customers")
        for name, value, excluded in cases
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    "join_on_filter",
    """
    SELECT c_custkey, count(o_orderkey) AS recent_open FROM customer
    LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderstatus <> 'F'
    GROUP BY c_custkey
    """,
)
def _(t):
    recent = t.orders.where(
        (F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderstatus") != "F")
    )
    return (
        t.customer.join(recent, F.col("o_custkey") == F.col("c_custkey"), "left")
        .groupBy("c_custkey")
        .agg(F.count("o_orderkey").alias("recent_open"))
    )


@query(
    "join_agg_subquery",
    """
    SELECT s_suppkey, coalesce(quota, 0) AS quota FROM supplier LEFT JOIN (
        SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(19,4))) AS DOUBLE) AS quota
        FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY l_suppkey
    ) ON l_suppkey = s_suppkey
    """,
)
def _(t):
    quota = (
        t.lineitem.where(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
        .groupBy("l_suppkey")
        .agg(F.sum(as_money(F.col("l_extendedprice"))).alias("quota"))
    )
    return t.supplier.join(quota, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
        "s_suppkey", F.coalesce("quota", F.lit(0)).alias("quota")
    )


@query(
    "join_broadcast_dim",
    """
    SELECT n_name, r_name, count(*) AS customers FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
    """,
)
def _(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        joins.join_dimension(t.customer, places, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "r_name")
        .agg(F.count("*").alias("customers"))
    )


@query(
    "join_self_before_after",
    """
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT a.event_id, b.event_type AS old_type, a.event_type AS new_type
    FROM e a JOIN e b ON a.user_id = b.user_id AND a.n = b.n + 1 WHERE a.event_type <> b.event_type
    """,
)
def _(t):
    images = neighbours_by_bucket(
        t.events.select("event_id", "ts", "user_id", "event_type"),
        ["user_id"],
        F.col("ts").cast("date"),
        ["ts", "event_id"],
        "event_type",
        lag="old_type",
    )
    return images.where(F.col("event_type") != F.col("old_type")).select(
        "event_id", "old_type", F.col("event_type").alias("new_type")
    )


@query(
    "apply_cross",
    """
    SELECT o_orderkey, label, CAST(amount AS DOUBLE) AS amount FROM (
        SELECT o_orderkey, 'total' AS label, CAST(o_totalprice AS DECIMAL(19,4)) AS amount FROM orders
        UNION ALL SELECT o_orderkey, 'tax', CAST(CAST(o_totalprice AS DECIMAL(19,4)) * 0.08 AS DECIMAL(19,4)) FROM orders
        UNION ALL SELECT o_orderkey, 'freight', CAST(CAST(o_totalprice AS DECIMAL(19,4)) * 0.02 AS DECIMAL(19,4)) FROM orders)
    WHERE amount > 5000
    """,
)
def _(t):
    total = as_money(F.col("o_totalprice").outer())

    def part(label, factor):
        amount = (total * F.lit(Decimal(factor))).cast(MONEY)
        return F.struct(F.lit(label).alias("label"), amount.alias("amount"))

    # a table of three rows for each order, of which some pass
    parts = t.spark.tvf.inline(F.array(part("total", "1.00"), part("tax", "0.08"), part("freight", "0.02")))
    return t.orders.lateralJoin(parts).where("amount > 5000").select("o_orderkey", "label", "amount")


@query(
    "apply_outer",
    """
    SELECT r_name, n.n_name AS nation FROM region
    LEFT JOIN LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 20) n ON TRUE
    """,
)
def _(t):
    late = t.nation.where((F.col("n_regionkey") == F.col("r_regionkey").outer()) & (F.col("n_nationkey") > 20))
    return t.region.lateralJoin(late.select("n_name"), how="left").select(
        "r_name", F.col("n_name").alias("nation")
    )


@query(
    "apply_top_n_per_row",
    """
    WITH s AS (
        SELECT o_custkey AS customer_id, p_type AS category, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
    SELECT customer_id, category, CAST(revenue AS DOUBLE) AS revenue FROM s
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY revenue DESC, category) <= 5
    """,
)
def _(t):
    lines = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("customer_id"),
            F.col("p_type").alias("category"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        )
    )
    return topn.top_groups_per_key(lines, "customer_id", "category", "amount", 5)


# --- sort, limit, sets ------------------------------------------------------------


@query(
    "ord_nulls",
    """
    SELECT n AS position, CAST(k AS BIGINT) AS nation_key, CAST(nullable AS BIGINT) AS nullable FROM (
        SELECT c_nationkey AS k, nullif(c_nationkey, 3) AS nullable,
               row_number() OVER (ORDER BY nullif(c_nationkey, 3) ASC NULLS FIRST) AS n
        FROM (SELECT DISTINCT c_nationkey FROM customer))
    """,
)
def _(t):
    keys = t.customer.select(F.col("c_nationkey").alias("nation_key")).distinct()
    keys = keys.withColumn("nullable", F.nullif(F.col("nation_key"), F.lit(3)))
    return global_row_number(keys, [("nullable", "asc")], "position")


@query(
    "top_n",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def _(t):
    return (
        t.orders.select("o_orderkey", "o_totalprice")
        .orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")
        .limit(10)
    )


@query(
    "top_n_with_ties",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem QUALIFY rank() OVER (ORDER BY l_quantity DESC) <= 10",
)
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return topn.top_with_ties(lines, "l_quantity", 10)


@query(
    "offset_fetch",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50",
)
def _(t):
    return (
        t.customer.select("c_custkey", "c_acctbal")
        .orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey")
        .offset(50)
        .limit(25)
    )


@query(
    "ord_multi_expr",
    """
    SELECT row_number() OVER (ORDER BY n_name, c_acctbal * 2 DESC, c_name) AS position, n_name, c_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def _(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_name", "c_name", (F.col("c_acctbal") * 2).alias("score")
    )
    order = [("n_name", "asc"), ("score", "desc"), ("c_name", "asc")]
    return global_row_number(rows, order, "position").drop("score")


@query(
    "set_union_all",
    """
    SELECT kind, count(*) AS n FROM (
        SELECT 'customer' AS kind, c_nationkey AS nation FROM customer
        UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY kind
    """,
)
def _(t):
    customers = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    suppliers = t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return customers.unionByName(suppliers).groupBy("kind").agg(F.count("*").alias("n"))


def _nations(t):
    customers = t.customer.where(F.col("c_acctbal") > 9000).select(F.col("c_nationkey").alias("nation"))
    suppliers = t.supplier.where(F.col("s_acctbal") > 5000).select(F.col("s_nationkey").alias("nation"))
    return customers, suppliers


_A = "SELECT CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_acctbal > 9000"
_B = "SELECT CAST(s_nationkey AS BIGINT) AS nation FROM supplier WHERE s_acctbal > 5000"


@query("set_union_distinct", f"{_A} UNION {_B}")
def _(t):
    a, b = _nations(t)
    return a.union(b).distinct()


@query("set_intersect", f"{_A} INTERSECT {_B}")
def _(t):
    a, b = _nations(t)
    return a.intersect(b)


@query("set_except", f"{_A} EXCEPT ALL {_B}")
def _(t):
    a, b = _nations(t)
    return a.exceptAll(b)
