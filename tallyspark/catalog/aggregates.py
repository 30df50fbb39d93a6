"""Grouped and global aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog.registry import query
from tallyspark.functions.rules import quota_band
from tallyspark.functions.scalars import as_money, safe_ratio
from tallyspark.operators import trend
from tallyspark.operators.joins import partitions_for


@query("agg_count_star", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "agg_count_col",
    """
    SELECT c_nationkey::BIGINT AS nation, count(*) AS all_rows,
           count(nullif(c_mktsegment, 'BUILDING')) AS known FROM customer GROUP BY 1
    """,
)
def _(t):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count("*").alias("all_rows"), F.count(segment).alias("known")
    )


@query(
    "agg_count_distinct",
    """
    SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS sellers
    FROM lineitem GROUP BY l_returnflag
    """,
)
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("sellers")
    )


@query(
    "agg_sum_avg_min_max",
    """
    SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(19,4))) AS DOUBLE) AS total,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(19,4))) AS DOUBLE) / count(l_extendedprice) AS mean,
           min(l_extendedprice) AS smallest, max(l_extendedprice) AS largest
    FROM lineitem GROUP BY l_suppkey
    """,
)
def _(t):
    price = as_money(F.col("l_extendedprice"))
    return t.lineitem.groupBy("l_suppkey").agg(
        F.sum(price).alias("total"),
        safe_ratio(F.sum(price), F.count(price)).alias("mean"),
        F.min("l_extendedprice").alias("smallest"),
        F.max("l_extendedprice").alias("largest"),
    )


@query(
    "agg_stdev_var",
    """
    SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS var
    FROM lineitem GROUP BY l_returnflag
    """,
)
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.stddev("l_quantity"), 6).alias("sd"),
        F.round(F.variance("l_quantity"), 6).alias("var"),
    )


@query(
    "agg_conditional_sum",
    """
    SELECT o_custkey,
           CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS online,
           CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(19,4)) ELSE 0 END) AS DOUBLE) AS finished
    FROM orders GROUP BY o_custkey
    """,
)
def _(t):
    online = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    finished = F.when(F.col("o_orderstatus") == "F", as_money(F.col("o_totalprice"))).otherwise(0)
    return t.orders.groupBy("o_custkey").agg(
        F.sum(F.when(online, 1).otherwise(0)).alias("online"), F.sum(finished).alias("finished")
    )


@query(
    "agg_conditional_band",
    """
    WITH s AS (SELECT l_suppkey AS seller, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue FROM lineitem GROUP BY 1),
    q AS (SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(19,4)) * 5000 AS quota FROM supplier)
    SELECT seller, CASE WHEN quota <= 0 THEN 'No Quota'
        WHEN revenue >= 1.20 * quota THEN 'Overachiever' WHEN revenue >= quota THEN 'On Target'
        WHEN revenue >= 0.80 * quota THEN 'Near Target' WHEN revenue >= 0.60 * quota THEN 'Below Target'
        ELSE 'At Risk' END AS band
    FROM s JOIN q ON s_suppkey = seller
    """,
)
def _(t):
    revenue = t.lineitem.groupBy(F.col("l_suppkey").alias("seller")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue")
    )
    quota = F.when(F.col("s_acctbal") > 0, as_money(F.col("s_acctbal")) * 5000)
    return revenue.join(t.supplier, F.col("seller") == F.col("s_suppkey")).select(
        "seller", quota_band(F.col("revenue"), quota).alias("band")
    )


@query(
    "agg_two_level",
    """
    WITH per_order AS (
        SELECT o_custkey, o_orderkey, count(*) AS lines, count(DISTINCT l_partkey) AS products,
               sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT o_custkey, count(*) AS orders, CAST(sum(lines) AS BIGINT) AS lines,
           CAST(sum(products) AS BIGINT) AS products, CAST(max(total) AS DOUBLE) AS largest
    FROM per_order GROUP BY 1
    """,
)
def _(t):
    lines = t.lineitem.where(F.col("l_orderkey").isNotNull()).select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = t.orders.where(F.col("o_orderkey").isNotNull()).select("o_custkey", "o_orderkey")
    # nearly every line is a group of its own, so a task's memory follows its rows
    parts = partitions_for(lines)
    per_order = (
        orders.repartition(parts, "o_orderkey")
        .join(lines.repartition(parts, "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "o_orderkey")
        .agg(
            F.count("*").alias("lines"),
            F.countDistinct("l_partkey").alias("products"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"),
        )
    )
    return per_order.groupBy("o_custkey").agg(
        F.count("*").alias("orders"),
        F.sum("lines").alias("lines"),
        F.sum("products").alias("products"),
        F.max("total").alias("largest"),
    )


@query(
    "agg_having",
    "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1 HAVING count(*) > 12",
)
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders")).where("orders > 12")


@query(
    "agg_string",
    """
    SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types FROM part GROUP BY p_brand
    """,
)
def _(t):
    return t.part.groupBy("p_brand").agg(
        F.array_join(F.sort_array(F.collect_set("p_type")), ", ").alias("types")
    )


_REGION_SEGMENT = """
    customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def _customers(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "balance", as_money(F.col("c_acctbal"))
    )


def _grouping_sql(sets: str) -> str:
    return f"""
    SELECT r_name, c_mktsegment AS segment, count(*) AS n,
           CAST(sum(CAST(c_acctbal AS DECIMAL(19,4))) AS DOUBLE) AS balance,
           CAST(grouping(r_name) * 2 + grouping(c_mktsegment) AS BIGINT) AS level
    FROM {_REGION_SEGMENT} GROUP BY {sets}
    """


def _grouped(grouped):
    return grouped.agg(
        F.count("*").alias("n"),
        F.sum("balance").alias("balance"),
        F.grouping_id().alias("level"),
    ).withColumnRenamed("c_mktsegment", "segment")


@query("agg_rollup", _grouping_sql("ROLLUP (r_name, c_mktsegment)"))
def _(t):
    return _grouped(_customers(t).rollup("r_name", "c_mktsegment"))


@query("agg_cube", _grouping_sql("CUBE (r_name, c_mktsegment)"))
def _(t):
    return _grouped(_customers(t).cube("r_name", "c_mktsegment"))


@query("agg_grouping_sets", _grouping_sql("GROUPING SETS ((r_name), (c_mktsegment), ())"))
def _(t):
    sets = [[F.col("r_name")], [F.col("c_mktsegment")], []]
    return _grouped(_customers(t).groupingSets(sets, "r_name", "c_mktsegment"))


_MONTHS = range(1, 13)


@query(
    "agg_pivot",
    "SELECT o_orderstatus AS status, "
    + ", ".join(
        f'CAST(sum(CAST(o_totalprice AS DECIMAL(19,4))) FILTER (WHERE month(o_orderdate) = {m}) AS DOUBLE) AS "{m}"'
        for m in _MONTHS
    )
    + " FROM orders GROUP BY 1",
)
def _(t):
    return (
        t.orders.select(
            F.col("o_orderstatus").alias("status"),
            F.month("o_orderdate").alias("month"),
            as_money(F.col("o_totalprice")).alias("total"),
        )
        .groupBy("status")
        .pivot("month", list(_MONTHS))
        .agg(F.sum("total"))
    )


@query(
    "agg_unpivot",
    """
    SELECT l_returnflag, 'quantity' AS measure, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS amount FROM lineitem GROUP BY 1
    UNION ALL
    SELECT l_returnflag, 'price', CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) FROM lineitem GROUP BY 1
    """,
)
def _(t):
    sums = t.lineitem.groupBy("l_returnflag").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,4)")).alias("quantity"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("price"),
    )
    return sums.unpivot("l_returnflag", ["quantity", "price"], "measure", "amount")


@query(
    "agg_group_null",
    """
    SELECT coalesce(g, 'Unknown') AS segment, n FROM (
        SELECT nullif(c_mktsegment, 'FURNITURE') AS g, count(*) AS n FROM customer GROUP BY 1)
    """,
)
def _(t):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE"))
    grouped = t.customer.groupBy(segment.alias("g")).agg(F.count("*").alias("n"))
    return grouped.select(F.coalesce("g", F.lit("Unknown")).alias("segment"), "n")


MONTHLY_SQL = """
    SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, sum(CAST(o_totalprice AS DECIMAL(19,4))) AS v
    FROM orders GROUP BY 1, 2
"""


@query(
    "agg_linear_trend",
    f"""
    WITH s AS (SELECT row_number() OVER (ORDER BY y, m) AS x, CAST(v AS DOUBLE) AS v FROM ({MONTHLY_SQL}))
    SELECT count(*) AS points, round(regr_slope(v, x), 2) AS slope, round(avg(v), 2) AS mean FROM s
    """,
)
def _(t):
    monthly = t.orders.groupBy(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).agg(F.sum(as_money(F.col("o_totalprice"))).alias("value"))
    fit = trend.linear_trend(monthly, ["year", "month"], "value")
    return fit.select(
        "points", F.round("slope", 2).alias("slope"), F.round("mean", 2).alias("mean")
    )


@query(
    "agg_scalar_bundle",
    """
    SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS customers,
           (SELECT count(*) FROM orders) AS orders,
           (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(19,4))) AS DOUBLE) FROM lineitem) AS gross,
           (SELECT count(DISTINCT p_type) FROM part) AS categories
    """,
)
def _(t):
    # each side is a global aggregate: one row
    orders = t.orders.agg(
        F.countDistinct("o_custkey").alias("customers"), F.count("*").alias("orders")
    )
    gross = t.lineitem.agg(F.sum(as_money(F.col("l_extendedprice"))).alias("gross"))
    categories = t.part.agg(F.countDistinct("p_type").alias("categories"))
    return orders.join(F.broadcast(gross)).join(F.broadcast(categories))


@query(
    "agg_ratio_safe",
    """
    SELECT l_suppkey, CAST(sum(CAST(l_tax AS DECIMAL(9,4))) AS DOUBLE) /
        nullif(CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_discount AS DECIMAL(9,4)) END) AS DOUBLE), 0) * 100 AS pct
    FROM lineitem GROUP BY 1
    """,
)
def _(t):
    tax = F.sum(F.col("l_tax").cast("decimal(9,4)"))
    discount = F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_discount").cast("decimal(9,4)"))
    return t.lineitem.groupBy("l_suppkey").agg((safe_ratio(tax, F.sum(discount)) * 100).alias("pct"))
