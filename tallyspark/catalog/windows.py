"""Window functions. Frames are ROWS unless a query says RANGE."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.catalog.registry import query
from tallyspark.functions.scalars import as_money, safe_ratio
from tallyspark.operators import ranking
from tallyspark.operators.cuts import with_tiles
from tallyspark.operators.joins import join_dimension

_PRICES = "SELECT p_partkey, p_brand, p_retailprice FROM part"


def _prices(t):
    return t.part.select("p_partkey", "p_brand", "p_retailprice")


@query(
    "win_row_number",
    """
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS in_customer,
           row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS overall
    FROM orders
    """,
)
def _(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    order = [("o_orderdate", "desc"), ("o_orderkey", "asc")]
    keyed = ranking.keyed_row_number(orders, ["o_custkey"], order, "in_customer")
    return ranking.global_row_number(keyed, order, "overall").select(
        "o_orderkey", "in_customer", "overall"
    )


def _rank_query(function: str, way: str):
    @query(
        f"win_{function}",
        f"""
        SELECT p_partkey, {function}() OVER (PARTITION BY p_brand ORDER BY p_retailprice {way}) AS in_brand,
               {function}() OVER (ORDER BY p_retailprice {way}) AS overall FROM part
        """,
    )
    def _(t):
        order = [("p_retailprice", way.lower())]
        keyed = ranking.with_ranks(_prices(t), ["p_brand"], order, {function: "in_brand"})
        both = ranking.with_ranks(keyed, [], order, {function: "overall"})
        return both.select("p_partkey", "in_brand", "overall")


_rank_query("rank", "DESC")
_rank_query("dense_rank", "DESC")
_rank_query("percent_rank", "ASC")
_rank_query("cume_dist", "ASC")


@query(
    "win_ntile_global",
    """
    SELECT o_orderkey, ntile(4) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS quartile FROM orders
    """,
)
def _(t):
    order = [("o_totalprice", "desc"), ("o_orderkey", "asc")]
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return with_tiles(rows, {"quartile": (order, 4)}).drop("o_totalprice")


@query(
    "win_ntile_partition",
    """
    SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS quartile FROM part
    """,
)
def _(t):
    order = [("p_retailprice", "desc"), ("p_partkey", "asc")]
    tiles = ranking.keyed_ntile(_prices(t), ["p_brand"], order, 4, "quartile")
    return tiles.select("p_partkey", "quartile")


def _neighbour_query(function: str):
    @query(
        f"win_{function}",
        f"""
        SELECT c_custkey, {function}(c_acctbal) OVER (
            PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS other FROM customer
        """,
    )
    def _(t):
        rows = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
        names = {"lag": None, "lead": None, function: "other"}
        return ranking.with_neighbours(
            rows, ["c_nationkey"], [("c_acctbal", "desc"), ("c_custkey", "asc")], "c_acctbal", **names
        ).select("c_custkey", "other")


_neighbour_query("lag")
_neighbour_query("lead")

# Calendar totals: the rows of one group are bounded by the number of months or days.
_MONTHLY = """
    SELECT o_orderpriority AS priority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
           CAST(sum(CAST(o_totalprice AS DECIMAL(19,4))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2
"""


def _monthly(t):
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority"), month.alias("month")).agg(
        F.sum(as_money(F.col("o_totalprice"))).alias("total")
    )


def _by_month():
    return Window.partitionBy("priority").orderBy("month")


@query(
    "win_first_last_value",
    f"""
    SELECT priority, CAST(month AS VARCHAR) AS month,
           first_value(total) OVER w AS first_total,
           last_value(total) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_total
    FROM ({_MONTHLY}) WINDOW w AS (PARTITION BY priority ORDER BY month)
    """,
)
def _(t):
    whole = _by_month().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _monthly(t).select(
        "priority",
        "month",
        F.first("total").over(_by_month()).alias("first_total"),
        F.last("total").over(whole).alias("last_total"),
    )


@query(
    "win_running_sum_rows",
    """
    SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(19,4))) OVER (
        PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running
    FROM orders
    """,
)
def _(t):
    rows = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", as_money(F.col("o_totalprice")).alias("total")
    )
    return ranking.running_by_bucket(
        rows,
        ["o_custkey"],
        "o_orderdate",
        [("o_orderdate", "asc"), ("o_orderkey", "asc")],
        sums={"total": "running"},
    ).select("o_orderkey", "running")


@query(
    "win_running_sum_range",
    """
    SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(19,4))) OVER (
        PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE)) AS DOUBLE) AS running FROM orders
    """,
)
def _(t):
    # RANGE gives all rows of a day the day's closing total, so days are summed first
    day = F.col("o_orderdate").cast("date")
    rows = t.orders.select(
        "o_orderkey", "o_orderpriority", day.alias("day"), as_money(F.col("o_totalprice")).alias("total")
    )
    closing = rows.groupBy("o_orderpriority", "day").agg(F.sum("total").alias("total"))
    frame = Window.partitionBy("o_orderpriority").orderBy("day")
    frame = frame.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    closing = closing.select("o_orderpriority", "day", F.sum("total").over(frame).alias("running"))
    return rows.join(closing, ["o_orderpriority", "day"]).select("o_orderkey", "running")


@query(
    "win_moving_avg",
    f"""
    SELECT priority, CAST(month AS VARCHAR) AS month, round(avg(total) OVER (
        PARTITION BY priority ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving
    FROM ({_MONTHLY})
    """,
)
def _(t):
    moving = F.avg(F.col("total").cast("double")).over(_by_month().rowsBetween(-2, 0))
    return _monthly(t).select("priority", "month", F.round(moving, 4).alias("moving"))


@query(
    "win_partition_total",
    "SELECT p_partkey, count(*) OVER (PARTITION BY p_type) AS in_type FROM part",
)
def _(t):
    counts = t.part.groupBy("p_type").agg(F.count("*").alias("in_type"))
    return join_dimension(t.part, counts, "p_type").select("p_partkey", "in_type")


@query(
    "win_over_aggregate",
    """
    SELECT year(o_orderdate) AS year, month(o_orderdate) AS month,
           CAST(sum(sum(CAST(o_totalprice AS DECIMAL(19,4)))) OVER (
               ORDER BY year(o_orderdate), month(o_orderdate)
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cumulative
    FROM orders GROUP BY 1, 2
    """,
)
def _(t):
    monthly = t.orders.groupBy(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).agg(F.sum(as_money(F.col("o_totalprice"))).alias("total"))
    # one row per calendar month
    frame = Window.orderBy("year", "month").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select("year", "month", F.sum("total").over(frame).alias("cumulative"))


@query(
    "win_share_of_total",
    """
    SELECT c_custkey, c_acctbal / (SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(19,4))) AS DOUBLE) FROM customer) * 100 AS share
    FROM customer
    """,
)
def _(t):
    total = t.customer.agg(F.sum(as_money(F.col("c_acctbal"))).alias("total"))
    return t.customer.join(F.broadcast(total)).select(
        "c_custkey", (safe_ratio(F.col("c_acctbal"), F.col("total")) * 100).alias("share")
    )


@query(
    "win_dedupe_latest",
    """
    SELECT user_id, event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def _(t):
    latest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return t.events.groupBy("user_id").agg(latest.alias("e")).select("user_id", "e.event_id", "e.event_type")
