"""JSON built and read. Parsed columns are compared, not the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog.registry import query
from tallyspark.functions.scalars import as_money

c = F.col


def _object():
    return F.to_json(
        F.struct(
            c("c_custkey").alias("id"),
            F.nullif(c("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
            as_money(c("c_acctbal")).alias("balance"),
        )
    )


@query(
    "json_object",
    """
    SELECT c_custkey AS id, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal AS balance,
           CAST(c_mktsegment <> 'BUILDING' AS BIGINT) AS has_segment FROM customer
    """,
)
def _(t):
    schema = "id bigint, segment string, balance double"
    text = t.customer.select(_object().alias("j"))
    return text.select(
        F.from_json("j", schema).alias("o"), c("j").contains('"segment"').alias("has_segment")
    ).select("o.*", "has_segment")


@query(
    "json_nested_array",
    """
    SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS orders,
           row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS place
    FROM orders GROUP BY 1, 2
    """,
)
def _(t):
    counts = t.orders.groupBy(c("o_orderstatus").alias("status"), c("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("orders")
    )
    # statuses and priorities are code lists, so each array is short
    items = F.sort_array(F.collect_list(F.struct((-c("orders")).alias("o"), "priority", "orders")))
    nested = F.transform(items, lambda i: F.struct(i["priority"].alias("priority"), i["orders"].alias("orders")))
    text = counts.groupBy("status").agg(F.to_json(F.struct(nested.alias("top"))).alias("j"))
    parsed = F.from_json("j", "top array<struct<priority:string,orders:bigint>>")["top"]
    return text.select("status", F.posexplode(parsed)).select(
        "status", "col.priority", "col.orders", (c("pos") + 1).alias("place")
    )


@query(
    "json_openjson",
    """
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           TRY_CAST(json_extract_string(props, '$.k') || 'x' AS BIGINT) AS bad FROM events
    """,
)
def _(t):
    parsed = F.from_json("props", "k string")
    return t.events.select("event_id", parsed.alias("p")).select(
        "event_id",
        c("p.k").try_cast("bigint").alias("k"),
        F.concat("p.k", F.lit("x")).try_cast("bigint").alias("bad"),
    )


@query("json_value", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    "json_query",
    """
    SELECT event_id, json_extract_string(json_extract('{"a": ' || props || '}', '$.a'), '$.k') AS k FROM events
    """,
)
def _(t):
    wrapped = F.concat(F.lit('{"a": '), "props", F.lit("}"))
    subtree = F.get_json_object(wrapped, "$.a")
    return t.events.select("event_id", F.get_json_object(subtree, "$.k").alias("k"))
