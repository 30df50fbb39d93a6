"""NTILE by cut rows, neighbours by ranges and by buckets, against plain windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators import cuts
from tallyspark.operators import ranking as R
from tallyspark.operators.cuts import with_tiles


def same(left, right):
    assert left.columns == right.columns
    # as text, because NaN does not equal itself
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    values = [0] * 40 + [None] * 5 + list(range(1, 60))
    data = [
        (
            rng.choice(["hot"] * 5 + ["b", None]),
            rng.choice(values),
            i,
            rng.choice([None, 1.5, float("nan"), float("inf"), -2.0, 2.0]),
            dt.datetime(2024, 1, rng.randint(1, 9), rng.randint(0, 23)) if rng.random() < 0.97 else None,
        )
        for i in range(1200)
    ]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, v int, id int, x double, ts timestamp").repartition(5).cache()


def over(order, *keys):
    return W.partitionBy(*keys).orderBy(*R.sort_columns(order))


@pytest.mark.parametrize("tiles, way", [(1, "asc"), (4, "asc"), (5, "desc"), (7, "asc")])
def test_tiles(rows, tiles, way):
    order = [("v", way), ("id", "asc")]
    same(with_tiles(rows, {"t": (order, tiles)}), rows.select("*", F.ntile(tiles).over(over(order)).cast("bigint").alias("t")))


def test_more_tiles_than_rows(rows):
    few, order = rows.where("id < 9"), [("v", "desc"), ("id", "asc")]
    same(with_tiles(few, {"t": (order, 12)}), few.select("*", F.ntile(12).over(over(order)).cast("bigint").alias("t")))


def test_several_scores_in_one_pass(rows):
    orders = {
        "a": ([("ts", "desc"), ("id", "desc")], 5),
        "b": ([("x", "asc"), ("k", "desc"), ("id", "asc")], 4),
        "c": ([("v", "desc"), ("k", "asc"), ("id", "asc")], 3),
    }
    expected = rows.select("*", *[F.ntile(n).over(over(o)).cast("bigint").alias(name) for name, (o, n) in orders.items()])
    same(with_tiles(rows, orders), expected)


def test_brackets_that_miss_are_opened(rows, monkeypatch):
    # brackets far from every cut: counted, found wanting, and opened
    monkeypatch.setattr(cuts, "MARGIN", -0.2)
    order = [("v", "desc"), ("id", "asc")]
    same(with_tiles(rows, {"t": (order, 4)}), rows.select("*", F.ntile(4).over(over(order)).cast("bigint").alias("t")))


def test_nothing_to_tile(rows):
    order = [("v", "desc"), ("id", "asc")]
    assert with_tiles(rows.limit(0), {"t": (order, 4)}).count() == 0
    with pytest.raises(ValueError, match="k: "):
        with_tiles(rows, {"t": ([("k", "asc")], 2)})


def test_only_order_columns_are_sorted(spark):
    """The rows themselves meet the cut rows in a broadcast join; no exchange carries them."""
    wide = spark.range(5000).select("id", (F.col("id") % 97).alias("v"), F.repeat(F.lit("x"), 20).alias("wide"))
    plan = with_tiles(wide, {"t": ([("v", "desc"), ("id", "asc")], 4)})._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "RepartitionByExpression" not in plan


@pytest.mark.parametrize("function", ["lag", "lead"])
def test_neighbours_by_range(rows, function):
    order = [("v", "desc"), ("id", "asc")]
    expected = rows.select("*", getattr(F, function)("x").over(over(order, "k")).alias("other"))
    names = {"lag": None, "lead": None, function: "other"}
    same(R.with_neighbours(rows, ["k"], order, "x", **names), expected)
    one = rows.select("id", "v", "x")
    expected = one.select("*", getattr(F, function)("x").over(over(order)).alias("other"))
    same(R.with_neighbours(one, [], order, "x", **names), expected)


def test_neighbours_by_bucket(rows):
    order = [("ts", "asc"), ("id", "asc")]
    w = over(order, "k")
    expected = rows.select("*", F.lag("v").over(w).alias("a"), F.lead("v").over(w).alias("b"))
    same(R.neighbours_by_bucket(rows, ["k"], F.to_date("ts"), ["ts", "id"], "v", lag="a", lead="b"), expected)
    empty = rows.limit(0)
    assert R.neighbours_by_bucket(empty, ["k"], F.to_date("ts"), ["ts", "id"], "v", lag="a").count() == 0


def test_neighbours_join_no_frame_with_itself(spark, rows):
    order = [("v", "desc"), ("id", "asc")]
    plan = R.with_neighbours(rows, ["k"], order, "x", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    plan = R.neighbours_by_bucket(rows, ["k"], F.to_date("ts"), ["ts", "id"], "v", lag="a")
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
