"""Distributed ranking against plain windows, with a hot key, ties and NULLs."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators import ranking as R

ORDER = [("v", "desc"), ("id", "asc")]


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(3)
    keys = ["hot"] * 6 + ["b", "c", None]
    values = [1, 2, 2, 2, 3, None] + list(range(4, 40))
    data = [(random.choice(keys), random.choice(values), i) for i in range(900)]
    return spark.createDataFrame(data, "k string, v int, id int").cache()


def same(left, right):
    assert left.columns == right.columns
    key = str
    assert sorted(map(tuple, left.collect()), key=key) == sorted(map(tuple, right.collect()), key=key)


def over(*keys, tie=True):
    order = [F.desc_nulls_last("v")] + (["id"] if tie else [])
    return W.partitionBy(*keys).orderBy(*order)


def test_row_number(rows):
    same(R.global_row_number(rows, ORDER, "r"), rows.select("*", F.row_number().over(over()).alias("r")))
    same(
        R.keyed_row_number(rows, ["k"], ORDER, "r"),
        rows.select("*", F.row_number().over(over("k")).alias("r")),
    )


@pytest.mark.parametrize("tiles", [1, 2, 4, 5, 7, 1000])
def test_ntile(rows, tiles):
    same(
        R.global_ntile(rows, ORDER, tiles, "r"), rows.select("*", F.ntile(tiles).over(over()).alias("r"))
    )
    same(
        R.keyed_ntile(rows, ["k"], ORDER, tiles, "r"),
        rows.select("*", F.ntile(tiles).over(over("k")).alias("r")),
    )


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranks(rows, keys):
    names = {"rank": "a", "dense_rank": "b", "percent_rank": "c", "cume_dist": "d"}
    w = over(*keys, tie=False)
    expected = rows.select(
        "*",
        F.rank().over(w).alias("a"),
        F.dense_rank().over(w).alias("b"),
        F.percent_rank().over(w).alias("c"),
        F.cume_dist().over(w).alias("d"),
    )
    same(R.with_ranks(rows, keys, [("v", "desc")], names), expected)


def test_neighbours(rows):
    expected = rows.select(
        "*", F.lag("v").over(over("k")).alias("a"), F.lead("v").over(over("k")).alias("b")
    )
    same(R.with_neighbours(rows, ["k"], ORDER, "v", "a", "b"), expected)


@pytest.mark.parametrize("way", ["asc", "desc"])
def test_running_by_bucket(rows, way):
    order = [("v", way), ("id", "asc")]
    w = W.partitionBy("k").orderBy(*R.sort_columns(order)).rowsBetween(W.unboundedPreceding, 0)
    expected = rows.select(
        "*", F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n")
    )
    same(R.running_by_bucket(rows, ["k"], "v", order, sums={"v": "s"}, count="n", way=way), expected)


def test_count_down_takes_buckets_in_reverse(rows):
    order = [("v", "asc"), ("id", "asc")]
    w = W.partitionBy("k").orderBy(F.desc_nulls_last("v"), "id")
    expected = rows.select("*", F.row_number().over(w).alias("n"))
    same(R.running_by_bucket(rows, ["k"], "v", order, count_down="n"), expected)


def test_tiles_differ_by_one(rows):
    sizes = [r["count"] for r in R.global_ntile(rows, ORDER, 7, "t").groupBy("t").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_last_running_total_is_the_sum(rows):
    total = R.global_positions(rows, ORDER, row="r", running={"v": "s"})
    assert total.agg(F.max_by("s", "r")).first()[0] == rows.agg(F.sum("v")).first()[0]


def test_empty_frame(rows):
    empty = rows.where("id < 0")
    assert R.global_ntile(empty, ORDER, 4, "r").count() == 0
    assert R.keyed_row_number(empty, ["k"], ORDER, "r").count() == 0
