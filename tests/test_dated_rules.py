"""The best dated rule per row against a search of all rules, and NOT IN with NULLs."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import joins

DAY = dt.date(2000, 1, 1)
RULE = "rule_id int, rk string, rs string, rt string, effective_date date, expiry_date date, pct int"


def day(n):
    return DAY + dt.timedelta(days=n)


def plain(facts, rules):
    for i, k, s, t, d in facts:
        held = [
            r for r in rules
            if k is not None and d is not None and r[1] == k and r[4] is not None and r[4] <= d
            and (r[5] is None or r[5] >= d) and r[2] in (None, s) and r[3] in (None, t)
        ]
        best = min(held, key=lambda r: (r[2] is None, r[3] is None, -r[4].toordinal(), r[0]), default=None)
        yield (i, *((best[0], best[6]) if best else (None, None)))


def test_against_a_search(spark):
    rng = random.Random(2)
    rules = []
    for i in range(400):
        start = rng.randint(-400, 400)
        rules.append(
            (i, rng.choice("ABC"), rng.choice([None, "x", "y"]), rng.choice([None, "m", "n"]),
             rng.choice([day(start)] * 9 + [None]), rng.choice([None, day(start + rng.randint(-3, 300))]), rng.randint(0, 9))
        )
    facts = [
        (i, rng.choice(["A", "B", "C", "D", None]), rng.choice([None, "x", "y", "z"]), rng.choice([None, "m", "n"]),
         rng.choice([None, *[day(rng.randint(-450, 800)) for _ in range(20)]]))
        for i in range(1500)
    ]
    rows = spark.createDataFrame(facts, "id int, k string, s string, t string, day date")
    found = joins.best_rule_per_day(
        rows, spark.createDataFrame(rules, RULE), [("k", "rk")], [("s", "rs"), ("t", "rt")], "day", ["pct"]
    )
    assert found.columns == [*rows.columns, "rule_id", "pct"]
    got = sorted((r.id, r.rule_id, r.pct) for r in found.collect())
    assert got == sorted(plain(facts, rules)) and sum(r[1] is not None for r in got) > 500


def test_blocks_cover_each_day_once(spark):
    rng = random.Random(6)
    spans = [(a, a + rng.randint(0, 1 << rng.randint(0, 20))) for a in (rng.randint(0, 1 << 21) for _ in range(300))]
    frame = spark.createDataFrame([*spans, (0, joins._LAST_DAY), (5, 5)], "a bigint, b bigint")
    for a, b, blocks in frame.select("a", "b", joins._blocks(F.col("a"), F.col("b"))).collect():
        parts = sorted((x["block"] << x["level"], (x["block"] + 1 << x["level"]) - 1) for x in blocks)
        assert parts[0][0] == a and parts[-1][1] == b
        assert all(p[1] + 1 == q[0] for p, q in itertools.pairwise(parts))
        assert len(parts) <= 2 * joins._LEVELS


def test_a_hundred_thousand_rules_on_one_key(spark):
    rules = spark.range(100_000).select(
        F.col("id").cast("int").alias("rule_id"),
        F.lit("A").alias("rk"),
        F.lit(None).cast("string").alias("rs"),
        F.date_add(F.lit(DAY), (F.col("id") % 5000).cast("int")).alias("effective_date"),
        F.date_add(F.lit(DAY), (F.col("id") % 5000 + F.col("id") % 7).cast("int")).alias("expiry_date"),
        (F.col("id") % 10).cast("int").alias("pct"),
    )
    facts = spark.range(20_000).select(
        "id", F.lit("A").alias("k"), F.lit("x").alias("s"), F.date_add(F.lit(DAY), (F.col("id") % 6000).cast("int")).alias("day")
    )
    found = joins.best_rule_per_day(facts, rules, [("k", "rk")], [("s", "rs")], "day", ["pct"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.day: r.rule_id for r in found.collect()}
    # the newest valid rule starts on the day itself, and the lowest id of those is the day's number
    assert all(got[day(n)] == n for n in range(5000))
    assert got[day(5500)] is None and len(got) == 6000


@pytest.mark.parametrize("values", [[], [1, 2], [1, None], [None]])
def test_not_in(spark, values):
    rows = [(1, "a"), (3, "b"), (3, "b"), (None, "c")]
    df = spark.createDataFrame(rows, "k int, v string")
    others = spark.createDataFrame([(x,) for x in values], "x int")
    df.createOrReplaceTempView("left_rows")
    others.createOrReplaceTempView("right_values")
    wanted = spark.sql("SELECT * FROM left_rows WHERE k NOT IN (SELECT x FROM right_values)")
    found = joins.join_not_in(df, "k", others, "x")
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
