"""Committed versions, tables changed in place, levels of long chains."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import graph
from tallyspark.operators.levels import spread
from tallyspark.sources import files
from tallyspark.sources.keyed import KeyedTable


def values(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def broken(spark):
    return spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))


def test_commit_shows_whole_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    first = files.commit(spark.range(3), path)
    assert values(files.read_committed(spark, path), "id") == [(0,), (1,), (2,)]
    reader = files.read_committed(spark, path)
    second = files.commit(spark.range(5, 7).repartition(2), path)
    assert values(files.read_committed(spark, path), "id") == [(5,), (6,)]
    assert values(reader, "id") == [(0,), (1,), (2,)]
    assert values(files.read_committed(spark, path, first), "id") == [(0,), (1,), (2,)]
    with pytest.raises(Exception, match="no"):
        files.commit(broken(spark), path)
    assert values(files.read_committed(spark, path), "id") == [(5,), (6,)]
    assert sorted(os.listdir(f"{path}/data")) == sorted([first, second])
    # a file that a lost task left behind is not read
    spark.range(100, 101).write.mode("append").parquet(f"{path}/data/{second}")
    assert values(files.read_committed(spark, path), "id") == [(5,), (6,)]


def test_failing_writes_leave_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="no"):
        files.publish(broken(spark), str(tmp_path / "u"))
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="no"):
        files.commit(broken(spark), str(tmp_path / "v"))
    assert os.listdir(tmp_path / "v" / "data") == [] if (tmp_path / "v" / "data").exists() else True
    with pytest.raises(FileNotFoundError):
        files.read_committed(spark, str(tmp_path / "v"))


def contents(path):
    return {name: os.stat(name).st_mtime_ns for name in glob.glob(f"{path}/__part=*/*.parquet")}


def test_a_merge_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, ["id"], parts=16)
    table.create(spark.range(200).select("id", F.lit("old").alias("v")))
    before = contents(path)
    source = spark.createDataFrame([(3, "new"), (500, "more"), (None, "none")], "id bigint, v string")
    assert tuple(table.merge(source).first()) == (2, 1)
    rows = dict(values(table.read().where("id is not null"), "id", "v"))
    assert len(rows) == 201 and rows[3] == "new" and rows[500] == "more" and rows[4] == "old"
    assert table.read().where("id is null").count() == 1
    after = contents(path)
    kept = {name for name in before if after.get(name) == before[name]}
    folders = {os.path.dirname(name) for name in before}
    assert len({os.path.dirname(name) for name in kept}) >= len(folders) - 3 >= 10
    # the same merge again changes no rows; the row without key is added once more
    assert tuple(table.merge(source).first()) == (1, 2)
    assert table.read().where("id is not null").count() == 201


def test_an_update_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, ["id"], parts=16)
    table.create(spark.range(200).select("id", F.lit("old").alias("v")))
    before = contents(path)
    assert table.update(F.col("id") == 7, v=F.lit("new")).first()[0] == 1
    assert values(table.read().where("v = 'new'"), "id") == [(7,)] and table.read().count() == 200
    after = contents(path)
    assert len({os.path.dirname(n) for n in before if after.get(n) != before[n]}) == 1
    assert table.update(F.col("id") < 0, v=F.lit("new")).first()[0] == 0
    assert contents(path) == after
    with pytest.raises(ValueError):
        table.update(F.col("id") == 7, id=F.lit(8))


def test_long_chains_take_few_rounds(spark, monkeypatch):
    writes = []
    monkeypatch.setattr(graph, "materialise", lambda df, label: writes.append(label) or materialise(df, label))
    from tallyspark.session import materialise

    chain = [(f"n{i}", f"n{i + 1}") for i in range(1100)]
    more = [("top", "n0"), ("top", "n500"), ("loop1", "loop2"), ("loop2", "loop1"), ("behind", "loop1"), ("mixed", "loop1"), ("mixed", "n3")]
    edges = spark.createDataFrame([*chain, *more, ("alone", None)], "node string, depends_on string")
    found = dict(values(graph.dependency_levels(edges), "node", "level"))
    assert all(found[f"n{i}"] == 1100 - i for i in range(1101))
    assert found["top"] == 1101 and found["alone"] == 0
    assert [found[n] for n in ("loop1", "loop2", "behind", "mixed")] == [None] * 4
    assert len(found) == 1101 + 6 and len(writes) < 20


def test_cycles_are_named_by_component(spark):
    ring = [(f"r{i:02d}", f"r{(i + 1) % 40:02d}") for i in range(40)]
    more = [("x", "y"), ("y", "x"), ("behind", "x"), ("free", "end"), ("self", "self"), ("r05", "end")]
    edges = spark.createDataFrame([*ring, *more], "node string, depends_on string")
    found = dict(values(graph.cycle_components(edges), "node", "component"))
    assert {found[f"r{i:02d}"] for i in range(40)} == {"r00"}
    assert {n: c for n, c in found.items() if n[0] != "r"} == {"x": "behind", "y": "behind", "behind": "behind", "self": "self"}


def test_spread_keeps_sums(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], 5), (2, [], 7), (3, None, 1)], "k int, s array<string>, n int")
    assert sorted(map(tuple, spread(rows, "s", "m", ["n"]).collect()), key=str) == [
        (1, "a", 5), (1, "b", None), (2, None, 7), (3, None, 1),
    ]
