"""Codes, errors and codebooks against a full search in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyspark.llm import queries, vector_codes
from tallyspark.llm.common import ship

ROWS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("__v", T.StringType()),
    ]
)


def plain(rows, parts, size, rounds):
    kept = [
        (i, [math.floor(256 * x) for x in v], label)
        for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return [], []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(v[p]) for v in cut[:size]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in cut:
                members.setdefault(nearest(p, v[p])[1], []).append(v[p])
            for j, xs in members.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = []
    for (i, _, label), v in zip(kept, cut, strict=True):
        best = [nearest(p, v[p]) for p in range(parts)]
        found.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), label))
    return found, books


def compare(spark, rows, parts=4, size=8, rounds=2):
    frame = spark.createDataFrame([(i, v, label, "mine", "mine") for i, v, label in rows], ROWS).repartition(3)
    books = vector_codes.fit(frame, parts, size, rounds, 256)
    coded = vector_codes.with_label_error(vector_codes.encode(frame, books, keep=("vec_id", "label")))
    got = [(r.vec_id, r.code.hex(), r.error, r.label, r.label_error) for r in coded.collect()]
    wanted, tables = plain(rows, parts, size, rounds)
    totals = {}
    for _, _, error, label in wanted:
        totals[label] = totals.get(label, 0) + error
    assert sorted(got, key=repr) == sorted([(*r, totals[r[3]]) for r in wanted], key=repr)
    flat = ",".join(str(x) for table in tables for entry in table for x in entry)
    assert books.sha256() == hashlib.sha256(flat.encode()).hexdigest()


def test_codes_equal_a_full_search(spark):
    rng = random.Random(3)
    rows = [
        (i, [rng.gauss((i % 3) * 0.3, 0.2) for _ in range(12)], rng.choice([None, 1, 2])) for i in rng.sample(range(999), 200)
    ]
    rows = [(i, np.array(v, np.float32).tolist(), label) for i, v, label in rows]
    compare(spark, rows)
    # few distinct vectors: many ties between equal entries
    compare(spark, [(i, [float(i % 2)] * 8, 7) for i in range(30)], parts=2, size=5)


def test_edge_rows(spark):
    good = [0.5, -0.25, 1.0, 2.0, -3.5, 0.0, 0.125, 9.0]
    rows = [
        (1, None, 1),
        (2, [], 1),
        (3, [*good[:7], None], 1),
        (4, [*good[:7], float("nan")], 2),
        (5, [*good[:7], float("-inf")], 2),
        (None, good, None),
        (6, good, None),
        (6, good, None),
        (6, good[::-1], 3),
        (-9, [0.0] * 8, 3),
    ]
    compare(spark, rows)
    compare(spark, rows[:5])
    compare(spark, [])


def test_vectors_that_do_not_fit_are_left_out(spark):
    rows = [(1, [0.0] * 8, 1), (2, [1.0] * 4, 1), (3, [1.0] * 6, 1), (4, [1e30] + [0.0] * 7, 1), (5, [1.0] * 8, 1)]
    frame = spark.createDataFrame([(*r, "", "") for r in rows], ROWS)
    books = vector_codes.fit(frame, 4, 8, 2)
    assert {r.vec_id for r in vector_codes.encode(frame, books).collect()} == {1, 5}
    with pytest.raises(ValueError):
        vector_codes.encode(frame, vector_codes.Codebooks(np.zeros((1, 257, 1), np.int64), 1))


@pytest.mark.parametrize("width, spread", [(1, 5), (2, 40), (4, 300), (7, 1 << 20)])
def test_cells_keep_every_nearest_entry(width, spread):
    rng = np.random.default_rng(width)
    entries = rng.integers(-spread, spread, (64, width))
    vectors = rng.integers(-2 * spread, 2 * spread, (3000, width))
    search = vector_codes.CellSearch(entries, most_cells=500)
    distance = ((vectors[:, None] - entries[None]) ** 2).sum(2)
    for part in np.array_split(vectors, 7):
        index, least = search.nearest(part)
        full = ((part[:, None] - entries[None]) ** 2).sum(2)
        assert (index == full.argmin(1)).all() and (least == full.min(1)).all()
        assert len(search.cells) <= 500 or len(part) > 400
    assert distance.shape == (3000, 64)


def test_query_equals_a_full_search(spark):
    ship(spark)
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    wanted, books = plain(rows, 16, 64, 2)
    totals = {}
    for _, _, error, label in wanted:
        totals[label] = totals.get(label, 0) + error
    flat = hashlib.sha256(",".join(str(x) for t in books for e in t for x in e).encode()).hexdigest()
    got = {tuple(r) for r in queries.op13_vector_codes(spark, folder).collect()}
    assert got == {(i, code, error, totals[label], flat) for i, code, error, label in wanted}
