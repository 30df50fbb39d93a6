"""Runs, longest run and collapsed text against a search of every period in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tallyspark.llm import periodic_runs, queries
from tallyspark.llm.common import ship

DATA = "/root/testdata/sf0.001"
ROWS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("runs", T.StringType()),
        T.StructField("__key", T.StringType()),
        T.StructField("period", T.StringType()),
    ]
)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words, least=6, periods=4):
    """(start, length, period) by start, then period."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.array([numbers[w] for w in words], np.int64)
    found, seen = [], set()
    for q in range(1, len(codes) // periods + 1):
        same = np.concatenate([[False], codes[:-q] == codes[q:], [False]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(same)).reshape(-1, 2)
        for first, last in edges.tolist():
            length = last - first + q
            if length >= max(least, periods * q) and (first, length) not in seen:
                seen.add((first, length))
                found.append((first, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def planted(doc_id, text):
    words = split(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def check(spark, pairs, **options):
    frame = spark.createDataFrame([(i, t, "mine", "mine", "mine") for i, t in pairs], ROWS).repartition(3)
    got = periodic_runs.periodic_runs(frame, **options).collect()
    rows = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr)
    wanted = []
    for i, t in pairs:
        words = split(t)
        runs = plain_runs(words, options.get("min_length", 6), options.get("min_periods", 4))
        wanted.append((i, len(words), runs, collapse(words, runs)))
    assert rows == sorted(wanted, key=repr)


def test_runs_in_random_texts(spark):
    rng = random.Random(5)
    pairs = []
    for i in range(400):
        letters = "ab" if i % 3 else "abcdefgh"
        words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(words))
            words[at:at] = (unit * 12)[: rng.randint(1, 12 * len(unit))]
        pairs.append((i, " ".join(words)))
    check(spark, pairs)
    check(spark, pairs[:100], min_length=9, min_periods=5)


def test_edge_rows(spark):
    pairs = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, "x x x x x"),
        (5, "x x x x x x"),
        (5, "x x x x x x"),
        (None, "a b c a b\tc a b\r\nc  a b c"),
        (None, "no run at all"),
        (-3, "A a A a A a A a"),
        (7, "\x1c \x1c \x1c \x1c \x1c \x1c end"),
    ]
    check(spark, pairs)
    check(spark, [])


def test_long_texts_and_runs_over_many_tiles(spark, monkeypatch):
    rng = random.Random(9)
    noise = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    unit = [f"u{i}" for i in range(1500)]
    long = noise[:7001] + (unit * 9)[:11_003] + noise[7001:9000] + ["z"] * 9_001 + noise[9000:]
    pairs = [
        (1, " ".join(long)),
        (2, " ".join(["same"] * 20_000)),
        (3, " ".join((noise[:5000] * 5)[:20_003])),
        (4, " ".join((["a", "b"] * 9 + ["c"]) * 400)),
    ]
    check(spark, pairs)


@pytest.mark.parametrize("tile, boundaries", [(1, 1), (16, 2), (64, 8)])
def test_tiles_of_any_size(monkeypatch, tile, boundaries):
    monkeypatch.setattr(periodic_runs, "TILE_WORDS", tile)
    monkeypatch.setattr(periodic_runs, "TILE_BOUNDARIES", boundaries)
    rng = random.Random(tile)
    for _ in range(150):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 25))]
        words += (unit * 9)[: rng.randint(0, 9 * len(unit))] + [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        _, codes, starts, sizes = periodic_runs._numbered(pa.array([" ".join(words), "other a a"]))
        intervals = []
        for doc, octave, first, last in periodic_runs.promising_tiles(codes, starts, sizes):
            low = max(0, first - (periodic_runs.BACK << octave))
            high = min(int(sizes[doc]), last + (periodic_runs.AHEAD << octave))
            part = codes[starts[doc] + low : starts[doc] + high]
            found = periodic_runs.solve_tile(part, low, int(sizes[doc]), octave, first, last)
            intervals += [x for x in found if doc == 0]
        runs = set()
        for period in {p for p, _, _ in intervals}:
            joined = []
            for first, last in sorted((f, e) for p, f, e in intervals if p == period):
                if joined and first <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], last)
                else:
                    joined.append([first, last])
            runs |= {(f, e - f + period, period) for f, e in joined if e - f + period >= max(6, 4 * period)}
        assert sorted(runs, key=lambda r: (r[0], r[2])) == plain_runs(words)


def test_words():
    texts = [None, "", "  ", "a", " a  b\tc\x0b\x0c\r\nd ", "\x1c x\u00a0y \x85", "a b a"]
    joined, codes, starts, sizes = periodic_runs._numbered(pa.array(texts))
    assert joined.to_pylist() == [" ".join(split(t)) for t in texts]
    assert sizes.tolist() == [len(split(t)) for t in texts]
    every = [codes[s : s + n].tolist() for s, n in zip(starts.tolist(), sizes.tolist())]
    names = [w for t in texts for w in split(t)]
    flat = [x for part in every for x in part]
    assert len(set(zip(names, flat))) == len(set(names)) == len(set(flat))
    ends = codes[starts + sizes].tolist()
    assert len(set(ends)) == len(texts) and not set(ends) & set(flat)


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice([0, 1]) for _ in range(rng.randint(0, 20))]
        z = periodic_runs.z_function(s)
        assert periodic_runs.z_function(s, 5) == z[:5]
        for i in range(1, len(s)):
            assert s[i : i + z[i]] == s[: z[i]]
            assert i + z[i] == len(s) or s[z[i]] != s[i + z[i]]


def test_query_equals_the_plain_search(spark):
    ship(spark)
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = planted(doc_id, text)
        runs = plain_runs(words)
        row = got[doc_id]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (len(runs), *best, milli)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
        some += bool(runs)
    assert some >= 10
