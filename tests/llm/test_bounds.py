"""What workers keep, and how small graphs are worked on."""

import random
import string

import pytest

from tallyspark.llm import components, encoding, records
from tallyspark.llm.common import BATCH_BYTES
from tallyspark.llm.wordhash import forgetting


def test_pieces_met_again_are_taken_over_from_the_older_generation(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_PIECES", 20)
    encoder, learned = encoding.Encoder("word_bpe_49k.json"), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda pieces: (learned.extend(pieces), learn(pieces)))
    texts = [" ".join(f"word{j}" for j in [1, 2, 3, *range(10 * i, 10 * i + 10)]) for i in range(30)]
    most = 0
    for text in texts:
        assert encoder.encode([text]) == encoder.direct([text])
        most = max(most, len(encoder.kept) + len(encoder.older))
    assert most <= 2 * (20 + 13)
    assert learned.count(" word2") == 1


def test_new_words_go_to_the_library_once_and_without_marks(monkeypatch):
    encoder, sent = encoding.Encoder("word_bpe_49k.json"), []
    plain = encoder.plain

    class Watched:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    monkeypatch.setattr(encoder, "plain", Watched())
    text = "- Tree TREE\ntree tree$$$ tree- House\thouse\u00e9 HOUSE&& house"
    found = encoder.encode([text, text])
    words = [x.split() for x in sent if encoder.mark not in x]
    assert [sorted(x) for x in words] == [["house", "house\u00e9", "tree"]]
    assert not any("tree" in x.lower() or "house" in x.lower() for x in sent if encoder.mark in x)
    assert found == encoding.Encoder("word_bpe_49k.json").direct([text, text])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_folded_and_cut_bytes_give_the_ids_of_the_library(name):
    encoder, dice = encoding.Encoder(name), random.Random(5)
    assert encoder.folds == name.startswith("word")
    signs = ["J", "j", "H", "\u030c", "\u0331", "I", "\u0307", "\u0130", "\u03a3", "\u212a", "\u00c9", "\u00d7"]
    signs += ["\u00f7", "Ab", "foo", "'S", "<|", "|>", "<|EndOfText|>", "<|endoftext|>", "\u0338", "7", "\x00", "\x1d", "\x7f"]
    signs += [*string.punctuation, *"  \t\n" * 5, "\r", "\x85", "\u00a0", "\u1680", "\u2028", "\u205f", "\u3000"]
    signs += ["\u2019", "\u6f22", "\U0001f642"]
    texts = ["".join(dice.choices(signs, k=dice.randrange(30))) for _ in range(2000)]
    texts = ["", *texts, "", "J", "\u030c", "a", " "]
    for first in range(0, len(texts), 401):
        part = texts[first : first + 401]
        assert encoder.encode(part) == encoder.direct(part)
    assert encoder.encode([]) == [] and encoder.encode(["", ""]) == [b"", b""]


def test_other_work_empties_what_encoders_left():
    encoding._ENCODERS["left"] = None
    assert list(forgetting(lambda batches: batches)(iter([1]))) == [1]
    assert not encoding._ENCODERS


def test_records_are_encoded_from_small_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    rows = [(i, None if i % 7 == 0 else f"text {i} " * 9000) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    records.write_records(docs, str(tmp_path / "r"))
    assert int(spark.conf.get(name)) == BATCH_BYTES <= 2 << 20
    read = records.read_records(spark, str(tmp_path / "r")).collect()
    plain = encoding.Encoder("word_bpe_49k.json").plain
    want = {i: plain.encode(text or "", add_special_tokens=False).ids + [2] for i, text in rows}
    assert {r.doc_id: r.n_tokens for r in read} == {i: len(ids) for i, ids in want.items()}


def test_reading_records_shuffles_no_ids(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records.write_records(docs, str(tmp_path / "r"))
        read = records.read_records(spark, str(tmp_path / "r"))
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "ids" not in spark.read.parquet(str(tmp_path / "r" / "index")).columns
    assert read.count() == 30


def test_a_small_graph_is_not_shuffled(spark, monkeypatch):
    pick = random.Random(3)
    pairs = [(pick.randrange(400), pick.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    edges = spark.createDataFrame([*pairs, pairs[0], (None, 4)], "u long, v long").repartition(5)
    kept = components.materialise(edges.where("u is not null and u > v"), "edges")
    for large in (True, False):
        plan = components._star(kept, large, True)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
    few = {tuple(r) for r in components.components(edges).collect()}
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    assert few == {tuple(r) for r in components.components(edges).collect()}
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    linked = {n for u, v in pairs if u != v for n in (u, v)}
    assert few == {(n, label[n]) for n in linked}
