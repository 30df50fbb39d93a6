"""Queries against their SQL, and the pipeline against its parts in plain Python."""

import pytest
import test_operators as plain
from compare import connect, difference

import corpus_pipeline
from pyspark.sql import functions as F
from tallyspark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_matches_sql(spark, name, sf):
    where = DATA.replace("0.001", sf)
    found, sql = queries.QUERIES[name](spark, where), queries.SQL[name]
    for column, kind in found.dtypes:  # the comparison knows no booleans
        if kind == "boolean":
            found = found.withColumn(column, found[column].cast("long"))
            sql = f"SELECT * REPLACE (CAST({column} AS BIGINT) AS {column}) FROM ({sql})"
    assert difference(found, sql, connect(where)) is None


def test_pipeline_stages(spark):
    """Each stage against the plain version of its operator, on what the stage before kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DATA).cache()
        kept[name] = docs
        pairs = [(r.doc_id, r.text) for r in before.collect()]
        if name != "packing":
            assert docs.columns == columns
        got = sorted((r.doc_id, r.text) for r in docs.collect()) if name != "packing" else None
        if name == "toxicity":
            labels = spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0")
            assert docs.count() < before.count()
            assert before.join(labels, "doc_id").count() - docs.join(labels, "doc_id").count() <= 3
        elif name == "near_duplicates":
            root = plain.plain_components(pairs, 5, 80)
            assert got == sorted((d, t) for d, t in pairs if root[d][1] == d)
        elif name == "repeats":
            assert got == sorted((d, k.decode("utf-8", "ignore")) for d, _, k in plain.plain_repeats(pairs, 200))
            assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
        elif name == "decontamination":
            bench = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
            clean = {d for d, _, n, _ in plain.plain_hits(pairs, [(b.item_id, b.text) for b in bench], 10) if not n}
            assert got == sorted((d, t) for d, t in pairs if d in clean)
        else:
            plain.check_packed(docs, pairs, 1024)
    whole = corpus_pipeline.run(spark, DATA)
    assert whole.agg(F.sum("length")).first() == kept["packing"].agg(F.sum("length")).first()
