"""One query per operator over the given tables, with the SQL that checks it where there is one."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (
    decontamination,
    fingerprints,
    html_text,
    language,
    lengths,
    near_duplicates,
    packing,
    periodic_runs,
    records,
    repeats,
    toxicity,
    urls,
    vector_codes,
)
from tallyspark.llm.common import remainder, table
from tallyspark.session import fresh_path, materialise


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 1024, 0)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(remainder("doc_id", 5) != 0))
    return language.identify(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.fit(urls.labelled_urls(spark))
    return urls.judge(table(spark, sf_dir, "pages"), model)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lengths.limits(materialise(lengths.histogram(lengths.encoded_lengths(docs)), "histogram"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 3) != 1))
    return toxicity.with_scores(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), 2, Fraction(4, 5))


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", 2)
    return records.read_records(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = repeats.mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return marked.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.fingerprints_of_edits(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = decontamination.mark(docs, table(spark, sf_dir, "benchmark"), 10, keep=["doc_id"])
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["words"])
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_text.fit(html_text.labelled_table(spark))
    return html_text.extract(table(spark, sf_dir, "pages"), model).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs, 6, 4)
    # the greatest length, then the smallest start and period
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.transform(lines, lambda line: F.concat(line, F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-longest["s"]).alias("start"),
        longest["length"].alias("length"),
        (-longest["p"]).alias("period"),
        F.floor(1000 * longest["length"] / -longest["p"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors, parts=16, entries=64, rounds=2, scale=256)
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, books, keep=("vec_id", "label")))
    return coded.select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(books.sha256()).alias("codebooks_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_language,
        op3_urls,
        op4_token_counts,
        op5_toxicity,
        op6_near_duplicates,
        op7_records,
        op8_repeats,
        op9_fingerprints,
        op10_decontamination,
        op11_html_text,
        op12_periodic_runs,
        op13_vector_codes,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Each part's nearest entry of a codebook: distance and index, ties to the lower index.
_NEAREST = """{a} AS MATERIALIZED (
  SELECT vec_id, part, min(d) AS d, arg_min(entry, d * 64 + entry) AS entry FROM (
    SELECT p.vec_id, p.part, b.entry,
      CAST(list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM p JOIN {b} b USING (part)) GROUP BY vec_id, part
)"""
#: A round: floored means of the parts of each entry; entries without parts stay.
_ROUND = (
    _NEAREST
    + """, {m} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
    SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (
      SELECT p.part, a.entry, unnest(p.c) AS x, unnest(range(len(p.c))) AS i FROM p JOIN {a} a USING (vec_id, part))
    GROUP BY part, entry, i) GROUP BY part, entry
), {n} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.c, b.c) AS c FROM {b} b LEFT JOIN {m} m USING (part, entry)
)"""
)

SQL = {
    "op6_near_duplicates": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN ws IS NULL OR len(ws) = 0 THEN []
    WHEN len(ws) = 1 THEN [ws[1]]
    ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
  SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u
), k AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT k.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, k.doc_id = component_id AS kept
FROM k LEFT JOIN n USING (doc_id)
""",
    "op10_decontamination": rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents
), b AS (
  SELECT item_id, ws, least(10, len(ws)) AS n FROM (
    SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
  ) WHERE len(ws) > 0
), g AS (
  SELECT DISTINCT item_id, n,
    unnest([array_to_string(ws[i:i + n - 1], ' ') FOR i IN range(1, len(ws) - n + 2)]) AS t FROM b
), x AS (
  SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS pos,
    unnest([array_to_string(ws[i:i + n - 1], ' ') FOR i IN range(1, len(ws) - n + 2)]) AS t
  FROM d, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n
), h AS (
  SELECT x.doc_id, x.pos, x.n, g.item_id FROM x JOIN g ON x.t = g.t AND x.n = g.n
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
""",
    "op13_vector_codes": f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS c
  FROM k, range(16) AS t(part)
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, c
  FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)
), {_ROUND.format(b="b0", a="a1", m="m1", n="b1")}, {_ROUND.format(b="b1", a="a2", m="m2", n="b2")},
{_NEAREST.format(b="b2", a="a3")}, s AS (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code,
    CAST(sum(d) AS BIGINT) AS error
  FROM a3 JOIN k USING (vec_id) GROUP BY vec_id
), h AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM s, h
""",
}
