"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page becomes its leaf blocks in order. The field labels each of them as part
of the article or not, from features of its ancestors' tags and names, its text
and its place, and from its neighbours' labels; Viterbi finds the likeliest
labels of the whole page.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import crf, labelled_pages, pages
from tallyspark.llm.common import ship, slices

#: Labelled pages the field is fitted on at most.
MAX_LABELLED = 2_000


def labelled_table(spark: SparkSession) -> DataFrame:
    """The pages that come with the package: ``html`` and ``labels``, one 0 or 1 for each leaf block."""
    ship(spark)
    return spark.createDataFrame(labelled_pages.labelled_pages(), "html string, labels array<int>")


def fit(labelled: DataFrame) -> crf.Crf:
    """A field fitted on ``html`` and ``labels`` of at most ``MAX_LABELLED`` pages, those with the smallest hash.

    Rows without html or whose labels are not as many as their leaf blocks are left out.
    """
    rows = (
        labelled.where("html is not null and labels is not null")
        .select("html", "labels")
        .orderBy(F.xxhash64("html"), "html")
        .limit(MAX_LABELLED)
        .collect()
    )
    sequences, labels = [], []
    for row in rows:
        found = [[*sorted(path), *own] for path, own in pages.features(pages.blocks(row["html"]))]
        if len(found) == len(row["labels"]):
            sequences.append(found)
            labels.append([int(label) for label in row["labels"]])
    return crf.fit(sequences, labels)


class Extractor:
    """Main texts by a fitted field; scores of path features are kept per path."""

    def __init__(self, model: crf.Crf):
        self.model = model
        self.paths: dict[frozenset, list[float]] = {}

    def labels(self, found: list[pages.Block]) -> list[int]:
        scores = []
        for path, own in pages.features(found):
            known = self.paths.get(path)
            if known is None:
                if len(self.paths) >= pages.KEPT_PATHS:
                    self.paths.clear()
                known = self.paths[path] = self.model.score(sorted(path))
            scores.append([a + b for a, b in zip(known, self.model.score(own), strict=True)])
        return self.model.decode(scores)

    def text(self, html: str | None) -> str:
        found = pages.blocks(html or "")
        return "\n".join(b.text for b, label in zip(found, self.labels(found), strict=True) if label == 1)


def extract(df: DataFrame, model: crf.Crf, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` and ``text``: the article's blocks in page order, one to a line.

    Character references are decoded; white space of a block is one blank. Text
    of null or empty html, and of pages without an article, is empty. Every row
    gives one row; rows that repeat stay repeated.
    """
    ship(df.sparkSession)
    chosen = df.select(*keep, F.col(html).cast("string").alias("__html"))
    schema = T.StructType([*chosen.drop("__html").schema.fields, T.StructField("text", T.StringType())])

    def extracted(batches):
        extractor = Extractor(model)
        for batch in slices(batches, "__html"):
            texts = [extractor.text(page) for page in batch.column("__html").to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=schema.names)

    return chosen.mapInArrow(extracted, schema)
