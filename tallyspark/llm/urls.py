"""URL filtering: rules on hosts and paths, and logistic regression for the rest.

The model reads hashed character n-grams of host and path. It is fitted on a
small labelled table of URLs, at most ``MAX_LABELLED`` rows of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most labelled rows the model is fitted on; those with the smallest hash are taken.
MAX_LABELLED = 20_000
BITS = 14
SIZES = (3, 4, 5)


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Words of hosts that nobody wants in a corpus, and of hosts that are fine.
UNWANTED = (
    "casino poker slots roulette betting bets jackpot lottery pills pharmacy viagra meds adult xxx porn cams escort "
    "spam spammer seo backlinks farm ads adserver adclick banner tracker tracking track popunder payday loans cheap "
    "discount replica warez crack torrent malware phishing clickbait free win bonus deals coupon"
).split()
WANTED = (
    "library university museum school garden kitchen recipes weather history science travel music theater nation "
    "winter address orchard city council hospital sport football news daily times journal review research physics "
    "chemistry maps bridge river mountain village art photo film book poem story language grammar letters math "
    "ocean forest station market bakery church festival painting cooking reading writing running building training "
    "wedding knitting sailing thing nothing something other brother mother together leather there these those third "
    "thirteen thunder theory therapy north south earth health youth truth method author tradition education "
    "information question region action motion version season reason person lesson shelter water winter center letter "
    "teacher river paper summer number order border corner dinner farmer father sister doctor editor mirror error "
    "answer ancient silent student parent moment planet cabinet internet sonnet tennis finish english spanish danish "
    "fresh ship shore shape share island inland onion union opinion thread throne three tree street sweet green queen "
    "onward inner under handle candle table cable stable bible noble double trouble humble rest nest forest west "
    "harvest interest best honest artist dentist list mist almost post host cost coast east feast beast yeast"
).split()
_ENDS = ("example.com", "example.net", "example.org")
_PATHS = ("/en/12", "/de/8/", "/fr/532.html", "/", "/es/77", "/en/401?page=2", "/index.html")


def labelled() -> list[tuple[str, int]]:
    """URLs with 1 for unwanted and 0 for wanted, composed alike for both: each word alone, with a prefix, and in pairs."""
    rows = []
    for words, label in ((UNWANTED, 1), (WANTED, 0)):
        for i, word in enumerate(words):
            other, third = words[(i + 4) % len(words)], words[(3 * i + 11) % len(words)]
            for j, name in enumerate((word, f"www.{word}", f"blog.{word}", f"m.{word}", f"{word}{other}", f"{third}.{word}")):
                rows.append((f"http{'s' * (j % 2)}://{name}.{_ENDS[(i + j) % 3]}{_PATHS[(i + 2 * j) % 7]}", label))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled(), "url string, label int")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and where there is no ``://``.

    The host ends at the first ``/``, ``?`` or ``#``, its A-Z lower-cased; the
    path goes from there to ``?``, ``#`` or the end.
    """
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.host + rule.path).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def features(host: str, path: str) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of host and path."""
    found = set()
    for sign, value in ((b"h", host), (b"p", path)):
        data = b"^" + value.encode("utf-8", "replace") + b"$"
        for n in SIZES:
            for i in range(len(data) - n + 1):
                found.add(zlib.crc32(sign + data[i : i + n]) >> (32 - BITS))
    return np.array(sorted(found), dtype=np.int64)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        x = features(host, path)
        margin = self.bias + float(self.weights[x].sum()) / max(1.0, len(x)) ** 0.5
        return float(1 / (1 + np.exp(-margin)))


def fit(labelled: DataFrame, rounds: int = 400, rate: float = 20.0, ridge: float = 1e-4) -> UrlModel:
    """Logistic regression by gradient descent, both classes weighing the same.

    Rows without a label are left out; of more than ``MAX_LABELLED`` rows those
    with the smallest hash are taken. Without rows every score is a half.
    """
    host, path = parts(F.col("url"))
    rows = (
        labelled.where(F.col("label").isNotNull())
        .select(host.alias("host"), path.alias("path"), "label")
        .orderBy(F.xxhash64("host", "path", "label"))
        .limit(MAX_LABELLED)
        .collect()
    )
    x = [features(r.host, r.path) for r in rows]
    y = np.array([r.label for r in rows], dtype=float)
    model = UrlModel(np.zeros(1 << BITS), 0.0)
    if not rows:
        return model
    owner = np.repeat(np.arange(len(x)), [len(v) for v in x])
    index = np.concatenate(x)
    value = 1 / np.sqrt(np.array([max(1, len(v)) for v in x], dtype=float))[owner]
    classes = [max(1, int((y == c).sum())) for c in (0, 1)]
    share = np.where(y == 1, 0.5 / classes[1], 0.5 / classes[0])
    weights, bias = model.weights, 0.0
    for _ in range(rounds):
        margin = bias + np.bincount(owner, weights[index] * value, len(x))
        error = (1 / (1 + np.exp(-margin)) - y) * share
        gradient = np.bincount(index, error[owner] * value, 1 << BITS)
        weights = weights - rate * (gradient + ridge * weights)
        bias -= rate / 40 * error.sum()
    return UrlModel(weights, bias)


def judge(
    pages: DataFrame, model: UrlModel, rules: Sequence[Rule] = RULES, threshold: float = 0.5
) -> DataFrame:
    """Judge every URL: page_id, host, path, rule, verdict, score.

    The longest fitting rule decides, and where none fits the model: block at
    or above ``threshold``. A null or malformed URL has an empty host and path
    and is scored like any other. Rows are kept as they are, repeated ones too.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            scores = pa.array([model.score(h, p) for h, p in pairs], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    kind = rows.schema["page_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"page_id {kind}, host string, path string, score double")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, by_model).alias("verdict"),
        "score",
    )
