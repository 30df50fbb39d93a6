"""Token ids as files of length-delimited binary records with an offset index.

A record is: payload length (8 bytes), masked checksum of those 8 bytes (4),
payload, masked checksum of the payload (4), and the line feed that Spark's
text writer puts after each; integers are little-endian. The payload is a flag byte (bit 0: ids of 4 bytes instead of 2;
bit 1: the document id is null), the document id (8 bytes, signed) and the ids.
A masked checksum is crc32 rotated right by 15 bits plus a constant, so that a
checksum over data with embedded checksums stays sound.

Files hold documents in ascending id order, both inside a file and by file
name. Spark's own writer commits them, task by task, in any store that Spark
writes to. The index is a Parquet table (file, doc_id, offset, length,
n_tokens) beside the data.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, small_batches, texts
from tallyspark.llm.encoding import encoder

#: Documents of a file; a file is read as a whole.
DOCS_PER_FILE = 4096
MASK = 0xA282EAD8


class CorruptRecord(ValueError):
    """A record whose length or payload does not meet its checksum."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def unmasked(value: int) -> int:
    turned = (value - MASK) & 0xFFFFFFFF
    return ((turned >> 17) | (turned << 15)) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """A record but for its line feed."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flags = wide | (doc_id is None) << 1
    payload = struct.pack("<Bq", flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    parts = (length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)))
    return b"".join(parts)


def parse(data: bytes, offset: int) -> tuple[int | None, np.ndarray, int]:
    """Document id, ids and the offset of the next record."""
    if offset + 12 > len(data):
        raise CorruptRecord(f"cut short at {offset}")
    length, check = struct.unpack_from("<QI", data, offset)
    if masked(data[offset : offset + 8]) != check:
        raise CorruptRecord(f"length at {offset}")
    end = offset + 12 + length
    payload = data[offset + 12 : end]
    if end + 5 > len(data) or struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise CorruptRecord(f"payload at {offset}")
    flags, doc_id = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, "<u4" if flags & 1 else "<u2", offset=9)
    return None if flags & 2 else doc_id, ids, end + 5


def write_records(
    docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int | None = 2
) -> None:
    """Encode whole texts and write them below ``path`` with their index.

    ``doc_id`` is an integer; rows of one id are written one after another,
    null ids first. Null texts count as empty. An empty table gives an empty
    index. The number of files follows from the number of documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in slices(batches, "text"):
            frames = [
                frame(doc_id, np.frombuffer(packed + end, "<u4"))
                for doc_id, packed in zip(
                    batch.column("doc_id").to_pylist(), encode(texts(batch)), strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    files = max(1, -(-docs.count() // DOCS_PER_FILE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if files > 1:
        rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    else:
        rows = rows.coalesce(1).sortWithinPartitions("doc_id")
    frames = rows.mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(
        f"{path}/data"
    )
    _entries(spark, path, ids=False).drop("before").write.parquet(f"{path}/index")


def _entries(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Every record of the data files, in order, with place, checks done, and its ids unless told otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("file"), batch.column("content"), strict=True):
                yield from _records(file.as_py(), data.as_py(), ids)

    # names, not paths: a path may be given in several forms
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    files = spark.read.format("binaryFile").load(f"{path}/data/*").select(file, "content")
    schema = "file string, doc_id long, offset long, length long, n_tokens long, before long"
    return files.mapInArrow(run, f"{schema}, ids binary" if ids else schema)


def _records(file: str, data: bytes, with_ids: bool = True) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "offset", "length", "n_tokens", "before", *(["ids"] if with_ids else [])]
    types = [pa.int64()] * 5 + [pa.binary()] * with_ids
    rows: list[tuple] = []
    offset = before = held = 0

    def out() -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), *arrays], ["file", *names])

    while offset < len(data):
        doc_id, ids, following = parse(data, offset)
        row = (doc_id, offset, following - offset, len(ids), before)
        rows.append((*row, ids.astype("<u4").tobytes()) if with_ids else row)
        offset, before, held = following, before + len(ids), held + 4 * len(ids)
        if held > 1 << 22:
            yield out()
            rows, held = [], 0
    if rows:
        yield out()


def file_order(name: str) -> list[Column]:
    """Order of the data files: by part number, which has more than five digits in a large set."""
    return [F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.col(name)]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records: doc_id, start (ids of all records before), n_tokens, ids (unsigned 32-bit).

    Checksums are verified; a bad one raises ``CorruptRecord`` in the task.
    ``start`` adds the place in the file to the sum of the files before, of
    which there is one row per file: those are broadcast, so no ids are shuffled.
    """
    sums = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy(*file_order("file")).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return (
        _entries(spark, path)
        .join(F.broadcast(bases), "file")
        .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")
    )


def fetch_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records of some documents, in any order, through the index.

    ``wanted`` has ``doc_id``. Only files that hold one are read, and in them
    only the wanted records are parsed.
    """
    index = spark.read.parquet(f"{path}/index").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    places = index.groupBy("file").agg(F.collect_list("offset").alias("offsets"))
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    files = spark.read.format("binaryFile").load(f"{path}/data/*").select(file, "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets in zip(batch.column("content"), batch.column("offsets"), strict=True):
                content = data.as_py()
                found = [parse(content, offset)[:2] for offset in sorted(offsets.as_py())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _ in found], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for _, x in found], pa.binary()),
                    ],
                    ["doc_id", "ids"],
                )

    return files.join(places, "file").select("content", "offsets").mapInArrow(run, "doc_id long, ids binary")
