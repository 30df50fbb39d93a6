"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a rest. The rests of some
hundred documents of one task are divided into near-equal windows: every rest
begins as a partial partition of its own, and the two partitions with the
largest difference between their fullest and emptiest window are merged,
fullest with emptiest, until one is left. The window count is what fills them
to the brim; where a window exceeds its capacity, the excess is cut off and
fills windows that lack some, and what no window takes raises the count: it
goes on into the next division. The last rest of a task is cut into powers of
two, which need no padding.

Nothing is shuffled: tasks pack what they read, and at most one unfinished
window is held between divisions. Ids of sequences are the task's number and
a count, so they do not depend on other tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyspark.llm.common import slices, texts
from tallyspark.llm.encoding import encoder

#: Rests divided together, and ids held at most before they are.
GROUP_RESTS = 512
GROUP_IDS = 4_000_000
SCHEMA = "doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Divide items into at most ``windows`` subsets of near-equal sums.

    A partial partition is a list of (sum, items), fullest first, its empty
    subsets left out.
    """
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    ties = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        empty = windows - len(b)
        with_b, b = a[empty:], b[::-1]
        merged = a[:empty]
        merged += [(s + t, x + y) for (s, x), (t, y) in zip(with_b, b, strict=False)]
        merged += b[len(with_b) :]
        merged.sort(key=lambda subset: -subset[0])
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[0][0], ties, merged))
        ties += 1
    return [items for _, items in heap[0][2]] if heap else []


class Packer:
    """Pieces of documents into windows of one task.

    A piece is (document, start, length); ``closed`` receives each finished
    window as a list of pieces.
    """

    def __init__(self, capacity: int, closed):
        self.capacity, self.closed = capacity, closed
        self.rests: list[tuple] = []

    def add(self, document, total: int) -> None:
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            self.closed([(document, start, self.capacity)])
        if total > whole:
            self.rests.append((document, whole, total - whole))

    def divide(self) -> None:
        """Fill windows from the rests; less than one window is left over."""
        total = sum(piece[2] for piece in self.rests)
        windows = total // self.capacity
        if not windows:
            return
        excess: list[tuple] = []
        short: list[tuple[int, list[tuple]]] = []
        for items in differencing([piece[2] for piece in self.rests], windows):
            window, room = [], self.capacity
            for document, start, length in sorted((self.rests[i] for i in items), key=lambda p: -p[2]):
                taken = min(room, length)
                if taken:
                    window.append((document, start, taken))
                    room -= taken
                if length > taken:
                    excess.append((document, start + taken, length - taken))
            if room:
                short.append((room, window))
            else:
                self.closed(window)
        excess.sort(key=lambda p: -p[2])
        for room, window in sorted(short, key=lambda x: -x[0]):
            while room:
                document, start, length = excess.pop()
                taken = min(room, length)
                window.append((document, start, taken))
                room -= taken
                if length > taken:
                    excess.append((document, start + taken, length - taken))
            self.closed(window)
        self.rests = excess

    def finish(self) -> None:
        """Close what is left as windows whose sizes are powers of two."""
        self.divide()
        left = sum(piece[2] for piece in self.rests)
        pieces = self.rests[::-1]
        while left:
            room, window = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                document, start, length = pieces.pop()
                taken = min(room, length)
                window.append((document, start, taken))
                room -= taken
                if length > taken:
                    pieces.append((document, start + taken, length - taken))
            self.closed(window)
        self.rests = []


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    capacity: int = 1024,
    end_id: int | None = 0,
) -> DataFrame:
    """Pack the ids of whole texts; one row per piece with its ids.

    Columns: doc_id, start (ids of the document before the piece), length, ids
    (packed little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    ``end_id`` is appended to every document. Null and empty texts hold just
    that id, and with ``end_id`` None they have no piece. Repeated rows are
    packed each on its own. Other columns are not looked at. An empty table
    gives no rows.
    """
    kind = docs.schema["doc_id"].dataType
    schema = SCHEMA.format(kind=kind.simpleString())
    arrow = pa.schema(
        [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
        + [(name, pa.int64()) for name in ("doc_tokens", "sequence_id", "offset")]
    )
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        ids: dict[int, tuple] = {}
        rows: list[tuple] = []
        next_sequence = TaskContext.get().partitionId() << 33
        number = 0

        def closed(window: list[tuple]) -> None:
            nonlocal next_sequence
            offset = 0
            for document, start, length in window:
                doc_id, packed = ids[document]
                piece = packed[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, length, piece, len(packed) // 4, next_sequence, offset))
                offset += length
            next_sequence += 1

        def out() -> Iterator[pa.RecordBatch]:
            for first in range(0, len(rows), 8192):
                columns = list(zip(*rows[first : first + 8192], strict=True))
                arrays = [pa.array(columns[0], doc_type)]
                arrays += [pa.array(c, f.type) for c, f in zip(columns[1:], arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *arrow.names])
            rows.clear()

        packer, held, doc_type = Packer(capacity, closed), 0, None
        for batch in slices(batches, "text"):
            doc_type = batch.schema.field("doc_id").type
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), encode(texts(batch)), strict=True):
                packed += end
                ids[number] = (doc_id, packed)
                packer.add(number, len(packed) // 4)
                number += 1
                held += len(packed) // 4
            if len(packer.rests) >= GROUP_RESTS or held >= GROUP_IDS:
                packer.divide()
                ids = {d: ids[d] for d in {piece[0] for piece in packer.rests}}
                held = sum(len(packed) // 4 for _, packed in ids.values())
                yield from out()
        packer.finish()
        yield from out()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
