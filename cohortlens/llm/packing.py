"""Best-fit packing of tokenised documents into sequences of a fixed length.

1. ``pieces``: every whole document's ids and an end id (the ids are stored only where ``sequences`` is to follow); a document longer than a sequence is
   cut into full pieces, of which the first takes what is left over. One row a piece.
2. ``assign``: a full piece is a sequence of its own. The others are dealt to tasks of about
   ``pieces_a_task`` pieces, longest first within a task, and packed online: at most ``max_open``
   bins are open, a bitset says which amounts of free space occur, the tightest bin that still
   fits takes the piece, and when a new bin is needed beyond ``max_open`` the fullest one is
   closed. A task holds its open bins and one batch of rows.
3. ``sequences``: the ids of each sequence, put together by offset.

Null text: an empty document (one piece, the end id). Rows that share a doc_id are separate
documents. An empty table: no row. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts_of
from .token_store import id_arrays

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, keep_ids: bool = True) -> DataFrame:
    """A stored table: row (unique number), doc_id, piece, start, length, ids_crc32 and, unless they are not to be
    kept, ids (binary, little-endian unsigned 32-bit)."""
    types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
    names = [c.split()[0] for c in PIECES.split(", ")]

    def cut(batches):
        for part, arrays in id_arrays(batches, tokenizer, end_id):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), arrays):
                data, n, begin = ids.astype("<u4").tobytes(), len(ids), 0
                end = n % capacity or capacity if n > capacity else n
                for piece in range(-(-n // capacity)):
                    body = data[4 * begin : 4 * end]
                    rows.append((doc_id, piece, begin, end - begin, zlib.crc32(body), body if keep_ids else None))
                    begin, end = end, end + capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    found = texts_of(docs).mapInArrow(cut, PIECES)
    found = found if keep_ids else found.drop("ids")
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "pieces")


class BestFit:
    """Online best-fit with a fixed number of open bins; ``bits`` has bit f set if an open bin has
    f free places. Bins of the same free space are taken in the order they got there."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.by_free: list[deque[int]] = [deque() for _ in range(capacity + 1)]
        self.bits = self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.popleft()
        if not bins:
            self.bits &= ~(1 << free)
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            at = self._take(free)
        else:
            if self.n_open >= self.max_open:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.n_open -= 1
            free, at = self.capacity, self.n_bins
            self.n_bins += 1
            self.n_open += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(at)
        else:
            self.n_open -= 1  # full
        return at, self.capacity - free


def assign(
    cut: DataFrame, capacity: int = 1024, max_open: int = 1 << 16, pieces_a_task: int = 500_000
) -> DataFrame:
    """The columns of ``cut`` but ids, with sequence_id and offset. Every piece has at most
    ``capacity`` ids and at least one."""
    plain = cut.drop("ids")
    full, part = plain.where(F.col("length") == capacity), plain.where(F.col("length") < capacity)
    tasks = max(1, -(-part.count() // pieces_a_task))
    schema = f"{', '.join(f'`{n}` {t}' for n, t in part.dtypes)}, sequence_id long, offset long"

    def pack(batches):
        bins, base = BestFit(capacity, max_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            if placed:
                at, offset = zip(*placed)
                columns = [*batch.columns, pa.array([base + i for i in at], pa.int64()), pa.array(offset, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sequence_id", "offset"])

    packed = part.repartition(tasks, F.xxhash64("row")).sortWithinPartitions(F.desc("length"), "row").mapInArrow(pack, schema)
    own = full.withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(own)


def sequences(cut: DataFrame, assigned: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids binary): at most ``capacity`` ids a row."""
    ids = cut.select("row", "ids").join(assigned.select("row", "sequence_id", "offset"), "row")
    parts = ids.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", joined.alias("ids")).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    placed = assign(pieces(docs, tokenizer, end_id, capacity, keep_ids=False), capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
