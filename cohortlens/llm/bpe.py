"""Byte-level BPE of a corpus by one global shuffle of distinct words.

1. ``split``: blocks of about ``BLOCK_BYTES`` of text. The matches of the pattern ("words") are
   numbered within the block, most frequent first; the block keeps, for each document, its words'
   numbers in order of position. The distinct words of the block are dealt to buckets by a hash.
   One row for the positions of a block, one for each (block, bucket).
2. ``encode_words``: shuffle by bucket. Each block brings a word once, however frequent it is, so
   a common word is one entry a block. Each distinct word of a bucket is merged once, by rank; its
   ids go back to every block that has it.
3. ``assemble``: shuffle by block. Ids of the block's words joined to the positions.

``decode`` joins ids with the token-byte table (as many rows as the vocabulary, whatever the input).

Null text: no token. Null doc_id is kept. Rows that share a doc_id are separate documents. An
empty table: no row. Other columns are left out.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, parts_for, texts_of
from .units import UnitMemo, gather, matches_of, unit_of

BLOCK_BYTES = 8 << 20
SLICE_BYTES = 4 << 20
TASK_BYTES = 64 << 20
FEWEST_BUCKETS, MOST_BUCKETS, BUCKET_BYTES = 256, 4096, 256 << 20
KNOWN_WORDS = 200_000
BACK = "bucket int, block long, doc_ids array<long>, counts array<long>, payload binary"
LAST = 1 << 30  # "bucket" of a block's positions: they follow its words


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of the lowest rank is joined first, the leftmost of
    equals, until no pair is a token. A heap of pairs, so long words take n log n steps."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
    alive = bytearray(b"\1" * n)
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop or not alive[j]:
            continue
        alive[j] = 0
        end[i] = stop
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0 and (r := get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = after[i]
    return ids


def _pack(values: np.ndarray) -> bytes:
    """Numbers as four byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def split(docs: DataFrame, buckets: int, positions: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """With ``positions``, a row a block: its documents, the bucket of each of its words, and the word number
    at each position. Else a row for each (block, bucket): its distinct words. A block is named by a hash of
    what it holds."""

    def blocks(batches):
        name = xxhash.xxh3_64()
        words: dict[str, int] = {}
        held: list[tuple] = []
        size = 0

        def expand(keys):
            return [array("I", [words.setdefault(w, len(words)) for w in matches_of(unit_of(k))]).tobytes() for k in keys]

        def rows():
            stream = np.concatenate([v for _, v, _ in held])
            order = np.argsort(-np.bincount(stream, minlength=len(words)), kind="stable")
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            listed = list(words)
            texts = [listed[i].encode() for i in order.tolist()]
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in texts), np.uint32, len(texts))
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            block = name.intdigest() - (1 << 63)
            if positions:
                ids, counts = [i for x, _, _ in held for i in x], np.concatenate([c for _, _, c in held]).tolist()
                yield _row(BACK, LAST, block, ids, counts, _join(_pack(bucket), _pack(number[stream])))
                return
            squeeze = zstandard.ZstdCompressor(level=3)
            for b in np.unique(bucket).tolist():
                data = squeeze.compress(b"\xff".join(texts[i] for i in by[edges[b] : edges[b + 1]].tolist()))
                yield _row(BACK, b, block, None, None, data)

        memo = None
        for part in gathered(batches, "text", min(SLICE_BYTES, block_bytes)):
            memo = memo or UnitMemo(expand, 100_000)
            values, counts = memo.run(part.column("text"))
            ids = part.column("doc_id").to_pylist()
            held.append((ids, values, counts))
            name.update(repr((ids, counts.tolist())).encode())
            name.update(values)
            name.update("".join(words).encode())
            size += part.column("text").nbytes
            if size >= block_bytes:
                yield from rows()
                name.reset()
                words.clear()
                held.clear()
                memo, size = None, 0
        if held:
            yield from rows()

    return texts_of(docs).mapInArrow(blocks, BACK)


def _row(schema: str, *values) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    types = {"int": pa.int32(), "long": pa.int64(), "array<long>": longs, "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], types[t]) for v, (_, t) in zip(values, fields)], [n for n, _ in fields])


def encode_words(words: DataFrame, ranks_path: str, buckets: int) -> DataFrame:
    """For each (block, bucket): the numbers of ids and the ids of its words."""

    def encode(batches):
        ranks, known, at = read_ranks(ranks_path), {}, None
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in range(batch.num_rows):
                bucket, block, data = (batch.column(c)[r].as_py() for c in ("bucket", "block", "payload"))
                if bucket != at:
                    known, at = {}, bucket
                found = []
                for w in unzip.decompress(data).split(b"\xff"):
                    ids = known.get(w)
                    if ids is None:
                        ids = tuple(merge(w, ranks))
                        if len(known) < KNOWN_WORDS:  # beyond them a word is merged for each of its blocks
                            known[w] = ids
                    found.append(ids)
                lengths = np.fromiter(map(len, found), np.uint32, len(found))
                ids = np.array([i for x in found for i in x], np.uint32)
                yield _row(BACK, bucket, block, None, None, _join(_pack(lengths), _pack(ids)))

    tasks = min(buckets, max(buckets // 4, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return (
        words.select("bucket", "block", "payload")
        .repartition(tasks, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(encode, BACK)
    )


def assemble(positions: DataFrame, encoded: DataFrame, tasks: int) -> DataFrame:
    """(doc_id, ids array<int>) from the words' ids and the positions of each block."""

    def build(batches):
        starts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        flat: list[np.ndarray] = []
        used, current, before = 0, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                bucket, block, doc_ids, counts, data = (batch.column(i)[r].as_py() for i in range(5))
                if bucket < LAST and (block, bucket) == before:
                    continue  # of an equal block: the same words
                before = block, bucket
                a, b = map(_unpack, _parts(data))
                if bucket < LAST:
                    if block != current:
                        starts, lengths, flat, used, current = [], [], [], 0, block
                    n = a.astype(np.int64)
                    starts.append(used + np.cumsum(n) - n)
                    lengths.append(n)
                    flat.append(b)
                    used += len(b)
                    continue
                if not len(a):  # a block without words
                    for i in range(0, len(doc_ids), 10_000):
                        part = doc_ids[i : i + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([[]] * len(part), pa.list_(pa.int32()))], ["doc_id", "ids"])
                    continue
                # the last row of its block: words stand in the order of bucket, then number
                if block != current or sum(map(len, lengths)) != len(a):
                    raise ValueError("the documents were read in other partitions the second time: store them first")
                order = np.argsort(a, kind="stable")
                start, length = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
                start[order], length[order] = np.concatenate(starts), np.concatenate(lengths)
                ids = np.concatenate(flat)
                edges = np.concatenate([[0], np.cumsum(counts)])
                begin = 0
                while begin < len(counts):  # some documents at a time
                    end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + 300_000, "right")) - 1)
                    at = b[edges[begin] : edges[end]]
                    n = length[at]
                    ends = np.concatenate([[0], np.cumsum(n)])[edges[begin : end + 1] - edges[begin]]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gather(ids, start[at], n).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[begin:end], pa.int64()), lists], ["doc_id", "ids"])
                    begin = end

    rows = encoded.unionByName(positions).repartition(tasks, "block").sortWithinPartitions("block", "bucket")
    return rows.mapInArrow(build, "doc_id long, ids array<int>")


def encode(docs: DataFrame, ranks_path: str, buckets: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids array<int>) of every document. The documents are read twice, for words and for positions (storing
    the blocks would take as much disk as the table): a table or a stored DataFrame gives the same blocks each time."""
    buckets = buckets or min(MOST_BUCKETS, max(FEWEST_BUCKETS, parts_for(docs, BUCKET_BYTES)))
    words = encode_words(split(docs, buckets, False, block_bytes), ranks_path, buckets)
    return assemble(split(docs, buckets, True, block_bytes), words, parts_for(docs, TASK_BYTES))


def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths


@lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, begin and length of each id (0 for ids that are free)."""
    ranks = read_ranks(ranks_path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return _table(tokens)


def _joined(table, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int]]:
    """The table's strings for all ids, and where each document ends in them."""
    flat, start, length = table
    n = length[ids]
    return gather(flat, start[ids], n).tobytes(), np.concatenate([[0], np.cumsum(n)])[ends].tolist()


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, bytes): each id joined with its row of the token-byte table, in order."""

    def join(batches):
        table = token_bytes(ranks_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                lists = part.column("ids")
                data, at = _joined(table, lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(_sizes(lists))]))
                out = pa.array([data[a:b] for a, b in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, out], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id long, ids array<int>, bytes binary")


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``decode`` returns. In SQL: one more Python function in
    the stage would be one more worker process for every core."""
    numbers = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
