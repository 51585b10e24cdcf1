"""Token ids of documents in block files with one shared zstandard dictionary.

Layout of a store (a folder of two Parquet tables, so Spark's committer writes it and any file
system that Spark reads can hold it):

* ``blocks``: documents in ascending doc_id order over all shards. One row is a block: the
  documents' ids, their token counts, the byte offset of every document in ``payload`` (one more
  for the end), the number of tokens before the block in its shard, the width of an id in bytes
  and the hash of the dictionary. ``payload`` holds one zstandard frame a document, so a short
  document is read by its two offsets without unpacking its neighbours.
* ``dictionary``: the dictionary's bytes by their sha256.

The dictionary is trained on the id arrays of a bounded sample: the ``sample_docs`` documents of
1 to ``sample_chars`` characters with the smallest hash of doc_id. With too little to learn from
it is empty and the frames stand for themselves.

Null text: an empty document (the end id alone). Null doc_id: first in the order. Rows that share
a doc_id are separate documents, in the order of their texts. An empty table gives a store with
no block. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, parts_for, texts_of
from .encoder import text_encoder

SLICE_BYTES, TASK_BYTES = 8 << 20, 64 << 20
BLOCK_BYTES = 4 << 20
BLOCKS = (
    "shard int, block int, first_doc long, last_doc long, tokens_before long, dictionary string, width int, "
    "doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"
)


def id_width(path: str, end_id: int) -> int:
    return 2 if max(text_encoder(path).size - 1, end_id) < 1 << 16 else 4


def id_arrays(batches, path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of (.., text) and the ids of each of their texts, end id included."""
    encoder = text_encoder(path)
    for part in gathered(batches, "text", SLICE_BYTES):
        values, counts = encoder.run(part.column("text"))
        ends = np.cumsum(counts)
        yield part, [np.append(values[e - n : e], np.uint32(end_id)) for e, n in zip(ends.tolist(), counts.tolist())]


def train_dictionary(docs: DataFrame, path: str, end_id: int, sample_docs: int, sample_chars: int, size: int) -> bytes:
    width = id_width(path, end_id)
    sample = (
        texts_of(docs)
        .where(F.length("text").between(1, sample_chars))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_docs)
    )

    def serialize(batches):
        for _, arrays in id_arrays(batches, path, end_id):
            yield pa.RecordBatch.from_pydict({"ids": pa.array([a.astype(f"<u{width}").tobytes() for a in arrays], pa.binary())})

    rows = [bytes(r.ids) for r in sample.select("text").mapInArrow(serialize, "ids binary").collect()]  # at most sample_docs
    try:
        return zstandard.train_dictionary(size, rows).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 0,
    shards: int | None = None,
    sample_docs: int = 1000,
    sample_chars: int = 20_000,
    dictionary_bytes: int = 64 << 10,
    level: int = 3,
) -> None:
    """Write the store of ``docs`` (doc_id, text) to ``folder``."""
    spark = docs.sparkSession
    trained = train_dictionary(docs, tokenizer, end_id, sample_docs, sample_chars, dictionary_bytes)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(name, bytearray(trained))], "dictionary string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    width = id_width(tokenizer, end_id)
    shards = shards or parts_for(docs, TASK_BYTES)

    def pack(batches):
        shard, block, before, total = TaskContext.get().partitionId(), 0, 0, 0
        frames = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        ids: list = []
        counts: list[int] = []
        payload: list[bytes] = []

        def row():
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in payload])]).tolist()
            known = [i for i in ids if i is not None]
            values = [shard, block, known[0] if known else None, known[-1] if known else None, before, name, width, ids, counts, offsets, b"".join(payload)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for part, arrays in id_arrays(batches, tokenizer, end_id):
            for doc_id, array in zip(part.column("doc_id").to_pylist(), arrays):
                payload.append(frames.compress(array.astype(f"<u{width}").tobytes()))
                ids.append(doc_id)
                counts.append(len(array))
                total += len(payload[-1])
                if total >= BLOCK_BYTES:
                    yield row()
                    block, before, total = block + 1, before + sum(counts), 0
                    ids, counts, payload = [], [], []
        if ids:
            yield row()

    longs = pa.list_(pa.int64())
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), longs, longs, longs, pa.binary()]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    (
        texts_of(docs)
        # the text's beginning deals out rows that share a doc_id, in the order of their texts
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.left("text", F.lit(64)))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(pack, BLOCKS)
        .write.option("compression", "none")  # the payload is compressed already
        .parquet(f"{folder}/blocks")
    )


def read_tokens(spark: SparkSession, folder: str, blocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary: little-endian unsigned 32-bit) of every document; start:
    number of ids of all documents before it."""
    all_blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    last = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n) + F.col("tokens_before")
    totals = all_blocks.groupBy("shard").agg(F.max(last).alias("n"))
    # one row a shard, whatever the number of documents
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    return (
        (all_blocks if blocks is None else blocks)
        .join(starts, "shard")
        .withColumn("tokens_before", F.col("tokens_before") + F.col("shard_start"))
        .select("tokens_before", "dictionary", "width", "doc_ids", "n_tokens", "offsets", "payload")
        .mapInArrow(_unpack(stored_dictionary(spark, folder)), "doc_id long, start long, n_tokens long, ids binary")
    )


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The given documents only: blocks by their first and last doc_id, documents by their offsets."""
    wanted = [int(i) for i in doc_ids]
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    if wanted:
        blocks = blocks.where((F.col("last_doc") >= min(wanted)) & (F.col("first_doc") <= max(wanted)))
    return _only(read_tokens(spark, folder, blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in wanted])))), wanted)


def _only(df: DataFrame, wanted: list[int]) -> DataFrame:
    return df.where(F.col("doc_id").isin(wanted))


def stored_dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    """(hash, bytes) of the store's dictionary: one row of at most ``dictionary_bytes``."""
    row = spark.read.schema("dictionary string, bytes binary").parquet(f"{folder}/dictionary").first()
    name, data = row[0], bytes(row[1])
    if hashlib.sha256(data).hexdigest() != name:
        raise ValueError("the stored dictionary does not have the hash it is named by")
    return name, data


def _unpack(dictionary: tuple[str, bytes]):
    name, data = dictionary

    def unpack(batches):
        frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        for batch in batches:
            for r in range(batch.num_rows):
                before, by, width, doc_ids, counts, offsets, payload = (batch.column(i)[r].as_py() for i in range(7))
                if by != name:
                    raise ValueError("a block was written with another dictionary")
                out: list[tuple] = []
                size = 0
                for doc_id, n, a, b in zip(doc_ids, counts, offsets, offsets[1:]):
                    ids = np.frombuffer(frames.decompress(payload[a:b]), f"<u{width}").astype("<u4").tobytes()
                    if len(ids) != 4 * n:
                        raise ValueError(f"document {doc_id}: {len(ids) // 4} ids in its frame, {n} in the index")
                    out.append((doc_id, before, n, ids))
                    before, size = before + n, size + len(ids)
                    if size >= SLICE_BYTES:
                        yield _rows(out)
                        out, size = [], 0
                if out:
                    yield _rows(out)

    return unpack


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = pa.int64(), pa.int64(), pa.int64(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "start", "n_tokens", "ids"])


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what ``read_tokens`` returns."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
