"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, distributed components.

1. ``classes``: equal vectors are one class with its number of rows and its least vec_id.
2. ``signed``: in each table a class has a key, the signs of its products with that table's random hyperplanes. The
   number of hyperplanes a table follows from the number of classes (about ``BUCKET`` random ones a bucket), the
   number of tables from the wanted recall of a pair whose cosine is just the threshold; nearer pairs are
   found more surely.
3. Classes that share a key of a table are compared by exact cosine in double precision, as matrix products. A bucket of
   over ``BLOCK`` classes is dealt to blocks by a hash, which are joined with each other, so that no task holds a
   whole bucket. A pair counts in the first table in which it meets, so ``n_links`` is exact for the pairs found,
   and no pair leaves a task: only each class's number of links there and its link to one class of those it reaches.
4. Components of these links by star joins (checkpointed), and their least vec_id.

Vectors null, empty, zero or with null or non-finite components, and null ids, link with nothing: no links, component
their own id (null id: null, not kept). Vectors of unequal width: missing components are zero. Repeated rows: each
row counts as another vector, with the same result. Empty table: no row. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import ship, stored
from .simhash import components

BUCKET, BLOCK, ROWS_AT_ONCE = 32, 2048, 512
FOUND = "a long, links long, b long"


def vector_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, str]:
    """(vec_id, vec (binary), key (hash of vec; null: takes no part), stored; the numbers in vec, as wide as the column's)."""
    ship(vectors.sparkSession)
    kind = vectors.schema[vector_col].dataType
    number = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"

    def pack(batches):
        for batch in batches:
            lists, out, keys = batch.column("vec"), [], []
            named = batch.column("vec_id").is_valid()
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes).tolist()
            for ok, n, end in zip(named.to_pylist(), sizes.tolist(), ends):
                x = values[end - n : end]
                good = ok and n > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                out.append(x.astype(number).tobytes() if good else None)
                keys.append(hashlib.sha256(out[-1]).digest()[:16] if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "vec", "key"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    return stored(rows.mapInArrow(pack, "vec_id long, vec binary, key binary"), "vector-rows"), number


def classes(rows: DataFrame) -> DataFrame:
    """cid (unique number), key, least (vec_id), n (rows), vec of each distinct vector; stored."""
    held = rows.where(F.col("key").isNotNull()).groupBy("key")
    found = held.agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    return stored(found.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")


def layout(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(hyperplanes a table, tables) for ``n`` classes."""
    bits = min(31, max(4, math.ceil(math.log2(max(n, 1) / BUCKET))))
    same = 1 - math.acos(threshold) / math.pi  # of one sign, at the threshold
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same**bits)))


def directions(binaries: pa.Array, number: str) -> np.ndarray:
    """Unit vectors of a column of packed vectors; shorter ones are filled up with zeros."""
    rows = [np.frombuffer(v.as_buffer(), number) for v in binaries]
    dim = max(map(len, rows), default=0)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    out /= np.abs(out).max(axis=1, keepdims=True) if dim else 1.0  # no overflow in the squares
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def signed(found: DataFrame, number: str, dim: int, bits: int, tables: int, seed: int = 20_24) -> DataFrame:
    """cid, n, vec, keys (one a table) of the classes; stored."""
    planes = np.random.default_rng(seed).normal(size=(dim, bits * tables))
    places = 1 << np.arange(bits)

    def sign(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = directions(part.column("vec"), number)
                above = (x @ planes[: x.shape[1]] > 0).reshape(len(x), tables, bits)
                keys = (above * places).sum(axis=2).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["cid", "n", "vec", "keys"])

    return stored(found.select("cid", "n", "vec").mapInArrow(sign, "cid long, n long, vec binary, keys array<int>"), "vector-signs")


def _spread(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Bring the smallest label of each component of the links (i, j) to all its members."""
    while True:
        apart = label[i] != label[j]
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        low = np.minimum(label[i], label[j])
        for side in (i, j):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while True:
            next_label = label[label]
            if (next_label == label).all():
                break
            label[:] = next_label


class Block:
    """Classes of one bucket."""

    def __init__(self, table: int, cid: np.ndarray, n: np.ndarray, keys: np.ndarray, x: np.ndarray):
        self.table, self.cid, self.n, self.keys, self.x = table, cid, n, keys, x


def compare(a: Block, b: Block | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, number of its links, one class for all that reach each other) for the classes with links: pairs within ``a``, or
    between ``a`` and ``b``, that meet in no earlier table."""
    other = a if b is None else b
    earlier_a, earlier_b = a.keys[:, : a.table], other.keys[:, : a.table]
    none = np.zeros(0, np.int64)
    if a.table and ((earlier_a == earlier_a[0]).all(axis=0) & (earlier_b == earlier_a[0]).all(axis=0)).any():
        return none, none, none  # all of them met before
    shift = 0 if b is None else len(a.cid)
    cid = a.cid if b is None else np.concatenate([a.cid, b.cid])
    n = a.n if b is None else np.concatenate([a.n, b.n])
    dim = max(a.x.shape[1], other.x.shape[1])
    left, right = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (a.x, other.x))
    links, label = np.zeros(len(cid)), np.arange(len(cid))
    for begin in range(0, len(left), ROWS_AT_ONCE):
        near = left[begin : begin + ROWS_AT_ONCE] @ right.T >= threshold
        if b is None:
            near = np.triu(near, begin + 1)
        i, j = np.nonzero(near)
        i += begin
        for t in range(a.table):
            new = earlier_a[i, t] != earlier_b[j, t]
            i, j = i[new], j[new]
        j = j + shift
        links += np.bincount(i, n[j], len(cid)) + np.bincount(j, n[i], len(cid))
        _spread(label, i, j)
    held = np.flatnonzero(links)
    return cid[held], links[held].astype(np.int64), cid[label[held]]


def _found(parts: list[tuple]) -> pa.RecordBatch:
    a, links, b = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, links, b)], ["a", "links", "b"])


def _runs(batches: Iterator[pa.RecordBatch], number: str) -> Iterator[tuple[tuple, Block]]:
    """The rows (t, s, salt, cid, n, vec, keys) of each (t, s, salt), which follow each other."""
    held: list[tuple] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in ("t", "s", "salt")], axis=1)
        cid, n = batch.column("cid").to_numpy(), batch.column("n").to_numpy()
        keys = batch.column("keys").flatten().to_numpy().reshape(len(cid), -1)
        x = directions(batch.column("vec"), number)
        edges = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]).any(axis=1), [True]])).tolist()
        for a, b in zip(edges, edges[1:]):
            mark = tuple(marks[a].tolist())
            if mark != at and held:
                yield at, _block(at[0], held)
                held = []
            at = mark
            held.append((cid[a:b], n[a:b], keys[a:b], x[a:b]))
    if held:
        yield at, _block(at[0], held)


def _block(table: int, held: list[tuple]) -> Block:
    if len(held) == 1:
        return Block(table, *held[0])
    dim = max(h[3].shape[1] for h in held)
    x = np.concatenate([np.pad(h[3], ((0, 0), (0, dim - h[3].shape[1]))) for h in held])
    return Block(table, *(np.concatenate([h[i] for h in held]) for i in range(3)), x)


PACKED = "t int, s int, salt int, rows int, cids binary, ns binary, keys binary, x binary"


def _pack(mark: tuple, block: Block) -> pa.RecordBatch:
    values = [*mark, len(block.cid), *(np.ascontiguousarray(v).tobytes() for v in (block.cid, block.n, block.keys, block.x))]
    types = [pa.int32()] * 4 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in PACKED.split(", ")])


def _unpack(batch: pa.RecordBatch, row: int, prefix: str = "") -> Block:
    rows = batch.column(prefix + "rows")[row].as_py()
    cid, n, keys, x = (batch.column(prefix + c)[row].as_buffer() for c in ("cids", "ns", "keys", "x"))
    return Block(
        batch.column("t")[row].as_py(),
        np.frombuffer(cid, np.int64),
        np.frombuffer(n, np.int64),
        np.frombuffer(keys, np.int32).reshape(rows, -1),
        np.frombuffer(x, np.float64).reshape(rows, -1),
    )


def links(found: DataFrame, number: str, threshold: float) -> DataFrame:
    """a, links, b of ``signed`` classes: parts of each class's number of links, and a class it reaches; stored."""
    keyed = found.select("cid", F.posexplode("keys").alias("t", "s"))
    sizes = keyed.groupBy("t", "s").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    sizes = stored(sizes.select("t", "s", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "large-buckets")
    members = found.select("cid", "n", "vec", "keys", F.posexplode("keys").alias("t", "s")).join(sizes, ["t", "s"], "left")
    salt = F.coalesce(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"), F.lit(0))
    members = members.withColumn("salt", salt).select("t", "s", "salt", "blocks", "cid", "n", "vec", "keys")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.drop("blocks").repartition(parts, "t", "s", "salt").sortWithinPartitions("t", "s", "salt", "cid")

    def small(batches):
        out, size = [], 0
        for _, block in _runs(batches, number):
            if len(block.cid) > 1:
                out.append(compare(block, None, threshold))
                size += len(out[-1][0])
            if size > 10_000:
                yield _found(out)
                out, size = [], 0
        yield _found(out)

    def packed(batches):
        for mark, block in _runs(batches, number):
            yield _pack(mark, block)

    def pairs(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.column("salt")[r].as_py() == batch.column("o_salt")[r].as_py()
                a = _unpack(batch, r)
                yield _found([compare(a, None if one else _unpack(batch, r, "o_"), threshold)])

    within = dealt(members.where(F.col("blocks").isNull())).mapInArrow(small, FOUND)
    blocks = stored(dealt(members.where(F.col("blocks").isNotNull())).mapInArrow(packed, PACKED), "large-blocks")
    others = blocks.select("t", "s", *(F.col(c).alias("o_" + c) for c in ("salt", "rows", "cids", "ns", "keys", "x")))
    met = blocks.join(others.hint("merge"), ["t", "s"]).where(F.col("salt") <= F.col("o_salt"))
    return stored(within.unionByName(met.mapInArrow(pairs, FOUND)), "vector-links")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows, number = vector_rows(vectors, id_col, vector_col)
    distinct = classes(rows)
    n, longest = distinct.agg(F.count("*"), F.max(F.length("vec"))).first()
    bits, tables = layout(n, threshold, recall)
    found = links(signed(distinct, number, (longest or 0) // int(number[-1]), bits, tables), number, threshold)
    counts = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found).withColumnRenamed("node", "cid")
    named = distinct.select("cid", "key", "least", "n").join(counts, "cid", "left").join(roots, "cid", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "cid")), "named-classes")
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "vector-components")
    # stored: joined as a table, so that AQE can split the rows of a common vector
    known = stored(named.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "known-vectors")
    mine = rows.select("vec_id", "key").where(F.col("key").isNotNull()).join(known, "key").drop("key")
    alone = rows.where(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return mine.unionByName(alone).withColumn("kept", kept)
