"""SimHash near-duplicates: fingerprints of word shingles, linked by their distance in bits.

1. ``fingerprints``: every whole text, A-Z lower-cased, its words' shingles hashed by XXH64 (seed 42);
   a bit is set if it is in over half the hashes. No word: zero.
2. Copies collapse: one node a distinct fingerprint.
3. Byte-position index. Within d differing bits two fingerprints share at least 8 - d of their 8
   positional bytes. For d <= 4 the postings are three positions and their bytes: the 20 triples
   below hold three of any four positions, so every pair to be linked meets in one of them (for
   d = 5, 6, 7 postings are single pairs or bytes by the same argument).
4. In a posting list, count filtering: the positional bytes that a pair shares are tallied, pairs
   with the guaranteed minimum are kept and verified by their distance, and only the links of a
   spanning forest of the list come out of it. A list of over ``LIST`` fingerprints takes another
   exact way: two of them are within d bits if and only if they have a common centre within
   ceil(d/2) bits of one and floor(d/2) of the other, so each names its centres and is linked with the
   smallest that named the same one.
5. Components by alternating star joins on the links, with a checkpoint each round.

Null text: no word. Null doc_id: takes part, but names no component; a component of such rows alone
has a null component_id. Repeated rows: same fingerprint, same component. Empty table: no row. Other
columns are left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import chunks, fresh, shared_folder, ship, stored, texts_of

SLICE_BYTES = 4 << 20
LIST = 16_384
ROWS_AT_ONCE = 128


def positions(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any 8 - max_bits positions hold one of them.

    Three groups of positions: three within a group, or two of one group and one of the next, always
    occur among four positions; two of a group among any three if there are two groups.
    """
    shared = 8 - max_bits
    if shared >= 4:
        group = [0, 0, 0, 1, 1, 1, 2, 2]
        def held(t):
            a, b, c = sorted(group[i] for i in t)
            return a == b == c or (a == b and c == (a + 1) % 3) or (b == c and a == (b + 1) % 3)
        return [t for t in combinations(range(8), 3) if held(t)]
    if shared >= 2:
        n = shared - 1  # so many groups: of one more position, two fall into one group
        return [t for t in combinations(range(8), 2) if t[0] % n == t[1] % n]
    if shared == 1:
        return [(i,) for i in range(8)]
    raise ValueError("at most 7 differing bits")


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of a document's shingle hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # bytes: A-Z only; split at x20 and x09-x0d only
    if not words:
        return 0
    data, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    spans = zip(starts[:n].tolist(), last.tolist())
    return bits_of(np.fromiter((digest(data[a:b], 42) for a, b in spans), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long: the fingerprint's 64 bits), stored."""

    def hashed(batches):
        for part in chunks(batches, "text", SLICE_BYTES):
            fps = np.fromiter((fingerprint(bytes(t.as_buffer()), shingle) for t in part.column("text")), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return stored(texts_of(docs).mapInArrow(hashed, "doc_id long, fp long"), "fingerprints")


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs within ``max_bits``, some rows of pairs at a time."""
    n = len(fps)
    label = np.arange(n)  # of the component so far
    a_out, b_out = [], []
    octets = np.ascontiguousarray(fps.view(np.uint8).reshape(n, 8).T)
    for begin in range(0, n, ROWS_AT_ONCE):
        end = min(begin + ROWS_AT_ONCE, n)
        tally = np.zeros((end - begin, n - begin), np.uint8)
        for p in range(8):
            tally += octets[p, begin:end, None] == octets[p, None, begin:]
        i, j = np.nonzero(tally >= 8 - max_bits)
        i, j = i + begin, j + begin
        near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        i, j = i[near], j[near]
        while len(i):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            # one link for each component on the right; the loop ends when none is apart
            _, first = np.unique(label[j], return_index=True)
            for a, b in zip(i[first].tolist(), j[first].tolist()):
                x, y = label[a], label[b]
                if x != y:
                    label[label == max(x, y)] = min(x, y)
                    a_out.append(a)
                    b_out.append(b)
    return np.array(a_out, np.int64), np.array(b_out, np.int64)


def _links_of_lists(rows: DataFrame, max_bits: int) -> DataFrame:
    """rows (key, fp) sorted by key within partitions, whole lists together -> links (a, b)."""

    def build(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            if held is not None:
                key, fp = np.concatenate([held[0], key]), np.concatenate([held[1], fp])
            cut = int(np.searchsorted(key, key[-1]))  # the last list may go on
            held = key[cut:], fp[cut:]
            yield links(key[:cut], fp[:cut])
        if held is not None:
            yield links(*held)

    def links(key, fp):
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        begins, sizes = edges[:-1], np.diff(edges)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        two = begins[sizes == 2]  # most lists
        near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= max_bits
        a.append(fp[two[near]])
        b.append(fp[two[near] + 1])
        for begin, size in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            part = fp[begin : begin + size]
            i, j = forest(np.ascontiguousarray(part).view(np.uint64), max_bits)
            a.append(part[i])
            b.append(part[j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return rows.mapInArrow(build, "a long, b long")


def centres(max_bits: int, radius: int) -> list[int]:
    """Flips of at most ``radius`` of 64 bits, as signed longs."""
    flips = [0]
    for n in range(1, radius + 1):
        flips += [sum(1 << i for i in c) for c in combinations(range(64), n)]
    return [f - (1 << 64) if f >> 63 else f for f in flips]


def _links_by_centre(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of fingerprints (fp) that meet in a centre; as many rows as centres a fingerprint, whatever
    the number of fingerprints."""

    def flipped(radius):
        flips = np.array(centres(max_bits, radius), np.int64)

        def build(batches):
            for batch in batches:
                fp = batch.column("fp").to_numpy()
                for i in range(0, len(fp), 64):
                    part = fp[i : i + 64]
                    centre = (part[:, None] ^ flips[None, :]).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(flips))), pa.array(centre)], ["fp", "centre"])

        return fps.mapInArrow(build, "fp long, centre long")

    near = flipped(max_bits // 2)
    least = near.groupBy("centre").agg(F.min("fp").alias("b"))
    far = near if max_bits % 2 == 0 else flipped(max_bits - max_bits // 2)
    return far.join(least, "centre").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()


def links(nodes: DataFrame, max_bits: int = 4, longest_list: int = LIST) -> DataFrame:
    """(a, b): links whose components are those of all pairs within ``max_bits``. nodes: distinct fp."""
    keys = []
    for n, places in enumerate(positions(max_bits)):
        mask = sum(0xFF << (8 * p) for p in places)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).alias("set"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bytes")))
    postings = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select(F.xxhash64("k.set", "k.bytes").alias("key"), "fp")
    # stored here and below: joined as a table, so that AQE can split the rows of a common key
    sizes = stored(postings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "list-sizes")
    lists = stored(postings.join(sizes, "key"), "postings")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = lists.where(F.col("n") <= longest_list).select("key", "fp").repartition(parts, "key").sortWithinPartitions("key", "fp")
    found = _links_of_lists(short, max_bits)
    long = lists.where(F.col("n") > longest_list).select("fp").distinct()
    if not long.isEmpty():
        found = found.unionByName(_links_by_centre(long, max_bits))
    return found


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of the links reaches, itself included; nodes
    without a link don't occur. Alternating large and small stars: every link is moved to the
    smallest neighbour, until all links go to roots."""
    shared_folder(edges.sparkSession)  # for checkpoint()
    big, small = F.greatest(a, b), F.least(a, b)
    edges = edges.select(big.alias("u"), small.alias("v")).where(F.col("u") != F.col("v")).distinct().checkpoint()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).checkpoint()
        stars = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = stars.checkpoint()
        least = stars.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        moved = stars.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        sums = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        now = tuple(edges.agg(*sums).first())
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )


def grouped(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp, root (smallest fingerprint reachable) and component_id (smallest doc_id reachable) of every row."""
    prints = fingerprints(docs, shingle)
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    known = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = stored(known, "nodes")
    least = stored(known.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = known.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    return grouped(docs, shingle, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, or one without a doc_id where the whole
    component has none. Of several such rows it is one of the smallest fingerprint, and of these the one whose text
    hashes lowest."""
    every = stored(grouped(docs, shingle, max_bits), "grouped")
    found = every.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = stored(found.groupBy("root").agg(F.min("fp").alias("fp"), F.first("doc_id").alias("doc_id")), "first-rows")
    # a doc_id that occurs once tells its row; only texts without one, or with a common one, are hashed again
    common = stored(every.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"), "common-ids")
    own = first.where(F.col("doc_id").isNotNull()).join(common, "doc_id", "left_anti")
    doc_id = F.col("doc_id").cast("long")
    one = docs.join(own.select(F.col("doc_id").alias(fresh(docs, "first_id")[0])), doc_id == F.col(fresh(docs, "first_id")[0]), "left_semi")

    fp, same, none, turn = fresh(docs, "fp", "same_id", "no_id", "turn")
    key = [fp, same, none]  # a null doc_id never equals one in a join

    def keyed(rows: DataFrame, c: str) -> DataFrame:
        return rows.withColumns({same: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")), none: F.col(c).cast("long").isNull()})

    again = docs.join(common.select(F.col("doc_id").alias(same)), doc_id == F.col(same), "left_semi").unionByName(docs.where(doc_id.isNull()))
    kept = keyed(with_fingerprints(again, shingle, fp), "doc_id").join(keyed(first.withColumnRenamed("fp", fp), "doc_id").select(*key), key)
    order = Window.partitionBy(*key).orderBy(F.xxhash64("text"))
    some = kept.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1)
    return one.select(*docs.columns).unionByName(some.select(*docs.columns))


def with_fingerprints(docs: DataFrame, shingle: int, name: str = "fp") -> DataFrame:
    """``docs`` with a column more: the fingerprint's 64 bits, as ``fingerprints`` has them."""
    ship(docs.sparkSession)

    def hashed(batches):
        for part in chunks(batches, "text", SLICE_BYTES):
            texts = part.column("text")
            fps = np.fromiter((fingerprint(bytes(t.as_buffer()) if t.is_valid else b"", shingle) for t in texts), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps.view(np.int64))], [*part.schema.names, name])

    return docs.mapInArrow(hashed, StructType([*docs.schema.fields, StructField(name, LongType())]))
