"""Repeated word spans across documents, by paths of a De Bruijn graph.

A window of ``WINDOW`` words is an edge of the graph (from its first to its last WINDOW - 1 words); a word goes if
a window over it also starts in a document with a smaller doc_id. All windows are judged on the input.

1. ``scan``: every whole text once: word count, hashes of text and word sequence, and its seeds. A seed is the
   least hash of the GRAM-word k-mers of a window, so equal windows have equal seeds, and a document has far
   fewer seeds than windows. Documents with one word sequence collapse to the smallest doc_id; the others go
   whole (if they have a window at all).
2. Seeds in more than one document (least and largest doc_id of each seed, joined back) tell which windows can
   be repeated; only these become edges.
3. Edges: the smallest (doc_id, position) of each is its source coordinate, joined back to the edges that can
   be removed. Edges that follow each other in a document and in their source are one nonbranching
   path: neighbours compact to (document, begin, end, source, begin there). A path ends where its
   source changes.
4. Each path is verified: its words are compared with those at its source coordinates.

A common passage is one row a document and seed or edge; least and largest are taken before rows are shuffled,
and the join back is by key, where AQE splits a key with many rows. No group is gathered in one place.

Null text: no word. Null doc_id: larger than any other. Repeated rows (same doc_id and text): each gets
the same answer, and they are no copies of each other. Rows that share a doc_id only: separate
texts of one document. Empty table: no row. Other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, fresh, stored, texts_of

WINDOW, GRAM = 50, 10
SLICE_BYTES = 4 << 20
LAST = (1 << 63) - 1  # stands for a null doc_id
_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base)]), dtype=np.uint64)[:n]


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def spans_hashed(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of every run of ``size`` words: polynomials by differences of one running sum."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    power = _powers(n, base)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_stir(hashes + base) * power, dtype=np.uint64)])
    back = _powers(n, np.uint64(pow(int(base), -1, 1 << 64)))
    return _stir((sums[size:] - sums[:-size]) * back[: n - size + 1])


def window_seeds(hashes: np.ndarray) -> np.ndarray:
    """The least k-mer hash of each window."""
    low, size, need = spans_hashed(hashes, GRAM, _BASES[1]), 1, WINDOW - GRAM + 1
    if len(hashes) < WINDOW:
        return low[:0]
    while 2 * size <= need:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    return np.minimum(low[: len(low) - (need - size)], low[need - size :]) if need > size else low


def scan(docs: DataFrame) -> DataFrame:
    """(d, uid, n_words, sha256 of the words, h1 and h2 of the word sequence, seeds), stored."""

    def scanned(batches):
        for part in chunks(batches, "text", SLICE_BYTES):
            out = []
            for text in part.column("text"):
                words = bytes(text.as_buffer()).split()
                data = b" ".join(words)
                seeds = np.unique(window_seeds(word_hashes(words))).view(np.int64) if len(words) >= WINDOW else np.zeros(0, np.int64)
                whole = np.frombuffer(xxhash.xxh3_128_digest(data), "<i8")
                out.append((len(words), hashlib.sha256(data).hexdigest(), int(whole[0]), int(whole[1]), seeds))
            n, sha, h1, h2, seeds = zip(*out)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in seeds])]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(seeds)))
            columns = [*(part.column(c) for c in ("d", "uid")), pa.array(n, pa.int64()), pa.array(sha), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["d", "uid", "n_words", "sha256", "h1", "h2", "seeds"])

    schema = "d long, uid long, n_words long, sha256 string, h1 long, h2 long, seeds array<long>"
    return stored(keyed(docs).mapInArrow(scanned, schema), "scan")


def keyed(docs: DataFrame) -> DataFrame:
    """(d, uid, text): d is doc_id, uid a hash of the text."""
    return texts_of(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("uid"), "text")


def suspects(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(d, uid, text, seeds, flags) of the documents that share a seed, stored. flags: 1 if the seed is in a
    smaller document, 2 if in a larger, 3 if both."""
    rows = firsts.select("d", "uid", F.explode("seeds").alias("seed"))
    ends = rows.groupBy("seed").agg(F.min("d").alias("low"), F.max("d").alias("high")).where(F.col("low") < F.col("high"))
    ends = stored(ends, "seeds")  # joined as a table, so that AQE can split the rows of a common seed
    flag = F.when(F.col("d") == F.col("low"), 2).when(F.col("d") == F.col("high"), 1).otherwise(3).cast("tinyint")
    shared = rows.join(ends, "seed").groupBy("d", "uid").agg(F.array_sort(F.collect_list(F.struct("seed", flag.alias("flag")))).alias("s"))
    shared = shared.select("d", "uid", F.col("s.seed").alias("seeds"), F.col("s.flag").alias("flags"))
    return stored(keyed(docs).join(shared, ["d", "uid"]), "suspects")


def edges(suspected: DataFrame, flag: int) -> DataFrame:
    """(h1, h2, d, uid, pos) of the windows whose seed has the flag."""

    def build(batches):
        for part in chunks(batches, "text", SLICE_BYTES):
            d, uid = part.column("d").to_numpy(), part.column("uid").to_numpy()
            out = [[] for _ in range(4)]
            for r in range(part.num_rows):
                hashes = word_hashes(bytes(part.column("text")[r].as_buffer()).split())
                seeds = part.column("seeds")[r].values.to_numpy(zero_copy_only=False)
                seeds = seeds[part.column("flags")[r].values.to_numpy(zero_copy_only=False) & flag > 0]
                at = np.flatnonzero(_among(window_seeds(hashes).view(np.int64), seeds))
                if len(at):
                    for x, base in zip(out, _BASES):
                        x.append(spans_hashed(hashes, WINDOW, base)[at].view(np.int64))
                    out[2].append(np.full(len(at), r))
                    out[3].append(at.astype(np.int32))
            if out[3]:
                h1, h2, r, pos = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, d[r], uid[r], pos)], ["h1", "h2", "d", "uid", "pos"])

    return suspected.mapInArrow(build, "h1 long, h2 long, d long, uid long, pos int")


def _among(values: np.ndarray, sorted_seeds: np.ndarray) -> np.ndarray:
    if not len(sorted_seeds):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_seeds, values), len(sorted_seeds) - 1)
    return sorted_seeds[at] == values


def paths(suspected: DataFrame) -> DataFrame:
    """(d, uid, begin, end, src_d, src_uid, src_begin) in words: compacted runs of repeated edges."""
    source = F.min(F.struct("d", "pos", "uid")).alias("src")
    sources = stored(edges(suspected, 2).groupBy("h1", "h2").agg(source), "sources")  # as the seeds
    found = edges(suspected, 1).join(sources, ["h1", "h2"]).where(F.col("src.d") < F.col("d"))
    found = found.select("d", "uid", "pos", F.col("src.d").alias("src_d"), F.col("src.uid").alias("src_uid"), (F.col("src.pos") - F.col("pos")).alias("shift"))
    line = Window.partitionBy("d", "uid", "src_d", "src_uid", "shift").orderBy("pos")
    found = found.withColumn("path", F.col("pos") - F.dense_rank().over(line))  # equal for neighbours
    runs = found.groupBy("d", "uid", "src_d", "src_uid", "shift", "path").agg(F.min("pos").alias("begin"), (F.max("pos") + WINDOW).alias("end"))
    return runs.select("d", "uid", "begin", "end", "src_d", "src_uid", (F.col("begin") + F.col("shift")).alias("src_begin"))


def _cut(rows: DataFrame, suspected: DataFrame, keys: tuple[str, str], out: str, schema: str, digest) -> DataFrame:
    """rows grouped by a document, joined to its text, and ``digest(words, spans)`` taken in Python."""
    text = suspected.select(F.col("d").alias(keys[0]), F.col("uid").alias(keys[1]), "text")

    def build(batches):
        for part in chunks(batches, "text", SLICE_BYTES):
            found = [digest(bytes(t.as_buffer()).split(), s.as_py()) for t, s in zip(part.column("text"), part.column("spans"))]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(found, types)], [*keys, out])

    types = {"sums": pa.list_(pa.binary()), "kept": pa.struct([("n_removed", pa.int64()), ("text", pa.string())])}[out]
    return rows.join(text, list(keys)).mapInArrow(build, f"{keys[0]} long, {keys[1]} long, {out} {schema}")


def _sums(words, spans):
    return [xxhash.xxh3_128_digest(b" ".join(words[b:e])) for b, e in ((s["begin"], s["end"]) for s in spans)]


def verified(found: DataFrame, suspected: DataFrame) -> DataFrame:
    """The paths whose words are those at their source coordinates."""
    asked = found.select("src_d", "src_uid", F.col("src_begin").alias("begin"), (F.col("src_begin") + F.col("end") - F.col("begin")).alias("end")).distinct()
    own = found.select("d", "uid", "begin", "end").distinct()

    def summed(rows, keys):
        spans = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
        sums = _cut(spans, suspected, keys, "sums", "array<binary>", _sums)
        both = spans.join(sums, list(keys)).select(*keys, F.explode(F.arrays_zip("spans", "sums")).alias("x"))
        return both.select(*keys, F.col("x.spans.begin").alias("begin"), F.col("x.spans.end").alias("end"), F.col("x.sums").alias("sum"))

    there = summed(asked, ("src_d", "src_uid")).select("src_d", "src_uid", F.col("begin").alias("src_begin"), (F.col("end") - F.col("begin")).alias("n"), F.col("sum").alias("there"))
    here = summed(own, ("d", "uid"))
    joined = found.withColumn("n", F.col("end") - F.col("begin")).join(there, ["src_d", "src_uid", "src_begin", "n"]).join(here, ["d", "uid", "begin", "end"])
    return joined.where(F.col("there") == F.col("sum")).select(*found.columns)


def keep(words: list[bytes], spans: list[dict]) -> dict:
    """What is left of the words without the spans."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["begin"]] += 1
        gone[s["end"]] -= 1
    left = np.cumsum(gone[:-1]) == 0
    kept = [words[i] for i in np.flatnonzero(left).tolist()]
    return {"n_removed": len(words) - len(kept), "text": b" ".join(kept).decode()}


def changed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all documents: d, uid, n_words, sha256, first: smallest d of the same words; those of them of which a part
    goes: d, uid, kept with n_removed and the text that is left)."""
    scanned = scan(docs)
    least = stored(scanned.groupBy("h1", "h2").agg(F.min("d").alias("first")), "firsts")
    every = scanned.join(least, ["h1", "h2"])
    firsts = every.where((F.col("d") == F.col("first")) & (F.size("seeds") > 0))
    suspected = suspects(docs, firsts)
    found = stored(paths(suspected), "paths")
    spans = verified(found, suspected).groupBy("d", "uid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    kept = _cut(spans, suspected, ("d", "uid"), "kept", "struct<n_removed: long, text: string>", keep)
    return every.select("d", "uid", "n_words", "sha256", "first"), kept


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    every, kept = changed(docs)
    kept = kept.select("d", "uid", F.col("kept.n_removed").alias("part"), F.sha2(F.col("kept.text").cast("binary"), 256).alias("kept_sha")).distinct()
    copy = (F.col("first") < F.col("d")) & (F.col("n_words") >= WINDOW)
    return every.join(kept, ["d", "uid"], "left").select(
        F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("part", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha", "sha256")).alias("kept_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left of each text, words joined by one space; texts of which nothing goes stay as they
    are, and documents of which no word is left go. Null texts stay."""
    every, kept = changed(docs)
    copy = (F.col("first") < F.col("d")) & (F.col("n_words") >= WINDOW)
    gone = every.where(copy).select("d", "uid", F.lit("").alias("left"))
    parts = kept.select("d", "uid", F.col("kept.text").alias("left")).unionByName(gone).dropDuplicates(["d", "uid"])
    d, uid, left = fresh(docs, "d", "uid", "left")
    parts = stored(parts.select(F.col("d").alias(d), F.col("uid").alias(uid), F.col("left").alias(left)), "changed-texts")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    on = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col(d)) & (F.xxhash64(text) == F.col(uid))
    joined = docs.join(parts, on, "left").where(F.col(left).isNull() | (F.col(left) != ""))
    return joined.withColumn("text", F.coalesce(left, "text")).select(*docs.columns)
