"""Ranked lexical search by branch and bound over document FP-trees.

1. ``restricted``: one pass over the whole texts gives each document's length and its term counts, restricted to
   the terms of the items. Document counts of the terms, N and L come from the stored result.
2. Each task packs its documents some at a time into an FP-tree: a document is the list of its terms, the
   most frequent in the corpus first, so that documents share the path of what they begin with alike. Sorted by
   these lists, a node is a range of documents. Nodes are made when they are first visited, with the largest tf of
   each term and the smallest m below them. Children of up to ``LOOSE`` documents are put together, that many
   neighbours at a time, each such group with its own maxima and minimum.
3. For each item, depth first: a node's bound is the score of a document that had the subtree's largest tf of every
   term and its smallest m (the score rises with tf and falls with m). Children are taken by descending bound;
   nodes and groups whose bound lies below the k-th best score so far are left out, the documents of the
   other groups are scored exactly. The best of an item stay from tree to tree of a task.
4. The best of all tasks, ranked in two steps.

Items are taken some at a time (``items_at_once``, ``item_bytes``); each such block of the query set goes over all
documents, so neither the driver nor a task holds more than one block of items.

Null text: no term. Documents without a term are counted nowhere. Null doc_id: takes part, behind all ids among
equal scores. Rows that share a doc_id are separate documents. Repeated items (same item_id and text) count once; an
item_id with several texts has the best of each. Null item_id is kept. Empty tables: no row. Other columns are
left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, parts_for, stored, texts_of

SLICE_BYTES = 4 << 20
CELLS = 6 << 20  # of a tree's matrix (documents by terms)
DOCS = 4096
TASK_BYTES = 32 << 20
LOOSE = 16
SALTS = 64
FOUND = "item int, doc_id long, score long"

# Bytes outside terms become spaces, A-Z small letters; UTF-8 beyond ASCII stays.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split()


def counts_of(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of terms, numbers of the vocabulary's terms in the text, their counts), some megabytes at a time."""
    n, begin, found = 0, 0, []
    while begin < len(text):
        end = text.find(b" ", begin + SLICE_BYTES)
        end = len(text) if end < 0 else end
        terms = text[begin:end].split()
        n += len(terms)
        numbers = np.fromiter(map(vocabulary.get, terms, repeat(-1)), np.int32, len(terms))
        found.append(np.unique(numbers[numbers >= 0], return_counts=True))
        begin = end
    if len(found) == 1:
        return n, *found[0]
    total = Counter()
    for numbers, counts in found:
        total.update(dict(zip(numbers.tolist(), counts.tolist())))
    return n, np.array(sorted(total), np.int32), np.array([total[i] for i in sorted(total)], np.int64)


def restricted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the document), terms (numbers in ``vocabulary``, ascending), tfs; stored."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def count(batches):
        for part in chunks(batches, "text", SLICE_BYTES):
            found = [counts_of(bytes(t.as_buffer()).translate(_TERM_BYTES), number) for t in part.column("text")]
            ends = pa.array(np.cumsum([0] + [len(t) for _, t, _ in found]), pa.int32())
            flat = [np.concatenate([f[i] for f in found] or [np.zeros(0)]) for i in (1, 2)]
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(w))) for v, w in zip(flat, (np.int32, np.int64))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _, _ in found], pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return stored(texts_of(docs).mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>"), "term-vectors")


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to the score."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Node(NamedTuple):
    """A visited node: larger children with their bounds (term by child); the documents of the others (``loose``)
    with bounds of each ``LOOSE`` that follow each other, and what their terms add."""

    inner: list
    bounds: np.ndarray
    loose: np.ndarray
    loose_bounds: np.ndarray
    adds: np.ndarray


class Tree:
    """The FP-tree of some documents. A document: (doc_id, m, term ranks ascending, tfs); rank 0 is the most frequent term."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, m: np.ndarray, ends: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, width: int):
        starts = np.concatenate([[0], ends[:-1]])
        big = ranks.astype(">u4").tobytes()
        paths = [big[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
        order = sorted(range(len(paths)), key=paths.__getitem__)
        self.ids, self.none, self.m = ids[order], none[order], m[order]
        self.start, self.size = starts[order], (ends - starts)[order]
        self.ranks = ranks
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = np.repeat(place, ends - starts)
        self.tf = np.zeros((len(order), width), np.uint32)
        self.tf[row, ranks] = tfs
        self.adds = np.zeros((len(order), width), np.float32)  # whole numbers up to 10**6: exact
        self.adds[row, ranks] = contribution(tfs, np.repeat(m, ends - starts))
        self.known: dict[tuple[int, int, int], Node] = {}

    def node(self, at: tuple[int, int, int]) -> Node:
        """The node of documents lo to hi that share their first ``depth`` terms."""
        made = self.known.get(at)
        if made is None:
            lo, hi, depth = at
            first = lo + int(np.searchsorted(self.size[lo:hi] > depth, True))  # lists that end here sort first
            term = self.ranks[self.start[first:hi] + depth]
            edges = first + np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]])) if first < hi else np.array([hi])
            spans = [(lo, first)] * (first > lo) + list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            inner = [(a, b, depth + 1) for a, b in spans if b - a > LOOSE and a >= first]
            loose = [np.arange(a, b) for a, b in spans if b - a <= LOOSE or a < first]
            loose = np.concatenate(loose) if loose else np.zeros(0, np.int64)
            cuts = list(range(0, len(loose), LOOSE))
            bounds = self._bounds([slice(a, b) for a, b, _ in inner]), self._bounds([loose[c : c + LOOSE] for c in cuts])
            made = self.known[at] = Node(inner, bounds[0], loose, bounds[1], np.ascontiguousarray(self.adds[loose].T))
        return made

    def _bounds(self, groups: list) -> np.ndarray:
        """What each term can add in each group of documents: by its largest tf and the smallest m there."""
        out = np.zeros((self.tf.shape[1], len(groups)), np.float32)
        for i, g in enumerate(groups):
            out[:, i] = contribution(self.tf[g].max(axis=0).astype(np.int64), self.m[g].min())
        return out

    def search(self, ranks: np.ndarray, weights: np.ndarray, k: int, best: Best) -> int:
        """Put the documents that can be among the ``k`` best into ``best``; returns how many were scored."""
        scored = 0
        small = int(weights.sum()) < 1 << 33  # times 10**6 below 2**53: doubles add up exactly
        weights = weights.astype(np.float64) if small else weights

        def total(adds: np.ndarray) -> np.ndarray:
            return (weights @ adds.astype(weights.dtype)).astype(np.int64)

        todo = [(1 << 62, (0, len(self.ids), 0))]
        while todo:
            bound, at = todo.pop()
            if bound < max(1, best.least):
                continue
            node = self.node(at)
            if len(node.loose):
                near = total(node.loose_bounds[ranks]) >= max(1, best.least)
                if near.any():
                    own = np.flatnonzero(np.repeat(near, LOOSE)[: len(node.loose)])
                    scored += len(own)
                    scores = total(node.adds[ranks[:, None], own])
                    good = scores >= max(1, best.least)
                    if good.any():
                        docs = node.loose[own[good]]
                        best.put(scores[good], self.none[docs], self.ids[docs])
            if node.inner:
                reach = total(node.bounds[ranks])
                todo += [(int(reach[i]), node.inner[i]) for i in np.argsort(reach, kind="stable").tolist() if reach[i] >= max(1, best.least)]
        return scored


class Best:
    """The k best (score, doc_id), equal scores by ascending doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.score, self.none, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def put(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        score, none, ids = np.concatenate([self.score, score]), np.concatenate([self.none, none]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.none, self.ids = score[order], none[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


def _trees(batches, rank_of: np.ndarray, width: int, n_docs: int, n_terms: int) -> Iterator[Tree]:
    """Trees of the documents (doc_id, n, terms, tfs), as many at a time as ``CELLS`` allows."""
    size = max(1, min(DOCS, CELLS // max(1, width)))
    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        while count >= size:
            table = pa.Table.from_batches(held)
            yield _tree(table.slice(0, size), rank_of, width, n_docs, n_terms)
            held, count = table.slice(size).to_batches(), count - size
    if count:
        yield _tree(pa.Table.from_batches(held), rank_of, width, n_docs, n_terms)


def _tree(table: pa.Table, rank_of: np.ndarray, width: int, n_docs: int, n_terms: int) -> Tree:
    table = table.combine_chunks()
    ids, n, terms, tfs = (table.column(c).chunk(0) for c in ("doc_id", "n", "terms", "tfs"))
    sizes = np.diff(terms.offsets.to_numpy())
    ranks, counts = rank_of[terms.flatten().to_numpy()], tfs.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((ranks, row))
    n = n.to_numpy()
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    return Tree(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), m, np.cumsum(sizes), ranks[order], counts[order], width)


def _blocks_of_items(items: DataFrame, items_at_once: int, item_bytes: int) -> Iterator[list[tuple]]:
    """(item_id, text) of the items, some at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held, size = [], 0
    for row in rows.distinct().toLocalIterator():
        if held and (len(held) >= items_at_once or size + len(row.text) > item_bytes):
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 20, items_at_once: int = 512, item_bytes: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents (doc_id, text) of the highest score above 0 for each item
    (item_id, text)."""
    spark = docs.sparkSession
    parts = [_search(docs, block, k) for block in _blocks_of_items(items, items_at_once, item_bytes)]
    found = [p for p in parts if p is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return _ranked(reduce(DataFrame.unionByName, found), k, "item_id").select("item_id", "rank", "doc_id", "score")


def _ranked(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _search(docs: DataFrame, block: list[tuple], k: int) -> DataFrame | None:
    """item_id, doc_id, score: the best of each item of a block in each of ``SALTS`` parts; None where no document holds a term."""
    wanted = [Counter(terms_of(text)) for _, text in block]
    vocabulary = sorted(set().union(*wanted))
    if not vocabulary:
        return None
    vectors = restricted(docs, vocabulary)
    n_docs, n_terms = vectors.where(F.col("n") > 0).agg(F.count("*"), F.sum("n")).first()
    counted = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # a row a term of the items
    if not counted:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in counted:
        df[t] = n
    width = int((df > 0).sum())
    order = np.argsort(-df, kind="stable")  # frequent terms first; terms that no document holds last
    rank_of = np.empty(len(vocabulary), np.int32)
    rank_of[order] = np.arange(len(vocabulary), dtype=np.int32)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()]
    number = {t: i for i, t in enumerate(vocabulary)}
    asked = []
    for terms in wanted:
        held = sorted((int(rank_of[number[t]]), c * weight[number[t]]) for t, c in terms.items() if df[number[t]])
        asked.append((np.array([r for r, _ in held], np.int64), np.array([w for _, w in held], np.int64)))

    def run(batches):
        best = [Best(k) for _ in asked]
        for tree in _trees(batches, rank_of, width, n_docs, n_terms):
            for b, (ranks, weights) in zip(best, asked):
                if len(ranks):
                    tree.search(ranks, weights, k, b)
        for i, b in enumerate(best):
            if len(b.ids):
                item = pa.array(np.full(len(b.ids), i), pa.int32())
                yield pa.RecordBatch.from_arrays([item, pa.array(b.ids, mask=b.none), pa.array(b.score)], ["item", "doc_id", "score"])

    # far smaller than the texts, but more work: dealt to tasks by the size of the texts
    dealt = vectors.where(F.size("terms") > 0).repartition(parts_for(docs, TASK_BYTES), F.xxhash64("doc_id", "n", "terms"))
    found = dealt.mapInArrow(run, FOUND)
    names = docs.sparkSession.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
    salted = _ranked(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k, "item", "salt")
    return stored(salted.join(names, "item").select("item_id", "doc_id", "score"), "search-results")
