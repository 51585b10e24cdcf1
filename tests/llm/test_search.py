"""Exact and approximate search against all pairs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import ann_tree, exact_topk, queries
from helpers import SF, rows_of, tuples, with_clashes

VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def odd_vectors(rng, n=120, dim=6):
    rows = [(i, [float(x) for x in rng.normal(size=dim)], 0) for i in range(n)]
    rows[7] = (7, rows[6][1], 0)                      # equal vectors
    rows[20] = (20, rows[6][1], 0)
    rows += [rows[20], rows[3]]                       # repeated rows
    rows += [(200, None, 0), (300, [None] * dim, 0), (400, [math.nan] + [1.0] * (dim - 1), 0), (500, [math.inf] * dim, 0), (600, [], 0)]
    rows += [(None, [1.0] * dim, 0), (700, [0.0] * dim, 0), (900, [1.0, 2.0], 0), (800, [3e38] * dim, 0)]
    return rows


def valid(rows, zero=True):
    out = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out[i, tuple(float(np.float32(x)) for x in v)] = None
    return list(out)


def brute_top(rows, every, k):
    whole = [(i, [max(-(1 << 62), min(1 << 62, math.floor(64 * x))) for x in v]) for i, v in valid(rows)]
    out = []
    for q, a in whole:
        if q % every == 0:
            clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            scores = sorted((-clip(sum(x * y for x, y in zip(a, b))), c) for c, b in whole if c != q)[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)]
    return sorted(out, key=repr)


def test_exact_topk_of_odd_vectors(spark):
    rows = odd_vectors(np.random.default_rng(1))
    df = with_clashes(spark.createDataFrame(rows, VECTORS), skip=("vec",)).repartition(3)
    vectors = exact_topk.whole_numbers(df, 64.0)
    got = exact_topk.exact_topk(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)
    assert tuples(got, "query_id", "rank", "vec_id", "score") == brute_top(rows, 20, 20)


@pytest.mark.parametrize("band,tile", [(16, 8), (4096, 1024)])
def test_exact_topk_in_small_bands(spark, monkeypatch, band, tile):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=12) * rng.exponential()], 0) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]  # ties beyond k
    monkeypatch.setattr(exact_topk, "BAND", band)
    monkeypatch.setattr(exact_topk, "TILE", tile)
    vectors = exact_topk.whole_numbers(spark.createDataFrame(rows, VECTORS), 64.0)
    got = exact_topk.exact_topk(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)
    assert tuples(got, "query_id", "rank", "vec_id", "score") == brute_top(rows, 20, 20)


def test_pruning_drops_no_pair():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(400, 16)) * np.linspace(8, 1, 16) * 20)
    x = x[np.argsort(-(x * x).sum(axis=1))]
    turn = np.linalg.svd(x, full_matrices=True)[2].T
    ids = np.arange(400)
    (i, s, j), _, _ = exact_topk.search(ids[:30], x[:30], ids, x, turn, np.full(30, -np.inf), 5)
    for q in range(30):
        scores = sorted(((-int(x[q] @ x[c]), c) for c in range(400) if c != q))[:5]
        assert [(-a, b) for a, b in zip(s[i == q].tolist(), j[i == q].tolist())] == scores


def test_few_pairs_are_scored_exactly():
    """sf0.1: the partial sums leave under 15 % of the pairs, and the best of them are those of all pairs."""
    rows = rows_of("embeddings", "vec_id, embedding", sf="/root/testdata/sf0.1")
    ids, x = np.array([i for i, _ in rows]), np.floor(64 * np.array([v for _, v in rows], float))
    order = np.lexsort((ids, -(x * x).sum(axis=1)))
    ids, x = ids[order], x[order]
    asked = ids % 20 == 0
    turn = np.linalg.svd(x, full_matrices=True)[2].T
    _, limit, _ = exact_topk.search(ids[asked], x[asked], ids, x, turn, np.full(asked.sum(), -np.inf), 20)
    (i, s, j), _, scored = exact_topk.search(ids[asked], x[asked], ids, x, turn, limit, 20)
    assert scored < 0.15 * asked.sum() * len(x)
    for q, at in enumerate(np.flatnonzero(asked).tolist()):
        every = x @ x[at]
        every[at] = -np.inf
        best = np.lexsort((ids, -every))[:20]
        assert j[i == q].tolist() == best.tolist() and s[i == q].tolist() == every[best].tolist()


def test_searches_of_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    v = exact_topk.whole_numbers(none, 64.0)
    assert exact_topk.exact_topk(v, v, 20).count() == 0
    s = ann_tree.searchable(none)
    assert ann_tree.nearest_neighbours(s, s, 10).count() == 0


def check_neighbours(got, rows, every, k):
    all_rows = valid(rows, zero=False)
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    dim = max(len(v) for _, v in all_rows)
    vectors = {}
    for i, v in all_rows:
        vectors.setdefault(i, []).append(np.pad(np.array(v, float), (0, dim - len(v))))
    for q in [i for i in vectors if i % every == 0]:
        a = vectors[q][0]
        far = sorted((float(np.sqrt(((b - a) ** 2).sum())), c) for c, bs in vectors.items() for b in bs if c != q)
        mine = sorted(by[q])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and len(mine) == min(k, len(far))
        assert [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda m: (m[1], m[0]))
        for _, c, s in mine:
            assert any(abs(s - float(np.sqrt(((b - a) ** 2).sum()))) <= 1e-9 * max(1.0, s) for b in vectors[c])
        limit = far[min(k, len(far)) - 1][0]
        hits += sum(m[2] <= limit * (1 + 1e-12) for m in mine)
        total += len(mine)
    return hits / total


def test_neighbours_of_odd_vectors(spark):
    rows = [r for r in odd_vectors(np.random.default_rng(4)) if r[0] != 800]
    df = ann_tree.searchable(with_clashes(spark.createDataFrame(rows, VECTORS), skip=("vec",)))
    got = ann_tree.nearest_neighbours(df.where("vec_id % 10 = 0"), df, k=10, leaf_rows=16).collect()
    assert check_neighbours(got, rows, 10, 10) >= 0.9


def test_recall_on_the_stored_vectors(spark):
    got = queries.op2_kmeans_tree(spark, SF).collect()
    assert check_neighbours(got, [(i, v, 0) for i, v in rows_of("embeddings", "vec_id, embedding")], 100, 10) >= 0.9


def test_recall_and_measured_rows_on_a_larger_table(spark):
    """sf0.1: recall against brute force, and the share of all rows that a query is measured against."""
    folder = "/root/testdata/sf0.1"
    rows = [(i, v, 0) for i, v in rows_of("embeddings", "vec_id, embedding", sf=folder)]
    assert check_neighbours(queries.op2_kmeans_tree(spark, folder).collect(), rows, 100, 10) >= 0.9

    df = ann_tree.searchable(spark.read.parquet(f"{folder}/embeddings.parquet"))
    index = ann_tree.build(df, 10, 0.95, 20_000, 1024, 16, 100)
    asked = ann_tree._chosen_cells(df.where("vec_id % 100 = 0"), index, 10)
    first = ann_tree._first_found(asked, index, 10)

    def pairs(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict({"n": [int(ann_tree.allowed(batch, r).sum())]})

    measured = 0
    for some in (asked.where("first").withColumn("limit", F.lit(None).cast("double")), ann_tree.within_reach(asked, first, 10)):
        packs = ann_tree.chosen_leaves(some, index, 10).join(index.blocks, "cell")
        measured += packs.mapInArrow(pairs, "n long").agg(F.sum("n")).first()[0]
    assert measured < 0.6 * df.where("vec_id % 100 = 0").count() * df.count()


def test_a_very_common_vector(spark):
    """A third of all rows are one vector: its queries find the smallest ids, others still reach their neighbours."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in (np.ones(8) if i % 3 == 0 else rng.normal(size=8))], 0) for i in range(3000)]
    df = ann_tree.searchable(spark.createDataFrame(rows, VECTORS))
    got = ann_tree.nearest_neighbours(df.where("vec_id % 100 = 0"), df, k=10).collect()
    assert check_neighbours(got, rows, 100, 10) >= 0.9
    assert sorted(r.vec_id for r in got if r.query_id == 300) == [3 * i for i in range(10)]


def test_few_candidates_are_all_returned(spark):
    df = ann_tree.searchable(spark.createDataFrame([(i, [float(i + 1), 1.0], 0) for i in range(4)], VECTORS))
    got = ann_tree.nearest_neighbours(df.where("vec_id = 0"), df, k=10).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 1.0), (2, 2, 2.0), (3, 3, 3.0)]
