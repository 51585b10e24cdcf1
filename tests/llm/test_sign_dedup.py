"""Embedding near-duplicates against all pairs."""

import math

import numpy as np
import pytest

from cohortlens.llm import queries, sign_dedup
from helpers import SF, rows_of, tuples, with_clashes
from test_search import VECTORS, odd_vectors

COLUMNS = ["vec_id", "n_links", "component_id", "kept"]


def brute(rows, threshold=0.95):
    good = [i for i, (v, x) in enumerate(rows) if v is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    dim = max((len(x) for _, x in rows if x), default=0)
    m = np.array([[float(np.float32(c)) for c in rows[i][1]] + [0.0] * (dim - len(rows[i][1])) for i in good]).reshape(len(good), dim)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= threshold
    np.fill_diagonal(near, False)
    label = list(range(len(good)))
    for i, j in zip(*np.nonzero(near)):
        a, b = label[i], label[j]
        if a != b:
            label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for i, x in zip(good, label):
        least[x] = min(least.get(x, rows[i][0]), rows[i][0])
    out = {i: (v, 0, v, v is not None) for i, (v, _) in enumerate(rows)}
    for i, x, links in zip(good, label, near.sum(axis=1).tolist()):
        out[i] = rows[i][0], links, least[x], rows[i][0] == least[x]
    return sorted(out.values(), key=repr)


def groups(rng, dim=32):
    base = rng.normal(size=(60, dim))
    rows = [(i, b) for i, b in enumerate(base)]
    for g in range(8):  # near copies around some of them, links of links among them
        for i in range(12):
            rows.append((100 + 20 * g + i, base[g] + rng.normal(size=dim) * (0.02 + 0.02 * i)))
    rows += [(500 + i, base[9]) for i in range(40)] + [(600 + i, base[9] * (i + 1)) for i in range(20)]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in rows]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)


def test_odd_vectors(spark):
    rows = odd_vectors(np.random.default_rng(1))
    df = with_clashes(spark.createDataFrame(rows, VECTORS), skip=("vec",)).repartition(3)
    clashes = {c: df["vec_id"] for c in ("cid", "n", "t", "s", "salt", "blocks", "links", "a", "b", "least", "root", "n_links", "component_id", "kept")}
    got = sign_dedup.near_duplicates(df.withColumns(clashes))
    assert tuples(got, *COLUMNS) == brute([(i, [] if v is None else v) for i, v, _ in rows])


@pytest.mark.parametrize("block", [2048, 8])
def test_groups_of_copies(spark, monkeypatch, block):
    """Small blocks: the large buckets are joined block by block; every link counts once."""
    monkeypatch.setattr(sign_dedup, "BLOCK", block)
    rows = groups(np.random.default_rng(3))
    assert tuples(sign_dedup.near_duplicates(frame(spark, rows), recall=0.99999), *COLUMNS) == brute(rows)


def test_empty(spark):
    assert tuples(sign_dedup.near_duplicates(frame(spark, []))) == []


def test_whole_table(spark):
    assert tuples(queries.op11_sign_dedup(spark, SF), *COLUMNS) == brute(rows_of("embeddings", "vec_id, embedding"))


def test_recall_at_the_threshold():
    """Pairs whose cosine is just the threshold share a key as often as the layout says."""
    rng = np.random.default_rng(8)
    n, dim = 4000, 24
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=(n, dim))
    r -= (r * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    for size in (1000, 10**6):
        bits, tables = sign_dedup.layout(size, 0.95, 0.99)
        planes = rng.normal(size=(dim, bits * tables))
        same = ((a @ planes > 0) == (b @ planes > 0)).reshape(n, tables, bits).all(axis=2).any(axis=1)
        assert same.mean() > 0.98
