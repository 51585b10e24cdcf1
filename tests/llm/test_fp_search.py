"""Ranked lexical search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import fp_search, queries
from helpers import SF, no_docs, odd_docs, odd_texts, rows_of, tuples, with_clashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(SMALL) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    out = []
    for item, text in dict.fromkeys(items):
        wanted = Counter(terms(text))
        scores = []
        df = {t: sum(t in c for _, c in held) for t in wanted}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
        for (doc, c), n in zip(held, sizes):
            if n:
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                scores.append((-sum(r * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in wanted.items()), doc is None, doc))
        best = sorted((s for s in scores if s[0] < 0), key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(best, 1)]
    return sorted(out, key=repr)


COLUMNS = ["item_id", "rank", "doc_id", "score"]
ITEMS = [(0, "w3 w4 W5 w119 one x"), (1, ""), (2, None), (3, "nowhere"), (4, "ten ten TEN nine"), (5, "ÉTÉ été 東京"), (4, "ten ten TEN nine"), (None, "long x")]


@pytest.mark.parametrize("at_once", [1, 3, 512])
def test_odd_documents(spark, at_once):
    items = with_clashes(spark.createDataFrame(ITEMS, "item_id LONG, text STRING"))
    got = fp_search.search(odd_docs(spark).repartition(3), items, 20, items_at_once=at_once)
    assert tuples(got, *COLUMNS) == brute([(i, t) for i, t in odd_texts()], ITEMS)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id LONG, text STRING")
    assert tuples(fp_search.search(no_docs(spark), items)) == []
    assert tuples(fp_search.search(odd_docs(spark), items.where("false"))) == []


@pytest.mark.parametrize("loose,docs", [(1, 50), (2, 7), (16, 4096)])
def test_ties_and_copies(spark, monkeypatch, loose, docs):
    monkeypatch.setattr(fp_search, "LOOSE", loose)
    monkeypatch.setattr(fp_search, "DOCS", docs)
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 25), p=np.arange(30, 0, -1) / 465)) for _ in range(150)]
    rows = [(i, texts[i % 120]) for i in range(400)] + [(1000 + i, texts[3]) for i in range(90)]
    items = [(i, " ".join(rng.choice(words, 6))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    got = fp_search.search(df, spark.createDataFrame(items, "item_id LONG, text STRING"))
    assert tuples(got, *COLUMNS) == brute(rows, items)


def test_whole_table(spark):
    got = queries.op12_fp_search(spark, SF)
    assert tuples(got, *COLUMNS) == brute(rows_of(), rows_of("benchmark", "item_id, text"))


def test_long_texts_are_counted_by_slices(monkeypatch):
    monkeypatch.setattr(fp_search, "SLICE_BYTES", 10)
    text = "aa bb-cc " * 500 + "dd" * 40
    n, numbers, counts = fp_search.counts_of(text.encode().translate(fp_search._TERM_BYTES), {b"aa": 0, b"cc": 1, b"dd" * 40: 2, b"ee": 3})
    assert (n, numbers.tolist(), counts.tolist()) == (1501, [0, 1, 2], [500, 500, 1])


def test_bounds_hold_and_leave_documents_out():
    """No node's bound lies below a score in it, and most documents are never scored."""
    rng = np.random.default_rng(6)
    n, width = 2000, 60
    sizes = rng.integers(1, 4, n)
    ranks = np.concatenate([np.sort(rng.choice(width, s, replace=False)) for s in sizes]).astype(np.int32)
    tfs = rng.integers(1, 5, len(ranks))
    tree = fp_search.Tree(np.arange(n), np.zeros(n, bool), rng.integers(76, 200, n), np.cumsum(sizes), ranks, tfs, width)
    wanted, weights = np.arange(40, 46), rng.integers(1, 5000, 6)
    best = fp_search.Best(5)
    scored = tree.search(wanted, weights, 5, best)
    scores = tree.adds[:, wanted].astype(np.int64) @ weights
    order = np.lexsort((tree.ids, -scores))[:5]
    assert best.score.tolist() == scores[order].tolist() and best.ids.tolist() == tree.ids[order].tolist()
    assert scored < n / 2
    for node in tree.known.values():
        for i, (a, b, _) in enumerate(node.inner):
            assert node.bounds[wanted, i].astype(np.int64) @ weights >= scores[a:b].max()
