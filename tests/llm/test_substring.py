"""Repeated word spans against brute force."""

import hashlib
import random

import numpy as np
import pytest

from cohortlens.llm import queries, substring
from helpers import DOCS, SF, no_docs, odd_docs, odd_texts, rows_of, tuples, words


def brute_left(docs):
    least, split = {}, [(LAST if i is None else i, words(t)) for i, t in docs]
    for i, w in split:
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            least[k] = min(i, least.get(k, i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if least[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        out.append([x for x, g in zip(w, gone) if not g])
    return out


LAST = 1 << 63


def brute(docs):
    rows = []
    for (i, t), left in zip(docs, brute_left(docs)):
        n = len(words(t))
        rows.append((i, n, n - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(rows, key=repr)


def test_all_documents(spark):
    assert tuples(queries.op5_substring(spark, SF)) == brute(rows_of())


def test_odd_documents(spark):
    assert tuples(substring.digest(odd_docs(spark))) == brute(odd_texts())
    assert substring.digest(no_docs(spark)).count() == 0


def passages(seed, n=60):
    """Documents of shared passages of 40 to 130 words, in all orders, whole and cut."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    shared = [[word() for _ in range(rng.choice([40, 49, 50, 51, 75, 130]))] for _ in range(8)]
    shared.append(["again"] * 120)
    docs = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(shared)
            a = rng.choice([0, 0, 1, 5, 30])
            w += [word() for _ in range(rng.randint(0, 30))] + part[a : len(part) - rng.choice([0, 0, 2, 20])]
        docs.append((rng.randint(0, n // 2) if rng.random() < 0.2 else i, " ".join(w)))
    return docs + docs[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages(spark, seed):
    docs = passages(seed)
    got = substring.digest(spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(4))
    assert tuples(got) == brute(docs)


def test_what_is_left(spark):
    docs = odd_texts()
    got = substring.deduplicate(odd_docs(spark))
    expected = []
    for (i, t), left in zip(docs, brute_left(docs)):
        if t is None or len(left) == len(words(t)):
            expected.append((i, t))
        elif left:
            expected.append((i, " ".join(left)))
    assert tuples(got, "doc_id", "text") == sorted(expected, key=repr)
    assert got.columns == odd_docs(spark).columns
    assert substring.deduplicate(no_docs(spark)).count() == 0 and substring.deduplicate(no_docs(spark)).columns == [f.split()[0] for f in DOCS.split(", ")]


def test_equal_windows_have_equal_hashes_and_seeds():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    b = np.concatenate([rng.integers(0, 1 << 63, 37).astype(np.uint64), a[20:150]])
    for base in substring._BASES:
        assert (substring.spans_hashed(a, 50, base)[20:101] == substring.spans_hashed(b, 50, base)[37:]).all()
    assert (substring.window_seeds(a)[20:101] == substring.window_seeds(b)[37:]).all()
    low = substring.spans_hashed(a, substring.GRAM, substring._BASES[1])
    assert substring.window_seeds(a).tolist() == [low[i : i + 41].min() for i in range(151)]
    assert len(substring.window_seeds(a[:49])) == 0 and len(substring.window_seeds(a[:50])) == 1


def test_a_false_path_is_not_removed(spark):
    """Paths are held against their source: one that only claims to be a repeat is dropped."""
    rows = [(1, 10, " ".join(f"a{i}" for i in range(60))), (2, 20, " ".join(f"b{i}" for i in range(60)))]
    suspected = spark.createDataFrame(rows, "d LONG, uid LONG, text STRING")
    claims = spark.createDataFrame([(2, 20, 0, 50, 1, 10, 0)], "d LONG, uid LONG, begin INT, end INT, src_d LONG, src_uid LONG, src_begin INT")
    assert substring.verified(claims, suspected).count() == 0
    true = claims.selectExpr("1L AS d", "10L AS uid", "begin", "end", "src_d", "src_uid", "src_begin")
    assert substring.verified(true, suspected).count() == 1
