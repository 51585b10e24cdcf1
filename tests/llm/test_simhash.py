"""SimHash near-duplicates against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from cohortlens.llm import queries, simhash
from helpers import DOCS, SF, no_docs, odd_docs, odd_texts, rows_of, tuples, words


def brute_print(text, shingle=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    parts = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, near):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def brute(docs, bits=4):
    prints = [brute_print(t) for _, t in docs]
    near = [(a, b) for a, b in combinations(range(len(docs)), 2) if (prints[a] ^ prints[b]).bit_count() <= bits]
    root = roots(len(docs), near)
    least = {}
    for (i, _), r in zip(docs, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(docs, prints, root)), key=repr)


def test_all_documents(spark):
    assert tuples(queries.op3_simhash(spark, SF)) == brute(rows_of())


def test_odd_documents(spark):
    assert tuples(simhash.near_duplicates(odd_docs(spark))) == brute(odd_texts())
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    only_unnamed = [(None, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(only_unnamed, "doc_id LONG, text STRING"))
    assert {r.component_id for r in got.collect()} == {None}


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 5, 6, 7])
def test_position_sets_meet_every_pair(bits):
    sets = simhash.positions(bits)
    for same in combinations(range(8), 8 - bits):
        assert any(set(t) <= set(same) for t in sets)
    assert bits != 4 or len(sets) == 20


def close_prints(seed, n=400, bits=4):
    """Chains and clusters of fingerprints, some at just the distance."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n // 4)}
    while len(out) < n:
        f = rng.choice(sorted(out))
        for b in rng.sample(range(64), rng.randint(1, bits + 1)):
            f ^= 1 << b
        out.add(f)
    return sorted(out)


def same_components(spark, prints, bits, **options):
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp LONG")
    got = dict(tuples(simhash.components(simhash.links(nodes, bits, **options))))
    near = [(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= bits]
    root = roots(len(prints), near)
    mine = {}
    for i, f in enumerate(signed):
        mine.setdefault(got.get(f, f), set()).add(i)
    theirs = {}
    for i, r in enumerate(root):
        theirs.setdefault(r, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("bits", [3, 4])
def test_links_by_lists(spark, bits):
    same_components(spark, close_prints(bits), bits)


def test_links_by_centres(spark):
    same_components(spark, close_prints(9, n=60), 4, longest_list=2)
    same_components(spark, close_prints(8, n=40, bits=3), 3, longest_list=2)


def test_long_chains_end_in_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a LONG, b LONG")
    got = dict(tuples(simhash.components(edges)))
    assert all(got[i] == 0 for i in range(201)) and got[1001] == got[1000] == 1000


def test_forest_of_a_dense_group():
    base = random.Random(5).getrandbits(64)
    prints = np.array(sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}), np.uint64)
    a, b = simhash.forest(prints, 4)
    assert len(a) == len(prints) - 1


def test_one_row_of_each_group_stays(spark):
    kept = simhash.keep_first(odd_docs(spark))
    component = {}
    for (i, t), (j, _, c) in zip(sorted(odd_texts(), key=repr), sorted(((i, f, c) for i, f, c in brute(odd_texts())), key=repr)):
        component[i] = c
    named = {r[2] for r in brute(odd_texts()) if r[2] is not None}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(named)
    assert kept.columns == odd_docs(spark).columns
    alone = spark.createDataFrame([(None, "only here", "en", "s", 1)] * 2 + [(1, "q w e r", "en", "s", 1)], DOCS)
    assert tuples(simhash.keep_first(alone), "doc_id", "text") == sorted([(None, "only here"), (1, "q w e r")], key=repr)
    assert simhash.keep_first(no_docs(spark)).count() == 0


def test_texts_that_share_a_doc_id_are_kept_by_group(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, one), (3, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    assert tuples(simhash.keep_first(docs), "doc_id", "text") == [(1, one), (1, two)]


def test_one_row_of_each_unnamed_group_stays(spark):
    base = [f"w{i}" for i in range(2000)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), "quite another text of some words"]
    docs = spark.createDataFrame([(None, t, "en", "s", 1) for t in texts], DOCS)
    assert simhash.near_duplicates(docs).select("fingerprint").distinct().count() == 3
    kept = [t for _, t in tuples(simhash.keep_first(docs), "doc_id", "text")]
    assert len(kept) == 2 and texts[2] in kept
