"""Language identification: held-out accuracy, mixed texts, odd rows."""

import re
import zlib

import numpy as np
import pytest

from cohortlens.llm import langid, queries
from helpers import DOCS, no_docs, odd_docs, rows_of, with_clashes

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    return langid.learn(docs.where(~langid.held_out()))


def test_accuracy_of_held_out_documents(spark):
    lang = dict(rows_of(columns="doc_id, lang", sf=SF01))
    rows = queries.op9_language(spark, SF01).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_is_labelled_by_span(spark, model):
    by = {}
    for text, lang in rows_of(columns="text, lang", sf=SF01):
        by.setdefault(lang, []).append(text)
    parts = [" ".join(by[x][3].split()[:60]) for x in ("en", "fr", "de")]
    docs = spark.createDataFrame([(1, " ".join(parts))], "doc_id LONG, text STRING")
    row = langid.label(docs, model).first()
    assert [s.lang for s in row.spans] == ["en", "fr", "de"]
    assert [abs(s.begin - 60 * i) <= 4 for i, s in enumerate(row.spans)] == [True] * 3
    assert row.spans[0].begin == 0 and row.spans[-1].end == len(docs.first().text.split())


def test_odd_documents(spark):
    docs = odd_docs(spark)
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    for i in (2, 3, 4):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert rows[0].lang_pred == "en" and rows[None].held_out is False
    assert langid.identify(no_docs(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None, "s", 1), (2, "...", None, "s", 1)], DOCS)
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert [r.doc_id for r in langid.accept(unlabelled).collect()] == [1]
    kept = langid.accept(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    assert not {2, 3, 4} & {r.doc_id for r in kept.collect()}


def plain(text, model, penalty=8.0):
    """(language, share of letters) of a text word by word, from the model's tables."""
    words = [w for w in text.lower().split()]
    n, unseen = len(model.languages), len(model.row)
    rows, letters, own, seen = [], [], [], []
    for word in words:
        total, size, of_scripts, known = np.zeros(n), 0, 0, np.zeros(n)
        runs = re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() or not c.isalnum() else " " for c in word))
        for run in runs:
            size += len(run)
            use = model.scripts.get(langid.script_of(run[0]), np.zeros(n, bool))
            if not use.any():
                continue
            of_scripts += len(run)
            at = [model.row.get(g, unseen) for g in langid.trigrams(run)]
            sums = model.scores[at].astype(float).sum(axis=0)
            known += (model.scores[at] > model.scores[-1]).sum(axis=0)
            total += np.where(use, sums - sums[use].max(), langid.FOREIGN)
        rows.append(total), letters.append(size), own.append(of_scripts), seen.append(known)
    if not sum(letters):
        return "und", 0.0
    best, came = rows[0], []
    for scores in rows[1:]:
        top = int(best.argmax())
        switch = best >= best[top] - penalty
        came.append([i if switch[i] else top for i in range(n)])
        best = np.maximum(best, best[top] - penalty) + scores
    labels = [int(best.argmax())]
    for back in reversed(came):
        labels.insert(0, back[labels[0]])
    held = np.array([sum(o for o, x in zip(own, labels) if x == i) for i in range(n)])
    winner = int(held.argmax())
    known = sum(s[winner] for s, x in zip(seen, labels) if x == winner)
    return model.languages[winner], min(held[winner], known / model.expected[winner]) / sum(letters)


def test_labels_and_scores_equal_a_plain_version(spark, model):
    texts = [t or "" for _, t in rows_of()][:120]
    texts += [a[:400] + " " + b[:300] for a, b in zip(texts[:20], texts[20:40])] + ["", "½", "東京 the and", "qqxz vvkj", "x", "the ² und der die"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.label(docs, model).select("doc_id", "lang_pred", "score").collect()}
    for i, t in enumerate(texts):
        lang, score = plain(t, model)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-6, (i, t[:80])


def test_signs_that_are_no_letters(spark, model):
    signs = ["½ ²", "Ⅷ ① ⅔ ³", "12 34", "٣٤", "_"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(signs)] + [(100, "² the and ½ of")], "doc_id LONG, text STRING")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.label(docs, model).collect()}
    assert all(rows[i] == ("und", 0.0) for i in range(len(signs))) and rows[100][0] == "en"


def test_prediction_ignores_other_columns(spark, model):
    text = rows_of(columns="text", sf=SF01)[5][0]
    a = spark.createDataFrame([(1, text, "en", "a", 1), (2, text, "zz", "b", 9)], DOCS)
    got = {(r.lang_pred, r.score) for r in langid.label(a, model).collect()}
    assert len(got) == 1


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "мир и свет над рекой", "ru", "s", 1) for i in range(40)] + [(100 + i, "light over the river", "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    m = langid.learn(docs)
    got = {r.doc_id: r.lang_pred for r in langid.label(spark.createDataFrame([(1, "ъы щука"), (2, "zqx vvk"), (3, "東京都")], "doc_id LONG, text STRING"), m).collect()}
    assert got[1] == "ru" and got[2] == "en" and got[3] in ("en", "ru")


def test_viterbi_equals_the_plain_recursion():
    rng = np.random.default_rng(8)
    sizes = np.array([5, 0, 1, 9, 3])
    scores = rng.normal(size=(int(sizes.sum()), 3)).astype(np.float32) * 3
    begins = np.cumsum(sizes) - sizes
    labels = langid.viterbi(scores, begins, sizes, 2.0)

    def value(rows, path):
        return sum(rows[t, s] for t, s in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))

    from itertools import product
    for b, n in zip(begins, sizes):
        if n:
            rows = scores[b : b + n]
            best = max(value(rows, p) for p in product(range(3), repeat=int(n)))
            assert abs(value(rows, labels[b : b + n].tolist()) - best) < 1e-4


def test_other_scripts_and_nonsense_are_rejected(spark, model):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rng = np.random.default_rng(5)
    nonsense = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxzaeiou"), 7)) for _ in range(60)) for _ in range(5)]
    odd = ["東京都は日本の首都です " * 10, "мир и свет над рекой " * 10, "東京都 " * 40 + docs.first().text[:20], *nonsense]
    mixed = docs.unionByName(spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(odd)], docs.schema))
    scores = {r.doc_id: r.score for r in langid.label(mixed, model).collect()}
    assert all(scores[10**9 + i] < 0.4 for i in range(len(odd))), [scores[10**9 + i] for i in range(len(odd))]
    kept = {r.doc_id for r in langid.accept(mixed).select("doc_id").collect()}
    assert not kept & {10**9 + i for i in range(len(odd))}
    clean = {i for i, t in rows_of(sf=SF01) if t and sum(c.isalpha() for c in t) >= 0.5 * len(t)}
    assert len(clean) > 900 and clean <= kept


def test_languages_of_long_documents_are_learned(spark):
    rows = [(i, "light over the river " * 2_000, "en", "s", 1) for i in range(5)] + [(100 + i, "licht ueber dem fluss", "de", "s", 1) for i in range(5)]
    m = langid.learn(spark.createDataFrame(rows, DOCS))
    assert m.languages == ["de", "en"]
    got = langid.label(spark.createDataFrame([(1, "over the light river")], "doc_id LONG, text STRING"), m).first()
    assert got.lang_pred == "en"
