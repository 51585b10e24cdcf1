"""Language of documents, and of spans in mixed ones.

Model: letter trigrams of words by language, and for each language the share of its letters in each script;
learned from a sample bounded by ``sample_per_language`` documents a language (about that many, by a hash of doc_id;
all, where there are fewer) and the first ``sample_chars`` characters of each. The counts are sums over the sample by language and trigram.

Prediction, of whole texts: the script ranges of a word leave the languages that use its script; each of these
gets the word's trigram score (all of them the same, if none uses the script). Viterbi with a
switching penalty labels the words, many documents at a time; neighbours with one label are a span.
A document's language is the one with most letters (of equals the first in order), not counting words in a script
that no learned language uses. Its score is their share of all letters; where fewer of their trigrams are known from
the language's sample than new text of it has (Good-Turing: all but the share of those met once), it falls in
proportion. So texts in other scripts, and nonsense, score low.

Null text, or no letter: "und" with score 0; so also if there was nothing to learn from. Null doc_id: not held out,
kept. Repeated rows: each gets its answer. Empty table: no row. Other columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ship, texts_of

SLICE_BYTES = 3 << 20
UNKNOWN = "und"
# runs of letters: of the signs that \w takes, those that are no letter (², ½, Ⅷ, ①) are left out by their ranges
_SIGNS = "".join(f"\\U{ord(c):08x}" for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(rf"[^\W\d_{_SIGNS}]+")
LONGEST_KEPT = 64
MAP_LANGUAGES = 500
FOREIGN = -50.0  # a word in a script that the language doesn't use

# First code points of ranges of scripts, and their scripts.
_SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [s for s, _ in _SCRIPTS]


def script_of(letter: str) -> str:
    return _SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def trigrams(word: str) -> list[str]:
    edged = f"<{word}>"
    return [edged[i : i + 3] for i in range(len(edged) - 2)]


@dataclass
class Model:
    languages: list[str]
    row: dict[str, int]  # trigram -> row of scores
    scores: np.ndarray  # log shares; the last row is that of trigrams never seen
    scripts: dict[str, np.ndarray]  # script -> which languages use it
    expected: np.ndarray  # by language, the share of a new text's trigrams that the sample should hold


def held_out(column="doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_per_language: int = 1500, sample_chars: int = 20_000, least_share: float = 0.02) -> Model:
    """From (doc_id, text, lang): rows with null text or lang teach nothing."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring(F.col("text").cast("string"), 1, sample_chars).alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = rows.groupBy("lang").agg((sample_per_language / F.count("*")).alias("share"))
    turn = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)).alias("turn")
    rows = rows.select("lang", "text", turn)
    shares = share.limit(MAP_LANGUAGES + 1).collect()
    if len(shares) <= MAP_LANGUAGES:  # as a map, so that no text is shuffled; with more labels, a join
        known = F.create_map(*(F.lit(x) for r in shares for x in (r["lang"], float(r["share"])))) if shares else None
        sample = rows.where(F.col("turn") < F.element_at(known, F.col("lang"))) if shares else rows.limit(0)
    else:
        sample = rows.join(share, "lang").where(F.col("turn") < F.col("share"))
    sample = sample.select("lang", "text")

    def count(batches):
        for part in chunks(batches, "text", SLICE_BYTES):
            sums: Counter = Counter()
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                for word, n in Counter(_LETTERS.findall(text.lower())).items():
                    for gram in trigrams(word):
                        sums[lang, "gram", gram] += n
                    sums[lang, "script", script_of(word[0])] += n * len(word)
            if sums:
                keys, n = zip(*sums.items())
                columns = [pa.array(c, pa.string()) for c in zip(*keys)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], ["lang", "kind", "name", "n"])

    sums = sample.mapInArrow(count, "lang string, kind string, name string, n long").groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))
    table = sums.toArrow().to_pandas()  # trigrams of a bounded sample
    languages = sorted(table["lang"].unique())
    if not languages:
        return Model([], {}, np.zeros((1, 0)), {}, np.zeros(0))
    at = {lang: i for i, lang in enumerate(languages)}
    grams, used = table[table["kind"] == "gram"], table[table["kind"] == "script"]
    row = {g: i for i, g in enumerate(sorted(grams["name"].unique()))}
    counts = np.full((len(row) + 1, len(languages)), 0.5)
    counts[grams["name"].map(row), grams["lang"].map(at)] += grams["n"]
    scripts: dict[str, np.ndarray] = {}
    letters = used.groupby("lang")["n"].sum()
    for lang, script, n in zip(used["lang"], used["name"], used["n"]):
        scripts.setdefault(script, np.zeros(len(languages), bool))[at[lang]] |= n >= least_share * letters[lang]
    total, once = counts[:-1].sum(axis=0) - 0.5 * len(row), (counts[:-1] == 1.5).sum(axis=0)
    expected = np.maximum(1 - once / np.maximum(total, 1), 1e-9)
    return Model(languages, row, np.log(counts / counts.sum(axis=0)).astype(np.float32), scripts, expected)


class WordScores:
    """Scores and letters of each distinct word, its letters in scripts that some language uses (``own``), and these
    in proportion to its trigrams that each language's sample holds (``seen``); at most ``kept`` words stay for the next call."""

    def __init__(self, model: Model, kept: int = 100_000):
        self.model, self.kept, self.index = model, kept, {}
        self.scores = np.zeros((1 << 12, len(model.languages)), np.float32)
        self.letters, self.own = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.seen = np.zeros(self.scores.shape, np.float32)

    def _score(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scores, letters, own, seen) of the tokens: sums over their runs of letters."""
        model, get, unseen = self.model, self.model.row.get, len(self.model.row)
        total, letters = np.zeros((len(tokens), len(model.languages)), np.float32), np.zeros(len(tokens), np.int64)
        own, seen = np.zeros(len(tokens), np.int64), np.zeros(total.shape, np.float32)
        rows: list[int] = []
        starts, owner, script, sizes = [], [], [], []
        kinds = {name: i for i, (name, use) in enumerate(model.scripts.items()) if use.any()}
        for i, token in enumerate(tokens):
            for word in (token,) if token.isalpha() else _LETTERS.findall(token):
                letters[i] += len(word)
                kind = kinds.get(script_of(word[0]))
                if kind is not None:  # else nobody's script: no evidence
                    starts.append(len(rows))
                    owner.append(i)
                    script.append(kind)
                    sizes.append(len(word))
                    rows += [get(g, unseen) for g in trigrams(word)]
        if starts:
            scores = model.scores[rows]
            sums = np.add.reduceat(scores, starts, axis=0)
            known = np.add.reduceat(scores > model.scores[-1], starts, axis=0, dtype=np.float32)
            use = np.stack(list(model.scripts.values()))[script]
            best = np.where(use, sums, -np.inf).max(axis=1, keepdims=True)
            np.add.at(total, owner, np.where(use, sums - best, FOREIGN).astype(np.float32))
            np.add.at(own, owner, sizes)
            np.add.at(seen, owner, known)  # a word of n letters has n trigrams
        return total, letters, own, seen

    def look_up(self, tokens: list[str]) -> np.ndarray:
        """Rows of ``scores``, ``letters``, ``own`` and ``seen``. Rows of words that are not kept hold until the next call."""
        at = list(map(self.index.get, tokens))
        new = [i for i, found in enumerate(at) if found is None]
        kept = [i for i in new if len(tokens[i]) <= LONGEST_KEPT][: max(0, self.kept - len(self.index))]
        n = len(self.index)
        if n + len(new) > len(self.letters):
            more = n + 2 * len(new) - len(self.letters)
            self.scores = np.concatenate([self.scores, np.zeros((more, self.scores.shape[1]), np.float32)])
            self.seen = np.concatenate([self.seen, np.zeros((more, self.seen.shape[1]), np.float32)])
            self.letters, self.own = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.letters, self.own))
        stays = set(kept)
        order = kept + [i for i in new if i not in stays]
        if order:
            new_rows = slice(n, n + len(order))
            self.scores[new_rows], self.letters[new_rows], self.own[new_rows], self.seen[new_rows] = self._score([tokens[i] for i in order])
        for row, i in enumerate(order, n):
            at[i] = row
        self.index.update((tokens[i], at[i]) for i in kept)
        return np.array(at, np.int64)


def viterbi(scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row, for all documents (rows begins[i] to begins[i] + sizes[i]) at once: step t takes
    the t-th word of every document that has one."""
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    n_langs = scores.shape[1]
    came = np.zeros(scores.shape, np.uint8 if n_langs < 256 else np.uint32)
    live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")  # documents with a t-th word
    best = np.zeros((len(sizes), n_langs), np.float32)
    own = np.arange(n_langs)
    for t, n in enumerate(live.tolist()):
        rows = begins[:n] + t
        if t == 0:
            best[:n] = scores[rows]
            continue
        top = best[:n].argmax(axis=1)
        switched = best[np.arange(n), top][:, None] - penalty
        stay = best[:n] >= switched
        came[rows] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, best[:n], switched) + scores[rows]
    labels = np.zeros(len(scores), np.int64)
    state = best.argmax(axis=1)
    for t in range(len(live) - 1, -1, -1):
        n = int(live[t])
        rows = begins[:n] + t
        labels[rows] = state[:n]
        state[:n] = came[rows, state[:n]] if t else state[:n]
    return labels


@dataclass
class Labelled:
    """Words of some texts with their labels, and each text's language (-1: unknown) and its share."""

    labels: np.ndarray
    doc: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    language: np.ndarray
    share: np.ndarray
    letters: np.ndarray


def classify(texts: pa.Array, words: WordScores, penalty: float) -> Labelled:
    n, width = len(texts), max(1, len(words.model.languages))
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    rows = words.look_up(encoded.dictionary.to_numpy(zero_copy_only=False).tolist())
    rows = rows[encoded.indices.to_numpy(zero_copy_only=False)]
    begins, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(n), sizes)
    labels = viterbi(words.scores[rows], begins, sizes, penalty) if words.model.languages else np.zeros(len(rows), np.int64)
    held = np.bincount(doc * width + labels, weights=words.own[rows], minlength=n * width).reshape(n, width)
    letters, top = np.bincount(doc, weights=words.letters[rows], minlength=n), held.argmax(axis=1)
    known = (letters > 0) & bool(words.model.languages)
    share = np.zeros(n)
    if words.model.languages:
        seen = np.bincount(doc, weights=np.where(labels == top[doc], words.seen[rows, labels], 0), minlength=n)
        share = np.minimum(held[np.arange(n), top], seen / words.model.expected[top]) / np.maximum(letters, 1)
    return Labelled(labels, doc, begins, sizes, np.where(known, top, -1), share, letters)


def spans_of(x: Labelled, languages: list[str]) -> pa.Array:
    """Runs of words with one label, of texts whose language is known."""
    first = np.concatenate([[True], (x.labels[1:] != x.labels[:-1]) | (x.doc[1:] != x.doc[:-1])]) if len(x.doc) else np.zeros(0, bool)
    new = np.flatnonzero(first)
    new = new[x.language[x.doc[new]] >= 0]
    owner = x.doc[new]
    stop = np.minimum(np.append(new[1:], len(x.doc))[: len(new)], (x.begins + x.sizes)[owner])
    columns = [(new - x.begins[owner]).astype(np.int32), (stop - x.begins[owner]).astype(np.int32)]
    values = pa.StructArray.from_arrays([*map(pa.array, columns), pa.array([languages[i] for i in x.labels[new].tolist()], pa.string())], ["begin", "end", "lang"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(x.sizes) + 1)), pa.int32()), values)


def label(docs: DataFrame, model: Model, penalty: float = 8.0) -> DataFrame:
    """doc_id, lang_pred, score, spans: (begin, end, lang) in white-space separated words."""

    def predict(batches):
        words = WordScores(model)
        for part in chunks(batches, "text", SLICE_BYTES):
            x = classify(part.column("text"), words, penalty)
            names = pa.array([model.languages[i] if i >= 0 else UNKNOWN for i in x.language.tolist()], pa.string())
            columns = [part.column("doc_id"), names, pa.array(x.share), spans_of(x, model.languages)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"])

    schema = "doc_id long, lang_pred string, score double, spans array<struct<begin: int, end: int, lang: string>>"
    return texts_of(docs).mapInArrow(predict, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans; learned from the documents that are not held out."""
    found = label(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


def accept(docs: DataFrame, least_score: float = 0.4, penalty: float = 8.0) -> DataFrame:
    """Rows of ``docs`` that have a language: texts without a letter go, and those whose language scores less
    than ``least_score``: other scripts, nonsense, or parts in several languages. Where nothing could be learned, every text with a letter stays."""
    model = learn(docs.where(~held_out()))

    def choose(batches):
        words = WordScores(model)
        for part in chunks(batches, "text", SLICE_BYTES):
            x = classify(part.column("text").fill_null(""), words, penalty)
            good = x.share >= least_score if model.languages else x.letters > 0
            yield part.filter(pa.array(good))

    return docs.mapInArrow(choose, docs.schema)
