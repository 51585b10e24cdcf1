"""Personal data in whole texts, also where it is disguised.

Base spans: the plain patterns of emails, IP addresses, card numbers (Luhn) and phone numbers on the text as it is,
leftmost and without overlap by kind; matches that fail a check are dropped.

Added spans: transducers rewrite the text and keep, for every character of the new text, the source characters it
stands for: look-alike letters, digits and signs to ASCII, invisible characters to nothing; digits spelled as
words to digits (and, as a second form of the text, left as they are); "at" and "dot" in brackets, between spaces, or as words to signs. The same
detectors run on the results, and their spans are mapped back to the source. "at" and "dot" are rewritten only in
whole addresses; every run with a digit word is, as the detectors settle which numbers count. An address
ends in its last label that is a listed one, or any of 2 to 24 letters after a spelled or bracketed dot (not so in
"at the dot matrix"); a full stop with a space after it ends an address that has a spelled dot. A span that lies within another one of its kind adds nothing.

Texts without a trigger (a mapped character, numbers with digit words that are long enough for a detector, a disguised sign) are not rewritten at all. All
steps are linear in the text.

Null text: empty, no span. Null doc_id is kept. Repeated rows: each gets its answer. Empty table: no row. Other
columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ship, texts_of

KINDS = ("email", "ip", "card", "phone")
SLICE_BYTES = 4 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ԛ": "q", "ѡ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ɡ": "g", "ı": "i", "ⅼ": "l",
    "․": ".", "。": ".", "｡": ".", "‚": ",", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "﹢": "+", "﹫": "@",
}
# Characters without a shape of their own, and spaces of other widths.
_INVISIBLE = "­​‌‍⁠﻿"
_SPACES = "              　"
# Digits as words in four languages.
_SPELLED = (
    ("zero", "oh", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "zwo", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
# Last labels that an address may end in where no dot is spelled or in brackets.
_RESERVED = frozenset("example test invalid".split())
_LAST_LABELS = _RESERVED | frozenset(
    "com net org edu gov mil int info biz io co us uk de fr es it eu ch at nl be dev app ca au jp ru cn br pl se ie nz za mx ar cl kr tw hk sg cz dk fi hu pt gr ro tr ua il".split()
)
# Words that make "at the dot matrix" prose, unless a listed label ends it.
_ARTICLES = frozenset("the a an this that each every any some its his her our your their my der die das dem den le la el los las".split())


def _mapped() -> dict[str, str]:
    """Look-alikes, invisible characters, spaces, decimal digits of all scripts, and the full-width and
    mathematical forms of ASCII."""
    table = dict(_LOOK_ALIKES) | dict.fromkeys(_INVISIBLE, "") | dict.fromkeys(_SPACES, " ")
    for code in (*range(0x80, 0x20000), *range(0x1FBF0, 0x1FBFA)):
        c = chr(code)
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            table.setdefault(c, str(digit))
        elif 0xFF01 <= code <= 0xFF5E or 0x1D400 <= code <= 0x1D7FF or 0x24B6 <= code <= 0x24E9:
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                table.setdefault(c, plain)
    return table


_TABLE = _mapped()
_ODD = re.compile("[" + re.escape("".join(_TABLE)) + "]")
_DIGIT_OF = {w: str(d) for d, words in enumerate(_SPELLED) for w in words}
_WORD = "(?:" + "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + ")"
_DIGIT_WORD = re.compile(_WORD)
_ITEM = rf"(?:{_WORD}|[0-9]++)"
_GAP = r"(?:[ ,]{1,2}|-| ?(?:dot|punkt|point|punto|\.) ?)"
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:plus )?{_ITEM}(?:{_GAP}{_ITEM})*(?!\w)", re.I)
_NUMBER = re.compile(rf"(?<!\w){_ITEM}(?:(?:[ ,().-]{{1,4}}| ?(?:dot|punkt|point|punto) ?){_ITEM})*", re.I)
_PIECE = re.compile(rf"(?P<plus>plus )|(?P<word>{_WORD})|(?P<num>[0-9]++)|(?P<dot> ?(?:dot|punkt|point|punto|\.) ?)|(?P<gap>[ ,-]++)", re.I)
_BRACKET_AT = re.compile(r" ?[\[({<] ?(?:at|@|arroba) ?[\])}>] ?", re.I)
_BRACKET_DOT = re.compile(r" ?[\[({<] ?(?:dot|\.|punkt|point|punto) ?[\])}>] ?", re.I)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9]) @ ?(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@ (?=[A-Za-z0-9])")
_AT, _DOT = "\ud800", "\ud801"  # signs in brackets until the words are settled; no UTF-8 text holds lone surrogates
_LABEL = r"[A-Za-z0-9-]{1,63}"
_WORDS = re.compile(
    rf"(?<![\w.%+-])[\w.%+-]{{1,64}}(?P<local>(?: dot [\w%+-]{{1,64}}){{0,5}})(?P<at> at | ?@ ?|{_AT})(?P<label>{_LABEL})(?P<rest>(?:(?: dot | ?\. ?|{_DOT}){_LABEL}){{1,126}})(?!\w)",
    re.I | re.A,
)
_DOT_WORD = re.compile(r" dot | ?\. ?", re.I)
_NEXT = re.compile(rf"(?P<dot> dot | ?\. ?|{_DOT})(?P<label>{_LABEL})", re.I)
_LOOSE_DOT = re.compile(rf"@{_LABEL}(?: \. ?|\. )[A-Za-z0-9]")
_SIGN_FORMS = (_BRACKET_AT, _BRACKET_DOT, _LOOSE_DOT)
_SIGNS = re.compile(f"[{_AT}{_DOT}]")
_DOTS = frozenset(("dot", "punkt", "point", "punto", "arroba"))
_MAPPED = frozenset(_TABLE)
_TRANSLATE = {ord(c): s for c, s in _TABLE.items()}
_APART = {ord(c): " " for c in "-,.;:!?()[]{}<>"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    found = []
    at, past = text.find("@"), 0
    while at >= 0:  # from each @ back over the local part
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            past = domain.end()
            found.append((start, 0, past))
        at = text.find("@", max(at + 1, past))
    if not _ANY_DIGIT.search(text):
        return found
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        begin = m.start()
        for i in range(0, len(parts) - 3, 4):  # four at a time, as leftmost matches take them
            four = parts[i : i + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((begin, 1, end))
            begin = end + 1
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Rewritten:
    """A text and the edits that led to it: ``source(a, b)`` is the source span of its characters."""

    def __init__(self, text: str):
        self.text, self.layers = text, []

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """(begin, end, new string) of the present text, ascending and apart."""
        if not edits:
            return
        out, at, news, olds = [], 0, [], []
        size = 0
        for begin, end, new in edits:
            out += [self.text[at:begin], new]
            size += begin - at
            news.append((size, size + len(new)))
            olds.append((begin, end))
            size += len(new)
            at = end
        out.append(self.text[at:])
        self.text = "".join(out)
        self.layers.append(([n[0] for n in news], news, olds))

    def source(self, begin: int, end: int) -> tuple[int, int]:
        for starts, news, olds in reversed(self.layers):
            begin, end = _back(starts, news, olds, begin, False), _back(starts, news, olds, end - 1, True) + 1
        return begin, end


def _back(starts, news, olds, at: int, last: bool) -> int:
    """The old place of the character at ``at``: its own, or the first or last one of its edit."""
    i = bisect_right(starts, at) - 1
    while i >= 0 and news[i][0] == news[i][1]:  # deletions stand before the character
        if news[i][1] <= at:
            return olds[i][1] + at - news[i][1]
        i -= 1
    if i < 0:
        return at
    if at < news[i][1]:
        return olds[i][1] - 1 if last else olds[i][0]
    return olds[i][1] + at - news[i][1]


def _joins(dot: str, before: str, label: str, spelled: bool) -> bool:
    """Whether an address may go on over ``dot`` from one label to the next; ``spelled``: after a spelled dot."""
    if dot.lower() in (" dot ", ".", _DOT):
        return True
    ended = before.lower() in _LAST_LABELS - _RESERVED
    if spelled:
        return dot[0] == " " and not ended and label in _LAST_LABELS
    return not (dot == ". " and ended and label[0].isupper())  # else a sentence begins


def _end(m: re.Match) -> int | None:
    """The end of the longest address in a match of ``_WORDS``."""
    spelled_at = m["at"].lower() == " at "
    end, spelled, bracket, before = None, False, m["at"] == _AT, m["label"]
    for x in _NEXT.finditer(m.string, *m.span("rest")):
        dot, label = x["dot"], x["label"]
        if not _joins(dot, before, label, spelled):
            break
        spelled |= dot.lower() == " dot " or dot == _DOT
        bracket |= dot == _DOT
        listed = label.lower() in _LAST_LABELS
        free = spelled and label.isalpha() and 2 <= len(label) <= 24
        if spelled_at and not bracket and m["label"].lower() in _ARTICLES:
            free = False
        if (listed or free) and (spelled or not spelled_at):
            end = x.end()
        before = label
    return end


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """The edits that write spelled or spaced addresses with signs."""
    edits, at = [], 0
    while m := _WORDS.search(text, at):
        end = _end(m)
        if end is None:
            at = m.end("at")  # what follows may be a local part
            continue
        found = [(*m.span("at"), "@")]
        for begin, stop in (m.span("local"), (m.start("rest"), end)):
            found += [(x.start(), x.end(), ".") for x in _DOT_WORD.finditer(text, begin, stop) if x.end() - x.start() > 1]
        edits += sorted(e for e in found if text[e[0] : e[1]] not in (e[2], _AT))
        at = end
    return edits


def _may_be_number(text: str) -> bool:
    """Whether numbers with a digit word among them have as many digits or dots as some detector asks for."""
    for m in _NUMBER.finditer(text):
        words = digits = dots = 0
        for p in _PIECE.finditer(m[0]):
            words += p.lastgroup == "word"
            digits += 1 if p.lastgroup == "word" else len(p[0]) if p.lastgroup == "num" else 0
            dots += p.lastgroup == "dot"
        if words and (digits >= 10 or dots >= 3):
            return True
    return False


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """The edits that write runs with a digit word, or with a spelled dot, in digits."""
    new = {"plus": lambda p: "+", "word": lambda p: _DIGIT_OF[p[0].lower()], "dot": lambda p: ".", "gap": lambda p: ""}
    edits = []
    for m in _SPELLED_RUN.finditer(text):
        pieces = list(_PIECE.finditer(text, m.start(), m.end()))
        # numbers that are written as such stay
        if any(p.lastgroup == "word" for p in pieces) or (len(pieces) > 6 and re.search("dot|punkt|point|punto", m[0], re.I)):
            edits += [(p.start(), p.end(), new[p.lastgroup](p)) for p in pieces if p.lastgroup != "num"]
    return edits


def rewrite(text: str) -> list[Rewritten]:
    """The text in plain form, with digit words as they are and as digits; none if nothing in it asks for that."""
    odd = not text.isascii() and not _MAPPED.isdisjoint(set(text))
    low = (text.translate(_TRANSLATE) if odd else text).lower()
    words = low.translate(_APART).split()
    signs = not _DOTS.isdisjoint(words) or " @" in low or "@ " in low or any(x.search(low) for x in _SIGN_FORMS)
    numbers = [w for w in words if w in _DIGIT_OF]
    several = len(numbers) >= 4 and len(set(numbers)) > 1  # an address may hold them too
    spelled = signs or several or (bool(numbers) or _DIGIT_WORD.search(low) is not None) and _may_be_number(low)
    found = []
    for digits in (False, True) if spelled else (False,):
        r = Rewritten(text)
        if odd:
            r.edit([(m.start(), m.end(), _TABLE[m[0]]) for m in _ODD.finditer(text)])
        if digits:
            edits = _numbers(r.text)
            if not edits:
                break  # the same as before
            r.edit(edits)
        if signs:
            for pattern, sign in ((_BRACKET_AT, _AT), (_BRACKET_DOT, _DOT), (_SPACED_AT, "@")):
                r.edit([(m.start(), m.end(), sign) for m in pattern.finditer(r.text)])
            r.edit(_addresses(r.text))
            r.edit([(m.start(), m.end(), "@" if m[0] == _AT else ".") for m in _SIGNS.finditer(r.text)])
        if r.layers:
            found.append(r)
    return found


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans), each as (start, kind, end)."""
    base = detect(text)
    added = set()
    for plain in rewrite(text):
        for begin, kind, end in detect(plain.text):
            a, b = plain.source(begin, end)
            added.add((a, kind, b))
    kept = []
    reach = dict.fromkeys(range(len(KINDS)), 0)  # the furthest end of the wider spans of a kind so far
    for a, _, b, own, kind in sorted([(s, -e, e, False, k) for s, k, e in base] + [(s, -e, e, True, k) for s, k, e in added]):
        if b > reach[kind] and own:
            kept.append((a, kind, b))
        reach[kind] = max(reach[kind], b)
    return base, sorted(kept)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) in code points, end exclusive."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def build(batches):
        for part in chunks(batches, "text", SLICE_BYTES):
            found = [find(t) for t in part.column("text").to_pylist()]
            columns = [pa.array([[(KINDS[k], s, e) for s, k, e in x[i]] for x in found], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "base", "added"])

    spans = "array<struct<kind: string, start: long, end: long>>"
    return texts_of(docs).mapInArrow(build, f"doc_id long, base {spans}, added {spans}")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, n_added, base_sha256, spans (all, written out)."""

    def joined(spans):
        order = F.when(spans["kind"] == "email", 0).when(spans["kind"] == "ip", 1).when(spans["kind"] == "card", 2).otherwise(3)
        return F.struct(spans["start"].alias("s"), order.alias("o"), spans["end"].alias("e"), spans["kind"].alias("k"))

    def text(column):
        sorted_ = F.array_sort(F.transform(column, joined))
        return F.array_join(F.transform(sorted_, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(number(k) for k in KINDS),
        F.size("added").cast("long").alias("n_added"),
        F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text(F.concat("base", "added")).alias("spans"),
    )


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    base, added = find(text)
    out, at = [], 0
    merged: list[list[int]] = []
    for start, kind, end in sorted(base + added):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(end, merged[-1][2])
        else:
            merged.append([start, kind, end])
    for start, kind, end in merged:
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` masked; null texts stay null."""
    ship(docs.sparkSession)

    def build(batches):
        for part in chunks(batches, "text", SLICE_BYTES):
            i = part.schema.get_field_index("text")
            texts = pa.array([t if t is None else masked(t) for t in part.column("text").to_pylist()], part.column("text").type)
            yield part.set_column(i, part.schema.field(i), texts)

    return docs.mapInArrow(build, docs.schema)
