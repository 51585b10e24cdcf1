"""Byte-level BPE texts cut into units that can be handled on their own.

The GPT-2 style pattern never lets a match run on past a single space or line feed between two
other characters: a space there opens the next match, a line feed is a match of its own. So a
text without two white-space characters in a row can be cut in front of each space and line
feed, and every unit gives the same matches alone as in its text. Other texts are cut into
their matches. Arrow's kernels cut the texts and find the distinct units of a batch; a unit's
result is kept for the next time it occurs.

Keys: "x" is the unit " x", "\nx" is itself, "\n\nx" the unit "x" (head of a text, or a match).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
matches = regex.compile(PATTERN).findall

_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHITE_RUN = _WHITE + _WHITE
LONGEST_KEPT = 64
_SIGNS = frozenset(".,;:!?)]}%*|")


def unit_of(key: str) -> str:
    return key[2:] if key[:2] == "\n\n" else key if key[:1] == "\n" else " " + key


def matches_of(unit: str) -> list[str]:
    """The pattern's matches; letters, and letters with one ASCII sign at the end, need no pattern."""
    body = unit[1:] if unit[:1] == " " else unit
    if body.isalpha():
        return [unit]
    if body[-1:] in _SIGNS and body[:-1].isalpha():
        return [unit[:-1], body[-1:]]
    return matches(unit)


def keys_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(keys, number of keys of each text taken, order: which text each is)."""
    runs = pc.match_substring_regex(texts, WHITE_RUN).to_numpy(zero_copy_only=False)
    order = np.concatenate([np.flatnonzero(~runs), np.flatnonzero(runs)])
    plain = texts.filter(pa.array(~runs)) if runs.any() else texts
    cut = pc.binary_join_element_wise("\n\n", pc.replace_substring(plain, "\n", " \n"), "")
    lists = pc.split_pattern(cut, " ")
    keys, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if runs.any():
        found = [matches(t) for t in texts.filter(pa.array(runs)).to_pylist()]
        keys = pa.concat_arrays([keys, pa.array(["\n\n" + w for x in found for w in x], keys.type)])
        counts = np.concatenate([counts, [len(x) for x in found]])
    return keys, counts.astype(np.int64), order


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s:s+n] for each (s, n), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(total, dtype=at.dtype)
    return flat[at]


class UnitMemo:
    """Integers for each unit by ``expand`` (keys -> for each key its integers, as bytes of unsigned 32-bit numbers: they
    take little memory and give the garbage collector nothing to follow).

    Kept units: at most ``max_units``; later ones, and those of over 64 characters, are expanded
    anew in each call.
    """

    def __init__(self, expand: Callable[[list[str]], list[bytes]], max_units: int = 300_000):
        self.expand, self.max_units = expand, max_units
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _add(self, keys: list[str]) -> None:
        if not keys:
            return
        found, n = self.expand(keys), len(self.index)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        values = np.frombuffer(b"".join(found), np.uint32)
        self._room("flat", self.used + len(values))
        self._room("start", n + len(keys))
        self._room("length", n + len(keys))
        self.flat[self.used : self.used + len(values)] = values
        self.start[n : n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(keys)] = lengths
        self.used += len(values)
        self.index.update(zip(keys, range(n, n + len(keys))))

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all integers, one text after another; number of integers of each text)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, n_keys, order = keys_of(texts)
        encoded = keys.dictionary_encode()
        distinct = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = list(map(self.index.get, distinct))
        passing: list[str] = []
        if None in at:
            gaps = [i for i, x in enumerate(at) if x is None]
            room = max(0, self.max_units - len(self.index))
            short = [i for i in gaps if len(distinct[i]) <= LONGEST_KEPT]
            kept = short[:room]
            rest = set(gaps).difference(kept)
            self._add([distinct[i] for i in kept])
            used, n = self.used, len(self.index)
            for x, i in enumerate(kept, n - len(kept)):
                at[i] = x
            passing = [distinct[i] for i in gaps if i in rest]
            self._add(passing)
            for x, i in enumerate((i for i in gaps if i in rest), n):
                at[i] = x
        each = np.array(at, np.int64)[encoded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.length[each]
        edges = np.concatenate([[0], np.cumsum(n_keys)])
        values = gather(self.flat, self.start[each], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[edges]
        counts = np.diff(ends)
        if (order[:-1] > order[1:]).any():  # back to the order of the texts
            back = np.argsort(order)
            values, counts = gather(values, ends[:-1][back], counts[back]), counts[back]
        if passing:
            for k in passing:
                del self.index[k]
            self.used = used
        return values, counts
