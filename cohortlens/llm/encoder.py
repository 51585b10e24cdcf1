"""Ids of whole texts by a tokenizer file of the tokenizers library."""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .units import UnitMemo, matches_of, unit_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; kept out of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextEncoder:
    """ids of texts, without special tokens; strings of special tokens are ordinary text.

    A plain byte-level BPE file is run on each new distinct word through the library's model,
    and the ids of units that come again are taken from a bounded memo: at most ``max_kept`` words and half as many
    units, some 150 MB when full. Any other tokenizer encodes the whole texts.
    """

    def __init__(self, path: str, max_kept: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = (
            spec["model"].get("type") == "BPE"
            and not spec["model"].get("dropout")
            and not spec.get("normalizer")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and all(t["special"] for t in spec["added_tokens"])
        )
        self.size = self.tokenizer.get_vocab_size()
        self.max_kept = max_kept
        self.words: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.model = self.tokenizer.model
        self.memo = UnitMemo(self._expand, max_kept // 2)

    def _expand(self, keys: list[str]) -> list[bytes]:
        known, merged, out = self.words.get, self._merged, []
        for k in keys:
            if k.isalpha():  # most units are one word
                w = " " + k
                found = known(w)
                out.append(merged(w) if found is None else found)
                continue
            ids = []
            for w in matches_of(unit_of(k)):
                found = known(w)
                ids.append(merged(w) if found is None else found)
            out.append(ids[0] if len(ids) == 1 else b"".join(ids))
        return out

    def _merged(self, word: str) -> bytes:
        """The ids of a word by the library's model; kept, where there is room."""
        letters = word.encode().decode("latin-1").translate(self.letters)
        found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(self.words) < self.max_kept and len(word) <= 64:
            self.words[word] = found
        return found

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; number of ids of each text)."""
        if self.plain:
            return self.memo.run(texts)
        found = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.array([i for x in found for i in x], np.uint32), counts


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder a process and file: its memo lives on from batch to batch."""
    return TextEncoder(path)
