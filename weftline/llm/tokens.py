"""Token ids of the tokenizers library, with a cache of pre-tokens.

The library's own result is kept: texts are cut into pre-tokens as the
vocabulary file says, each distinct pre-token is encoded once by the library,
and the ids are put together. Texts with characters outside a plain set, where
two regex engines might cut in two ways, go through the library as a whole.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import pairwise

import numpy as np

#: Pre-tokens in each of the two generations that a worker holds, if nothing else is said: some 80 MB each.
CACHE = 400_000
#: Rows that are encoded at once, and pre-tokens in one string for the library.
ENCODED_ROWS, JOINED = 1024, 100
# Letters, digits and the other characters of plain texts: those on whose classes all Unicode versions agree,
# without combining marks and controls. Within them, the classes of the vocabularies' patterns can be written out.
_LETTERS, _DIGITS, _OTHERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ", "0-9²³¹¼½¾", "!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷–—‘-”…€"
_PLAIN = re.compile(f"[\t\n\r {_LETTERS}{_DIGITS}{_OTHERS}]*+")
_CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
#: The rule that a vocabulary file with word ends must state for its pre-tokens.
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What each kind of vocabulary says of pre-tokens, for plain texts. No alternative can match where an earlier one was left out.
_FIND = {
    "byte_level": re.compile(rf" ?[{_LETTERS}]+|{_CONTRACTIONS}| ?[{_OTHERS}]+| ?[{_DIGITS}]+|\s+(?!\S)|\s+").findall,
    "word_end": re.compile(f"[{_LETTERS}]+|{_CONTRACTIONS}|[{_OTHERS}]+|[{_DIGITS}]").findall,
}
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Encodes batches of texts as uint32 ids, as ``Tokenizer.encode_batch(texts, add_special_tokens=False)`` does."""

    def __init__(self, path: str, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        kinds = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = spec["pre_tokenizer"]
        parts = [p["type"] for p in pre.get("pretokenizers", [])]
        if not kinds and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.kind = "byte_level"
        elif kinds == ["NFC", "Replace", "Lowercase"] and parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"]["Regex"] == _WORD_RULE:
            self.kind = "word_end"
        else:
            self.kind = ""
        self.most = most
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: set[str]) -> None:
        """Fills the cache. Words of letters are encoded many to a string, of which each is a pre-token again."""
        lead = self.kind == "byte_level"
        letters = [w for w in words if (w[0] == " " and w[1:].isalpha() if lead else w.isalpha())]
        rest = list(words.difference(letters))
        self.cache.update(zip(rest, self._whole(rest), strict=True))
        for at in range(0, len(letters), JOINED):  # one string at a time: what the library returns is large
            group = letters[at : at + JOINED]
            e = self.library.encode(("" if lead else " ").join(group), add_special_tokens=False)
            of = np.array(e.word_ids)
            ends = [0, *(4 * (np.flatnonzero(of[1:] != of[:-1]) + 1)).tolist(), 4 * len(of)]
            ids = array("I", e.ids).tobytes()
            self.cache.update(zip(group, (ids[a:b] for a, b in pairwise(ends)), strict=True))

    def words(self, text: str) -> list[str] | None:
        """The pre-tokens of a plain text; None if the library has to see it whole."""
        if not self.kind or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return None
        return _FIND[self.kind](text.lower() if self.kind == "word_end" else text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        cut = [self.words(t) for t in texts]
        rest = iter(self._whole([t for t, words in zip(texts, cut, strict=True) if words is None]))
        need = set().union(*(words for words in cut if words))
        if len(self.cache) > self.most:
            self.cache, self.older = {}, self.cache
        need.difference_update(self.cache)
        if self.older:
            known = need.intersection(self.older)
            self.cache.update((w, self.older[w]) for w in known)
            need -= known
        self._new(need)
        get = self.cache.__getitem__
        return [next(rest) if words is None else b"".join(map(get, words)) for words in cut]


def encoder(path: str, most: int = CACHE) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    _LOADED[path].most = most
    return _LOADED[path]
