"""Token counts by rank-synchronous merging.

Distinct pre-tokens of a batch are held as ragged numpy arrays of symbols. In
each step every sequence applies its pair of lowest rank, all sequences at
once, until none has a pair; the surviving symbols are its tokens. A rank
whose merge could make room for a better pair is applied at its leftmost place
only, any other at all its places, so the result is that of a queue of pairs.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens held by a worker, characters of a pre-token beyond which it is merged by itself, rows of a slice.
CACHE, LONG, ROWS = 500_000, 256, 1024
_NONE = np.iinfo(np.int32).max
_SPACE = "▁"
_LOADED: dict[str, Counter] = {}


class _Pairs:
    """(left, right) symbols -> merged symbol, as an open-addressed table in numpy."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, (len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = self._at(keys[todo], step)
            free = self.keys[at] == np.iinfo(np.uint64).max
            at, these = at[free], todo[free]
            self.keys[at] = keys[these]  # of several at one place, the last stays
            self.values[at] = values[these]
            placed = np.zeros(len(keys), bool)
            placed[these[self.keys[at] == keys[these]]] = True
            todo, step = todo[~placed[todo]], step + 1
        self.steps = step

    def _at(self, keys: np.ndarray, step: int) -> np.ndarray:
        h = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(64 - self.bits)) + np.uint64(step)) & np.uint64((1 << self.bits) - 1)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged symbol of each pair, -1 where there is none or a symbol is negative."""
        out = np.full(len(left), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[todo].astype(np.uint64) << np.uint64(32)) | right[todo].astype(np.uint64)
        for step in range(self.steps):
            if not len(todo):
                break
            at = self._at(keys, step)
            held = self.keys[at]
            hit = held == keys
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held != np.iinfo(np.uint64).max)
            todo, keys = todo[on], keys[on]
        return out


class Counter:
    """Counts the tokens of texts as the sentencepiece library does for a BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in normal}
        if any(a != _SPACE and b == _SPACE for p in pieces for a, b in zip(p, p[1:], strict=False)) or any("\n" in p for p in pieces):
            raise ValueError("a piece of the model reaches over a word boundary")
        scores = sorted({sp.get_score(i) for i in normal}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = np.full(sp.get_piece_size(), _NONE, np.int32)
        for i in normal:
            self.rank[i] = place[sp.get_score(i)]
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.pairs: dict[tuple[int, int], int] = {}
        self.careful = np.zeros(len(scores) + 1, bool)
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = i
                    for part in (a, b):  # made by a merge of a worse or equal rank than the pair it makes room for
                        if self.rank[i] <= self.rank[part]:
                            self.careful[self.rank[part]] = True
        self.table = _Pairs(self.pairs)
        self.cache: dict[str, int] = {}

    @staticmethod
    def _bytes(codes: np.ndarray) -> np.ndarray:
        return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)

    def _queue(self, word: str) -> int:
        """One long pre-token, by a queue of pairs."""
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        known = self.symbol[codes]
        sym = known.tolist()
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            m = self.pairs.get((sym[i], sym[j])) if i >= 0 and j < n else None
            if m is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, j, sym[i], sym[j]))

        for i in range(n - 1):
            push(i, i + 1)
        gone = [False] * n
        merges = 0
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if gone[i] or gone[j] or after[i] != j or sym[i] != a or sym[j] != b:
                continue
            sym[i] = self.pairs[a, b]
            gone[j] = True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            merges += 1
            push(before[i], i)
            push(i, after[i])
        return int(np.where(known < 0, self._bytes(codes), 1).sum()) - merges

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbol[codes]
        seq = np.repeat(np.arange(len(words)), lengths)
        cost = np.where(sym < 0, self._bytes(codes), 1)
        total = np.bincount(seq, cost, len(words)).astype(np.int64)
        made = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(seq[:-1] == seq[1:]) if len(seq) else np.zeros(0, np.int64)
        made[inner] = self.table.get(sym[inner], sym[inner + 1])
        while True:
            ranks = np.where(made >= 0, self.rank[made], _NONE)
            if not len(ranks):
                return total
            new = np.concatenate(([True], seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(ranks, np.flatnonzero(new))
            which = np.cumsum(new) - 1
            live = (best < _NONE)[which]
            if not live.all():  # finished sequences leave
                sym, seq, made, ranks, which, new = (x[live] for x in (sym, seq, made, ranks, which, new))
                if not len(sym):
                    return total
            here = ranks == best[which]
            at = np.flatnonzero(here)
            group = seq[at]
            lead = np.concatenate(([True], group[1:] != group[:-1]))
            # of places side by side every second one, from the left; of careful ranks the leftmost place
            run = np.concatenate(([True], (at[1:] != at[:-1] + 1) | lead[1:]))
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            take = ((np.arange(len(at)) - begin) % 2 == 0) & (lead | ~self.careful[ranks[at]])
            at = at[take]
            sym[at] = made[at]
            total -= np.bincount(seq[at], minlength=len(total))
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            position = np.cumsum(stay) - 1
            sym, seq, made = sym[stay], seq[stay], made[stay]
            fresh = position[at]
            fresh = np.unique(np.concatenate((fresh, fresh[fresh > 0] - 1)))
            made[fresh] = -1
            last = fresh[fresh + 1 < len(seq)]
            last = last[seq[last] == seq[last + 1]]
            made[last] = self.table.get(sym[last], sym[last + 1])

    def count(self, texts: list[str]) -> list[int]:
        cut = [_PRE(f"{_SPACE}{t.replace(' ', _SPACE)}") if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = [w for w in set().union(*cut) if w not in self.cache]
        short, long = [w for w in new if len(w) <= LONG], [w for w in new if len(w) > LONG]
        for k in range(0, len(short), 65536):
            some = short[k : k + 65536]
            self.cache.update(zip(some, self.merge(some).tolist(), strict=True))
        self.cache.update((w, self._queue(w)) for w in long)
        get = self.cache.__getitem__
        return [sum(map(get, words)) for words in cut]


#: No piece of a checked model reaches over these boundaries; a line break is always a token of its own.
_PRE = re.compile(f"{_SPACE}+[^{_SPACE}\n]*|[^{_SPACE}\n]+|\n").findall


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row; a null text is empty and has no tokens.

    Repeated rows each give a row, null ids stay null, other columns are not
    read, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(count(part.column(2).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
