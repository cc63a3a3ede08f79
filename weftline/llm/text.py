"""Shared text helpers: words are runs of bytes other than space and \\t \\n \\v \\f \\r, which is bytes.split()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Rows of a slice of an Arrow batch: bounds what a worker holds beside the batch itself.
SLICE_ROWS = 256
#: The word separators as a character class for SQL and Java patterns.
SPACE = r"\x09-\x0D\x20"


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lowered_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lowered; a null text has none."""
    return [] if text is None else text.encode().lower().split()


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """All runs of ``width`` words, repeats included; a shorter text is one run; no words, no runs."""
    if not words:
        return []
    if len(words) <= width:
        return [b" ".join(words)]
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def hashes(runs: list[bytes], seed: int = 42) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in runs), dtype=np.uint64, count=len(runs))
