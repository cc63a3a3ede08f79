"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def regex_captures(text: Column, pattern: str, groups: int) -> list[Column]:
    """The groups of the first match; null where nothing matches."""
    hit = F.regexp_like(text, F.lit(pattern))
    return [F.when(hit, F.regexp_extract(text, pattern, k)) for k in range(1, groups + 1)]


# complex numbers as struct<re, im>
def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def complex_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def complex_sub(a: Column, b: Column) -> Column:
    return complex_of(a["re"] - b["re"], a["im"] - b["im"])


def complex_mul(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_conj(a: Column) -> Column:
    return complex_of(a["re"], -a["im"])


def complex_scale(a: Column, k: Column) -> Column:
    return complex_of(a["re"] * k, a["im"] * k)


# vectors as sequences of columns
def vector_dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def vector_length(a: Sequence[Column]) -> Column:
    return F.sqrt(vector_dot(a, a))


def vector_cosine(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return vector_dot(a, b) / (vector_length(a) * vector_length(b))


def vector_direction(a: Sequence[Column]) -> list[Column]:
    n = vector_length(a)
    return [x / n for x in a]


def box_contains(lo: Sequence[Column], hi: Sequence[Column], point: Sequence[Column], kind: str = "closed") -> Column:
    """Whether a point lies in a box: closed, half (its end not) or open."""
    out = F.lit(True)
    for a, b, p in zip(lo, hi, point, strict=True):
        low = a < p if kind == "open" else a <= p
        out = out & low & (p <= b if kind == "closed" else p < b)
    return out


def grid_cell(x: Column, origin: float, scale: float) -> Column:
    return F.floor((x - origin) * scale).cast("long")


def torus_hops(a: Sequence[Column], b: Sequence[Column], dims: Sequence[int], torus: Sequence[bool]) -> Column:
    """Hops between two places, around an axis where that is shorter and the axis is closed."""
    out = F.lit(0)
    for x, y, n, closed in zip(a, b, dims, torus, strict=True):
        d = F.abs(x - y)
        out = out + (F.least(d, n - d) if closed else d)
    return out


def color_scale(value: Column, low: float, high: float) -> list[Column]:
    """Red, green and blue of a value on a blue-green-red ramp."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    up, down = F.round(510 * t).cast("int"), F.round(510 * (1 - t)).cast("int")
    return [F.greatest(F.lit(0), up - 255), F.least(F.lit(255), F.least(up, down)), F.greatest(F.lit(0), down - 255)]


POLY = 7


def lfsr_step(k: Column) -> Column:
    """The next of a stream of 64-bit numbers: a shift, and the polynomial where the sign bit was set."""
    return F.shiftleft(k, 1).bitwiseXOR(F.when(k < 0, F.lit(POLY)).otherwise(F.lit(0)).cast("long"))


def lfsr(k: Column, steps: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), k.cast("long"), lambda s, _: lfsr_step(s))


_CRC_POLY = 0x04C11DB7


def msb_crc(data: bytes) -> int:
    """A CRC-32 taken from the highest bit on, without trailing zero bytes.

    The register begins with the complement of the first four bytes; each
    further byte is shifted in from below. Data under four bytes is returned
    as packed bytes.
    """
    if len(data) < 4:
        return int.from_bytes(data, "big")
    r = int.from_bytes(data[:4], "big") ^ 0xFFFFFFFF
    for byte in data[4:]:
        for k in range(7, -1, -1):
            top = r >> 31
            r = ((r << 1) & 0xFFFFFFFF) | (byte >> k & 1)
            if top:
                r ^= _CRC_POLY
    return r ^ 0xFFFFFFFF


@F.pandas_udf(LongType())
def crc_msb_first(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else msb_crc(bytes(b)))
