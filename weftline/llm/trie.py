"""Similarity self-join of bit codes by a binary trie.

Two nodes of the trie are visited together. Going down one level adds a
differing bit or none, and a pair of nodes is dropped as soon as its errors
exceed what the level allows.

``near_links`` takes codes of up to 64 bits and a small budget. Every code is
entered twice, once as it is and once rotated by half its length: of ``budget``
errors, one of the two halves holds ``budget // 2`` at most, so above the middle
of the code only that many are allowed, and no pair within the budget is lost.
The top of the trie is dealt out over the cluster: a code goes to the pairs of
nodes at a depth that follows the number of codes. Pairs of nodes that still
hold too many codes are dealt out again at a greater depth.

``prefix_links`` takes several codes of a thing, of 128 bits each. Their first
bits must be equal, so a code goes to one node only, whatever the number of
rows; the budget is for the bits below.

A task goes down the subtrees in numpy, with a bounded frontier.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.lineage import cut
from weftline.llm.groups import Forest, links_in_groups, thinned

#: Mean codes below a node at the depth where tasks begin.
NODE_CODES = 512
#: Codes of a pair of nodes beyond which it is dealt out at a greater depth, and of a node of prefix_links beyond which it is split.
TASK_CODES = 65536
#: Levels that are dealt out at once when a pair is too large.
STEP = 6
#: Node pairs that a task holds in one array, and pairs of codes that it compares at once.
FRONTIER, PAIRS = 200_000, 2_000_000
#: A pair of subtrees of so few codes, multiplied, is compared directly.
LEAF = 64


def _zeros(codes: np.ndarray, depth: int) -> np.ndarray:
    bit = (codes >> np.uint64(63 - depth)) & np.uint64(1)
    return np.concatenate(([0], np.cumsum(bit == 0)))


def _all_pairs(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of each al..ah with its bl..bh, PAIRS at a time."""
    rows = np.maximum(1, PAIRS // np.maximum(bh - bl, 1))  # of a, that fit in one piece
    pieces = -(-(ah - al) // rows)
    at = np.repeat(np.arange(len(al)), pieces)
    k = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = al[at] + k * rows[at]
    hi, bl, bh = np.minimum(lo + rows[at], ah[at]), bl[at], bh[at]
    of = np.cumsum((hi - lo) * (bh - bl)) // PAIRS
    for part in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(of)) + 1):
        n, m = hi[part] - lo[part], bh[part] - bl[part]
        own = np.repeat(np.arange(len(part)), n * m)
        k = np.arange(len(own)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        yield lo[part][own] + k // m[own], bl[part][own] + k % m[own]


def close_codes(a: np.ndarray, b: np.ndarray, same: bool, depth: int, errors: int, allowed: Sequence[int], leaf: int = LEAF, more: tuple[np.ndarray, np.ndarray, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (i, j) of all a[i], b[j] that keep within the errors; both sorted, left-aligned uint64.

    All of ``a`` share their first ``depth`` bits, all of ``b`` too, and these
    prefixes differ in ``errors`` bits. same: b is a, and i < j. allowed[d]:
    errors that the first d bits may hold, 0 to 64. more: second words of both,
    and the errors allowed in first and second words together.
    """
    zeros: dict[tuple[int, bool], np.ndarray] = {}

    def split(side: bool, d: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        z = zeros.get((d, side))
        if z is None:
            z = zeros[d, side] = _zeros(b if side else a, d)
        return lo + z[hi] - z[lo]

    # where the errors allowed rise, a direct comparison has to look at the bits above
    rises = [d for d in range(1, 64) if allowed[d] < allowed[d + 1]]
    if not len(a) or not len(b):
        return
    first = np.array
    stack = [(depth, first([0]), first([len(a)]), first([0]), first([len(b)]), first([errors]))]
    while stack:
        d, al, ah, bl, bh, e = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(d, *(x[:half] for x in (al, ah, bl, bh, e))), (d, *(x[half:] for x in (al, ah, bl, bh, e)))]
            continue
        small = ((ah - al) * (bh - bl) <= leaf) | (d == 64)
        if small.any():
            for i, j in _all_pairs(al[small], ah[small], bl[small], bh[small]):
                if same:
                    upper = i < j
                    i, j = i[upper], j[upper]
                x = a[i] ^ b[j]
                ok = np.bitwise_count(x) <= allowed[64]
                i, j, x = i[ok], j[ok], x[ok]
                for k in rises:
                    if k > d and len(i):
                        ok = np.bitwise_count(x >> np.uint64(64 - k)) <= allowed[k]
                        i, j, x = i[ok], j[ok], x[ok]
                if more is not None and len(i):
                    ok = np.bitwise_count(x).astype(np.int64) + np.bitwise_count(more[0][i] ^ more[1][j]) <= more[2]
                    i, j = i[ok], j[ok]
                if len(i):
                    yield i, j
            if small.all():
                continue
            al, ah, bl, bh, e = (x[~small] for x in (al, ah, bl, bh, e))
        am, bm = split(False, d, al, ah), split(not same, d, bl, bh)
        one = same & (al == bl) & (ah == bh)
        parts = []
        for x, (l1, h1) in enumerate(((al, am), (am, ah))):
            for y, (l2, h2) in enumerate(((bl, bm), (bm, bh))):
                err = e + (x != y)
                keep = (h1 > l1) & (h2 > l2) & (err <= allowed[d + 1])
                if (x, y) == (1, 0):
                    keep &= ~one
                parts.append([v[keep] for v in (l1, h1, l2, h2, err)])
        joined = [np.concatenate(v) for v in zip(*parts, strict=True)]
        if len(joined[0]):
            stack.append((d + 1, *joined))


def _join_nodes(frame: pd.DataFrame, depth: int, allowed: Sequence[int]) -> pd.DataFrame:
    """Spanning links of one pair of nodes."""
    lo, hi = (frame[k].to_numpy().view(np.uint64)[0] for k in ("lo", "hi"))
    same, errors = lo == hi, int(lo ^ hi).bit_count()
    code, member = frame["code"].to_numpy().view(np.uint64), frame["id"].to_numpy()
    right = (code >> np.uint64(64 - depth)) != lo
    sides, out_a, out_b = [], [], []
    for side in (~right, right):
        order = np.lexsort((member[side], code[side]))
        c, m = code[side][order], member[side][order]
        new = np.concatenate(([True], c[1:] != c[:-1])) if len(c) else np.zeros(0, bool)
        if same and not new.all():  # equal codes of different members
            out_a.append(m[new][np.cumsum(new) - 1][~new])
            out_b.append(m[~new])
        sides.append((c[new], m[new]))
    (a, am), (b, bm) = (sides[0], sides[0]) if same else sides
    if len(a) and len(b):
        forest = Forest(len(a) if same else len(a) + len(b))
        for i, j in close_codes(a, b, same, depth, errors, allowed):
            forest.add(i, j if same else j + len(a))
        i, j = forest.links()
        ids = am if same else np.concatenate((am, bm))
        out_a.append(ids[i])
        out_b.append(ids[j])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _masks(bits: int, most: int) -> list[tuple[int, int]]:
    return [(sum(1 << x for x in c), k) for k in range(most + 1) for c in combinations(range(bits), k)]


def _deal(rows: DataFrame, step: int, depth: int, allowed: Sequence[int]) -> DataFrame:
    """The rows (tree, code, id, lo, hi) of pairs of nodes at ``depth``, dealt to the pairs ``step`` levels below.

    lo and hi are the prefixes of the two nodes; a row belongs to the one that
    its code begins with, and the errors so far are the bits in which they differ.
    """
    most = allowed[depth + step]
    own = F.shiftrightunsigned(F.shiftleft("code", depth), 64 - step)
    right = F.shiftrightunsigned("code", 64 - depth) != F.col("lo") if depth else F.lit(False)
    masks = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).alias("k")) for m, k in _masks(step, most)))
    out = rows.withColumn("own", own).withColumn("right", right).withColumn("x", F.explode(masks))
    out = out.where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) + F.col("x.k") <= most)
    other = F.col("own").bitwiseXOR(F.col("x.m"))
    lo = F.shiftleft("lo", step).bitwiseOR(F.when(F.col("right"), other).otherwise(F.col("own")))
    hi = F.shiftleft("hi", step).bitwiseOR(F.when(F.col("right"), F.col("own")).otherwise(other))
    # a node meets itself and its partner once: the smaller prefix comes first
    return out.select("tree", "code", "id", lo.alias("lo"), hi.alias("hi")).select("tree", "code", "id", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))


def near_links(codes: DataFrame, bits: int, budget: int, task_codes: int = TASK_CODES, node_codes: int = NODE_CODES) -> DataFrame:
    """(a, b), a < b: links that join all ids whose codes differ in ``budget`` bits or fewer.

    codes: (tree, code, id), all long; code holds ``bits`` bits, left-aligned;
    codes of different trees are not compared. The links of a tree of codes
    span the same components as all pairs within the budget would, and there
    are no more of them than codes in the tasks: pairs of a dense group are
    counted down in the task and not sent on. Ids of equal codes are best joined
    beforehand: they stay together at every depth.
    """
    half = bits // 2
    allowed = [budget // 2 if d <= half else budget for d in range(65)]
    codes = cut(codes.select("tree", "code", "id"))
    most = codes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    keep = -1 if bits == 64 else ((1 << bits) - 1) << (64 - bits)
    keep = keep - (1 << 64) if keep >= 1 << 63 else keep
    turned = F.shiftleft("code", half).bitwiseOR(F.shiftrightunsigned("code", bits - half).bitwiseAND(F.lit(keep)))
    both = codes.select((F.col("tree") * 2).alias("tree"), "code", "id").unionByName(codes.select((F.col("tree") * 2 + 1).alias("tree"), turned.alias("code"), "id"))
    depth = min(half, max(1, (most // node_codes).bit_length()))
    root = both.select("tree", "code", "id", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    rows = _deal(root, depth, 0, allowed)
    key = ["tree", "lo", "hi"]

    def links(dealt: DataFrame, at: int) -> DataFrame:
        return dealt.groupBy(*key).applyInPandas(lambda x: _join_nodes(x, at, allowed), "a long, b long")

    done = []
    while True:
        large = cut(rows.groupBy(*key).count().where(F.col("count") > task_codes).select(*key)) if depth + STEP <= bits else None
        if large is None or large.isEmpty():
            done.append(links(rows, depth))
            break
        done.append(links(rows.join(large, key, "left_anti"), depth))
        rows = cut(_deal(rows.join(large, key, "left_semi"), STEP, depth, allowed))
        depth += STEP
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


#: Codes of a pair of subtrees of prefix_links, multiplied, that are compared directly.
WIDE_LEAF = 4096


def _sorted_codes(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first words, second words, ids, rows of the frame) by code."""
    high, low, ids = frame["high"].to_numpy().view(np.uint64), frame["low"].to_numpy().view(np.uint64), frame["id"].to_numpy()
    order = np.lexsort((ids, low, high))
    return high[order], low[order], ids[order], order


def prefix_links(codes: DataFrame, exact: int, allowed: Sequence[int], total: int, task_codes: int = TASK_CODES) -> DataFrame:
    """(a, b), a < b: links that join all ids of which a code agrees in its first ``exact`` bits and keeps within the errors.

    codes: (tree, high, low, id), all long, a stored table: 128 bits. allowed[d]:
    errors that the first d bits may hold (none in the first ``exact``); total:
    those of both words. A row goes to one node. Small nodes share a task; a node
    beyond ``task_codes`` is split (see ``groups``).
    """
    n = codes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    top = min(exact, max(0, (2 * n // task_codes).bit_length()))
    prefix = lambda d: F.shiftrightunsigned("high", 64 - d) if d else F.lit(0).cast("long")
    rows = codes.select((F.shiftleft("tree", exact) + prefix(exact)).alias("group"), (F.shiftleft("tree", exact) + prefix(top)).alias("whole"), "id", F.lit(1).alias("weight"), "high", "low")

    def within(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        high, low, ids, _ = _sorted_codes(frame)
        new = np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
        at = np.cumsum(new) - 1
        forest = Forest(int(new.sum()))
        for i, j in close_codes(high[new], high[new], True, 0, 0, allowed, WIDE_LEAF, (low[new], low[new], total)):
            forest.add(i, j)
        return forest.stars(ids, at)

    def across(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        a, a_low, a_ids, a_rows = _sorted_codes(x)
        b, b_low, b_ids, b_rows = _sorted_codes(y)
        _, part = np.unique(np.concatenate((x["part"].to_numpy()[a_rows], y["part"].to_numpy()[b_rows])), return_inverse=True)
        forest, ids = Forest(int(part.max()) + 1 if len(part) else 0), [np.zeros(0, np.int64)] * 2
        for i, j in close_codes(a, b, False, 0, 0, allowed, WIDE_LEAF, (a_low, b_low, total)):
            p, q = part[i], part[len(a) + j]
            apart = forest.parent[p] != forest.parent[q]
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            # one pair of rows for each pair of parts
            _, first = np.unique(np.minimum(p, q) * np.int64(len(forest.parent)) + np.maximum(p, q), return_index=True)
            forest.add(p[first], q[first])
            ids = [np.concatenate((ids[0], a_ids[i[first]])), np.concatenate((ids[1], b_ids[j[first]]))]
        return ids[0], ids[1]

    # a dense group has its stars in the nodes of every tree: only what joins something new is handed on
    return thinned(links_in_groups(rows, task_codes, within, across, ["high", "low"], "whole"))
