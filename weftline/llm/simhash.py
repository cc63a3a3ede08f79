"""SimHash fingerprints of word shingles, and near-duplicate groups of them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.components import connected_components
from weftline.lineage import cut, tidied
from weftline.llm.groups import Forest, links_in_groups
from weftline.llm.text import hashes, lowered_words, shingles, slices
from weftline.llm.trie import TASK_CODES, near_links, prefix_links

#: Exact bits of a code at least, and texts that agree in them by chance from which on more bits are taken.
LEAST_EXACT, NODE_TEXTS = 12, 4096
#: Shingles that one task compares.
TASK_SHINGLES = 1 << 20
_ONES = np.uint64(0x0101010101010101)
_BLOCK = 255  # rows whose bits add up in a byte


def bit_counts(words: np.ndarray) -> np.ndarray:
    """(rows, k) uint64 -> for each of k words, how many rows have each of its 64 bits set, lowest bit first."""
    starts = np.arange(0, len(words), _BLOCK)
    out = np.zeros((words.shape[1], 64), np.int64)
    for shift in range(8):
        lanes = np.add.reduceat((words >> np.uint64(shift)) & _ONES, starts, axis=0)
        out[:, shift::8] = np.ascontiguousarray(lanes).view(np.uint8).reshape(len(starts), words.shape[1], 8).sum(axis=0, dtype=np.int64)
    return out


def _words_of_bits(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").reshape(*bits.shape[:-1], 8).view("<u8")[..., 0]


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """k further 64-bit words of each hash (its own, mixed with k odd constants)."""
    step = np.uint64(0x9E3779B97F4A7C15)
    x = h[:, None] + np.arange(1, k + 1, dtype=np.uint64)[None, :] * step
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingle_hashes(text: str | None, width: int, block: int = 65536) -> Iterator[np.ndarray]:
    """The XXH64 hashes (seed 42) of a text's shingles, repeats included, in blocks."""
    words = lowered_words(text)
    n = max(0, len(words) - width + 1) or bool(words)
    for at in range(0, n, block):
        yield hashes(shingles(words[at : min(at + block, n) + width - 1], width))


def _majority(parts: Iterable[np.ndarray], extra_words: int = 0) -> np.ndarray:
    """Words of which a bit is 1 if set in over half the hashes: of the hashes themselves, or so many words of further hashes. No hashes: all zero."""
    total, n = np.zeros((extra_words or 1, 64), np.int64), 0
    for h in parts:
        n += len(h)
        total += bit_counts(_spread(h, extra_words) if extra_words else h[:, None])
    return _words_of_bits(2 * total > n)


def fingerprint(text: str | None, width: int, block: int = 65536) -> np.ndarray:
    """The SimHash of a text's shingles, repeats counted; long texts are taken in blocks of shingles."""
    return _majority(_shingle_hashes(text, width, block))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as ascending hashes."""
    parts = list(_shingle_hashes(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def sketch(distinct: np.ndarray, words: int, block: int = 16384) -> np.ndarray:
    """So many SimHash words of a set of hashes; their differing bits follow the similarity of the sets."""
    return _majority((distinct[at : at + block] for at in range(0, len(distinct), block)), words)


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit SimHash of each row as a signed long. Null and empty texts: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = [fingerprint(t, width)[0] for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, fp long")


def simhash_components(docs: DataFrame, width: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: fingerprints link at ``budget`` or fewer differing bits.

    component_id is the smallest id reachable, the row's own included. Null or
    empty texts have fingerprint zero and link like others. Rows with equal
    fingerprints are one node of the join, so copies cost nothing; repeated
    rows each give a row. Rows with a null id keep their fingerprint and get
    the component of the ids that share it (null if there are none). An empty
    table gives an empty result. Other columns of ``docs`` are not read.
    """
    fps = cut(fingerprints(docs, width, id_col, text_col))
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("id")).where("id is not null"))
    links = near_links(classes.select(F.lit(0).cast("long").alias("tree"), F.col("fp").alias("code"), "id"), 64, budget)
    found = connected_components(links)
    labels = classes.join(found, classes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    labels = cut(labels)
    return fps.join(labels, "fp", "left").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def expected_difference(similarity: float) -> float:
    """Share of differing bits between SimHashes of two sets of a Jaccard similarity: angle / pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@dataclass(frozen=True)
class Plan:
    """Codes of 128 bits: ``exact`` bits of their own, and as many of one shared sketch as are left."""

    exact: int
    tables: int
    allowed: tuple[int, ...]
    total: int

    @property
    def words(self) -> int:
        return -(-(self.tables * self.exact + 128 - self.exact) // 64)


def plan_codes(n: int, similarity: float, recall: float = 0.99) -> Plan:
    """The codes by which n texts are joined.

    A code leads to one node by its exact bits: NODE_TEXTS texts by chance, if
    there are many texts, fewer otherwise. So many tables are taken that a pair at
    the threshold agrees in the exact bits of one of them with probability
    ``recall``. Below, differing bits may exceed what is expected at the threshold
    by four deviations on the way and by three in all 128 bits.
    """
    p = expected_difference(similarity)
    exact = max(LEAST_EXACT, (n // NODE_TEXTS).bit_length())
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - p) ** exact))

    def most(bits: int, deviations: float) -> int:
        return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))

    allowed = tuple(0 if d <= exact else most(d - exact, 4.0) for d in range(65))
    return Plan(exact, tables, allowed, most(128 - exact, 3.0))


def _code_words(words: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(first words of a text's codes, one for each table; the second word, that of all)."""
    bits = np.unpackbits(words.view(np.uint8), bitorder="little")
    own, shared = bits[: plan.tables * plan.exact].reshape(plan.tables, plan.exact), bits[plan.tables * plan.exact :][: 128 - plan.exact]
    high = np.hstack((own, np.broadcast_to(shared[: 64 - plan.exact], (plan.tables, 64 - plan.exact))))
    pack = lambda x: np.packbits(x, axis=-1).view(">u8").astype(np.uint64)
    return pack(high)[:, 0], pack(shared[64 - plan.exact :])


class _Index:
    """Which of some sets hold a shingle; tells the similarity of a set to all of them exactly."""

    def __init__(self, sets: list[np.ndarray], rows: np.ndarray):
        self.rows, self.size = rows, np.array([len(sets[r]) for r in rows], np.int64)
        flat, of = np.concatenate([sets[r] for r in rows]), np.repeat(np.arange(len(rows)), self.size)
        order = np.argsort(flat, kind="stable")
        flat, self.of = flat[order], of[order]
        new = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
        self.keys, self.start = flat[new], np.concatenate((new, [len(flat)]))

    def alike(self, own: np.ndarray, similarity: float) -> np.ndarray:
        """Positions in ``rows`` of the sets with the similarity or more; an empty set has no partners."""
        at = np.searchsorted(self.keys, own)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == own)] if len(self.keys) else at[:0]
        first, n = self.start[at], self.start[at + 1] - self.start[at]
        common = np.zeros(len(self.rows), np.int64)
        for lo in range(0, len(at), 4096):
            f, m = first[lo : lo + 4096], n[lo : lo + 4096]
            place = np.repeat(f - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
            common += np.bincount(self.of[place], minlength=len(self.rows))
        return np.flatnonzero((common > 0) & (common / np.maximum(len(own) + self.size - common, 1) >= similarity))


def spanning_within(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links (i, j) that span the components of all pairs of sets with the similarity or more: a search that meets every set once."""
    left = np.ones(len(sets), bool)
    index = _Index(sets, np.arange(len(sets)))
    out_i, out_j = [], []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        stack = [seed]
        while stack:
            i = stack.pop()
            found = index.rows[index.alike(sets[i], similarity)]
            found = found[left[found]]
            left[found] = False
            out_i += [i] * len(found)
            out_j += found.tolist()
            stack += found.tolist()
            if (n := int(left.sum())) < len(index.rows) // 2:  # sets that are reached need not be found again
                if not n:
                    return out_i, out_j
                index = _Index(sets, np.flatnonzero(left))
    return out_i, out_j


def spanning_across(x: list[np.ndarray], y: list[np.ndarray], x_parts: np.ndarray, y_parts: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links (i of x, j of y) that join the parts as all pairs of similar sets of different parts would."""
    _, part = np.unique(np.concatenate((x_parts, y_parts)), return_inverse=True)
    forest, index = Forest(int(part.max()) + 1 if len(part) else 0), _Index(y, np.arange(len(y)))
    out_i, out_j = [], []
    for i, own in enumerate(x):
        found = index.alike(own, similarity)
        q = part[len(x) + found]
        apart = forest.parent[q] != forest.parent[part[i]]
        q, first = np.unique(q[apart], return_index=True)
        forest.add(np.full(len(q), part[i]), q)
        out_i += [i] * len(q)
        out_j += found[apart][first].tolist()
    return out_i, out_j


@tidied
def simhash_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", task_codes: int = TASK_CODES, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """(id, component_id) per distinct id: groups of texts whose sets of shingles have the Jaccard similarity or more.

    Texts with equal sets of shingles (words with A-Z lowered) are one class. Each
    class gets several SimHash codes; those that meet in the trie join are
    candidates. The candidates' components are then compared exactly on whole sets
    of shingles: every pair of a component, not only the candidates, but for pairs
    that are joined already. So a link is lost only if its ends lie in no common
    component of candidates. The angle formula holds for large sets: of sets below
    some ten shingles, pairs at the threshold are missed more often (7 in 100).

    Null texts and such without words are one class. Repeated rows of an id count
    once; an id with several texts stands for all of them. Null ids are left out.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null")
    plan = plan_codes(rows.count(), similarity)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            digests, highs, lows = [], [], []
            for t in part.column(1).to_pylist():
                own = shingle_set(t, width)
                high, low = _code_words(sketch(own, plan.words), plan)
                digests.append(hashlib.md5(own.tobytes()).digest())
                highs.append(high.view(np.int64))
                lows.append(low.view(np.int64)[0])
            ends = pa.array(np.arange(len(highs) + 1, dtype=np.int32) * plan.tables)
            yield pa.record_batch([part.column(0), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(highs) if highs else np.zeros(0, np.int64))), pa.array(lows, pa.int64())], names=["id", "d", "high", "low"])

    coded = cut(rows.mapInArrow(codes, "id long, d binary, high array<long>, low long"))
    classes = cut(coded.groupBy("d").agg(F.min("id").alias("head"), F.first("high").alias("high"), F.first("low").alias("low")))
    spread = classes.select(F.col("head").alias("id"), "low", F.posexplode("high").alias("tree", "high")).select(F.col("tree").cast("long").alias("tree"), "high", "low", "id")
    found = connected_components(prefix_links(spread, plan.exact, plan.allowed, plan.total, task_codes))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [shingle_set(t, width).view(np.int64) for t in part.column(2).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(1), pa.array([len(x) + 16 for x in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["group", "id", "weight", "shingles"])

    members = cut(found.select(F.col("component").alias("group"), F.col("node").alias("id")))
    fetched = cut(rows.join(members, "id").select("group", "id", "t").mapInArrow(sets, "group long, id long, weight long, shingles array<long>"))

    def within(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids = frame["id"].to_numpy()
        i, j = spanning_within([np.asarray(x).view(np.uint64) for x in frame["shingles"]], similarity)
        return ids[i], ids[j]

    def across(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        i, j = spanning_across(*([np.asarray(v).view(np.uint64) for v in f["shingles"]] for f in (x, y)), x["part"].to_numpy(), y["part"].to_numpy(), similarity)
        return x["id"].to_numpy()[i], y["id"].to_numpy()[j]

    # small components share a task: what is compared across them is compared exactly too
    tasks = 1 + 2 * (fetched.agg(F.sum("weight")).first()[0] or 0) // task_shingles
    fetched = fetched.withColumn("whole", F.pmod(F.xxhash64("group"), F.lit(tasks)))
    joined = connected_components(links_in_groups(fetched, task_shingles, within, across, ["shingles"], "whole"))
    labels = cut(classes.join(joined, classes["head"] == joined["node"], "left").select("d", F.coalesce("component", "head").alias("component_id")))
    return coded.select("id", "d").join(labels, "d").groupBy("id").agg(F.min("component_id").alias("component_id"))
