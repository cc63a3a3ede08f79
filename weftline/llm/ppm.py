"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts up to five symbols is counted over all training
texts; it is a table of grams (a context and its next symbol), and a shorter
context is the sum of the longer ones that end with it. A context predicts the
symbols that it has seen by their counts, and keeps an escape in proportion to
the number of distinct symbols (method C); an escape goes to the next shorter
context, whose counts then leave out the symbols that the longer one has seen
(exclusion). Below the empty context all 257 symbols (bytes and the end of the
text) are alike.

Every context counts, however many there are. The probabilities of the most
frequent grams, HEAD_GRAMS at most, are a table in the shared folder that each
worker holds; by it a text is scored in numpy. The grams of a text that it does
not hold are counted for each text and meet the others' probabilities in a join,
and those that no training text has go down the contexts in joins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.lineage import cut, new_folder, tidied
from weftline.llm.text import lowered_words, slices

END = 256
#: Symbols of the longest context.
ORDER = 5
#: Grams whose probabilities, and words whose counts, every worker holds.
HEAD_GRAMS, HEAD_WORDS = 1 << 22, 65_536
#: Distinct words, and distinct grams, that a training task holds before it hands on counts; bytes of texts counted at once.
WORDS_HELD, GRAMS_HELD, BYTES_HELD = 250_000, 2_000_000, 4 << 20


def symbols(text: str | None) -> np.ndarray:
    """As many end symbols as a context has, the bytes, one end symbol."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    out = np.full(len(raw) + ORDER + 1, END, np.int64)
    out[ORDER:-1] = raw
    return out


def grams(s: np.ndarray) -> np.ndarray:
    """Every symbol of a text after its context, nine bits each."""
    out = s[: len(s) - ORDER].copy()
    for k in range(1, ORDER + 1):
        out = (out << 9) | s[k : len(s) - ORDER + k]
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of several (keys, counts), by ascending key."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def count_corpus(texts: DataFrame) -> DataFrame:
    """(kind, key, n) over all texts of the one column: kind 0 words by XXH64, kind 1 grams of a context and its next symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[np.ndarray] = []
        merged: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 65536):
                k = keys[at : at + 65536]
                yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at : at + 65536])], names=["kind", "key", "n"])

        def hashed() -> Iterator[pa.RecordBatch]:
            keys = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)
            yield from out(0, keys, np.fromiter(words.values(), np.int64, len(words)))
            words.clear()

        def counted() -> None:
            nonlocal size
            if held:
                merged.append(np.unique(np.concatenate(held), return_counts=True))
                held.clear()
                size = 0
            if len(merged) > 4:
                merged[:] = [_merged(merged)]

        for part in slices(batches):
            for t in part.column(0).to_pylist():
                words.update(lowered_words(t))
                g = grams(symbols(t))
                held.append(g)
                size += len(g)
                if size >= BYTES_HELD:
                    counted()
                    if sum(len(k) for k, _ in merged) > GRAMS_HELD:
                        yield from out(1, *_merged(merged))
                        merged.clear()
            if len(words) > WORDS_HELD:
                yield from hashed()
        yield from hashed()
        counted()
        if merged:
            yield from out(1, *_merged(merged))

    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Head:
    """Log10 probabilities by gram, found by a hash."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.bits = max(1, len(keys).bit_length())
        place = self._place(keys)
        order = np.argsort(place, kind="stable")
        self.keys, self.logs = keys[order], logs[order]
        self.start = np.searchsorted(place[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.start).max(initial=0))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    @classmethod
    def read(cls, folder: str) -> Head:
        where, path = fs.FileSystem.from_uri(folder)
        names = [f.path for f in where.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
        tables = [pq.read_table(n, filesystem=where) for n in names]
        keys, logs = (np.concatenate([t.column(c).to_numpy() for t in tables] or [np.zeros(0)]) for c in ("g", "log"))
        return cls(keys.astype(np.int64), logs.astype(np.float32))

    def parts(self, g: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of the logs of the grams held, and the other grams."""
        if not len(self.keys):
            return 0.0, g
        place = self._place(g)
        at, end = self.start[place], self.start[place + 1]
        left, total = np.flatnonzero(at < end), 0.0
        missed = [np.flatnonzero(at >= end)]
        for step in range(self.longest):
            here = at[left] + step
            hit = self.keys[here] == g[left]
            total += self.logs[here[hit]].sum(dtype=np.float64)
            left, here = left[~hit], here[~hit]
            more = here + 1 < end[left]
            missed.append(left[~more])
            left = left[more]
            if not len(left):
                break
        return total, g[np.concatenate(missed)]


_HEADS: dict[str, Head] = {}


def _head(folder: str) -> Head:
    """The head of this worker; one is held at a time."""
    if folder not in _HEADS:
        _HEADS.clear()
        _HEADS[folder] = Head.read(folder)
    return _HEADS[folder]


def _suffix(g: str, order: int) -> F.Column:
    """The last ``order`` symbols of a gram's context, with its symbol."""
    return F.col(g).bitwiseAND(F.lit((1 << 9 * (order + 1)) - 1))


def gram_logs(counts: DataFrame) -> DataFrame:
    """(g, n, log) of every gram counted: its own context has seen the symbol, so that one tells its probability."""
    seen = counts.where("kind = 1").select(F.col("key").alias("g"), "n")
    contexts = seen.groupBy(F.shiftright("g", 9).alias("c")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return seen.join(contexts, F.shiftright("g", 9) == F.col("c")).select("g", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("log"))


def escaped_logs(grams_counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, log) of each wanted gram that no training text has: from the longest context down until one has seen the symbol.

    wanted: (g), distinct. What a longer context has seen, its suffix has seen too,
    so exclusion takes the suffix's counts of those symbols (``above``) and their
    number (``known``) from its totals. Only the contexts of wanted grams are added up.
    """
    tables = {ORDER: grams_counted.select("g", "n")}
    for order in range(ORDER - 1, -1, -1):
        tables[order] = cut(tables[order + 1].groupBy(_suffix("g", order).alias("g")).agg(F.sum("n").alias("n")))
    state = wanted.select("g", F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("above"), F.lit(0).cast("long").alias("known"))
    done = None
    for order in range(ORDER, -1, -1):
        asked = state.select(F.shiftright(_suffix("g", order), 9).alias("c")).distinct()
        seen = tables[order].join(asked, F.shiftright("g", 9) == F.col("c"), "left_semi")
        if order:
            shorter = tables[order - 1].select(F.col("g").alias("h"), F.col("n").alias("m"))
            seen = seen.join(shorter, _suffix("g", order - 1) == F.col("h")).select("g", "n", "m")
        else:
            seen = seen.withColumn("m", F.lit(0).cast("long"))
        contexts = seen.groupBy(F.shiftright("g", 9).alias("c")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("m").alias("next"))
        own = tables[order].select(F.col("g").alias("h"), "n")
        # contexts of two symbols and fewer, and grams of one: bounded by the alphabet, and frequent keys
        contexts, own = F.broadcast(contexts) if order <= 2 else contexts, F.broadcast(own) if order <= 1 else own
        here = state.join(contexts, F.shiftright(_suffix("g", order), 9) == F.col("c"), "left").join(own, _suffix("g", order) == F.col("h"), "left")
        kinds = F.col("kinds") - F.col("known")
        all_ = F.col("total") - F.col("above") + kinds
        here = cut(
            here.select(
                "g",
                F.when(F.col("n") > 0, F.col("log") + F.log10(F.col("n") / all_)).when(kinds > 0, F.col("log") + F.log10(kinds / all_)).otherwise(F.col("log")).alias("log"),
                F.coalesce("next", F.lit(0)).alias("above"),
                F.coalesce("kinds", F.lit(0)).alias("known"),
                F.col("n").isNotNull().alias("found"),
            )
        )
        found = here.where("found").select("g", "log")
        done = found if done is None else done.unionByName(found)
        state = here.where("not found").drop("found")
    return done.unionByName(state.select("g", (F.col("log") - F.log10(F.greatest(END + 1 - F.col("known"), F.lit(1)))).alias("log")))


def head_grams(logs: DataFrame, most: int) -> DataFrame:
    """(g, log) of the most frequent grams: all that occur so often that there are ``most`` of them or fewer."""
    steps = [1, 2, 3, 4, 6, *(k << s for s in range(3, 40) for k in (1, 2) if s % 2)]
    sizes = logs.agg(*(F.count_if(F.col("n") >= s).alias(f"s{s}") for s in steps)).first()
    least = next((s for s in steps if sizes[f"s{s}"] <= most), None)
    return logs.where(F.col("n") >= least if least else F.lit(False)).select("g", "log")


@tidied
def ppm_scores(docs: DataFrame, folds: int = 5, held_out_fold: int = 1, head: int = HEAD_GRAMS, head_words: int = HEAD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Learns from the rows whose crc32 of the id as text, modulo ``folds``, is not
    ``held_out_fold``, and scores all. score: log10 probability of the bytes of
    the text and its end. base_score: tokens (words with A-Z lowered, and one
    end) by smoothed counts. Null texts are empty. A null id is not held out.
    Repeated rows are each learnt and scored. If there is no text to learn from,
    all symbols are alike and no token is known. Other columns are not read; an
    empty table gives an empty result.

    Words are told apart by their 64-bit hash. Counts of the most frequent words
    go to all tasks, those of the others meet the texts in a join, in which
    no word is frequent. ``head`` says how many grams a worker holds, and changes
    no score.
    """
    spark = docs.sparkSession
    text, doc = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    held_out = F.coalesce(F.crc32(doc.cast("string").cast("binary")) % folds == held_out_fold, F.lit(False))
    counts = cut(count_corpus(docs.where(~held_out).select(text.alias("t"))))
    n_train, word_total, distinct = docs.where(~held_out).count(), *counts.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = word_total + n_train
    size = distinct + (n_train > 0)
    base = total + 0.5 * (size + 1)
    logs = cut(gram_logs(counts))
    folder = new_folder(spark)
    head_grams(logs, head).write.parquet(folder)
    frequent = counts.where("kind = 0").select("key", "n").orderBy(F.desc("n"), "key").limit(head_words).toArrow()
    keys = frequent.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], frequent.column(1).to_numpy().astype(np.int64)[order]))
    end_log, end_known = float(np.log10((n_train + 0.5) / base)), int(n_train > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _head(folder)
        keys, known = shared.value
        word_logs = np.log10((known + 0.5) / base)
        for part in slices(batches):
            texts = part.column(3).to_pylist()
            scores, rest = [], []
            for t in texts:
                s, score, own = symbols(t), 0.0, []
                for at in range(0, len(s) - ORDER, 1 << 20):
                    near, far = held.parts(grams(s[at : at + (1 << 20) + ORDER]))
                    score += near
                    own.append(far)
                scores.append(score)
                rest.append(np.unique(np.concatenate(own), return_counts=True))
            index: dict[bytes, int] = {}
            per = [[index.setdefault(w, len(index)) for w in lowered_words(t)] for t in texts]
            h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in index), np.uint64, len(index))
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            log = np.where(hit, word_logs[at], 0.0) if len(keys) else np.zeros(len(h))
            n, near, sums, tails = [], [], [], []
            for words in per:
                w = np.asarray(words, np.int64)
                in_head = hit[w]
                n.append(len(w) + 1)
                near.append(int(in_head.sum()) + end_known)
                sums.append(float(log[w].sum()) + end_log)
                kinds, times = np.unique(w[~in_head], return_counts=True)
                tails.append((h[kinds].view(np.int64), times))
            lists = []
            for found in (tails, rest):
                ends = pa.array(np.concatenate(([0], np.cumsum([len(k) for k, _ in found]))).astype(np.int32))
                lists += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([k for k, _ in found]))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([m for _, m in found]).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array(near, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores, pa.float64()), *lists], names=["row", "doc_id", "held_out", "n_tokens", "head_known", "head_sum", "score", "h", "times", "g", "g_times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc_id"), held_out.alias("held_out"), text.alias("t"))
    rows = cut(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_sum double, score double, h array<long>, times array<int>, g array<long>, g_times array<int>"))
    tail = rows.select("row", F.explode(F.arrays_zip("h", "times")).alias("x")).select("row", F.col("x.h").alias("key"), F.col("x.times").alias("times"))
    met = tail.join(counts.where("kind = 0").select("key", "n"), "key", "left")
    n = F.coalesce("n", F.lit(0))
    sums = met.groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.log10((n + 0.5) / F.lit(base)) * F.col("times")).alias("rest"))
    deep = rows.select("row", F.explode(F.arrays_zip("g", "g_times")).alias("x")).select("row", F.col("x.g").alias("g"), F.col("x.g_times").alias("times"))
    deep = cut(deep.join(logs.select("g", "log"), "g", "left"))
    unseen = cut(escaped_logs(logs, deep.where("log is null").select("g").distinct()))
    missing = deep.where("log is null").drop("log").join(unseen, "g")
    deeper = deep.where("log is not null").unionByName(missing).groupBy("row").agg(F.sum(F.col("log") * F.col("times")).alias("deep"))
    return (
        rows.drop("h", "times", "g", "g_times")
        .join(sums, "row", "left")
        .join(deeper, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("head_sum") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("deep", F.lit(0.0))).alias("score"),
        )
    )
