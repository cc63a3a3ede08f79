"""Mixing of sources to target weights by temperature.

The weight of a source is its share of tokens to the power of an exponent,
normalised. The exponent is bisected: between 1 (natural shares) and 0 (all
sources alike) the entropy of the weights rises and so does the most that a
source is repeated. The weights become budgets of tokens. A source is given out
in permutations of blocks: full passes over all its documents, then the first
blocks of one more permutation, and of the last block the first documents, up
to the budget. Every draw has a place, by which all sources are laid out together.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.lineage import cut
from weftline.llm.text import SPACE

#: Exponents tried in one pass over the sources: six bisections at once.
GRID = 64
PASSES = 6
#: Digits of the exponent that are kept, so that the order of sums does not matter.
DIGITS = 6
#: Tokens of a block, and blocks of a source: beyond that many, its blocks are larger.
BLOCK_TOKENS, SOURCE_BLOCKS = 20_000, 65_536


def _power_sums(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent a: (Z = sum n^a, entropy of n^a / Z, most repeats over those of the largest source)."""
    total = sources.agg(F.sum("n"), F.max("n"), F.min("n")).first()
    if not total[0]:
        return [(0.0, 0.0, 1.0)] * len(exponents)
    x = F.col("n") / F.lit(float(total[0]))
    aggs = []
    for k, a in enumerate(exponents):
        p = F.pow(x, F.lit(a))
        aggs += [F.sum(p).alias(f"z{k}"), F.sum(p * F.log(x) * a).alias(f"s{k}")]
    r = sources.agg(*aggs).first()
    spread = math.log(total[1] / total[2])
    return [(r[f"z{k}"], math.log(r[f"z{k}"]) - r[f"s{k}"] / r[f"z{k}"], math.exp(spread * (1 - a))) for k, a in enumerate(exponents)]


def find_exponent(sources: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None) -> float:
    """The exponent at which the entropy (natural log) reaches its target, or the least one that keeps within the repetition limit; of both, the larger.

    sources: one row per source, tokens in n (positive). Repetition is that of
    the most repeated source over that of the largest. Only sums come to the
    driver, however many sources there are.
    """
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        step = (hi - lo) / GRID
        tried = [lo + step * k for k in range(GRID + 1)]
        # falling in the exponent: too even, or repeated too often
        over = [(target_entropy is not None and h > target_entropy) or (max_repetition is not None and most > max_repetition) for _, h, most in _power_sums(sources, tried)]
        if not over[0]:
            return round(lo, DIGITS)
        k = max(i for i, x in enumerate(over) if x)
        if k == GRID:
            return 1.0
        lo, hi = tried[k], tried[k + 1]
    return round(hi + 0.5 * 10**-DIGITS, DIGITS)


def _hash(seed: str, *parts) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(F.col(x).cast("string") for x in parts))), 1, 12), 16, 10).cast("long")


def _sid(source_col: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("null"))


def _words(text_col: str) -> F.Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def _turn(seed: str) -> F.Column:
    """The order of the rows of a block in an epoch: a row keeps its half of the block."""
    return F.shiftleft(F.shiftright(_hash(seed, "key"), 47), 48) + _hash(seed, "epoch", "key")


def _dealt(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """rows (key, sid and more) with their source's plan, and the block of each."""
    return rows.join(plan, "sid").withColumn("block", F.pmod(_hash(seed, "key"), F.greatest("blocks", F.lit(1))))


def _budgets(rows: DataFrame, target_entropy, max_repetition, budget_tokens, block_tokens: int) -> DataFrame:
    """A row per source: weight, repetition, whole passes, tokens of the broken pass (part), blocks and tokens (n)."""
    all_sources = cut(rows.groupBy("sid").agg(F.sum("n_tokens").alias("n")))
    sources = all_sources.where("n > 0")
    exponent = find_exponent(sources, target_entropy, max_repetition)
    total, most = sources.agg(F.sum("n"), F.max("n")).first()
    total, most = float(total or 1), float(most or 1)
    power = F.pow(F.col("n") / F.lit(total), F.lit(exponent))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    top = (most / total) ** exponent / z
    budget = float(budget_tokens) if budget_tokens is not None else most / top
    weight = F.when(F.col("n") > 0, power / F.lit(z)).otherwise(0.0)
    repetition = F.when(F.col("n") > 0, F.col("weight") * budget / F.col("n")).otherwise(1.0)
    plan = all_sources.withColumn("weight", weight).withColumn("repetition", F.round(repetition, 9)).withColumn("passes", F.floor("repetition"))
    plan = plan.withColumn("blocks", F.least(F.ceil(F.col("n") / F.lit(block_tokens)).cast("long"), F.lit(SOURCE_BLOCKS)))
    return cut(plan.withColumn("part", F.floor((F.col("repetition") - F.col("passes")) * F.col("n") + F.lit(0.5)).cast("long")))


def _permuted(dealt: DataFrame, seed: str) -> DataFrame:
    """(sid, block, epoch, before, broken): the tokens that a source gives out before a block, for each epoch in which the block is drawn; broken: only some of its rows are."""
    blocks = dealt.groupBy("sid", "block").agg(F.sum("n_tokens").alias("size"), *(F.first(c).alias(c) for c in ("passes", "part", "n")))
    # the broken pass is one more permutation; a block keeps its half of the epoch, so its draws lie half an epoch apart
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    order = Window.partitionBy("sid", "epoch").orderBy(F.col("block") % 2, _hash(seed, "sid", "epoch", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("begin", F.sum("size").over(order) - F.col("size"))
    last = F.col("epoch") == F.col("passes")
    broken = last & (F.col("begin") + F.col("size") > F.col("part"))
    return cut(blocks.where(~last | (F.col("begin") < F.col("part"))).select("sid", "block", "epoch", (F.col("epoch") * F.col("n") + F.col("begin")).alias("before"), broken.alias("broken")))


def _draws(dealt: DataFrame, permuted: DataFrame, seed: str) -> DataFrame:
    """dealt with a row per draw: epoch, and the tokens that the source gives out before (start)."""
    names = dealt.columns
    met = dealt.join(permuted, ["sid", "block"]).withColumn("turn", _turn(seed))
    inside = Window.partitionBy("sid", "block", "epoch").orderBy("turn", F.col("doc_id").asc_nulls_last(), "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("end", F.col("before") + F.sum("n_tokens").over(inside))
    whole = (F.col("epoch") < F.col("passes")) | ((F.col("n_tokens") > 0) & (F.col("end") <= F.col("passes") * F.col("n") + F.col("part")))
    return met.where(whole).select(*names, "epoch", (F.col("end") - F.col("n_tokens")).alias("start"))


def temperature_mix(
    docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = 2.0, budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, source, n_tokens, weight, repetition, epoch, start, position) per draw of a row.

    n_tokens counts words. epoch is the pass over the source, start the tokens that
    the source has given out before, position their share of all that it gives
    out: the draws of all sources in order of position are the mixed corpus, with
    the wanted weights in every stretch of it. Every epoch has a permutation of its
    own, in which each block and row keeps its half, so the copies of a row lie
    about half an epoch apart or more. A row that is not drawn at all has null
    in the last three. Without a budget, the largest source is given out once, so
    no document is lost and the others are repeated up to the limit. With one, a
    source may get less than its documents.

    A null source is a source of its own. A row without words has n_tokens 0
    and goes with the full passes of its source only (at least one copy without
    a budget). If no row of any source has words, each row is drawn once. Rows
    with equal ids lie in one block, side by side in no set order; rows with a null
    id are one id. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _words(text_col).alias("n_tokens"), _sid(source_col).alias("sid"))
    rows = cut(rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    plan = _budgets(rows, target_entropy, max_repetition, budget_tokens, block_tokens)
    dealt = _dealt(rows, plan, seed)
    drawn = _draws(dealt, _permuted(dealt, seed), seed)
    given = F.greatest(F.col("passes") * F.col("n") + F.col("part"), F.lit(1))
    few = ["doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), F.round("repetition", 6).alias("repetition")]
    out = drawn.select(*few, "epoch", "start", F.round(F.col("start") / given, 9).alias("position"))
    if budget_tokens is None:
        return out
    some = cut(drawn.select(F.col("key").alias("drawn_key"), F.col("sid").alias("drawn_sid")).distinct())
    missing = dealt.where("passes = 0").join(some, (F.col("sid") == F.col("drawn_sid")) & (F.col("key") == F.col("drawn_key")), "left_anti")
    nothing = F.lit(None)
    return out.unionByName(missing.select(*few, nothing.cast("long").alias("epoch"), nothing.cast("long").alias("start"), nothing.cast("double").alias("position")))


def mix_rows(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = 2.0, budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as drawn and in mixed order, all columns as they are.

    Rows are laid out by the place of their block in its source's permutations and
    by their turn in the block, so the texts are moved once, and never to find
    their draws: blocks are few, and only the rows of a source's one broken block
    are looked up. Columns may have any names, those used here included. Rows with
    one id and source in a broken block are all drawn if one of them is; else see
    ``temperature_mix``: null texts, null ids and sources, ties, repeated rows. An
    empty table gives an empty one.
    """
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("null")).alias("key"), _sid(source_col).alias("sid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), _words(text_col).alias("n_tokens"))
    rows = cut(packed.drop("row"))
    plan = _budgets(rows, target_entropy, max_repetition, budget_tokens, block_tokens)
    dealt = _dealt(rows, plan, seed)
    permuted = _permuted(dealt, seed)
    edge = _draws(dealt, permuted.where("broken"), seed).select("sid", "key", F.lit(True).alias("inside")).distinct()
    met = _dealt(packed, plan, seed).join(permuted, ["sid", "block"])
    met = met.join(cut(edge), ["sid", "key"], "left").where(((F.col("epoch") < F.col("passes")) | (F.col("n_tokens") > 0)) & (~F.col("broken") | F.col("inside")))
    place = F.col("before") / F.greatest(F.col("passes") * F.col("n") + F.col("part"), F.lit(1))
    met = met.select("row", place.alias("place"), _turn(seed).alias("turn"))
    return met.repartitionByRange("place", "turn").sortWithinPartitions("place", "turn").select("row.*")
