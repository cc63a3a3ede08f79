"""Quality rules, by built-in functions only: base counts, and divergence from language references.

A reference is the pooled histogram of all documents of one language that pass
the base rules: shares of character classes, and shares of that language's
common words. A document is held against every reference by Jensen-Shannon
distance and keeps the nearest; it is rejected if even that one is too far.
Short documents say too little and are not judged, nor are documents of a
language that has no reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.lineage import cut
from weftline.llm.text import SPACE

# The most common words of running text by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
WORDS = sorted({w for some in COMMON_WORDS.values() for w in some})
CLASSES = ["space", "upper", "digit", "symbol", "mark", "foreign", "lower"]
_MARKS = r"[!\x22'()+,\-./:;=?@\[\\\]^_`{}~]"
_SYMBOLS = r"[#*$%&|<>]"

#: Words below which only the base rules hold.
LEAST_WORDS = 80
#: Distances beyond which a document is rejected: of character classes, of common words.
FAR_CLASSES, FAR_WORDS = 0.25, 0.28
MAX_REPEAT_SHARE, BASE_WORDS = 50, 50


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def features(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The columns of ``docs`` renamed away but for those used: q_* counts per row, in one pass over the texts."""
    rows = docs.withColumn("q_t", _text(text_col)).withColumn("q_w", F.array_remove(F.split("q_t", f"[{SPACE}]+"), ""))
    # a window of three words as one hash; the arrays are zipped, so no lambda looks outside of its own element
    n = F.greatest(F.size("q_w") - 2, F.lit(0))
    three = F.arrays_zip(F.slice("q_w", 1, n), F.slice("q_w", 2, n), F.slice("q_w", 3, n))
    rows = rows.withColumn("q_h", F.transform(three, lambda z: F.xxhash64(z["0"], z["1"], z["2"])))
    rows = rows.withColumn("q_s", F.when(F.size(F.array_distinct("q_h")) < F.size("q_h"), F.array_sort(F.transform("q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("q_s")
    twins = F.zip_with(F.slice("q_s", 1, n - 1), F.slice("q_s", 2, n - 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    rows = rows.withColumn("q_p", F.array_distinct(F.flatten(F.array_compact(twins))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("q_p", lambda i: F.array(i, i + 1, i + 2)))))
    lines = F.filter(F.split("q_t", "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]")))
    joined = F.array_join("q_w", "")
    rows = rows.withColumn("q_l", lines)
    rows = rows.withColumn("q_c", F.concat(F.lit("|"), F.array_join(F.filter(F.split(F.lower("q_t"), f"[{SPACE}]+"), lambda w: w.isin(*WORDS)), "||"), F.lit("|")))
    rows = rows.withColumns({"q_words": F.size("q_w").cast("long"), "q_chars": F.char_length("q_t").cast("long"), "q_word_chars": F.char_length(joined).cast("long"), "q_symbols": F.regexp_count("q_t", F.lit(_SYMBOLS)).cast("long")})
    count = {w: ((F.octet_length("q_c") - F.octet_length(F.replace("q_c", F.lit(f"|{w}|"), F.lit("")))) / (len(w.encode()) + 2)).cast("long") for w in WORDS}
    return rows.withColumns(
        {
            "q_dup_lines": (F.size("q_l") - F.size(F.array_distinct("q_l"))).cast("long"),
            "q_repeat": F.when(F.col("q_s").isNull(), F.lit(0)).otherwise(covered).cast("long"),
            "q_lang": F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string"),
            "c_space": F.col("q_chars") - F.col("q_word_chars"),
            "c_upper": F.regexp_count("q_t", F.lit("[A-Z]")).cast("long"),
            "c_digit": F.regexp_count("q_t", F.lit("[0-9]")).cast("long"),
            "c_symbol": F.col("q_symbols"),
            "c_mark": F.regexp_count("q_t", F.lit(_MARKS)).cast("long"),
            "c_foreign": F.regexp_count("q_t", F.lit(r"[^\x00-\x7F]")).cast("long"),
        }
        | {f"w_{w}": x for w, x in count.items()}
    ).withColumn("c_lower", F.col("q_chars") - sum((F.col(f"c_{k}") for k in CLASSES[:-1]), F.lit(0)))


_KEPT = ["q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat", "q_lang", *(f"c_{k}" for k in CLASSES), *(f"w_{w}" for w in WORDS)]


def base_failed() -> Column:
    return (F.col("q_words") < BASE_WORDS) | (100 * F.col("q_repeat") > MAX_REPEAT_SHARE * F.col("q_words"))


def _shares(counts: list[Column], total: Column) -> Column:
    return F.transform(F.array(*counts), lambda c: F.when(total > 0, c / total).otherwise(F.lit(0.0)))


def _distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, of an array of shares and a reference."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, F.array(*map(F.lit, q)), part), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _word_columns(lang: str) -> list[Column]:
    own = [F.col(f"w_{w}") for w in COMMON_WORDS[lang]]
    return [*own, F.col("q_words") - sum(own, F.lit(0))]


def references(table: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Pooled shares per language over all documents that pass the base rules and are long enough; a row for each of the few languages."""
    # counted where it holds, not filtered: a filter would be moved below the counts and take them anew
    ok = F.coalesce(~base_failed() & (F.col("q_words") >= LEAST_WORDS), F.lit(False))
    sums = [F.sum(F.when(ok, F.col(c)).otherwise(0)).cast("double").alias(c) for c in ("q_words", *(f"c_{k}" for k in CLASSES), *(f"w_{w}" for w in WORDS))]
    found = table.where(F.col("q_lang").isin(*COMMON_WORDS)).groupBy("q_lang").agg(*sums)
    out = {}
    for r in found.collect():
        if not r["q_words"]:
            continue
        chars = sum(r[f"c_{k}"] for k in CLASSES)
        own = [r[f"w_{w}"] for w in COMMON_WORDS[r["q_lang"]]]
        out[r["q_lang"]] = ([r[f"c_{k}"] / chars for k in CLASSES], [x / r["q_words"] for x in [*own, r["q_words"] - sum(own)]])
    return dict(sorted(out.items()))


def judged(table: DataFrame) -> DataFrame:
    """Adds base_failed, class_distance, word_distance (of the nearest reference) and kept."""
    refs = references(table)
    chars = F.col("q_word_chars") + F.col("c_space")
    each = []
    for lang, (classes, words) in refs.items():
        a = _distance(_shares([F.col(f"c_{k}") for k in CLASSES], chars), classes)
        b = _distance(_shares(_word_columns(lang), F.col("q_words")), words)
        each.append(F.struct((a / FAR_CLASSES + b / FAR_WORDS).alias("d"), a.alias("a"), b.alias("b"), F.lit(lang).alias("l")))
    best = F.array_min(F.array(*each)) if each else F.lit(None).cast("struct<d:double,a:double,b:double,l:string>")
    out = table.withColumn("q_best", best).withColumn("base_failed", base_failed())
    far = (F.col("q_best.a") > FAR_CLASSES) | (F.col("q_best.b") > FAR_WORDS)
    silent = (F.col("q_words") < LEAST_WORDS) | F.col("q_best").isNull() | ~F.coalesce(F.col("q_lang").isin(*refs), F.lit(False))
    kept = F.when(F.col("base_failed"), False).when(silent, True).otherwise(~far)
    return out.withColumns({"class_distance": F.col("q_best.a"), "word_distance": F.col("q_best.b"), "kept": kept})


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the two distances) per row.

    A null text has no words and fails the base rules, as an empty one does.
    A document whose language is null or has no reference adds to none and is held
    to the base rules alone. Repeated rows each give a row; null ids stay null; other columns are not read. An empty
    table gives an empty result. If no document passes the base rules there is
    no reference, and the base rules alone decide.
    """
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("q_in"), F.col(lang_col).alias("q_lang_in"))
    table = cut(features(few, "q_in", "q_lang_in").select("doc_id", *_KEPT))
    return judged(table).select(
        "doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeat").alias("n_repeat_words"), "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance")
    )


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are.

    The counts are taken twice, once for the references and once to judge, so no
    text is written on the way. Columns may have any names, those used here
    included. Null and empty texts fail the base rules; else see
    ``quality_rules``. An empty table gives an empty one.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("q_row")
    packed = docs.select(row, F.col(f"`{text_col}`").alias("q_in"), F.col(f"`{lang_col}`").alias("q_lang_in"))
    out = judged(features(packed, "q_in", "q_lang_in").select("q_row", *_KEPT))
    # always true, but not to the optimizer: so the filter stays above the counts, which are taken once
    kept = F.col("kept") & (F.spark_partition_id() >= 0)
    return out.select("q_row", kept.alias("q_kept")).where("q_kept").select("q_row.*")
