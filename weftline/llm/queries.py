"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe_count, licenses, mixing, packing, ppm, quality, rpforest, simhash, tokenbin, warc
from weftline.llm.text import SPACE
from weftline.tables import load


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(load(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.embedding_near_duplicates(load(spark, sf_dir, "embeddings"), 0.98)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(load(spark, sf_dir, "pages"), 0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(load(spark, sf_dir, "documents"))


def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_scores(load(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(load(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), 4096)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1, 4096)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_file_round_trip(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2)


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.temperature_mix(load(spark, sf_dir, "documents"), max_repetition=2.0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(load(spark, sf_dir, "documents"), 3, 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_embedding_near_dedup, op3_warc, op4_quality_rules, op5_ppm_scores, op6_token_counts, op7_best_fit_packing, op8_token_files, op9_temperature_mixing, op10_simhash)}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op1_sql() -> str:
    canon = f"regexp_replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_text(licenses._COPYRIGHT)}, chr(10), 'g'), {_text(licenses._PUNCTUATION)}, ' ', 'g')"
    for old, new in licenses.SPELLINGS:
        canon = f"replace({canon}, {_text(old)}, {_text(new)})"
    values = lambda known: ", ".join(f"({_text(d)}, {_text(k)})" for d, k in sorted(known.items()))
    return f"""
WITH known(d, license_id) AS (VALUES {values(licenses.known_licenses())}),
notices(d, k) AS (VALUES {values(licenses.known_notices())}),
canon AS (SELECT row_number() OVER () AS r, doc_id, {canon} AS c FROM documents),
lines AS (SELECT r, md5(trim(x, ' ')) AS d FROM (SELECT r, unnest(string_split(c, chr(10))) AS x FROM canon)),
hits AS (SELECT r, count(*) AS n, string_agg(DISTINCT k, ',' ORDER BY k) AS names FROM lines JOIN notices USING (d) GROUP BY r)
SELECT doc_id, md5(w) AS canonical_digest, license_id, coalesce(n, 0)::BIGINT AS n_notices, coalesce(names, '') AS notice_licenses
FROM (SELECT *, trim(regexp_replace(c, '[ \\n]+', ' ', 'g'), ' ') AS w FROM canon) LEFT JOIN known ON known.d = md5(w) LEFT JOIN hits USING (r)"""


_OP2_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.id AS a, b.id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.id <> b.id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(id, m) AS (
  SELECT id, id FROM good UNION SELECT p.a, r.m FROM reach r JOIN pairs p ON p.b = r.id AND r.m < p.a
), comp AS (SELECT id, min(m) AS m FROM reach GROUP BY id), links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN comp ON comp.id = vec_id LEFT JOIN links ON links.a = vec_id"""

_OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS s FROM p),
d AS (SELECT *, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(s || '0', (5 * k // 4 + 1)::BIGINT, 3))::BIGINT) >> (7 - 5 * k % 4)::BIGINT) & 31), 1)), 'string_agg', '') AS payload_digest,
  min(page_id) OVER (PARTITION BY s, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM d"""


def quality_sql(source: str = "documents") -> tuple[str, str]:
    """(CTEs that end in ``judged``: r, base columns, distances and kept per row; name of the source)."""
    q = quality
    inner = f"""
q_rows AS (SELECT row_number() OVER () AS r, * FROM {source}),
q_text AS (SELECT r, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[{SPACE}]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l FROM q_rows),
q_grams AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM q_text)),
q_twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM q_grams) WHERE n > 1),
q_repeat AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM q_twice) GROUP BY r),
q_common AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(string_split_regex(lower(t), '[{SPACE}]+')) AS word FROM q_text) WHERE word IN ({", ".join(map(_text, q.WORDS))}) GROUP BY r, word),
q_words AS (SELECT r, {", ".join(f"coalesce(sum(n) FILTER (word = {_text(w)}), 0)::BIGINT AS {_quoted(w)}" for w in q.WORDS)} FROM q_common GROUP BY r),
q_base AS (SELECT r, lang, len(w)::BIGINT AS n_words, length(t)::BIGINT AS n_chars, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(q_repeat.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS c_upper, length(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT AS c_digit,
  length(regexp_replace(t, {_text(q._MARKS.replace("[", "[^", 1))}, '', 'g'))::BIGINT AS c_mark, length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))::BIGINT AS c_foreign,
  {", ".join(f"coalesce({_quoted(w)}, 0) AS {_quoted(w)}" for w in q.WORDS)}
  FROM q_text LEFT JOIN q_repeat USING (r) LEFT JOIN q_words USING (r)),
q_all AS (SELECT *, n_chars - word_chars AS c_space, n_symbols AS c_symbol, word_chars - c_upper - c_digit - n_symbols - c_mark - c_foreign AS c_lower,
  n_words < {q.BASE_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_SHARE} * n_words AS base_failed FROM q_base)"""
    shares = []
    for lang, words in q.COMMON_WORDS.items():
        own = "[" + ", ".join(f"sum({_quoted(w)})" for w in words) + "]"
        shares.append(
            f"SELECT '{lang}' AS l, list_transform([{', '.join(f'sum(c_{k})' for k in q.CLASSES)}], lambda x: x::DOUBLE / sum(n_chars)::DOUBLE) AS qc, list_transform(list_append({own}, sum(n_words) - list_sum({own})), lambda x: x::DOUBLE / sum(n_words)::DOUBLE) AS qw"
            f" FROM q_all WHERE NOT base_failed AND n_words >= {q.LEAST_WORDS} AND lang = '{lang}' HAVING count(*) > 0"
        )
    each = []
    for lang, words in q.COMMON_WORDS.items():
        own = "[" + ", ".join(_quoted(w) for w in words) + "]"
        each.append(f"SELECT r, n_words, base_failed, '{lang}' AS l, [{', '.join(f'c_{k}' for k in q.CLASSES)}] AS pc, n_chars AS nc, list_append({own}, n_words - list_sum({own})::BIGINT) AS pw FROM q_all")
    half = lambda p, q: f"list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END))"
    return (
        inner
        + f""",
q_refs AS ({" UNION ALL ".join(shares)}),
q_each AS ({" UNION ALL ".join(each)}),
q_far AS (SELECT r, l, sqrt(greatest({half("list_transform(pc, lambda x: CASE WHEN nc > 0 THEN x::DOUBLE / nc ELSE 0.0 END)", "qc")} / 2, 0)) AS a, sqrt(greatest({half("list_transform(pw, lambda x: CASE WHEN n_words > 0 THEN x::DOUBLE / n_words ELSE 0.0 END)", "qw")} / 2, 0)) AS b FROM q_each JOIN q_refs USING (l)),
q_best AS (SELECT r, arg_min(struct_pack(a := a, b := b), struct_pack(d := a / {q.FAR_CLASSES} + b / {q.FAR_WORDS}, a := a, b := b, l := l)) AS z FROM q_far GROUP BY r),
judged AS (SELECT q_all.*, z.a AS class_distance, z.b AS word_distance, CASE WHEN base_failed THEN false WHEN n_words < {q.LEAST_WORDS} OR z IS NULL OR NOT coalesce(lang IN (SELECT l FROM q_refs), false) THEN true ELSE NOT (z.a > {q.FAR_CLASSES} OR z.b > {q.FAR_WORDS}) END AS kept FROM q_all LEFT JOIN q_best USING (r))""",
        "q_rows",
    )


def _quoted(word: str) -> str:
    return f'"w_{word}"'


def _op4_sql() -> str:
    ctes, rows = quality_sql()
    return f"WITH {ctes} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM judged JOIN {rows} USING (r)"


_OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+'))::BIGINT AS n_tokens, coalesce('s' || source, 'null') AS sid, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents),
s AS (SELECT sid, sum(n_tokens)::BIGINT AS n FROM d GROUP BY sid),
t AS (SELECT sum(n)::DOUBLE AS total, max(n)::DOUBLE AS most, min(n)::DOUBLE AS least FROM s WHERE n > 0),
e AS (SELECT *, CASE WHEN most / least <= 2 THEN 0 ELSE ceil((1 - ln(2) / ln(most / least)) * 1e6) / 1e6 END AS a FROM t),
p AS (SELECT s.*, CASE WHEN n > 0 THEN pow(n / total, a) ELSE 0 END AS x, pow(most / total, a) AS top, most FROM s, e),
w AS (SELECT sid, n, x / (SELECT sum(x) FROM p) AS weight, round(CASE WHEN n > 0 THEN x / top * most / n ELSE 1 END, 9) AS repetition, least(ceil(n / {mixing.BLOCK_TOKENS})::BIGINT, {mixing.SOURCE_BLOCKS}) AS blocks FROM p),
plan AS (SELECT *, floor(repetition)::BIGINT AS passes, floor((repetition - floor(repetition)) * n + 0.5)::BIGINT AS part FROM w),
dealt AS (SELECT row_number() OVER () AS r, d.*, plan.* EXCLUDE (sid), ('0x' || substr(md5('mix:' || key), 1, 12))::BIGINT % greatest(blocks, 1) AS block FROM d JOIN plan USING (sid)),
b AS (SELECT *, unnest(range(passes + 1)) AS epoch FROM (SELECT sid, block, sum(n_tokens)::BIGINT AS size, any_value(passes) AS passes, any_value(part) AS part, any_value(n) AS n FROM dealt GROUP BY sid, block)),
o AS (SELECT *, sum(size) OVER (PARTITION BY sid, epoch ORDER BY block % 2, ('0x' || substr(md5('mix:' || sid || ':' || epoch || ':' || block), 1, 12))::BIGINT, block ROWS UNBOUNDED PRECEDING) - size AS first FROM b),
x AS (SELECT dealt.*, epoch, epoch * dealt.n + first + sum(n_tokens) OVER (PARTITION BY dealt.sid, dealt.block, epoch ORDER BY ('0x' || substr(md5('mix:' || key), 1, 12))::BIGINT >> 47, ('0x' || substr(md5('mix:' || epoch || ':' || key), 1, 12))::BIGINT, doc_id NULLS LAST, n_tokens ROWS UNBOUNDED PRECEDING) AS last FROM dealt JOIN o ON o.sid = dealt.sid AND o.block = dealt.block)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, round(repetition, 6) AS repetition, epoch, (last - n_tokens)::BIGINT AS start, round((last - n_tokens) / greatest(passes * n + part, 1), 9) AS position
FROM x WHERE epoch < passes OR (n_tokens > 0 AND last <= passes * n + part)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op2_embedding_near_dedup": _OP2_SQL, "op3_warc": _OP3_SQL, "op4_quality_rules": _op4_sql(), "op9_temperature_mixing": _OP9_SQL}
