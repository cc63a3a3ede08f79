"""Queries of the built-in, sparse and custom reductions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from weftline.operators import reduce as R
from weftline.operators import select as S
from weftline.tables import load


def _line(spark, sf_dir):
    return load(spark, sf_dir, "lineitem")


def reduce_tuple(spark, sf_dir):
    """Several reductions of one pass, with count, mean and sample deviation."""
    q = F.col("l_quantity")
    return _line(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.sum(q), 4).alias("sum_qty"), F.min(q).alias("min_qty"), F.max(q).alias("max_qty"), F.count("*").alias("n"), F.round(F.avg(q), 8).alias("mean_qty"), F.round(F.stddev_samp(q), 8).alias("sd_qty"))


def reduce_sum(spark, sf_dir):
    """Sums of integer and floating types."""
    d = _line(spark, sf_dir).withColumn("small", F.col("l_linenumber").cast("smallint")).withColumn("real", F.col("l_quantity").cast("float"))
    return R.reduce_by(d, ["l_returnflag"], sum_int=("sum", "l_linenumber"), sum_short=("sum", "small"), sum_long=("sum", "l_orderkey"), sum_float=("sum", "real"), sum_double=("sum", "l_quantity"))


def reduce_product(spark, sf_dir):
    d = _line(spark, sf_dir).withColumn("f", F.col("l_linenumber").cast("double"))
    return R.reduce_by(d, ["l_orderkey"], product_line=("product", "f"))


def reduce_extremes(spark, sf_dir):
    return R.reduce_by(_line(spark, sf_dir), ["l_returnflag", "l_linestatus"], max_price=("max", "l_extendedprice"), min_price=("min", "l_extendedprice"), max_key=("max", "l_orderkey"), min_key=("min", "l_orderkey"))


def reduce_logical(spark, sf_dir):
    d = _line(spark, sf_dir).withColumn("x", (F.col("l_linenumber") % 3).cast("int"))
    return R.reduce_by(d, ["l_orderkey"], all_true=("logical_and", "x"), any_true=("logical_or", "x"), odd_true=("logical_xor", "x"))


def reduce_bitvec(spark, sf_dir):
    return R.reduce_by(_line(spark, sf_dir), ["l_suppkey"], and_key=("bitvec_and", "l_orderkey"), or_key=("bitvec_or", "l_orderkey"), xor_key=("bitvec_xor", "l_orderkey"))


def reduce_random(spark, sf_dir):
    """Any member of a group: whichever it is, the group has it."""
    some = R.reduce_by(_line(spark, sf_dir), ["l_returnflag"], some_key=("random", "l_orderkey"))
    own = _line(spark, sf_dir).select("l_returnflag", F.col("l_orderkey").alias("some_key")).distinct().withColumn("found", F.lit(True))
    return some.join(own, ["l_returnflag", "some_key"], "left").select("l_returnflag", F.coalesce("found", F.lit(False)).alias("is_member"))


def reduce_nop(spark, sf_dir):
    """A barrier without a payload: one row once all rows have arrived."""
    return _line(spark, sf_dir).agg((F.count("*") > 0).alias("arrived"))


def reduce_concat(spark, sf_dir):
    """Contributions appended; sorted, as their order is not defined."""
    d = _line(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("v"))
    return d.select("l_orderkey", F.array_join(F.col("v").cast("array<string>"), ",").alias("parts"))


def reduce_set(spark, sf_dir):
    """A bag of contributions that keeps each with its size."""
    d = _line(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.array("l_partkey", "l_suppkey")).alias("bag"))
    return d.select("l_orderkey", F.size("bag").cast("long").alias("members"), F.aggregate("bag", F.lit(0).cast("long"), lambda s, x: s + F.size(x)).alias("items"))


def reduce_statistics(spark, sf_dir):
    d = load(spark, sf_dir, "events").groupBy("event_type").agg(*R.statistics(F.col("value")))
    return d.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "var", "sd", "lo", "hi", "rms")))


def _log_sum(x: pd.Series) -> float:
    import numpy as np

    return float(np.log1p(x.abs()).sum())


def reduce_custom(spark, sf_dir):
    """A reducer in Python that is streamable: parts are reduced, then merged."""
    d = load(spark, sf_dir, "events")
    return R.custom_reduce(d, ["event_type"], "value", _log_sum, merge=lambda x: float(x.sum())).select("event_type", F.round("v", 6).alias("log_sum"))


def reduce_python(spark, sf_dir):
    """A reducer in Python over whole groups (one order each)."""
    d = _line(spark, sf_dir)
    return R.custom_reduce(d, ["l_orderkey"], "l_quantity", lambda x: float(x.max() - x.min()), out="spread")


def reduce_vector(spark, sf_dir):
    """Element-wise sums of two-field vectors."""
    d = _line(spark, sf_dir).select("l_returnflag", F.array(F.lit(1).cast("double"), F.col("l_quantity"), F.col("l_discount") * 100).alias("vec"))
    return R.vector_reduce(d, ["l_returnflag"], "vec", "sum").select("l_returnflag", F.col("pos").cast("long").alias("pos"), F.round("v", 3).alias("v"))


def reduce_barrier(spark, sf_dir):
    d = _line(spark, sf_dir).groupBy(F.pmod("l_orderkey", F.lit(16)).alias("pe")).agg(F.count("*").alias("n"))
    return d.agg(F.count("*").alias("arrived"), F.sum("n").alias("n"))


def reduce_struct(spark, sf_dir):
    """A struct merged field by field: pair sums (x, -2x)."""
    x = F.pmod("l_orderkey", F.lit(64)) + 1
    d = _line(spark, sf_dir).select(F.struct(x.alias("a"), (-2 * x).alias("b")).alias("s"))
    return d.agg(F.sum("s.a").alias("sum_a"), F.sum("s.b").alias("sum_b"))


def reduce_ccs_merge(spark, sf_dir):
    """Replies of parts merged again: a reduction of partial reductions."""
    part = F.pmod("l_orderkey", F.lit(8))
    local = _line(spark, sf_dir).groupBy("l_linestatus", part.alias("pe")).agg(F.sum("l_linenumber").alias("s"), F.max("l_quantity").alias("m"), F.min("l_quantity").alias("i"), F.bit_or("l_partkey").alias("o"), F.bit_and("l_partkey").alias("a"), F.bool_and(F.col("l_tax") > 0).alias("t"), F.bool_or(F.col("l_tax") > 0.07).alias("u"))
    return local.groupBy("l_linestatus").agg(F.sum("s").alias("sum_line"), F.max("m").alias("max_qty"), F.min("i").alias("min_qty"), F.bit_or("o").alias("or_part"), F.bit_and("a").alias("and_part"), F.bool_and("t").alias("all_taxed"), F.bool_or("u").alias("any_high"))


def reduce_cache_stats(spark, sf_dir):
    """Sums, and the largest with its owner."""
    d = _line(spark, sf_dir).groupBy("l_suppkey").agg(F.count("*").alias("hits"), F.sum(F.col("l_quantity").cast("long")).alias("data"))
    best = R.max_loc(F.col("data"), F.col("l_suppkey"))
    return d.agg(F.sum("hits").alias("hits"), F.sum("data").alias("data"), best.alias("z")).select("hits", "data", F.col("z.v").alias("most"), F.col("z.loc").alias("owner"))


def reduce_utilization(spark, sf_dir):
    """Sums per bin and entry, small entries of a bin folded into 'other'."""
    d = _line(spark, sf_dir).select(F.year("l_shipdate").cast("long").alias("bin"), F.pmod("l_suppkey", F.lit(40)).cast("string").alias("ep"), F.col("l_quantity").cast("long").alias("t"))
    return R.fold_small(d, ["bin"], "ep", "t", 0.025)


def reduce_loop(spark, sf_dir):
    """Reductions of a parallel loop in chunks."""
    chunk = F.floor(F.col("l_orderkey") / 1000).cast("long")
    d = _line(spark, sf_dir).groupBy(chunk.alias("chunk")).agg(F.sum("l_linenumber").alias("i"), F.sum("l_quantity").alias("d"), F.max("l_extendedprice").alias("m"))
    return d.agg(F.sum("i").alias("sum_int"), F.sum("d").alias("sum_double"), F.max("m").alias("max_double"))


def reduce_block_field(spark, sf_dir):
    return R.reduce_by(load(spark, sf_dir, "part"), ["p_brand"], sum_size=("sum", "p_size"), max_price=("max", "p_retailprice"), min_price=("min", "p_retailprice"))


def reduce_mesh_field(spark, sf_dir):
    """Shared nodes count once: only the copy of the lowest element is primary."""
    d = _line(spark, sf_dir).groupBy(F.col("l_partkey").alias("node")).agg(R.min_loc(F.col("l_orderkey"), F.col("l_linenumber")).alias("z"))
    return d.agg(F.sum("z.v").alias("sum_primary"), F.max("z.v").alias("max_primary"), F.min("z.v").alias("min_primary"), F.count("*").alias("n"))


def _coo(spark, sf_dir):
    return _line(spark, sf_dir).select(F.pmod("l_orderkey", F.lit(16)).alias("x"), F.pmod("l_partkey", F.lit(16)).alias("y"), F.pmod("l_suppkey", F.lit(8)).alias("z"), F.col("l_linenumber").alias("data"), "l_quantity")


def sparse_1d(spark, sf_dir):
    d = _coo(spark, sf_dir)
    return d.groupBy("x").agg(F.sum("data").alias("s"), F.max("data").alias("m"), F.min("l_quantity").alias("i"))


def sparse_2d(spark, sf_dir):
    return R.sparse_reduce(_coo(spark, sf_dir), ["x", "y"], "sum", "data", "s")


def sparse_3d(spark, sf_dir):
    return R.sparse_reduce(_coo(spark, sf_dir), ["x", "y", "z"], "max", "l_quantity", "m")


def segment_sum(spark, sf_dir):
    """Rectangles of 2 x 2 cells, reduced by cell."""
    sx, sy = F.pmod("l_orderkey", F.lit(6)), F.pmod("l_partkey", F.lit(6))
    q = F.col("l_quantity").cast("long")
    d = _line(spark, sf_dir).select(sx.alias("sx"), sy.alias("sy"), (sx + 1).alias("ex"), (sy + 1).alias("ey"), F.array(q, q + 1, q + 2, q + 3).alias("vals"))
    return R.segment_reduce(d, ["sx", "sy", "ex", "ey"], "vals", "sum")


def _typed(op, column, kind):
    """A reduction of a column as one of the types of the sparse reducers."""
    return R.REDUCERS[op](F.col(column).cast(kind)).cast("double")


def sparse_typed(spark, sf_dir):
    """All operations over all types of values, of two indices."""
    d = _line(spark, sf_dir).select(F.pmod("l_orderkey", F.lit(512)).alias("x"), F.pmod("l_partkey", F.lit(64)).alias("y"), F.col("l_linenumber").alias("i"), (1 + F.col("l_linenumber") % 3 / 2).alias("d"))
    outs = [_typed(op, c, kind).alias(f"{op}_{kind}") for op in ("sum", "product", "max", "min") for c, kind in (("i", "int"), ("d", "float"), ("d", "double"))]
    return d.groupBy("x", "y").agg(*outs)


def sparse_sorted(spark, sf_dir):
    """What the client of a sparse reduction gets: indices ascending, with their place."""
    d = R.sparse_reduce(_coo(spark, sf_dir).withColumn("x", F.col("x") * 1000 - F.col("y")), ["x", "y", "z"], "sum", "data", "s")
    return S.ordered_ranks(d, ["x", "y", "z"], "place")


def segment_shapes(spark, sf_dir):
    """Rectangles of two shapes, with the extremes and the product of each cell."""
    sx, sy, wide = F.pmod("l_orderkey", F.lit(6)), F.pmod("l_partkey", F.lit(6)), F.col("l_linenumber") % 2
    q = F.col("l_quantity").cast("long")
    d = _line(spark, sf_dir).select(sx.alias("sx"), sy.alias("sy"), (sx + 1 + 2 * wide).alias("ex"), (sy + 1 - wide).alias("ey"), F.array(q, q + 1, q + 2, q + 3).alias("vals"))
    most, least = (R.segment_reduce(d, ["sx", "sy", "ex", "ey"], "vals", op, op) for op in ("max", "min"))
    signs = d.withColumn("vals", F.transform("vals", lambda v: F.when(v % 2 == 0, 1.0).otherwise(-1.0)))
    return most.join(least, ["x", "y"]).join(R.segment_reduce(signs, ["sx", "sy", "ex", "ey"], "vals", "product", "sign"), ["x", "y"])


def msa_product(spark, sf_dir):
    d = _line(spark, sf_dir).select(F.pmod("l_partkey", F.lit(5000)).alias("idx"), F.when(F.col("l_linenumber") % 2 == 0, -1.0).otherwise(1.0).alias("v"))
    return R.accumulate(d, "idx", 5000, "product", "v", "sign")


def msa_lists(spark, sf_dir):
    """Items appended to an index, ascending, as their order is not defined; untouched indices have an empty list."""
    d = load(spark, sf_dir, "supplier").select(F.pmod("s_nationkey", F.lit(40)).alias("idx"), "s_suppkey")
    found = d.groupBy("idx").agg(R.REDUCERS["set"](F.col("s_suppkey")).alias("v"))
    return spark.range(40).withColumnRenamed("id", "idx").join(found, "idx", "left").select("idx", F.coalesce(F.array_join(F.col("v").cast("array<string>"), ","), F.lit("")).alias("items"))


def segment_pairs(spark, sf_dir):
    """Cells of number pairs, summed field by field."""
    x, y = F.pmod("l_orderkey", F.lit(6)).alias("x"), F.pmod("l_partkey", F.lit(6)).alias("y")
    d = _line(spark, sf_dir).select(x, y, F.struct(F.col("l_quantity").alias("re"), F.col("l_linenumber").alias("im")).alias("c"))
    return d.groupBy("x", "y").agg(F.round(F.sum("c.re"), 3).alias("re"), F.sum("c.im").alias("im"))


def msa_accumulate(spark, sf_dir):
    """Every index has a value, untouched ones the identity."""
    d = _line(spark, sf_dir).select(F.pmod("l_partkey", F.lit(5000)).alias("idx"), "l_linenumber")
    return R.accumulate(d, "idx", 5000, "sum", "l_linenumber", "total")


def msa_max(spark, sf_dir):
    d = _line(spark, sf_dir).select(F.pmod("l_partkey", F.lit(5000)).alias("idx"), "l_orderkey")
    return R.accumulate(d, "idx", 5000, "max", "l_orderkey", "top", identity=-(2**63) + 1)


def msa_histogram(spark, sf_dir):
    return R.histogram(_line(spark, sf_dir), F.col("l_extendedprice"), 10, 110000.0)


def group_histogram(spark, sf_dir):
    """Equal bins of rounded-up width over [0, 51)."""
    return R.histogram(load(spark, sf_dir, "part"), F.col("p_size"), 6, 54.0)


_L = "FROM lineitem"
SPECS = {
    "reduce_tuple": (reduce_tuple, f"SELECT l_returnflag, round(sum(l_quantity), 4) AS sum_qty, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, count(*) AS n, round(avg(l_quantity), 8) AS mean_qty, round(stddev_samp(l_quantity), 8) AS sd_qty {_L} GROUP BY l_returnflag"),
    "reduce_sum": (reduce_sum, f"SELECT l_returnflag, sum(l_linenumber)::BIGINT AS sum_int, sum(l_linenumber::SMALLINT)::BIGINT AS sum_short, sum(l_orderkey)::BIGINT AS sum_long, sum(l_quantity::FLOAT)::DOUBLE AS sum_float, sum(l_quantity) AS sum_double {_L} GROUP BY l_returnflag"),
    "reduce_product": (reduce_product, f"SELECT l_orderkey, product(l_linenumber::DOUBLE) AS product_line {_L} GROUP BY l_orderkey"),
    "reduce_extremes": (reduce_extremes, f"SELECT l_returnflag, l_linestatus, max(l_extendedprice) AS max_price, min(l_extendedprice) AS min_price, max(l_orderkey) AS max_key, min(l_orderkey) AS min_key {_L} GROUP BY ALL"),
    "reduce_logical": (reduce_logical, f"SELECT l_orderkey, bool_and(l_linenumber % 3 <> 0)::INTEGER AS all_true, bool_or(l_linenumber % 3 <> 0)::INTEGER AS any_true, (count(*) FILTER (l_linenumber % 3 <> 0) % 2)::INTEGER AS odd_true {_L} GROUP BY l_orderkey"),
    "reduce_bitvec": (reduce_bitvec, f"SELECT l_suppkey, bit_and(l_orderkey) AS and_key, bit_or(l_orderkey) AS or_key, bit_xor(l_orderkey) AS xor_key {_L} GROUP BY l_suppkey"),
    "reduce_random": (reduce_random, f"SELECT l_returnflag, count(*) > 0 AS is_member {_L} GROUP BY 1"),
    "reduce_nop": (reduce_nop, f"SELECT count(*) > 0 AS arrived {_L}"),
    "reduce_concat": (reduce_concat, f"SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts {_L} GROUP BY l_orderkey"),
    "reduce_set": (reduce_set, f"SELECT l_orderkey, count(*) AS members, (2 * count(*))::BIGINT AS items {_L} GROUP BY l_orderkey"),
    "reduce_statistics": (reduce_statistics, "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY event_type"),
    "reduce_custom": (reduce_custom, "SELECT event_type, round(sum(ln(1 + abs(value))), 6) AS log_sum FROM events GROUP BY event_type"),
    "reduce_python": (reduce_python, f"SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS spread {_L} GROUP BY l_orderkey"),
    "reduce_vector": (reduce_vector, f"SELECT l_returnflag, pos, round(sum(v), 3) AS v FROM (SELECT l_returnflag, unnest([0, 1, 2])::BIGINT AS pos, unnest([1.0::DOUBLE, l_quantity, l_discount * 100]) AS v {_L}) GROUP BY ALL"),
    "reduce_barrier": (reduce_barrier, f"SELECT count(*) AS arrived, sum(n)::BIGINT AS n FROM (SELECT count(*) AS n {_L} GROUP BY l_orderkey % 16)"),
    "reduce_struct": (reduce_struct, f"SELECT sum(l_orderkey % 64 + 1)::BIGINT AS sum_a, sum(-2 * (l_orderkey % 64 + 1))::BIGINT AS sum_b {_L}"),
    "reduce_ccs_merge": (reduce_ccs_merge, f"SELECT l_linestatus, sum(l_linenumber)::BIGINT AS sum_line, max(l_quantity) AS max_qty, min(l_quantity) AS min_qty, bit_or(l_partkey) AS or_part, bit_and(l_partkey) AS and_part, bool_and(l_tax > 0) AS all_taxed, bool_or(l_tax > 0.07::DOUBLE) AS any_high {_L} GROUP BY l_linestatus"),
    "reduce_cache_stats": (reduce_cache_stats, f"WITH d AS (SELECT l_suppkey, count(*) AS hits, sum(l_quantity::BIGINT)::BIGINT AS data {_L} GROUP BY l_suppkey) SELECT sum(hits)::BIGINT AS hits, sum(data)::BIGINT AS data, max(data) AS most, (SELECT min(l_suppkey) FROM d WHERE data = (SELECT max(data) FROM d)) AS owner FROM d"),
    "reduce_utilization": (reduce_utilization, f"WITH s AS (SELECT year(l_shipdate)::BIGINT AS bin, (l_suppkey % 40)::VARCHAR AS ep, sum(l_quantity::BIGINT)::BIGINT AS s {_L} GROUP BY ALL), t AS (SELECT bin, sum(s) AS t FROM s GROUP BY bin) SELECT bin, CASE WHEN s < 0.025::DOUBLE * t THEN 'other' ELSE ep END AS ep, sum(s)::BIGINT AS t FROM s JOIN t USING (bin) GROUP BY 1, 2"),
    "reduce_loop": (reduce_loop, f"SELECT sum(l_linenumber)::BIGINT AS sum_int, sum(l_quantity) AS sum_double, max(l_extendedprice) AS max_double {_L}"),
    "reduce_block_field": (reduce_block_field, "SELECT p_brand, sum(p_size)::BIGINT AS sum_size, max(p_retailprice) AS max_price, min(p_retailprice) AS min_price FROM part GROUP BY p_brand"),
    "reduce_mesh_field": (reduce_mesh_field, f"SELECT sum(v)::BIGINT AS sum_primary, max(v) AS max_primary, min(v) AS min_primary, count(*) AS n FROM (SELECT min(l_orderkey) AS v {_L} GROUP BY l_partkey)"),
    "sparse_1d": (sparse_1d, f"SELECT l_orderkey % 16 AS x, sum(l_linenumber)::BIGINT AS s, max(l_linenumber) AS m, min(l_quantity) AS i {_L} GROUP BY 1"),
    "sparse_2d": (sparse_2d, f"SELECT l_orderkey % 16 AS x, l_partkey % 16 AS y, sum(l_linenumber)::BIGINT AS s {_L} GROUP BY 1, 2"),
    "sparse_3d": (sparse_3d, f"SELECT l_orderkey % 16 AS x, l_partkey % 16 AS y, l_suppkey % 8 AS z, max(l_quantity) AS m {_L} GROUP BY 1, 2, 3"),
    "segment_sum": (segment_sum, f"SELECT l_orderkey % 6 + p % 2 AS x, l_partkey % 6 + p // 2 AS y, sum(l_quantity::BIGINT + p)::BIGINT AS v FROM lineitem, (SELECT unnest([0, 1, 2, 3])::BIGINT AS p) GROUP BY 1, 2"),
    "sparse_typed": (
        sparse_typed,
        "SELECT l_orderkey % 512 AS x, l_partkey % 64 AS y, "
        + ", ".join(f"{op}({c}::DOUBLE)::DOUBLE AS {op}_{kind}" for op in ("sum", "product", "max", "min") for c, kind in (("l_linenumber", "int"), ("(1 + l_linenumber % 3 / 2)", "float"), ("(1 + l_linenumber % 3 / 2)", "double")))
        + f" {_L} GROUP BY 1, 2",
    ),
    "sparse_sorted": (sparse_sorted, f"SELECT *, row_number() OVER (ORDER BY x, y, z) - 1 AS place FROM (SELECT l_orderkey % 16 * 1000 - l_partkey % 16 AS x, l_partkey % 16 AS y, l_suppkey % 8 AS z, sum(l_linenumber)::BIGINT AS s {_L} GROUP BY 1, 2, 3)"),
    "segment_shapes": (segment_shapes, f"SELECT l_orderkey % 6 + CASE WHEN l_linenumber % 2 = 1 THEN p ELSE p % 2 END AS x, l_partkey % 6 + CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE p // 2 END AS y, max(l_quantity::BIGINT + p)::BIGINT AS max, min(l_quantity::BIGINT + p)::BIGINT AS min, product(CASE WHEN (l_quantity::BIGINT + p) % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE) AS sign FROM lineitem, (SELECT unnest([0, 1, 2, 3])::BIGINT AS p) GROUP BY 1, 2"),
    "msa_product": (msa_product, f"SELECT idx, coalesce(s, 1)::DOUBLE AS sign FROM (SELECT unnest(range(5000)) AS idx) LEFT JOIN (SELECT l_partkey % 5000 AS idx, product(CASE WHEN l_linenumber % 2 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE) AS s {_L} GROUP BY 1) USING (idx)"),
    "msa_lists": (msa_lists, "SELECT idx, coalesce(v, '') AS items FROM (SELECT unnest(range(40)) AS idx) LEFT JOIN (SELECT s_nationkey % 40 AS idx, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS v FROM supplier GROUP BY 1) USING (idx)"),
    "segment_pairs": (segment_pairs, f"SELECT l_orderkey % 6 AS x, l_partkey % 6 AS y, round(sum(l_quantity), 3) AS re, sum(l_linenumber)::BIGINT AS im {_L} GROUP BY 1, 2"),
    "msa_accumulate": (msa_accumulate, f"SELECT idx, coalesce(s, 0)::BIGINT AS total FROM (SELECT unnest(range(5000)) AS idx) LEFT JOIN (SELECT l_partkey % 5000 AS idx, sum(l_linenumber) AS s {_L} GROUP BY 1) USING (idx)"),
    "msa_max": (msa_max, f"SELECT idx, coalesce(s, -9223372036854775807)::BIGINT AS top FROM (SELECT unnest(range(5000)) AS idx) LEFT JOIN (SELECT l_partkey % 5000 AS idx, max(l_orderkey) AS s {_L} GROUP BY 1) USING (idx)"),
    "msa_histogram": (msa_histogram, f"SELECT bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN (SELECT greatest(0, least(9, floor(l_extendedprice / 11000)))::BIGINT AS bin, count(*) AS n {_L} GROUP BY 1) USING (bin)"),
    "group_histogram": (group_histogram, "SELECT bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(6)) AS bin) LEFT JOIN (SELECT greatest(0, least(5, floor(p_size / 9.0::DOUBLE)))::BIGINT AS bin, count(*) AS n FROM part GROUP BY 1) USING (bin)"),
}
