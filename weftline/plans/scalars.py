"""Queries of the scalar functions and of the spatial and keyed joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import scalar as X
from weftline.operators import select as S
from weftline.operators import spatial as P
from weftline.tables import load


def regex_captures(spark, sf_dir):
    g = X.regex_captures(F.col("props"), r'"(\w+)":\s*(\d+)', 2)
    return load(spark, sf_dir, "events").select("event_id", g[0].alias("name"), g[1].alias("number"))


def crc_msb_first(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", X.crc_msb_first(F.col("s_name").cast("binary")).alias("crc"), F.crc32(F.col("s_name").cast("binary")).alias("crc_reflected"))


def hash_functions(spark, sf_dir):
    """Keys dealt out by hash: all buckets are used."""
    d = load(spark, sf_dir, "part").select(F.pmod(F.xxhash64("p_partkey", "p_name"), F.lit(16)).alias("bucket"))
    return d.groupBy("bucket").agg(F.count("*").alias("n"))


def voxel_hash(spark, sf_dir):
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select("p_partkey", P.voxel_hash(k, F.col("p_size"), k % 7).alias("h"))


def complex_numbers(spark, sf_dir):
    a, b = X.complex_of(F.col("p_size").cast("long"), F.col("p_partkey")), X.complex_of(F.col("p_partkey") % 5, F.col("p_partkey") % 3)
    m, s, d = X.complex_mul(a, b), X.complex_add(a, b), X.complex_sub(a, X.complex_conj(b))
    k = X.complex_scale(a, F.lit(3))
    return load(spark, sf_dir, "part").select("p_partkey", m["re"].alias("mul_re"), m["im"].alias("mul_im"), s["re"].alias("add_re"), s["im"].alias("add_im"), d["re"].alias("sub_re"), d["im"].alias("sub_im"), k["im"].alias("scaled_im"))


def vector_functions(spark, sf_dir):
    a, b = [F.col("l_quantity"), F.col("l_discount") + 1, F.col("l_tax") + 1], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.vector_dot(a, b), 6).alias("dot"), F.round(X.vector_length(a), 6).alias("mag"), F.round(X.vector_cosine(a, b), 6).alias("cos"), F.round(X.vector_direction(a)[0], 6).alias("dir_x"))


def box_predicates(spark, sf_dir):
    lo, hi, p = [F.lit(10.0), F.lit(0.02), F.lit(0.02)], [F.lit(30.0), F.lit(0.06), F.lit(0.06)], [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")]
    d = load(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return d.agg(*(F.count_if(X.box_contains(lo, hi, p, k)).alias(k) for k in ("closed", "half", "open")), F.count_if(P.half_open_overlap(F.col("l_quantity"), F.col("l_quantity") + 2, F.lit(10.0), F.lit(12.0))).alias("overlap"))


def grid_mapping(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(X.grid_cell(F.col("l_quantity"), 0.5, 0.125).alias("cell")).agg(F.count("*").alias("n"))


def random_numbers(spark, sf_dir):
    """Moments of uniform numbers, within bounds."""
    d = spark.range(10000).select(F.rand(7).alias("x"))
    return d.agg(F.avg("x").between(0.4, 0.6).alias("mean_ok"), F.stddev_samp("x").between(0.2, 0.4).alias("sd_ok"), (F.min("x") <= 0.1).alias("low_ok"), (F.max("x") >= 0.9).alias("high_ok"))


def color_scale(spark, sf_dir):
    r, g, b = X.color_scale(F.col("p_size").cast("double"), 1.0, 51.0)
    return load(spark, sf_dir, "part").select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


def lfsr(spark, sf_dir):
    """Sixteen steps, of which the top bits show the polynomial at work."""
    return load(spark, sf_dir, "supplier").select("s_suppkey", X.lfsr(F.shiftleft(F.col("s_suppkey"), 50), 16).alias("k"))


def torus_hops(spark, sf_dir):
    k = F.col("p_partkey")
    a, b = [k % 5, F.floor(k / 5) % 4, F.floor(k / 20) % 6], [F.lit(0), F.lit(3), F.lit(5)]
    return load(spark, sf_dir, "part").select("p_partkey", X.torus_hops(a, b, [5, 4, 6], [True, False, True]).cast("long").alias("hops"))


def json_field(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def _boxes(spark, sf_dir):
    """A box for each line of an order, flat ones included, along a strip of orders."""
    line = F.col("l_linenumber")
    d = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.round(F.col("l_discount") * 100)).alias("lo_y"), F.min(F.round(F.col("l_tax") * 100)).alias("lo_z"))
    d = d.select((F.col("l_orderkey") * 10 + line).alias("id"), line.alias("prio"), F.col("l_orderkey").cast("double").alias("lo_x"), "lo_y", "lo_z", (line % 4).alias("wx"), (line % 3).alias("wy"), F.pmod("l_orderkey", F.lit(3)).alias("wz"))
    return d.select("id", "prio", *(F.col(f"lo_{k}") for k in P.AXES), *((F.col(f"lo_{k}") + F.col(f"w{k}")).alias(f"hi_{k}") for k in P.AXES))


def box_join(spark, sf_dir):
    return P.box_join(_boxes(spark, sf_dir), 3.0)


def grid_binning(spark, sf_dir):
    return P.in_cells(_boxes(spark, sf_dir), 3.0).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))


def mesh_collision(spark, sf_dir):
    """Boxes of elements from their nodes, grown by a padding, then joined: orders are elements, their lines nodes."""
    nodes = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") + 10 * F.col("l_discount")).alias("x"), F.col("l_quantity").alias("y"), (100 * F.col("l_tax")).alias("z"))
    d = nodes.groupBy("id").agg(*((F.min(k) - 0.25).alias(f"lo_{k}") for k in P.AXES), *((F.max(k) + 0.25).alias(f"hi_{k}") for k in P.AXES)).withColumn("prio", F.col("id"))
    return P.box_join(d, 16.0)


def _points(spark, sf_dir):
    d = load(spark, sf_dir, "customer")
    return d.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 37).cast("double").alias("y"), (F.col("c_custkey") % 11).cast("double").alias("z"), F.col("c_nationkey").alias("part"))


def near_pairs(spark, sf_dir):
    d = P.near_pairs(_points(spark, sf_dir), 3.0)
    return d.select("a", "b", F.round("r2", 6).alias("r2"))


def shared_points(spark, sf_dir):
    """Points of different parts at one place."""
    d = load(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(6)).alias("part"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return P.shared_points(d, "part", "id")


def cache_lookup(spark, sf_dir):
    """A keyed lookup of remote records."""
    l, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    return l.join(p, l["l_partkey"] == p["p_partkey"]).groupBy("p_brand").agg(F.count("*").alias("requests"), F.sum("p_size").alias("data"))


def when_join(spark, sf_dir):
    """Entries a[ref] and b[ref] fire together, first in first out per reference number."""
    e = load(spark, sf_dir, "events").select("event_id", F.pmod("user_id", F.lit(40)).alias("ref"), "event_type")
    turn = F.row_number().over(Window.partitionBy("ref").orderBy("event_id"))
    a = e.where("event_type = 'click'").select("ref", F.col("event_id").alias("a"), turn.alias("turn"))
    b = e.where("event_type = 'purchase'").select("ref", F.col("event_id").alias("b"), turn.alias("turn"))
    return a.join(b, ["ref", "turn"]).select("ref", "a", "b", F.greatest("a", "b").alias("fires_at"))


def tagged_receive(spark, sf_dir):
    """Messages received by (tag, source), with how many of each tag wait."""
    o = load(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(20)).alias("tag"), F.pmod("o_orderkey", F.lit(3)).alias("source"), "o_orderkey")
    return S.queue_order(o, ["tag", "source"], "o_orderkey", "o_orderkey").groupBy("tag").agg(F.max("turn").alias("deepest"), F.count("*").alias("n"))


_CENTERS = [tuple(a * (-1.0 if d % 4 == k else 1.0) for d in range(64)) for k, a in enumerate((0.1, 0.0, 0.05, 0.1))]


def nearest_center(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    d = load(spark, sf_dir, "embeddings").select("vec_id", P.nearest_center(v, _CENTERS).alias("z"))
    return d.select("vec_id", F.col("z.k").alias("k"), F.round("z.d", 9).alias("d"))


_BOX = """SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber AS prio, l_orderkey::DOUBLE AS lo_x, l_orderkey::DOUBLE + l_linenumber % 4 AS hi_x, min(round(l_discount * 100)) AS lo_y, min(round(l_discount * 100)) + l_linenumber % 3 AS hi_y, min(round(l_tax * 100)) AS lo_z, min(round(l_tax * 100)) + l_orderkey % 3 AS hi_z
FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def _meets(k: str) -> str:
    return f"((a.lo_{k} <= b.lo_{k} AND b.lo_{k} < a.hi_{k}) OR (b.lo_{k} < a.lo_{k} AND a.lo_{k} < b.hi_{k}))"


# what the first two say follows from the others, but lets DuckDB join by ranges
_MEETS = "a.lo_x <= b.hi_x AND b.lo_x <= a.hi_x AND " + " AND ".join(map(_meets, "xyz"))
_ROL = lambda x, n: f"(((({x}) << {n}) | (({x}) >> {32 - n})) & 4294967295)"
_T = "greatest(0.0, least(1.0, (p_size - 1) / 50.0))::DOUBLE"
_NEAR = ", ".join(f"struct_pack(d := list_sum(list_transform(list_zip(v, {list(c)}::DOUBLE[]), lambda z: (z[1] - z[2]) ** 2)), k := {k}::BIGINT)" for k, c in enumerate(_CENTERS))
_BITS = "list_transform(range({first}, length(s_name)), lambda i: list_transform({order}, lambda k: (ascii(substr(s_name, i + 1, 1))::BIGINT >> k) & 1))"
_CRC_MSB = f"list_reduce(list_prepend(xor(list_sum(list_transform([0, 1, 2, 3], lambda i: ascii(substr(s_name, i + 1, 1))::BIGINT << (24 - 8 * i)))::BIGINT, 4294967295), flatten({_BITS.format(first=4, order='[7, 6, 5, 4, 3, 2, 1, 0]')})), lambda r, b: xor(((r << 1) & 4294967295) | b, CASE WHEN r >> 31 = 1 THEN 79764919 ELSE 0 END))"
_CRC_LSB = f"list_reduce(list_prepend(4294967295, flatten({_BITS.format(first=0, order='[0, 1, 2, 3, 4, 5, 6, 7]')})), lambda r, b: xor(r >> 1, CASE WHEN xor(r, b) & 1 = 1 THEN 3988292384 ELSE 0 END))"
_LFSR = "list_reduce(list_prepend(s_suppkey::UBIGINT << 50, list_transform(range(16), lambda i: i::UBIGINT)), lambda k, i: xor((k & 9223372036854775807::UBIGINT) * 2::UBIGINT, CASE WHEN k > 9223372036854775807::UBIGINT THEN 7::UBIGINT ELSE 0::UBIGINT END))"
SPECS = {
    "regex_captures": (regex_captures, "SELECT event_id, nullif(regexp_extract(props, '\"(\\w+)\":\\s*(\\d+)', 1), '') AS name, nullif(regexp_extract(props, '\"(\\w+)\":\\s*(\\d+)', 2), '') AS number FROM events"),
    "crc_msb_first": (crc_msb_first, f"SELECT s_suppkey, xor({_CRC_MSB}, 4294967295) AS crc, xor({_CRC_LSB}, 4294967295) AS crc_reflected FROM supplier"),
    "hash_functions": (hash_functions, None),
    "voxel_hash": (voxel_hash, f"SELECT p_partkey, ({_ROL('p_partkey', 6)} + {_ROL('p_size::BIGINT', 17)} + {_ROL('p_partkey % 7', 28)}) & 4294967295 AS h FROM part"),
    "complex_numbers": (complex_numbers, "SELECT p_partkey, a * c - b * d AS mul_re, a * d + b * c AS mul_im, a + c AS add_re, b + d AS add_im, a - c AS sub_re, b + d AS sub_im, 3 * b AS scaled_im FROM (SELECT p_partkey, p_size::BIGINT AS a, p_partkey AS b, p_partkey % 5 AS c, p_partkey % 3 AS d FROM part)"),
    "vector_functions": (vector_functions, "SELECT l_orderkey, l_linenumber, round(d, 6) AS dot, round(m, 6) AS mag, round(d / (m * sqrt(14)), 6) AS cos, round(x / m, 6) AS dir_x FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_quantity + 2 * (l_discount + 1) + 3 * (l_tax + 1) AS d, sqrt(l_quantity * l_quantity + (l_discount + 1) * (l_discount + 1) + (l_tax + 1) * (l_tax + 1)) AS m FROM lineitem)"),
    "box_predicates": (box_predicates, "SELECT l_returnflag, count(*) FILTER (l_quantity BETWEEN 10 AND 30 AND l_discount BETWEEN 0.02::DOUBLE AND 0.06::DOUBLE AND l_tax BETWEEN 0.02::DOUBLE AND 0.06::DOUBLE) AS closed, count(*) FILTER (l_quantity >= 10 AND l_quantity < 30 AND l_discount >= 0.02::DOUBLE AND l_discount < 0.06::DOUBLE AND l_tax >= 0.02::DOUBLE AND l_tax < 0.06::DOUBLE) AS half, count(*) FILTER (l_quantity > 10 AND l_quantity < 30 AND l_discount > 0.02::DOUBLE AND l_discount < 0.06::DOUBLE AND l_tax > 0.02::DOUBLE AND l_tax < 0.06::DOUBLE) AS open, count(*) FILTER (l_quantity > 8 AND l_quantity < 12) AS overlap FROM lineitem GROUP BY 1"),
    "grid_mapping": (grid_mapping, "SELECT floor((l_quantity - 0.5) * 0.125)::BIGINT AS cell, count(*) AS n FROM lineitem GROUP BY 1"),
    "random_numbers": (random_numbers, "SELECT true AS mean_ok, true AS sd_ok, true AS low_ok, true AS high_ok"),
    "color_scale": (color_scale, f"SELECT p_partkey, greatest(0, round(510 * {_T})::INTEGER - 255)::INTEGER AS r, least(255, least(round(510 * {_T})::INTEGER, round(510 * (1 - {_T}))::INTEGER))::INTEGER AS g, greatest(0, round(510 * (1 - {_T}))::INTEGER - 255)::INTEGER AS b FROM part"),
    "lfsr": (lfsr, f"SELECT s_suppkey, CASE WHEN k > 9223372036854775807::UBIGINT THEN (k::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE k::BIGINT END AS k FROM (SELECT s_suppkey, {_LFSR} AS k FROM supplier)"),
    "torus_hops": (torus_hops, "SELECT p_partkey, (least(x, 5 - x) + abs(y - 3) + least(abs(z - 5), 6 - abs(z - 5)))::BIGINT AS hops FROM (SELECT p_partkey, p_partkey % 5 AS x, p_partkey // 5 % 4 AS y, p_partkey // 20 % 6 AS z FROM part)"),
    "json_field": (json_field, "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events"),
    "box_join": (box_join, f"WITH box AS ({_BOX}) SELECT a.id AS a, b.id AS b FROM box a JOIN box b ON a.prio < b.prio AND {_MEETS}"),
    "grid_binning": (grid_binning, f"WITH box AS ({_BOX}), c AS (SELECT id, unnest(range(floor(lo_x / 3)::BIGINT, greatest(floor(lo_x / 3) + 1, ceil(hi_x / 3))::BIGINT)) AS cx, * FROM box), d AS (SELECT *, unnest(range(floor(lo_y / 3)::BIGINT, greatest(floor(lo_y / 3) + 1, ceil(hi_y / 3))::BIGINT)) AS cy FROM c), e AS (SELECT *, unnest(range(floor(lo_z / 3)::BIGINT, greatest(floor(lo_z / 3) + 1, ceil(hi_z / 3))::BIGINT)) AS cz FROM d) SELECT cx, cy, cz, count(*) AS n FROM e GROUP BY 1, 2, 3"),
    "mesh_collision": (mesh_collision, f"WITH n AS (SELECT l_orderkey AS id, l_orderkey + 10 * l_discount AS x, l_quantity AS y, 100 * l_tax AS z FROM lineitem), box AS (SELECT id, id AS prio, min(x) - 0.25::DOUBLE AS lo_x, max(x) + 0.25::DOUBLE AS hi_x, min(y) - 0.25::DOUBLE AS lo_y, max(y) + 0.25::DOUBLE AS hi_y, min(z) - 0.25::DOUBLE AS lo_z, max(z) + 0.25::DOUBLE AS hi_z FROM n GROUP BY 1) SELECT a.id AS a, b.id AS b FROM box a JOIN box b ON a.prio < b.prio AND {_MEETS}"),
    "near_pairs": (near_pairs, "WITH p AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, (c_custkey % 37)::DOUBLE AS y, (c_custkey % 11)::DOUBLE AS z FROM customer) SELECT a.id AS a, b.id AS b, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 6) AS r2 FROM p a JOIN p b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) >= 0.001::DOUBLE AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 9"),
    "shared_points": (shared_points, "WITH p AS (SELECT l_suppkey % 6 AS part, min(l_orderkey) AS id, round(l_quantity, 4) AS x, round(l_discount, 4) AS y, round(l_tax, 4) AS z FROM lineitem GROUP BY 1, 3, 4, 5) SELECT a.part AS low_part, a.id AS low_id, b.part AS high_part, b.id AS high_id FROM p a JOIN p b ON a.part < b.part AND a.x = b.x AND a.y = b.y AND a.z = b.z"),
    "cache_lookup": (cache_lookup, "SELECT p_brand, count(*) AS requests, sum(p_size)::BIGINT AS data FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "when_join": (when_join, "WITH e AS (SELECT event_id, user_id % 40 AS ref, event_type, row_number() OVER (PARTITION BY user_id % 40, event_type ORDER BY event_id) AS t FROM events) SELECT a.ref, a.event_id AS a, b.event_id AS b, greatest(a.event_id, b.event_id) AS fires_at FROM e a JOIN e b ON a.ref = b.ref AND a.t = b.t AND a.event_type = 'click' AND b.event_type = 'purchase'"),
    "tagged_receive": (tagged_receive, "SELECT tag, max(n) AS deepest, sum(n)::BIGINT AS n FROM (SELECT o_custkey % 20 AS tag, o_orderkey % 3 AS source, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1"),
    "nearest_center": (nearest_center, f"SELECT vec_id, z.k AS k, round(z.d, 9) AS d FROM (SELECT vec_id, list_min([{_NEAR}]) AS z FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))"),
}
