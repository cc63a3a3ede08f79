"""Queries of iteration, search, load balancing and shipped Python code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from weftline.lineage import cut
from weftline.operators import iterate as I
from weftline.operators import spatial as P
from weftline.tables import load

#: Four centers of 64 dimensions: signs that change with the bits of the dimension.
_SEEDS = [tuple(-0.1 if d >> k & 1 else 0.1 for d in range(64)) for k in range(4)]


def kmeans(spark, sf_dir):
    """Sizes of the clusters at the fixed point."""
    d = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    means, _ = I.kmeans(d, "v", _SEEDS)
    return d.select(P.nearest_center(F.transform("v", lambda x: x.cast("double")), means)["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def kmeans_step(spark, sf_dir):
    """One assignment and move."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    d = load(spark, sf_dir, "embeddings").select(v.alias("v")).select("v", P.nearest_center(F.col("v"), _SEEDS)["k"].alias("k"))
    return d.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg(F.col("v")[0]), 9).alias("x"), F.round(F.avg(F.col("v")[63]), 9).alias("y"))


def monte_carlo_pi(spark, sf_dir):
    d = spark.range(200_000).select((F.pow(F.rand(3), 2) + F.pow(F.rand(4), 2) <= 1).alias("hit"))
    return d.agg((4 * F.avg(F.col("hit").cast("double"))).between(3.1, 3.18).alias("near_pi"))


def integrate(spark, sf_dir):
    """The integral of 4 / (1 + x^2) over 0..1, by midpoints."""
    x = (F.col("id") + 0.5) / 100_000.0
    return spark.range(100_000).agg(F.round(F.sum(4.0 / (1.0 + x * x)) / 100_000.0, 6).alias("area"))


def fibonacci(spark, sf_dir):
    return spark.sql("WITH RECURSIVE f(n, a, b) AS (SELECT 0, 0L, 1L UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40) SELECT n, a AS fib FROM f")


def queens(spark, sf_dir):
    return I.queens(spark, 7)


def ida_star(spark, sf_dir):
    """Least number of steps from 1 to 100 by +1 or *2, deepened by bound."""
    level = spark.range(1, 2).select(F.col("id").alias("x"), F.lit(0).cast("long").alias("g"))
    bound = 7  # doublings from 1 that do not pass 100, one more to reach it
    while True:
        frontier, found = level, None
        for _ in range(bound + 1):
            hit = frontier.where("x = 100").limit(1)
            if not hit.isEmpty():
                found = hit.select(F.col("g").alias("steps"))
                break
            h = F.ceil(F.log2(F.lit(100.0) / F.col("x"))).cast("long")
            frontier = cut(frontier.select(F.explode(F.array(F.col("x") + 1, F.col("x") * 2)).alias("x"), (F.col("g") + 1).alias("g")).where("x <= 100").where(F.col("g") + h <= bound).distinct())
        if found is not None:
            return found
        bound += 1


_CITIES = [(0, 0), (3, 0), (3, 4), (0, 4), (1, 2), (5, 2)]


def branch_and_bound(spark, sf_dir):
    """The shortest tour of six cities."""
    n = len(_CITIES)
    dist = F.array(*(F.array(*(F.lit(float(((a - c) ** 2 + (b - d) ** 2) ** 0.5)) for c, d in _CITIES)) for a, b in _CITIES))
    near = [sorted(((a - c) ** 2 + (b - d) ** 2) ** 0.5 for c, d in _CITIES if (a, b) != (c, d)) for a, b in _CITIES]
    # half of the two shortest ways of each city still to come, and half of the shortest of the two ends
    both, one = F.array(*(F.lit((x[0] + x[1]) / 2) for x in near)), F.array(*(F.lit(x[0] / 2) for x in near))
    total = sum((x[0] + x[1]) / 2 for x in near)
    start = spark.range(1).select(F.array(F.lit(0)).alias("tour"), F.lit(0.0).alias("cost"))

    def expand(level):
        d = level.select("tour", "cost", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("c")).where(~F.array_contains("tour", F.col("c")))
        return d.select(F.concat("tour", F.array("c")).alias("tour"), (F.col("cost") + dist[F.element_at("tour", -1)][F.col("c")]).alias("cost"))

    def bound(level):
        open_ = F.aggregate("tour", F.lit(total), lambda s, c: s - both[c])
        return level.withColumn("bound", F.col("cost") + open_ + one[F.element_at("tour", -1)] + one[0])

    def finished(level):
        return level.where(F.size("tour") == n).select((F.col("cost") + dist[F.element_at("tour", -1)][0]).alias("cost"))

    best = I.frontier_search(start, expand, bound, finished, "cost", n)
    return spark.range(1).select(F.round(F.lit(best), 6).alias("tour_length"))


def task_graph(spark, sf_dir):
    """Levels of a graph in which task k needs k / 2 and 2 k / 3."""
    tasks = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("task"))
    deps = tasks.select("task", F.explode(F.array(F.floor(F.col("task") / 2), F.floor(F.col("task") * 2 / 3))).alias("needs")).where("needs >= 1 and needs < task")
    return I.task_levels(tasks, deps)


def _objs(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(4)).alias("pe_group"), F.col("p_partkey").alias("obj"), F.col("p_retailprice").alias("load"), F.pmod("p_partkey", F.lit(8)).alias("old"))


def greedy_packing(spark, sf_dir):
    """The bin of every object."""
    return I.greedy_packing(_objs(spark, sf_dir), 8).select("pe_group", "obj", "bin")


def greedy_refine(spark, sf_dir):
    """The bin of every object, of which most stay where they are."""
    return I.greedy_refine(_objs(spark, sf_dir), 8).select("pe_group", "obj", "bin")


def refine_packing(spark, sf_dir):
    """The bin of every object after moves off the overloaded bins."""
    return I.refine_packing(_objs(spark, sf_dir), 8).select("pe_group", "obj", "old", "bin")


def rotate_balancer(spark, sf_dir):
    return _objs(spark, sf_dir).select("obj", ((F.col("old") + 1) % 8).alias("bin"))


def distributed_balancer(spark, sf_dir):
    d = I.imbalance(_objs(spark, sf_dir), "old", "load", 0.98)
    return d.select(F.col("old").alias("pe"), F.round("load", 4).alias("load"), F.round("avg", 4).alias("avg"), F.round("ratio", 6).alias("ratio"), "under")


def tree_balancer(spark, sf_dir):
    """Loads up the tree: processor, node, set of nodes, root."""
    d = load(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(16)).alias("pe"), F.col("p_size").alias("load"))
    d = d.select(F.floor(F.col("pe") / 8).alias("nodeset"), F.floor(F.col("pe") / 4).alias("node"), "pe", "load")
    return d.rollup("nodeset", "node", "pe").agg(F.sum("load").alias("load"))


def edge_cut(spark, sf_dir):
    parts = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("obj"), F.pmod("s_suppkey", F.lit(4)).alias("part"))
    comm = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % F.lit(10) + 1).alias("dst")).agg(F.sum(F.col("l_quantity").cast("long")).alias("bytes"))
    return I.edge_cut(parts, comm)


def planar_order(spark, sf_dir):
    d = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return I.planar_order(d, "p_retailprice", "p_partkey", 4).select("p_partkey", "part")


def load_predictor(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("double").alias("t"), "l_quantity")
    return I.fit_line(d, ["l_suppkey"], "t", "l_quantity").select("l_suppkey", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def jacobi(spark, sf_dir):
    grid = spark.range(144).select((F.col("id") % 12).alias("i"), F.floor(F.col("id") / 12).alias("j")).withColumn("v", F.when(F.col("i") == 0, 1.0).otherwise(0.0))
    state, _ = I.jacobi(grid, 12, 6, 1e-9)
    return state.select("i", "j", F.round("v", 9).alias("v"))


def wave(spark, sf_dir):
    grid = spark.range(100).select((F.col("id") % 10).alias("i"), F.floor(F.col("id") / 10).alias("j")).withColumn("now", F.when((F.col("i") == 5) & (F.col("j") == 5), 1.0).otherwise(0.0)).withColumn("before", F.col("now"))
    return I.wave(grid, 3).select("i", "j", F.round("now", 9).alias("now"), F.round("before", 9).alias("before"))


def fft_lines(spark, sf_dir):
    """The coefficients of each line of a table."""
    d = I.fft_lines(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return d.select("vec_id", "k", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


def fft_slabs(spark, sf_dir):
    """A field on 8 x 8 x 8 places: planes first, then lines across the planes."""
    k = F.col("p_partkey")
    d = load(spark, sf_dir, "part").groupBy((k % 8).alias("x"), (F.floor(k / 8) % 8).alias("y"), (F.floor(k / 64) % 8).alias("z")).agg(F.sum("p_size").cast("double").alias("v"))
    out = I.fft_slabs(d, 8)
    return out.select("x", "y", "z", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im"))


def shipped_python(spark, sf_dir):
    """A script applied to every element, which may change it."""

    def script(frames):
        for f in frames:
            yield f.assign(c_acctbal=(f["c_acctbal"].clip(lower=0)).round(2))[["c_custkey", "c_acctbal"]]

    return load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").mapInPandas(script, "c_custkey long, c_acctbal double")


def script_merge(spark, sf_dir):
    """String results of a script, put together in order."""
    d = load(spark, sf_dir, "nation").select("n_regionkey", F.upper("n_name").alias("s"))
    return d.groupBy("n_regionkey").agg(F.concat_ws(";", F.array_sort(F.collect_list("s"))).alias("merged"))


def task_farm(spark, sf_dir):
    """Tasks dealt out to workers, each response beside its reference."""
    tasks = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("payload"))
    return tasks.select("ref", "payload", (F.col("payload") * F.col("payload")).alias("response"))


def redistribute(spark, sf_dir):
    """Rows moved to ranges of a key: no two partitions overlap."""
    d = load(spark, sf_dir, "orders").repartitionByRange(8, "o_orderkey").select("o_orderkey", F.spark_partition_id().alias("p"))
    r = d.groupBy("p").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count("*").alias("n"))
    a, b = r.alias("a"), r.alias("b")
    overlaps = a.join(b, (F.col("a.p") < F.col("b.p")) & (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi"))).agg(F.count("*").alias("overlaps"))
    return r.agg(F.sum("n").alias("n")).join(F.broadcast(overlaps))


_K = ", ".join(f"struct_pack(d := list_sum(list_transform(list_zip(v, {list(map(float, c))}::DOUBLE[]), lambda z: (z[1] - z[2]) ** 2)), k := {k}::BIGINT)" for k, c in enumerate(_SEEDS))
_OBJS = "o AS (SELECT p_partkey % 4 AS pe_group, p_partkey AS obj, p_retailprice::DOUBLE AS load, p_partkey % 8 AS old FROM part)"
_ZEROS = "[" + ", ".join(["0::DOUBLE"] * 8) + "]"


def _placed(name: str, source: str, choice: str, limit: str) -> str:
    """Objects, heaviest first, each put where ``choice`` (of the loads s.l and the object x) says; a row per group."""
    none = "[]::DOUBLE[]"
    add = f"list_transform(s.l, lambda v, i: CASE WHEN i = {choice} THEN v + x.load ELSE v END)"
    return (
        f"{name} AS (SELECT pe_group, list(obj ORDER BY load DESC, obj) AS objs, list_reduce(list_prepend({{'load': 0::DOUBLE, 'old': 0::BIGINT, 'top': 0::DOUBLE, 'l': {_ZEROS}, 'bins': []::BIGINT[]}}, "
        f"list({{'load': load, 'old': old, 'top': {limit}, 'l': {none}, 'bins': []::BIGINT[]}} ORDER BY load DESC, obj)), "
        f"lambda s, x: {{'load': x.load, 'old': x.old, 'top': x.top, 'l': {add}, 'bins': list_append(s.bins, ({choice})::BIGINT - 1)}}) AS z FROM {source} GROUP BY 1)"
    )


_LEAST = "list_position(s.l, list_min(s.l))"
_STAY = f"(CASE WHEN s.l[x.old + 1] + x.load > x.top THEN {_LEAST} ELSE x.old + 1 END)"
_GREEDY = f"WITH {_OBJS}, {_placed('f', 'o', _LEAST, '0::DOUBLE')}"
_REFINE = f"{_GREEDY}, h AS (SELECT o.*, 1.1::DOUBLE * list_max(f.z.l) AS top FROM o JOIN f USING (pe_group)), {_placed('g', 'h', _STAY, 'top')}"


def _rounds(first: str, step: str, n: int) -> str:
    """CTEs g0..gn; step is written with the name of the one before for @."""
    return f"WITH g0 AS ({first})" + "".join(f", g{k} AS ({step.replace('@', f'g{k - 1}')})" for k in range(1, n + 1))


_JACOBI = _rounds(
    "SELECT k % 12 AS i, k // 12 AS j, CASE WHEN k % 12 = 0 THEN 1.0::DOUBLE ELSE 0 END AS v FROM (SELECT unnest(range(144)) AS k)",
    "SELECT a.i, a.j, CASE WHEN a.i BETWEEN 1 AND 10 AND a.j BETWEEN 1 AND 10 THEN avg(b.v) ELSE any_value(a.v) END AS v FROM @ a JOIN @ b ON abs(a.i - b.i) + abs(a.j - b.j) <= 1 GROUP BY a.i, a.j",
    6,
)
_WAVE = _rounds(
    "SELECT k % 10 AS i, k // 10 AS j, CASE WHEN k = 55 THEN 1.0::DOUBLE ELSE 0 END AS now, CASE WHEN k = 55 THEN 1.0::DOUBLE ELSE 0 END AS before FROM (SELECT unnest(range(100)) AS k)",
    "SELECT a.i, a.j, 2 * any_value(a.now) - any_value(a.before) + 0.16::DOUBLE * (sum(b.now) - 4 * any_value(a.now)) AS now, any_value(a.now) AS before FROM @ a JOIN @ b ON (a.i = b.i AND (a.j + 1) % 10 = b.j) OR (a.i = b.i AND (b.j + 1) % 10 = a.j) OR (a.j = b.j AND (a.i + 1) % 10 = b.i) OR (a.j = b.j AND (b.i + 1) % 10 = a.i) GROUP BY a.i, a.j",
    3,
)
SPECS = {
    "kmeans": (kmeans, None),
    "kmeans_step": (kmeans_step, f"SELECT z.k AS k, count(*) AS n, round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM (SELECT v[1] AS x, v[64] AS y, list_min([{_K}]) AS z FROM (SELECT embedding::DOUBLE[] AS v FROM embeddings)) GROUP BY 1"),
    "monte_carlo_pi": (monte_carlo_pi, "SELECT true AS near_pi"),
    "integrate": (integrate, "SELECT round(sum(4 / (1 + ((k + 0.5::DOUBLE) / 100000) ** 2)) / 100000, 6) AS area FROM (SELECT unnest(range(100000)) AS k)"),
    "fibonacci": (fibonacci, "WITH RECURSIVE f(n, a, b) AS (SELECT 0::INTEGER, 0::BIGINT, 1::BIGINT UNION ALL SELECT (n + 1)::INTEGER, b, a + b FROM f WHERE n < 40) SELECT n, a AS fib FROM f"),
    "queens": (queens, "WITH RECURSIVE q(r, c) AS (SELECT 1, [k] FROM (SELECT unnest(range(7)) AS k) UNION ALL SELECT r + 1, list_append(c, k) FROM q, (SELECT unnest(range(7)) AS k) WHERE r < 7 AND len(list_filter(c, lambda x, i: x = k OR abs(x - k) = r + 1 - i)) = 0) SELECT count(*) AS solutions FROM q WHERE r = 7"),
    "ida_star": (ida_star, "WITH RECURSIVE s(x, g) AS (SELECT 1, 0::BIGINT UNION SELECT unnest([x + 1, x * 2]), g + 1 FROM s WHERE g < 9 AND x <= 100) SELECT min(g) AS steps FROM s WHERE x = 100"),
    "branch_and_bound": (branch_and_bound, f"WITH RECURSIVE c AS (SELECT unnest(range(6)) AS k, unnest({[a for a, _ in _CITIES]}) AS x, unnest({[b for _, b in _CITIES]}) AS y), t(p, l, d) AS (SELECT [0::BIGINT], 0::BIGINT, 0.0::DOUBLE UNION ALL SELECT list_append(p, b.k), b.k, d + sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) FROM t JOIN c a ON a.k = l, c b WHERE NOT list_contains(p, b.k)) SELECT round(min(d + sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS tour_length FROM t JOIN c a ON a.k = l JOIN c b ON b.k = 0 WHERE len(p) = 6"),
    "task_graph": (task_graph, "WITH RECURSIVE d AS (SELECT p_partkey AS task, unnest([p_partkey // 2, p_partkey * 2 // 3]) AS needs FROM part), l(task, level) AS (SELECT p_partkey, 0::BIGINT FROM part UNION SELECT d.task, level + 1 FROM l JOIN d ON d.needs = l.task AND d.needs >= 1 AND d.needs < d.task) SELECT task, max(level) AS level FROM l GROUP BY 1"),
    "greedy_packing": (greedy_packing, f"{_GREEDY} SELECT pe_group, unnest(objs) AS obj, unnest(z.bins) AS bin FROM f"),
    "greedy_refine": (greedy_refine, f"{_REFINE} SELECT pe_group, unnest(objs) AS obj, unnest(z.bins) AS bin FROM g"),
    "refine_packing": (refine_packing, None),
    "rotate_balancer": (rotate_balancer, "SELECT p_partkey AS obj, (p_partkey % 8 + 1) % 8 AS bin FROM part"),
    "distributed_balancer": (distributed_balancer, "WITH p AS (SELECT p_partkey % 8 AS pe, sum(p_retailprice) AS l FROM part GROUP BY 1) SELECT pe, round(l, 4) AS load, round((SELECT avg(l) FROM p), 4) AS avg, round((SELECT max(l) / avg(l) FROM p), 6) AS ratio, l < 0.98::DOUBLE * (SELECT avg(l) FROM p) AS under FROM p"),
    "tree_balancer": (tree_balancer, "SELECT p_partkey % 16 // 8 AS nodeset, p_partkey % 16 // 4 AS node, p_partkey % 16 AS pe, sum(p_size)::BIGINT AS load FROM part GROUP BY ROLLUP (1, 2, 3)"),
    "edge_cut": (edge_cut, "WITH p AS (SELECT s_suppkey AS obj, s_suppkey % 4 AS part FROM supplier), c AS (SELECT l_suppkey AS src, l_partkey % 10 + 1 AS dst, sum(l_quantity::BIGINT) AS bytes FROM lineitem GROUP BY 1, 2) SELECT sum(CASE WHEN a.part <> b.part THEN bytes ELSE 0 END)::BIGINT AS cut, sum(bytes)::BIGINT AS total FROM c JOIN p a ON a.obj = src JOIN p b ON b.obj = dst"),
    "planar_order": (planar_order, "SELECT p_partkey, ntile(4) OVER (ORDER BY p_retailprice, p_partkey) - 1 AS part FROM part"),
    "load_predictor": (load_predictor, "SELECT l_suppkey, round(regr_slope(l_quantity, l_linenumber), 6) AS slope, round(regr_intercept(l_quantity, l_linenumber), 6) AS intercept FROM lineitem GROUP BY 1"),
    "jacobi": (jacobi, f"{_JACOBI} SELECT i, j, round(v, 9) AS v FROM g6"),
    "wave": (wave, f"{_WAVE} SELECT i, j, round(now, 9) AS now, round(before, 9) AS before FROM g3"),
    "fft_lines": (fft_lines, "SELECT vec_id, k, round(list_sum(list_transform(v, lambda x, j: x * cos(2 * pi() * ((j - 1) * k % len(v)) / len(v)))), 6) + 0 AS re, round(-list_sum(list_transform(v, lambda x, j: x * sin(2 * pi() * ((j - 1) * k % len(v)) / len(v)))), 6) + 0 AS im FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(len(embedding))) AS k FROM embeddings)"),
    "fft_slabs": (
        fft_slabs,
        "WITH f AS (SELECT p_partkey % 8 AS x, p_partkey // 8 % 8 AS y, p_partkey // 64 % 8 AS z, sum(p_size)::DOUBLE AS v FROM part GROUP BY 1, 2, 3), g AS (SELECT k % 8 AS a, k // 8 % 8 AS b, k // 64 AS c FROM (SELECT unnest(range(512)) AS k)), t AS (SELECT a, b, c, v, ((a * x + b * y + c * z) % 8)::DOUBLE * pi() / 4 AS w FROM g CROSS JOIN f) SELECT a AS x, b AS y, c AS z, round(sum(v * cos(w)), 5) + 0 AS re, round(sum(v * sin(-w)), 5) + 0 AS im FROM t GROUP BY a, b, c",
    ),
    "shipped_python": (shipped_python, "SELECT c_custkey, round(greatest(c_acctbal, 0), 2) AS c_acctbal FROM customer"),
    "script_merge": (script_merge, "SELECT n_regionkey, string_agg(upper(n_name), ';' ORDER BY upper(n_name)) AS merged FROM nation GROUP BY 1"),
    "task_farm": (task_farm, "SELECT o_orderkey AS ref, o_custkey AS payload, o_custkey * o_custkey AS response FROM orders"),
    "redistribute": (redistribute, "SELECT count(*) AS n, 0::BIGINT AS overlaps FROM orders"),
}
