"""Queries of further communicators, data types, splits, searches and refinements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import collectives as C
from weftline.operators import iterate as I
from weftline.operators import refine as N
from weftline.operators import search as H
from weftline.operators import select as S
from weftline.operators import tracelog as G
from weftline.plans.scalars import torus_hops
from weftline.tables import load


def cart_sub(spark, sf_dir):
    """Sub-grids of a grid of 4 x 3 x 2 that keep its first and last dimension."""
    comm, rank = C.cart_sub(F.col("id"), [4, 3, 2], [True, False, True])
    return spark.range(24).select(F.col("id").alias("rank"), comm.alias("comm"), rank.alias("new_rank"))


def group_ranges(spark, sf_dir):
    """Members by ranges of ranks (first, last, step), and those that ranges leave out."""
    own = S.ordered_ranks(load(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"])
    inside = C.in_ranges(F.col("rank"), [(1, 40, 3), (60, 51, -2)])
    return own.select("s_suppkey", inside.alias("included"))


def group_translate(spark, sf_dir):
    """The ranks of one group's members in another; null where they are not in it."""
    s = load(spark, sf_dir, "supplier")
    a = S.ordered_ranks(s.where("s_suppkey % 3 <> 1").select("s_suppkey"), ["s_suppkey"])
    b = S.ordered_ranks(s.where("s_suppkey % 2 = 0").select("s_suppkey", (-F.col("s_suppkey")).alias("o")), ["o"]).drop("o")
    return a.select("s_suppkey", F.col("rank").alias("rank_a")).join(b.select("s_suppkey", F.col("rank").alias("rank_b")), "s_suppkey", "left")


def neighbor_alltoall(spark, sf_dir):
    """Each rank sends its k-th neighbour its own item; at the other end it has the place of the sender."""
    d = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("src"), F.pmod("s_suppkey", F.lit(25)).alias("dst")).distinct()
    return C.neighbor_alltoall(d)


def match_any(spark, sf_dir):
    """Receives that may name a source, a tag, both or none, each taking the first message that fits."""
    e = load(spark, sf_dir, "events").select("event_id", F.pmod("user_id", F.lit(20)).alias("dst"), F.pmod("event_id", F.lit(3)).alias("source"), F.pmod("event_id", F.lit(5)).alias("tag"), "event_type")
    sends = e.where("event_type = 'click'").select("dst", "source", "tag", F.col("event_id").alias("send_id"))
    free = F.pmod("event_id", F.lit(4))
    recvs = e.where("event_type = 'view'").select("dst", F.when(free < 2, F.col("source")).alias("source"), F.when(free % 2 == 0, F.col("tag")).alias("tag"), F.col("event_id").alias("recv_id"))
    return C.match_any(sends, recvs)


def probe(spark, sf_dir):
    """What a probe sees before anything is received: the first message of each source and tag, and how many wait."""
    e = load(spark, sf_dir, "events")
    return e.groupBy(F.pmod("user_id", F.lit(20)).alias("dst"), F.pmod("event_id", F.lit(3)).alias("source"), F.pmod("event_id", F.lit(5)).alias("tag")).agg(F.min("event_id").alias("first"), F.count("*").alias("waiting"))


_BLOCKS = [(0, 2), (5, 1), (9, 3)]


def derived_indexed(spark, sf_dir):
    """Blocks of uneven length at uneven places of an extent of 16, end to end."""
    pos = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(pos.alias("pos"), C.indexed_place(pos, _BLOCKS, 16).alias("packed")).where("packed is not null")


def derived_darray(spark, sf_dir):
    """Blocks of 5 dealt to 4 ranks in turn: owner and place there."""
    owner, local = C.block_cyclic(F.col("p_partkey"), 5, 4)
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), owner.alias("owner"), local.alias("local"))


#: Fields of a struct: name, size, place; the struct is resized to 32 bytes.
_FIELDS = [("k", 4, 0), ("v", 8, 8), ("c", 1, 16)]


def derived_struct(spark, sf_dir):
    """Where each field of a resized struct lies, and where it goes when packed."""
    fields = F.array(*(F.struct(F.lit(n).alias("field"), F.lit(at).alias("at"), F.lit(sum(s for _, s, _ in _FIELDS[:k])).alias("packed")) for k, (n, _, at) in enumerate(_FIELDS)))
    size = sum(s for _, s, _ in _FIELDS)
    d = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(fields).alias("f"))
    return d.select("k", "f.field", (F.col("k") * 32 + F.col("f.at")).alias("byte"), (F.col("k") * size + F.col("f.packed")).alias("packed"))


def hop_order(spark, sf_dir):
    """Places in order of their distance on the torus."""
    return S.ordered_ranks(torus_hops(spark, sf_dir), ["hops", "p_partkey"], "turn").select("p_partkey", "turn")


def median_halves(spark, sf_dir):
    """The rows of each group split at its median place: of an odd number the lower half has one more."""
    d = load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return S.median_halves(d, "o_orderstatus", ["o_totalprice", "o_orderkey"], "upper").select("o_orderkey", "upper")


def begin_end_durations(spark, sf_dir):
    """Clicks begin and purchases end: each begin with its own end, nested ones inside."""
    d = load(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").select("user_id", "event_id", F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("d"))
    return G.matched_pairs(d, "user_id", "event_id", "d")


def jacobi_cube(spark, sf_dir):
    """Seven-point relaxation of a cube with one hot side."""
    k = F.col("id")
    grid = spark.range(216).select((k % 6).alias("i"), (F.floor(k / 6) % 6).alias("j"), F.floor(k / 36).alias("k"), F.when(k % 6 == 0, 1.0).otherwise(0.0).alias("v"))
    state, _ = I.jacobi(grid, 6, 4, 1e-9, ("i", "j", "k"))
    return state.select("i", "j", "k", F.round("v", 9).alias("v"))


#: Three of ten variables in each clause, by a rule.
_CLAUSES = [[((k * 3) % 10 + 1) * (1 if k % 2 else -1), ((k * 7 + 2) % 10 + 1) * (1 if k % 3 else -1), ((k * k + 5) % 10 + 1) * (1 if k % 5 < 2 else -1)] for k in range(26)]


def three_sat(spark, sf_dir):
    return H.satisfying(spark, _CLAUSES, 10)


def hamiltonian(spark, sf_dir):
    """Closed tours of a ring of eight with chords."""
    k = F.col("id")
    edges = spark.range(8).select(k.alias("u"), F.explode(F.array((k + 1) % 8, (k + 3) % 8)).alias("v"))
    return H.hamiltonian_cycles(edges, 8).select(F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def unbalanced_tree(spark, sf_dir):
    """Nodes per level of a tree whose nodes have none to four children."""
    return H.tree_levels(spark, 9, lambda x: F.when((x * 7 + 3) % 5 > 0, F.transform(F.sequence(F.lit(1).cast("long"), (x * 7 + 3) % 5), lambda c: x * 4 % 100003 + c)).otherwise(F.array().cast("array<long>")), 2)


def refine_tets(spark, sf_dir):
    k = F.col("id")
    d = spark.range(40).select(k.alias("elem"), *((k + i).cast("string").alias(n) for i, n in enumerate("abcd")))
    return N.refine_tets(d)


def refine_triangles(spark, sf_dir):
    """Red and green refinement of a grid of triangles, of which each thirteenth is marked."""
    q = F.col("id")
    a = F.floor(q / 12) * 13 + q % 12
    two = F.array(F.struct((2 * q).alias("elem"), a.alias("a"), (a + 1).alias("b"), (a + 14).alias("c")), F.struct((2 * q + 1).alias("elem"), a.alias("a"), (a + 14).alias("b"), (a + 13).alias("c")))
    d = spark.range(144).select(F.explode(two).alias("t")).select("t.elem", *(F.col(f"t.{x}").cast("string").alias(x) for x in "abc"))
    return N.refine_triangles(d, d.where("elem % 13 = 0").select("elem"))


def _mid(a: str, b: str) -> str:
    return f"'(' || least({a}, {b}) || ' ' || greatest({a}, {b}) || ')'"


_M = {x + y: _mid(x, y) for x, y in ("ab", "ac", "ad", "bc", "bd", "cd")}
_EIGHT = [("a", "ab", "ac", "ad"), ("b", "ab", "bc", "bd"), ("c", "ac", "bc", "cd"), ("d", "ad", "bd", "cd"), ("ab", "cd", "ac", "ad"), ("ab", "cd", "ad", "bd"), ("ab", "cd", "bd", "bc"), ("ab", "cd", "bc", "ac")]
_TETS = ", ".join("{" + f"'part': {k}::BIGINT, " + ", ".join(f"'{n}': {_M.get(x, x)}" for n, x in zip("abcd", p, strict=True)) + "}" for k, p in enumerate(_EIGHT))
_INDEXED = " ".join(f"WHEN p_partkey % 16 >= {at} AND p_partkey % 16 < {at + n} THEN p_partkey // 16 * 6 + {sum(m for _, m in _BLOCKS[:k])} + p_partkey % 16 - {at}" for k, (at, n) in enumerate(_BLOCKS))
_STRUCT = ", ".join(f"{{'field': '{n}', 'at': {at}, 'packed': {sum(s for _, s, _ in _FIELDS[:k])}}}" for k, (n, _, at) in enumerate(_FIELDS))
_SAT = " AND ".join("(" + " OR ".join(f"(m >> {abs(x) - 1}) & 1 = {int(x > 0)}" for x in c) + ")" for c in _CLAUSES)
_CUBE = "WITH g0 AS (SELECT k % 6 AS i, k // 6 % 6 AS j, k // 36 AS k, CASE WHEN k % 6 = 0 THEN 1.0::DOUBLE ELSE 0 END AS v FROM (SELECT unnest(range(216)) AS k))" + "".join(
    f", g{r} AS (SELECT a.i, a.j, a.k, CASE WHEN a.i BETWEEN 1 AND 4 AND a.j BETWEEN 1 AND 4 AND a.k BETWEEN 1 AND 4 THEN avg(b.v) ELSE any_value(a.v) END AS v FROM g{r - 1} a JOIN g{r - 1} b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) <= 1 GROUP BY a.i, a.j, a.k)" for r in range(1, 5)
)
SPECS = {
    "cart_sub": (cart_sub, "SELECT r AS rank, r // 2 % 3 AS comm, r // 6 * 2 + r % 2 AS new_rank FROM (SELECT unnest(range(24)) AS r)"),
    "group_ranges": (group_ranges, "SELECT s_suppkey, (r BETWEEN 1 AND 40 AND r % 3 = 1) OR (r BETWEEN 52 AND 60 AND r % 2 = 0) AS included FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier)"),
    "group_translate": (group_translate, "WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS rank_a FROM supplier WHERE s_suppkey % 3 <> 1), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) - 1 AS rank_b FROM supplier WHERE s_suppkey % 2 = 0) SELECT s_suppkey, rank_a, rank_b FROM a LEFT JOIN b USING (s_suppkey)"),
    "neighbor_alltoall": (neighbor_alltoall, "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS sent, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS got FROM (SELECT DISTINCT s_nationkey AS src, s_suppkey % 25 AS dst FROM supplier)"),
    "match_any": (match_any, None),
    "probe": (probe, "SELECT user_id % 20 AS dst, event_id % 3 AS source, event_id % 5 AS tag, min(event_id) AS first, count(*) AS waiting FROM events GROUP BY 1, 2, 3"),
    "derived_indexed": (derived_indexed, f"SELECT * FROM (SELECT p_partkey AS pos, CASE {_INDEXED} END AS packed FROM part) WHERE packed IS NOT NULL"),
    "derived_darray": (derived_darray, "SELECT p_partkey AS pos, p_partkey // 5 % 4 AS owner, p_partkey // 20 * 5 + p_partkey % 5 AS local FROM part"),
    "derived_struct": (derived_struct, f"SELECT k, f.field AS field, k * 32 + f.at AS byte, k * 13 + f.packed AS packed FROM (SELECT s_suppkey AS k, unnest([{_STRUCT}]) AS f FROM supplier)"),
    "hop_order": (hop_order, "SELECT p_partkey, row_number() OVER (ORDER BY least(x, 5 - x) + abs(y - 3) + least(abs(z - 5), 6 - abs(z - 5)), p_partkey) - 1 AS turn FROM (SELECT p_partkey, p_partkey % 5 AS x, p_partkey // 5 % 4 AS y, p_partkey // 20 % 6 AS z FROM part)"),
    "median_halves": (median_halves, "SELECT o_orderkey, ntile(2) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) = 2 AS upper FROM orders"),
    "begin_end_durations": (
        begin_end_durations,
        "WITH d AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('click', 'purchase')), l AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN d < 0 THEN 1 ELSE 0 END AS level FROM d), n AS (SELECT *, lead(event_id) OVER w AS next_id, lead(d) OVER w AS next_d FROM l WINDOW w AS (PARTITION BY user_id, level ORDER BY event_id)) SELECT user_id, level::BIGINT AS level, event_id AS begin_id, next_id AS end_id FROM n WHERE d = 1 AND next_d = -1",
    ),
    "jacobi_cube": (jacobi_cube, f"{_CUBE} SELECT i, j, k, round(v, 9) AS v FROM g4"),
    "three_sat": (three_sat, f"SELECT m AS assignment FROM (SELECT unnest(range(1024)) AS m) WHERE {_SAT}"),
    "hamiltonian": (
        hamiltonian,
        "WITH RECURSIVE e AS (SELECT k AS u, unnest([(k + 1) % 8, (k + 3) % 8]) AS v FROM (SELECT unnest(range(8)) AS k)), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), p(path, l) AS (SELECT [0::BIGINT], 0::BIGINT UNION ALL SELECT list_append(path, v), v FROM p JOIN b ON u = l WHERE NOT list_contains(path, v)) SELECT array_to_string(path, ',') AS path FROM p JOIN b ON u = l AND v = 0 WHERE len(path) = 8",
    ),
    "unbalanced_tree": (unbalanced_tree, "WITH RECURSIVE t(level, x) AS (SELECT 0::BIGINT, 2::BIGINT UNION ALL SELECT level + 1, x * 4 % 100003 + unnest(range(1, (x * 7 + 3) % 5 + 1)) FROM t WHERE level < 9) SELECT l AS level, (SELECT count(*) FROM t WHERE level = l) AS n FROM (SELECT unnest(range(10)) AS l)"),
    "refine_tets": (refine_tets, f"SELECT elem, z.* FROM (SELECT elem, unnest([{_TETS}]) AS z FROM (SELECT k AS elem, k::VARCHAR AS a, (k + 1)::VARCHAR AS b, (k + 2)::VARCHAR AS c, (k + 3)::VARCHAR AS d FROM (SELECT unnest(range(40)) AS k)))"),
    "refine_triangles": (refine_triangles, None),
}
