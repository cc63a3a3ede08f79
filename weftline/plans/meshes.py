"""Queries of mesh, graph and grid derivations: elements are orders, nodes their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import mesh as M
from weftline.tables import load


def _conn(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node")).distinct()


def _parts(spark, sf_dir):
    return _conn(spark, sf_dir).select("elem", F.pmod("elem", F.lit(5)).alias("part")).distinct()


def node_elements(spark, sf_dir):
    return M.node_elements(_conn(spark, sf_dir)).select("node", "n_elems", F.array_join(F.col("elems").cast("array<string>"), ",").alias("elems"))


def node_nodes(spark, sf_dir):
    return M.node_nodes(_conn(spark, sf_dir))


def element_elements(spark, sf_dir):
    """Elements that share an edge, which is a face of two nodes."""
    a, b = _conn(spark, sf_dir).alias("a"), _conn(spark, sf_dir).alias("b")
    faces = a.join(b, (F.col("a.elem") == F.col("b.elem")) & (F.col("a.node") < F.col("b.node"))).select(F.col("a.elem").alias("elem"), F.col("a.node").alias("n1"), F.col("b.node").alias("n2"))
    return M.element_elements(faces, ["n1", "n2"])


def mesh_partition(spark, sf_dir):
    """Coordinate bisection at the median, twice: sizes of the four parts."""
    d = load(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    mx = d.agg(F.expr("percentile(x, 0.5)")).first()[0]
    d = d.withColumn("px", (F.col("x") > mx).cast("long"))
    my = d.groupBy("px").agg(F.expr("percentile(y, 0.5)").alias("my"))
    d = d.join(my, "px").select((F.col("px") * 2 + (F.col("y") > F.col("my")).cast("long")).alias("part"), "p_partkey")
    return d.groupBy("part").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


def mesh_assemble(spark, sf_dir):
    """Chunks put together: shared nodes once, by global id."""
    copies = _conn(spark, sf_dir).join(_parts(spark, sf_dir), "elem").select("part", "node").distinct()
    return copies.groupBy("node").agg(F.count("*").alias("copies"))


def _copies(spark, sf_dir):
    return _conn(spark, sf_dir).join(_parts(spark, sf_dir), "elem").select("part", "node").distinct()


def global_numbers(spark, sf_dir):
    return M.global_numbers(_copies(spark, sf_dir)).select("part", "node", "owner", "number")


def ghost_layer(spark, sf_dir):
    return M.ghost_elements(_conn(spark, sf_dir), _parts(spark, sf_dir))


def valid_entities(spark, sf_dir):
    """Counts of valid and invalid entities."""
    return load(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_returnflag") != "R").alias("valid"), F.count_if(F.col("l_returnflag") == "R").alias("invalid"))


def node_owners(spark, sf_dir):
    c = _copies(spark, sf_dir)
    return c.groupBy("node").agg(F.min("part").alias("owner"), (F.count("*") > 1).alias("shared"))


def _triangles(spark, sf_dir):
    """Two triangles in each square of a 12 x 12 grid, oriented alike."""
    q = spark.range(144).select((F.col("id") % 12).alias("i"), F.floor(F.col("id") / 12).alias("j"))
    a = F.col("j") * 13 + F.col("i")
    return q.select(F.explode(F.array(F.array(a, a + 1, a + 14), F.array(a, a + 14, a + 13))).alias("t"))


def boundary_edges(spark, sf_dir):
    t = _triangles(spark, sf_dir)
    edges = t.select(F.explode(F.array(*(F.struct(F.col("t")[i].alias("n1"), F.col("t")[(i + 1) % 3].alias("n2")) for i in range(3)))).alias("e")).select("e.n1", "e.n2")
    return M.boundary_edges(edges)


def corner_features(spark, sf_dir):
    """Corners on the boundary of a stepped, wavy triangle mesh."""
    t = _triangles(spark, sf_dir).where(F.col("t")[0] % 13 + F.floor(F.col("t")[0] / 13) < 12)
    edges = t.select(F.explode(F.array(*(F.struct(F.col("t")[i].alias("n1"), F.col("t")[(i + 1) % 3].alias("n2")) for i in range(3)))).alias("e")).select("e.n1", "e.n2")
    n = F.col("id")
    coords = spark.range(169).select(n.alias("node"), (n % 13).cast("double").alias("x"), (F.floor(n / 13) + F.when(n % 13 % 5 == 2, 0.6).otherwise(0.0)).alias("y"))
    return M.corner_nodes(M.boundary_edges(edges), coords)


def periodic_nodes(spark, sf_dir):
    """Nodes of a strip of faces and of its slightly disturbed copy, moved along x."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 1000).alias("z"))
    corners = s.select(F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("face"), F.col("k").alias("node"), F.lit(0.0).alias("x"), F.col("k").cast("double").alias("y"), "z")
    other = corners.select("face", (F.col("node") + 100000).alias("node"), (F.col("x") + 7.5).alias("x"), (F.col("y") + (F.col("node") % 3 - 1) * 0.00001).alias("y"), "z")
    return M.periodic_nodes(corners, other)


def interpolate(spark, sf_dir):
    values = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("v"))
    w = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node"), F.col("l_quantity").alias("w"))
    return M.interpolate(w, values, weight="w").select("elem", F.round("v", 6).alias("v"))


def sum_shared(spark, sf_dir):
    """Each copy of a shared node gets the sum over its copies."""
    c = _copies(spark, sf_dir).withColumn("v", F.col("part") + F.col("node") % 3)
    return M.sum_shared(c, "node", "v").select("part", "node", "total")


def _grid(spark, n=24):
    return spark.range(n * n).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("j")).withColumn("v", (F.col("i") * 7 + F.col("j") * 3) % 11)


def block_stencil(spark, sf_dir):
    """Ghost update and boundary condition: outside cells count as zero."""
    d = M.stencil(_grid(spark), [(0, 1), (0, -1), (1, 0), (-1, 0)], ["i", "j"], "v", "s")
    return d.select("i", "j", "v", F.coalesce("s", F.lit(0)).alias("s"))


def boundary_condition(spark, sf_dir):
    """A callback per face of the block."""
    face = F.when(F.col("i") == 0, "left").when(F.col("i") == 23, "right").when(F.col("j") == 0, "bottom").when(F.col("j") == 23, "top").otherwise("inner")
    return _grid(spark).withColumn("face", face).groupBy("face").agg(F.count("*").alias("n"), F.sum(F.when(F.col("face") == "left", 0).otherwise(F.col("v"))).alias("total"))


def matrix_multiply(spark, sf_dir):
    a = load(spark, sf_dir, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(12)).alias("i"), F.pmod("l_partkey", F.lit(10)).alias("k")).agg(F.sum("l_linenumber").alias("v"))
    b = load(spark, sf_dir, "part").groupBy(F.pmod("p_partkey", F.lit(10)).alias("k"), F.pmod("p_size", F.lit(6)).alias("j")).agg(F.sum("p_size").alias("v"))
    return M.multiply(a, b)


def dot_product(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(M.dot("embedding", "embedding"), 6).alias("d"))


def image_sum(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(F.pmod("l_orderkey", F.lit(32)).alias("x"), F.pmod("l_partkey", F.lit(32)).alias("y"), F.col("l_linenumber").alias("v"))
    return M.combine_images(d, "sum")


def image_max(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(F.pmod("l_orderkey", F.lit(32)).alias("x"), F.pmod("l_partkey", F.lit(32)).alias("y"), F.col("l_quantity").alias("v"))
    return M.combine_images(d, "max")


def adaptive_tree(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 1) / 50).alias("px"), (F.pmod("l_partkey", F.lit(97)) / 97.0).alias("py"))
    return M.refine_tree(d, 4, 500)


def topology_model(spark, sf_dir):
    """Nodes with their attributes and elements: lookups on the adjacency tables."""
    nodes = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    return M.node_elements(_conn(spark, sf_dir)).join(nodes, "node").select("node", "n_elems", F.col("p_size").alias("attribute"), F.element_at("elems", 1).alias("first_elem"))


_C = "c AS (SELECT DISTINCT l_orderkey AS elem, l_partkey AS node FROM lineitem)"
_P = f"{_C}, p AS (SELECT DISTINCT elem % 5 AS part, node FROM c)"
_T = "t AS (SELECT unnest([a, a + 1, a + 14, a, a + 14, a + 13]) AS n1, unnest([a + 1, a + 14, a, a + 14, a + 13, a]) AS n2 FROM (SELECT k // 12 * 13 + k % 12 AS a FROM (SELECT unnest(range(144)) AS k)))"
_G = "g AS (SELECT k % 24 AS i, k // 24 AS j, (k % 24 * 7 + k // 24 * 3) % 11 AS v FROM (SELECT unnest(range(576)) AS k))"
_QUAD = "q0 AS (SELECT (l_quantity - 1) / 50 AS px, (l_partkey % 97) / 97.0::DOUBLE AS py FROM lineitem)"
for _k in range(5):
    _side = 1 << _k
    _QUAD += f", c{_k} AS (SELECT *, least(floor(px * {_side}), {_side - 1})::BIGINT AS x, least(floor(py * {_side}), {_side - 1})::BIGINT AS y FROM q{_k}), s{_k} AS (SELECT x, y, count(*) AS n FROM c{_k} GROUP BY 1, 2), q{_k + 1} AS (SELECT px, py FROM c{_k} WHERE (x, y) IN (SELECT (x, y) FROM s{_k} WHERE n > 500))"
SPECS = {
    "node_elements": (node_elements, f"WITH {_C} SELECT node, count(*) AS n_elems, string_agg(elem::VARCHAR, ',' ORDER BY elem) AS elems FROM c GROUP BY 1"),
    "node_nodes": (node_nodes, f"WITH {_C} SELECT DISTINCT a.node AS a, b.node AS b FROM c a JOIN c b ON a.elem = b.elem AND a.node <> b.node"),
    "element_elements": (element_elements, f"WITH {_C}, f AS (SELECT p.elem, p.node AS n1, q.node AS n2 FROM c p JOIN c q ON p.elem = q.elem AND p.node < q.node) SELECT DISTINCT a.elem AS a, b.elem AS b FROM f a JOIN f b ON a.n1 = b.n1 AND a.n2 = b.n2 AND a.elem < b.elem"),
    "mesh_partition": (mesh_partition, "WITH d AS (SELECT p_partkey, p_size, (p_retailprice > (SELECT quantile_cont(p_retailprice, 0.5) FROM part))::BIGINT AS px FROM part), m AS (SELECT px, quantile_cont(p_size::DOUBLE, 0.5) AS my FROM d GROUP BY 1) SELECT px * 2 + (p_size > my)::BIGINT AS part, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM d JOIN m USING (px) GROUP BY 1"),
    "mesh_assemble": (mesh_assemble, f"WITH {_P} SELECT node, count(*) AS copies FROM p GROUP BY 1"),
    "global_numbers": (global_numbers, f"WITH {_P}, o AS (SELECT node, min(part) AS owner FROM p GROUP BY 1), n AS (SELECT node, owner, row_number() OVER (ORDER BY owner, node) - 1 AS number FROM o) SELECT part, node, owner, number FROM p JOIN n USING (node)"),
    "ghost_layer": (ghost_layer, f"WITH {_P} SELECT DISTINCT p.part, c.elem FROM p JOIN c USING (node) WHERE c.elem % 5 <> p.part"),
    "valid_entities": (valid_entities, "SELECT l_linestatus, count(*) FILTER (l_returnflag <> 'R') AS valid, count(*) FILTER (l_returnflag = 'R') AS invalid FROM lineitem GROUP BY 1"),
    "node_owners": (node_owners, f"WITH {_P} SELECT node, min(part) AS owner, count(*) > 1 AS shared FROM p GROUP BY 1"),
    "boundary_edges": (boundary_edges, f"WITH {_T} SELECT DISTINCT n1, n2 FROM t WHERE (n2, n1) NOT IN (SELECT (n1, n2) FROM t)"),
    "corner_features": (corner_features, "WITH s AS (SELECT unnest([[a, a + 1, a + 14], [a, a + 14, a + 13]]) AS v FROM (SELECT k // 12 * 13 + k % 12 AS a FROM (SELECT unnest(range(144)) AS k) WHERE k // 12 + k % 12 < 12)), d AS (SELECT v[1] AS n1, v[2] AS n2 FROM s UNION SELECT v[2], v[3] FROM s UNION SELECT v[3], v[1] FROM s), e AS (SELECT * FROM d WHERE (n2, n1) NOT IN (SELECT (n1, n2) FROM d)), u AS (SELECT n1, n2 FROM e UNION SELECT n2, n1 FROM e), c AS (SELECT n AS node, (n % 13)::DOUBLE AS x, n // 13 + CASE WHEN n % 13 % 5 = 2 THEN 0.6::DOUBLE ELSE 0 END AS y FROM (SELECT unnest(range(169)) AS n)), w AS (SELECT u.n1 AS node, atan2(q.y - p.y, q.x - p.x) AS t FROM u JOIN c p ON p.node = u.n1 JOIN c q ON q.node = u.n2) SELECT node FROM w GROUP BY 1 HAVING count(*) = 2 AND least(max(t) - min(t), 2 * pi() - max(t) + min(t)) < 0.75 * pi()"),
    "periodic_nodes": (periodic_nodes, "WITH a AS (SELECT unnest([s_suppkey, s_suppkey + 1]) AS face, s_suppkey AS node, 0::DOUBLE AS x, s_suppkey::DOUBLE AS y, s_acctbal / 1000 AS z FROM supplier), b AS (SELECT face, node + 100000 AS node, x + 7.5 AS x, y + (node % 3 - 1) * 0.00001::DOUBLE AS y, z FROM a), m AS (SELECT (SELECT avg(x) FROM b) - avg(x) AS x, (SELECT avg(y) FROM b) - avg(y) AS y, (SELECT avg(z) FROM b) - avg(z) AS z FROM a), tol AS (SELECT 0.001 * min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) AS tol FROM a p JOIN a q ON p.face = q.face AND p.node < q.node), g AS (SELECT a.node AS node_a, b.node AS node_b, sqrt((a.x + m.x - b.x) ** 2 + (a.y + m.y - b.y) ** 2 + (a.z + m.z - b.z) ** 2) AS gap FROM (SELECT DISTINCT node, x, y, z FROM a) a, (SELECT DISTINCT node, x, y, z FROM b) b, m) SELECT node_a, arg_min(node_b, gap) AS node_b FROM g, tol WHERE gap <= tol GROUP BY 1"),
    "interpolate": (interpolate, "SELECT l_orderkey AS elem, round(sum(p_size * l_quantity) / sum(l_quantity), 6) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "sum_shared": (sum_shared, f"WITH {_P} SELECT part, node, (sum(part + node % 3) OVER (PARTITION BY node))::BIGINT AS total FROM p"),
    "block_stencil": (block_stencil, f"WITH {_G} SELECT g.i, g.j, any_value(g.v) AS v, coalesce(sum(h.v), 0)::BIGINT AS s FROM g LEFT JOIN g h ON abs(g.i - h.i) + abs(g.j - h.j) = 1 GROUP BY 1, 2"),
    "boundary_condition": (boundary_condition, f"WITH {_G}, f AS (SELECT *, CASE WHEN i = 0 THEN 'left' WHEN i = 23 THEN 'right' WHEN j = 0 THEN 'bottom' WHEN j = 23 THEN 'top' ELSE 'inner' END AS face FROM g) SELECT face, count(*) AS n, sum(CASE WHEN face = 'left' THEN 0 ELSE v END)::BIGINT AS total FROM f GROUP BY 1"),
    "matrix_multiply": (matrix_multiply, "SELECT i, j, sum(a.v * b.v)::BIGINT AS v FROM (SELECT l_orderkey % 12 AS i, l_partkey % 10 AS k, sum(l_linenumber)::BIGINT AS v FROM lineitem GROUP BY 1, 2) a JOIN (SELECT p_partkey % 10 AS k, p_size % 6 AS j, sum(p_size)::BIGINT AS v FROM part GROUP BY 1, 2) b USING (k) GROUP BY 1, 2"),
    "dot_product": (dot_product, "SELECT vec_id, round(list_dot_product(v, v), 6) AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"),
    "image_sum": (image_sum, "SELECT l_orderkey % 32 AS x, l_partkey % 32 AS y, least(sum(l_linenumber), 255)::BIGINT AS v FROM lineitem GROUP BY 1, 2"),
    "image_max": (image_max, "SELECT l_orderkey % 32 AS x, l_partkey % 32 AS y, max(l_quantity)::BIGINT AS v FROM lineitem GROUP BY 1, 2"),
    "adaptive_tree": (adaptive_tree, f"WITH {_QUAD} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS level, x, y, n FROM s{k}" + (" WHERE n <= 500" if k < 4 else "") for k in range(5))),
    "topology_model": (topology_model, f"WITH {_C} SELECT node, count(*) AS n_elems, any_value(p_size) AS attribute, min(elem) AS first_elem FROM c JOIN part ON node = p_partkey GROUP BY 1"),
}
