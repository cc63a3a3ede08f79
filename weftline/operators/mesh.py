"""Mesh, graph and grid derivations. An element is a row (elem, node) per node that it touches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.lineage import cut


def connectivity(elements: DataFrame, elem: str = "elem", conn: str = "conn") -> DataFrame:
    """(elem, node) of elements with arrays of nodes."""
    return elements.select(elem, F.explode(conn).alias("node")).distinct()


def node_elements(conn: DataFrame) -> DataFrame:
    """(node, n_elems, elems) of each node, elements ascending."""
    return conn.groupBy("node").agg(F.count("*").alias("n_elems"), F.array_sort(F.collect_list("elem")).alias("elems"))


def node_nodes(conn: DataFrame) -> DataFrame:
    """(a, b) of different nodes that share an element, both ways, each pair once."""
    a, b = conn.alias("a"), conn.alias("b")
    return a.join(b, (F.col("a.elem") == F.col("b.elem")) & (F.col("a.node") != F.col("b.node"))).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def element_elements(faces: DataFrame, face: Sequence[str]) -> DataFrame:
    """(a, b), a < b, of elements that share a face; faces: (elem, sorted node tuple)."""
    a, b = faces.alias("a"), faces.alias("b")
    cond = F.col("a.elem") < F.col("b.elem")
    for k in face:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, cond).select(F.col("a.elem").alias("a"), F.col("b.elem").alias("b")).distinct()


def owners(copies: DataFrame, part: str = "part", node: str = "node") -> DataFrame:
    """(node, owner): the lowest part that shares a node."""
    return copies.groupBy(node).agg(F.min(part).alias("owner"))


def global_numbers(copies: DataFrame, part: str = "part", node: str = "node") -> DataFrame:
    """(part, node, owner, number): nodes numbered part after part by their owners; all copies get the owner's number.

    Counts per part are summed up over the few parts; within a part, rows are numbered there.
    """
    own = owners(copies, part, node)
    per = own.groupBy("owner").agg(F.count("*").alias("n"))
    first = per.select("owner", (F.sum("n").over(Window.orderBy("owner").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    numbered = own.withColumn("_k", F.row_number().over(Window.partitionBy("owner").orderBy(node)) - 1).join(first, "owner")
    return copies.select(part, node).distinct().join(numbered.select(node, "owner", (F.col("first") + F.col("_k")).cast("long").alias("number")), node)


def ghost_elements(conn: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, elem): elements of other parts that share a node with a part; parts: (elem, part)."""
    placed = conn.join(parts, "elem")
    touched = placed.select("part", "node").distinct()
    seen = touched.join(placed.select("node", "elem", F.col("part").alias("home")), "node")
    return seen.where("part <> home").select("part", "elem").distinct()


def sum_shared(copies: DataFrame, node: str, value: str, out: str = "total") -> DataFrame:
    """Each copy of a shared node gets the sum over all copies."""
    return copies.join(copies.groupBy(node).agg(F.sum(value).alias(out)), node)


def boundary_edges(directed: DataFrame) -> DataFrame:
    """Directed edges (n1, n2) of which no element has the reverse."""
    back = directed.select(F.col("n2").alias("n1"), F.col("n1").alias("n2"))
    return directed.select("n1", "n2").distinct().join(back, ["n1", "n2"], "left_anti")


def interpolate(targets: DataFrame, values: DataFrame, target: str = "elem", node: str = "node", value: str = "v", weight: str | None = None) -> DataFrame:
    """(target, value): weighted mean of the values of each target's nodes."""
    met = targets.join(values, node)
    if weight is None:
        return met.groupBy(target).agg(F.avg(value).alias(value))
    return met.groupBy(target).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def stencil(grid: DataFrame, offsets: Sequence[tuple[int, ...]], axes: Sequence[str], value: str, out: str, op=F.sum) -> DataFrame:
    """(axes..., value, out): an aggregate of the values at the offsets around each cell; each cell sends its value to the cells that need it."""
    moved = F.explode(F.array(*(F.struct(*((F.col(a) - o).alias(a) for a, o in zip(axes, off, strict=True))) for off in offsets))).alias("to")
    around = grid.select(moved, F.col(value).alias("_v")).groupBy(*(F.col(f"to.{a}").alias(a) for a in axes)).agg(op("_v").alias(out), F.count("*").alias("n_around"))
    return grid.join(around, list(axes), "left")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v): product of sparse matrices a (i, k, v) and b (k, j, v)."""
    return a.select("i", "k", F.col("v").alias("_a")).join(b.select("k", "j", F.col("v").alias("_b")), "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def combine_images(deposits: DataFrame, how: str = "sum", top: int = 255) -> DataFrame:
    """(x, y, v) of overlapping deposits (x, y, v): the sum, clipped at the channel's top, or the greatest."""
    v = F.least(F.sum("v"), F.lit(top)) if how == "sum" else F.max("v")
    return deposits.groupBy("x", "y").agg(v.cast("long").alias("v"))


def refine_tree(points: DataFrame, levels: int, most: int) -> DataFrame:
    """(level, x, y, n): leaves of a quad tree over the unit square that is split where a cell holds over ``most`` points.

    One pass per level over the points that still lie in large cells.
    """
    rows = points.select("px", "py")
    leaves = None
    for level in range(levels + 1):
        side = 1 << level
        cell = rows.select("px", "py", F.least(F.floor(F.col("px") * side), F.lit(side - 1)).cast("long").alias("x"), F.least(F.floor(F.col("py") * side), F.lit(side - 1)).cast("long").alias("y"))
        sizes = cut(cell.groupBy("x", "y").agg(F.count("*").alias("n")))
        done = (sizes if level == levels else sizes.where(F.col("n") <= most)).select(F.lit(level).cast("long").alias("level"), "x", "y", "n")
        leaves = done if leaves is None else leaves.unionByName(done)
        if level < levels:
            rows = cut(cell.join(sizes.where(F.col("n") > most).select("x", "y"), ["x", "y"], "left_semi").select("px", "py"))
    return leaves


#: Boundary nodes whose two boundary edges meet at less than this angle are corners (a fixed value).
CORNER_ANGLE = 0.75 * math.pi


def corner_nodes(edges: DataFrame, coords: DataFrame, angle: float = CORNER_ANGLE) -> DataFrame:
    """(node,) of corners of a boundary; edges: (n1, n2) of the boundary, coords: (node, x, y).

    A corner has exactly two neighbours on the boundary and an angle between
    them below ``angle``. Repeated edges count once. Nodes where boundaries
    touch (more than two neighbours), ends of an open boundary, nodes without
    coordinates and edges of length zero give no corner.
    """
    both = edges.select("n1", "n2").unionByName(edges.select(F.col("n2").alias("n1"), F.col("n1").alias("n2"))).where("n1 <> n2").distinct()
    arms = both.join(coords.select(F.col("node").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2")), "n2", "left").join(coords.select(F.col("node").alias("n1"), "x", "y"), "n1", "left")
    arms = arms.select(F.col("n1").alias("node"), "n2", (F.col("x2") - F.col("x")).alias("dx"), (F.col("y2") - F.col("y")).alias("dy"))
    # two neighbours at most matter, so the smallest and the greatest are all of them
    arm = F.struct("n2", "dx", "dy")
    two = arms.groupBy("node").agg(F.count("*").alias("n"), F.min(arm).alias("a"), F.max(arm).alias("b")).where("n = 2")
    dot = F.col("a.dx") * F.col("b.dx") + F.col("a.dy") * F.col("b.dy")
    lengths = F.hypot("a.dx", "a.dy") * F.hypot("b.dx", "b.dy")
    return two.where((lengths > 0) & (dot > F.lit(math.cos(angle)) * lengths)).select("node")


def periodic_nodes(a: DataFrame, b: DataFrame, relative: float = 0.001) -> DataFrame:
    """(node_a, node_b): each node of face set ``a`` with the nearest node of ``b`` at a's place moved by the shift from a to b.

    a, b: (face, node, x, y, z), a row per corner of a face. The shift is the
    difference of the mean corners; the tolerance is ``relative`` times the least
    distance of two nodes of a face of ``a``. Nodes without a partner within the
    tolerance are left out; of equally near ones the smaller id counts. Nodes
    are met by cells of the tolerance's width, so a node is compared with those
    of its 27 cells only.
    """
    axes = ("x", "y", "z")
    p, q = a.alias("p"), a.alias("q")
    gap = F.sqrt(sum((F.col(f"p.{k}") - F.col(f"q.{k}")) ** 2 for k in axes))
    least = p.join(q, (F.col("p.face") == F.col("q.face")) & (F.col("p.node") < F.col("q.node"))).agg((F.min(gap) * relative).alias("tol"))
    ma, mb = (d.agg(*(F.avg(k).alias(f"{s}{k}") for k in axes)) for s, d in (("a", a), ("b", b)))
    # three rows of one value each
    found = least.first().asDict() | ma.first().asDict() | mb.first().asDict()
    tol = found["tol"]
    if not tol or found["ax"] is None or found["bx"] is None:
        return a.select(F.col("node").alias("node_a"), F.col("node").alias("node_b")).limit(0)
    cells = lambda d: d.withColumns({f"c{k}": F.floor(F.col(k) / tol) for k in axes})
    moved = cells(a.select(F.col("node").alias("node_a"), *((F.col(k) + (found[f"b{k}"] - found[f"a{k}"])).alias(k) for k in axes)).distinct())
    around = F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1)))
    for k in axes:
        moved = moved.withColumn(f"d{k}", F.explode(around)).withColumn(f"c{k}", F.col(f"c{k}") + F.col(f"d{k}")).drop(f"d{k}")
    there = cells(b.select(F.col("node").alias("node_b"), *axes).distinct()).withColumnsRenamed({k: f"b{k}" for k in axes})
    near = moved.join(there, [f"c{k}" for k in axes]).withColumn("gap", F.sqrt(sum((F.col(k) - F.col(f"b{k}")) ** 2 for k in axes))).where(F.col("gap") <= tol)
    return near.groupBy("node_a").agg(F.min(F.struct("gap", "node_b")).alias("m")).select("node_a", F.col("m.node_b").alias("node_b"))
