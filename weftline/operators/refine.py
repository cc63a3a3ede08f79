"""Refinement of meshes. Nodes are named by strings; the middle of an edge is named by its ends, so both its elements name it alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.lineage import cut


def middle(a: Column, b: Column) -> Column:
    """The name of the node in the middle of an edge, whichever way it is taken."""
    return F.concat(F.lit("("), F.least(a, b), F.lit(" "), F.greatest(a, b), F.lit(")"))


def refine_tets(tets: DataFrame) -> DataFrame:
    """(elem, part, a, b, c, d): every tetrahedron in eight of an eighth of its volume: one at each corner, four around the line from the middle of ab to that of cd."""
    a, b, c, d = (F.col(k) for k in "abcd")
    ab, ac, ad, bc, bd, cd = (middle(x, y) for x, y in ((a, b), (a, c), (a, d), (b, c), (b, d), (c, d)))
    parts = [(a, ab, ac, ad), (b, ab, bc, bd), (c, ac, bc, cd), (d, ad, bd, cd), (ab, cd, ac, ad), (ab, cd, ad, bd), (ab, cd, bd, bc), (ab, cd, bc, ac)]
    made = F.array(*(F.struct(F.lit(k).cast("long").alias("part"), *(x.alias(n) for x, n in zip(p, "abcd", strict=True))) for k, p in enumerate(parts)))
    return tets.select("elem", F.explode(made).alias("z")).select("elem", "z.*")


def _edges(triangles: DataFrame) -> DataFrame:
    """(elem, edge) three times per triangle; an edge is named by its middle."""
    ends = F.array(middle(F.col("a"), F.col("b")), middle(F.col("b"), F.col("c")), middle(F.col("c"), F.col("a")))
    return triangles.select("elem", F.explode(ends).alias("edge"))


def refine_triangles(triangles: DataFrame, marked: DataFrame) -> DataFrame:
    """(elem, part, a, b, c) of a mesh (elem, a, b, c) in which the marked elements (elem) are split in four, and no edge has a node on one side only.

    An element two of whose edges are split has its third split too, round by
    round until nothing is added; one with a single split edge is halved. Rounds
    are joins of tables; only a count comes to the driver.
    """
    edges = cut(_edges(triangles))
    split = cut(edges.join(marked.select("elem").distinct(), "elem", "left_semi").select("edge").distinct())
    n = split.count()
    while True:
        torn = edges.join(split, "edge").groupBy("elem").agg(F.count("*").alias("n")).where("n >= 2").select("elem")
        split = cut(split.unionByName(edges.join(torn, "elem", "left_semi").select("edge")).distinct())
        before, n = n, split.count()
        if n == before:
            break
    found = edges.join(split, "edge").groupBy("elem").agg(F.collect_set("edge").alias("split"))  # three at most
    rows = triangles.join(found, "elem", "left")
    a, b, c = (F.col(k) for k in "abc")
    ab, bc, ca = middle(a, b), middle(b, c), middle(c, a)

    def made(*parts: tuple[Column, Column, Column]) -> Column:
        return F.array(*(F.struct(F.lit(k).cast("long").alias("part"), p.alias("a"), q.alias("b"), r.alias("c")) for k, (p, q, r) in enumerate(parts)))

    has = lambda x: F.array_contains("split", x)
    out = F.when(F.col("split").isNull(), made((a, b, c))).when(F.size("split") == 3, made((a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)))
    out = out.when(has(ab), made((a, ab, c), (ab, b, c))).when(has(bc), made((a, b, bc), (a, bc, c))).otherwise(made((a, b, ca), (ca, b, c)))
    return rows.select("elem", F.explode(out).alias("z")).select("elem", "z.*")
