"""Queries of index spaces, sections, queues, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import select as S
from weftline.tables import load


def index_space(spark, sf_dir):
    return S.index_space(spark, [(0, 10, 3), (1, 5, 1), (2, 9, 2), (0, 2, 1), (5, 6, 1), (0, 3, 1)]).agg(F.count("*").alias("n"), F.sum(F.col("i0") + F.col("i1") + F.col("i2") + F.col("i3") + F.col("i4") + F.col("i5")).alias("total"))


def strided_section(spark, sf_dir):
    """Sums over sections of step 1, 2 and 3."""
    p = load(spark, sf_dir, "part")
    aggs = [F.sum(F.when(S.strided(F.col("p_partkey"), 1, 120, k), F.col("p_size"))).alias(f"sum_{k}") for k in (1, 2, 3)]
    return p.agg(*aggs)


def explicit_section(spark, sf_dir):
    members = load(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return S.explicit_section(load(spark, sf_dir, "lineitem"), members, ["l_suppkey"]).groupBy("l_suppkey").agg(F.sum("l_linenumber").alias("s"))


def cross_array_section(spark, sf_dir):
    """One reduction over sections of two collections."""
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    both = c.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v")).unionByName(s.where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v")))
    return both.groupBy("k").agg(F.round(F.sum("v"), 2).alias("total"), F.count("*").alias("n"))


def group_section(spark, sf_dir):
    """A subset of the processors."""
    pe = F.pmod("l_orderkey", F.lit(16))
    d = load(spark, sf_dir, "lineitem").withColumn("pe", pe)
    members = spark.range(0, 16, 3).withColumnRenamed("id", "pe")
    return S.explicit_section(d, members, ["pe"]).groupBy("pe").agg(F.count("*").alias("n"))


def section_multicast(spark, sf_dir):
    """A message to a section, mapped there and reduced back, by fragment."""
    d = load(spark, sf_dir, "part").where(S.strided(F.col("p_partkey"), 10, 190, 4))
    return d.select(F.pmod("p_partkey", F.lit(3)).alias("fragment"), (F.col("p_size") * 2 + 1).alias("v")).groupBy("fragment").agg(F.sum("v").alias("v"))


def broadcast_map(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 1.1, 4).alias("raised"))


def point_invocation(spark, sf_dir):
    return load(spark, sf_dir, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_acctbal")


def dynamic_insertion(spark, sf_dir):
    base = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    new = base.where("p_partkey % 10 = 0").select(F.col("p_partkey") + 5, F.lit(99).alias("p_size")).toDF("p_partkey", "p_size")
    return S.upsert(base, new, base.where("p_partkey % 7 = 0").select("p_partkey"), "p_partkey")


def local_elements(spark, sf_dir):
    """Iterates over the elements of each partition."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    return load(spark, sf_dir, "lineitem").select("l_orderkey").mapInArrow(run, "n long").agg(F.sum("n").alias("n"))


def user_partitioner(spark, sf_dir):
    """Rows dealt out by an expression of the user's; every key lies in one partition."""
    d = load(spark, sf_dir, "lineitem").repartition(8, F.col("l_suppkey") % 8).select("l_suppkey", F.spark_partition_id().alias("p"))
    return d.groupBy("l_suppkey").agg(F.countDistinct("p").alias("homes"))


def priority_queue(spark, sf_dir):
    d = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return S.queue_order(d, ["o_custkey"], "o_orderpriority", "o_orderkey").select("o_custkey", "o_orderkey", "turn")


def priority_queue_lifo(spark, sf_dir):
    d = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return S.queue_order(d, ["o_custkey"], "o_orderpriority", "o_orderkey", lifo=True).select("o_custkey", "o_orderkey", "turn")


def bitvector_priority(spark, sf_dir):
    """Priorities as bit strings, in lexicographic order."""
    d = load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.bin(F.col("p_partkey")).alias("bits"))
    return S.queue_order(d, ["p_brand"], "bits", "p_partkey").select("p_partkey", "bits", "turn")


def heap_top(spark, sf_dir):
    d = load(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return S.top_k(d, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3)


def sort_by_coordinates(spark, sf_dir):
    """Place of each point in order of x, y, z within its part."""
    d = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_quantity", "l_discount", "l_tax", "l_orderkey", "l_linenumber")
    return d.select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


def event_queue(spark, sf_dir):
    d = load(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return S.queue_order(d, ["user_id"], "ts", "event_id").select("user_id", "event_id", "turn")


def median_split(spark, sf_dir):
    """The exact median of each part, at which it would be split."""
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.expr("percentile(l_extendedprice, 0.5)").alias("median"))


def hilbert_order(spark, sf_dir):
    return spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y")).select("x", "y", S.hilbert_index(F.col("x"), F.col("y"), 4).alias("place"))


def bitvector_ops(spark, sf_dir):
    """Union, intersection, difference, inverse and shifts of bit vectors of 16 bits."""
    a, b = F.col("p_size").cast("long"), F.pmod("p_partkey", F.lit(65536))
    d = load(spark, sf_dir, "part")
    return d.select("p_partkey", a.bitwiseOR(b).alias("either"), a.bitwiseAND(b).alias("both"), a.bitwiseAND(F.bitwise_not(b)).alias("only_a"), F.bitwise_not(a).bitwiseAND(F.lit(65535)).alias("inverse"), F.shiftleft(a, 3).alias("up"), F.shiftright(b, 2).alias("down"), F.shiftleft(a, 16).bitwiseOR(b).alias("concat"))


def group_union_order(spark, sf_dir):
    """Members of one group in its order, then those only in the other."""
    p = load(spark, sf_dir, "part")
    a = p.where("p_size < 6").select("p_partkey", F.col("p_partkey").alias("seq"))
    b = p.where("p_size between 4 and 9").select("p_partkey", (-F.col("p_partkey")).alias("seq"))
    return S.ordered_union(a, b, "p_partkey", "seq")


def unique_elements(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").dropDuplicates()


def sequence_compact(spark, sf_dir):
    """Runs of consecutive parts per supplier."""
    return S.compact_sequence(load(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey")


def list_combine(spark, sf_dir):
    """Lists appended with duplicates kept, one of them shifted."""
    a = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"))
    return a.unionAll(a.select(F.col("i") + 5)).groupBy("i").agg(F.count("*").alias("n"))


def list_intersect(spark, sf_dir):
    """An entity is in a list if all of its nodes are: intersection of the nodes' lists."""
    d = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.pmod("l_partkey", F.lit(12))).alias("a"), F.collect_set(F.pmod("l_suppkey", F.lit(12))).alias("b"))
    return d.select("l_orderkey", F.size(F.array_intersect("a", "b")).cast("long").alias("n"))



def _hilbert_sql(order: int) -> str:
    """The place of each cell, a step for each bit of its coordinates."""
    sql = f"WITH h{order} AS (SELECT k % {1 << order} AS x0, k // {1 << order} AS y0, k % {1 << order} AS x, k // {1 << order} AS y, 0::BIGINT AS d FROM (SELECT unnest(range({1 << 2 * order})) AS k))"
    for k in reversed(range(order)):
        n, top = 1 << k, (1 << order) - 1
        sql += f", r{k} AS (SELECT *, x >> {k} & 1 AS rx, y >> {k} & 1 AS ry FROM h{k + 1}), t{k} AS (SELECT x0, y0, ry, d + {n * n} * xor(3 * rx, ry) AS d, CASE WHEN ry = 0 AND rx = 1 THEN {top} - x ELSE x END AS a, CASE WHEN ry = 0 AND rx = 1 THEN {top} - y ELSE y END AS b FROM r{k})"
        sql += f", h{k} AS (SELECT x0, y0, CASE WHEN ry = 0 THEN b ELSE a END AS x, CASE WHEN ry = 0 THEN a ELSE b END AS y, d FROM t{k})"
    return sql + " SELECT x0 AS x, y0 AS y, d AS place FROM h0"


SPECS = {
    "index_space": (index_space, "SELECT count(*) AS n, sum(a + b + c + d + e + f)::BIGINT AS total FROM (SELECT unnest([0, 3, 6, 9]) AS a), (SELECT unnest([1, 2, 3, 4]) AS b), (SELECT unnest([2, 4, 6, 8]) AS c), (SELECT unnest([0, 1]) AS d), (SELECT 5 AS e), (SELECT unnest([0, 1, 2]) AS f)"),
    "strided_section": (strided_section, "SELECT " + ", ".join(f"(sum(p_size) FILTER (p_partkey BETWEEN 1 AND 120 AND (p_partkey - 1) % {k} = 0))::BIGINT AS sum_{k}" for k in (1, 2, 3)) + " FROM part"),
    "explicit_section": (explicit_section, "SELECT l_suppkey, sum(l_linenumber)::BIGINT AS s FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1"),
    "cross_array_section": (cross_array_section, "SELECT k, round(sum(v), 2) AS total, count(*) AS n FROM (SELECT c_nationkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY 1"),
    "group_section": (group_section, "SELECT l_orderkey % 16 AS pe, count(*) AS n FROM lineitem WHERE l_orderkey % 16 % 3 = 0 GROUP BY 1"),
    "section_multicast": (section_multicast, "SELECT p_partkey % 3 AS fragment, sum(p_size * 2 + 1)::BIGINT AS v FROM part WHERE p_partkey BETWEEN 10 AND 190 AND (p_partkey - 10) % 4 = 0 GROUP BY 1"),
    "broadcast_map": (broadcast_map, "SELECT o_orderkey, round(o_totalprice * 1.1::DOUBLE, 4) AS raised FROM orders"),
    "point_invocation": (point_invocation, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42"),
    "dynamic_insertion": (dynamic_insertion, "WITH n AS (SELECT p_partkey + 5 AS p_partkey FROM part WHERE p_partkey % 10 = 0) SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0 AND p_partkey NOT IN (SELECT p_partkey FROM n) UNION ALL SELECT p_partkey, 99 FROM n"),
    "local_elements": (local_elements, "SELECT count(*) AS n FROM lineitem"),
    "user_partitioner": (user_partitioner, "SELECT DISTINCT l_suppkey, 1::BIGINT AS homes FROM lineitem"),
    "priority_queue": (priority_queue, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS turn FROM orders"),
    "priority_queue_lifo": (priority_queue_lifo, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey DESC) AS turn FROM orders"),
    "bitvector_priority": (bitvector_priority, "SELECT p_partkey, bin(p_partkey) AS bits, row_number() OVER (PARTITION BY p_brand ORDER BY bin(p_partkey), p_partkey) AS turn FROM part"),
    "heap_top": (heap_top, "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3"),
    "sort_by_coordinates": (sort_by_coordinates, "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_discount, l_tax, l_orderkey, l_linenumber) AS place FROM lineitem"),
    "event_queue": (event_queue, "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events"),
    "median_split": (median_split, "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS median FROM lineitem GROUP BY 1"),
    "hilbert_order": (hilbert_order, _hilbert_sql(4)),
    "bitvector_ops": (bitvector_ops, "SELECT p_partkey, a | b AS either, a & b AS both, a & ~b AS only_a, ~a & 65535 AS inverse, a << 3 AS up, b >> 2 AS down, (a << 16) | b AS concat FROM (SELECT p_partkey, p_size::BIGINT AS a, p_partkey % 65536 AS b FROM part)"),
    "group_union_order": (group_union_order, "SELECT p_partkey, row_number() OVER (ORDER BY p_size >= 6, CASE WHEN p_size < 6 THEN p_partkey ELSE -p_partkey END) - 1 AS turn FROM part WHERE p_size <= 9"),
    "unique_elements": (unique_elements, "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem"),
    "sequence_compact": (sequence_compact, "SELECT l_suppkey, min(l_partkey) AS start, max(l_partkey) AS last, count(*) AS n FROM (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS r FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY l_suppkey, r"),
    "list_combine": (list_combine, "SELECT i, count(*) AS n FROM (SELECT s_suppkey AS i FROM supplier UNION ALL SELECT s_suppkey + 5 FROM supplier) GROUP BY 1"),
    "list_intersect": (list_intersect, "SELECT l_orderkey, len(list_intersect(list(DISTINCT l_partkey % 12), list(DISTINCT l_suppkey % 12)))::BIGINT AS n FROM lineitem GROUP BY 1"),
}
