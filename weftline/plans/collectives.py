"""Queries of the message-passing collectives."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import collectives as C
from weftline.operators import reduce as R
from weftline.operators import select as S
from weftline.tables import load


def _ranked(spark, sf_dir):
    """Lines as ranks of their order."""
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def bcast(spark, sf_dir):
    d = C.bcast(_ranked(spark, sf_dir), ["l_orderkey"], "l_linenumber", 1, "l_partkey", "root_part")
    return d.select("l_orderkey", "l_linenumber", "root_part")


def scatter(spark, sf_dir):
    d = load(spark, sf_dir, "part").withColumn("pos", F.col("p_partkey"))
    return C.scatter(d, "pos", 16).select("rank", "place", "p_partkey")


def gather(spark, sf_dir):
    d = C.gather(_ranked(spark, sf_dir), ["l_orderkey"], "l_linenumber", "l_partkey", "parts")
    return d.select("l_orderkey", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


def allgather(spark, sf_dir):
    d = _ranked(spark, sf_dir)
    got = C.gather(d, ["l_orderkey"], "l_linenumber", "l_partkey", "parts")
    return d.join(got, "l_orderkey").select("l_orderkey", "l_linenumber", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


def alltoall(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(8)).alias("src"), F.pmod("l_partkey", F.lit(8)).alias("dst")).agg(F.sum("l_linenumber").alias("v"))
    return C.alltoall(d, "src", "dst").select("src", "dst", "v")


def alltoallv(spark, sf_dir):
    """Parts of different lengths, each packed in order."""
    d = load(spark, sf_dir, "supplier").select(F.pmod("s_suppkey", F.lit(5)).alias("src"), F.pmod("s_nationkey", F.lit(5)).alias("dst"), "s_suppkey")
    packed = d.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_list("s_suppkey")).cast("array<string>"), ",").alias("items"), F.count("*").alias("n"))
    return C.alltoall(packed, "src", "dst").select("src", "dst", "items", "n")


def reduce_to_root(spark, sf_dir):
    return R.reduce_by(_ranked(spark, sf_dir), ["l_orderkey"], total=("sum", "l_partkey"), top=("max", "l_quantity"))


def allreduce(spark, sf_dir):
    return C.allreduce(_ranked(spark, sf_dir), ["l_orderkey"], "sum", "l_partkey", "total").select("l_orderkey", "l_linenumber", "total")


def maxloc(spark, sf_dir):
    """Of equal values the lowest rank."""
    d = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(R.max_loc(F.col("l_quantity"), F.col("l_orderkey")).alias("x"), R.min_loc(F.col("l_quantity"), F.col("l_orderkey")).alias("i"))
    return d.select("l_returnflag", F.col("x.v").alias("max_v"), F.col("x.loc").alias("max_loc"), F.col("i.v").alias("min_v"), F.col("i.loc").alias("min_loc"))


def reduce_scatter(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(F.array(*(F.col("l_linenumber") * k + F.col("l_orderkey") % 7 for k in range(6))).alias("vec"))
    return C.reduce_scatter(d, "vec", "sum", 2, "v")


def reduce_local(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.col("l_suppkey")).alias("sum_in"), F.greatest("l_partkey", "l_suppkey").alias("max_in"))


def scan(spark, sf_dir):
    return C.scan(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "sum", "o_orderkey", "prefix").select("o_custkey", "o_orderkey", "prefix")


def exscan(spark, sf_dir):
    return C.exscan(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "sum", "o_orderkey", "prefix").select("o_custkey", "o_orderkey", "prefix")


def ordered_fold(spark, sf_dir):
    """An operation that does not commute: s -> (3 s + x) mod 1000003 in rank order."""
    return C.ordered_fold(_ranked(spark, sf_dir), ["l_orderkey"], "l_linenumber", "l_partkey", F.lit(0).cast("long"), lambda s, x: (s * 3 + x) % 1000003, "folded")


def logical_collective(spark, sf_dir):
    d = _ranked(spark, sf_dir).withColumn("k", F.col("l_partkey").bitwiseAND(F.lit(7)))
    return R.reduce_by(d, ["l_orderkey"], land=("logical_and", "k"), lor=("logical_or", "k"), lxor=("logical_xor", "k"), band=("bitvec_and", "k"), bor=("bitvec_or", "k"), bxor=("bitvec_xor", "k"))


def _edges(spark, sf_dir):
    """Nations of suppliers -> nations of customers, by who orders from whom, as distinct pairs."""
    line, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    s, c = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "customer")
    d = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(s, line["l_suppkey"] == s["s_suppkey"]).join(c, orders["o_custkey"] == c["c_custkey"])
    return d.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()


def neighbor_allgather(spark, sf_dir):
    values = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return C.neighbor_allgather(values, _edges(spark, sf_dir), "n_nationkey", "n_name", "got").select("dst", "src", "got")


def graph_degrees(spark, sf_dir):
    """A distributed graph topology: in- and outdegree of each rank."""
    e = _edges(spark, sf_dir)
    out, into = e.groupBy(F.col("src").alias("rank")).agg(F.count("*").alias("outdegree")), e.groupBy(F.col("dst").alias("rank")).agg(F.count("*").alias("indegree"))
    return out.join(into, "rank", "full").select("rank", F.coalesce("outdegree", F.lit(0)).alias("outdegree"), F.coalesce("indegree", F.lit(0)).alias("indegree"))


def comm_split(spark, sf_dir):
    d = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    return C.split(d, "o_custkey", ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey", "new_rank")


def comm_create(spark, sf_dir):
    """A communicator of the members of a group; ranks follow the group's order."""
    members = load(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    return S.ordered_ranks(members, ["s_suppkey"], "new_rank")


def intercomm(spark, sf_dir):
    """An inter-communicator: each side gets the other side's sum."""
    s = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.round(F.sum("s_acctbal"), 2).alias("from_suppliers"))
    c = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("from_customers"))
    return s.join(c, s["s_nationkey"] == c["c_nationkey"], "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "from_suppliers", "from_customers")


def group_sets(spark, sf_dir):
    """Union, intersection and difference of two groups."""
    p = load(spark, sf_dir, "part")
    a, b = p.where("p_size <= 30").select("p_partkey"), p.where("p_size >= 20").select("p_partkey")
    tag = lambda d, k: d.select(F.lit(k).alias("op"), "p_partkey")
    return tag(a.union(b).distinct(), "union").unionByName(tag(a.intersect(b), "intersection")).unionByName(tag(a.subtract(b), "difference"))


def cart_topology(spark, sf_dir):
    """Coordinates and shifted neighbours on a grid of 4 x 3 x 2, the first axis periodic."""
    dims = C.dims_create(24, 3)
    rank = F.col("id")
    x = C.cart_coords(rank, dims)
    return spark.range(24).select(rank.alias("rank"), x[0].alias("c0"), x[1].alias("c1"), x[2].alias("c2"), C.cart_shift(rank, dims, 0, 1, True).alias("next0"), C.cart_shift(rank, dims, 1, -1, False).alias("prev1"))


def match_messages(spark, sf_dir):
    """Sends and receives with equal tags, first in first out."""
    e = load(spark, sf_dir, "events").select("event_id", F.pmod("user_id", F.lit(50)).alias("tag"), "event_type")
    sends, recvs = e.where("event_type = 'click'").select("tag", F.col("event_id").alias("send_id")), e.where("event_type = 'view'").select("tag", F.col("event_id").alias("recv_id"))
    return C.match_messages(sends, recvs, ["tag"], "send_id", "recv_id").select("tag", "send_id", "recv_id")


def rma_accumulate(spark, sf_dir):
    base = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("v"))
    updates = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").cast("long").alias("v"))
    return C.apply_updates(base, updates, "k", "sum", "v")


def rma_put(spark, sf_dir):
    base = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(0.0).alias("v"))
    updates = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("s"), F.col("o_totalprice").alias("v"))
    return C.put_last(base, updates, "k", "s", "v")


def rma_compare_and_swap(spark, sf_dir):
    """Counter from 0: the update of line n swaps n - 1 for n."""
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("e"))
    return C.compare_and_swap(d, "l_orderkey", "l_linenumber", "e", "l_linenumber", F.lit(0), "v")


def derived_vector(spark, sf_dir):
    d = load(spark, sf_dir, "part").withColumn("pos", F.col("p_partkey") - 1)
    return C.typed_slice(d, "pos", 12, 3, 10, 5).select("pos", "packed")


def derived_subarray(spark, sf_dir):
    """Rows 2..5, columns 3..8 of an array of 16 columns."""
    d = load(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("pos"))
    r, c = F.floor(F.col("pos") / 16).cast("long"), F.col("pos") % 16
    return d.where(r.between(2, 5) & c.between(3, 8)).select("pos", ((r - 2) * 6 + c - 3).alias("packed"))


def pack_unpack(spark, sf_dir):
    """A row packed to JSON bytes and read back."""
    d = load(spark, sf_dir, "supplier").select(F.to_json(F.struct("s_suppkey", "s_name")).cast("binary").alias("b"))
    return d.select(F.from_json(F.col("b").cast("string"), "s_suppkey long, s_name string").alias("z")).select("z.s_suppkey", "z.s_name")


_E = "SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey"
SPECS = {
    "bcast": (bcast, "SELECT l.l_orderkey, l.l_linenumber, r.l_partkey AS root_part FROM lineitem l LEFT JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND r.l_linenumber = 1"),
    "scatter": (scatter, "SELECT p_partkey // 16 AS rank, p_partkey % 16 AS place, p_partkey FROM part"),
    "gather": (gather, "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey"),
    "allgather": (allgather, "SELECT l_orderkey, l_linenumber, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) OVER (PARTITION BY l_orderkey) AS parts FROM lineitem"),
    "alltoall": (alltoall, "SELECT l_partkey % 8 AS src, l_orderkey % 8 AS dst, sum(l_linenumber)::BIGINT AS v FROM lineitem GROUP BY 1, 2"),
    "alltoallv": (alltoallv, "SELECT (s_nationkey % 5) AS src, s_suppkey % 5 AS dst, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS items, count(*) AS n FROM supplier GROUP BY 1, 2"),
    "reduce_to_root": (reduce_to_root, "SELECT l_orderkey, sum(l_partkey)::BIGINT AS total, max(l_quantity) AS top FROM lineitem GROUP BY 1"),
    "allreduce": (allreduce, "SELECT l_orderkey, l_linenumber, (sum(l_partkey) OVER (PARTITION BY l_orderkey))::BIGINT AS total FROM lineitem"),
    "maxloc": (maxloc, "SELECT l_returnflag, max(l_quantity) AS max_v, min(l_orderkey) FILTER (l_quantity = hi) AS max_loc, min(l_quantity) AS min_v, min(l_orderkey) FILTER (l_quantity = lo) AS min_loc FROM (SELECT *, max(l_quantity) OVER w AS hi, min(l_quantity) OVER w AS lo FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)) GROUP BY 1"),
    "reduce_scatter": (reduce_scatter, "SELECT k // 2 AS rank, k % 2 AS place, sum(l_linenumber * k + l_orderkey % 7)::BIGINT AS v FROM lineitem, (SELECT unnest(range(6)) AS k) GROUP BY k"),
    "reduce_local": (reduce_local, "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS sum_in, greatest(l_partkey, l_suppkey) AS max_in FROM lineitem"),
    "scan": (scan, "SELECT o_custkey, o_orderkey, (sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))::BIGINT AS prefix FROM orders"),
    "exscan": (exscan, "SELECT o_custkey, o_orderkey, (sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS prefix FROM orders"),
    "ordered_fold": (ordered_fold, "SELECT l_orderkey, list_reduce(list_prepend(0::BIGINT, list(l_partkey ORDER BY l_linenumber, l_partkey)), lambda s, x: (s * 3 + x) % 1000003) AS folded FROM lineitem GROUP BY 1"),
    "logical_collective": (logical_collective, "SELECT l_orderkey, bool_and(k <> 0)::INTEGER AS land, bool_or(k <> 0)::INTEGER AS lor, (count(*) FILTER (k <> 0) % 2)::INTEGER AS lxor, bit_and(k) AS band, bit_or(k) AS bor, bit_xor(k) AS bxor FROM (SELECT l_orderkey, l_partkey & 7 AS k FROM lineitem) GROUP BY 1"),
    "neighbor_allgather": (neighbor_allgather, f"SELECT dst, src, n_name AS got FROM ({_E}) JOIN nation ON n_nationkey = src"),
    "graph_degrees": (graph_degrees, f"WITH e AS ({_E}), o AS (SELECT src AS rank, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS rank, count(*) AS n FROM e GROUP BY 1) SELECT rank, coalesce(o.n, 0)::BIGINT AS outdegree, coalesce(i.n, 0)::BIGINT AS indegree FROM o FULL JOIN i USING (rank)"),
    "comm_split": (comm_split, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS new_rank FROM orders"),
    "comm_create": (comm_create, "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS new_rank FROM supplier WHERE s_acctbal > 0"),
    "intercomm": (intercomm, "SELECT coalesce(s_nationkey, c_nationkey) AS nation, from_suppliers, from_customers FROM (SELECT s_nationkey, round(sum(s_acctbal), 2) AS from_suppliers FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey, round(sum(c_acctbal), 2) AS from_customers FROM customer GROUP BY 1) ON s_nationkey = c_nationkey"),
    "group_sets": (group_sets, "SELECT 'union' AS op, p_partkey FROM part WHERE p_size <= 30 OR p_size >= 20 UNION ALL SELECT 'intersection', p_partkey FROM part WHERE p_size BETWEEN 20 AND 30 UNION ALL SELECT 'difference', p_partkey FROM part WHERE p_size < 20"),
    "cart_topology": (cart_topology, "SELECT r AS rank, r // 6 AS c0, r // 2 % 3 AS c1, r % 2 AS c2, (r // 6 + 1) % 4 * 6 + r % 6 AS next0, CASE WHEN r // 2 % 3 > 0 THEN r - 2 END AS prev1 FROM (SELECT unnest(range(24)) AS r)"),
    "match_messages": (match_messages, "WITH e AS (SELECT event_id, user_id % 50 AS tag, event_type, row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY event_id) AS t FROM events) SELECT s.tag, s.event_id AS send_id, r.event_id AS recv_id FROM e s JOIN e r ON s.tag = r.tag AND s.t = r.t AND s.event_type = 'click' AND r.event_type = 'view'"),
    "rma_accumulate": (rma_accumulate, "SELECT k, sum(v)::BIGINT AS v FROM (SELECT p_partkey AS k, p_size::BIGINT AS v FROM part UNION ALL SELECT l_partkey, l_linenumber FROM lineitem) GROUP BY 1"),
    "rma_put": (rma_put, "SELECT coalesce(c_custkey, o_custkey) AS k, coalesce(v, 0.0::DOUBLE) AS v FROM customer FULL JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey"),
    "rma_compare_and_swap": (rma_compare_and_swap, "SELECT l_orderkey, list_reduce(list_prepend(0, list(l_linenumber ORDER BY l_linenumber)), lambda v, x: CASE WHEN v = x - 1 THEN x ELSE v END) AS v FROM lineitem GROUP BY 1"),
    "derived_vector": (derived_vector, "SELECT p_partkey - 1 AS pos, (p_partkey - 6) // 10 * 3 + (p_partkey - 6) % 10 AS packed FROM part WHERE p_partkey >= 6 AND p_partkey < 126 AND (p_partkey - 6) % 10 < 3"),
    "derived_subarray": (derived_subarray, "SELECT p AS pos, (p // 16 - 2) * 6 + p % 16 - 3 AS packed FROM (SELECT p_partkey - 1 AS p FROM part) WHERE p // 16 BETWEEN 2 AND 5 AND p % 16 BETWEEN 3 AND 8"),
    "pack_unpack": (pack_unpack, "SELECT s_suppkey, s_name FROM supplier"),
}
