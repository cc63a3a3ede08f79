"""Closed forms, ties, involutions and round trips."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from weftline.components import connected_components
from weftline.functions.scalar import lfsr, msb_crc
from weftline.lineage import new_folder
from weftline.operators import collectives as C
from weftline.operators import iterate as I
from weftline.operators import mesh as M
from weftline.operators import reduce as R
from weftline.operators import select as S
from weftline.operators import spatial as P
from weftline.sources import ranges as B
from weftline.sources import text_formats as X
from weftline.streaming import streams as T


def test_section_sums_have_their_closed_form(spark):
    for step in (1, 2, 3, 7):
        n = spark.range(100).where(S.strided(F.col("id"), 0, 99, step)).count()
        assert n == -(-100 // step)


def test_max_loc_takes_the_lowest_location_of_equal_values(spark):
    d = spark.createDataFrame([(5, 3), (5, 1), (4, 0)], "v int, loc int")
    z = d.agg(R.max_loc(F.col("v"), F.col("loc")).alias("z")).first().z
    assert (z.v, z.loc) == (5, 1)


def test_scan_is_the_arithmetic_series(spark):
    d = C.scan(spark.range(50).withColumn("c", F.lit(0)), ["c"], "id", "sum", "id", "s")
    assert all(r.s == r.id * (r.id + 1) // 2 for r in d.collect())


def test_updates_applied_twice_restore_the_table(spark):
    base = spark.range(64).select(F.col("id").alias("k"), F.col("id").alias("v"))
    updates = spark.range(1000).select(F.pmod(lfsr(F.col("id") + 1, 9), F.lit(64)).alias("k"), lfsr(F.col("id") + 1, 9).alias("v"))
    once = C.apply_updates(base, updates, "k", "bitvec_xor", "v")
    assert all(r.k == r.v for r in C.apply_updates(once, updates, "k", "bitvec_xor", "v").collect())


def test_lfsr_folds_the_sign_bit(spark):
    d = spark.range(1).select(lfsr(F.lit(-(2**63)), 1).alias("a"), lfsr(F.lit(1), 3).alias("b")).first()
    assert (d.a, d.b) == (7, 8)


def test_msb_crc_of_short_and_long_data():
    assert msb_crc(b"\x01\x02") == 0x0102
    assert msb_crc(b"\x00\x00\x00\x00") == 0
    assert msb_crc(b"\x00\x00\x00\x00\x01") != msb_crc(b"\x00\x00\x00\x00\x02")


def test_hilbert_order_steps_from_cell_to_cell(spark):
    d = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    cells = [(r.x, r.y) for r in d.withColumn("d", S.hilbert_index(F.col("x"), F.col("y"), 3)).orderBy("d").collect()]
    assert all(abs(a - c) + abs(b - e) == 1 for (a, b), (c, e) in zip(cells, cells[1:], strict=False))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in (90, 95, 100)} == {90}
    assert connected_components(edges.where("a < 0")).count() == 0


def test_queens(spark):
    assert I.queens(spark, 6).first().solutions == 4


def test_kmeans_keeps_an_empty_cluster(spark):
    d = spark.createDataFrame([([0.0, 0.0],), ([0.2, 0.0],), ([1.0, 1.0],)], "v array<double>")
    means, _ = I.kmeans(d, "v", [(0.0, 0.0), (1.0, 1.0), (9.0, 9.0)])
    assert means == [[0.1, 0.0], [1.0, 1.0], [9.0, 9.0]]


def test_stream_equals_its_batch_twin(spark, sf_dir):
    rows = T.stream_table(spark, f"{sf_dir}/events.parquet")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    a, b = T.run_to_end(T.keyed_updates(rows, "user_id", "event_id"), "complete"), T.keyed_updates(batch, "user_id", "event_id")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.node").write_text("2 2 0 1\n1 0.5 1.5 1\n2 2.25 3.0 0\n# end\n")
    (tmp_path / "b.node").write_text("# whole numbers\n3 2 0 0\n1 0 0\n2 1 0\n3 0 1\n")
    (tmp_path / "a.cnf").write_text("c x\np cnf 3 3\n1 -2 0\n2\n 3 0 -1\n-3 0\n")
    (tmp_path / "a.hcp").write_text("NAME : x\nEDGE_DATA_SECTION\n1 2\n2 3\n-1\n")
    (tmp_path / "a.tsp").write_text("NAME : x\nNODE_COORD_SECTION\n1 1.5 2.5\nEOF\n")
    (tmp_path / "a.bin").write_bytes(bytes(range(100)))
    assert sorted(map(tuple, X.read_mesh_nodes(spark, str(tmp_path / "a.node")).collect())) == [(1, 0.5, 1.5, 1), (2, 2.25, 3.0, 0)]
    assert sorted(map(tuple, X.read_mesh_nodes(spark, str(tmp_path / "b.node")).collect())) == [(1, 0.0, 0.0, None), (2, 1.0, 0.0, None), (3, 0.0, 1.0, None)]
    assert sorted((r.clause, r.literals) for r in X.read_clauses(spark, str(tmp_path / "a.cnf")).collect()) == [(0, [1, -2]), (1, [2, 3]), (2, [-1, -3])]
    assert X.read_edges(spark, str(tmp_path / "a.hcp")).count() == 2
    assert X.read_tour(spark, str(tmp_path / "a.tsp")).first().x == 1.5
    parts = sorted((r.offset, bytes(r.data)) for r in B.read_ranges(spark, str(tmp_path / "a.bin"), 32).collect())
    assert b"".join(d for _, d in parts) == bytes(range(100)) and len(parts) == 4
    view = sorted((r.offset, bytes(r.data)) for r in B.read_view(spark, str(tmp_path / "a.bin"), 3, 2, 10).collect())
    assert view == [(k, bytes(range(k, min(k + 2, 100)))) for k in range(3, 100, 10)]


def test_written_ranges_are_read_back(spark):
    data = bytes(k % 251 for k in range(5000))
    rows = [(k, data[k : k + 70]) for k in range(0, 5000, 70)]
    parts = B.write_session(spark.createDataFrame(rows, "offset long, data binary").repartition(5), new_folder(spark))
    assert sum(r.length for r in parts.collect()) == 5000
    whole = {r.offset: (r.length, r.path) for r in parts.collect()}
    wanted = [(at + d, n) for at, (length, _) in whole.items() for d, n in ((0, 7), (length // 2, 9), (length - 5, 5))]
    back = B.read_session(parts, spark.createDataFrame(wanted, "offset long, length long"))
    assert sorted((r.offset, bytes(r.data)) for r in back.collect()) == sorted((at, data[at : at + n]) for at, n in wanted)


def test_mesh_nodes_of_the_reference_format(spark, tmp_path):
    # a head line with whole coordinates below it, in a file of several blocks
    lines = ["400 2 0 0", *(f"{k} {k % 20} {k // 20}" for k in range(1, 401)), "# generated"]
    (tmp_path / "m.node").write_text("\n".join(lines))
    got = X.read_mesh_nodes(spark, str(tmp_path / "m.node"))
    assert got.count() == 400 and got.agg(F.sum("x")).first()[0] == sum(k % 20 for k in range(1, 401))


def test_points_within_units_of_the_last_place_are_one(spark):
    x = 1.0
    near, far = x + 150 * 2.0**-52, x + 400 * 2.0**-52
    rows = [(0, 1, x, 2.0, 3.0), (1, 2, near, 2.0, 3.0), (2, 3, far, 2.0, 3.0), (1, 4, x, 2.5, 3.0)]
    d = spark.createDataFrame(rows, "part long, id long, x double, y double, z double")
    assert sorted(map(tuple, P.shared_points(d, "part", "id").collect())) == [(0, 1, 1, 2)]


def test_ranks_over_the_whole_table(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(13)
    assert all(r.k == r["rank"] for r in S.ordered_ranks(d, ["k"]).collect())
    assert S.ordered_ranks(d.limit(0), ["k"]).count() == 0


def test_refine_moves_only_off_overloaded_bins(spark):
    rows = [(0, k, float(10 + k % 7), 0 if k < 30 else k % 4) for k in range(60)]
    got = I.refine_packing(spark.createDataFrame(rows, "pe_group long, obj long, load double, old long"), 4).collect()
    before, after = ([sum(r.load for r in got if getattr(r, c) == b) for b in range(4)] for c in ("old", "bin"))
    mean = sum(before) / 4
    assert max(after) <= 1.1 * mean < max(before)
    assert {r.old for r in got if r.old != r.bin} <= {b for b in range(4) if before[b] > mean}


def test_transform_of_slabs_equals_numpy(spark):
    rng = np.random.default_rng(4)
    full = rng.random((4, 4, 4)).round(3)
    full[1] = 0  # an absent plane
    rows = [(x, y, z, float(full[x, y, z])) for x in range(4) for y in range(4) for z in range(4) if full[x, y, z]]
    got = I.fft_slabs(spark.createDataFrame(rows, "x long, y long, z long, v double"), 4)
    want = np.fft.fftn(full)
    assert got.count() == 64 and all(abs(complex(r.re, r.im) - want[r.x, r.y, r.z]) < 1e-9 for r in got.collect())


def test_a_bend_is_a_corner_and_a_straight_or_touching_node_is_none(spark):
    # a unit square with a node in the middle of its lower side; node 9 has no coordinates
    edges = spark.createDataFrame([(0, 4), (4, 1), (1, 2), (2, 3), (3, 0), (3, 0), (9, 9)], "n1 long, n2 long")
    coords = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0), (4, 0.5, 0.0)], "node long, x double, y double")
    assert sorted(r.node for r in M.corner_nodes(edges, coords).collect()) == [0, 1, 2, 3]
    touching = edges.union(spark.createDataFrame([(0, 9), (9, 0)], "n1 long, n2 long"))
    assert sorted(r.node for r in M.corner_nodes(touching, coords).collect()) == [1, 2, 3]
    assert M.corner_nodes(edges.limit(0), coords).count() == 0


def test_periodic_nodes_meet_their_moved_partners(spark):
    a = [(f, n, 0.0, float(n), 0.5 * n) for f in range(3) for n in (f, f + 1)]
    b = [(f, n + 10, 4.0, y + 1e-5 * (n - 1), z) for f, n, _, y, z in a]
    schema = "face long, node long, x double, y double, z double"
    a, b = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    assert sorted(map(tuple, M.periodic_nodes(a, b).collect())) == [(n, n + 10) for n in range(4)]
    assert M.periodic_nodes(a.limit(0), b).count() == 0
    # a set that is no copy: only what lies within the tolerance is matched
    assert M.periodic_nodes(a, b.withColumn("y", F.col("y") * 2)).count() == 0


def test_event_time_stream_with_late_rows_and_a_restart(spark, tmp_path):
    schema = "obj long, ts timestamp, value double"
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = T.run_to_end(T.event_time_fold(stream, "obj", "ts", "value", lambda s, v: s / 2 + v), folder=str(tmp_path / "work"))
        return sorted(map(tuple, out.collect()))

    batch([(1, at(0, 10), 3.0), (1, at(0), 2.0), (2, at(10), 1.0)])
    assert run() == [(1, 2, 4.0)]  # the watermark is 9:00
    # a new query goes on from the checkpoint: out of order within the delay, too late, and what moves time on
    batch([(2, at(9, 30), 8.0), (3, at(8), 5.0), (4, at(20), 1.0)])
    assert run() == [(1, 2, 4.0), (2, 2, 5.0)]


def test_optimistic_fold_ends_as_the_sequential_one(spark):
    rng = np.random.default_rng(6)
    times = rng.integers(0, 50, 200).tolist()
    rows = [(k % 3, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), k, float(k % 7)) for k, t in enumerate(times)]
    d = spark.createDataFrame(rows, "obj long, ts timestamp, event_id long, value double")
    step = lambda s, v: s / 2 + v
    got = {r.obj: r for r in T.optimistic_fold(d, "obj", "ts", "event_id", "value", step).collect()}
    for obj in range(3):
        own = [r for r in rows if r[0] == obj]
        s = 0.0
        for r in sorted(own, key=lambda r: (r[1], r[2])):
            s = step(s, r[3])
        later = [sum(b[1] > a[1] for b in own if b[2] < a[2]) for a in own]
        assert (got[obj].state, got[obj].undone, got[obj].rollbacks) == (s, sum(later), sum(n > 0 for n in later))


def test_receives_take_the_first_message_that_fits(spark):
    sends = spark.createDataFrame([(0, 1, 5, 10), (0, 2, 5, 11), (0, 1, 6, 12), (1, 1, 5, 13)], "dst long, source long, tag long, send_id long")
    recvs = spark.createDataFrame([(0, 2, None, 1), (0, None, 6, 2), (0, None, None, 3), (0, None, None, 4), (1, 2, 5, 5)], "dst long, source long, tag long, recv_id long")
    assert sorted(map(tuple, C.match_any(sends, recvs).collect())) == [(0, 10, 3), (0, 11, 1), (0, 12, 2)]


def test_refined_triangles_fit_together(spark):
    from weftline.plans import registry

    got = registry.queries()["refine_triangles"](spark, "").collect()

    def place(name):  # of a grid node, or of the middle of two
        if not name.startswith("("):
            return int(name) % 13, int(name) // 13
        depth = 0
        for k, c in enumerate(name):
            depth += (c == "(") - (c == ")")
            if c == " " and depth == 1:
                (x, y), (u, v) = place(name[1:k]), place(name[k + 1 : -1])
                return (x + u) / 2, (y + v) / 2

    area, seen = 0.0, {}
    for r in got:
        (x, y), (u, v), (p, q) = (place(n) for n in (r.a, r.b, r.c))
        area += ((u - x) * (q - y) - (p - x) * (v - y)) / 2
        for e in ((r.a, r.b), (r.b, r.c), (r.c, r.a)):
            seen[e] = seen.get(e, 0) + 1
    assert area == 144 and set(seen.values()) == {1}
    rim = lambda e: any({place(e[0])[k], place(e[1])[k]} in ({0}, {12}) for k in (0, 1))
    assert all(((b, a) in seen) != rim((a, b)) for a, b in seen)  # no node on one side of an edge only
    assert sum(r.part == 3 for r in got) >= 23


def test_refined_tetrahedra_keep_the_volume(spark):
    from weftline.operators import refine as N

    corner = {"0": (0, 0, 0), "1": (2, 0, 0), "2": (0, 2, 0), "3": (0, 0, 2)}

    def place(name):
        return np.array(corner[name]) if name in corner else (place(name[1]) + place(name[3])) / 2

    d = spark.createDataFrame([(7, "0", "1", "2", "3")], "elem long, a string, b string, c string, d string")
    volumes = [abs(np.linalg.det(np.stack([place(r[n]) - place(r["a"]) for n in "bcd"]))) / 6 for r in N.refine_tets(d).collect()]
    assert np.allclose(volumes, 8 / 6 / 8) and len(volumes) == 8
