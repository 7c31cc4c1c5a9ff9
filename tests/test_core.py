import math
import random

import pytest
from pyspark.sql import functions as F

from atlaspark.functions import geometry as G
from atlaspark.operators import filters, graph, joins, metrics, raster, windows
from atlaspark.plans.voxels import MapSettings, demote, fold, ray_cells
from atlaspark.streaming.voxel_stream import START, edge_ages, observe, voxel_stream


def test_keys(spark):
    half = 1 << 20
    rows = [(0, 0, 0), (-1, 2, -3), (-half, -half, -half), (half - 1, half - 1, half - 1)]
    df = spark.createDataFrame(rows, "i long, j long, k long").withColumn("key", G.pack_key(F.col("i"), F.col("j"), F.col("k")))
    i, j, k = G.unpack_key(F.col("key"))
    out = df.select("*", i.alias("a"), j.alias("b"), k.alias("c")).collect()
    assert [r.key for r in out] == [4611688217451692032, 4611683819409375229, 0, 9223372036854775807]
    assert [(r.a, r.b, r.c) for r in out] == rows
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(half, 0, 0)], "i long, j long, k long").select(G.pack_key(F.col("i"), F.col("j"), F.col("k"))).collect()


def test_percentile_filter_drops_nan(spark):
    df = spark.createDataFrame([(c, 0.0, 0.0, 0.0) for c in (float("nan"), 1.0, 2.0, 3.0, 4.0)], "conf double, x double, y double, z double")
    assert sorted(r.conf for r in filters.percentile_filter(df, 0.5).collect()) == [3.0, 4.0]


def test_natural_key(spark):
    df = spark.createDataFrame([("Frame10",), ("frame2",), ("frame1b3",)], "n string")
    assert [r.n for r in df.orderBy(G.natural_key(F.col("n"))).collect()] == ["frame1b3", "frame2", "Frame10"]


def test_rotation_round_trip(spark):
    angle = math.radians(40)
    row = spark.range(1).select(*[c.alias(f"m{i}{j}") for i, r in enumerate(G.rodrigues([F.lit(0.0), F.lit(0.0), F.lit(angle)])) for j, c in enumerate(r)])
    q = G.matrix_to_quaternion([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    x, y, z, w = row.select(*[c.alias(n) for c, n in zip(q, "xyzw", strict=True)]).first()
    assert (x, y) == (0.0, 0.0) and math.isclose(z, math.sin(angle / 2)) and math.isclose(w, math.cos(angle / 2))


def test_projective_divisor_of_zero(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (None,), (-1.0005,)], "x double")
    a = G.projective([[0.0]], [2.0], [1.0], [F.col("x")])[0]
    assert [r.a for r in df.select(a.alias("a")).collect()] == [2000.0, 2.0, None, -2000.0]


def test_sync_and_stride(spark):
    cams = {1: [0, 1, 2, 4], 2: [1, 2, 3, 4], 3: [1, 2, 4, 5]}
    df = spark.createDataFrame([(c, i) for c, ids in cams.items() for i in ids], "cam int, idx int")
    assert sorted(r.idx for r in windows.stride(joins.synchronised(df), [], [F.col("idx")], 2).collect()) == [1, 4]


def test_pair_counts(spark):
    five = spark.range(5).select(F.col("id").cast("int").alias("idx"))
    assert joins.frame_pairs(five, "complete", symmetric=True).count() == 20
    assert joins.frame_pairs(five, "swin", 2).count() == 10
    assert joins.frame_pairs(five, "oneref", 0).count() == 4


def test_nearest_and_mutual(spark):
    p = spark.createDataFrame([(0, 0.0), (1, 0.3), (2, 50.0)], "p int, px double")
    q = spark.createDataFrame([(0, 0.1), (1, 90.0)], "q int, qx double")
    forth, back = joins.nearest(p, q, "p", "q", ["px"], ["qx"], 0.5), joins.nearest(q, p, "q", "p", ["qx"], ["px"], 0.5)
    assert sorted((r.p, r.q) for r in forth.collect()) == [(0, 0), (1, 0), (2, 1)]
    assert sorted((r.p, r.q) for r in joins.reciprocal(forth, back, "p", "q").collect()) == [(0, 0), (2, 1)]
    assert sorted((r.q, r.p) for r in joins.last_of_each(forth, "p", "q").collect()) == [(0, 1), (1, 2)]


def test_perfect_clouds(spark):
    d2 = spark.createDataFrame([(0.0,), (0.0,)], "d2 double")
    s = metrics.cloud_scores(d2, d2, 0.1).first()
    assert s.chamfer == 0 and math.isclose(s.fscore, 2 / (2 + 1e-9))


def test_clouds_that_are_empty_or_gated(spark):
    cloud = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (3, 0.0, 0.0, None)], "id int, x double, y double, z double")
    raised = spark.createDataFrame([(7, 0.0, 0.0, 0.5), (8, 1.0, 0.0, 0.05), (9, 1.05, 0.0, 0.0)], "id int, x double, y double, z double")
    none = cloud.limit(0)
    row = lambda *a, **k: metrics.compare_clouds(*a, 0.1, 0.5, **k).first()
    s = row(cloud, raised, z_gate=0.2, flat=True)
    assert (s.tp, s.fp, s.fn, s.n_truth, s.n_found) == (1, 1, 1, 2, 3) and math.isclose(s.chamfer, (0.25 + 0.0025) / 2 + (0.25 + 0.0025 + 0.0025) / 3)
    assert row(cloud, raised, flat=True).precision == 1 and row(cloud, raised).precision == 0.5
    assert row(cloud, raised, flat=True, last_only=True).fn == 1 and row(cloud, raised, z_band=(0.05, 0.5)).n_truth == 0
    s = row(none, none)
    assert (s.chamfer, s.precision, s.recall, s.tp, s.fn) == (0, 1, 1, 0, 0)
    s = row(cloud, none)
    assert (s.chamfer, s.precision, s.recall, s.tp, s.fp, s.n_found) == (math.inf, 0, 0, 0, 2, 0)


def test_surface_triangles_stand_on_their_own_corners(spark):
    from atlaspark.operators import frames

    rows = [(v, u, (v, u) != (1, 1), 10 * v + u) for v in range(3) for u in range(3)] + [(0, 0, True, 99)]
    df = spark.createDataFrame(rows, "v long, u long, ok boolean, shade int")
    at = lambda v, u: v * (1 << 20) + u
    valid, want = {(v, u): s for v, u, ok, s in rows[:9] if ok}, []
    for v in range(2):
        for u in range(2):
            a, b, c, e = (v, u), (v, u + 1), (v + 1, u), (v + 1, u + 1)
            for face, own in (((a, b, c), a), ((b, c, e), e)):
                if all(x in valid for x in face):
                    want += [(*(at(*x) for x in f), valid[own]) for f in (face, face[::-1])]
    assert sorted((r.a, r.b, r.c, r.shade) for r in frames.surface_faces(df, "ok", "shade").collect()) == sorted(want) and len(want) == 4
    assert frames.surface_faces(df.limit(0), "ok", "shade").count() == 0


def test_bev(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 0, 1), (1, 0, 1)], "u long, v long, n int")
    out = {(r.v, r.u): r.value for r in raster.bev_ternary(df, F.col("u"), F.col("v"), F.col("n") >= 3, F.col("n") < 3, 3, 1).collect()}
    assert out == {(0, 0): 100, (0, 1): 0, (0, 2): -1}


def test_graph(spark):
    e = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.4), (4, 5, 0.9), (0, 2, 0.1)], "src int, dst int, score double")
    nodes = spark.range(6).select(F.col("id").cast("int").alias("node"))
    groups = graph.components(nodes, e)
    assert {r.node: r.component for r in groups.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    assert {r.node: r.component for r in graph.merge_singletons(groups, 6).collect()} == {0: 0, 1: 0, 2: 0, 3: 4, 4: 4, 5: 4}
    assert sorted((r.src, r.dst) for r in graph.spanning_tree(e).collect()) == [(0, 1), (1, 2), (4, 5)]


def test_state_fold_matches_stream(spark, tmp_path):
    p = MapSettings()
    rows = [(k, e, s, (k * 7 + e * 3 + s) % 3 % 2) for k in range(5) for e in range(6) for s in range(3)]
    schema = "key long, epoch int, seq int, kind int"
    expected = {}
    for k, e, _, kind in sorted(rows):
        expected[k] = observe(expected.get(k, START), e, kind, p)
    batch = {r.key: (r.st, r.lt, r.hits, r.pos, r.neg, -1 if r.last_occ is None else r.last_occ, -1 if r.last_free is None else r.last_free) for r in fold(spark.createDataFrame(rows, schema), p).collect()}
    assert batch == expected
    for e in range(6):
        spark.createDataFrame([r for r in rows if r[1] == e], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = voxel_stream(stream, p).writeStream.format("memory").queryName("voxels").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {}
    for r in spark.sql("SELECT * FROM voxels").collect():
        if r.key not in last or r.last_occ + r.last_free >= last[r.key].last_occ + last[r.key].last_free:
            last[r.key] = r
    assert {k: tuple(r)[1:] for k, r in last.items()} == expected


def test_edge_ages(spark, tmp_path):
    rows = [("0_1", 0, True), ("0_1", 1, False), ("0_1", 2, False), ("1_2", 0, False), ("1_2", 1, True)]
    spark.createDataFrame(rows, "pair string, epoch int, ran boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pair string, epoch int, ran boolean").parquet(str(tmp_path / "in"))
    query = edge_ages(stream).writeStream.format("memory").queryName("ages").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.pair: r.age for r in spark.sql("SELECT * FROM ages").collect()} == {"0_1": 2, "1_2": 0}


def test_rays(spark):
    p = spark.createDataFrame([(0.95, 0.05, 0.05, 0.0, 0.05, 0.05)], "x double, y double, z double, cx double, cy double, cz double")
    keys = ray_cells(p, MapSettings(size=0.1), [])
    i, j, k = G.unpack_key(F.col("key"))
    assert sorted(r.i for r in keys.select(i.alias("i")).collect()) == list(range(9))


def test_demotion_clamps_all(spark):
    s = spark.createDataFrame([(1, 0.8, 10, 0), (2, -0.25, 4, 0)], "key int, lt double, neg int, last_occ int")
    out = {r.key: (round(r.lt, 6), r.demoted) for r in demote(s, 3, MapSettings()).collect()}
    assert out == {1: (0.3, True), 2: (0.0, False)}


def test_undistort_undoes_distortion(spark):
    df = spark.createDataFrame([(0.3, -0.2)], "x double, y double")
    radial = 1 + F.lit(0.1) * (F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    u, v = G.undistort(F.col("x") * radial, F.col("y") * radial, 0.1)
    r = df.select(u.alias("u"), v.alias("v")).first()
    assert math.isclose(r.u, 0.3, abs_tol=1e-9) and math.isclose(r.v, -0.2, abs_tol=1e-9)


def test_shortest_costs_and_coverage(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0)], "src int, dst int, cost double")
    assert {r.node: r.cost for r in graph.shortest_costs(e, 0).collect()} == {0: 0.0, 1: 1.0, 2: 2.0}


def test_nearest_settles_rows_however_far_away(spark):
    from atlaspark.operators import joins

    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e7, 0.0), (3, float("nan"), 0.0)], "p int, x double, y double")
    right = spark.createDataFrame([(7, 0.1, 0.0), (8, -3e6, 1.0), (9, None, 0.0)], "q int, a double, b double")
    found = joins.nearest(left, right, "p", "q", ["x", "y"], ["a", "b"], 0.1)
    assert sorted((r.p, r.q) for r in found.collect()) == [(1, 7), (2, 7)]
    assert joins.nearest(left, right.limit(0), "p", "q", ["x", "y"], ["a", "b"], 0.1).count() == 0


def test_quantiles_are_exact_in_any_number_of_ranges(spark):
    import numpy as np

    from atlaspark.operators import ordered

    r = np.random.default_rng(0)
    values = [(i % 3, float(v)) for i, v in enumerate(r.integers(0, 50, 500))] + [(0, None), (1, float("nan")), (4, None)]
    df = spark.createDataFrame(values, "g int, v double").repartition(7)
    numbers = [v for _, v in values if v is not None and v == v]
    want = {g: tuple(np.quantile([v for k, v in values if k == g and v is not None and v == v], [0.1, 0.77])) for g in range(3)}
    for few in (0, ordered.FEW):
        got = {x.g: (x.q0, x.q1) for x in ordered.quantiles_by(df, ["g"], "v", [0.1, 0.77], few).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[g], want[g]) for g in want)
        assert np.allclose(list(ordered.quantiles_by(df, [], "v", [0.0, 0.31, 1.0], few).first()), np.quantile(numbers, [0.0, 0.31, 1.0]))
    assert [x.n for x in ordered.numbered(df.select("v"), [df.v.asc_nulls_last()], "n").orderBy("n").select("n").collect()] == list(range(503))


def test_nearest_of_dense_clouds_and_copies(spark, monkeypatch):
    """Cells shrink until few rows lie in one, copies count once, and the lists of a full cell are many."""
    import numpy as np

    r = np.random.default_rng(4)
    where = lambda n: np.concatenate((np.round(r.normal(0, 0.01, (n, 2)), 3), r.integers(-40, 40, (n // 9, 2)), [[1e6, 0.0]] * 3)).tolist()
    p, q = ([(i, *c) for i, c in enumerate(where(900))] for _ in range(2))
    left, right = spark.createDataFrame(p, "p long, px double, py double"), spark.createDataFrame(q + [(i + 5000, x, y) for i, x, y in q], "q long, qx double, qy double")
    want = {}
    for i, x, y in p:
        want[i] = min(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in q)
    sizes, own = [], joins._own_cell
    monkeypatch.setattr(joins, "_own_cell", lambda df, coords, size: sizes.append(size) or own(df, coords, size))
    monkeypatch.setattr(joins, "FEW", 8)
    monkeypatch.setattr(joins, "LIST_ROWS", 3)
    for open_rows in (0, 50_000):
        monkeypatch.setattr(joins, "FEW_OPEN", open_rows)
        got = {x.p: (x.d2, x.q) for x in joins.nearest(left, right, "p", "q", ["px", "py"], ["qx", "qy"], 4.0).collect()}
        assert got == want and min(sizes) < 0.4


def test_first_rows_of_groups_without_one_task(spark):
    from atlaspark.operators import ordered

    rows = [(i % 3, float(i * 7 % 5), i) for i in range(200)] + [(7, 1.0, 900), (7, None, 901), (8, 1.0, 902), (None, 2.0, 903)]
    df = spark.createDataFrame(rows, "g int, y double, id int").repartition(5)
    want = sorted(r.id for r in windows.best_fraction(df, ["g"], [F.col("y"), F.col("id")], 0.7).collect())
    got = ordered.first_rows(df, ["g"], ["y", "id"], 0.7)
    assert sorted(r.id for r in got.collect()) == want and got.columns == df.columns
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert ordered.first_rows(df.limit(0), ["g"], ["y", "id"], 0.7).count() == 0


def test_pair_distances_of_tiles_and_copies(spark):
    import numpy as np

    r = np.random.default_rng(5)
    rows = [(g, float(x), float(y)) for g, n in ((0, 60), (1, 2), (2, 1), (3, 5)) for x, y in r.integers(0, 9 if g != 3 else 1, (n, 2))]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {x.g: (x.value, x.pairs) for x in metrics.pair_distances(df, "g", ["x", "y"], 0.3, tile=7, bins=16).collect()}
    for g in (0, 1, 3):
        p = np.array([(x, y) for h, x, y in rows if h == g])
        d = [np.hypot(*(p[i] - p[j])) for i in range(len(p)) for j in range(i)]
        assert got[g][1] == len(d) and math.isclose(got[g][0], np.quantile(d, 0.3), abs_tol=1e-9)
    assert got.keys() == {0, 1, 3}


def test_denoise_keeps_the_distance_where_named(spark):
    df = spark.createDataFrame([(float(i), 0.0, 0.0) for i in range(101)], "x double, y double, z double")
    kept = filters.denoise(df, 0.9, distance_name="far")
    assert kept.columns == ["x", "y", "z", "far"] and kept.agg(F.max("far")).first()[0] == 44.0


def test_radius_join_settles_copies_as_one_place(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIST_ROWS", 10)
    r, cuts = random.Random(8), 0
    places = [(r.uniform(-1, 1), r.uniform(-1, 1)) for _ in range(12)]
    left = [(i, *places[i % 12]) for i in range(60)] + [(100, None, 0.0), (101, float("nan"), 0.0), (102, float("inf"), 0.0), (103, -0.0, 5.0)]
    right = [(i, *places[i % 3]) for i in range(90)] + [(i, *places[i % 12]) for i in range(90, 120)] + [(200, None, 0.0), (201, float("nan"), 0.0), (202, float("inf"), 0.0), (203, 0.0, 5.0)]
    p, q = spark.createDataFrame(left, "p int, px double, py double"), spark.createDataFrame(right, "q int, qx double, qy double")
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] is not None and b[1] is not None and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.36)
    found = joins.radius_join(p, q, ["px", "py"], ["qx", "qy"], 0.6)
    assert found.columns == ["p", "px", "py", "q", "qx", "qy", "d2"] and sorted((x.p, x.q) for x in found.collect()) == want
    near = joins.near_places(p, q, ["px", "py"], ["qx", "qy"], 0.6).collect()
    assert len(near) < len(want) / 5 and sum(len(x["_left"]) * len(x["_right"]) for x in near) == len(want)
    assert max(len(x["_right"]) for x in near) < 33


def test_radius_join_deals_one_place_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIST_ROWS", 16)
    monkeypatch.setattr(joins, "TASK_ROWS", 300, raising=False)
    p = spark.createDataFrame([(i, 2.0 - (i % 2) * 0.25, 0.0) for i in range(1000)], "p int, px double, py double")
    q = spark.createDataFrame([(i, 2.0, 0.5) for i in range(1100)], "q int, qx double, qy double")
    found = joins.place_rows(joins.near_places(p, q, ["px", "py"], ["qx", "qy"], 0.5)).groupBy(F.spark_partition_id().alias("task"))
    found = found.agg(F.count("*").alias("n"), F.countDistinct("p", "q").alias("pairs"), F.countDistinct("p").alias("p"), F.countDistinct("q").alias("q")).collect()
    assert sum(x.n for x in found) == sum(x.pairs for x in found) == 500 * 1100
    assert len(found) >= 3 and max(x.n for x in found) < 500 * 1100 / 2


def test_radius_join_writes_copies_in_few_bytes(spark, tmp_path):
    # 357 copies of each of 6 places, an odd number, which hashes cut into uneven lists.
    cloud = lambda n: spark.range(6 * 357).select(F.col("id").alias(n), (F.col("id") % 6).cast("double").alias(f"{n}x"))
    joins.place_rows(joins.near_places(cloud("p"), cloud("q"), ["px"], ["qx"], 0.5)).select("p", "q", "d2").coalesce(1).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 6 * 357 * 357
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.2 * 6 * 357 * 357


def test_near_places_keep_all_columns_nulls_and_edges(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIST_ROWS", 8)
    monkeypatch.setattr(joins, "TASK_ROWS", 40, raising=False)
    r = random.Random(3)
    at = lambda: tuple(r.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 1e19, -3.7]) for _ in range(3))
    left = [(i if i % 5 else None, "a" if i % 3 else None, *at()) for i in range(300)]
    right = [(i, *at(), i % 2 == 0) for i in range(280)] + [(i, 0.0, 0.25, 0.5, None) for i in range(280, 380)]
    p, q = spark.createDataFrame(left, "p int, s string, px double, py double, pz double"), spark.createDataFrame(right, "q int, qx double, qy double, qz double, t boolean")
    want = [(a, b) for a in left for b in right if sum((x - y) ** 2 for x, y in zip(a[2:], b[1:4], strict=True)) <= 0.0625]
    found = joins.radius_join(p, q, ["px", "py", "pz"], ["qx", "qy", "qz"], 0.25)
    assert found.columns == ["p", "s", "px", "py", "pz", "q", "qx", "qy", "qz", "t", "d2"]
    assert sorted(map(str, (tuple(x)[:10] for x in found.collect()))) == sorted(str((*a, *b)) for a, b in want)
    assert joins.radius_join(p.limit(0), q, ["px", "py", "pz"], ["qx", "qy", "qz"], 0.25).count() == 0
