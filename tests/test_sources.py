from pyspark.sql import functions as F

from atlaspark.sources import files, sinks


def test_frame_files(spark, tmp_path):
    for name in ("cam1/0001.jpg", "cam1/x2.PNG", "Cam2/7.jpeg", "other/3.jpg", "cam1/readme.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    df = files.frame_files(spark, str(tmp_path))
    assert sorted((r.cam, r.idx) for r in df.collect()) == [("Cam2", 7), ("cam1", 1), ("cam1", 2)]
    assert sorted(r.target for r in sinks.export_manifest(df).collect()) == ["Cam2/00000007.jpeg", "cam1/00000001.jpg", "cam1/00000002.png"]


def test_text_model(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 500 501 320 240\n")
    (tmp_path / "images.txt").write_text("# i\n1 1 0 0 0 0.5 0 0 1 a.jpg\n1.5 2.5 7 3 4 -1\n2 1 0 0 0 0 0 0 1 b.jpg\n\n")
    (tmp_path / "points3D.txt").write_text("# p\n7 1 2 3 9 9 9 1.0 1 0 2 5\n")
    assert files.model_cameras(spark, str(tmp_path / "cameras.txt")).first().params == [500, 501, 320, 240]
    a, b = files.model_images(spark, str(tmp_path / "images.txt")).orderBy("image_id").collect()
    assert (a.name, a.t, [(p.x, p.point3d_id) for p in a.points]) == ("a.jpg", [0.5, 0, 0], [(1.5, 7)]) and b.points == []
    p = files.model_points(spark, str(tmp_path / "points3D.txt")).first()
    assert [(t.image_id, t.idx) for t in p.track] == [(1, 0), (2, 5)] and p.conf == 0.5 * 0.4


def test_small_files(spark, tmp_path):
    (tmp_path / "t.traj").write_text("1.5 0 0 0 1 2 3\nbad line\n")
    (tmp_path / "pairs.txt").write_text("# all\na b\nc d # last\n\n")
    (tmp_path / "poses.json").write_text('{"poses":[{"camera_index":3,"file_path":"a","depth_file":"b","transform_matrix":[[1,0],[0,1]]}]}')
    assert files.trajectory(spark, str(tmp_path / "t.traj")).first().tz == 3
    assert [(r.first, r.second) for r in files.pair_list(spark, str(tmp_path / "pairs.txt")).collect()] == [("a", "b"), ("c", "d")]
    assert files.simulator_poses(spark, str(tmp_path / "poses.json")).first().pose == [1, 0, 0, 1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3)], "i long, j long, k long")
    sinks.write_voxels(df, str(tmp_path / "v"), {"voxel_size": 0.1})
    back, meta = sinks.read_voxels(spark, str(tmp_path / "v"))
    assert back.collect() == df.collect() and meta == {"voxel_size": 0.1}
    sinks.write_ply(df.select(*[(F.col(c) * 0.5).alias(n) for c, n in zip("ijk", "xyz", strict=True)]), str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p/1-vertices")).collect()] == ["0.500000 1.000000 1.500000"]


def test_text_model_writer(spark, tmp_path):
    cams = spark.createDataFrame([(0, "PINHOLE", 4, 3, [1.0, 2.0])], "camera_id int, model string, width int, height int, params array<double>")
    images = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.5], 0, f"{i}.jpg") for i in range(2)], "image_id int, q array<double>, t array<double>, camera_id int, name string")
    tracks = spark.createDataFrame([(0, 0, 1.5, 2.5), (0, 1, 1.0, 2.0), (1, 0, 9.0, 9.0)], "track_id int, image_id int, x double, y double")
    points = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)], "track_id int, x double, y double, z double")
    sinks.write_text_model(cams, images, tracks, points, str(tmp_path / "m"))
    lines = lambda name: sorted(r.value for r in spark.read.text(str(tmp_path / "m" / name)).collect())
    assert lines("points") == ["1 1.0 2.0 3.0 0 0 0 0 1 0 2 0"]
    assert "1.5 2.5 1" in lines("images") and "2 1.0 0.0 0.0 0.0 0.0 0.0 0.5 1 1.jpg" in lines("images")


def test_dense_files_round_trip(spark, tmp_path):
    import numpy as np

    from atlaspark.sources import dense

    flow = np.arange(24, dtype=np.float32).reshape(3, 4, 2)
    flow[1, 2] = np.inf
    (tmp_path / "a.flo").write_bytes(dense.encode_flow(flow))
    pixels = dense.dense_files(spark, str(tmp_path), "flo")
    found = {(r.v, r.u): r.value for r in pixels.collect()}
    assert len(found) == 12 and found[0, 1] == [2.0, 3.0] and found[1, 2] is None
    back = dense.flow_contents(pixels).first().content
    assert np.array_equal(dense.decode_flow(bytes(back)), flow)
    depth = np.array([[1.5, 2.5], [3.5, 4.5]], "<f4")
    (tmp_path / "d.pfm").write_bytes(b"Pf\n2 2\n-1.0\n" + depth[::-1].tobytes())
    assert {(r.v, r.u): r.value for r in dense.dense_files(spark, str(tmp_path), "pfm").collect()} == {(0, 0): [1.5], (0, 1): [2.5], (1, 0): [3.5], (1, 1): [4.5]}
    rows = np.array([(1, 2, 0.5), (3, 4, 0.25)], [("scene_id", "i4"), ("im1_id", "i4"), ("score", "f8")])
    np.savez(tmp_path / "p.npz", pairs=rows, other=[1])
    got = dense.structured_arrays(spark, str(tmp_path), "pairs", "scene_id int,im1_id int,score double")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 0.5), (3, 4, 0.25)]


def test_sequences_annotations_and_texts(spark, tmp_path):
    import gzip

    for name in ("s1/f10.jpg", "s1/f9.jpg", "s1/x.txt", "s2/a.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = files.sequences(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["f9.jpg", "f10.jpg"]
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('[{"sequence_name": "q", "frame_number": 3}, {"sequence_name": "r", "frame_number": null}]')
    assert files.annotations(spark, str(tmp_path / "a.json.gz"), "sequence_name string, frame_number int").count() == 2
    (tmp_path / "t.txt").write_text("Before icp:\n9 9\nAfter general icp:\n1 0 0 0.5\n0 1 0 -2e-1\n0 0 1 3\n0 0 0 1\nend 7\n")
    (tmp_path / "u.txt").write_text("nothing\n")
    assert files.alignment_text(spark, str(tmp_path / "*.txt")).first().pose == [1, 0, 0, 0.5, 0, 1, 0, -0.2, 0, 0, 1, 3, 0, 0, 0, 1]
    grid = files.scene_grid(spark, "room_%d_%d", 5, 21)
    assert grid.count() == 105 and grid.where("name = 'room_4_20'").count() == 1


def test_floor_plan_sink(spark, tmp_path):
    bev = spark.createDataFrame([(0, 0, 100), (2, 4, -1)], "v int, u int, value int")
    sinks.write_bev(bev, f"{tmp_path}/bev", 0.05, (1.0, 2.0), (0.1, 1.8))
    cells, meta = sinks.read_bev(spark, f"{tmp_path}/bev")
    assert (meta["width"], meta["height"], meta["origin_xy"]) == (5, 3, [1.0, 2.0]) and sorted(r.value for r in cells.collect()) == [-1, 100]
