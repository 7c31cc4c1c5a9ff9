import numpy as np
from pyspark.sql import functions as F

from atlaspark.operators import align


def cloud(spark, x, names="x double, y double, z double"):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], names)


def test_similarity_and_its_transpose(spark):
    r = np.array([[np.cos(0.7), -np.sin(0.7), 0], [np.sin(0.7), np.cos(0.7), 0], [0, 0, 1]])
    p = np.random.default_rng(0).normal(size=(20, 3))
    q = 1.7 * p @ r.T + [1, 2, 3]
    df = cloud(spark, np.hstack([p, q]), ", ".join(f"{a} double" for a in ("x", "y", "z", "u", "v", "w")))
    s = align.similarity(df, ["x", "y", "z"], ["u", "v", "w"])
    assert np.isclose(s.scale, 1.7) and np.allclose(s.rotation, r) and np.allclose(s.shift, [1, 2, 3])
    assert np.allclose(align.similarity(df, ["x", "y", "z"], ["u", "v", "w"], transposed=True).rotation, r.T)


def test_icp_finds_a_small_motion(spark):
    p = np.random.default_rng(1).uniform(0, 5, size=(40, 3))
    q = p + [0.05, -0.03, 0.02]
    a = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "p int, x double, y double, z double")
    b = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "q int, qx double, qy double, qz double")
    s = align.icp(a, b, radius=0.5, size=0.5, rounds=3)
    assert np.allclose(s.shift, [0.05, -0.03, 0.02], atol=1e-6) and np.isclose(s.scale, 1)


def test_icp_weighs_far_pairs_and_uncertain_points_less(spark):
    r = np.random.default_rng(5)
    p = np.array([[x, y, z] for x in range(4) for y in range(4) for z in range(3)], float) + r.uniform(-0.1, 0.1, (48, 3))
    q = p + [0.05, -0.03, 0.02]
    q[::6] += [0.25, 0.25, 0.0]
    conf = [0.0 if i % 6 == 0 else 1.0 for i in range(48)]
    conf[6], conf[12], conf[18] = None, float("nan"), -1.0
    a = spark.createDataFrame([(i, *map(float, v), c) for i, (v, c) in enumerate(zip(p, conf, strict=True))], "p int, x double, y double, z double, c double")
    b = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "q int, qx double, qy double, qz double")
    def away(**k):
        s = align.icp(a, b, 0.6, 0.5, 4, **k)
        return np.abs(s.scale * s.rotation @ p[1] + s.shift - q[1]).max()

    plain, robust, sure = away(), away(huber=0.02), away(conf="c")
    assert sure < 1e-6 and robust < plain / 2


def test_floor_plane(spark):
    r = np.random.default_rng(2)
    floor = np.column_stack([r.uniform(0, 4, 300), r.uniform(0, 4, 300), r.normal(0.5, 0.002, 300)])
    rest = r.uniform(0, 4, (200, 3)) + [0, 0, 0.6]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(np.vstack([floor, rest]))], "id int, x double, y double, z double")
    n, d = align.floor_plane(df, "id", 0.02, share=0.6)
    assert n[2] > 0.999 and abs(d - 0.5) < 0.01
    assert np.allclose(align.upright_rotation(n) @ n, [0, 0, 1])
    assert df.where(F.col("z") < 0).count() == 0
