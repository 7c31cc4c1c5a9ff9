"""The vector map against numpy, image parts against a flood fill."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlaspark.operators import images, latent


def weights(d, r):
    m = lambda rows, cols: r.normal(size=(rows, cols)).tolist()
    gates = ("reset", "keep", "new")
    return latent.LatentWeights(
        gate=m(d, 2 * d), gate_bias=m(1, d)[0], message={g: m(d, d) for g in gates}, state={g: m(d, d) for g in gates},
        message_bias={g: m(1, d)[0] for g in gates}, state_bias={g: m(1, d)[0] for g in gates},
        point_projection=m(3, d), voxel_projection=m(3, d), offset=(0.2, -0.1, 0.4), bias=0.3, temperature=0.8,
    )


def test_update_is_the_plain_one(spark):
    r, d, radius, most = np.random.default_rng(5), 4, 1.1, 3
    w = weights(d, r)
    voxels = [(k, *(np.array(np.unravel_index(k, (3, 3, 2))) + 0.5).tolist(), r.normal(size=d).tolist()) for k in range(18)] + [(90, 40.0, 0.0, 0.0, [1.0] * d), (91, 0.5, 0.5, 0.5, None), (92, None, 0.0, 0.0, [2.0] * d)]
    points = [(i, *r.uniform(0, 3, 3).tolist(), r.normal(size=d).tolist()) for i in range(50)] + [(60, float("nan"), 0.0, 0.0, [1.0] * d), (61, 1.0, 1.0, 1.0, None), (62, 500.0, 0.0, 0.0, [1.0] * d)]
    z = {v[0]: np.array(v[4]) for v in voxels[:19]}
    u = defaultdict(lambda: np.zeros(d))
    for _, *p, f in points[:50]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, v[1:4], strict=True)), v[0]) for v in voxels[:19])
        near = [k for d2, k in near if d2 <= radius * radius][:most]
        sim = []
        for k in near:
            a, b = np.array(w.point_projection) @ f, np.array(w.voxel_projection) @ z[k]
            sim.append(w.temperature * (a @ b / ((np.linalg.norm(a) + 1e-6) * (np.linalg.norm(b) + 1e-6)) + np.array(w.offset) @ (np.array(p) - voxels[k][1:4]) + w.bias))
        e = np.exp((np.array(sim) - max(sim)) / 0.5) if sim else []
        for k, x in zip(near, e, strict=True):
            u[k] = u[k] + x / (sum(e) + 1e-8) * np.array(f)
    s = lambda x: 1 / (1 + np.exp(-x))
    want = dict(z)
    for k, m in u.items():
        x = m * s(np.array(w.gate) @ np.concatenate((m, z[k])) + w.gate_bias)
        part = {g: (np.array(w.message[g]) @ x + w.message_bias[g], np.array(w.state[g]) @ z[k] + w.state_bias[g]) for g in w.message}
        keep, reset = s(sum(part["keep"])), s(sum(part["reset"]))
        want[k] = (1 - keep) * np.tanh(part["new"][0] + reset * part["new"][1]) + keep * z[k]
    p = spark.createDataFrame(points, "point_id int, x double, y double, z double, f array<double>")
    v = spark.createDataFrame(voxels, "key long, cx double, cy double, cz double, z_latent array<double>")
    got = {x.key: x.z_latent for x in latent.update(p, v, w, d, radius, 0.5, most).collect()}
    assert got.keys() == {x[0] for x in voxels} and got[91] is None and got[92] == [2.0] * d
    assert all(np.allclose(got[k], want[k]) for k in want) and len(u) > 10
    assert {x.key: x.z_latent for x in latent.update(p.limit(0), v, w, d, radius).collect()} == {x[0]: x[4] for x in voxels}


def pairs_by_brute_force(points, voxels, radius, most):
    near = {i: sorted((sum((a - b) ** 2 for a, b in zip(p, v[1:4], strict=True)), v[0]) for v in voxels) for i, *p in points}
    return {(i, k) for i, found in near.items() for k in [k for d2, k in found if d2 <= radius * radius][:most]}


@pytest.mark.parametrize("few", [True, False])
def test_points_are_not_exchanged_by_point(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(latent, "FEW_OPEN", 0)
    r = np.random.default_rng(9)
    voxels = [(k, *r.uniform(-2, 2, 3).tolist(), [1.0, 0.5]) for k in range(40)]
    points = [(i, *r.uniform(-2, 2, 3).tolist()) for i in range(60)]
    p = spark.createDataFrame(points, "point_id int, x double, y double, z double")
    v = spark.createDataFrame(voxels, "key long, cx double, cy double, cz double, z_latent array<double>")
    found = latent.near_voxels(p, v, 1.3, 2)
    assert {(x.point_id, x.key) for x in found.collect()} == pairs_by_brute_force(points, voxels, 1.3, 2)
    w = weights(2, r)
    sent = latent.messages(p.withColumn("f", F.array("x", "y")), v, w, 2, 1.3, 0.5, 2)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(point_id" not in plan and ("Exchange hashpartitioning(_c0" not in plan) == few
    assert {x.key for x in sent.collect()} == {k for _, k in pairs_by_brute_force(points, voxels, 1.3, 2)}


def test_copies_of_a_point_are_points_of_their_own(spark):
    r = np.random.default_rng(3)
    v = spark.createDataFrame([(k, k * 0.5, 0.0, 0.0, r.normal(size=2).tolist()) for k in range(3)], "key long, cx double, cy double, cz double, z_latent array<double>")
    p = spark.createDataFrame([(7, 0.4, 0.0, 0.0, [1.0, 2.0])] * 2 + [(8, 0.1, 0.0, 0.0, [1.0, None]), (9, 0.1, 0.0, 0.0, [1.0])], "point_id int, x double, y double, z double, f array<double>")
    one, both = ({x.key: x.message for x in latent.messages(q, v, weights(2, np.random.default_rng(1)), 2, 1.0, 1.0, 2).collect()} for q in (p.where("point_id = 7").limit(1), p))
    assert one.keys() == both.keys() == {0, 1} and all(np.allclose(np.array(one[k]) * 2, both[k]) for k in one)


def flood(mask, diagonal):
    part = {}
    for p in sorted(mask):
        if p not in part:
            part[p], open_ = p, [p]
            while open_:
                g, v, u = open_.pop()
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        q = (g, v + a, u + b)
                        if q in mask and q not in part and (diagonal or not a or not b):
                            part[q] = p
                            open_.append(q)
    return {k: v[1] * 2**31 + v[2] for k, v in part.items()}


@pytest.mark.parametrize("diagonal, tile", [(True, 4), (False, 3), (True, 64)])
def test_parts_are_flood_fills(spark, diagonal, tile):
    r = random.Random(tile)
    mask = {(g, v, u) for g in "ab" for v in range(17) for u in range(13) if r.random() < (0.4 if diagonal else 0.55)}
    spiral = [(0, u) for u in range(20)] + [(v, 19) for v in range(20)] + [(19, u) for u in range(20)] + [(v, 0) for v in range(2, 20)] + [(2, u) for u in range(18)]
    mask |= {("spiral", v, u) for v, u in spiral}
    rows = [*mask, *list(mask)[:5], ("a", None, 3), (None, 1, 1)]
    parts = images.connected_parts(spark.createDataFrame(rows, "image string, v int, u int"), tile=tile, diagonal=diagonal)
    found = {(x.image, x.v, x.u): x.part for x in parts.collect()}
    assert found.pop((None, 1, 1)) == 2**31 + 1
    want = flood(mask, diagonal)
    assert found == want and len({p for (g, *_), p in want.items() if g == "spiral"}) == 1
    sizes = defaultdict(int)
    for (g, *_), p in want.items():
        sizes[g, p] += 1
    large = {(g, p, n) for (g, p), n in sizes.items() if n > max(m for (h, _), m in sizes.items() if h == g) / 2}
    assert {(x.image, x.part, x["size"]) for x in images.large_parts(parts).collect() if x.image} == large
    assert images.connected_parts(parts.limit(0)).count() == 0
