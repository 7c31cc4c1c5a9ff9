"""Schedules of pairs, registration of pose sets and splines of turns against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from atlaspark.operators import align, frames, steps


def test_schedule_is_the_plain_one(spark):
    r = random.Random(1)
    edges = [(u, v, round(r.random(), 6)) for u in range(9) for v in range(u + 1, 9) if r.random() < 0.5]
    changes = [(e, v) for e in (1, 2, 5, 9, 10) for v in r.sample(range(11), r.randint(0, 8))]
    up, tree = list(range(9)), []
    for s, u, v in sorted((-s, u, v) for u, v, s in edges):
        if up[u] != up[v]:
            tree.append((u, v, -s))
            up = [up[u] if x == up[v] else x for x in up]
    for budget, plus_one in ((2, True), (2, False), (0, True), (50, False)):
        ages, want, started = {e[:2]: 0 for e in tree}, [], sorted({e for e, _ in changes})
        for epoch in started:
            run = []
            for node in sorted(v for e, v in changes if e == epoch):
                if len(run) > budget - (not plus_one):
                    break
                mine = [(-s, v if u == node else u, (u, v)) for u, v, s in tree if node in (u, v)]
                if mine and min(mine)[2] not in run:
                    run.append(min(mine)[2])
            want += [(epoch, i, *e, ages[e]) for i, e in enumerate(run)]
            ages = {e: 0 if e in run else a + 1 for e, a in ages.items()}
        got = steps.schedule(spark.createDataFrame(edges, "src int, dst int, score double"), spark.createDataFrame([*changes, changes[0], (None, 1), (3, None)], "epoch int, node int").where("node IS NOT NULL"), budget, plus_one)
        assert sorted((x.epoch, x.place, x.src, x.dst, x.age) for x in got.collect()) == sorted(want)


def poses(n, seed=0):
    r = np.random.default_rng(seed)
    z = r.normal(size=(n, 3))
    return [(i, *c, *a) for i, (c, a) in enumerate(zip(r.normal(size=(n, 3)).tolist(), (z / np.linalg.norm(z, axis=1)[:, None]).tolist(), strict=True))]


def test_pose_sets(spark):
    angle = 0.7
    rot = np.array([[1, 0, 0], [0, np.cos(angle), -np.sin(angle)], [0, np.sin(angle), np.cos(angle)]])
    schema = "pose_id int, x double, y double, z double, zx double, zy double, zz double"
    rows = poses(12)
    moved = [(i, *(2.5 * rot @ p[:3] + [1, 2, 3]).tolist(), *(rot @ p[3:]).tolist()) for i, *p in rows for p in [np.array(p)]]
    odd = [(90, 1.0, 1.0, 1.0, 1.0, 0.0, None), (91, float("nan"), 1.0, 1.0, 1.0, 0.0, 0.0)]
    s = align.pose_sets(spark.createDataFrame([*rows, *odd, (77, *[1.0] * 6)], schema), spark.createDataFrame([*moved, *odd], schema))
    assert np.isclose(s.scale, 2.5) and np.allclose(s.rotation, rot) and np.allclose(s.shift, [1, 2, 3])
    # Centres on a line leave a turn open, which the axes settle; poses in one place have no scale.
    line = [(i, float(i), 0.0, 0.0, 0.0, float(np.cos(i)), float(np.sin(i))) for i in range(5)]
    turned = [(i, *(rot @ p[:3]).tolist(), *(rot @ p[3:]).tolist()) for i, *p in line for p in [np.array(p)]]
    assert np.allclose(align.pose_sets(spark.createDataFrame(line, schema), spark.createDataFrame(turned, schema)).rotation, rot)
    here = [(i, 1.0, 1.0, 1.0, *p[4:]) for i, *p in [(x[0], *x) for x in rows]]
    s = align.pose_sets(spark.createDataFrame(here, schema), spark.createDataFrame([(i, 5.0, 1.0, 1.0, *(rot @ np.array(a)).tolist()) for i, _, _, _, *a in here], schema))
    assert s.scale == 1.0 and np.allclose(s.rotation, rot)
    assert align.spacing(spark.createDataFrame(rows[:1], schema), ["x", "y", "z"]) is None


def mul(a, b):
    (w, x, y, z), (p, q, r, s) = a, b
    return np.array([w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p])


def inv(q):
    return q * np.array([1, -1, -1, -1])


def log(q):
    n = np.linalg.norm(q[1:])
    return np.concatenate(([0.0], q[1:] / n * np.arctan2(n, q[0]) if n else np.zeros(3)))


def exp(v):
    n = np.linalg.norm(v[1:])
    return np.concatenate(([np.cos(n)], v[1:] / n * np.sin(n) if n else np.zeros(3)))


def slerp(a, b, t):
    return mul(exp(log(mul(b, inv(a))) * t), a)


def plain_squad(t, ts, qs):
    i = max(k for k in range(len(ts)) if ts[k] <= t)
    if ts[i] == t:
        return qs[i]
    near = lambda q, p: q if q @ p >= 0 else -q
    q, n = qs[i], near(qs[i + 1], qs[i])
    d = ts[i + 1] - ts[i]
    a = q if i == 0 else mul(q, exp((log(mul(inv(near(qs[i - 1], q)), q)) * d / (ts[i] - ts[i - 1]) - log(mul(inv(q), n))) / 4))
    b = n if i + 2 == len(ts) else mul(n, exp((log(mul(inv(n), near(qs[i + 2], n))) * d / (ts[i + 2] - ts[i + 1]) - log(mul(inv(q), n))) / -4))
    s = (t - ts[i]) / d
    return slerp(slerp(q, n, s), slerp(a, b, s), 2 * s * (1 - s))


def test_splines_of_turns(spark):
    r = np.random.default_rng(2)
    ts = np.cumsum(r.uniform(0.3, 2, 30))
    steps_ = r.normal(size=(30, 4)) * 0.25
    qs = [np.array([1.0, 0, 0, 0])]
    for v in steps_[1:]:
        q = mul(qs[-1], exp(np.array([0, *v[1:]])))
        qs.append(q if r.random() < 0.7 else -q)
    rows = [(float(t), *(3 * q).tolist()) for t, q in zip(ts, qs, strict=True)] + [(None, 1.0, 0.0, 0.0, 0.0), (4.0, 0.0, 0.0, 0.0, 0.0)]
    times = sorted([*r.uniform(ts[0], ts[-1], 80), ts[4], ts[0], ts[-1]])
    df = spark.createDataFrame(rows, "at double, qw double, qx double, qy double, qz double").repartition(5)
    asked = spark.createDataFrame([(i, float(t)) for i, t in enumerate(times)] + [(900, float(ts[0] - 1)), (901, float(ts[-1] + 1)), (902, None)], "id int, at double").repartition(3)
    got = {x.id: x for x in frames.interpolate_turns(asked, df, "at").collect()}
    assert len(got) == len(times) + 3 and all(got[i].qw is None for i in (900, 901, 902))
    for i, t in enumerate(times):
        q = np.array([got[i].qw, got[i].qx, got[i].qy, got[i].qz])
        p = plain_squad(t, ts, qs)
        assert min(np.abs(q - p).max(), np.abs(q + p).max()) < 1e-9
    one = frames.interpolate_turns(asked, df.where(F.col("at") == float(ts[4])), "at").where("qw IS NOT NULL").collect()
    assert [x.at for x in one] == [ts[4]]
