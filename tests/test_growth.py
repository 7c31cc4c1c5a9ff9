"""Greedy growth, farthest-first order and spectral groups against plain Python and numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlaspark.operators import graph, growth, joins, spectral


def plain_growth(n, w, least, start, steps=100):
    a = np.eye(n)
    for u, v, s in w:
        a[u, v] = a[v, u] = max(a[u, v], s)
    chosen, out = [], []
    new = list(enumerate([int(np.argmax(a.sum(axis=1)))] if start is None else start))
    step, gain = 0, None
    while True:
        chosen += [v for _, v in new]
        cover = a[:, chosen].max(axis=1)
        out += [(step, p, v, gain if v == new[-1][1] else None, round(cover.mean(), 9)) for p, v in new]
        if cover.mean() >= least or step == steps:
            return out
        gains = [(-np.maximum(0, a[:, c] - cover).sum() / n, c) for c in range(n) if c not in chosen]
        if not gains or -min(gains)[0] <= 0:
            return out
        gain, best = -min(gains)[0], min(gains)[1]
        source = min(chosen, key=lambda v: (sum(a[v, x] for x in chosen if x != v), v))
        tree = {}
        costs = {(u, v): 1 / (a[u, v] + 1e-6) for u in range(n) for v in range(n) if u != v and a[u, v] > 0}
        tree, open_ = {source: (0, 0, None)}, True
        while open_:
            open_ = False
            for (u, v), c in costs.items():
                if u in tree and (tree[u][0] + c, tree[u][1] + 1, u) < (tree[v] if v in tree else (np.inf, 0, 0))[:3] and v != source:
                    tree[v], open_ = (tree[u][0] + c, tree[u][1] + 1, u), True
        path, v = [], best if best in tree else None
        while v is not None:
            path.append(v)
            v = tree[v][2]
        path = list(enumerate(path[::-1])) or [(0, best)]
        new, step = [(p, v) for p, v in path if v not in chosen], step + 1


CASES = [(1, 12, 30, None, 0.8), (2, 9, 8, [3, 0], 0.95), (3, 6, 0, None, 0.5), (4, 40, 200, None, 0.9), (5, 40, 60, [1, 2], 1.0)]


@pytest.mark.parametrize("small", [graph.SMALL, 0])
@pytest.mark.parametrize("seed, n, m, start, least", CASES)
def test_growth_is_the_plain_greedy_one(spark, monkeypatch, seed, n, m, start, least, small):
    if not small and n > 10:
        return
    r = random.Random(seed)
    w = [(u, v, r.random()) for u, v in (sorted(r.sample(range(n), 2)) for _ in range(m))]
    nodes, edges = spark.range(n).select(F.col("id").alias("node")), spark.createDataFrame([*w, (0, 0, 3.0)], "src int, dst int, score double")
    monkeypatch.setattr(growth, "HEAD", 4)
    got = growth.grow(nodes, edges, least, start, small=small).collect()
    want = plain_growth(n, w, least, start)
    assert sorted((x.step, x.place, x.node, round(x.coverage, 9)) for x in got) == sorted((*x[:3], x[4]) for x in want)
    assert np.allclose(sorted(x.gain for x in got if x.gain is not None), sorted(x[3] for x in want if x[3] is not None))


@pytest.mark.parametrize("last_only", [False, True])
def test_farthest_first(spark, last_only):
    x = np.random.default_rng(4).normal(size=(40, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, None), (51, [0.0] * 5), (52, x[3].tolist())]
    u = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and any(v)}
    first = max(u, key=lambda i: (sum(u[i] @ v for v in u.values()), -i))
    want, least = [first], {i: np.inf for i in u}
    while len(want) < 20:
        for i in least:
            d = 1 - u[i] @ u[want[-1]]
            least[i] = d if last_only else min(least[i], d)
        want.append(max((i for i in u if i not in want), key=lambda i: (round(least[i], 12), -i)))
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    got = growth.farthest_first(df, 20, last_only=last_only, every=6).orderBy("place").collect()
    assert [r.id for r in got] == want and got[0].distance is None
    assert growth.farthest_first(df.limit(0), 3).count() == 0 and growth.farthest_first(df.where("id < 2"), 5).count() == 2


def blocks(sizes, seed=0, inner=0.6, outer=0.01):
    r, at, out = random.Random(seed), [], []
    for k, s in enumerate(sizes):
        at += [k] * s
    for u in range(len(at)):
        out += [(u, v, r.uniform(0.8, 1.0)) for v in range(u) if r.random() < (inner if at[u] == at[v] else outer)]
    return at, out


@pytest.mark.parametrize("dense", [spectral.DENSE, 10])
def test_planted_blocks_are_found_whole(spark, dense):
    at, w = blocks([8, 9, 7], 5, 0.9)
    df = spark.createDataFrame(w, "src int, dst int, score double")
    links = spectral.affinity(df, 0.5, 2)
    values, vectors = spectral.laplacian(links, 5, dense, 1e-7)
    m = np.eye(len(at))
    for u, v, s in w:
        m[u, v] = m[v, u] = s
    d = np.sqrt(m.sum(axis=1))
    exact = np.linalg.eigvalsh(np.eye(len(at)) - m / np.outer(d, d))[:5]
    assert np.abs(np.array(values) - exact).max() < 1e-6
    v = np.array([r.v for r in vectors.orderBy("node").collect()])
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-6)
    assert spectral.eigengap(values) == 3
    if dense < len(at):
        return
    found = {r.node: r.component for r in spectral.spectral_groups(df, len(at)).collect()}
    assert found == {i: at.index(k) for i, k in enumerate(at)}


def test_spectral_groups_of_little(spark):
    df = spark.createDataFrame([(0, 1, 0.9), (1, 0, None), (2, 2, 0.4), (0, 1, float("nan"))], "src int, dst int, score double")
    assert {r.node for r in spectral.spectral_groups(df, 3).collect()} == {0, 1}
    assert spectral.spectral_groups(df.limit(0), 3).count() == 0


def test_nearest_of_points_far_away(spark):
    r = random.Random(8)
    right = [(i, r.uniform(-5, 5), r.uniform(-5, 5)) for i in range(60)] + [(100, 3e19, 0.0)]
    left = [(i, r.uniform(-5, 5), r.uniform(-5, 5)) for i in range(300)] + [(1000, 1e19, 1e3), (1001, -1e19, 0.0), (1002, 1e300, 1e300), (1003, float("inf"), 0.0), (1004, 500.0, 0.0)]
    far = [(2000 + i, 4000.0 + i, 1e6) for i in range(300)]
    cols = "i int, x double, y double"
    a, b = spark.createDataFrame(left + far, cols), spark.createDataFrame(right, "j int, u double, v double")
    got = {x.i: x.j for x in joins.nearest(a, b, "i", "j", ["x", "y"], ["u", "v"], 0.5).collect()}
    ok = [p for p in left + far if p[0] not in (1003,)]
    want = {i: min(((x - u) * (x - u) + (y - v) * (y - v), j) for j, u, v in right)[1] for i, x, y in ok}
    assert got == want
    assert joins.nearest(a, b.limit(0), "i", "j", ["x", "y"], ["u", "v"], 0.5).count() == 0
    assert joins.nearest(a.limit(0), b, "i", "j", ["x", "y"], ["u", "v"], 0.5).count() == 0
