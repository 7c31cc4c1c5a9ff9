"""Graphs in rounds over the cluster (small=0) and in one task, against plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from atlaspark.operators import graph

CHAIN = 1000


def graph_of(spark, links, score=True):
    return spark.createDataFrame([(*x[:2], float(x[2])) for x in links], f"src long, dst long, {'score' if score else 'cost'} double")


def parts_of(nodes, links):
    up = {v: v for v in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, *_ in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {v: top(v) for v in nodes}


def some_links(seed, n, m):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), r.randint(1, 9)) for _ in range(m)]


CASES = [[], [(0, 0, 1)], [(i, i + 1, 1 + i % 3) for i in range(40)], [(99, i, 2) for i in range(30)], some_links(1, 60, 50), some_links(2, 40, 120)]
#: In one task, and with rounds over the cluster down to twelve edges.
RUNS = [(x, graph.SMALL) for x in CASES] + [(x, 12) for x in CASES[2:5]]


@pytest.mark.parametrize("links, small", RUNS)
def test_components_and_tree(spark, links, small):
    nodes = range(100)
    df, frames = graph_of(spark, links), spark.range(100).select(F.col("id").alias("node"))
    want = parts_of(nodes, links)
    assert {r.node: r.component for r in graph.components(frames, df, small).collect()} == want
    tree, up = [], {v: v for v in nodes}
    best = {}
    for a, b, s in links:
        if a != b:
            key = (min(a, b), max(a, b))
            best[key] = max(best.get(key, 0), s)
    for s, a, b in sorted((-s, a, b) for (a, b), s in best.items()):
        up = parts_of(nodes, tree)
        if up[a] != up[b]:
            tree.append((a, b, -s))
    assert sorted((r.src, r.dst, r.score) for r in graph.spanning_tree(df, small).collect()) == sorted(tree)


@pytest.mark.parametrize("links, small", RUNS)
def test_k_core(spark, links, small):
    pairs = {(a, b) for a, b, _ in links if a != b} | {(b, a) for a, b, _ in links if a != b}
    want = set(pairs)
    while True:
        keep = {v for v in range(100) if sum(a == v for a, _ in want) >= 2}
        less = {(a, b) for a, b in want if a in keep and b in keep}
        if less == want:
            break
        want = less
    df = spark.createDataFrame(sorted(pairs), "src long, dst long")
    assert {(r.src, r.dst) for r in graph.k_core(df, 2, small).collect()} == want


def cheapest(links, source):
    beside, done, heap = {}, {}, [(0, 0, -1, source)]
    for a, b, w in links:
        if a != b:
            beside.setdefault(a, []).append((b, w))
            beside.setdefault(b, []).append((a, w))
    while heap:
        d, h, p, v = heapq.heappop(heap)
        if v not in done:
            done[v] = (d, h, None if v == source else p)
            for x, w in beside.get(v, ()):
                heapq.heappush(heap, (d + w, h + 1, v, x))
    return done


@pytest.mark.parametrize("links, small", RUNS)
def test_shortest_paths_and_their_nodes(spark, links, small):
    want = cheapest(links, 0)
    tree = graph.shortest_paths(graph_of(spark, links, False), 0, small=small)
    assert {r.node: (r.cost, r.hops, r.previous) for r in tree.collect()} == want
    found = {}
    for r in graph.path_nodes(tree, spark.range(0, 100, 7).select(F.col("id").alias("node"))).collect():
        found.setdefault(r.target, []).append((r.place, r.node))
    for t in range(0, 100, 7):
        path, v = [], t if t in want else None
        while v is not None:
            path.append(v)
            v = want[v][2]
        assert [v for _, v in sorted(found.get(t, []))] == path[::-1]
        assert [p for p, _ in sorted(found.get(t, []))] == list(range(len(path)))


def test_chains_settle(spark):
    links = [(i, i + 1, 1) for i in range(CHAIN)]
    r = random.Random(3)
    names = list(range(CHAIN + 1))
    r.shuffle(names)
    shuffled = [(names[a], names[b], w) for a, b, w in links]
    frames = spark.range(CHAIN + 1).select(F.col("id").alias("node"))
    for x in (links, shuffled):
        assert {r.component for r in graph.components(frames, graph_of(spark, x), 300).collect()} == {0}
        assert graph.spanning_tree(graph_of(spark, x), 400).count() == CHAIN
        tree = graph.shortest_paths(graph_of(spark, x, False), x[0][0])
        assert tree.agg(F.max("cost")).first()[0] == CHAIN
        end = spark.createDataFrame([(x[-1][1],)], "node long")
        assert [r.node for r in graph.path_nodes(tree, end).orderBy("place").collect()] == [x[0][0], *(b for _, b, _ in x)]
    assert graph.k_core(graph.both_ways(graph_of(spark, links)), 2).count() == 0


def test_paths_take_no_part_in_odd_costs_and_reach_the_nearest_target(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (1, 2, None), (1, 3, float("nan")), (1, 4, -1.0), (1, 5, 0.0), (5, 6, 2.0), (0, 6, 9.0)], "src int, dst int, cost double")
    assert {r.node: r.cost for r in graph.shortest_costs(df, 0).collect()} == {0: 0.0, 1: 1.0, 5: 1.0, 6: 3.0}
    targets = spark.createDataFrame([(6,), (2,)], "node long")
    assert [(r.target, r.cost, r.place, r.node) for r in graph.nearest_target(df, 0, targets).orderBy("place").collect()] == [(6, 3.0, 0, 0), (6, 3.0, 1, 1), (6, 3.0, 2, 5)]
    assert graph.nearest_target(df, 6, targets).count() == 0 and graph.nearest_target(df, 0, targets.where("node = 2")).count() == 0


@pytest.mark.parametrize("sizes", [[1, 1, 1], [2, 1, 1, 3, 1], [1, 2, 1], [1, 1, 4, 1, 1]])
def test_lone_frames_join_the_next_group(spark, sizes):
    rows, i = [], 0
    for s in sizes:
        rows += [(i + k, i) for k in range(s)]
        i += s
    groups = {}
    for node, c in rows:
        groups.setdefault(c, []).append(node)
    want = {}
    for node, c in rows:
        t = node
        if len(groups[c]) == 1 and any(len(g) > 1 for g in groups.values()):
            while len(groups[dict(rows)[t % i]]) == 1:
                t += 1
            c = dict(rows)[t % i]
        elif len(groups[c]) == 1:
            c = 0
        want[node] = c
    df = spark.createDataFrame(rows, "node int, component int")
    assert {r.node: r.component for r in graph.merge_singletons(df, i).collect()} == want


def test_walks_may_cost_less_than_nothing(spark):
    rows = [(0, 1, -1e-6), (1, 2, -1e-6), (0, 2, -1e-6), (2, 3, 0.5), (0, 3, 1.0), (3, 4, float("nan"))]
    edges = spark.createDataFrame(rows, "src int, dst int, cost double")
    beside = [(u, v, w) for a, b, w in rows if w == w for u, v in ((a, b), (b, a))]
    best = {0: (0.0, 1, [0])}
    for _ in range(4):
        found = dict(best)
        for u, v, w in beside:
            if u in best:
                step = (best[u][0] + w, best[u][1] + 1, [*best[u][2], v])
                found[v] = min(found.get(v, step), step)
        best = found
    got = {r.node: (r.cost, len(r.path), r.path) for r in graph.cheapest_walks(edges, 0, 4).collect()}
    assert got == best and best[3][2] == [0, 1, 0, 2, 3]
    way = graph.nearest_target(edges, 0, spark.createDataFrame([(3,), (4,)], "node long"), most=4)
    assert sorted((r.target, r.place, r.node) for r in way.collect()) == [(3, 0, 0), (3, 1, 1), (3, 2, 0), (3, 3, 2)]
    assert graph.nearest_target(edges, 9, spark.createDataFrame([(3,)], "node long"), most=4).count() == 0
