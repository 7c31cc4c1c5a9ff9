"""Frame graphs as edge tables (src, dst, score)."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import materialize
from . import ordered
from .windows import top_k

#: Edges that one task may hold. Graphs are counted first; what is left of so few is finished there, whatever its shape.
SMALL = 200_000


def in_one_task(df: DataFrame, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """solve() over all rows of a table that is known to be small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            yield solve(pd.concat(rows, ignore_index=True))

    return df.coalesce(1).mapInPandas(run, schema)


def both_ways(edges: DataFrame) -> DataFrame:
    """The edges and their reverses."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def adjacency(edges: DataFrame, least: float, k: int = 0, mutual: bool = False) -> DataFrame:
    """Neighbours (src, dst), both ways: edges of `least` or more, and each frame's k best; only what both ends chose if mutual."""
    every = both_ways(edges).groupBy("src", "dst").agg(F.max("score").alias("score"))
    chosen = every.where(F.col("score") >= least).select("src", "dst")
    if k:
        chosen = chosen.union(top_k(every, ["src"], [F.desc("score"), F.col("dst")], k).select("src", "dst"))
    chosen = chosen.distinct()
    back = chosen.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return chosen.intersect(back) if mutual else chosen.union(back).distinct()


def jaccard_prune(neighbours: DataFrame, least: float) -> DataFrame:
    """Edges whose ends share that part of their other neighbours; an edge without any other neighbour stays."""
    n = neighbours
    degree = n.groupBy("src").agg(F.count("*").alias("d"))
    common = n.alias("a").join(n.alias("b"), F.col("a.dst") == F.col("b.dst")).where("a.src <> b.src")
    common = common.groupBy(F.col("a.src").alias("src"), F.col("b.src").alias("dst")).agg(F.count("*").alias("both"))
    joined = n.join(common, ["src", "dst"], "left").join(degree.select("src", F.col("d").alias("ds")), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    both, union = F.coalesce("both", F.lit(0)), F.col("ds") + F.col("dd") - 2 - F.coalesce("both", F.lit(0))
    return joined.withColumn("jaccard", F.when(union == 0, 1.0).otherwise(both / union)).where(F.col("jaccard") >= least).select("src", "dst", "jaccard")


def k_core(neighbours: DataFrame, k: int, small: int = SMALL) -> DataFrame:
    """What is left once frames with fewer than k neighbours are taken away until there is none.

    Rounds over the cluster go on until nothing goes; what is left of `small`
    edges or fewer is finished in one task.
    """
    left = materialize(neighbours.select("src", "dst").distinct())
    n = left.count()
    while n > small:
        keep = left.groupBy("src").count().where(F.col("count") >= k).select("src")
        left = materialize(left.join(keep, "src", "left_semi").join(keep.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))
        before, n = n, left.count()
        if n == before:
            return left

    def peel(rows: pd.DataFrame) -> pd.DataFrame:
        outs, ins = defaultdict(set), defaultdict(set)
        for u, v in zip(rows.src.tolist(), rows.dst.tolist(), strict=True):
            outs[u].add(v)
            ins[v].add(u)
        degree = {u: len(vs) for u, vs in outs.items()}
        gone: set = set()
        open_ = [v for v in {*outs, *ins} if degree.get(v, 0) < k]
        while open_:
            v = open_.pop()
            if v in gone:
                continue
            gone.add(v)
            for u in ins[v] - gone:
                degree[u] -= 1
                if degree[u] < k:
                    open_.append(u)
        return rows[~rows.src.isin(gone) & ~rows.dst.isin(gone)]

    return in_one_task(left, peel, left.schema)


def components(nodes: DataFrame, neighbours: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component): the smallest node that each node (all ends of links among them) reaches.

    Each round every part joins the one beside it that is first in an order by
    hash, so that chains of parts that join each other are short, and the parts
    become the nodes of a smaller graph, until `small` edges or fewer are left,
    which one task joins. Links may repeat, run either way or loop.
    """
    label = nodes.select("node", F.col("node").alias("part"))
    links = materialize(both_ways(neighbours.select("src", "dst")).where("src <> dst").distinct())
    n = links.count()
    while n > small:
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        up = links.groupBy("src").agg(F.min(key("dst")).alias("first")).select(F.col("src").alias("part"), F.least(key("src"), "first")["id"].alias("to"))
        for _ in range(3):
            up = up.join(up.select(F.col("part").alias("to"), F.col("to").alias("top")), "to", "left").select("part", F.coalesce("top", "to").alias("to"))
        up = materialize(up)
        label = label.join(up, "part", "left").select("node", F.coalesce("to", "part").alias("part"))
        a, b = (up.select(F.col("part").alias(c), F.col("to").alias(f"_{c}")) for c in ("src", "dst"))
        links = materialize(links.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).where("src <> dst").distinct())
        n = links.count()
    if n:
        kind = links.schema["src"].dataType
        joined = in_one_task(links.where("src > dst"), lambda rows: _joined(rows.src, rows.dst), T.StructType([T.StructField("part", kind), T.StructField("top", kind)]))
        label = label.join(joined, "part", "left").select("node", F.coalesce("top", "part").alias("part"))
    first = label.groupBy("part").agg(F.min("node").alias("component"))
    return label.join(first, "part").select("node", "component")


def _joined(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """The smallest of each set of joined values."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return pd.DataFrame({"part": list(up), "top": [top(x) for x in up]})


def merge_singletons(groups: DataFrame, n: int) -> DataFrame:
    """Frames alone in their group join the group of the next frame in the cycle of n that is in a larger one; if all are alone, all join."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    sized = groups.join(sizes, "component")
    # In the order of the cycle, twice around, the next frame that is in a larger group.
    turn = sized.select("node", "component", "size", F.explode(F.array(F.lit(0), F.lit(n))).alias("lap")).withColumn("place", F.col("node") + F.col("lap"))
    rows = ordered.ranged(turn.select("node", "lap", "place", F.when(F.col("size") > 1, F.col("component")).alias("host")), [F.col("place")])
    ahead = F.first("host", True).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(0, Window.unboundedFollowing))
    parts = rows.groupBy("_part").agg(F.min_by("host", F.when(F.col("host").isNotNull(), F.col("_at"))).alias("first"))
    later = F.broadcast(parts.select("_part", ordered.carried(parts, F.col("first"), back=True).alias("later")))  # one row a range
    best = rows.withColumn("ahead", ahead).join(later, "_part").where("lap = 0").select("node", F.coalesce("ahead", "later").alias("target"))
    lone = groups.agg(F.min("component").alias("_least"))
    return groups.join(best, "node", "left").crossJoin(F.broadcast(lone)).select("node", F.coalesce("target", "_least").alias("component"))


def spanning_tree(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """The maximum spanning forest: every part takes its best edge outwards until none is left (ties by src, dst).

    Parts become nodes, with the best edge between each two of them, until
    `small` edges or fewer are left, which one task takes in order.
    """
    every = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("score").alias("score")).where("src <> dst")
    every = materialize(every.withColumn("a", F.col("src")).withColumn("b", F.col("dst")))
    tree, n = every.select("src", "dst", "score").limit(0), every.count()
    rank = F.struct((-F.col("score")).alias("cost"), "src", "dst")
    while n > small:
        ends = every.select(F.col("a").alias("c"), rank.alias("e")).union(every.select(F.col("b").alias("c"), rank.alias("e")))
        best = ends.groupBy("c").agg(F.min("e").alias("e"))
        chosen = materialize(best.select("e.src", "e.dst", (-F.col("e.cost")).alias("score")).distinct())
        tree = tree.union(chosen)
        joined = every.join(chosen.select("src", "dst"), ["src", "dst"], "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        parts = every.select(F.col("a").alias("node")).union(every.select("b")).distinct()
        part = components(parts, joined, small)
        a, b = (part.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("a", "b"))
        moved = every.join(a, "a").join(b, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "src", "dst", "score")
        best = moved.groupBy("a", "b").agg(F.min(rank).alias("e"))
        every = materialize(best.select("e.src", "e.dst", (-F.col("e.cost")).alias("score"), "a", "b"))
        n = every.count()

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "src", "dst"], ascending=[False, True, True])
        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        taken = []
        for i, a, b in zip(rows.index, rows.a, rows.b, strict=True):
            a, b = top(a), top(b)
            if a != b:
                up[b] = a
                taken.append(i)
        return rows.loc[taken, ["src", "dst", "score"]]

    return tree.unionByName(in_one_task(every, take, tree.schema)) if n else tree


def coverage(neighbours: DataFrame, chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """The mean over all frames of the best score to a chosen one; a chosen frame covers itself."""
    near = both_ways(neighbours).join(chosen.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.max("score").alias("s"))
    own = chosen.select("node", F.lit(1.0).alias("own"))
    return nodes.join(near, "node", "left").join(own, "node", "left").agg(F.avg(F.coalesce("own", "s", F.lit(0.0))).alias("coverage"))


def shortest_costs(edges: DataFrame, source: int, cost: str = "cost", small: int = SMALL) -> DataFrame:
    """(node, cost) of the cheapest path from a node."""
    return shortest_paths(edges, source, cost, small).select("node", "cost")


def shortest_paths(edges: DataFrame, source: int, cost: str = "cost", small: int = SMALL) -> DataFrame:
    """(node, cost, hops, previous) of the cheapest path from a node to each that it reaches, edges running both ways.

    Of equally cheap paths that with fewest edges counts, and of those the
    smallest previous node; so following `previous` always ends at the source,
    whose own is null. Costs below 0, NaN or null take no part. A graph of
    `small` edges or fewer is solved in one task; a larger one by rounds, in
    which only nodes reached better than before pass it on, until there are none.
    """
    links = both_ways(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col(cost).cast("double").alias("w"))).where("src <> dst AND w >= 0 AND NOT isnan(w)")
    links = materialize(links.groupBy("src", "dst").agg(F.min("w").alias("w")))
    schema = "node long, cost double, hops long, previous long"
    if links.count() <= small:

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            beside = defaultdict(list)
            for u, v, w in zip(rows.src.tolist(), rows.dst.tolist(), rows.w.tolist(), strict=True):
                beside[u].append((v, w))
            done = reached(beside, source)
            out = pd.DataFrame([(u, *rest) for u, rest in done.items()], columns=["node", "cost", "hops", "previous"])
            return out.assign(previous=out.previous.astype("Int64").where(out.node != source))

        seed = edges.sparkSession.createDataFrame([(source, source, 0.0)], "src long, dst long, w double")
        return in_one_task(links.unionByName(seed), solve, schema)
    best = materialize(edges.sparkSession.createDataFrame([(source, 0.0, 0, None)], schema))
    moved = best
    while True:
        step = moved.join(links, moved["node"] == links["src"]).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("previous"))
        least = best.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False))).groupBy("node").agg(F.min(F.struct("cost", "hops", "previous", (~F.col("old")).alias("new"))).alias("b"))
        rows = materialize(least.select("node", "b.*"))
        best, moved = rows.drop("new"), rows.where("new").drop("new")
        if moved.isEmpty():
            return best


def reached(beside: dict, source: int) -> dict:
    """{node: (cost, hops, previous)} by the neighbours (node, cost) of each node; the source's previous is -1."""
    done: dict = {}
    heap: list = [(0.0, 0, -1, source)]
    while heap:
        d, hops, before, u = heapq.heappop(heap)
        if u not in done:
            done[u] = (d, hops, before)
            for v, w in beside.get(u, ()):
                if v not in done:
                    heapq.heappush(heap, (d + w, hops + 1, u, v))
    return done


def path_nodes(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, place, node): the nodes on the path to each target (node), its source at place 0, of what shortest_paths returns.

    Pointers to nodes 1, 2, 4, .. before are each other's squares, so a path of
    n nodes is read in log n rounds, and no row holds a path. A target that is
    not reached has no rows.
    """
    jump = materialize(tree.where("previous IS NOT NULL").select("node", F.col("previous").alias("to")))
    rows = materialize(tree.join(targets.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("target"), "node"))
    while not jump.isEmpty():
        rows = materialize(rows.unionByName(rows.join(jump, "node").select("target", F.col("to").alias("node"))))
        jump = materialize(jump.select("node", F.col("to").alias("middle")).join(jump.select(F.col("node").alias("middle"), "to"), "middle").select("node", "to"))
    return rows.join(tree.select("node", F.col("hops").alias("place")), "node").select("target", "place", "node")


def cheapest_walks(edges: DataFrame, source: int, most: int, cost: str = "cost") -> DataFrame:
    """(node, cost, path) of the cheapest walk of at most `most` edges from a node to each that it reaches, edges running both ways.

    Costs may be below 0, so that a walk may pass a node more than once; NaN and
    null take no part. Round by round every node keeps the cheapest of its own
    walk and its neighbours' with one edge more; ties go to fewer edges, then to
    the smaller nodes from the start.
    """
    links = both_ways(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col(cost).cast("double").alias("w"))).where("src <> dst AND NOT isnan(w)")
    links = materialize(links.groupBy("src", "dst").agg(F.min("w").alias("w")))
    best = edges.sparkSession.createDataFrame([(source, 0.0, [source])], "node long, cost double, path array<long>")
    for _ in range(most):
        step = best.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        least = F.min(F.struct("cost", F.size("path").alias("hops"), "path")).alias("b")
        best = materialize(best.unionByName(step).groupBy("node").agg(least).select("node", "b.cost", "b.path"))
    return best


def nearest_target(edges: DataFrame, source: int, targets: DataFrame, cost: str = "cost", small: int = SMALL, most: int | None = None) -> DataFrame:
    """(target, cost, place, node): the cheapest to reach of the targets (node; ties to the smaller) with the path there, without the target itself.

    No rows if none is reached or the source is one of them. With `most`, walks
    of at most so many edges count, and costs may be below 0.
    """
    tree = cheapest_walks(edges, source, most, cost) if most is not None else materialize(shortest_paths(edges, source, cost, small))
    found = tree.join(targets.select("node").distinct(), "node", "left_semi")
    if most is not None:
        best = found.agg(F.min(F.struct("cost", "node", "path")).alias("b")).select("b.*").where("node IS NOT NULL")
        way = best.select(F.col("node").alias("target"), "cost", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("place", "node"))
        return way.select("target", "cost", F.col("place").cast("long").alias("place"), "node")
    first = found.agg(F.min(F.struct("cost", "node")).alias("b")).select("b.node", "b.cost").where("node IS NOT NULL")
    first = materialize(first)  # one row
    return path_nodes(tree, first).join(F.broadcast(first.select(F.col("node").alias("target"), "cost")), "target").where("node <> target").select("target", "cost", "place", "node")


def incident(edges: DataFrame) -> DataFrame:
    """(node, other, score, tree, place): each frame's pairs, those of the maximum spanning tree apart from the others, best first."""
    tree = spanning_tree(edges).select("src", "dst", F.lit(True).alias("tree"))
    marked = edges.join(tree, ["src", "dst"], "left").select("src", "dst", "score", F.coalesce("tree", F.lit(False)).alias("tree"))
    sides = both_ways(marked).withColumnsRenamed({"src": "node", "dst": "other"})
    place = F.row_number().over(Window.partitionBy("node", "tree").orderBy(F.desc("score"), "other")) - 1
    return sides.withColumn("place", place)
