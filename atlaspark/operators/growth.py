"""Choosing frames one after another: greedy coverage and farthest-first order."""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .graph import SMALL, both_ways, in_one_task, path_nodes, reached, shortest_paths

#: Candidates whose gain is worked out anew at a time.
HEAD = 32


def grow(nodes: DataFrame, edges: DataFrame, least: float, start: list[int] | None = None, most_steps: int = 100, eps: float = 1e-6, small: int = SMALL) -> DataFrame:
    """(step, place, node, gain, coverage): frames chosen until the mean over all frames of the best score to a chosen one is `least`.

    A chosen frame covers itself with 1. Step 0 is the start (the frame with the
    highest sum of scores, if none is given). Each further step takes the frame
    that adds most to the coverage (ties to the smaller), with the frames on the
    cheapest path to it, at 1 / (score + eps) an edge, from the chosen frame
    with the lowest sum of scores to chosen ones; without a path the frame
    alone. `gain` is what the taken frame alone adds; coverage counts its path.
    Ends when nothing adds anything, or after most_steps.

    Gains only shrink as the set grows, so the last known gain of a frame bounds
    it from above: a step works out anew only the HEAD best bounds, and further
    ones only while a bound is as good as the best gain. A graph of `small`
    edges or fewer grows in one task, with a heap of bounds.
    """
    scores = both_ways(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("score").cast("double"))).where("src <> dst AND score > 0")
    scores = materialize(scores.groupBy("src", "dst").agg(F.max("score").alias("score")))
    frames = materialize(nodes.select(F.col("node").cast("long")).distinct())
    n = frames.count()
    if n + scores.count() <= small:
        own = frames.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("score"))
        return in_one_task(scores.unionByName(own), lambda rows: _grown(rows, least, start, most_steps, eps), GROWN)
    costs = materialize(scores.select("src", "dst", (1 / (F.col("score") + eps)).alias("cost")))
    if start is None:
        sums = frames.join(scores.groupBy(F.col("src").alias("node")).agg(F.sum("score").alias("sum")), "node", "left")
        first = sums.orderBy(F.desc(F.coalesce("sum", F.lit(0.0))), "node").first()
        start = [] if first is None else [first.node]
    spark = nodes.sparkSession
    taken = spark.createDataFrame([(0, i, v, None) for i, v in enumerate(start)], "step int, place long, node long, gain double")
    out, covered = [], None
    bounds = frames.select("node", F.lit(float("inf")).alias("bound"))
    new = taken

    def widen(covered: DataFrame | None, new: DataFrame) -> DataFrame:
        near = scores.join(new.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "score")
        every = near.unionByName(new.select("node", F.lit(1.0).alias("score")))
        every = every if covered is None else every.unionByName(covered)
        return materialize(every.groupBy("node").agg(F.max("score").alias("score")))

    for step in range(most_steps + 1):
        covered = widen(covered, new)
        coverage = (covered.join(frames, "node", "left_semi").agg(F.sum("score")).first()[0] or 0.0) / n if n else 0.0
        out.append(new.withColumn("coverage", F.lit(coverage)))
        if coverage >= least or step == most_steps or not n:
            break
        bounds = materialize(bounds.join(new.select("node"), "node", "left_anti"))
        best, fresh, waiting = None, None, bounds
        while True:
            head = materialize(waiting.orderBy(F.desc("bound"), "node").limit(HEAD))
            top = head.agg(F.max("bound")).first()[0]
            if top is None or (best is not None and (top, 0) < (best.gain, 0)):
                break
            own = frames.select("node").join(head.select("node"), "node", "left_semi").select(F.col("node").alias("dst"), "node", F.lit(1.0).alias("score"))
            pairs = scores.join(head.select(F.col("node").alias("dst")), "dst").select("dst", F.col("src").alias("node"), "score").unionByName(own)
            added = pairs.join(covered.withColumnRenamed("score", "now"), "node", "left").join(frames, "node", "left_semi")
            added = added.groupBy(F.col("dst").alias("node")).agg((F.sum(F.greatest(F.lit(0.0), F.col("score") - F.coalesce("now", F.lit(0.0)))) / n).alias("bound"))
            block = materialize(head.select("node").join(added, "node", "left").select("node", F.coalesce("bound", F.lit(0.0)).alias("bound")))
            fresh = block if fresh is None else fresh.unionByName(block)
            lead = block.orderBy(F.desc("bound"), "node").select("node", F.col("bound").alias("gain")).first()
            if best is None or (-lead.gain, lead.node) < (-best.gain, best.node):
                best = lead
            waiting = waiting.join(head.select("node"), "node", "left_anti")
        if best is None or best.gain <= 0:
            break
        bounds = fresh.unionByName(waiting)
        chosen = materialize(reduce(DataFrame.unionByName, out).select("node"))
        sums = chosen.join(scores.join(chosen.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.sum("score").alias("sum")), "node", "left")
        # A frame's score with itself is 1 for all, and so decides nothing.
        source = sums.orderBy(F.coalesce("sum", F.lit(0.0)), "node").first().node
        target = spark.createDataFrame([(best.node,)], "node long")
        path = materialize(path_nodes(shortest_paths(costs.where("src < dst"), source, small=small), target).select("place", "node"))
        if path.isEmpty():
            path = target.select(F.lit(0).cast("long").alias("place"), "node")
        new = path.join(chosen, "node", "left_anti").select(F.lit(step + 1).alias("step"), "place", "node", F.when(F.col("node") == best.node, best.gain).alias("gain"))
        new = materialize(new)
    return reduce(DataFrame.unionByName, out)


GROWN = "step int, place long, node long, gain double, coverage double"


def _grown(rows: pd.DataFrame, least: float, start: list[int] | None, most_steps: int, eps: float) -> pd.DataFrame:
    """grow() over scores of which each frame has one with itself."""
    beside: dict = defaultdict(dict)
    for u, v, s in zip(rows.src.tolist(), rows.dst.tolist(), rows.score.tolist(), strict=True):
        beside[u][v] = s
    n = sum(u in around for u, around in beside.items())
    costs = {u: [(v, 1 / (s + eps)) for v, s in around.items() if v != u] for u, around in beside.items()}
    if start is None:
        start = [min(beside, key=lambda u: (-sum(beside[u].values()), u))]
    covered = dict.fromkeys(beside, 0.0)
    gain_of = lambda c: sum(max(0.0, s - covered[v]) for v, s in beside[c].items()) / n
    bounds = [(-float("inf"), u) for u in sorted(beside)]
    chosen: set = set()
    out, new, gain = [], list(enumerate(start)), None
    for step in range(most_steps + 1):
        for _, c in new:
            chosen.add(c)
            for v, s in beside.get(c, {}).items():
                covered[v] = max(covered[v], s)
        coverage = sum(covered.values()) / n
        out += [(step, place, c, gain if (place, c) == new[-1] else None, coverage) for place, c in new]
        best = None
        while coverage < least and step < most_steps and bounds:
            bound, c = bounds[0]
            if best is not None and bound > best[0]:
                break
            heapq.heappop(bounds)
            if c not in chosen:
                own = (-gain_of(c), c)
                if best is None or own < best:
                    if best is not None:
                        heapq.heappush(bounds, best)
                    best = own
                else:
                    heapq.heappush(bounds, own)
                    if bound == own[0]:
                        break
        if best is None or best[0] >= 0:
            break
        gain, target = -best[0], best[1]
        source = min(chosen, key=lambda u: (sum(s for v, s in beside[u].items() if v in chosen and v != u), u))
        tree, path, v = reached(costs, source), [], target
        while v in tree:
            path.append(v)
            v = tree[v][2]
        path = path[::-1] or [target]
        new = [(place, c) for place, c in enumerate(path) if c not in chosen]
    return pd.DataFrame(out, columns=["step", "place", "node", "gain", "coverage"]).astype({"gain": float})


def commonest(df: DataFrame, id_col: str, vector_col: str) -> int | None:
    """The row most like all others: the highest sum of cosines (ties to the smaller id), by the sum of all unit vectors instead of all pairs."""
    unit = _unit(df, id_col, vector_col)
    total = unit.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    total = total.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e.x).alias("total"))  # one row
    dot = F.aggregate(F.zip_with("v", "total", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    first = unit.crossJoin(F.broadcast(total)).select("id", dot.alias("s")).orderBy(F.desc("s"), "id").first()
    return None if first is None else first.id


def _unit(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), norm.alias("norm")).where("norm > 0 AND norm < double('Infinity')").select("id", F.transform("v", lambda x: F.try_divide(x, F.col("norm"))).alias("v"))


def farthest_first(df: DataFrame, count: int, first: int | None = None, id_col: str = "id", vector_col: str = "embedding", last_only: bool = False, every: int = 16) -> DataFrame:
    """(place, id, distance): `count` rows, each the one farthest from those before it, by 1 - cosine; ties to the smaller id.

    The first is `first`, or the row most like all others, at distance null.
    With last_only the distance is to the row before alone. Each row keeps its
    least distance in a table, lowered by every pick and written down after
    `every` picks, so that a pick is one pass over it. Vectors null, zero or not
    finite take no part; if there are fewer rows, all are returned.
    """
    first = commonest(df, id_col, vector_col) if first is None else first
    state = materialize(_unit(df, id_col, vector_col).withColumn("d", F.lit(float("inf"))))
    spark, picked = df.sparkSession, []
    row = state.where(F.col("id") == first).first() if first is not None else None
    while row is not None:
        picked.append((len(picked), row.id, float(row.d) if picked else None))
        if len(picked) == count:
            break
        pick = F.array(*[F.lit(x) for x in row.v])
        away = 1 - F.aggregate(F.zip_with("v", pick, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        state = state.where(F.col("id") != row.id).withColumn("d", away if last_only else F.least("d", away))
        if len(picked) % every == 0:
            state = materialize(state)
        row = state.orderBy(F.desc("d"), "id").first()
    return spark.createDataFrame(picked, "place int, id long, distance double")
