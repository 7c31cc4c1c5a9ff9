"""Groups of frames by the smallest eigenvectors of a graph's normalised Laplacian."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .graph import both_ways, in_one_task, merge_singletons
from .growth import farthest_first
from .windows import top_k

#: Nodes whose whole matrix one task may take apart (32 MB).
DENSE = 2000


def affinity(edges: DataFrame, least: float = 0.5, k: int = 5, window: int | None = None) -> DataFrame:
    """(src, dst, w), both ways: scores of `least` or more and each frame's k best, of frames at most `window` apart, and each frame with itself at 1."""
    every = both_ways(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("score").cast("double"))).where("src <> dst AND score > 0")
    every = every.groupBy("src", "dst").agg(F.max("score").alias("w"))
    near = every if window is None else every.where(F.abs(F.col("src") - F.col("dst")) <= window)
    kept = both_ways(near.where(F.col("w") >= least).select("src", "dst").union(top_k(near, ["src"], [F.desc("w"), F.col("dst")], k).select("src", "dst"))).distinct()
    own = every.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w"))
    return every.join(kept, ["src", "dst"], "left_semi").unionByName(own)


def laplacian(links: DataFrame, count: int, dense: int = DENSE, tolerance: float = 1e-8, extra: int = 12, powers: int = 4, seed: int = 0) -> tuple[list[float], DataFrame]:
    """The `count` smallest eigenvalues of I - D^-1/2 W D^-1/2 of symmetric links (src, dst, w), and (node, v) with their vectors' entries.

    A graph of up to `dense` nodes is taken apart in one task. A larger one by
    block power iteration: links times a table of vectors is a join and a sum
    by node; a block's inner products are sums of each partition, and only they
    (a square of the block's width) come to the driver, where the block is made
    orthogonal and turned to its best combinations, until the eigenvalues move
    by less than the tolerance.
    """
    degree = links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d"))
    a, b = (degree.select(F.col("node").alias(c), F.sqrt(F.greatest("d", F.lit(1e-8))).alias(f"d_{c}")) for c in ("src", "dst"))
    links = materialize(links.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") / (F.col("d_src") * F.col("d_dst"))).alias("w")))
    nodes = materialize(links.select(F.col("src").alias("node")).distinct())
    n = nodes.count()
    count = min(count, n)
    if n == 0:
        return [], nodes.select("node", F.array().cast("array<double>").alias("v"))
    if n <= dense:

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            names, at = np.unique(np.concatenate((rows.src, rows.dst)), return_inverse=True)
            m = np.zeros((len(names), len(names)))
            np.add.at(m, (at[: len(rows)], at[len(rows) :]), rows.w.to_numpy())
            values, vectors = np.linalg.eigh(np.eye(len(names)) - (m + m.T) / 2)
            return pd.DataFrame({"node": names, "v": list(vectors[:, :count]), "values": [values[:count]] * len(names)})

        found = materialize(in_one_task(links, solve, "node long, v array<double>, values array<double>"))
        return list(found.first().values), found.select("node", "v")

    width = min(count + extra, n)
    names = [f"x{i}" for i in range(width)]
    start = [((F.pmod(F.xxhash64("node", F.lit(i + seed * width)), F.lit(1 << 20)) / float(1 << 19)) - 1).alias(c) for i, c in enumerate(names)]
    block = materialize(nodes.select("node", *start))

    # (W + I) / 2 of the scaled links: its largest eigenvalues belong to the Laplacian's smallest.
    halves = links.select("src", "dst", (F.col("w") / 2).alias("w")).unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.5).alias("w")))
    halves = materialize(halves.groupBy("src", "dst").agg(F.sum("w").alias("w")))

    def times(x: DataFrame) -> DataFrame:
        return halves.join(x.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])

    def products(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum((p[left].to_numpy().T @ p[right].to_numpy() for p in parts), np.zeros((len(left), len(right))))
            yield pd.DataFrame({"s": [total.ravel()]})

        rows = df.select(*dict.fromkeys(left + right)).mapInPandas(run, "s array<double>").toLocalIterator()  # one row a partition
        return sum((np.array(r.s) for r in rows), np.zeros(len(left) * len(right))).reshape(len(left), len(right))

    def turned(df: DataFrame, m: np.ndarray) -> DataFrame:
        combine = lambda j: sum((F.col(c) * F.lit(float(m[i, j])) for i, c in enumerate(names)), F.lit(0.0))
        return df.select("node", *[combine(j).alias(c) for j, c in enumerate(names)])

    before = np.full(count, np.inf)
    while True:
        for _ in range(powers):
            block = times(block)
        block = materialize(block)
        gram = products(block, names, names)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = np.maximum(values, values.max() * 1e-14)
        block = turned(block, vectors / np.sqrt(keep))
        after = times(block).select("node", *[F.col(c).alias(f"z{i}") for i, c in enumerate(names)])
        both = materialize(block.join(after, "node"))
        inner = products(both, names, [f"z{i}" for i in range(width)])
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)
        block = turned(both, vectors[:, order])
        now = 2 - 2 * values[order][:count]
        if np.abs(now - before).max() < tolerance:
            return now.tolist(), materialize(block.select("node", F.array(*names[:count]).alias("v")))
        before = now


def eigengap(values: list[float], least: int = 2, most: int = 6) -> int:
    """How many groups: where the next eigenvalue is furthest off (first such), within least and most."""
    most = min(most, len(values) - 1)
    if most < 1:
        return 1
    gaps = [values[i + 1] - values[i] for i in range(most)]
    return max(least, min(gaps.index(max(gaps)) + 1, most))


def lloyd(rows: DataFrame, k: int, rounds: int = 30, tolerance: float = 1e-5) -> DataFrame:
    """(node, label) of rows (node, v): the nearest of k centres, which move to their rows' means until they stay.

    The first centres are rows each farthest from those before; a centre that
    loses its rows stays where it was.
    """
    rows = materialize(rows)
    first = farthest_first(rows, k, id_col="node", vector_col="v")
    centres = [r.v for r in rows.join(F.broadcast(first.select(F.col("id").alias("node"), "place")), "node").orderBy("place").collect()]  # k rows
    if not centres:
        return rows.select("node", F.lit(0).alias("label"))

    def assigned() -> DataFrame:
        away = [F.struct(F.aggregate(F.zip_with("v", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), F.lit(i).alias("label")) for i, c in enumerate(centres)]
        return rows.select("node", "v", (F.least(*away) if len(away) > 1 else away[0])["label"].alias("label"))

    for _ in range(rounds):
        means = assigned().groupBy("label").agg(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(len(centres[0]))]).collect()  # k rows
        moved = list(centres)
        for r in means:
            moved[r.label] = [r[f"m{i}"] for i in range(len(centres[0]))]
        still = np.allclose(moved, centres, atol=tolerance)
        centres = moved
        if still:
            break
    return assigned().select("node", "label")


def spectral_groups(edges: DataFrame, n: int, least: float = 0.5, k: int = 3, window: int | None = None, groups: int | None = None, fewest: int = 2, most: int = 6, dense: int = DENSE) -> DataFrame:
    """(node, component) of frames 0 to n - 1 that have a positive score: as many groups as the eigengap asks for (or `groups`), each named by its smallest frame.

    Frames alone in their group join the group of the next frame. Edges may
    repeat and run either way; scores that are null, NaN or not above 0 take no
    part; without any there are no rows.
    """
    edges = edges.where(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    values, vectors = laplacian(affinity(edges, least, k, window), max(most, groups or 2) + 1, dense)
    wanted = min(groups or eigengap(values, fewest, most), max(1, len(values)))
    top = F.slice("v", 1, wanted)
    norm = F.sqrt(F.aggregate(top, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select("node", F.transform(top, lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("v"))
    labels = lloyd(rows, wanted)
    first = labels.groupBy("label").agg(F.min("node").alias("component"))
    return merge_singletons(materialize(labels.join(first, "label").select("node", "component")), n)
