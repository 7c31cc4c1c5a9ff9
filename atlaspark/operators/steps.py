"""What follows from step to step of a sequence: clones of unchanged steps, keyframes, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from .graph import SMALL, spanning_tree


def clone_unchanged(steps: DataFrame, by: list[str], at: str, changed: Column) -> DataFrame:
    """Add cloned (nothing changed, so the last result is published again) and source, the step whose result that is."""
    order = Window.partitionBy(*by).orderBy(at)
    runs = changed | (F.row_number().over(order) == 1)
    found = steps.withColumn("_runs", runs)
    source = F.max(F.when(F.col("_runs"), F.col(at))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("cloned", ~F.col("_runs")).withColumn("source", source).drop("_runs")


def keyframes(steps: DataFrame, by: list[str], at: str, changed: Column, most: int) -> DataFrame:
    """(by.., at, frames): the first step as anchor, then the last `most` steps up to this one that changed.

    Changed steps are numbered, so that each step looks back over `most` of them
    by a join of equal keys, however far back they lie.
    """
    order = Window.partitionBy(*by).orderBy(at)
    rows = steps.select(*by, at, changed.alias("_c"), F.first(at).over(order).alias("_a"), F.row_number().over(order).alias("_n"))
    keep = (F.col("_c") & (F.col("_n") > 1)).cast("int")
    rows = rows.withColumn("_k", F.sum(keep).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.where(keep == 1).select(*by, F.col("_k").alias("_want"), F.col(at).alias("_frame"))
    wanted = rows.select(*by, at, "_a", F.explode_outer(F.when(F.col("_k") > 0, F.sequence(F.greatest(F.lit(1), F.col("_k") - most + 1), F.col("_k")))).alias("_want"))
    found = wanted.join(kept, [*by, "_want"], "left").groupBy(*by, at, "_a").agg(F.array_sort(F.collect_list("_frame")).alias("_f"))
    return found.select(*by, at, F.concat(F.array("_a"), "_f").alias("frames"))


def against_previous(steps: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Add gained (against the step before, 0 for the first) and loss, the group's mean absolute change."""
    before = steps.withColumn("_l", F.lag(value).over(Window.partitionBy(*by).orderBy(at)))
    mean = before.groupBy(*by).agg(F.avg(F.abs(F.col(value) - F.col("_l"))).alias("loss"))
    return before.join(mean, by).select(*steps.columns, F.coalesce(F.col(value) - F.col("_l"), F.lit(0)).alias("gained"), F.coalesce("loss", F.lit(0.0)).alias("loss"))


def schedule(edges: DataFrame, changes: DataFrame, budget: int, plus_one: bool = True, small: int = SMALL) -> DataFrame:
    """(epoch, place, src, dst, age): the pairs that each epoch runs, and for how many epochs each had not run.

    edges (src, dst, score), changes (epoch, node): each changed frame asks for
    the best pair of the maximum spanning tree at it (ties to the smaller other
    frame). Frames ask in order; an epoch runs the first `budget` different
    pairs, or one more, as a counter does that is only looked at before a pair
    is added (plus_one). Epochs are counted as they stand in changes, a pair
    that never ran from the first one. Frames outside the tree and null ones
    ask for nothing.
    """
    heads = incident_best(edges, small)
    asked = changes.select("epoch", "node").where("epoch IS NOT NULL").distinct()
    turns = ordered.numbered(asked.select("epoch").distinct(), [F.col("epoch")], "turn")
    wanted = asked.join(heads, "node").groupBy("epoch", "src", "dst").agg(F.min("node").alias("first"))
    # As many rows in an epoch as the tree has pairs at most.
    place = F.row_number().over(Window.partitionBy("epoch").orderBy("first", "src", "dst")) - 1
    runs = wanted.withColumn("place", place).where(F.col("place") < budget + int(plus_one)).join(turns, "epoch")
    last = F.lag("turn").over(Window.partitionBy("src", "dst").orderBy("turn"))
    return runs.select("epoch", "place", "src", "dst", (F.col("turn") - F.coalesce(last + 1, F.lit(0))).cast("long").alias("age"))


def incident_best(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, src, dst): the best pair of the maximum spanning tree at each frame."""
    tree = spanning_tree(edges, small)
    ends = [tree.select(F.col(a).alias("node"), F.struct((-F.col("score")).alias("cost"), F.col(b).alias("other"), "src", "dst").alias("e")) for a, b in (("src", "dst"), ("dst", "src"))]
    return ends[0].unionByName(ends[1]).groupBy("node").agg(F.min("e").alias("e")).select("node", "e.src", "e.dst")
