"""Robust estimates, losses and counts of reconstructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize


def lower_median(column: str) -> Column:
    """The middle value, of two the lower."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}`)")


def weiszfeld(df: DataFrame, by: list[str], x: Column, y: Column, rounds: int = 10, eps: float = 1e-8) -> DataFrame:
    """(by, scale): the scale s that makes s * x nearest to y in the sum of distances, by reweighted least squares."""
    rows = materialize(df.select(*by, x.alias("_x"), y.alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL"))
    ratio = F.sum(F.col("_w") * F.col("_x") * F.col("_y")) / F.sum(F.col("_w") * F.col("_x") * F.col("_x"))
    scale = rows.withColumn("_w", F.lit(1.0)).groupBy(*by).agg(ratio.alias("scale"))
    for _ in range(rounds):
        gap = F.abs(F.col("_y") - F.col("scale") * F.col("_x"))
        scale = rows.join(scale, by).withColumn("_w", 1 / F.greatest(gap, F.lit(eps))).groupBy(*by).agg(ratio.alias("scale"))
    return scale


def normalise(df: DataFrame, by: list[str], coords: list[str], how: str = "avg") -> DataFrame:
    """Coordinates over the mean (or median) distance from the origin within a group."""
    d = F.sqrt(sum((F.col(c) * F.col(c) for c in coords), F.lit(0.0)))
    agg = F.avg(d) if how == "avg" else F.percentile(d, F.lit(0.5))
    size = df.groupBy(*by).agg(F.greatest(agg, F.lit(1e-8)).alias("_s"))
    return df.join(size, by).withColumns({c: F.col(c) / F.col("_s") for c in coords}).drop("_s")


def edge_scores(df: DataFrame, edge: list[str], conf_i: str, conf_j: str) -> DataFrame:
    """Product of the two sides' mean confidences."""
    return df.groupBy(*edge).agg((F.avg(conf_i) * F.avg(conf_j)).alias("score"))


def confidence_loss(error: Column, conf: Column, alpha: float) -> Column:
    return error * conf - F.lit(alpha) * F.log(conf)


def laplacian_loss(error: Column, log_scale: Column) -> Column:
    return error / F.exp(log_scale) + log_scale


def regression_scores(df: DataFrame, image: list[str], gt: Column, pred: Column, limits: list[float]) -> DataFrame:
    """Mean over images of the mean error, root mean square and share of errors above each limit; infinite truths are left out."""
    e = df.where(F.abs(gt) < float("inf")).withColumn("_e", F.abs(pred - gt))
    per = e.groupBy(*image).agg(F.avg("_e").alias("avgerr"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), *[F.avg((F.col("_e") > t).cast("double")).alias(f"bad_{i}") for i, t in enumerate(limits)])
    return per.agg(*[F.avg(c).alias(c) for c in per.columns if c not in image])


def binned_errors(df: DataFrame, size: Column, error: Column, edges: list[float]) -> DataFrame:
    """Count and mean error of rows by the bin their size falls in, below edges[0] being bin 0."""
    place = sum(((size >= e).cast("int") for e in edges), F.lit(0))
    return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(error).alias("mean"))


def track_inliers(tracks: DataFrame, least_views: int = 2, least_inliers: int = 64) -> DataFrame:
    """(frame_id, inliers, valid): tracks seen in enough frames, counted by frame."""
    good = tracks.groupBy("track_id").agg(F.countDistinct("frame_id").alias("v")).where(F.col("v") >= least_views)
    n = tracks.join(good, "track_id", "left_semi").groupBy("frame_id").agg(F.countDistinct("track_id").alias("inliers"))
    return tracks.select("frame_id").distinct().join(n, "frame_id", "left").select("frame_id", F.coalesce("inliers", F.lit(0)).alias("inliers")).withColumn("valid", F.col("inliers") >= least_inliers)


def motion_gate(df: DataFrame, by: list[str], dx: Column, dy: Column, least: float, q: float = 0.9, fewest: int = 10) -> DataFrame:
    """(by, motion, changed): the q-th quantile of displacements; too few of them count as changed."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(F.sqrt(dx * dx + dy * dy), F.lit(q)).alias("motion"))
    return n.withColumn("changed", (F.col("n") < fewest) | (F.col("motion") >= least))
