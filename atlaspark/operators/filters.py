"""Row filters of point clouds, voxels, frames and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance, is_finite
from .ordered import quantiles_by


def percentile_filter(df: DataFrame, q: float, conf: str = "conf", coords: tuple[str, ...] = ("x", "y", "z"), floor: float = 1e-5) -> DataFrame:
    """Rows with finite values whose confidence reaches the q-th quantile of all finite ones and exceeds `floor`."""
    valid = df.where(is_finite(conf, *coords))
    cut = quantiles_by(valid, [], conf, [q]).withColumnRenamed("q0", "_cut")
    return valid.crossJoin(F.broadcast(cut)).where((F.col(conf) >= F.col("_cut")) & (F.col(conf) > floor)).drop("_cut")


def within_range(df: DataFrame, point: list[str], centre: list[str], most: float) -> DataFrame:
    """Points at most so far from their camera."""
    return df.where(distance([F.col(c) for c in point], [F.col(c) for c in centre]) <= most)


def in_block(df: DataFrame, low: list[int], high: list[int], index: tuple[str, ...] = ("i", "j", "k"), most: int | None = None) -> DataFrame:
    """Voxels inside an inclusive block, each side capped to `most` voxels."""
    top = [min(h, lo + most - 1) if most else h for lo, h in zip(low, high, strict=True)]
    cond = F.lit(True)
    for c, lo, h in zip(index, low, top, strict=True):
        cond &= F.col(c).between(lo, h)
    return df.where(cond)


def sequence_gap(src: Column, dst: Column, n: Column | int | None = None) -> Column:
    """How far apart two frames are in order; around a closed loop of n frames if n is given."""
    gap = F.abs(src - dst)
    if n is None:
        return gap
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(gap, F.abs(src + n - dst), F.abs(src - n - dst))


def denoise(df: DataFrame, q: float = 0.99, coords: tuple[str, ...] = ("x", "y", "z"), distance_name: str | None = None) -> DataFrame:
    """Points nearer to the median point than the q-th quantile of such distances; the distance stays as a column if it is named."""
    far = df
    for c in coords:
        far = far.crossJoin(F.broadcast(quantiles_by(df, [], c, [0.5]).withColumnRenamed("q0", f"_{c}")))
    far = far.withColumn("_d", distance([F.col(c) for c in coords], [F.col(f"_{c}") for c in coords]))
    cut = quantiles_by(far, [], "_d", [q]).withColumnRenamed("q0", "_cut")
    kept = far.crossJoin(F.broadcast(cut)).where("_d < _cut").drop("_cut", *[f"_{c}" for c in coords])
    return kept.withColumnRenamed("_d", distance_name) if distance_name else kept.drop("_d")


def occupied(lt: Column, st: Column, threshold: float, margin: float) -> Column:
    return (lt > threshold) | (st > threshold + margin)
