"""Bird's-eye rasters and voxel blocks."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(df: DataFrame, width: int, height: int) -> DataFrame:
    """All cells (v, u) of a raster."""
    rows = df.sparkSession.range(height).select(F.col("id").alias("v"))
    return rows.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("u"))


def bev_ternary(df: DataFrame, u: Column, v: Column, occupied: Column, free: Column, width: int, height: int) -> DataFrame:
    """(v, u, value): 100 where any voxel of the column is occupied, else 0 where any is free, else -1."""
    seen = df.select(v.alias("v"), u.alias("u"), F.when(occupied, 100).when(free, 0).otherwise(-1).alias("value")).groupBy("v", "u").agg(F.max("value").alias("value"))
    return grid(df, width, height).join(seen, ["v", "u"], "left").select("v", "u", F.coalesce("value", F.lit(-1)).alias("value"))


def bev_probability(df: DataFrame, u: Column, v: Column, p: Column, width: int, height: int) -> DataFrame:
    """(v, u, most, mean): the largest probability (0 at least) and the mean one of each cell, 0 where there is none."""
    seen = df.select(v.alias("v"), u.alias("u"), p.alias("p")).groupBy("v", "u").agg(F.greatest(F.max("p"), F.lit(0.0)).alias("most"), F.avg("p").alias("mean"))
    return grid(df, width, height).join(seen, ["v", "u"], "left").select("v", "u", F.coalesce("most", F.lit(0.0)).alias("most"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def inflate(bev: DataFrame, radius: int) -> DataFrame:
    """Unknown cells within `radius` of an occupied one become free; the rest stays."""
    disc = [(dv, du) for dv, du in itertools.product(range(-radius, radius + 1), repeat=2) if dv * dv + du * du <= radius * radius]
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("dv"), F.lit(b).cast("long").alias("du")) for a, b in disc])
    reached = bev.where("value = 100").select("v", "u", F.explode(steps).alias("s")).select((F.col("v") + F.col("s.dv")).alias("v"), (F.col("u") + F.col("s.du")).alias("u")).distinct()
    joined = bev.join(reached.withColumn("_near", F.lit(True)), ["v", "u"], "left")
    return joined.select("v", "u", F.when((F.col("value") == -1) & F.col("_near"), 0).otherwise(F.col("value")).alias("value"))


def resample(bev: DataFrame, value: str, targets: DataFrame, v: Column, u: Column) -> DataFrame:
    """Bilinear values of a raster at real places (v, u) of the target rows; nothing outside counts 0."""
    at = targets.withColumn("_v", v).withColumn("_u", u).withColumn("_id", F.monotonically_increasing_id())
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in itertools.product((0, 1), repeat=2)])
    near = at.withColumn("_k", F.explode(corners)).withColumn("_cv", (F.floor("_v") + F.col("_k.a")).cast("long")).withColumn("_cu", (F.floor("_u") + F.col("_k.b")).cast("long"))
    weight = (1 - F.abs(F.col("_v") - F.col("_cv"))) * (1 - F.abs(F.col("_u") - F.col("_cu")))
    found = near.join(bev.select(F.col("v").alias("_cv"), F.col("u").alias("_cu"), F.col(value).alias("_x")), ["_cv", "_cu"], "left")
    sums = found.groupBy("_id", *targets.columns).agg(F.sum(weight * F.coalesce(F.col("_x"), F.lit(0.0))).alias(value))
    return sums.drop("_id")


def box_blur(block: DataFrame, value: str, size: list[int], reach: int = 1) -> DataFrame:
    """The mean of each voxel's neighbourhood in a dense block from (0, 0, 0), its border repeated outwards."""
    n = (2 * reach + 1) ** 3
    steps = F.array(*[F.struct(*[F.lit(s).cast("long").alias(c) for s, c in zip(step, "abc", strict=True)]) for step in itertools.product(range(-reach, reach + 1), repeat=3)])
    inside = lambda c, s, top: F.least(F.greatest(F.col(c) + F.col(f"_s.{s}"), F.lit(0).cast("long")), F.lit(top - 1).cast("long"))
    wide = block.select("i", "j", "k", F.explode(steps).alias("_s")).select("i", "j", "k", *[inside(c, s, top).alias(f"_{c}") for c, s, top in zip("ijk", "abc", size, strict=True)])
    source = block.select(*[F.col(c).alias(f"_{c}") for c in "ijk"], F.col(value).alias("_x"))
    return wide.join(source, ["_i", "_j", "_k"], "left").groupBy("i", "j", "k").agg((F.sum(F.coalesce("_x", F.lit(0.0))) / n).alias(value))


def tile_starts(length: int, tile: int, overlap: float) -> list[int]:
    """Starts of evenly spread tiles that overlap by at least a share of their size."""
    if length <= tile:
        return [0]
    n = 1 + -(-(length - tile) // max(1, int(tile * (1 - overlap))))
    return [round(i * (length - tile) / (n - 1)) for i in range(n)]


def tiles(df: DataFrame, length: str, tile: int, overlap: float) -> DataFrame:
    """Each row with the numbers and starts of tile_starts() for its length; a null length gives no rows."""
    left, step = F.col(length) - tile, max(1, int(tile * (1 - overlap)))
    spread = df.withColumn("_n", F.when(left <= 0, 1).otherwise(1 + F.ceil(left / step)).cast("int"))
    spread = spread.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return spread.withColumn("start", F.when(F.col("_n") == 1, 0).otherwise(F.bround(F.col("tile") * left / (F.greatest(F.col("_n"), F.lit(2)) - 1))).cast("int")).drop("_n")


def blend_tiles(tiles: DataFrame, value: str = "value", conf: str = "conf", by: tuple[str, ...] = ("v", "u")) -> DataFrame:
    """Overlapping predictions of a pixel averaged by confidence."""
    return tiles.groupBy(*by).agg((F.sum(F.col(value) * F.col(conf)) / F.sum(conf)).alias(value))
