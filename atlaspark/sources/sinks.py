"""Voxels, rasters, poses and export manifests written as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_voxels(df: DataFrame, path: str, meta: dict, mode: str = "errorifexists") -> None:
    """Indices (i, j, k) as Parquet, with what is needed to place them in a JSON beside it."""
    df.select("i", "j", "k").write.mode(mode).parquet(f"{path}/ijk")
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def read_voxels(spark, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/ijk"), json.loads(spark.read.text(f"{path}/meta").first().value)


def write_ply(df: DataFrame, path: str, coords: tuple[str, ...] = ("x", "y", "z"), mode: str = "errorifexists") -> None:
    """Points as text parts behind a header file; concatenated in name order they are one ASCII PLY file."""
    spark, n = df.sparkSession, df.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {c}" for c in coords], "end_header"]
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/0-header")
    df.select(F.concat_ws(" ", *[F.format_string("%.6f", c) for c in coords]).alias("value")).write.mode(mode).text(f"{path}/1-vertices")


def write_poses(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines "name qw qx qy qz tx ty tz"."""
    df.select(F.concat_ws(" ", "name", *[F.col(c).cast("string") for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")]).alias("value")).write.mode(mode).text(path)


def export_manifest(frames: DataFrame, pad: int = 8) -> DataFrame:
    """Source and target of every file of a per-camera export: camK/00000012.jpg."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return frames.select("path", F.concat("cam", F.lit("/"), F.lpad(F.col("idx").cast("string"), pad, "0"), ext).alias("target"))


def archive_members(frames: DataFrame) -> DataFrame:
    """Members of each timestamp's archive, in camera order; a timestamp has one file a camera."""
    return frames.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("cam", "path"))).alias("members"))


def write_text_model(cameras: DataFrame, images: DataFrame, tracks: DataFrame, points: DataFrame, path: str, least_views: int = 2, mode: str = "errorifexists") -> None:
    """A reconstruction as cameras, images and points in text form, one folder each, ids from 1.

    cameras (camera_id, model, width, height, params), images (image_id, q, t,
    camera_id, name), tracks (track_id, image_id, x, y), points (track_id, x, y,
    z). Tracks seen in fewer images than least_views are left out.
    """
    text = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    numbers = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    kept = tracks.groupBy("track_id").agg(F.countDistinct("image_id").alias("_n")).where(F.col("_n") >= least_views).select("track_id")
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("track_id", "x", "y")) - 1
    seen = tracks.join(kept, "track_id", "left_semi").withColumn("_i", place)
    cameras.select(text(F.col("camera_id") + 1, F.col("model"), F.col("width"), F.col("height"), numbers("params")).alias("value")).write.mode(mode).text(f"{path}/cameras")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track_id", "x", "y"))), lambda p: text(p.x, p.y, p.track_id + 1)), " ")
    found = seen.groupBy("image_id").agg(rows.alias("_p"))
    head = text(F.col("image_id") + 1, numbers("q"), numbers("t"), F.col("camera_id") + 1, F.col("name"))
    images.join(found, "image_id", "left").select(F.concat_ws("\n", head, F.coalesce("_p", F.lit(""))).alias("value")).write.mode(mode).text(f"{path}/images")
    track = seen.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_id", "_i"))), lambda t: text(t.image_id + 1, t._i)), " ").alias("_t"))
    points.join(track, "track_id").select(text(F.col("track_id") + 1, F.col("x"), F.col("y"), F.col("z"), F.lit("0 0 0 0"), F.col("_t")).alias("value")).write.mode(mode).text(f"{path}/points")


def write_bev(bev: DataFrame, path: str, resolution: float, origin: tuple[float, float], z_band: tuple[float, float], mode: str = "errorifexists") -> None:
    """A floor plan (v, u, value) as Parquet, with its size, place and height band in a JSON beside it."""
    size = bev.agg((F.max("v") + 1).alias("height"), (F.max("u") + 1).alias("width")).first()
    meta = {"resolution": resolution, "origin_xy": list(origin), "width": size.width or 0, "height": size.height or 0, "z_band": list(z_band)}
    bev.select("v", "u", F.col("value").cast("tinyint").alias("value")).write.mode(mode).parquet(f"{path}/cells")
    bev.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def read_bev(spark, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/cells"), json.loads(spark.read.text(f"{path}/meta").first().value)
