"""Frame folders, reconstructions in text form, trajectories and pair lists as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import natural_key


def frame_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """(cam, idx, path) of numbered images in folders that start with "cam"; of equal numbers the last path stays. Reads no image."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = files.select("path", F.regexp_extract("path", r"/([^/]+)/[^/]*$", 1).alias("cam"), F.regexp_extract(F.lower("path"), rf"(\d+)\.(?:{'|'.join(suffixes)})$", 1).alias("n"))
    named = parts.where((F.col("n") != "") & F.lower("cam").startswith("cam"))
    return named.groupBy("cam", F.col("n").cast("long").alias("idx")).agg(F.max("path").alias("path"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of one text file without comments."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return lines.where(~F.col("line").startswith("#"))


def model_cameras(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, model, width, height, params) of a cameras.txt."""
    f = F.split(F.trim("line"), r"\s+")
    lines = _lines(spark, path).where(F.trim("line") != "")
    return lines.select(f[0].cast("int").alias("camera_id"), f[1].alias("model"), f[2].cast("int").alias("width"), f[3].cast("int").alias("height"), F.slice(f, 5, F.size(f)).cast("array<double>").alias("params"))


def model_images(spark: SparkSession, path: str) -> DataFrame:
    """Poses and 2-D points of an images.txt, whose records take two lines; points without a 3-D point are left out."""
    lines = _lines(spark, path)
    # One file's lines: a model's image list is small beside its points.
    both = lines.select("n", "line", F.lead("line").over(Window.orderBy("n")).alias("points"), F.row_number().over(Window.orderBy("n")).alias("r")).where("r % 2 = 1 AND trim(line) <> ''")
    f, p = F.split(F.trim("line"), r"\s+"), F.filter(F.split(F.trim(F.coalesce("points", F.lit(""))), r"\s+"), lambda x: x != "")
    at = F.sequence(F.lit(0), (F.size(p) / 3).cast("int") - 1)
    found = F.when(F.size(p) >= 3, F.transform(at, lambda i: F.struct(F.get(p, i * 3).cast("double").alias("x"), F.get(p, i * 3 + 1).cast("double").alias("y"), F.get(p, i * 3 + 2).cast("long").alias("point3d_id")))).otherwise(F.array())
    return both.select(f[0].cast("int").alias("image_id"), F.slice(f, 2, 4).cast("array<double>").alias("q"), F.slice(f, 6, 3).cast("array<double>").alias("t"), f[8].cast("int").alias("camera_id"), f[9].alias("name"), F.filter(found, lambda x: x.point3d_id != -1).alias("points"))


def model_points(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, z, error, track, conf) of a points3D.txt; conf falls with the error and rises with the track's length up to five."""
    f = F.split(F.trim("line"), r"\s+")
    n = ((F.size(f) - 8) / 2).cast("int")
    track = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(f, 8 + i * 2).cast("int").alias("image_id"), F.get(f, 9 + i * 2).cast("int").alias("idx")))).otherwise(F.array())
    rows = _lines(spark, path).where(F.trim("line") != "").select(f[0].cast("long").alias("id"), *[f[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")], f[7].cast("double").alias("error"), track.alias("track"))
    return rows.withColumn("conf", 1 / (1 + F.col("error")) * F.least(F.lit(1.0), F.size("track") / 5))


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """(ts, rx, ry, rz, tx, ty, tz) of lines with seven numbers."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(f) == 7).select(*[f[i].cast("double").alias(c) for i, c in enumerate(("ts", "rx", "ry", "rz", "tx", "ty", "tz"))])


def simulator_poses(spark: SparkSession, path: str) -> DataFrame:
    """(camera_index, file_path, depth_file, pose as 16 numbers) of a poses.json."""
    schema = "poses array<struct<camera_index:int,file_path:string,depth_file:string,transform_matrix:array<array<double>>>>"
    poses = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("poses").alias("p"))
    return poses.select("p.camera_index", "p.file_path", "p.depth_file", F.flatten("p.transform_matrix").alias("pose"))


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """(first, second) of lines with two names; # starts a comment."""
    f = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")
    return spark.read.text(path).where(F.size(f) >= 2).select(f[0].alias("first"), f[1].alias("second"))


def sequences(spark: SparkSession, root: str, least: int = 2, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """(sequence, place, path): images of each folder in natural order, folders with fewer than `least` left out. Reads no image."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    named = listed.where(F.lower("path").rlike(rf"\.(?:{'|'.join(suffixes)})$")).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("sequence"), "path")
    by = Window.partitionBy("sequence")
    placed = named.withColumn("n", F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy(natural_key(F.col("path")), "path")) - 1)
    return placed.where(F.col("n") >= least).select("sequence", "place", "path")


def annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of gzipped JSON files that each hold one array of records."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def alignment_text(spark: SparkSession, path: str, heading: str = "After general icp:") -> DataFrame:
    """(path, pose): the sixteen numbers after a heading in each text file; files without it are left out."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    block = F.regexp_extract("value", rf"(?s)\Q{heading}\E(.*)", 1)
    numbers = F.slice(F.regexp_extract_all(block, F.lit(r"[-+]?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?"), F.lit(0)), 1, 16).cast("array<double>")
    return text.select("path", numbers.alias("pose")).where(F.size("pose") == 16)


def scene_grid(spark: SparkSession, pattern: str, rows: int, columns: int) -> DataFrame:
    """(row, column, name) of a catalogue of scenes named by two numbers."""
    one = spark.range(rows).select(F.col("id").cast("int").alias("row"))
    return one.select("row", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column")).withColumn("name", F.format_string(pattern, "row", "column"))
