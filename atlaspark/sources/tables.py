"""Point clouds, frames, edges and poses read from the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that tell the rows of lineitem apart.
POINT_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points: frame, epoch, x, y, z, conf and the row's own id."""
    return read(spark, sf_dir, "lineitem").select(
        *POINT_ID,
        (F.col("l_orderkey") % 8).cast("int").alias("frame_id"),
        F.col("l_linenumber").cast("int").alias("epoch"),
        (F.col("l_quantity") / 10.0).alias("x"),
        (F.col("l_extendedprice") / 20000.0).alias("y"),
        (F.round(F.col("l_discount") * 100) / 50.0).alias("z"),
        (F.col("l_tax") * 100.0).alias("conf"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as cells of a fine lattice by epoch and frame."""
    return read(spark, sf_dir, "lineitem").select(
        *POINT_ID,
        (F.col("l_orderkey") % 8).cast("int").alias("frame_id"),
        F.col("l_linenumber").cast("int").alias("epoch"),
        F.floor("l_quantity").cast("long").alias("i"),
        F.floor(F.col("l_extendedprice") / 2500.0).cast("long").alias("j"),
        F.round(F.col("l_discount") * 100).cast("long").alias("k"),
        F.col("l_tax").alias("tax"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frame files: camera, hourly index, path."""
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).cast("int").alias("cam"),
        (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("int").alias("idx"),
        "event_id",
    )


def verified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as two-view geometries: two image ids in one number, and a count of inliers."""
    return read(spark, sf_dir, "orders").select(
        ((F.col("o_custkey") % 64) * 4294967296 + F.col("o_orderkey") % 64).alias("pair_id"),
        (F.floor("o_totalprice").cast("long") % 40).alias("rows"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored frame pairs src < dst over 24 frames, from the lattice cells that they share."""
    seen = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 24).cast("int").alias("f"),
        F.floor("l_quantity").cast("long").alias("i"), F.floor(F.col("l_extendedprice") / 2500.0).cast("long").alias("j"), F.round(F.col("l_discount") * 100).cast("long").alias("k"),
    ).distinct()
    sizes = seen.groupBy("f").agg(F.count("*").alias("n"))
    shared = seen.alias("a").join(seen.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.f") < F.col("b.f")))
    shared = shared.groupBy(F.col("a.f").alias("src"), F.col("b.f").alias("dst")).agg(F.count("*").alias("both"))
    a, b = sizes.select(F.col("f").alias("src"), F.col("n").alias("na")), sizes.select(F.col("f").alias("dst"), F.col("n").alias("nb"))
    return shared.join(a, "src").join(b, "dst").select("src", "dst", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("score"))


def pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as localisation results: translation and angle error by query group."""
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("grp"), (F.col("value") / 100.0).alias("transl_err"), (F.get_json_object("props", "$.k").cast("double") / 10.0).alias("ang_err")
    )


V_POINTS = """v_points AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CAST(l_orderkey % 8 AS INTEGER) AS frame_id, CAST(l_linenumber AS INTEGER) AS epoch, l_quantity / 10.0::DOUBLE AS x,
  l_extendedprice / 20000.0::DOUBLE AS y, round(l_discount * 100) / 50.0::DOUBLE AS z, l_tax * 100.0::DOUBLE AS conf FROM lineitem)"""
V_CELLS = """v_cells AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CAST(l_orderkey % 8 AS INTEGER) AS frame_id, CAST(l_linenumber AS INTEGER) AS epoch, CAST(floor(l_quantity) AS BIGINT) AS i,
  CAST(floor(l_extendedprice / 2500.0::DOUBLE) AS BIGINT) AS j, CAST(round(l_discount * 100) AS BIGINT) AS k, l_tax AS tax FROM lineitem)"""
V_FRAMES = "v_frames AS (SELECT CAST(user_id % 4 AS INTEGER) AS cam, CAST(day(ts) * 24 + hour(ts) AS INTEGER) AS idx, event_id FROM events)"
V_TVG = "v_tvg AS (SELECT (o_custkey % 64) * 4294967296 + o_orderkey % 64 AS pair_id, CAST(floor(o_totalprice) AS BIGINT) % 40 AS rows FROM orders)"
V_EDGES = """v_seen AS (SELECT DISTINCT CAST(l_orderkey % 24 AS INTEGER) AS f, CAST(floor(l_quantity) AS BIGINT) AS i, CAST(floor(l_extendedprice / 2500.0::DOUBLE) AS BIGINT) AS j, CAST(round(l_discount * 100) AS BIGINT) AS k
  FROM lineitem), v_size AS (SELECT f, count(*) AS n FROM v_seen GROUP BY f),
v_edges AS (SELECT s.src, s.dst, s.both::DOUBLE / (a.n + b.n - s.both) AS score FROM
  (SELECT a.f AS src, b.f AS dst, count(*) AS both FROM v_seen a JOIN v_seen b ON a.i = b.i AND a.j = b.j AND a.k = b.k AND a.f < b.f GROUP BY a.f, b.f) s
  JOIN v_size a ON a.f = s.src JOIN v_size b ON b.f = s.dst)"""
V_POSES = "v_poses AS (SELECT event_id, event_type AS grp, value / 100.0::DOUBLE AS transl_err, CAST(props->>'$.k' AS DOUBLE) / 10.0 AS ang_err FROM events)"
