"""Queries on estimates, losses, tracks and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, estimates
from ..sources import tables as T
from .spatial import r6

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    """Register a query under its function's name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT l_orderkey % 16 AS edge, round(avg(l_tax) * avg(l_discount), 9) AS score FROM lineitem GROUP BY 1")
def edge_scores(spark, d):
    """Confidence product of each edge."""
    li = T.read(spark, d, "lineitem").withColumn("edge", F.col("l_orderkey") % 16)
    return estimates.edge_scores(li, ["edge"], "l_tax", "l_discount").select("edge", F.round("score", 9).alias("score"))


@query("SELECT l_suppkey, round(avg(abs(l_discount * 10 - l_tax * 10) * (1 + l_quantity) - 0.2::DOUBLE * ln(1 + l_quantity)), 6) AS loss FROM lineitem GROUP BY l_suppkey")
def confidence_loss(spark, d):
    """Mean confidence-weighted loss of each group."""
    error = F.abs(F.col("l_discount") * 10 - F.col("l_tax") * 10)
    return T.read(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(F.avg(estimates.confidence_loss(error, 1 + F.col("l_quantity"), 0.2))).alias("loss"))


@query("""WITH p AS (SELECT l_suppkey, avg(abs(l_tax - l_discount)) AS a, sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))) AS r, avg((abs(l_tax - l_discount) > 0.045)::INT) AS b FROM lineitem GROUP BY l_suppkey)
SELECT round(avg(a), 6) AS avgerr, round(avg(r), 6) AS rmse, round(avg(b), 6) AS bad FROM p""")
def regression_scores(spark, d):
    """Errors averaged by image, then over images."""
    s = estimates.regression_scores(T.read(spark, d, "lineitem"), ["l_suppkey"], F.col("l_discount"), F.col("l_tax"), [0.045])
    return s.select(r6(F.col("avgerr")).alias("avgerr"), r6(F.col("rmse")).alias("rmse"), r6(F.col("bad_0")).alias("bad"))


@query("SELECT CAST((l_quantity >= 10)::INT + (l_quantity >= 40)::INT AS INTEGER) AS bin, count(*) AS n, round(avg(l_tax), 6) AS mean FROM lineitem GROUP BY 1")
def binned_errors(spark, d):
    """Error by speed bin."""
    return estimates.binned_errors(T.read(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_tax"), [10, 40]).select("bin", "n", r6(F.col("mean")).alias("mean"))


@query("""WITH t AS (SELECT DISTINCT o_custkey AS track_id, o_orderkey % 40 AS frame_id FROM orders), g AS (SELECT track_id FROM t GROUP BY 1 HAVING count(*) >= 2), n AS (SELECT frame_id, count(*) AS c FROM t SEMI JOIN g USING (track_id) GROUP BY 1)
SELECT f.frame_id, coalesce(c, 0) AS inliers, coalesce(c, 0) >= 64 AS valid FROM (SELECT DISTINCT frame_id FROM t) f LEFT JOIN n USING (frame_id)""")
def track_inliers(spark, d):
    """Tracks of each frame that another frame sees too."""
    t = T.read(spark, d, "orders").select(F.col("o_custkey").alias("track_id"), (F.col("o_orderkey") % 40).alias("frame_id"))
    return estimates.track_inliers(t)


@query("SELECT l_suppkey, quantile_disc(l_extendedprice, 0.5) AS middle FROM lineitem GROUP BY l_suppkey")
def lower_medians(spark, d):
    """Middle price of each group, of two the lower."""
    return T.read(spark, d, "lineitem").groupBy("l_suppkey").agg(estimates.lower_median("l_extendedprice").alias("middle"))


@query("""SELECT o_custkey % 50 AS frame, count(*) AS n, round(quantile_cont(sqrt(o_totalprice * o_totalprice + 9.0), 0.9), 4) AS motion, count(*) < 10 OR quantile_cont(sqrt(o_totalprice * o_totalprice + 9.0), 0.9) >= 90000 AS changed FROM orders GROUP BY 1""")
def motion_gate(spark, d):
    """Frames whose features moved far, or that have too few."""
    m = estimates.motion_gate(T.read(spark, d, "orders").withColumn("frame", F.col("o_custkey") % 50), ["frame"], F.col("o_totalprice"), F.lit(3.0), 90000)
    return m.select("frame", "n", F.round("motion", 4).alias("motion"), "changed")


@query(f"""WITH {T.V_POINTS}, s AS (SELECT frame_id, greatest(avg(sqrt(x * x + y * y + z * z)), 1e-8) AS s FROM v_points GROUP BY frame_id)
SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey, p.l_quantity, p.l_extendedprice, round(x / s, 6) AS x FROM v_points p JOIN s USING (frame_id)""")
def cloud_normalised(spark, d):
    """Points over their frame's mean distance."""
    return estimates.normalise(T.points(spark, d), ["frame_id"], ["x", "y", "z"]).select(*T.POINT_ID, r6(F.col("x")).alias("x"))


@query("""WITH RECURSIVE r AS (SELECT l_suppkey, l_tax AS x, l_discount AS y FROM lineitem), s AS (SELECT 0 AS n, l_suppkey, sum(x * y) / sum(x * x) AS scale FROM r GROUP BY l_suppkey
UNION ALL SELECT s.n + 1, s.l_suppkey, (SELECT sum(x * y / greatest(abs(y - s.scale * x), 1e-8)) / sum(x * x / greatest(abs(y - s.scale * x), 1e-8)) FROM r WHERE r.l_suppkey = s.l_suppkey) FROM s WHERE s.n < 3)
SELECT l_suppkey, round(scale, 6) AS scale FROM s WHERE n = 3""")
def weiszfeld_scale(spark, d):
    """Robust scale between two columns after three rounds."""
    s = estimates.weiszfeld(T.read(spark, d, "lineitem"), ["l_suppkey"], F.col("l_tax"), F.col("l_discount"), rounds=3)
    return s.select("l_suppkey", r6(F.col("scale")).alias("scale"))


@query(f"""WITH {T.V_POINTS}, m AS (SELECT x, y, z, 1.7 * (0.8 * x - 0.6 * y) + 1 AS qx, 1.7 * (0.6 * x + 0.8 * y) + 2 AS qy, 1.7 * z + 3 AS qz FROM v_points),
a AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(qx) AS qx, avg(qy) AS qy, avg(qz) AS qz, count(*) AS n FROM m),
s AS (SELECT max(a.n) AS n, sqrt(sum((m.qx - a.qx) ^ 2 + (m.qy - a.qy) ^ 2 + (m.qz - a.qz) ^ 2) / sum((m.x - a.x) ^ 2 + (m.y - a.y) ^ 2 + (m.z - a.z) ^ 2)) AS scale,
  atan2(sum((m.x - a.x) * (m.qy - a.qy) - (m.y - a.y) * (m.qx - a.qx)), sum((m.x - a.x) * (m.qx - a.qx) + (m.y - a.y) * (m.qy - a.qy))) AS turn FROM m, a)
SELECT s.n, round(scale, 6) AS scale, round(sin(turn), 6) AS r10, round(a.qx - scale * (cos(turn) * a.x - sin(turn) * a.y), 6) AS tx, round(a.qz - scale * a.z, 6) AS tz FROM s, a""")
def similarity_fit(spark, d):
    """The transform of moved points, found again."""
    p = T.points(spark, d)
    moved = p.select("x", "y", "z", *[c.alias(f"q{a}") for a, c in zip("xyz", align.linear([[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]], [F.col(a) for a in "xyz"], [1.0, 2.0, 3.0], 1.7), strict=True)])
    s = align.similarity(moved, ["x", "y", "z"], ["qx", "qy", "qz"])
    return p.agg(F.count("*").alias("n")).select("n", F.lit(round(s.scale, 6)).alias("scale"), F.lit(round(float(s.rotation[1, 0]), 6)).alias("r10"), F.lit(round(float(s.shift[0]), 6)).alias("tx"), F.lit(round(float(s.shift[2]), 6)).alias("tz"))
