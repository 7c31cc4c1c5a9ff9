"""Queries on frames, pixels and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import frames, graph, joins, raster
from ..sources import tables as T
from .spatial import BEV_CELLS, _bev, r6

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    """Register a query under its function's name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT TRY_CAST(regexp_extract(CASE WHEN event_id % 3 = 0 THEN 'All' ELSE (user_id || ': ' || event_type) END, '^\\s*(\\d{1,9})\\s*:', 1) AS INTEGER) AS frame, count(*) AS n FROM events GROUP BY 1")
def frame_selector(spark, d):
    """Frames chosen by a label; what is no choice counts as none."""
    label = F.when(F.col("event_id") % 3 == 0, "All").otherwise(F.concat_ws(": ", F.col("user_id").cast("string"), "event_type"))
    return T.read(spark, d, "events").groupBy(frames.selected_index(label).alias("frame")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_size * 5 + p_partkey % 251 + p_partkey % 7 >= 16 AND NOT (p_size * 5 > 240 AND p_partkey % 251 > 240 AND p_partkey % 7 > 240)")
def background_masks(spark, d):
    """Pixels that are neither black nor white."""
    rgb = [F.col("p_size") * 5, F.col("p_partkey") % 251, F.col("p_partkey") % 7]
    return T.read(spark, d, "part").where(frames.not_black(*rgb) & frames.not_white(*rgb)).select("p_partkey")


@query("SELECT CASE WHEN o_custkey % 10 = 0 THEN 'test' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'train' END AS split, count(*) AS n FROM orders GROUP BY 1")
def scene_split(spark, d):
    """Scenes split by the last digit of their number and by name."""
    split = F.when(F.col("o_custkey") % 10 == 0, "test").when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("train")
    return T.read(spark, d, "orders").groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@query(f"WITH {T.V_FRAMES}, i AS (SELECT DISTINCT cam, idx FROM v_frames) SELECT a.cam, a.idx AS src, b.idx AS dst FROM i a JOIN i b ON a.cam = b.cam AND abs(a.idx - b.idx) BETWEEN 1 AND 30 AND (a.idx - b.idx) % 5 = 0")
def frame_combinations(spark, d):
    """Pairs of a camera's frames a multiple of five apart, up to thirty."""
    return joins.frame_combinations(T.frames(spark, d), 5, 30)


@query(f"""WITH {BEV_CELLS}, ok AS (SELECT v, u FROM bev WHERE value = 100), q AS (SELECT a.v, a.u FROM ok a JOIN ok b ON b.v = a.v AND b.u = a.u + 1 JOIN ok c ON c.v = a.v + 1 AND c.u = a.u JOIN ok e ON e.v = a.v + 1 AND e.u = a.u + 1)
SELECT v * 1048576 + u AS a, v * 1048576 + u + 1 AS b, (v + 1) * 1048576 + u AS c FROM q UNION ALL SELECT (v + 1) * 1048576 + u, v * 1048576 + u + 1, (v + 1) * 1048576 + u + 1 FROM q""")
def mesh_faces(spark, d):
    """Triangles over the occupied cells of the floor plan."""
    return frames.mesh_faces(_bev(spark, d).withColumn("ok", F.col("value") == 100), "ok")


@query(f"""WITH {BEV_CELLS}, ok AS (SELECT v, u, (v * 31 + u * 17) % 256 AS shade, v * 1048576 + u AS i FROM bev WHERE value = 100),
x AS (SELECT a.i AS a, b.i AS b, c.i AS c, a.shade FROM ok a JOIN ok b ON b.v = a.v AND b.u = a.u + 1 JOIN ok c ON c.v = a.v + 1 AND c.u = a.u),
y AS (SELECT a.i AS a, b.i AS b, c.i AS c, c.shade FROM ok c JOIN ok a ON a.v = c.v - 1 AND a.u = c.u JOIN ok b ON b.v = c.v AND b.u = c.u - 1),
z AS (SELECT * FROM x UNION ALL SELECT * FROM y) SELECT a, b, c, shade FROM z UNION ALL SELECT c, b, a, shade FROM z""")
def mesh_surface(spark, d):
    """Triangles over the occupied cells of the floor plan by their own three corners, from both sides, with a colour."""
    cells = _bev(spark, d).withColumn("ok", F.col("value") == 100).withColumn("shade", (F.col("v") * 31 + F.col("u") * 17) % 256)
    return frames.surface_faces(cells, "ok", "shade")


@query("""WITH r AS (SELECT o_orderkey * 3 AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 5 <> 0), l AS (SELECT o_orderkey AS id, o_orderkey * 3 + CAST(o_orderkey % 3 AS BIGINT) - 1 AS k FROM orders)
SELECT l.id, l.k, coalesce(a.v, b.v, c.v) AS v FROM l LEFT JOIN r a ON a.k = l.k LEFT JOIN r b ON b.k = l.k - 1 LEFT JOIN r c ON c.k = l.k + 1""")
def tolerance_lookup(spark, d):
    """Rows found by an equal key, or one step to either side."""
    o = T.read(spark, d, "orders")
    right = o.where("o_orderkey % 5 <> 0").select((F.col("o_orderkey") * 3).alias("k"), F.col("o_totalprice").alias("v"))
    left = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 3 + F.col("o_orderkey") % 3 - 1).alias("k"))
    return frames.within_tolerance(left, right, "k", 1, "v")


@query("SELECT user_id % 64 AS v, event_id % 64 AS u, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def pixel_scatter(spark, d):
    """The value written last to each pixel."""
    e = T.read(spark, d, "events").withColumn("v", F.col("user_id") % 64).withColumn("u", F.col("event_id") % 64)
    return frames.last_written(e, ["v", "u"], "value", ["event_id"])


@query("""WITH s AS (SELECT DISTINCT o_orderkey * 10 AS t, o_totalprice AS value FROM orders), q AS (SELECT event_id, event_id * 7 AS t FROM events),
y AS (SELECT q.*, s.t AS a FROM q ASOF LEFT JOIN s ON q.t >= s.t), x AS (SELECT y.*, s.t AS b FROM y ASOF LEFT JOIN s ON y.t <= s.t)
SELECT event_id, x.t, round(CASE WHEN a = b THEN sa.value ELSE sa.value + (sb.value - sa.value) * (x.t - a) / (b - a) END, 4) AS value FROM x LEFT JOIN s sa ON sa.t = x.a LEFT JOIN s sb ON sb.t = x.b""")
def interpolated(spark, d):
    """Values between samples, on straight lines."""
    s = T.read(spark, d, "orders").select((F.col("o_orderkey") * 10).alias("t"), F.col("o_totalprice").alias("value")).distinct()
    q = T.read(spark, d, "events").select("event_id", (F.col("event_id") * 7).alias("t"))
    return frames.interpolate(q, s, "t", "value", "event_id").select("event_id", "t", F.round("value", 4).alias("value"))


@query("SELECT c_custkey, CAST(k.range AS INTEGER) AS copy FROM customer, range(3) k")
def dataset_repeat(spark, d):
    """Every customer three times."""
    return frames.repeat(T.read(spark, d, "customer").select("c_custkey"), 3)


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY (p_partkey * 2654435761 + 3) % 4294967296, p_partkey) - 1 AS r, count(*) OVER () AS n FROM part)
SELECT p_partkey, CAST(r + k.range * n AS BIGINT) AS place FROM r, range(100) k WHERE r + k.range * n < 3000""")
def dataset_resize(spark, d):
    """Three thousand rows from the parts, in a seeded order, again and again."""
    return frames.resize(T.read(spark, d, "part").select("p_partkey"), [F.col("p_partkey")], 3000, 3, "p_partkey").select("p_partkey", F.col("place").cast("long").alias("place"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 360 - 180 BETWEEN -60 AND 60 THEN 0 ELSE CAST(((round_even((p_partkey % 360 - 180) / 90.0::DOUBLE, 0)::BIGINT % 4) + 4) % 4 * 90 AS INTEGER) END AS turn, lower(printf('%x', p_partkey // 256 % 16)) || '/' || lower(printf('%x', p_partkey // 16 % 16)) || '/' || lower(printf('%x', p_partkey % 16)) AS path FROM part")
def names_and_turns(spark, d):
    """Snapped rotations and hierarchical paths."""
    p = T.read(spark, d, "part")
    return p.select("p_partkey", frames.snap_rotation(F.col("p_partkey") % 360 - 180).alias("turn"), frames.hex_path(F.col("p_partkey"), 16, 3).alias("path"))


@query("""WITH g AS (SELECT p_partkey, list_transform([1.0, 1.33, 1.78]::DOUBLE[], lambda r: abs(greatest(p_size + 10, p_partkey % 97 + 10)::DOUBLE / least(p_size + 10, p_partkey % 97 + 10) - r)) AS g FROM part)
SELECT p_partkey, list_position(g, list_min(g)) - 1 AS bucket FROM g""")
def aspect_bucket(spark, d):
    """Nearest aspect ratio of each size."""
    return T.read(spark, d, "part").select("p_partkey", frames.nearest_bucket((F.col("p_size") + 10).cast("double"), (F.col("p_partkey") % 97 + 10).cast("double"), [1.0, 1.33, 1.78]).cast("int").alias("bucket"))


@query("SELECT event_id, round(CASE WHEN value / 0.5 <= 120 THEN value / 0.5 ELSE 0 END, 6) AS depth, round(value / 255 , 6) AS conf FROM events")
def depth_and_confidence(spark, d):
    """Decoded depths, and confidences brought to one."""
    e = frames.unit_confidence(T.read(spark, d, "events"), ["confidence", "value"])
    return e.select("event_id", r6(frames.decode_depth(F.col("value"), 0.5, 120)).alias("depth"), r6(F.col("conf")).alias("conf"))


@query(f"WITH {T.V_EDGES} SELECT src, dst FROM v_edges WHERE score >= 0.05 UNION SELECT dst, src FROM v_edges WHERE score >= 0.05")
def symmetric_closure(spark, d):
    """Strong edges and their reverses."""
    return graph.both_ways(T.edges(spark, d).where("score >= 0.05")).select("src", "dst").distinct()


@query("SELECT event_id, round(sin(pi() * value / 100), 6) AS s0, round(sin(4 * pi() * value / 100), 6) AS s2, round(cos(2 * pi() * value / 100), 6) AS c1 FROM events")
def fourier_features(spark, d):
    """Sines and cosines at doubling frequencies."""
    e = T.read(spark, d, "events").select("event_id", G.fourier(F.col("value") / 100, 3).alias("f"))
    return e.select("event_id", r6(F.col("f")[0]).alias("s0"), r6(F.col("f")[2]).alias("s2"), r6(F.col("f")[4]).alias("c1"))


@query(f"""WITH {T.V_FRAMES}, l AS (SELECT cam, max(idx) + 1 AS length FROM v_frames GROUP BY cam),
n AS (SELECT cam, length, CASE WHEN length <= 30 THEN 1 ELSE 1 + (length - 30 + 17) // 18 END AS n FROM l), t AS (SELECT cam, length, n, unnest(range(n)) AS i FROM n)
SELECT cam, CAST(i AS INTEGER) AS tile, CASE WHEN n = 1 THEN 0 ELSE CAST(round_even(i * (length - 30) / (n - 1)::DOUBLE, 0) AS INTEGER) END AS start FROM t""")
def tile_starts(spark, d):
    """Starts of overlapping tiles of thirty along each camera's frames."""
    lengths = T.frames(spark, d).groupBy("cam").agg((F.max("idx") + 1).alias("length"))
    return raster.tiles(lengths, "length", 30, 0.4).select("cam", "tile", "start")
