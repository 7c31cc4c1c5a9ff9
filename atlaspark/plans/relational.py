"""Join, set, window, sampling, graph and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import filters, graph, joins, metrics, ordered, windows
from ..sources import tables as T
from .spatial import r6
from .storage import materialize

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    """Register a query under its function's name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {T.V_FRAMES} SELECT idx FROM v_frames GROUP BY idx HAVING count(DISTINCT cam) = (SELECT count(DISTINCT cam) FROM v_frames)")
def frame_sync(spark, d):
    """Frame indices that all cameras have."""
    return joins.synchronised(T.frames(spark, d))


@query(f"""WITH {T.V_FRAMES}, s AS (SELECT idx FROM v_frames GROUP BY idx HAVING count(DISTINCT cam) = (SELECT count(DISTINCT cam) FROM v_frames)),
n AS (SELECT idx, row_number() OVER (ORDER BY idx) AS r FROM s WHERE idx BETWEEN 100 AND 600) SELECT idx FROM n WHERE (r - 1) % 3 = 0""")
def frame_stride(spark, d):
    """Every third common frame of a range."""
    synced = joins.synchronised(T.frames(spark, d)).where("idx BETWEEN 100 AND 600")
    return windows.stride(synced, [], [F.col("idx")], 3)


@query(f"""WITH {T.V_FRAMES} SELECT printf('cam%d/%08d.jpg', cam, idx) AS path, count(*) AS n FROM v_frames GROUP BY 1""")
def frame_manifest(spark, d):
    """Paths that a per-camera export writes, with how many sources each has."""
    return T.frames(spark, d).groupBy(F.format_string("cam%d/%08d.jpg", "cam", "idx").alias("path")).agg(F.count("*").alias("n"))


@query(f"""WITH {T.V_CELLS}, a AS (SELECT DISTINCT i, j, k FROM v_cells WHERE epoch = 1), b AS (SELECT DISTINCT i, j, k FROM v_cells WHERE epoch = 2)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'rows', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)""")
def set_operations(spark, d):
    """Sizes of the intersection, union, difference and concatenation of two epochs' voxels."""
    c = T.cells(spark, d)
    a, b = (c.where(F.col("epoch") == e).select("i", "j", "k").distinct() for e in (1, 2))
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "first": a.subtract(b), "rows": a.unionByName(b)}
    out = None
    for name, df in parts.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.union(n)
    return out


@query(f"""WITH {T.V_CELLS}, a AS (SELECT DISTINCT i, j, k FROM v_cells WHERE epoch = 1), b AS (SELECT DISTINCT i, j + 1 AS j, k FROM v_cells WHERE epoch = 1)
SELECT shared AS "both", n_a, n_b, shared::DOUBLE / (n_a + n_b - shared) AS iou FROM (SELECT (SELECT count(*) FROM a JOIN b USING (i, j, k)) AS shared, (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b)""")
def voxel_set_iou(spark, d):
    """Overlap of an epoch's voxels with themselves moved by one."""
    c = T.cells(spark, d).where("epoch = 1")
    return metrics.set_iou(c, c.withColumn("j", F.col("j") + 1), ["i", "j", "k"])


def _hours(spark, d):
    """The hours of the day that frames have, as frames of one cycle."""
    return T.frames(spark, d).select((F.col("idx") % 24).alias("idx")).distinct()


HOURS = f"WITH {T.V_FRAMES}, h AS (SELECT DISTINCT idx % 24 AS f FROM v_frames), n AS (SELECT max(f) + 1 AS n FROM h)"


@query(f"{HOURS} SELECT a.f AS src, b.f AS dst FROM h a, h b WHERE a.f <> b.f")
def pair_complete(spark, d):
    """All ordered pairs of hours."""
    return joins.frame_pairs(_hours(spark, d), "complete", symmetric=True)


@query(f"{HOURS} SELECT DISTINCT CAST(least(f, (f + s.range + 1) % n) AS INTEGER) AS src, CAST(greatest(f, (f + s.range + 1) % n) AS INTEGER) AS dst FROM h, n, range(3) s")
def pair_swin(spark, d):
    """Pairs of hours within a sliding window around the cycle."""
    return joins.frame_pairs(_hours(spark, d), "swin", 3)


@query(f"{HOURS} SELECT f AS src, CAST(f + (1 << s.range) AS INTEGER) AS dst FROM h, n, range(4) s WHERE f + (1 << s.range) < n")
def pair_logwin(spark, d):
    """Pairs of hours at distances of powers of two, not around the cycle."""
    return joins.frame_pairs(_hours(spark, d), "logwin", 4, cyclic=False)


@query(f"{HOURS} SELECT CAST(3 AS INTEGER) AS src, f AS dst FROM h WHERE f <> 3")
def pair_oneref(spark, d):
    """Pairs with one reference hour."""
    return joins.frame_pairs(_hours(spark, d), "oneref", 3)


@query(f"WITH {T.V_EDGES} SELECT src, dst, round(score, 9) AS score FROM v_edges WHERE least(abs(src - dst), abs(src + 24 - dst), abs(src - 24 - dst)) <= 4")
def pair_sequence_filter(spark, d):
    """Scored pairs at most four frames apart around the cycle."""
    e = T.edges(spark, d).where(filters.sequence_gap(F.col("src"), F.col("dst"), 24) <= 4)
    return e.select("src", "dst", F.round("score", 9).alias("score"))


@query(f"""WITH {T.V_TVG}, e AS (SELECT pair_id >> 32 AS u, pair_id & 4294967295 AS v FROM v_tvg WHERE rows >= 15), b AS (SELECT u AS img, v AS other FROM e UNION ALL SELECT v, u FROM e)
SELECT i.range AS image_id, count(*) AS degree, count(b.other) AS partners FROM range(66) i LEFT JOIN b ON b.img = i.range GROUP BY i.range""")
def image_degrees(spark, d):
    """Verified pairs of each image; an image without any counts one row but no partner."""
    e = T.verified_pairs(spark, d).where("rows >= 15").select(F.shiftright("pair_id", 32).alias("src"), F.col("pair_id").bitwiseAND(4294967295).alias("dst"))
    images = spark.range(66).select(F.col("id").alias("image_id"))
    joined = images.join(graph.both_ways(e), F.col("image_id") == F.col("src"), "left")
    return joined.groupBy("image_id").agg(F.count("*").alias("degree"), F.count("dst").alias("partners"))


@query(f"""WITH {T.V_TVG}, i AS (SELECT range AS image_id, printf('img%03d.jpg', range) AS name FROM range(64))
SELECT a.name AS first, b.name AS second, p.pair_id, sum(p.rows)::BIGINT AS inliers FROM v_tvg p JOIN i a ON a.image_id = p.pair_id >> 32 JOIN i b ON b.image_id = p.pair_id & 4294967295 GROUP BY ALL ORDER BY inliers DESC, pair_id LIMIT 10""")
def top_pairs(spark, d):
    """The ten image pairs with most inliers, by name."""
    p = T.verified_pairs(spark, d).select("*", F.shiftright("pair_id", 32).alias("u"), F.col("pair_id").bitwiseAND(4294967295).alias("v"))
    i = spark.range(64).select(F.col("id").alias("image_id"), F.format_string("img%03d.jpg", "id").alias("name"))
    a, b = i.select(F.col("image_id").alias("u"), F.col("name").alias("first")), i.select(F.col("image_id").alias("v"), F.col("name").alias("second"))
    return p.join(a, "u").join(b, "v").groupBy("first", "second", "pair_id").agg(F.sum("rows").alias("inliers")).orderBy(F.desc("inliers"), "pair_id").limit(10)


@query(f"WITH {T.V_TVG} SELECT count(*) AS pairs, coalesce(sum(rows), 0)::BIGINT AS inliers, count(*) FILTER (WHERE rows >= 15) AS verified FROM v_tvg")
def pair_statistics(spark, d):
    """Counts over all pairs."""
    return T.verified_pairs(spark, d).agg(F.count("*").alias("pairs"), F.coalesce(F.sum("rows"), F.lit(0)).alias("inliers"), F.count(F.when(F.col("rows") >= 15, 1)).alias("verified"))


@query(f"""WITH {T.V_CELLS}, a AS (SELECT DISTINCT i, j FROM v_cells WHERE epoch = 1), b AS (SELECT i, j, avg(tax) AS p FROM v_cells WHERE epoch = 2 GROUP BY ALL)
SELECT a.i * 1000 + a.j AS key, round(coalesce(p, 0.5), 6) AS p FROM a LEFT JOIN b USING (i, j)""")
def align_probabilities(spark, d):
    """Each cell of one epoch with another epoch's probability, one half where there is none."""
    c = T.cells(spark, d).withColumn("key", F.col("i") * 1000 + F.col("j"))
    left = c.where("epoch = 1").select("key").distinct()
    right = c.where("epoch = 2").groupBy("key").agg(F.avg("tax").alias("p"))
    return joins.with_default(left, right, "key", {"p": 0.5}).select("key", r6(F.col("p")).alias("p"))


@query(f"""WITH {T.V_CELLS}, s AS (SELECT i * 100000 + j * 100 + k AS key, CAST(count(*) AS INTEGER) AS hits FROM v_cells WHERE epoch <= 2 GROUP BY 1), u AS (SELECT DISTINCT i * 100000 + j * 100 + k AS key FROM v_cells WHERE epoch = 3)
SELECT coalesce(s.key, u.key) AS key, coalesce(hits, 0) AS hits FROM s FULL JOIN u ON s.key = u.key""")
def keyed_upsert(spark, d):
    """State by key joined with the keys of a new call."""
    c = T.cells(spark, d).withColumn("key", F.col("i") * 100000 + F.col("j") * 100 + F.col("k"))
    state = c.where("epoch <= 2").groupBy("key").agg(F.count("*").cast("int").alias("hits"))
    return joins.upsert(state, c.where("epoch = 3"), "key", {"hits": 0})


@query(f"""WITH {T.V_CELLS}, o AS (SELECT DISTINCT i, j, k FROM v_cells WHERE epoch = 1) SELECT DISTINCT i, j, k FROM v_cells f WHERE epoch = 2 AND NOT EXISTS (SELECT 1 FROM o WHERE o.i = f.i AND o.j = f.j AND o.k = f.k)""")
def anti_free_cells(spark, d):
    """Free voxels that are not occupied."""
    c = T.cells(spark, d)
    return c.where("epoch = 2").select("i", "j", "k").distinct().join(c.where("epoch = 1"), ["i", "j", "k"], "left_anti")


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(max(value) OVER w, 6) AS most, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def trailing_window(spark, d):
    """Mean, maximum and count over the last twenty events of a type."""
    w = windows.trailing(["ts", "event_id"], ["event_type"])
    return T.read(spark, d, "events").select("event_id", r6(F.avg("value").over(w)).alias("mean"), r6(F.max("value").over(w)).alias("most"), F.count("*").over(w).alias("n"))


@query("""SELECT event_id, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS place,
  round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS before FROM events""")
def running_offsets(spark, d):
    """Place among flagged events, and the sum of what came before, for each user."""
    e = T.read(spark, d, "events")
    return e.select("event_id", windows.running_index(F.col("value") > 50, ["user_id"], ["ts", "event_id"]).alias("place"), r6(windows.offsets(F.col("value"), ["ts", "event_id"], ["user_id"])).alias("before"))


@query(f"""WITH {T.V_EDGES}, b AS (SELECT src, dst, score FROM v_edges UNION ALL SELECT dst, src, score FROM v_edges) SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS INTEGER) AS rank FROM b QUALIFY rank <= 4""")
def top_neighbours(spark, d):
    """Four best neighbours of each frame."""
    return windows.top_k(graph.both_ways(T.edges(spark, d)), ["src"], [F.desc("score"), F.col("dst")], 4).select("src", "dst", "rank")


@query(f"""WITH {T.V_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r, count(*) OVER (PARTITION BY frame_id) AS n FROM v_points)
SELECT frame_id, count(*) AS kept, max(y) AS far FROM r WHERE r <= greatest(floor(0.7 * n), 3) GROUP BY frame_id""")
def trimmed_fraction(spark, d):
    """Nearest seven tenths of each frame's points."""
    p = ordered.first_rows(T.points(spark, d), ["frame_id"], ["y", *T.POINT_ID], 0.7)
    return p.groupBy("frame_id").agg(F.count("*").alias("kept"), F.max("y").alias("far"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE n <= 5 OR list_contains(list_transform(range(5), lambda i: CAST(round_even(i * (n - 1) / 4.0::DOUBLE, 0) AS BIGINT)), r)""")
def evenly_spaced(spark, d):
    """Five events of each user, evenly spread over time."""
    return windows.evenly_spaced(T.read(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 5).select("user_id", "event_id")


@query("""SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 2654435761 + 17) % 4294967296, event_id) <= 50""")
def seeded_sample(spark, d):
    """Fifty events of each type, the same ones each time."""
    return windows.seeded_sample(T.read(spark, d, "events"), ["event_type"], "event_id", 50, 17).select("event_type", "event_id")


@query("""SELECT o_orderpriority, o_orderkey, (row_number() OVER w - 1) // 64 AS batch FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey) QUALIFY (row_number() OVER w - 1) // 64 < count(*) OVER (PARTITION BY o_orderpriority) // 64""")
def batch_sampler(spark, d):
    """Full batches of 64 orders of one priority."""
    return windows.batches(T.read(spark, d, "orders"), ["o_orderpriority"], [F.col("o_orderkey")], 64).select("o_orderpriority", "o_orderkey", "batch")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY lpad(regexp_extract(p_name, '([0-9]+)', 1), 12, '0'), p_partkey) AS place FROM (SELECT p_partkey, 'Frame' || p_partkey % 1000 AS p_name FROM part)""")
def natural_sort(spark, d):
    """Names in natural order: frame2 before frame10."""
    names = T.read(spark, d, "part").select("p_partkey", F.concat(F.lit("Frame"), F.col("p_partkey") % 1000).alias("name"))
    placed = ordered.numbered(names, [G.natural_key(F.col("name")), F.col("p_partkey")])
    return placed.select("p_partkey", (F.col("place") + 1).cast("long").alias("place"))


@query(f"""WITH {T.V_EDGES}, b AS (SELECT src, dst, score FROM v_edges UNION ALL SELECT dst, src, score FROM v_edges) SELECT src, arg_min(dst, (-score, dst)) AS best, round(max(score), 9) AS score FROM b GROUP BY src""")
def best_edge(spark, d):
    """Best partner of each frame, ties to the smaller one."""
    e = graph.both_ways(T.edges(spark, d))
    return e.groupBy("src").agg(F.min_by("dst", F.struct((-F.col("score")).alias("c"), "dst")).alias("best"), F.round(F.max("score"), 9).alias("score"))


@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY ALL), x AS (SELECT e.*, m.m, abs(value - m.m) AS dv FROM events e JOIN m USING (event_type)), a AS (SELECT event_type, median(dv) AS mad FROM x GROUP BY ALL)
SELECT event_id, round((value - m) / (1.4826::DOUBLE * (mad + 1e-8)), 6) AS z FROM x JOIN a USING (event_type)""")
def robust_scores(spark, d):
    """Distance from the median in robust deviations."""
    return metrics.robust_scores(T.read(spark, d, "events"), "value", ["event_type"]).select("event_id", r6(F.col("z")).alias("z"))


@query("""WITH m AS (SELECT l_suppkey, median(CASE WHEN l_discount > 0 THEN l_tax / l_discount END) AS m, count(CASE WHEN l_discount > 0 THEN 1 END) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, n, round(CASE WHEN n >= 100 AND m BETWEEN 0.25 AND 4.0 THEN m ELSE 1.0 END, 6) AS scale FROM m""")
def median_scale(spark, d):
    """Median ratio of each group where enough rows allow one."""
    li = T.read(spark, d, "lineitem")
    return metrics.median_scale(li, ["l_suppkey"], F.col("l_tax") / F.col("l_discount"), F.col("l_discount") > 0).select("l_suppkey", "n", r6(F.col("scale")).alias("scale"))


THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]


@query(f"""WITH t AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]::DOUBLE[]) AS threshold), s AS (SELECT threshold, l_discount * 10 >= threshold AS hit, l_returnflag = 'R' AS y FROM lineitem, t),
c AS (SELECT threshold, count(*) FILTER (hit AND y) AS tp, count(*) FILTER (hit AND NOT y) AS fp, count(*) FILTER (NOT hit AND y) AS fn, count(*) FILTER (NOT hit AND NOT y) AS tn FROM s GROUP BY threshold)
SELECT threshold, tp, fp, fn, tn, round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (tp + fn + 1e-9), 6) AS recall, round(tp / (tp + fp + fn + 1e-9), 6) AS iou,
  round(2 * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9)) / (tp / (tp + fp + 1e-9) + tp / (tp + fn + 1e-9) + 1e-9), 6) AS f1 FROM c""")
def confusion_sweep(spark, d):
    """Confusion counts and scores at nineteen thresholds."""
    li = T.read(spark, d, "lineitem")
    s = metrics.confusion_sweep(li, F.col("l_discount") * 10, F.col("l_returnflag") == "R", THRESHOLDS)
    return s.select("threshold", "tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "iou", "f1")])


@query(f"""WITH {T.V_POSES} SELECT grp, round(median(transl_err), 6) AS median_transl, round(median(ang_err), 6) AS median_ang, round(avg((transl_err < 0.25 AND ang_err < 2.0)::INT), 6) AS acc_0, round(avg((transl_err < 0.5 AND ang_err < 5.0)::INT), 6) AS acc_1 FROM v_poses GROUP BY grp""")
def pose_accuracy(spark, d):
    """Median pose errors and shares within limits."""
    s = metrics.pose_accuracy(T.pose_errors(spark, d), ["grp"], [(0.25, 2.0), (0.5, 5.0)])
    return s.select("grp", *[r6(F.col(c)).alias(c) for c in ("median_transl", "median_ang", "acc_0", "acc_1")])


@query("SELECT round(quantile_cont(value, 0.05), 6) AS q5, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95, round(avg(value), 6) AS mean, round(avg((value <= 50)::INT), 6) AS within FROM events")
def distance_quantiles(spark, d):
    """Quantiles, mean and share within a limit."""
    q = metrics.quantiles(T.read(spark, d, "events"), "value", [0.05, 0.5, 0.95], 50)
    return q.select(*[r6(F.col(c)).alias(c) for c in q.columns])


CLOUD = "SELECT o_orderkey AS {n}, o_totalprice / 50000.0::DOUBLE AS {n}x, o_custkey % 100 / 10.0::DOUBLE AS {n}y FROM orders WHERE o_orderkey % 2 = {r}"


def _cloud(spark, d, name, rest):
    """One of two clouds that all orders make: those with odd and those with even keys."""
    o = T.read(spark, d, "orders").where(F.col("o_orderkey") % 2 == rest)
    return o.select(F.col("o_orderkey").alias(name), (F.col("o_totalprice") / 50000.0).alias(f"{name}x"), (F.col("o_custkey") % 100 / 10.0).alias(f"{name}y"))


NN = f"""p AS ({CLOUD.format(n='p', r=1)}), q AS ({CLOUD.format(n='q', r=0)}), d AS (SELECT p, q, (px - qx) * (px - qx) + (py - qy) * (py - qy) AS d2 FROM p, q),
pq AS (SELECT p, arg_min(q, (d2, q)) AS q, min(d2) AS d2 FROM d GROUP BY p), qp AS (SELECT q, arg_min(p, (d2, p)) AS p, min(d2) AS d2 FROM d GROUP BY q)"""


def _forth(spark, d):
    return joins.nearest(_cloud(spark, d, "p", 1), _cloud(spark, d, "q", 0), "p", "q", ["px", "py"], ["qx", "qy"], 0.05)


def _nn(spark, d):
    back = joins.nearest(_cloud(spark, d, "q", 0), _cloud(spark, d, "p", 1), "q", "p", ["qx", "qy"], ["px", "py"], 0.05)
    return _forth(spark, d), back


@query(f"WITH {NN} SELECT p, q, round(d2, 9) AS d2 FROM pq")
def nearest_join(spark, d):
    """Nearest point of another cloud."""
    return _forth(spark, d).select("p", "q", F.round("d2", 9).alias("d2"))


@query(f"WITH {NN} SELECT pq.p, pq.q, round(pq.d2, 9) AS d2 FROM pq JOIN qp ON pq.p = qp.p AND pq.q = qp.q")
def mutual_nearest(spark, d):
    """Pairs that are each other's nearest."""
    return joins.reciprocal(*_nn(spark, d), "p", "q").select("p", "q", F.round("d2", 9).alias("d2"))


@query(f"WITH {NN} SELECT q, max(p) AS p FROM pq GROUP BY q")
def pseudo_mutual(spark, d):
    """For each target the last point that maps to it."""
    return joins.last_of_each(_forth(spark, d), "p", "q")


@query(f"WITH {NN} SELECT p, q, round(d2, 9) AS d2 FROM d WHERE d2 <= 0.0025::DOUBLE")
def radius_join(spark, d):
    """Pairs of points within a radius."""
    near = joins.near_places(_cloud(spark, d, "p", 1), _cloud(spark, d, "q", 0), ["px", "py"], ["qx", "qy"], 0.05)
    return joins.place_rows(near.withColumn("d2", F.round("d2", 9))).select("p", "q", "d2")


@query(f"""WITH {NN}, a AS (SELECT avg(d2) AS d2, avg((sqrt(d2) <= 0.05)::INT) AS p FROM pq), b AS (SELECT avg(d2) AS d2, avg((sqrt(d2) <= 0.05)::INT) AS r FROM qp)
SELECT round(a.d2 + b.d2, 6) AS chamfer, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-9), 6) AS fscore FROM a, b""")
def chamfer_fscore(spark, d):
    """Chamfer distance and F-score of two clouds."""
    s = metrics.cloud_scores(*_nn(spark, d), 0.05)
    return s.select(*[r6(F.col(c)).alias(c) for c in s.columns])


@query("""WITH v AS (SELECT event_id AS id, value / 100.0::DOUBLE AS x, user_id / 100.0::DOUBLE AS y, CAST(props->>'$.k' AS DOUBLE) / 10 AS z FROM events),
p AS (SELECT * FROM v WHERE id % 5 < 2 AND z BETWEEN 0.1 AND 0.8), q AS (SELECT * FROM v WHERE id % 5 = 2 AND z BETWEEN 0.1 AND 0.8),
d AS (SELECT p.id AS p, q.id AS q, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2, abs(p.z - q.z) AS dz, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d3 FROM p, q),
f AS (SELECT p, arg_min(struct_pack(q := q, d2 := d2, dz := dz, d3 := d3), (d2, q)) AS b FROM d GROUP BY p), g AS (SELECT q, arg_min(struct_pack(p := p, d2 := d2, dz := dz, d3 := d3), (d2, p)) AS b FROM d GROUP BY q),
a AS (SELECT count(*) AS n, sum((sqrt(b.d2) <= 0.1 AND b.dz <= 0.2 AND last)::INT)::BIGINT AS c, avg(b.d3) AS far FROM (SELECT p, b, p = max(p) OVER (PARTITION BY b.q) AS last FROM f)),
e AS (SELECT count(*) AS n, sum((sqrt(b.d2) <= 0.1 AND b.dz <= 0.2 AND last)::INT)::BIGINT AS c, avg(b.d3) AS far FROM (SELECT q, b, q = max(q) OVER (PARTITION BY b.p) AS last FROM g))
SELECT round(a.far + e.far, 6) AS chamfer, round(a.c / a.n, 6) AS precision, round(e.c / e.n, 6) AS recall, round(2 * (a.c / a.n) * (e.c / e.n) / (a.c / a.n + e.c / e.n + 1e-9), 6) AS fscore,
a.c AS tp, a.n - a.c AS fp, e.n - e.c AS fn, a.n AS n_truth, e.n AS n_found FROM a, e""")
def cloud_comparison(spark, d):
    """Scores of two clouds within a height band: neighbours on the floor, gated by height, the last of equal neighbours only."""
    v = T.read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") / 100.0).alias("x"), (F.col("user_id") / 100.0).alias("y"), (F.get_json_object("props", "$.k").cast("double") / 10).alias("z"))
    s = metrics.compare_clouds(v.where("id % 5 < 2"), v.where("id % 5 = 2"), 0.1, 0.05, 0.2, True, True, (0.1, 0.8))
    return s.select(*[r6(F.col(c)).alias(c) if c in ("chamfer", "precision", "recall", "fscore") else c for c in s.columns])


@query("""WITH l AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'click'), r AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, min(value) AS value FROM events WHERE event_type <> 'click' GROUP BY ALL),
x AS (SELECT l.event_id, l.user_id, l.t, r.t AS f, r.value, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t), r.t) AS n FROM l JOIN r USING (user_id))
SELECT l.user_id, l.event_id, l.t, x.f AS t_found, x.value FROM l LEFT JOIN x ON x.event_id = l.event_id AND x.n = 1""")
def nearest_in_time(spark, d):
    """The event of another kind nearest in time to each click of a user."""
    e = T.read(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_timestamp("ts").alias("t"))
    right = e.where("event_type <> 'click'").groupBy("user_id", "t").agg(F.min("value").alias("value"))
    return joins.nearest_in_order(e.where("event_type = 'click'"), right, "event_id", "t", "value", ["user_id"])


B = f"WITH {T.V_EDGES}, b AS (SELECT src, dst, score FROM v_edges UNION ALL SELECT dst, src, score FROM v_edges), k AS (SELECT src, dst FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 2), n AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k)"


def _neighbours(spark, d):
    return graph.adjacency(T.edges(spark, d), 2.0, k=2)


@query(f"{B} SELECT src, dst FROM n")
def adjacency_knn(spark, d):
    """Neighbours by the two best edges of each frame, both ways."""
    return _neighbours(spark, d)


@query(f"""{B}, g AS (SELECT src, count(*) AS d FROM n GROUP BY src), c AS (SELECT x.src, y.src AS dst, count(*) AS shared FROM n x JOIN n y ON x.dst = y.dst AND x.src <> y.src GROUP BY ALL),
j AS (SELECT n.src, n.dst, coalesce(c.shared, 0) AS shared, a.d + b.d - 2 - coalesce(c.shared, 0) AS u FROM n LEFT JOIN c ON c.src = n.src AND c.dst = n.dst JOIN g a ON a.src = n.src JOIN g b ON b.src = n.dst)
SELECT src, dst, round(CASE WHEN u = 0 THEN 1.0 ELSE shared / u END, 6) AS jaccard FROM j WHERE u = 0 OR shared / u >= 0.1""")
def jaccard_prune(spark, d):
    """Edges whose ends share neighbours."""
    return graph.jaccard_prune(_neighbours(spark, d), 0.1).select("src", "dst", r6(F.col("jaccard")).alias("jaccard"))


@query(f"""WITH RECURSIVE {B[5:]}, c AS (SELECT src AS node, src AS reach FROM n UNION SELECT c.node, n.dst FROM c JOIN n ON n.src = c.reach) SELECT node, min(reach) AS component FROM c GROUP BY node""")
def connected_components(spark, d):
    """Smallest frame that each frame reaches."""
    n = _neighbours(spark, d)
    n = materialize(n)
    return graph.components(n.select(F.col("src").alias("node")).distinct(), n)


@query(f"""WITH RECURSIVE {T.V_EDGES}, o AS (SELECT src, dst, score, row_number() OVER (ORDER BY score DESC, src, dst) AS n FROM v_edges), b AS (SELECT src, dst, n FROM o UNION ALL SELECT dst, src, n FROM o),
r AS (SELECT n AS e, src AS node FROM o UNION SELECT r.e, b.dst FROM r JOIN b ON b.src = r.node AND b.n < r.e) SELECT src, dst, round(score, 9) AS score FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.e = o.n AND r.node = o.dst)""")
def spanning_tree(spark, d):
    """Maximum spanning tree of the scored pairs: those whose ends no better pairs connect."""
    return graph.spanning_tree(T.edges(spark, d)).select("src", "dst", F.round("score", 9).alias("score"))


@query(f"""WITH RECURSIVE {T.V_EDGES}, o AS (SELECT src, dst, score, row_number() OVER (ORDER BY score DESC, src, dst) AS n FROM v_edges), b AS (SELECT src, dst, n FROM o UNION ALL SELECT dst, src, n FROM o),
r AS (SELECT n AS e, src AS node FROM o UNION SELECT r.e, b.dst FROM r JOIN b ON b.src = r.node AND b.n < r.e), t AS (SELECT src, dst, score, NOT EXISTS (SELECT 1 FROM r WHERE r.e = o.n AND r.node = o.dst) AS tree FROM o),
i AS (SELECT src AS node, dst AS other, score, tree FROM t UNION ALL SELECT dst, src, score, tree FROM t)
SELECT node, other, tree, row_number() OVER (PARTITION BY node, tree ORDER BY score DESC, other) - 1 AS place FROM i""")
def incident_pairs(spark, d):
    """Each frame's pairs within the spanning tree and outside it, best first."""
    return graph.incident(T.edges(spark, d)).select("node", "other", "tree", "place")


def _core_sql() -> str:
    """Twenty-four frames: as many rounds settle."""
    parts = [f"WITH {T.V_EDGES}, m AS (SELECT avg(score) AS m FROM v_edges)", "c0 AS (SELECT src, dst FROM v_edges, m WHERE score >= m UNION ALL SELECT dst, src FROM v_edges, m WHERE score >= m)"]
    for i in range(24):
        parts.append(f"g{i} AS MATERIALIZED (SELECT src FROM c{i} GROUP BY src HAVING count(*) >= 8), c{i + 1} AS MATERIALIZED (SELECT src, dst FROM c{i} WHERE src IN (SELECT src FROM g{i}) AND dst IN (SELECT src FROM g{i}))")
    return ", ".join(parts)


@query(f"{_core_sql()} SELECT src, dst FROM c24")
def k_core(spark, d):
    """Frames and links left of the better half of pairs when frames with fewer than eight neighbours go."""
    e = T.edges(spark, d)
    mean = e.agg(F.avg("score").alias("m")).first().m or 0.0
    return graph.k_core(graph.adjacency(e, mean), 8)


def _costs_sql() -> str:
    """Twenty-four frames: a cheapest path has no more steps."""
    parts = [f"WITH {T.V_EDGES}, w AS (SELECT src, dst, -ln(score) AS w FROM v_edges UNION ALL SELECT dst, src, -ln(score) FROM v_edges), d0 AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS cost)"]
    for i in range(24):
        parts.append(f"d{i + 1} AS MATERIALIZED (SELECT node, min(cost) AS cost FROM (SELECT * FROM d{i} UNION ALL SELECT w.dst::BIGINT, cost + w FROM d{i} JOIN w ON w.src = d{i}.node) GROUP BY node)")
    return ", ".join(parts)


@query(f"{_costs_sql()} SELECT node, round(cost, 6) AS cost FROM d24")
def shortest_costs(spark, d):
    """Cost of the cheapest path from the first frame, a pair costing the logarithm of its score."""
    e = T.edges(spark, d).select("src", "dst", (-F.log("score")).alias("cost"))
    return graph.shortest_costs(e, 0).select("node", r6(F.col("cost")).alias("cost"))


@query(f"""{B}, c AS (SELECT DISTINCT src AS node FROM n WHERE src % 6 = 0), s AS (SELECT b.src, max(score) AS s FROM b JOIN c ON c.node = b.dst GROUP BY b.src), a AS (SELECT DISTINCT src AS node FROM n)
SELECT round(avg(CASE WHEN c.node IS NOT NULL THEN 1.0 ELSE coalesce(s.s, 0.0) END), 6) AS coverage FROM a LEFT JOIN c USING (node) LEFT JOIN s ON s.src = a.node""")
def coverage(spark, d):
    """How well every sixth frame covers all."""
    e = T.edges(spark, d)
    nodes = _neighbours(spark, d).select(F.col("src").alias("node")).distinct()
    return graph.coverage(e, nodes.where(F.col("node") % 6 == 0), nodes).select(r6(F.col("coverage")).alias("coverage"))


@query("""WITH e AS (SELECT label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, dim, round(avg(x), 6) AS mean, round(max(x), 6) AS most FROM e GROUP BY ALL""")
def latent_pool(spark, d):
    """Mean and maximum of each label's vectors by dimension."""
    e = T.read(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    return e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(r6(F.avg("x")).alias("mean"), r6(F.max("x")).alias("most"))


@query("""WITH p AS (SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1)
SELECT vec_id, round(c, 6) AS cosine, c < 0.1 AS changed FROM p""")
def change_gate(spark, d):
    """Whether a vector turned away from the one before."""
    e = T.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    p = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    c = dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))
    return p.select("vec_id", r6(c).alias("cosine"), (c < 0.1).alias("changed"))


@query("SELECT sum(n * n)::BIGINT AS grouped, (sum(n) * sum(n))::BIGINT AS whole, sum(n * n) <= 0.7 * sum(n) * sum(n) AS split FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)")
def grouping_cost(spark, d):
    """Whether attention within groups costs less than over all frames."""
    n = T.read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    grouped, whole = F.sum(F.col("n") * F.col("n")), F.sum("n") * F.sum("n")
    return n.agg(grouped.alias("grouped"), whole.alias("whole"), (grouped <= 0.7 * whole).alias("split"))


@query(f"""WITH {T.V_CELLS}, f AS (SELECT DISTINCT frame_id, i, j FROM v_cells WHERE epoch = 1), n AS (SELECT frame_id, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT a.frame_id AS src, b.frame_id AS dst, count(*) AS shared FROM f a JOIN f b USING (i, j) GROUP BY ALL)
SELECT src, dst, round(shared / least(a.n, b.n), 6) AS overlap FROM s JOIN n a ON a.frame_id = src JOIN n b ON b.frame_id = dst""")
def covisibility(spark, d):
    """Share of the smaller frame's cells that another frame sees too."""
    f = T.cells(spark, d).where("epoch = 1").select("frame_id", "i", "j").distinct()
    n = f.groupBy("frame_id").agg(F.count("*").alias("n"))
    s = f.withColumnRenamed("frame_id", "src").join(f.withColumnRenamed("frame_id", "dst"), ["i", "j"]).groupBy("src", "dst").agg(F.count("*").alias("both"))
    s = s.join(n.select(F.col("frame_id").alias("src"), F.col("n").alias("na")), "src").join(n.select(F.col("frame_id").alias("dst"), F.col("n").alias("nb")), "dst")
    return s.select("src", "dst", r6(F.col("both") / F.least("na", "nb")).alias("overlap"))
