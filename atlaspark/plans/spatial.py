"""Point, voxel, raster and state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import filters, raster, windows
from ..sources import tables as T
from .voxels import MapSettings, demote, endpoints, fold, promote, ray_cells

QUERIES, ORACLES = {}, {}
KEY = "xor(xor((({i}) + 1048576) << 42, (({j}) + 1048576) << 21), ({k}) + 1048576)"


def query(sql: str | None):
    """Register a query under its function's name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


@query(f"""WITH {T.V_POINTS}, v AS (SELECT CAST(floor(x / 0.25::DOUBLE) AS BIGINT) AS i, CAST(floor(y / 0.25::DOUBLE) AS BIGINT) AS j, CAST(floor(z / 0.25::DOUBLE) AS BIGINT) AS k, conf
  FROM v_points WHERE conf >= 2.0 AND z BETWEEN 0.0 AND 0.16 AND sqrt((x - frame_id * 0.5::DOUBLE) * (x - frame_id * 0.5::DOUBLE) + (y - 2.5::DOUBLE) * (y - 2.5::DOUBLE) + (z - 1.0::DOUBLE) * (z - 1.0::DOUBLE)) <= 3.0)
SELECT {KEY.format(i='i', j='j', k='k')} AS key, count(*) AS hits, max(conf) AS most FROM v GROUP BY 1""")
def voxel_occupancy(spark, d):
    """Occupied voxels of confident points within range and height of their camera."""
    p = T.points(spark, d).where("conf >= 2.0 AND z BETWEEN 0.0 AND 0.16")
    p = p.withColumn("cx", F.col("frame_id") * 0.5).withColumn("cy", F.lit(2.5)).withColumn("cz", F.lit(1.0))
    p = filters.within_range(p.where(G.is_finite("x", "y", "z")), ["x", "y", "z"], ["cx", "cy", "cz"], 3.0)
    key = G.pack_key(*[G.voxel_index(F.col(c), 0.0, 0.25) for c in "xyz"])
    return p.groupBy(key.alias("key")).agg(F.count("*").alias("hits"), F.max("conf").alias("most"))


@query(f"""WITH {T.V_CELLS} SELECT DISTINCT i, j, k, {KEY.format(i='i', j='j', k='k')} AS key, (i + 0.5::DOUBLE) * 0.1::DOUBLE AS x FROM v_cells""")
def key_round_trip(spark, d):
    """Lattice indices, their packed key unpacked again, and the voxel's centre."""
    c = T.cells(spark, d).select(G.pack_key(F.col("i"), F.col("j"), F.col("k")).alias("key")).distinct()
    i, j, k = G.unpack_key(F.col("key"))
    return c.select(i.alias("i"), j.alias("j"), k.alias("k"), "key", G.voxel_centre(i, 0.0, 0.1).alias("x"))


@query(f"""WITH {T.V_POINTS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, conf FROM v_points
WHERE conf >= (SELECT quantile_cont(conf, 0.75) FROM v_points) AND conf > 1e-5""")
def conf_percentile_filter(spark, d):
    """Points whose confidence reaches the upper quartile."""
    return filters.percentile_filter(T.points(spark, d), 0.75).select(*T.POINT_ID, "conf")


@query(f"WITH {T.V_CELLS} SELECT i, j, k, count(*) AS n FROM v_cells WHERE i BETWEEN 5 AND 14 AND j BETWEEN 3 AND 12 AND k BETWEEN 2 AND 8 GROUP BY ALL")
def aabb_block(spark, d):
    """Voxels in a block whose sides are capped to ten."""
    return filters.in_block(T.cells(spark, d), [5, 3, 2], [20, 40, 8], most=10).groupBy("i", "j", "k").agg(F.count("*").alias("n"))


@query(f"""WITH {T.V_POINTS}, m AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz FROM v_points), e AS (SELECT p.*, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS dist FROM v_points p, m)
SELECT count(*) AS n, round(max(dist), 6) AS far FROM e WHERE dist < (SELECT quantile_cont(dist, 0.99) FROM e)""")
def denoised(spark, d):
    """How many points are left, and how far out, without the farthest hundredth."""
    p = filters.denoise(T.points(spark, d), distance_name="far")
    return p.agg(F.count("*").alias("n"), r6(F.max("far")).alias("far"))


BEV_CELLS = f"""{T.V_CELLS}, occ AS (SELECT i, j, k, count(*) AS n FROM v_cells WHERE epoch = 1 GROUP BY ALL),
b AS (SELECT j AS v, i AS u, max(CASE WHEN n >= 3 THEN 100 ELSE 0 END) AS value FROM occ GROUP BY ALL),
g AS (SELECT v.range AS v, u.range AS u FROM range(42) v, range(52) u), bev AS (SELECT g.v, g.u, coalesce(value, -1) AS value FROM g LEFT JOIN b USING (v, u))"""


def _bev(spark, d):
    n = T.cells(spark, d).where("epoch = 1").groupBy("i", "j", "k").agg(F.count("*").alias("n"))
    return raster.bev_ternary(n, F.col("i"), F.col("j"), F.col("n") >= 3, F.col("n") < 3, 52, 42)


@query(f"WITH {BEV_CELLS} SELECT v, u, value FROM bev")
def bev_ternary(spark, d):
    """Floor plan: occupied columns of voxels hit three times, free ones hit less, unknown others."""
    return _bev(spark, d)


@query(f"""WITH {BEV_CELLS}, s AS (SELECT a.range - 1 AS dv, b.range - 1 AS du FROM range(3) a, range(3) b WHERE (a.range - 1) * (a.range - 1) + (b.range - 1) * (b.range - 1) <= 1),
n AS (SELECT DISTINCT v + dv AS v, u + du AS u FROM bev, s WHERE value = 100)
SELECT bev.v, bev.u, CASE WHEN value = -1 AND n.v IS NOT NULL THEN 0 ELSE value END AS value FROM bev LEFT JOIN n ON n.v = bev.v AND n.u = bev.u""")
def bev_inflate(spark, d):
    """Unknown cells beside an occupied one become free."""
    return raster.inflate(_bev(spark, d), 1)


@query(f"""WITH {T.V_CELLS}, b AS (SELECT j AS v, i AS u, greatest(max(tax), 0.0) AS most, avg(tax) AS mean FROM v_cells WHERE epoch = 2 GROUP BY ALL), g AS (SELECT v.range AS v, u.range AS u FROM range(42) v, range(52) u)
SELECT g.v, g.u, round(coalesce(most, 0.0), 6) AS most, round(coalesce(mean, 0.0), 6) AS mean FROM g LEFT JOIN b USING (v, u)""")
def bev_probability(spark, d):
    """Largest and mean probability of each cell of the floor plan."""
    b = raster.bev_probability(T.cells(spark, d).where("epoch = 2"), F.col("i"), F.col("j"), F.col("tax"), 52, 42)
    return b.select("v", "u", r6(F.col("most")).alias("most"), r6(F.col("mean")).alias("mean"))


@query(f"""WITH {BEV_CELLS}, t AS (SELECT r.range AS id, (r.range % 40) * 1.0::DOUBLE + 0.25::DOUBLE AS tv, (r.range // 40) * 2.0::DOUBLE + 0.5::DOUBLE AS tu FROM range(1000) r),
c AS (SELECT id, tv, tu, CAST(floor(tv) AS BIGINT) + a.range AS cv, CAST(floor(tu) AS BIGINT) + b.range AS cu FROM t, range(2) a, range(2) b)
SELECT id, round(sum((1 - abs(tv - cv)) * (1 - abs(tu - cu)) * coalesce(value, 0.0)), 6) AS value FROM c LEFT JOIN bev ON bev.v = cv AND bev.u = cu GROUP BY id""")
def bev_resample(spark, d):
    """The floor plan read at places between its cells."""
    t = spark.range(1000)
    out = raster.resample(_bev(spark, d).withColumn("value", F.col("value").cast("double")), "value", t, (F.col("id") % 40) * 1.0 + 0.25, F.floor(F.col("id") / 40) * 2.0 + 0.5)
    return out.select("id", r6(F.col("value")).alias("value"))


@query(f"""WITH {T.V_CELLS}, t AS (SELECT max(i) + 1 AS ni, max(j) + 1 AS nj, max(k) + 1 AS nk FROM v_cells), o AS (SELECT i, j, k, max(tax) AS p FROM v_cells GROUP BY ALL),
b AS (SELECT a.range AS i, b.range AS j, c.range AS k FROM t, range(t.ni) a, range(t.nj) b, range(t.nk) c),
w AS (SELECT b.i, b.j, b.k, least(greatest(b.i + s.range - 1, 0), ni - 1) AS ii, least(greatest(b.j + r.range - 1, 0), nj - 1) AS jj, least(greatest(b.k + u.range - 1, 0), nk - 1) AS kk FROM b, t, range(3) s, range(3) r, range(3) u)
SELECT w.i, w.j, w.k, round(sum(coalesce(o.p, 0)) / 27, 6) AS p FROM w LEFT JOIN o ON o.i = ii AND o.j = jj AND o.k = kk GROUP BY ALL""")
def box_blur(spark, d):
    """The whole block of cells, each with the mean of its neighbourhood's highest values."""
    cells = T.cells(spark, d)
    top = cells.agg(F.max("i"), F.max("j"), F.max("k")).first()
    size = [0 if t is None else t + 1 for t in top]
    axes = lambda n, c: spark.range(n).select(F.col("id").alias(c))
    dense = axes(size[0], "i").crossJoin(axes(size[1], "j")).crossJoin(axes(size[2], "k"))
    seen = cells.groupBy("i", "j", "k").agg(F.max("tax").alias("p"))
    return raster.box_blur(dense.join(seen, ["i", "j", "k"], "left").fillna(0.0, ["p"]), "p", size).select("i", "j", "k", r6(F.col("p")).alias("p"))


@query(f"""WITH {T.V_CELLS} SELECT j AS v, i AS u, round(sum(k * tax) / sum(tax), 6) AS value FROM v_cells WHERE tax > 0 GROUP BY ALL""")
def tile_blend(spark, d):
    """Overlapping values of a cell averaged by confidence."""
    t = T.cells(spark, d).where("tax > 0").select(F.col("j").alias("v"), F.col("i").alias("u"), F.col("k").alias("value"), F.col("tax").alias("conf"))
    return raster.blend_tiles(t).select("v", "u", r6(F.col("value")).alias("value"))


PARAMS = MapSettings()


def _calls(spark, d):
    """One occupied or free observation a row: kind from the line status, order by epoch and order key."""
    c = T.read(spark, d, "lineitem").select(
        F.floor(F.col("l_quantity") / 5.0).cast("long").alias("i"), F.floor(F.col("l_extendedprice") / 10000.0).cast("long").alias("j"), F.floor(F.round(F.col("l_discount") * 100) / 2.0).cast("long").alias("k"),
        F.col("l_linenumber").cast("int").alias("epoch"), (F.col("l_orderkey") % 32).cast("int").alias("seq"), F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("kind"),
    )
    return c.select(G.pack_key(F.col("i"), F.col("j"), F.col("k")).alias("key"), "epoch", "seq", "kind").distinct()


@query(f"""WITH c AS (SELECT DISTINCT {KEY.format(i='CAST(floor(l_quantity / 5.0::DOUBLE) AS BIGINT)', j='CAST(floor(l_extendedprice / 10000.0::DOUBLE) AS BIGINT)', k='CAST(floor(round(l_discount * 100) / 2.0::DOUBLE) AS BIGINT)')} AS key,
  CAST(l_linenumber AS INTEGER) AS epoch, CAST(l_orderkey % 32 AS INTEGER) AS seq, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS kind FROM lineitem),
h AS (SELECT key, list({{'epoch': epoch, 'seq': seq, 'kind': kind}} ORDER BY epoch, seq, kind) AS h FROM c GROUP BY key),
f AS (SELECT key, list_reduce(h, lambda s, e: {{'epoch': e.epoch, 'seq': e.seq, 'kind': e.kind,
    'st': CASE WHEN e.kind = 0 THEN least(greatest(s.st + 0.5::DOUBLE, -2.0), 3.5) ELSE least(greatest(s.st - 0.5::DOUBLE, -2.0), 3.5) END,
    'lt': CASE WHEN e.kind = 1 AND s.neg + 1 >= 4 AND (CASE WHEN s.last_occ < 0 THEN e.epoch = 0 ELSE e.epoch - s.last_occ > 2 END) THEN least(greatest(s.lt - 0.25::DOUBLE, -2.0), 3.5) ELSE s.lt END,
    'hits': CASE WHEN e.kind = 0 THEN s.hits + 1 ELSE s.hits END, 'pos': CASE WHEN e.kind = 0 THEN s.pos + 1 ELSE 0 END, 'neg': CASE WHEN e.kind = 0 THEN 0 ELSE s.neg + 1 END,
    'last_occ': CASE WHEN e.kind = 0 THEN e.epoch ELSE s.last_occ END, 'last_free': CASE WHEN e.kind = 0 THEN s.last_free ELSE e.epoch END}},
    {{'epoch': 0, 'seq': 0, 'kind': 0, 'st': 0.0::DOUBLE, 'lt': 0.0::DOUBLE, 'hits': 0, 'pos': 0, 'neg': 0, 'last_occ': -1, 'last_free': -1}}) AS s
  FROM (SELECT key, list_transform(h, lambda e: {{'epoch': e.epoch, 'seq': e.seq, 'kind': e.kind, 'st': 0.0::DOUBLE, 'lt': 0.0::DOUBLE, 'hits': 0, 'pos': 0, 'neg': 0, 'last_occ': -1, 'last_free': -1}}) AS h FROM h))
SELECT key, s.st AS st, s.lt AS lt, s.hits AS hits, s.pos AS pos, s.neg AS neg, CASE WHEN s.last_occ >= 0 THEN s.last_occ END AS last_occ, CASE WHEN s.last_free >= 0 THEN s.last_free END AS last_free FROM f""")
def log_odds_fold(spark, d):
    """State of each voxel after all its observations in order."""
    return fold(_calls(spark, d), PARAMS)


@query(f"""WITH {T.V_CELLS}, s AS (SELECT {KEY.format(i='i', j='j', k='k')} AS key, epoch, bit_or(1 << frame_id) AS bits FROM v_cells GROUP BY 1, 2)
SELECT key, count(DISTINCT epoch) AS epochs, bit_count(bit_or(bits) & 255) AS views, count(DISTINCT epoch) >= 5 AND bit_count(bit_or(bits) & 255) >= 3 AS promoted FROM s GROUP BY key""")
def epoch_promotion(spark, d):
    """Voxels seen occupied in five epochs and from three directions."""
    c = T.cells(spark, d).select(G.pack_key(F.col("i"), F.col("j"), F.col("k")).alias("key"), "epoch", F.pow(F.lit(2), F.col("frame_id")).cast("int").alias("b"))
    return promote(c.groupBy("key", "epoch").agg(F.bit_or("b").alias("bits")), MapSettings(promote_views=3))


@query("""WITH s AS (SELECT l_partkey AS key, CAST(count(*) AS INTEGER) AS neg, CAST(min(l_linenumber) AS INTEGER) AS last_occ, max(l_discount) - 0.05::DOUBLE AS lt FROM lineitem GROUP BY l_partkey),
x AS (SELECT *, neg >= 10 AND 7 - last_occ >= 3 AS due FROM s)
SELECT key, round(CASE WHEN (SELECT bool_or(due) FROM x) THEN least(greatest(CASE WHEN due THEN lt - 0.5 ELSE lt END, 0.0), 3.5) ELSE lt END, 6) AS lt, due AS demoted FROM x""")
def epoch_demotion(spark, d):
    """Long-term values after an epoch that demotes some voxels."""
    s = T.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").cast("int").alias("neg"), F.min("l_linenumber").cast("int").alias("last_occ"), (F.max("l_discount") - 0.05).alias("lt"))
    return demote(s, 7, PARAMS).select("key", r6(F.col("lt")).alias("lt"), "demoted")


RAYS = f"""{T.V_POINTS}, p AS (SELECT frame_id, x, y, z, frame_id * 0.5::DOUBLE AS cx, 2.5::DOUBLE AS cy, 1.0::DOUBLE AS cz FROM v_points WHERE epoch = 1),
l AS (SELECT *, sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y) + (cz - z) * (cz - z)) AS len FROM p),
n AS (SELECT *, greatest(1, CAST(ceil(len / 0.25::DOUBLE * 1.0) AS INTEGER)) AS n FROM l), m AS (SELECT *, unnest(range(n)) AS m FROM n), t AS (SELECT *, (m + 0.5::DOUBLE) / n AS t FROM m)"""
_RAY_INDEX = {c: f"CAST(floor((c{a} + t * ({a} - c{a}) - 0.0) / 0.25::DOUBLE) AS BIGINT)" for c, a in zip("ijk", "xyz", strict=True)}
_END_INDEX = {c: f"CAST(floor(({a} - 0.0) / 0.25::DOUBLE) AS BIGINT)" for c, a in zip("ijk", "xyz", strict=True)}


@query(f"""WITH {RAYS} SELECT DISTINCT frame_id, {KEY.format(**_RAY_INDEX)} AS key FROM t EXCEPT SELECT frame_id, {KEY.format(**_END_INDEX)} FROM p""")
def ray_carve(spark, d):
    """Voxels that a frame's rays pass without ending in them."""
    p = T.points(spark, d).where("epoch = 1").select("frame_id", "x", "y", "z", (F.col("frame_id") * 0.5).alias("cx"), F.lit(2.5).alias("cy"), F.lit(1.0).alias("cz"))
    return ray_cells(p, PARAMS, ["frame_id"])


@query(f"WITH {T.V_POINTS} SELECT DISTINCT frame_id, {KEY.format(**_END_INDEX)} AS key FROM v_points WHERE epoch = 2")
def ray_endpoints(spark, d):
    """Voxels that a frame's rays end in."""
    return endpoints(T.points(spark, d).where("epoch = 2"), PARAMS, ["frame_id"])


@query(f"""WITH {T.V_POINTS} SELECT frame_id, CAST(floor((atan2(y - 2.5, x - 2.5) + pi()) / (2 * pi()) * 8) AS BIGINT) % 8 AS sector, count(*) AS n FROM v_points GROUP BY ALL""")
def yaw_sectors(spark, d):
    """Points of a frame by the direction they lie in."""
    return T.points(spark, d).groupBy("frame_id", G.yaw_sector(F.col("x") - 2.5, F.col("y") - 2.5).cast("long").alias("sector")).agg(F.count("*").alias("n"))


@query(f"""WITH {T.V_POINTS}, s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, 1.7::DOUBLE * (0.0 * x + -1.0::DOUBLE * y + 0.0 * z) + 1.0 AS a, 1.7::DOUBLE * (1.0::DOUBLE * x + 0.0 * y + 0.0 * z) + 2.0 AS b, 1.7::DOUBLE * z + 3.0 AS c FROM v_points)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, round(a, 9) AS a, round(b, 9) AS b, round(c, 9) AS c FROM s""")
def sim3_apply(spark, d):
    """Points turned a quarter, scaled and moved."""
    a, b, c = G.linear([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [F.col(x) for x in "xyz"], [1.0, 2.0, 3.0], 1.7)
    return T.points(spark, d).select(*T.POINT_ID, F.round(a, 9).alias("a"), F.round(b, 9).alias("b"), F.round(c, 9).alias("c"))


@query(f"""WITH {T.V_POINTS}, q AS (SELECT *, sign(0.1 * x - 0.2::DOUBLE * y + 1) * greatest(abs(0.1 * x - 0.2::DOUBLE * y + 1), 0.001) AS den FROM v_points)
SELECT count(*) AS n, round(sum(CAST(round((x + 0.5) / den, 4) * 10000 AS DECIMAL(38, 0))) , 0)::BIGINT AS total FROM q""")
def projective_apply(spark, d):
    """Sum of a projective transform's first coordinate in ten-thousandths."""
    a = G.projective([[1.0, 0.0, 0.0]], [0.5], [0.1, -0.2, 0.0], [F.col(x) for x in "xyz"])[0]
    return T.points(spark, d).agg(F.count("*").alias("n"), F.sum((F.round(a, 4) * 10000).cast("decimal(38,0)")).cast("long").alias("total"))


@query(f"""WITH {T.V_POINTS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, round((l_quantity - 25.0) / 50.0 * z, 10) AS a, round((y * 10 - 20.0) / 50.0 * z, 10) AS b,
  round(CASE WHEN z > 0 THEN 50.0 * (((l_quantity - 25.0) / 50.0 * z) / z) + 25.0 ELSE 0.0 END, 6) AS u FROM v_points WHERE z > 0""")
def unproject_project(spark, d):
    """Depth pixels as camera points, and back."""
    p = T.points(spark, d).where("z > 0")
    f, cx, cy = F.lit(50.0), F.lit(25.0), F.lit(20.0)
    x = G.unproject(F.col("l_quantity"), F.col("y") * 10, F.col("z"), f, f, cx, cy)
    return p.select(*T.POINT_ID, F.round(x[0], 10).alias("a"), F.round(x[1], 10).alias("b"), r6(G.project(x, f, f, cx, cy)[0]).alias("u"))


@query("""SELECT vec_id, round(embedding[1]::DOUBLE, 5) AS a, round(embedding[2]::DOUBLE, 5) AS b, round(embedding[3]::DOUBLE, 5) AS c, round(1.0::DOUBLE, 5) AS det FROM embeddings""")
def quaternion_round_trip(spark, d):
    """Unit quaternions as matrices and back, scaled to the first components again; the matrix keeps volume."""
    e = T.read(spark, d, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyzw")])
    m = G.quaternion_to_matrix(*[F.col(c) for c in "xyzw"])
    det = m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in "xyzw"), F.lit(0.0))) * F.when(F.col("w") < 0, -1.0).otherwise(1.0)
    flat = e.select("vec_id", norm.alias("s"), F.round(det, 5).alias("det"), *[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)])
    q = G.matrix_to_quaternion([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    return flat.select("vec_id", *[F.round(q[i] * F.col("s"), 5).alias(c) for i, c in enumerate("abc")], "det")


@query(f"""WITH {T.V_POINTS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, round(ln(least(greatest(conf / 10.0, 1e-5), 1 - 1e-5) / (1 - least(greatest(conf / 10.0, 1e-5), 1 - 1e-5))), 6) AS logit,
  round(sign(x - 2) * ln(1 + abs(x - 2)), 6) AS slog, round(2 * atan(y / 2 / x), 6) AS fov FROM v_points""")
def scalar_transforms(spark, d):
    """Logit, signed logarithm and field of view."""
    p = T.points(spark, d)
    return p.select(*T.POINT_ID, r6(G.logit(F.col("conf") / 10.0)).alias("logit"), r6(G.signed_log1p(F.col("x") - 2)).alias("slog"), r6(G.field_of_view(F.col("y"), F.col("x"))).alias("fov"))


@query(f"""WITH {T.V_POINTS}, s AS (SELECT frame_id, epoch, conf, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, max(conf) OVER (PARTITION BY l_orderkey) AS m FROM v_points)
SELECT l_orderkey, epoch, l_partkey, l_suppkey, l_quantity, l_extendedprice, round(exp((conf - m) / 2.0) / (sum(exp((conf - m) / 2.0)) OVER (PARTITION BY l_orderkey) + 1e-8), 6) AS weight FROM s""")
def partitioned_softmax(spark, d):
    """Softmax of confidence within an order."""
    p = T.points(spark, d)
    return p.select("l_orderkey", "epoch", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", r6(windows.softmax(F.col("conf"), ["l_orderkey"], 2.0)).alias("weight"))
