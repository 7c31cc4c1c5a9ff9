"""Queries of the map over epochs: integrate, finalise, export, and what follows from an unchanged step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import steps
from ..sources import tables as T
from .spatial import KEY, r6
from .voxels import MapSettings, capped_rays, exported, observations, run_epochs

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Register a query under its function's name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


SETTINGS = MapSettings(size=0.5, promote_after=2, promote_views=2, demote_after=2, demote_gap=2, free_to_lt_after=2, carve_gap=1, decay=0.5)
EPOCHS = list(range(1, 8))
_AT = lambda form: {c: form.format(a=a) for c, a in zip("ijk", "xyz", strict=True)}
_END = KEY.format(**_AT("CAST(floor(({a} - 0.0) / 0.5::DOUBLE) AS BIGINT)"))
_RAY = KEY.format(**_AT("CAST(floor((c{a} + t * ({a} - c{a}) - 0.0) / 0.5::DOUBLE) AS BIGINT)"))
SEEN = f"""{T.V_POINTS}, pc AS (SELECT *, frame_id * 0.5::DOUBLE AS cx, 2.5::DOUBLE AS cy, 1.0::DOUBLE AS cz FROM v_points),
pl AS (SELECT *, sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y) + (cz - z) * (cz - z)) AS len FROM pc),
pr AS (SELECT * FROM pl WHERE z BETWEEN 0.02 AND 0.19 AND len <= 3.0),
occ AS (SELECT epoch, {_END} AS key, bit_or(1 << CAST(CAST(floor((atan2(y - cy, x - cx) + pi()) / (2 * pi()) * 8) AS BIGINT) % 8 AS INTEGER)) AS bits FROM pr GROUP BY 1, 2),
rm AS (SELECT *, unnest(range(greatest(1, CAST(ceil(len / 0.5::DOUBLE * 1.0) AS INTEGER)))) AS m, greatest(1, CAST(ceil(len / 0.5::DOUBLE * 1.0) AS INTEGER)) AS n FROM pr),
fr AS (SELECT DISTINCT epoch, {_RAY} AS key FROM (SELECT *, (m + 0.5::DOUBLE) / n AS t FROM rm)),
seen AS (SELECT epoch, key, 0 AS kind, bits FROM occ UNION ALL SELECT epoch, key, 1, 0 FROM fr ANTI JOIN occ USING (epoch, key))"""


def _seen(spark, d):
    cameras = spark.createDataFrame([(f, f * 0.5, 2.5, 1.0) for f in range(8)], "frame_id int, cx double, cy double, cz double")
    points = T.points(spark, d).select("epoch", "frame_id", "x", "y", "z")
    # Eight cameras.
    return observations(points, F.broadcast(cameras), SETTINGS, 3.0, (0.02, 0.19), ["epoch"])


@query(f"WITH {SEEN} SELECT epoch, key, kind, bits FROM seen")
def camera_calls(spark, d):
    """Voxels that each epoch's call of all cameras sees occupied or free."""
    return _seen(spark, d)


def _epochs_sql() -> str:
    """Each epoch's step as two common table expressions."""
    parts, before = [SEEN, "s0 AS (SELECT 0::BIGINT AS key, 0.0::DOUBLE AS st, 0.0::DOUBLE AS lt, 0 AS hits, 0 AS pos, 0 AS neg, 0 AS last_occ, 0 AS last_free, 0 AS epochs, 0 AS mask, false AS promoted WHERE false)"], "s0"
    for e in EPOCHS:
        parts.append(f"""i{e} AS (SELECT coalesce(s.key, o.key) AS key, coalesce(st, 0) AS st0, coalesce(lt, 0) AS lt0, coalesce(hits, 0) AS hits0, coalesce(pos, 0) AS pos0, coalesce(neg, 0) AS neg0,
  s.last_occ AS occ0, s.last_free AS free0, coalesce(epochs, 0) AS epochs0, coalesce(mask, 0) AS mask0, coalesce(promoted, false) AS promoted0, o.kind, o.bits FROM {before} s FULL JOIN (SELECT * FROM seen WHERE epoch = {e}) o ON s.key = o.key),
u{e} AS (SELECT key, CASE WHEN kind = 0 THEN least(greatest(st0 + 0.5, -2.0), 3.5) WHEN kind = 1 THEN least(greatest(st0 - 0.5, -2.0), 3.5) ELSE st0 END AS st,
  CASE WHEN kind = 1 AND neg0 + 1 >= 2 AND (CASE WHEN occ0 IS NULL THEN {e} = 0 ELSE {e} - occ0 > 1 END) THEN least(greatest(lt0 - 0.25, -2.0), 3.5) ELSE lt0 END AS lt,
  CASE WHEN kind = 0 THEN hits0 + 1 ELSE hits0 END AS hits, CASE WHEN kind = 0 THEN pos0 + 1 WHEN kind = 1 THEN 0 ELSE pos0 END AS pos, CASE WHEN kind = 0 THEN 0 WHEN kind = 1 THEN neg0 + 1 ELSE neg0 END AS neg,
  CASE WHEN kind = 0 THEN {e} ELSE occ0 END AS last_occ, CASE WHEN kind = 1 THEN {e} ELSE free0 END AS last_free, CASE WHEN kind = 0 THEN epochs0 + 1 ELSE epochs0 END AS epochs, CASE WHEN kind = 0 THEN mask0 | bits ELSE mask0 END AS mask, promoted0 AS promoted FROM i{e}),
p{e} AS (SELECT *, coalesce(last_occ = {e} AND epochs >= 2 AND bit_count(mask & 255) >= 2, false) AS rises FROM u{e}),
q{e} AS (SELECT *, CASE WHEN rises THEN least(greatest(greatest(lt, 0.8), -2.0), 3.5) ELSE lt END AS lt1, coalesce(neg >= 2 AND {e} - last_occ >= 2, false) AS due FROM p{e}),
d{e} AS (SELECT *, CASE WHEN (SELECT coalesce(bool_or(due), false) FROM q{e}) THEN least(greatest(CASE WHEN due THEN lt1 - 0.5 ELSE lt1 END, 0.0), 3.5) ELSE lt1 END AS lt2 FROM q{e}),
s{e} AS MATERIALIZED (SELECT key, least(greatest(st * 0.5, -2.0), 3.5)::DOUBLE AS st, lt2::DOUBLE AS lt, hits, pos, neg, last_occ, last_free, epochs, mask, (promoted OR rises) AND lt2 > 0 AS promoted FROM d{e})""")
        before = f"s{e}"
    return ", ".join(parts)


@query(f"WITH {_epochs_sql()} SELECT key, round(st, 6) AS st, round(lt, 6) AS lt, hits, pos, neg, last_occ, last_free, epochs, mask, promoted FROM s7")
def epoch_loop(spark, d):
    """The whole map after seven epochs: calls integrated, epochs finalised, short-term values decayed."""
    state = run_epochs(_seen(spark, d), EPOCHS, SETTINGS)
    return state.withColumns({c: r6(F.col(c)) for c in ("st", "lt")})


@query(f"""WITH {_epochs_sql()}, x AS (SELECT key, (key >> 42) - 1048576 AS i, ((key >> 21) & 2097151) - 1048576 AS j, (key & 2097151) - 1048576 AS k, greatest(st, lt) AS value, st FROM s7)
SELECT key, i, j, k, round(value, 6) AS value, CASE WHEN value >= 0.2 THEN 'occupied' ELSE 'free' END AS kind FROM x WHERE (value >= 0.2 OR st <= -0.2) AND k BETWEEN 0 AND 1""")
def map_export(spark, d):
    """Occupied and free voxels of the map within a height band, by the value that is shown."""
    return exported(run_epochs(_seen(spark, d), EPOCHS, SETTINGS), 0.2, -0.2, (0, 1)).withColumn("value", r6(F.col("value")))


@query(f"""WITH {T.V_POINTS}, r AS (SELECT epoch, frame_id, l_orderkey, (l_orderkey * 2654435761 + 5) % 4294967296 AS h FROM v_points)
SELECT epoch, count(*) AS rays, sum(l_orderkey)::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY h, l_orderkey) AS n FROM (SELECT DISTINCT epoch, frame_id, l_orderkey, h FROM r)) WHERE n <= 2000 GROUP BY epoch""")
def ray_cap(spark, d):
    """The rays of each epoch that carve where their number is capped."""
    rays = T.points(spark, d).select("epoch", "frame_id", "l_orderkey").distinct()
    order = F.struct((F.col("l_orderkey") * 2654435761 + 5) % 4294967296, "l_orderkey")
    return capped_rays(rays, ["epoch"], order, 2000).groupBy("epoch").agg(F.count("*").alias("rays"), F.sum("l_orderkey").alias("total"))


STEPS = "st AS (SELECT CAST(user_id % 4 AS INTEGER) AS cam, CAST(day(ts) * 24 + hour(ts) AS INTEGER) AS idx, count(*) FILTER (WHERE value > 90) AS changed FROM events GROUP BY ALL)"


def _steps(spark, d):
    e = T.read(spark, d, "events")
    return e.groupBy((F.col("user_id") % 4).cast("int").alias("cam"), (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("int").alias("idx")).agg(F.count(F.when(F.col("value") > 90, 1)).alias("changed"))


@query(f"""WITH {STEPS}, f AS (SELECT *, changed >= 1 OR row_number() OVER (PARTITION BY cam ORDER BY idx) = 1 AS runs FROM st)
SELECT cam, idx, changed, NOT runs AS cloned, max(CASE WHEN runs THEN idx END) OVER (PARTITION BY cam ORDER BY idx) AS source FROM f""")
def clone_unchanged(spark, d):
    """Steps without a change publish what the last changed one made; the first step always runs."""
    return steps.clone_unchanged(_steps(spark, d), ["cam"], "idx", F.col("changed") >= 1)


@query(f"""WITH {STEPS}, k AS (SELECT *, row_number() OVER (PARTITION BY cam ORDER BY idx) = 1 AS anchor, changed >= 1 AS keep FROM st),
l AS (SELECT cam, idx, anchor, list(CASE WHEN keep AND NOT anchor THEN idx END) OVER (PARTITION BY cam ORDER BY idx ROWS UNBOUNDED PRECEDING) AS kept, first_value(idx) OVER (PARTITION BY cam ORDER BY idx) AS a FROM k)
SELECT cam, idx, array_to_string([a] || coalesce(list_filter(kept, lambda x: x IS NOT NULL)[-3:], []), ',') AS frames FROM l""")
def keyframe_cache(spark, d):
    """Frames that a step sees: the anchor and the last three keyframes up to it."""
    return steps.keyframes(_steps(spark, d), ["cam"], "idx", F.col("changed") >= 1, 3).select("cam", "idx", F.array_join("frames", ",").alias("frames"))


@query(f"""WITH {STEPS} SELECT cam, idx, changed, coalesce(changed - lag(changed) OVER (PARTITION BY cam ORDER BY idx), 0) AS gained, round(coalesce(avg(abs(changed - l)) OVER (PARTITION BY cam), 0), 6) AS loss
FROM (SELECT *, lag(changed) OVER (PARTITION BY cam ORDER BY idx) AS l FROM st)""")
def previous_step(spark, d):
    """Each step against the one before: what was gained, and the mean absolute change of the camera."""
    return steps.against_previous(_steps(spark, d), ["cam"], "idx", "changed").withColumn("loss", r6(F.col("loss")))
