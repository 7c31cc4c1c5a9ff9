"""Choosing, naming, pairing and interpolating frames; pixels on grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .ordered import carried, numbered, ranged


def selected_index(choice: Column) -> Column:
    """The number before the colon of "3: name"; null for anything else."""
    digits = F.regexp_extract(choice, r"^\s*(\d{1,9})\s*:", 1)
    return F.when(digits != "", digits.cast("int"))


def not_black(r: Column, g: Column, b: Column, least: int = 16) -> Column:
    return r + g + b >= least


def not_white(r: Column, g: Column, b: Column, most: int = 240) -> Column:
    return ~((r > most) & (g > most) & (b > most))


def repeat(df: DataFrame, k: int, index: str = "copy") -> DataFrame:
    """Every row k times, numbered."""
    return df.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def resize(df: DataFrame, order: list[Column], n: int, seed: int, id_col: str) -> DataFrame:
    """n rows in a seeded order, the rows taken round and round where there are fewer."""
    mixed = F.pmod(F.col(id_col).cast("long") * 2654435761 + seed, F.lit(4294967296))
    ranked = numbered(df, [mixed, *order], "_r")
    total = ranked.agg(F.count("*").alias("_n"))
    times = F.floor((F.lit(n) - F.col("_r") + F.col("_n") - 1) / F.col("_n")).cast("int")
    spread = ranked.crossJoin(F.broadcast(total)).withColumn("_t", times).where("_t > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    return spread.withColumn("place", F.col("_r") + F.col("_k") * F.col("_n")).drop("_r", "_n", "_t", "_k")


def within_tolerance(left: DataFrame, right: DataFrame, key: str, step: int, value: str) -> DataFrame:
    """left with the value of the right row of equal key, else of key - step, else of key + step."""
    tries = left.select("*", F.posexplode(F.array(F.lit(0), F.lit(-step), F.lit(step))).alias("_o", "_d"))
    found = tries.join(right.select((F.col(key)).alias("_k"), F.col(value).alias("_v")), F.col(key) + F.col("_d") == F.col("_k"), "left")
    return found.groupBy(*left.columns).agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_o"))).alias(value))


def last_written(points: DataFrame, pixel: list[str], value: str, order: list[str]) -> DataFrame:
    """The value written last to each pixel."""
    return points.groupBy(*pixel).agg(F.max_by(value, F.struct(*order)).alias(value))


def interpolate(queries: DataFrame, samples: DataFrame, at: str, value: str, id_col: str) -> DataFrame:
    """Values at times between samples, on the straight line between the ones before and after; none outside."""
    both = queries.select(F.col(id_col).alias("_id"), F.col(at).alias("_t"), F.lit(None).cast("double").alias("_v")).unionByName(samples.select(F.lit(None).cast(queries.schema[id_col].dataType).alias("_id"), F.col(at).alias("_t"), F.col(value).cast("double").alias("_v")))
    is_sample = F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))
    rows = ranged(both, [F.col("_t")])
    # The range before and the one after, by one row for each range.
    parts = rows.groupBy("_part").agg(F.max(is_sample).alias("_last"), F.min(is_sample).alias("_first"))
    edges = parts.select("_part", carried(parts, F.col("_last")).alias("_left"), carried(parts, F.col("_first"), back=True).alias("_right"))
    before = Window.partitionBy("_part").orderBy("_t", F.col("_v").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    # Backwards, as a frame up to the end is worked out anew for every row.
    after = Window.partitionBy("_part").orderBy(F.desc("_t"), F.col("_v").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(edges), "_part").withColumn("_a", F.coalesce(F.last(is_sample, True).over(before), "_left")).withColumn("_b", F.coalesce(F.last(is_sample, True).over(after), "_right")).where("_id IS NOT NULL")
    span = F.col("_b._t") - F.col("_a._t")
    line = F.when(span == 0, F.col("_a._v")).otherwise(F.col("_a._v") + (F.col("_b._v") - F.col("_a._v")) * (F.col("_t") - F.col("_a._t")) / span)
    return out.select(F.col("_id").alias(id_col), F.col("_t").alias(at), line.alias(value))


def _brackets(samples: DataFrame, at: str, columns: list[str]) -> DataFrame:
    """Each sample with the one before it and the two after, as structs (t, columns) b, s, n and m."""
    placed = materialize(numbered(samples.select(F.col(at).cast("double").alias("t"), *columns), [F.col("t")], "i"))
    row = F.struct("t", *columns)
    own = placed.select("i", row.alias("s"))
    for name, step in (("b", 1), ("n", -1), ("m", -2)):
        own = own.join(placed.select((F.col("i") + step).alias("i"), row.alias(name)), "i", "left")
    return own


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w, x, y, z = a.T
    p, q, r, s = b.T
    return np.stack([w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p], 1)


def _logarithm(q: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(q[:, 1:], axis=1)
    factor = np.where(size > 0, np.arctan2(size, q[:, 0]) / np.where(size > 0, size, 1), 0)
    return np.column_stack((np.log(np.linalg.norm(q, axis=1)), q[:, 1:] * factor[:, None]))


def _power(q: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(q[:, 1:], axis=1)
    factor = np.where(size > 0, np.sin(size) / np.where(size > 0, size, 1), 1)
    return np.exp(q[:, :1]) * np.column_stack((np.cos(size), q[:, 1:] * factor[:, None]))


def _between(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The turn from a to b, by shares of it."""
    return _multiply(_power(_logarithm(_multiply(b, a * [1, -1, -1, -1])) * share[:, None]), a)


def squad(t: np.ndarray, times: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Spherical spline at t between the second and third of four unit quaternions (rows, 4, wxyz) at their times; a first or fourth without a time is none."""
    before, own, after, later = (turns[:, i] for i in range(4))
    back = lambda q: q * [1, -1, -1, -1]
    span = times[:, 2] - times[:, 1]
    forth = _logarithm(_multiply(back(own), after))
    left = _logarithm(_multiply(back(before), own)) * (span / (times[:, 1] - times[:, 0]))[:, None]
    right = _logarithm(_multiply(back(after), later)) * (span / (times[:, 3] - times[:, 2]))[:, None]
    a = np.where(np.isnan(times[:, :1]), own, _multiply(own, _power((left - forth) / 4)))
    b = np.where(np.isnan(times[:, 3:]), after, _multiply(after, _power((forth - right) / 4)))
    share = (t - times[:, 1]) / span
    return _between(_between(own, after, share), _between(a, b, share), 2 * share * (1 - share))


def interpolate_turns(queries: DataFrame, samples: DataFrame, at: str, turn: tuple[str, str, str, str] = ("qw", "qx", "qy", "qz"), id_col: str = "id") -> DataFrame:
    """(id, at, turn): unit quaternions at times between samples, by spherical splines over the two samples on either side.

    Samples are scaled to unit length, and each takes the sign nearer to the one
    before it within its bracket. At the ends of the samples the missing one is
    left out; outside them, and with fewer than two, the result is null. Samples
    with a null number or no length take no part; of samples at one time the
    first by value counts.
    """
    columns = list(turn)
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
    unit = samples.select(F.col(at).cast("double").alias("_t"), *[F.col(c).cast("double") for c in columns]).withColumn("_l", length).where("_t IS NOT NULL AND _l > 0")
    unit = unit.select("_t", *[(F.col(c) / F.col("_l")).alias(c) for c in columns]).groupBy("_t").agg(F.min(F.struct(*columns)).alias("q")).select(F.col("_t").alias(at), *[f"q.{c}" for c in columns])
    bracket = _brackets(unit, at, columns).select(F.col("s.t").alias("_t"), F.struct("b", "s", "n", "m").alias("_b"))
    both = queries.select(F.col(id_col).alias("_id"), F.col(at).cast("double").alias("_t")).withColumn("_b", F.lit(None).cast(bracket.schema["_b"].dataType)).withColumn("_q", F.lit(1))
    rows = ranged(both.unionByName(bracket.withColumn("_id", F.lit(None).cast(queries.schema[id_col].dataType)).withColumn("_q", F.lit(0))), [F.col("_t"), F.col("_q")])
    parts = rows.groupBy("_part").agg(F.max_by("_b", F.when(F.col("_b").isNotNull(), F.col("_at"))).alias("_last"))
    left = F.broadcast(parts.select("_part", carried(parts, F.col("_last")).alias("_left")))  # one row a range
    # The last sample at or before a time; a sample itself is its own.
    last = F.last("_b", True).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_own", last).join(left, "_part").where("_q = 1").select("_id", "_t", F.coalesce("_own", "_left").alias("_b"))
    kinds = ["b", "s", "n", "m"]
    flat = found.select("_id", "_t", *[F.col(f"_b.{k}.t").alias(f"t{k}") for k in kinds], *[F.col(f"_b.{k}.{c}").alias(f"{k}{c}") for k in kinds for c in columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            times = rows[[f"t{k}" for k in kinds]].to_numpy(float)
            turns = np.stack([rows[[f"{k}{c}" for c in columns]].to_numpy(float) for k in kinds], 1)
            for i, j in ((2, 1), (0, 1), (3, 2)):
                flip = (turns[:, i] * turns[:, j]).sum(axis=1) < 0
                turns[flip, i] *= -1
            t = rows["_t"].to_numpy(float)
            with np.errstate(invalid="ignore", divide="ignore"):
                out = squad(t, times, turns)
            exact = t == times[:, 1]
            out[exact] = turns[exact, 1]
            frame = rows[["_id", "_t"]].copy()
            for k, c in enumerate(columns):
                frame[c] = out[:, k]
            yield frame

    kind = queries.schema[id_col].dataType.simpleString()
    done = flat.mapInPandas(run, f"_id {kind}, _t double, {', '.join(f'{c} double' for c in columns)}")
    return done.select(F.col("_id").alias(id_col), F.col("_t").alias(at), *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])


def mesh_faces(pixels: DataFrame, valid: str) -> DataFrame:
    """Two triangles (a, b, c as v * 2^20 + u) for each square of a pixel grid whose corners are all valid."""
    ok = pixels.where(F.col(valid)).select("v", "u")
    at = lambda dv, du: ok.select((F.col("v") - dv).alias("v"), (F.col("u") - du).alias("u"))
    squares = ok.join(at(0, 1), ["v", "u"]).join(at(1, 0), ["v", "u"]).join(at(1, 1), ["v", "u"])
    corner = lambda dv, du: (F.col("v") + dv) * (1 << 20) + F.col("u") + du
    faces = F.array(F.array(corner(0, 0), corner(0, 1), corner(1, 0)), F.array(corner(1, 0), corner(0, 1), corner(1, 1)))
    return squares.select(F.explode(faces).alias("f")).select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"), F.col("f")[2].alias("c"))


def surface_faces(pixels: DataFrame, valid: str, colour: str) -> DataFrame:
    """(a, b, c, colour): the triangles of a pixel grid whose three corners are valid, each from both sides; corners as v * 2^20 + u.

    Each square has two triangles: its first corner's and its last one's, whose
    colours they take. A pixel is counted for the six triangles around it, so
    that a triangle is a group of three rows and no pixel is joined with its
    neighbours. Pixels that repeat count once, with their lowest colour.
    """
    ok = pixels.where(F.col(valid)).groupBy("v", "u").agg(F.min(colour).alias("_k"))
    # Of which square (steps back) and triangle (0: first corner's, 1: last one's) a pixel is a corner; where it gives the colour.
    places = [(0, 0, 0, True), (0, 1, 0, False), (0, 1, 1, False), (1, 0, 0, False), (1, 0, 1, False), (1, 1, 1, True)]
    part = F.explode(F.array(*[F.struct((F.col("v") - dv).alias("v"), (F.col("u") - du).alias("u"), F.lit(t).alias("t"), F.when(F.lit(own), F.col("_k")).alias("k")) for dv, du, t, own in places]))
    whole = ok.select(part.alias("p")).groupBy("p.v", "p.u", "p.t").agg(F.count("*").alias("n"), F.max("p.k").alias("k")).where("n = 3")
    corner = lambda dv, du: (F.col("v") + dv) * (1 << 20) + F.col("u") + du
    first, last = [corner(0, 0), corner(0, 1), corner(1, 0)], [corner(0, 1), corner(1, 0), corner(1, 1)]
    sides = F.when(F.col("t") == 0, F.array(F.array(*first), F.array(*first[::-1]))).otherwise(F.array(F.array(*last), F.array(*last[::-1])))
    return whole.select(F.explode(sides).alias("f"), "k").select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"), F.col("f")[2].alias("c"), F.col("k").alias(colour))


def nearest_bucket(width: Column, height: Column, ratios: list[float]) -> Column:
    """Index of the aspect ratio nearest to a landscape image's (the inverse for portraits), the first of equals."""
    own = F.greatest(width, height) / F.least(width, height)
    gaps = F.array(*[F.abs(own - F.lit(r)) for r in ratios])
    return F.array_position(gaps, F.array_min(gaps)) - 1


def snap_rotation(angle: Column) -> Column:
    """0 within 60 degrees, else the nearest quarter turn."""
    return F.when(angle.between(-60, 60), 0).otherwise(F.pmod(F.bround(angle / 90), F.lit(4)).cast("int") * 90)


def hex_path(index: Column, base: int, digits: int) -> Column:
    """A folder path from an index: its digits in a base, in hexadecimal, joined by slashes."""
    parts = [F.lower(F.hex(F.pmod(F.floor(index / base**k).cast("long"), F.lit(base)))) for k in reversed(range(digits))]
    return F.concat_ws("/", *parts)


def decode_depth(raw: Column, scale: float, most: float) -> Column:
    """Depth of a stored number; 0 where it is not finite or beyond the limit."""
    d = raw / scale
    return F.when((d <= most) & ~F.isnan(d), d).otherwise(0.0)


def unit_confidence(df: DataFrame, names: list[str]) -> DataFrame:
    """Column conf from the first of the names that is there, over 255 if it goes beyond 1."""
    out = df.withColumn("conf", F.coalesce(*[F.col(n) for n in names if n in df.columns]).cast("double"))
    top = out.agg(F.max("conf").alias("_top"))
    return out.crossJoin(F.broadcast(top)).withColumn("conf", F.when(F.col("_top") > 1, F.col("conf") / 255).otherwise(F.col("conf"))).drop("_top")
