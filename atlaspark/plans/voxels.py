"""The voxel map: occupied and free observations folded into short- and long-term log-odds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp, distance, is_finite, pack_key, unpack_key, voxel_index, yaw_bit
from .storage import materialize


@dataclass(frozen=True)
class MapSettings:
    """Steps and limits of the log-odds state."""

    size: float = 0.25
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    occ_step: float = 0.5
    free_step: float = -0.5
    low: float = -2.0
    high: float = 3.5
    free_to_lt_after: int = 4
    carve_gap: int = 2
    lt_free_scale: float = 0.5
    promote_after: int = 5
    promote_views: int = 1
    promote_value: float = 0.8
    demote_after: int = 10
    demote_gap: int = 3
    demote_step: float = 0.5
    samples_per_voxel: float = 1.0
    accumulate_step: float | None = None
    promoted_above: float = 0.0
    decay: float = 1.0


def endpoints(points: DataFrame, params: MapSettings, by: list[str]) -> DataFrame:
    """Distinct keys of the voxels in which finite points lie, for each call."""
    index = [voxel_index(F.col(c), o, params.size) for c, o in zip("xyz", params.origin, strict=True)]
    return points.where(is_finite("x", "y", "z")).select(*by, pack_key(*index).alias("key")).distinct()


def ray_cells(points: DataFrame, params: MapSettings, by: list[str], most_range: float | None = None) -> DataFrame:
    """Distinct keys of the voxels that rays (cx, cy, cz) to (x, y, z) pass, without the endpoints of the same call."""
    start, end = [F.col(f"c{a}") for a in "xyz"], [F.col(a) for a in "xyz"]
    rays = points.where(is_finite("x", "y", "z")).withColumn("_len", distance(start, end))
    if most_range is not None:
        rays = rays.where(F.col("_len") <= most_range)
    steps = F.greatest(F.lit(1), F.ceil(F.col("_len") / params.size * params.samples_per_voxel).cast("int"))
    sampled = rays.withColumn("_n", steps).withColumn("_m", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = (F.col("_m") + 0.5) / F.col("_n")
    index = [voxel_index(a + t * (b - a), o, params.size) for a, b, o in zip(start, end, params.origin, strict=True)]
    return sampled.select(*by, pack_key(*index).alias("key")).distinct().join(endpoints(points, params, by), [*by, "key"], "left_anti")


def _start() -> Column:
    return F.named_struct(
        F.lit("st"), F.lit(0.0), F.lit("lt"), F.lit(0.0), F.lit("hits"), F.lit(0), F.lit("pos"), F.lit(0), F.lit("neg"), F.lit(0),
        F.lit("last_occ"), F.lit(-1), F.lit("last_free"), F.lit(-1),
    )


def _observe(s: Column, e: Column, p: MapSettings) -> Column:
    """The state after one observation: occupied raises the short-term value; free lowers it and, after enough in a row, the long-term one."""
    occ = e.kind == 0
    step = lambda v, d: clamp(v + F.lit(d), p.low, p.high)
    neg = s.neg + 1
    carve = (neg >= p.free_to_lt_after) & F.when(s.last_occ < 0, e.epoch == 0).otherwise(e.epoch - s.last_occ > p.carve_gap)
    return F.named_struct(
        F.lit("st"), F.when(occ, step(s.st, p.occ_step)).otherwise(step(s.st, p.free_step)),
        F.lit("lt"), F.when(~occ & carve, step(s.lt, p.lt_free_scale * p.free_step)).otherwise(s.lt),
        F.lit("hits"), s.hits + F.when(occ, 1).otherwise(0),
        F.lit("pos"), F.when(occ, s.pos + 1).otherwise(0),
        F.lit("neg"), F.when(occ, 0).otherwise(neg),
        F.lit("last_occ"), F.when(occ, e.epoch).otherwise(s.last_occ),
        F.lit("last_free"), F.when(occ, s.last_free).otherwise(e.epoch),
    )


def fold(events: DataFrame, params: MapSettings) -> DataFrame:
    """State of each key after its events (epoch, seq, kind: 0 occupied, 1 free) in order.

    A key's history is bounded by the number of calls, as a call sees a key at
    most twice; keys are spread over the cluster.
    """
    history = events.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("epoch", "seq", "kind"))).alias("h"))
    folded = history.select("key", F.aggregate("h", _start(), lambda s, e: _observe(s, e, params)).alias("s"))
    never = lambda c: F.when(F.col(f"s.{c}") >= 0, F.col(f"s.{c}")).alias(c)
    return folded.select("key", "s.st", "s.lt", "s.hits", "s.pos", "s.neg", never("last_occ"), never("last_free"))


def promote(occupied: DataFrame, params: MapSettings) -> DataFrame:
    """(key, epochs, views, promoted): keys seen occupied in enough epochs and from enough directions.

    Takes the distinct (key, epoch) with the bits of the directions seen in it.
    """
    seen = occupied.groupBy("key").agg(F.countDistinct("epoch").alias("epochs"), F.bit_or("bits").alias("mask"))
    views = F.bit_count(F.col("mask").bitwiseAND(255)).alias("views")
    return seen.select("key", "epochs", views).withColumn("promoted", (F.col("epochs") >= params.promote_after) & (F.col("views") >= params.promote_views))


def demote(state: DataFrame, epoch: int, params: MapSettings, floor: float = 0.0) -> DataFrame:
    """Long-term values after an epoch ends: keys free long enough lose a step, and if any did, all values are clamped to floor or more."""
    due = (F.col("neg") >= params.demote_after) & (F.lit(epoch) - F.col("last_occ") >= params.demote_gap)
    any_due = state.agg(F.coalesce(F.bool_or(due), F.lit(False)).alias("_any"))
    lowered = F.when(due, F.col("lt") - params.demote_step).otherwise(F.col("lt"))
    return state.crossJoin(F.broadcast(any_due)).withColumn("lt", F.when(F.col("_any"), clamp(lowered, max(params.low, floor), params.high)).otherwise(lowered)).withColumn("demoted", F.coalesce(due, F.lit(False))).drop("_any")


#: A voxel's state between epochs. st, lt: short- and long-term log-odds; epochs, mask: epochs and directions it was seen in.
STATE = "key long, st double, lt double, hits int, pos int, neg int, last_occ int, last_free int, epochs int, mask int, promoted boolean"


def capped_rays(points: DataFrame, by: list[str], order: Column, most: int) -> DataFrame:
    """At most `most` rays of each call for carving, the first by `order`; a window with a limit, which Spark also applies before the exchange."""
    return points.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= most).drop("_r")


def observations(points: DataFrame, cameras: DataFrame, params: MapSettings, most_range: float, z_band: tuple[float, float], by: list[str], carving: DataFrame | None = None) -> DataFrame:
    """(by.., key, kind, bits) of one multi-camera call for each value of `by`: voxels that points end in (0) or rays pass (1).

    Points (frame_id, x, y, z) meet their camera (frame_id, cx, cy, cz); those
    out of range or of the height band go. bits: the directions from which an
    endpoint was seen. A voxel that a point of the call ends in is never free.
    Where rays are to be capped, `carving` is the points whose rays carve.
    """

    def seen(rows: DataFrame) -> DataFrame:
        far = distance([F.col(f"c{a}") for a in "xyz"], [F.col(a) for a in "xyz"])
        return rows.join(cameras, "frame_id").where(is_finite("x", "y", "z") & F.col("z").between(*z_band) & (far <= most_range))

    ends = seen(points)
    index = [voxel_index(F.col(c), o, params.size) for c, o in zip("xyz", params.origin, strict=True)]
    bit = yaw_bit(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    occupied = ends.groupBy(*by, pack_key(*index).alias("key")).agg(F.bit_or(bit).alias("bits"))
    free = ray_cells(seen(carving) if carving is not None else ends, params, by).join(occupied, [*by, "key"], "left_anti")
    return occupied.select(*by, "key", F.lit(0).alias("kind"), "bits").union(free.select(*by, "key", F.lit(1), F.lit(0)))


def integrate(state: DataFrame, seen: DataFrame, epoch: int, params: MapSettings) -> DataFrame:
    """State after one call of an epoch: seen (key, kind, bits) with a key at most once. New keys start at zero."""
    new = {"st": 0.0, "lt": 0.0, "hits": 0, "pos": 0, "neg": 0, "last_occ": None, "last_free": None, "epochs": 0, "mask": 0, "promoted": False}
    both = state.join(seen.select("key", "kind", "bits"), "key", "full")
    old = {c: F.coalesce(F.col(c), F.lit(v)) if v is not None else F.col(c) for c, v in new.items()}
    occ, free, e = F.col("kind") == 0, F.col("kind") == 1, F.lit(epoch)
    neg = old["neg"] + 1
    gap = F.when(old["last_occ"].isNull(), e == 0).otherwise(e - old["last_occ"] > params.carve_gap)
    step = lambda v, d: clamp(v + F.lit(d), params.low, params.high)
    return both.select(
        "key",
        F.when(occ, step(old["st"], params.occ_step)).when(free, step(old["st"], params.free_step)).otherwise(old["st"]).alias("st"),
        F.when(free & (neg >= params.free_to_lt_after) & gap, step(old["lt"], params.lt_free_scale * params.free_step)).otherwise(old["lt"]).alias("lt"),
        (old["hits"] + F.when(occ, 1).otherwise(0)).alias("hits"),
        F.when(occ, old["pos"] + 1).when(free, 0).otherwise(old["pos"]).alias("pos"),
        F.when(occ, 0).when(free, neg).otherwise(old["neg"]).alias("neg"),
        F.when(occ, e).otherwise(old["last_occ"]).alias("last_occ"),
        F.when(free, e).otherwise(old["last_free"]).alias("last_free"),
        (old["epochs"] + F.when(occ, 1).otherwise(0)).alias("epochs"),
        F.when(occ, old["mask"].bitwiseOR(F.col("bits"))).otherwise(old["mask"]).alias("mask"),
        old["promoted"].alias("promoted"),
    )


def finalise(state: DataFrame, epoch: int, params: MapSettings, floor: float = 0.0) -> DataFrame:
    """State after an epoch ends: promotion of voxels seen in it, demotion, decay of the short-term value.

    Promotion raises the long-term value to promote_value, or by
    accumulate_step where that is set. Demotion takes a step off voxels free for
    long and then clamps the whole map (one row says whether any was demoted).
    """
    views = F.bit_count(F.col("mask").bitwiseAND(255))
    rises = (F.col("last_occ") == epoch) & (F.col("epochs") >= params.promote_after) & (views >= params.promote_views)
    raised = F.greatest(F.col("lt"), F.lit(params.promote_value)) if params.accumulate_step is None else F.col("lt") + params.accumulate_step
    up = state.withColumn("promoted", F.col("promoted") | F.coalesce(rises, F.lit(False))).withColumn("lt", F.when(rises, clamp(raised, params.low, params.high)).otherwise(F.col("lt")))
    down = demote(up, epoch, params, floor).withColumn("promoted", F.col("promoted") & (F.col("lt") > params.promoted_above)).drop("demoted")
    return down.withColumn("st", clamp(F.col("st") * params.decay, params.low, params.high)) if params.decay < 0.9999 else down


def run_epochs(seen: DataFrame, epochs: list[int], params: MapSettings) -> DataFrame:
    """The map after epochs of observations (epoch, key, kind, bits): each is integrated and finalised; the state is written down after each.

    The observations are written down once before, so that rays are worked out once and not for each epoch.
    """
    seen = materialize(seen.where(F.col("epoch").isin(epochs)))
    state = seen.sparkSession.createDataFrame([], STATE)
    for epoch in epochs:
        state = materialize(finalise(integrate(state, seen.where(F.col("epoch") == epoch), epoch, params), epoch, params))
    return state


def exported(state: DataFrame, occupied_above: float, free_below: float, z_band: tuple[int, int]) -> DataFrame:
    """(key, i, j, k, value, kind): voxels within a height band, by the larger of both values: occupied, else free by the short-term one."""
    i, j, k = unpack_key(F.col("key"))
    value = F.greatest("st", "lt")
    kind = F.when(value >= occupied_above, "occupied").when(F.col("st") <= free_below, "free")
    rows = state.select("key", i.alias("i"), j.alias("j"), k.alias("k"), value.alias("value"), kind.alias("kind"))
    return rows.where(F.col("kind").isNotNull() & F.col("k").between(*z_band))
