"""Order over whole tables without one task: rows are ranged by the order, numbered within ranges, and ranges are shifted by what comes before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize

_LOW = (1 << 33) - 1


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in order, with their range (_part) and place in it (_at); written down, so that both stay."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(_LOW)))


def carried(parts: DataFrame, value: Column, back: bool = False) -> Column:
    """Over one row a range: the last `value` of the ranges before (with back: the first of those after)."""
    w = Window.orderBy("_part")
    return F.first(value, True).over(w.rowsBetween(1, Window.unboundedFollowing)) if back else F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows numbered from 0 in order."""
    rows = ranged(df, order)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range, of which there are as many as partitions.
    shift = F.broadcast(parts.select("_part", before.alias("_shift")))
    return rows.join(shift, "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def rows_before(counts: DataFrame, order: list[Column], size: str) -> DataFrame:
    """counts with _i: the sum of `size` over all rows before in order; written down."""
    placed = ranged(counts, order)
    parts = placed.groupBy("_part").agg(F.sum(size).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range, of which there are as many as partitions.
    shift = F.broadcast(parts.select("_part", before.alias("_shift")))
    own = F.coalesce(F.sum(size).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return materialize(placed.withColumn("_own", own).join(shift, "_part").withColumn("_i", F.col("_own") + F.col("_shift")).select(*counts.columns, "_i"))


#: Different values (by group) of which one task each group's percentiles may take.
FEW = 1_000_000


def quantiles_by(df: DataFrame, by: list[str], value: str, qs: list[float], few: int = FEW) -> DataFrame:
    """(by.., q0, q1, ..): exact quantiles of the values that are numbers, on the straight line between neighbours.

    Equal values are counted first, so that a value that very many rows have is
    one row. Up to `few` different ones go into percentiles by count; more are
    put in one order of (by, value), with how many rows stand before each, so
    that neither a group nor the whole table meets in one task. Null and NaN
    values are left out, and so are groups without any other.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v"))
    counts = materialize(rows.groupBy(*by, "_v").agg(F.count("*").alias("_n")))
    names = [f"q{k}" for k in range(len(qs))]
    if counts.count() <= few:
        found = counts.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(float(q)) for q in qs]), F.col("_n")).alias("_q")).where("_q IS NOT NULL")
        return found.select(*by, *[F.get("_q", F.lit(k)).alias(c) for k, c in enumerate(names)])
    placed = rows_before(counts, [*[F.col(c) for c in by], F.col("_v")], "_n")
    groups = placed.groupBy(*by).agg(F.min("_i").alias("_first"), F.sum("_n").alias("_total"))
    joined = placed.alias("p").join(groups.alias("g"), [F.col(f"p.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]) if by else placed.alias("p").crossJoin(F.broadcast(groups.alias("g")))  # one row
    at = F.col("_i") - F.col("_first")
    holds = lambda place: (place >= at) & (place < at + F.col("_n"))
    sums = []
    for q, name in zip(qs, names, strict=True):
        place = (F.col("_total") - 1) * float(q)
        low, share = F.floor(place), place - F.floor(place)
        sums.append(F.sum(F.when(holds(low), F.col("_v") * (1 - share)).otherwise(0.0) + F.when(holds(F.ceil(place)) & (share > 0), F.col("_v") * share).otherwise(0.0)).alias(name))
    return joined.groupBy(*[F.col(f"p.{c}") for c in by]).agg(*sums)


def first_rows(df: DataFrame, by: list[str], order: list[str], fraction: float, least: int = 3) -> DataFrame:
    """The first floor(fraction * n) rows of each group in ascending order, `least` at least.

    Rows are counted by the first column of the order, which tells where each
    group is cut; only rows at a cut are put in order among each other, so that
    no group meets in one task.
    """
    counts = materialize(df.groupBy(*by, F.col(order[0]).alias("_v")).agg(F.count("*").alias("_n")))
    placed = rows_before(counts, [*[F.col(c) for c in by], F.col("_v")], "_n")
    groups = placed.groupBy(*by).agg(F.min("_i").alias("_first"), F.sum("_n").alias("_total"))
    wanted = groups.select(*by, "_first", F.least(F.greatest(F.floor(F.lit(fraction) * F.col("_total")), F.lit(least)), F.col("_total")).alias("_k"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    into = F.col("_i") - F.col("_first")
    cuts = placed.alias("p").join(wanted.alias("w"), same("p", "w")).where((into < F.col("_k")) & (F.col("_k") <= into + F.col("_n")))
    cuts = materialize(cuts.select(*[F.col(f"p.{c}") for c in by], F.col("_v").alias("_cut"), (F.col("_k") - into).alias("_left")))
    cuts = F.broadcast(cuts) if cuts.count() <= FEW_GROUPS else cuts
    rows, at = df.alias("p").join(cuts.alias("w"), same("p", "w")).select("p.*", "_cut", "_left"), F.col(order[0]).eqNullSafe(F.col("_cut"))
    below = rows.where(~at & (F.col(order[0]).isNull() | (F.col(order[0]) < F.col("_cut")))).select(*df.columns)
    ties = materialize(numbered(rows.where(at), [F.col(c) for c in [*by, *order]], "_place"))
    first = ties.groupBy(*by).agg(F.min("_place").alias("_start"))
    first = F.broadcast(first) if first.count() <= FEW_GROUPS else first
    kept = ties.alias("p").join(first.alias("w"), same("p", "w")).where("_place - _start < _left").select(*[F.col(f"p.{c}") for c in df.columns])
    return below.unionByName(kept)


#: Groups whose cuts are broadcast.
FEW_GROUPS = 100_000
