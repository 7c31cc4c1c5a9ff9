"""Ordered and partitioned calculations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(score: Column, by: list[str], temperature: float = 1.0, eps: float = 1e-8) -> Column:
    """exp((s - max) / t) over its sum within a group."""
    w, t = Window.partitionBy(*by), max(temperature, 1e-6)
    e = F.exp((score - F.max(score).over(w)) / t)
    return e / (F.sum(e).over(w) + eps)


def running_index(flag: Column, by: list[str], order: list[str]) -> Column:
    """Place of each flagged row among the flagged ones, from 0."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(flag.cast("int")).over(w) - 1


def offsets(size: Column, order: list[str], by: list[str] | None = None) -> Column:
    """Sum of the sizes that come before."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(w), F.lit(0))


def trailing(order: list[str], by: list[str], n: int = 20):
    """The last n rows up to this one."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def best_fraction(df: DataFrame, by: list[str], order: list[Column], fraction: float, least: int = 3) -> DataFrame:
    """The first floor(fraction * n) rows of each group, `least` at least; a group is one task (ordered.first_rows: for large ones)."""
    w = Window.partitionBy(*by)
    n = F.greatest(F.floor(F.lit(fraction) * F.count("*").over(w)), F.lit(least))
    return df.withColumn("_n", n).withColumn("_r", F.row_number().over(w.orderBy(*order))).where("_r <= _n").drop("_n", "_r")


def stride(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """Every n-th row of each group, from the first."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where((F.col("_r") - 1) % n == 0).drop("_r")


def evenly_spaced(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """k rows of each group at rounded even steps (half to even), all rows of smaller groups."""
    w = Window.partitionBy(*by)
    placed = df.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(1, k - 1)))).cast("int"))
    return placed.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_r").cast("int"))).drop("_n", "_r")


def mixed(id_col: Column, seed: int) -> Column:
    """An arithmetic hash of whole numbers that other engines share."""
    return F.pmod(id_col.cast("long") * 2654435761 + seed, F.lit(4294967296))


def seeded_sample(df: DataFrame, by: list[str], id_col: str, n: int, seed: int) -> DataFrame:
    """n rows of each group, always the same ones for a seed."""
    return top_k(df, by, [mixed(F.col(id_col), seed), F.col(id_col)], n, "_r").drop("_r")


def batches(df: DataFrame, by: list[str], order: list[Column], size: int, drop_last: bool = True) -> DataFrame:
    """Number rows of equal `by` into batches; a batch that is not full is dropped."""
    w = Window.partitionBy(*by)
    out = df.withColumn("batch", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / size).cast("long"))
    if not drop_last:
        return out
    return out.withColumn("_n", F.count("*").over(w)).where(F.col("batch") < F.floor(F.col("_n") / size)).drop("_n")
