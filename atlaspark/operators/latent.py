"""A map whose voxels hold vectors: points send theirs to the voxels around them, which take them in through a gate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import materialize
from .joins import FEW_OPEN, WIDER, _near_cells, _own_cell

Matrix = Sequence[Sequence[float]]

CELL = ["_c0", "_c1", "_c2"]


@dataclass(frozen=True)
class LatentWeights:
    """Weights of the update, which do not grow with the map.

    Similarity: temperature * (cosine of the projected vectors + offset . (point - centre) + bias); no projection
    means the vectors themselves. gate: rows of 2 D (message, then state) and a bias each. reset, keep and new: rows of
    D for the gated message and rows of D for the state, and biases, of a recurrent cell's three gates.
    """

    gate: Matrix
    gate_bias: Sequence[float]
    message: dict[str, Matrix]
    state: dict[str, Matrix]
    message_bias: dict[str, Sequence[float]]
    state_bias: dict[str, Sequence[float]]
    point_projection: Matrix | None = None
    voxel_projection: Matrix | None = None
    offset: Sequence[float] = (0.0, 0.0, 0.0)
    bias: float = 0.0
    temperature: float = 1.0


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _times(rows: Matrix, vector: Column) -> Column:
    return F.array(*[_dot(_numbers(r), vector) for r in rows])


def _sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _sigmoid(a: Column) -> Column:
    return F.transform(a, lambda x: 1 / (1 + F.exp(-x)))


def _around(voxels: DataFrame, radius: float, entry: Column, name: str = "_around") -> tuple[DataFrame, bool]:
    """For each cell the list of entries of the voxels in and next to it, and whether these are few enough for every task."""
    lists = _near_cells(voxels, ["cx", "cy", "cz"], radius * WIDER, 1).groupBy(*CELL).agg(F.collect_list(entry).alias(name))
    lists = materialize(lists)
    return lists, (lists.agg(F.sum(F.size(name))).first()[0] or 0) <= FEW_OPEN


def _meet(points: DataFrame, lists: DataFrame, few: bool, radius: float) -> DataFrame:
    """Points with the lists of their cells, and stay where they are if the lists are few; otherwise they are dealt by cell."""
    return _own_cell(points, ["x", "y", "z"], radius * WIDER).join(F.broadcast(lists) if few else lists, CELL).drop(*CELL)


def near_voxels(points: DataFrame, voxels: DataFrame, radius: float, most: int = 32, key: str = "key") -> DataFrame:
    """Points (x, y, z) with the voxels (cx, cy, cz) at most `radius` from them, the `most` nearest of each point (ties to the smaller key).

    A point meets the voxels around its cell as one list, so that no pairs are exchanged by point.
    """
    other = [c for c in voxels.columns if c != key]
    found = _meet(points, *_around(voxels, radius, F.struct(key, *other)), radius)
    far = lambda v: sum(((F.col(a) - v[f"c{a}"]) * (F.col(a) - v[f"c{a}"]) for a in "xyz"), F.lit(0.0))
    near = F.filter(F.transform("_around", lambda v: F.struct(far(v).alias("d2"), v[key].alias(key), *[v[c].alias(c) for c in other])), lambda v: v["d2"] <= radius * radius)
    return found.select(*points.columns, F.inline(F.slice(F.sort_array(near), 1, most)))


def _values(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sent(batch: pa.RecordBatch, weights: LatentWeights, size: int, width: int, radius: float, tau: float, most: int) -> pa.RecordBatch | None:
    """(key, message): what the points of a batch send to each voxel."""
    x, y, z, f, keys, around = (batch.column(c) for c in ("x", "y", "z", "f", "_keys", "_around"))
    point = np.repeat(np.arange(len(batch)), keys.value_lengths().to_numpy(zero_copy_only=False))
    at, f, voxel, keys = np.column_stack([x, y, z]), _values(f, size), _values(around, width + 4), keys.flatten()
    delta = at[point] - voxel[:, :3]
    d2 = (delta * delta).sum(1)
    kept = np.flatnonzero(d2 <= radius * radius)
    keys = keys.take(pa.array(kept)).dictionary_encode()
    code = keys.indices.to_numpy(zero_copy_only=False)
    if len(kept) and np.bincount(point[kept]).max() > most:
        rank = np.argsort(pc.array_sort_indices(keys.dictionary).to_numpy())[code]
        order = np.lexsort((rank, d2[kept], point[kept]))
        kept, code = kept[order], code[order]
        first = np.searchsorted(point[kept], point[kept])
        near = np.arange(len(kept)) - first < most
        kept, code = kept[near], code[near]
    if not len(kept):
        return None
    point, delta, voxel = point[kept], delta[kept], voxel[kept]
    own = f if weights.point_projection is None else f @ np.array(weights.point_projection, dtype=float).T
    length = np.sqrt((own * own).sum(1)) + 1e-6
    core = (own[point] * voxel[:, 4:]).sum(1) / (length[point] * voxel[:, 3])
    s = weights.temperature * (core + delta @ np.array(weights.offset, dtype=float) + weights.bias)
    _, first, turn = np.unique(point, return_index=True, return_inverse=True)
    e = np.exp((s - np.maximum.reduceat(s, first)[turn]) / max(tau, 1e-6))
    share = e / (np.add.reduceat(e, first)[turn] + 1e-8)
    met = np.unique(code)
    sums = np.column_stack([np.bincount(code, share * f[point, i], len(keys.dictionary)) for i in range(size)])[met]
    message = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, size, dtype=np.int32), sums.ravel())
    return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(met)), message], ["key", "message"])


def messages(points: DataFrame, state: DataFrame, weights: LatentWeights, size: int, radius: float, tau: float = 1.0, most: int = 32) -> DataFrame:
    """(key, message): for each voxel near any point, the sum of the points' vectors by their softmax shares.

    points (x, y, z, f), a point a row; state (key, cx, cy, cz, z_latent);
    vectors of `size` numbers, others send and take nothing. Similarity to the
    `most` nearest voxels: temperature * (cosine of the projected vectors +
    offset . (point - centre) + bias). A point's shares come to 1. A point meets
    the voxels around its cell as one list, so that it is settled in one row
    and only sums by voxel are exchanged.
    """
    width = size if weights.voxel_projection is None else len(weights.voxel_projection)
    whole = lambda c: F.size(F.filter(c, lambda x: x.isNotNull())) == size
    v = F.col("z_latent") if weights.voxel_projection is None else _times(weights.voxel_projection, F.col("z_latent"))
    voxels = state.where((F.size("z_latent") == size) & whole("z_latent")).select("key", "cx", "cy", "cz", v.alias("_v"))
    voxels = voxels.select("key", "cx", "cy", "cz", F.concat(F.array(*[F.col(c).cast("double") for c in ("cx", "cy", "cz")], F.sqrt(_dot(F.col("_v"), F.col("_v"))) + 1e-6), "_v").alias("_v"))
    lists, few = _around(voxels, radius, F.struct("key", "_v"))
    lists = lists.select(*CELL, F.col("_around.key").alias("_keys"), F.flatten("_around._v").alias("_around"))
    sent = points.where((F.size("f") == size) & whole("f")).select(*[F.col(c).cast("double").alias(c) for c in "xyz"], "f")
    schema = T.StructType([T.StructField("key", state.schema["key"].dataType), T.StructField("message", T.ArrayType(T.DoubleType()))])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) and (found := _sent(batch, weights, size, width, radius, tau, most)) is not None:
                yield found

    parts = _meet(sent, lists, few, radius).mapInArrow(settle, schema)
    return parts.groupBy("key").agg(F.array(*[F.sum(F.get("message", F.lit(i))) for i in range(size)]).alias("message"))


def write_back(weights: LatentWeights, message: Column, z: Column) -> Column:
    """The new vector of a voxel: a recurrent cell of the message, let through by a gate of both, and the old vector."""
    gate = _sigmoid(_sum(_times(weights.gate, F.concat(message, z)), _numbers(weights.gate_bias)))
    x = F.zip_with(message, gate, lambda a, b: a * b)
    part = {g: (_sum(_times(weights.message[g], x), _numbers(weights.message_bias[g])), _sum(_times(weights.state[g], z), _numbers(weights.state_bias[g]))) for g in ("reset", "keep", "new")}
    reset, keep = (_sigmoid(_sum(*part[g])) for g in ("reset", "keep"))
    new = F.transform(_sum(part["new"][0], F.zip_with(reset, part["new"][1], lambda a, b: a * b)), F.tanh)
    return F.zip_with(keep, F.zip_with(new, z, lambda a, b: F.struct(a.alias("n"), b.alias("z"))), lambda k, p: (1 - k) * p.n + k * p.z)


def update(points: DataFrame, state: DataFrame, weights: LatentWeights, size: int, radius: float, tau: float = 1.0, most: int = 32) -> DataFrame:
    """The state after one call: voxels near a point are rewritten, the others stay; all columns of state stay.

    Points or voxels with a null or non-finite coordinate, or without a vector,
    send and take nothing. An empty table of points changes nothing.
    """
    finite = lambda *c: F.coalesce(sum((F.abs(F.col(x)) for x in c), F.lit(0.0)) < float("inf"), F.lit(False))
    sent = points.where(finite("x", "y", "z") & F.col("f").isNotNull()).select("x", "y", "z", F.col("f").cast("array<double>").alias("f"))
    taking = state.where(finite("cx", "cy", "cz") & F.col("z_latent").isNotNull()).select("key", "cx", "cy", "cz", F.col("z_latent").cast("array<double>").alias("z_latent"))
    found = messages(sent, taking, weights, size, radius, tau, most)
    joined = state.join(found, "key", "left")
    new = F.when(F.col("message").isNotNull(), write_back(weights, F.col("message"), F.col("z_latent").cast("array<double>"))).otherwise(F.col("z_latent").cast("array<double>"))
    return joined.withColumn("z_latent", new).drop("message")
