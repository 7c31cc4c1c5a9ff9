"""Counting fixed-width keys: sorted runs in tasks, one exchange by ranges, merged runs that can be kept as memory-mapped arrays."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import new_folder

RUN = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("run", pa.binary())])
#: Keys a task holds before it sorts and sends them.
HELD = 3 << 20
#: Records that a merging task is meant to get.
PART = 2 << 20


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned 64-bit columns, the first column first: a stable pass for each sixteen bits that differ."""
    order = None
    for column in range(keys.shape[1] - 1, -1, -1):
        own = keys[:, column]
        differ = np.bitwise_or.reduce(own ^ own[0]) if len(own) else 0
        for shift in (0, 16, 32, 48):
            if int(differ) >> shift & 0xFFFF:
                digit = (own >> np.uint64(shift)).astype(np.uint16)
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(keys)) if order is None else order


def run_lengths(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights (rows of columns; without any, how often they occur)."""
    if not len(keys):
        return keys, np.zeros((0, 1 if weights is None else weights.shape[1]), np.uint64)
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint64)[:, None]
    return keys[first], np.add.reduceat(weights[order], first, axis=0)


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), 8).T.tobytes()


def pack(keys: np.ndarray, weights: np.ndarray) -> bytes:
    """A sorted run in few bytes: differences of the first column, then byte by byte, compressed."""
    columns = [np.diff(keys[:, 0], prepend=np.uint64(0)), *keys[:, 1:].T, *weights.T]
    return bytes([len(columns)]) + pa.compress(b"".join(_planes(np.ascontiguousarray(c)) for c in columns), codec="zstd", asbytes=True)


def unpack(n: int, run: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of a run of n keys of `width` columns."""
    planes = np.frombuffer(pa.decompress(memoryview(run)[1:], 8 * n * run[0], codec="zstd", asbytes=True), np.uint8)
    columns = np.ascontiguousarray(planes.reshape(-1, 8, n).transpose(0, 2, 1)).view(np.uint64).reshape(-1, n)
    return np.column_stack((np.cumsum(columns[0], dtype=np.uint64), *columns[1:width])), columns[width:].T


class Sender:
    """Collects keys of one task and gives them out as sorted runs, one for each part."""

    def __init__(self, part_of: Callable[[np.ndarray], np.ndarray], held: int = HELD):
        self.part_of, self.most, self.held, self.size = part_of, held, [], 0

    def add(self, keys: np.ndarray, weights: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, weights))
        self.size += len(keys)
        if self.size >= self.most:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, weights = (None if x[0] is None else np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        keys, weights = run_lengths(keys, weights)
        parts = self.part_of(keys)
        order = np.argsort(parts, kind="stable")
        keys, weights, parts = keys[order], weights[order], parts[order]
        first = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(first, [*first[1:], len(parts)], strict=True):
            for column, value in zip(out, (int(parts[a]), b - a, pack(keys[a:b], weights[a:b])), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, RUN.types, strict=True)], schema=RUN)


SENT = "part int, n long, run binary"


def exchange(
    sent: DataFrame, parts: int, width: int, finish: Callable[[int, np.ndarray, np.ndarray], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Merge all runs of a part in one task, which `finish` gets as (part, distinct keys in order, sums of weights), parts without any too."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, held = [], [], 0
        for batch in batches:
            for n, run in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                k, w = unpack(n, run.as_py(), width)
                keys.append(k)
                weights.append(w)
                held += n
                if len(keys) > 1 and held > 2 * max(PART, len(keys[0])):
                    merged = run_lengths(np.concatenate(keys), np.concatenate(weights))
                    keys, weights, held = [merged[0]], [merged[1]], len(merged[0])
        found = run_lengths(np.concatenate(keys), np.concatenate(weights)) if keys else (np.zeros((0, width), np.uint64), np.zeros((0, 1), np.uint64))
        del keys, weights
        yield from finish(TaskContext.get().partitionId(), *found)

    return sent.repartitionById(parts, "part").mapInArrow(merge, schema)


def part_of_hash(parts: int) -> Callable[[np.ndarray], np.ndarray]:
    """Equal ranges of 64-bit numbers as parts."""
    return lambda x: ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


# Arrays in the shared folder


def local_path(folder: str) -> str:
    """The mounted path of a folder that driver and executors share."""
    found = urlparse(folder)
    if found.scheme not in ("", "file"):
        raise ValueError(f"arrays are memory-mapped: spark.checkpoint.dir must be a mounted folder (file:), not {found.scheme}:")
    return found.path


def arrays_folder(spark: SparkSession, name: str) -> str:
    path = local_path(new_folder(spark, name))
    os.makedirs(path, exist_ok=True)
    return path


def write_array(folder: str, name: str, part: int, x: np.ndarray) -> None:
    """Written under a name of its own and then renamed: a task that is repeated leaves the same file."""
    own = f"{folder}/.{name}-{part}-{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, np.ascontiguousarray(x))
    os.replace(own, f"{folder}/{name}-{part:06d}.npy")


def read_array(folder: str, name: str, part: int) -> np.ndarray:
    """Memory-mapped, so that all workers of a machine share the pages that they touch; empty arrays can't be."""
    path = f"{folder}/{name}-{part:06d}.npy"
    return np.load(path, mmap_mode="r" if os.path.getsize(path) > 128 else None)


def find_in(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted values in a sorted array (0 where missing), and whether they are there."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    hit = sorted_[at] == wanted
    return np.where(hit, at, 0), hit


def slices(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of equal values in a sorted array."""
    if len(parts):
        first = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))
        for a, b in zip(first, [*first[1:], len(parts)], strict=True):
            yield int(parts[a]), slice(int(a), int(b))
