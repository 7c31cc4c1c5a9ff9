"""Flow, disparity and structured-array files as rows, and rows as such files. A file is read by one task, a row of pixels at a time."""

from __future__ import annotations

import io
import itertools
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PIXELS = "path string, v int, u int, value array<float>"


def decode_flow(data: bytes) -> np.ndarray:
    """(height, width, 2) of a .flo file: a mark, width, height, then pairs of 32-bit numbers."""
    mark, width, height = struct.unpack("<fii", data[:12])
    if mark != struct.unpack("<f", b"PIEH")[0]:
        raise ValueError("no .flo file")
    return np.frombuffer(data, "<f4", 2 * width * height, 12).reshape(height, width, 2)


def decode_float_map(data: bytes) -> np.ndarray:
    """(height, width, channels) of a .pfm file, whose rows run from the bottom; a negative scale says little-endian."""
    kind, size, scale, rest = data.split(b"\n", 3)
    width, height = map(int, size.split())
    channels = {b"PF": 3, b"Pf": 1}[kind.strip()]
    order = "<f4" if float(scale) < 0 else ">f4"
    return np.frombuffer(rest, order, width * height * channels).reshape(height, width, channels)[::-1]


def encode_flow(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    return b"PIEH" + struct.pack("<ii", width, height) + pixels.astype("<f4").tobytes()


def encode_float_map(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    return f"{'PF' if channels == 3 else 'Pf'}\n{width} {height}\n-1\n".encode() + pixels[::-1].astype("<f4").tobytes()


def decode_array(data: bytes) -> np.ndarray:
    """(height, width, channels) of a .npy file of two or three dimensions."""
    found = np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)
    return found[:, :, None] if found.ndim == 2 else found


def encode_array(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, pixels[:, :, 0] if pixels.shape[2] == 1 else pixels, allow_pickle=False)
    return out.getvalue()


PNG_MARK = b"\x89PNG\r\n\x1a\n"


def decode_png16(data: bytes) -> np.ndarray:
    """(height, width, channels) of an uninterlaced 16-bit PNG file of grey or RGB."""
    if data[:8] != PNG_MARK:
        raise ValueError("no PNG file")
    at, packed, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = head
    if depth != 16 or colour not in (0, 2) or interlaced:
        raise ValueError("only uninterlaced 16-bit grey or RGB")
    channels = 3 if colour == 2 else 1
    size = 2 * channels
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * size)
    out = np.zeros((height + 1, width + 1, size), np.uint8)
    for y in range(height):
        line, above, own = raw[y, 1:].reshape(width, size), out[y, 1:], out[y + 1, 1:]
        kind = raw[y, 0]
        if kind == 0:
            own[:] = line
        elif kind == 1:
            own[:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            own[:] = line + above
        else:
            for x in range(width):
                a, b, c = out[y + 1, x].astype(int), out[y, x + 1].astype(int), out[y, x].astype(int)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                own[x] = (line[x] + guess) & 255
    return out[1:, 1:].reshape(height, width * size).view(">u2").reshape(height, width, channels).astype(np.uint16)


def encode_png16(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    lines = np.ascontiguousarray(pixels.astype(">u2")).view(np.uint8).reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 16, 2 if channels == 3 else 0, 0, 0, 0)
    return PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(np.insert(lines, 0, 0, axis=1).tobytes(), 6)) + chunk(b"IEND", b"")


# Fixed values of the format: flow is kept as 64 steps a pixel around 2^15 with a mark of validity, disparity as 256 steps.
def decode_flow_png(data: bytes) -> np.ndarray:
    found = decode_png16(data).astype(np.float32)
    return np.where(found[:, :, 2:] > 0, (found[:, :, :2] - 2**15) / 64, np.float32(np.nan))


def encode_flow_png(pixels: np.ndarray) -> bytes:
    valid = np.isfinite(pixels[:, :, :2]).all(axis=2, keepdims=True)
    steps = np.clip(np.round(np.where(valid, pixels[:, :, :2], 0) * 64 + 2**15), 0, 2**16 - 1)
    return encode_png16(np.concatenate((np.where(valid, steps, 0), valid), axis=2))


def decode_disparity_png(data: bytes) -> np.ndarray:
    found = decode_png16(data)[:, :, :1].astype(np.float32)
    return np.where(found > 0, found / 256, np.float32(np.nan))


def encode_disparity_png(pixels: np.ndarray) -> bytes:
    known = np.isfinite(pixels[:, :, :1]) & (pixels[:, :, :1] > 0)
    return encode_png16(np.where(known, np.clip(np.round(np.where(known, pixels[:, :, :1], 0) * 256), 1, 2**16 - 1), 0))


DECODERS = {"flo": decode_flow, "pfm": decode_float_map, "npy": decode_array, "flow.png": decode_flow_png, "disp.png": decode_disparity_png}
ENCODERS = {"flo": encode_flow, "pfm": encode_float_map, "npy": encode_array, "flow.png": encode_flow_png, "disp.png": encode_disparity_png}


def dense_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, v, u, value) of files of a kind of DECODERS (their names' endings) below a path; a value that is not finite is null, its pixel stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                pixels = DECODERS[kind](data.as_py())
                for v, row in enumerate(pixels):
                    values = pa.array([x.tolist() if np.isfinite(x).all() else None for x in row.astype(np.float32)], pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(row)), pa.array([v] * len(row), pa.int32()), pa.array(np.arange(len(row), dtype=np.int32)), values], names=["path", "v", "u", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, PIXELS)


def flow_contents(pixels: DataFrame, name: str = "path") -> DataFrame:
    """(name, content): each image's pixels (v, u, value) as the bytes of a .flo file; missing pixels are infinite. An image is put together by one task."""
    schema = f"{name} string, content binary"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        v, u = (rows.column(c).to_numpy() for c in ("v", "u"))
        out = np.full((int(v.max()) + 1, int(u.max()) + 1, 2), np.inf, np.float32)
        for y, x, value in zip(v, u, rows.column("value").to_pylist(), strict=True):
            if value is not None:
                out[y, x] = value
        return pa.table({name: [key[0].as_py()], "content": pa.array([encode_flow(out)], pa.binary())})

    return pixels.select(name, "v", "u", "value").groupBy(name).applyInArrow(run, schema)


def structured_arrays(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """Rows of a structured array named `member` in .npz files below a path, by the schema's column names."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z, z.open(f"{member}.npy") as f:
                    rows = np.lib.format.read_array(f, allow_pickle=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[n])) for n in names], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, schema)


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


class DenseReader(DataSourceReader):
    """Reads only the columns that the schema asks for: without `value`, a flow file's pixels are not decoded into rows of arrays."""

    def __init__(self, path: str, kind: str, schema: StructType, files_per_task: int):
        self.path, self.kind, self.names, self.per_task = path, kind, schema.fieldNames(), files_per_task

    def partitions(self) -> list[Files]:
        fs, root = _files(self.path)
        found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(f".{self.kind}"))
        return [Files(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = _files(self.path)
        for path in partition.paths:
            with fs.open_input_stream(path, compression=None) as f:
                pixels = DECODERS[self.kind](f.read())
            name = path.removeprefix(root).lstrip("/")
            for v, row in enumerate(pixels):
                n = len(row)
                columns = {"path": lambda: pa.array([name] * n), "v": lambda: pa.array([v] * n, pa.int32()), "u": lambda: pa.array(np.arange(n, dtype=np.int32)), "value": lambda: _values(row)}  # noqa: B023
                yield pa.RecordBatch.from_arrays([columns[c]() for c in self.names], names=self.names)


def _values(row: np.ndarray) -> pa.Array:
    return pa.array([x.tolist() if np.isfinite(x).all() else None for x in row.astype(np.float32)], pa.list_(pa.float32()))


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class DenseWriter(DataSourceWriter):
    """Puts images together from rows sorted by path within tasks (repartition("path").sortWithinPartitions("path")), one in memory at a time.

    Files are written under names of the attempt's own, and get theirs once all
    tasks are done.
    """

    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite, self.work = path, kind, overwrite, f"_work-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = _files(self.path)
        own = f"{self.work}/{TaskContext.get().taskAttemptId()}"
        done: dict[str, str] = {}
        for name, rows in itertools.groupby(iterator, lambda r: r.path):
            if name in done:
                raise ValueError("rows of a path must stand together: sort by path within partitions")
            cells = [(r.v, r.u, r.value) for r in rows]
            channels = next((len(x) for *_, x in cells if x is not None), 2 if "flo" in self.kind else 1)
            image = np.full((max(v for v, *_ in cells) + 1, max(u for _, u, _ in cells) + 1, channels), np.inf if self.kind == "flo" else np.nan, np.float32)
            for v, u, x in cells:
                if x is not None:
                    image[v, u] = x
            done[name] = f"{own}/{len(done)}"
            fs.create_dir(f"{root}/{own}", recursive=True)
            with fs.open_output_stream(f"{root}/{done[name]}", compression=None) as f:
                f.write(ENCODERS[self.kind](image))
        return Written([(n if n.endswith(f".{self.kind}") else f"{n}.{self.kind}", a) for n, a in done.items()])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _files(self.path)
        names = [x for m in messages if m for x in m.names]
        if len({n for n, _ in names}) < len(names):
            raise ValueError("two tasks wrote the same path: repartition by path")
        for name, attempt in names:
            target = f"{root}/{name}"
            fs.create_dir(os.path.dirname(target), recursive=True)
            if fs.get_file_info(target).type != pafs.FileType.NotFound:
                if not self.overwrite:
                    raise ValueError(f"{name} is there already")
                fs.delete_file(target)
            fs.move(f"{root}/{attempt}", target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _files(self.path)
        if fs.get_file_info(f"{root}/{self.work}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.work}")


class DenseSource(DataSource):
    """Flow, disparity and array files as a Spark data source; options path, kind (of DECODERS), filesPerTask (16).

    spark.dataSource.register(DenseSource)
    spark.read.format("dense").schema("path string, v int").option("kind", "flo").load(folder)
    """

    @classmethod
    def name(cls) -> str:
        return "dense"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema: StructType) -> DenseReader:
        return DenseReader(self.options["path"], self._kind(), schema, int(self.options.get("filesPerTask", 16)))

    def writer(self, schema: StructType, overwrite: bool) -> DenseWriter:
        return DenseWriter(self.options["path"], self._kind(), overwrite)

    def _kind(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in DECODERS:
            raise ValueError(f"kind must be one of {sorted(DECODERS)}")
        return kind
