"""Archives by timestamp, files by camera, and artefacts by step: written by tasks, seen only once committed."""

from __future__ import annotations

import io
import json
import os
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize

WRITTEN = "target string, attempt string, bytes long, members array<string>"
KINDS = ("zip", "tar", "folder")
#: Bytes of a file that a task copies at a time.
COPY = 1 << 22


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _copy(source: str, fs: pafs.FileSystem, target: str) -> int:
    own, path = _open(source)
    n = 0
    with own.open_input_stream(path, compression=None) as a, fs.open_output_stream(target, compression=None) as b:
        while data := a.read(COPY):
            b.write(data)
            n += len(data)
    return n


class _Zip:
    def __init__(self, stream, store: bool):
        self.file = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED if store else zipfile.ZIP_DEFLATED)

    def add(self, name: str, source: str) -> None:
        own, path = _open(source)
        # A fixed time: a task that is repeated writes the same bytes.
        with own.open_input_stream(path, compression=None) as a, self.file.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w") as b:
            while data := a.read(COPY):
                b.write(data)

    def close(self) -> None:
        self.file.close()


class _Tar:
    def __init__(self, stream, store: bool):
        self.file = tarfile.open(fileobj=stream, mode="w|")

    def add(self, name: str, source: str) -> None:
        own, path = _open(source)
        info = tarfile.TarInfo(name)
        info.size = own.get_file_info(path).size
        with own.open_input_stream(path, compression=None) as a:
            self.file.addfile(info, a)

    def close(self) -> None:
        self.file.close()


class _Sink(io.RawIOBase):
    """A stream that can only be written, for writers that ask where they are."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at


def _commit(written: DataFrame, root: str, work: str) -> DataFrame:
    """Give finished attempts their names; what is there already stays, so that a repeated task changes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        for batch in batches:
            for target, attempt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fs.get_file_info(f"{folder}/{attempt}").type != pafs.FileType.NotFound:
                    if fs.get_file_info(f"{folder}/{target}").type != pafs.FileType.NotFound:
                        fs.delete_file(f"{folder}/{target}")
                    fs.create_dir(os.path.dirname(f"{folder}/{target}"), recursive=True)
                    fs.move(f"{folder}/{attempt}", f"{folder}/{target}")
            yield batch

    done = materialize(written.mapInArrow(run, WRITTEN))
    fs, folder = _open(root)
    if fs.get_file_info(f"{folder}/{work}").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{folder}/{work}")  # what failed or second attempts have left
    return done.select("target", "bytes", "members")


def write_archives(frames: DataFrame, root: str, kind: str = "zip", pad: int = 8, store: bool = False, dry: bool = False) -> DataFrame:
    """One archive for each idx of frames (idx, cam, path), named by idx with `pad` digits, its members camera + the file's ending; (target, bytes, members).

    kind: zip (stored without compression if asked), tar, or a folder of files.
    An archive is put together by one task as a stream, a few megabytes in
    memory, under a name of the attempt's own; it gets its name once all are
    written, and a repeated or lost task leaves one archive. dry writes nothing
    and leaves bytes null. Of a camera's files for an idx the last by path
    counts; rows with a null take no part.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    known = frames.where("idx IS NOT NULL AND cam IS NOT NULL AND path IS NOT NULL")
    one = known.groupBy("idx", F.col("cam").cast("string").alias("cam")).agg(F.max("path").alias("path"))
    member = F.concat("cam", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    # As many members as there are cameras.
    plan = one.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct(member.alias("name"), "path"))).alias("m"))
    name = F.lpad(F.col("idx").cast("string"), pad, "0")
    if dry:
        return plan.select((name if kind == "folder" else F.concat(name, F.lit(f".{kind}"))).alias("target"), F.lit(None).cast("long").alias("bytes"), F.col("m.name").alias("members"))
    work = f"_work-{uuid.uuid4().hex}"
    files = plan.select(name.alias("name"), F.col("m.name").alias("names"), F.col("m.path").alias("paths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        own = f"{work}/{TaskContext.get().taskAttemptId()}"
        fs.create_dir(f"{folder}/{own}", recursive=True)
        for batch in batches:
            rows = []
            for name_, names, paths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "folder":
                    for n, p in zip(names, paths, strict=True):
                        attempt = f"{own}/{name_}-{n}"
                        rows.append((f"{name_}/{n}", attempt, _copy(p, fs, f"{folder}/{attempt}"), [n]))
                    continue
                attempt = f"{own}/{name_}.{kind}"
                with fs.open_output_stream(f"{folder}/{attempt}", compression=None) as stream:
                    sink = _Sink(stream)
                    archive = {"zip": _Zip, "tar": _Tar}[kind](sink, store)
                    for n, p in zip(names, paths, strict=True):
                        archive.add(n, p)
                    archive.close()
                rows.append((f"{name_}.{kind}", attempt, sink.at, names))
            if rows:
                yield _written(rows)

    return _commit(materialize(files.mapInArrow(run, WRITTEN)), root, work)


def _written(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["target", "attempt", "bytes", "members"])


def export_files(manifest: DataFrame, root: str, mode: str = "copy", dry: bool = False) -> DataFrame:
    """Files of a manifest (path, target) put below root: copied, moved (sources go once all are there) or linked; (target, bytes, members).

    Of rows with the same target the last by path counts. Links need a root on
    a mounted file system.
    """
    if mode not in ("copy", "move", "symlink"):
        raise ValueError("mode must be copy, move or symlink")
    plan = manifest.where("path IS NOT NULL AND target IS NOT NULL").groupBy("target").agg(F.max("path").alias("path"))
    if dry:
        return plan.select("target", F.lit(None).cast("long").alias("bytes"), F.array("path").alias("members"))
    work = f"_work-{uuid.uuid4().hex}"
    plan = materialize(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        own = f"{work}/{TaskContext.get().taskAttemptId()}"
        fs.create_dir(f"{folder}/{own}", recursive=True)
        for batch in batches:
            rows = []
            for i, (target, path) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                attempt = f"{own}/{i}-{uuid.uuid4().hex}"
                if mode == "symlink":
                    source = _open(path)[1]
                    os.symlink(source, f"{folder}/{attempt}")
                    rows.append((target, attempt, os.path.getsize(source), [path]))
                else:
                    rows.append((target, attempt, _copy(path, fs, f"{folder}/{attempt}"), [path]))
            if rows:
                yield _written(rows)

    done = _commit(materialize(plan.select("target", "path").mapInArrow(run, WRITTEN)), root, work)
    if mode == "move":

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    fs, at = _open(path)
                    if fs.get_file_info(at).type != pafs.FileType.NotFound:
                        fs.delete_file(at)
                yield batch

        materialize(plan.select("path").distinct().mapInArrow(drop, "path string"))
    return done


class StepSink:
    """Artefacts of each step of a stream below a folder; a step without a change publishes those of the step before again.

    publish(batch, batch_id) suits foreachBatch. A step is `step=<id>`, with
    Parquet of its artefacts and provenance.json, which is written last and
    marks the step as there: a batch that comes again changes nothing, and what
    a broken try has left is written over. `changed` (a condition) says which
    rows of a batch are a change; fewer than `least` of them are none. The
    first step is always written.
    """

    def __init__(self, root: str, changed: str = "true", least: int = 1):
        self.root, self.changed, self.least = root.rstrip("/"), changed, least

    def provenance(self, step: int) -> dict | None:
        fs, folder = _open(self.root)
        path = f"{folder}/step={step}/provenance.json"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def before(self, step: int) -> int | None:
        """The last published step before one."""
        fs, folder = _open(self.root)
        if fs.get_file_info(folder).type == pafs.FileType.NotFound:
            return None
        names = [os.path.basename(f.path) for f in fs.get_file_info(pafs.FileSelector(folder))]
        known = sorted((int(n[5:]) for n in names if n.startswith("step=") and n[5:].isdigit() and int(n[5:]) < step), reverse=True)
        return next((k for k in known if self.provenance(k) is not None), None)

    def publish(self, batch: DataFrame, step: int) -> None:
        if self.provenance(step) is not None:
            return
        last = self.before(step)
        n = batch.where(self.changed).count()
        clone = last is not None and n < self.least
        rows = self.read(batch.sparkSession, last) if clone else batch
        rows.write.mode("overwrite").parquet(f"{self.root}/step={step}/rows")
        note = {"step": step, "changed": n, "copied_from": last if clone else None, "reason": "no change" if clone else "new"}
        fs, folder = _open(self.root)
        own = f"{folder}/step={step}/.provenance-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(json.dumps(note, sort_keys=True).encode())
        fs.move(own, f"{folder}/step={step}/provenance.json")

    def read(self, spark, step: int) -> DataFrame:
        return spark.read.parquet(f"{self.root}/step={step}/rows")
