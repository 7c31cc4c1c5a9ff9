"""Archives, exports and steps: contents, repeated tasks and replayed batches."""

import os
import tarfile
import zipfile
from pathlib import Path

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from atlaspark.sources import archives


def frames(spark, tmp_path):
    rows = []
    for idx in (3, 12):
        for cam in ("cam1", "cam2"):
            p = tmp_path / "in" / cam / f"{idx}.JPG"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(f"{cam} {idx}".encode() * 1000)
            rows.append((idx, cam, str(p)))
    return spark.createDataFrame([*rows, (3, "cam1", rows[0][2]), (None, "cam1", "x"), (4, None, "x")], "idx int, cam string, path string")


def listing(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


@pytest.mark.parametrize("kind, store", [("zip", False), ("zip", True), ("tar", False), ("folder", False)])
def test_archives_hold_each_cameras_file_and_repeat_alike(spark, tmp_path, kind, store):
    df, root = frames(spark, tmp_path), tmp_path / "out"
    plan = archives.write_archives(df, str(root), kind, dry=True).collect()
    assert not root.exists() and all(r.bytes is None for r in plan) and len(plan) == 2
    done = archives.write_archives(df, str(root), kind, store=store)
    first = listing(root)
    want = {f"cam{c}.jpg": f"cam{c} 12".encode() * 1000 for c in (1, 2)}
    if kind == "zip":
        with zipfile.ZipFile(root / "00000012.zip") as z:
            assert {n: z.read(n) for n in z.namelist()} == want
    elif kind == "tar":
        with tarfile.open(root / "00000012.tar") as t:
            assert {m.name: t.extractfile(m).read() for m in t.getmembers()} == want
    else:
        assert {n.split("/")[1]: b for n, b in first.items() if n.startswith("00000012/")} == want
    assert len(first) == (4 if kind == "folder" else 2) and sum(r.bytes for r in done.collect()) == sum(map(len, first.values()))
    archives.write_archives(df, f"file://{root}", kind, store=store)
    assert listing(root) == first and archives.write_archives(df.limit(0), str(root), kind).count() == 0
    with pytest.raises(ValueError, match="kind"):
        archives.write_archives(df, str(root), "rar")


def test_a_failing_task_leaves_one_archive_and_no_other_file(spark, tmp_path):
    df, root, work = frames(spark, tmp_path), tmp_path / "out", tmp_path / "seen"
    work.mkdir()

    def broken_once(batches):
        # What a lost executor leaves: an attempt's file that no row names.
        own = root / "_work-lost" / str(TaskContext.get().taskAttemptId())
        own.mkdir(parents=True, exist_ok=True)
        (own / "00000003.zip").write_bytes(b"half")
        yield from batches

    archives.write_archives(df.mapInArrow(broken_once, df.schema), str(root), "zip")
    assert sorted(n for n in listing(root) if not n.startswith("_work-lost")) == ["00000003.zip", "00000012.zip"]
    with zipfile.ZipFile(root / "00000003.zip") as z:
        assert z.testzip() is None


@pytest.mark.parametrize("mode", ["copy", "move", "symlink"])
def test_exports(spark, tmp_path, mode):
    df = frames(spark, tmp_path).where("idx IS NOT NULL AND cam IS NOT NULL")
    manifest = df.select("path", F.concat("cam", F.lit("/"), F.lpad(F.col("idx").cast("string"), 8, "0"), F.lit(".jpg")).alias("target"))
    root = tmp_path / "out"
    assert archives.export_files(manifest, str(root), mode, dry=True).count() == 4 and not root.exists()
    assert archives.export_files(manifest, str(root), mode).count() == 4
    assert (root / "cam2/00000012.jpg").read_bytes() == b"cam2 12" * 1000
    assert os.path.islink(root / "cam1/00000003.jpg") == (mode == "symlink")
    assert (tmp_path / "in/cam1/3.JPG").exists() == (mode != "move")
    assert sorted(os.listdir(root)) == ["cam1", "cam2"]


def test_steps_are_published_once_and_again_without_a_change(spark, tmp_path):
    sink = archives.StepSink(str(tmp_path / "steps"), "motion > 0.5", 2)
    batch = lambda *m: spark.createDataFrame([(i, x) for i, x in enumerate(m)], "id int, motion double")
    sink.publish(batch(0.1), 0)
    sink.publish(batch(0.9, 0.8), 1)
    sink.publish(batch(0.9, 0.1), 3)
    assert [sink.provenance(k) and sink.provenance(k)["copied_from"] for k in range(4)] == [None, None, None, 1] and sink.provenance(2) is None
    rows = lambda k: sorted((r.id, r.motion) for r in sink.read(spark, k).collect())
    assert rows(3) == rows(1) == [(0, 0.9), (1, 0.8)] and rows(0) == [(0, 0.1)]
    before = listing(tmp_path / "steps")
    sink.publish(batch(0.9, 0.9, 0.9), 3)
    sink.publish(batch(0.9, 0.9, 0.9), 1)
    assert listing(tmp_path / "steps") == before
    # A try that broke before its mark is written over.
    os.remove(tmp_path / "steps/step=3/provenance.json")
    sink.publish(batch(0.9, 0.9, 0.9), 3)
    assert len(rows(3)) == 3 and sink.provenance(3)["reason"] == "new"


def test_a_stream_replayed_from_its_start_leaves_the_steps_as_they_were(spark, tmp_path):
    sink = archives.StepSink(str(tmp_path / "steps"), "motion > 0.5")
    for m in (0.9, 0.1, 0.7):
        spark.createDataFrame([(1, m)], "id int, motion double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go(place):
        source = spark.readStream.schema("id int, motion double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = source.writeStream.foreachBatch(sink.publish).option("checkpointLocation", str(tmp_path / place)).trigger(availableNow=True).start()
        q.awaitTermination(100)

    go("a")
    first = listing(tmp_path / "steps")
    assert sum(n.endswith("provenance.json") for n in first) == 3
    go("b")
    assert listing(tmp_path / "steps") == first
