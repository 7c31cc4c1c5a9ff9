"""Round trips of dense files through the data source."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlaspark.sources import dense


def images(kind):
    r = np.random.default_rng(3)
    channels = {"flo": 2, "flow.png": 2, "disp.png": 1, "pfm": 3, "npy": 1}[kind]
    out = {}
    for k in range(3):
        x = r.uniform(-40, 40, (5 + k, 7, channels)).astype(np.float32)
        if kind.endswith("png"):
            x = np.round(np.abs(x) * 64 + 1) / 64 if channels == 1 else np.round(x * 64) / 64
        out[f"a{k}/im{k}.{kind}"] = x.astype(np.float32)
    return out


@pytest.mark.parametrize("kind", sorted(dense.DECODERS))
def test_each_kind_comes_back(spark, tmp_path, kind):
    spark.dataSource.register(dense.DenseSource)
    rows = [(n, v, u, [float(c) for c in x[v, u]]) for n, x in images(kind).items() for v in range(x.shape[0]) for u in range(x.shape[1])]
    hole = (rows[9][0], rows[9][1], rows[9][2])
    df = spark.createDataFrame([r if r[:3] != hole else (*hole, None) for r in rows], dense.PIXELS)
    sorted_ = df.repartition(3, "path").sortWithinPartitions("path", F.desc("u"))
    for _ in range(2):
        sorted_.write.format("dense").option("kind", kind).mode("overwrite" if _ else "append").save(str(tmp_path / "out"))
    got = {(r.path, r.v, r.u): r.value for r in spark.read.format("dense").option("kind", kind).option("filesPerTask", 2).load(str(tmp_path / "out")).collect()}
    assert got.pop(hole) is None and len(got) == len(rows) - 1
    assert all(np.allclose(got[r[:3]], r[3]) for r in rows if r[:3] != hole)
    assert sorted(os.listdir(tmp_path / "out")) == ["a0", "a1", "a2"]
    again = {(r.v, r.u): r.value for r in dense.dense_files(spark, str(tmp_path / "out/a1"), kind).collect()}
    assert again == {k[1:]: v for k, v in got.items() if k[0].startswith("a1/")}
    few = spark.read.format("dense").schema("v int, path string").option("kind", kind).load(str(tmp_path / "out"))
    assert few.columns == ["v", "path"] and few.groupBy("path").agg(F.max("v")).count() == 3
    with pytest.raises(Exception, match="there already"):
        sorted_.write.format("dense").option("kind", kind).mode("append").save(str(tmp_path / "out"))
    assert not [n for n in os.listdir(tmp_path / "out") if n.startswith("_work")]


def test_odd_kinds_and_empty_folders(spark, tmp_path):
    spark.dataSource.register(dense.DenseSource)
    assert spark.read.format("dense").option("kind", "flo").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="kind must be"):
        spark.read.format("dense").option("kind", "tiff").load(str(tmp_path)).count()
    with pytest.raises(ValueError, match="PNG"):
        dense.decode_png16(b"x" * 20)


def test_every_png_filter():
    r = np.random.default_rng(1)
    pixels = r.integers(0, 1 << 16, (10, 6, 3)).astype(np.uint16)
    raw = pixels.astype(">u2").view(np.uint8).reshape(10, 36).astype(int)
    lines = []
    for y in range(10):
        kind = y % 5
        line = [kind]
        for i in range(36):
            a = raw[y, i - 6] if i >= 6 else 0
            b = raw[y - 1, i] if y else 0
            c = raw[y - 1, i - 6] if y and i >= 6 else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((raw[y, i] - [0, a, b, (a + b) // 2, near][kind]) & 255)
        lines.append(bytes(line))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(b"".join(lines))
    data = dense.PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 10, 16, 2, 0, 0, 0)) + chunk(b"IDAT", packed[:40]) + chunk(b"IDAT", packed[40:]) + chunk(b"IEND", b"")
    assert (dense.decode_png16(data) == pixels).all() and (dense.decode_png16(dense.encode_png16(pixels)) == pixels).all()
