"""Stacks and videos: ranges of pages, codecs against plain encoders, round trips over several tasks."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluora.sources import video


def lzw(data: bytes) -> bytes:
    """A plain encoder with codes of 9 to 12 bits, a code early."""
    out, have, bits = 0, 0, []

    def put(code, n):
        bits.append((code, n))

    table, n = {bytes([i]): i for i in range(256)}, 9
    put(256, n)
    now = b""
    for i in range(len(data)):
        b = data[i : i + 1]
        if now + b in table:
            now += b
            continue
        put(table[now], n)
        table[now + b] = len(table) + 2
        size = len(table) + 2
        n = 10 if 512 <= size < 1024 else 11 if 1024 <= size < 2048 else 12 if size >= 2048 else 9
        if size >= 4094:
            put(256, n)
            table, n = {bytes([i]): i for i in range(256)}, 9
        now = b
    if now:
        put(table[now], n)
        size = len(table) + 3
        n = 10 if 512 <= size < 1024 else 11 if 1024 <= size < 2048 else 12 if size >= 2048 else 9
    put(257, n)
    for code, k in bits:
        out, have = out << k | code, have + k
    return (out << (-have % 8)).to_bytes((have + 7) // 8, "big")


def packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and data[i + run : i + run + 1] == data[i : i + 1]:
            run += 1
        if run > 1:
            out += bytes([257 - run]) + data[i : i + 1]
            i += run
        else:
            out += bytes([0]) + data[i : i + 1] + b"\x80" * (i % 3 == 0)  # 128 stands for nothing
            i += 1
    return bytes(out)


def stack(pages, order="<", compression=1, predictor=1, rows=None, big=False):
    """A stack made plainly: strips, then directories behind them."""
    pack = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}[compression]
    offset = "Q" if big else "I"
    out = bytearray(struct.pack(order + "2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 0) if big else struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 8 if big else 4
    for p in pages:
        a = p.reshape(p.shape[0], p.shape[1], -1)
        if predictor == 2:
            a = np.diff(a, axis=1, prepend=np.zeros_like(a[:, :1]))
        a = a.astype(a.dtype.newbyteorder(order))
        each, starts, sizes = rows or len(a), [], []
        for i in range(0, len(a), each):
            body = pack(a[i : i + each].tobytes())
            starts.append(len(out))
            sizes.append(len(body))
            out += body
        tags = {256: [p.shape[1]], 257: [p.shape[0]], 258: [a.dtype.itemsize * 8] * a.shape[2], 259: [compression], 273: starts, 277: [a.shape[2]], 278: [each], 279: sizes, 317: [predictor], 339: [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * a.shape[2]}
        entries = b""
        for tag, values in tags.items():
            raw = struct.pack(f"{order}{len(values)}I", *values)
            if len(raw) > struct.calcsize(offset):
                at = len(out)
                out += raw
                raw = struct.pack(order + offset, at)
            entries += struct.pack(order + "HH" + offset, tag, 4, len(values)) + raw.ljust(struct.calcsize(offset), b"\0")
        out[link : link + struct.calcsize(offset)] = struct.pack(order + offset, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries
        link = len(out)
        out += bytes(struct.calcsize(offset))
    return bytes(out)


def test_kinds_of_pages(spark, tmp_path):
    rng = np.random.default_rng(1)
    smooth = np.add.outer(np.arange(70), np.arange(90))
    kinds = {
        "plain.tif": ([smooth.astype(np.uint16) + i for i in range(3)], {}),
        "lzw.tif": ([rng.integers(0, 4, (70, 90)).astype(np.uint8), rng.integers(0, 256, (70, 90)).astype(np.uint8)], {"compression": 5, "rows": 50}),
        "diff.tiff": ([smooth.astype(np.uint16), rng.integers(0, 65536, (9, 11)).astype(np.uint16)], {"compression": 5, "predictor": 2, "order": ">", "rows": 7}),
        "deflate.TIF": ([rng.random((6, 5)).astype(np.float32)], {"compression": 8, "big": True}),
        "pack.tif": ([rng.integers(0, 2, (30, 40)).astype(np.uint8)], {"compression": 32773, "rows": 4, "big": True, "order": ">"}),
        "colour.tif": ([rng.integers(0, 256, (8, 9, 3)).astype(np.uint8), rng.integers(0, 256, (8, 9, 2)).astype(np.uint8)], {}),
        "signed.tif": ([rng.integers(-9, 9, (4, 4)).astype(np.int32), rng.random((4, 4))], {}),
    }
    for name, (pages, how) in kinds.items():
        (tmp_path / name).write_bytes(stack(pages, **how))
    got = {(r.file.rsplit("/", 1)[-1], r.frame): np.reshape(r.px, (r.h, r.w)) for r in video.frames(spark, str(tmp_path)).collect()}
    for name, (pages, _) in kinds.items():
        for i, p in enumerate(pages):
            want = p @ np.array([0.299, 0.587, 0.114]) if p.ndim == 3 and p.shape[2] == 3 else p.reshape(p.shape[0], p.shape[1], -1)[:, :, 0]
            assert np.allclose(got.pop((name, i)), want), (name, i)
    assert not got
    assert {r.file.rsplit("/", 1)[-1]: r.frames for r in video.frame_counts(spark, str(tmp_path)).collect()} == {n: len(p) for n, (p, _) in kinds.items()}


def test_a_long_file_spreads_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(video, "TASK_BYTES", 1 << 16)
    pages = [np.full((16, 16), i, np.uint16) for i in range(500)]
    (tmp_path / "a.tif").write_bytes(video.write_tiff(pages))
    out = video.frames(spark, str(tmp_path / "a.tif")).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() >= 10
    assert [(r.frame, r.v) for r in out.selectExpr("frame", "px[255] v").orderBy("frame").collect()] == [(i, float(i)) for i in range(500)]


def test_round_trips(spark, tmp_path):
    rng = np.random.default_rng(2)
    images = {"x/one.tif": rng.uniform(-5, 300, (7, 5, 6)), "two.avi": rng.uniform(0, 255, (4, 3, 7))}
    rows = [(f, i, *v.shape, v.ravel().tolist()) for f, vs in images.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "file string, frame long, h int, w int, px array<double>").repartition(3)
    for container, kind, to in (("tif", "f8", lambda v: v), ("tif", "u1", lambda v: np.clip(np.rint(v), 0, 255)), ("avi", "f8", lambda v: np.clip(np.rint(v), 0, 255))):
        folder = f"file://{tmp_path}/{container}{kind}"
        paths = {r.path: r.frames for r in video.write_frames(df, folder, kind, container).collect()}
        assert paths == {f"{folder}/one.{container}": 7, f"{folder}/two.{container}": 4}
        got = {(r.file.rsplit("/", 1)[-1].rsplit(".", 1)[0], r.frame): np.reshape(r.px, (r.h, r.w)) for r in video.frames(spark, folder).collect()}
        assert len(got) == 11
        for f, vs in images.items():
            for i, v in enumerate(vs):
                assert np.allclose(got[f.rsplit("/", 1)[-1].rsplit(".", 1)[0], i], to(v))
    big = b"".join(video.tiff_bytes(iter([np.arange(6.0).reshape(2, 3)] * 2), big=True))
    (tmp_path / "big.tif").write_bytes(big)
    assert [r.px for r in video.frames(spark, str(tmp_path / "big.tif")).collect()] == [list(range(6))] * 2
    assert list(video.tiff_directory(lambda at, n, data=video.write_tiff([]): data[at : at + n])) == []


def test_other_files_are_errors(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"....")
    with pytest.raises(Exception, match="aren't read"):
        video.frame_counts(spark, str(tmp_path / "a.mp4")).collect()
    (tmp_path / "b.tif").write_bytes(b"no stack at all")
    with pytest.raises(Exception, match="not a TIFF"):
        video.frame_counts(spark, str(tmp_path / "b.tif")).collect()
    colour = bytearray(b"".join(video.avi_bytes(iter([np.zeros((2, 4), np.uint8)]), 1, 2, 4)))
    at = colour.index(b"strf") + 8
    colour[at + 16 : at + 20] = b"MJPG"
    (tmp_path / "c.avi").write_bytes(bytes(colour))
    with pytest.raises(Exception, match="codec"):
        video.frame_counts(spark, str(tmp_path / "c.avi")).collect()
