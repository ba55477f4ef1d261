"""Frames of TIFF stacks and uncompressed AVI files, page by page.

A first pass reads only where the pages are: directories of a TIFF file, chunk heads of an AVI file, a file a task. The
pages are then dealt to tasks by their bytes, and each task reads the ranges it needs, so that one long file spreads over
many. Files are opened by their URI.

TIFF: classic and BigTIFF, strips without compression or with LZW, Deflate or PackBits, with or without horizontal
differences; integers of 8, 16 and 32 bits and floats of 32 and 64. AVI: RGB rows of 8, 24 or 32 bits. Colour becomes luma
(weights 0.299, 0.587, 0.114) if there are three samples at least, else the first sample counts. Other codecs need
libraries that aren't there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluora.functions.shared import checkpoint

#: Fixed values of the TIFF format: numbers of tags, sizes of values by type, codes of compression.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANES, PREDICTOR, TILES, SAMPLE_FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 339
TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
LUMA = (0.299, 0.587, 0.114)
#: Bytes that are read at once while looking for pages, and bytes of pages that a task decodes.
AHEAD, TASK_BYTES = 1 << 16, 64 << 20
#: Bytes from which on a written stack is a BigTIFF file.
BIG = 0xF0000000
PAGES = "file string, frame long, h int, w int, samples int, kind string, compression int, predictor int, rows int, starts array<long>, sizes array<long>"

Read = Callable[[int, int], bytes]


def opened(uri: str):
    """A file of any store that has a URI, for reading at any place."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")
    return fs.open_input_file(path)


def ahead(file) -> Read:
    """Reads ranges by larger ones, of which the last is kept."""
    kept = [0, b""]

    def read(at: int, n: int) -> bytes:
        if not kept[0] <= at <= at + n <= kept[0] + len(kept[1]):
            file.seek(at)
            kept[:] = [at, file.read(max(n, AHEAD))]
        return kept[1][at - kept[0] : at - kept[0] + n]

    return read


def tiff_directory(read: Read) -> Iterator[dict]:
    """The pages of a TIFF file: size, kind of samples, and where their strips are."""
    order = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    version = struct.unpack(order + "H", read(2, 2))[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    offset, count, entry, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    wide, head = struct.calcsize(offset), struct.calcsize(count)
    at, seen = struct.unpack(order + offset, read(8 if big else 4, wide))[0], set()
    while at:
        if at in seen:
            raise ValueError("the page directory runs in a circle")
        seen.add(at)
        n = struct.unpack(order + count, read(at, head))[0]
        body, tags = read(at + head, entry * n + wide), {}
        for i in range(n):
            tag, kind, many = struct.unpack(order + "HH" + offset, body[entry * i : entry * i + 4 + wide])
            if kind in TYPES:
                size, field = struct.calcsize(TYPES[kind]) * many, body[entry * i + 4 + wide : entry * (i + 1)]
                raw = field[:size] if size <= inline else read(struct.unpack(order + offset, field)[0], size)
                tags[tag] = struct.unpack(f"{order}{many}{TYPES[kind]}", raw)
        one = lambda tag, default, tags=tags: tags.get(tag, (default,))[0]
        samples, bits, form = one(SAMPLES, 1), one(BITS, 8), {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
        if TILES in tags or form is None or bits not in (8, 16, 32, 64) or samples > 1 and one(PLANES, 1) != 1 or one(COMPRESSION, PLAIN) not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS):
            raise ValueError("pages of this kind aren't understood")
        yield {"h": one(HEIGHT, 0), "w": one(WIDTH, 0), "samples": samples, "kind": f"{order}{form}{bits // 8}", "compression": one(COMPRESSION, PLAIN), "predictor": one(PREDICTOR, 1), "rows": min(one(ROWS, one(HEIGHT, 0)), one(HEIGHT, 0)), "starts": list(tags[STRIPS]), "sizes": list(tags[STRIP_BYTES])}
        at = struct.unpack(order + offset, body[entry * n :])[0]


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: runs of repeated and of plain bytes."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n == 128:  # stands for nothing
            i += 1
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, the highest bit first; 256 empties the table, 257 ends."""
    table, out, last = [], bytearray(), b""
    bits, held, have = 9, 0, 0
    for byte in data:
        held, have = held << 8 | byte, have + 8
        if have < bits:
            continue
        have -= bits
        code, held = held >> have, held & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            table, bits, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        bits = min(12, max(9, (len(table) + 1).bit_length()))  # a code early
    return bytes(out)


UNPACK = {PLAIN: bytes, LZW: unpacked_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpacked_bits}


def gray(page: np.ndarray) -> np.ndarray:
    """(h, w) of (h, w, samples)."""
    return page[:, :, :3] @ np.array(LUMA) if page.shape[2] >= 3 else page[:, :, 0].astype(float)


def tiff_page(read: Read, p) -> np.ndarray:
    """The page (h, w) of a row of the directory."""
    parts = []
    for i, (at, n) in enumerate(zip(p.starts, p.sizes, strict=True)):
        rows = min(p.rows, p.h - i * p.rows)
        raw = UNPACK[p.compression](read(at, n))
        strip = np.frombuffer(raw, p.kind, rows * p.w * p.samples).reshape(rows, p.w, p.samples)
        parts.append(np.cumsum(strip, axis=1, dtype=strip.dtype) if p.predictor == 2 else strip)
    return gray(np.concatenate(parts).astype(float))


def avi_directory(read: Read, length: int) -> Iterator[dict]:
    """The frames of an uncompressed AVI file, found from the heads of its chunks (also of several RIFF parts)."""
    if read(0, 4) != b"RIFF" or read(8, 4) != b"AVI ":
        raise ValueError("not an AVI file")
    at, image = 0, None
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", read(at, 8))
        if name == b"RIFF" or name == b"LIST" and read(at + 8, 4) in (b"hdrl", b"strl", b"movi", b"rec "):
            at += 12
            continue
        if name == b"strf" and image is None:  # of the first stream
            _, w, h, _, bits, codec = struct.unpack("<IiiHH4s", read(at + 8, 20))
            if codec not in (b"\0\0\0\0", b"DIB ") or bits not in (8, 24, 32):
                raise ValueError("frames of this codec aren't understood")
            image = {"h": abs(h), "w": w, "samples": bits // 8, "kind": "|u1", "compression": PLAIN, "predictor": 1 if h > 0 else -1, "rows": abs(h)}
        elif name in (b"00db", b"00dc") and image is not None and size:
            yield {**image, "starts": [at + 8], "sizes": [size]}
        at += 8 + size + size % 2


def avi_page(read: Read, p) -> np.ndarray:
    """The frame (h, w) of a row of the directory; rows fill up to four bytes, the lowest comes first if the height is positive."""
    line = -(-p.w * p.samples // 4) * 4
    page = np.frombuffer(read(p.starts[0], p.sizes[0]), np.uint8, line * p.h).reshape(p.h, line)[:, : p.w * p.samples].reshape(p.h, p.w, p.samples)
    page = page[::-1] if p.predictor == 1 else page
    return gray(page[:, :, 2::-1] if p.samples >= 3 else page)  # blue comes first


FORMATS = {".tif": "tiff", ".tiff": "tiff", ".avi": "avi"}


def _format(name: Column | str):
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return F.coalesce(*[F.when(ext == e, F.lit(f)) for e, f in FORMATS.items()])


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, ...): where the pages of the files under a path are; no page is read. Other kinds of files are an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, kind, length in zip(part.path, part.format, part.length, strict=True):
                if kind is None:
                    raise ValueError(f"files of this kind aren't read: {file}")
                with opened(file) as f:
                    read = ahead(f)
                    found = list(tiff_directory(read) if kind == "tiff" else avi_directory(read, int(length)))
                if found:
                    yield pd.DataFrame(found).assign(file=file, frame=range(len(found)))[[c.split()[0] for c in PAGES.split(", ")]]

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # contents aren't read
    return files.withColumn("format", _format("path")).mapInPandas(run, PAGES)


def frame_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, frames) of the files under a path, without decoding."""
    return pages(spark, path).groupBy("file").agg(F.count("*").alias("frames"))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, h, w, px) of the TIFF stacks and AVI files under a path."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file = None, None
        try:
            for part in parts:
                for p in part.itertuples(index=False):
                    if p.file != name:
                        if file is not None:
                            file.close()
                        name, file = p.file, opened(p.file)

                    def read(at: int, n: int, file=file) -> bytes:
                        file.seek(at)
                        return file.read(n)

                    page = (tiff_page if p.format == "tiff" else avi_page)(read, p)
                    yield pd.DataFrame({"file": [p.file], "frame": [p.frame], "h": [p.h], "w": [p.w], "px": [page.ravel()]})
        finally:
            if file is not None:
                file.close()

    found = checkpoint(pages(spark, path).withColumn("format", _format("file")))
    size = found.agg(F.sum(F.col("h").cast("long") * F.col("w") * 8)).first()[0] or 0
    found = found.repartitionByRange(max(1, -(-size // TASK_BYTES)), "file", "frame").sortWithinPartitions("file", "frame")
    return found.mapInPandas(run, "file string, frame long, h int, w int, px array<double>")


def tiff_frames(spark: SparkSession, path: str) -> DataFrame:
    """The same, for a path that holds TIFF stacks."""
    return frames(spark, path)


def write_tiff(pages: list[np.ndarray]) -> bytes:
    """Gray pages of one type as an uncompressed little-endian stack."""
    return b"".join(tiff_bytes(iter(pages), sum(p.nbytes for p in pages) > BIG))


def tiff_bytes(pages: Iterator[np.ndarray], big: bool = False) -> Iterator[bytes]:
    """The bytes of a stack, page by page: a directory first, then its page, so that nothing has to be changed later."""
    offset, many, head = ("Q", "<Q", struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16)) if big else ("I", "<H", struct.pack("<2sHI", b"II", 42, 8))
    yield head if (page := next(pages, None)) is not None else head[:-8] + bytes(8) if big else head[:-4] + bytes(4)
    at = len(head)
    while page is not None:
        after = next(pages, None)
        a = np.ascontiguousarray(page, page.dtype.newbyteorder("<"))
        tags = [(WIDTH, 4, a.shape[1]), (HEIGHT, 4, a.shape[0]), (BITS, 3, a.dtype.itemsize * 8), (COMPRESSION, 3, PLAIN), (STRIPS, 16 if big else 4, None), (SAMPLES, 3, 1), (ROWS, 4, a.shape[0]), (STRIP_BYTES, 16 if big else 4, a.nbytes), (SAMPLE_FORMAT, 3, {"u": 1, "i": 2, "f": 3}[a.dtype.kind])]
        start = at + struct.calcsize(many) + len(tags) * (20 if big else 12) + struct.calcsize(offset)
        end = start + a.nbytes + a.nbytes % 2
        body = b"".join(struct.pack(f"<HH{offset}{offset}", tag, kind, 1, start if value is None else value) for tag, kind, value in tags)
        yield struct.pack(many, len(tags)) + body + struct.pack("<" + offset, 0 if after is None else end)
        yield a.tobytes() + bytes(a.nbytes % 2)
        page, at = after, end


def avi_bytes(pages: Iterator[np.ndarray], n: int, h: int, w: int, fps: float = 10.0) -> Iterator[bytes]:
    """The bytes of n gray frames of 8 bits as an uncompressed AVI file, frame by frame; of at most 4 GB."""
    line = -(-w // 4) * 4
    chunk = 8 + line * h
    if n * (chunk + 16) + 4096 > 0xFFFFFFFF:
        raise ValueError("the file would be larger than its format allows")
    pack = lambda name, body: struct.pack("<4sI", name, len(body)) + body
    main = struct.pack("<14I", round(1e6 / fps), round(line * h * fps), 0, 0x10, n, 0, 1, line * h, w, h, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"DIB ", 0, 0, 0, 0, 1000, round(1000 * fps), 0, n, line * h, 0, 0, 0, 0, w, h)
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256))
    form = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 8, b"\0\0\0\0", line * h, 0, 0, 256, 0) + palette
    head = pack(b"LIST", b"hdrl" + pack(b"avih", main) + pack(b"LIST", b"strl" + pack(b"strh", stream) + pack(b"strf", form)))
    yield struct.pack("<4sI4s", b"RIFF", 4 + len(head) + 12 + n * chunk + 8 + 16 * n, b"AVI ") + head + struct.pack("<4sI4s", b"LIST", 4 + n * chunk, b"movi")
    for page in pages:
        rows = np.zeros((h, line), np.uint8)
        rows[:, :w] = page[::-1]
        yield struct.pack("<4sI", b"00db", line * h) + rows.tobytes()
    yield struct.pack("<4sI", b"idx1", 16 * n) + b"".join(struct.pack("<4sIII", b"00db", 0x10, 4 + i * chunk, line * h) for i in range(n))


def write_frames(rows: DataFrame, folder: str, kind: str = "f8", container: str = "tif", fps: float = 10.0) -> DataFrame:
    """Writes (file, frame, h, w, px) as a stack (``tif``) or gray video (``avi``) per file into a folder; returns (path, frames).

    ``kind`` is the type of a stack's samples; integers are rounded and cut to their range. A file is a stream of bytes and
    so written by one task, but frame by frame from sorted rows: the task holds one or two frames.
    """
    if container not in ("tif", "avi"):
        raise ValueError(f"no such container: {container}")
    dtype = np.dtype("u1" if container == "avi" else kind)

    def image(r) -> np.ndarray:
        a = np.asarray(r.px, float).reshape(r.h, r.w)
        return a.astype(dtype) if dtype.kind == "f" else np.clip(np.rint(a), np.iinfo(dtype).min, np.iinfo(dtype).max).astype(dtype)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from itertools import groupby

        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        for file, own in groupby((r for part in parts for r in part.itertuples(index=False)), key=lambda r: r.file):
            first = next(own)
            fs.create_dir(root, recursive=True)
            name = f"{str(file).rsplit('/', 1)[-1].rsplit('.', 1)[0]}.{container}"

            def images(first=first, own=own) -> Iterator[np.ndarray]:
                yield image(first)
                yield from map(image, own)

            data = avi_bytes(images(), int(first.n), first.h, first.w, fps) if container == "avi" else tiff_bytes(images(), int(first.n) * first.h * first.w * dtype.itemsize > BIG)
            with fs.open_output_stream(f"{root}/{name}") as f:
                for b in data:
                    f.write(b)
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "frames": [first.n]})

    counts = rows.groupBy("file").agg(F.count("*").alias("n"))
    dealt = rows.select("file", "frame", "h", "w", "px").join(counts, "file").repartition("file").sortWithinPartitions("file", "frame")
    return dealt.mapInPandas(run, "path string, frames long")
