"""WARC records in ZIP-packaged archives: a writer, and a reader that finds records by the ZIP directories.

An archive is a ZIP file whose members are stored, not packed: ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdx`` (page, offset and length of each record). The reader takes the end of the file, follows the ZIP64
locator where there is one, parses the central directory, finds the data of stored members behind their local headers,
and reads index and records by ranges; nothing is extracted. Files are opened through a file system URI, so local, HDFS
and S3 paths work alike.

Tasks write to names of their own partition and attempt, so no attempt touches the files of another, also if its rows come
in another order. The list of archives is a table that Spark commits one attempt a task to; only archives in it count,
and files of lost attempts stay unread. Archives are closed at ``ARCHIVE_BYTES``, so no task holds more than one of that size.

Edge cases: null html is an empty payload, null url an empty one; of records with equal payloads those with the largest
id are responses (all of them if rows repeat); a null id never wins; any payload length works; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluora.llm.common import cut, shared_dir

ARCHIVE_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PAGE = "urn:page:"
#: Fixed values of the ZIP format: signatures of the local header, central entry, end, ZIP64 end and ZIP64 locator.
LOCAL, ENTRY, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


def record(page_id, url: str, payload: bytes, digest: str, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; a revisit keeps the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE}{page_id}>", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Page, type, digest, referred page, length and payload (None for revisits) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page = lambda s: int(s[1:-1].removeprefix(PAGE)) if s[1:-1] != f"{PAGE}null" else None
    revisit = fields["WARC-Type"] == "revisit"
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": page(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pack(data: bytes, index: str, out) -> None:
    """Writes the ZIP; entries carry ZIP64 sizes, so that larger archives have the same layout."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, content in ((DATA, data), (INDEX, index.encode())):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            with z.open(info, "w", force_zip64=True) as f:
                f.write(content)


def directory(read_at, size: int) -> dict[str, tuple[int, int]]:
    """Name to (offset, length) of the data of all stored members; ``read_at(offset, length)`` reads a range."""
    tail_at = max(0, size - 65_557)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack("<HLL", tail[end + 10 : end + 20])
    if (count == 0xFFFF or 0xFFFFFFFF in (length, at)) and tail[end - 20 : end - 16] == LOCATOR:
        far = struct.unpack("<Q", tail[end - 12 : end - 4])[0]
        more = read_at(far, 56)
        if more[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, at = struct.unpack("<QQQ", more[32:56])
    entries, members, pos = read_at(at, length), {}, 0
    for _ in range(count):
        if entries[pos : pos + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, packed, real, n, m, k, local = struct.unpack("<10xH8xLLHHH8xL", entries[pos : pos + 46])
        name = entries[pos + 46 : pos + 46 + n].decode()
        extra, values = entries[pos + 46 + n : pos + 46 + n + m], []
        while len(extra) >= 4:
            kind, size_of = struct.unpack("<HH", extra[:4])
            if kind == 1:
                values = list(struct.unpack(f"<{size_of // 8}Q", extra[4 : 4 + size_of // 8 * 8]))
            extra = extra[4 + size_of :]
        real, packed, local = (values.pop(0) if v == 0xFFFFFFFF and values else v for v in (real, packed, local))
        if method == 0:
            head = read_at(local, 30)
            if head[:4] != LOCAL:
                raise ValueError("broken local header")
            members[name] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), packed)
        pos += 46 + n + m + k
    return members


def _open(uri: str):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    return fs, path


def write(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per page (page_id, url, html) to archives in ``folder``; their (uri, records, bytes).

    Payloads of at least ``least`` bytes are written once.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    twice = rows.where(F.length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("sha", "keep")
    rows = rows.join(twice, "sha", "left").withColumn("refers_to", F.when(~F.col("keep").eqNullSafe(F.col("page_id")), F.col("keep")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get(), []
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        data, index = io.BytesIO(), []

        def close() -> None:
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.wacz"
            out = io.BytesIO()
            pack(data.getvalue(), "".join(index), out)
            with fs.open_output_stream(f"{path}/{name}") as f:
                f.write(out.getbuffer())
            made.append((f"{folder}/{name}", len(index), out.tell()))
            data.seek(0)
            data.truncate()
            index.clear()

        for part in parts:
            for page_id, url, payload, keep in zip(part.page_id, part.url, part.payload, part.refers_to, strict=True):
                page = "null" if pd.isna(page_id) else int(page_id)
                whole = gzip.compress(record(page, url, payload, digest(payload), None if pd.isna(keep) else int(keep)), 1, mtime=0)
                index.append(f"{page} {data.tell()} {len(whole)}\n")
                data.write(whole)
                if data.tell() >= archive_bytes:
                    close()
        if index:
            close()
        yield pd.DataFrame(made, columns=["uri", "records", "bytes"])

    return cut(rows.select("page_id", "url", "payload", "refers_to").mapInPandas(run, "uri string, records long, bytes long"))


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in ``uri``; with ``payloads`` False lengths and digests only, checked all the same."""
    columns = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in columns.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for uri in (u for part in parts for u in part.uri):
            fs, path = _open(uri)
            with fs.open_input_file(path) as f:

                def read_at(at: int, n: int, f=f) -> bytes:
                    return f.read_at(n, at)

                members = directory(read_at, f.size())
                base, (at, n) = members[DATA][0], members[INDEX]
                rows = []
                for line in read_at(at, n).decode().splitlines():
                    _, start, length = line.split(" ")
                    r = parse(gzip.decompress(read_at(base + int(start), int(length))))
                    if r["payload"] is not None and (digest(r["payload"]), len(r["payload"])) != (r["payload_digest"], r["payload_bytes"]):
                        raise ValueError(f"{uri}: the payload of page {r['page_id']} is broken")
                    rows.append([r[c] for c in names])
                    if len(rows) >= 2000:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    n = max(1, archives.count())
    return archives.select("uri").repartition(n).mapInPandas(run, columns)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back; one row per page."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    out = read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
