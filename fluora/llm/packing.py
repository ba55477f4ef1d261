"""Best-two-fit packing of documents into token sequences.

Documents become token ids in one pass, which cuts the long ones into pieces and numbers the pieces of each length within
the pass's tasks. The plan of the packing is made on the histogram of lengths, which has at most as many rows as a
sequence has tokens, whatever the corpus: a sequence starts with the longest document left and takes the longest one that
fits, again and again; then its shortest document gives way to the two that fill the gap with it best, if they leave a
smaller one. Sequences that come out alike are planned together, as often as their documents last, so the plan is the
same as one made sequence by sequence. Pieces find their places by their number within their length: a broadcast join
with the plan's runs, of which there are a bounded number.

Pieces of one length are numbered from counts by (part, length), so a length that a third of all pieces have is no group.
The numbering is part of a written table; a retried task can't change it.

Edge cases: a null text is an empty one, whose document is the end id alone; texts of any length are read whole; a null id
is a value like any other; rows that repeat are packed each; an empty table gives an empty result; columns beside the id
and the text play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluora.llm.common import checkpoint, cut
from fluora.llm.word_ids import BATCH, tokenizer, tokenizer_path

#: Tokens of a sequence.
LIMIT = 4096
#: The id that ends a document.
END = 1


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth): the pieces of all documents.

    ids are little-endian unsigned 32-bit integers; nth counts a task's pieces of one length from 0, part is the task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, seen, part = tokenizer(path or tokenizer_path()), Counter(), TaskContext.get().partitionId()
        for some in parts:
            for at in range(0, some.num_rows, BATCH):
                rows = some.slice(at, BATCH)
                texts = pa.concat_arrays([rows.column(1).fill_null("").cast(pa.large_binary())])
                bounds = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: bounds[-1]]
                ids, ends = enc.encode(data, bounds)
                ids = np.insert(ids, ends[1:], np.uint32(end))
                sizes = np.diff(ends) + 1
                n = -(-sizes // limit)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                lengths = np.minimum(sizes[row] - piece * limit, limit)
                nth = []
                for length in lengths.tolist():
                    nth.append(seen[length])
                    seen[length] += 1
                offsets = pa.array(np.concatenate([[0], 4 * np.cumsum(lengths)]), pa.int64())
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, offsets.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
                columns = [rows.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * limit, pa.int64()), pa.array(lengths, pa.int64()), packed.cast(pa.binary()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, part int, nth long")


def _best_two(have: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """The two lengths with the largest sum of at most ``room`` and more than ``least``; of equal sums the one with the longest."""
    lengths = np.flatnonzero(have[: room + 1])
    nth = np.arange(len(lengths))
    with_ = np.minimum(np.searchsorted(lengths, room - lengths, "right") - 1, nth)  # the longest partner, not longer than itself
    with_ -= (with_ == nth) & (have[lengths] < 2)
    both = np.where(with_ >= 0, lengths + lengths[with_], -1) if len(lengths) else np.array([-1])
    best = len(both) - 1 - int(np.argmax(both[::-1]))
    return (int(lengths[best]), int(lengths[with_[best]])) if both[best] > least else None


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, dict[int, int]]]:
    """(sequences, documents of each length in one of them) of a histogram of lengths, by best-two-fit."""
    have = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    out = []
    while have.any():
        inside: Counter[int] = Counter()
        gap, left = limit, have.copy()
        while len(fits := np.flatnonzero(left[: gap + 1])):  # the longest documents that fit, as many as there are and fit
            length = int(fits[-1])
            inside[length] = min(gap // length, int(left[length]))
            left[length] -= inside[length]
            gap -= inside[length] * length
        needed = dict(inside)
        least = min(inside)
        if gap and inside.total() > 1:
            left[least] += 1
            if two := _best_two(left, gap + least, least):
                inside[least] -= 1
                inside.update(two)
        inside = +inside
        # the next sequences come out the same while what was met lasts
        again = min((int(have[x]) - max(needed.get(x, 0), n)) // n for x, n in inside.items())
        for length, n in inside.items():
            have[length] -= (1 + again) * n
        out.append((1 + again, dict(inside)))
    return out


def runs(counts: pd.DataFrame, limit: int = LIMIT) -> pd.DataFrame:
    """(length, low, high, sequence, place, each): pieces number low to high - 1 of a length go to sequences from ``sequence`` on, ``each`` in one, from ``place`` on."""
    rows, used, first = [], Counter(), 0
    for n, inside in plan(dict(zip(counts.length, counts.n, strict=True)), limit):
        place = 0
        for length, each in sorted(inside.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * each, first, place, each))
            used[length] += n * each
            place += each * length
        first += n
    return pd.DataFrame(rows, columns=["length", "low", "high", "sequence", "place", "each"]).astype("int64")


def packed(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of all pieces; sequences are numbered from 0, without gaps."""
    rows = cut(pieces(docs, path, limit, end), compression="zstd")
    by_part = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = by_part.groupBy("length").agg(F.sum("n").alias("n"))
    # one group, but of at most ``limit`` rows; its runs are at most some hundred thousand, of 48 bytes
    places = checkpoint(counts.groupBy().applyInPandas(lambda h: runs(h, limit), "length long, low long, high long, sequence long, place long, each long"))
    rows = rows.join(starts, ["length", "part"]).withColumn("at", F.col("first") + F.col("nth"))
    hit = (F.col("length") == F.col("size")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    return rows.join(F.broadcast(places.withColumnRenamed("length", "size")), hit).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids",
        F.expr("sequence + (at - low) div each").alias("sequence_id"),
        F.expr("place + (at - low) % each * length").alias("offset"),
    )


def op13_packing(spark, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens; one row per piece."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    out = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
