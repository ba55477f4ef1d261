"""Alignment of two tokenizers over a corpus by distinct segments.

A text with a space before it is split before runs of white space, at places over which neither vocabulary can merge: no
entry of either has such a white-space character after another character, and the first tokenizer's pattern always ends a
unit there. So segments are tokenized and aligned by themselves, each distinct one once, and a document is their chain.

1. One pass puts documents into lots of bounded bytes and writes them as numbers of a lot's segments, with the segments and
their counts. 2. Spark sums the counts of each distinct segment over the corpus. 3. Each is tokenized both ways and aligned
once. 4. Links are counted by id pair over the corpus, and the counts go back to the segments. 5. Segments are joined to
the lots that hold them, and a lot composes its documents.

A pair's count and a pair's documents are found by aggregates with partial sums and by joins whose large partitions Spark
can split; a lot's size bounds what a task holds, besides one text.

Edge cases: null and empty texts, and texts that hold the second tokenizer's space mark (whose bytes it can't give back),
have no tokens; strings of special tokens are plain text; texts and segments of any length are taken whole; rows that repeat
count each; an empty table gives an empty result; columns beside the id and the text play no part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluora.llm.common import cut, small

MARK = "▁"
#: Bytes of text after which a lot is full.
LOT_BYTES = 64 << 20
#: Id pairs (17 bytes each) that are broadcast at most; beyond that they are joined by a shuffle.
PAIRS = 3_000_000
#: Rows of a batch that goes to a task.
BATCH = 1024
#: The one character in a byte for each that the byte-level vocabulary doesn't spell as itself are numbered from 256.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Pair:
    """Two tokenizer files, prepared for segments."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        level = spec["pre_tokenizer"] or {}
        if level.get("type") != "ByteLevel" or not level["use_regex"] or level["add_prefix_space"] or spec["normalizer"] is not None:
            raise ValueError("the first tokenizer isn't byte-level with its usual pattern")
        model = model_pb2.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces and model.trainer_spec.byte_fallback):
            raise ValueError("the second tokenizer changes texts")
        others = iter(range(256, 512))
        byte = {(chr(b) if b in PLAIN else chr(next(others))): b for b in range(256)}
        special = {t["content"] for t in spec["added_tokens"]}
        self.bytes_a = {i: p.encode() if p in special else bytes(byte[c] for c in p) for p, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_b = {}
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            self.bytes_b[i] = bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
        self.space = self.b.piece_to_id(MARK)
        entries = [*self.bytes_a.values(), *(self.bytes_b[i] for i in self.bytes_b if not (self.b.is_control(i) or self.b.is_unknown(i)))]
        # white space that no entry of either vocabulary has after another character, or after the space put before a segment
        inner = set("".join(x for e in entries for m in re.findall(r"\S(?=(\s))| (?=([^ \S]))", e.decode(errors="surrogateescape")) for x in m))
        self.gaps = "".join(c for c in " \t\n\v\f\r" if c not in inner)
        if " " not in self.gaps:
            raise ValueError("entries reach over spaces")
        # a run of white space and one of other characters, and on as long as the next white space is no such one
        self.pieces = re.compile(rf"\s*\S*(?:[^\S{self.gaps}]\s*\S*)*").findall

    def segments(self, text: str) -> list[str]:
        """The segments of a text with a space before it; none for texts that the second tokenizer can't give back."""
        return self.pieces(" " + text)[:-1] if text and MARK not in text else []  # the last one is empty

    def aligned(self, segments: list[str]) -> Iterator[tuple[list[int], list[int], list[tuple[list[int], list[int]]], list[tuple[int, int]]]]:
        """For each segment the ids of both tokenizers, the groups between common ends, and the linked ids."""
        # the second tokenizer puts a space before; a segment that begins with another character gets it taken off again
        of_b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for s, a, b in zip(segments, self.a.encode_batch(segments, add_special_tokens=False), of_b, strict=True):
            a = a.ids
            if s == " ":
                b = [self.space]  # the library puts no space before nothing
            elif s[0] != " ":
                if b[0] != self.space:
                    raise ValueError(f"the second tokenizer merges a space with {s[0]!r}")
                b = b[1:]
            if b"".join(map(self.bytes_a.__getitem__, a)) != s.encode() or b"".join(map(self.bytes_b.__getitem__, b)) != s.encode():
                raise ValueError(f"tokens don't spell {s!r}")
            groups, links, i, j, end_a, end_b = [], [], 0, 0, len(self.bytes_a[a[0]]), len(self.bytes_b[b[0]])
            from_i = from_j = 0
            while True:
                links.append((a[i], b[j]))
                step_a, step_b = end_a <= end_b, end_b <= end_a
                if step_a:
                    i += 1
                if step_b:
                    j += 1
                if step_a and step_b:
                    groups.append((a[from_i:i], b[from_j:j]))
                    from_i, from_j = i, j
                    if i == len(a):
                        break
                if step_a:
                    end_a += len(self.bytes_a[a[i]])
                if step_b:
                    end_b += len(self.bytes_b[b[j]])
            yield a, b, groups, links


_pairs: dict[tuple[str, str], Pair] = {}


def pair(paths: tuple[str, str] | None = None) -> Pair:
    """One for each two files and worker process."""
    if paths is None:
        import public_tokenizers

        paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    if paths not in _pairs:
        _pairs[paths] = Pair(*paths)
    return _pairs[paths]


def coded(docs: DataFrame, paths: tuple[str, str] | None = None, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """(lot, doc_id, n, codes, segments, counts), written: a row for each document, and one for each lot's segments.

    codes are a document's n segments by their place in its lot's segments, as packed 32-bit integers. Documents of a task
    go to a lot in turn, until it is full.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        two, lot = pair(paths), TaskContext.get().partitionId() << 32
        names, kinds = ["lot", "doc_id", "n", "codes", "segments", "counts"], [pa.int64(), None, pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
        number, counts, size, doc_type = defaultdict(count().__next__), np.zeros(0, np.int64), 0, None

        def batch(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k or doc_type) for c, k in zip(columns, kinds, strict=True)], names)

        def told() -> pa.RecordBatch:
            return batch([lot], [None], [None], [None], [list(number)], [counts[: len(number)].tolist()])

        for some in parts:
            doc_type, n, codes, at, new = some.column(0).type, [], [], [], []
            for text in map(pa.StringScalar.as_py, some.column(1)):
                own = np.fromiter(map(number.__getitem__, two.segments(text)), np.int32)
                if len(number) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(number), np.int64)])
                np.add.at(counts, own, 1)
                at.append(lot)
                n.append(len(own))
                codes.append(pa.compress(own.tobytes(), "zstd", asbytes=True))
                size += len((text or "").encode())
                if size >= lot_bytes:
                    new.append(told())
                    lot, size = lot + 1, 0
                    number, counts = defaultdict(count().__next__), np.zeros(0, np.int64)
            yield batch(at, some.column(0), n, codes, [None] * len(n), [None] * len(n))
            yield from new
        if size or number:
            yield told()

    schema = f"lot long, doc_id {kind}, n int, codes binary, segments array<string>, counts array<long>"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // lot_bytes))  # few lots that aren't full
    return cut(docs.coalesce(tasks).select("doc_id", "text").mapInArrow(run, schema), compression="zstd")


def aligned(self, segments: list[str]) -> Iterator[tuple[list[int], list[int], list[tuple[list[int], list[int]]], list[tuple[int, int]]]]:
        """For each segment the ids of both tokenizers, the groups between common ends, and the linked ids."""
        # the second tokenizer puts a space before; a segment that begins with another character gets it taken off again
        of_b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for s, a, b in zip(segments, self.a.encode_batch(segments, add_special_tokens=False), of_b, strict=True):
            a = a.ids
            if s == " ":
                b = [self.space]  # the library puts no space before nothing
            elif s[0] != " ":
                if b[0] != self.space:
                    raise ValueError(f"the second tokenizer merges a space with {s[0]!r}")
                b = b[1:]
            if b"".join(map(self.bytes_a.__getitem__, a)) != s.encode() or b"".join(map(self.bytes_b.__getitem__, b)) != s.encode():
                raise ValueError(f"tokens don't spell {s!r}")
            groups, links, i, j, end_a, end_b = [], [], 0, 0, len(self.bytes_a[a[0]]), len(self.bytes_b[b[0]])
            from_i = from_j = 0
            while True:
                links.append((a[i], b[j]))
                step_a, step_b = end_a <= end_b, end_b <= end_a
                if step_a:
                    i += 1
                if step_b:
                    j += 1
                if step_a and step_b:
                    groups.append((a[from_i:i], b[from_j:j]))
                    from_i, from_j = i, j
                    if i == len(a):
                        break
                if step_a:
                    end_a += len(self.bytes_a[a[i]])
                if step_b:
                    end_b += len(self.bytes_b[b[j]])
            yield a, b, groups, links


_pairs: dict[tuple[str, str], Pair] = {}


def pair(paths: tuple[str, str] | None = None) -> Pair:
    """One for each two files and worker process."""
    if paths is None:
        import public_tokenizers

        paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    if paths not in _pairs:
        _pairs[paths] = Pair(*paths)
    return _pairs[paths]


def lots(docs: DataFrame, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """(lot, doc_id, text), written: documents of a task in turn, a new lot when one is full; null texts are empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        first, before = TaskContext.get().partitionId() << 32, 0
        for some in parts:
            ends = before + np.cumsum(pc.fill_null(pc.binary_length(some.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate([[before], ends[:-1]])
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([pa.array(first + starts // lot_bytes), some.column(0), pc.fill_null(some.column(1), "")], ["lot", "doc_id", "text"])

    return cut(docs.select("doc_id", "text").mapInArrow(run, f"lot long, doc_id {kind}, text string"))


def counted(rows: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(lot, segment, n) of (lot, doc_id, text)."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        two, lot, seen = pair(paths), None, Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array([lot] * len(seen), pa.int64()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["lot", "segment", "n"])
        for some in parts:
            for own, text in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                if own != lot:
                    if seen:
                        yield table()
                    lot, seen = own, Counter()
                seen.update(two.segments(text.as_py()))
        if seen:
            yield table()

    return rows.select("lot", "text").mapInArrow(run, "lot long, segment string, n long")


def aligned(segments: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(segment, n, groups, links) of (segment, n): groups as text ``a1,a2|b1;a3|b2,b3``, and linked ids as a << 32 | b."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        two = pair(paths)
        for part in parts:
            groups, links = [], []
            for _, _, cuts, met in two.aligned(part.segment.tolist()):
                groups.append(";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in cuts]))
                links.append([x << 32 | y for x, y in met])
            yield pd.DataFrame({"segment": part.segment, "n": part.n, "groups": groups, "links": links})

    return segments.mapInPandas(run, "segment string, n long, groups string, links array<long>")


def pair_counts(segments: DataFrame) -> DataFrame:
    """(link, count, best) of aligned segments: how often an id pair is linked, and whether no pair of its b is linked more often."""
    counts = segments.select(F.explode("links").alias("link"), "n").groupBy("link").agg(F.sum("n").alias("count"))
    b = F.col("link").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("link", "count", (F.col("count") == F.col("most")).alias("best"))


@dataclass
class Aligned:
    """What an alignment gives: coded documents, the segments of their lots (lot, number, segment, n), and the alignment and counts of segments."""

    documents: DataFrame
    held: DataFrame
    segments: DataFrame


def align(docs: DataFrame, paths: tuple[str, str] | None = None, lot_bytes: int = LOT_BYTES) -> Aligned:
    """Aligns both tokenizers over all documents; segments are (segment, groups, n_best, count_sum)."""
    rows = coded(docs, paths, lot_bytes)
    held = rows.where("segments is not null").select("lot", F.posexplode(F.arrays_zip("segments", "counts")).alias("number", "s")).select("lot", "number", F.col("s.segments").alias("segment"), F.col("s.counts").alias("n"))
    told = cut(aligned(held.groupBy("segment").agg(F.sum("n").alias("n")), paths), compression="zstd")
    pairs = small(cut(pair_counts(told), compression="zstd"), PAIRS)
    links = told.select("segment", F.explode("links").alias("link")).join(pairs, "link")
    sums = links.groupBy("segment").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    return Aligned(rows.where("segments is null").drop("segments", "counts"), held, told.select("segment", "groups").join(sums, "segment"))


SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def composed(found: Aligned) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    kind = found.documents.schema["doc_id"].dataType.simpleString()

    def run(docs, segments):
        import numpy as np
        import pyarrow as pa

        number, text = segments.column("number").to_numpy(), segments.column("groups").to_pylist()
        groups, sums = [""] * len(text), np.zeros((len(text), len(SUMS)), np.int64)
        for i, s in zip(number.tolist(), text, strict=True):
            groups[i] = s
        n_groups = np.array([s.count("|") for s in text], np.int64)
        n_a = np.array([sum(g.count(",", 0, g.index("|")) + 1 for g in s.split(";")) for s in text], np.int64)
        n_b = np.array([s.count(",") + 2 * s.count("|") for s in text], np.int64) - n_a
        # within a group each further token of either kind makes one more link
        for k, values in enumerate((n_a, n_b, n_groups, n_a + n_b - n_groups, segments.column("n_best").to_numpy(), segments.column("count_sum").to_numpy())):
            sums[number, k] = values
        out, digests = np.zeros((docs.num_rows, len(SUMS)), np.int64), []
        for i, (n, codes) in enumerate(zip(docs.column("n").to_pylist(), docs.column("codes").to_pylist(), strict=True)):
            at = np.frombuffer(pa.decompress(codes, 4 * n, "zstd", asbytes=True), np.int32)
            out[i] = sums[at].sum(0)
            digests.append(hashlib.sha256(";".join([groups[k] for k in at.tolist()]).encode()).hexdigest() if n else "")
        return pa.table([docs.column("doc_id"), *(pa.array(c) for c in out.T), pa.array(digests, pa.string())], ["doc_id", *SUMS, "groups_sha256"])

    told = found.held.select(F.col("lot").alias("of"), "number", "segment").join(found.segments, "segment").drop("segment")
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in SUMS)}, groups_sha256 string"
    return found.documents.groupBy("lot").cogroup(told.groupBy("of")).applyInArrow(run, schema)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Aligns a byte-level and a piece tokenizer over all documents; one row per document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return composed(align(spark.read.parquet(f"{sf_dir}/documents.parquet")))
