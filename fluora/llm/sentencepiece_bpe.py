"""SentencePiece BPE encoding with a table of each prefix's last token, and decoding.

The last token of the encoding of a prefix is unique. A word is encoded from left to right: an automaton (a
trie of reversed pieces) lists the pieces that end at each place, and the one that may stand after the last token of the
prefix before it is stored. A pair may stand together if undoing its merges, latest first, never shows a pair that
merges sooner. Ids are then read backwards from the end of the word. All new words of a batch of texts go through this
together, place by place, in numpy.

No piece holds a space mark after another character, so texts fall into words ("▁" runs with what follows) that encode
by themselves; a bounded cache holds the words met lately. Runs of "▁" have pieces of one equal score that merge from
the left, so they are encoded by their length. Characters without a piece become byte pieces.

Edge cases: null is an empty text, which has begin and end ids only; texts of any length are encoded whole; an empty
table gives an empty result; columns beside the id and the text play no part.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words that a task keeps from batch to batch; a full cache is emptied.
CACHE = 250_000
#: Slots of the table of pairs that were tested.
SLOTS = 1 << 21
#: Texts are passed to the tasks in batches of so many.
BATCH = 256


class Encoder:
    """The pieces of one model file, prepared for encoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("the model has pieces that span words")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.runs = {len(p): i for p, i in pieces.items() if not p.strip(MARK)}
        chars = sorted(p for p in pieces if len(p) == 1)
        merged = sorted((p for p in pieces if len(p) > 1 and p.strip(MARK)), key=lambda p: (-sp.get_score(pieces[p]), pieces[p]))
        self.known = frozenset(chars)
        self.ids: list[int] = []  # by rank: characters first, then pieces in the order they merge
        self.halves: list[tuple[int, int]] = []
        self.pair: dict[tuple[int, int], int] = {}
        rank: dict[str, int] = {}
        for p in [*chars, *merged]:
            r, halves = len(self.ids), None
            if len(p) > 1:
                for k in range(1, len(p)):
                    a, b = rank.get(p[:k]), rank.get(p[k:])
                    if a is not None and b is not None and self._fits(a, b):
                        halves = (a, b)
                        break
                if halves is None:
                    continue  # no order of merges leads to it
                self.pair[halves] = r
            rank[p] = r
            self.ids.append(pieces[p])
            self.halves.append(halves or (r, r))
        if len(self.ids) > 1 << 16 or len(chars) >= 1 << 13:
            raise ValueError("the model has too many pieces or characters for the packed keys")
        self._trie(rank, chars)
        self.id_of = np.array(self.ids, np.uint32)
        self.slot_key, self.slot_fits = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.start, self.end = self._pack([sp.bos_id()]), self._pack([sp.eos_id()])
        self.line = self._pack([self.byte[10]])
        self.cache: dict[str, bytes] = {}

    def _trie(self, rank: dict[str, int], chars: list[str]) -> None:
        """The automaton: steps from a node by one more character to the left, and the piece that a node spells."""
        self.code = np.zeros(0x110000, np.int16)
        for i, c in enumerate(chars, 1):
            self.code[ord(c)] = i
        steps: dict[int, int] = {}
        spells = [-1]
        for p, r in rank.items():
            node = 0
            for c in reversed(p):
                key = node << 13 | int(self.code[ord(c)])
                if key not in steps:
                    steps[key] = len(spells)
                    spells.append(-1)
                node = steps[key]
            spells[node] = r
        self.step_key = np.array(sorted(steps), np.int64)
        self.step_to = np.array([steps[k] for k in sorted(steps)], np.int64)
        self.spells = np.array(spells, np.int64)

    def _fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: no merge across their border comes before the merges that made them."""
        limit = 1 << 60
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            if a > b:
                (_, inner), limit = self.halves[a], a
                if inner == a:
                    return True
                a = inner
            else:
                (inner, _), limit = self.halves[b], b + 1
                if inner == b:
                    if self.halves[a][1] == a:
                        return True
                    limit, a = a, self.halves[a][1]
                else:
                    b = inner

    def _step(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = node << 13 | char
        at = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
        return self.step_to[at], self.step_key[at] == key

    def _pairs_fit(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys * 0x9E3779B1 >> 9) & (SLOTS - 1)
        new = self.slot_key[slot] != keys
        if not new.any():
            return self.slot_fits[slot]
        todo, back = np.unique(keys[new], return_inverse=True)
        told = np.array([self._fits(k >> 16, k & 0xFFFF) for k in todo.tolist()], bool)
        out = self.slot_fits[slot]
        out[new] = told[back]
        where = (todo * 0x9E3779B1 >> 9) & (SLOTS - 1)
        self.slot_key[where] = todo
        self.slot_fits[where] = self.slot_key[where] == todo  # of two keys in one slot one stays
        kept = self.slot_key[where] == todo
        self.slot_fits[where[kept]] = told[kept]
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """The packed ids of words whose characters all have pieces; no word is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        char = self.code[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].astype(np.int64)
        ends = np.cumsum(sizes)
        place = np.arange(len(char)) - np.repeat(ends - sizes, sizes)  # within the word
        at, (node, ok) = np.arange(len(char)), self._step(np.zeros(len(char), np.int64), char)
        at, node, length, found = at[ok], node[ok], 1, []
        while len(at):
            r = self.spells[node]
            hit = r >= 0
            found.append((at[hit], np.full(int(hit.sum()), length), r[hit]))
            more = place[at] >= length
            at, node = at[more], node[more]
            node, ok = self._step(node, char[at - length])
            at, node, length = at[ok], node[ok], length + 1
        at, lengths, ranks = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place[at], kind="stable")
        at, lengths, ranks = at[order], lengths[order], ranks[order]
        bounds = np.searchsorted(place[at], np.arange(int(sizes.max()) + 1))
        last, size = np.full(len(char), -1, np.int64), np.zeros(len(char), np.int64)
        for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
            a, n, r = at[low:high], lengths[low:high], ranks[low:high]
            fits = n == i + 1  # the whole prefix
            rest = np.flatnonzero(~fits)
            fits[rest] = self._pairs_fit(last[a[rest] - n[rest]] << 16 | r[rest])
            last[a[fits]], size[a[fits]] = r[fits], n[fits]
        back, first, stands = ends - 1, ends - sizes, np.zeros(len(char), bool)
        while len(back):
            stands[back] = True
            back = back - size[back]
            more = back >= first
            back, first = back[more], first[more]
        counts = np.add.reduceat(stands, ends - sizes)
        packed = self.id_of[last[stands]].tobytes()
        cuts = [0, *(4 * np.cumsum(counts)).tolist()]
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _run(self, n: int) -> list[int]:
        """The ids of a run of n space marks: the left one grows while there is a piece for it."""
        if n > 64:  # the longest piece comes off the left again and again
            most = max(self.runs)
            times = (n - 48) // most
            return [self.runs[most]] * times + self._run(n - times * most)
        sizes = [1] * n
        i = 0
        while i < len(sizes) - 1:
            if sizes[i] + sizes[i + 1] in self.runs:
                sizes[i : i + 2] = [sizes[i] + sizes[i + 1]]
                i = max(i - 1, 0)
            else:
                i += 1
        return [self.runs[s] for s in sizes]

    def _odd(self, word: str) -> list[int]:
        """The ids of a word that has characters without a piece, or more than one space mark."""
        body = word.lstrip(MARK)
        marks = len(word) - len(body)
        if not body:
            return self._run(marks)
        if marks and body[0] in self.known:
            body, marks = MARK + body, marks - 1
        ids: list[int] = []
        at = 0
        while at < len(body):
            end = at
            while end < len(body) and body[end] in self.known:
                end += 1
            if end > at:
                ids += array("I", self._known([body[at:end]])[0]).tolist()
            while end < len(body) and body[end] not in self.known:
                ids += [self.byte[b] for b in body[end].encode("utf-8", "surrogatepass")]
                end += 1
            at = end
        if marks and ids[0] == self.runs[1]:  # a mark that the word leaves alone joins the run before it
            ids, marks = ids[1:], marks + 1
        return self._run(marks) + ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids with begin and end, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        parts = [[] if not t else self._odd_text(t) if MARK in t or "  " in t or " \n" in t or t[0] in " \n" or t[-1] == " " else t.replace("\n", " \n").split(" ") for t in texts]
        plain, body = [], []
        for w in set().union(*parts).difference(cache):
            # a word follows a space, unless it is marked as the first of a line
            b = w[1:] if w[0] == "\n" else MARK + w
            if b and self.known.issuperset(b) and w[0] != MARK:
                plain.append(w)
                body.append(b)
            else:
                cache[w] = (self.line if w[0] == "\n" else b"") + (self._pack(self._odd(w if w[0] == MARK else b)) if b else b"")
        if plain:
            for w, ids in zip(plain, self._known(body), strict=True):
                cache[w] = self.line + ids if w[0] == "\n" else ids
        return [b"".join([self.start, *map(cache.__getitem__, words), self.end]) for words in parts]

    def _odd_text(self, text: str) -> list[str]:
        """The words of a text that has runs of spaces or spaces at the ends of lines, in the form of cache keys."""
        words = re.findall(MARK + "+[^▁\n]*|\n[^▁\n]*", MARK + text.replace(" ", MARK))
        return [w[1:] if w[0] == MARK and len(w) > 1 and w[1] != MARK else w for w in words]

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(array("I", ids).tolist())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each model and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def model_path() -> str:
    """The public 32k BPE model of the tokenizer package, as a default for the parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokenized(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path or model_path())
        for part in parts:
            yield pd.DataFrame({"doc_id": part.doc_id, "ids": [array("I", ids).tolist() for ids in enc.encode([t or "" for t in part.text])]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path or model_path())
        for part in parts:
            for at in range(0, part.num_rows, BATCH):
                some = part.slice(at, BATCH)
                n, ids, texts = [], [], []
                for packed in enc.encode([t or "" for t in some.column(1).to_pylist()]):
                    n.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    texts.append(hashlib.sha256(enc.decode(packed).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes the whole text of every document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
