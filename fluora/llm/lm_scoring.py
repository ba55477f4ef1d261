"""LM scoring with a log-bilinear neural model that is trained by noise-contrastive estimation.

Words are counted over all training documents. Those with at least ``sqrt(tokens) / SPARSE`` occurrences are items of
their own, so the vocabulary grows about as the root of the corpus; all other words fall into classes by their last three
bytes, and the end of a text is an item. Items are dealt into groups: a word group for every ``sqrt(words)`` words, and a
group of its own for each class and the end. A context is ``sum_j c_j * r_(word j before)`` over the last ``CONTEXT``
tokens; groups score ``b_g + q_g . context``, items likewise, and a token's probability is that of its group among all
groups times that of its item among the group's items, by batched matrix products. A class gives its probability to its
words by counts less a discount, and the discounted mass to one unknown word, so token probabilities sum to one.

Texts are encoded once, as item numbers. Every training token takes part in noise-contrastive steps: tasks pass over
their texts in numpy, with noise shared by a batch, and parameters and step sizes are averaged by Spark in pieces between
``ROUNDS`` rounds, each over its share of the texts. Small corpora are passed until ``EXAMPLES`` tokens are seen.

Counts of up to ``FREQUENT`` of the most frequent words travel with the tasks; the other words of a text are joined with
the table of counts, whatever its size.

Edge cases: null is an empty text, which has the end token only; a null id counts as the empty text for the split; rows
that share an id are scored each; with no training text at all every token is unknown; an empty table gives an empty
result. Only A-Z are lower-cased.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import ceil, log10, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluora.llm.common import cut

#: A word is an item of its own from the root of the tokens divided by this on.
SPARSE = 8
#: Classes of the other words, by their last three bytes.
LASTS = 96
FREQUENT = 200_000
SMOOTH = 0.1
CONTEXT, DIM, NOISE, ROUNDS, RATE = 3, 16, 48, 4, 0.15
#: Training tokens to see at least, over several passes of a small corpus.
EXAMPLES = 4_000_000
BATCH, STEP = 512, 4096
#: Tokens that are scored together, and rows of scores at once.
CHUNK, ROWS = 1 << 17, 2048
#: Parameters in a piece that is averaged.
PIECE = 1 << 14


def last_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % LASTS


def _batches(parts: Iterator) -> Iterator:
    for part in parts:
        for at in range(0, part.num_rows, BATCH):
            yield part.slice(at, BATCH)


def tokens(text: str) -> list[bytes]:
    """Words in UTF-8 with A-Z lowered; the separators of ``split`` are those of the contract."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, class, c) over all texts: every partition counts its batches, Spark adds up."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        def out(count: Counter):
            words = list(count)
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array([last_class(w) for w in words], pa.int32()), pa.array([count[w] for w in words], pa.int64())], ["word", "class", "n"])

        count: Counter = Counter()
        for part in _batches(parts):
            for t in part.column(0).to_pylist():
                count.update(tokens(t))
            if len(count) > 400_000:
                yield out(count)
                count = Counter()
        yield out(count)

    return train.select("text").mapInArrow(run, "word string, class int, n long").groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("c"))


class Lexicon:
    """Item numbers of the words: words of their own, then the end, then the classes; counts of the frequent words."""

    def __init__(self, own: list[tuple[str, int]], frequent: list[tuple[str, int, int]], texts: int, rest: dict[int, tuple[int, int]], discount: float):
        self.item = {w.encode(): i for i, (w, _) in enumerate(own)}
        self.end, self.texts, self.discount = len(own), texts, discount
        self.count = {w.encode(): c for w, _, c in frequent} | {w.encode(): c for w, c in own}
        self.log_n = np.array([log10(rest[k][0]) if k in rest else 0.0 for k in range(LASTS)])
        self.log_miss = [log10(discount * rest[k][1]) if k in rest else 0.0 for k in range(LASTS)]
        unigram = [c for _, c in own] + [texts] + [rest[k][0] if k in rest else 0 for k in range(LASTS)]
        self.unigram = (np.array(unigram, np.float64) + 0.5) / (sum(unigram) + 0.5 * len(unigram))
        # groups: words in runs of equal length by frequency, then one for each other item
        size = max(1, ceil(sqrt(len(own))))
        words = np.arange(len(own)) // size
        first = int(words[-1]) + 1 if len(own) else 0
        self.group = np.concatenate([words, first + np.arange(1 + LASTS)]).astype(np.int64)
        self.words = first  # the number of groups of words
        self.edges = [*range(0, len(own), size), len(own)]
        # one number for each counted word, and what the number stands for
        counted = list(self.count)
        self.number = {w: i for i, w in enumerate(counted)}
        c = np.array([self.count[w] for w in counted], np.float64)
        self.item_of = np.array([self.item[w] if w in self.item else self.end + 1 + last_class(w) for w in counted], np.int32)
        self.log_count = np.log10(c + SMOOTH)
        self.less = np.where(self.item_of > self.end, np.log10(np.maximum(c - discount, 1e-9)), 0.0)


def contexts(ids: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """For each token of joined texts the CONTEXT tokens before it, the nearest first; the end stands before a text."""
    out = np.full((len(ids), CONTEXT), end, np.int64)
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    for j in range(CONTEXT):
        at = np.flatnonzero(place > j)
        out[at, j] = ids[at - j - 1]
    return out


class Model:
    """Parameters of the log-bilinear model, with the running squares of their steps."""

    NAMES = ("r", "q", "b", "gq", "gb", "c", "sr", "sq", "sgq")

    def __init__(self, lexicon: Lexicon, seed: int = 3):
        rng = np.random.default_rng(seed)
        n, groups = len(lexicon.group), int(lexicon.group[-1]) + 1
        self.group, self.end, self.words, self.edges = lexicon.group, lexicon.end, lexicon.words, lexicon.edges
        self.noise = lexicon.unigram
        self.group_noise = np.bincount(lexicon.group, lexicon.unigram, groups)
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.r, self.q, self.gq = normal(n, DIM), normal(n, DIM), normal(groups, DIM)
        self.b, self.gb = np.log(self.noise).astype(np.float32), np.log(self.group_noise).astype(np.float32)
        self.c = np.full((CONTEXT, DIM), 1 / CONTEXT, np.float32)
        self.sr, self.sq, self.sgq = (np.full(k, 1e-4, np.float32) for k in (n, n, groups))

    def pack(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def unpack(self, data: np.ndarray) -> Model:
        at = 0
        for k in self.NAMES:
            shape = getattr(self, k).shape
            n = int(np.prod(shape))
            setattr(self, k, data[at : at + n].reshape(shape).astype(np.float32))
            at += n
        return self

    def made(self, before: np.ndarray) -> np.ndarray:
        out = self.c[0] * self.r[before[:, 0]]
        for j in range(1, CONTEXT):
            out += self.c[j] * self.r[before[:, j]]
        return out

    def _contrast(self, made: np.ndarray, target: np.ndarray, q: str, b: str, s: str, log_noise: np.ndarray, drawn: np.ndarray, rate: float) -> np.ndarray:
        """A step of one output layer, whose targets are in order; returns the slope for the contexts."""
        weights, bias, past = getattr(self, q), getattr(self, b), getattr(self, s)
        own, noise = weights[target], weights[drawn]
        up = _falling(np.einsum("ij,ij->i", made, own) + (bias - log_noise)[target])
        down = made @ -noise.T
        down += log_noise[drawn] - bias[drawn]
        down = _falling(down)
        own *= up[:, None]
        own -= down @ noise
        back = own
        first = _firsts(target)
        rows = np.concatenate([target[first], drawn])
        grad = np.concatenate([np.add.reduceat(up[:, None] * made, first, axis=0), -(down.T @ made)])
        self._move(weights, past, rows, grad, rate, bias, np.concatenate([np.add.reduceat(up, first), -down.sum(0)]))
        return back

    @staticmethod
    def _move(weights: np.ndarray, past: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float, bias: np.ndarray | None = None, slope: np.ndarray | None = None) -> None:
        """Adagrad by rows: sums the gradients of equal rows, then moves each row once."""
        order = np.argsort(rows.astype(np.uint16) if len(weights) <= 1 << 16 else rows, kind="stable")
        rows = rows[order]
        first = _firsts(rows)
        rows, total = rows[first], np.add.reduceat(grad[order], first, axis=0)
        past[rows] += (total * total).mean(1)
        size = rate / np.sqrt(past[rows])
        weights[rows] += size[:, None] * total
        if bias is not None:
            bias[rows] += size * np.add.reduceat(slope[order], first)

    def train(self, ids: np.ndarray, starts: np.ndarray, seed: int, rate: float) -> None:
        """Noise-contrastive steps over all tokens of the joined texts, in random order; within a step by item, so that equal ones are together."""
        rng = np.random.default_rng(seed)
        before, order = contexts(ids, starts, self.end), rng.permutation(len(ids))
        edges, group_edges = np.cumsum(self.noise), np.cumsum(self.group_noise)
        log_noise, log_group_noise = (np.log(NOISE * x).astype(np.float32) for x in (self.noise, self.group_noise))
        draw = lambda x: np.minimum(np.searchsorted(x, rng.random(NOISE)), len(x) - 1)
        small = np.uint16 if len(self.group) <= 1 << 16 else np.int64
        for low in range(0, len(order), STEP):
            at = order[low : low + STEP]
            at = at[np.argsort(ids[at].astype(small), kind="stable")]
            u, w = before[at], ids[at]
            seen = self.r[u]
            made = np.einsum("ijk,jk->ik", seen, self.c)
            back = self._contrast(made, w, "q", "b", "sq", log_noise, draw(edges), rate)
            back += self._contrast(made, self.group[w], "gq", "gb", "sgq", log_group_noise, draw(group_edges), rate)
            slope = np.einsum("ik,ijk->jk", back, seen) / len(at)
            self._move(self.r, self.sr, u.ravel(), (back[:, None, :] * self.c).reshape(-1, DIM), rate)
            self.c += rate * slope

    def log_probs(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of every token of the joined texts, normalised over groups and over the items of a group."""
        before, out = contexts(ids, starts, self.end), np.zeros(len(ids))
        items = np.arange(len(self.group)).astype(np.uint16 if len(self.group) <= 1 << 16 else np.int64)
        for low in range(0, len(ids), CHUNK):
            order = np.argsort(items[ids[low : low + CHUNK]], kind="stable")  # by item, so by group: each group is one slice
            w, made = ids[low : low + CHUNK][order], self.made(before[low : low + CHUNK][order])
            g, part = self.group[w], np.zeros(len(w))
            for at in range(0, len(w), ROWS):
                part[at : at + ROWS] = _taken(made[at : at + ROWS] @ self.gq.T + self.gb, g[at : at + ROWS])
            cuts = np.searchsorted(g, np.arange(self.words + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                a, b = self.edges[k], self.edges[k + 1]
                for at in range(cuts[k], cuts[k + 1], ROWS):
                    to = min(at + ROWS, cuts[k + 1])
                    part[at:to] += _taken(made[at:to] @ self.q[a:b].T + self.b[a:b], w[at:to] - a)
            out[low + order] = part
        return out / np.log(10)


def _falling(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    np.exp(np.minimum(x, 80, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _firsts(rows: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))


def _taken(score: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of each row at one place."""
    own = score[np.arange(len(at)), at].astype(np.float64)
    np.exp(np.minimum(score, 80, out=score), out=score)
    return np.minimum(own, 80) - np.log(score.sum(1))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(t, np.int32) for t in texts]
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    return np.concatenate(parts).astype(np.int64), starts


def trained(encoded: DataFrame, lexicon: Lexicon, tokens: int) -> Model:
    """The model after rounds over all training texts (row, held_out, ids); tasks' parameters are averaged by their tokens."""
    model = Model(lexicon)
    if not tokens:
        return model
    passes = max(1, ceil(EXAMPLES / tokens))
    lots = max(1, min(encoded.sparkSession.sparkContext.defaultParallelism, ceil(passes * tokens / EXAMPLES)))
    texts = encoded.where("not held_out")
    for turn in range(ROUNDS):
        share = texts.where(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == turn).select("ids").coalesce(lots)
        packed, rate = model.pack(), RATE / (1 + turn) ** 0.5

        def run(parts: Iterator, packed=packed, rate=rate, turn=turn) -> Iterator:
            import pyarrow as pa

            own, seen, held = Model(lexicon).unpack(packed), 0, []

            def step() -> None:
                nonlocal seen
                ids, starts = _joined(held)
                for p in range(passes):
                    own.train(ids, starts, 1000 * turn + p, rate)
                seen += len(ids)
                held.clear()

            room = 0
            for part in _batches(parts):
                for t in part.column(0).to_pylist():
                    held.append(t)
                    room += len(t)
                    if room > 1 << 20:
                        step()
                        room = 0
            if held:
                step()
            if seen:
                data = own.pack()
                pieces = [data[i : i + PIECE].tobytes() for i in range(0, len(data), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([float(seen)] * len(pieces)), pa.array(pieces, pa.binary())], ["piece", "n", "data"])

        def mean(rows: pd.DataFrame) -> pd.DataFrame:
            rows, total = rows.sort_values(["n", "data"]), rows.n.sum()
            data = sum(np.frombuffer(d, np.float32) * (n / total) for d, n in zip(rows.data, rows.n, strict=True))
            return pd.DataFrame({"piece": [rows.piece.iloc[0]], "data": [data.astype(np.float32).tobytes()]})

        made = share.mapInArrow(run, "piece int, n double, data binary").groupBy("piece").applyInPandas(mean, "piece int, data binary").collect()
        if made:
            model.unpack(np.concatenate([np.frombuffer(r.data, np.float32) for r in sorted(made, key=lambda r: r.piece)]))
    return model


def _frequent(counts: DataFrame) -> list[tuple[str, int, int]]:
    """The words whose counts only ``FREQUENT`` words reach, most frequent first.

    The least such count comes from how many words have each count, so no task sends more than these words.
    """
    least, room = None, FREQUENT
    for c, n in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(FREQUENT).collect():
        room -= n
        if room < 0:
            break
        least = c
    if least is None:
        return []
    rows = counts.where(F.col("c") >= least).collect()
    return [(r["word"], r["class"], r["c"]) for r in sorted(rows, key=lambda r: (-r["c"], r["word"].encode()))]


def encode(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, known, base, inner, ids, rare) of docs (row, doc_id, held_out, text).

    known, base and inner count the words that travel with the lexicon; rare has the others, with their class's miss.
    """

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        end, first, miss, number = log10(lexicon.texts + SMOOTH), lexicon.end + 1, lexicon.log_miss, lexicon.number.get
        rare_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32()), ("miss", pa.float64())]))
        for part in _batches(parts):
            cols: list[list] = [[] for _ in range(6)]
            for t in part.column(3).to_pylist():
                words = tokens(t)
                at = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
                known, other = at[at >= 0], np.flatnonzero(at < 0)
                ids = np.full(len(words) + 1, lexicon.end, np.int32)
                ids[np.flatnonzero(at >= 0)] = lexicon.item_of[known]
                rare: Counter = Counter(words[i] for i in other.tolist())
                cls = {w: last_class(w) for w in rare}
                ids[other] = [first + cls[words[i]] for i in other.tolist()]
                inner = lexicon.less[known].sum() - lexicon.log_n[ids[ids >= first] - first].sum()
                more = [{"word": w.decode("utf-8", "replace"), "n": c, "miss": miss[cls[w]]} for w, c in rare.items()]
                for col, x in zip(cols, (len(ids), len(known) + (lexicon.texts > 0), float(lexicon.log_count[known].sum()) + end, float(inner), ids.tobytes(), more), strict=True):
                    col.append(x)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), rare_type)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "inner", "ids", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, inner double, ids binary, rare array<struct<word: string, n: int, miss: double>>")


_models: dict[str, Model] = {}


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all rows of docs (doc_id, text)."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    docs = docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    train = docs.where("not held_out")
    counts = cut(word_counts(train))
    texts = train.count()
    told = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n, v = told["n"] + texts, told["v"] + (texts > 0)
    discount = min(0.9, max(0.1, told["once"] / max(1, told["once"] + 2 * told["twice"])))
    least = max(2, ceil(sqrt(n) / SPARSE))
    own = sorted(((r["word"], r["c"]) for r in counts.where(F.col("c") >= least).collect()), key=lambda r: (-r[1], r[0].encode()))
    rest = {r["class"]: (r["n"], r["v"]) for r in counts.where(F.col("c") < least).groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    lexicon = Lexicon(own, _frequent(counts), texts, rest, discount)
    encoded = cut(encode(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text"), lexicon))
    model = trained(encoded, lexicon, n)
    name, packed = uuid.uuid4().hex, model.pack()

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        if name not in _models:
            _models.clear()
            _models[name] = Model(lexicon).unpack(packed)
        for part in _batches(parts):
            ids, starts = _joined(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.add.reduceat(_models[name].log_probs(ids, starts), starts))], ["row", "lm"])

    lm = encoded.select("row", "ids").mapInArrow(run, "row long, lm double")
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts.select("word", "c"), "word", "left")
    known = F.coalesce(F.col("c"), F.lit(0))
    sums = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(known + SMOOTH)).alias("sum"), F.sum(F.when(known > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.when(known > 0, F.log10(known - discount)).otherwise(F.col("miss"))).alias("within"))
    out = encoded.drop("rare", "ids").join(lm, "row").join(sums, "row", "left")
    zero, floor = F.lit(0.0), log10(n + SMOOTH * (v + 1))
    base = F.col("base") + F.coalesce("sum", zero) - F.col("n_tokens") * F.lit(floor)
    score = F.col("lm") + F.col("inner") + F.coalesce("within", zero)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores the whole texts of all documents, held out or not."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2048)
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
