"""Line dedup by an exact set-similarity join.

A line is the set of its five-word shingles; a line of one to four words has one shingle of all its words. Shingles are
ordered by rarity, then by hash; two lines of Jaccard similarity 0.8 or more share a shingle among the first
``n - ceil(0.8 n) + 1`` of each (prefix filter). Candidates pass the length and positional filters and are verified. A
line goes if an earlier line (by document id, then hash of the text, then line number) has the same set or a similar
one; whether that earlier line goes itself doesn't matter.

Two rounds find them. The first screens all lines at little cost: its order is by the hash of a shingle's first word, so that
words are hashed once and only the shingles of the prefix are made, as rows. Lines of equal words are one line before anything is joined:
an aggregation finds the first of each, and only that line's prefix takes part. A line whose prefix shingles it has alone is
similar to none and goes. The second round makes the sets of the lines that are left and orders them by rarity; of several
shingles that the same sets share one is enough. Bitmaps of 256 bits drop most of the other pairs that can't be similar. What
remains is a left semi join of the lines with themselves by shingle, whose condition filters and verifies: it has one row for
each line and shingle at most, never rows of pairs. Large groups are salted: their right side is dealt into blocks of
``BLOCK`` lines and the left side repeated for each.

Rarity comes from a table of shingle counts by hash bucket (2**16 buckets, over the sets of the second round): any order gives
the same result, a better one fewer candidates. A shingle is a hash of 57 bits there; in a prefix its rarity stands in front.

All work is DataFrame functions.

Edge cases: lines without words always stay; null and empty texts stay as they are; rows with one document id and one
text count as one document, whose lines don't match themselves by number; rows that share an id or have none are told
apart by a 64-bit hash of their texts; a document can end with an empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from math import log2
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluora.llm.common import cut, drop, fresh, let, noted, small, window_hashes, words

SHINGLE, BITS = 5, 57
BUCKETS = 1 << 16
#: Lines of a shingle's group that a task compares a line with at most.
BLOCK = 1024
#: Bitmaps of a set: 256 bits in all.
SKETCH = ("bits_0", "bits_1", "bits_2", "bits_3")
#: Lines (40 bytes each and 24 for each shingle that they share) that are broadcast at most.
BROADCAST = 1_000_000


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    # the outer forms: before others Spark puts filters that compute the array again
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(F.length("line") > 0)


def rarity(sets: DataFrame) -> str:
    """For each bucket a number below 64 that grows with the logarithm of its count of shingles in all sets (tokens); joined by commas."""
    rows = sets.select(F.explode("tokens").alias("t"))
    table = [1] * BUCKETS
    for bucket, n in rows.groupBy(F.col("t").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).count().collect():
        table[bucket] = min(63, 1 + int(2 * log2(1 + n)))
    return ",".join(map(str, table))


def shingles(line: Column) -> Column:
    """Hashes of the five-word windows of a line, repeats included; null for a line without words."""
    return let(words(line), lambda w: F.when(F.size(w) > 0, window_hashes(w, SHINGLE)))


def ranked(hashes: Column, table: str) -> Column:
    """57 bits of the distinct hashes with their rarity in front, rarest first."""
    ranks = F.split(F.lit(table), ",").cast("array<bigint>")  # folded into one literal
    rank = lambda h: F.coalesce(F.get(ranks, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(1).cast("long"))  # noqa: E731  never null, so sorted as primitives
    keys = F.transform(hashes, lambda h: F.shiftleft(rank(h), BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - BITS)))
    return F.sort_array(F.array_distinct(keys))


def _prefix(n: Column) -> Column:
    """The length of the prefix of a set of n shingles."""
    return n - F.floor((4 * n + 4) / 5).cast("int") + 1


def ordered(sets: DataFrame, *keep: str) -> DataFrame:
    """(``keep``, set_id, n, prefix) of the sets (tokens), whose shingles are ordered by their rarity among them; computed once."""
    rows = sets.select(*keep, ranked(F.col("tokens"), rarity(sets)).alias("tokens"))
    n = F.size("tokens")
    return cut(rows.select(*keep, F.xxhash64("tokens").alias("set_id"), n.alias("n"), F.slice("tokens", F.lit(1), _prefix(n)).alias("prefix")))


def prefixes(docs: DataFrame) -> DataFrame:
    """(line, doc_id, text_hash, line_no, set_id, n, prefix) of all lines with words; ``line`` numbers them."""
    rows = cut(_lines(docs).select(F.monotonically_increasing_id().alias("line"), "doc_id", "text_hash", "line_no", F.array_distinct(shingles(F.col("line"))).alias("tokens")))
    return ordered(rows.where("tokens is not null"), "line", "doc_id", "text_hash", "line_no")


def screened(docs: DataFrame) -> DataFrame:
    """(line, doc_id, text_hash, line_no, words_id, head, token): the screening shingles of all lines with words, computed once.

    ``line`` numbers the lines, lines of equal words share ``words_id``. The row with ``head`` alone says where a line is; it has
    no token if the line's first shingle isn't one of them. The shingles are those whose first word is among the line's first by hash: as many different first
    words as a prefix of all its windows would have shingles, or all. So the prefix of its set in that order is among them.
    They are rows, as those are hashed in generated code; a shingle may come twice, except in lines of many repeats.
    """
    keys = ("line", "doc_id", "text_hash", "line_no", "words_id")
    rows = _lines(docs).select("doc_id", "text_hash", "line_no", words("line").alias("w"))
    rows = rows.select(F.monotonically_increasing_id().alias("line"), *keys[1:4], F.xxhash64("w").alias("words_id"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    n = F.when(F.size("h") > 0, F.greatest(F.lit(1), F.size("h") - (SHINGLE - 1))).otherwise(0)
    rows = rows.select(*keys, "h", n.alias("n"), F.sort_array(F.array_distinct(F.slice("h", F.lit(1), n))).alias("heads"))
    starts = F.sequence(F.lit(0), F.col("n") - 1)
    many = F.col("n") > 2 * F.size("heads")
    # of lines of many repeats all shingles are taken, each once
    at = F.when(many, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(SHINGLE)])))).when(F.col("n") > 0, starts.cast("array<bigint>"))
    last = F.get("heads", F.least(_prefix(F.col("n")), F.size("heads")) - 1)
    rows = rows.select(*keys, "h", many.alias("many"), last.alias("last"), at.alias("at"))
    rows = rows.select(*keys, "h", "many", "last", F.posexplode_outer("at").alias("place", "at")).where("at is not null")
    i = F.col("at").cast("int")
    token = F.when(F.col("many"), F.col("at")).when(F.get("h", i) <= F.col("last"), F.xxhash64(*[F.get("h", i + j) for j in range(SHINGLE)]))
    rows = rows.where((F.col("place") == 0) | F.col("many") | (F.get("h", i) <= F.col("last")))
    head = F.col("place") == 0
    return cut(rows.select("line", *[F.when(head, F.col(c)).alias(c) for c in keys[1:]], head.alias("head"), token.alias("token")))


def bitmaps(sets: DataFrame) -> DataFrame:
    """(line, bits_*): 256 bits for each line of ``sets`` (line, tokens), with those that its shingles choose."""
    rows = sets.select("line", F.explode("tokens").alias("t"))
    word = F.shiftrightunsigned("t", 22).bitwiseAND(F.lit(len(SKETCH) - 1))
    one = F.expr("shiftleft(1L, cast(shiftrightunsigned(t, 16) & 63 as int))")
    return rows.groupBy("line").agg(*[F.bit_or(F.when(word == i, one).otherwise(F.lit(0).cast("long"))).alias(b) for i, b in enumerate(SKETCH)])


def _met(left: DataFrame, right: DataFrame, earlier: bool, exact: bool) -> DataFrame:
    """The rows of ``left`` that meet a row of ``right`` on an earlier (or later) line: a semi join in salted groups.

    Both have (token, place, n, at, blocks), and tokens where the match is to be ``exact``; else the filters decide, with
    the bitmaps of both: sets of similarity 0.8 differ in at most a ninth of their shingles, so their bitmaps do.
    """
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("a")
    right = right.withColumn("block", F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int")).alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    both = a("n") + b("n")
    hit = (a("token") == b("token")) & (a("block") == b("block")) & (b("place") < a("place") if earlier else b("place") > a("place"))
    hit = hit & (5 * a("n") >= 4 * b("n")) & (5 * b("n") >= 4 * a("n"))
    hit = hit & (9 * (F.least(a("at"), b("at")) + F.least(a("n") - a("at"), b("n") - b("at"))) >= 4 * both)
    if not exact:
        hit = hit & (9 * reduce(add, [F.bit_count(a(c).bitwiseXOR(b(c))) for c in SKETCH]) <= both)
    else:
        hit = hit & (9 * F.size(F.array_intersect(a("tokens"), b("tokens"))) >= 4 * both)
    return left.join(right, hit, "left_semi").drop("block")


def _sets(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, tokens): the sets of ``lines`` (line, place), read from their documents once."""
    few = lines.count() <= BROADCAST
    by_text = lines.groupBy(F.col("place.doc_id").alias("wanted_id"), F.col("place.text_hash").alias("wanted_hash")).agg(F.collect_list(F.struct("place.line_no", "line")).alias("wanted"))
    here = docs["doc_id"].eqNullSafe(F.col("wanted_id")) & (text_hash(docs["text"]) == F.col("wanted_hash"))
    some = docs.join(F.broadcast(by_text) if few else by_text, here)
    picked = let(F.split("text", "\n"), lambda x: F.transform("wanted", lambda w: F.struct(w["line"].alias("line"), F.get(x, w["line_no"]).alias("words"))))
    return cut(some.select(F.explode_outer(picked).alias("p")).select("p.line", F.array_distinct(shingles(F.col("p.words"))).alias("tokens")))


def met_lines(rows: DataFrame) -> DataFrame:
    """(line, place) of the lines of ``rows`` (``screened``) that share a shingle with another of them, computed once."""
    by_token = Window.partitionBy("token")
    # most tokens have one line and go at once
    met = rows.where("token is not null").select("line", "token").repartition(F.col("token"))
    met = met.select("line", F.min("line").over(by_token).alias("low"), F.max("line").over(by_token).alias("high")).where("low < high")
    some = rows.where("head").join(small(cut(met.select("line").distinct()), BROADCAST), "line", "left_semi")
    return cut(some.select("line", F.struct("doc_id", "text_hash", "line_no").alias("place")))


def similar_lines(docs: DataFrame, some: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no) of the lines of ``some`` (line, place), one for each sequence of words, that have a similar earlier one."""
    by_token = Window.partitionBy("token")
    sets = _sets(docs, some)
    entries = ordered(sets, "line").select("line", "n", F.posexplode("prefix").alias("at", "token")).withColumn("at", F.col("at") + 1)
    met = entries.repartition(F.col("token")).withColumn("size", F.count("*").over(by_token)).where("size > 1")
    shared = cut(met.withColumn("members", F.bit_xor(F.xxhash64("line")).over(by_token)))
    groups = shared.groupBy("size", "members").agg(F.min("token").alias("token")).select("token")
    shared = cut(shared.join(groups, "token", "left_semi").select("token", "line", "n", "at", "size"))
    sets = cut(sets.join(small(cut(shared.select("line").distinct()), BROADCAST), "line", "left_semi"))
    light = cut(shared.join(some, "line").join(bitmaps(sets), "line").select("token", "line", "place", "n", "at", *SKETCH, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    sides = [_met(light, light, side == "left", False).select("line", "place", F.struct("token", "at", "n", "blocks", F.lit(side).alias("side")).alias("entry")) for side in ("left", "right")]
    wanted = cut(sides[0].unionByName(sides[1]).groupBy("line", "place").agg(F.collect_set("entry").alias("entries")))
    full = cut(wanted.join(sets, "line").select("place", "tokens", "entries")).select("place", "tokens", F.explode("entries").alias("e")).select("place", "tokens", "e.*")
    return cut(_met(full.where("side = 'left'"), full.where("side = 'right'"), True, True).select("place.*"))


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no) of all lines of docs (doc_id, text) that have an earlier match; may hold one twice."""
    with noted([]) as screening:
        rows = screened(docs)
    lines = rows.where("head").drop("token")
    place = F.struct("doc_id", "text_hash", "line_no")
    many = small(cut(lines.groupBy("words_id").count().where("count > 1").select("words_id")), BROADCAST)
    firsts = lines.join(many, "words_id", "left_semi").groupBy("words_id").agg(F.min(F.struct(place.alias("place"), "line")).alias("first"))
    firsts = small(cut(firsts), BROADCAST)
    others = lines.select("line", "words_id", place.alias("place")).join(firsts, "words_id").where("line != first.line")
    others = cut(others.select("line", "place", (F.col("place") > F.col("first.place")).alias("later")))
    copies = others.where("later").select("place.*")
    alone = rows.join(small(others.select("line"), BROADCAST), "line", "left_anti")
    some = met_lines(alone)
    drop(docs.sparkSession, screening)  # the largest table; nothing reads it any more
    return copies.unionByName(similar_lines(docs, some))


def deduplicated(docs: DataFrame) -> DataFrame:
    """All rows as (record, text, n_lines, removed): the record with its text but the removed lines, and their numbers.

    ``docs`` has doc_id and text; other columns stay in the record.
    """
    gone = cut(removed(docs.select("doc_id", "text")))
    few = gone.count() <= BROADCAST
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    record, ident = fresh(docs.columns, "record"), fresh(docs.columns, "ident")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(record), F.col("doc_id").alias(ident))
    here = F.col(ident).eqNullSafe(F.col("gone_id")) & (text_hash(F.col(record)["text"]) == F.col("gone_hash"))
    out = rows.join(F.broadcast(gone) if few else gone, here, "left")
    split = F.split(F.col(record)["text"], "\n")
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col(record)["text"]).otherwise(kept)
    return out.select(F.col(record).alias("record"), text.alias("text"), F.coalesce(F.size(split), F.lit(0)).alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines that have an earlier match."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("record.doc_id").alias("doc_id"), "n_lines", F.size("removed").alias("n_removed"), "removed", "text")
