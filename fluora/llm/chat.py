"""Chat formatting from event logs.

A log row is an event (conversation, sequence number, message, kind, role, text), delivered once or more. Events are partitioned by
conversation and message, sorted by sequence, and folded: ``message`` sets the text, ``delta`` appends to it, ``edit``
replaces it, ``regenerate`` starts it again. Messages are then ordered within their conversation and rendered.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a backslash is doubled and
one is put after the first character of each control string, so no text can hold a control string and ``\\\\x`` always
reads back as ``x``. The loss mask is a run of (head, body) lengths for each turn: body characters of assistant turns
carry loss.

A conversation is one output row, so its turns meet in one task; they are collected as partial lists, no window.

Edge cases: null text or role is empty; null conversations and turns are values like any other (nulls sort first); rows
equal in conversation and turn are ordered by role, then text, and each stays a turn; events without a ``message`` make
a message of their deltas; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that tokenizers of common chat templates read as control tokens.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_CONTROL_AT = "(?=" + "|".join(re.escape(c) for c in CONTROL) + ")(.)"


def escape(text: Column) -> Column:
    """Text without control strings; ``unescape`` gives it back."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL_AT, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of events (conv_id, seq, message, kind, role, text).

    Where logs share message ids, a column ``part`` tells their messages apart. Events that are equal in all of this are
    deliveries of one event, of whatever kind.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    part = ["part"] if "part" in events.columns else []
    listed = events.groupBy("conv_id", "message", *part).agg(F.sort_array(F.collect_set(event)).alias("events"), F.coalesce(F.max("role"), F.lit("")).alias("role"))
    # from the last event that sets the text on, deltas are joined
    numbered = F.transform("events", lambda e, i: F.when(e["kind"] != "delta", i))
    last = F.coalesce(F.array_max(numbered), F.lit(0))
    tail = F.slice("events", F.col("last") + 1, F.size("events"))
    text = F.array_join(F.transform(tail, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "")
    return listed.withColumn("last", last).select("conv_id", "message", "role", text.alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask) of final messages; mask has (head, body, loss) for each turn, in characters."""
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learn).alias("loss")))
    turns = turns.select("conv_id", parts.alias("parts"))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform("parts", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["loss"].alias("loss"))).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, learned) from formatted conversations and their masks; learned is the text under the mask."""
    end = re.escape(END[:-1]) + "\n"
    pieces = F.filter(F.split("formatted", end), lambda p: p != "")
    role = lambda p: unescape(F.regexp_extract(p, re.escape(START) + r"((?:[^\\\n]|(?s:\\.))*)\n", 1))
    body = lambda p: unescape(F.regexp_replace(p, "^" + re.escape(START) + r"(?:[^\\\n]|(?s:\\.))*\n", ""))
    return formatted.withColumn("pieces", pieces).select(
        "conv_id",
        F.transform("pieces", lambda p: F.struct(role(p).alias("role"), body(p).alias("text"))).alias("turns"),
        F.array_join(F.zip_with("pieces", "mask", lambda p, m: F.when(m["loss"], unescape(F.substring(p, m["head"] + 1, m["body"]))).otherwise(F.lit(""))), "").alias("learned"),
        F.length("formatted").alias("chars"),
    )


def events_of(rows: DataFrame) -> DataFrame:
    """An event log that ends in the turns of a table: user turns as drafts that are edited, others as streams.

    A row's message begins with half of its text. The users' is edited to the whole text; the others' is regenerated,
    then streamed in two deltas. Rows of one turn are told apart by a hash of role, text and number of occurrence: equal rows
    are counted, and each number makes a message of its own.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    event = lambda seq, kind, of: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), of.alias("text"))
    edited = F.array(event(0, "message", first), event(1, "edit", F.col("text")))
    streamed = F.array(event(0, "message", first), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", second))
    named = rows.select("conv_id", F.col("turn").alias("message"), role.alias("role"), text.alias("text"))
    named = named.groupBy("conv_id", "message", "role", "text").agg(F.count("*").alias("n")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    log = F.explode(F.when(F.col("role") == "user", edited).otherwise(streamed))
    return named.select("conv_id", "message", F.xxhash64("role", "text", "nth").alias("part"), "role", log.alias("e")).select("conv_id", "e.seq", "message", "part", "e.kind", "role", "e.text")


def op10_chat(spark, sf_dir: str) -> DataFrame:
    """Formats all conversations and one more, -7, and reads turns and loss text back from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT -7L conv_id, turn, role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    back = read_back(render(fold(events_of(rows.unionByName(more)))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length('{START}') + length({_sql_escaped("role")}) + length(role) - length(replace(role, chr(10), '')) + 1
    + length({_sql_escaped("text")}) + {len(END)})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
