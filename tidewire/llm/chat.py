r"""Chat formatting: event-sourced reconstruction, DataFrame functions only.

A log row is (conv_id, turn, seq, op, role, text). Within a conversation and
turn, in order of seq: ``message`` starts a message, ``delta`` appends to the
newest, ``edit`` replaces its text and ``regenerate`` discards it for what
follows (its own text, if any, begins the new one). Only the events after a
message's last reset are joined, so folding is linear. A table without seq and
op holds final messages: each row is one ``message`` at its turn.

Rendered, a turn is ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``.
Inside roles and texts every backslash is doubled and every control string
gets a backslash after its first character, so a text can never open or close
a turn; dropping one backslash of each pair and every single one restores it.
The loss mask marks the assistant texts: ``segments`` cuts the formatted text
into runs, each wholly in or out of the mask.

Rows: null texts and roles are empty; null turns come first; a null conv_id is
one conversation of its own. Repeated rows and rows with the same turn are all
kept, by role and then text. A very long conversation is one row, which bounds
its size. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What must not occur in a text as it is: this template's marks and those of other common ones.
CONTROLS = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, turn, m, role, text): the final messages; m numbers those of one turn."""
    if "op" in log.columns and "seq" in log.columns:
        e = log.select("conv_id", "turn", "seq", "op", "role", "text")
    else:
        e = log.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("op"), "role", "text")
    e = e.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumns({"n": F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("seq", "role", "text")), "m": F.sum((F.col("op") == "message").cast("int")).over(order)})
    own = Window.partitionBy("conv_id", "turn", "m")
    e = e.withColumn("reset", F.max(F.when(F.col("op") != "delta", F.col("n"))).over(own))
    parts = F.sort_array(F.collect_list(F.when(F.col("n") >= F.coalesce("reset", F.lit(0)), F.struct("n", "text"))))
    return e.groupBy("conv_id", "turn", "m").agg(F.min_by("role", "n").alias("role"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<text, loss>>."""
    m = messages.select("conv_id", F.struct(F.col("turn"), F.col("m"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss")).alias("t"))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    each = lambda t: F.array(seg(F.concat(F.lit(START), t["role"], F.lit(SEP)), F.lit(False)), seg(t["text"], t["loss"]), seg(F.lit(END), F.lit(False)))
    out = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("conv_id", F.flatten(F.transform("ts", each)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def turns_of(formatted: Column) -> Column:
    """The turns array<struct<role, text>> read back from a formatted text."""
    raw = F.slice(F.split(formatted, re.escape(END), -1), 1, F.size(F.split(formatted, re.escape(END), -1)) - 1)

    def back(x: Column) -> Column:
        two = F.split(x, re.escape(SEP), -1)
        return F.struct(unescape(F.substr(two[0], F.lit(len(START) + 1))).alias("role"), unescape(two[1]).alias("text"))

    return F.transform(raw, back)


def digest(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = rendered.select(
        "conv_id",
        turns_of(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(whole).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars")


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (SELECT *, {_escaped_sql("role")} AS er, {_escaped_sql("text")} AS et FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(er) + length(et) + {len(START + SEP + END)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
