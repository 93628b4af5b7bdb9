"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are its context
and only its reply is trainable. What stands after the last assistant turn trains nothing
but is still part of the conversation, so it comes out as one more example without a target.

Template: each turn is START role newline text END. Inside roles and texts a backslash is
written \\b, and the first character of a control string is written \\l (for <) or \\k (for [),
so that no control string can occur in them; a newline in a role is written \\n. The
way back replaces \\l, \\k and \\n first and \\b last.

Defined results: a null text or role is empty; a null turn sorts before all others; turns
that share a number are ordered by role, then text; a conversation without an assistant
turn gives one example without a target. Rows of a null conv_id form one conversation.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that chat templates in use read as control.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _tails(first: str) -> str:
    return "|".join(re.escape(c[1:]).replace("\\<", "<").replace("\\>", ">") for c in CONTROL if c[0] == first)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.regexp_replace(out, f"<(?={_tails('<')})", r"\\l")
    return F.regexp_replace(out, rf"\[(?={_tails('[')})", r"\\k")


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\k"), F.lit("["))
    return F.replace(F.replace(out, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, example (from 0), n_examples, formatted, loss_start, loss_end (code points; equal: no target)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rendered = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escape(text), F.lit(END))
    turns = rows.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), rendered.alias("rendered"), F.length(escape(text)).alias("n")).alias("turn"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    numbers = F.sequence(F.lit(1), F.size("turns"))
    ends = F.filter(numbers, lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == F.size("turns")))
    one = whole.select("conv_id", "turns", F.size(ends).alias("n_examples"), F.posexplode(ends).alias("example", "end"))
    last = F.element_at("turns", F.col("end"))
    formatted = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("end")), lambda t: t["rendered"]), "")
    stop = F.length("formatted") - len(END)
    return one.select("conv_id", "example", "n_examples", formatted.alias("formatted"), (last["role"] == "assistant").alias("target"), last["n"].alias("n")).select(
        "conv_id", "example", "n_examples", "formatted", F.when(F.col("target"), stop - F.col("n")).otherwise(stop).cast("long").alias("loss_start"), stop.cast("long").alias("loss_end")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>."""
    pieces = F.split(formatted, re.escape(END).replace("\\\n", "\n"), -1)
    bodies = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2)).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, what the formatted examples say when they are read back."""
    full = F.col("example") == F.col("n_examples") - 1
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id", "example",
        F.length("formatted").cast("long").alias("chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.when(full, F.size(turns)).cast("long").alias("n_turns"),
        F.when(full, F.sha2(said, 256)).alias("turns_sha256"),
    )
    grouped = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
    )
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op8_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return digest(format_conversations(rows.unionByName(extra)))


def _sql() -> str:
    """The digests straight from the turns; the template only gives formatted_chars."""
    marks = "|".join(re.escape(c).replace("\\<", "<").replace("\\>", ">") for c in CONTROL)
    escaped = lambda c: f"length({c}) + length({c}) - length(replace({c}, '\\', '')) + len(regexp_extract_all({c}, '{marks}'))"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, {len(START) + 1 + len(END)} + {escaped('role')} + {escaped('text')} AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM t),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY back DESC ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY back DESC)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY back DESC) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR back = 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


QUERIES = {"op8_prefix_targets": op8_prefix_targets}
ORACLE = {"op8_prefix_targets": _sql()}
