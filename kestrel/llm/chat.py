"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns up to and including it are formatted, and
only that reply is trainable (``loss_start``/``loss_end``, code-point offsets, end exclusive).
Turns after the last reply go into one final example without a target, so that no turn is lost.

Template of a turn: ``<|role|>`` newline, text, ``<|end|>`` newline.  Inside role and text each
of ``\\``, ``<``, ``[`` and ``|`` is followed by a backslash, so neither the template's markers
nor other templates' control strings (``</s>``, ``[INST]``) can appear; dropping the backslash
after each of the four restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import missing

END = "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[|])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[|])\\", "$1")


def format_chats(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (from 0), last (the conversation's final example),
    text, loss_start, loss_end (both -1 in an example without a target).

    ``turns`` has conv_id, turn, role, text; null role or text count as empty, a null conv_id is
    a conversation of its own, null turns come first, and rows with the same turn are ordered by
    role and text (repeated rows stay repeated).  Other columns are ignored.  An empty table
    gives no example.  A conversation is assembled in one row, as its examples repeat it.
    """
    missing(turns, "conv_id", "turn", "role", "text")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("conv_id", "turn", "role", "text",
                 F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")).alias("head"),
                 escape(F.col("text")).alias("body"))
    t = t.select("conv_id", F.struct(
        "turn", "role", "text", F.concat("head", "body", F.lit(END)).alias("seg"),
        F.length("head").alias("head"), F.length("body").alias("body")).alias("t"))
    convs = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # running state over the turns: end offset of each turn in the formatted conversation
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(
        "array<struct<loss_start:int,loss_end:int,stop:int>>").alias("ex"))
    walked = F.aggregate("ts", zero, lambda s, x: F.struct(
        (s["at"] + F.length(x["seg"])).alias("at"),
        F.when(x["role"] == target_role, F.concat(s["ex"], F.array(F.struct(
            (s["at"] + x["head"]).alias("loss_start"),
            (s["at"] + x["head"] + x["body"]).alias("loss_end"),
            (s["at"] + F.length(x["seg"])).alias("stop"))))).otherwise(s["ex"]).alias("ex")))
    convs = convs.select("conv_id", F.array_join(F.transform("ts", lambda x: x["seg"]), "")
                         .alias("whole"), walked.alias("w"))
    tail = F.struct(F.lit(-1).alias("loss_start"), F.lit(-1).alias("loss_end"),
                    F.col("w.at").alias("stop"))
    done = F.exists(F.col("w.ex"), lambda e: e["stop"] == F.col("w.at"))
    convs = convs.select("conv_id", "whole", F.when(done, F.col("w.ex")).otherwise(
        F.concat(F.col("w.ex"), F.array(tail))).alias("ex"))
    return convs.select("conv_id", "whole", F.size("ex").alias("n"),
                        F.posexplode("ex").alias("example", "e")).select(
        "conv_id", "example", (F.col("example") == F.col("n") - 1).alias("last"),
        F.substring("whole", F.lit(1), F.col("e.stop")).alias("text"),
        "e.loss_start", "e.loss_end")


def parse_example(text: Column) -> Column:
    """Turns of a formatted example, unescaped: array of (role, text)."""
    segments = F.split(text, r"<\|end\|>\n", -1)
    segments = F.slice(segments, 1, F.size(segments) - 1)
    return F.transform(segments, lambda s: F.struct(
        unescape(F.regexp_extract(s, r"(?s)^<\|(.*?)\|>\n", 1)).alias("role"),
        unescape(F.regexp_extract(s, r"(?s)^<\|.*?\|>\n(.*)$", 1)).alias("text")))


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped (empty without a target)."""
    return F.when(start >= 0, unescape(F.substring(text, start + 1, end - start))).otherwise("")


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation, read from its examples: n_turns and turns_sha256 from the
    final example, loss_chars and loss_sha256 from the loss spans of all examples in order,
    n_examples, and formatted_chars (code points of all examples)."""
    rows = examples.select(
        "conv_id", F.length("text").cast("long").alias("chars"),
        F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end"))
                 .alias("loss")).alias("loss"),
        F.when(F.col("last"), F.col("text")).alias("whole"))
    convs = rows.groupBy("conv_id").agg(
        F.max("whole").alias("whole"), F.sort_array(F.collect_list("loss")).alias("losses"),
        F.count("*").alias("n_examples"), F.sum("chars").alias("formatted_chars"))
    convs = convs.select("conv_id", "n_examples", "formatted_chars",
                         parse_example(F.col("whole")).alias("turns"),
                         F.array_join("losses.loss", "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_examples")
