"""Chat formatting: snapshots of a growing conversation collapse into the longest, which is rendered."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written
from .frames import named


@F.pandas_udf(T.ArrayType(T.StringType()))
def rolled(digests: pd.Series) -> pd.Series:
    """For every list the MD5 digest of each of its prefixes, each made from the one before it."""
    out = []
    for some in digests:
        last, own = "", []
        for d in some:
            last = hashlib.md5((last + d).encode(), usedforsecurity=False).hexdigest()
            own.append(last)
        out.append(own)
    return pd.Series(out)


def maximal_conversations(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns, h): conversations that are no proper prefix of another and, among equal ones, the least conv_id.

    A conversation's turns are one cell of the result, so they meet in one task; rows that repeat are dropped before that.
    Every conversation gets rolling MD5 hashes of its turn prefixes. A conversation whose last hash is the hash of a
    shorter prefix of another is a snapshot of it and goes by an anti-join; only hashes and ids are shuffled for that.
    """
    t = named(turns, conv_id=conv, turn=turn, role=role, text=text)
    t = t.select("conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("x"))
    t = t.filter(F.col("conv_id").isNotNull())
    whole = t.groupBy("conv_id").agg(F.array_sort(F.collect_set("x")).alias("turns"))
    # the role's length keeps role and text apart
    each = F.transform("turns", lambda x: F.md5(F.concat(F.length(x["role"]).cast("string"), F.lit(":"), x["role"], x["text"]).cast("binary")))
    whole = written(whole.withColumn("h", rolled(each)), "chats")
    ids = whole.select("conv_id", "h")
    last = ids.groupBy(F.element_at("h", -1).alias("end")).agg(F.min("conv_id").alias("conv_id"))
    inner = ids.select(F.explode(F.slice("h", 1, F.size("h") - 1)).alias("end")).distinct()
    kept = last.join(inner, "end", "left_anti").select("conv_id")
    return whole.join(kept, "conv_id", "left_semi")


def format_chats(
    turns: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    start: str = "<|im_start|>",
    end: str = "<|im_end|>",
) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations, each turn as start, role, newline, text, end, newline.

    Defined cases: rows with a null conv_id belong to no conversation and go. A null role renders as "unknown", a null
    text as the empty text. Turns are ordered by (turn, role, text), a null turn first; a repeated row counts once, while
    different texts at one turn number are both kept. Equal conversations leave the least conv_id. A text that holds the
    markers gets a zero-width space behind their first character, so no text can open or close a turn. The conv_id keeps its
    type. Very long texts are rendered whole; the work is linear in a conversation's turns. Other columns are ignored, whatever
    their names. An empty table gives an empty table.
    """
    safe = lambda c: F.replace(F.replace(c, F.lit(start), F.lit(start[0] + "​" + start[1:])), F.lit(end), F.lit(end[0] + "​" + end[1:]))
    kept = maximal_conversations(turns, conv=conv, turn=turn, role=role, text=text)
    parts = F.transform("turns", lambda x: F.concat(F.lit(start), safe(x["role"]), F.lit("\n"), safe(x["text"]), F.lit(end + "\n")))
    return kept.select("conv_id", F.size("turns").alias("n_turns"), F.array_join(parts, "").alias("rendered"))
