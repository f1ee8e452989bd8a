"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import packed, place, unpacked


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def exact_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", salts: int = 16, count: str | None = None) -> DataFrame:
    """One row of every group of rows with the same ``text``; the columns of ``docs``, and the group's size as ``count``.

    Rows combine in three steps: within a task (Spark's partial aggregation), within (digest, salt) groups and
    over the salts of a digest. In all three the whole text is part of the grouping key, so texts are equal byte
    for byte, and rows of equal digest but different text stay apart. A text that occurs a billion times reaches
    the second step as one row per task and salt, spread over ``salts`` tasks, and the third as at most ``salts`` rows.

    Defined cases: the row kept has the least ``key``, null keys last; ties go to the least values of the other columns
    in their order (map and variant columns can't be compared and break no tie). Null texts are one group, empty texts
    another. Very long texts are compared whole. An empty table gives an empty table. Columns of any name may be there: they travel
    inside a struct, and ``count`` gets underscores behind it until it differs from them all.
    """
    if salts < 1:
        raise ValueError("salts must be at least 1")
    k, t = place(docs, key), place(docs, text)
    rows, _ = packed(docs)
    q = lambda i: F.col(f"c{i}")
    ties = [q(i) for i, f in enumerate(docs.schema.fields) if i not in (k, t) and _orderable(f.dataType)]
    order: Column = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([q(k).isNull(), q(k), *ties])])
    row = F.struct(*[q(i) for i in range(len(docs.columns)) if i != t])
    d = rows.select(F.xxhash64(q(t)).alias("d"), F.pmod(F.xxhash64(q(k), F.lit(7)), F.lit(salts)).alias("s"), q(t).alias("t"), row.alias("r"), order.alias("o"))
    pick = lambda size: [F.min_by("r", "o").alias("r"), F.min("o").alias("o"), size.alias("n")]
    salted = d.groupBy("d", "s", "t").agg(*pick(F.count(F.lit(1))))
    whole = salted.groupBy("d", "t").agg(*pick(F.sum("n")))
    whole = whole.select(F.struct(*[(F.col("t") if i == t else F.col(f"r.c{i}")).alias(f"c{i}") for i in range(len(docs.columns))]).alias("r"), "n")
    return unpacked(whole, "r", docs, **({count: F.col("n")} if count else {}))
