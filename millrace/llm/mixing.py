"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import named, packed, place, unpacked

#: More sources than this aren't collected; their rates are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000


def word_tokens(text: str = "text") -> Column:
    """Number of runs of characters other than space, tab, newline and carriage return; null has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: 48 bits of an MD5 digest."""
    hexed = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 12)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(1 << 48))


def source_rates(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    *,
    total_tokens: float | None = None,
    temperature: float | None = None,
    tokens: Column | None = None,
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """(source, tokens, rate) of every source with tokens; the null source is a source.

    The target weight is that of ``weights`` (sources it lacks get none, None is the null source), or equal for all sources, or with
    ``temperature`` a source's own tokens to that power. Weights are normalised over the sources that have tokens.
    rate = weight x total / tokens; the total is ``total_tokens``, or the tokens there are, or with ``temperature`` the
    least total at which no source's rate is below 1.
    """
    if tokens is None:
        sized = named(docs, source=source, text=text).select("source", word_tokens("text").alias("t"))
    else:
        rows, _ = packed(docs, tokens)
        sized = rows.select(F.col(f"c{place(docs, source)}").alias("source"), F.col(f"c{len(docs.columns)}").alias("t"))
    per = sized.groupBy("source").agg(F.sum("t").alias("tokens")).filter("tokens > 0")
    if weights is not None:
        if not weights or any(not w >= 0 or w == float("inf") for w in weights.values()):
            raise ValueError("weights must be finite numbers of at least 0")
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], T.StructType([T.StructField("s", docs.schema[place(docs, source)].dataType), T.StructField("w", T.DoubleType())]))
        per = per.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "tokens", F.coalesce("w", F.lit(0.0)).alias("w"))
    elif temperature is not None:
        per = per.withColumn("w", F.pow(F.col("tokens").cast("double"), F.lit(float(temperature))))
    else:
        per = per.withColumn("w", F.lit(1.0))
    exact = F.sum(F.col("w").cast("decimal(38,12)")).cast("double")  # the same in whatever order sources are added
    sums = per.agg(exact.alias("ws"), F.sum("tokens").cast("double").alias("ts"), F.max(F.col("tokens") / F.col("w")).alias("most"))
    rated = per.crossJoin(F.broadcast(sums))  # one row
    if total_tokens is not None:
        rate = F.col("w") * F.lit(float(total_tokens)) / (F.col("ws") * F.col("tokens"))
    elif temperature is not None and weights is None:
        rate = F.col("w") * F.col("most") / F.col("tokens")
    else:
        rate = F.col("w") * F.col("ts") / (F.col("ws") * F.col("tokens"))
    return rated.select("source", "tokens", F.when(F.col("ws") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    seed: int = 0,
    total_tokens: float | None = None,
    temperature: float | None = None,
    tokens: Column | None = None,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    copy: str | None = None,
) -> DataFrame:
    """Each row floor(rate) times and, with probability rate - floor(rate), once more; ``copy`` numbers them from 1.

    The extra copy depends on ``key`` and ``seed`` alone, so a rerun or a retried task draws the same. One pass counts
    tokens per source with partial sums, the other emits rows; the text is never shuffled. The rates come back to the
    driver when there are at most MAX_BROADCAST_SOURCES of them and are broadcast; beyond that they are joined.

    Defined cases: the null source is a source of its own. A source without tokens (all texts null or empty) has no rate
    and its rows are dropped, as are those of weight 0. Rows with a null key draw as the key "null". Repeated rows draw
    alike. Very long texts are counted whole. Columns of any name may be there; ``copy`` gets underscores behind it until it
    differs from them all. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, weights, total_tokens=total_tokens, temperature=temperature, tokens=tokens, source=source, text=text)
    kind = docs.schema[place(docs, source)].dataType
    rows, row = packed(docs)
    rows = rows.select(F.col(f"c{place(docs, source)}").alias("s"), F.col(f"c{place(docs, key)}").alias("k"), row.alias("r"))
    found = rates.select("source", "rate").limit(MAX_BROADCAST_SOURCES + 1).collect()
    if len(found) <= MAX_BROADCAST_SOURCES:
        table = spark.createDataFrame([tuple(x) for x in found], T.StructType([T.StructField("s2", kind), T.StructField("rate", T.DoubleType())]))
        joined = rows.join(F.broadcast(table), F.col("s").eqNullSafe(F.col("s2")))
    else:
        joined = rows.join(rates.select(F.col("source").alias("s2"), "rate"), F.col("s").eqNullSafe(F.col("s2")))
    whole = F.floor("rate")
    times = (whole + (uniform(F.col("k"), seed) < F.col("rate") - whole).cast("long")).cast("int")
    out = joined.withColumn("n", times).filter("n > 0").select("r", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return unpacked(out, "r", docs, **({copy: F.col("i")} if copy else {}))
