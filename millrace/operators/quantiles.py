"""Exact quantiles of columns too large for one task's memory."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..scratch import written


def exact_quantiles(df: DataFrame, value: Column, probs: Sequence[float]) -> list[float | None]:
    """Linearly interpolated (type 7) quantiles of the non-null values, one for each of ``probs``.

    Distinct values are counted (combined where they are read), sorted by range into partitions and written with their
    partition's number. Only the partitions' totals come to the driver; of the values just those at the wanted ranks.
    No task holds more than its range. Without values all are None.
    """
    p = checks.probabilities(probs)
    counts = df.select(value.cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "quantiles")
    totals = ranged.groupBy("part").agg(F.sum("n").alias("n"), F.min("v").alias("low")).orderBy("low").collect()
    size = sum(r["n"] for r in totals)
    if not size:
        return [None] * len(p)
    at = [x * (size - 1) for x in p]
    ranks = sorted({r for x in at for r in (floor(x), ceil(x))})
    wanted, before = [], 0
    for r in totals:
        wanted += [(r["part"], k - before, k) for k in ranks if before <= k < before + r["n"]]
        before += r["n"]
    targets = F.broadcast(df.sparkSession.createDataFrame(wanted, "part int, inside long, k long"))  # two a quantile
    run = Window.partitionBy("part").orderBy("v")
    near = ranged.join(targets.select("part").distinct(), "part", "left_semi").withColumn("upto", F.sum("n").over(run))
    hit = near.join(targets, "part").filter((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n")))
    found = {r["k"]: r["v"] for r in hit.select("k", "v").collect()}
    return [found[floor(x)] + (x - floor(x)) * (found[ceil(x)] - found[floor(x)]) for x in at]
