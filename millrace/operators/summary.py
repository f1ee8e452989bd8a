"""One-row summaries of a categorical and of a continuous variable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks
from ..functions.formatting import c_fixed, count_percent, make_unique
from .quantiles import exact_quantiles

PROBS = (0.05, 0.1, 0.2, 0.25, 0.5, 0.75, 0.8, 0.9, 0.95)


def category_levels(
    df: DataFrame,
    var_name: str,
    *,
    digits: int = 1,
    include_missing: bool = True,
    missing_label: str = "Missing",
    sort_levels: str = "desc",
    top_n: int | None = None,
    other_label: str = "Other",
    levels: Sequence[str] | None = None,
    collation: str | None = None,
) -> DataFrame:
    """(ord, level, n, share, is_other, cell): a row for each displayed level, in display order.

    Null and NaN are missing: they count under ``missing_label`` or not at all. With ``top_n`` the most frequent levels
    stay (ties by name) and the rest are one level, always last, that takes the first free name from ``other_label``.
    ``levels`` gives the order for ``sort_levels="levels"``; names are compared byte by byte or by ``collation`` (as "UNICODE" or
    "fr"). The data is aggregated by level; with ``top_n`` only that many levels go on. Without it all of them are shown and
    numbered in one task, so take it for columns of very many values.
    """
    checks.frame(df)
    checks.column(df, var_name)
    checks.whole(digits, "digits")
    checks.flag(include_missing, "include_missing")
    checks.label(missing_label, "missing_label")
    checks.label(other_label, "other_label")
    checks.choice(sort_levels, "sort_levels", ("desc", "asc", "alpha", "levels"))
    if top_n is not None:
        checks.whole(top_n, "top_n", 1)
    level = checks.as_level(df, var_name)
    level = F.coalesce(level, F.lit(missing_label)) if include_missing else level
    counts = df.select(level.alias("level")).filter("level is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("is_other", F.lit(False))
    every = Window.partitionBy(F.lit(0))
    name = F.col("level") if collation is None else F.collate("level", checks.label(collation, "collation"))
    if top_n is not None:
        top = counts.orderBy(F.desc("n"), name.asc()).limit(top_n)
        whole = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("of"))
        kept = top.agg(F.sum("n").alias("kept"), F.collect_set("level").alias("names"))
        tries = [F.lit(other_label), *[F.lit(f"{other_label}_{k}") for k in range(1, top_n + 2)]]
        free = F.element_at(F.filter(F.array(*tries), lambda x: ~F.array_contains(F.col("names"), x)), 1)
        rest = whole.crossJoin(F.broadcast(kept)).filter(F.col("of") > top_n)  # a row against a row
        counts = top.unionByName(rest.select(free.alias("level"), (F.col("all") - F.col("kept")).alias("n"), F.lit(True).alias("is_other")))
    given = list(levels) if levels is not None and sort_levels == "levels" else None
    if sort_levels == "asc":
        order = [F.asc("n"), name.asc()]
    elif sort_levels == "alpha":
        order = [name.asc()]
    elif given:
        place = F.array_position(F.array(*[F.lit(x) for x in given]), F.col("level"))
        order = [F.when(place == 0, F.lit(len(given) + 1)).otherwise(place), name.asc()]
    else:
        order = [F.desc("n"), name.asc()]
    share = F.col("n") / F.sum("n").over(every)
    return counts.select(
        F.row_number().over(every.orderBy("is_other", *order)).alias("ord"),
        "level",
        "n",
        share.alias("share"),
        "is_other",
        count_percent(F.col("n"), 100 * F.col("n") / F.sum("n").over(every), digits).alias("cell"),
    )


def category_summary(df: DataFrame, var_name: str, display_name: str | None = None, **how) -> DataFrame:
    """The same in one row: ``display_name`` ("Count n(%)"), a column for each level, Total. The levels are collected."""
    display = checks.label(display_name if display_name is not None else var_name, "display_name")
    rows = category_levels(df, var_name, **how).orderBy("ord").collect()
    digits = how.get("digits", 1)
    total = sum(r["n"] for r in rows)
    names = make_unique([display, *[r["level"] for r in rows], "Total"])
    cells = ["Count n(%)", *[r["cell"] for r in rows], f"{total} ({100.0 if total else 0.0:.{digits}f}%)"]
    return df.sparkSession.createDataFrame([tuple(cells)], T.StructType([T.StructField(n, T.StringType()) for n in names]))


#: Distinct values that one task may hold for exact quantiles.
MAX_HELD = 2_000_000


def quantile_labels(probs: Sequence[float]) -> list[str]:
    named = {0.25: "Q1", 0.5: "Q2", 0.75: "Q3"}
    return make_unique([named.get(p) or f"P{p * 100:.12g}" for p in probs])


def continuous_stats(df: DataFrame, var_name: str, *, finite_only: bool = True, probs: Sequence[float] = PROBS, distributed: bool | None = None) -> DataFrame:
    """One row of numbers: n, missing, non_missing, non_finite, analyzed, mean, sd, median, min, max, quantiles.

    Null and NaN are missing, infinities non-finite; with ``finite_only`` they aren't analysed. sd is the sample's,
    quantiles interpolate linearly (exact, type 7). With at most about ``MAX_HELD`` distinct values, counted first, one
    aggregation holds them in a task; with more, quantiles and median come from a range-partitioned sort. ``distributed``
    True or False chooses without the count; the numbers are the same.
    """
    checks.frame(df)
    checks.column(df, var_name)
    checks.flag(finite_only, "finite_only")
    p = checks.probabilities(probs)
    if not checks.is_numeric(df.schema[var_name].dataType):
        raise TypeError("`var_name` must be numeric.")
    v = checks.present(df, var_name).cast("double")
    wild = F.abs(v) == float("inf")
    x = F.when(wild, None).otherwise(v) if finite_only else v
    d = df.select(v.alias("v"), x.alias("x"), wild.alias("wild"))
    if distributed is None:
        distributed = d.agg(F.approx_count_distinct("x")).first()[0] > MAX_HELD
    if checks.flag(distributed, "distributed"):
        mid, *some = exact_quantiles(d, F.col("x"), [0.5, *[y for y in p if y != 0.5]])
        rest = iter(some)
        listed = [mid if y == 0.5 else next(rest) for y in p]
        median, quantiles = F.lit(mid).cast("double"), F.array(*[F.lit(y).cast("double") for y in listed])
    else:
        every = F.percentile("x", F.array(*[F.lit(y) for y in (0.5, *p)]))
        median, quantiles = F.get(every, F.lit(0)), F.slice(every, 2, len(p))
    return d.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("v").isNull()).alias("missing"),
        F.count("v").alias("non_missing"),
        F.count_if("wild").alias("non_finite"),
        F.count("x").alias("analyzed"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("sd"),
        median.alias("median"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        quantiles.alias("quantiles"),
    )


def continuous_summary(df: DataFrame, var_name: str, display_name: str | None = None, *, digits: int = 2, finite_only: bool = True, probs: Sequence[float] = PROBS, distributed: bool | None = None) -> DataFrame:
    """One display row: Variable, Mean_SD, Median, Min_Max, quantiles, Missing, N, NonMissing, MissingPct, NonFinite,
    Analyzed. Where nothing is analysed the texts are null; the sd of one value prints NA."""
    display = checks.label(display_name if display_name is not None else var_name, "display_name")
    checks.whole(digits, "digits")
    s = continuous_stats(df, var_name, finite_only=finite_only, probs=probs, distributed=distributed)
    t = lambda c: c_fixed(F.col(c) if isinstance(c, str) else c, digits)
    some = lambda c: F.when(F.col("analyzed") > 0, c)
    labels = quantile_labels(checks.probabilities(probs))
    return s.select(
        F.lit(display).alias("Variable"),
        some(F.concat(t("mean"), F.lit(" ("), F.coalesce(t("sd"), F.lit("NA")), F.lit(")"))).alias("Mean_SD"),
        some(t("median")).alias("Median"),
        some(F.concat(t("min"), F.lit(" - "), t("max"))).alias("Min_Max"),
        *[some(t(F.col("quantiles")[i])).alias(name) for i, name in enumerate(labels)],
        F.col("missing").alias("Missing"),
        F.col("n").alias("N"),
        F.col("non_missing").alias("NonMissing"),
        F.when(F.col("n") > 0, F.bround(100 * F.col("missing") / F.col("n"), 1)).alias("MissingPct"),
        F.col("non_finite").alias("NonFinite"),
        F.col("analyzed").alias("Analyzed"),
    )
