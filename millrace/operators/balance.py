"""Covariate balance of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks

COLUMNS = ("variable", "type", "level", "prop1", "prop2", "diff", "n1", "mean1", "sd1", "n2", "mean2", "sd2", "smd", "miss_n1", "miss_pct1", "miss_n2", "miss_pct2")


def compare_balance(
    df1: DataFrame,
    df2: DataFrame,
    variables: Sequence[str],
    *,
    weights1: str | None = None,
    weights2: str | None = None,
    digits: int | None = 4,
    include_smd: bool = False,
    levels: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """A row for each continuous variable and for each level of a categorical one, in the order of ``variables``.

    Continuous: numeric on both sides. n counts finite values. Without weights the mean and the sample sd of the
    non-missing values, infinities included; with a weight column those of rows finite in both, sd as of the population.
    Otherwise categorical: proportions among non-missing values, weighted on request, for all levels of ``levels`` or of
    either side in the alphabet; logical variables have FALSE and TRUE. A variable that one side lacks counts as logical and
    missing there, so it is categorical and has FALSE and TRUE among its levels. smd is the difference over the root
    of the mean variance. ``digits=None`` leaves numbers unrounded. A side is read once for all continuous
    variables (twice with weights) and once for all categorical ones.
    """
    checks.frame(df1, "df1")
    checks.frame(df2, "df2")
    checks.flag(include_smd, "include_smd")
    variables = [variables] if isinstance(variables, str) else list(variables)
    lost = [v for v in variables if v not in df1.columns and v not in df2.columns]
    if lost:
        raise ValueError(f"These variables are in neither table: {', '.join(lost)}.")
    for df, w, name in ((df1, weights1, "weights1"), (df2, weights2, "weights2")):
        if w is not None and (w not in df.columns or not checks.is_numeric(df.schema[w].dataType)):
            raise ValueError(f"`{name}` must name a numeric column.")
    sides = ((df1, weights1), (df2, weights2))
    numeric = lambda df, v: v in df.columns and checks.is_numeric(df.schema[v].dataType)
    both = [(i, v) for i, v in enumerate(variables) if numeric(df1, v) and numeric(df2, v)]
    rest = [(i, v) for i, v in enumerate(variables) if (i, v) not in both]
    parts = ([_continuous(sides, both)] if both else []) + ([_categorical(sides, rest, levels or {})] if rest else [])
    pct = lambda k: F.when(F.col(f"rows{k}") > 0, 100 * F.col(f"miss_n{k}") / F.col(f"rows{k}"))
    shared = {"variable": F.get(F.array(*[F.lit(v) for v in variables]), F.col("at")), "miss_pct1": pct(1), "miss_pct2": pct(2)}
    parts = [p.withColumns(shared).select("at", "level_at", *COLUMNS) for p in parts]
    out = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    if digits is not None:
        checks.whole(digits, "digits")
        out = out.withColumns({f.name: F.bround(f.name, digits) for f in out.schema.fields if isinstance(f.dataType, T.DoubleType)})
    return out.orderBy("at", "level_at").select(*[c for c in COLUMNS if c != "smd" or include_smd])


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _inline(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*rows)))


def _side(df: DataFrame, named: list[tuple[int, str]], w: str | None, k: int) -> DataFrame:
    """A row for each variable from one aggregation over all of them; with weights their means are one more before it."""
    xs = [checks.present(df, v).cast("double").alias(f"x{i}") for i, v in named]
    d = df.select(*xs, *([checks.q(w).cast("double").alias("w")] if w else []))
    x = lambda i: F.col(f"x{i}")
    if w:
        ok = lambda i: _finite(x(i)) & _finite(F.col("w"))
        total = lambda i, c: F.sum(F.when(ok(i), c)) / F.nullif(F.sum(F.when(ok(i), F.col("w"))), F.lit(0.0))
        means = d.agg(*[total(i, F.col("w") * x(i)).alias(f"mu{i}") for i, _ in named])  # one row: the second pass is stable
        d = d.crossJoin(F.broadcast(means))
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, _ in named:
        mean, sd = F.avg(x(i)), F.stddev_samp(x(i))
        if w:
            mean, sd = F.first(f"mu{i}"), F.sqrt(total(i, F.col("w") * F.pow(x(i) - F.col(f"mu{i}"), 2)))
        aggs += [F.count_if(x(i).isNull()).alias(f"miss{i}"), F.count_if(_finite(x(i))).alias(f"n{i}"), mean.alias(f"mean{i}"), sd.alias(f"sd{i}")]
    row = lambda i: F.struct(F.lit(i).alias("at"), F.col("rows").alias(f"rows{k}"), F.col(f"miss{i}").alias(f"miss_n{k}"), F.col(f"n{i}").alias(f"n{k}"), F.col(f"mean{i}").alias(f"mean{k}"), F.col(f"sd{i}").alias(f"sd{k}"))
    return _inline(d.agg(*aggs), [row(i) for i, _ in named])


def _continuous(sides, named: list[tuple[int, str]]) -> DataFrame:
    a, b = (_side(df, named, w, k) for k, (df, w) in enumerate(sides, 1))
    both = a.join(b, "at")
    diff = F.col("mean2") - F.col("mean1")
    pooled = F.sqrt((F.pow("sd1", F.lit(2)) + F.pow("sd2", F.lit(2))) / 2)
    none = F.lit(None).cast("double")
    return both.withColumns({"type": F.lit("continuous"), "diff": diff, "smd": F.when(_finite(pooled) & (pooled > 0), diff / pooled), "level_at": F.lit(0), "level": F.lit(None).cast("string"), "prop1": none, "prop2": none})


def _categorical(sides, named: list[tuple[int, str]], given: dict[str, Sequence[str]]) -> DataFrame:
    """A row for each level of each variable; all variables of a side are counted by level in one aggregation."""
    spark = sides[0][0].sparkSession
    tables, totals, logical = [], spark.createDataFrame([(i,) for i, _ in named], "at int"), set()
    for k, (df, w) in enumerate(sides, 1):
        rows = []
        for i, v in named:
            there = v in df.columns
            if not there or isinstance(df.schema[v].dataType, T.BooleanType):
                logical.add(i)
            rows.append(F.struct(F.lit(i).alias("at"), (checks.as_level(df, v) if there else F.lit(None).cast("string")).alias("level")))
        weight = checks.q(w).cast("double") if w else F.lit(1.0)
        d = df.select(F.when(_finite(weight), weight).alias("w"), F.inline(F.array(*rows)))
        t = d.groupBy("at", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
        known = F.col("level").isNotNull()
        tables.append(t.filter(known).select("at", "level", F.col("w").alias(f"w{k}")))
        total = t.groupBy("at").agg(F.sum("n").alias(f"rows{k}"), F.sum(F.when(known, F.col("n"))).alias(f"n{k}"), F.sum(F.when(~known, F.col("n"))).alias(f"miss_n{k}"), F.sum(F.when(known, F.col("w"))).alias(f"all{k}"))
        totals = totals.join(total, "at", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in (f"rows{k}", f"n{k}", f"miss_n{k}")})
    listed = [(i, x, p) for i, v in named for p, x in enumerate(dict.fromkeys([*given.get(v, ()), *(["FALSE", "TRUE"] if i in logical else [])]))]
    fixed = spark.createDataFrame(listed, "at int, level string, place int")
    found = tables[0].join(tables[1], ["at", "level"], "full_outer").join(fixed, ["at", "level"], "full_outer")
    found = found.withColumn("level_at", F.row_number().over(Window.partitionBy("at").orderBy(F.col("place").asc_nulls_last(), "level")))
    out = totals.join(found, "at", "left").withColumn("level_at", F.coalesce("level_at", F.lit(0)))
    prop = lambda k: F.when(F.col("level").isNotNull() & (F.col(f"all{k}") != 0), F.coalesce(F.col(f"w{k}"), F.lit(0.0)) / F.col(f"all{k}"))
    out = out.withColumns({"prop1": prop(1), "prop2": prop(2)}).withColumn("diff", F.col("prop2") - F.col("prop1"))
    none = F.lit(None).cast("double")
    return out.withColumns({"type": F.lit("categorical"), "mean1": none, "sd1": none, "mean2": none, "sd2": none, "smd": none})
