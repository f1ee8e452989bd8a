"""Cross-tables with margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks
from ..functions.formatting import count_percent


def _levels(spark, d: DataFrame, side: str, given: Sequence[str] | None, missing_label: str) -> DataFrame:
    """(level, ord) of a side: the given order, kept though unused, or first appearance; missing comes last."""
    seen = d.groupBy(F.col(side).alias("level")).agg(F.min("at").alias("at"))
    if given is not None:
        listed = spark.createDataFrame([(x, i) for i, x in enumerate(given)], "level string, place int")
        seen = listed.join(seen, "level", "full_outer").withColumn("at", F.coalesce("place", F.lit(len(given))).cast("long"))
    late = (F.col("level") == missing_label).cast("int")
    return seen.select("level", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(late, "at", "level")).alias("ord"))


def crosstab_long(
    df: DataFrame,
    row_var: str,
    col_var: str,
    *,
    percent: str = "row",
    include_missing: bool = True,
    include_total: bool = True,
    digits: int = 1,
    missing_label: str = "Missing",
    row_levels: Sequence[str] | None = None,
    col_levels: Sequence[str] | None = None,
    order_by: str | None = None,
) -> DataFrame:
    """(row_ord, row_level, col_ord, col_level, n, share, cell); margins have the level "Total" and the last ord.

    Level order is that of ``row_levels`` and ``col_levels`` (unused ones are kept as zeros), else first appearance along
    ``order_by``, else the alphabet. With ``include_missing`` a null or NaN is the level ``missing_label``, else a
    row that has one on either side is left out. A share without denominator is 0. Counts are aggregated
    once over the data; levels, zeros and margins are made from that small table.
    """
    checks.frame(df)
    checks.column(df, row_var, "row_var")
    checks.column(df, col_var, "col_var")
    checks.choice(percent, "percent", ("row", "column", "total", "none"))
    checks.flag(include_missing, "include_missing")
    checks.flag(include_total, "include_total")
    checks.whole(digits, "digits")
    checks.label(missing_label, "missing_label")
    spark = df.sparkSession
    r, c = checks.as_level(df, row_var), checks.as_level(df, col_var)
    at = checks.q(order_by).cast("long") if order_by else F.lit(0).cast("long")
    d = df.select(r.alias("r"), c.alias("c"), at.alias("at"))
    d = d.fillna(missing_label, ["r", "c"]) if include_missing else d.dropna(subset=["r", "c"])
    counts = d.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    rows = _levels(spark, counts, "r", row_levels, missing_label).select(F.col("level").alias("r"), F.col("ord").alias("row_ord"))
    cols = _levels(spark, counts, "c", col_levels, missing_label).select(F.col("level").alias("c"), F.col("ord").alias("col_ord"))
    grid = rows.crossJoin(cols).join(counts.drop("at"), ["r", "c"], "left").fillna(0, ["n"])
    in_row, in_col, in_all = Window.partitionBy("r"), Window.partitionBy("c"), Window.partitionBy(F.lit(0))
    rt, ct, gt = F.sum("n").over(in_row), F.sum("n").over(in_col), F.sum("n").over(in_all)
    grid = grid.withColumns({"rt": rt, "ct": ct, "gt": gt})
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n, rt, ct, gt = (F.col(x) for x in ("n", "rt", "ct", "gt"))
    share = {"row": ratio(n, rt), "column": ratio(n, ct), "total": ratio(n, gt), "none": F.lit(None).cast("double")}[percent]
    out = grid.select("row_ord", F.col("r").alias("row_level"), "col_ord", F.col("c").alias("col_level"), n.alias("n"), share.alias("share"))
    if include_total:
        last_row, last_col = F.max("row_ord").over(in_all) + 1, F.max("col_ord").over(in_all) + 1
        grid = grid.withColumns({"lr": last_row, "lc": last_col})
        right = {"row": F.when(rt > 0, 1.0).otherwise(0.0), "column": ratio(rt, gt), "total": ratio(rt, gt), "none": F.lit(None).cast("double")}[percent]
        below = {"column": F.when(ct > 0, 1.0).otherwise(0.0), "row": ratio(ct, gt), "total": ratio(ct, gt), "none": F.lit(None).cast("double")}[percent]
        corner = F.lit(1.0) if percent != "none" else F.lit(None).cast("double")
        total = F.lit("Total")
        side = grid.select("row_ord", F.col("r").alias("row_level"), F.col("lc").alias("col_ord"), total.alias("col_level"), rt.alias("n"), right.alias("share")).distinct()
        foot = grid.select(F.col("lr").alias("row_ord"), total.alias("row_level"), "col_ord", F.col("c").alias("col_level"), ct.alias("n"), below.alias("share")).distinct()
        end = grid.select(F.col("lr").alias("row_ord"), total.alias("row_level"), F.col("lc").alias("col_ord"), total.alias("col_level"), gt.alias("n"), corner.alias("share")).distinct()
        out = out.unionByName(side).unionByName(foot).unionByName(end)
    cell = F.col("n").cast("string") if percent == "none" else count_percent(F.col("n"), 100 * F.col("share"), digits)
    return out.withColumn("cell", cell)


def cross_table(df: DataFrame, row_var: str, col_var: str, **how) -> DataFrame:
    """The display table: a row for each row level, a column for each column level. The small long form is collected."""
    cells = crosstab_long(df, row_var, col_var, **how).collect()
    cols = [c for _, c in sorted({(r["col_ord"], r["col_level"]) for r in cells})]
    rows = sorted({(r["row_ord"], r["row_level"]) for r in cells})
    at = {(r["row_ord"], r["col_ord"]): r["cell"] for r in cells}
    ords = sorted({r["col_ord"] for r in cells})
    data = [(level, *[at[o, c] for c in ords]) for o, level in rows]
    schema = T.StructType([T.StructField(x, T.StringType()) for x in [row_var, *cols]])
    return df.sparkSession.createDataFrame(data, schema).coalesce(1)
