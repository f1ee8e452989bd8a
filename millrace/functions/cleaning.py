"""Column names, quote characters and date labels."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import checks

#: Straight and curly quotes and the backtick. The opening single curly quote is not among them.
QUOTES = ("'", "’", '"', "“", "”", "`")


def fixed_name(name: str) -> str:
    """A blank becomes an underscore; brackets, apostrophes and hyphens go."""
    return re.sub(r"[()'\-]", "", name.replace(" ", "_"))


def fix_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[fixed_name(c) for c in df.columns])


def strip_characters(text: Column, chars: tuple[str, ...] | list[str] = QUOTES) -> Column:
    """``text`` without any of ``chars``, taken literally; single characters in one pass."""
    single = "".join(c for c in chars if len(c) == 1)
    for c in chars:
        if len(c) > 1:
            text = F.replace(text, F.lit(c))
    return F.translate(text, single, "") if single else text


def strip_quotes(df: DataFrame, chars: tuple[str, ...] | list[str] = QUOTES) -> DataFrame:
    """All text columns without quote characters, other columns as they are."""
    checks.frame(df, "data")
    if any(not isinstance(c, str) or not c for c in chars):
        raise ValueError("`chars` must be non-empty text values.")
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(*[strip_characters(checks.q(c), chars).alias(c) if c in names else checks.q(c) for c in df.columns])


def today_labels(date: dt.date | str | None = None) -> dict[str, str]:
    """The date as ``YYYY_MM_DD`` and ``YYYYMMDD``."""
    if date is None:
        date = dt.date.today()
    if isinstance(date, str):
        date = dt.date.fromisoformat(date)
    if not isinstance(date, dt.date):
        raise TypeError("`date` must be a date.")
    return {"underscore": date.strftime("%Y_%m_%d"), "compact": date.strftime("%Y%m%d")}


def date_labels(date: Column) -> tuple[Column, Column]:
    """The same two texts of a date column."""
    return F.date_format(date, "yyyy_MM_dd"), F.date_format(date, "yyyyMMdd")
