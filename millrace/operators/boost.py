"""Columns that hold dates are found from their values and names and converted."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks, dates

log = logging.getLogger(__name__)

_STANDARD = r"^(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}|[0-9]{8}(?:[T\s]?[0-9]{4}(?:[0-9]{2})?)?)"
_NAMED = r"(?s)^(?:[0-9]{1,2}[-\s]|\p{Alpha}{3,9}\s[0-9]{1,2},?\s).*[0-9]{4}"
_TIMED = r"(?:[T\s][0-9]{1,2}:[0-9]{2}|^[0-9]{12}(?:[0-9]{2})?$)"
_NUMBER = r"^[+-]?[0-9]+(?:[.][0-9]+)?$"


def name_type(column_name: str) -> str:
    """"timestamp", "date" or "none", by the words of a column's name."""
    snake = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", column_name)
    name = re.sub(r"[^A-Za-z0-9]+", "_", snake).lower()
    words = {w for w in name.split("_") if w}
    if words & {"datetime", "timestamp", "time"} or "date_time" in name or re.search(r"(^|_)at$", name):
        return "timestamp"
    if words & {"date", "dob", "birthdate"} or "date_of_birth" in name or "birth_date" in name:
        return "date"
    return "none"


def _numeric_shape(x: Column, kind: str, origin: str) -> Column:
    if origin != "auto":
        return x.isNotNull()
    shape = dates._compact(dates._whole_digits(x)).isNotNull() | ((x >= 1e8) & (x <= 4102444800)) | ((x >= 30000) & (x <= 60000))
    return shape | ((x > -1e5) & (x < 30000)) if kind == "date" else shape


def detect_dates(df: DataFrame, *, day_first: bool = False, numeric_origin: str = "auto", tz: str = "UTC", min_success: float = 0.8) -> dict[str, str]:
    """column: "date" or "timestamp", for the columns to convert. One aggregation tells the columns whose values have a date's
    shape, a second one, over these alone, how many of them parse."""
    checks.frame(df, "data")
    if isinstance(min_success, bool) or not isinstance(min_success, (int, float)) or not 0 < min_success <= 1:
        raise ValueError("`min_success` must be one number greater than 0 and at most 1.")
    checks.flag(day_first, "day_first")
    checks.choice(numeric_origin, "numeric_origin", dates.ORIGINS)
    aggs: list[Column] = []
    found: list[tuple[str, str, bool, Column]] = []
    rate = lambda ok, used: F.avg(F.when(used, F.coalesce(ok, F.lit(False)).cast("int")))
    for i, f in enumerate(df.schema.fields):
        kind, c = name_type(f.name), checks.q(f.name)
        how = {"day_first": day_first, "numeric_origin": numeric_origin, "tz": tz}
        if isinstance(f.dataType, T.StringType):
            t, used = F.btrim(c), dates.meaningful(c)
            shape = t.rlike(_STANDARD) | t.rlike(_NAMED)
            if kind != "none":
                shape = shape | (t.rlike(_NUMBER) & F.coalesce(_numeric_shape(t.try_cast("double"), kind, numeric_origin), F.lit(False)))
            timed = F.max(F.when(used, t.rlike(_TIMED)))
        elif isinstance(f.dataType, T.NumericType) and kind != "none":
            x = checks.present(df, f.name).cast("double")
            used = x.isNotNull() & (F.abs(x) < float("inf"))
            shape = _numeric_shape(x, kind, numeric_origin)
            timed = F.lit(False)
        else:
            continue
        k = len(found)
        parsed = dates.to_datetime(c, f.dataType, **how).isNotNull()
        found.append((f.name, kind, isinstance(f.dataType, T.StringType), rate(parsed, used).alias(f"parsed{k}")))
        aggs += [rate(shape, used).alias(f"shape{k}"), timed.alias(f"timed{k}")]
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    likely = [k for k in range(len(found)) if row[f"shape{k}"] is not None and row[f"shape{k}"] >= min_success]
    if not likely:
        return {}
    rates = df.agg(*[found[k][3] for k in likely]).first()
    out = {}
    for k in likely:
        name, kind, text, _ = found[k]
        if rates[f"parsed{k}"] >= min_success:
            out[name] = "timestamp" if kind == "timestamp" or (text and row[f"timed{k}"]) else "date"
    return out


def boost_data(df: DataFrame, *, day_first: bool = False, numeric_origin: str = "auto", tz: str = "UTC", min_success: float = 0.8, verbose: bool = True) -> DataFrame:
    """``df`` with its date-like columns as dates or timestamps; the others are untouched.

    Text converts where at least ``min_success`` of its meaningful values have a date's shape and parse, numbers only
    under a date-like name. A timestamp comes of a name that says so or of any value with a time of day.
    """
    how = {"day_first": day_first, "numeric_origin": numeric_origin, "tz": tz}
    plan = detect_dates(df, min_success=min_success, **how)
    if checks.flag(verbose, "verbose"):
        log.info("converted: %s", ", ".join(f"{k} ({v})" for k, v in plan.items()) or "no date-like columns")
    make = {"date": dates.to_date, "timestamp": dates.to_datetime}
    return df.select(*[make[plan[c]](checks.q(c), df.schema[c].dataType, **how).alias(c) if c in plan else checks.q(c) for c in df.columns])
