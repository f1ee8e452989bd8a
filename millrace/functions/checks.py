"""Argument checks, at plan-building time."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from math import isfinite
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def frame(df: Any, name: str = "dataset") -> None:
    if not hasattr(df, "schema") or not hasattr(df, "select"):
        raise TypeError(f"`{name}` must be a DataFrame.")


def column(df: DataFrame, name: Any, argument: str = "var_name") -> str:
    if not isinstance(name, str) or not name:
        raise ValueError(f"`{argument}` must be one non-empty column name.")
    if name not in df.columns:
        raise ValueError(f"`{argument}` not found in `dataset`: {name}.")
    return name


def flag(value: Any, argument: str) -> bool:
    if not isinstance(value, bool):
        raise ValueError(f"`{argument}` must be True or False.")
    return value


def whole(value: Any, argument: str, least: int = 0) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not isfinite(value) or value != int(value) or value < least:
        raise ValueError(f"`{argument}` must be one integer of at least {least}.")
    return int(value)


def label(value: Any, argument: str) -> str:
    if not isinstance(value, str) or not value:
        raise ValueError(f"`{argument}` must be one non-empty character value.")
    return value


def choice(value: Any, argument: str, choices: Sequence[str]) -> str:
    if value not in choices:
        raise ValueError(f"`{argument}` must be one of: {', '.join(choices)}.")
    return value


def probabilities(values: Iterable[float]) -> list[float]:
    p = [float(v) for v in values]
    if not p or any(not isfinite(v) or not 0 <= v <= 1 for v in p):
        raise ValueError("`probs` must be finite numbers from 0 to 1.")
    if len(set(p)) != len(p):
        raise ValueError("`probs` must not contain duplicates.")
    return p


def q(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    c = q(name)
    return F.when(F.isnan(c), None).otherwise(c) if is_floating(df.schema[name].dataType) else c


def as_level(df: DataFrame, name: str) -> Column:
    """The column as text of a category; missing is null, logical values are FALSE and TRUE."""
    c = present(df, name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.upper(c.cast("string"))
    if is_floating(kind):
        return F.when(F.abs(c) < 1e15, F.regexp_replace(c.cast("string"), r"\.0$", "")).otherwise(c.cast("string"))
    return c.cast("string")
