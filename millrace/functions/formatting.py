"""Display text of numbers and unique labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def c_fixed(value: Column, digits: int) -> Column:
    """``value`` with ``digits`` decimals, rounded as C's printf does; Inf, -Inf and NaN by these names, null stays null."""
    v = value.cast("double")
    pattern = "0" + ("." + "0" * digits if digits else "")
    text = F.call_function("format_number", v, F.lit(pattern))
    return F.when(F.isnan(v), F.lit("NaN")).when(v == F.lit(float("inf")), F.lit("Inf")).when(v == F.lit(float("-inf")), F.lit("-Inf")).otherwise(text)


def count_percent(n: Column, percent: Column, digits: int) -> Column:
    """``n (p%)``."""
    return F.concat(n.cast("long").cast("string"), F.lit(" ("), c_fixed(percent, digits), F.lit("%)"))


def make_unique(names: Iterable[str], sep: str = "_") -> list[str]:
    """Names in their order; a repeated one gets the first free number behind ``sep``."""
    names = list(names)
    taken, seen, out = set(names), set(), []
    for name in names:
        if name in seen:
            k = 1
            while f"{name}{sep}{k}" in taken:
                k += 1
            name = f"{name}{sep}{k}"
            taken.add(name)
        seen.add(name)
        out.append(name)
    return out
