"""Columns by place: tables may have columns of any names, also names that differ by case alone or that a result uses too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(docs: DataFrame, name: str) -> int:
    """Number of the column ``name``: the exact name, else the only one that differs by case."""
    if name in docs.columns:
        return docs.columns.index(name)
    alike = [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"no column {name!r}")
    return alike[0]


def numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """``docs`` with its columns named c0, c1, ... and ``more`` behind them."""
    out = docs.select("*", *more) if more else docs
    return out.toDF(*[f"c{i}" for i in range(len(out.columns))])


def named(docs: DataFrame, **names: str) -> DataFrame:
    """The given columns alone, under new names."""
    return numbered(docs).select(*[F.col(f"c{place(docs, c)}").alias(n) for n, c in names.items()])


def packed(docs: DataFrame, *more: Column) -> tuple[DataFrame, Column]:
    """``numbered`` docs and a struct of all their own columns, which ``unpacked`` takes apart."""
    return numbered(docs, *more), F.struct(*[F.col(f"c{i}") for i in range(len(docs.columns))])


def unpacked(rows: DataFrame, struct: str, docs: DataFrame, **more: Column) -> DataFrame:
    """The columns of ``docs`` from the struct column, and ``more`` under names that are still free."""
    names = list(docs.columns)
    for n in more:
        names.append(free_name(n, names))
    return rows.select(*[F.col(f"{struct}.c{i}").alias(f"c{i}") for i in range(len(docs.columns))], *more.values()).toDF(*names)


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores behind it as keep it apart from ``taken``, whatever the case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
