"""Classes of columns by their type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def data_types(df: DataFrame, selected_columns: Sequence[str] | None = None) -> dict[str, str]:
    """column: date, continuous, categorical or other, in the order asked for. Reads the schema alone."""
    names = list(df.columns if selected_columns is None else selected_columns)
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"Unknown columns: {', '.join(map(str, unknown))}.")

    def kind(t: T.DataType) -> str:
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "date"
        if isinstance(t, T.NumericType):
            return "continuous"
        return "categorical" if isinstance(t, (T.StringType, T.BooleanType, T.CharType, T.VarcharType)) else "other"

    return {n: kind(df.schema[n].dataType) for n in names}


def data_type_table(df: DataFrame, selected_columns: Sequence[str] | None = None) -> DataFrame:
    """The same as rows (column_name, data_class)."""
    return df.sparkSession.createDataFrame(list(data_types(df, selected_columns).items()), "column_name string, data_class string")
