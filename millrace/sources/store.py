"""Tables saved to and loaded from Parquet."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from ..functions import checks
from ..scratch import file_system

_CODECS = {True: "zstd", False: "uncompressed", "gzip": "gzip", "zstd": "zstd", "snappy": "snappy"}


def table_path(path: str) -> str:
    """With ``.parquet`` at its end, in any case."""
    checks.label(path, "file")
    return path if path.lower().endswith(".parquet") else path + ".parquet"


def save_table(df: DataFrame, file: str, *, compress: bool | str = True, overwrite: bool = True) -> str:
    """Writes ``df`` and returns the path. The parent folder must exist; an existing table is replaced on request only."""
    checks.frame(df, "data")
    checks.flag(overwrite, "overwrite")
    if compress not in _CODECS:
        raise ValueError(f"`compress` must be True, False or one of: {', '.join(k for k in _CODECS if isinstance(k, str))}.")
    path = table_path(file)
    fs, at = file_system(df.sparkSession, path)
    parent = at.getParent()
    if parent is not None and not fs.exists(parent):
        raise FileNotFoundError(f"Directory does not exist: {parent.toString()}")
    if fs.exists(at) and not overwrite:
        raise FileExistsError(f"File already exists: {path}")
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", _CODECS[compress]).parquet(path)
    return path


def load_table(spark: SparkSession, file: str) -> DataFrame:
    path = table_path(file)
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(f"File does not exist: {path}")
    return spark.read.parquet(path)
