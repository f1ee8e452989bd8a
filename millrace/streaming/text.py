"""The stateless text operators over streams. They hold no state, so any output mode and trigger will do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import checks
from ..functions.health_numbers import flag_phn, mask_phn
from ..functions.known_names import flag_known_names, mask_known_names
from ..functions.person_names import flag_person_names, mask_person_names


def read_stream(spark: SparkSession, folder: str, like: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they come to ``folder``, with the schema of the table at ``like``."""
    r = spark.readStream.schema(spark.read.parquet(like).schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(folder)


def private_text(df: DataFrame, text: str, *, output: str = "masked_text", name_columns: list[str] | None = None) -> DataFrame:
    """Health numbers, then the row's known names, then detected names, masked; the same for batch and stream."""
    out = df.withColumn(output, mask_phn(checks.q(text)))
    if name_columns:
        out = mask_known_names(out, output, name_columns, output=output)
    return mask_person_names(out.withColumnRenamed(output, "__part"), "__part", output=output).drop("__part")


def flags(df: DataFrame, text: str, *, name_columns: list[str] | None = None) -> DataFrame:
    """With columns phn_flag and name_flag, and known_name_flag where name columns are given."""
    out = flag_person_names(df.withColumn("phn_flag", flag_phn(checks.q(text))), text)
    return flag_known_names(out, text, name_columns, output="known_name_flag") if name_columns else out


def write_stream(df: DataFrame, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends to Parquet at ``folder`` (exactly once, by the checkpoint), until all that is there has been read."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return w.foreachBatch(each).start() if each else w.format("parquet").option("path", folder).outputMode("append").start()
