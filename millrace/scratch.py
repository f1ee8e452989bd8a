"""Tables that cut lineage, written where every executor can read them again.

A job that loses an executor recomputes from these files, so they live in the folder the cluster names in
``spark.checkpoint.dir``. Only a local session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def file_system(spark: SparkSession, path: str) -> tuple[object, object]:
    """(Hadoop file system, path on it): any storage that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application inside the shared checkpoint folder; it is deleted when the Python process ends, also
    where the session has stopped before."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        made = None
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = made = tempfile.mkdtemp(prefix="millrace-")
        _roots[app] = f"{base.rstrip('/')}/millrace-{app}"
        fs, path = file_system(spark, made or _roots[app])  # held: a stopped session no longer tells its configuration
        atexit.register(lambda: fs.delete(path, True))
    return _roots[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a plan without its past."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a frame that ``written`` returned; nothing may read it any more."""
    fs, path = file_system(df.sparkSession, df._scratch)
    fs.delete(path, True)
