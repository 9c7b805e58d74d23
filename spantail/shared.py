"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); where that is unset, a temporary one, and only if Spark is one process."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if told:
        return f"{told.rstrip('/')}/{app}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spantail-")
    return f"file://{_LOCAL[app]}"


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = hadoop(spark, path)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, reread: later steps don't depend on lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
