"""Tables written to the shared folder, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-gneiss-")


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Only a local session without that setting gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/gneiss-{uuid.uuid4().hex}"


def written(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and return what was written."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `written` returned and that nothing reads any more; other tables are left alone."""
    for t in tables:
        path = t.__dict__.get("written_to")
        if path:
            files = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            files.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(files, True)
