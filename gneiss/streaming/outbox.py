"""The outbox as a stream: at-least-once delivery with keys that make repeats no-ops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.storage import shared_folder


def deliver_once(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """A stream whose repeated keys within the watermark are dropped."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, kind: str, width: str, late: str = "1 hour") -> DataFrame:
    """Events of a kind per tumbling window; in append mode a window is emitted when the watermark passes its end."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).count()


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet in the shared folder, and return what it wrote."""
    spark: SparkSession = stream.sparkSession
    path = shared_folder(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def last_result(stream: DataFrame) -> DataFrame:
    """Run an aggregated stream in complete mode to its end and return the last batch: all groups, also of windows still open."""
    spark: SparkSession = stream.sparkSession
    path, last = shared_folder(spark), []

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{i}")
        last[:] = [i]

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[0]}") if last else spark.createDataFrame([], stream.schema)
