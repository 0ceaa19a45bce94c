"""Quality history as a stream: windows of metrics with late rows, and limits that every row is judged by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.folders import new_path


def arriving(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """Rows of Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def windowed(stream: DataFrame, keys: list[str], time: str, value: str, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """(keys, window, n, mean, low, high) of tumbling or sliding windows; rows later than `late` behind the newest are no longer counted."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(*keys, window.alias("window")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def sessions(stream: DataFrame, keys: list[str], time: str, gap: str, late: str = "2 days") -> DataFrame:
    """(keys, window, n): runs of rows of a key with no longer pause than the gap."""
    return stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("window")).agg(F.count(F.lit(1)).alias("n"))


def judged(stream: DataFrame, limits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of a stream with their status by a table of limits, which is joined to each batch anew."""
    v = F.col(value)
    status = F.when((v < F.col("lower_control")) | (v > F.col("upper_control")), "out_of_control").when((v < F.col("lower_warning")) | (v > F.col("upper_warning")), "warning").otherwise("in_control")
    return stream.join(limits, keys).withColumn("status", status)


def drained(result: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that has come so far and returns what it says: the last state in complete mode, all rows in append mode."""
    spark = result.sparkSession
    path = new_path(spark, name)
    how = "overwrite" if mode == "complete" else "append"
    run = result.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode(how).parquet(path))
    run.start().awaitTermination()
    return spark.read.schema(result.schema).parquet(path)
