"""Plans that read quality history as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.folders import new_path
from quadrille.operators import quality
from quadrille.plans.common import query, rounded
from quadrille.streaming import history


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come in four files, in order of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    path = new_path(spark, "arriving")
    events.repartitionByRange(4, "ts").write.parquet(path)
    return history.arriving(spark, path, "event_id bigint, ts timestamp, event_type string, value double")


@query("""SELECT event_type, epoch(date_trunc('day', ts::TIMESTAMP))::BIGINT AS start, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY ALL""")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of the history by type."""
    w = history.drained(history.windowed(_stream(spark, sf_dir), ["event_type"], "ts", "value", "1 day", "400 days"), "windows")
    return rounded(w.select("event_type", F.unix_timestamp("window.start").alias("start"), "n", "mean", "low", "high"))


@query("""WITH lim AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY event_type HAVING count(value) >= 10)
SELECT event_id, event_type, CASE WHEN value < m - 3 * sd OR value > m + 3 * sd THEN 'out_of_control' WHEN value < m - 2 * sd OR value > m + 2 * sd THEN 'warning' ELSE 'in_control' END AS status FROM events JOIN lim USING (event_type)""")
def streamed_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event judged by control limits as it comes."""
    past = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value")
    limits = quality.control_limits(past, ["event_type"], "value").drop("n", "mean")
    return history.drained(history.judged(_stream(spark, sf_dir), limits, ["event_type"], "value").select("event_id", "event_type", "status"), "statuses", "append")
