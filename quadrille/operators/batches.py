"""Batch effects, control- and bead-anchored normalisation, instrumental drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def batch_effects(long: DataFrame, batch: str, marker: str, value: str) -> DataFrame:
    """(marker, n_batches, cv, kruskal_h): spread of batch medians, and the Kruskal-Wallis statistic with tie correction."""
    medians = long.groupBy(marker, batch).agg(F.percentile(value, F.lit(0.5)).alias("m"))
    cv = medians.groupBy(marker).agg(F.count(F.lit(1)).alias("n_batches"), (F.stddev_pop("m") / F.when(F.avg("m") != 0, F.avg("m"))).alias("cv"))
    # One row a value and batch: ranks follow from counts, so no row is ranked by itself.
    counts = long.groupBy(marker, value).agg(F.count(F.lit(1)).alias("t"))
    below = F.sum("t").over(Window.partitionBy(marker).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = counts.select(marker, value, "t", (below - (F.col("t") - 1) / 2).alias("r"))
    ties = counts.groupBy(marker).agg(F.sum("t").alias("n"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie"))
    per = long.groupBy(marker, batch, value).agg(F.count(F.lit(1)).alias("c")).join(ranks, [marker, value]).groupBy(marker, batch).agg(F.sum(F.col("c") * F.col("r")).alias("s"), F.sum("c").alias("c"))
    h = per.join(ties, marker).groupBy(marker, "n", "tie").agg(F.sum(F.col("s") * F.col("s") / F.col("c")).alias("q"))
    n = F.col("n").cast("double")
    stat = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("tie") / (n * n * n - n))
    return cv.join(h.select(marker, stat.alias("kruskal_h")), marker)


def control_anchored(long: DataFrame, control: Column, marker: str, value: str) -> DataFrame:
    """Adds z against mean and sample spread of the control rows; without spread in the control, against the marker's own; else 0."""
    stats = long.groupBy(marker).agg(F.avg(F.when(control, F.col(value))).alias("_m"), F.stddev_samp(F.when(control, F.col(value))).alias("_s"), F.avg(value).alias("_om"), F.stddev_samp(value).alias("_os"))
    z = F.when(F.col("_s") > 1e-10, (F.col(value) - F.col("_m")) / F.col("_s")).when(F.col("_os") > 1e-10, (F.col(value) - F.col("_om")) / F.col("_os")).otherwise(0.0)
    return long.join(F.broadcast(stats), marker).withColumn("z", z).drop("_m", "_s", "_om", "_os")


def bead_factors(beads: DataFrame, batch: str, bead: str, value: str, order: str, least: float = 1.0, reference: str = "median") -> DataFrame:
    """(batch, factor): median over beads of reference over observed bead medians, each held to 0.1..10.

    The reference is the median over batches or the first batch's value; beads below `least` do not count.
    """
    medians = beads.groupBy(batch, bead).agg(F.percentile(value, F.lit(0.5)).alias("m"), F.min(order).alias("o")).filter(F.col("m") >= least)
    if reference == "median":
        ref = medians.groupBy(bead).agg(F.percentile("m", F.lit(0.5)).alias("ref"))
    else:
        ref = medians.groupBy(bead).agg(F.min_by("m", "o").alias("ref"))
    each = medians.join(ref, bead).withColumn("f", F.greatest(F.least(F.col("ref") / (F.col("m") + 1e-10), F.lit(10.0)), F.lit(0.1)))
    return each.groupBy(batch).agg(F.coalesce(F.percentile(F.when(F.abs(F.col("f") - 1) > 1e-12, F.col("f")), F.lit(0.5)), F.lit(1.0)).alias("factor"), F.count(F.lit(1)).alias("n_beads"))


def drift(beads: DataFrame, batch: str, bead: str, value: str, order: str) -> DataFrame:
    """(bead, slope, cv, range) of batch medians along the order of batches."""
    medians = beads.groupBy(bead, batch).agg(F.percentile(value, F.lit(0.5)).alias("m"), F.min(order).alias("o"))
    placed = medians.withColumn("i", F.row_number().over(Window.partitionBy(bead).orderBy("o", batch)))
    return placed.groupBy(bead).agg(F.regr_slope("m", "i").alias("slope"), (F.stddev_pop("m") / F.avg("m")).alias("cv"), (F.max("m") - F.min("m")).alias("range"))


def shared_markers(long: DataFrame, batch: str, marker: str) -> DataFrame:
    """Markers that every batch has."""
    n = long.agg(F.count_distinct(batch).alias("n"))
    return long.groupBy(marker).agg(F.count_distinct(batch).alias("k")).join(F.broadcast(n)).filter("k = n").select(marker)
