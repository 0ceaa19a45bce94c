"""Compositional tables: category fractions up the hierarchy, zero replacement, log-ratios. Long form throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fractions(units: DataFrame, keys: list[str], category: str, vocabulary: list[str]) -> DataFrame:
    """(keys, category, n, n_total, fraction) for every category of the vocabulary, zeros included."""
    counted = units.groupBy(*keys).pivot(category, vocabulary).count().na.fill(0)
    long = counted.unpivot(keys, [f"`{v}`" for v in vocabulary], "category", "n")
    total = Window.partitionBy(*keys)
    return long.withColumn("n_total", F.sum("n").over(total)).withColumn("fraction", F.col("n") / F.col("n_total"))


def to_subjects(df: DataFrame, keys: list[str], value: str = "fraction", count: str = "n_total") -> DataFrame:
    """Mean of the regions' values and sum of their counts for each subject; a null subject is a group like any other."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value), F.sum(count).alias(count), F.count(F.lit(1)).alias("n_regions"), F.count(value).alias("n_valued"))


def merge_rare(df: DataFrame, group: str, subject: list[str], least: float) -> DataFrame:
    """Categories whose mean is below `least` in every group become other_rare, their fractions summed."""
    means = df.groupBy("category", group).agg(F.avg("fraction").alias("m")).groupBy("category").agg(F.max("m").alias("top"))
    named = df.join(F.broadcast(means), "category").withColumn("category", F.when(F.col("top") < least, "other_rare").otherwise(F.col("category")))
    return named.groupBy(group, *subject, "category").agg(F.sum("fraction").alias("fraction"), F.max("n_total").alias("n_total"))


def replace_zeros(df: DataFrame, keys: list[str], alpha: float = 0.5, default_n: int = 100) -> DataFrame:
    """Bayesian multiplicative replacement: (p n + alpha) / (n + D alpha); a row of zeros becomes 1/D."""
    row = Window.partitionBy(*keys)
    n = F.coalesce(F.col("n_total"), F.lit(default_n))
    made = (F.col("fraction") * n + alpha) / (n + F.count(F.lit(1)).over(row) * alpha)
    return df.withColumn("replaced", F.when(F.sum("fraction").over(row) > 0, made).otherwise(1 / F.count(F.lit(1)).over(row)))


def clr(df: DataFrame, keys: list[str], value: str, name: str = "clr") -> DataFrame:
    """Centred log-ratio within each composition; null throughout a composition that has a part that isn't positive."""
    row = Window.partitionBy(*keys)
    ln = F.log(F.when(F.col(value) > 0, F.col(value)))
    whole = F.count(ln).over(row) == F.count(F.lit(1)).over(row)
    return df.withColumn(name, F.when(whole, ln - F.avg(ln).over(row)))
