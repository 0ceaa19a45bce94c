"""Per-unit transforms of wide tables: scaling, filters, co-abundance features and their selection."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def zscores(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Population z-score within each key; a value without spread is divided by one."""
    stats = df.groupBy(*keys).agg(*(F.avg(v).alias(f"_m_{v}") for v in values), *(F.stddev_pop(v).alias(f"_s_{v}") for v in values))
    z = lambda v: (F.col(v) - F.col(f"_m_{v}")) / F.when(F.col(f"_s_{v}") > 1e-12, F.col(f"_s_{v}")).otherwise(1.0)
    joined = df.join(stats, keys) if keys else df.join(F.broadcast(stats))  # without keys it is one row
    return joined.withColumns({v: z(v) for v in values}).drop(*(f"_m_{v}" for v in values), *(f"_s_{v}" for v in values))


def minmax(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the value's place between the least and the largest of its key; null without a range."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    span = F.col("_high") - F.col("_low")
    return df.join(ends, keys).withColumn(name, F.when(span != 0, (F.col(value) - F.col("_low")) / span)).drop("_low", "_high")


def with_signal(df: DataFrame, values: list[str]) -> DataFrame:
    """Rows in which some value is not zero."""
    return df.filter(reduce(add, (F.abs(v) for v in values)) > 0)


def coabundance(df: DataFrame, keys: list[str], values: list[str], percentile: float = 25.0) -> DataFrame:
    """Adds for each pair a product scaled by both second moments, and for each ordered pair a log ratio.

    The ratio's pseudocount is a percentile of all positive entries of the key, so that p values
    give p(p-1)/2 products and p(p-1) ratios.
    """
    entries = df.select(*keys, F.explode(F.array(*values)).alias("_e")).groupBy(*keys).agg(F.percentile(F.when(F.col("_e") > 0, F.col("_e")), F.lit(percentile / 100)).alias("_m"))
    stats = df.groupBy(*keys).agg(*(F.avg(F.col(v) * F.col(v)).alias(f"_q_{v}") for v in values)).join(entries, keys)
    rows = df.join(stats, keys)
    products = {f"{a}_x_{b}": F.col(a) * F.col(b) / (F.sqrt(F.col(f"_q_{a}") * F.col(f"_q_{b}")) + 1e-10) for i, a in enumerate(values) for b in values[i + 1 :]}
    ratios = {f"{a}_over_{b}": F.log1p((F.col(a) + F.col("_m")) / (F.col(b) + F.col("_m"))) for a in values for b in values if a != b}
    return rows.withColumns({k: F.coalesce(c, F.lit(0.0)) for k, c in {**products, **ratios}.items()}).drop("_m", *(f"_q_{v}" for v in values))


def hierarchical_features(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Adds mean, largest and population variance of each group of markers."""
    out = {}
    for name, members in groups.items():
        mean = reduce(add, (F.col(m) for m in members)) / len(members)
        out[f"{name}_mean"] = mean
        out[f"{name}_max"] = F.greatest(*members) if len(members) > 1 else F.col(members[0])
        if len(members) > 1:
            out[f"{name}_var"] = reduce(add, (F.pow(F.col(m) - mean, 2) for m in members)) / len(members)
    return df.withColumns(out)


def most_variable(df: DataFrame, values: list[str], n: int) -> DataFrame:
    """(feature, variance, place): the n columns with the largest population variance."""
    spread = df.agg(*(F.var_pop(v).alias(v) for v in values))
    long = spread.unpivot([], values, "feature", "variance")
    return long.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("variance", 9)), "feature"))).filter(F.col("place") <= n)
