"""Cofactors, percentile thresholds and control-group reference distributions, in long form.

Long form: one row a unit and marker, (keys..., marker, value).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.folders import staged

#: Bins of equal width that a value's range is cut in, to find where its percentiles lie.
BINS = 1024


def unpivoted(df: DataFrame, keys: list[str], markers: list[str]) -> DataFrame:
    return df.unpivot(keys, markers, "marker", "value")


def cofactors(long: DataFrame, percentile: float = 5.0, floor: float = 0.1) -> DataFrame:
    """(marker, cofactor_percentile, cofactor_mad) over positive values; floor where there are none or the figure is less."""
    positive = F.when(F.col("value") > 0, F.col("value"))
    medians = long.groupBy("marker").agg(F.percentile(positive, F.lit(percentile / 100)).alias("p"), F.percentile(positive, F.lit(0.5)).alias("median"))
    off = long.join(medians, "marker").withColumn("off", F.when(F.col("value") > 0, F.abs(F.col("value") - F.col("median"))))
    made = off.groupBy("marker").agg(F.first("p").alias("p"), F.percentile("off", F.lit(0.5)).alias("mad"))
    at_least = lambda c: F.greatest(F.coalesce(c, F.lit(floor)), F.lit(floor))
    return made.select("marker", at_least(F.col("p")).alias("cofactor_percentile"), at_least(1.4826 * F.col("mad")).alias("cofactor_mad"))


def variance_cofactor(long: DataFrame, steps: int = 50) -> DataFrame:
    """(marker, cofactor): of `steps` log-spaced candidates from 0.1 to 100 the one whose arcsinh has the least variance over positives."""
    grid = F.array(*(F.lit(10 ** (-1 + 3 * i / (steps - 1))) for i in range(steps)))
    tried = long.filter("value > 0").select("marker", "value", F.explode(grid).alias("cofactor"))
    spread = tried.groupBy("marker", "cofactor").agg(F.var_pop(F.asinh(F.col("value") / F.col("cofactor"))).alias("v"))
    return spread.groupBy("marker").agg(F.min_by("cofactor", F.struct(F.round("v", 12), "cofactor")).alias("cofactor"))


def pooled_thresholds(long: DataFrame, percentile: float) -> DataFrame:
    return long.groupBy("marker").agg(F.percentile("value", F.lit(percentile / 100)).alias("threshold"))


def scales(long: DataFrame, floor: float = 1e-6) -> DataFrame:
    """(marker, scale): interquartile range; a quarter of the range where that is nil; the floor where that is too."""
    q = long.groupBy("marker").agg((F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("iqr"), ((F.max("value") - F.min("value")) / 4).alias("quarter"))
    return q.select("marker", F.when(F.col("iqr") >= floor, F.col("iqr")).when(F.col("quarter") >= floor, F.col("quarter")).otherwise(floor).alias("scale"))


def reference_distribution(long: DataFrame, percentile: float = 60.0, overrides: dict[str, float] | None = None, group: str = "timepoint", subject: str = "mouse", control: str = "Sham") -> DataFrame:
    """(marker, threshold, scale): centre from the control group, width from all units.

    All percentiles asked for are taken in one aggregate over the control units; each marker picks its own.
    """
    overrides = overrides or {}
    asked = sorted({percentile, *overrides.values()})
    mine = F.lit(asked.index(percentile))
    for marker, p in overrides.items():
        mine = F.when(F.col("marker") == marker, asked.index(p)).otherwise(mine)
    per_subject = long.filter(F.col(group) == control).groupBy("marker", subject).agg(F.percentile("value", F.array(*(F.lit(p / 100) for p in asked))).alias("t"))
    centres = per_subject.groupBy("marker").agg(F.avg(F.get("t", mine)).alias("threshold"))
    return centres.join(scales(long), "marker")


def percentiles(df: DataFrame, keys: list[str], values: list[str], shares: list[float]) -> DataFrame:
    """(keys, value, t): the exact percentiles of each value by its name, as F.percentile gives them, however many different numbers a key has.

    A first pass counts numbers by bins, a second keeps what lies in the few bins that hold a percentile and ranks that alone. Nulls do
    not count; a value of nulls only has no row. Numbers that all but a few lie in one bin are ranked by number, each once.
    """
    number = lambda v: F.col(v).cast("double")
    finite = lambda v: F.when(F.abs(number(v)) < float("inf"), number(v))
    ends = staged(df.groupBy(*keys).agg(*(f(finite(v)).alias(f"_{n}_{v}") for v in values for n, f in (("lo", F.min), ("hi", F.max)))), "ends")  # a row a key
    long = lambda rows, entry: rows.select(*keys, F.inline(F.array(*(F.struct(F.lit(i).alias("_v"), *entry(v)) for i, v in enumerate(values)))))
    ranges = staged(long(ends, lambda v: [F.col(f"_lo_{v}").alias("_lo"), (F.col(f"_hi_{v}") - F.col(f"_lo_{v}")).alias("_width")]), "ranges")
    # Little is done to a row of many values at once: what is made for each follows when it is a row.
    binned = F.when(F.col("_width") > 0, F.least(F.greatest((F.col("x") - F.col("_lo")) / F.col("_width") * BINS, F.lit(0.0)), F.lit(BINS - 1.0))).otherwise(0.0).cast("int")
    numbered = long(df, lambda v: [number(v).alias("x")]).filter("x IS NOT NULL").join(ranges, [*keys, "_v"]).select(*keys, F.col("_v").alias("value"), "x", binned.alias("bin"))
    counts = numbered.groupBy(*keys, "value", "bin").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy(*keys, "value")
    first = F.coalesce(F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = [s * (F.sum("n").over(of) - 1) for s in shares]
    placed = counts.withColumns({"_first": first, **{f"_at_{i}": p for i, p in enumerate(at)}})
    ranks = lambda i: (F.floor(f"_at_{i}"), F.ceil(f"_at_{i}"))
    holds = lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("n"))
    held = staged(placed.filter(reduce(or_, (holds(r) for i in range(len(shares)) for r in ranks(i)))).drop("n"), "held-bins")
    inside = numbered.join(held.select(*keys, "value", "bin"), [*keys, "value", "bin"], "left_semi")
    numbers = inside.groupBy(*keys, "value", "bin", "x").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*keys, "value", "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = numbers.join(held, [*keys, "value", "bin"]).withColumn("_first", F.col("_first") + F.coalesce(F.sum("n").over(up), F.lit(0)))
    found = ranked.groupBy(*keys, "value").agg(*(F.max(f"_at_{i}").alias(f"_at_{i}") for i in range(len(shares))), *(F.max(F.when(holds(r), F.col("x"))).alias(f"_{n}_{i}") for i in range(len(shares)) for n, r in zip("ab", ranks(i))))
    share = lambda i: F.when(F.col(f"_a_{i}") == F.col(f"_b_{i}"), F.col(f"_a_{i}")).otherwise((F.ceil(f"_at_{i}") - F.col(f"_at_{i}")) * F.col(f"_a_{i}") + (F.col(f"_at_{i}") - F.floor(f"_at_{i}")) * F.col(f"_b_{i}"))
    name = F.element_at(F.array(*map(F.lit, values)), F.col("value") + 1)
    return found.select(*keys, name.alias("value"), F.array(*(share(i) for i in range(len(shares)))).alias("t"))
