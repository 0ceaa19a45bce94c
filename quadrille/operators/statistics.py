"""Correlations, distribution distances, thresholds and agreement of labellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties sharing the mean of their places."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def correlations(df: DataFrame, keys: list[str], a: str, b: str, least: int = 10) -> DataFrame:
    """(keys, n, pearson, spearman) over rows in which both are there; null below `least` rows."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ranked = both.withColumns({"_ra": average_rank(a, keys), "_rb": average_rank(b, keys)})
    made = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))
    return made.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("pearson", "spearman")})


def all_correlations(df: DataFrame, keys: list[str], values: list[str], least: int = 10) -> DataFrame:
    """(keys, a, b, n, pearson, spearman) of each two values, over rows in which all are there; null below `least` rows.

    Each value is ranked once, wherever its rows already lie for their keys; pairs are made only on the way into one aggregate.
    """
    whole = df.select(*keys, *values).dropna(subset=values)
    ranked = whole.withColumns({f"_r_{v}": average_rank(v, keys) for v in values})
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb"), F.col(f"_r_{a}").alias("ra"), F.col(f"_r_{b}").alias("rb"))
    pairs = ranked.select(*keys, F.explode(F.array(*(pair(a, b) for i, a in enumerate(values) for b in values[i + 1 :]))).alias("_p")).select(*keys, "_p.*")
    made = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("va", "vb").alias("pearson"), F.corr("ra", "rb").alias("spearman"))
    return made.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("pearson", "spearman")})


def region_difference(df: DataFrame, keys: list[str], flag: Column, value: str) -> DataFrame:
    """Mean and population spread inside and outside a flag, and their standardised difference (0 without spread)."""
    side = lambda c, f: F.when(c, F.col(value)) if f else F.when(~c, F.col(value))
    stats = df.groupBy(*keys).agg(*(fn(side(flag, inside)).alias(f"{n}_{'in' if inside else 'out'}") for n, fn in (("mean", F.avg), ("sd", F.stddev_pop), ("n", F.count)) for inside in (True, False)))
    pooled = F.sqrt((F.col("sd_in") * F.col("sd_in") + F.col("sd_out") * F.col("sd_out")) / 2)
    return stats.withColumn("d", F.when(pooled > 0, (F.col("mean_in") - F.col("mean_out")) / pooled).otherwise(0.0))


def otsu(long: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """(keys, threshold): centre of the histogram bin that separates two classes best."""
    w = Window.partitionBy(*keys)
    ends = long.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ranged = long.select(*keys, F.col(value).alias("v")).join(ends, keys)
    binned = ranged.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).filter("hi > lo")
    hist = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    up = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = hist.withColumns({"w0": F.sum("n").over(up), "s0": F.sum(F.col("n") * (F.col("bin") + 0.5)).over(up), "wt": F.sum("n").over(w), "st": F.sum(F.col("n") * (F.col("bin") + 0.5)).over(w)})
    w1 = F.col("wt") - F.col("w0")
    between = F.when(w1 > 0, F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("st") - F.col("s0")) / w1, 2))
    best = at.withColumn("b", F.round(between, 3)).filter("b IS NOT NULL").groupBy(*keys).agg(F.max(F.struct("b", (-F.col("bin")).alias("back"), "lo", "hi")).alias("m"))
    return best.select(*keys, (F.col("m.lo") + (-F.col("m.back") + 0.5) * (F.col("m.hi") - F.col("m.lo")) / bins).alias("threshold"))


def ks_distance(long: DataFrame, keys: list[str], source: str, value: str, first: str) -> DataFrame:
    """(keys, ks): largest gap between two sources' distribution functions."""
    both = long.groupBy(*keys, value).agg(F.count_if(F.col(source) == first).alias("a"), F.count_if(F.col(source) != first).alias("b"))
    w = Window.partitionBy(*keys)
    up = w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.abs(F.sum("a").over(up) / F.sum("a").over(w) - F.sum("b").over(up) / F.sum("b").over(w))
    return both.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.max("gap").alias("ks"))


def label_agreement(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, ari, nmi): adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings."""
    cells = df.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    row, column, all_ = (F.sum("n").over(x) for x in (Window.partitionBy(*keys, "a"), Window.partitionBy(*keys, "b"), w))
    c = cells.withColumns({"ra": row, "cb": column, "t": all_})
    first_a = F.row_number().over(Window.partitionBy(*keys, "a").orderBy("b")) == 1
    first_b = F.row_number().over(Window.partitionBy(*keys, "b").orderBy("a")) == 1
    c = c.withColumns({"fa": first_a, "fb": first_b})
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2
    h = lambda x: -F.col(x) / F.col("t") * F.log(F.col(x) / F.col("t"))
    s = c.groupBy(*keys).agg(
        F.first("t").alias("n"), F.sum(two("n")).alias("ij"), F.sum(F.when(F.col("fa"), two("ra"))).alias("i"), F.sum(F.when(F.col("fb"), two("cb"))).alias("j"),
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ra") * F.col("cb")))).alias("mi"),
        F.sum(F.when(F.col("fa"), h("ra"))).alias("ha"), F.sum(F.when(F.col("fb"), h("cb"))).alias("hb"),
    )
    expected = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("i") + F.col("j")) / 2
    return s.select(*keys, "n", F.when(most != expected, (F.col("ij") - expected) / (most - expected)).otherwise(1.0).alias("ari"), F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"))


def centroids(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(v) for v in values))


def separability(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """(separability): mean distance between centroids over mean within-cluster variance."""
    c = df.groupBy(label).agg(*(F.avg(v).alias(v) for v in values), F.lit(0).alias("_"), *(F.var_pop(v).alias(f"v_{v}") for v in values))
    within = sum((F.col(f"v_{v}") for v in values), F.lit(0.0)) / len(values)
    other = c.select(F.col(label).alias("_l"), "_", *(F.col(v).alias(f"o_{v}") for v in values))
    gap = F.sqrt(sum((F.pow(F.col(v) - F.col(f"o_{v}"), 2) for v in values), F.lit(0.0)))
    between = c.join(other, "_").filter(F.col(label) < F.col("_l")).agg(F.avg(gap).alias("between"))
    return between.join(c.agg(F.avg(within).alias("within"))).select((F.col("between") / (F.col("within") + 1e-10)).alias("separability"))


def nearest_centroids(a: DataFrame, b: DataFrame, label: str, values: list[str]) -> DataFrame:
    """(label, distance): for each of a's centroids the distance to b's nearest; centroid tables are small."""
    other = F.broadcast(b.select(*(F.col(v).alias(f"o_{v}") for v in values)))
    gap = F.sqrt(sum((F.pow(F.col(v) - F.col(f"o_{v}"), 2) for v in values), F.lit(0.0)))
    return a.join(other).groupBy(label).agg(F.min(gap).alias("distance"))


def threshold_features(df: DataFrame, keys: list[str], a: str, b: str, ta: float, tb: float) -> DataFrame:
    """Positive shares of two markers, their overlap, Jaccard index and conditional shares."""
    pa, pb = F.col(a) > ta, F.col(b) > tb
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(pa).alias("n_a"), F.count_if(pb).alias("n_b"), F.count_if(pa & pb).alias("n_ab"), F.avg(F.when(pa, F.col(a))).alias("mean_a"), F.max(a).alias("max_a"))
    over = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    n, na, nb, nab = (F.col(c) for c in ("n", "n_a", "n_b", "n_ab"))
    return s.select(*keys, "n", "n_a", "n_b", "n_ab", "mean_a", "max_a", over(nab, n).alias("overlap"), over(nab, na + nb - nab).alias("jaccard"), over(nab, na).alias("b_given_a"), over(nab, nb).alias("a_given_b"))


def regression(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.count(F.lit(1)).alias("n"))


def evaluated(df: DataFrame, method: str, label: str, values: list[str]) -> DataFrame:
    """(method, n_clusters, size_balance, separability) of labellings given as rows of a method each."""
    c = df.groupBy(method, label).agg(F.count(F.lit(1)).alias("_n"), *(F.avg(v).alias(v) for v in values), *(F.var_pop(v).alias(f"v_{v}") for v in values))
    within = sum((F.col(f"v_{v}") for v in values), F.lit(0.0)) / len(values)
    other = c.select(method, F.col(label).alias("_l"), *(F.col(v).alias(f"o_{v}") for v in values))
    gap = F.sqrt(sum((F.pow(F.col(v) - F.col(f"o_{v}"), 2) for v in values), F.lit(0.0)))
    between = c.join(other, method).filter(F.col(label) < F.col("_l")).groupBy(method).agg(F.avg(gap).alias("_b"))
    s = c.groupBy(method).agg(F.count(F.lit(1)).alias("n_clusters"), (1 / (1 + F.stddev_pop("_n") / F.avg("_n"))).alias("size_balance"), F.avg(within).alias("_w"))
    return s.join(between, method, "left").select(method, "n_clusters", "size_balance", (F.col("_b") / (F.col("_w") + 1e-10)).alias("separability"))
