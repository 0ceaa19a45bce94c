"""Contrasts of few subjects: effect sizes, shrinkage, exact resampling ranges, rank sums, adjustment, power."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.folders import staged

# The contrasts of the design.
CONTRASTS = [("Sham", "D1"), ("Sham", "D3"), ("Sham", "D7"), ("D1", "D3"), ("D1", "D7"), ("D3", "D7")]
# Prior spreads, normal quantiles, limits beyond which an effect is not believed.
PRIORS = {"skeptical": 0.5, "neutral": 1.0, "optimistic": 2.0}
Z_ALPHA, Z_POWER = 1.959964, 0.841621
PATHOLOGICAL_G, PATHOLOGICAL_SD = 3.0, 0.01


def contrast_table(spark: SparkSession, contrasts: list[tuple[str, str]] = CONTRASTS) -> DataFrame:
    return F.broadcast(spark.createDataFrame(contrasts, "g1 string, g2 string"))


def pooled_d(m1: Column, m2: Column, v1: Column, v2: Column, n1: Column, n2: Column) -> Column:
    """(m2 - m1) over the pooled standard deviation; null below two subjects or without spread."""
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 1e-24), (m2 - m1) / F.sqrt(pooled))


def small_sample(d: Column, n1: Column, n2: Column) -> Column:
    return d * (1 - 3 / (4 * (n1 + n2 - 2) - 1))


def n_required(g: Column) -> Column:
    size = F.abs(g)
    return F.when(size < 1e-6, F.lit(float("inf"))).otherwise(F.ceil(2 * F.pow((Z_ALPHA + Z_POWER) / size, 2)).cast("double"))


def effect_sizes(df: DataFrame, endpoint: list[str], group: str, value: str, contrasts: DataFrame) -> DataFrame:
    """One row for each endpoint and contrast: counts, means, ranges, Hedges' g, its shrunk forms, subjects needed.

    Contrasts short of subjects are rows with nulls. df: one row a subject; it is staged, as both sides of a contrast and
    the endpoints are read from it.
    """
    df = staged(df.select(*endpoint, group, value), "subjects")
    stats = df.groupBy(*endpoint, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    side = lambda i: stats.select(*endpoint, F.col(group).alias(f"g{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("n", "m", "v", "lo", "hi")))
    rows = df.select(*endpoint).distinct().join(contrasts).join(side(1), [*endpoint, "g1"], "left").join(side(2), [*endpoint, "g2"], "left").na.fill(0, ["n1", "n2"])
    c = F.col
    g = small_sample(pooled_d(c("m1"), c("m2"), c("v1"), c("v2"), c("n1"), c("n2")), c("n1"), c("n2"))
    out = rows.withColumn("hedges_g", g).withColumn("g_pathological", (F.abs("hedges_g") > PATHOLOGICAL_G) & (F.sqrt((c("v1") + c("v2")) / 2) < PATHOLOGICAL_SD))
    n = F.least("n1", "n2")
    variance = F.when(n >= 2, 2 / n + c("hedges_g") * c("hedges_g") / (4 * n))
    shrunk = {f"g_shrunk_{k}": F.when(~c("g_pathological"), c("hedges_g") * (s * s) / (s * s + variance)) for k, s in PRIORS.items()}
    out = out.withColumns({**shrunk, "n_required": n_required(c("hedges_g"))})
    return out.select(*endpoint, "g1", "g2", "n1", "n2", "m1", "m2", "lo1", "hi1", "lo2", "hi2", "hedges_g", "g_pathological", *shrunk, "n_required")


def fold_changes(df: DataFrame, endpoint: list[str], group: str, value: str, contrasts: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(endpoint, g1, g2, fold_change, log2_fc) of group means, a small amount added to both."""
    means = df.groupBy(*endpoint, group).agg(F.avg(value).alias("m"))
    rows = contrasts.join(means.select(*endpoint, F.col(group).alias("g1"), F.col("m").alias("m1")), "g1").join(means.select(*endpoint, F.col(group).alias("g2"), F.col("m").alias("m2")), [*endpoint, "g2"])
    fc = (F.col("m2") + eps) / (F.col("m1") + eps)
    return rows.select(*endpoint, "g1", "g2", fc.alias("fold_change"), F.log2(fc).alias("log2_fc"))


def adjusted(df: DataFrame, keys: list[str], p: str, tie: list[str], name: str = "q") -> DataFrame:
    """Benjamini-Hochberg within each key; a null p stays null and does not count."""
    family = Window.partitionBy(*keys)
    up = family.orderBy(F.col(p).asc_nulls_last(), *tie)
    ranked = df.withColumn("_r", F.row_number().over(up)).withColumn("_q", F.col(p) * F.count(p).over(family) / F.col("_r"))
    low = F.min("_q").over(family.orderBy("_r").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return ranked.withColumn(name, F.when(F.col(p).isNotNull(), F.least(low, F.lit(1.0)))).drop("_r", "_q")


#: Groups up to this size have an exact rank-sum p.
EXACT = 8


def normal_tail(z: Column) -> Column:
    """Share of the normal distribution beyond z >= 0, to 1e-7."""
    # Coefficients of a rational approximation.
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series


def rank_sums(df: DataFrame, endpoint: list[str], group: str, value: str, contrasts: DataFrame) -> DataFrame:
    """(endpoint, g1, g2, n1, n2, u, p): Mann-Whitney U of the first group and its two-sided p.

    Exact, by how many choices of ranks give each U, for groups of EXACT subjects at most; by the normal
    approximation, with corrections for ties and continuity, for larger ones; null below two.
    """
    # Means of the same numbers in another order differ in the last digits; they are ties.
    same = F.format_string("%.12e", F.col(value).cast("double")).cast("double")
    df = staged(df.select(*endpoint, group, F.when(F.col(value).isNotNull(), same).alias(value)), "subjects")
    a = df.select(*endpoint, F.col(group).alias("g1"), F.col(value).alias("a")).filter("a IS NOT NULL")
    b = df.select(*endpoint, F.col(group).alias("g2"), F.col(value).alias("b")).filter("b IS NOT NULL")
    lists = lambda x, g, v: x.groupBy(*endpoint, g).agg(F.array_sort(F.collect_list(v)).alias(v))
    both = contrasts.join(lists(a, "g1", "a"), "g1").join(lists(b, "g2", "b"), [*endpoint, "g2"])
    u = F.aggregate(F.transform("a", lambda x: F.aggregate("b", F.lit(0.0), lambda s, y: s + F.when(x > y, 1.0).when(x == y, 0.5).otherwise(0.0))), F.lit(0.0), lambda s, x: s + x)
    all_ = F.concat("a", "b")
    ties = F.aggregate(F.transform(F.array_distinct(all_), lambda v: F.size(F.filter(all_, lambda x: x == v))), F.lit(0.0), lambda s, t: s + (t * t * t - t))
    sized = both.select(*endpoint, "g1", "g2", F.size("a").cast("bigint").alias("n1"), F.size("b").cast("bigint").alias("n2"), u.alias("u"), ties.alias("_ties"))
    tables = df.sparkSession.createDataFrame([(n, m, float(2 * k), c) for n in range(2, EXACT + 1) for m in range(2, EXACT + 1) for k, c in _u_counts(n, m).items()], "n1 bigint, n2 bigint, u2 double, ways bigint")
    far = F.abs(2 * F.col("u") - F.col("n1") * F.col("n2"))
    exact = F.sum(F.when(F.abs(F.col("u2") - F.col("n1") * F.col("n2")) >= far, F.col("ways")).otherwise(0)) / F.sum("ways")
    counted = sized.join(F.broadcast(tables), ["n1", "n2"], "left").groupBy(*endpoint, "g1", "g2", "n1", "n2", "u", "_ties").agg(exact.alias("_exact"))
    n, nm = F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2")
    sd = F.sqrt(nm / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = F.greatest(F.lit(0.0), (F.abs(F.col("u") - nm / 2) - 0.5) / sd)
    normal = F.when((F.least("n1", "n2") >= 2) & (sd > 0), F.least(F.lit(1.0), 2 * normal_tail(z)))
    return counted.select(*endpoint, "g1", "g2", "n1", "n2", "u", F.coalesce("_exact", normal).alias("p"))


def _u_counts(n: int, m: int) -> dict[int, int]:
    """How many of the choices of n ranks among n + m give each U."""
    counts = {(0, 0): 1}
    for rank in range(n + m):
        step: dict[tuple[int, int], int] = {}
        for (picked, u), ways in counts.items():
            step[picked, u] = step.get((picked, u), 0) + ways
            if picked < n:
                key = (picked + 1, u + rank - picked)
                step[key] = step.get(key, 0) + ways
        counts = step
    return {u: w for (picked, u), w in counts.items() if picked == n}


#: Groups up to this size have all their resamples enumerated.
ENUMERATED = 4


def resampled_range(df: DataFrame, endpoint: list[str], group: str, value: str, contrasts: DataFrame) -> DataFrame:
    """(endpoint, g1, g2, g_min, g_max, n_unique): Hedges' g over every pair of resamples with replacement.

    A group of n subjects has n to the power n resamples, so groups of ENUMERATED at most; pairs without spread have no g.
    """
    df = staged(df.select(*endpoint, group, value), "subjects")
    v, n = F.col("v"), F.size("v")
    pick = lambda i, j: F.get(v, (F.floor(i / F.pow(n, j)) % n).cast("int"))
    drawn = F.transform(F.sequence(F.lit(0), F.pow(n, n).cast("int") - 1), lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: pick(i, j)))
    total = lambda s, f: F.aggregate(s, F.lit(0.0), lambda a, x: a + f(x))
    moments = F.transform(drawn, lambda s: F.struct((total(s, lambda x: x) / n).alias("m"), s.alias("s")))
    spread = F.transform(moments, lambda r: F.struct(r["m"].alias("m"), total(r["s"], lambda x: (x - r["m"]) * (x - r["m"])).alias("q")))

    def side(i: int) -> DataFrame:
        lists = df.filter(F.col(value).isNotNull()).groupBy(*endpoint, F.col(group).alias(f"g{i}")).agg(F.array_sort(F.collect_list(value)).alias("v")).filter(F.size("v").between(2, ENUMERATED))
        return lists.select(*endpoint, f"g{i}", n.alias(f"n{i}"), F.explode(spread).alias(f"r{i}"))

    both = contrasts.join(side(1), "g1").join(side(2), [*endpoint, "g2"])
    free = F.col("n1") + F.col("n2") - 2
    pooled = (F.col("r1.q") + F.col("r2.q")) / free
    g = F.when(pooled > 1e-24, (F.col("r2.m") - F.col("r1.m")) / F.sqrt(pooled) * (1 - 3 / (4 * free - 1)))
    return both.withColumn("g", g).groupBy(*endpoint, "g1", "g2").agg(F.min("g").alias("g_min"), F.max("g").alias("g_max"), F.count_distinct(F.round("g", 6)).alias("n_unique"))


def top_by_size(df: DataFrame, keys: list[str], value: str, tie: list[str], k: int) -> DataFrame:
    """The k rows of each key with the largest absolute value, nulls last, with their place."""
    place = Window.partitionBy(*keys).orderBy(F.abs(value).desc_nulls_last(), *tie)
    return df.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def t_test_power(g: float, n: int, alpha_z: float = Z_ALPHA, steps: int = 400) -> float:
    """Power of a two-sided two-sample t test with n a group, by numeric integration over the spread's distribution."""
    df = 2 * n - 2
    t = t_quantile(0.975, df)
    shift = g * math.sqrt(n / 2)
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    # the pooled spread is chi / sqrt(df): integrate over chi
    top = math.sqrt(df) + 8
    width = top / steps
    total = 0.0
    for i in range(steps):
        c = (i + 0.5) * width
        density = math.exp((df - 1) * math.log(c) - c * c / 2 - (df / 2 - 1) * math.log(2) - math.lgamma(df / 2))
        total += density * width * (1 - phi(t * c / math.sqrt(df) - shift) + phi(-t * c / math.sqrt(df) - shift))
    return total


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on its distribution function."""
    def below(x: float) -> float:
        n, w = 2_000, x / 2_000
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        return 0.5 + sum(c * (1 + ((i + 0.5) * w) ** 2 / df) ** (-(df + 1) / 2) for i in range(n)) * w

    low, high = 0.0, 200.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def n_for_t_test(g: float, power: float = 0.8, most: int = 100_000) -> int | None:
    """Subjects a group that a t test needs for an effect of g; None if more than `most`."""
    if abs(g) < 1e-6:
        return None
    low, high = 2, 2
    while high <= most and t_test_power(abs(g), high) < power:
        low, high = high, high * 2
    if high > most:
        return None
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if t_test_power(abs(g), mid) < power else (low, mid)
    return high


def n_for_rank_test(g: float, power: float = 0.8) -> int | None:
    n = n_for_t_test(g, power)
    return None if n is None else math.ceil(n * math.pi / 3)


def detectable(n: int, power: float = 0.8) -> float:
    """The least effect that n subjects a group detect with the given power."""
    low, high = 1e-3, 50.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if t_test_power(mid, n) < power else (low, mid)
    return high
