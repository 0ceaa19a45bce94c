"""Statistics over spatial edges: composition, enrichment, differences, autocorrelation, point patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.folders import staged


def enrichment(units: DataFrame, edges: DataFrame, keys: list[str], label: str, clip: float = 10.0) -> DataFrame:
    """Observed over expected share of each neighbour label around each focal label, per key.

    The full grid of a key's labels is given, pairs never seen included. units: (keys, id, label).
    log2_enrichment is null where nothing was observed, and held within the clip elsewhere.
    """
    named = units.select(*keys, F.col("id"), F.col(label).alias("l"))
    counts = named.groupBy(*keys, "l").agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("expected", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    pairs = (
        edges.join(named.select(*keys, F.col("id").alias("src"), F.col("l").alias("focal")), [*keys, "src"])
        .join(named.select(*keys, F.col("id").alias("dst"), F.col("l").alias("neighbour")), [*keys, "dst"])
        .groupBy(*keys, "focal", "neighbour").agg(F.count(F.lit(1)).alias("m"))
    )
    seen = pairs.withColumn("observed", F.col("m") / F.sum("m").over(Window.partitionBy(*keys, "focal"))).drop("m")
    grid = share.select(*keys, F.col("l").alias("focal"), F.col("n").alias("n_focal")).join(share.select(*keys, F.col("l").alias("neighbour"), "expected"), keys)
    full = grid.join(seen, [*keys, "focal", "neighbour"], "left").na.fill(0.0, ["observed"])
    ratio = full.withColumn("enrichment", F.col("observed") / F.col("expected"))
    return ratio.withColumn("log2_enrichment", F.when(F.col("enrichment") > 0, F.greatest(F.least(F.log2("enrichment"), F.lit(clip)), F.lit(-clip))))


def strata(per_unit: DataFrame, value: str, weight: str, cell: list[str], strata_columns: list[str], subject: list[str], least: int) -> DataFrame:
    """Means of subjects' means over all lenses that grouping sets of the strata give, in one pass.

    A dense region counts no more than a sparse one and a subject no more than another. Rows short
    of support are kept with their value nulled and a flag; 'pooled' stands for a stratum that is
    not distinguished.
    """
    lenses = [[], *[[s] for s in strata_columns], strata_columns] if len(strata_columns) > 1 else [[], strata_columns]
    # GROUPING SETS: one pass over the units for all lenses.
    sets = [[*cell, *subject, *lens] for lens in lenses]
    pooled = per_unit.groupingSets(sets, *cell, *subject, *strata_columns).agg(F.avg(value).alias("v"), F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"), *(F.grouping(s).alias(f"_g_{s}") for s in strata_columns))
    first = pooled.withColumns({f"{s}_level": F.when(F.col(f"_g_{s}") == 1, "pooled").otherwise(F.col(s)) for s in strata_columns})
    out = [*cell, *(f"{s}_level" for s in strata_columns)]
    made = first.groupBy(*out).agg(
        F.avg("v").alias("mean"), F.min("v").alias("range_min"), F.max("v").alias("range_max"), F.sum("w").alias("n_support"), F.sum("n").alias("n_regions"),
        F.count(F.lit(1)).alias("n_subjects"), F.count("v").alias("n_effective"), F.array_sort(F.collect_list(F.round("v", 6))).alias("subject_values"),
    )
    short = F.col("n_support") < least
    return made.withColumns({"insufficient_support": short, **{c: F.when(~short, F.col(c)) for c in ("mean", "range_min", "range_max")}})


def neighbour_minus_self(units: DataFrame, edges: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """(keys, id, d_<score>): mean of the neighbours' scores less the unit's own."""
    theirs = edges.join(units.select(*keys, F.col("id").alias("dst"), *scores), [*keys, "dst"]).groupBy(*keys, "src").agg(*(F.avg(s).alias(f"m_{s}") for s in scores))
    both = units.join(theirs.withColumnRenamed("src", "id"), [*keys, "id"])
    return both.select(*keys, "id", *(c for c in units.columns if c not in (*keys, "id", *scores)), *((F.col(f"m_{s}") - F.col(s)).alias(f"d_{s}") for s in scores))


def supported_means(df: DataFrame, keys: list[str], values: list[str], least: int) -> DataFrame:
    """Means of values per key, null (the row kept, with a flag) where fewer than `least` units are behind them."""
    made = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(v) for v in values))
    return made.select(*keys, "n", (F.col("n") < least).alias("below_min_support"), *(F.when(F.col("n") >= least, F.col(v)).alias(v) for v in values))


def complete_trajectories(df: DataFrame, label: str, time: str, n_times: int) -> DataFrame:
    """Rows of the labels that have a value at every time point."""
    full = df.groupBy(label).agg(F.count_distinct(time).alias("n")).filter(F.col("n") == n_times).select(label)
    return df.join(full, label, "left_semi")


def minus_control(df: DataFrame, keys: list[str], time: str, control: str, value: str) -> DataFrame:
    """Adds the value less the mean of the control's values of the same key."""
    base = F.avg(F.when(F.col(time) == control, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(f"{value}_delta", F.col(value) - base)


def morans_i(units: DataFrame, edges: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, n, i_<value>): sum over edges of the products of deviations, edges of a unit weighing one in all, over the sum of squares.

    edges: (keys, src, dst, w), w the weight of each edge.
    """
    mean = Window.partitionBy(*keys)
    dev = units.select(*keys, "id", *((F.col(v) - F.avg(v).over(mean)).alias(v) for v in values)).withColumn("n", F.count(F.lit(1)).over(mean))
    theirs = dev.select(*keys, F.col("id").alias("dst"), *(F.col(v).alias(f"o_{v}") for v in values))
    cross = edges.join(dev.withColumnRenamed("id", "src"), [*keys, "src"]).join(theirs, [*keys, "dst"]).groupBy(*keys).agg(*(F.sum(F.col("w") * F.col(v) * F.col(f"o_{v}")).alias(f"c_{v}") for v in values), F.sum("w").alias("w"))
    squares = dev.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(v) * F.col(v)).alias(f"q_{v}") for v in values))
    return cross.join(squares, keys).select(*keys, "n", *(F.when(F.col(f"q_{v}") > 0, F.col("n") / F.col("w") * F.col(f"c_{v}") / F.col(f"q_{v}")).alias(f"i_{v}") for v in values))


def join_counts(units: DataFrame, edges: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """(keys, n, n_positive, joins): how many edges join two flagged units."""
    on = units.filter(flag)
    joined = edges.join(on.select(*keys, F.col("id").alias("src")), [*keys, "src"], "left_semi").join(on.select(*keys, F.col("id").alias("dst")), [*keys, "dst"], "left_semi")
    counts = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(flag)).alias("n_positive"))
    return counts.join(joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("joins")), keys, "left").na.fill(0, ["joins"])


def ripley(points: DataFrame, edges: DataFrame, keys: list[str], radii: list[float], area: float, field: float) -> DataFrame:
    """(keys, radius, k, k_translation, l): Ripley's K without and with translation correction, and L, over a square field.

    edges: ordered pairs up to the largest radius with |dx|, |dy| as ax, ay and d2.
    """
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    at = F.explode(F.filter(F.array(*(F.lit(float(r)) for r in radii)), lambda r: F.col("d2") <= r * r))
    weight = field * field / ((field - F.col("ax")) * (field - F.col("ay")))
    sums = edges.select(*keys, "d2", weight.alias("w"), at.alias("radius")).groupBy(*keys, "radius").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("mw"))
    k = lambda c: area * F.col(c) / (F.col("n") * (F.col("n") - 1))
    return sums.join(n, keys).select(*keys, "radius", k("m").alias("k"), k("mw").alias("k_translation"), (F.sqrt(k("m") / F.pi()) - F.col("radius")).alias("l"))


def local_covariance(units: DataFrame, edges: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(keys, id, cov_a_b): sample covariance of each pair of values over a unit's neighbours; 0 below two."""
    values = sorted({v for p in pairs for v in p})
    near = edges.join(units.select(*keys, F.col("id").alias("dst"), *values), [*keys, "dst"])
    return near.groupBy(*keys, F.col("src").alias("id")).agg(*(F.coalesce(F.when(F.count(F.lit(1)) >= 2, F.covar_samp(a, b)), F.lit(0.0)).alias(f"cov_{a}_{b}") for a, b in pairs))


def label_components(units: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, component): the smallest id reachable over the edges, by rounds of taking the least label around, until none changes.

    A label also jumps to its label's label in each round, so the rounds grow with the logarithm of the path length.
    """
    links = staged(edges.select(*keys, "src", "dst"), "component-links")
    labels = staged(units.select(*keys, "id", F.col("id").alias("component")), "components")
    while True:
        around = links.join(labels.withColumnRenamed("id", "dst"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("id")).agg(F.min("component").alias("low"))
        lower = labels.join(around, [*keys, "id"], "left").select(*keys, "id", F.col("component").alias("old"), F.least("component", "low").alias("mid"))
        jump = lower.select(*keys, F.col("id").alias("mid"), F.col("mid").alias("far"))
        now = staged(lower.join(jump, [*keys, "mid"], "left").select(*keys, "id", "old", F.least("mid", "far").alias("component")), "components")
        if now.filter("old <> component").isEmpty():
            return now.drop("old")
        labels = now.drop("old")
