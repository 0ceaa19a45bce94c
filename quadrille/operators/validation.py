"""Validators and gates: scores of regions, rules that judge them, decisions to go on."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.operators import thresholds

# Least scores and sizes, of which those from one half on fail a region and lesser ones warn.
LEAST = {"coordinate_quality": 0.3, "ion_count_quality": 0.4, "biological_quality": 0.3, "overall_quality": 0.5}
MIN_PIXELS, MIN_PROTEINS, MIN_COMPLETE = 1_000, 3, 0.5
MAX_BATCH_CV, MIN_BATCH, TREND_WINDOW, MAX_DECLINE = 0.3, 2, 5, -0.05
# Markers that are high or low where a part of the organ is, and those that rise or fall at a time.
SIGNATURES = {"cortex": (["cd31", "cd34"], ["cd140a"]), "medulla": (["cd140a"], ["cd31", "cd34"])}
RESPONSES = {"D1": (["ly6g", "cd11b", "cd45"], []), "D3": (["cd206", "cd11b", "cd45"], ["ly6g"]), "D7": (["cd140a", "cd140b", "cd206"], ["ly6g"])}


def mean_of(columns: list[Column]) -> Column:
    return reduce(add, columns) / len(columns)


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def region_scores(pixels: DataFrame, keys: list[str], markers: list[str], expected: list[str], dna: str) -> DataFrame:
    """Scores in 0..1 of each region: coordinates, ion counts, biology, completeness; and the mean of the first three.

    A marker counts as found if a pixel has it.
    """
    def channel(m: str) -> Column:
        sd = F.stddev_pop(m)
        return 0.5 * F.avg((F.col(m) > 0).cast("double")) + 0.5 * F.least(F.lit(1.0), F.when(sd > 0, F.avg(m) / (sd + 1e-10)).otherwise(0.0) / 2)

    wide = (F.max("x") - F.min("x") > 10) & (F.max("y") - F.min("y") > 10)
    found = reduce(add, ((F.max(m) > 0).cast("int") for m in markers))
    s = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pixels"), found.alias("n_proteins"), (F.avg((F.col("x").isNotNull() & F.col("y").isNotNull()).cast("double")) * F.when(wide, 1.0).otherwise(0.5)).alias("coordinate_quality"), mean_of([channel(m) for m in markers]).alias("ion_count_quality"), F.least(F.lit(1.0), F.avg(dna) / 50).alias("_dna"))
    s = s.withColumn("protein_completeness", unit(F.col("n_proteins") / len(expected)))
    s = s.withColumn("biological_quality", 0.6 * F.col("protein_completeness") + 0.4 * F.col("_dna")).drop("_dna")
    return s.withColumn("overall_quality", overall(["coordinate_quality", "ion_count_quality", "biological_quality"]))


def overall(base: list[str], optional: list[str] | None = None) -> Column:
    """Mean of the base scores and, each as half of itself, of those optional scores that are there; in 0..1."""
    halves = [F.when(F.col(c).isNotNull(), F.col(c) * 0.5) for c in optional or []]
    n = reduce(add, (h.isNotNull().cast("int") for h in halves), F.lit(len(base)))
    return unit((reduce(add, (F.col(c) for c in base)) + reduce(add, (F.coalesce(h, F.lit(0.0)) for h in halves), F.lit(0.0))) / n)


def region_gate(scores: DataFrame) -> DataFrame:
    """Adds n_issues, n_warnings and decision: FAIL by any issue, WARN by any warning, else PASS."""
    short = {m: (F.col(m) < least).cast("int") for m, least in LEAST.items()}
    issues = [short[m] for m, least in LEAST.items() if least >= 0.5] + [(F.col("n_pixels") < MIN_PIXELS).cast("int"), (F.col("n_proteins") < MIN_PROTEINS).cast("int"), (F.col("protein_completeness") < MIN_COMPLETE).cast("int")]
    out = scores.withColumns({"n_issues": reduce(add, issues), "n_warnings": reduce(add, [short[m] for m, least in LEAST.items() if least < 0.5])})
    return out.withColumn("decision", F.when(F.col("n_issues") > 0, "FAIL").when(F.col("n_warnings") > 0, "WARN").otherwise("PASS"))


def decision_summary(decisions: DataFrame, column: str = "decision") -> DataFrame:
    """(decision, n, share)."""
    counts = decisions.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = decisions.agg(F.count(F.lit(1)).alias("_t"))
    return counts.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_t")).alias("share"))


def batch_gate(history: DataFrame, batch: str, value: str) -> DataFrame:
    """(batch, n, mean, cv, batch_decision): WARN for much variation, few regions or low quality; a single region passes."""
    s = history.groupBy(batch).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_pop(value) / F.avg(value)).alias("cv"))
    concern = (F.col("cv") > MAX_BATCH_CV) | (F.col("n") < MIN_BATCH) | (F.col("mean") < LEAST["overall_quality"])
    return s.withColumn("batch_decision", F.when((F.col("n") >= 2) & concern, "WARN").otherwise("PASS"))


def trend_gate(history: DataFrame, keys: list[str], order: list[str], value: str, window: int = TREND_WINDOW) -> DataFrame:
    """(keys, slope, recent_mean, trend_decision) of each key's last `window` values: ABORT for a steep decline or a low level.

    The last rows are told by rank, of which each task keeps `window` before anything is shuffled; only those are gathered. Rows that agree in
    key, order and value are alike.
    """
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in [*order, value])))
    few = history.select(*keys, *order, value).withColumn("_r", last).filter(F.col("_r") <= window)
    place = F.struct(*order, F.col(value).alias("_v"))
    whole = few.groupBy(*keys).agg(F.sort_array(F.collect_list(place), asc=False).alias("_top"))
    v = F.transform(F.reverse("_top"), lambda s: s["_v"])
    n = F.size("_top")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    centre = (n - 1) / 2
    slope = F.aggregate(F.transform(v, lambda x, i: (i - centre) * x), F.lit(0.0), lambda a, x: a + x) / (n * (n * n - 1) / 12)
    s = whole.select(*keys, F.when(n == window, slope).alias("slope"), F.when(n == window, mean).alias("recent_mean"))
    abort = (F.col("slope") < MAX_DECLINE) | (F.col("recent_mean") < LEAST["overall_quality"] * 0.8)
    return s.withColumn("trend_decision", F.when(abort, "ABORT").when(F.col("slope") < -0.01, "WARN").otherwise("PASS"))


def continuation(current: DataFrame, batches: DataFrame, trends: DataFrame, on: str) -> DataFrame:
    """Adds should_continue and skip_current: an abort ends the run, a failed region is left out."""
    all_ = current.join(batches.select(on, "batch_decision"), on, "left").join(trends.select(on, "trend_decision"), on, "left")
    return all_.withColumns({"should_continue": F.coalesce(F.col("trend_decision") != "ABORT", F.lit(True)), "skip_current": F.col("decision") == "FAIL"})


def limits_of(scores: DataFrame, metrics: list[str], least: int = 10) -> DataFrame:
    """(metric, mean, lower and upper warning and control limits in 0..1) over all regions; none below `least` regions."""
    s = scores.unpivot([], metrics, "metric", "value").groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).filter(F.col("n") >= least)
    return s.select("metric", "mean", *(unit(F.col("mean") + k * F.col("sd")).alias(n) for n, k in (("lower_control", -3), ("lower_warning", -2), ("upper_warning", 2), ("upper_control", 3))))


def statuses(scores: DataFrame, limits: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, value, status): qualities are judged by their lower limits."""
    long = scores.unpivot([key], metrics, "metric", "value").join(F.broadcast(limits), "metric")
    status = F.when(F.col("value") < F.col("lower_control"), "out_of_control").when(F.col("value") < F.col("lower_warning"), "warning").otherwise("in_control")
    return long.select(key, "metric", "value", status.alias("status"))


def metric_rows(results: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """One row a region of the scores of rules, 0 where a rule said nothing. results: (key, rule, score); names: rule to column."""
    return results.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col("rule") == rule, F.col("score"))), F.lit(0.0)).alias(c) for rule, c in names.items()))


def transformation_checks(rows: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Per key: range compression, share of ordered pairs kept, zeros kept, share of finite values."""
    w = Window.partitionBy(*keys).orderBy(before, after)
    r = rows.withColumn("_fell", (F.col(after) < F.lag(after).over(w)).cast("int"))
    finite = F.col(after).isNotNull() & ~F.isnan(after) & (F.abs(after) != float("inf"))
    span = lambda c: F.max(c) - F.min(c)
    zeros = F.count_if(F.col(before) == 0)
    return r.groupBy(*keys).agg(
        F.when(span(before) > 0, span(after) / span(before)).otherwise(0.0).alias("range_compression"), (1 - F.coalesce(F.sum("_fell"), F.lit(0)) / F.count(F.lit(1))).alias("monotonicity"),
        F.when(zeros > 0, F.count_if(F.abs(after) < 1e-10) / zeros).alias("zero_preservation"), F.avg(finite.cast("double")).alias("finite_share"),
    )


def marker_names(before: DataFrame, after: DataFrame, marker: str) -> DataFrame:
    """(marker, state): kept, lost or extra."""
    b, a = before.select(marker).distinct().withColumn("_b", F.lit(1)), after.select(marker).distinct().withColumn("_a", F.lit(1))
    return b.join(a, marker, "full_outer").select(marker, F.when(F.col("_a").isNull(), "lost").when(F.col("_b").isNull(), "extra").otherwise("kept").alias("state"))


def preprocessing_checks(rows: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Per key: completeness, how well the signal is kept (correlation, no less than 0), how natural the positives are spread; their mean and how severe that is."""
    positive = F.when(F.col(after) > 0, F.col(after))
    shape = (F.greatest(F.lit(0.0), 1 - F.abs(F.skewness(positive) - 1) / 3) + F.greatest(F.lit(0.0), 1 - F.abs(F.kurtosis(positive)) / 5)) / 2
    flat = (F.stddev_pop(before) > 0) & (F.stddev_pop(after) > 0)
    s = rows.groupBy(*keys).agg((F.count(after) / F.count(F.lit(1))).alias("completeness"), F.when(flat, F.greatest(F.lit(0.0), F.corr(before, after))).otherwise(0.0).alias("signal_preservation"), F.when(F.count(positive) >= 10, shape).otherwise(0.5).alias("background_quality"))
    quality = (F.col("completeness") + F.col("signal_preservation") + F.col("background_quality")) / 3
    return s.withColumn("quality", quality).withColumn("severity", F.when(F.col("quality") < 0.15, "critical").when(F.col("quality") < 0.35, "warning").otherwise("pass"))


def cluster_checks(rows: DataFrame, keys: list[str], cluster: str, values: list[str]) -> DataFrame:
    """Per key: number of clusters, balance of sizes, separation (mean distance between centroids over mean distance to the own one, halved, 1 at most), specificity."""
    c = rows.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("_n"), *(F.avg(v).alias(f"_c_{v}") for v in values))
    gap = lambda a, b: F.sqrt(reduce(add, (F.pow(F.col(x) - F.col(y), 2) for x, y in zip(a, b))))
    # Centroids are one row a cluster; pairs of them are pairs of clusters of one key.
    other = c.select(*keys, F.col(cluster).alias("_o"), *(F.col(f"_c_{v}").alias(f"_o_{v}") for v in values))
    between = c.join(other, keys).filter(F.col(cluster) < F.col("_o")).groupBy(*keys).agg(F.avg(gap([f"_c_{v}" for v in values], [f"_o_{v}" for v in values])).alias("_between"))
    several = c.filter("_n > 1")
    within = rows.join(several, [*keys, cluster]).groupBy(*keys).agg(F.avg(gap(values, [f"_c_{v}" for v in values])).alias("_within"))
    total = reduce(add, (F.col(f"_c_{v}") for v in values))
    shape = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"), (1 / (1 + F.stddev_pop("_n") / F.avg("_n"))).alias("size_balance"), F.avg(F.when(total > 0, F.greatest(*(F.col(f"_c_{v}") for v in values)) / total)).alias("specificity"))
    separation = F.when(F.col("n_clusters") < 2, 1.0).when(F.col("_within") > 0, F.least(F.lit(1.0), F.col("_between") / F.col("_within") / 2)).otherwise(0.5)
    return shape.join(between, keys, "left").join(within, keys, "left").select(*keys, "n_clusters", "size_balance", "specificity", separation.alias("separation"))


def signature_scores(rows: DataFrame, keys: list[str], cluster: str, markers: list[str], least_rows: int = 5, least_score: float = 0.3) -> DataFrame:
    """(keys, signature, quality, n_with): the best score of a cluster for each signature, and how many clusters have it.

    A cluster's score is the mean of how far its high markers are above the key's mean and its low ones below.
    """
    whole = rows.groupBy(*keys).agg(*(F.avg(m).alias(f"_g_{m}") for m in markers))
    c = rows.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("_n"), *(F.avg(m).alias(m) for m in markers)).filter(F.col("_n") >= least_rows).join(whole, keys)
    ratio = lambda m: F.when(F.col(f"_g_{m}") > 0, F.col(m) / F.col(f"_g_{m}"))
    up = lambda ms: reduce(add, (F.coalesce(F.greatest(F.lit(0.0), ratio(m) - 1), F.lit(0.0)) for m in ms)) / len(ms)
    down = lambda ms: reduce(add, (F.coalesce(F.greatest(F.lit(0.0), 1 - ratio(m)), F.lit(0.0)) for m in ms)) / len(ms)
    scored = F.explode(F.array(*(F.struct(F.lit(name).alias("signature"), F.round((up(high) + down(low)) / 2, 9).alias("score")) for name, (high, low) in SIGNATURES.items())))
    return c.select(*keys, cluster, scored.alias("s")).groupBy(*keys, "s.signature").agg(F.max("s.score").alias("quality"), F.count_if(F.col("s.score") > least_score).alias("n_with"))


def response_scores(rows: DataFrame, time: str, control: str, markers: list[str]) -> DataFrame:
    """(time, n_risen, n_fallen, quality): which expected changes against the control are there (a fifth up or down)."""
    means = rows.groupBy(time).agg(*(F.avg(m).alias(m) for m in markers))
    base = F.broadcast(means.filter(F.col(time) == control).select(*(F.col(m).alias(f"_b_{m}") for m in markers)))
    change = lambda m: F.when(F.col(f"_b_{m}") > 0, F.col(m) / F.col(f"_b_{m}"))
    count = lambda tests: reduce(add, (F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0))
    out = None
    for at, (rise, fall) in RESPONSES.items():
        risen, fallen = count([change(m) > 1.2 for m in rise]), count([change(m) < 0.8 for m in fall])
        one = means.filter(F.col(time) == at).join(base).select(time, risen.alias("n_risen"), fallen.alias("n_fallen"), ((risen / max(1, len(rise)) + fallen / max(1, len(fall))) / 2).alias("quality"))
        out = one if out is None else out.unionByName(one)
    return out


def suite_summary(results: DataFrame) -> DataFrame:
    """(total_rules, n_critical, n_warning, n_pass, mean_quality, min_quality, status). results: (rule, severity, score)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    s = results.agg(F.count(F.lit(1)).alias("total_rules"), n("critical").alias("n_critical"), n("warning").alias("n_warning"), n("pass").alias("n_pass"), F.avg("score").alias("mean_quality"), F.min("score").alias("min_quality"))
    return s.withColumn("status", F.when(F.col("n_critical") > 0, "critical").when(F.col("n_warning") > 0, "warning").otherwise("pass"))


def practical_checks(pixels: DataFrame, keys: list[str], markers: list[str], dna: list[str]) -> DataFrame:
    """(keys, n_cells, n_issues, n_critical, status) by plain checks of counts, extent, signal to noise, zeros and DNA."""
    ends = thresholds.percentiles(pixels, keys, markers, [0.05, 0.95])
    p5, p95 = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    noisy = ends.groupBy(*keys).agg(F.count_if((p5 > 0) & (p95 / F.when(p5 > 0, p5) < 1.5)).alias("_noisy"))
    empty = [(F.avg((F.col(m) == 0).cast("double")) > 0.9).cast("int") for m in markers]
    dark = [(F.avg(d) < 5).cast("int") for d in dna]
    loose = F.coalesce((F.corr(*dna) < 0.6).cast("int"), F.lit(0))
    flat = ((F.max("x") == F.min("x")) | (F.max("y") == F.min("y"))).cast("int")
    counted = [F.coalesce(t, F.lit(0)) for t in (*empty, *dark)]
    s = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), flat.alias("n_critical"), (reduce(add, counted) + loose + (F.count(F.lit(1)) < 100).cast("int") + flat).alias("n_issues"))
    s = s.join(noisy, keys, "left").withColumn("n_issues", (F.col("n_issues") + F.coalesce("_noisy", F.lit(0))).cast("int")).drop("_noisy")
    status = F.when(F.col("n_critical") > 0, "FAIL").when(F.col("n_issues") > 5, "POOR").when(F.col("n_issues") > 2, "FAIR").when(F.col("n_issues") > 0, "GOOD").otherwise("EXCELLENT")
    return s.withColumn("status", status)


def nearest_regularity(neighbours: DataFrame, keys: list[str], d2: str = "d2") -> DataFrame:
    """(keys, regularity): e to the minus variation of the distances to the nearest neighbour, in 0..1; 0.5 below ten points."""
    d = F.sqrt(d2)
    return neighbours.groupBy(*keys).agg(F.when(F.count(F.lit(1)) < 10, 0.5).when(F.avg(d) > 0, unit(F.exp(-F.stddev_pop(d) / F.avg(d)))).otherwise(0.0).alias("regularity"))
