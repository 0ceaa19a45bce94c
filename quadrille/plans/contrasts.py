"""Plans of the subject level: composition, log-ratios, effect sizes, adjustment, batches, quality history, knowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import batches, composition, effects, gating, knowledge, quality, statistics, thresholds
from quadrille.plans.common import LONG_SQL, SCORED_SQL, query, r6, rounded, scored, units, with_interface
from quadrille.plans.units import GATED_SQL, PAIRED_SQL, gated, paired
from quadrille.sources import virtual
from quadrille.sources.virtual import BASE_SQL, MARKERS

_CATS = ", ".join(f"'{c}'" for c in gating.INTERFACES)
_FRACTIONS = f"""{SCORED_SQL}, cats AS (SELECT unnest([{_CATS}]) AS category), k AS (SELECT roi, interface AS category, count(*) AS n FROM scored GROUP BY ALL),
rois AS (SELECT roi, any_value(timepoint) AS timepoint, any_value(mouse) AS mouse, any_value(region) AS region, count(*) AS n_total FROM scored GROUP BY roi),
fr AS (SELECT r.*, c.category, coalesce(k.n, 0) AS n, coalesce(k.n, 0) / r.n_total AS fraction FROM rois r CROSS JOIN cats c LEFT JOIN k ON k.roi = r.roi AND k.category = c.category),
mf AS (SELECT timepoint, mouse, category, avg(fraction) AS fraction, sum(n_total) AS n_total, count(*) AS n_regions FROM fr GROUP BY ALL)"""
_CLR = f"""{_FRACTIONS}, rep AS (SELECT *, CASE WHEN sum(fraction) OVER w > 0 THEN (fraction * n_total + 0.5) / (n_total + count(*) OVER w * 0.5) ELSE 1.0 / count(*) OVER w END AS replaced FROM mf WINDOW w AS (PARTITION BY timepoint, mouse)),
cl AS (SELECT *, ln(replaced) - avg(ln(replaced)) OVER (PARTITION BY timepoint, mouse) AS clr FROM rep)"""


def region_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_interface(scored(spark, sf_dir))
    return composition.fractions(df, ["roi", "timepoint", "mouse", "region"], "interface", gating.INTERFACES)


def subject_clr(spark: SparkSession, sf_dir: str) -> DataFrame:
    mice = composition.to_subjects(region_fractions(spark, sf_dir), ["timepoint", "mouse", "category"])
    return composition.clr(composition.replace_zeros(mice, ["timepoint", "mouse"]), ["timepoint", "mouse"], "replaced")


@query(f"WITH {_FRACTIONS} SELECT roi, timepoint, mouse, region, category, n, n_total, {r6('fraction', 'fraction')} FROM fr")
def interface_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(region_fractions(spark, sf_dir))


@query(f"WITH {_CLR} SELECT timepoint, mouse, category, {r6('fraction', 'fraction')}, n_total::BIGINT AS n_total, n_regions, {r6('replaced', 'replaced')}, {r6('clr', 'clr')} FROM cl")
def subject_log_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(subject_clr(spark, sf_dir).drop("n_valued"))


@query(f"""WITH {_FRACTIONS}, m AS (SELECT category, timepoint, avg(fraction) AS m FROM mf GROUP BY ALL), t AS (SELECT category, max(m) AS top FROM m GROUP BY category)
SELECT timepoint, mouse, CASE WHEN top < 0.05 THEN 'other_rare' ELSE category END AS category, round(sum(fraction), 6) AS fraction, max(n_total)::BIGINT AS n_total FROM mf JOIN t USING (category) GROUP BY ALL""")
def rare_merged_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mice = composition.to_subjects(region_fractions(spark, sf_dir), ["timepoint", "mouse", "category"])
    return rounded(composition.merge_rare(mice, "timepoint", ["mouse"], 0.05))


_PAIRS = "con AS (SELECT * FROM (VALUES ('Sham','D1'),('Sham','D3'),('Sham','D7'),('D1','D3'),('D1','D7'),('D3','D7')) AS v(g1, g2))"


def _effect_sql(source: str, value: str, endpoint: str = "category") -> str:
    """CTEs st (per group) and ef (per contrast) over a table with the endpoint, timepoint and value."""
    return f"""{_PAIRS}, st AS (SELECT {endpoint}, timepoint, count({value}) AS n, avg({value}) AS m, var_samp({value}) AS v, min({value}) AS lo, max({value}) AS hi FROM {source} GROUP BY ALL),
e0 AS (SELECT k.{endpoint}, g1, g2, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2, a.m AS m1, b.m AS m2, a.lo AS lo1, a.hi AS hi1, b.lo AS lo2, b.hi AS hi2, a.v AS v1, b.v AS v2
FROM (SELECT DISTINCT {endpoint} FROM {source}) k CROSS JOIN con LEFT JOIN st a ON a.{endpoint} = k.{endpoint} AND a.timepoint = g1 LEFT JOIN st b ON b.{endpoint} = k.{endpoint} AND b.timepoint = g2),
e1 AS (SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2 AND ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) > 1e-24 THEN (m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3 / (4.0 * (n1 + n2 - 2) - 1)) END AS g FROM e0),
e2 AS (SELECT *, abs(g) > 3 AND sqrt((v1 + v2) / 2) < 0.01 AS bad, CASE WHEN least(n1, n2) >= 2 THEN 2.0 / least(n1, n2) + g * g / (4 * least(n1, n2)) END AS var FROM e1)"""


_SHRUNK = {"skeptical": 0.25, "neutral": 1.0, "optimistic": 4.0}


@query(f"""WITH {_CLR}, {_effect_sql('cl', 'clr')} SELECT category, g1, g2, n1, n2, {', '.join(r6(c, c) for c in ('m1', 'm2', 'lo1', 'hi1', 'lo2', 'hi2'))}, {r6('g', 'hedges_g')}, bad AS g_pathological,
{', '.join(f"round(CASE WHEN NOT bad THEN g * {t} / ({t} + var) END, 6) AS g_shrunk_{k}" for k, t in _SHRUNK.items())}, ceil(2 * pow((1.959964 + 0.841621) / abs(g), 2)) AS n_required FROM e2""")
def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(effects.effect_sizes(subject_clr(spark, sf_dir), ["category"], "timepoint", "clr", effects.contrast_table(spark)))


@query(f"""WITH {_CLR}, {_effect_sql('cl', 'clr')}, r AS (SELECT *, row_number() OVER (PARTITION BY g1, g2 ORDER BY abs(round(g, 6)) DESC NULLS LAST, category) AS place FROM e2)
SELECT category, g1, g2, {r6('g', 'hedges_g')}, place FROM r WHERE place <= 5""")
def top_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rounded(effects.effect_sizes(subject_clr(spark, sf_dir), ["category"], "timepoint", "clr", effects.contrast_table(spark)))
    return effects.top_by_size(made.select("category", "g1", "g2", "hedges_g"), ["g1", "g2"], "hedges_g", ["category"], 5).withColumn("place", F.col("place").cast("bigint"))


_P = """l AS (SELECT category, timepoint, list(clr ORDER BY clr) AS v FROM cl GROUP BY ALL), u0 AS (SELECT a.category, g1, g2, a.v AS a, b.v AS b FROM con JOIN l a ON a.timepoint = g1 JOIN l b ON b.timepoint = g2 AND a.category = b.category),
u1 AS (SELECT category, g1, g2, len(a) AS n1, len(b) AS n2, list_sum(list_transform(a, lambda x: list_sum(list_transform(b, lambda y: CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0.0 END)))) AS u FROM u0),
tab AS (SELECT unnest([0, 1, 2, 3, 4]) AS ku, unnest([1, 1, 2, 1, 1]) AS ways),
p AS (SELECT category, g1, g2, n1, n2, u, sum(CASE WHEN abs(2 * ku - n1 * n2) >= abs(2 * u - n1 * n2) THEN ways ELSE 0 END) / sum(ways) AS p FROM u1, tab WHERE n1 = 2 AND n2 = 2 GROUP BY ALL)"""


@query(f"""WITH {_CLR}, {_PAIRS}, {_P}, r AS (SELECT *, row_number() OVER (ORDER BY round(p, 6), category, g1, g2) AS r, count(*) OVER () AS m FROM p),
q AS (SELECT *, least(min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q FROM r)
SELECT category, g1, g2, n1, n2, round(u, 6) AS u, round(p, 6) AS p, round(q, 6) AS q FROM q""")
def rank_sum_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = effects.rank_sums(subject_clr(spark, sf_dir), ["category"], "timepoint", "clr", effects.contrast_table(spark))
    one = rounded(tests).withColumn("_family", F.lit(1))
    return rounded(effects.adjusted(one, ["_family"], "p", ["category", "g1", "g2"]).drop("_family"))


@query(f"""WITH {_CLR}, {_PAIRS}, l AS (SELECT category, timepoint, list(clr ORDER BY clr) AS v FROM cl GROUP BY ALL), pk AS (SELECT a.i AS i, b.i AS j FROM range(1, 3) a(i), range(1, 3) b(i)),
d AS (SELECT a.category, g1, g2, a.v[p.i] AS a1, a.v[p.j] AS a2, b.v[q.i] AS b1, b.v[q.j] AS b2 FROM con JOIN l a ON a.timepoint = g1 JOIN l b ON b.timepoint = g2 AND b.category = a.category, pk p, pk q WHERE len(a.v) = 2 AND len(b.v) = 2),
g AS (SELECT *, ((a1 - a2) * (a1 - a2) / 2 + (b1 - b2) * (b1 - b2) / 2) / 2 AS s FROM d), h AS (SELECT category, g1, g2, CASE WHEN s > 1e-24 THEN ((b1 + b2) - (a1 + a2)) / 2 / sqrt(s) * (1 - 3 / 7.0) END AS g FROM g)
SELECT category, g1, g2, round(min(g), 6) AS g_min, round(max(g), 6) AS g_max, count(DISTINCT round(g, 6)) AS n_unique FROM h GROUP BY ALL""")
def resampled_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(effects.resampled_range(subject_clr(spark, sf_dir), ["category"], "timepoint", "clr", effects.contrast_table(spark)))


@query(f"""WITH {GATED_SQL}, c AS (SELECT roi, timepoint, mouse, count(*) AS n FROM labelled GROUP BY ALL), voc AS (SELECT unnest([{', '.join(f"'{g}'" for g in [*gating.GATES, 'unassigned'])}]) AS category),
k AS (SELECT roi, cell_type AS category, count(*) AS n FROM labelled GROUP BY ALL), f AS (SELECT c.roi, timepoint, mouse, voc.category, coalesce(k.n, 0) / c.n AS fraction FROM c CROSS JOIN voc LEFT JOIN k ON k.roi = c.roi AND k.category = voc.category),
mm AS (SELECT timepoint, mouse, category, avg(fraction) AS v FROM f GROUP BY ALL), g AS (SELECT category, timepoint, avg(v) AS m FROM mm GROUP BY ALL), {_PAIRS}
SELECT a.category, g1, g2, round((b.m + 1e-6) / (a.m + 1e-6), 6) AS fold_change, round(log2((b.m + 1e-6) / (a.m + 1e-6)), 6) AS log2_fc FROM con JOIN g a ON a.timepoint = g1 JOIN g b ON b.timepoint = g2 AND a.category = b.category""")
def abundance_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = composition.fractions(gated(spark, sf_dir), ["roi", "timepoint", "mouse"], "cell_type", [*gating.GATES, "unassigned"])
    mice = composition.to_subjects(fr, ["timepoint", "mouse", "category"])
    return rounded(effects.fold_changes(mice, ["category"], "timepoint", "fraction", effects.contrast_table(spark)))


@query(f"""WITH {SCORED_SQL}, th AS (SELECT unnest([0.2, 0.3, 0.4]) AS threshold), n AS (SELECT threshold, roi, timepoint, mouse, avg((lineage_immune > threshold)::INT) AS immune, avg((lineage_immune > threshold AND lineage_stromal > threshold)::INT) AS immune_stromal FROM scored, th GROUP BY ALL),
m AS (SELECT threshold, timepoint, mouse, avg(immune) AS immune, avg(immune_stromal) AS immune_stromal FROM n GROUP BY ALL)
SELECT threshold::DOUBLE AS threshold, timepoint, round(avg(immune), 6) AS immune, round(avg(immune_stromal), 6) AS immune_stromal FROM m GROUP BY ALL""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The thresholds are rows of one plan, not so many plans.
    df = scored(spark, sf_dir).withColumn("threshold", F.explode(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.4))))
    im, st = F.col("lineage_immune") > F.col("threshold"), F.col("lineage_stromal") > F.col("threshold")
    n = df.groupBy("threshold", "roi", "timepoint", "mouse").agg(F.avg(im.cast("double")).alias("immune"), F.avg((im & st).cast("double")).alias("immune_stromal"))
    m = n.groupBy("threshold", "timepoint", "mouse").agg(F.avg("immune").alias("immune"), F.avg("immune_stromal").alias("immune_stromal"))
    return rounded(m.groupBy("threshold", "timepoint").agg(F.avg("immune").alias("immune"), F.avg("immune_stromal").alias("immune_stromal")))


@query(f"""WITH {BASE_SQL}, pm AS (SELECT mouse, quantile_cont(cd45, 0.75) AS c45, quantile_cont(cd31, 0.75) AS c31, quantile_cont(cd140b, 0.75) AS c140, quantile_cont(cd44, 0.75) AS c44 FROM ex WHERE timepoint = 'Sham' GROUP BY mouse),
t AS (SELECT avg(c45) AS c45, avg(c31) AS c31, avg(c140) AS c140, avg(c44) AS c44 FROM pm),
r AS (SELECT roi, timepoint, mouse, avg((cd44 > c44)::INT) FILTER (cd45 > c45) AS cd45_rate, avg((cd44 > c44)::INT) FILTER (cd31 > c31) AS cd31_rate, avg((cd44 > c44)::INT) FILTER (cd140b > c140) AS cd140b_rate, avg((cd44 > c44)::INT) FILTER (NOT cd45 > c45 AND NOT cd31 > c31 AND NOT cd140b > c140) AS background_rate,
avg((cd45 > c45 AND cd31 > c31 AND cd140b > c140)::INT) AS triple_overlap, count(*) AS n FROM ex, t GROUP BY ALL)
SELECT timepoint, mouse, {', '.join(f'round(avg({c}), 6) AS {c}, count({c}) AS {c}_n_rois' for c in ('cd45_rate', 'cd31_rate', 'cd140b_rate', 'background_rate'))}, round(avg(triple_overlap), 6) AS triple_overlap, sum(n)::BIGINT AS n FROM r GROUP BY ALL""")
def compartment_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = units(spark, sf_dir)
    ms = ["cd45", "cd31", "cd140b", "cd44"]
    cut = df.filter("timepoint = 'Sham'").groupBy("mouse").agg(*(F.percentile(m, F.lit(0.75)).alias(m) for m in ms)).agg(*(F.avg(m).alias(f"t_{m}") for m in ms))
    above = {m: F.col(m) > F.col(f"t_{m}") for m in ms}
    rate = lambda inside: F.avg(F.when(inside, above["cd44"].cast("double")))
    any_ = above["cd45"] | above["cd31"] | above["cd140b"]
    per = df.join(F.broadcast(cut)).groupBy("roi", "timepoint", "mouse").agg(*(rate(above[m]).alias(f"{m}_rate") for m in ms[:3]), rate(~any_).alias("background_rate"), F.avg((above["cd45"] & above["cd31"] & above["cd140b"]).cast("double")).alias("triple_overlap"), F.count(F.lit(1)).alias("n"))
    rates = [*(f"{m}_rate" for m in ms[:3]), "background_rate"]
    out = per.groupBy("timepoint", "mouse").agg(*(f for c in rates for f in (F.avg(c).alias(c), F.count(c).alias(f"{c}_n_rois"))), F.avg("triple_overlap").alias("triple_overlap"), F.sum("n").alias("n"))
    return rounded(out)


@query(f"""WITH {BASE_SQL}, long AS ({LONG_SQL}), md AS (SELECT marker, roi, quantile_cont(value, 0.5) AS m FROM long GROUP BY ALL), cv AS (SELECT marker, count(*) AS n_batches, stddev_pop(m) / nullif(avg(m), 0) AS cv FROM md GROUP BY marker),
rk AS (SELECT marker, roi, rank() OVER (PARTITION BY marker ORDER BY value) + (count(*) OVER (PARTITION BY marker, value) - 1) / 2.0 AS r FROM long), s AS (SELECT marker, roi, sum(r) AS s, count(*) AS c FROM rk GROUP BY ALL),
tie AS (SELECT marker, sum(t) AS n, sum(t::DOUBLE * t * t - t) AS tie FROM (SELECT marker, value, count(*) AS t FROM long GROUP BY ALL) GROUP BY marker), q AS (SELECT marker, sum(s * s / c) AS q FROM s GROUP BY marker)
SELECT marker, n_batches, round(cv, 6) AS cv, round((12 / (n::DOUBLE * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n::DOUBLE * n * n - n)), 6) AS kruskal_h FROM cv JOIN q USING (marker) JOIN tie USING (marker)""")
def batch_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = thresholds.unpivoted(units(spark, sf_dir), ["roi"], MARKERS)
    return rounded(batches.batch_effects(long, "roi", "marker", "value"))


@query(f"""WITH {BASE_SQL}, long AS ({LONG_SQL}), s AS (SELECT marker, avg(value) FILTER (timepoint = 'Sham') AS m, stddev_samp(value) FILTER (timepoint = 'Sham') AS sd FROM long GROUP BY marker)
SELECT marker, timepoint, round(avg((value - m) / sd), 6) AS mean_z, round(stddev_samp((value - m) / sd), 6) AS sd_z, count(*) AS n FROM long JOIN s USING (marker) GROUP BY ALL""")
def control_anchored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = thresholds.unpivoted(units(spark, sf_dir), ["timepoint"], MARKERS)
    z = batches.control_anchored(long, F.col("timepoint") == "Sham", "marker", "value")
    return rounded(z.groupBy("marker", "timepoint").agg(F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("sd_z"), F.count(F.lit(1)).alias("n")))


_BEADS = "beads AS (SELECT user_id % 8 AS batch, event_type AS bead, value + 1 AS value, event_id AS ord FROM events)"


def _beads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 8).alias("batch"), F.col("event_type").alias("bead"), (F.col("value") + 1).alias("value"), F.col("event_id").alias("ord"))


@query(f"""WITH {_BEADS}, m AS (SELECT batch, bead, quantile_cont(value, 0.5) AS m FROM beads GROUP BY ALL HAVING quantile_cont(value, 0.5) >= 1), r AS (SELECT bead, quantile_cont(m, 0.5) AS ref FROM m GROUP BY bead),
f AS (SELECT batch, greatest(least(ref / (m + 1e-10), 10), 0.1) AS f FROM m JOIN r USING (bead)) SELECT batch, round(coalesce(quantile_cont(f, 0.5) FILTER (abs(f - 1) > 1e-9), 1), 6) AS factor, count(*) AS n_beads FROM f GROUP BY batch""")
def bead_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(batches.bead_factors(_beads(spark, sf_dir), "batch", "bead", "value", "ord"))


@query(f"""WITH {_BEADS}, m AS (SELECT batch, bead, quantile_cont(value, 0.5) AS m, min(ord) AS o FROM beads GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY bead ORDER BY o, batch) AS i FROM m)
SELECT bead, round(regr_slope(m, i), 6) AS slope, round(stddev_pop(m) / avg(m), 6) AS cv, round(max(m) - min(m), 6) AS "range" FROM p GROUP BY bead""")
def instrument_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(batches.drift(_beads(spark, sf_dir), "batch", "bead", "value", "ord"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", (F.col("user_id") % 8).alias("batch"), "value", "ts")


_LIMITS = "lim AS (SELECT event_type, count(value) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY event_type HAVING count(value) >= 10)"


@query(f"""WITH {_LIMITS} SELECT event_type, user_id % 8 AS batch, CASE WHEN value < m - 3 * sd OR value > m + 3 * sd THEN 'out_of_control' WHEN value < m - 2 * sd OR value > m + 2 * sd THEN 'warning' ELSE 'in_control' END AS status, count(*) AS n FROM events JOIN lim USING (event_type) GROUP BY ALL""")
def control_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    return quality.evaluated(h, quality.control_limits(h, ["event_type"], "value").drop("n", "mean"), ["event_type"], "value").groupBy("event_type", "batch", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT *, count(value) OVER w AS n, sum(i) OVER w AS sx, sum(value) OVER w AS sy, sum(i * value) OVER w AS sxy, sum(i * i) OVER w AS sxx FROM p WINDOW w AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
l AS (SELECT *, CASE WHEN n = 10 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS slope FROM s)
SELECT event_type, event_id, round(slope, 5) AS slope, CASE WHEN slope > 0.01 THEN 'improving' WHEN slope < -0.01 THEN 'declining' WHEN slope IS NOT NULL THEN 'stable' END AS trend FROM l""")
def quality_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.trends(_history(spark, sf_dir), ["event_type"], "ts", "value", tie=["event_id"]).select("event_type", "event_id", "slope", "trend"), 5)


@query("""WITH z AS (SELECT event_id, event_type, value, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM events WINDOW w AS (PARTITION BY event_type))
SELECT event_id, event_type, round(value, 6) AS value, round(z, 6) AS z FROM z WHERE abs(z) > 2.5""")
def quality_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.anomalies(_history(spark, sf_dir).select("event_id", "event_type", "value"), ["event_type"], "value"))


@query("""WITH b AS (SELECT user_id % 8 AS batch, count(*) AS n, avg(value) AS mean, stddev_pop(value) / avg(value) AS cv FROM events GROUP BY ALL)
SELECT batch, n, round(mean, 6) AS mean, round(cv, 6) AS cv, CASE WHEN cv < 0.1 THEN 'excellent' WHEN cv < 0.2 THEN 'good' WHEN cv < 0.3 THEN 'acceptable' ELSE 'poor' END AS consistency, CASE WHEN cv > 0.3 OR n < 3 OR mean < 20 THEN 'WARN' ELSE 'PASS' END AS decision FROM b""")
def batch_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = quality.batch_consistency(_history(spark, sf_dir), "batch", "value")
    return rounded(b.withColumn("decision", F.when((F.col("cv") > 0.3) | (F.col("n") < 3) | (F.col("mean") < 20), "WARN").otherwise("PASS")))


@query(f"""WITH {PAIRED_SQL}, r AS (SELECT roi, a, b, va, vb, rank() OVER (PARTITION BY roi, a, b ORDER BY va) + (count(*) OVER (PARTITION BY roi, a, b, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY roi, a, b ORDER BY vb) + (count(*) OVER (PARTITION BY roi, a, b, vb) - 1) / 2.0 AS rb FROM pm)
SELECT roi, a, b, count(*) AS n, round(corr(va, vb), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY roi, a, b""")
def marker_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.all_correlations(units(spark, sf_dir), ["roi"], MARKERS))


@query(f"""WITH {PAIRED_SQL}, s AS (SELECT roi, a, b, avg(vb) FILTER (va > 2) AS mi, avg(vb) FILTER (NOT va > 2) AS mo, stddev_pop(vb) FILTER (va > 2) AS si, stddev_pop(vb) FILTER (NOT va > 2) AS so, count(vb) FILTER (va > 2) AS ni, count(vb) FILTER (NOT va > 2) AS no_ FROM pm GROUP BY ALL)
SELECT roi, a, b, {r6('mi', 'mean_in')}, {r6('mo', 'mean_out')}, {r6('si', 'sd_in')}, {r6('so', 'sd_out')}, ni AS n_in, no_ AS n_out, round(CASE WHEN si * si + so * so > 0 THEN (mi - mo) / sqrt((si * si + so * so) / 2) ELSE 0 END, 6) AS d FROM s""")
def region_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each marker inside and outside of where another is high."""
    return rounded(statistics.region_difference(paired(units(spark, sf_dir)), ["roi", "a", "b"], F.col("va") > 2, "vb"))


@query(f"""WITH {BASE_SQL}, lo AS ({LONG_SQL}), b AS (SELECT roi, marker, value AS v, min(value) OVER (PARTITION BY roi, marker) AS lo, max(value) OVER (PARTITION BY roi, marker) AS hi FROM lo), h AS (SELECT roi, marker, least(floor((v - lo) / (hi - lo) * 256), 255) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM b GROUP BY ALL),
c AS (SELECT *, sum(n) OVER u AS w0, sum(n * (bin + 0.5)) OVER u AS s0, sum(n) OVER p AS wt, sum(n * (bin + 0.5)) OVER p AS st FROM h WINDOW u AS (PARTITION BY roi, marker ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY roi, marker)),
k AS (SELECT *, CASE WHEN wt - w0 > 0 THEN round(w0::DOUBLE * (wt - w0) * pow(s0 / w0 - (st - s0) / (wt - w0), 2), 3) END AS b FROM c), m AS (SELECT *, row_number() OVER (PARTITION BY roi, marker ORDER BY b DESC, bin) AS r FROM k WHERE b IS NOT NULL)
SELECT roi, marker, round(lo + (bin + 0.5) * (hi - lo) / 256, 6) AS threshold FROM m WHERE r = 1""")
def otsu_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.otsu(thresholds.unpivoted(units(spark, sf_dir), ["roi"], MARKERS), ["roi", "marker"], "value"))


@query(f"""WITH {BASE_SQL}, long AS ({LONG_SQL}), v AS (SELECT marker, value, count(*) FILTER (mouse = 'MS1') AS a, count(*) FILTER (mouse <> 'MS1') AS b FROM long GROUP BY ALL),
g AS (SELECT marker, abs(sum(a) OVER u / sum(a) OVER p - sum(b) OVER u / sum(b) OVER p) AS gap FROM v WINDOW u AS (PARTITION BY marker ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY marker)) SELECT marker, round(max(gap), 6) AS ks FROM g GROUP BY marker""")
def distribution_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.ks_distance(thresholds.unpivoted(units(spark, sf_dir), ["mouse"], MARKERS), ["marker"], "mouse", "value", "MS1"))


@query(f"""WITH {GATED_SQL}, i AS (SELECT roi, cell_type AS a, floor(y / 100)::BIGINT * 5 + floor(x / 100)::BIGINT AS b FROM labelled), c AS (SELECT roi, a, b, count(*)::DOUBLE AS n FROM i GROUP BY ALL), ra AS (SELECT roi, a, sum(n) AS n FROM c GROUP BY ALL), cb AS (SELECT roi, b, sum(n) AS n FROM c GROUP BY ALL), tot AS (SELECT roi, sum(n) AS t FROM c GROUP BY roi),
x AS (SELECT roi, sum(n * (n - 1) / 2) AS ij FROM c GROUP BY roi), y AS (SELECT roi, sum(n * (n - 1) / 2) AS i, -sum(n / t * ln(n / t)) AS ha FROM ra JOIN tot USING (roi) GROUP BY roi), z AS (SELECT roi, sum(n * (n - 1) / 2) AS j, -sum(n / t * ln(n / t)) AS hb FROM cb JOIN tot USING (roi) GROUP BY roi),
mi AS (SELECT c.roi, sum(c.n / t * ln(c.n * t / (ra.n * cb.n))) AS mi FROM c JOIN ra ON c.roi = ra.roi AND c.a = ra.a JOIN cb ON c.roi = cb.roi AND c.b = cb.b JOIN tot ON c.roi = tot.roi GROUP BY c.roi)
SELECT roi, t::BIGINT AS n, round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi FROM tot JOIN x USING (roi) JOIN y USING (roi) JOIN z USING (roi) JOIN mi USING (roi)""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = (F.floor(F.col("y") / 100) * 5 + F.floor(F.col("x") / 100)).alias("square")
    return rounded(statistics.label_agreement(gated(spark, sf_dir).select("roi", "cell_type", square), ["roi"], "cell_type", "square"))


@query(f"""WITH {GATED_SQL} SELECT cell_type, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in MARKERS)} FROM labelled GROUP BY cell_type""")
def label_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.centroids(gated(spark, sf_dir), "cell_type", MARKERS))


@query(f"""WITH {GATED_SQL}, c AS (SELECT cell_type, {', '.join(f'avg({m}) AS {m}, var_pop({m}) AS v_{m}' for m in MARKERS)} FROM labelled GROUP BY cell_type), b AS (SELECT avg(sqrt({' + '.join(f'pow(a.{m} - b.{m}, 2)' for m in MARKERS)})) AS b FROM c a JOIN c b ON a.cell_type < b.cell_type)
SELECT round(b / ((SELECT avg(({' + '.join(f'v_{m}' for m in MARKERS)}) / 9) FROM c) + 1e-10), 6) AS separability FROM b""")
def label_separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.separability(gated(spark, sf_dir), "cell_type", MARKERS))


@query(f"""WITH {PAIRED_SQL}, s AS (SELECT roi, a, b, count(*) AS n, count(*) FILTER (va > 2) AS na, count(*) FILTER (vb > 2) AS nb, count(*) FILTER (va > 2 AND vb > 2) AS nab, avg(va) FILTER (va > 2) AS ma, max(va) AS xa FROM pm GROUP BY ALL)
SELECT roi, a, b, n, na AS n_a, nb AS n_b, nab AS n_ab, round(ma, 6) AS mean_a, round(xa, 6) AS max_a, round(coalesce(nab / nullif(n, 0), 0), 6) AS overlap, round(coalesce(nab / nullif(na + nb - nab, 0), 0), 6) AS jaccard, round(coalesce(nab / nullif(na, 0), 0), 6) AS b_given_a, round(coalesce(nab / nullif(nb, 0), 0), 6) AS a_given_b FROM s""")
def positive_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.threshold_features(paired(units(spark, sf_dir)), ["roi", "a", "b"], "va", "vb", 2.0, 2.0))


@query(f"WITH {PAIRED_SQL} SELECT roi, a, b, round(regr_slope(vb, va), 6) AS slope, round(regr_intercept(vb, va), 6) AS intercept, round(corr(vb, va), 6) AS r, count(*) AS n FROM pm GROUP BY roi, a, b")
def marker_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.regression(paired(units(spark, sf_dir)), ["roi", "a", "b"], "vb", "va"))


@query(f"""WITH {BASE_SQL}, long AS ({LONG_SQL}) SELECT marker, timepoint, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) AS n FROM long GROUP BY ALL""")
def timepoint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = thresholds.unpivoted(units(spark, sf_dir), ["timepoint"], MARKERS)
    return rounded(long.groupBy("marker", "timepoint").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n")))


_STATEMENTS = "st AS (SELECT s_nationkey AS source, (s_suppkey * 7) % 25 AS target, CASE WHEN s_suppkey % 3 = 0 THEN 'activates' WHEN s_suppkey % 3 = 1 THEN 'inhibits' ELSE 'binds' END AS type, s_suppkey % 13 AS evidence, (s_suppkey % 10) / 10.0 AS belief FROM supplier)"


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "activates").when(k % 3 == 1, "inhibits").otherwise("binds")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("source"), (k * 7 % 25).alias("target"), kind.alias("type"), (k % 13).alias("evidence"), (k % 10 / 10.0).alias("belief"))


_PAIRSUM = f"{_STATEMENTS}, ps AS (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(evidence)::BIGINT AS evidence, max(belief) AS belief, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM st GROUP BY ALL)"


@query(f"""WITH {_PAIRSUM} SELECT a, b, evidence, round(belief, 6) AS belief, types, CASE WHEN evidence >= 100 THEN 'high' WHEN evidence >= 10 OR (evidence >= 5 AND belief >= 0.7) THEN 'medium' WHEN evidence >= 1 THEN 'low' ELSE 'none' END AS tier FROM ps""")
def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = knowledge.pair_summary(_statements(spark, sf_dir))
    return rounded(s.withColumn("tier", knowledge.tier(F.col("evidence"), F.col("belief"))))


@query(f"""WITH {_PAIRSUM}, q AS (SELECT r.r_regionkey AS focal, s.r_regionkey AS neighbour, n.n_nationkey AS x, m.n_nationkey AS y FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey, region s JOIN nation m ON m.n_regionkey = s.r_regionkey),
d AS (SELECT DISTINCT focal, neighbour, least(x, y) AS a, greatest(x, y) AS b FROM q WHERE x <> y), f AS (SELECT focal, neighbour, coalesce(max(evidence), 0) AS evidence, coalesce(max(belief), 0) AS belief, count(evidence) AS n_pairs_known FROM d LEFT JOIN ps USING (a, b) GROUP BY ALL)
SELECT focal, neighbour, evidence, round(belief, 6) AS belief, n_pairs_known, CASE WHEN evidence >= 100 THEN 'high' WHEN evidence >= 10 OR (evidence >= 5 AND belief >= 0.7) THEN 'medium' WHEN evidence >= 1 THEN 'low' ELSE 'none' END AS tier FROM f""")
def neighbourhood_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("members"))
    one = nation.select(F.col("n_regionkey").alias("focal"), F.col("members").alias("a_members"), F.lit(1).alias("_"))
    two = nation.select(F.col("n_regionkey").alias("neighbour"), F.col("members").alias("b_members"), F.lit(1).alias("_"))
    return rounded(knowledge.best_evidence(one.join(two, "_"), ["focal", "neighbour"], "a_members", "b_members", knowledge.pair_summary(_statements(spark, sf_dir))))


_KEY_TEXT = {"region": "r_regionkey || '|' || r_name", "nation": "n_nationkey || '|' || n_name || '|' || n_regionkey", "supplier": "s_suppkey || '|' || s_name || '|' || s_nationkey", "part": "p_partkey || '|' || p_name"}


@query(f"""WITH f AS ({' UNION ALL '.join(f"SELECT '{t}' AS n, sha256(string_agg(sha256({e}), '' ORDER BY sha256({e}))) AS d FROM {t}" for t, e in _KEY_TEXT.items())}) SELECT sha256(string_agg(n || ':' || d, '|' ORDER BY n || ':' || d)) AS sha256 FROM f""")
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of the contents of the dimension tables: of each its rows' digests in order, of all the tables' digests."""
    out = None
    for t, text in _KEY_TEXT.items():
        one = knowledge.table_digest(spark.read.parquet(f"{sf_dir}/{t}.parquet"), F.expr(text)).select(F.lit(t).alias("name"), "digest")
        out = one if out is None else out.unionByName(one)
    return knowledge.fingerprint(out, "name", "digest")


@query("""WITH o AS (SELECT p_partkey, p_name AS h FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || '*' ELSE p_name END AS h FROM part WHERE p_partkey % 4 <> 0)
SELECT p_partkey, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (p_partkey) WHERE o.h IS NULL OR n.h IS NULL OR o.h <> n.h""")
def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    old = part.filter("p_partkey % 3 <> 0").select("p_partkey", F.col("p_name").alias("h"))
    new = part.filter("p_partkey % 4 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("*"))).otherwise(F.col("p_name")).alias("h"))
    return knowledge.manifest_diff(old, new, "p_partkey", "h")
