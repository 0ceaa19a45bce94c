"""Plans that judge data: scores of regions, gates, validators of each step, rasters of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.folders import new_path, staged
from quadrille.operators import neighbours, quality, raster, thresholds, validation
from quadrille.plans.common import query, r6, rounded, units
from quadrille.plans.space import knn, knn_sql
from quadrille.plans.units import GATED_SQL, gated
from quadrille.sources import virtual
from quadrille.sources.virtual import BASE_SQL, DNA, MARKERS

M = ", ".join(MARKERS)
_CHANNEL = " + ".join(f"(0.5 * avg(({m} > 0)::INT) + 0.5 * least(1.0, CASE WHEN stddev_pop({m}) > 0 THEN avg({m}) / (stddev_pop({m}) + 1e-10) ELSE 0 END / 2))" for m in MARKERS)
_SCORES = f"""{virtual.pixel_sql()}, s0 AS (SELECT roi, count(*) AS n_pixels, ({' + '.join(f'(max({m}) > 0)::INT' for m in MARKERS)}) AS n_proteins, CASE WHEN max(x) - min(x) > 10 AND max(y) - min(y) > 10 THEN 1.0 ELSE 0.5 END AS coordinate_quality, ({_CHANNEL}) / 9 AS ion_count_quality, least(1.0, avg(dna1) / 50) AS d FROM px GROUP BY roi),
s1 AS (SELECT *, least(n_proteins / 10.0, 1.0) AS protein_completeness, 0.6 * least(n_proteins / 10.0, 1.0) + 0.4 * d AS biological_quality FROM s0), scores AS (SELECT *, (coordinate_quality + ion_count_quality + biological_quality) / 3 AS overall_quality FROM s1)"""
_METRICS = ["coordinate_quality", "ion_count_quality", "biological_quality", "overall_quality", "protein_completeness"]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.region_scores(virtual.pixels(spark, sf_dir), ["roi"], MARKERS, [*MARKERS, "cd68"], "dna1")


@query(f"""WITH {_SCORES} SELECT roi, n_pixels, n_proteins, {', '.join(r6(m, m) for m in _METRICS)}, round(CASE WHEN roi % 2 = 0 THEN (coordinate_quality + ion_count_quality + biological_quality + 0.5 * 0.7) / 4 ELSE overall_quality END, 6) AS overall_with_segments FROM scores""")
def region_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir).withColumn("segmentation_quality", F.when(F.col("roi") % 2 == 0, 0.7))
    return rounded(s.withColumn("overall_with_segments", validation.overall(_METRICS[:3], ["segmentation_quality"])).drop("segmentation_quality"))


_GATED = f"""{_SCORES}, g0 AS (SELECT *, (overall_quality < 0.5)::INT + (n_pixels < 1000)::INT + (n_proteins < 3)::INT + (protein_completeness < 0.5)::INT AS n_issues, (coordinate_quality < 0.3)::INT + (ion_count_quality < 0.4)::INT + (biological_quality < 0.3)::INT AS n_warnings FROM scores),
g AS (SELECT *, CASE WHEN n_issues > 0 THEN 'FAIL' WHEN n_warnings > 0 THEN 'WARN' ELSE 'PASS' END AS decision FROM g0)"""


@query(f"WITH {_GATED} SELECT roi, n_issues, n_warnings, decision FROM g")
def region_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.region_gate(_scores(spark, sf_dir)).select("roi", "n_issues", "n_warnings", "decision")


@query(f"WITH {_GATED} SELECT decision, count(*) AS n, round(count(*) / (SELECT count(*) FROM g), 6) AS share FROM g GROUP BY decision")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.decision_summary(staged(validation.region_gate(_scores(spark, sf_dir)).select("decision"), "decisions")))


_LIM = f"""{_SCORES}, l AS (SELECT roi, metric, value FROM (UNPIVOT scores ON {', '.join(_METRICS)} INTO NAME metric VALUE value)), lm AS (SELECT metric, avg(value) AS m, stddev_pop(value) AS sd FROM l GROUP BY metric HAVING count(value) >= 10)"""


@query(f"""WITH {_LIM} SELECT roi, metric, round(value, 6) AS value, CASE WHEN value < greatest(0, least(1, m - 3 * sd)) THEN 'out_of_control' WHEN value < greatest(0, least(1, m - 2 * sd)) THEN 'warning' ELSE 'in_control' END AS status FROM l JOIN lm USING (metric)""")
def metric_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = staged(_scores(spark, sf_dir).select("roi", *_METRICS), "scores")
    return rounded(validation.statuses(s, validation.limits_of(s, _METRICS), "roi", _METRICS))


_HIST = "h AS (SELECT event_id, event_type, user_id % 8 AS batch, value / 100 AS q, ts FROM events)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", (F.col("user_id") % 8).alias("batch"), (F.col("value") / 100).alias("q"), "ts")


_TREND = """p AS (SELECT {k}, q, row_number() OVER (PARTITION BY {k} ORDER BY ts DESC, event_id DESC) AS r FROM h), t0 AS (SELECT {k}, count(*) AS n, regr_slope(q, -r) AS slope, avg(q) AS m FROM p WHERE r <= 5 GROUP BY {k}),
t AS (SELECT {k}, CASE WHEN n = 5 THEN slope END AS slope, CASE WHEN n = 5 THEN m END AS recent_mean, CASE WHEN n = 5 AND (slope < -0.05 OR m < 0.4) THEN 'ABORT' WHEN n = 5 AND slope < -0.01 THEN 'WARN' ELSE 'PASS' END AS trend_decision FROM t0)"""


@query(f"WITH {_HIST}, {_TREND.format(k='event_type')} SELECT event_type, {r6('slope', 'slope')}, {r6('recent_mean', 'recent_mean')}, trend_decision FROM t")
def trend_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.trend_gate(_history(spark, sf_dir), ["event_type"], ["ts", "event_id"], "q"))


@query(f"""WITH {_HIST}, {_TREND.format(k='batch')}, b AS (SELECT batch, CASE WHEN count(q) >= 2 AND (stddev_pop(q) / avg(q) > 0.3 OR avg(q) < 0.5) THEN 'WARN' ELSE 'PASS' END AS batch_decision FROM h GROUP BY batch),
c AS (SELECT batch, arg_max(q, (ts, event_id)) AS quality FROM h GROUP BY batch) SELECT batch, round(quality, 6) AS quality, CASE WHEN quality < 0.5 THEN 'FAIL' ELSE 'PASS' END AS decision, batch_decision, trend_decision, trend_decision <> 'ABORT' AS should_continue, quality < 0.5 AS skip_current FROM c JOIN b USING (batch) JOIN t USING (batch)""")
def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    current = h.groupBy("batch").agg(F.max(F.struct("ts", "event_id", "q"))["q"].alias("quality")).withColumn("decision", F.when(F.col("quality") < validation.LEAST["overall_quality"], "FAIL").otherwise("PASS"))
    return rounded(validation.continuation(current, validation.batch_gate(h, "batch", "q"), validation.trend_gate(h, ["batch"], ["ts", "event_id"], "q"), "batch"))


@query(f"WITH {_HIST} SELECT batch, count(*) AS n, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS sd, round(min(q), 6) AS low, round(max(q), 6) AS high, round(arg_max(q, (ts, event_id)), 6) AS last, count(DISTINCT event_type) AS n_types FROM h GROUP BY batch")
def quality_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History kept as files: two runs append, a third reads it all."""
    path = new_path(spark, "history")
    h = _history(spark, sf_dir)
    for run in (0, 1):
        h.filter(F.col("event_id") % 2 == run).write.mode("append").partitionBy("batch").parquet(path)
    kept = spark.read.parquet(path)
    out = kept.groupBy(F.col("batch").cast("bigint").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean"), F.stddev_pop("q").alias("sd"), F.min("q").alias("low"), F.max("q").alias("high"), F.max(F.struct("ts", "event_id", "q"))["q"].alias("last"), F.count_distinct("event_type").alias("n_types"))
    return rounded(out)


_PAIRED = f"""{virtual.pixel_sql()}, {virtual.superpixel_sql()}, {virtual.expression_sql()}, b AS (SELECT roi, spx, marker, value FROM (UNPIVOT spx ON {M}, dna1, dna2 INTO NAME marker VALUE value)), a AS (SELECT roi, spx, marker, value FROM (UNPIVOT ex ON {M} INTO NAME marker VALUE value)),
pr AS (SELECT roi, spx, marker, b.value AS before, a.value AS after FROM b JOIN a USING (roi, spx, marker))"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(roi, spx, marker, before, after): raw and stabilised values."""
    df = virtual.superpixels(spark, sf_dir)
    pair = F.explode(F.array(*(F.struct(F.lit(m).alias("marker"), F.col(m).alias("before"), virtual.stabilised(F.col(m), 5.0).alias("after")) for m in MARKERS)))
    return df.select("roi", "spx", pair.alias("p")).select("roi", "spx", "p.*")


@query(f"""WITH {_PAIRED}, l AS (SELECT *, (after < lag(after) OVER (PARTITION BY roi, marker ORDER BY before, after))::INT AS fell FROM pr)
SELECT roi, marker, round(CASE WHEN max(before) > min(before) THEN (max(after) - min(after)) / (max(before) - min(before)) ELSE 0 END, 6) AS range_compression, round(1 - coalesce(sum(fell), 0) / count(*), 6) AS monotonicity,
round(CASE WHEN count(*) FILTER (before = 0) > 0 THEN count(*) FILTER (abs(after) < 1e-10) / count(*) FILTER (before = 0) END, 6) AS zero_preservation, round(avg(isfinite(after)::INT), 6) AS finite_share FROM l GROUP BY ALL""")
def transformation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.transformation_checks(_paired(spark, sf_dir), ["roi", "marker"], "before", "after"))


@query(f"WITH {_PAIRED}, s AS (SELECT DISTINCT marker FROM b), t AS (SELECT DISTINCT marker FROM a) SELECT coalesce(s.marker, t.marker) AS marker, CASE WHEN t.marker IS NULL THEN 'lost' WHEN s.marker IS NULL THEN 'extra' ELSE 'kept' END AS state FROM s FULL JOIN t ON s.marker = t.marker")
def marker_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = thresholds.unpivoted(virtual.superpixels(spark, sf_dir), ["roi"], MARKERS + DNA)
    return validation.marker_names(raw, thresholds.unpivoted(units(spark, sf_dir), ["roi"], MARKERS), "marker")


_PRE = f"""{_PAIRED}, m AS (SELECT roi, marker, count(after) / count(*) AS completeness, CASE WHEN stddev_pop(before) > 0 AND stddev_pop(after) > 0 THEN greatest(0, corr(before, after)) ELSE 0 END AS signal_preservation, avg(after) FILTER (after > 0) AS pm, count(*) FILTER (after > 0) AS np FROM pr GROUP BY ALL),
k AS (SELECT roi, marker, avg(pow(after - pm, 2)) AS m2, avg(pow(after - pm, 3)) AS m3, avg(pow(after - pm, 4)) AS m4 FROM pr JOIN m USING (roi, marker) WHERE after > 0 GROUP BY ALL),
q AS (SELECT m.*, CASE WHEN np >= 10 THEN (greatest(0, 1 - abs(m3 / pow(m2, 1.5) - 1) / 3) + greatest(0, 1 - abs(m4 / (m2 * m2) - 3) / 5)) / 2 ELSE 0.5 END AS background_quality FROM m LEFT JOIN k USING (roi, marker)), pre AS (SELECT *, (completeness + signal_preservation + background_quality) / 3 AS quality FROM q)"""


@query(f"WITH {_PRE} SELECT roi, marker, {', '.join(r6(c, c) for c in ('completeness', 'signal_preservation', 'background_quality', 'quality'))}, CASE WHEN quality < 0.15 THEN 'critical' WHEN quality < 0.35 THEN 'warning' ELSE 'pass' END AS severity FROM pre")
def preprocessing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.preprocessing_checks(_paired(spark, sf_dir), ["roi", "marker"], "before", "after"))


_GAP = lambda a, b: "sqrt(" + " + ".join(f"pow({a}.{m} - {b}.{m}, 2)" for m in MARKERS) + ")"


@query(f"""WITH {GATED_SQL}, c AS (SELECT roi, cell_type, count(*) AS n, {', '.join(f'avg({m}) AS {m}' for m in MARKERS)} FROM labelled GROUP BY ALL), b AS (SELECT a.roi, avg({_GAP('a', 'b')}) AS v FROM c a JOIN c b ON a.roi = b.roi AND a.cell_type < b.cell_type GROUP BY a.roi),
w AS (SELECT l.roi, avg({_GAP('l', 'c')}) AS v FROM labelled l JOIN c ON l.roi = c.roi AND l.cell_type = c.cell_type WHERE c.n > 1 GROUP BY l.roi), s AS (SELECT roi, count(*) AS k, 1 / (1 + stddev_pop(n) / avg(n)) AS bal, avg(CASE WHEN {' + '.join(MARKERS)} > 0 THEN greatest({M}) / ({' + '.join(MARKERS)}) END) AS sp FROM c GROUP BY roi)
SELECT s.roi, k AS n_clusters, round(bal, 6) AS size_balance, round(sp, 6) AS specificity, round(CASE WHEN k < 2 THEN 1.0 WHEN w.v > 0 THEN least(1.0, b.v / w.v / 2) ELSE 0.5 END, 6) AS separation FROM s LEFT JOIN b ON s.roi = b.roi LEFT JOIN w ON s.roi = w.roi""")
def cluster_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = staged(gated(spark, sf_dir).select("roi", "cell_type", *MARKERS), "labelled")
    return rounded(validation.cluster_checks(df, ["roi"], "cell_type", MARKERS))


def _signature_sql(high: list[str], low: list[str]) -> str:
    up = " + ".join(f"greatest(0, c.{m} / g.{m} - 1)" for m in high)
    down = " + ".join(f"greatest(0, 1 - c.{m} / g.{m})" for m in low)
    return f"round((({up}) / {len(high)} + ({down}) / {len(low)}) / 2, 9)"


@query(f"""WITH {GATED_SQL}, g AS (SELECT roi, {', '.join(f'avg({m}) AS {m}' for m in MARKERS)} FROM labelled GROUP BY roi), c AS (SELECT roi, cell_type, {', '.join(f'avg({m}) AS {m}' for m in MARKERS)} FROM labelled GROUP BY ALL HAVING count(*) >= 5),
s AS ({' UNION ALL '.join(f"SELECT c.roi, '{n}' AS signature, {_signature_sql(*hl)} AS score FROM c JOIN g USING (roi)" for n, hl in validation.SIGNATURES.items())})
SELECT roi, signature, round(max(score), 6) AS quality, count(*) FILTER (score > 0.3) AS n_with FROM s GROUP BY ALL""")
def signature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.signature_scores(gated(spark, sf_dir).select("roi", "cell_type", *MARKERS), ["roi"], "cell_type", MARKERS))


@query(f"""WITH {BASE_SQL}, m AS (SELECT timepoint, {', '.join(f'avg({m}) AS {m}' for m in MARKERS)} FROM ex GROUP BY timepoint), b AS (SELECT * FROM m WHERE timepoint = 'Sham'),
r AS ({' UNION ALL '.join(f"SELECT m.timepoint, ({' + '.join(f'(m.{x} / b.{x} > 1.2)::INT' for x in up)}) AS n_risen, ({' + '.join(f'(m.{x} / b.{x} < 0.8)::INT' for x in down) or '0'}) AS n_fallen, {len(up)} AS u, {max(1, len(down))} AS d FROM m, b WHERE m.timepoint = '{t}'" for t, (up, down) in validation.RESPONSES.items())})
SELECT timepoint, n_risen, n_fallen, round((n_risen / u + n_fallen / d) / 2, 6) AS quality FROM r""")
def injury_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.response_scores(units(spark, sf_dir), "timepoint", "Sham", MARKERS))


_NOISY = " + ".join(f"coalesce((quantile_cont({m}, 0.05) > 0 AND quantile_cont({m}, 0.95) / nullif(quantile_cont({m}, 0.05), 0) < 1.5)::INT, 0) + (avg(({m} = 0)::INT) > 0.9)::INT" for m in MARKERS)
_PRACTICAL = f"""{virtual.pixel_sql()}, pc0 AS (SELECT roi, count(*) AS n_cells, (max(x) = min(x) OR max(y) = min(y))::INT AS n_critical, {_NOISY} + (avg(dna1) < 5)::INT + (avg(dna2) < 5)::INT + (corr(dna1, dna2) < 0.6)::INT + (count(*) < 100)::INT AS n FROM px GROUP BY roi),
pc AS (SELECT roi, n_cells, n_critical, n + n_critical AS n_issues, CASE WHEN n_critical > 0 THEN 'FAIL' WHEN n + n_critical > 5 THEN 'POOR' WHEN n + n_critical > 2 THEN 'FAIR' WHEN n + n_critical > 0 THEN 'GOOD' ELSE 'EXCELLENT' END AS status FROM pc0)"""


@query(f"WITH {_PRACTICAL} SELECT roi, n_cells, n_critical, n_issues, status FROM pc")
def practical_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.practical_checks(virtual.pixels(spark, sf_dir), ["roi"], MARKERS, DNA)


@query(f"WITH {_PRACTICAL} SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM pc), 6) AS share FROM pc GROUP BY status")
def practical_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = staged(validation.practical_checks(virtual.pixels(spark, sf_dir), ["roi"], MARKERS, DNA).select("status"), "practical")
    return rounded(validation.decision_summary(checks, "status"))


_SUITE = f"""{_PRE}, sc AS (WITH {_SCORES} SELECT roi, coordinate_quality, ion_count_quality, biological_quality FROM scores), pq AS (SELECT roi, avg(quality) AS v FROM pre GROUP BY roi),
rr AS (SELECT roi, 'coordinates' AS rule, coordinate_quality AS score FROM sc UNION ALL SELECT roi, 'ion_counts', ion_count_quality FROM sc UNION ALL SELECT roi, 'biology', biological_quality FROM sc UNION ALL SELECT roi, 'preprocessing', v FROM pq),
sv AS (SELECT *, CASE WHEN score < 0.15 THEN 'critical' WHEN score < 0.35 THEN 'warning' ELSE 'pass' END AS severity FROM rr)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(roi, rule, score, severity) of every rule and region."""
    names = {"coordinate_quality": "coordinates", "ion_count_quality": "ion_counts", "biological_quality": "biology"}
    s = _scores(spark, sf_dir).select("roi", *(F.col(a).alias(b) for a, b in names.items())).unpivot(["roi"], list(names.values()), "rule", "score")
    pre = validation.preprocessing_checks(_paired(spark, sf_dir), ["roi", "marker"], "before", "after").groupBy("roi").agg(F.avg("quality").alias("score")).select("roi", F.lit("preprocessing").alias("rule"), "score")
    return s.unionByName(pre).withColumn("severity", F.when(F.col("score") < 0.15, "critical").when(F.col("score") < 0.35, "warning").otherwise("pass"))


@query(f"WITH {_SUITE} SELECT roi, rule, round(score, 6) AS score, severity FROM sv")
def validation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_results(spark, sf_dir))


@query(f"""WITH {_SUITE} SELECT count(*) AS total_rules, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'pass') AS n_pass, round(avg(score), 6) AS mean_quality, round(min(score), 6) AS min_quality,
CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'pass' END AS status FROM sv""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.suite_summary(_results(spark, sf_dir)))


@query(f"""WITH {_SUITE} SELECT roi, {', '.join(f"round(coalesce(max(score) FILTER (rule = '{r}'), 0), 6) AS {c}" for r, c in (('coordinates', 'coordinate_quality'), ('ion_counts', 'ion_count_quality'), ('preprocessing', 'preprocessing_quality'), ('segmentation', 'segmentation_quality')))} FROM sv GROUP BY roi""")
def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"coordinates": "coordinate_quality", "ion_counts": "ion_count_quality", "preprocessing": "preprocessing_quality", "segmentation": "segmentation_quality"}
    return rounded(validation.metric_rows(_results(spark, sf_dir), "roi", names))


_RANGES = {m: (0.5, 3.0) for m in MARKERS}


@query(f"""WITH {BASE_SQL}, l AS (SELECT roi, marker, value FROM (UNPIVOT ex ON {M} INTO NAME marker VALUE value)) SELECT roi, marker, round(quantile_cont(value, 0.25) FILTER (value > 0), 6) AS p25, round(quantile_cont(value, 0.75) FILTER (value > 0), 6) AS p75,
quantile_cont(value, 0.25) FILTER (value > 0) >= 0.5 AND quantile_cont(value, 0.75) FILTER (value > 0) <= 3.0 AS in_range FROM l GROUP BY ALL""")
def expression_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = thresholds.unpivoted(units(spark, sf_dir), ["roi"], MARKERS)
    positive = F.when(F.col("value") > 0, F.col("value"))
    s = long.groupBy("roi", "marker").agg(F.percentile(positive, F.lit(0.25)).alias("p25"), F.percentile(positive, F.lit(0.75)).alias("p75"))
    low, high = next(iter(_RANGES.values()))
    return rounded(s.withColumn("in_range", (F.col("p25") >= low) & (F.col("p75") <= high)))


@query(f"""WITH {BASE_SQL}, {knn_sql('ex', 1)}, n AS (SELECT roi, CASE WHEN count(*) < 10 THEN 0.5 ELSE greatest(0, least(1, exp(-stddev_pop(sqrt(d2)) / avg(sqrt(d2))))) END AS regularity FROM e GROUP BY roi), b AS (SELECT roi, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM ex GROUP BY roi),
q AS (SELECT roi, count(*) AS c FROM ex JOIN b USING (roi) GROUP BY roi, least(floor((y - ly) * 4 / (hy - ly)), 3), least(floor((x - lx) * 4 / (hx - lx)), 3)), u AS (SELECT roi, exp(-stddev_pop(c) / avg(c)) AS uniformity FROM q GROUP BY roi)
SELECT roi, round(regularity, 6) AS regularity, round(uniformity, 6) AS uniformity FROM n JOIN u USING (roi)""")
def spatial_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = staged(units(spark, sf_dir).select("roi", "spx", "x", "y"), "places")
    near = validation.nearest_regularity(knn(df, 1), ["roi"])
    return rounded(near.join(quality.coordinate_checks(df, ["roi"]).select("roi", "uniformity"), "roi"))


# Rasters: pixels in squares of 5, labelled by the cell of a grid of 35 that they lie in.
_RASTER = f"{virtual.pixel_sql()}, ra AS (SELECT roi, x // 5 AS cx, y // 5 AS cy, (y // 35) * 100 + x // 35 AS label, sum(dna1 + dna2) AS v FROM px GROUP BY ALL), rs AS (SELECT roi, cx, cy, min(label) AS label, sum(v) AS v FROM ra GROUP BY ALL)"


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = virtual.pixels(spark, sf_dir)
    at = lambda c, s: F.floor(F.col(c) / s)
    cells = px.groupBy("roi", at("x", 5).alias("bin_x"), at("y", 5).alias("bin_y")).agg(F.min(at("y", 35) * 100 + at("x", 35)).alias("label"), F.sum(F.col("dna1") + F.col("dna2")).alias("value"))
    return staged(cells, "raster")


_SHAPES = f"""{_RASTER}, o AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS t(dx, dy)), sd AS (SELECT a.roi, a.cx, a.cy, a.label, a.v, (SELECT 0) + count(b.label) AS same FROM rs a CROSS JOIN o LEFT JOIN rs b ON b.roi = a.roi AND b.cx = a.cx + dx AND b.cy = a.cy + dy AND b.label = a.label GROUP BY ALL),
sh0 AS (SELECT roi, label, count(*) AS area, sum(4 - same)::BIGINT AS perimeter, avg(cx) AS x, avg(cy) AS y, avg(v) AS mean_value, var_pop(cx) + 1.0 / 12 AS xx, var_pop(cy) + 1.0 / 12 AS yy, covar_pop(cx, cy) AS xy FROM sd GROUP BY ALL),
sh AS (SELECT *, least(1.0, 4 * pi() * area / pow(perimeter, 2)) AS compactness, sqrt(1 - greatest((xx + yy - sqrt(pow(xx - yy, 2) + 4 * xy * xy)) / 2, 0) / ((xx + yy + sqrt(pow(xx - yy, 2) + 4 * xy * xy)) / 2)) AS eccentricity FROM sh0)"""


@query(f"WITH {_SHAPES} SELECT roi, label, area, perimeter, {', '.join(r6(c, c) for c in ('x', 'y', 'mean_value', 'compactness', 'eccentricity'))} FROM sh")
def segment_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.segment_shapes(_raster(spark, sf_dir), ["roi"]))


@query(f"""WITH {_SHAPES} SELECT roi, count(*) AS n_segments, round(avg(compactness), 6) AS mean_compactness, round(stddev_pop(compactness), 6) AS sd_compactness, round(min(compactness), 6) AS min_compactness, round(max(compactness), 6) AS max_compactness, round(1 / (1 + stddev_pop(area) / avg(area)), 6) AS size_uniformity,
round(avg(eccentricity), 6) AS mean_eccentricity, round((1 / (1 + stddev_pop(area) / avg(area)) + avg(compactness) + least(1.0, sum(area) / 10000.0)) / 3, 6) AS quality, CASE WHEN (1 / (1 + stddev_pop(area) / avg(area)) + avg(compactness) + least(1.0, sum(area) / 10000.0)) / 3 < 0.4 THEN 'warning' ELSE 'pass' END AS severity FROM sh GROUP BY roi""")
def segmentation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = staged(raster.segment_shapes(_raster(spark, sf_dir), ["roi"]), "shapes")
    covered = shapes.groupBy("roi").agg(F.least(F.lit(1.0), F.sum("area") / 10_000).alias("_c"))
    s = raster.shape_summary(shapes, ["roi"]).join(covered, "roi").withColumn("quality", (F.col("size_uniformity") + F.col("mean_compactness") + F.col("_c")) / 3).drop("_c")
    return rounded(s.withColumn("severity", F.when(F.col("quality") < 0.4, "warning").otherwise("pass")))


_EDGE = f"""{_RASTER}, bd AS (SELECT DISTINCT a.roi, a.cx, a.cy FROM rs a JOIN rs b ON a.roi = b.roi AND ((b.cx = a.cx - 1 AND b.cy = a.cy) OR (b.cx = a.cx AND b.cy = a.cy - 1)) WHERE a.label <> b.label)"""


@query(f"""WITH {_EDGE}, c AS (SELECT roi, box, count(*) AS n FROM (SELECT DISTINCT roi, box, cx // box AS a, cy // box AS b FROM bd, (SELECT unnest([2, 4, 8, 16, 32]) AS box)) GROUP BY ALL), d AS (SELECT roi, greatest(1.0, least(2.0, -regr_slope(ln(n), ln(box)))) AS fractal_dim FROM c GROUP BY roi)
SELECT r.roi, round(coalesce(fractal_dim, 1), 6) AS fractal_dim, round(2 - coalesce(fractal_dim, 1), 6) AS regularity, (SELECT count(*) FROM bd WHERE bd.roi = r.roi) AS boundary_pixels FROM (SELECT DISTINCT roi FROM rs) r LEFT JOIN d ON r.roi = d.roi""")
def boundary_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.box_dimension(_raster(spark, sf_dir), ["roi"]))


_SOBEL = f"""{_EDGE}, w AS (SELECT a AS dx, b AS dy FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b) WHERE a <> 0 OR b <> 0),
gr AS (SELECT a.roi, a.cx, a.cy, sqrt(pow(coalesce(sum(-dx * (2 - abs(dy)) * b.v), 0), 2) + pow(coalesce(sum(-dy * (2 - abs(dx)) * b.v), 0), 2)) AS g FROM rs a CROSS JOIN w LEFT JOIN rs b ON b.roi = a.roi AND b.cx = a.cx + dx AND b.cy = a.cy + dy GROUP BY ALL)"""


@query(f"""WITH {_SOBEL}, j AS (SELECT gr.roi, g, bd.cx AS edge FROM gr LEFT JOIN bd ON gr.roi = bd.roi AND gr.cx = bd.cx AND gr.cy = bd.cy)
SELECT roi, round(CASE WHEN avg(g) > 0 THEN greatest(0, least(2, coalesce(avg(g) FILTER (edge IS NOT NULL), 0) / avg(g))) ELSE 1 END, 6) AS adherence FROM j GROUP BY roi""")
def signal_adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.adherence(_raster(spark, sf_dir), ["roi"]))


@query(f"""WITH {_SOBEL}, lim AS (SELECT roi, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM rs GROUP BY roi), bi AS (SELECT bd.* FROM bd JOIN lim USING (roi) WHERE cx > x0 AND cx < x1 AND cy > y0 AND cy < y1), cut AS (SELECT roi, quantile_cont(g, 0.8) FILTER (g > 0) AS cut FROM gr GROUP BY roi),
s AS (SELECT gr.roi, count(bi.cx) AS n_b, count(*) FILTER (g > cut) AS n_t, count(bi.cx) FILTER (g > cut) AS nb FROM gr JOIN cut ON gr.roi = cut.roi LEFT JOIN bi ON gr.roi = bi.roi AND gr.cx = bi.cx AND gr.cy = bi.cy GROUP BY gr.roi), p AS (SELECT roi, n_b, n_t, coalesce(nb / nullif(n_b, 0), 0) AS precision, coalesce(nb / nullif(n_t, 0), 0) AS recall FROM s)
SELECT roi, n_b, n_t, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM p""")
def boundary_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.boundary_quality(_raster(spark, sf_dir), ["roi"]))


@query(f"""WITH {_RASTER}, z AS (SELECT roi, label, count(*)::DOUBLE AS s FROM rs GROUP BY ALL), d AS (SELECT roi, label, s - avg(s) OVER (PARTITION BY roi) AS s FROM z), e AS (SELECT DISTINCT a.roi, a.label AS src, b.label AS dst FROM rs a JOIN rs b ON a.roi = b.roi AND a.label <> b.label AND abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1),
c AS (SELECT e.roi, count(*) AS w, sum(a.s * b.s) AS c FROM e JOIN d a ON e.roi = a.roi AND e.src = a.label JOIN d b ON e.roi = b.roi AND e.dst = b.label GROUP BY e.roi), q AS (SELECT roi, count(*) AS n, sum(s * s) AS q FROM d GROUP BY roi) SELECT roi, n, round(CASE WHEN q > 0 THEN n / w * c / q END, 6) AS i_size FROM c JOIN q USING (roi)""")
def segment_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _raster(spark, sf_dir)
    sizes = cells.groupBy("roi", F.col("label").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("size"))
    return rounded(neighbours.morans_i(sizes, raster.touching(cells, ["roi"]).withColumn("w", F.lit(1.0)), ["roi"], ["size"]))


@query(f"""WITH {virtual.pixel_sql()}, p AS (SELECT roi, x, y, sum(dna1 + dna2) AS raw FROM px GROUP BY ALL), f AS (SELECT roi, CASE WHEN quantile_cont(raw, 0.1) > 0 THEN quantile_cont(raw, 0.1) ELSE coalesce(quantile_cont(raw, 0.25) FILTER (raw > 0), 1) END AS f FROM p GROUP BY roi)
SELECT roi, count(*) AS n, round(avg(asinh(raw / (f * 10))), 6) AS mean_value, round(max(asinh(raw / (f * 10))), 6) AS top_value, round(avg(raw), 6) AS mean_raw FROM p JOIN f USING (roi) GROUP BY roi""")
def dna_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = raster.composite(virtual.pixels(spark, sf_dir), ["roi"], DNA)
    return rounded(c.groupBy("roi").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("top_value"), F.avg("raw").alias("mean_raw")))


