"""Plans over pixels and units: aggregation, transforms, thresholds, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import binning, gating, quality, thresholds, transforms
from quadrille.plans.common import LONG_SQL, REFERENCE_SQL, SCORED_SQL, lineages, query, r6, reference, rounded, scored, units, with_interface
from quadrille.sources import virtual
from quadrille.sources.virtual import BASE_SQL, MARKERS

M = ", ".join(MARKERS)


@query(f"WITH {virtual.pixel_sql()}, {virtual.superpixel_sql(20)} SELECT roi, spx, {r6('x', 'x')}, {r6('y', 'y')}, {M}, dna1, dna2 FROM spx")
def superpixel_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(virtual.superpixels(spark, sf_dir, 20))


@query(f"""WITH {virtual.pixel_sql()}, grid AS (SELECT roi, a.i AS bin_y, b.i AS bin_x FROM (SELECT DISTINCT roi FROM px), range(0, 25) a(i), range(0, 25) b(i)),
s AS (SELECT roi, y // 20 AS bin_y, x // 20 AS bin_x, {', '.join(f'sum({m}) AS {m}' for m in MARKERS)} FROM px GROUP BY ALL)
SELECT roi, bin_y, bin_x, {', '.join(f'round(coalesce({m}, 0), 6) AS {m}' for m in MARKERS)} FROM grid LEFT JOIN s USING (roi, bin_y, bin_x)""")
def dense_bin_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(binning.dense_bins(virtual.pixels(spark, sf_dir), ["roi"], 20, MARKERS, virtual.FIELD))


_GRID = f"""{virtual.pixel_sql()}, b AS (SELECT roi, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px GROUP BY roi),
n AS (SELECT *, greatest(ceil((x1 - x0) / 35.0), 1)::BIGINT AS nx, greatest(ceil((y1 - y0) / 35.0), 1)::BIGINT AS ny FROM b),
g AS (SELECT px.*, least(floor((y - y0) * ny / greatest(y1 - y0, 1e-9)), ny - 1)::BIGINT * nx + least(floor((x - x0) * nx / greatest(x1 - x0, 1e-9)), nx - 1)::BIGINT AS cell FROM px JOIN n USING (roi)),
c AS (SELECT roi, cell, avg(x) AS x, avg(y) AS y, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, sum(dna1) AS dna1, {', '.join(f'sum({m}) AS {m}' for m in MARKERS)} FROM g GROUP BY roi, cell)"""


@query(f"WITH {_GRID} SELECT roi, cell, {r6('x', 'x')}, {r6('y', 'y')}, area, {r6('dna1', 'dna1')}, {', '.join(r6(m, m) for m in MARKERS)} FROM c")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = binning.regular_grid(virtual.pixels(spark, sf_dir), ["roi"], 35, ["dna1", *MARKERS])
    return rounded(cells.select("roi", "cell", "x", "y", "area", "dna1", *MARKERS))


@query(f"""WITH {_GRID} SELECT roi, cell, area, 2 * ((max_x - min_x + 1) + (max_y - min_y + 1)) AS perimeter,
round(sqrt(1 - pow(least(max_x - min_x + 1, max_y - min_y + 1) / greatest(max_x - min_x + 1, max_y - min_y + 1), 2)), 6) AS eccentricity,
round(dna1 / area, 6) AS mean_signal, round(1 / (1 + stddev_pop(area) OVER w / avg(area) OVER w), 6) AS size_uniformity FROM c WINDOW w AS (PARTITION BY roi)""")
def grid_cell_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = binning.regular_grid(virtual.pixels(spark, sf_dir), ["roi"], 35, ["dna1", "cd45"])
    return rounded(binning.cell_properties(cells, ["roi"], "dna1"))


@query(f"""WITH {virtual.pixel_sql()}, s0 AS (SELECT roi, y // 20 AS yy, x // 20 AS xx, {', '.join(f'sum({m}) AS {m}' for m in MARKERS)} FROM px GROUP BY ALL), s AS (SELECT roi, yy, xx, marker, v FROM (UNPIVOT s0 ON {M} INTO NAME marker VALUE v)),
l AS MATERIALIZED (SELECT roi, marker, yy, xx, least(floor(v / max(v) OVER (PARTITION BY roi, marker) * 8), 7) AS i FROM s), p AS (SELECT a.roi, a.marker, a.i AS i, b.i AS j FROM l a JOIN l b ON a.roi = b.roi AND a.marker = b.marker AND a.yy = b.yy AND a.xx + 1 = b.xx),
q AS (SELECT roi, marker, i, j, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT roi, marker, j AS i, i AS j FROM p) GROUP BY ALL), w AS (SELECT *, n / sum(n) OVER (PARTITION BY roi, marker) AS w FROM q),
m AS (SELECT roi, marker, sum(w * pow(i - j, 2)) AS contrast, sum(w / (1 + pow(i - j, 2))) AS homogeneity, sqrt(sum(w * w)) AS energy, sum(w * i * j) AS ij, sum(w * i) AS mi, sum(w * i * i) AS ii FROM w GROUP BY roi, marker)
SELECT roi, marker, {r6('contrast', 'contrast')}, {r6('homogeneity', 'homogeneity')}, {r6('energy', 'energy')}, round(CASE WHEN round(ii - mi * mi, 12) > 0 THEN (ij - mi * mi) / (ii - mi * mi) END, 6) AS correlation FROM m""")
def texture_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = binning.bin_sums(virtual.pixels(spark, sf_dir), ["roi"], 20, MARKERS)
    return rounded(binning.texture(sums.unpivot(["roi", "bin_y", "bin_x"], MARKERS, "marker", "v"), ["roi", "marker"]))


_LONG_RAW = f"{virtual.pixel_sql()}, {virtual.superpixel_sql()}, lr AS (SELECT roi, marker, value FROM (UNPIVOT spx ON {M} INTO NAME marker VALUE value))"


@query(f"""WITH {_LONG_RAW}, m AS (SELECT marker, quantile_cont(value, 0.05) AS p, quantile_cont(value, 0.5) AS med FROM lr WHERE value > 0 GROUP BY marker),
d AS (SELECT marker, quantile_cont(abs(value - med), 0.5) AS mad FROM lr JOIN m USING (marker) WHERE value > 0 GROUP BY marker)
SELECT marker, round(greatest(p, 0.1), 6) AS cofactor_percentile, round(greatest(1.4826 * mad, 0.1), 6) AS cofactor_mad FROM m JOIN d USING (marker)""")
def arcsinh_cofactors(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = thresholds.unpivoted(virtual.superpixels(spark, sf_dir), ["roi"], MARKERS)
    return rounded(thresholds.cofactors(long))


@query(f"""WITH {_LONG_RAW}, g AS (SELECT pow(10, -1 + 3 * i / 49.0) AS cofactor FROM range(0, 50) t(i)),
v AS (SELECT marker, cofactor, var_pop(asinh(value / cofactor)) AS v FROM lr, g WHERE value > 0 GROUP BY ALL)
SELECT marker, round(arg_min(cofactor, (round(v, 12), cofactor)), 6) AS cofactor FROM v GROUP BY marker""")
def variance_cofactors(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = thresholds.unpivoted(virtual.superpixels(spark, sf_dir), ["roi"], MARKERS)
    return rounded(thresholds.variance_cofactor(long))


@query(f"WITH {BASE_SQL} SELECT roi, spx, {', '.join(r6(m, m) for m in MARKERS)} FROM ex WHERE {' + '.join(f'abs({m})' for m in MARKERS)} > 0")
def arcsinh_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transforms.with_signal(units(spark, sf_dir), MARKERS).select("roi", "spx", *MARKERS))


@query(f"""WITH {BASE_SQL} SELECT roi, spx, {', '.join(f"round(({m} - avg({m}) OVER w) / CASE WHEN stddev_pop({m}) OVER w > 1e-12 THEN stddev_pop({m}) OVER w ELSE 1 END, 5) AS {m}" for m in MARKERS)} FROM ex WINDOW w AS (PARTITION BY roi)""")
def standardized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transforms.zscores(units(spark, sf_dir).select("roi", "spx", *MARKERS), ["roi"], MARKERS), 5)


_CO = MARKERS


@query(f"""WITH {BASE_SQL}, e AS (SELECT roi, quantile_cont(v, 0.25) FILTER (v > 0) AS m FROM (SELECT roi, unnest([{', '.join(_CO)}]) AS v FROM ex) GROUP BY roi),
q AS (SELECT roi, {', '.join(f'avg({a} * {a}) AS q_{a}' for a in _CO)} FROM ex GROUP BY roi)
SELECT roi, spx, {', '.join(f"round(coalesce({a} * {b} / (sqrt(q_{a} * q_{b}) + 1e-10), 0), 6) AS {a}_x_{b}" for i, a in enumerate(_CO) for b in _CO[i + 1:])},
{', '.join(f"round(coalesce(ln(1 + ({a} + m) / ({b} + m)), 0), 6) AS {a}_over_{b}" for a in _CO for b in _CO if a != b)} FROM ex JOIN e USING (roi) JOIN q USING (roi)""")
def coabundance_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transforms.coabundance(units(spark, sf_dir).select("roi", "spx", *_CO), ["roi"], _CO).drop(*_CO))


@query(f"""WITH {BASE_SQL}, v AS (SELECT {', '.join(f'var_pop({m}) AS {m}' for m in MARKERS)} FROM ex), l AS (SELECT marker AS feature, value AS variance FROM (UNPIVOT v ON {M} INTO NAME marker VALUE value))
SELECT feature, round(variance, 6) AS variance, row_number() OVER (ORDER BY round(variance, 9) DESC, feature) AS place FROM l QUALIFY place <= 5""")
def most_variable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transforms.most_variable(units(spark, sf_dir), MARKERS, 5))


@query(f"""WITH {BASE_SQL} SELECT roi, spx, round((cd45 + cd11b + ly6g) / 3, 6) AS immune_mean, greatest(cd45, cd11b, ly6g) AS immune_max,
round((pow(cd45 - (cd45 + cd11b + ly6g) / 3, 2) + pow(cd11b - (cd45 + cd11b + ly6g) / 3, 2) + pow(ly6g - (cd45 + cd11b + ly6g) / 3, 2)) / 3, 6) AS immune_var,
round((cd31 + cd34) / 2, 6) AS vessel_mean, greatest(cd31, cd34) AS vessel_max, round((pow(cd31 - (cd31 + cd34) / 2, 2) + pow(cd34 - (cd31 + cd34) / 2, 2)) / 2, 6) AS vessel_var FROM
(SELECT roi, spx, {', '.join(r6(m, m) for m in MARKERS)} FROM ex)""")
def group_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rounded(units(spark, sf_dir).select("roi", "spx", *MARKERS))
    return rounded(transforms.hierarchical_features(df, {"immune": ["cd45", "cd11b", "ly6g"], "vessel": ["cd31", "cd34"]}).drop(*MARKERS))


@query(f"WITH {BASE_SQL}, {REFERENCE_SQL} SELECT marker, {r6('threshold', 'threshold')}, {r6('scale', 'scale')} FROM ref")
def reference_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reference(units(spark, sf_dir)))


@query(f"WITH {BASE_SQL}, long AS ({LONG_SQL}) SELECT marker, round(quantile_cont(value, 0.75), 6) AS threshold FROM long GROUP BY marker")
def pooled_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(thresholds.pooled_thresholds(thresholds.unpivoted(units(spark, sf_dir), ["roi"], MARKERS), 75.0))


def _gates_sql() -> str:
    cut = {"cd206": 0.5, "ly6g": 0.7}
    t = ", ".join(f"quantile_cont({m}, {cut.get(m, 0.6)}) AS t_{m}" for m in MARKERS)
    g = {n: " AND ".join([f"{m} > t_{m}" for m in pos] + [f"NOT {m} > t_{m}" for m in gating.NEGATIVES.get(n, [m for m in MARKERS if m not in pos])]) for n, pos in gating.GATES.items()}
    hits = " + ".join(f"({c})::INT" for c in g.values())
    return f"""{BASE_SQL}, t AS (SELECT roi, {t} FROM ex GROUP BY roi), gated AS (SELECT ex.*, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c in g.items())} ELSE 'unassigned' END AS cell_type, {hits} AS hits FROM ex JOIN t USING (roi)),
labelled AS (SELECT *, CASE WHEN hits > 0 THEN 1.0 / hits ELSE 0.0 END AS confidence FROM gated)"""


GATED_SQL = _gates_sql()


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.annotate(gating.positivity(units(spark, sf_dir), ["roi"], MARKERS, gating.POSITIVITY), MARKERS)


@query(f"WITH {GATED_SQL} SELECT roi, spx, cell_type, round(confidence, 6) AS confidence FROM labelled")
def cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gated(spark, sf_dir).select("roi", "spx", "cell_type", "confidence"))


@query(f"""WITH {GATED_SQL} SELECT roi, timepoint, mouse, region, count(*) AS n, count(*) FILTER (cell_type <> 'unassigned') AS n_assigned, round(avg((cell_type <> 'unassigned')::INT), 6) AS assignment_rate,
count(DISTINCT cell_type) AS n_types, round(avg(confidence), 6) AS mean_confidence FROM labelled GROUP BY ALL""")
def annotation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("cell_type") != "unassigned"
    out = gated(spark, sf_dir).groupBy("roi", "timepoint", "mouse", "region").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("n_assigned"), F.avg(known.cast("double")).alias("assignment_rate"), F.count_distinct("cell_type").alias("n_types"), F.avg("confidence").alias("mean_confidence")
    )
    return rounded(out)


_SCORES = ["lineage_immune", "lineage_endothelial", "lineage_stromal", "activation_cd44", "activation_cd140b"]
_COMPOSITE = """CASE WHEN t1 < 0.3 THEN 'c:unassigned' WHEN t2 >= 0.3 AND t1 < 2.0 * t2 THEN 'c:mixed' ELSE 'c:' || CASE WHEN act <> '' THEN 'activated_' || base || '_' || act ELSE base END END"""


def _composite_sql() -> str:
    """The composite label of a row of `scored`, in one expression."""
    three = "[lineage_immune, lineage_endothelial, lineage_stromal]"
    t1, t2, top = f"list_reverse_sort({three})[1]", f"list_reverse_sort({three})[2]", "greatest(lineage_immune, lineage_endothelial, lineage_stromal)"
    act = "concat_ws('_', CASE WHEN activation_cd140b >= 0.3 THEN 'cd140b' END, CASE WHEN activation_cd44 >= 0.3 THEN 'cd44' END)"
    base = f"CASE WHEN subtype <> 'none' THEN subtype WHEN lineage_immune = {top} THEN 'immune' WHEN lineage_endothelial = {top} THEN 'endothelial' ELSE 'stromal' END"
    return f"CASE WHEN {t1} < 0.3 THEN 'c:unassigned' WHEN {t2} >= 0.3 AND {t1} < 2.0 * {t2} THEN 'c:mixed' ELSE 'c:' || CASE WHEN {act} <> '' THEN 'activated_' || {base} || '_' || {act} ELSE {base} END END"


COMPOSITE_SQL = _composite_sql()


@query(f"""WITH {SCORED_SQL}, k AS (SELECT *, list_reverse_sort([lineage_immune, lineage_endothelial, lineage_stromal])[1] AS t1, list_reverse_sort([lineage_immune, lineage_endothelial, lineage_stromal])[2] AS t2,
concat_ws('_', CASE WHEN activation_cd140b >= 0.3 THEN 'cd140b' END, CASE WHEN activation_cd44 >= 0.3 THEN 'cd44' END) AS act,
CASE WHEN subtype <> 'none' THEN subtype WHEN lineage_immune = greatest(lineage_immune, lineage_endothelial, lineage_stromal) THEN 'immune' WHEN lineage_endothelial = greatest(lineage_immune, lineage_endothelial, lineage_stromal) THEN 'endothelial' ELSE 'stromal' END AS base FROM scored)
SELECT roi, spx, {', '.join(r6(s, s) for s in _SCORES)}, subtype, {_COMPOSITE} AS composite_label, interface FROM k""")
def membership_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_interface(scored(spark, sf_dir))
    label = gating.composite_label(lineages(), F.col("subtype"), {a: F.col(f"activation_{a}") for a in gating.ACTIVATION})
    return rounded(df.withColumn("composite_label", label).select("roi", "spx", *_SCORES, "subtype", "composite_label", "interface"))


@query(f"""WITH {SCORED_SQL} SELECT timepoint, {', '.join(f"round(avg(CASE WHEN n = {k} THEN 100.0 ELSE 0 END), 6) AS pct_{k}" for k in range(4))} FROM (
SELECT timepoint, (lineage_immune > 0.5)::INT + (lineage_endothelial > 0.5)::INT + (lineage_stromal > 0.5)::INT AS n FROM scored) GROUP BY timepoint""")
def lineage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gating.lineage_count_shares(scored(spark, sf_dir), ["timepoint"]))


@query(f"""WITH {virtual.pixel_sql()}, m AS (SELECT roi, count(*) AS n, ({' + '.join(f'avg(({m} > 0)::INT)' for m in MARKERS)}) / 9 AS p, ({' + '.join(f'coalesce(avg({m}) / nullif(stddev_pop({m}), 0), 0)' for m in MARKERS)}) / 9 AS s, least(1.0, (avg(dna1) + avg(dna2)) / 2 / 50) AS d FROM px GROUP BY roi)
SELECT roi, n, {r6('p', 'positive_share')}, {r6('s', 'snr')}, {r6('d', 'dna_quality')}, round(0.5 * p + 0.5 * least(1.0, s / 2), 6) AS ion_quality, round((0.5 * p + 0.5 * least(1.0, s / 2) + d) / 2, 6) AS overall FROM m""")
def region_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.region_metrics(virtual.pixels(spark, sf_dir), ["roi"], MARKERS, virtual.DNA))


@query(f"""WITH {virtual.pixel_sql()}, q AS (SELECT roi, quantile_cont(x, 0.25) AS x25, quantile_cont(x, 0.75) AS x75, quantile_cont(y, 0.25) AS y25, quantile_cont(y, 0.75) AS y75, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM px GROUP BY roi),
c AS (SELECT roi, least(floor((y - ly) * 4 / (hy - ly)), 3) AS qy, least(floor((x - lx) * 4 / (hx - lx)), 3) AS qx, count(*) AS c,
 count(*) FILTER (x < x25 - 1.5 * (x75 - x25) OR x > x75 + 1.5 * (x75 - x25) OR y < y25 - 1.5 * (y75 - y25) OR y > y75 + 1.5 * (y75 - y25)) AS o, any_value((hx - lx) * (hy - ly)) AS area FROM px JOIN q USING (roi) GROUP BY ALL)
SELECT roi, sum(c)::BIGINT AS n, any_value(area) AS area, round(sum(c) / any_value(area), 6) AS density, round(sum(o) / sum(c), 6) AS outlier_share, round(exp(-stddev_pop(c) / avg(c)), 6) AS uniformity FROM c GROUP BY roi""")
def coordinate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.coordinate_checks(virtual.pixels(spark, sf_dir), ["roi"]))


@query(f"""WITH {_LONG_RAW}, s AS (SELECT marker, count(*) AS n, avg((value = 0)::INT) AS z, avg(value) AS m, stddev_pop(value) AS sd, max(value) AS top, quantile_cont(value, 0.99) FILTER (value > 0) AS p99, avg(value) FILTER (value > 0) AS pm FROM lr GROUP BY marker),
k AS (SELECT marker, avg(pow(value - pm, 3)) / pow(avg(pow(value - pm, 2)), 1.5) AS sk FROM lr JOIN s USING (marker) WHERE value > 0 GROUP BY marker),
x AS (SELECT marker, avg((value > p99)::INT) AS e FROM lr JOIN s USING (marker) GROUP BY marker)
SELECT marker, n, {r6('z', 'zero_share')}, {r6('m', 'mean')}, {r6('sd', 'sd')}, {r6('top', 'top')}, {r6('p99', 'p99')}, {r6('sk', 'skewness')}, {r6('sd * sd / m', 'fano')}, {r6('exp(-pow(ln(sd * sd / m), 2))', 'distribution_score')}, {r6('e', 'extreme_share')} FROM s JOIN k USING (marker) JOIN x USING (marker)""")
def count_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.count_checks(thresholds.unpivoted(virtual.superpixels(spark, sf_dir), ["roi"], MARKERS), ["marker"]))


_ALL_PAIRS = [(a, b) for i, a in enumerate(MARKERS) for b in MARKERS[i + 1 :]]
#: Rows (roi, a, b, va, vb) of all pairs of markers of a unit.
PAIRED_SQL = f"""{BASE_SQL}, lm AS MATERIALIZED ({LONG_SQL}), pm AS (SELECT x.roi, x.spx, x.marker AS a, y.marker AS b, x.value AS va, y.value AS vb FROM lm x JOIN lm y ON x.roi = y.roi AND x.spx = y.spx JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _ALL_PAIRS)}) AS k(a, b) ON k.a = x.marker AND k.b = y.marker)"""


def paired(df: DataFrame, *keep: str) -> DataFrame:
    """(roi, keep, a, b, va, vb): all pairs of markers of each unit as rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb")) for a, b in _ALL_PAIRS)))
    return df.select("roi", *keep, pairs.alias("p")).select("roi", *keep, "p.*")


@query(f"""WITH {PAIRED_SQL} SELECT roi, a, b, count(*) FILTER (va > 0 AND vb > 0) AS n_both, round(CASE WHEN count(*) FILTER (va > 0 AND vb > 0) >= 21 THEN corr(va, vb) FILTER (va > 0 AND vb > 0) END, 6) AS r_both,
count(*) FILTER (va > 0 OR vb > 0) AS n_either, round(CASE WHEN count(*) FILTER (va > 0 OR vb > 0) >= 21 THEN corr(va, vb) FILTER (va > 0 OR vb > 0) END, 6) AS r_either FROM pm GROUP BY roi, a, b""")
def coexpression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.pair_checks(paired(units(spark, sf_dir)), ["roi", "a", "b"], "va", "vb"))


def _votes_sql(name: str, positive: list[str]) -> str:
    negative = gating.NEGATIVES.get(name, [m for m in MARKERS if m not in positive])
    votes = [f"(c.{m} / g.{m} >= 1.5)::INT" for m in positive] + [f"(c.{m} / g.{m} < 1 / 1.5)::INT" for m in negative]
    return f"round(({' + '.join(votes)}) / {len(votes)}.0, 9)"


@query(f"""WITH {BASE_SQL}, c AS (SELECT spx % 12 AS cluster, {', '.join(f'avg({m}) AS {m}' for m in MARKERS)} FROM ex GROUP BY ALL), g AS (SELECT {', '.join(f'avg({m}) AS {m}' for m in MARKERS)} FROM ex),
s AS ({' UNION ALL '.join(f"SELECT cluster, {i} AS i, '{n}' AS cell_type, {_votes_sql(n, pos)} AS score FROM c, g" for i, (n, pos) in enumerate(gating.GATES.items()))}),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, i) AS k FROM s) SELECT cluster, CASE WHEN score >= 0.3 THEN cell_type ELSE 'unassigned' END AS cell_type, round(score, 6) AS score FROM r WHERE k = 1""")
def cluster_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell type that most markers of a cluster speak for; clusters are units by their number here."""
    return rounded(gating.cluster_enrichment(units(spark, sf_dir).withColumn("cluster", F.col("spx") % 12), "cluster", MARKERS))


_MAXES = ", ".join(f"round(max(v) FILTER (marker = '{m}'), 6) AS {m}" for m in MARKERS)


@query(f"""WITH {_LONG_RAW}, cf AS (SELECT marker, greatest(quantile_cont(value, 0.05) FILTER (value > 0), 0.1) AS c FROM lr GROUP BY marker), l2 AS (SELECT roi, spx, marker, value FROM (UNPIVOT spx ON {M} INTO NAME marker VALUE value)),
v AS (SELECT roi, spx, marker, round(asinh(value / c), 9) AS v FROM l2 JOIN cf USING (marker)) SELECT roi, spx, {_MAXES} FROM v GROUP BY ALL""")
def optimised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcsinh with each marker's own cofactor, taken from its low positive values."""
    df = virtual.superpixels(spark, sf_dir)
    row = thresholds.cofactors(thresholds.unpivoted(df, ["roi"], MARKERS)).agg(*(F.max(F.when(F.col("marker") == m, F.col("cofactor_percentile"))).alias(f"_c_{m}") for m in MARKERS))
    made = df.join(F.broadcast(row)).select("roi", "spx", *(F.round(F.asinh(F.col(m) / F.col(f"_c_{m}")), 9).alias(m) for m in MARKERS))
    return rounded(made)


@query(f"WITH {BASE_SQL}, l AS ({LONG_SQL}) SELECT roi, spx, marker, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS scaled FROM l WINDOW w AS (PARTITION BY roi, marker)")
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = thresholds.unpivoted(units(spark, sf_dir), ["roi", "spx"], MARKERS)
    return rounded(transforms.minmax(long, ["roi", "marker"], "value", "scaled").select("roi", "spx", "marker", "scaled"))


@query(f"""WITH {SCORED_SQL}, k AS (SELECT roi, coalesce(nullif(concat_ws('+', CASE WHEN lineage_endothelial >= 0.3 THEN 'endothelial' END, CASE WHEN lineage_immune >= 0.3 THEN 'immune' END, CASE WHEN lineage_stromal >= 0.3 THEN 'stromal' END), ''), 'none') AS category FROM scored) SELECT roi, category, count(*) AS n FROM k GROUP BY ALL""")
def inclusive_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface categories with thresholds included."""
    df = scored(spark, sf_dir).withColumn("category", gating.interface(lineages(), strict=False))
    return df.groupBy("roi", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BASE_SQL}, w AS (SELECT unnest(range(0, 2500)) AS place), r AS (SELECT DISTINCT roi FROM ex), l AS (SELECT roi, spx, spx % 7 AS label FROM ex) SELECT r.roi, (place // 50)::BIGINT AS y, (place % 50)::BIGINT AS x, coalesce(label, -1) AS label FROM r CROSS JOIN w LEFT JOIN l ON l.roi = r.roi AND l.spx = place""")
def cluster_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels put back on each region's grid, -1 where there is no unit."""
    return binning.label_map(units(spark, sf_dir).select("roi", F.col("spx").alias("at"), (F.col("spx") % 7).alias("label")), ["roi"], 50, 50)


@query(f"""WITH {virtual.pixel_sql()}, {virtual.superpixel_sql()} SELECT px.roi, px.x, px.y, round(spx.cd45, 6) AS cd45, round(spx.cd44, 6) AS cd44, count(*) AS n FROM px JOIN spx ON px.roi = spx.roi AND spx.spx = (px.y // 10) * 50 + px.x // 10 GROUP BY ALL""")
def pixel_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of superpixels spread over the pixels that they are made of."""
    px = virtual.pixels(spark, sf_dir).groupBy("roi", "x", "y", (F.floor(F.col("y") / 10) * 50 + F.floor(F.col("x") / 10)).alias("spx")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(px.join(virtual.superpixels(spark, sf_dir).select("roi", "spx", "cd45", "cd44"), ["roi", "spx"]).select("roi", "x", "y", "cd45", "cd44", "n"))
