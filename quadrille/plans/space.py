"""Plans over spatial edges: enrichment, strata, differences, autocorrelation, point patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.folders import staged
from quadrille.operators import edges, neighbours
from quadrille.plans.common import SCORED_SQL, lineages, query, r6, rounded, scored, units, with_interface
from quadrille.plans.units import GATED_SQL, gated
from quadrille.sources import virtual
from quadrille.sources.virtual import BASE_SQL

K, SIDE = 10, 40.0


def kept(df: DataFrame) -> DataFrame:
    """Units are read once for the edges and again for what is put on them; staged, so that nothing stays in memory after."""
    return staged(df, "units")


def points(df: DataFrame) -> DataFrame:
    return df.select("roi", F.col("spx").alias("id"), "x", "y")


def knn(df: DataFrame, k: int = K) -> DataFrame:
    return edges.knn(points(df), ["roi"], k, SIDE)


def knn_sql(source: str, k: int = K, name: str = "e") -> str:
    return f"""{name} AS (SELECT a.roi, a.spx AS src, b.spx AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, row_number() OVER (PARTITION BY a.roi, a.spx ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.spx) AS rank
FROM {source} a JOIN {source} b ON a.roi = b.roi AND a.spx <> b.spx QUALIFY rank <= {k})"""


@query(f"WITH {BASE_SQL}, {knn_sql('ex')} SELECT roi, src, dst, {r6('d2', 'd2')}, rank FROM e")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn(kept(units(spark, sf_dir))).select("roi", "src", "dst", "d2", F.col("rank").cast("bigint").alias("rank")))


_ENRICH = """c AS (SELECT roi, l, count(*) AS n FROM named GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY roi) AS expected FROM c),
p AS (SELECT e.roi, f.l AS focal, g.l AS neighbour, count(*) AS m FROM e JOIN named f ON e.roi = f.roi AND e.src = f.spx JOIN named g ON e.roi = g.roi AND e.dst = g.spx GROUP BY ALL),
o AS (SELECT *, m / sum(m) OVER (PARTITION BY roi, focal) AS observed FROM p),
enr AS (SELECT a.roi, a.l AS focal, b.l AS neighbour, a.n AS n_focal, b.expected, coalesce(o.observed, 0) AS observed, coalesce(o.observed, 0) / b.expected AS enrichment FROM s a JOIN s b ON a.roi = b.roi LEFT JOIN o ON o.roi = a.roi AND o.focal = a.l AND o.neighbour = b.l),
en AS (SELECT *, CASE WHEN enrichment > 0 THEN greatest(least(log2(enrichment), 10), -10) END AS log2_enrichment FROM enr)"""
_ENRICHED = f"{GATED_SQL}, sure AS (SELECT * FROM labelled WHERE confidence > 0), named AS (SELECT roi, spx, cell_type AS l FROM sure), {knn_sql('sure')}, {_ENRICH}"


def cell_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(gated(spark, sf_dir).filter("confidence > 0"))
    return neighbours.enrichment(df.select("roi", F.col("spx").alias("id"), "cell_type"), knn(df), ["roi"], "cell_type")


@query(f"WITH {_ENRICHED} SELECT roi, focal, neighbour, n_focal, {', '.join(r6(c, c) for c in ('expected', 'observed', 'enrichment', 'log2_enrichment'))} FROM en")
def neighbourhood_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cell_enrichment(spark, sf_dir).select("roi", "focal", "neighbour", "n_focal", "expected", "observed", "enrichment", "log2_enrichment"))


_D = virtual.design_sql("en.roi")


@query(f"""WITH {_ENRICHED}, d AS (SELECT en.*, {_D} FROM en), s1 AS (SELECT focal, neighbour, mouse, timepoint,
CASE WHEN grouping(region) = 1 THEN 'pooled' ELSE region END AS region_level, CASE WHEN grouping(timepoint) = 1 THEN 'pooled' ELSE timepoint END AS timepoint_level,
avg(log2_enrichment) AS v, sum(n_focal) AS w, count(*) AS n FROM (SELECT *, timepoint || mouse AS subject FROM d)
GROUP BY GROUPING SETS ((focal, neighbour, subject), (focal, neighbour, subject, mouse, region), (focal, neighbour, subject, mouse, timepoint), (focal, neighbour, subject, mouse, region, timepoint))),
f AS (SELECT focal, neighbour, region_level, timepoint_level, avg(v) AS mean, min(v) AS lo, max(v) AS hi, sum(w) AS w, sum(n) AS n, count(*) AS k, count(v) AS kv FROM s1 GROUP BY ALL)
SELECT focal, neighbour, region_level, timepoint_level, round(CASE WHEN w >= 20 THEN mean END, 6) AS mean, round(CASE WHEN w >= 20 THEN lo END, 6) AS range_min, round(CASE WHEN w >= 20 THEN hi END, 6) AS range_max,
w::BIGINT AS n_support, n::BIGINT AS n_regions, k AS n_subjects, kv AS n_effective, w < 20 AS insufficient_support FROM f""")
def stratified_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = virtual.with_design(cell_enrichment(spark, sf_dir)).withColumn("subject", F.concat("timepoint", "mouse"))
    out = neighbours.strata(df, "log2_enrichment", "n_focal", ["focal", "neighbour"], ["region", "timepoint"], ["subject"], 20)
    return rounded(out.drop("subject_values"))


_SELF = f"{SCORED_SQL}, named AS (SELECT roi, spx, interface AS l FROM scored), {knn_sql('scored')}, {_ENRICH}, d AS (SELECT en.*, {_D} FROM en WHERE focal = neighbour)"


@query(f"""WITH {_SELF}, m AS (SELECT focal AS category, timepoint, mouse, avg(enrichment) AS v FROM d GROUP BY ALL), t AS (SELECT category, timepoint, avg(v) AS enrichment, count(*) AS n_mice FROM m GROUP BY ALL),
l AS (SELECT *, max(CASE WHEN timepoint = 'D7' THEN enrichment END) OVER (PARTITION BY category) AS last FROM t)
SELECT category, timepoint, n_mice, round(enrichment, 6) AS enrichment, CASE WHEN last >= 1.05 THEN 'focal' WHEN last IS NULL THEN 'absent' ELSE 'diffuse' END AS status FROM l""")
def interface_focalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    df = kept(with_interface(scored(spark, sf_dir)))
    own = neighbours.enrichment(df.select("roi", F.col("spx").alias("id"), "interface"), knn(df), ["roi"], "interface").filter("focal = neighbour")
    mice = virtual.with_design(own).groupBy(F.col("focal").alias("category"), "timepoint", "mouse").agg(F.avg("enrichment").alias("v"))
    t = mice.groupBy("category", "timepoint").agg(F.avg("v").alias("enrichment"), F.count(F.lit(1)).alias("n_mice"))
    last = F.max(F.when(F.col("timepoint") == "D7", F.col("enrichment"))).over(Window.partitionBy("category"))
    status = F.when(last >= 1.05, "focal").when(last.isNull(), "absent").otherwise("diffuse")
    return rounded(t.select("category", "timepoint", "n_mice", "enrichment", status.alias("status")))


_DELTAS = ", ".join(f"avg(b.{s}) - any_value(a.{s}) AS d_{s}" for s in ("lineage_immune", "lineage_endothelial", "lineage_stromal"))


@query(f"""WITH {SCORED_SQL}, {knn_sql('scored')}, d AS (SELECT e.roi, e.src, any_value(a.interface) AS interface, {_DELTAS} FROM e JOIN scored a ON e.roi = a.roi AND e.src = a.spx JOIN scored b ON e.roi = b.roi AND e.dst = b.spx GROUP BY e.roi, e.src)
SELECT roi, interface, count(*) AS n, count(*) < 20 AS below_min_support, {', '.join(f"round(CASE WHEN count(*) >= 20 THEN avg(d_{s}) END, 6) AS d_{s}" for s in ('lineage_immune', 'lineage_endothelial', 'lineage_stromal'))} FROM d GROUP BY roi, interface""")
def neighbour_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(with_interface(scored(spark, sf_dir)))
    names = [f"lineage_{n}" for n in lineages()]
    delta = neighbours.neighbour_minus_self(df.select("roi", F.col("spx").alias("id"), "interface", *names), knn(df), ["roi"], names)
    return rounded(neighbours.supported_means(delta, ["roi", "interface"], [f"d_{n}" for n in names], 20))


_SCORES = ["lineage_immune", "lineage_endothelial", "lineage_stromal"]


@query(f"""WITH {SCORED_SQL}, {knn_sql('scored')}, d AS (SELECT e.roi, e.src, any_value(a.interface) AS interface, any_value(a.timepoint) AS timepoint, any_value(a.mouse) AS mouse, {', '.join(f'avg(b.{v}) - any_value(a.{v}) AS d_{v}' for v in _SCORES)} FROM e JOIN scored a ON e.roi = a.roi AND e.src = a.spx JOIN scored b ON e.roi = b.roi AND e.dst = b.spx GROUP BY e.roi, e.src),
r AS (SELECT roi, interface, timepoint, mouse, {', '.join(f'CASE WHEN count(*) >= 20 THEN avg(d_{v}) END AS d_{v}' for v in _SCORES)}, count(*) AS n FROM d GROUP BY ALL), m AS (SELECT interface, timepoint, mouse, {', '.join(f'avg(d_{v}) AS d_{v}' for v in _SCORES)}, sum(n) AS n FROM r GROUP BY ALL),
full_ AS (SELECT interface FROM m GROUP BY interface HAVING count(DISTINCT CASE WHEN d_lineage_immune IS NOT NULL THEN timepoint END) = 4)
SELECT interface, timepoint, mouse, n::BIGINT AS n, {', '.join(f"round(d_{v}, 6) AS d_{v}, round(d_{v} - avg(CASE WHEN timepoint = 'Sham' THEN d_{v} END) OVER (PARTITION BY interface), 6) AS d_{v}_delta" for v in _SCORES)} FROM m SEMI JOIN full_ USING (interface) WHERE d_lineage_immune IS NOT NULL""")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far neighbours differ from a unit in each lineage's score, by interface, timepoint and subject, and that less the control's."""
    df = kept(with_interface(scored(spark, sf_dir)))
    delta = neighbours.neighbour_minus_self(df.select("roi", F.col("spx").alias("id"), "interface", *_SCORES), knn(df), ["roi"], _SCORES)
    found = [f"d_{v}" for v in _SCORES]
    per_roi = virtual.with_design(neighbours.supported_means(delta, ["roi", "interface"], found, 20))
    mice = per_roi.groupBy("interface", "timepoint", "mouse").agg(*(F.avg(v).alias(v) for v in found), F.sum("n").alias("n")).filter("d_lineage_immune IS NOT NULL")  # support is of a unit, so of all scores or none
    out = neighbours.complete_trajectories(mice, "interface", "timepoint", 4)
    for v in found:
        out = neighbours.minus_control(out, ["interface"], "timepoint", "Sham", v)
    return rounded(out)


def _moran_sql(values: list[str]) -> str:
    dev = ", ".join(f"{v} - avg({v}) OVER (PARTITION BY roi) AS {v}" for v in values)
    return f"""dev AS (SELECT roi, spx, {dev} FROM src), q AS (SELECT roi, count(*) AS n, {', '.join(f'sum({v} * {v}) AS q_{v}' for v in values)} FROM dev GROUP BY roi),
c AS (SELECT e.roi, sum(w) AS w, {', '.join(f'sum(w * a.{v} * b.{v}) AS c_{v}' for v in values)} FROM e JOIN dev a ON e.roi = a.roi AND e.src = a.spx JOIN dev b ON e.roi = b.roi AND e.dst = b.spx GROUP BY e.roi)
SELECT roi, n, {', '.join(f'round(CASE WHEN q_{v} > 0 THEN n / w * c_{v} / q_{v} END, 6) AS i_{v}' for v in values)} FROM c JOIN q USING (roi)"""


_MORAN = ["lineage_immune", "lineage_endothelial", "lineage_stromal"]


@query(f"WITH {SCORED_SQL}, {knn_sql('scored', K, 'e0')}, e AS (SELECT *, 1 / {K}.0 AS w FROM e0), src AS (SELECT * FROM scored), {_moran_sql(_MORAN)}")
def morans_i_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(scored(spark, sf_dir))
    return rounded(neighbours.morans_i(df.select("roi", F.col("spx").alias("id"), *_MORAN), knn(df).withColumn("w", F.lit(1 / K)), ["roi"], _MORAN))


_RADIUS = """SELECT a.roi, a.spx AS src, b.spx AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, abs(a.x - b.x) AS ax, abs(a.y - b.y) AS ay FROM ex a JOIN ex b ON a.roi = b.roi AND a.spx <> b.spx"""


@query(f"WITH {BASE_SQL}, e AS (SELECT *, 1.0 AS w FROM ({_RADIUS}) WHERE d2 <= 50 * 50), src AS (SELECT * FROM ex), {_moran_sql(virtual.MARKERS)}")
def morans_i_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(units(spark, sf_dir))
    near = edges.within(points(df), ["roi"], 50.0).select("roi", "src", "dst", F.lit(1.0).alias("w"))
    return rounded(neighbours.morans_i(df.select("roi", F.col("spx").alias("id"), *virtual.MARKERS), near, ["roi"], virtual.MARKERS))


@query(f"""WITH {SCORED_SQL}, {knn_sql('scored')}, f AS (SELECT roi, spx, lineage_immune > 0.3 AS on_ FROM scored), j AS (SELECT e.roi, count(*) AS joins FROM e JOIN f a ON e.roi = a.roi AND e.src = a.spx AND a.on_ JOIN f b ON e.roi = b.roi AND e.dst = b.spx AND b.on_ GROUP BY e.roi)
SELECT roi, count(*) AS n, count(*) FILTER (on_) AS n_positive, any_value(coalesce(joins, 0)) AS joins FROM f LEFT JOIN j USING (roi) GROUP BY roi""")
def join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(scored(spark, sf_dir))
    return neighbours.join_counts(df.select("roi", F.col("spx").alias("id"), (F.col("lineage_immune") > 0.3).alias("flag")), knn(df), ["roi"], "flag")


_K_ROWS = (5, 10, 15)


@query(f"""WITH {SCORED_SQL}, {knn_sql('scored', 15, 'e0')}, ks AS (SELECT unnest([5, 10, 15]) AS k), named AS (SELECT roi, spx, interface AS l FROM scored),
c AS (SELECT roi, l, count(*) AS n FROM named GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY roi) AS expected FROM c),
p AS (SELECT k, e.roi, f.l AS focal, g.l AS neighbour, count(*) AS m FROM e0 e JOIN ks ON e.rank <= k JOIN named f ON e.roi = f.roi AND e.src = f.spx JOIN named g ON e.roi = g.roi AND e.dst = g.spx GROUP BY ALL),
o AS (SELECT *, m / sum(m) OVER (PARTITION BY k, roi, focal) AS observed FROM p)
SELECT k, focal AS category, round(avg(observed / expected), 6) AS enrichment, count(*) AS n_regions FROM o JOIN s ON o.roi = s.roi AND o.focal = s.l WHERE focal = neighbour GROUP BY k, focal""")
def k_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(with_interface(scored(spark, sf_dir)))
    # The edges are found once for the largest k; smaller ones are a filter on the rank.
    by_k = knn(df, max(_K_ROWS)).withColumn("k", F.explode(F.filter(F.array(*map(F.lit, _K_ROWS)), lambda k: F.col("rank") <= k)))
    named = df.select("roi", F.col("spx").alias("id"), "interface")
    rows = neighbours.enrichment(named.withColumn("k", F.explode(F.array(*map(F.lit, _K_ROWS)))), by_k, ["k", "roi"], "interface").filter("focal = neighbour AND observed > 0")
    return rounded(rows.groupBy("k", F.col("focal").alias("category")).agg(F.avg("enrichment").alias("enrichment"), F.count(F.lit(1)).alias("n_regions")))


_ALL_PAIRS = [(a, b) for i, a in enumerate(virtual.MARKERS) for b in virtual.MARKERS[i + 1 :]]


@query(f"""WITH {BASE_SQL}, e AS (SELECT a.roi, a.spx AS src, {', '.join(f'b.{m}' for m in virtual.MARKERS)} FROM ex a JOIN ex b ON a.roi = b.roi AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400)
SELECT roi, src AS id, {', '.join(f"round(coalesce(CASE WHEN count(*) >= 2 THEN covar_samp({a}, {b}) END, 0), 6) AS cov_{a}_{b}" for a, b in _ALL_PAIRS)} FROM e GROUP BY roi, src""")
def local_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(units(spark, sf_dir))
    near = edges.within(points(df), ["roi"], 20.0, include_self=True).select("roi", "src", "dst")
    return rounded(neighbours.local_covariance(df.select("roi", F.col("spx").alias("id"), *virtual.MARKERS), near, ["roi"], _ALL_PAIRS))


_RADII = [10, 20, 30, 40, 50]


@query(f"""WITH {BASE_SQL}, e AS (SELECT * FROM ({_RADIUS}) WHERE d2 <= 2500), n AS (SELECT roi, count(*) AS n FROM ex GROUP BY roi),
s AS (SELECT roi, r AS radius, count(*) AS m, sum(500.0 * 500 / ((500 - ax) * (500 - ay))) AS mw FROM e, (SELECT unnest({_RADII}) AS r) WHERE d2 <= r * r GROUP BY ALL)
SELECT roi, radius::DOUBLE AS radius, round(250000.0 * m / (n * (n - 1)), 6) AS k, round(250000.0 * mw / (n * (n - 1)), 6) AS k_translation, round(sqrt(250000.0 * m / (n * (n - 1)) / pi()) - radius, 6) AS l FROM s JOIN n USING (roi)""")
def ripley_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(points(units(spark, sf_dir)))
    return rounded(neighbours.ripley(df, edges.within(df, ["roi"], 50.0), ["roi"], _RADII, 250_000.0, 500.0))


@query(f"""WITH {BASE_SQL}, t AS (SELECT roi, quantile_cont(cd44, 0.9) AS t FROM ex GROUP BY roi), p AS (SELECT ex.roi, spx, x, y FROM ex JOIN t USING (roi) WHERE cd44 > t.t),
e AS (SELECT a.roi, count(*) AS m FROM p a JOIN p b ON a.roi = b.roi AND a.spx < b.spx AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 625 GROUP BY a.roi)
SELECT p.roi, count(*) AS n_positive, any_value(coalesce(m, 0)) AS n_edges, round(any_value(coalesce(m, 0)) / (count(*) * (count(*) - 1) / 2.0), 6) AS density FROM p LEFT JOIN e ON p.roi = e.roi GROUP BY p.roi""")
def positive_cluster_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positives(units(spark, sf_dir))
    near = edges.within(p, ["roi"], 25.0).filter("src < dst").groupBy("roi").agg(F.count(F.lit(1)).alias("m"))
    n = p.groupBy("roi").agg(F.count(F.lit(1)).alias("n_positive")).join(near, "roi", "left").na.fill(0, ["m"])
    return rounded(n.select("roi", "n_positive", F.col("m").alias("n_edges"), (F.col("m") / (F.col("n_positive") * (F.col("n_positive") - 1) / 2)).alias("density")))


def positives(df: DataFrame) -> DataFrame:
    cut = df.groupBy("roi").agg(F.percentile("cd44", F.lit(0.9)).alias("t"))
    return points(df.join(cut, "roi").filter("cd44 > t"))


@query()
def positive_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of highly activated units: iterative, so without SQL; tests hold it against union-find."""
    p = positives(units(spark, sf_dir))
    return neighbours.label_components(p, edges.within(p, ["roi"], 25.0), ["roi"]).groupBy("roi", "component").agg(F.count(F.lit(1)).alias("size"))


@query("""WITH v AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE))), 9) AS d2 FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT label, src, dst, round(d2, 6) AS d2, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM p QUALIFY rank <= 5""")
def feature_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(edges.vector_knn(v, 5, ["label"]))


@query("""WITH c AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE - list_avg(embedding::DOUBLE[])) AS c FROM embeddings),
u AS (SELECT vec_id, label, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS u FROM c),
p AS (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, round(list_sum(list_transform(list_zip(a.u, b.u), lambda t: t[1] * t[2])), 6) AS r FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT * FROM p WHERE abs(r) >= 0.3""")
def correlation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return edges.correlation_edges(v, ["label"], 0.3)
