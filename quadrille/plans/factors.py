"""Features chosen, markers grouped in modules, density along graphs. Beyond SQL, the tests hold them against plain numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.folders import staged
from quadrille.functions.rounding import tidy
from quadrille.operators import clustering, edges, factors, graph_density, transforms
from quadrille.plans.common import query, rounded, units
from quadrille.sources.virtual import BASE_SQL, MARKERS

BINS, CHOSEN, MODULES = 16, 50, 3
_TOTAL = " + ".join(MARKERS)


@query(f"""WITH {BASE_SQL}, r AS (SELECT {', '.join(f'round({m}, 6) AS {m}' for m in MARKERS)} FROM ex),
t AS (SELECT *, {_TOTAL} AS total FROM r),
l AS (SELECT marker AS feature, value, total FROM (UNPIVOT t ON {', '.join(MARKERS)} INTO NAME marker VALUE value)),
e AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, min(total) OVER w AS tlo, max(total) OVER w AS thi FROM l WINDOW w AS (PARTITION BY feature)),
c AS (SELECT feature, least(floor((value - lo) / (hi - lo) * {BINS}), {BINS - 1}) AS a, least(floor((total - tlo) / (thi - tlo) * {BINS}), {BINS - 1}) AS b, count(*) AS n FROM e GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY feature, a) AS na, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature) AS al FROM c)
SELECT feature, CAST(sum(n) AS BIGINT) AS n, round(sum(n / al * ln(n * al / (na * nb))), 6) AS information FROM s GROUP BY feature""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each marker tells of a unit's whole signal."""
    df = units(spark, sf_dir).select(*(tidy(m).alias(m) for m in MARKERS)).withColumn("total", F.expr(_TOTAL))
    return rounded(factors.mutual_information(df, MARKERS, "total", BINS))


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Units with their markers and all products and ratios of them."""
    df = transforms.coabundance(units(spark, sf_dir).select("roi", "spx", *MARKERS), ["roi"], MARKERS)
    return staged(df, "features"), [c for c in df.columns if c not in ("roi", "spx")]


@query()
def informative_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that tell most of the first principal component."""
    df, names = _features(spark, sf_dir)
    return rounded(factors.most_informative(df, names, CHOSEN, BINS))


@query()
def lasso_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features with the largest coefficients in a sparse sum that follows the first principal component."""
    df, names = _features(spark, sf_dir)
    df = df.withColumn("unit", F.concat_ws("-", "roi", "spx"))
    found = factors.lasso(df, names, "unit").filter("coefficient <> 0")
    return rounded(found.orderBy(F.desc(F.round(F.abs("coefficient"), 9)), "feature").limit(CHOSEN))


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(units(spark, sf_dir).select("roi", "spx", *MARKERS), "markers")


@query()
def marker_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that vary together, by non-negative factors and by independent directions: loadings and members."""
    df = _markers(spark, sf_dir)
    found = {"nonnegative": factors.nonnegative_modules(df, MARKERS, MODULES)[0], "independent": factors.independent_modules(df, MARKERS, MODULES)[0]}
    out = None
    for method, loadings in found.items():
        one = factors.composition(spark, loadings, MARKERS).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 5)


@query()
def module_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's scores in the non-negative modules."""
    df = _markers(spark, sf_dir)
    loadings, low, _ = factors.nonnegative_modules(df, MARKERS, MODULES)
    return rounded(factors.with_scores(df, ["roi", "spx"], MARKERS, lambda x: factors.nonnegative(x - low, loadings), len(loadings)), 5)


#: Units are squares of this side; neighbours in place; how unlike, added up along a path, is still near; units that make one dense.
SCALE, NEAR, REACH, LEAST = 20, 6, 1.25, 8


def likeness_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Units, and edges between neighbours in place whose length is how unlike their markers are."""
    df = staged(units(spark, sf_dir, SCALE).withColumnRenamed("spx", "id").select("roi", "id", *MARKERS, "x", "y"), "units")
    z = staged(clustering.combined(df, ["roi"], MARKERS, ["x", "y"], 0.0).select("roi", "id", F.array(*MARKERS).alias("z")), "alike")
    end = lambda name: z.select("roi", F.col("id").alias(name), F.col("z").alias(f"z_{name}"))
    near = edges.knn(df.select("roi", "id", "x", "y"), ["roi"], NEAR, 4.0 * SCALE).join(end("src"), ["roi", "src"]).join(end("dst"), ["roi", "dst"])
    off = sum((F.pow(F.get("z_src", F.lit(i)) - F.get("z_dst", F.lit(i)), 2) for i in range(len(MARKERS))), F.lit(0.0))
    return df, staged(near.select("roi", "src", "dst", F.round(F.sqrt(off / len(MARKERS)), 6).alias("weight")), "likeness")


@query()
def graph_density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's units in density clusters along the graph of likeness, -1 for noise: sizes and means."""
    df, graph = likeness_graph(spark, sf_dir)
    labels = graph_density.clusters(df, graph, ["roi"], REACH, LEAST)
    return rounded(df.join(labels, ["roi", "id"]).groupBy("roi", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if("dense").alias("n_dense"), *(F.avg(c).alias(c) for c in [*MARKERS, "x", "y"])), 5)
