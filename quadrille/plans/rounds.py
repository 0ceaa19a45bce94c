"""Plans that iterate or resample: without SQL, held against brute force and invariants in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.folders import staged
from quadrille.operators import binning, edges, effects, iterative
from quadrille.plans.common import query, rounded, units
from quadrille.plans.contrasts import subject_clr
from quadrille.plans.space import kept, knn
from quadrille.plans.units import gated
from quadrille.sources import virtual


@query()
def permutation_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(gated(spark, sf_dir).filter("confidence > 0"))
    return iterative.permutation_p(df.select("roi", F.col("spx").alias("id"), "cell_type"), knn(df), "roi", "cell_type", 1000)


@query()
def slic_superpixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = virtual.pixels(spark, sf_dir).groupBy("roi", "x", "y").agg(F.sum(F.col("dna1") + F.col("dna2")).alias("dna"))
    labels = iterative.slic(px, ["roi"], "dna", 20.0, compactness=500.0)
    return labels.groupBy("roi", "label").agg(F.count(F.lit(1)).alias("n_pixels"), F.round(F.avg("x"), 3).alias("x"), F.round(F.avg("y"), 3).alias("y"))


@query()
def seeded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = staged(binning.bin_sums(virtual.pixels(spark, sf_dir), ["roi"], 5, ["dna1"]).select("roi", "bin_x", "bin_y", "dna1"), "raster")
    peaks = iterative.seeds(raster, ["roi"], "dna1", 300.0)
    return iterative.cells_around(raster, peaks, ["roi"], "dna1", 200.0, 4.0).groupBy("roi", "label").agg(F.count(F.lit(1)).alias("n_cells"))


@query()
def community_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(units(spark, sf_dir))
    graph = staged(edges.symmetric(knn(df), ["roi"], 1 / (1 + F.sqrt("d2"))), "graph")
    labels = iterative.communities(graph, ["roi"])
    sizes = labels.groupBy("roi").agg(F.count_distinct("label").alias("n_communities"), F.count(F.lit(1)).alias("n"))
    return rounded(sizes.join(iterative.modularity(graph, labels, ["roi"]), "roi"))


@query()
def bootstrap_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle 95 percent of 10,000 resamples for every contrast."""
    df = staged(subject_clr(spark, sf_dir).select("category", "timepoint", "clr"), "subjects")
    out = None
    for a, b in effects.CONTRASTS:
        one = iterative.bootstrap_range(df, ["category"], "timepoint", "clr", a, b).select("category", F.lit(a).alias("g1"), F.lit(b).alias("g2"), "g", "low", "high")
        out = one if out is None else out.unionByName(one)
    return rounded(out)
