"""Clusterings compared as clusterings: by density, by modularity, by distance. Held against plain Python in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.folders import staged
from quadrille.operators import clustering, density_tree, edges, spectral
from quadrille.plans.common import query, rounded, units
from quadrille.sources.virtual import MARKERS

#: Units are squares of this side, so that a region holds hundreds; units that make a cluster.
SCALE, LEAST = 20, 15
_VALUES = [*MARKERS, "x", "y"]


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = units(spark, sf_dir, SCALE).withColumnRenamed("spx", "id").select("roi", "id", *_VALUES)
    return staged(clustering.combined(df, ["roi"], MARKERS, ["x", "y"]), "features")


def _labelled(f: DataFrame) -> DataFrame:
    """(method, roi, id, label) by each clustering."""
    found = {"communities": clustering.communities(f, "roi", _VALUES), "density": density_tree.hierarchical(f, "roi", _VALUES, LEAST)}
    out = None
    for name, labels in found.items():
        one = labels.select(F.lit(name).alias("method"), "roi", "id", "label")
        out = one if out is None else out.unionByName(one)
    return staged(out, "labels")


@query()
def hierarchical_density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of each region's units by how long they stay dense, -1 for noise: sizes and places."""
    f = _features(spark, sf_dir)
    labels = density_tree.hierarchical(f, "roi", _VALUES, LEAST)
    return rounded(f.join(labels, ["roi", "id"]).groupBy("roi", "label").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in _VALUES)), 5)


@query()
def clustering_silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each clustering tells each region's units apart."""
    f = _features(spark, sf_dir)
    return rounded(density_tree.silhouettes(_labelled(f).join(f, ["roi", "id"]), ["method", "roi"], _VALUES))


@query()
def clustering_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusterings by their mean silhouette and by the share of units that they place, and their ranks."""
    f = _features(spark, sf_dir)
    scores = density_tree.silhouettes(_labelled(f).join(f, ["roi", "id"]), ["method", "roi"], _VALUES)
    means = staged(scores.groupBy("method").agg(F.avg("silhouette").alias("silhouette"), (1 - F.sum("n_noise") / F.sum("n")).alias("placed"), F.avg("n_clusters").alias("mean_clusters")), "method-means")
    return rounded(means.join(clustering.ranked(means, "method", ["silhouette", "placed"]), "method"))


#: Neighbours in place that make the graph, groups a region.
NEAR, GROUPS = 10, 4


@query()
def spectral_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's units in groups by the leading vectors of a graph of neighbours in place, weighted by how alike their markers are: sizes and means."""
    df = staged(units(spark, sf_dir, SCALE).withColumnRenamed("spx", "id").select("roi", "id", *_VALUES), "units")
    z = staged(clustering.combined(df, ["roi"], MARKERS, ["x", "y"], 0.0).select("roi", "id", F.array(*MARKERS).alias("z")), "alike")
    end = lambda name: z.select("roi", F.col("id").alias(name), F.col("z").alias(f"z_{name}"))
    near = edges.knn(df.select("roi", "id", "x", "y"), ["roi"], NEAR, 4.0 * SCALE).join(end("src"), ["roi", "src"]).join(end("dst"), ["roi", "dst"])
    off = sum((F.pow(F.get("z_src", F.lit(i)) - F.get("z_dst", F.lit(i)), 2) for i in range(len(MARKERS))), F.lit(0.0))
    graph = edges.symmetric(near, ["roi"], F.exp(-off / (2 * len(MARKERS))))
    labels, _ = spectral.clusters(graph, ["roi"], GROUPS)
    return rounded(df.join(labels, ["roi", "id"]).groupBy("roi", "label").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in _VALUES)), 5)
