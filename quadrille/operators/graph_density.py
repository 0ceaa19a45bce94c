"""Density clusters along a graph: near is what the shortest path says, not the plane.

No table of all pairs within reach is made. Whether a node is dense is told by the few nodes nearest to it; which dense
nodes belong together is told by the edges between the parts of the graph that are nearest to each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.folders import staged
from quadrille.operators.neighbours import label_components


def _edges(graph: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """The shortest edge of each two nodes, both ways; those without positive length, or beyond reach, are none."""
    both = graph.select(*keys, "src", "dst", "weight").unionByName(graph.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    real = both.filter((F.col("weight") > 0) & (F.col("weight") <= reach) & (F.col("src") != F.col("dst")))
    return staged(real.groupBy(*keys, "src", "dst").agg(F.min("weight").alias("weight")), "graph-edges")


def _length(*parts: str):
    """A path's length, rounded so that its order of summing does not matter at the edge of reach."""
    return F.round(sum((F.col(p) for p in parts), F.lit(0.0)), 9)


def nearest_along(nodes: DataFrame, links: DataFrame, keys: list[str], m: int, reach: float) -> DataFrame:
    """(keys, src, dst, d): the m nodes nearest to each by shortest path, itself first, none beyond reach; ties by id.

    links: both ways, a row an edge. Who is among the m nearest of a node is also among the m nearest of the first node on the way there,
    so that lists of m are enough, and m - 1 rounds at most.
    """
    rank = F.row_number().over(Window.partitionBy(*keys, "src").orderBy("d", "dst"))
    now = staged(nodes.select(*keys, F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d")), "nearest-along")
    for _ in range(m - 1):
        onward = now.select(*keys, F.col("src").alias("via"), "dst", F.col("d").alias("_d"))
        longer = links.withColumnRenamed("dst", "via").join(onward, [*keys, "via"]).select(*keys, "src", "dst", _length("weight", "_d").alias("d")).filter(F.col("d") <= reach)
        best = now.unionByName(longer).groupBy(*keys, "src", "dst").agg(F.min("d").alias("d"))
        then = staged(best.withColumn("_r", rank).filter(F.col("_r") <= m).drop("_r"), "nearest-along")
        if then.join(now, [*keys, "src", "dst", "d"], "left_anti").isEmpty():
            return then
        now = then
    return now


def nearest_of(sources: DataFrame, links: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """(keys, id, source, d): the source nearest to each node by shortest path within reach; ties by the source's id."""
    now = staged(sources.select(*keys, "id", F.col("id").alias("source"), F.lit(0.0).alias("d")), "nearest-of")
    new = now
    while True:
        step = new.withColumnRenamed("id", "src").join(links, [*keys, "src"]).select(*keys, F.col("dst").alias("id"), "source", _length("d", "weight").alias("d")).filter(F.col("d") <= reach)
        best = now.unionByName(step).groupBy(*keys, "id").agg(F.min(F.struct("d", "source")).alias("m"))
        then = staged(best.select(*keys, "id", F.col("m.source").alias("source"), F.col("m.d").alias("d")), "nearest-of")
        new = staged(then.join(now, [*keys, "id", "source", "d"], "left_anti"), "nearer")  # only these can bring anything nearer
        if new.isEmpty():
            return then
        now = then


def clusters(nodes: DataFrame, graph: DataFrame, keys: list[str], reach: float, least: int) -> DataFrame:
    """(keys, id, label, dense): density clusters of nodes (id) over the edges (src, dst, weight as length) of an undirected graph.

    A node is dense if at least `least` nodes, itself counted, lie within reach along the graph. Dense nodes within reach of each other
    share a cluster, named by its smallest dense node; others join the cluster of the dense node nearest to them
    (ties: the smaller id) if that is within reach, or get -1. Nodes without edges, and those of no graph at all, are handled
    alike: dense only if `least` is 1. An edge given twice counts at its shorter length; edges of null, zero or negative length are none.

    If two dense nodes are within reach, a chain of dense nodes joins them whose neighbours meet at an edge between the parts nearest
    to each, over a path no longer than theirs: what those edges connect is what all pairs would.
    """
    ids = staged(nodes.select(*keys, "id").distinct(), "graph-nodes")
    links = _edges(graph, keys, reach)
    dense = nearest_along(ids, links, keys, least, reach).groupBy(*keys, F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(*keys, "id")
    part = nearest_of(dense, links, keys, reach)
    end = lambda name: part.select(*keys, F.col("id").alias(name), F.col("source").alias(f"_{name}"), F.col("d").alias(f"d_{name}"))
    meet = links.join(end("src"), [*keys, "src"]).join(end("dst"), [*keys, "dst"]).filter((F.col("_src") != F.col("_dst")) & (_length("d_src", "weight", "d_dst") <= reach))
    joined = meet.select(*keys, F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()
    names = label_components(part.filter("id = source").select(*keys, "id"), joined, keys).select(*keys, F.col("id").alias("source"), F.col("component").alias("label"))
    found = part.join(names, [*keys, "source"]).select(*keys, "id", "label", (F.col("id") == F.col("source")).alias("dense"))
    return ids.join(found, [*keys, "id"], "left").select(*keys, "id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("dense", F.lit(False)).alias("dense"))
