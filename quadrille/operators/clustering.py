"""Clusterings of units by features and place: communities of neighbour graphs, their stability, metrics and ranks.

A region is one field of view, a few thousand units: its graph is what one task clusters. Regions, resolutions and resamples
are rows that Spark deals out.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.operators import neighbours


def adaptive_k(n: Column) -> Column:
    """Neighbours of a graph of n units: twice the logarithm, between 8 and 15."""
    return F.greatest(F.lit(8), F.least(F.lit(15), F.floor(2 * F.log(n)).cast("int")))


def combined(df: DataFrame, keys: list[str], values: list[str], place: list[str], weight: float = 0.3) -> DataFrame:
    """Standardised values weighted by 1 - weight and standardised places weighted by it, within each key."""
    from quadrille.operators.transforms import zscores

    z = zscores(df, keys, [*values, *place])
    return z.withColumns({**{v: F.col(v) * (1 - weight) for v in values}, **{p: F.col(p) * weight for p in place}})


def nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, weight) to the k nearest rows, in either direction, each once; weight falls with distance."""
    k = min(k, len(x) - 1)
    if k < 1:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    square = (x * x).sum(axis=1)
    near = np.empty((len(x), k), int)
    for at in range(0, len(x), 512):
        d = square[at : at + 512, None] + square[None, :] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near[at : at + 512] = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :k]
    a, b = np.repeat(np.arange(len(x)), k), near.ravel()
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    distance = np.sqrt(((x[pairs[:, 0]] - x[pairs[:, 1]]) ** 2).sum(axis=1))
    return pairs[:, 0], pairs[:, 1], 1 / (1 + distance)


def _moved(near: list[dict[int, float]], degree: np.ndarray, label: np.ndarray, resolution: float, rng: np.random.Generator) -> np.ndarray:
    """Labels 0.. after nodes have moved to the community around them that gains most, until none gains."""
    size, total = len(degree), degree.sum()
    label, weight = label.copy(), np.bincount(label, degree, size)
    changed = total > 0
    while changed:
        changed = False
        for i in rng.permutation(size):
            own = label[i]
            weight[own] -= degree[i]
            links: dict[int, float] = {}
            for j, x in near[i].items():
                links[label[j]] = links.get(label[j], 0.0) + x
            gain = lambda c: links.get(c, 0.0) - resolution * degree[i] * weight[c] / total  # noqa: B023, E731
            best = max(links, key=lambda c: (gain(c), -c), default=own)
            if gain(best) <= gain(own) + 1e-12:
                best = own
            label[i] = best
            weight[best] += degree[i]
            changed |= best != own
    return np.unique(label, return_inverse=True)[1]


def _refined(near: list[dict[int, float]], degree: np.ndarray, label: np.ndarray, resolution: float, rng: np.random.Generator) -> np.ndarray:
    """Parts 0.. of the communities: nodes that are still alone join the part of their community around them that gains most.

    Only nodes and parts join that are held well enough by the rest of their community. A part only grows along edges, so that it is connected.
    """
    size, total = len(degree), degree.sum()
    part, weight, members = np.arange(size), degree.astype(float).copy(), np.ones(size, int)
    whole = np.bincount(label, degree)
    held = np.array([sum(x for j, x in near[i].items() if label[j] == label[i]) for i in range(size)])  # edges of a part to the rest of its community
    firm = lambda p, c: held[p] >= resolution * weight[p] * (whole[c] - weight[p]) / total - 1e-12
    for i in rng.permutation(size) if total > 0 else ():
        if members[part[i]] > 1 or not firm(part[i], label[i]):
            continue
        links: dict[int, float] = {}
        for j, x in near[i].items():
            if label[j] == label[i]:
                links[part[j]] = links.get(part[j], 0.0) + x
        gains = {p: x - resolution * degree[i] * weight[p] / total for p, x in links.items() if p != part[i] and firm(p, label[i])}
        best = max(gains, key=lambda p: (gains[p], -p), default=None)  # noqa: B023
        if best is None or gains[best] <= 1e-12:
            continue
        held[best] += held[part[i]] - 2 * links[best]
        weight[best] += degree[i]
        members[best] += 1
        members[part[i]] = 0
        part[i] = best
    return np.unique(part, return_inverse=True)[1]


def _parted(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of the connected parts of communities: apart they are never less modular."""
    inside = label[a] == label[b]
    low = np.arange(len(label))
    while True:
        now = low.copy()
        np.minimum.at(now, a[inside], low[b[inside]])
        np.minimum.at(now, b[inside], low[a[inside]])
        now = now[now]
        if (now == low).all():
            return np.unique(low, return_inverse=True)[1]
        low = now


def modular_communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, rng: np.random.Generator) -> np.ndarray:
    """Labels 0.. by size of communities that raise modularity, each of them connected.

    Nodes move while that gains; within each community they are then joined anew to connected parts, and the parts become the nodes of
    the next round, which begins with the communities of this one. It ends when every community is one part.
    """
    if not n:
        return np.empty(0, int)
    member = start = np.arange(n)
    while True:
        size = len(start)
        loops, near = np.zeros(size), [{} for _ in range(size)]
        for i, j, x in zip(member[a], member[b], w):
            if i == j:
                loops[i] += 2 * x
            else:
                near[i][j] = near[i].get(j, 0.0) + x
                near[j][i] = near[j].get(i, 0.0) + x
        degree = np.array([sum(e.values()) for e in near]) + loops
        label = _moved(near, degree, start, resolution, rng)
        part = _refined(near, degree, label, resolution, rng)
        if part.max() + 1 == size:
            found = _parted(label[member], a, b)
            order = np.argsort(-np.bincount(found), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            return rank[found]
        start = np.zeros(part.max() + 1, int)
        start[part] = label
        member = part[member]


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index."""
    table = np.unique(np.stack([a, b], axis=1), axis=0, return_counts=True)[1].astype(float)
    pairs = lambda c: (c * (c - 1) / 2).sum()
    ij, i, j, all_ = pairs(table), pairs(np.bincount(a).astype(float)), pairs(np.bincount(b).astype(float)), len(a) * (len(a) - 1) / 2
    expected = i * j / all_ if all_ else 0.0
    return float((ij - expected) / ((i + j) / 2 - expected)) if (i + j) / 2 != expected else 1.0


def seeded(*parts: object) -> np.random.Generator:
    """A generator that is the same wherever the group is worked on."""
    return np.random.default_rng(int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16))


def communities(df: DataFrame, key: str, values: list[str], resolution: float = 1.0, k: int | None = None, seed: int = 42) -> DataFrame:
    """(key, id, label) of each key's rows by modular communities of their nearest-neighbour graph. df: (key, id, values)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        n = len(pdf)
        around = k or max(8, min(15, int(2 * math.log(max(2, n)))))
        labels = modular_communities(n, *nearest(pdf[values].to_numpy(float), around), resolution, seeded(seed, pdf[key].iloc[0]))
        return pd.DataFrame({key: pdf[key].to_numpy(), "id": pdf["id"].to_numpy(), "label": labels.astype(np.int64)})

    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.select(key, "id", *values).groupBy(key).applyInPandas(run, f"{key} {kind(key)}, id {kind('id')}, label bigint")


def stability(df: DataFrame, key: str, values: list[str], resolutions: list[float], draws: int = 5, share: float = 0.9, k: int = 15, seed: int = 42) -> DataFrame:
    """(key, resolution, stability, mean_n_clusters): mean agreement of communities between resamples of a share of the rows.

    Each key and resolution is a group of its own; a resample clusters the graph that all rows' graph induces on it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        n, resolution = len(pdf), float(pdf["resolution"].iloc[0])
        a, b, w = nearest(pdf[values].to_numpy(float), k)
        found = []
        for draw in range(draws):
            rng = seeded(seed, pdf[key].iloc[0], resolution, draw)
            rows = np.sort(rng.choice(n, max(1, int(n * share)), replace=False))
            at = np.full(n, -1)
            at[rows] = np.arange(len(rows))
            inside = (at[a] >= 0) & (at[b] >= 0)
            found.append((rows, modular_communities(len(rows), at[a[inside]], at[b[inside]], w[inside], resolution, rng)))
        scores = []
        for i in range(draws):
            for j in range(i + 1, draws):
                both, x, y = np.intersect1d(found[i][0], found[j][0], return_indices=True)
                if len(both) >= 10:
                    scores.append(agreement(found[i][1][x], found[j][1][y]))
        return pd.DataFrame([{key: pdf[key].iloc[0], "resolution": resolution, "stability": float(np.mean(scores)) if scores else 0.0, "mean_n_clusters": float(np.mean([lab.max() + 1 for _, lab in found]))}])

    rows = df.select(key, "id", *values, F.explode(F.array(*map(F.lit, resolutions))).alias("resolution"))
    return rows.groupBy(key, "resolution").applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, resolution double, stability double, mean_n_clusters double")


def plateaus(scores: DataFrame, keys: list[str], least: float = 0.6, step: float = 0.05) -> DataFrame:
    """Adds acceptable (at least `least`) and plateau (acceptable, and both neighbours, where there are any, within a step)."""
    w = Window.partitionBy(*keys).orderBy("resolution")
    near = lambda other: other.isNull() | (F.abs(F.col("stability") - other) < step)
    ok = F.col("stability") >= least
    return scores.withColumns({"acceptable": ok, "plateau": ok & near(F.lag("stability").over(w)) & near(F.lead("stability").over(w))})


def chosen_resolution(scores: DataFrame, keys: list[str], least: float = 0.6, prefer_more: bool = False) -> DataFrame:
    """(keys, resolution, stability): the best plateau, else the best acceptable, else the best; the first of equals. prefer_more: of plateaus that with most clusters."""
    tier = F.when(F.col("plateau"), 2).when(F.col("acceptable"), 1).otherwise(0)
    first = F.when(F.col("plateau") & F.lit(prefer_more), F.col("mean_n_clusters")).otherwise(F.col("stability"))
    place = Window.partitionBy(*keys).orderBy(tier.desc(), first.desc(), "resolution")
    return plateaus(scores, keys, least).withColumn("_r", F.row_number().over(place)).filter("_r = 1").select(*keys, "resolution", "stability")


def graph_metrics(edges: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_nodes, n_edges, density, mean_conductance): of a labelled graph (src, dst, weight) given in both directions."""
    a = labels.select(*keys, F.col("id").alias("src"), F.col("label").alias("la"))
    b = labels.select(*keys, F.col("id").alias("dst"), F.col("label").alias("lb"))
    both = edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"])
    whole = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))
    nodes = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"))
    inside = both.groupBy(*keys, "la").agg((F.sum((F.col("la") == F.col("lb")).cast("int")) / 2).alias("i"), F.sum("weight").alias("d"))
    sizes = labels.groupBy(*keys, F.col("label").alias("la")).agg(F.count(F.lit(1)).alias("_n"))
    c = inside.join(sizes, [*keys, "la"]).filter("_n > 1").join(whole, keys)
    external = F.col("d") - 2 * F.col("i")
    low = F.least(F.col("i") + external, F.col("n_edges") / 2 - F.col("i"))
    conductance = F.when(F.col("i") + external > 0, external / F.when(low != 0, low)).otherwise(1.0)
    means = c.groupBy(*keys).agg(F.avg(conductance).alias("mean_conductance"))
    return whole.join(nodes, keys).join(means, keys, "left").select(*keys, "n_nodes", "n_edges", (F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).alias("density"), "mean_conductance")


def ranked(scores: DataFrame, method: str, metrics: list[str]) -> DataFrame:
    """(method, rank_<metric>, composite, place): ranks by each metric, larger first, nulls without rank; composite: their mean, smaller is better."""
    ranks = {f"rank_{m}": F.when(F.col(m).isNotNull(), F.row_number().over(Window.orderBy(F.col(m).desc_nulls_last(), method))) for m in metrics}  # a row a method
    r = scores.withColumns(ranks)
    n = reduce(add, (F.col(c).isNotNull().cast("int") for c in ranks))
    composite = reduce(add, (F.coalesce(F.col(c), F.lit(0)) for c in ranks)) / F.when(n > 0, n)
    return r.withColumn("composite", composite).withColumn("place", F.row_number().over(Window.orderBy(F.col("composite").asc_nulls_last(), method))).select(method, *ranks, "composite", "place")


def density_clusters(points: DataFrame, near: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, id, label): clusters of points with at least `least` others within reach, named by their smallest such point.

    Other points take the smallest cluster within reach, or -1. near: (keys, src, dst) of points within reach, both directions.
    """
    dense = near.groupBy(*keys, F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*keys, "id")
    between = near.join(dense.withColumnRenamed("id", "src"), [*keys, "src"], "left_semi").join(dense.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_semi")
    cores = neighbours.label_components(dense, between, keys)
    reach = near.join(cores.select(*keys, F.col("id").alias("dst"), "component"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("id")).agg(F.min("component").alias("_reach"))
    return points.select(*keys, "id").join(cores, [*keys, "id"], "left").join(reach, [*keys, "id"], "left").select(*keys, "id", F.coalesce("component", "_reach", F.lit(-1)).alias("label"))


def coherence(labels: DataFrame, nearest_edges: DataFrame, within, keys: list[str]) -> DataFrame:
    """(keys, coherence): Moran's I of numeric labels, weights one over distance, up to three times the 95th percentile of nearest distances.

    labels: (keys, id, x, y, label). within(points, reach): pairs of points within the largest reach of any key.
    """
    reach = nearest_edges.groupBy(*keys).agg((F.percentile(F.sqrt("d2"), F.lit(0.95)) * 3).alias("_reach"))
    most = reach.agg(F.max("_reach")).first()[0] or 1.0
    pairs = within(labels.select(*keys, "id", "x", "y"), most).join(reach, keys).filter(F.sqrt("d2") <= F.col("_reach"))
    weighted = pairs.select(*keys, "src", "dst", (1 / (F.sqrt("d2") + 1e-6)).alias("w"))
    made = neighbours.morans_i(labels.select(*keys, "id", F.col("label").cast("double").alias("label")), weighted, keys, ["label"])
    return made.select(*keys, F.coalesce("i_label", F.lit(0.0)).alias("coherence"))
