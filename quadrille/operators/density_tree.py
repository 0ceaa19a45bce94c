"""Hierarchical density clustering of each region's units, and the silhouette that labellings are compared by.

A region is one field of view, a few thousand units: its tree is what one task makes. Memory grows with the units, not with their pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows of distances made at once; distances are rounded to so many digits, so that equal ones tie; the least one.
ROWS, DIGITS, LEAST = 256, 9, 1e-9


def _distances(x: np.ndarray, rows: slice) -> np.ndarray:
    return np.round(np.sqrt(((x[rows, None, :] - x[None, :, :]) ** 2).sum(axis=2)), DIGITS)


def core_distances(x: np.ndarray, samples: int) -> np.ndarray:
    """How far each row's `samples`-th nearest is, itself counted."""
    k = min(samples, len(x)) - 1
    return np.concatenate([np.partition(_distances(x, slice(at, at + ROWS)), k, axis=1)[:, k] for at in range(0, len(x), ROWS)])


def spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, reach) of a least tree of mutual reachability: the largest of a distance and both ends' core distances."""
    n = len(x)
    best, source, out = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    ends = np.zeros((2, max(n - 1, 0)), int)
    reach = np.zeros(max(n - 1, 0))
    now = 0
    for step in range(n - 1):
        out[now] = True
        d = np.maximum(np.maximum(_distances(x, slice(now, now + 1))[0], core), core[now])
        nearer = ~out & (d < best)
        best[nearer], source[nearer] = d[nearer], now
        now = int(np.argmin(np.where(out, np.inf, best)))
        ends[:, step], reach[step] = (source[now], now), best[now]
    return ends[0], ends[1], reach


def merges(a: np.ndarray, b: np.ndarray, reach: np.ndarray, n: int) -> tuple[list[list[int]], list[float]]:
    """The tree of joined parts, leaves first: children and reach of each node; parts that join at one reach are children of one node."""
    top, children, height, parent = list(range(n)), [[] for _ in range(n)], [0.0] * n, list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = np.argsort(reach, kind="stable")
    for same in np.split(order, np.nonzero(np.diff(reach[order]))[0] + 1) if len(order) else []:
        before = {find(int(i)) for e in same for i in (a[e], b[e])}
        for e in same:
            parent[find(int(b[e]))] = find(int(a[e]))
        joined: dict[int, list[int]] = {}
        for part in sorted(before):
            joined.setdefault(find(part), []).append(top[part])
        for root, parts in joined.items():
            top[root] = len(children)
            children.append(parts)
            height.append(float(reach[same[0]]))
    return children, height


def stable_clusters(children: list[list[int]], height: list[float], n: int, least: int) -> np.ndarray:
    """A label for each leaf, -1 for none: the most stable clusters of at least `least` leaves, of which none holds another. The root is none.

    Going down, a part splits where at least two of its parts are large enough; smaller ones fall off it. Its stability is the sum over its leaves
    of how much longer they stay, in one over reach. Labels are in order of the clusters' first leaves.
    """
    if n == 0:
        return np.empty(0, int)
    size = [1] * n + [0] * (len(children) - n)
    for node in range(n, len(children)):
        size[node] = sum(size[c] for c in children[node])
    born, up, stability, fell = [0.0], [-1], [0.0], np.zeros(n, int)
    waiting = [(len(children) - 1, 0)]
    while waiting:
        node, cluster = waiting.pop()
        if node < n:
            fell[node] = cluster
            continue
        density = 1 / max(height[node], LEAST)
        large = [c for c in children[node] if size[c] >= least]
        for child in children[node]:
            if size[child] >= least and len(large) == 1:
                waiting.append((child, cluster))
                continue
            stability[cluster] += size[child] * (density - born[cluster])
            if size[child] >= least:
                born.append(density)
                up.append(cluster)
                stability.append(0.0)
                waiting.append((child, len(born) - 1))
            else:
                rest = [child]
                while rest:
                    one = rest.pop()
                    if one < n:
                        fell[one] = cluster
                    else:
                        rest += children[one]
    below, chosen = [0.0] * len(born), [False] * len(born)
    for c in range(len(born) - 1, 0, -1):  # those inside others come after them
        chosen[c] = round(stability[c], 6) >= round(below[c], 6)
        below[up[c]] += max(stability[c], below[c])
    of = [-1] * len(born)
    for c in range(1, len(born)):
        of[c] = of[up[c]] if of[up[c]] >= 0 else c if chosen[c] else -1
    found = np.array([of[c] for c in fell])
    names: dict[int, int] = {}
    for c in found:
        if c >= 0:
            names.setdefault(int(c), len(names))
    return np.array([names.get(int(c), -1) for c in found])


def density_labels(x: np.ndarray, least: int, samples: int) -> np.ndarray:
    tree = spanning_tree(x, core_distances(x, samples)) if len(x) else (np.empty(0, int), np.empty(0, int), np.empty(0))
    return stable_clusters(*merges(*tree, len(x)), len(x), least)


def hierarchical(df: DataFrame, key: str, values: list[str], least: int, samples: int | None = None) -> DataFrame:
    """(key, id, label) of each key's rows by hierarchical density clustering, -1 for noise. samples: half of `least` unless given."""
    around = samples or max(1, least // 2)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        labels = density_labels(pdf[values].to_numpy(float), least, around)
        return pd.DataFrame({key: pdf[key].to_numpy(), "id": pdf["id"].to_numpy(), "label": labels.astype(np.int64)})

    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.select(key, "id", *values).groupBy(key).applyInPandas(run, f"{key} {kind(key)}, id {kind('id')}, label bigint")


def silhouette_of(x: np.ndarray, label: np.ndarray) -> float | None:
    """The mean over rows of how much nearer their own cluster is than the next; None unless there are two clusters and fewer than rows. A lone row counts 0."""
    names, code = np.unique(label, return_inverse=True)
    if not 2 <= len(names) < len(x):
        return None
    one = np.eye(len(names))[code]
    n, total = one.sum(axis=0), 0.0
    for at in range(0, len(x), ROWS):
        own = code[at : at + ROWS]
        sums = np.sqrt(((x[at : at + ROWS, None, :] - x[None, :, :]) ** 2).sum(axis=2)) @ one
        rows = np.arange(len(own))
        inside = sums[rows, own] / np.maximum(n[own] - 1, 1)
        means = sums / n
        means[rows, own] = np.inf
        outside = means.min(axis=1)
        both = np.maximum(inside, outside)
        total += np.where((n[own] > 1) & (both > 0), (outside - inside) / np.where(both > 0, both, 1), 0.0).sum()
    return float(total / len(x))


def silhouettes(df: DataFrame, keys: list[str], values: list[str], label: str = "label") -> DataFrame:
    """(keys, n, n_clusters, n_noise, silhouette) of labelled rows; rows of label -1 are noise and not judged."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = pdf[pdf[label] >= 0]
        row = {**{k: pdf[k].iloc[0] for k in keys}, "n": len(pdf), "n_clusters": kept[label].nunique(), "n_noise": len(pdf) - len(kept), "silhouette": silhouette_of(kept[values].to_numpy(float), kept[label].to_numpy())}
        return pd.DataFrame([row])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, label, *values).groupBy(*keys).applyInPandas(run, f"{schema}, n bigint, n_clusters bigint, n_noise bigint, silhouette double")
