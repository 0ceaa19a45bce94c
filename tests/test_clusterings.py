"""Hierarchical density clusters and silhouettes against plain Python; communities are connected."""

import numpy as np
import pytest

from quadrille.operators import clustering, density_tree


def parts(near):
    """Components of a graph given as a matrix, as frozensets of nodes."""
    left, out = set(range(len(near))), []
    while left:
        part, edge = set(), {left.pop()}
        while edge:
            i = edge.pop()
            part.add(i)
            edge |= {j for j in np.nonzero(near[i])[0] if j not in part}
        left -= part
        out.append(frozenset(part))
    return out


def by_thresholds(x, least, samples):
    """The same clusters from the components at every distance, without a tree of merges."""
    n = len(x)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    core = np.sort(d, axis=1)[:, samples - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    levels = sorted({v for v in reach[~np.eye(n, dtype=bool)]})

    def grow(members, level, born):
        """(stability, label sets) of the cluster that these members are just below levels[level]."""
        here, stability = set(members), 0.0
        for at in range(level, -1, -1):
            density = 1 / max(levels[at], 1e-9)
            below = levels[at - 1] if at else -1.0
            idx = sorted(here)
            found = [frozenset(idx[i] for i in p) for p in parts((reach[np.ix_(idx, idx)] <= below) & ~np.eye(len(idx), dtype=bool))]
            large = [p for p in found if len(p) >= least]
            if len(large) != 1:
                stability += len(here) * (density - born)
                return stability, [(p, at - 1, density) for p in large] if len(large) > 1 else []
            stability += (len(here) - len(large[0])) * (density - born)
            here = set(large[0])
        raise AssertionError

    def choose(members, level, born, root=False):
        stability, kids = grow(members, level, born)
        below = [choose(*k) for k in kids]
        total = sum(s for s, _ in below)
        if not root and round(stability, 6) >= round(total, 6):
            return stability, [frozenset(members)]
        return max(stability, total), [c for _, cs in below for c in cs]

    clusters = choose(frozenset(range(n)), len(levels) - 1, 0.0, True)[1]
    label = np.full(n, -1)
    for k, c in enumerate(sorted(clusters, key=min)):
        label[sorted(c)] = k
    return label


@pytest.mark.parametrize("seed, least, samples", [(0, 5, 3), (1, 8, 4), (2, 4, 1), (3, 6, 6)])
def test_density_tree_against_thresholds(seed, least, samples):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (m, 2)) for c, s, m in ((0, 0.3, 30), (3, 0.5, 25), (6, 0.2, 20), (3, 3, 20))])
    if seed == 2:
        x = x.round(1)  # many ties
    got = density_tree.density_labels(x, least, samples)
    assert (got == by_thresholds(x, least, samples)).all()
    assert got.max() >= 1


def test_density_clusters_by_region(spark):
    rng = np.random.default_rng(7)
    rows = [(r, i, float(a), float(b)) for r in (1, 2) for i, (a, b) in enumerate(np.concatenate([rng.normal(0, 0.2, (20, 2)), rng.normal(4, 0.2, (20, 2)), [[50.0, 50.0]]]))] + [(3, 0, 1.0, 1.0)]
    got = density_tree.hierarchical(spark.createDataFrame(rows, "roi int, id int, a double, b double"), "roi", ["a", "b"], 6).collect()
    for r in got:
        assert r["label"] == (-1 if r["id"] == 40 or r["roi"] == 3 else r["id"] // 20)
    assert density_tree.hierarchical(spark.createDataFrame([], "roi int, id int, a double, b double"), "roi", ["a", "b"], 6).count() == 0


def test_silhouettes(spark):
    rng = np.random.default_rng(8)
    x, label = rng.normal(size=(40, 3)), np.array([i % 4 - 1 for i in range(40)])
    label[5] = 9  # a cluster of one
    want, kept = [], np.nonzero(label >= 0)[0]
    for i in kept:
        mean = {c: np.mean([np.linalg.norm(x[i] - x[j]) for j in kept if label[j] == c and j != i]) for c in set(label[kept]) if any(label[j] == c and j != i for j in kept)}
        own = mean.pop(label[i], None)
        want.append(0.0 if own is None else (min(mean.values()) - own) / max(own, min(mean.values())))
    df = spark.createDataFrame([(1, int(c), *map(float, v)) for c, v in zip(label, x)] + [(2, 0, 1.0, 1.0, 1.0)], "roi int, label int, a double, b double, c double")
    got = {r["roi"]: r for r in density_tree.silhouettes(df, ["roi"], ["a", "b", "c"]).collect()}
    assert got[1]["silhouette"] == pytest.approx(np.mean(want)) and (got[1]["n"], got[1]["n_clusters"], got[1]["n_noise"]) == (40, 4, int((label < 0).sum()))
    assert got[2]["silhouette"] is None


def modularity(a, b, w, label, n):
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    inside = w[label[a] == label[b]].sum() * 2
    return inside / degree.sum() - (np.bincount(label, degree) ** 2).sum() / degree.sum() ** 2


@pytest.mark.parametrize("seed", range(6))
def test_communities_are_connected(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 1.2, (40, 2)) for c in (0, 3, 6)])
    a, b, w = clustering.nearest(x, 6)
    for resolution in (0.5, 1.0, 2.0):
        label = clustering.modular_communities(len(x), a, b, w, resolution, clustering.seeded("t", seed))
        assert sorted(np.bincount(label), reverse=True) == list(np.bincount(label))
        for c in range(label.max() + 1):
            members = np.nonzero(label == c)[0]
            near = np.zeros((len(x), len(x)), bool)
            near[a, b] = near[b, a] = True
            assert len(parts(near[np.ix_(members, members)])) == 1
        if resolution == 1.0:
            assert modularity(a, b, w, label, len(x)) > 0.55


def test_a_bridge_does_not_hold_two_halves_together():
    """Two cliques that only met through a node which has moved on are two communities."""
    clique = lambda at: [(at + i, at + j) for i in range(5) for j in range(i)]
    edges = np.array(clique(0) + clique(5) + clique(10) + [(4, 10), (9, 10)])
    label = clustering.modular_communities(15, edges[:, 0], edges[:, 1], np.ones(len(edges)), 1.0, clustering.seeded(1))
    assert [len(set(label[i : i + 5])) for i in (0, 5, 10)] == [1, 1, 1] and len(set(label)) == 3
