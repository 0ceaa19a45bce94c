"""Leading vectors against numpy, groups against known blocks and plain Python."""

import numpy as np
import pytest

from quadrille.operators import spectral

GRAPH = "roi int, src int, dst int, weight double"


def blocks(seed, sizes, inside=0.6, between=0.02):
    rng = np.random.default_rng(seed)
    label = np.repeat(np.arange(len(sizes)), sizes)
    n = len(label)
    w = np.where(rng.random((n, n)) < np.where(label[:, None] == label[None], inside, between), rng.uniform(0.5, 1.5, (n, n)), 0.0)
    w = np.triu(w, 1)
    return w + w.T, label


def rows(roi, w):
    return [(roi, int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))]


def by_numpy(w, k):
    d = w.sum(axis=1)
    return np.sort(np.linalg.eigvalsh(w / np.sqrt(np.outer(d, d))))[::-1][:k]


def test_values_vectors_and_known_blocks(spark):
    graphs = {1: blocks(1, [30, 22, 14]), 2: blocks(2, [25, 25, 12]), 3: blocks(3, [20, 16, 12], between=0.0)}  # the last falls into three parts
    df = spark.createDataFrame([r for roi, (w, _) in graphs.items() for r in rows(roi, w)], GRAPH)
    vectors, values = spectral.leading(df, ["roi"], 3)
    labels = spectral.grouped(vectors, ["roi"], 3)
    got, said = {}, {}
    for r in values.collect():
        got.setdefault(r["roi"], {})[r["place"]] = r["value"]
    for r in vectors.collect():
        said.setdefault(r["roi"], {})[r["id"]] = [r["x0"], r["x1"], r["x2"]]
    for roi, (w, _) in graphs.items():
        want = by_numpy(w, 3)
        assert [got[roi][i] for i in range(3)] == pytest.approx(list(want), abs=1e-6)
        x, d = np.array([said[roi][i] for i in range(len(w))]), w.sum(axis=1)
        assert x.T @ x == pytest.approx(np.eye(3), abs=1e-6)
        assert (w / np.sqrt(np.outer(d, d))) @ x == pytest.approx(x * want, abs=1e-5)
    found = {(r["roi"], r["id"]): r["label"] for r in labels.collect()}
    for roi, (w, label) in graphs.items():
        mine = np.array([found[roi, i] for i in range(len(w))])
        assert len({(a, b) for a, b in zip(mine, label)}) == 3, roi  # each block is one group
        assert list(np.bincount(mine)) == sorted(np.bincount(mine), reverse=True)


def test_small_and_empty_graphs(spark):
    pair = spark.createDataFrame([(1, 0, 1, 2.0), (1, 1, 0, 2.0), (1, 0, 2, 0.0), (1, 2, 0, None)], GRAPH)
    labels, values = spectral.clusters(pair, ["roi"], 3)
    assert {(r["place"], round(r["value"], 9)) for r in values.collect()} == {(0, 1.0), (1, -1.0)}
    assert {r["id"]: r["label"] for r in labels.collect()} == {0: 0, 1: 1}
    labels, values = spectral.clusters(pair.limit(0), ["roi"], 3)
    assert labels.count() == values.count() == 0


def test_groups_around_means(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.2, (m, 2)) for c, m in (((0, 0), 20), ((3, 0), 12), ((0, 4), 8))])
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(2, i, 1.0, 1.0) for i in range(4)], "roi int, id int, u double, v double")
    found = {(r["roi"], r["id"]): r["label"] for r in spectral.nearest_groups(df, ["roi"], ["u", "v"], 3).collect()}
    assert [found[1, i] for i in range(40)] == [0] * 20 + [1] * 12 + [2] * 8
    assert {found[2, i] for i in range(4)} == {0}
