"""Whitening against numpy, and hostile tables."""

import numpy as np
import pytest

from quadrille.llm import whiten

KIND = "vec_id bigint, embedding array<float>, x0 string, v string, component string"


def made(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in vectors], KIND)


def check(report, ids, vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)) + 100_000
    n, s = len(x), x.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    k = min(8, x.shape[1])
    w = (x - s / n) @ v[:, :k] / np.sqrt(e[:k])
    got = {(r["vec_id"], r["component"]): r for r in report.collect()}
    assert len(got) == n * k == report.count()
    for c in range(k):
        sign = np.sign(sum(got[i, c + 1]["whitened"] * w[at, c] for at, i in enumerate(ids)))
        for at, i in enumerate(ids):
            r = got[i, c + 1]
            assert r["whitened"] * sign == pytest.approx(w[at, c], abs=1e-8) and r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9)
            assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[at], s)) and r["identity_error"] < 1e-9


def test_against_numpy_with_rows_that_go(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(60, 10)) * np.arange(1, 11) / 10).round(4).tolist()
    bad = [(100, None), (101, [1.0, None] + [0.0] * 8), (102, [float("nan")] * 10), (103, [float("-inf")] + [0.0] * 9), (104, [1.0, 2.0]), (105, [])]
    check(whiten.whiten(made(spark, [*enumerate(good), *bad])), range(60), good)


def test_the_table(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    check(whiten.op12_whiten(spark, sf), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_no_variance(spark):
    got = whiten.whiten(made(spark, [(1, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (1, [2.0, 2.0, 3.0])])).collect()
    assert len(got) == 9 and {r["whitened"] for r in got if r["component"] > 1} == {0.0}
    assert sorted(round(r["whitened"], 6) for r in got if r["component"] == 1) in ([-0.707107, -0.707107, 1.414214], [-1.414214, 0.707107, 0.707107])
    assert all(r["identity_error"] < 1e-9 and r["explained"] == pytest.approx(float(r["component"] == 1)) for r in got)
    same = whiten.whiten(made(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(0.0, 0.0, 0.0, 0)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_fit(spark, rows):
    assert whiten.whiten(made(spark, rows)).count() == 0


def test_sums_dealt_over_several_aggregations(spark, monkeypatch):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(30, 6)).round(4).tolist()
    monkeypatch.setattr(whiten, "SUMS", 4)
    check(whiten.whiten(made(spark, list(enumerate(good)))), range(30), good)
