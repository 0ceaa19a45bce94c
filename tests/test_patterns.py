"""Point patterns with marks and intensities, and block bootstraps, against plain Python."""

import hashlib

import numpy as np
import pytest

from quadrille.operators import point_patterns

PLACES = "roi int, id int, x double, y double, mark double"


def scattered(seed, n=40):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0, 60, (n, 2))
    p[1] = p[0]  # two points in one place
    return [(1, i, float(x), float(y), float(m)) for i, ((x, y), m) in enumerate(zip(p, rng.uniform(0.1, 3, n)))]


def k_by_hand(rows, radii, correction, marks=None, lam=None):
    p = np.array([(x, y) for _, _, x, y, _ in rows])
    (x0, y0), (x1, y1) = p.min(axis=0), p.max(axis=0)
    out = []
    for r in radii:
        total = 0.0
        for i in range(len(p)):
            for j in range(len(p)):
                d2 = ((p[i] - p[j]) ** 2).sum()
                if i == j or d2 > r * r:
                    continue
                a = p[min(i, j)]
                sides = [a[0] - x0, x1 - a[0], a[1] - y0, y1 - a[1]]
                w = 1.0
                if correction == "border":
                    w = float(min(p[i][0] - x0, x1 - p[i][0], p[i][1] - y0, y1 - p[i][1]) >= radii[-1])
                elif correction == "translation" and d2 > 0:
                    w = 1 / max(min(1.0, min(sides[:2]) * min(sides[2:]) / d2), 0.1)
                elif correction == "isotropic" and d2 > 0:
                    w = 1 / max(0.75 ** sum(s < d2**0.5 for s in sides), 0.25)
                total += w * (marks[i] * marks[j] if marks is not None else 1) / (lam[i] * lam[j] if lam is not None else 1)
        out.append(total / (sum(marks) ** 2 if marks is not None else len(p)) * (x1 - x0) * (y1 - y0))
    return out


def test_k_with_marks_and_intensity(spark):
    rows, radii = scattered(1), [4.0, 9.0, 15.0]
    df = spark.createDataFrame([(*r, 0.5 + r[1] % 3) for r in rows], PLACES + ", lam double")
    marks, lam = [r[4] for r in rows], [0.5 + r[1] % 3 for r in rows]
    for mark, intensity in ((None, None), ("mark", None), (None, "lam"), ("mark", "lam")):
        got = {r["radius"]: r for r in point_patterns.k_functions(df, ["roi"], radii, mark, intensity).collect()}
        for c in point_patterns.CORRECTIONS:
            want = k_by_hand(rows, radii, c, marks if mark else None, lam if intensity else None)
            assert [got[r][f"k_{c}"] for r in radii] == pytest.approx(want), (c, mark, intensity)
            assert got[9.0][f"l_{c}"] == pytest.approx((want[1] / np.pi) ** 0.5 - 9)


def test_constant_intensity_is_plain_k(spark):
    df = spark.createDataFrame([(*r, 1.0) for r in scattered(2)], PLACES + ", lam double")
    plain = {r["radius"]: r["k_none"] for r in point_patterns.k_functions(df, ["roi"], [5.0, 10.0]).collect()}
    assert {r["radius"]: r["k_none"] for r in point_patterns.k_functions(df, ["roi"], [5.0, 10.0], intensity="lam").collect()} == pytest.approx(plain)
    areas = spark.createDataFrame([(1, 100.0)], "roi int, area double")
    n = df.count()
    masked = {r["radius"]: r["k_none"] for r in point_patterns.k_functions(df, ["roi"], [5.0, 10.0], areas=areas).collect()}
    p = np.array([(r["x"], r["y"]) for r in df.collect()])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    assert masked == pytest.approx({r: ((d <= r).sum() - n) / n * 100 for r in (5.0, 10.0)})


def test_intensities_are_kernels_of_all_points(spark):
    rows = scattered(3)
    p = np.array([(x, y) for _, _, x, y, _ in rows])
    inverse = np.linalg.inv(np.cov(p.T) * len(p) ** (-1 / 3))
    d = p[:, None] - p[None]
    s = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, inverse, d)).sum(axis=1)
    got = {r["id"]: r["intensity"] for r in point_patterns.intensities(spark.createDataFrame(rows, PLACES), ["roi"]).collect()}
    assert [got[i] for i in range(len(p))] == pytest.approx(list(s / s.mean()))


def test_points_that_say_little(spark):
    odd = spark.createDataFrame([(1, i, float(i), 2.0 * i, 0.0) for i in range(5)] + [(2, 0, 1.0, 1.0, 1.0), (3, 0, None, 1.0, 1.0), (3, 1, 1.0, None, 1.0)], PLACES)
    assert {(r["roi"], r["intensity"]) for r in point_patterns.intensities(odd, ["roi"]).collect()} == {(1, 1.0), (2, 1.0)}
    k = point_patterns.k_functions(odd, ["roi"], [1.0, 3.0], mark="mark").collect()
    assert {(r["roi"], r["radius"], r["k_none"]) for r in k} == {(1, 1.0, None), (1, 3.0, None)}
    assert point_patterns.k_functions(odd.limit(0), ["roi"], [1.0]).count() == 0
    assert point_patterns.intensities(odd.limit(0), ["roi"]).count() == 0


@pytest.mark.parametrize("height, width, block", [(12, 12, 4), (10, 7, 4), (3, 3, 5)])
def test_block_bootstrap_by_hand(spark, height, width, block):
    rng = np.random.default_rng(4)
    field = rng.integers(0, 9, (height, width)).astype(float)
    rows = [(1, i, j, float(field[i, j])) for i in range(height) for j in range(width) if field[i, j]]

    def place(draw, i, j, name, size):
        return int(hashlib.md5(f"7|1|{draw}|{i}|{j}|{name}".encode()).hexdigest()[:8], 16) % max(1, size - block)

    made = []
    for draw in range(6):
        new = np.zeros_like(field)
        for i in range(0, height, block):
            for j in range(0, width, block):
                r, c = place(draw, i, j, "row", height), place(draw, i, j, "col", width)
                new[i : i + block, j : j + block] = field[r : r + block, c : c + block][: height - i, : width - j]
        made.append((new.mean(), new.std()))
    got = point_patterns.block_bootstrap(spark.createDataFrame(rows, "roi int, row int, col int, v double"), ["roi"], ["v"], height, width, block, 6, 7).first()
    m, s = np.array(made).T
    assert (got["mean"], got["mean_sd"], got["spread"], got["spread_sd"]) == pytest.approx((m.mean(), m.std(), s.mean(), s.std()), abs=1e-9)


def test_radii_without_pairs_are_told(spark):
    """Three points 20 apart in a row: no pair at 10; SQL of the queries has no row there."""
    from quadrille.plans import patterns

    grid = spark.createDataFrame([(1, i, 20.0 * i, float(i % 2), 1.0) for i in range(3)], PLACES)
    made = point_patterns.k_functions(grid, ["roi"], [10.0, 25.0, 50.0])
    assert [(r["radius"], r["pairs"]) for r in made.orderBy("radius").collect()] == [(10.0, 0), (25.0, 2), (50.0, 3)]
    assert [r["radius"] for r in patterns._met(made).orderBy("radius").collect()] == [25.0, 50.0]
