"""Cells by flooding against plain Python: smoothing, distances, openings, peaks, the flood itself, hulls, and the whole on a small field."""

import math

import numpy as np
import pytest

from quadrille.operators import raster, watershed

KIND = "roi int, bin_x bigint, bin_y bigint, value double"


def image(spark, fields, extra=None):
    rows = [(r, x, y, float(f[y, x])) for r, f in fields.items() for y in range(f.shape[0]) for x in range(f.shape[1])]
    return spark.createDataFrame(rows, KIND)


def back(df, column, shapes):
    out = {r: np.zeros(s) for r, s in shapes.items()}
    for row in df.collect():
        out[row["roi"]][row["bin_y"], row["bin_x"]] = row[column]
    return out


@pytest.fixture(scope="module")
def fields():
    rng = np.random.default_rng(4)
    return {1: rng.random((9, 14)).round(3), 2: rng.random((5, 4)).round(3)}


def smooth(f, sigma, reflect):
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    mode = "symmetric" if reflect else "edge"
    line = lambda v: np.convolve(np.pad(v, reach, mode), w[::-1], "valid")
    return np.apply_along_axis(line, 0, np.apply_along_axis(line, 1, f))


@pytest.mark.parametrize("sigma, reflect", [(0.5, False), (1.0, False), (0.9, True)])
def test_smoothing(spark, fields, sigma, reflect):
    got = back(watershed.blurred(image(spark, fields), ["roi"], sigma, reflect=reflect), "value", {r: f.shape for r, f in fields.items()})
    for r, f in fields.items():
        assert np.allclose(got[r], smooth(f, sigma, reflect), atol=1e-12)


def nearest_off(mask, outside):
    h, w = mask.shape
    off = [(y, x) for y in range(-outside, h + outside) for x in range(-outside, w + outside) if not (0 <= y < h and 0 <= x < w and mask[y, x])]
    return np.array([[min(((y - v) ** 2 + (x - u) ** 2 for v, u in off), default=watershed.FAR**2) if mask[y, x] else 0 for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("outside", [False, True])
def test_distances(spark, fields, outside):
    both = {**fields, 3: np.ones((3, 5)), 4: np.zeros((2, 2))}
    df = watershed.distance2(image(spark, both).selectExpr("roi", "bin_x", "bin_y", "value > 0.3 AS mask"), ["roi"], "mask", outside)
    got = back(df, "d2", {r: f.shape for r, f in both.items()})
    for r, f in both.items():
        assert (got[r] == nearest_off(f > 0.3, outside)).all(), r


@pytest.mark.parametrize("radius", [1, 2])
def test_opening(spark, fields, radius):
    df = watershed.opened(image(spark, fields).selectExpr("roi", "bin_x", "bin_y", "value > 0.2 AS mask"), ["roi"], "mask", radius)
    got = back(df.selectExpr("roi", "bin_x", "bin_y", "CAST(mask AS INT) AS mask"), "mask", {r: f.shape for r, f in fields.items()})
    disk = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    for r, f in fields.items():
        m, (h, w) = f > 0.2, f.shape
        at = lambda g, y, x: 0 <= y < h and 0 <= x < w and bool(g[y, x])  # noqa: B023, E731
        small = np.array([[all(at(m, y + a, x + b) for a, b in disk) for x in range(w)] for y in range(h)])
        want = np.array([[any(at(small, y + a, x + b) for a, b in disk) for x in range(w)] for y in range(h)])
        assert (got[r].astype(bool) == want).all()


def test_specks_go(spark):
    f = np.array([[1, 1, 0, 0, 1], [0, 1, 0, 0, 0], [0, 0, 1, 1, 0], [1, 0, 1, 1, 0]])
    df = watershed.without_specks(image(spark, {1: f}).selectExpr("roi", "bin_x", "bin_y", "value > 0 AS mask"), ["roi"], "mask", 3)
    kept = {(r["bin_y"], r["bin_x"]) for r in df.filter("mask").collect()}
    assert kept == {(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 2), (3, 3)}


def test_seeds(spark, fields):
    masked = image(spark, fields).selectExpr("roi", "bin_x", "bin_y", "value > 0.25 AS mask")
    got = {(r["roi"], r["bin_y"], r["bin_x"]): r["seed"] for r in watershed.nucleus_seeds(masked, ["roi"], 1).collect()}
    want = {}
    for r, f in fields.items():
        d, n = nearest_off(f > 0.25, False), 0
        for y in range(1, f.shape[0] - 1):
            for x in range(1, f.shape[1] - 1):
                near = [(d[v, u], -v, -u) for v in (y - 1, y, y + 1) for u in (x - 1, x, x + 1)]
                if d[y, x] and 4 * d[y, x] > 1 and (d[y, x], -y, -x) == max(near):
                    n += 1
                    want[r, y, x] = n
    assert got == want


def flood_slowly(height, open_, seed, compactness):
    """Looks at every pixel that could be taken before each step."""
    label, at = np.zeros(height.shape, int), {int(seed[p]): p for p in zip(*np.nonzero(seed))}
    offers = {(height[p], s, *p) for s, p in at.items() if open_[p]}
    while offers:
        best = min(offers)
        _, s, y, x = best
        offers = {o for o in offers if o[2:] != (y, x)}
        label[y, x] = s
        for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= v < height.shape[0] and 0 <= u < height.shape[1] and open_[v, u] and not label[v, u]:
                offers.add((height[v, u] + compactness * math.hypot(v - at[s][0], u - at[s][1]), s, v, u))
    return label


@pytest.mark.parametrize("compactness", [0.0, 0.1])
def test_flood_pixel_by_pixel(spark, compactness):
    rng = np.random.default_rng(9)
    cases = {}
    for r in range(4):
        height, open_, seed = rng.integers(0, 4, (12, 15)).astype(float), rng.random((12, 15)) < 0.9, np.zeros((12, 15), int)
        for s, p in enumerate(rng.choice(180, 6, replace=False)):
            seed.flat[p] = s + 1
        cases[r] = height, open_, seed
    rows = [(r, x + 40, y + 7, float(h[y, x]), bool(o[y, x]), int(s[y, x]) or None) for r, (h, o, s) in cases.items() for y in range(12) for x in range(15)]
    found = watershed.flood(spark.createDataFrame(rows, "roi int, bin_x bigint, bin_y bigint, height double, open boolean, seed bigint"), ["roi"], compactness)
    got = {r: np.zeros((12, 15), int) for r in cases}
    for row in found.collect():
        got[row["roi"]][row["bin_y"] - 7, row["bin_x"] - 40] = row["label"]
    for r, case in cases.items():
        assert (got[r] == flood_slowly(*case, compactness)).all()


def test_hull_of_shapes():
    square = np.array([(x, y) for x in range(3) for y in range(3)], float)
    assert watershed.hull_pixels(square[:, 0], square[:, 1]) == 9
    ell = np.array([(0, y) for y in range(5)] + [(x, 0) for x in range(1, 5)], float)
    assert watershed.hull_pixels(ell[:, 0], ell[:, 1]) == 15 and watershed.hull_pixels(np.array([2.0]), np.array([3.0])) == 1


def test_two_nuclei(spark):
    px = [(1, x, y, 100.0 * math.exp(-min((x - 6) ** 2 + (y - 8) ** 2, (x - 16) ** 2 + (y - 8) ** 2) / 12), 1.0) for x in range(24) for y in range(18)]
    pixels = spark.createDataFrame([(r, x, y, a, a, v) for r, x, y, a, v in px], "roi int, x int, y int, dna1 double, dna2 double, m double")
    im = watershed.nucleus_image(pixels, ["roi"], ("dna1", "dna2"), 1).cache()
    masked = watershed.nucleus_mask(im, ["roi"], 15, 6, 1)
    seeds = watershed.nucleus_seeds(masked, ["roi"], 3)
    assert sorted(min((abs(r["bin_x"] - x) + abs(r["bin_y"] - 8), x) for x in (6, 16)) for r in seeds.collect()) in [sorted([(a, 6), (b, 16)]) for a in (0, 1) for b in (0, 1)]
    found = watershed.cells(im, seeds, ["roi"], 1).cache()
    sides = {r["label"]: (r["low"], r["high"]) for r in found.groupBy("label").agg({"bin_x": "min"}).withColumnRenamed("min(bin_x)", "low").join(found.groupBy("label").agg({"bin_x": "max"}).withColumnRenamed("max(bin_x)", "high"), "label").collect()}
    assert sides[1][1] <= 12 and sides[2][0] >= 10
    sums = {r["label"]: r for r in watershed.cell_sums(pixels, found, ["roi"], 1, ["m"]).collect()}
    sizes = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    assert {k: r["m"] for k, r in sums.items()} == sizes and {k: r["n_pixels"] for k, r in sums.items()} == sizes
    shapes = raster.segment_shapes(found, ["roi"]).join(watershed.solidities(found, ["roi"]), ["roi", "label"])
    q = watershed.quality(masked, seeds, shapes, ["roi"], 1).first()
    assert q["n_seeds"] == q["n_cells"] == 2 and q["good_conversion"] and q["score"] == 1.0
    assert watershed.connected(found, ["roi"], raster.EIGHT).select("component").distinct().count() in (1, 2)


def test_nothing_to_segment(spark):
    none = spark.createDataFrame([], "roi int, x int, y int, dna1 double, dna2 double")
    im = watershed.nucleus_image(none, ["roi"], ("dna1", "dna2"), 1)
    seeds = watershed.nucleus_seeds(watershed.nucleus_mask(im, ["roi"], 15, 6, 1), ["roi"], 3)
    assert watershed.cells(im, seeds, ["roi"], 1).count() == 0
    dark = spark.createDataFrame([(1, x, y, 0.0, 0.0) for x in range(4) for y in range(4)], "roi int, x int, y int, dna1 double, dna2 double")
    assert {r["value"] for r in watershed.nucleus_image(dark, ["roi"], ("dna1", "dna2"), 1).collect()} == {0.0}
