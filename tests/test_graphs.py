"""Clusterings, shuffles and power against plain Python and known values."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import clustering, composition, edges, effects, iterative, raster


def test_modular_communities_of_cliques():
    pairs = [(a + o, b + o) for o in (0, 6, 12) for a, b in itertools.combinations(range(6), 2)] + [(0, 6), (6, 12), (12, 0)]
    a, b = np.array(pairs).T
    for seed in range(5):
        labels = clustering.modular_communities(18, a, b, np.ones(len(a)), 1.0, np.random.default_rng(seed))
        assert [len(set(labels[i : i + 6])) for i in (0, 6, 12)] == [1, 1, 1] and len(set(labels)) == 3
    assert list(clustering.modular_communities(3, np.empty(0, int), np.empty(0, int), np.empty(0), 1.0, np.random.default_rng(0))) == [0, 1, 2]


def test_modular_communities_are_no_worse_than_their_parts():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4)) + np.repeat(np.eye(3, 4) * 6, 50, axis=0)
    a, b, w = clustering.nearest(x, 10)
    labels = clustering.modular_communities(150, a, b, w, 1.0, np.random.default_rng(1))
    assert clustering.agreement(labels, np.repeat([0, 1, 2], 50)) > 0.6

    def modularity(c):
        degree = np.bincount(np.concatenate([a, b]), np.concatenate([w, w]), 150)
        return sum(w[c[a] == c[b]]) / sum(w) - sum((degree[c == k].sum() / degree.sum()) ** 2 for k in set(c))

    assert modularity(labels) >= modularity(np.repeat([0, 1, 2], 50)) - 1e-9


def test_nearest_graph():
    x = np.random.default_rng(2).normal(size=(40, 3))
    want = set()
    for i in range(40):
        order = sorted((round(float(((x[i] - x[j]) ** 2).sum()), 9), j) for j in range(40) if j != i)
        want |= {tuple(sorted((i, j))) for _, j in order[:5]}
    a, b, _ = clustering.nearest(x, 5)
    assert set(zip(a.tolist(), b.tolist())) == want


def test_agreement():
    assert clustering.agreement(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])) == 1.0
    assert clustering.agreement(np.array([0, 0, 1, 1]), np.array([0, 0, 1, 2])) == pytest.approx(0.5714285714)
    assert clustering.agreement(np.array([0, 1, 0, 1]), np.array([0, 0, 1, 1])) == pytest.approx(-0.5)


def test_stability_is_the_same_each_time(spark):
    rng = np.random.default_rng(4)
    rows = [(r, i, *map(float, rng.normal(size=2) + 8 * (i % 3))) for r in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "roi int, id int, a double, b double")
    first, again = (sorted(map(tuple, clustering.stability(d, "roi", ["a", "b"], [0.5, 1.0], 3).collect())) for d in (df, df.repartition(7)))
    assert first == again and len(first) == 4 and all(0 <= r[2] <= 1 for r in first)
    labels = clustering.communities(df, "roi", ["a", "b"]).toPandas()
    for _, g in labels.groupby("roi"):
        assert clustering.agreement(g.sort_values("id").label.to_numpy(), np.arange(60) % 3) > 0.5


def test_density_clusters_against_plain_python(spark):
    rng = np.random.default_rng(6)
    points = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 40, size=(120, 2)))]
    df = spark.createDataFrame(points, "roi int, id int, x double, y double")
    got = {r["id"]: r["label"] for r in clustering.density_clusters(df, edges.within(df, ["roi"], 4.0), ["roi"], 4).collect()}
    near = {i: {j for _, j, x2, y2 in points if j != i and (x - x2) ** 2 + (y - y2) ** 2 <= 16} for _, i, x, y in points}
    core = {i for i in near if len(near[i]) >= 4}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in label:
                    label[j] = i
                    todo += near[j] & core
    want = {i: label[i] if i in core else min((label[j] for j in near[i] & core), default=-1) for i in near}
    assert got == want and {-1} < set(want.values())


def test_join_counts_against_shuffles(spark):
    side = 12
    units = [(1, i, i % side < 4, i % 7 == 0, True, i < 3) for i in range(side * side)]
    links = [(1, i, j) for i in range(side * side) for j in (i + 1, i + side) if j < side * side and (j != i + 1 or j % side)]
    got = {r["flag"]: r for r in iterative.join_count_z(spark.createDataFrame(units, "roi int, id int, left boolean, spread boolean, all boolean, few boolean"), spark.createDataFrame(links, "roi int, src int, dst int"), "roi", ["left", "spread", "all", "few"], 400).collect()}
    assert got["all"]["saturated"] and got["all"]["z"] is None and not got["few"]["sufficient"] and got["few"]["z"] is None
    src, dst = np.array(links)[:, 1:].T
    for name, at in (("left", 2), ("spread", 3)):
        on = np.array([u[at] for u in units])
        null = [np.count_nonzero(s[src] & s[dst]) for s in (np.random.default_rng(k).permutation(on) for k in range(400))]
        assert got[name]["observed"] == np.count_nonzero(on[src] & on[dst])
        assert abs(got[name]["null_mean"] - np.mean(null)) < 4 * np.std(null) / 20 and abs(got[name]["null_sd"] / np.std(null) - 1) < 0.2
        assert got[name]["z"] == pytest.approx((got[name]["observed"] - got[name]["null_mean"]) / got[name]["null_sd"])
    assert got["left"]["z"] > 5 > got["spread"]["z"]


def test_power_against_known_values():
    assert [effects.n_for_t_test(g) for g in (0.2, 0.5, 0.8, 1.0)] == [394, 64, 26, 17]
    assert effects.n_for_rank_test(0.5) == 68 and effects.n_for_t_test(0.0) is None
    assert effects.detectable(26) == pytest.approx(0.79, abs=0.01) and effects.t_test_power(0.5, 64) == pytest.approx(0.8015, abs=1e-3)


def test_rank_sums_of_larger_groups(spark):
    rng = np.random.default_rng(8)
    rows = [("e", "a", float(v)) for v in rng.normal(size=12)] + [("e", "b", float(v)) for v in rng.normal(1.2, size=15)] + [("f", "a", float(v % 3)) for v in range(10)] + [("f", "b", float(v % 4)) for v in range(20)]
    df = spark.createDataFrame(rows, "endpoint string, g string, v double")
    got = {r["endpoint"]: r for r in effects.rank_sums(df, ["endpoint"], "g", "v", effects.contrast_table(spark, [("a", "b")])).collect()}
    for e in ("e", "f"):
        a, b = ([v for x, g, v in rows if x == e and g == s] for s in "ab")
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        n, m = len(a), len(b)
        ties = sum(t**3 - t for t in np.unique(a + b, return_counts=True)[1])
        z = max(0, (abs(u - n * m / 2) - 0.5) / (n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1)))) ** 0.5)
        from math import erfc

        assert got[e]["u"] == u and got[e]["p"] == pytest.approx(erfc(z / 2**0.5), abs=1e-6)


def test_resamples_of_three(spark):
    values = {"a": [1.0, 2.0, 4.0], "b": [2.0, 5.0, 9.0]}
    df = spark.createDataFrame([("e", g, v) for g, vs in values.items() for v in vs], "endpoint string, g string, v double")
    got = effects.resampled_range(df, ["endpoint"], "g", "v", effects.contrast_table(spark, [("a", "b")])).first()
    gs = []
    for x in itertools.product(values["a"], repeat=3):
        for y in itertools.product(values["b"], repeat=3):
            pooled = (2 * np.var(x, ddof=1) + 2 * np.var(y, ddof=1)) / 4
            if pooled > 1e-24:
                gs.append((np.mean(y) - np.mean(x)) / pooled**0.5 * (1 - 3 / 15))
    assert (got["g_min"], got["g_max"]) == (pytest.approx(min(gs)), pytest.approx(max(gs))) and got["n_unique"] == len({round(g, 6) for g in gs})


def test_bootstrap_brackets_the_effect(spark):
    rows = [("e", "a", v) for v in (1.0, 2.0, 3.0, 2.5)] + [("e", "b", v) for v in (4.0, 5.0, 4.5, 6.0)] + [("one", "a", 1.0), ("one", "b", 2.0)]
    got = {r["k"]: r for r in iterative.bootstrap_range(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "v", "a", "b", 2_000).collect()}
    assert got["e"]["low"] < got["e"]["g"] < got["e"]["high"] and got["one"]["g"] is None


def test_seeds_and_cells_against_plain_python(spark):
    rng = np.random.default_rng(9)
    grid = {(x, y): float(rng.integers(0, 9)) for x in range(15) for y in range(15) if rng.random() < 0.9}
    cells = spark.createDataFrame([(1, x, y, v) for (x, y), v in grid.items()], "roi int, bin_x bigint, bin_y bigint, v double")
    peaks = iterative.seeds(cells, ["roi"], "v", 4.0)
    around = lambda x, y: [(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (x + a, y + b) in grid]
    want = {(x, y) for (x, y), v in grid.items() if v > 4 and all((v, -y, -x) > (grid[p], -p[1], -p[0]) for p in around(x, y))}
    assert {(int(r["x"]), int(r["y"])) for r in peaks.collect()} == want
    got = {(r["bin_x"], r["bin_y"]): r["label"] for r in iterative.cells_around(cells, peaks, ["roi"], "v", 2.0, 3.0).collect()}
    for (x, y), v in grid.items():
        if v > 2:
            near = min((((x - a) ** 2 + (y - b) ** 2, b * (1 << 16) + a) for a, b in want if (x - a) ** 2 + (y - b) ** 2 <= 9), default=(0, -1))
            assert got[x, y] == near[1]


def test_vectors_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(edges, "VECTORS", 7)
    x = np.random.default_rng(1).normal(size=(50, 4)).round(2)
    x[10] = x[20]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vector array<double>")
    d = {(i, j): round(float(((x[i] - x[j]) ** 2).sum()), 9) for i in range(50) for j in range(50) if i != j}
    got = {}
    for r in edges.vector_knn(df, 3).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: [j for _, j in sorted((d[i, j], j) for j in range(50) if j != i)[:3]] for i in range(50)}
    assert {(r["src"], r["dst"]) for r in edges.vectors_within(df, 2.0).collect()} == {(i, j) for (i, j), v in d.items() if i < j and v <= 2.0}


def test_a_part_that_is_not_positive_nulls_its_composition(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.0), ("b", 0.25), ("b", 0.75)], "k string, v double")
    got = {(r["k"], r["v"]): r["clr"] for r in composition.clr(df, ["k"], "v").collect()}
    assert got["a", 0.5] is None and got["a", 0.0] is None and got["b", 0.25] == pytest.approx(-got["b", 0.75])


def test_one_segment_has_no_boundary(spark):
    cells = spark.createDataFrame([(1, x, y, 0, 1.0) for x in range(6) for y in range(6)], "roi int, bin_x bigint, bin_y bigint, label int, value double")
    assert raster.box_dimension(cells, ["roi"]).first().asDict() == {"roi": 1, "fractal_dim": 1.0, "regularity": 1.0, "boundary_pixels": 0}
    shape = raster.segment_shapes(cells, ["roi"]).first()
    assert (shape["area"], shape["perimeter"]) == (36, 24) and shape["eccentricity"] < 1e-6 and shape["compactness"] == pytest.approx(np.pi / 4)


def test_windows_of_a_stream(spark):
    from quadrille.functions.folders import new_path
    from quadrille.streaming import history

    path = new_path(spark, "t")
    at = lambda h: f"2020-01-01 {h:02d}:00:00"
    spark.createDataFrame([("a", at(1), 1.0), ("a", at(2), 3.0), ("a", at(9), 5.0), ("b", at(1), 7.0)], "k string, t string, v double").select("k", F.col("t").cast("timestamp").alias("t"), "v").coalesce(1).write.parquet(path)
    stream = lambda: history.arriving(spark, path, "k string, t timestamp, v double")
    w = history.drained(history.windowed(stream(), ["k"], "t", "v", "4 hours"), "w")
    assert sorted((r["k"], r["window"]["start"].hour, r["n"], r["mean"]) for r in w.collect()) == [("a", 0, 2, 2.0), ("a", 8, 1, 5.0), ("b", 0, 1, 7.0)]
    s = history.drained(history.sessions(stream(), ["k"], "t", "3 hours"), "s")
    assert sorted((r["k"], r["n"]) for r in s.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_vectors_by_blocks_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(edges, "VECTORS", 5)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)).round(2) * rng.choice([1.0, 5.0], (60, 1))
    x[:20] = x[0]  # a third of one text, at one length
    x[59] = 1.5  # without spread
    key = ["a" if i < 40 else "b" for i in range(60)]
    hostile = [("a", 100, None), ("a", 101, [None, 1.0, 1.0, 1.0]), ("b", None, [1.0] * 4), ("c", 102, [1.0] * 4)]
    df = spark.createDataFrame([(k, i, [float(v) for v in r]) for i, (k, r) in enumerate(zip(key, x))] + hostile, "k string, id bigint, vector array<double>")
    d = {(i, j): round(float(((x[i] - x[j]) ** 2).sum()), 9) for i in range(60) for j in range(60) if i != j and key[i] == key[j]}
    got = {}
    for r in edges.vector_knn(df, 4, ["k"]).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: [j for _, j in sorted((v, j) for (a, j), v in d.items() if a == i)[:4]] for i in range(60)}
    near = edges.vectors_within(df, 3.0, ["k"]).collect()
    assert len(near) == len({(r["src"], r["dst"]) for r in near})
    assert {(r["k"], r["src"], r["dst"]): r["d2"] for r in near} == {(key[i], i, j): v for (i, j), v in d.items() if i < j and v <= 3.0}
    u = (x - x.mean(axis=1, keepdims=True))[:59]
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    alike = {(r["src"], r["dst"]): r["r"] for r in edges.correlation_edges(df, ["k"], 0.5).collect()}
    assert alike == {(i, j): pytest.approx(u[i] @ u[j], abs=1e-5) for (i, j) in d if i < j < 59 and abs(u[i] @ u[j]) >= 0.5}


def test_last_values_of_a_key(spark):
    from quadrille.operators import validation

    rows = [(k, i % 30, i, float(i % 7) / 10) for k in "ab" for i in range(90)] + [("c", 1, 1, 0.5)]
    got = {r["k"]: (r["slope"], r["recent_mean"]) for r in validation.trend_gate(spark.createDataFrame(rows, "k string, t int, i int, q double").repartition(7), ["k"], ["t", "i"], "q", 5).collect()}
    last = [q for _, _, q in sorted((t, i, q) for k, t, i, q in rows if k == "a")[-5:]]
    assert got["a"] == got["b"] == (pytest.approx(np.polyfit(range(5), last, 1)[0]), pytest.approx(np.mean(last))) and got["c"] == (None, None)


def test_trends_over_a_long_history(spark):
    """Places whose squares outgrow an int, in one key and range; ranges without a row of some keys; a slope over a null is null."""
    from quadrille.operators import quality

    n = 50_000
    long = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.when(F.col("id") != 7, (F.col("id") * 7919 % 101).cast("double")).alias("v"))
    few = spark.createDataFrame([("b", t, float(3 * t)) for t in range(12)], "k string, t bigint, v double")
    got = {(r["k"], r["t"]): (r["slope"], r["trend"]) for r in quality.trends(long.unionByName(few), ["k"], "t", "v").collect()}
    assert len(got) == n + 12
    value = lambda i: None if i == 7 else float(i * 7919 % 101)
    for t in (0, 8, 16, 17, 18, n // 4, n // 2, n - 1):
        v = [value(i) for i in range(t - 9, t + 1)]
        if t < 9 or None in v:
            assert got["a", t] == (None, None)
        else:
            assert got["a", t][0] == pytest.approx(np.polyfit(range(10), v, 1)[0], abs=1e-6)
    assert [got["b", t][0] for t in range(9)] == [None] * 9 and [got["b", t] for t in (9, 10, 11)] == [(pytest.approx(3.0), "improving")] * 3


def test_vector_blocks_do_not_grow_in_number(spark, monkeypatch):
    """Each block meets each other, so what is moved grows with their number: it is bounded, and the edges are those by all pairs."""
    monkeypatch.setattr(edges, "VECTORS", 4)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(900, 3)), 3)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, vector array<double>")
    blocks = edges._vector_blocks(df.withColumn("k", F.lit(0)), ["k"])
    assert blocks.count() <= 2 * edges.STRIPES
    d2 = np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 9)
    got = {(r["src"], r["dst"]): r["d2"] for r in edges.vectors_within(df, 0.1).collect()}
    assert set(got) == {(i, j) for i in range(900) for j in range(i + 1, 900) if d2[i, j] <= 0.1}
    near = sorted((r["src"], r["rank"], r["dst"]) for r in edges.vector_knn(df, 3).collect())
    want = [(i, n + 1, j) for i in range(900) for n, j in enumerate(sorted((j for j in range(900) if j != i), key=lambda j: (d2[i, j], j))[:3])]
    assert near == want


def test_nearest_squares_few_differences(monkeypatch):
    """A block's nearest are those of all pairs, and few pairs' differences are squared for them."""
    rng = np.random.default_rng(11)
    x, ids = rng.normal(size=(1200, 16)), rng.permutation(1200).astype(np.int64)
    x[7], x[300] = x[900], x[900] + 1e-7
    squared, done = edges._squared, []
    monkeypatch.setattr(edges, "_squared", lambda a, b, i, j: done.append(len(i)) or squared(a, b, i, j))
    place, dst, d = edges._nearest_of_block((ids, x, None), 5, 100)
    d2 = np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 9)
    d2[np.arange(1200), np.arange(1200)] = np.inf
    want = np.lexsort((np.broadcast_to(ids, d2.shape), d2), axis=1)[:, :5]
    assert (place.reshape(-1, 5) == np.arange(1200)[:, None]).all() and (dst.reshape(-1, 5) == ids[want]).all()
    assert (d.reshape(-1, 5) == np.take_along_axis(d2, want, axis=1)).all()
    assert sum(done) < 0.1 * 1200 * 1200


def _all_sorts(rng):
    """Vectors of far apart sizes, with an offset that hides their distances from single precision, copies, near copies, none but zeros."""
    x = rng.normal(size=(160, 6))
    x[:40] += 1e4
    x[40:60] = x[40]
    x[60:80] = x[60] + rng.normal(size=(20, 6)) * 1e-6
    x[80:90] *= 1e-12
    x[90:95] *= 1e12
    x[95:97] = 0.0
    return x


def test_nearest_of_all_sorts_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(edges, "VECTORS", 16)
    x = _all_sorts(np.random.default_rng(12))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [float("nan")] * 6), (901, [float("inf")] + [0.0] * 5), (902, None)]
    d2 = np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 9)
    got = {}
    for r in edges.vector_knn(spark.createDataFrame(rows, "id bigint, vector array<double>"), 3).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: sorted((j for j in range(160) if j != i), key=lambda j: (d2[i, j], j))[:3] for i in range(160)}


def test_vectors_within_square_few_differences(spark, monkeypatch):
    """Of two blocks, pairs within a radius are those of all pairs, and only about as many differences are squared."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(900, 16))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    compared, done, squared = [], [], edges._squared
    monkeypatch.setattr(edges, "VECTORS", 100)
    monkeypatch.setattr(edges, "_squared", lambda *a: done.append(a[-1].size) or squared(*a))
    monkeypatch.setattr(edges, "_block_pairs", lambda blocks, by, how, *_: compared.append(how) or spark.createDataFrame([], "src bigint, dst bigint, d double"))
    edges.vectors_within(spark.createDataFrame([(0, [1.0, 2.0])], "id bigint, vector array<double>"), 0.7)
    ids = np.arange(900)
    got = {(s, t): d for src, dst, d in compared[0]((ids[:400], x[:400], None), (ids[400:], x[400:], None), False) for s, t, d in zip(src.tolist(), dst.tolist(), d.tolist())}
    d2 = np.round(((x[:400, None] - x[None, 400:]) ** 2).sum(axis=2), 9)
    assert got == {(i, 400 + j): d2[i, j] for i, j in zip(*(c.tolist() for c in np.nonzero(d2 <= 0.7)))} and len(got) > 100
    assert sum(done) < len(got) + 50


def test_all_sorts_of_vectors_within(spark, monkeypatch):
    """Distances that round to the radius count, also where lengths differ by more."""
    monkeypatch.setattr(edges, "VECTORS", 16)
    x = _all_sorts(np.random.default_rng(12))
    x[60:80] = x[60] * (1 + 1e-6 * np.arange(20)[:, None])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [float("nan")] * 6), (901, [float("inf")] + [0.0] * 5), (902, None)]
    d2 = np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 9)
    for radius2 in (0.0, 3.0):
        got = sorted((r["src"], r["dst"], r["d2"]) for r in edges.vectors_within(spark.createDataFrame(rows, "id bigint, vector array<double>"), radius2).collect())
        assert got == [(i, j, d2[i, j]) for i in range(160) for j in range(i + 1, 160) if d2[i, j] <= radius2]
