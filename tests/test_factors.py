"""Features, modules and density along graphs against plain numpy."""

import itertools

import numpy as np
import pytest

from quadrille.operators import factors, graph_density
from quadrille.plans import factors as plans
from quadrille.plans.registry import QUERIES

NAMES = [f"v{i}" for i in range(6)]


def made(spark, x, names=NAMES):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in names)).repartition(3)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    w, h = rng.gamma(1.0, 1.0, (90, 2)), np.array([[3.0, 2, 0, 0, 1, 0], [0, 0.5, 2, 4, 0, 1]])
    return w @ h + rng.uniform(0, 0.1, (90, 6))


def test_information_of_the_component(spark, table):
    x = table - table.mean(axis=0)
    v = np.linalg.svd(x, full_matrices=False)[2][0]
    t = x @ (v * np.sign(v[np.argmax(np.abs(v))]))
    want = {}
    for i, n in enumerate(NAMES):
        c = np.histogram2d(table[:, i], t, bins=8)[0] / len(t)
        want[n] = (c[c > 0] * np.log(c[c > 0] / np.outer(c.sum(1), c.sum(0))[c > 0])).sum()
    got = factors.most_informative(made(spark, table), NAMES, 4, 8).orderBy("place").collect()
    assert [r["feature"] for r in got] == sorted(want, key=lambda n: -want[n])[:4]
    assert {r["feature"]: r["information"] for r in got} == {r["feature"]: pytest.approx(want[r["feature"]], abs=1e-9) for r in got}


def test_information_of_nulls_and_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0.0), (2.0, 5.0, 1.0), (None, 5.0, 1.0), (2.0, 5.0, None)], "a double, b double, t double")
    got = {r["feature"]: (r["n"], r["information"]) for r in factors.mutual_information(df, ["a", "b"], "t", 2).collect()}
    assert got == {"a": (2, pytest.approx(np.log(2))), "b": (3, 0.0)}
    assert factors.mutual_information(df.limit(0), ["a"], "t").count() == 0


def plain_lasso(x, y, penalty, rounds=4000):
    x, y, w = x - x.mean(axis=0), y - y.mean(), np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(len(w)):
            pull = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / len(x)
            w[j] = np.sign(pull) * max(abs(pull) - penalty, 0) / (x[:, j] @ x[:, j] / len(x))
    return w


def test_lasso_over_folds(spark, table):
    import zlib

    got = factors.lasso(made(spark, table), NAMES, "id", folds=3, steps=6, least=0.01).collect()
    x = table - table.mean(axis=0)
    v = np.linalg.svd(x, full_matrices=False)[2][0]
    y = x @ (v * np.sign(v[np.argmax(np.abs(v))]))
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i in range(len(x))])
    path, errors = np.abs(x.T @ y / len(x)).max() * np.logspace(0, -2, 6), []
    for penalty in path:
        lost = []
        for f in range(3):
            a, b = x[fold != f], y[fold != f]
            w = plain_lasso(a, b, penalty, 400)
            lost.append(np.mean((b.mean() + (x[fold == f] - a.mean(axis=0)) @ w - y[fold == f]) ** 2))
        errors.append(np.mean(lost))
    best = path[int(np.argmin(errors))]
    assert got[0]["penalty"] == pytest.approx(best)
    assert [r["coefficient"] for r in got] == pytest.approx(list(plain_lasso(x, y, best)), abs=1e-5)


def test_sparse_sums_end_at_the_optimum():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 12))
    x[:, 6:] = x[:, :6] + 0.01 * rng.normal(size=(60, 6))  # nearly the same columns
    gram, along = x.T @ x / 60, x.T @ (x @ rng.normal(size=12)) / 60
    for penalty in (0.5, 0.05, 0.001):
        w = factors.descend(gram, along, penalty, np.zeros(12))
        rest = along - gram @ w
        assert np.all(np.abs(rest) <= penalty + 1e-4)
        assert rest[w != 0] == pytest.approx(penalty * np.sign(w[w != 0]), abs=1e-4)


def test_nonnegative_modules(spark, table):
    df = made(spark, table - 0.5)  # values below zero are raised
    h, low, losses = factors.nonnegative_modules(df, NAMES, 2)
    assert low == pytest.approx(table.min() - 0.5) and (h >= 0).all()
    assert all(b <= a * (1 + 1e-9) for a, b in itertools.pairwise(losses))
    raised = table - table.min()
    begin = factors.starting_loadings(df, NAMES, 2, low)
    for want in losses:  # the same rounds by least squares over whole columns
        w = np.array([best(r, begin) for r in raised])
        assert ((raised - w @ begin) ** 2).sum() == pytest.approx(want, rel=1e-6)
        begin = np.array([best(c, w.T) for c in raised.T]).T
    scores = factors.with_scores(df, ["id"], NAMES, lambda x: factors.nonnegative(x - low, h), 2).orderBy("id").collect()
    assert np.array([[r["module_0"], r["module_1"]] for r in scores]) == pytest.approx(np.array([best(r, h) for r in raised]), abs=1e-6)
    kept = {(r["module"], r["feature"]) for r in factors.composition(spark, h, NAMES).filter("member").collect()}
    assert kept == {(i, NAMES[j]) for i in range(2) for j in range(6) if h[i, j] > np.percentile(h[i], 75)}


def best(row, loadings):
    """The non-negative weights of least squares, by trying every set of those that are not zero."""
    found = (float(row @ row), np.zeros(len(loadings)))
    for size in range(1, len(loadings) + 1):
        for which in itertools.combinations(range(len(loadings)), size):
            w = np.zeros(len(loadings))
            w[list(which)] = np.linalg.lstsq(loadings[list(which)].T, row, rcond=None)[0]
            if (w >= 0).all():
                found = min(found, (float(((row - w @ loadings) ** 2).sum()), w), key=lambda f: f[0])
    return found[1]


def test_independent_modules_find_the_sources(spark):
    rng = np.random.default_rng(8)
    s = np.column_stack([rng.uniform(-1, 1, 800), rng.laplace(size=800), np.sign(rng.normal(size=800))])
    x = s @ rng.normal(size=(3, 6))
    loadings, centre = factors.independent_modules(made(spark, x), NAMES, 3)
    found = np.abs(np.corrcoef(((x - centre) @ loadings.T).T, s.T)[:3, 3:])
    assert found.max(axis=0) == pytest.approx(np.ones(3), abs=0.03) and sorted(found.argmax(axis=1)) == [0, 1, 2]


def test_modules_of_nothing(spark, table):
    none = made(spark, table).limit(0)
    assert factors.nonnegative_modules(none, NAMES, 2)[2] == []
    assert factors.independent_modules(none, NAMES, 2)[0].shape == (0, 6)
    assert {r["coefficient"] for r in factors.lasso(none, NAMES, "id").collect()} == {0.0}
    holes = made(spark, table).unionByName(spark.createDataFrame([(90, None, *[1.0] * 5), (91, float("nan"), *[1.0] * 5)], made(spark, table).schema))
    assert factors.means(holes, NAMES)[0] == 90
    assert factors.with_scores(holes, ["id"], NAMES, lambda x: x[:, :1], 1).filter("module_0 IS NULL").count() == 2


def density_by_hand(n, edges, reach, least):
    d = np.where(np.eye(n, dtype=bool), 0.0, np.inf)
    for a, b, w in edges:
        if w and w > 0:
            d[a, b] = d[b, a] = min(d[a, b], w)
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    d = np.round(d, 9)
    dense = (d <= reach).sum(axis=1) >= least
    label = np.full(n, -1)
    for i in np.flatnonzero(dense):
        if label[i] < 0:
            todo = [i]
            label[i] = i
            while todo:
                for j in np.flatnonzero(dense & (d[todo.pop()] <= reach) & (label < 0)):
                    label[j] = i
                    todo.append(j)
    for i in np.flatnonzero(~dense):
        near = [(d[i, j], j) for j in np.flatnonzero(dense) if d[i, j] <= reach]
        if near:
            label[i] = label[min(near)[1]]
    return {i: (int(label[i]), bool(dense[i])) for i in range(n)}


@pytest.mark.parametrize("seed,reach,least", [(1, 1.5, 4), (2, 2.5, 6), (3, 1.0, 1), (4, 0.75, 3)])
def test_density_along_graphs(spark, seed, reach, least):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b), float(w) / 4) for a, b, w in zip(rng.integers(0, 40, 70), rng.integers(0, 36, 70), rng.integers(0, 9, 70))] + [(3, 3, 1.0), (0, 1, -1.0)]  # ties, loops, edges of no length
    nodes = spark.createDataFrame([(1, i) for i in range(45)] + [(2, 7)], "roi int, id int")
    graph = spark.createDataFrame([(1, *e) for e in edges] + [(1, 5, 6, None)], "roi int, src int, dst int, weight double")
    got = {(r["roi"], r["id"]): (r["label"], r["dense"]) for r in graph_density.clusters(nodes, graph, ["roi"], reach, least).collect()}
    want = {(1, i): f for i, f in density_by_hand(45, edges, reach, least).items()}
    assert got == {**want, (2, 7): (7, True) if least == 1 else (-1, False)}


def test_density_of_a_hub_and_of_nothing(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(60)], "roi int, id int")
    graph = spark.createDataFrame([(1, 0, i, 1.0) for i in range(1, 60)], "roi int, src int, dst int, weight double")
    label = lambda reach: {r["label"] for r in graph_density.clusters(nodes, graph, ["roi"], reach, 5).collect()}
    assert label(1.0) == {0} and label(2.0) == {0} and label(0.5) == {-1}
    assert graph_density.clusters(nodes.limit(0), graph.limit(0), ["roi"], 1.0, 2).count() == 0


def test_queries_against_numpy(spark, sf):
    df, graph = plans.likeness_graph(spark, sf)
    ids = sorted((r["roi"], r["id"]) for r in df.select("roi", "id").collect())
    want = {}
    for roi in {r for r, _ in ids}:
        own = [i for r, i in ids if r == roi]
        at = {i: n for n, i in enumerate(own)}
        found = density_by_hand(len(own), [(at[r["src"]], at[r["dst"]], r["weight"]) for r in graph.filter(f"roi = {roi}").collect()], plans.REACH, plans.LEAST)
        for label, dense in found.values():
            key = (roi, own[label] if label >= 0 else -1)
            n, d = want.get(key, (0, 0))
            want[key] = (n + 1, d + dense)
    got = {(r["roi"], r["label"]): (r["n"], r["n_dense"]) for r in QUERIES["graph_density_clusters"](spark, sf).collect()}
    assert got == want and any(k[1] >= 0 for k in got) and any(k[1] < 0 for k in got)
    assert QUERIES["informative_features"](spark, sf).count() == plans.CHOSEN
    chosen = QUERIES["lasso_features"](spark, sf).collect()
    assert 0 < len(chosen) <= plans.CHOSEN
    modules = QUERIES["marker_modules"](spark, sf).collect()
    assert len(modules) == 2 * plans.MODULES * len(plans.MARKERS) and sum(r["member"] for r in modules) == 2 * plans.MODULES * 2
    assert QUERIES["module_scores"](spark, sf).filter("module_0 IS NULL OR module_0 < 0").count() == 0


def test_all_correlations_leave_out_rows_with_holes(spark):
    from quadrille.operators import statistics

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(40, 3)) * 2)  # ties
    rows = [("k", *map(float, r)) for r in x] + [("k", None, 9.0, 9.0), ("few", 1.0, 2.0, 3.0)]
    got = {(r["key"], r["a"], r["b"]): r for r in statistics.all_correlations(spark.createDataFrame(rows, "key string, v0 double, v1 double, v2 double"), ["key"], NAMES[:3]).collect()}
    place = np.array([[(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c] for c in x.T])
    for i, j in ((0, 1), (0, 2), (1, 2)):
        r = got["k", NAMES[i], NAMES[j]]
        assert (r["n"], r["pearson"], r["spearman"]) == (40, pytest.approx(np.corrcoef(x[:, i], x[:, j])[0, 1]), pytest.approx(np.corrcoef(place[i], place[j])[0, 1]))
        assert got["few", NAMES[i], NAMES[j]]["pearson"] is None
