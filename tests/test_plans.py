"""Every query with SQL agrees with DuckDB; those without are held against plain Python."""

import numpy as np
import pytest
from agreement import of_duckdb, of_spark

from quadrille.operators import binning, edges, iterative, neighbours
from quadrille.plans.registry import FLAGSHIP, QUERIES, SQL
from quadrille.plans.space import positives
from quadrille.plans.common import units



@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, name):
    assert of_spark(QUERIES[name](spark, sf)) == of_duckdb(SQL[name], sf)


def test_entry(spark):
    import __spark_entry__

    assert FLAGSHIP in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_knn_with_ties_and_few_points(spark):
    points = [(1, i, float(i % 4), float(i // 4)) for i in range(16)] + [(2, 0, 0.0, 0.0), (2, 1, 900.0, 0.0), (3, 0, 5.0, 5.0)]
    found = {}
    for r in edges.knn(spark.createDataFrame(points, "roi int, id int, x double, y double"), ["roi"], 3, 2.0).collect():
        found.setdefault((r["roi"], r["src"]), []).append((r["rank"], r["dst"]))
    for roi, i, x, y in points:
        want = sorted(((a - x) ** 2 + (b - y) ** 2, j) for q, j, a, b in points if q == roi and j != i)[:3]
        assert [d for _, d in sorted(found.get((roi, i), []))] == [j for _, j in want]


def test_components_against_union_find(spark, sf):
    p = positives(units(spark, sf))
    near = edges.within(p, ["roi"], 25.0)
    parent = {(r["roi"], r["id"]): (r["roi"], r["id"]) for r in p.collect()}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in near.collect():
        a, b = sorted((top((r["roi"], r["src"])), top((r["roi"], r["dst"]))))
        parent[b] = a
    said = {(r["roi"], r["id"]): r["component"] for r in neighbours.label_components(p, near, ["roi"]).collect()}
    assert said == {k: top(k)[1] for k in parent}


def test_slic_takes_the_nearest_centre(spark):
    rng = np.random.default_rng(1)
    pixels = [(1, x, y, float(rng.integers(0, 50))) for x in range(12) for y in range(12)]
    got = {(r["x"], r["y"]): r["label"] for r in iterative.slic(spark.createDataFrame(pixels, "roi int, x int, y int, v double"), ["roi"], "v", 4.0, 10.0, 2).collect()}
    label = {(x, y): (y // 4) * 65536 + x // 4 for _, x, y, _ in pixels}
    for _ in range(2):
        centre = {k: np.mean([(x, y, v) for _, x, y, v in pixels if label[x, y] == k], axis=0) for k in set(label.values())}
        label = {(x, y): min((round(((x - c[0]) ** 2 + (y - c[1]) ** 2) / 16 + ((v - c[2]) / 10) ** 2, 9), k) for k, c in centre.items() if abs(k // 65536 - y // 4) <= 1 and abs(k % 65536 - x // 4) <= 1)[1] for _, x, y, v in pixels}
    assert got == label


def test_permutation_p(spark):
    units_ = spark.createDataFrame([(1, i, "a" if i < 20 else "b") for i in range(40)], "roi int, id int, label string")
    links = spark.createDataFrame([(1, i, (i + s) % 20 + 20 * (i // 20)) for i in range(40) for s in (1, 2, 3)], "roi int, src int, dst int")
    p = {(r["focal"], r["neighbour"]): r["p"] for r in iterative.permutation_p(units_, links, "roi", "label", 99).collect()}
    assert p == {(a, b): 0.01 for a in "ab" for b in "ab"}  # the labels do not mix at all


def test_communities_and_modularity(spark):
    ring = [(1, a + o, b + o, 1.0) for o in (0, 10) for a in range(5) for b in range(5) if a != b] + [(1, 0, 10, 0.1), (1, 10, 0, 0.1)]
    graph = spark.createDataFrame(ring, "roi int, src int, dst int, weight double")
    labels = iterative.communities(graph, ["roi"])
    assert {r["id"]: r["label"] for r in labels.collect()} == {i + o: o for o in (0, 10) for i in range(5)}
    assert iterative.modularity(graph, labels, ["roi"]).first()["modularity"] == pytest.approx(0.5 - 0.2 / 40.2, abs=1e-6)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "roi int, id int, x double, y double")
    assert edges.knn(none, ["roi"], 3, 2.0).count() == 0
    assert edges.within(none, ["roi"], 2.0).count() == 0
    assert binning.bin_sums(spark.createDataFrame([], "roi int, x int, y int, v double"), ["roi"], 5, ["v"]).count() == 0


def test_labellings_of_one_label_are_not_ranked(spark, tmp_path):
    """Line items that only ever have a large quantity: the dominant marker is the same for all units."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"COPY (SELECT * REPLACE (l_quantity + 5000 AS l_quantity) FROM '{sf}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    got = [r["method"] for r in QUERIES["method_ranks"](spark, str(tmp_path)).orderBy("place").collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
        want = [r[0] for r in con.execute(f"SELECT method FROM ({SQL['method_ranks']}) ORDER BY place").fetchall()]
    assert got == want and "dominant" not in got


def test_communities_alike_in_groups_and_by_joins(spark, monkeypatch):
    """Keys in one group, by joins and in many short jobs end with the same labels."""
    rng = np.random.default_rng(5)
    rows = [(k, int(a), int(b), round(float(w), 3)) for k in (1, 2, 3) for a, b, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.uniform(0.1, 1, 150)) if a != b]
    graph = spark.createDataFrame(rows, "roi int, src bigint, dst bigint, weight double")
    graph = edges.symmetric(graph, ["roi"], graph["weight"])
    found = []
    for together, cycles in ((1 << 20, 64), (1 << 20, 1), (0, 64)):
        monkeypatch.setattr(iterative, "TOGETHER", together)
        monkeypatch.setattr(iterative, "CYCLES", cycles)
        found.append(sorted(map(tuple, iterative.communities(graph, ["roi"]).collect())))
    assert found[0] == found[1] == found[2] and len({label for _, _, label in found[0]}) > 3


def test_ranks_of_means_that_differ_in_the_last_digit(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 are a tie."""
    from quadrille.operators import effects

    a, b = (0.1 + 0.2 + 0.3) / 3, (0.3 + 0.2 + 0.1) / 3
    assert a != b
    df = spark.createDataFrame([("e", "A", a), ("e", "A", 1.0), ("e", "B", b), ("e", "B", 2.0), ("e", "B", None)], "endpoint string, g string, v double")
    found = effects.rank_sums(df, ["endpoint"], "g", "v", effects.contrast_table(spark, [("A", "B")])).first()
    assert (found["n1"], found["n2"], found["u"]) == (2, 2, 1.5)
