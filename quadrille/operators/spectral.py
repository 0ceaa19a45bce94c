"""Spectral clustering of weighted graphs: vectors by joins with the edges, rotations from sums, groups by nearest centre.

Nothing of a graph's size is gathered: of each key only sums over pairs of vectors and a few centres leave the tasks, so that a
key's graph may be as large as the cluster holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.folders import staged

#: Vectors beside those asked for, which make the others converge; products with the graph in a round; rounds at most.
BESIDE, DEGREE, ROUNDS = 4, 8, 40
#: Eigenvalues lie between these; what is damped reaches at most to HIGH.
LOW, HIGH = -1.0, 0.999


def normalised(graph: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, src, dst, w, own): weights over the root of both ends' degrees, and a row of each node to itself; (keys, id, degree).

    graph: (keys, src, dst, weight) in both directions; edges without positive weight, and nodes without others, are left out.
    """
    real = graph.filter(F.col("weight") > 0).groupBy(*keys, "src", "dst").agg(F.sum("weight").alias("weight"))
    degrees = staged(real.groupBy(*keys, F.col("src").alias("id")).agg(F.sum("weight").alias("degree")), "degrees")
    end = lambda name: degrees.select(*keys, F.col("id").alias(name), F.col("degree").alias(f"_{name}"))
    scaled = real.join(end("src"), [*keys, "src"]).join(end("dst"), [*keys, "dst"]).select(*keys, "src", "dst", (F.col("weight") / F.sqrt(F.col("_src") * F.col("_dst"))).alias("w"), F.lit(0.0).alias("own"))
    selves = degrees.select(*keys, F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"), F.lit(1.0).alias("own"))
    return staged(scaled.unionByName(selves), "normalised-edges"), degrees


def _names(letter: str, p: int) -> list[str]:
    return [f"{letter}{i}" for i in range(p)]


def _product(edges: DataFrame, state: DataFrame, keys: list[str], p: int, keep: list[str]) -> DataFrame:
    """state (keys, id, x.., keep) with the products a.. of the graph and x..: a node's own row brings it what it has already."""
    near = edges.join(state.withColumnRenamed("id", "dst"), [*keys, "dst"])
    mine = [F.sum(F.col("own") * F.col(c)).alias(c) for c in [*_names("x", p), *keep]]
    return near.groupBy(*keys, F.col("src").alias("id")).agg(*(F.sum(F.col("w") * F.col(x)).alias(a) for x, a in zip(_names("x", p), _names("a", p))), *mine)


def _filtered(edges: DataFrame, state: DataFrame, keys: list[str], p: int) -> DataFrame:
    """x.. after a Chebyshev polynomial of the graph that is small from LOW to the key's `high` and grows fast above it."""
    x, before, a = _names("x", p), _names("b", p), _names("a", p)
    centre, half = (F.col("high") + LOW) / 2, (F.col("high") - LOW) / 2
    for step in range(DEGREE):
        made = _product(edges, state, keys, p, ["high", *(before if step else [])])
        upper = lambda i: (F.col(a[i]) - centre * F.col(x[i])) / half  # noqa: B023, E731
        new = [(2 * upper(i) - F.col(before[i]) if step else upper(i)).alias(x[i]) for i in range(p)]
        state = made.select(*keys, "id", "high", *new, *(F.col(x[i]).alias(before[i]) for i in range(p)))
    return state.select(*keys, "id", "high", *x)


def _rotations(sums: DataFrame, keys: list[str], p: int, k: int) -> DataFrame:
    """(keys, turn, theta, off): of each key the matrix that turns x.. to the graph's vectors, their values, and how far the first k are off."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                g, h, q = (np.zeros((p, p)) for _ in range(3))
                for i in range(p):
                    for j in range(i, p):
                        for m, name in ((g, "g"), (h, "h"), (q, "q")):
                            m[i, j] = m[j, i] = getattr(r, f"{name}{i}_{j}")
                scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
                s, u = np.linalg.eigh(g / np.outer(scale, scale))
                there = s > 1e-11 * max(s[-1], 1e-300)
                base = (u[:, there] / np.sqrt(s[there])) / scale[:, None]
                theta, v = np.linalg.eigh(base.T @ h @ base)
                order = np.argsort(-theta, kind="stable")
                turn = base @ v[:, order]
                theta = theta[order]
                off = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, q, turn) - theta**2, 0.0))[:k]
                full = np.zeros((p, p))
                full[:, : turn.shape[1]] = turn
                rows.append({**{c: getattr(r, c) for c in keys}, "turn": full.ravel().tolist(), "theta": theta.tolist(), "off": float(off.max(initial=0.0))})
            yield pd.DataFrame(rows, columns=[*keys, "turn", "theta", "off"])

    kinds = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in keys)
    return sums.mapInPandas(solve, f"{kinds}, turn array<double>, theta array<double>, off double")


def leading(graph: DataFrame, keys: list[str], k: int, seed: int = 42, within: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """(keys, id, degree, x0..) and (keys, place, value, off): the k leading vectors and values of each key's normalised graph.

    A round applies a polynomial of the graph, by DEGREE joins with its edges in one job, and turns the vectors by what their sums of
    products say. It ends when a product of the graph and a vector is `within` the vector times its value, for all keys, after ROUNDS
    at the latest; off tells how far the worst is. A key with fewer nodes than vectors has zeros in place of the rest, and no values for them.
    """
    edges, degrees = normalised(graph, keys)
    p = k + BESIDE
    x, a = _names("x", p), _names("a", p)
    chance = lambda i: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 20)) / float(1 << 20) - 0.5
    state = degrees.select(*keys, "id", F.lit(0.0).alias("high"), F.sqrt("degree").alias(x[0]), *(chance(i).alias(x[i]) for i in range(1, p)))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for turn in range(ROUNDS):
        # What to damp is known once the first vectors have been turned.
        made = staged(_product(edges, _filtered(edges, state, keys, p) if turn else state, keys, p, ["high"]), "vectors")
        products = [F.sum(F.col(u[i]) * F.col(v[j])).alias(f"{name}{i}_{j}") for name, u, v in (("g", x, x), ("h", x, a), ("q", a, a)) for i, j in pairs]
        turns = staged(_rotations(made.groupBy(*keys).agg(*products), keys, p, k), "turns")
        turned = made.drop("high").join(turns.select(*keys, "turn", F.least(F.lit(HIGH), F.greatest(F.lit(-0.5), F.array_min("theta"))).alias("high")), keys)
        new = [sum((F.col(x[j]) * F.get("turn", F.lit(j * p + i)) for j in range(1, p)), F.col(x[0]) * F.get("turn", F.lit(i))).alias(x[i]) for i in range(p)]
        state = staged(turned.select(*keys, "id", "high", *new), "turned")
        worst = turns.agg(F.max("off")).first()[0]
        if worst is None or worst <= within:
            break
    values = turns.select(*keys, "off", F.posexplode(F.slice("theta", 1, k)).alias("place", "value")).select(*keys, "place", "value", "off")
    return state.select(*keys, "id", *x[:k]).join(degrees, [*keys, "id"]), values


def _apart(values: list[str], centre: Column) -> Column:
    return sum((F.pow(F.col(v) - F.get(centre, F.lit(i)), 2) for i, v in enumerate(values)), F.lit(0.0))


def nearest_groups(rows: DataFrame, keys: list[str], values: list[str], k: int, rounds: int = 100) -> DataFrame:
    """(keys, id, label): each key's rows (id, values) in k groups around their means, labels 0.. by size, then by smallest id.

    The first centre is the row that is farthest from the mean of all, each next one that farthest from all centres before; then rows go to
    the nearest centre, and centres to their rows' mean, until none moves by over 1e-9. Ties go to the smaller id and the earlier
    centre. Distances are rounded to 12 digits. A key with fewer different rows than k has fewer groups.
    """
    vector = F.array(*(F.col(v).cast("double") for v in values))
    centres = staged(rows.groupBy(*keys).agg(F.array(F.array(*(F.avg(v) for v in values))).alias("centres")), "centres")
    gap = lambda: F.round(F.array_min(F.transform("centres", lambda c: _apart(values, c))), 12)
    for step in range(k):
        far = rows.join(centres, keys).groupBy(*keys).agg(F.max_by(F.struct(gap().alias("gap"), vector.alias("at")), F.struct(gap(), -F.col("id"))).alias("far"), F.first("centres").alias("centres"))
        grown = F.concat("centres", F.array("far.at")) if step else F.array("far.at")
        centres = staged(far.select(*keys, F.when((F.col("far.gap") > 0) | F.lit(step == 0), grown).otherwise(F.col("centres")).alias("centres")), "centres")
    nearest = F.array_min(F.transform("centres", lambda c, i: F.struct(F.round(_apart(values, c), 12).alias("d"), i.alias("i"))))["i"]
    for _ in range(rounds):
        groups = rows.join(centres, keys).withColumn("_g", nearest).groupBy(*keys, "_g").agg(F.array(*(F.avg(v) for v in values)).alias("at"), F.first("centres").alias("old"))
        moved = groups.withColumn("moved", F.sqrt(_apart_arrays("at", "old", len(values))))
        step = staged(moved.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_g", "at"))), lambda s: s["at"]).alias("centres"), F.max("moved").alias("moved")), "centres")
        centres, most = step.select(*keys, "centres"), step.agg(F.max("moved")).first()[0]
        if most is None or most <= 1e-9:
            break
    found = staged(rows.join(centres, keys).select(*keys, "id", nearest.alias("_g")), "groups")
    sizes = found.groupBy(*keys, "_g").agg(F.struct((-F.count(F.lit(1))).alias("n"), F.min("id").alias("first"), F.col("_g")).alias("s"))
    order = sizes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["_g"]).alias("order"))  # k of a key
    return found.join(order, keys).select(*keys, "id", (F.array_position("order", F.col("_g")) - 1).alias("label"))


def _apart_arrays(at: str, centres: str, n: int) -> Column:
    return sum((F.pow(F.get(at, F.lit(i)) - F.get(F.get(F.col(centres), F.col("_g")), F.lit(i)), 2) for i in range(n)), F.lit(0.0))


def grouped(vectors: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, id, label): nodes in k groups by their k leading vectors over the roots of their degrees, as leading gives them."""
    names = _names("x", k)
    placed = staged(vectors.select(*keys, "id", *((F.col(v) / F.sqrt("degree")).alias(v) for v in names)), "embedded")
    return nearest_groups(placed, keys, names, k)


def clusters(graph: DataFrame, keys: list[str], k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(keys, id, label) of each graph's nodes in k groups, and (keys, place, value, off) of its leading values; see leading and grouped."""
    vectors, values = leading(graph, keys, k, seed)
    return grouped(vectors, keys, k), values
