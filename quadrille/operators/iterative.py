"""Iterative operators as rounds of joins: superpixels, cells around seeds, communities; and permutation nulls by region."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.folders import shared_dir


#: Parts of the nodes that move in turn.
TURNS = 4

#: Links of a key up to which its turns are taken in one group; a key with more takes each of them by joins. Cycles of turns that a job takes.
TOGETHER, CYCLES = 1 << 20, 64


def slic(pixels: DataFrame, keys: list[str], signal: str, scale: float, compactness: float = 10.0, rounds: int = 10) -> DataFrame:
    """(keys, x, y, label): simple linear iterative clustering of pixels by place and signal.

    Centres start on a grid of the given scale. In each round a pixel looks at the centres whose grid
    squares touch its own, takes the nearest by distance in space over the scale plus difference of
    signal over the compactness, and centres move to their pixels' mean. It ends when no label changes, after `rounds` at most (the usual ten). A label is the number of
    its starting square.
    """
    shared_dir(pixels.sparkSession)
    width = 1 << 16
    square = (F.floor(F.col("y") / scale) * width + F.floor(F.col("x") / scale)).cast("bigint")
    px = pixels.select(*keys, "x", "y", F.col(signal).cast("double").alias("v"), square.alias("label"))
    around = F.explode(F.array(*(F.lit(dy * width + dx).cast("bigint") for dy in (-1, 0, 1) for dx in (-1, 0, 1))))
    ask = px.withColumn("_step", around).withColumn("near", F.col("label") + F.col("_step")).drop("label", "_step")
    nearest = Window.partitionBy(*keys, "x", "y").orderBy("d", "near")
    labels = px
    for _ in range(rounds):
        centres = labels.groupBy(*keys, F.col("label").alias("near")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("v").alias("cv"))
        far = (F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) / (scale * scale) + F.pow((F.col("v") - F.col("cv")) / compactness, 2)
        best = ask.join(centres, [*keys, "near"]).withColumn("d", F.round(far, 9)).withColumn("_r", F.row_number().over(nearest)).filter("_r = 1")
        now = best.select(*keys, "x", "y", "v", F.col("near").alias("label")).checkpoint()
        still = now.join(labels.select(*keys, "x", "y", F.col("label").alias("_was")), [*keys, "x", "y"]).filter("label <> _was").isEmpty()
        labels = now
        if still:
            break
    return labels.select(*keys, "x", "y", "label")


def seeds(raster: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """(keys, id, x, y): raster cells (bin_x, bin_y) above `least` that no neighbouring cell exceeds; of equal neighbours the first by row and column."""
    cells = raster.select(*keys, "bin_x", "bin_y", F.col(value).alias("v"))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)))
    around = cells.withColumn("s", steps).select(*keys, (F.col("bin_x") + F.col("s.dx")).alias("bin_x"), (F.col("bin_y") + F.col("s.dy")).alias("bin_y"), F.struct("v", (-F.col("bin_y")).alias("y"), (-F.col("bin_x")).alias("x")).alias("o"))
    top = around.groupBy(*keys, "bin_x", "bin_y").agg(F.max("o").alias("o"))
    own = F.struct("v", (-F.col("bin_y")).alias("y"), (-F.col("bin_x")).alias("x"))
    peaks = cells.filter(F.col("v") > least).join(top, [*keys, "bin_x", "bin_y"], "left").filter(F.col("o").isNull() | (own > F.col("o")))
    return peaks.select(*keys, (F.col("bin_y") * (1 << 16) + F.col("bin_x")).alias("id"), F.col("bin_x").cast("double").alias("x"), F.col("bin_y").cast("double").alias("y"))


def cells_around(raster: DataFrame, peaks: DataFrame, keys: list[str], value: str, least: float, radius: float) -> DataFrame:
    """(keys, bin_x, bin_y, label): foreground cells labelled by the nearest seed within the radius, -1 for the rest."""
    side = radius
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    front = raster.filter(F.col(value) > least).select(*keys, "bin_x", "bin_y")
    ask = front.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumns({"_bx": F.floor(F.col("bin_x") / side) + F.col("_dx"), "_by": F.floor(F.col("bin_y") / side) + F.col("_dy")})
    have = peaks.withColumns({"_bx": F.floor(F.col("x") / side), "_by": F.floor(F.col("y") / side)})
    d2 = F.pow(F.col("bin_x") - F.col("x"), 2) + F.pow(F.col("bin_y") - F.col("y"), 2)
    near = ask.join(have, [*keys, "_bx", "_by"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).groupBy(*keys, "bin_x", "bin_y").agg(F.min(F.struct("d2", "id"))["id"].alias("label"))
    return front.join(near, [*keys, "bin_x", "bin_y"], "left").na.fill(-1, ["label"])


def communities(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, label): label propagation over weighted edges (src, dst, weight), both directions given, until no node moves.

    Each node takes the label with the most weight around it, but only for one with more weight than its own has. Nodes
    move in turn, one quarter of them by hash at a time, other quarters in each cycle, so that neighbours seldom swap. A community is named by its smallest member.
    """
    shared_dir(edges.sparkSession)
    links = edges.select(*keys, "src", "dst", "weight").checkpoint()
    wide = links.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > TOGETHER).select(*keys).checkpoint()
    if wide.isEmpty():
        labels = _moved_together(links, keys)
    else:
        labels = _moved_together(links.join(wide, keys, "left_anti"), keys).unionByName(_moved_by_joins(links.join(wide, keys, "left_semi").checkpoint(), keys))
    names = labels.groupBy(*keys, "label").agg(F.min("id").alias("_name"))
    return labels.join(names, [*keys, "label"]).select(*keys, "id", F.col("_name").alias("label"))


def _moved_together(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, label) when no node moves any more: a key's turns, those that joins would take, follow one another in its group.

    A key is at rest after a cycle in which none of its nodes moved, whatever others do; keys that are not yet are dealt to another job.
    """
    def run(nodes: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id", ignore_index=True)
        ids, n = nodes["id"].to_numpy(), len(nodes)
        src, dst, weight = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"]), e["weight"].to_numpy(float)
        label, turns, moved = np.searchsorted(ids, nodes["label"]), np.stack(nodes["turns"].to_numpy()), n > 0
        for cycle in range(CYCLES if n else 0):
            moved = False
            for turn in range(TURNS):
                mine = turns[src, cycle] == turn
                pairs, at = np.unique(src[mine] * n + label[dst[mine]], return_inverse=True)
                w = np.round(np.bincount(at, weight[mine], len(pairs)), 9)
                node, near = np.divmod(pairs, n)
                own = np.zeros(n)
                own[node[near == label[node]]] = w[near == label[node]]
                order = np.lexsort((near, -w, node))
                best = order[np.flatnonzero(np.diff(node[order], prepend=-1))]
                best = best[w[best] > own[node[best]]]
                label[node[best]] = near[best]
                moved |= len(best) > 0
            if not moved:
                break
        return nodes[keys].assign(id=ids, label=ids[label], moving=moved)

    kinds = dict(links.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"id {kinds['src']}, label {kinds['src']}, moving boolean"])
    state = links.select(*keys, F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    out, first = None, 0
    while True:
        turns = F.transform(F.sequence(F.lit(first), F.lit(first + CYCLES - 1)), lambda c: F.pmod(F.xxhash64(c, F.col("id")), F.lit(TURNS)))
        left, right = state.withColumn("turns", turns).groupBy(*keys), links.select(*(F.col(k).alias(f"_{k}") for k in keys), "src", "dst", "weight").groupBy(*(f"_{k}" for k in keys))
        made = left.cogroup(right).applyInPandas(run, schema).checkpoint()
        rest = made.filter("NOT moving").drop("moving")
        out = rest if out is None else out.unionByName(rest)
        state, first = made.filter("moving").drop("moving"), first + CYCLES
        if state.isEmpty():
            return out
        links = links.join(state.select(*keys).distinct(), keys, "left_semi")


def _moved_by_joins(links: DataFrame, keys: list[str]) -> DataFrame:
    """As _moved_together, each turn by joins: for keys that no task should hold."""
    labels = links.select(*keys, F.col("src").alias("id")).distinct().withColumn("label", F.col("id")).checkpoint()
    turn, moved = 0, True
    while moved or turn % TURNS:  # ends with a cycle in which no node of any part moved
        moved = moved and turn % TURNS > 0
        around = links.join(labels.withColumnRenamed("id", "dst"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("id"), "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        best = around.groupBy(*keys, "id").agg(F.max(F.struct("w", (-F.col("label")).alias("back"))).alias("m"))
        own = around.select(*keys, "id", "label", F.col("w").alias("_own"))
        mine = F.pmod(F.xxhash64(F.lit(turn // TURNS), "id"), F.lit(TURNS)) == turn % TURNS
        moves = mine & (F.col("m.w") > F.coalesce("_own", F.lit(0.0)))
        now = labels.join(best, [*keys, "id"], "left").join(own, [*keys, "id", "label"], "left").select(*keys, "id", F.col("label").alias("old"), F.when(moves, -F.col("m.back")).otherwise(F.col("label")).alias("label")).checkpoint()
        moved |= not now.filter("old <> label").isEmpty()
        labels, turn = now.drop("old"), turn + 1
    return labels


def modularity(edges: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, modularity) of a labelling of weighted edges given in both directions."""
    a = labels.select(*keys, F.col("id").alias("src"), F.col("label").alias("la"))
    b = labels.select(*keys, F.col("id").alias("dst"), F.col("label").alias("lb"))
    both = edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"])
    inside = both.groupBy(*keys).agg(F.sum("weight").alias("m2"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("win"))
    degree = both.groupBy(*keys, "la").agg(F.sum("weight").alias("d")).groupBy(*keys).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return inside.join(degree, keys).select(*keys, (F.col("win") / F.col("m2") - F.col("dd") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def permutation_p(units: DataFrame, edges: DataFrame, key: str, label: str, n: int = 999, salt: int = 42) -> DataFrame:
    """(key, focal, neighbour, p): two-sided share of label shuffles whose observed share is as far from the overall share.

    A region is the unit of the null, so its labels and edges come together; a region is bounded by
    what one field of view holds. The shuffles are seeded by the region's name.
    """
    def run(u: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if u.empty:
            return pd.DataFrame({key: [], "focal": [], "neighbour": [], "p": []})
        u = u.sort_values("id")
        names, code = np.unique(u[label].to_numpy(str), return_inverse=True)
        at = pd.Series(np.arange(len(u)), index=u["id"].to_numpy())
        e = e[e["src"].isin(at.index) & e["dst"].isin(at.index)]
        src, dst, k = at[e["src"].to_numpy()].to_numpy(), at[e["dst"].to_numpy()].to_numpy(), len(names)
        expected = np.bincount(code, minlength=k) / len(code)

        def share(c: np.ndarray) -> np.ndarray:
            m = np.bincount(c[src] * k + c[dst], minlength=k * k).reshape(k, k).astype(float)
            return m / np.maximum(m.sum(axis=1, keepdims=True), 1)

        rng = np.random.default_rng([salt, int(hashlib.sha256(str(u[key].iloc[0]).encode()).hexdigest()[:8], 16)])
        far = np.abs(share(code) - expected)
        beyond = sum((np.abs(share(rng.permutation(code)) - expected) >= far - 1e-12).astype(int) for _ in range(n))
        f, g = np.divmod(np.arange(k * k), k)
        return pd.DataFrame({key: u[key].iloc[0], "focal": names[f], "neighbour": names[g], "p": ((beyond + 1) / (n + 1)).ravel()})

    kind = units.schema[key].dataType.simpleString()
    # New names on both sides: the edges come from the units, and cogrouping needs their keys told apart.
    left = units.select(F.col(key).alias(key), "id", label).groupBy(key)
    right = edges.select(F.col(key).alias("_of"), "src", "dst").groupBy("_of")
    return left.cogroup(right).applyInPandas(run, f"{key} {kind}, focal string, neighbour string, p double")


def join_count_z(units: DataFrame, edges: DataFrame, key: str, flags: list[str], n: int = 1_000, least: int = 10, salt: int = 42) -> DataFrame:
    """(key, flag, n_total, n_positive, observed, null_mean, null_sd, z, sufficient, saturated): joins of flagged units against shuffles.

    A flag with fewer than `least` positives, or that all units have, has no null. A key is one field of view.
    """
    def run(u: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if u.empty:
            return pd.DataFrame({c: [] for c in names})
        u = u.sort_values("id")
        at = pd.Series(np.arange(len(u)), index=u["id"].to_numpy())
        e = e[e["src"].isin(at.index) & e["dst"].isin(at.index)]
        src, dst = at[e["src"].to_numpy()].to_numpy(), at[e["dst"].to_numpy()].to_numpy()
        rng = np.random.default_rng([salt, int(hashlib.sha256(str(u[key].iloc[0]).encode()).hexdigest()[:8], 16)])
        rows = []
        for f in flags:
            on = u[f].to_numpy(bool)
            positive = int(on.sum())
            saturated = positive in (0, len(on))
            row = [u[key].iloc[0], f, len(on), positive, None, None, None, None, positive >= least and not saturated, saturated]
            if row[8] and len(src):
                null = np.empty(n)
                for i in range(n):
                    shuffled = rng.permutation(on)
                    null[i] = np.count_nonzero(shuffled[src] & shuffled[dst])
                observed, sd = float(np.count_nonzero(on[src] & on[dst])), float(null.std(ddof=1))
                row[4:8] = [observed, float(null.mean()), sd, (observed - float(null.mean())) / sd if sd > 0 else None]
            rows.append(row)
        return pd.DataFrame(rows, columns=names)

    names = [key, "flag", "n_total", "n_positive", "observed", "null_mean", "null_sd", "z", "sufficient", "saturated"]
    kind = units.schema[key].dataType.simpleString()
    left = units.select(F.col(key).alias(key), "id", *flags).groupBy(key)
    right = edges.select(F.col(key).alias("_of"), "src", "dst").groupBy("_of")
    return left.cogroup(right).applyInPandas(run, f"{key} {kind}, flag string, n_total bigint, n_positive bigint, observed double, null_mean double, null_sd double, z double, sufficient boolean, saturated boolean")


def bootstrap_range(df: DataFrame, keys: list[str], group: str, value: str, first: str, second: str, draws: int = 10_000, salt: int = 42) -> DataFrame:
    """(keys, g, low, high): Hedges' g of two groups and the middle 95 percent of seeded resamples. A key holds a few subjects."""
    def g(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = a.shape[-1], b.shape[-1]
        pooled = ((n - 1) * a.var(axis=-1, ddof=1) + (m - 1) * b.var(axis=-1, ddof=1)) / (n + m - 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(pooled > 1e-24, (b.mean(axis=-1) - a.mean(axis=-1)) / np.sqrt(pooled), np.nan) * (1 - 3 / (4 * (n + m - 2) - 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: pdf[k].iloc[0] for k in keys}
        a, b = (np.sort(pdf.loc[pdf[group] == x, value].dropna().to_numpy(float)) for x in (first, second))
        if min(len(a), len(b)) < 2:
            return pd.DataFrame([{**row, "g": None, "low": None, "high": None}])
        rng = np.random.default_rng([salt, int(hashlib.sha256("|".join(map(str, row.values())).encode()).hexdigest()[:8], 16)])
        drawn = g(a[rng.integers(0, len(a), (draws, len(a)))], b[rng.integers(0, len(b), (draws, len(b)))])
        drawn = drawn[np.isfinite(drawn)]
        low, high = np.percentile(drawn, [2.5, 97.5]) if len(drawn) >= 100 else (None, None)
        return pd.DataFrame([{**row, "g": float(g(a, b)), "low": low, "high": high}])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{schema}, g double, low double, high double")
