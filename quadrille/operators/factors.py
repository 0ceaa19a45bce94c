"""Features chosen and markers grouped from sums of products: principal component, mutual information, lasso, modules.

What leaves the executors are sums whose size is that of the features squared, however many rows there are. Rows with a null or
non-finite value are left out. Of a factorisation only the loadings are kept between rounds: scores of a row follow from them, so no
table of scores is rewritten, and a lost executor costs its tasks of one round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sweeps of coordinate descent at most, and before the equations are solved; what a slope may be off, as a share of the steepest.
SWEEPS, SETTLE, STILL = 5000, 20, 1e-8


def summed(df: DataFrame, columns: list[str | Column], part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of part(rows of the columns), a matrix of the given shape: zeros for an empty table.

    Each task adds up its own rows first and gives one matrix.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for b in batches:
            x = b.to_numpy(dtype=float, na_value=np.nan)
            x = x[np.isfinite(x).all(axis=1)]
            if len(x):
                total += part(x)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    named = [(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"_{n}") for n, c in enumerate(columns)]
    out = np.zeros(shape)
    for r in df.select(*named).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def means(df: DataFrame, values: list[str]) -> tuple[int, np.ndarray]:
    """(rows, mean of each value) over complete rows."""
    s = summed(df, values, lambda x: np.concatenate([[len(x)], x.sum(axis=0)])[None, :], (1, len(values) + 1))[0]
    return int(s[0]), s[1:] / max(s[0], 1)


def products(df: DataFrame, values: list[str], centre: np.ndarray) -> np.ndarray:
    """The sum of products of each two values, less their centre."""
    return summed(df, values, lambda x: (x - centre).T @ (x - centre), (len(values), len(values)))


def fold_moments(df: DataFrame, values: list[str], fold: Column, folds: int, centre: np.ndarray) -> np.ndarray:
    """(folds, p + 1, p + 1): sums of products of one and of the values less their centre, for each fold 0, 1, ..."""
    p = len(values)

    def part(x: np.ndarray) -> np.ndarray:
        a = np.column_stack([np.ones(len(x)), x[:, :-1] - centre])
        return np.concatenate([a[x[:, -1] == f].T @ a[x[:, -1] == f] for f in range(folds)])

    return summed(df, [*values, fold], part, (folds * (p + 1), p + 1)).reshape(folds, p + 1, p + 1)


def first_component(covariance: np.ndarray) -> np.ndarray:
    """The unit vector of most variance; of its two signs that in which the largest entry is positive."""
    v = np.linalg.eigh(covariance)[1][:, -1]
    return v * np.sign(v[np.argmax(np.abs(v))])


def mutual_information(df: DataFrame, values: list[str], target: str, bins: int = 16) -> DataFrame:
    """(feature, n, information): mutual information in nats of each value with the target, both in bins of equal width.

    Rows in which either is null are left out; a value without spread has one bin and tells nothing. An empty table gives no row.
    """
    ends = df.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate([*values, target]) for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def binned(i: int, c: str) -> Column:
        lo, hi = ends[f"lo_{i}"], ends[f"hi_{i}"]
        if lo is None:
            return F.lit(None).cast("int")
        at = F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)) if hi > lo else F.lit(0)
        return F.when(F.col(c).isNotNull(), at.cast("int"))

    one = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), binned(i, c).alias("a")) for i, c in enumerate(values)))).alias("e")
    cells = df.select(binned(len(values), target).alias("b"), one).filter("b IS NOT NULL AND e.a IS NOT NULL").groupBy("e.feature", "e.a", "b").agg(F.count(F.lit(1)).alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    counts = cells.withColumns({"na": over("a"), "nb": over("b"), "all": over()})
    told = F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))
    return counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum(told).alias("information"))


def component_target(df: DataFrame, values: list[str], name: str) -> DataFrame:
    """Adds each row's place along the first principal component of the values."""
    n, centre = means(df, values)
    if not n:
        return df.withColumn(name, F.lit(None).cast("double"))
    v = first_component(products(df, values, centre) / n)
    return df.withColumn(name, reduce(add, ((F.col(c) - F.lit(float(m))) * F.lit(float(w)) for c, m, w in zip(values, centre, v))))


def most_informative(df: DataFrame, values: list[str], n: int, bins: int = 16) -> DataFrame:
    """(feature, information, place): the n values that tell most of the first principal component; ties by name."""
    scores = mutual_information(component_target(df, values, "_component"), values, "_component", bins)
    w = Window.orderBy(F.desc(F.round("information", 9)), "feature")  # a row a feature
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("feature", "information", "place")


def descend(gram: np.ndarray, along: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """The w of least w.gram.w/2 - along.w + penalty*|w|: coordinate descent over what is not zero, until no other has a reason to enter.

    Nearly equal columns let the descent creep, so that every few sweeps the equations of what is not zero are solved at once.
    """
    w, own, close = start.copy(), np.diag(gram), STILL * max(np.abs(along).max(initial=0.0), 1e-300)
    active = np.flatnonzero(w)
    for _ in range(SWEEPS // SETTLE):
        rest = along - gram @ w
        for _ in range(SETTLE):
            for j in active[own[active] > 0]:
                pull = rest[j] + own[j] * w[j]
                new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / own[j]
                if new != w[j]:
                    rest -= gram[:, j] * (new - w[j])
                    w[j] = new
        on = np.flatnonzero(w)
        while len(on):  # within the signs the cost falls all the way to the solution, or to where the first of them would turn
            way = np.linalg.lstsq(gram[np.ix_(on, on)], along[on] - penalty * np.sign(w[on]), rcond=None)[0] - w[on]
            turns = np.where(np.sign(w[on] + way) != np.sign(w[on]), -w[on] / np.where(way == 0, 1.0, way), np.inf)
            first = int(turns.argmin())
            w[on] += way * min(turns[first], 1.0)
            if turns[first] > 1.0:
                break
            w[on[first]] = 0.0
            on = np.flatnonzero(w)
        rest = along - gram @ w
        off = np.where(w != 0, np.abs(rest - penalty * np.sign(w)), np.maximum(np.abs(rest) - penalty, 0.0)) * (own > 0)
        if off.max(initial=0.0) <= close:
            break
        active = np.union1d(on, np.flatnonzero(off > close))
    return w


def _centred(m: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
    """(gram, along, square, mean of the values, mean of the target), by row, of moments whose target is the values' sum by weights."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    gram = m[1:, 1:] / n - np.outer(mean, mean)
    return gram, gram @ weights, float(weights @ gram @ weights), mean, float(mean @ weights)


def penalties(along: np.ndarray, n: int, least: float) -> np.ndarray:
    """n penalties, falling evenly by ratio from the smallest that leaves nothing to `least` times it."""
    return np.abs(along).max() * np.logspace(0, np.log10(least), n)


def lasso(df: DataFrame, values: list[str], by: str, folds: int = 5, steps: int = 30, least: float = 1e-3) -> DataFrame:
    """(feature, coefficient, penalty): the values that a sparse sum needs to follow the first principal component.

    The penalty is the one of least squared error over folds, which are dealt by the hash of column `by`; of equal ones the
    largest. Both errors and coefficients follow from each fold's sums of products; the folds' paths are solved side by side.
    Values are centred, not scaled. An empty table gives coefficients of zero.
    """
    spark, p = df.sparkSession, len(values)
    n, centre = means(df, values)
    found, chosen = np.zeros(p), None
    if n:
        m = fold_moments(df, values, F.pmod(F.crc32(F.coalesce(F.col(by).cast("string"), F.lit(""))), F.lit(folds)), folds, centre)
        weights = first_component(m.sum(axis=0)[1:, 1:] / n)
        gram, along, *_ = _centred(m.sum(axis=0), weights)
        path = penalties(along, steps, least)

        def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for f in b["id"]:
                    test, train = m[f], m.sum(axis=0) - m[f]
                    if not test[0, 0] or not train[0, 0]:
                        continue
                    g, a, _, mean, level = _centred(train, weights)
                    w = np.zeros(p)
                    for step, penalty in enumerate(path):
                        w = descend(g, a, penalty, w)
                        d = np.concatenate([[level - w @ mean], w - weights])  # prediction less target, of one and the values
                        yield pd.DataFrame({"step": [step], "error": [float(d @ test @ d) / test[0, 0]]})

        mse = spark.range(0, folds, 1, folds).mapInPandas(errors, "step int, error double").groupBy("step").agg(F.avg("error").alias("e")).collect()
        best = min(((round(r["e"], 12), r["step"]) for r in mse), default=(0.0, steps - 1))[1]
        chosen = float(path[best])
        for penalty in path[: best + 1]:
            found = descend(gram, along, penalty, found)
    return spark.createDataFrame([(v, float(w), chosen) for v, w in zip(values, found)], "feature string, coefficient double, penalty double")


def nonnegative(x: np.ndarray, loadings: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """For each row of x the w >= 0 that brings w @ loadings nearest to it."""
    gram, along = loadings @ loadings.T, x @ loadings.T
    w = np.zeros_like(along)
    for _ in range(sweeps):
        before = w.copy()
        for j in range(len(loadings)):
            if gram[j, j] > 0:
                w[:, j] = np.maximum(w[:, j] + (along[:, j] - w @ gram[:, j]) / gram[j, j], 0.0)
        if np.abs(w - before).max(initial=0.0) <= 1e-10 * max(np.abs(w).max(initial=0.0), 1e-300):
            break
    return w


def _from_gram(square: np.ndarray, along: np.ndarray) -> np.ndarray:
    """The h >= 0 of least tr(h'.square.h)/2 - tr(h'.along): a column a value."""
    values, vectors = np.linalg.eigh(square)
    root = vectors * np.sqrt(np.maximum(values, 1e-12 * max(values.max(), 1e-300)))  # square = root root'
    return nonnegative(np.linalg.solve(root, along).T, root, 2000).T


def starting_loadings(df: DataFrame, values: list[str], k: int, low: float) -> np.ndarray:
    """Non-negative loadings from the leading singular vectors: of each the sign whose part weighs more, zeros set to the mean."""
    p, shift = len(values), np.full(len(values), low)
    s = summed(df, values, lambda x: np.vstack([(x - shift).T @ (x - shift), (x - shift).sum(axis=0), np.full(p, len(x))]), (p + 2, p))
    level = s[p].sum() / max(s[p + 1].sum(), 1)
    squares, vectors = np.linalg.eigh(s[:p])
    squares, v = np.sqrt(np.maximum(squares[::-1][:k], 0)), vectors[:, ::-1][:, :k].T
    h = np.zeros((k, p))
    h[0] = np.sqrt(squares[0]) * np.abs(v[0])

    def sides(x: np.ndarray) -> np.ndarray:
        u = (x - shift) @ v.T
        return np.vstack([(np.maximum(u, 0) ** 2).sum(axis=0), (np.maximum(-u, 0) ** 2).sum(axis=0)])

    norms = np.sqrt(summed(df, values, sides, (2, k)))
    for j in range(1, k):
        if squares[j] <= 0:
            continue
        plus, minus = np.maximum(v[j], 0), np.maximum(-v[j], 0)
        a, b = norms[0, j] * np.linalg.norm(plus), norms[1, j] * np.linalg.norm(minus)
        side, weight = (plus, a) if a >= b else (minus, b)
        h[j] = np.sqrt(weight) * side / max(np.linalg.norm(side), 1e-300)
    h[h < 1e-10] = level
    return h


def nonnegative_modules(df: DataFrame, values: list[str], k: int, rounds: int = 200, still: float = 1e-5) -> tuple[np.ndarray, float, list[float]]:
    """(loadings k x values, least value if below zero, squared loss of each round): non-negative factors of the rows.

    In a round each row's scores are the best ones under the loadings, and the loadings the best ones under the scores' sums of
    products; it ends when the loss falls by less than `still` of the first. Values below zero are raised by the least one of all.
    k is at most the number of values.
    """
    k = min(k, len(values))
    found = df.agg(F.min(F.least(*values) if len(values) > 1 else F.col(values[0]))).first()[0]
    low = min(float(found), 0.0) if found is not None else 0.0
    h, losses = starting_loadings(df, values, k, low), []
    for _ in range(rounds if found is not None else 0):
        def part(x: np.ndarray, h: np.ndarray = h) -> np.ndarray:
            w = nonnegative(x - low, h)
            lost = np.zeros((1, k + len(values)))
            lost[0, 0] = ((x - low - w @ h) ** 2).sum()
            return np.vstack([np.hstack([w.T @ w, w.T @ (x - low)]), lost])

        s = summed(df, values, part, (k + 1, k + len(values)))
        losses.append(float(s[k, 0]))
        if len(losses) > 1 and losses[-2] - losses[-1] <= still * losses[0]:
            break
        h = _from_gram(s[:k, :k], s[:k, k:])
    return h, low, losses


def independent_modules(df: DataFrame, values: list[str], k: int, rounds: int = 200, still: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(loadings k x values, centre): directions along which whitened rows are least like noise, by the log cosh of all at once.

    k is at most the number of directions that vary. An empty table gives no direction.
    """
    n, centre = means(df, values)
    squares, vectors = np.linalg.eigh(products(df, values, centre) / max(n, 1))
    k = min(k, int((squares > 1e-12 * max(squares.max(), 1e-300)).sum()) if n else 0)
    white = vectors[:, ::-1][:, :k].T / np.sqrt(squares[::-1][:k, None])
    if not k:
        return white, centre

    def apart(w: np.ndarray) -> np.ndarray:
        s, u = np.linalg.eigh(w @ w.T)
        return (u / np.sqrt(np.maximum(s, 1e-300))) @ u.T @ w

    w = apart(np.random.RandomState(seed).normal(size=(k, k)))
    for _ in range(rounds):
        def part(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = (x - centre) @ white.T
            g = np.tanh(z @ w.T)
            return np.hstack([g.T @ z, (1 - g * g).sum(axis=0)[:, None]])

        s = summed(df, values, part, (k, k + 1)) / n
        now = apart(s[:, :k] - s[:, k:] * w)
        ended = np.abs(np.abs((now * w).sum(axis=1)) - 1).max() < still
        w = now
        if ended:
            break
    return w @ white, centre


def composition(spark, loadings: np.ndarray, values: list[str], percentile: float = 75.0) -> DataFrame:
    """(module, feature, loading, member): a value belongs to a module if its loading there is beyond the percentile of the module's."""
    rows = [(i, v, float(x), bool(abs(x) > np.percentile(np.abs(h), percentile))) for i, h in enumerate(loadings) for v, x in zip(values, h)]
    return spark.createDataFrame(rows, "module int, feature string, loading double, member boolean")


def with_scores(df: DataFrame, keys: list[str], values: list[str], score: Callable[[np.ndarray], np.ndarray], k: int) -> DataFrame:
    """(keys, module_0, module_1, ...): score(rows) beside each row's keys; null where a value is null or not finite."""
    names = [f"module_{i}" for i in range(k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[values].to_numpy(dtype=float, na_value=np.nan)
            good = np.isfinite(x).all(axis=1)
            out = np.full((len(x), k), np.nan)
            if good.any():
                out[good] = score(x[good])
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*keys).dtypes), *(f"{n} double" for n in names)])
    return df.select(*keys, *values).mapInPandas(run, schema)
