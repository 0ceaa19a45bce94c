"""Whitening of embeddings by the upper triangle of their covariance.

Every entry becomes a long. One aggregation gives the number of vectors and the sums of the dimensions. One more
has a generated sum of centred products for each pair of dimensions, i <= j: the upper triangle of the covariance. The driver
gets those few thousand numbers, mirrors them and has LAPACK decompose the matrix; the components go back into expressions.
No row leaves the executors, and nothing is shuffled but the sums of tasks.

Defined results: vectors that are null or hold null, NaN or infinite entries are dropped. Where lengths differ, the
most common one counts (the longest of equally common ones) and vectors of another length are dropped, as there is
no component for them. Repeated rows and null ids are rows like any other. A component without variance (an eigenvalue of at most
NOTHING of the trace) whitens everything to 0 and is left out of the identity error. Without a vector, or with vectors of
length 0, the report is empty. A deviation beyond 64 bits is null. Columns of any name may be there; they are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.shared import table

#: Entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components reported at most; sums that one aggregation may hold (91 dimensions), more are dealt over several.
COMPONENTS, SUMS = 8, 4_200
#: Share of the trace below which an eigenvalue is rounding.
NOTHING = 1e-12


@dataclass
class Whitening:
    """n, sums: of the fit list; values, vectors: eigenvalues, falling, and unit eigenvectors as columns; trace: of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, x0, x1 ...) of the vectors that remain, and how many dimensions they have."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & ~F.abs(c).eqNullSafe(F.lit(float("inf"))))
    kept = rows.select(F.col(id_col).alias("vec_id"), vector.alias("v")).filter(F.col("v").isNotNull() & finite)
    lengths = kept.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return kept.filter(F.size("v") == d).select("vec_id", *((F.floor(F.col("v")[i] * SCALE) + SHIFT).alias(f"x{i}") for i in range(d))), d


def fit(vectors: DataFrame, d: int) -> Whitening | None:
    """The decomposition of the covariance of x0 ... x(d-1); None if there is nothing to fit."""
    names = [f"x{i}" for i in range(d)]
    n, *sums = vectors.agg(F.count(F.lit(1)), *(F.sum(c) for c in names)).first() if d else (0,)
    if not n:
        return None
    centred = vectors.select(*((F.col(c) - F.lit(s / n)).alias(c) for c, s in zip(names, sums)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    products = [f"sum(x{i} * x{j})" for i, j in pairs]
    triangle = [v for at in range(0, len(pairs), SUMS) for v in centred.selectExpr(*products[at : at + SUMS]).first()]
    covariance = np.zeros((d, d))
    for (i, j), v in zip(pairs, triangle):
        covariance[i, j] = covariance[j, i] = v / n
    values, components = np.linalg.eigh(covariance)
    return Whitening(n, sums, values[::-1], components[:, ::-1], float(np.trace(covariance)))


def total(terms: list[Column], plus: Callable[[Column, Column], Column] = add) -> Column:
    """The sum of the terms as a flat tree, so that no expression is nested as deep as there are terms."""
    while len(terms) > 1:
        terms = [reduce(plus, terms[at : at + 8]) for at in range(0, len(terms), 8)]
    return terms[0]


def deviation(model: Whitening) -> Column:
    """The sum of (n x - S)^2 over all dimensions, in whole numbers; null where 64 bits are too narrow."""
    squares = []
    for i, s in enumerate(model.sums):
        apart = F.try_subtract(F.try_multiply(F.lit(model.n).cast("bigint"), F.col(f"x{i}")), F.lit(s).cast("bigint"))
        squares.append(F.try_multiply(apart, apart))
    return total(squares, F.try_add)


def whitened(vectors: DataFrame, model: Whitening, components: int) -> DataFrame:
    """(vec_id, deviation, w1, w2 ...): the projections on the first components, each over the root of its eigenvalue."""
    centred = [F.col(f"x{i}") - F.lit(s / model.n) for i, s in enumerate(model.sums)]
    out = [deviation(model).alias("deviation")]
    for k in range(components):
        if model.values[k] <= NOTHING * model.trace:
            out.append(F.lit(0.0).alias(f"w{k + 1}"))
        else:
            root = float(np.sqrt(model.values[k]))
            out.append((total([c * F.lit(float(v)) for c, v in zip(centred, model.vectors[:, k])]) / root).alias(f"w{k + 1}"))
    return vectors.select("vec_id", *out)


def identity_error(white: DataFrame, model: Whitening, components: int) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity."""
    live = [k + 1 for k in range(components) if model.values[k] > NOTHING * model.trace]
    pairs = [(i, j) for i in live for j in live if i <= j]
    if not pairs:
        return 0.0
    found = white.selectExpr(*(f"covar_pop(w{i}, w{j})" for i, j in pairs)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


REPORT = "vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors, d = integers(rows, id_col, vector_col)
    model = fit(vectors, d)
    if model is None:
        return rows.sparkSession.createDataFrame([], REPORT.format(kind=rows.schema[id_col].dataType.simpleString()))
    k = min(components, d)
    white = whitened(vectors, model, k)
    error = identity_error(white, model, k)
    share = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values[:k]]
    each = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("component"), F.col(f"w{i + 1}").alias("whitened"), F.lit(share[i]).alias("explained")) for i in range(k))))
    report = white.select("vec_id", "deviation", each.alias("c"))
    return report.select("vec_id", "c.component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
