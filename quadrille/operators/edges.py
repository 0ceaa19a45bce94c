"""Spatial joins: k nearest neighbours and neighbours within a radius, as bucketed equi-joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.folders import staged
from quadrille.functions.rounding import tidy


def _around(points: DataFrame, keys: list[str], side: float) -> DataFrame:
    """Each point once for each of the nine squares around it."""
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    spread = points.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    return spread.withColumns({"_by": F.floor(F.col("y") / side) + F.col("_dy"), "_bx": F.floor(F.col("x") / side) + F.col("_dx")}).drop("_dx", "_dy")


def spread(points: DataFrame, by: list[str]) -> DataFrame:
    """Each point is about to become a hundred pairs: few small partitions, as adaptive execution leaves, would make them on few cores."""
    return points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _pairs(probe: DataFrame, points: DataFrame, keys: list[str], side: float | None, include_self: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(keys, src, dst, d2, ax, ay) of points in neighbouring squares, ax and ay how far apart on each axis; of all points of a key if side is None.

    carry: columns of the points that pairs hold as <column>_src and <column>_dst.
    """
    of = lambda end: [F.col(c).alias(f"{c}_{end}") for c in carry]
    left = spread(probe.select(*keys, F.col("id").alias("src"), "x", "y", *of("src")), [*keys, "src"])
    right = points.select(*keys, F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), *of("dst"))
    on = list(keys)
    if side is not None:
        left = _around(left, keys, side)
        right = right.withColumns({"_by": F.floor(F.col("y2") / side), "_bx": F.floor(F.col("x2") / side)})
        on += ["_by", "_bx"]
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    carried = [f"{c}_{end}" for end in ("src", "dst") for c in carry]
    pairs = left.join(right, on).select(*keys, "src", "dst", (dx * dx + dy * dy).alias("d2"), F.abs(dx).alias("ax"), F.abs(dy).alias("ay"), *carried)
    return pairs if include_self else pairs.filter("src <> dst")


def knn(points: DataFrame, keys: list[str], k: int, side: float) -> DataFrame:
    """(keys, src, dst, d2, rank): the k nearest others of each point (id, x, y) within its key.

    Ties go to the smaller id. Squares of the given side hold the candidates; a point whose k-th
    candidate is farther than the side, or that has fewer, looks among squares four times as wide, and so on, until all
    have found theirs or the squares are wider than the widest key. Points of a key with too few others get what there is.
    """
    nearest = Window.partitionBy(*keys, "src").orderBy("d2", "dst")
    ranked = lambda pairs: pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    span = lambda c: F.max(c) - F.min(c)
    widest = points.groupBy(*keys).agg(F.greatest(span("x"), span("y")).alias("w")).agg(F.max("w")).first()[0] or 0.0
    out, probe, width = None, points, side
    while True:
        found = staged(ranked(_pairs(probe, points, keys, width)).select(*keys, "src", "dst", "d2", "rank"), "nearest")
        if width > widest:  # every point has looked at all of its key
            return found if out is None else out.unionByName(found)
        sure = found.groupBy(*keys, "src").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("far")).filter((F.col("n") == k) & (F.col("far") <= width * width)).select(*keys, "src")
        done = found.join(sure, [*keys, "src"], "left_semi")
        out = done if out is None else out.unionByName(done)
        probe = staged(probe.join(sure.withColumnRenamed("src", "id"), [*keys, "id"], "left_anti"), "seekers")
        if probe.isEmpty():
            return out
        width *= 4


def within(points: DataFrame, keys: list[str], radius: float, include_self: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(keys, src, dst, d2, ax, ay): all pairs of points (id, x, y) of a key at most the radius apart, in both directions; carry: see _pairs."""
    return _pairs(points, points, keys, radius, include_self, carry).filter(F.col("d2") <= radius * radius)


def symmetric(edges: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """(keys, src, dst, weight): half the sum of both directions' weights."""
    one = edges.select(*keys, "src", "dst", weight.alias("w"))
    both = one.unionByName(one.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy(*keys, "src", "dst").agg((F.sum("w") / 2).alias("weight"))


#: Vectors that are compared as a matrix, and in a block at least; blocks that a key has at most, about: each block meets each other,
#: so what is moved grows with their number, and with it fixed no faster than the vectors. Stripes of length, a block or two each.
VECTORS, BLOCKS = 512, 32
STRIPES = BLOCKS // 2
#: Share by which lengths may be off.
SAME = 1e-9
#: Vectors in a row of a block, about, so that rows stay small; pairs whose differences are squared at once; pairs that a task holds before it passes them on.
ROW, AT_ONCE, HELD = 2048, 1 << 13, 1 << 18


def _vector_blocks(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, part, ids, vectors, low, high): blocks of vectors (id, vector) of similar length, which lies in low..high: of at most about VECTORS each, larger where a key has more than STRIPES times as many.

    A block is a row, or some of about ROW vectors each, its parts.
    However many vectors are of one length, a stripe is dealt to as many blocks as its count asks for. Null ids and vectors, and vectors with an entry that is null or not finite, are left out.
    """
    whole = F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: F.abs(x) < float("inf"))
    v = vectors.filter(whole).select(*keys, "id", "vector", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("_length"))
    cuts = v.groupBy(*keys).agg(F.greatest(F.lit(VECTORS), F.ceil(F.count(F.lit(1)) / STRIPES)).alias("_size"), F.count(F.lit(1)).alias("_n"), F.percentile_approx("_length", [i / STRIPES for i in range(1, STRIPES)], 1000).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_length")))
    used = F.least(F.lit(STRIPES), F.ceil(F.col("_n") / F.col("_size")))
    v = v.join(cuts, keys).withColumn("_stripe", F.floor(below * used / STRIPES)).drop("_cuts", "_n")
    parts = v.groupBy(*keys, "_stripe").agg(F.ceil(F.count(F.lit(1)) / F.first("_size")).alias("_parts"))
    parts = parts.withColumn("_first", F.sum("_parts").over(Window.partitionBy(*keys).orderBy("_stripe")) - F.col("_parts"))  # a row a stripe
    v = v.join(parts, [*keys, "_stripe"]).withColumns({"block": F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts")), "part": F.pmod(F.hash("id"), F.ceil(F.col("_size") / ROW))})
    made = v.groupBy(*keys, "block", "part").agg(F.collect_list(F.struct("id", "vector")).alias("all"), F.min("_length").alias("low"), F.max("_length").alias("high"))
    return made.select(*keys, "block", "part", F.transform("all", lambda x: x["id"]).alias("ids"), F.flatten(F.transform("all", lambda x: x["vector"])).alias("vectors"), "low", "high")


def _keyed(vectors: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (vectors, keys) if keys else (vectors.withColumn("_all", F.lit(0)), ["_all"])


def _gathered(batches) -> dict:
    """ids, vectors (a row each) and, where there is one, the distance far of each vector, of each block whose rows the batches hold."""
    found = {}
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        for r in range(batch.num_rows):
            ids, flat, far = (columns[c][r].values.to_numpy(zero_copy_only=False) if c in columns else None for c in ("ids", "vectors", "far"))
            found.setdefault(columns["block"][r].as_py(), []).append((ids, flat.reshape(len(ids), flat.size // max(len(ids), 1)), far))
    return {block: tuple(None if x[0] is None else np.concatenate(x) for x in zip(*rows)) for block, rows in found.items()}


def _block_pairs(blocks: DataFrame, by: list[str], compared, apart: bool = False) -> DataFrame:
    """(by, src, dst, d) that compared(block a, block b, whether both are one) yields as arrays for each two blocks of a key, once; for blocks that differ only, if apart.

    blocks: as _vector_blocks makes them, with a column reach: blocks whose lengths lie farther apart than that of either are not compared.
    A pair of blocks is a group of its own, so that pairs spread over tasks, and one fits in memory; what is found is passed on in batches.
    """
    of = blocks.groupBy(*by, "block").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("reach").alias("reach"))
    one, other = (of.select(*by, *(F.col(c).alias(f"{c}_{n}") for c in ("block", "low", "high", "reach"))) for n in "ab")
    met = one.join(other, by).filter(F.col("block_a") < F.col("block_b") if apart else F.col("block_a") <= F.col("block_b"))
    met = met.filter(F.greatest(F.col("low_b") - F.col("high_a"), F.col("low_a") - F.col("high_b")) <= F.greatest("reach_a", "reach_b") + SAME * (F.col("high_a") + F.col("high_b")))
    roles = met.select(*by, "block_a", "block_b", F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    # dealt by block, then by pair: a join by key leaves a key's pairs in one task
    sides = roles.repartition(*by, "block").join(blocks.drop("part", "low", "high", "reach"), [*by, "block"])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, held = _gathered(batches), []

        def passed():
            src, dst, d = (np.concatenate(c) for c in zip(*held))
            held.clear()
            same = {k: pa.repeat(v, len(src)) for k, v in zip(by, key)}
            return pa.RecordBatch.from_pydict({**same, "src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "d": pa.array(d, pa.float64())})

        a, b = (side[k.as_py()] for k in key[-2:])
        for found in compared(a, b, len(side) == 1):
            held.append(found)
            if sum(len(h[0]) for h in held) >= HELD:
                yield passed()
        if held:
            yield passed()

    schema = ", ".join([*(f"`{c}` {t}" for c, t in blocks.select(*by).dtypes), "src bigint, dst bigint, d double"])
    group = [*by, "block_a", "block_b"]
    return sides.repartition(*group).groupBy(*group).applyInArrow(run, schema)


class _Piece(NamedTuple):
    """Some vectors of similar length, and two matrices: one's left by another's right is all squared distances between them, over the square of the scale, in single precision."""

    ids: np.ndarray
    vectors: np.ndarray
    low: float
    high: float
    far: np.ndarray | None
    left: np.ndarray
    right: np.ndarray


def _pieces(block, size: int, scale: float) -> list[_Piece]:
    ids, vectors, far = block
    length = np.sqrt((vectors * vectors).sum(axis=1))
    order, made = np.argsort(length, kind="stable"), []
    for s in range(0, len(order), size):
        c = order[s : s + size]
        u = vectors[c] / scale
        square, one = (u * u).sum(axis=1, keepdims=True), np.ones((len(c), 1))
        left, right = np.hstack([-2 * u, square, one]).astype(np.float32), np.hstack([u, one, square]).astype(np.float32).T
        made.append(_Piece(ids[c], vectors[c], length[c[0]], length[c[-1]], None if far is None else far[c], left, right))
    return made


def _too_far(p: _Piece, q: _Piece, reach: float) -> bool:
    return max(q.low - p.high, p.low - q.high) > reach + SAME * (p.high + q.high)


def _scale(*blocks) -> tuple[float, float]:
    """What no vector is longer than, and how far a squared distance over its square may be off in single precision, or by rounding to nine digits."""
    size = blocks[0][1].shape[1]
    scale = max(float(np.abs(v).max(initial=0)) for _, v, _ in blocks) * max(size, 1) ** 0.5 or 1.0
    return scale, 4.1 * (size + 8) * 2.0**-24 + 1e-9 / scale / scale


def _hits(hit):
    return np.divmod(np.flatnonzero(hit), hit.shape[1])


def _squared(a, b, i, j):
    """Squared distances of the pairs, from the differences themselves, so that they are as exact as by pairs."""
    out = np.empty(len(i))
    for s in range(0, len(i), AT_ONCE):
        d = a[i[s : s + AT_ONCE]] - b[j[s : s + AT_ONCE]]
        out[s : s + AT_ONCE] = np.einsum("ij,ij->i", d, d)
    return np.round(out, 9)


def _reach(d2: Column | float) -> Column:
    """How far lengths of vectors may differ whose squared distance is d2, rounded to nine digits, or less."""
    return F.sqrt(F.lit(d2) + 1e-9) + 1e-6


def vectors_within(vectors: DataFrame, radius2: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, src, dst, d2): all pairs (src < dst) of a key's vectors (id, vector) whose squared distance is at most radius2.

    A product of matrices tells which pairs may be that near; their distances are those of the differences.
    """
    size, reach = VECTORS, (radius2 + 1e-9) ** 0.5 + 1e-6

    def compared(a, b, same):
        scale, slack = _scale(a, b)
        one = _pieces(a, size, scale)
        other, limit = one if same else _pieces(b, size, scale), np.float32(radius2 / scale / scale + slack)
        for i, p in enumerate(one):
            for j, q in enumerate(other):
                if (same and j < i) or _too_far(p, q, reach):
                    continue
                x, y = _hits(p.left @ q.right <= limit)
                src, dst = p.ids[x], q.ids[y]
                apart = src < dst if same and i == j else src != dst
                x, y, src, dst = x[apart], y[apart], src[apart], dst[apart]
                d = _squared(p.vectors, q.vectors, x, y)
                near = d <= radius2
                yield np.minimum(src, dst)[near], np.maximum(src, dst)[near], d[near]

    v, by = _keyed(vectors, keys or [])
    blocks = staged(_vector_blocks(v, by).withColumn("reach", _reach(radius2)), "vector-blocks")
    return _block_pairs(blocks, by, compared).select(*(keys or []), "src", "dst", F.col("d").alias("d2"))


class _Nearest:
    """The k nearest so far of some vectors, by distance and id."""

    def __init__(self, k: int):
        self.k, self.found, self.n, self.full = k, [], 0, HELD

    def add(self, src, dst, d) -> None:
        self.found.append((src, dst, d))
        self.n += len(src)
        if self.n > self.full:
            self.found = [self.best()]
            self.n = len(self.found[0][0])
            self.full = max(HELD, 2 * self.n)

    def best(self):
        src, dst, d = (np.concatenate(c) for c in zip(*self.found)) if self.found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.lexsort((dst, d, src))
        ordered = src[order]
        first = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        order = order[place < self.k]
        return src[order], dst[order], d[order]


def _nearest_of_block(block, k: int, size: int):
    """(vector's place, id, d) of the k nearest others of each vector within its block, by place and rank."""
    ids = block[0]
    scale, slack = _scale(block)
    pieces = _pieces((np.arange(len(ids)), *block[1:]), size, scale)
    alone = len(np.unique(ids)) == len(ids)
    out = []
    for p in pieces:
        best, near = np.full((len(p.ids), k), np.inf, np.float32), _Nearest(k)
        for q in sorted(pieces, key=lambda q: q is not p):  # its own first, so that others have a bound
            d = p.left @ q.right
            if p is q or not alone:
                d[ids[p.ids][:, None] == ids[q.ids][None, :]] = np.inf
            low = np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d
            best = np.partition(np.hstack([best, low]), k - 1, axis=1)[:, :k]
            bound = best[:, k - 1] + np.float32(2 * slack)
            x, y = _hits((d <= bound[:, None]) & (d < np.inf))
            near.add(p.ids[x], ids[q.ids[y]], _squared(p.vectors, q.vectors, x, y))
        out.append(near.best())
    place, dst, d = (np.concatenate(c) for c in zip(*out))
    order = np.argsort(place, kind="stable")
    return place[order], dst[order], d[order]


def vector_knn(vectors: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, src, dst, d2, rank): the k nearest others of each vector of its key.

    Each block is searched first, so that a vector looks in others only for what is nearer than that; of each a vector keeps k at most, so that few rows are ranked.
    """
    size = VECTORS
    v, by = _keyed(vectors, keys or [])
    made = _vector_blocks(v, by)

    def searched(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block with the nearest within it (src, dst, d), and the distance of the k-th of each vector: far."""
        batches = list(batches)
        low, high = (edge(c.as_py() for b in batches for c in b.column(b.schema.get_field_index(name))) for name, edge in (("low", min), ("high", max)))
        ((ids, vectors, _),) = _gathered(batches).values()
        place, dst, d = _nearest_of_block((ids, vectors, None), k, size)
        far, ends = np.full(len(ids), np.inf), np.searchsorted(place, np.arange(len(ids) + 1))
        whole = np.diff(ends) == k
        far[whole] = d[ends[1:][whole] - 1]
        for part, s in enumerate(range(0, len(ids), ROW)):
            c, e = slice(s, s + ROW), slice(ends[s], ends[min(s + ROW, len(ids))])
            columns = {**dict(zip([*by, "block"], (pa.repeat(v, 1) for v in key))), "part": pa.array([part], pa.int64()), "low": pa.array([low]), "high": pa.array([high])}
            lists = {"ids": ids[c], "vectors": vectors[c].ravel(), "src": ids[place[e]], "dst": dst[e], "d": d[e], "far": far[c]}
            yield pa.RecordBatch.from_pydict(columns | {n: pa.array([x], pa.list_(pa.from_numpy_dtype(x.dtype))) for n, x in lists.items()})

    kinds = ", ".join(f"`{c}` {t}" for c, t in made.select(*by, "block").dtypes)
    schema = f"{kinds}, part bigint, low double, high double, ids array<bigint>, vectors array<double>, src array<bigint>, dst array<bigint>, d array<double>, far array<double>"
    blocks = staged(made.groupBy(*by, "block").applyInArrow(searched, schema).withColumn("reach", _reach(F.array_max("far"))), "vector-blocks")

    def compared(a, b, same):
        scale, slack = _scale(a, b)
        one, other, back = _pieces(a, size, scale), _pieces(b, size, scale), _Nearest(k)
        bounds = lambda pieces: [(q.far / scale / scale + slack).astype(np.float32) for q in pieces]
        reaches = lambda pieces: [(q.far.max() + 1e-9) ** 0.5 + 1e-6 for q in pieces]
        rows, columns = list(zip(one, bounds(one), reaches(one))), list(zip(other, bounds(other), reaches(other)))
        for p, most_p, reach_p in rows:
            there = _Nearest(k)
            for q, most_q, reach_q in columns:
                if _too_far(p, q, max(reach_p, reach_q)):
                    continue
                near = p.left @ q.right
                x, y = _hits((near <= most_p[:, None]) | (near <= most_q[None, :]))
                src, dst = p.ids[x], q.ids[y]
                d = _squared(p.vectors, q.vectors, x, y)
                to, fro = (d <= p.far[x]) & (src != dst), (d <= q.far[y]) & (src != dst)
                there.add(src[to], dst[to], d[to])
                back.add(dst[fro], src[fro], d[fro])
            yield there.best()
        yield back.best()

    inside = blocks.select(*by, F.explode(F.arrays_zip("src", "dst", "d")).alias("e")).select(*by, "e.*")
    found = inside.unionByName(_block_pairs(blocks.drop("src", "dst", "d"), by, compared, apart=True)).withColumnRenamed("d", "d2")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "src").orderBy("d2", "dst")).cast("bigint"))
    return ranked.filter(F.col("rank") <= k).select(*(keys or []), "src", "dst", "d2", "rank")


def correlation_edges(vectors: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, src, dst, r): pairs of one key whose vectors' Pearson correlation is at least `least` in size, src < dst; a vector without spread has none."""
    size = VECTORS

    def unit(block):
        c = block[1] - block[1].mean(axis=1, keepdims=True)
        length = np.sqrt((c * c).sum(axis=1, keepdims=True))
        spread = length[:, 0] > 0
        return block[0][spread], c[spread] / length[spread]

    def compared(a, b, same):
        (ia, ua), (ib, ub) = unit(a), unit(b)
        for i in range(0, len(ia), size):
            for j in range(i if same else 0, len(ib), size):
                r = ua[i : i + size] @ ub[j : j + size].T
                x, y = _hits(np.abs(r) >= least - 1e-5)
                src, dst = ia[i : i + size][x], ib[j : j + size][y]
                apart = src < dst if same and i == j else src != dst
                yield np.minimum(src, dst)[apart], np.maximum(src, dst)[apart], r[x[apart], y[apart]]

    v, by = _keyed(vectors, keys)
    blocks = staged(_vector_blocks(v, by).withColumn("reach", F.lit(float("inf"))), "vector-blocks")
    return _block_pairs(blocks, by, compared).select(*keys, "src", "dst", tidy("d").alias("r")).filter(F.abs("r") >= least)


def spatially_weighted(graph: DataFrame, near: DataFrame, keys: list[str], share: float, sigma: float) -> DataFrame:
    """(keys, src, dst, weight): the graph's weights times 1 - share plus share times a Gaussian of the distance; near: pairs beyond which that counts as nil."""
    gauss = near.select(*keys, "src", "dst", F.exp(-F.col("d2") / (2 * sigma * sigma)).alias("_s"))
    both = graph.join(gauss, [*keys, "src", "dst"], "full_outer")
    return both.select(*keys, "src", "dst", ((1 - share) * F.coalesce("weight", F.lit(0.0)) + share * F.coalesce("_s", F.lit(0.0))).alias("weight"))
