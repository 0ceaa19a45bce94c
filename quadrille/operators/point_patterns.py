"""Point patterns whose points carry marks and whose intensity varies, and bootstraps of fields by blocks."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.folders import staged
from quadrille.operators import edges

CORRECTIONS = ["none", "border", "translation", "isotropic"]

#: A side of the window that is nearer than the pair is apart counts for a quarter of the circle; corrections are bounded. Fixed values.
CUT_SIDE, LEAST_TRANSLATION, LEAST_ISOTROPIC = 0.75, 0.1, 0.25

#: Parts that the kernels of one region's sources are dealt to.
PARTS = 8


def intensities(points: DataFrame, keys: list[str], side: float | None = None) -> DataFrame:
    """(keys, id, intensity): a Gaussian kernel's density at each point (id, x, y), scaled so that a key's points have 1 on average.

    The kernel has the shape of the points' covariance, narrowed by n^(-1/6). With a side, sources are the mean places of
    squares of that side, weighted by their points, so that a point meets no more of them than the field has squares.
    Points without a place are left out. Where all lie on a line, or there are fewer than three, intensity is 1.
    """
    at = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n = F.count(F.lit(1))
    spread = at.groupBy(*keys).agg(n.alias("n"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"))
    det, narrow = F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy"), F.pow(F.col("n"), F.lit(-1 / 3))
    flat = det > 1e-9 * F.col("vx") * F.col("vy")
    shape = spread.select(*keys, *(F.when(flat, F.col(v) / (det * narrow)).alias(name) for v, name in (("vy", "axx"), ("vx", "ayy"), ("vxy", "axy"))))
    if side is None:
        sources = at.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"), F.lit(1.0).alias("m"))
    else:
        square = [F.floor(F.col(c) / side).alias(f"_{c}") for c in ("x", "y")]
        sources = at.groupBy(*keys, *square).agg(F.avg("x").alias("x2"), F.avg("y").alias("y2"), n.cast("double").alias("m")).drop("_x", "_y")
    sources = sources.join(shape, keys).withColumn("_part", F.pmod(F.xxhash64("x2", "y2"), F.lit(PARTS)))
    probes = edges.spread(at, [*keys, "id"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    kernel = F.col("m") * F.exp(-0.5 * (F.col("axx") * dx * dx - 2 * F.col("axy") * dx * dy + F.col("ayy") * dy * dy))
    dense = staged(probes.join(sources, [*keys, "_part"]).groupBy(*keys, "id").agg(F.sum(kernel).alias("s")), "kernel-sums")
    means = dense.groupBy(*keys).agg(F.avg("s").alias("mean"))
    return dense.join(means, keys).select(*keys, "id", F.coalesce(F.col("s") / F.col("mean"), F.lit(1.0)).alias("intensity"))


def _weights(reach: float) -> dict[str, Column]:
    """What a pair src < dst counts, both ways together, under each correction of the window's edge."""
    d = F.sqrt("d2")
    sides = [F.col(f"{c}_src") for c in ("_w", "_e", "_s", "_n")]
    feasible = F.least(*sides[:2]) * F.least(*sides[2:]) / F.col("d2")
    circle = reduce(mul, (F.when(s < d, CUT_SIDE).otherwise(1.0) for s in sides))
    inside = lambda end: (F.least(*(F.col(f"{c}_{end}") for c in ("_w", "_e", "_s", "_n"))) >= reach).cast("double")
    apart = lambda w: F.when(F.col("d2") > 0, 2 / w).otherwise(2.0)
    return {
        "none": F.lit(2.0),
        "border": inside("src") + inside("dst"),
        "translation": apart(F.greatest(F.least(feasible, F.lit(1.0)), F.lit(LEAST_TRANSLATION))),
        "isotropic": apart(F.greatest(circle, F.lit(LEAST_ISOTROPIC))),
    }


def k_functions(points: DataFrame, keys: list[str], radii: list[float], mark: str | None = None, intensity: str | None = None, areas: DataFrame | None = None) -> DataFrame:
    """(keys, radius, n, pairs, k_<correction>, l_<correction>): Ripley's K and L of points (id, x, y) under each of CORRECTIONS.

    pairs: how many pairs of points are at most the radius apart; where there are none, K is 0.
    mark: pairs count the product of their marks, over the squared sum of all. intensity: pairs count one over the product of their
    intensities. The window is the points' bounding box; areas (keys, area) replaces its area, as a mask does. A pair's
    corrections are those at its point of smaller id; the border keeps points that are the largest radius away from every side.
    Points without a place, mark or intensity are left out; a key with fewer than two has no rows; a sum of marks of 0 gives null.
    """
    radii = sorted(map(float, radii))
    needed = [c for c in ("x", "y", mark, intensity) if c]
    at = points.select(*keys, "id", *(F.col(c).cast("double").alias(c) for c in needed)).dropna(subset=needed)
    box = [fn(c).alias(f"_{name}{c}") for c in ("x", "y") for fn, name in ((F.min, "lo"), (F.max, "hi"))]
    total = F.sum(mark) if mark else F.lit(None).cast("double")
    window = staged(at.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), total.alias("_total"), *box).filter("n > 1"), "windows")
    placed = at.join(window, keys).select(
        *keys, "id", "x", "y", (F.col("x") - F.col("_lox")).alias("_w"), (F.col("_hix") - F.col("x")).alias("_e"), (F.col("y") - F.col("_loy")).alias("_s"), (F.col("_hiy") - F.col("y")).alias("_n"),
        ((F.col(mark) if mark else F.lit(1.0)) / (F.col(intensity) if intensity else F.lit(1.0))).alias("_f"),
    )
    pairs = edges.within(staged(placed, "placed"), keys, radii[-1], carry=["_w", "_e", "_s", "_n", "_f"]).filter("src < dst")
    # A pair is counted once, at the first radius that holds it; larger radii add up.
    first = F.coalesce(*(F.when(F.col("d2") <= r * r, r) for r in radii))
    sums = pairs.groupBy(*keys, first.alias("radius")).agg(F.count(F.lit(1)).alias("_pairs"), *(F.sum(F.col("_f_src") * F.col("_f_dst") * w).alias(c) for c, w in _weights(radii[-1]).items()))
    every = window.withColumn("radius", F.explode(F.array(*map(F.lit, radii)))).join(sums, [*keys, "radius"], "left")
    area = (F.col("_hix") - F.col("_lox")) * (F.col("_hiy") - F.col("_loy"))
    if areas is not None:
        every, area = every.join(areas.select(*keys, F.col("area").alias("_area")), keys), F.col("_area")
    up = Window.partitionBy(*keys).orderBy("radius").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.when(F.col("_total") != 0, 1 / (F.col("_total") * F.col("_total"))) if mark else 1 / F.col("n")
    k = every.withColumns({f"k_{c}": F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(up) * share * area for c in CORRECTIONS})
    k = k.withColumn("pairs", F.sum(F.coalesce("_pairs", F.lit(0))).over(up))
    return k.select(*keys, "radius", "n", "pairs", *(f"k_{c}" for c in CORRECTIONS), *((F.sqrt(F.col(f"k_{c}") / F.pi()) - F.col("radius")).alias(f"l_{c}") for c in CORRECTIONS))


def drawn(seed: int, most: Column, *parts: Column | str) -> Column:
    """A number from 0 to below `most` that follows from the seed and the parts, the same in any engine with MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *((F.lit(p) if isinstance(p, str) else p.cast("string")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % most


def summed_area(field: DataFrame, keys: list[str], values: list[str], height: int, width: int) -> DataFrame:
    """(keys, row, col, values): of each value the sum over all rows before row and columns before col; cells not in the field are 0.

    Running sums along the rows, then along the columns: no window holds more than a line.
    """
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    grid = field.select(*keys).distinct().withColumn("row", upto(height)).withColumn("col", upto(width))
    shifted = field.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).groupBy(*keys, (F.col("row") + 1).cast("int").alias("row"), (F.col("col") + 1).cast("int").alias("col")).agg(*(F.sum(v).alias(v) for v in values))
    out = grid.join(shifted, [*keys, "row", "col"], "left")
    for line, along in (("row", "col"), ("col", "row")):
        so_far = Window.partitionBy(*keys, line).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumns({v: F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0))).over(so_far) for v in values})
    return out.select(*keys, "row", "col", *values)


def block_bootstrap(field: DataFrame, keys: list[str], values: list[str], height: int, width: int, block: int, draws: int = 100, seed: int = 42) -> DataFrame:
    """(keys, value, mean, mean_sd, spread, spread_sd): of each value's field mean and spread, their mean and spread over the draws.

    A draw fills the field with blocks, each copied from a place that is drawn by hash (at most height - block and width - block, the last
    place left out); blocks at the far edges are cut to fit. A block's sums are four cells of the summed-area table, so a draw costs
    as many look-ups as it has blocks, whatever their size. field: (keys, row, col, values); cells that are not there, and nulls, are 0.
    """
    squares = {f"_{v}": F.col(v) * F.col(v) for v in values}
    cells = field.groupBy(*keys, "row", "col").agg(*(F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0))).alias(v) for v in values)).withColumns(squares)
    sums = [*values, *squares]
    table = summed_area(cells, keys, sums, height, width)
    steps = lambda n: F.explode(F.array(*(F.lit(i) for i in range(0, n, block))))
    blocks = field.select(*keys).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_r", steps(height)).withColumn("_c", steps(width))
    origin = lambda name, size: drawn(seed, F.lit(max(1, size - block)), *(F.col(k) for k in keys), F.col("draw"), F.col("_r"), F.col("_c"), name)
    placed = blocks.withColumns({"r0": origin("row", height), "c0": origin("col", width)}).withColumns({"r1": F.col("r0") + F.least(F.lit(block), height - F.col("_r")), "c1": F.col("c0") + F.least(F.lit(block), width - F.col("_c"))})
    corner = lambda r, c, sign: F.struct(F.col(r).cast("int").alias("row"), F.col(c).cast("int").alias("col"), F.lit(sign).alias("sign"))
    corners = placed.select(*keys, "draw", F.explode(F.array(corner("r1", "c1", 1), corner("r0", "c1", -1), corner("r1", "c0", -1), corner("r0", "c0", 1))).alias("at")).select(*keys, "draw", "at.*")
    # Corners of different draws fall together; the table is read once for each.
    by_draw = corners.join(table, [*keys, "row", "col"]).groupBy(*keys, "draw").agg(*(F.sum(F.col(s) * F.col("sign")).alias(s) for s in sums))
    cells_n = float(height * width)
    mean = {v: F.col(v) / cells_n for v in values}
    spread = {v: F.sqrt(F.greatest(F.col(f"_{v}") / cells_n - mean[v] * mean[v], F.lit(0.0))) for v in values}
    long = by_draw.select(*keys, F.explode(F.array(*(F.struct(F.lit(v).alias("value"), mean[v].alias("m"), spread[v].alias("s")) for v in values))).alias("e")).select(*keys, "e.*")
    return long.groupBy(*keys, "value").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("mean_sd"), F.avg("s").alias("spread"), F.stddev_pop("s").alias("spread_sd"))
