"""Cells by flooding: a nucleus image, its seeds, and the basins that grow from them.

An image is a raster: rows (keys, bin_x, bin_y, value) that fill the bounding box of each key. Smoothing, distances and
peaks are taken along lines (rows, then columns), so that a line of an image is the most that has to come together. The flood
itself takes a key, one field of view, in one task, as each pixel's turn depends on all before it.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.folders import staged
from quadrille.operators import binning, neighbours, raster

#: Number of a pixel: row times ROW plus column.
ROW = 1 << 16
FAR = 1 << 20


def filled(cells: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The raster with every place of each key's bounding box; values that were not there are 0."""
    box = cells.groupBy(*keys).agg(F.min("bin_x").alias("x0"), F.max("bin_x").alias("x1"), F.min("bin_y").alias("y0"), F.max("bin_y").alias("y1"))
    places = box.select(*keys, F.explode(F.sequence("y0", "y1")).alias("bin_y"), "x0", "x1").select(*keys, "bin_y", F.explode(F.sequence("x0", "x1")).alias("bin_x"))
    return places.join(cells.select(*keys, "bin_x", "bin_y", *values), [*keys, "bin_x", "bin_y"], "left").na.fill(0, values)


def _along(image: DataFrame, keys: list[str], axis: str, value: str, use, into: str) -> DataFrame:
    """image with a column that is use(line) of a value, a line being the array of values along the axis; other columns stay."""
    other = "bin_y" if axis == "bin_x" else "bin_x"
    rest = [c for c in image.columns if c not in (*keys, "bin_x", "bin_y")]
    lines = image.groupBy(*keys, other).agg(F.sort_array(F.collect_list(F.struct(axis, *rest))).alias("line"))
    once = lambda made, then: F.get(F.transform(F.array(F.struct(made.alias("v"))), lambda x: then(x["v"])), F.lit(0))  # noqa: E731  Catalyst would else make it anew wherever it is named
    zipped = once(F.col("line"), lambda line: F.zip_with(line, once(F.transform(line, lambda s: s[value]), use), lambda s, v: F.struct(s.alias("s"), v.alias("v"))))
    each = lines.select(*keys, other, F.explode(zipped).alias("p"))
    return each.select(*keys, *(F.col(f"p.s.{c}").alias(c) if c == axis else F.col(c) for c in ("bin_x", "bin_y")), *(F.col(f"p.s.{c}").alias(c) for c in rest if c != into), F.col("p.v").alias(into))


def blurred(image: DataFrame, keys: list[str], sigma: float, value: str = "value", reflect: bool = False, into: str | None = None) -> DataFrame:
    """image with a value, or `into`, smoothed by a normal kernel cut at four sigmas. Beyond an edge stands the pixel next to it, or the mirrored line."""
    into = into or value
    reach = int(4 * sigma + 0.5)
    if reach < 1:
        return image.withColumn(into, F.col(value))
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weights = [w / sum(weights) for w in weights]

    def smooth(line: Column) -> Column:
        n = F.size(line)

        def place(j: Column) -> Column:
            inside = F.when(j < 0, -j - 1).when(j >= n, 2 * n - 1 - j).otherwise(j) if reflect else j
            return F.least(F.greatest(inside, F.lit(0)), n - 1)

        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: reduce(add, (F.get(line, place(i + k - reach)) * w for k, w in enumerate(weights))))

    return _along(_along(image, keys, "bin_x", value, smooth, into), keys, "bin_y", into, smooth, into)


def distance2(image: DataFrame, keys: list[str], mask: str, outside: bool = False) -> DataFrame:
    """image with d2: the squared distance of a pixel in the mask to the nearest one that is not, 0 for those; FAR squared if there is none.

    outside: what lies beyond the edges is not in the mask.
    """
    down, up = (Window.partitionBy(*keys, "bin_x").orderBy("bin_y").rowsBetween(*r) for r in ((Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)))
    column = Window.partitionBy(*keys, "bin_x").orderBy("bin_y").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    off = F.when(~F.col(mask), F.col("bin_y"))
    before, after = F.col("bin_y") - F.last(off, True).over(down), F.first(off, True).over(up) - F.col("bin_y")
    apart = F.least(F.coalesce(before, F.lit(FAR)), F.coalesce(after, F.lit(FAR)))
    if outside:
        apart = F.least(apart, F.col("bin_y") - F.min("bin_y").over(column) + 1, F.max("bin_y").over(column) - F.col("bin_y") + 1)
    vertical = image.withColumn("d2", apart.cast("bigint"))

    def nearest(line: Column) -> Column:
        n = F.size(line)

        def least(i: Column) -> Column:
            own = F.get(line, i)
            a, b = F.greatest(i - own, F.lit(0).cast("bigint")), F.least(i + own, n - 1)
            best = F.array_min(F.transform(F.sequence(a, b), lambda j: F.get(line, j.cast("int")) * F.get(line, j.cast("int")) + (j - i) * (j - i)))
            return F.least(best, F.pow(i + 1, F.lit(2)).cast("bigint"), F.pow(n - i, F.lit(2)).cast("bigint")) if outside else best

        return F.transform(F.sequence(F.lit(0), n - 1), least)

    return _along(vertical, keys, "bin_x", "d2", nearest, "d2").withColumn("d2", F.least("d2", F.lit(FAR).cast("bigint") * FAR))


def eroded(image: DataFrame, keys: list[str], mask: str, radius: int = 1) -> DataFrame:
    """image whose mask keeps the pixels that a disk of the radius fits around, inside the image."""
    return distance2(image, keys, mask, True).withColumn(mask, F.col("d2") > radius * radius).drop("d2")


def opened(image: DataFrame, keys: list[str], mask: str, radius: int = 1) -> DataFrame:
    """image whose mask keeps what disks of the radius that fit into it cover."""
    small = eroded(image, keys, mask, radius).withColumn("_off", ~F.col(mask))
    return distance2(small, keys, "_off").withColumn(mask, F.col("d2") <= radius * radius).drop("d2", "_off")


def without_specks(image: DataFrame, keys: list[str], mask: str, least: int) -> DataFrame:
    """image whose mask has lost its 4-connected parts of fewer than `least` pixels."""
    if least <= 1:
        return image
    parts = connected(image.filter(mask), keys, raster.FOUR)
    sizes = parts.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    kept = parts.join(sizes, [*keys, "component"]).select(*keys, "bin_x", "bin_y", F.lit(True).alias("_kept"))
    return image.join(kept, [*keys, "bin_x", "bin_y"], "left").withColumn(mask, F.coalesce("_kept", F.lit(False))).drop("_kept")


def connected(pixels: DataFrame, keys: list[str], reach: list[tuple[int, int]], same: str | None = None) -> DataFrame:
    """pixels with component: the number of the first pixel that steps of `reach` over them lead to; same: a column that a step may not change."""
    number = F.col("bin_y") * ROW + F.col("bin_x")
    px = pixels.withColumn("id", number.cast("bigint"))
    steps = F.explode(F.array(*(F.lit(b * ROW + a).cast("bigint") for a, b in reach)))
    ask = px.select(*keys, *([same] if same else []), F.col("id").alias("src"), steps.alias("_s")).withColumn("dst", F.col("src") + F.col("_s"))
    have = px.select(*keys, *([same] if same else []), F.col("id").alias("dst"))
    links = ask.join(have, [*keys, "dst", *([same] if same else [])]).select(*keys, "src", "dst")
    return px.join(neighbours.label_components(px.select(*keys, "id"), links, keys), [*keys, "id"]).drop("id")


def nucleus_image(pixels: DataFrame, keys: list[str], dna: tuple[str, str], resolution: int, sigma: float = 0.5, multiplier: float = 2.0) -> DataFrame:
    """(keys, bin_x, bin_y, value): both DNA channels together, smoothed, stabilised by their own median, stretched between their 1st and 99th percentile."""
    a, b = dna
    sums = filled(binning.bin_sums(pixels, keys, resolution, [a, b]), keys, [a, b])
    both = F.sqrt(F.col(a) * F.col(b) + F.col(a) + F.col(b))
    image = staged(blurred(sums.select(*keys, "bin_x", "bin_y", both.cast("double").alias("value")), keys, sigma), "nuclei")
    signal = F.when(F.col("value") > 0, F.col("value"))
    middle = image.groupBy(*keys).agg(F.percentile(signal, F.lit(0.5)).alias("_median"))
    stable = staged(image.join(middle, keys).withColumn("value", F.coalesce(F.asinh(F.col("value") / (F.col("_median") * multiplier)), F.lit(0.0))).drop("_median"), "nuclei")
    ends = stable.groupBy(*keys).agg(F.percentile(signal, F.array(F.lit(0.01), F.lit(0.99))).alias("_p"))
    low, high = F.col("_p")[0], F.col("_p")[1]
    stretched = F.when(high > low, F.least(F.greatest((F.col("value") - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(F.col("value"))
    return stable.join(ends, keys).withColumn("value", stretched).select(*keys, "bin_x", "bin_y", "value")


def nucleus_mask(image: DataFrame, keys: list[str], block: int, specks: int, opening: int) -> DataFrame:
    """image with mask: brighter than its surroundings of `block` pixels, without specks, opened."""
    near = blurred(image, keys, (block - 1) / 6, reflect=True, into="_near")
    front = near.withColumn("mask", F.round("value", 9) > F.round("_near", 9)).drop("_near")
    return opened(without_specks(front, keys, "mask", specks), keys, "mask", opening)


def nucleus_seeds(masked: DataFrame, keys: list[str], apart: int) -> DataFrame:
    """(keys, bin_x, bin_y, seed): pixels deepest in the mask within `apart` pixels, at least half of that deep and not so near an edge; of equally deep ones the first by row and column.

    Seeds are numbered from 1 by row and column.
    """
    d = distance2(masked, keys, "mask")
    own = F.struct("d2", (-F.col("bin_y")).alias("y"), (-F.col("bin_x")).alias("x"))
    row, column = Window.partitionBy(*keys, "bin_y").orderBy("bin_x"), Window.partitionBy(*keys, "bin_x").orderBy("bin_y")
    top = d.withColumn("_own", own).withColumn("_top", F.max("_own").over(row.rowsBetween(-apart, apart))).withColumn("_top", F.max("_top").over(column.rowsBetween(-apart, apart)))
    inner = (F.lag("bin_x", apart).over(row).isNotNull()) & (F.lead("bin_x", apart).over(row).isNotNull()) & (F.lag("bin_y", apart).over(column).isNotNull()) & (F.lead("bin_y", apart).over(column).isNotNull())
    peaks = top.withColumn("_inner", inner).filter(F.col("_inner") & (F.col("_own") == F.col("_top")) & (4 * F.col("d2") > apart * apart) & F.col("mask"))
    return peaks.select(*keys, "bin_x", "bin_y", F.row_number().over(Window.partitionBy(*keys).orderBy("bin_y", "bin_x")).cast("bigint").alias("seed"))


def flooded(height: np.ndarray, open_: np.ndarray, seed: np.ndarray, compactness: float) -> np.ndarray:
    """The label of each open pixel that the flood reaches, 0 elsewhere.

    Pixels are taken in order of height plus compactness times their distance from the seed they are reached from; of equal ones
    that of the smallest label, then row, then column, comes first. A pixel taken offers its four neighbours.
    """
    label = np.zeros(height.shape, np.int64)
    at = {int(seed[y, x]): (y, x) for y, x in zip(*np.nonzero(seed))}
    waiting = [(float(height[p]), s, *map(int, p)) for s, p in at.items() if open_[p]]
    heapq.heapify(waiting)
    while waiting:
        _, s, y, x = heapq.heappop(waiting)
        if label[y, x]:
            continue
        label[y, x] = s
        for v, u in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= v < height.shape[0] and 0 <= u < height.shape[1] and open_[v, u] and not label[v, u]:
                far = compactness * math.hypot(v - at[s][0], u - at[s][1])
                heapq.heappush(waiting, (float(height[v, u]) + far, s, v, u))
    return label


def flood(image: DataFrame, keys: list[str], compactness: float = 0.1) -> DataFrame:
    """(keys, bin_x, bin_y, label) of the pixels that the flood reaches. image: (keys, bin_x, bin_y, height, open, seed), seed 0 or null where there is none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[c].to_numpy() - pdf[c].min() for c in ("bin_x", "bin_y"))
        shape = (int(y.max()) + 1, int(x.max()) + 1)
        height, open_, seed = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, np.int64)
        height[y, x], open_[y, x], seed[y, x] = pdf["height"], pdf["open"], pdf["seed"].fillna(0)
        pdf["label"] = flooded(height, open_, seed, compactness)[y, x]
        return pdf.loc[pdf["label"] > 0, [*keys, "bin_x", "bin_y", "label"]]

    kind = lambda c: image.schema[c].dataType.simpleString()
    schema = ", ".join(f"{c} {kind(c)}" for c in (*keys, "bin_x", "bin_y"))
    return image.select(*keys, "bin_x", "bin_y", "height", "open", "seed").groupBy(*keys).applyInPandas(run, f"{schema}, label bigint")


def cells(image: DataFrame, seeds: DataFrame, keys: list[str], resolution: float, least_area: float = 10.0, most_area: float = 500.0, erosion: float = 2.0, smoothing: float = 1.0, compactness: float = 0.1) -> DataFrame:
    """(keys, bin_x, bin_y, value, label): basins of the inverted image around the seeds, within the eroded tissue, of the areas that a cell can have."""
    top = image.groupBy(*keys).agg(F.max("value").alias("_top"))
    inverted = image.join(top, keys).withColumn("height", F.col("_top") - F.col("value")).drop("_top").withColumn("open", F.col("value") > 0)
    tissue = blurred(inverted, keys, smoothing / resolution, "height").withColumn("height", F.round("height", 9))
    for _ in range(max(1, int(erosion / resolution))):
        tissue = eroded(tissue, keys, "open")
    ready = tissue.join(seeds, [*keys, "bin_x", "bin_y"], "left")
    basins = staged(flood(ready, keys, compactness), "basins")
    area = resolution * resolution
    sizes = basins.groupBy(*keys, "label").agg((F.count(F.lit(1)) * area).alias("_a")).filter(F.col("_a").between(least_area, most_area))
    return basins.join(sizes, [*keys, "label"], "left_semi").join(image, [*keys, "bin_x", "bin_y"]).select(*keys, "bin_x", "bin_y", "value", "label")


def cell_sums(pixels: DataFrame, found: DataFrame, keys: list[str], resolution: int, markers: list[str]) -> DataFrame:
    """(keys, label, n_pixels, x, y, markers): what is measured in each cell."""
    placed = pixels.withColumns({"bin_x": F.floor(F.col("x") / resolution), "bin_y": F.floor(F.col("y") / resolution)})
    return placed.join(found.select(*keys, "bin_x", "bin_y", "label"), [*keys, "bin_x", "bin_y"]).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n_pixels"), F.avg("x").alias("x"), F.avg("y").alias("y"), *(F.sum(m).alias(m) for m in markers))


def hull_pixels(x: np.ndarray, y: np.ndarray) -> int:
    """Pixels whose centres lie in the convex hull of the given pixels' side centres."""
    corners = np.unique(np.concatenate([np.stack([x + a, y + b], axis=1) for a, b in ((-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5))]), axis=0)

    def chain(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(chain(corners) + chain(corners[::-1]))
    gx, gy = (g.ravel() for g in np.meshgrid(np.arange(x.min(), x.max() + 1), np.arange(y.min(), y.max() + 1)))
    inside = np.ones(len(gx), bool)
    for p, q in zip(hull, np.roll(hull, -1, axis=0)):
        inside &= (q[0] - p[0]) * (gy - p[1]) - (q[1] - p[1]) * (gx - p[0]) >= -1e-9
    return int(inside.sum())


def solidities(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, solidity): pixels of a cell over those of its convex hull. A key is one field of view, a cell a few hundred pixels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(*(pdf[k].iloc[0] for k in keys), label, len(c) / hull_pixels(c["bin_x"].to_numpy(float), c["bin_y"].to_numpy(float))) for label, c in pdf.groupby("label")]
        return pd.DataFrame(rows, columns=[*keys, "label", "solidity"])

    schema = ", ".join(f"{k} {found.schema[k].dataType.simpleString()}" for k in keys)
    return found.select(*keys, "bin_x", "bin_y", "label").groupBy(*keys).applyInPandas(run, f"{schema}, label bigint, solidity double")


#: What a segmentation is judged by.
SEEDS_TO_CELLS, MOST_ECCENTRIC, LEAST_SOLID, MOST_VARIED = (0.5, 1.2), 0.8, 0.6, 2.0


def quality(masked: DataFrame, seeds: DataFrame, shapes: DataFrame, keys: list[str], resolution: float) -> DataFrame:
    """Per key: seeds, cells, areas, shapes, and the share of four checks that hold. shapes: (keys, label, area, eccentricity, solidity)."""
    tissue = masked.groupBy(*keys).agg(F.avg(F.col("mask").cast("int")).alias("mask_coverage"), F.count(F.lit(1)).alias("_all"))
    n = seeds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_seeds"))
    made = shapes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("area").alias("_a"), F.stddev_pop("area").alias("_s"), F.sum("area").alias("_sum"), F.avg("eccentricity").alias("mean_eccentricity"), F.avg("solidity").alias("mean_solidity"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_ = tissue.join(n, keys, "left").join(made, keys, "left").na.fill(0)
    ratio = F.when(F.col("n_seeds") > 0, F.col("n_cells") / F.col("n_seeds")).otherwise(0.0)
    cv = F.when(F.col("_a") > 0, F.col("_s") / F.col("_a")).otherwise(0.0)
    area = resolution * resolution
    out = all_.select(*keys, "n_seeds", "n_cells", "mask_coverage", (zero(F.col("_sum")) / F.col("_all")).alias("cell_coverage"), (F.col("_a") * area).alias("mean_area"), (F.col("_s") * area).alias("sd_area"), ratio.alias("cells_per_seed"), cv.alias("area_cv"), "mean_eccentricity", "mean_solidity")
    checks = {"good_conversion": F.col("cells_per_seed").between(*SEEDS_TO_CELLS), "good_shape": F.col("mean_eccentricity") < MOST_ECCENTRIC, "good_solidity": F.col("mean_solidity") > LEAST_SOLID, "good_sizes": F.col("area_cv") < MOST_VARIED}
    return out.withColumns(checks).withColumn("score", sum(F.col(c).cast("int") for c in checks) / 4)
