"""Label rasters: what segmentations are judged by. A raster is rows (keys, bin_x, bin_y, label, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of the boxes that boundaries are counted in.
BOXES = (2, 4, 8, 16, 32)


def _moved(raster: DataFrame, keys: list[str], columns: list[str], steps: Column) -> DataFrame:
    """Each cell's columns, o_ before their names, at the places next to it."""
    at = raster.withColumn("_s", F.explode(steps))
    return at.select(*keys, (F.col("bin_x") + F.col("_s.dx")).alias("bin_x"), (F.col("bin_y") + F.col("_s.dy")).alias("bin_y"), F.col("_s.dx").alias("dx"), F.col("_s.dy").alias("dy"), *(F.col(c).alias(f"o_{c}") for c in columns))


def _steps(reach: list[tuple[int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in reach))


FOUR = [(0, 1), (0, -1), (1, 0), (-1, 0)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def sides(raster: DataFrame, keys: list[str]) -> DataFrame:
    """raster with same_sides: how many of a cell's four sides touch a cell of its own label."""
    near = _moved(raster, keys, ["label"], _steps(FOUR)).select(*keys, "bin_x", "bin_y", F.col("o_label").alias("label"))
    same = near.groupBy(*keys, "bin_x", "bin_y", "label").agg(F.count(F.lit(1)).alias("same_sides"))
    return raster.join(same, [*keys, "bin_x", "bin_y", "label"], "left").na.fill(0, ["same_sides"])


def segment_shapes(raster: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, area, perimeter, x, y, mean_value, compactness, eccentricity) of each segment.

    The perimeter counts open sides; eccentricity is that of the ellipse with the segment's second moments (a cell is a unit square).
    """
    s = sides(raster, keys).groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area"), F.sum(4 - F.col("same_sides")).alias("perimeter"), F.avg("bin_x").alias("x"), F.avg("bin_y").alias("y"), F.avg("value").alias("mean_value"),
        (F.var_pop("bin_x") + 1 / 12).alias("_xx"), (F.var_pop("bin_y") + 1 / 12).alias("_yy"), F.covar_pop("bin_x", "bin_y").alias("_xy"),
    )
    root = F.sqrt(F.pow(F.col("_xx") - F.col("_yy"), 2) + 4 * F.pow(F.col("_xy"), 2))
    large, low = (F.col("_xx") + F.col("_yy") + root) / 2, (F.col("_xx") + F.col("_yy") - root) / 2
    compact = F.least(F.lit(1.0), 4 * math.pi * F.col("area") / F.pow("perimeter", F.lit(2)))
    return s.select(*keys, "label", "area", "perimeter", "x", "y", "mean_value", compact.alias("compactness"), F.sqrt(1 - F.greatest(low, F.lit(0.0)) / large).alias("eccentricity"))


def shape_summary(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: compactness (mean, spread, range), uniformity of sizes, segments."""
    c = F.col("compactness")
    return shapes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_segments"), F.avg(c).alias("mean_compactness"), F.stddev_pop(c).alias("sd_compactness"), F.min(c).alias("min_compactness"), F.max(c).alias("max_compactness"), (1 / (1 + F.stddev_pop("area") / F.avg("area"))).alias("size_uniformity"), F.avg("eccentricity").alias("mean_eccentricity"))


def boundaries(raster: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin_x, bin_y) of cells whose left or upper neighbour has another label."""
    near = _moved(raster, keys, ["label"], _steps([(1, 0), (0, 1)])).select(*keys, "bin_x", "bin_y", "o_label")
    return raster.join(near, [*keys, "bin_x", "bin_y"]).filter(F.col("label") != F.col("o_label")).select(*keys, "bin_x", "bin_y").distinct()


def box_dimension(raster: DataFrame, keys: list[str], boxes: tuple[int, ...] = BOXES) -> DataFrame:
    """(keys, fractal_dim, regularity, boundary_pixels) by counting the boxes of each size that hold a boundary; without boundaries the dimension is 1."""
    cells = boundaries(raster, keys)
    sized = cells.withColumn("box", F.explode(F.array(*map(F.lit, boxes)))).select(*keys, "box", F.floor(F.col("bin_x") / F.col("box")).alias("a"), F.floor(F.col("bin_y") / F.col("box")).alias("b")).distinct()
    counts = sized.groupBy(*keys, "box").agg(F.count(F.lit(1)).alias("n"))
    dim = counts.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.least(F.lit(2.0), -F.regr_slope(F.log("n"), F.log("box")))).alias("fractal_dim"))
    pixels = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("boundary_pixels"))
    all_ = raster.select(*keys).distinct().join(dim, keys, "left").join(pixels, keys, "left").na.fill({"fractal_dim": 1.0, "boundary_pixels": 0})
    return all_.select(*keys, "fractal_dim", (2 - F.col("fractal_dim")).alias("regularity"), "boundary_pixels")


def gradients(raster: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin_x, bin_y, gradient): size of the Sobel gradient of `value`; cells that are not there count as 0."""
    weight = lambda along, across: F.col(along) * (2 - F.abs(across))
    near = _moved(raster, keys, ["value"], _steps(EIGHT))
    sums = near.groupBy(*keys, "bin_x", "bin_y").agg(F.sum(weight("dx", "dy") * F.col("o_value")).alias("gx"), F.sum(weight("dy", "dx") * F.col("o_value")).alias("gy"))
    return raster.select(*keys, "bin_x", "bin_y").join(sums, [*keys, "bin_x", "bin_y"], "left").select(*keys, "bin_x", "bin_y", F.coalesce(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), F.lit(0.0)).alias("gradient"))


def adherence(raster: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, adherence): mean gradient on boundaries over the mean of all cells, in 0..2; all cells stand where a random draw of them would."""
    g = gradients(raster, keys)
    on = boundaries(raster, keys).withColumn("_on", F.lit(True))
    s = g.join(on, [*keys, "bin_x", "bin_y"], "left").groupBy(*keys).agg(F.avg(F.when(F.col("_on"), F.col("gradient"))).alias("b"), F.avg("gradient").alias("a"))
    return s.select(*keys, F.when(F.col("a") > 0, F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.coalesce("b", F.lit(0.0)) / F.col("a")))).otherwise(1.0).alias("adherence"))


def boundary_quality(raster: DataFrame, keys: list[str], share: float = 0.8) -> DataFrame:
    """(keys, precision, recall, f1): how far boundaries meet cells whose gradient is above a percentile of the positive ones; the raster's rim is left out."""
    rim = raster.groupBy(*keys).agg(F.min("bin_x").alias("x0"), F.max("bin_x").alias("x1"), F.min("bin_y").alias("y0"), F.max("bin_y").alias("y1"))
    inner = (F.col("bin_x") > F.col("x0")) & (F.col("bin_x") < F.col("x1")) & (F.col("bin_y") > F.col("y0")) & (F.col("bin_y") < F.col("y1"))
    on = boundaries(raster, keys).join(rim, keys).filter(inner).select(*keys, "bin_x", "bin_y", F.lit(True).alias("_on"))
    g = gradients(raster, keys)
    cut = g.groupBy(*keys).agg(F.percentile(F.when(F.col("gradient") > 0, F.col("gradient")), F.lit(share)).alias("cut"))
    s = g.join(cut, keys).join(on, [*keys, "bin_x", "bin_y"], "left").groupBy(*keys).agg(F.count_if(F.col("_on")).alias("n_b"), F.count_if(F.col("gradient") > F.col("cut")).alias("n_t"), F.count_if(F.col("_on") & (F.col("gradient") > F.col("cut"))).alias("n_both"))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    p = s.select(*keys, "n_b", "n_t", over("n_both", "n_b").alias("precision"), over("n_both", "n_t").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return p.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def touching(raster: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst): pairs of labels that share a side, in both directions."""
    near = _moved(raster, keys, ["label"], _steps(FOUR)).select(*keys, "bin_x", "bin_y", "o_label")
    return raster.join(near, [*keys, "bin_x", "bin_y"]).filter(F.col("label") != F.col("o_label")).select(*keys, F.col("label").alias("src"), F.col("o_label").alias("dst")).distinct()


def composite(pixels: DataFrame, keys: list[str], channels: list[str], multiplier: float = 10.0) -> DataFrame:
    """(keys, x, y, raw, value): summed channels of each pixel, arcsinh over a multiple of the noise floor.

    The floor is the 10th percentile of the key's pixels, or the 25th of those above 0 if that is nil, or 1.
    """
    total = sum((F.col(c) for c in channels[1:]), F.col(channels[0]))
    px = pixels.groupBy(*keys, "x", "y").agg(F.sum(total).alias("raw"))
    f = px.groupBy(*keys).agg(F.percentile("raw", F.lit(0.1)).alias("_p10"), F.percentile(F.when(F.col("raw") > 0, F.col("raw")), F.lit(0.25)).alias("_p25"))
    floor = F.when(F.col("_p10") > 0, F.col("_p10")).otherwise(F.coalesce("_p25", F.lit(1.0)))
    return px.join(f, keys).select(*keys, "x", "y", "raw", F.asinh(F.col("raw") / (floor * multiplier)).alias("value"))
