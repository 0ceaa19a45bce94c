"""Spatial binning: sums of counts by square, regular grids, grid-cell properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bin_sums(pixels: DataFrame, keys: list[str], size: float, values: list[str], x: str = "x", y: str = "y", extent: float | None = None) -> DataFrame:
    """Sums (never means) of counts by left-closed square bin; centroids; only occupied bins.

    extent: coordinates outside 0 <= v < extent are dropped.
    """
    inside = pixels if extent is None else pixels.filter((F.col(x) >= 0) & (F.col(x) < extent) & (F.col(y) >= 0) & (F.col(y) < extent))
    return inside.groupBy(*keys, F.floor(F.col(y) / size).alias("bin_y"), F.floor(F.col(x) / size).alias("bin_x")).agg(
        F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("n_pixels"), *(F.sum(v).alias(v) for v in values)
    )


def dense_bins(pixels: DataFrame, keys: list[str], size: float, values: list[str], extent: int) -> DataFrame:
    """As bin_sums, with zeros for the empty bins of each key."""
    n = int(extent // size)
    spark = pixels.sparkSession
    axis = spark.range(n * n).select(F.floor(F.col("id") / n).alias("bin_y"), (F.col("id") % n).alias("bin_x"))
    grid = pixels.select(*keys).distinct().withColumn("_", F.lit(1)).join(F.broadcast(axis.withColumn("_", F.lit(1))), "_").drop("_")
    sums = bin_sums(pixels, keys, size, values, extent=extent).select(*keys, "bin_y", "bin_x", *values)
    return grid.join(sums, [*keys, "bin_y", "bin_x"], "left").na.fill(0.0, values)


def regular_grid(pixels: DataFrame, keys: list[str], scale: float, values: list[str]) -> DataFrame:
    """Sums over a grid of ceil(extent / scale) cells an axis that spans each key's own bounds; cell = row * columns + column."""
    bounds = pixels.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cells = lambda a, b: F.greatest(F.ceil((F.col(b) - F.col(a)) / scale), F.lit(1))
    placed = pixels.join(bounds, keys).withColumns({"nx": cells("x0", "x1"), "ny": cells("y0", "y1")})
    at = lambda v, a, b, n: F.least(F.floor((F.col(v) - F.col(a)) * F.col(n) / F.greatest(F.col(b) - F.col(a), F.lit(1e-9))), F.col(n) - 1)
    placed = placed.withColumn("cell", (at("y", "y0", "y1", "ny") * F.col("nx") + at("x", "x0", "x1", "nx")).cast("bigint"))
    return placed.groupBy(*keys, "cell").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("area"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        *(F.sum(v).alias(v) for v in values),
    )


def cell_properties(cells: DataFrame, keys: list[str], signal: str) -> DataFrame:
    """Area, box perimeter, eccentricity of the box's aspect, mean signal and size uniformity of each key's cells."""
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    inside = Window.partitionBy(*keys)
    return cells.select(
        *keys, "cell", "area", (2 * (w + h)).alias("perimeter"),
        F.sqrt(1 - F.pow(F.least(w, h) / F.greatest(w, h), 2)).alias("eccentricity"),
        (F.col(signal) / F.col("area")).alias("mean_signal"),
        (1 / (1 + F.stddev_pop("area").over(inside) / F.avg("area").over(inside))).alias("size_uniformity"),
    )


def texture(sums: DataFrame, keys: list[str], levels: int = 8) -> DataFrame:
    """Grey-level co-occurrence of horizontal neighbours on a binned field (keys, bin_y, bin_x, v), both directions counted.

    contrast, homogeneity, energy and correlation of each key.
    """
    top = Window.partitionBy(*keys)
    level = F.least(F.floor(F.col("v") / F.max("v").over(top) * levels), F.lit(levels - 1)).alias("i")
    graded = sums.select(*keys, "bin_y", "bin_x", level)
    right = graded.select(*keys, "bin_y", (F.col("bin_x") - 1).alias("bin_x"), F.col("i").alias("j"))
    pairs = graded.join(right, [*keys, "bin_y", "bin_x"]).select(*keys, "i", "j")
    both = pairs.unionByName(pairs.select(*keys, F.col("j").alias("i"), F.col("i").alias("j")))
    counts = both.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(top))
    i, j, w = F.col("i"), F.col("j"), F.col("p")
    moments = p.groupBy(*keys).agg(
        F.sum(w * F.pow(i - j, 2)).alias("contrast"), F.sum(w / (1 + F.pow(i - j, 2))).alias("homogeneity"), F.sqrt(F.sum(w * w)).alias("energy"),
        F.sum(w * i * j).alias("_ij"), F.sum(w * i).alias("_i"), F.sum(w * i * i).alias("_ii"),
    )
    spread = F.col("_ii") - F.col("_i") * F.col("_i")
    return moments.select(*keys, "contrast", "homogeneity", "energy", F.when(F.round(spread, 12) > 0, (F.col("_ij") - F.col("_i") * F.col("_i")) / spread).alias("correlation"))


def with_parents(units: DataFrame, size: float) -> DataFrame:
    """Adds parent_x and parent_y: the coarser square that a unit lies in."""
    return units.withColumns({"parent_x": F.floor(F.col("x") / size), "parent_y": F.floor(F.col("y") / size)})


def coarsened(units: DataFrame, keys: list[str], label: str, values: list[str]) -> DataFrame:
    """(keys, parent_x, parent_y, n_units, label, values): means of a parent's units, and the label most of them have, the first of equals."""
    parent = [*keys, "parent_x", "parent_y"]
    means = units.groupBy(*parent).agg(F.count(F.lit(1)).alias("n_units"), *(F.avg(v).alias(v) for v in values))
    votes = units.groupBy(*parent, label).agg(F.count(F.lit(1)).alias("_n"))
    most = votes.groupBy(*parent).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("label")))["label"].alias("label"))
    return means.join(most, parent).select(*parent, "n_units", "label", *values)


def label_map(labels: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys, y, x, label): labels by place (at = y * width + x) on the whole grid of each key, -1 where there is none."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1)))
    grid = labels.select(*keys).distinct().select(*keys, cells.alias("at")).withColumn("at", F.col("at").cast("bigint"))
    placed = grid.join(labels, [*keys, "at"], "left")
    return placed.select(*keys, F.floor(F.col("at") / width).alias("y"), (F.col("at") % width).alias("x"), F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"))
