"""Cells found by flooding, and what is measured in and about them. Held against plain Python in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.folders import staged
from quadrille.operators import raster, watershed
from quadrille.plans.common import query, rounded
from quadrille.sources import virtual

#: Side of a pixel of the images, in micrometers; sizes below are those at 1 micrometer, in pixels of this side.
RESOLUTION = 5
BLOCK, APART, OPENING, SPECKS = 11, 1, 1, 1


def _segmented(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Image with mask, seeds and cells of each region."""
    image = staged(watershed.nucleus_image(virtual.pixels(spark, sf_dir), ["roi"], ("dna1", "dna2"), RESOLUTION), "nuclei")
    masked = staged(watershed.nucleus_mask(image, ["roi"], BLOCK, SPECKS, OPENING), "mask")
    seeds = staged(watershed.nucleus_seeds(masked, ["roi"], APART), "seeds")
    return masked, seeds, staged(watershed.cells(image, seeds, ["roi"], RESOLUTION), "cells")


def _shapes(found: DataFrame) -> DataFrame:
    return raster.segment_shapes(found, ["roi"]).join(watershed.solidities(found, ["roi"]), ["roi", "label"])


@query()
def watershed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker sums and centre of each cell."""
    found = _segmented(spark, sf_dir)[2]
    return rounded(watershed.cell_sums(virtual.pixels(spark, sf_dir), found, ["roi"], RESOLUTION, virtual.MARKERS + virtual.DNA), 5)


@query()
def watershed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, perimeter, eccentricity, compactness and solidity of each cell."""
    return rounded(_shapes(_segmented(spark, sf_dir)[2]))


@query()
def watershed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each region's cells came out: seeds, sizes, shapes and the checks that hold."""
    masked, seeds, found = _segmented(spark, sf_dir)
    return rounded(watershed.quality(masked, seeds, _shapes(found), ["roi"], RESOLUTION))


@query()
def watershed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that touch, corners included, as one object: its pixels, cells and bounds."""
    parts = watershed.connected(_segmented(spark, sf_dir)[2], ["roi"], raster.EIGHT)
    ends = [f(c).alias(f"{f.__name__}_{c[-1]}") for f in (F.min, F.max) for c in ("bin_x", "bin_y")]
    return parts.groupBy("roi", F.col("component").alias("object")).agg(F.count(F.lit(1)).alias("n_pixels"), F.count_distinct("label").alias("n_cells"), *ends)
