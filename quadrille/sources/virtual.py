"""Spatial tables derived from the driver's order tables: pixels, superpixels, edges' points.

Each line item becomes a pixel of a 500 x 500 field; 24 regions of interest form the design of
four timepoints, two subjects each, three regions a subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.rounding import tidy

MARKERS = ["cd45", "cd11b", "ly6g", "cd140a", "cd140b", "cd31", "cd34", "cd206", "cd44"]
DNA = ["dna1", "dna2"]
TIMEPOINTS = ["Sham", "D1", "D3", "D7"]
CONTROL = "Sham"
FIELD = 500

#: The same expressions serve both engines.
PIXEL_COLUMNS = {
    "roi": "l_partkey % 24",
    "x": "(l_orderkey * 37 + l_linenumber * 11 + l_partkey) % 500",
    "y": "(l_orderkey * 53 + l_partkey * 17 + l_suppkey) % 500",
    "cd45": "l_quantity",
    "cd11b": "l_extendedprice / 2000",
    "ly6g": "l_discount * 100",
    "cd140a": "l_tax * 200",
    "cd140b": "l_quantity * l_tax * 5",
    "cd31": "l_extendedprice / l_quantity / 50",
    "cd34": "l_quantity * l_discount * 4",
    "cd206": "l_extendedprice * l_tax / 300",
    "cd44": "l_extendedprice * l_discount / 400",
    "dna1": "l_quantity * 10",
    "dna2": "l_extendedprice / 100",
}


def with_design(df: DataFrame, roi: str = "roi") -> DataFrame:
    """Adds timepoint, mouse and region, which follow from the region's number."""
    r = F.col(roi)
    return df.withColumns({
        "timepoint": F.get(F.array(*map(F.lit, TIMEPOINTS)), (r % 4).cast("int")),
        "mouse": F.when(F.floor(r / 4) % 2 == 0, "MS1").otherwise("MS2"),
        "region": F.when(F.floor(r / 8) % 2 == 0, "Cortex").otherwise("Medulla"),
    })


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*(F.expr(e).alias(c) for c, e in PIXEL_COLUMNS.items()))


def superpixels(spark: SparkSession, sf_dir: str, scale: int = 10) -> DataFrame:
    """(roi, spx, x, y, markers, dna): sums of the pixels of each square of the given side."""
    from quadrille.operators.binning import bin_sums

    cells = bin_sums(pixels(spark, sf_dir), ["roi"], scale, MARKERS + DNA)
    width = FIELD // scale
    return cells.select("roi", (F.col("bin_y") * width + F.col("bin_x")).alias("spx"), "x", "y", *(tidy(m).alias(m) for m in MARKERS + DNA))


def expression(spx: DataFrame, cofactor: float = 5.0) -> DataFrame:
    """Superpixels with variance-stabilised markers, rounded so that comparisons agree between engines."""
    return spx.withColumns({m: stabilised(F.col(m), cofactor) for m in MARKERS})


def stabilised(value: Column, cofactor: float) -> Column:
    return F.round(F.asinh(value / cofactor), 9)


def pixel_sql() -> str:
    return "px AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in PIXEL_COLUMNS.items()) + " FROM lineitem)"


def design_sql(r: str = "roi") -> str:
    return f"(['Sham','D1','D3','D7'])[CAST({r} % 4 AS INTEGER) + 1] AS timepoint, CASE WHEN ({r} // 4) % 2 = 0 THEN 'MS1' ELSE 'MS2' END AS mouse, CASE WHEN ({r} // 8) % 2 = 0 THEN 'Cortex' ELSE 'Medulla' END AS region"


def superpixel_sql(scale: int = 10, name: str = "spx") -> str:
    w = FIELD // scale
    sums = ", ".join(f"round(sum({m}), 6) AS {m}" for m in MARKERS + DNA)
    return f"{name} AS (SELECT roi, (y // {scale}) * {w} + x // {scale} AS spx, avg(x) AS x, avg(y) AS y, {sums} FROM px GROUP BY roi, y // {scale}, x // {scale})"


def expression_sql(source: str = "spx", name: str = "ex") -> str:
    values = ", ".join(f"round(asinh({m} / 5), 9) AS {m}" for m in MARKERS)
    return f"{name} AS (SELECT roi, spx, x, y, {values}, {design_sql()} FROM {source})"


BASE_SQL = f"{pixel_sql()}, {superpixel_sql()}, {expression_sql()}"
