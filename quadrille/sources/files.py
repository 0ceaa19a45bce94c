"""Readers: pixel files, result documents, metadata, annotations, features, reference artefacts."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.sources import columns

ARRAY = "struct<__numpy_array__: boolean, dtype: string, shape: array<int>, data: array<double>>"
SCALE = f"struct<spatial_coords: {ARRAY}, cluster_labels: {ARRAY}, transformed_arrays: map<string, {ARRAY}>, spatial_coherence: double>"
#: A result document: for each scale arrays of one length, and what the region is.
DOCUMENT = f"roi_id string, metadata struct<timepoint: string, mouse: string>, multiscale_results map<string, {SCALE}>"
SCALES = ("10.0", "20.0", "40.0")


def pixel_table(spark: SparkSession, path: str, markers: list[str], dna: list[str]) -> DataFrame:
    """Pixels of tab-separated files with a header: place, push order, markers and DNA as doubles, partition columns kept.

    A marker without a column is left out with a warning; a DNA channel without one is an error.
    """
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    found = columns.assigned([*markers, *dna], raw.columns)
    for name in (m for m in markers if found[m] is None):
        logging.getLogger(__name__).warning("no column holds %s", name)
    if missing := [d for d in dna if found[d] is None]:
        raise ValueError(f"no column holds {', '.join(missing)}")
    given = {c for c in raw.columns if c in ("Start_push", "X", "Y", "Z")} | {m.column for m in found.values() if m}
    parts = [c for c in raw.columns if c not in given and "(" not in c]
    value = lambda c: F.col(f"`{c}`").cast("double")
    return raw.select(*parts, value("X").alias("x"), value("Y").alias("y"), F.col("Start_push").cast("bigint").alias("push"), *(value(found[m].column).alias(m.lower()) for m in [*markers, *dna] if found[m]))


def images(pixels: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """(keys, channel, y, x, value): the lit pixels of each channel's image; of several counts for a pixel the last push is the one.

    Pixels that are not there are 0; an image reaches to the largest x and y.
    """
    last = pixels.groupBy(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(*(F.max(F.struct("push", c))[c].alias(c) for c in channels))
    return last.unpivot([*keys, "y", "x"], channels, "channel", "value")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Result documents, gzipped or not, a document a line; what can't be read gives a row of nulls and is passed over."""
    return spark.read.schema(DOCUMENT).option("mode", "PERMISSIVE").json(path).filter("roi_id IS NOT NULL")


def scale_of(docs: DataFrame, scale: str | None = None) -> DataFrame:
    """(roi_id, metadata, scale, data): one row a document and scale."""
    rows = docs.select("roi_id", "metadata", F.explode("multiscale_results").alias("scale", "data"))
    return rows if scale is None else rows.filter(F.col("scale") == scale)


def array_rows(array: Column, width: int) -> Column:
    """Rows of a tagged array of two dimensions, each an array of its width."""
    n = F.floor(F.size(array["data"]) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(array["data"], i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<array<double>>"))


def unit_rows(docs: DataFrame, markers: list[str], scale: str = "10.0") -> DataFrame:
    """(roi_id, metadata, scale, superpixel_id, x, y, cluster, markers): a row a superpixel; a marker whose array is short is null for the rest."""
    data = F.col("data")
    named = {m: F.coalesce(F.element_at(data["transformed_arrays"], m)["data"], F.array().cast("array<double>")) for m in markers}
    zipped = F.arrays_zip(array_rows(data["spatial_coords"], 2).alias("at"), data["cluster_labels"]["data"].alias("cluster"), *(v.alias(m) for m, v in named.items()))
    flat = scale_of(docs, scale).select("roi_id", "metadata", "scale", F.posexplode(zipped).alias("superpixel_id", "u"))
    return flat.select("roi_id", "metadata", "scale", F.col("superpixel_id").cast("bigint").alias("superpixel_id"), F.col("u.at")[0].alias("x"), F.col("u.at")[1].alias("y"), F.col("u.cluster").cast("int").alias("cluster"), *(F.col(f"u.{m}").alias(m) for m in markers))


def document_faults(docs: DataFrame, scales: tuple[str, ...] = SCALES) -> DataFrame:
    """(roi_id, missing_scales, short_arrays, negative_values, negative_places, gaps_in_labels): how often each rule is broken."""
    data, n = F.col("data"), F.size(F.col("data")["cluster_labels"]["data"])
    arrays = F.map_values(data["transformed_arrays"])
    labels = F.array_sort(F.array_distinct(data["cluster_labels"]["data"]))
    each = scale_of(docs).select(
        "roi_id", "scale",
        (F.size(F.filter(arrays, lambda a: F.size(a["data"]) != n)) + (F.size(array_rows(data["spatial_coords"], 2)) != n).cast("int")).alias("short"),
        F.size(F.filter(F.flatten(F.transform(arrays, lambda a: a["data"])), lambda v: v < 0)).alias("low"), F.size(F.filter(data["spatial_coords"]["data"], lambda v: v < 0)).alias("off"),
        (labels != F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: i.cast("double"))).cast("int").alias("gaps"),
    )
    return each.groupBy("roi_id").agg((len(scales) - F.count_if(F.col("scale").isin(*scales))).alias("missing_scales"), *(F.sum(a).alias(b) for a, b in (("short", "short_arrays"), ("low", "negative_values"), ("off", "negative_places"), ("gaps", "gaps_in_labels"))))


def document_summary(docs: DataFrame) -> DataFrame:
    """(roi_id, scale, n_superpixels, n_clusters, spatial_coherence)."""
    labels = F.col("data")["cluster_labels"]["data"]
    return scale_of(docs).select("roi_id", "scale", F.size(labels).cast("bigint").alias("n_superpixels"), F.size(F.array_distinct(labels)).cast("bigint").alias("n_clusters"), F.coalesce(F.col("data")["spatial_coherence"], F.lit(0.0)).alias("spatial_coherence"))


def name_parts(name: Column) -> dict[str, Column]:
    """What a region's file name says: roi_<run>_ROI_Sam1_01_2, or roi_<run>_ROI_D1_M1_01_9; null where it says nothing."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^roi_", ""), r"(_results)?(\.json)?(\.gz)?$", "")
    part = lambda form: F.nullif(F.regexp_extract(stem, form, 1), F.lit(""))
    sham = part(r"_ROI_(Sam\d+)_")
    return {
        "roi_id": stem, "timepoint": F.when(sham.isNotNull(), "Sham").otherwise(part(r"_ROI_(D\d+)_")), "mouse": F.coalesce(sham, part(r"_ROI_D\d+_(M\d+)_")),
        "roi_number": part(r"_ROI_(?:Sam\d+|D\d+_M\d+)_(\d+)_"), "replicate": part(r"_ROI_(?:Sam\d+|D\d+_M\d+)_\d+_(\d+)$"), "condition": F.when(sham.isNotNull(), "Sham").when(part(r"_ROI_(D\d+)_").isNotNull(), "UUO"),
    }


def metadata_table(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, day, mouse, region): the metadata file, spaces around names and values dropped."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    return raw.select(F.trim("File Name").alias("file_name"), F.col("Injury Day").cast("int").alias("day"), F.trim("Mouse").alias("mouse"), F.trim("Details").alias("region"))


def with_metadata(regions: DataFrame, metadata: DataFrame, name: str = "name") -> DataFrame:
    """Adds timepoint, mouse, region and replicate: as the metadata file says, else as the name says (region and, of controls, mouse are unknown then)."""
    stem = F.regexp_replace(F.col(name), r"^roi_", "")
    own = name_parts(F.col(name))
    number = F.nullif(F.regexp_extract(F.col(name), r"_(\d{2})(?:_|$)", 1), F.lit(""))
    joined = regions.withColumn("_stem", stem).join(metadata.withColumnsRenamed({c: f"_{c}" for c in metadata.columns}), F.col("_stem") == F.col("_file_name"), "left")
    known = F.col("_file_name").isNotNull()
    day = F.when(F.col("_day") == 0, "Sham").otherwise(F.concat(F.lit("D"), F.col("_day").cast("string")))
    sham = F.col(name).contains("Sam")
    named_replicate = F.when(sham, F.regexp_extract(F.col(name), r"(Sam\d+)", 1)).when(F.col(name).contains("Test"), "Test01").when(own["timepoint"].isNotNull(), F.concat_ws("_", own["timepoint"], own["mouse"], own["roi_number"])).otherwise(F.col(name))
    return joined.withColumns({
        "timepoint": F.when(known, day).otherwise(F.coalesce(own["timepoint"], F.when(F.col(name).contains("Test"), "Test"), F.lit("Unknown"))),
        "mouse": F.when(known, F.col("_mouse")).otherwise(F.when(~sham, own["mouse"])), "region": F.col("_region"),
        "replicate": F.when(known, F.when(sham, F.regexp_replace("_mouse", "MS", "Sam")).otherwise(F.concat_ws("_", day, F.col("_mouse"), number))).otherwise(named_replicate),
    }).drop("_stem", *(f"_{c}" for c in metadata.columns))


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on keys that are unique on both sides; an error if they aren't."""
    for side, name in ((left, "left"), (right, "right")):
        if not repeated_keys(side, on).isEmpty():
            raise ValueError(f"keys {on} are not unique on the {name}")
    return left.join(right, on)


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).count().filter("count > 1")


def features(spark: SparkSession, path: str, regions: list | None = None, proteins: list[str] | None = None) -> DataFrame:
    """Stored features of all regions or those listed, all proteins or those listed; ids and meta_ columns are always there."""
    df = spark.read.parquet(path)
    if regions is not None:
        df = df.filter(F.col("roi_id").isin(*regions))
    return df if proteins is None else df.select(*(c for c in df.columns if c in ("roi_id", "spatial_bin_id") or c.startswith("meta_") or c in proteins))


def reference_artefact(spark: SparkSession, path: str, scale: float, markers: list[str], config: str, percentile: float, aggregation: str) -> DataFrame:
    """(marker, threshold, scale) of a stored reference; an error unless it was made for this scale, these markers in this order, and these settings."""
    r = spark.read.schema("scale_um double, markers array<string>, config_sha256 string, percentile double, aggregation string, entries map<string, struct<threshold: double, scale: double>>").json(path).first()
    want = {"scale_um": scale, "markers": markers, "config_sha256": config, "percentile": percentile, "aggregation": aggregation}
    if differs := [k for k, v in want.items() if r[k] != v]:
        raise ValueError(f"the reference was made with other {', '.join(differs)}")
    rows = [(m, r["entries"][m]["threshold"], r["entries"][m]["scale"]) for m in markers]
    return spark.createDataFrame(rows, "marker string, threshold double, scale double")


def to_tagged(array: Column, dtype: str, *shape: Column) -> Column:
    """A flat array as a tagged one."""
    return F.struct(F.lit(True).alias("__numpy_array__"), F.lit(dtype).alias("dtype"), F.array(*(s.cast("int") for s in shape)).alias("shape"), F.transform(array, lambda v: v.cast("double")).alias("data"))
