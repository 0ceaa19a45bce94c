"""Writers of tables and documents. Paths are Spark's: any store that it reaches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.sources.files import SCALE, to_tagged

FORMATS = ("parquet", "json", "csv")


def safe_name(name: Column, longest: int = 100) -> Column:
    """A name that is safe in paths: other characters become underscores, none of dots and underscores at the ends; null if nothing safe is left."""
    kept = F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9_\-.]", "_"), r"^[._]+|[._]+$", "")
    named = F.substring(F.when(kept.startswith("-"), F.concat(F.lit("roi_"), kept)).otherwise(kept), 1, longest)
    return F.when((named != "") & ~named.contains(".."), named)


def save(df: DataFrame, path: str, kind: str = "parquet", compress: bool = True) -> str:
    """Writes in the format named, JSON if it is none of FORMATS; returns the format."""
    kind = kind if kind in FORMATS else "json"
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    if compress and kind != "parquet":
        writer = writer.option("compression", "gzip")
    writer.format(kind).save(path)
    return kind


def load(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(path)


def save_features(df: DataFrame, path: str, metadata: dict[str, str] | None = None, key: str = "roi_id") -> None:
    """Features by region, a folder each; metadata as constant meta_ columns. A region that is written again replaces its folder alone."""
    rows = df.withColumns({f"meta_{k}": F.lit(v) for k, v in (metadata or {}).items()}) if metadata else df
    rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def melted_centroids(df: DataFrame, keys: list[str], proteins: list[str]) -> DataFrame:
    """(keys, protein, value): the mean of each protein for each cluster."""
    return df.groupBy(*keys).agg(*(F.avg(p).alias(p) for p in proteins)).unpivot(keys, proteins, "protein", "value")


def result_documents(scales: dict[str, DataFrame], key: str, markers: list[str]) -> DataFrame:
    """One document a region from superpixels by scale: (key, timepoint, mouse, id, x, y, cluster, markers).

    Arrays go in order of id; a region's superpixels are what one field of view holds.
    """
    rows = None
    for scale, df in scales.items():
        unit = F.struct("id", "x", "y", "cluster", *markers)
        units = df.groupBy(F.col(key).alias("roi_id")).agg(F.first("timepoint").alias("timepoint"), F.first("mouse").alias("mouse"), F.sort_array(F.collect_list(unit)).alias("u"))
        n = F.size("u")
        arrays = F.map_from_arrays(F.array(*map(F.lit, markers)), F.array(*(to_tagged(F.col("u")[m], "float64", n) for m in markers)))
        data = F.struct(to_tagged(F.flatten(F.transform("u", lambda s: F.array(s["x"], s["y"]))), "float64", n, F.lit(2)).alias("spatial_coords"), to_tagged(F.col("u")["cluster"], "int64", n).alias("cluster_labels"), arrays.alias("transformed_arrays"), F.lit(0.0).alias("spatial_coherence"))
        one = units.select(F.col("roi_id").cast("string").alias("roi_id"), "timepoint", "mouse", F.lit(scale).alias("scale"), data.cast(SCALE).alias("data"))
        rows = one if rows is None else rows.unionByName(one)
    whole = rows.groupBy("roi_id").agg(F.first("timepoint").alias("timepoint"), F.first("mouse").alias("mouse"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("scale", F.to_json("data").alias("data"))))).alias("m"))
    parsed = F.transform_values("m", lambda _, v: F.from_json(v, SCALE))
    return whole.select("roi_id", F.struct("timepoint", "mouse").alias("metadata"), parsed.alias("multiscale_results"))


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested columns as plain ones, with dotted names."""

    def leaves(kind: T.StructType, at: list[str]):
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, [*at, f.name])
            else:
                yield [*at, f.name]

    return df.select(*(F.col(".".join(f"`{p}`" for p in parts)).alias(separator.join(parts)) for parts in leaves(df.schema, [])))


def unflattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Columns with dotted names as nested ones."""

    def nested(names: list[list[str]], at: list[str]) -> list[Column]:
        out, done = [], []
        for parts in names:
            if parts[0] in done:
                continue
            done.append(parts[0])
            inside = [p[1:] for p in names if p[0] == parts[0] and len(p) > 1]
            path = [*at, parts[0]]
            out.append(F.struct(*nested(inside, path)).alias(parts[0]) if inside else F.col(f"`{separator.join(path)}`").alias(parts[0]))
        return out

    return df.select(*nested([c.split(separator) for c in df.columns], []))


def provenance(spark: SparkSession, path: str, tables: dict[str, DataFrame], config: dict, seeds: dict[str, int]) -> DataFrame:
    """Writes and returns the manifest of a run: rows of each table, the settings' digest, versions, seeds; one row."""
    text = json.dumps(config, sort_keys=True)
    counts = {k: v.count() for k, v in tables.items()}
    row = (json.dumps(counts, sort_keys=True), hashlib.sha256(text.encode()).hexdigest(), spark.version, json.dumps(seeds, sort_keys=True))
    made = spark.createDataFrame([row], "row_counts string, config_sha256 string, spark_version string, seeds string")
    made.write.mode("overwrite").json(path)
    return made


def storage_summary(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the files below a path, as Spark's own reader lists them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def set_aside(spark: SparkSession, path: str, to: str) -> bool:
    """Moves prior output out of the way; false if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    src, dst = hadoop.Path(path), hadoop.Path(to)
    fs = src.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(src) and fs.mkdirs(dst.getParent()) and fs.rename(src, dst))
