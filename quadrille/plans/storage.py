"""Plans that write files and read them back: pixel files, result documents, metadata, annotations, features, exports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.folders import new_path, staged
from quadrille.plans.common import REFERENCE_SQL, query, r6, reference, rounded, units
from quadrille.sinks import files as sinks
from quadrille.sources import columns, files, virtual
from quadrille.sources.virtual import BASE_SQL, DNA, MARKERS

M = ", ".join(MARKERS)
# How the instrument names its channels.
HEADERS = {
    "cd45": "CD45(Sm152Di)", "cd11b": "CD11b(Nd143Di)", "ly6g": "Ly6G(Pr141Di)", "cd140a": "CD140a(Nd148Di)", "cd140b": "CD140b(Eu151Di)", "cd31": "CD31(Sm154Di)",
    "cd34": "CD34(Er166Di)", "cd206": "CD206(Tm169Di)", "cd44": "CD44(Yb171Di)", "dna1": "DNA1(Ir191Di)", "dna2": "DNA2(Ir193Di)",
}
_PUSH = "l_orderkey * 8 + l_linenumber"


def _pixel_files(spark: SparkSession, sf_dir: str) -> str:
    """Tab-separated files of all pixels, a folder a region."""
    path = new_path(spark, "pixels")
    px = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.expr(_PUSH).alias("Start_push"), *(F.expr(e).alias(c) for c, e in virtual.PIXEL_COLUMNS.items()))
    px.withColumnsRenamed({"x": "X", "y": "Y", **HEADERS}).repartition("roi").write.option("sep", "\t").option("header", True).partitionBy("roi").csv(path)
    return path


@query(f"WITH {virtual.pixel_sql()} SELECT roi, x::DOUBLE AS x, y::DOUBLE AS y, {', '.join(r6(f'{m}::DOUBLE', m) for m in MARKERS + DNA)} FROM px")
def pixel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(files.pixel_table(spark, _pixel_files(spark, sf_dir), MARKERS, DNA).drop("push"))


@query(f"""WITH px AS (SELECT {_PUSH} AS push, {', '.join(f'{e} AS {c}' for c, e in virtual.PIXEL_COLUMNS.items())} FROM lineitem),
d AS (SELECT roi, y, x, {', '.join(f'arg_max({m}, (push, {m})) AS {m}' for m in MARKERS + DNA)} FROM px GROUP BY ALL), l AS (SELECT roi, y, x, channel, value FROM (UNPIVOT d ON {M}, dna1, dna2 INTO NAME channel VALUE value))
SELECT roi, channel, (max(x) + 1)::INT AS width, (max(y) + 1)::INT AS height, count(*) AS n_filled, round(sum(value), 5) AS total FROM l GROUP BY ALL""")
def channel_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = files.images(files.pixel_table(spark, _pixel_files(spark, sf_dir), MARKERS, DNA), ["roi"], MARKERS + DNA)
    return rounded(image.groupBy("roi", "channel").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count(F.lit(1)).alias("n_filled"), F.sum("value").alias("total")), 5)


_ASKED = ["CD45", "CD3", "CD38", "CD11b", "CD140a", "Ly6G", "Collagen", "DNA1", "Vimentin"]
_GIVEN = ["X", "Y", "CD38(In113Di)", "CD11b(Nd143Di)", "CD-45 (Sm152Di)", "cd140a", "Ly-6G_1(Pr141Di)", "DNA1", "DNA1(Ir191Di)", "Collagen1(Tm169Di)"]


@query(f"""WITH a AS (SELECT unnest({_ASKED}) AS marker), g AS (SELECT unnest({_GIVEN}) AS "column"),
m AS (SELECT marker, "column", CASE WHEN lower(marker) = lower("column") THEN 1.0 ELSE 0.95 END AS confidence FROM a, g
WHERE lower(marker) = lower("column") OR regexp_full_match(lower("column"), regexp_replace(lower(marker), '([0-9])', '-?\\1', 'g') || '([_-][0-9]+)?[_-]?[ ]*\\([^)]+\\)')),
b AS (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY confidence DESC) AS r FROM m)
SELECT a.marker, "column", round(confidence, 6) AS confidence, CASE WHEN confidence = 1 THEN 'exact' WHEN confidence < 1 THEN 'regex' END AS how FROM a LEFT JOIN b ON a.marker = b.marker AND r = 1""")
def channel_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = columns.assigned(_ASKED, _GIVEN)
    rows = [(m, x.column if x else None, x.confidence if x else None, x.how if x else None) for m, x in found.items()]
    return rounded(spark.createDataFrame(rows, "marker string, column string, confidence double, how string"))


def _documents(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    """Result documents of all regions at three scales, written as gzipped JSON and read back; faults: some regions break a rule."""
    scales = {}
    for scale in (10, 20, 40):
        df = units(spark, sf_dir, scale).withColumnRenamed("spx", "id")
        label = F.col("id") % 7
        if faults:
            label = F.when(F.col("roi") % 6 == 4, label * 2).otherwise(label)
            df = df.withColumn("cd45", F.when(F.col("roi") % 6 == 3, -F.col("cd45") - 1).otherwise(F.col("cd45"))).withColumn("x", F.when(F.col("roi") % 6 == 2, -F.col("x") - 1).otherwise(F.col("x")))
        scales[f"{scale}.0"] = df.withColumn("cluster", label.cast("int"))
    docs = sinks.result_documents(scales, "roi", MARKERS)
    short = F.transform_values("multiscale_results", lambda _, d: F.struct(d["spatial_coords"].alias("spatial_coords"), d["cluster_labels"].alias("cluster_labels"), F.transform_values(d["transformed_arrays"], lambda k, a: F.when(k == "cd44", F.struct(a["__numpy_array__"].alias("__numpy_array__"), a["dtype"].alias("dtype"), a["shape"].alias("shape"), F.slice(a["data"], F.lit(1), F.size(a["data"]) - 1).alias("data"))).otherwise(a)).alias("transformed_arrays"), d["spatial_coherence"].alias("spatial_coherence")))
    docs = docs.withColumn("multiscale_results", F.when(F.col("roi_id").cast("int") % 6 == 5, short).otherwise(F.col("multiscale_results")))
    if faults:
        docs = docs.withColumn("multiscale_results", F.when(F.col("roi_id").cast("int") % 6 == 1, F.map_filter("multiscale_results", lambda k, _: k != "40.0")).otherwise(F.col("multiscale_results")))
    path = new_path(spark, "documents")
    sinks.save(docs, path, "json")
    return files.documents(spark, path)


@query(f"""WITH {BASE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY spx) - 1 AS superpixel_id, count(*) OVER (PARTITION BY roi) AS k FROM ex)
SELECT roi::VARCHAR AS roi_id, timepoint, mouse, superpixel_id, {r6('x', 'x')}, {r6('y', 'y')}, (spx % 7)::INT AS cluster, {', '.join(r6(m, m) for m in MARKERS if m != 'cd44')}, round(CASE WHEN roi % 6 = 5 AND superpixel_id = k - 1 THEN NULL ELSE cd44 END, 6) AS cd44 FROM n""")
def document_superpixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.unit_rows(_documents(spark, sf_dir), MARKERS)
    return rounded(rows.select("roi_id", "metadata.timepoint", "metadata.mouse", "superpixel_id", "x", "y", "cluster", *MARKERS))


_BY_SCALE = ", ".join(f"{virtual.superpixel_sql(s, f's{s}')}" for s in (10, 20, 40))


@query(f"""WITH {virtual.pixel_sql()}, {_BY_SCALE}, n AS (SELECT roi, count(*) AS n FROM (SELECT roi, spx FROM s10 UNION ALL SELECT roi, spx + 100000 FROM s20 UNION ALL SELECT roi, spx + 200000 FROM s40) GROUP BY roi)
SELECT roi::VARCHAR AS roi_id, (roi % 6 = 1)::INT::BIGINT AS missing_scales, CASE WHEN roi % 6 = 5 THEN 3 ELSE 0 END::BIGINT AS short_arrays, CASE WHEN roi % 6 = 3 THEN n ELSE 0 END AS negative_values,
CASE WHEN roi % 6 = 2 THEN n ELSE 0 END AS negative_places, CASE WHEN roi % 6 = 4 THEN 3 ELSE 0 END::BIGINT AS gaps_in_labels FROM n""")
def document_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.document_faults(_documents(spark, sf_dir, faults=True))
    return found.select("roi_id", *(F.col(c).cast("bigint").alias(c) for c in found.columns[1:]))


@query(f"""WITH {virtual.pixel_sql()}, {_BY_SCALE}, u AS (SELECT roi, spx, '10.0' AS scale FROM s10 UNION ALL SELECT roi, spx, '20.0' FROM s20 UNION ALL SELECT roi, spx, '40.0' FROM s40)
SELECT roi::VARCHAR AS roi_id, scale, count(*) AS n_superpixels, count(DISTINCT spx % 7) AS n_clusters, 0.0::DOUBLE AS spatial_coherence FROM u GROUP BY ALL""")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.document_summary(_documents(spark, sf_dir))


_NAME = "'roi_IMC_241218_Run_ROI_' || CASE WHEN roi % 4 = 0 THEN 'Sam' || (1 + (roi // 4) % 2) ELSE 'D' || [0, 1, 3, 7][roi % 4 + 1] || '_M' || (1 + (roi // 4) % 2) END || '_0' || (1 + roi // 8) || '_' || roi"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with file names as a run gives them."""
    roi = F.col("roi")
    who = (1 + F.floor(roi / 4) % 2).cast("string")
    day = F.get(F.array(*map(F.lit, ("0", "1", "3", "7"))), (roi % 4).cast("int"))
    head = F.when(roi % 4 == 0, F.concat(F.lit("Sam"), who)).otherwise(F.concat(F.lit("D"), day, F.lit("_M"), who))
    name = F.concat(F.lit("roi_IMC_241218_Run_ROI_"), head, F.lit("_0"), (1 + F.floor(roi / 8)).cast("string"), F.lit("_"), roi.cast("string"))
    return virtual.pixels(spark, sf_dir).select("roi").distinct().withColumn("name", name)


@query(f"""WITH {virtual.pixel_sql()}, r AS (SELECT DISTINCT roi, {_NAME} AS name FROM px) SELECT substr(name, 5) AS roi_id, CASE WHEN roi % 4 = 0 THEN 'Sham' ELSE 'D' || [0, 1, 3, 7][roi % 4 + 1] END AS timepoint,
CASE WHEN roi % 4 = 0 THEN 'Sam' ELSE 'M' END || (1 + (roi // 4) % 2) AS mouse, '0' || (1 + roi // 8) AS roi_number, roi::VARCHAR AS replicate, CASE WHEN roi % 4 = 0 THEN 'Sham' ELSE 'UUO' END AS condition FROM r""")
def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _named(spark, sf_dir).withColumn("name", F.concat("name", F.lit("_results.json.gz")))
    return named.select(*(c.alias(k) for k, c in files.name_parts(F.col("name")).items()))


@query(f"""WITH {virtual.pixel_sql()}, r AS (SELECT DISTINCT roi, {_NAME} AS name FROM px), k AS (SELECT *, roi % 3 <> 0 AS known, 'D' || [0, 1, 3, 7][roi % 4 + 1] AS d, (1 + (roi // 4) % 2) AS w FROM r)
SELECT roi, CASE WHEN roi % 4 = 0 THEN 'Sham' ELSE d END AS timepoint, CASE WHEN known THEN 'MS' || w WHEN roi % 4 <> 0 THEN 'M' || w END AS mouse, CASE WHEN known THEN CASE WHEN (roi // 8) % 2 = 0 THEN 'Cortex' ELSE 'Medulla' END END AS region,
CASE WHEN roi % 4 = 0 THEN 'Sam' || w WHEN known THEN d || '_MS' || w || '_0' || (1 + roi // 8) ELSE d || '_M' || w || '_0' || (1 + roi // 8) END AS replicate FROM k""")
def region_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _named(spark, sf_dir)
    path = new_path(spark, "metadata")
    day = F.get(F.array(*(F.lit(d) for d in (0, 1, 3, 7))), (F.col("roi") % 4).cast("int"))
    table = named.filter("roi % 3 <> 0").select(F.regexp_replace("name", "^roi_", "").alias(" File Name "), day.alias("Injury Day"), F.concat(F.lit("MS"), (1 + F.floor(F.col("roi") / 4) % 2).cast("string")).alias("Mouse"), F.concat(F.lit(" "), F.when(F.floor(F.col("roi") / 8) % 2 == 0, "Cortex").otherwise("Medulla")).alias("Details"))
    sinks.save(table, path, "csv", compress=False)
    return files.with_metadata(named, files.metadata_table(spark, path)).drop("name")


@query(f"WITH {BASE_SQL} SELECT roi, spx, {r6('x', 'x')}, {r6('y', 'y')}, {', '.join(r6(m, m) for m in MARKERS)}, 'type' || (spx % 5) AS cell_type, round((spx % 11) / 10.0, 6) AS confidence, timepoint, mouse, region FROM ex")
def annotated_superpixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpixels with their annotations, both read from files, joined one to one, the design joined on."""
    df = units(spark, sf_dir)
    at = new_path(spark, "annotations"), new_path(spark, "superpixels")
    df.select("roi", "spx", F.concat(F.lit("type"), (F.col("spx") % 5).cast("string")).alias("cell_type"), (F.col("spx") % 11 / 10.0).alias("confidence")).repartition("roi").write.partitionBy("roi").parquet(at[0])
    df.select("roi", "spx", "x", "y", *MARKERS).repartition("roi").write.partitionBy("roi").parquet(at[1])
    joined = files.one_to_one(spark.read.parquet(at[1]), spark.read.parquet(at[0]), ["roi", "spx"])
    return rounded(virtual.with_design(joined))


@query(f"WITH {BASE_SQL} SELECT roi AS roi_id, spx AS spatial_bin_id, 'run1' AS meta_run, timepoint AS meta_timepoint, {r6('cd45', 'cd45')}, {r6('cd31', 'cd31')} FROM ex")
def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = units(spark, sf_dir).select(F.col("roi").alias("roi_id"), F.col("spx").alias("spatial_bin_id"), F.col("timepoint").alias("meta_timepoint"), *MARKERS)
    path = new_path(spark, "features")
    sinks.save_features(df, path, {"run": "run1"})
    return rounded(files.features(spark, path, proteins=["cd45", "cd31"]))


@query(f"WITH {BASE_SQL}, c AS (SELECT roi, spx % 7 AS cluster, {', '.join(f'avg({m}) AS {m}' for m in MARKERS)} FROM ex GROUP BY ALL) SELECT roi, cluster, protein, round(value, 6) AS value FROM (UNPIVOT c ON {M} INTO NAME protein VALUE value)")
def stored_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sinks.melted_centroids(units(spark, sf_dir).withColumn("cluster", F.col("spx") % 7), ["roi", "cluster"], MARKERS)
    path = new_path(spark, "centroids")
    sinks.save(made, path)
    return rounded(spark.read.parquet(path))


@query(f"""WITH {BASE_SQL}, s AS (SELECT timepoint, count(*) AS n_rows, count(DISTINCT roi) AS n_regions, round(sum(cd45), 5) AS total FROM ex GROUP BY timepoint), f AS (SELECT unnest(['parquet', 'json', 'csv', 'hdf5']) AS asked)
SELECT asked, CASE WHEN asked = 'hdf5' THEN 'json' ELSE asked END AS written, s.* FROM f, s""")
def storage_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table through every format and back; what is not known is written as JSON."""
    df = units(spark, sf_dir).select("roi", "timepoint", "spx", "cd45")
    out = None
    for kind in ("parquet", "json", "csv", "hdf5"):
        path = new_path(spark, f"format-{kind}")
        as_ = sinks.save(df, path, kind)
        back = sinks.load(spark, path, as_, "roi bigint, timepoint string, spx bigint, cd45 double")
        one = back.groupBy("timepoint").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("roi").alias("n_regions"), F.sum("cd45").alias("total")).select(F.lit(kind).alias("asked"), F.lit(as_).alias("written"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out, 5)


_ODD = "CASE p_partkey % 5 WHEN 0 THEN '../' || p_name WHEN 1 THEN '-' || p_name || '.' WHEN 2 THEN p_name || '/x:y' WHEN 3 THEN '..' ELSE p_name END"


@query(f"""WITH n AS (SELECT p_partkey, {_ODD} AS name FROM part), k AS (SELECT *, regexp_replace(regexp_replace(name, '[^a-zA-Z0-9_.-]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS s FROM n),
c AS (SELECT *, substr(CASE WHEN s[1:1] = '-' THEN 'roi_' || s ELSE s END, 1, 100) AS t FROM k) SELECT p_partkey, CASE WHEN t <> '' AND NOT contains(t, '..') THEN t END AS safe FROM c""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    odd = F.when(k == 0, F.concat(F.lit("../"), n)).when(k == 1, F.concat(F.lit("-"), n, F.lit("."))).when(k == 2, F.concat(n, F.lit("/x:y"))).when(k == 3, "..").otherwise(n)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", sinks.safe_name(odd).alias("safe"))


@query("SELECT s_suppkey AS key, s_nationkey AS nation, round(s_acctbal, 6) AS balance, length(s_name)::INT AS letters FROM supplier")
def nested_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested columns made plain, nested again and made plain again."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    nested = s.select(F.struct(F.col("s_suppkey").alias("key"), F.struct(F.col("s_nationkey").alias("nation"), F.struct(F.col("s_acctbal").alias("balance")).alias("deep")).alias("place")).alias("a"), F.struct(F.length("s_name").alias("letters")).alias("b"))
    flat = sinks.flattened(sinks.unflattened(sinks.flattened(nested)))
    assert flat.columns == ["a.key", "a.place.nation", "a.place.deep.balance", "b.letters"]
    return rounded(flat.toDF("key", "nation", "balance", "letters"))


@query(f"""WITH {BASE_SQL}, m AS (SELECT timepoint, mouse, region, {', '.join(f'avg({v}) AS {v}' for v in MARKERS)}, count(*) AS n FROM ex GROUP BY ALL)
SELECT 'mouse' AS level, timepoint, mouse, 'pooled' AS region, {', '.join(f'round(avg({v}), 6) AS {v}' for v in MARKERS)}, sum(n)::BIGINT AS n FROM m GROUP BY timepoint, mouse UNION ALL SELECT 'mouse_region', timepoint, mouse, region, {', '.join(f'round({v}, 6)' for v in MARKERS)}, n FROM m""")
def product_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slices of one product, each written to a file of its own, read back with a tag of where they come from."""
    base = units(spark, sf_dir).groupBy("timepoint", "mouse", "region").agg(*(F.avg(v).alias(v) for v in MARKERS), F.count(F.lit(1)).alias("n"))
    product = staged(base.groupingSets([["timepoint", "mouse"], ["timepoint", "mouse", "region"]], "timepoint", "mouse", "region").agg(*(F.avg(v).alias(v) for v in MARKERS), F.sum("n").alias("n"), F.grouping("region").alias("g")), "product")
    out = None
    for level, g in (("mouse", 1), ("mouse_region", 0)):
        path = new_path(spark, level)
        sinks.save(product.filter(F.col("g") == g).select("timepoint", "mouse", F.coalesce("region", F.lit("pooled")).alias("region"), *MARKERS, "n"), path, "csv", compress=False)
        one = sinks.load(spark, path, "csv", f"timepoint string, mouse string, region string, {', '.join(f'{v} double' for v in MARKERS)}, n bigint").select(F.lit(level).alias("level"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(f"WITH {BASE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY spx) - 1 AS i FROM ex) SELECT roi, (i // 1)::BIGINT AS row, c AS col, round(CASE c WHEN 0 THEN cd45 ELSE cd44 END, 6) AS value FROM n, (SELECT unnest([0, 1]) AS c)")
def tagged_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices written as tagged arrays in JSON text and decoded to (row, col, value) by their shape."""
    ordered = units(spark, sf_dir).groupBy("roi").agg(F.sort_array(F.collect_list(F.struct("spx", "cd45", "cd44"))).alias("u"))
    text = ordered.select("roi", F.to_json(files.to_tagged(F.flatten(F.transform("u", lambda s: F.array(s["cd45"], s["cd44"]))), "float64", F.size("u"), F.lit(2))).alias("text"))
    array = text.select("roi", F.from_json("text", files.ARRAY).alias("a"))
    cells = array.select("roi", F.col("a.shape")[1].alias("w"), F.posexplode("a.data").alias("i", "value"))
    return rounded(cells.select("roi", F.floor(F.col("i") / F.col("w")).alias("row"), (F.col("i") % F.col("w")).alias("col"), "value"))


_CONFIG = {"markers": MARKERS, "percentile": 60.0}
_CONFIG_SHA = hashlib.sha256(json.dumps(_CONFIG, sort_keys=True).encode()).hexdigest()


@query(f"WITH {BASE_SQL}, {REFERENCE_SQL} SELECT marker, {r6('threshold', 'threshold')}, {r6('scale', 'scale')} FROM ref")
def stored_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference distribution written as an artefact and read back under its checks."""
    path = new_path(spark, "reference")
    made = reference(units(spark, sf_dir)).agg(F.map_from_entries(F.collect_list(F.struct("marker", F.struct("threshold", "scale")))).alias("entries"))
    made.select(F.lit(10.0).alias("scale_um"), F.array(*map(F.lit, MARKERS)).alias("markers"), F.lit(_CONFIG_SHA).alias("config_sha256"), F.lit(60.0).alias("percentile"), F.lit("per_mouse").alias("aggregation"), "entries").write.json(path)
    return rounded(files.reference_artefact(spark, path, 10.0, MARKERS, _CONFIG_SHA, 60.0, "per_mouse"))


@query(f"""WITH {virtual.pixel_sql()}, {virtual.superpixel_sql()} SELECT '{{"pixels": ' || (SELECT count(*) FROM px) || ', "superpixels": ' || (SELECT count(*) FROM spx) || '}}' AS row_counts, '{_CONFIG_SHA}' AS config_sha256, '{{"permutations": 42}}' AS seeds""")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "manifest")
    sinks.provenance(spark, path, {"pixels": virtual.pixels(spark, sf_dir), "superpixels": virtual.superpixels(spark, sf_dir)}, _CONFIG, {"permutations": 42})
    return spark.read.json(path).select("row_counts", "config_sha256", "seeds")


@query(f"""WITH {BASE_SQL}, s AS (SELECT roi, timepoint, count(*) AS n FROM ex GROUP BY ALL) SELECT timepoint, count(*) AS n_regions, sum(n)::BIGINT AS n_superpixels, round(avg(n), 6) AS mean_superpixels FROM s GROUP BY timepoint""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort's summary, made anew from the units of each region."""
    s = units(spark, sf_dir).groupBy("roi", "timepoint").agg(F.count(F.lit(1)).alias("n"))
    return rounded(s.groupBy("timepoint").agg(F.count(F.lit(1)).alias("n_regions"), F.sum("n").alias("n_superpixels"), F.avg("n").alias("mean_superpixels")))


