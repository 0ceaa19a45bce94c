"""Column matching, readers and writers on small inputs."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions.folders import new_path
from quadrille.sinks import files as sinks
from quadrille.sources import columns, files


def test_instrument_names():
    given = ["X", "Y", "CD38(In113Di)", "CD3(Er170Di)", "CD11b(Nd143Di)", "Ly-6G_1(Pr141Di)", "cd44", "DNA1(Ir191Di)"]
    found = columns.assigned(["CD3", "CD38", "CD11b", "Ly6G", "CD44", "CD4", "DNA1"], given)
    assert {k: v and (v.column, v.confidence) for k, v in found.items()} == {
        "CD3": ("CD3(Er170Di)", 0.95), "CD38": ("CD38(In113Di)", 0.95), "CD11b": ("CD11b(Nd143Di)", 0.95), "Ly6G": ("Ly-6G_1(Pr141Di)", 0.95), "CD44": ("cd44", 1.0), "CD4": None, "DNA1": ("DNA1(Ir191Di)", 0.95),
    }
    report = columns.coverage(found, given)
    assert (report["n_matched"], report["by_kind"], report["unmatched"], report["unused"]) == (6, {"exact": 1, "regex": 5}, ["CD4"], ["X", "Y"])


def test_a_column_serves_one_marker():
    found = columns.assigned(["CD45", "cd45"], ["CD45"])
    assert [m.column if m else None for m in found.values()] == ["CD45", None]


def test_candidates_by_kind():
    found = {m.column: (round(m.confidence, 4), m.how) for m in columns.candidates("CD31", ["CD31", "CD31(Sm154Di)", "CD31_a", "PECAM1_x", "CD32", "other"])}
    assert found == {"CD31": (1.0, "exact"), "CD31(Sm154Di)": (0.95, "regex"), "CD31_a": (0.95, "regex"), "PECAM1_x": (0.85, "alias")}
    assert [(m.column, m.how, round(m.confidence, 4)) for m in columns.candidates("Vimentin", ["Vimentn"], {})] == [("Vimentn", "fuzzy", round(0.7 * 14 / 15, 4))]


def test_missing_channels(spark):
    path = new_path(spark, "t")
    spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.0)], "Start_push int, X double, Y double, `CD45(Sm152Di)` double, `DNA1(Ir191Di)` double").write.option("sep", "\t").option("header", True).csv(path)
    got = files.pixel_table(spark, path, ["cd45", "cd31"], ["dna1"])
    assert got.columns == ["x", "y", "push", "cd45", "dna1"] and got.first()["cd45"] == 4.0
    with pytest.raises(ValueError):
        files.pixel_table(spark, path, ["cd45"], ["dna1", "dna2"])


def test_bad_documents_are_passed_over(spark):
    path = new_path(spark, "t")
    good = '{"roi_id": "a", "multiscale_results": {"10.0": {"cluster_labels": {"data": [0, 1]}, "spatial_coords": {"shape": [2, 2], "data": [1, 2, 3, 4]}, "transformed_arrays": {"m": {"data": [5]}}}}}'
    spark.createDataFrame([(good,), ("{ no json",), ("",)], "value string").write.text(path)
    docs = files.documents(spark, path)
    assert [tuple(r)[3:] for r in files.unit_rows(docs, ["m", "none"]).collect()] == [(0, 1.0, 2.0, 0, 5.0, None), (1, 3.0, 4.0, 1, None, None)]
    assert files.document_faults(docs).first().asDict() == {"roi_id": "a", "missing_scales": 2, "short_arrays": 1, "negative_values": 0, "negative_places": 0, "gaps_in_labels": 0}


def test_names_without_metadata(spark):
    names = ["roi_IMC_1_A_ROI_Sam1_01_2", "roi_IMC_1_A_ROI_D1_M1_01_9", "IMC_1_A_ROI_Test01", "Patient1"]
    none = spark.createDataFrame([], "file_name string, day int, mouse string, region string")
    got = {r["name"]: (r["timepoint"], r["mouse"], r["region"], r["replicate"]) for r in files.with_metadata(spark.createDataFrame([(n,) for n in names], "name string"), none).collect()}
    assert got == {names[0]: ("Sham", None, None, "Sam1"), names[1]: ("D1", "M1", None, "D1_M1_01"), names[2]: ("Test", None, None, "Test01"), names[3]: ("Unknown", None, None, "Patient1")}


def test_keys_must_be_unique(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    with pytest.raises(ValueError):
        files.one_to_one(a, b, ["k"])


def test_a_reference_of_other_settings_is_refused(spark):
    path = new_path(spark, "t")
    entries = F.create_map(F.lit("m"), F.struct(F.lit(1.0).alias("threshold"), F.lit(2.0).alias("scale")))
    spark.range(1).select(F.lit(10.0).alias("scale_um"), F.array(F.lit("m")).alias("markers"), F.lit("x").alias("config_sha256"), F.lit(60.0).alias("percentile"), F.lit("per_mouse").alias("aggregation"), entries.alias("entries")).write.json(path)
    assert files.reference_artefact(spark, path, 10.0, ["m"], "x", 60.0, "per_mouse").first()["threshold"] == 1.0
    for wrong in ((20.0, ["m"], "x", 60.0), (10.0, ["m", "n"], "x", 60.0), (10.0, ["m"], "y", 60.0), (10.0, ["m"], "x", 50.0)):
        with pytest.raises(ValueError):
            files.reference_artefact(spark, path, *wrong, "per_mouse")


def test_regions_are_replaced_one_by_one(spark):
    path = new_path(spark, "t")
    sinks.save_features(spark.createDataFrame([(1, 5.0), (2, 6.0)], "roi_id int, v double"), path)
    sinks.save_features(spark.createDataFrame([(2, 7.0)], "roi_id int, v double"), path)
    assert sorted((r["roi_id"], r["v"]) for r in files.features(spark, path).collect()) == [(1, 5.0), (2, 7.0)]
    assert [r["v"] for r in files.features(spark, path, [1]).collect()] == [5.0]
    assert sinks.storage_summary(spark, path).filter("file LIKE '%.parquet'").count() == 2
    assert sinks.set_aside(spark, path, path + "-old") and not sinks.set_aside(spark, path, path + "-older")
    assert files.features(spark, path + "-old").count() == 2


def test_percentiles_by_bins(spark):
    """As F.percentile: ties, nulls, one number, one row, outliers that crowd the rest in one bin, numbers that are not finite."""
    from pyspark.sql import functions as F

    from quadrille.operators import thresholds

    rows = [("spread", float(i * 7919 % 1009) / 7, float(i % 3)) for i in range(1009)] + [("crowd", 1e12 if i < 3 else i / 1000, None if i % 2 else 5.0) for i in range(400)]
    rows += [("one", 3.5, -2.0)] + [("odd", v, 0.0) for v in (float("inf"), float("-inf"), float("nan"), 1.0, 2.0, 2.0)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r["k"], r["value"]): r["t"] for r in thresholds.percentiles(df, ["k"], ["a", "b"], shares).collect()}
    want = df.groupBy("k").agg(*(F.percentile(v, F.array(*map(F.lit, shares))).alias(v) for v in "ab")).collect()
    assert repr(sorted(got.items())) == repr(sorted(((r["k"], v), r[v]) for r in want for v in "ab" if r[v] is not None))
