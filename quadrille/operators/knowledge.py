"""Evidence lookups in a small graph of statements, and dataset fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_summary(statements: DataFrame) -> DataFrame:
    """(a, b, evidence, belief, types) of each undirected pair. statements: (source, target, type, evidence, belief)."""
    return statements.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(
        F.sum("evidence").alias("evidence"), F.max("belief").alias("belief"), F.concat_ws("|", F.array_sort(F.collect_set("type"))).alias("types")
    )


def tier(evidence: Column, belief: Column) -> Column:
    return F.when(evidence >= 100, "high").when((evidence >= 10) | ((evidence >= 5) & (belief >= 0.7)), "medium").when(evidence >= 1, "low").otherwise("none")


def best_evidence(pairs: DataFrame, keys: list[str], members_a: str, members_b: str, summary: DataFrame) -> DataFrame:
    """For each row's two lists of members: the largest evidence and belief over all pairs of different members."""
    each = pairs.select(*keys, F.explode(members_a).alias("_a"), F.col(members_b).alias("_bs")).select(*keys, "_a", F.explode("_bs").alias("_b")).filter("_a <> _b")
    found = each.select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct().join(summary, ["a", "b"], "left")
    out = found.groupBy(*keys).agg(F.coalesce(F.max("evidence"), F.lit(0)).alias("evidence"), F.coalesce(F.max("belief"), F.lit(0.0)).alias("belief"), F.count("evidence").alias("n_pairs_known"))
    return out.withColumn("tier", tier(F.col("evidence"), F.col("belief")))


def table_digest(rows: DataFrame, text: Column) -> DataFrame:
    """(digest) of a dimension table: SHA-256 over its rows' digests in order. For tables whose digests fit one task, as a manifest's do."""
    return rows.select(F.sha2(text.cast("binary"), 256).alias("d")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "").cast("binary"), 256).alias("digest"))


def fingerprint(files: DataFrame, name: str, digest: str) -> DataFrame:
    """(sha256): one digest over the sorted name:digest lines of all files."""
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", name, digest))), "|"), 256).alias("sha256"))


def manifest_diff(old: DataFrame, new: DataFrame, name: str, digest: str) -> DataFrame:
    """(name, change): added, removed or changed; unchanged entries are left out."""
    both = old.select(name, F.col(digest).alias("_o")).join(new.select(name, F.col(digest).alias("_n")), name, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed")
    return both.select(name, change.alias("change")).filter("change IS NOT NULL")


def lineage_of(cell_type: Column, markers: Column) -> Column:
    """The lineage of a type: by the family in its name, else by its markers, else unknown."""
    named = F.when(cell_type.contains("endothelial"), "endothelial").when(cell_type.contains("fibroblast"), "stromal")
    return named.when(F.array_contains(markers, "cd45"), "immune").otherwise("unknown")
