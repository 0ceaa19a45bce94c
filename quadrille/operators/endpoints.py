"""Endpoint families: flags of sweeps, headline rules, demotion, the summary over all families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least size of a headline effect, and limits of disagreement between bases.
HEADLINE, COLLAPSE, DISAGREE = 0.5, 0.2, 0.5
# Lineage that a cell type stands for; types not named stand for none.
LINEAGE_OF = {
    "endothelial": "endothelial", "activated_endothelial_cd44": "endothelial", "activated_endothelial_cd140b": "endothelial", "immune_cells": "immune", "activated_immune": "immune",
    "fibroblast": "stromal", "activated_fibroblast_cd44": "stromal", "activated_fibroblast_cd140b": "stromal",
}
DEMOTED = "cross_axis_co_headline_forbidden"


def as_lineage(label: Column) -> Column:
    return reduce(lambda c, item: c.when(label == item[0], item[1]), LINEAGE_OF.items(), F.when(F.lit(False), ""))


def sign_flips(rows: DataFrame, keys: list[str], value: str = "hedges_g") -> DataFrame:
    """(keys, threshold_sensitive): whether the signs of a sweep's values differ; nulls say nothing."""
    return rows.groupBy(*keys).agg((F.count_distinct(F.signum(value)) > 1).alias("threshold_sensitive"))


def basis_flags(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """first with what another normalisation says: its g, whether the sign turns, the effect collapses or its size disagrees."""
    other = second.select(*keys, F.col("hedges_g").alias("g_other"))
    g, o = F.col("hedges_g"), F.col("g_other")
    both = g.isNotNull() & o.isNotNull()
    most = F.greatest(F.abs(g), F.abs(o))
    return first.join(other, keys, "left").withColumns({
        "sign_reverse": F.coalesce((F.signum(g) != F.signum(o)) & both, F.lit(False)), "g_collapse": F.coalesce((F.abs(g) > HEADLINE) & (F.abs(o) < COLLAPSE * F.abs(g)), F.lit(False)),
        "magnitude_disagree": F.coalesce((most > HEADLINE) & (F.abs(g - o) / F.when(most > 0, most).otherwise(1.0) > DISAGREE) & both, F.lit(False)),
    })


def divergence(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, g_first, g_second, status, sign_agree): which of two bases clears the headline, over the endpoints of either."""
    side = lambda d, n: d.select(*keys, F.col("g_shrunk_neutral").alias(f"g_{n}"), (F.coalesce(F.abs("g_shrunk_neutral") > HEADLINE, F.lit(False)) & ~F.coalesce("g_pathological", F.lit(False))).alias(f"above_{n}"))
    m = side(first, "first").join(side(second, "second"), keys, "full_outer").na.fill(False, ["above_first", "above_second"])
    status = F.when(F.col("above_first") & F.col("above_second"), "both_above").when(F.col("above_first"), "first_only").when(F.col("above_second"), "second_only").otherwise("both_below")
    vacuous = F.col("g_first").isNull() | F.col("g_second").isNull() | (F.col("g_first") == 0) | (F.col("g_second") == 0)
    return m.select(*keys, "g_first", "g_second", status.alias("status"), F.when(vacuous, True).otherwise((F.col("g_first") > 0) == (F.col("g_second") > 0)).alias("sign_agree"))


def rule_pass() -> Column:
    """Whether a row of the summary passes its family's rule; a flag that is not known counts as not raised."""
    raised = lambda c: F.coalesce(F.col(c), F.lit(False))
    large = lambda c: F.coalesce(F.abs(c) > HEADLINE, F.lit(False))
    sound = ~raised("g_pathological")
    return F.when(F.col("family") == "A", large("hedges_g") & sound & ~raised("magnitude_disagree")).when(F.col("family") == "B", large("g_shrunk_neutral") & sound & ~raised("support_sensitive")).otherwise(large("g_shrunk_neutral") & sound)


def summary(families: list[DataFrame], flips: DataFrame) -> DataFrame:
    """All families in one table, with sweeps' flips, rules, demotion and headline.

    families: (family, axis, endpoint, label, g1, g2, hedges_g, g_shrunk_neutral, g_pathological) and flags some of them have.
    A row of the second axis is demoted if one of the first passes for the same event: in A for the lineage that its type stands for,
    in B for the same score and its label or the lineage that stands for.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)
    rows = rows.join(flips, ["family", "endpoint", "g1", "g2"], "left").na.fill(False, ["threshold_sensitive"]).withColumn("rule_pass", rule_pass())
    stripped = F.regexp_replace("label", "^c:", "")
    winners = rows.filter((F.col("axis") == "first") & F.col("rule_pass")).select("family", F.when(F.col("family") == "A", F.lit("-")).otherwise(F.col("endpoint")).alias("_e"), F.when(F.col("family") == "A", F.col("endpoint")).otherwise(stripped).alias("_l"), "g1", "g2").distinct().withColumn("_won", F.lit(True))
    event = rows.withColumn("_e", F.when(F.col("family") == "A", F.lit("-")).otherwise(F.col("endpoint"))).withColumn("_name", F.when(F.col("family") == "A", F.col("endpoint")).otherwise(F.col("label")))
    own = winners.withColumnsRenamed({"_l": "_name", "_won": "_own"}).filter("family = 'B'")
    mapped = winners.withColumnsRenamed({"_l": "_mapped", "_won": "_map"})
    both = event.withColumn("_mapped", as_lineage(F.col("_name"))).join(own, ["family", "_e", "_name", "g1", "g2"], "left").join(mapped, ["family", "_e", "_mapped", "g1", "g2"], "left")
    clash = (F.col("axis") == "second") & F.col("rule_pass") & (F.coalesce("_own", F.lit(False)) | F.coalesce("_map", F.lit(False)))
    return both.withColumn("demoted_reason", F.when(clash, DEMOTED)).withColumn("is_headline", F.col("rule_pass") & F.col("demoted_reason").isNull()).drop("_e", "_name", "_mapped", "_own", "_map")
