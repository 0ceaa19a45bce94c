"""Labels of units: boolean gates, continuous memberships, composite and interface labels.

All are projections: a unit's label follows from its own row and a few thresholds.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The panel's gates in order of priority, by what is positive; every other marker is negative.
GATES = {
    "neutrophil": ["cd45", "ly6g"],
    "activated_m2_cd44": ["cd45", "cd11b", "cd206", "cd44"],
    "activated_m2_cd140b": ["cd45", "cd11b", "cd206", "cd140b"],
    "m2_macrophage": ["cd45", "cd11b", "cd206"],
    "activated_myeloid_cd44": ["cd45", "cd11b", "cd44"],
    "activated_myeloid_cd140b": ["cd45", "cd11b", "cd140b"],
    "myeloid": ["cd45", "cd11b"],
    "activated_immune": ["cd45", "cd44", "cd140b"],
    "immune_cells": ["cd45"],
    "activated_endothelial_cd44": ["cd31", "cd34", "cd44"],
    "activated_endothelial_cd140b": ["cd31", "cd34", "cd140b"],
    "endothelial": ["cd31", "cd34"],
    "activated_fibroblast_cd44": ["cd140a", "cd44"],
    "activated_fibroblast_cd140b": ["cd140a", "cd140b"],
    "fibroblast": ["cd140a"],
}
# The one gate that leaves the other markers free; percentiles of positivity; lineages, subtypes and activation by markers; steepness and least scores.
NEGATIVES = {"neutrophil": ["cd31", "cd34"]}
POSITIVITY = {"percentile": 60.0, "cd206": 50.0, "ly6g": 70.0}
LINEAGES = {"immune": ("max", ["cd45"]), "endothelial": ("mean", ["cd31", "cd34"]), "stromal": ("max", ["cd140a"])}
SUBTYPES = {
    "neutrophil": ("immune", ["ly6g"], []),
    "m2_macrophage": ("immune", ["cd11b", "cd206"], []),
    "myeloid": ("immune", ["cd11b"], ["cd206", "ly6g"]),
    "non_myeloid_immune": ("immune", [], ["cd11b", "ly6g"]),
}
ACTIVATION = {"cd140b": "cd140b", "cd44": "cd44"}
STEEPNESS, LINEAGE_LEAST, SUBTYPE_LEAST, ACTIVATION_LEAST, DOMINANCE = 10.0, 0.3, 0.3, 0.3, 2.0


def positivity(df: DataFrame, keys: list[str], markers: list[str], percentiles: dict[str, float]) -> DataFrame:
    """Adds p_<marker>: value above the percentile of its own group (region)."""
    cut = df.groupBy(*keys).agg(*(F.percentile(m, F.lit(percentiles.get(m, percentiles["percentile"]) / 100)).alias(f"t_{m}") for m in markers))
    return df.join(cut, keys).withColumns({f"p_{m}": F.col(m) > F.col(f"t_{m}") for m in markers}).drop(*(f"t_{m}" for m in markers))


def gate(positive: list[str], negative: list[str]) -> Column:
    return reduce(and_, [F.col(f"p_{m}") for m in positive] + [~F.col(f"p_{m}") for m in negative])


def annotate(df: DataFrame, markers: list[str], gates: dict[str, list[str]] = GATES, negatives: dict[str, list[str]] = NEGATIVES) -> DataFrame:
    """Adds cell_type (the first gate that holds, else unassigned) and confidence (one over how many hold, else 0)."""
    tests = {name: gate(pos, negatives.get(name, [m for m in markers if m not in pos])) for name, pos in gates.items()}
    n = reduce(add, (t.cast("int") for t in tests.values()))
    label = reduce(lambda c, item: c.when(item[1], item[0]), list(tests.items())[1:], F.when(*reversed(next(iter(tests.items()))))).otherwise("unassigned")
    return df.withColumns({"cell_type": label, "confidence": F.when(n > 0, 1.0 / n).otherwise(0.0)})


def sigmoids(df: DataFrame, reference: DataFrame, markers: list[str], steepness: float = STEEPNESS) -> DataFrame:
    """Adds s_<marker> in 0..1: logistic around the reference's threshold, as steep as its scale is narrow."""
    row = reference.groupBy().agg(*(F.max(F.when(F.col("marker") == m, F.struct("threshold", "scale"))).alias(f"r_{m}") for m in markers))
    z = lambda m: F.greatest(F.least(steepness / F.greatest(F.col(f"r_{m}.scale"), F.lit(1e-6)) * (F.col(m) - F.col(f"r_{m}.threshold")), F.lit(500.0)), F.lit(-500.0))
    return df.join(F.broadcast(row)).withColumns({f"s_{m}": 1 / (1 + F.exp(-z(m))) for m in markers}).drop(*(f"r_{m}" for m in markers))


def first_largest(scores: dict[str, Column], otherwise: str, least: float = 0.0) -> Column:
    """The first name with the largest score; `otherwise` if that is not above least."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    label = F.when(top <= least, otherwise)
    for name, score in scores.items():
        label = label.when(score == top, name)
    return label.otherwise(otherwise)


def memberships(df: DataFrame, digits: int = 9) -> DataFrame:
    """Adds lineage_*, subtype and activation_* from s_<marker>; scores rounded so that comparisons are stable."""
    merged = {"max": lambda c: F.greatest(*c) if len(c) > 1 else c[0], "min": lambda c: F.least(*c) if len(c) > 1 else c[0], "mean": lambda c: reduce(add, c) / len(c)}
    out = df.withColumns({f"lineage_{n}": F.round(merged[how]([F.col(f"s_{m}") for m in ms]), digits) for n, (how, ms) in LINEAGES.items()})
    scores = {}
    for name, (parent, pos, neg) in SUBTYPES.items():
        factors = [F.col(f"s_{m}") for m in pos] + [1 - F.col(f"s_{m}") for m in neg]
        made = F.pow(reduce(lambda a, b: a * b, factors), F.lit(1.0 / len(factors)))
        scores[name] = F.round(F.when(F.col(f"lineage_{parent}") >= SUBTYPE_LEAST, made).otherwise(0.0), digits)
    out = out.withColumns({f"_sub_{n}": s for n, s in scores.items()})
    subtype = first_largest({n: F.col(f"_sub_{n}") for n in scores}, "none")
    return out.withColumns({"subtype": subtype, **{f"activation_{a}": F.round(F.col(f"s_{m}"), digits) for a, m in ACTIVATION.items()}}).drop(*(f"_sub_{n}" for n in scores))


def composite_label(lineages: dict[str, Column], subtype: Column, activation: dict[str, Column]) -> Column:
    """c:unassigned, c:mixed, or c:[activated_]<subtype or lineage>[_activations]."""
    ranked = F.sort_array(F.array(*lineages.values()), asc=False)
    top, second = ranked[0], ranked[1]
    base = F.when(subtype != "none", subtype).otherwise(first_largest(lineages, "none", -1.0))
    active = F.concat_ws("_", *(F.when(activation[a] >= ACTIVATION_LEAST, a) for a in sorted(activation)))
    named = F.when(active != "", F.concat(F.lit("c:activated_"), base, F.lit("_"), active)).otherwise(F.concat(F.lit("c:"), base))
    return F.when(top < LINEAGE_LEAST, "c:unassigned").when((second >= LINEAGE_LEAST) & (top < DOMINANCE * second), "c:mixed").otherwise(named)


def interface(scores: dict[str, Column], least: float = LINEAGE_LEAST, strict: bool = True) -> Column:
    """The names, sorted and joined by +, whose score is above (not strict: at or above) the threshold; none if no one is."""
    above = (lambda s: s > least) if strict else (lambda s: s >= least)
    joined = F.concat_ws("+", *(F.when(above(scores[n]), n) for n in sorted(scores)))
    return F.when(joined == "", "none").otherwise(joined)


INTERFACES = ["immune", "endothelial", "stromal", "endothelial+immune", "immune+stromal", "endothelial+stromal", "endothelial+immune+stromal", "none"]


def lineage_count_shares(df: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Percent of each key's units with 0, 1, 2 and 3 lineages above the threshold."""
    n = reduce(add, ((F.col(f"lineage_{x}") > least).cast("int") for x in LINEAGES))
    return df.groupBy(*keys).agg(*(F.avg(F.when(n == k, 100.0).otherwise(0.0)).alias(f"pct_{k}") for k in range(4)))


def cluster_enrichment(df: DataFrame, cluster: str, markers: list[str], gates: dict[str, list[str]] = GATES, least_ratio: float = 1.5, least_score: float = 0.3) -> DataFrame:
    """(cluster, cell_type, score): the gate that most of its markers speak for, by ratio of cluster mean to overall mean; the first of equals."""
    overall = df.agg(*(F.avg(m).alias(f"g_{m}") for m in markers))
    means = df.groupBy(cluster).agg(*(F.avg(m).alias(m) for m in markers)).join(F.broadcast(overall))
    ratio = lambda m: F.col(m) / F.when(F.col(f"g_{m}") != 0, F.col(f"g_{m}"))
    scored = []
    for i, (name, pos) in enumerate(gates.items()):
        neg = NEGATIVES.get(name, [m for m in markers if m not in pos])
        votes = [(ratio(m) >= least_ratio).cast("int") for m in pos] + [(ratio(m) < 1 / least_ratio).cast("int") for m in neg]
        scored.append(F.struct(F.coalesce(F.round(reduce(add, votes) / len(votes), 9), F.lit(0.0)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return means.select(cluster, F.when(best["score"] >= least_score, best["name"]).otherwise("unassigned").alias("cell_type"), best["score"].alias("score"))
