"""Plans of abundance and activation: effects of types, lineages and regions; rates by compartment, region and scale; sensitivity tables."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.folders import staged
from quadrille.operators import batches, binning, composition, effects, gating, neighbours, statistics, thresholds
from quadrille.plans.common import LONG_SQL, SCORED_SQL, query, r6, reference, rounded, scored, scored_sql, units, with_interface
from quadrille.plans.contrasts import _BEADS, _PAIRS, _beads
from quadrille.plans.endpoints import _A2, _TYPES, effects_sql
from quadrille.plans.space import _ENRICH, cell_enrichment, kept, knn, knn_sql
from quadrille.plans.units import GATED_SQL, gated
from quadrille.sources import virtual
from quadrille.sources.virtual import BASE_SQL, CONTROL, MARKERS

M = ", ".join(MARKERS)
SCALES = (10, 20, 40)
_SCORE = ("lineage_immune", "lineage_endothelial", "lineage_stromal")


def _p_sql(source: str, value: str, key: str) -> str:
    """CTEs ending in pp: Mann-Whitney U and exact p of groups of two."""
    return f"""pl_ AS (SELECT {key}, timepoint, list({value} ORDER BY {value}) AS v FROM {source} GROUP BY ALL), pu AS (SELECT a.{key}, g1, g2, a.v AS a, b.v AS b FROM con JOIN pl_ a ON a.timepoint = g1 JOIN pl_ b ON b.timepoint = g2 AND a.{key} = b.{key}),
pw AS (SELECT {key}, g1, g2, len(a) AS n1, len(b) AS n2, list_sum(list_transform(a, lambda x: list_sum(list_transform(b, lambda y: CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0.0 END)))) AS u FROM pu),
pp AS (SELECT {key}, g1, g2, u, sum(CASE WHEN abs(2 * ku - 4) >= abs(2 * u - 4) THEN ways ELSE 0 END) / 6 AS p FROM pw, (SELECT unnest([0, 1, 2, 3, 4]) AS ku, unnest([1, 1, 2, 1, 1]) AS ways) WHERE n1 = 2 AND n2 = 2 GROUP BY ALL)"""


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timepoint, mouse, category, fraction, clr): cell types by subject, log-ratios with a small amount added. Test regions and subjects without a name are left out."""
    df = gated(spark, sf_dir).filter("timepoint <> 'Test' AND mouse IS NOT NULL")
    fr = composition.fractions(df, ["roi", "timepoint", "mouse"], "cell_type", _TYPES)
    mice = composition.to_subjects(fr, ["timepoint", "mouse", "category"])
    w = Window.partitionBy("timepoint", "mouse")
    return staged(mice.withColumn("clr", F.log(F.col("fraction") + 1e-6) - F.avg(F.log(F.col("fraction") + 1e-6)).over(w)), "abundance")


_AB = f"""{_A2}, ab AS MATERIALIZED (SELECT timepoint, mouse, category, fraction, ln(fraction + 1e-6) - avg(ln(fraction + 1e-6)) OVER (PARTITION BY timepoint, mouse) AS clr FROM km), {_PAIRS}, {effects_sql('ab', 'fraction', ['category'])}, {effects_sql('ab', 'clr', ['category'], 'ec')}, {_p_sql('ab', 'fraction', 'category')},
aq AS (SELECT *, row_number() OVER (ORDER BY round(p, 6), category, g1, g2) AS r, count(*) OVER () AS k FROM pp), ar AS (SELECT *, least(min(round(p, 6) * k / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q FROM aq),
abe AS MATERIALIZED (SELECT e2.category, g1, g2, e2.n1, e2.n2, e2.m1, e2.m2, sqrt(e2.v1) AS s1, sqrt(e2.v2) AS s2, (e2.m2 + 1e-6) / (e2.m1 + 1e-6) AS fc, u, p, q, -e2.g AS g, -ec.g AS g_clr FROM e2 JOIN ec USING (category, g1, g2) LEFT JOIN ar USING (category, g1, g2))"""


def _abundance_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of the first group over the second: the sign is that of m1 - m2."""
    df, con, key = _subjects(spark, sf_dir), effects.contrast_table(spark), ["category", "g1", "g2"]
    made = effects.effect_sizes(df, ["category"], "timepoint", "fraction", con).select(*key, "n1", "n2", "m1", "m2", (-F.col("hedges_g")).alias("hedges_g"))
    clr = effects.effect_sizes(df, ["category"], "timepoint", "clr", con).select(*key, (-F.col("hedges_g")).alias("hedges_g_clr"))
    sd = df.groupBy("category", "timepoint").agg(F.stddev_samp("fraction").alias("s"))
    tests = effects.rank_sums(df, ["category"], "timepoint", "fraction", con).select(*key, "u", F.round("p", 6).alias("p"))
    tests = effects.adjusted(tests.withColumn("_f", F.lit(1)), ["_f"], "p", key).drop("_f")
    fold = (F.col("m2") + 1e-6) / (F.col("m1") + 1e-6)
    out = made.join(clr, key).join(tests, key, "left").join(sd.select("category", F.col("timepoint").alias("g1"), F.col("s").alias("s1")), ["category", "g1"]).join(sd.select("category", F.col("timepoint").alias("g2"), F.col("s").alias("s2")), ["category", "g2"])
    return out.withColumns({"fold_change": fold, "log2_fc": F.log2(fold), "significant": F.coalesce(F.col("q") < 0.05, F.lit(False))})


@query(f"""WITH {_AB} SELECT category, g1, g2, n1, n2, {', '.join(r6(c, c) for c in ('m1', 'm2', 's1', 's2'))}, round(fc, 6) AS fold_change, round(log2(fc), 6) AS log2_fc, round(u, 6) AS u, round(p, 6) AS p, round(q, 6) AS q, round(g, 6) AS hedges_g, round(g_clr, 6) AS hedges_g_clr, coalesce(q < 0.05, false) AS significant FROM abe""")
def abundance_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_abundance_effects(spark, sf_dir))


@query(f"""WITH {_AB}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY abs(round(g, 6)) DESC NULLS LAST, g1, g2) AS i FROM abe) SELECT category, CASE WHEN g IS NOT NULL THEN g1 END AS g1, CASE WHEN g IS NOT NULL THEN g2 END AS g2, round(g, 6) AS hedges_g FROM r WHERE i = 1""")
def largest_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contrast with the largest effect of each type; types without any effect are kept."""
    made = rounded(_abundance_effects(spark, sf_dir).select("category", "g1", "g2", "hedges_g"))
    top = effects.top_by_size(made, ["category"], "hedges_g", ["g1", "g2"], 1).drop("place")
    return top.withColumns({c: F.when(F.col("hedges_g").isNotNull(), F.col(c)) for c in ("g1", "g2")})


@query(f"""WITH {_AB}, r AS (SELECT category, g1, g2, round(g, 6) AS g FROM abe ORDER BY abs(round(g, 6)) DESC NULLS LAST, category, g1, g2 LIMIT 10) SELECT category, g1, g2, g AS hedges_g FROM r""")
def strongest_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest effects of all."""
    made = rounded(_abundance_effects(spark, sf_dir).select("category", "g1", "g2", "hedges_g"))
    return made.orderBy(F.abs("hedges_g").desc_nulls_last(), "category", "g1", "g2").limit(10)


_CONS = [f"{a}_{b}" for a, b in effects.CONTRASTS]


@query(f"""WITH {_AB} SELECT category, {', '.join(f"round(max(g) FILTER (g1 || '_' || g2 = '{c}'), 6) AS {c}" for c in _CONS)} FROM abe GROUP BY category""")
def effect_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _abundance_effects(spark, sf_dir).select("category", F.concat_ws("_", "g1", "g2").alias("c"), "hedges_g")
    return rounded(made.groupBy("category").pivot("c", _CONS).agg(F.max("hedges_g")))


_LM = f"""{SCORED_SQL}, lr AS (SELECT roi, timepoint, mouse, {', '.join(f'avg({s}) AS {s}' for s in _SCORE)} FROM scored GROUP BY ALL), lm AS (SELECT timepoint, mouse, {', '.join(f'avg({s}) AS {s}' for s in _SCORE)} FROM lr GROUP BY ALL), lx AS MATERIALIZED (SELECT timepoint, mouse, feature, v FROM (UNPIVOT lm ON {', '.join(_SCORE)} INTO NAME feature VALUE v))"""


@query(f"""WITH {_LM}, {_PAIRS}, {effects_sql('lx', 'v', ['feature'])}, {_p_sql('lx', 'v', 'feature')} SELECT feature, g1, g2, n1, n2, {', '.join(r6(c, c) for c in ('m1', 'm2'))}, round(u, 6) AS u, round(p, 6) AS p, round(-g, 6) AS hedges_g FROM e2 LEFT JOIN pp USING (feature, g1, g2)""")
def lineage_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = scored(spark, sf_dir).groupBy("roi", "timepoint", "mouse").agg(*(F.avg(s).alias(s) for s in _SCORE))
    mice = staged(per.groupBy("timepoint", "mouse").agg(*(F.avg(s).alias(s) for s in _SCORE)).unpivot(["timepoint", "mouse"], list(_SCORE), "feature", "v"), "lineages")
    con, key = effects.contrast_table(spark), ["feature", "g1", "g2"]
    made = effects.effect_sizes(mice, ["feature"], "timepoint", "v", con).select(*key, "n1", "n2", "m1", "m2", (-F.col("hedges_g")).alias("hedges_g"))
    return rounded(made.join(effects.rank_sums(mice, ["feature"], "timepoint", "v", con).select(*key, "u", "p"), key, "left"))


@query(f"""WITH {GATED_SQL}, c AS (SELECT roi, timepoint, mouse, region, count(*) AS t FROM labelled GROUP BY ALL), k AS (SELECT roi, cell_type, count(*) AS n FROM labelled GROUP BY ALL), f AS (SELECT c.*, category, coalesce(n, 0) / t AS f FROM c CROSS JOIN (SELECT unnest([{', '.join(f"'{t}'" for t in _TYPES)}]) AS category) v LEFT JOIN k ON k.roi = c.roi AND k.cell_type = category),
m AS MATERIALIZED (SELECT timepoint, mouse, region, category, avg(f) AS v FROM f GROUP BY ALL), s AS (SELECT timepoint, category, region, count(v) AS n, avg(v) AS m, var_samp(v) AS q FROM m GROUP BY ALL)
SELECT a.timepoint, a.category, a.n AS n1, b.n AS n2, round(a.m, 6) AS m1, round(b.m, 6) AS m2, round(CASE WHEN a.n >= 2 AND b.n >= 2 AND ((a.n - 1) * a.q + (b.n - 1) * b.q) / (a.n + b.n - 2) > 1e-24 THEN (a.m - b.m) / sqrt(((a.n - 1) * a.q + (b.n - 1) * b.q) / (a.n + b.n - 2)) * (1 - 3 / (4.0 * (a.n + b.n - 2) - 1)) END, 6) AS hedges_g
FROM s a JOIN s b ON a.timepoint = b.timepoint AND a.category = b.category AND a.region = 'Cortex' AND b.region = 'Medulla' WHERE a.timepoint <> 'Sham'""")
def regional_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = composition.fractions(gated(spark, sf_dir), ["roi", "timepoint", "mouse", "region"], "cell_type", _TYPES).filter(F.col("timepoint") != CONTROL)
    mice = composition.to_subjects(fr, ["timepoint", "mouse", "region", "category"])
    made = effects.effect_sizes(mice, ["timepoint", "category"], "region", "fraction", effects.contrast_table(spark, [("Cortex", "Medulla")]))
    return rounded(made.select("timepoint", "category", "n1", "n2", "m1", "m2", (-F.col("hedges_g")).alias("hedges_g")))


_RULES = ("bayes", "small", "tiny")


@query(f"""WITH {_A2}, r AS (SELECT timepoint, mouse, category, (fraction * n_total + 0.5) / (n_total + count(*) OVER (PARTITION BY timepoint, mouse) * 0.5) AS bayes, fraction + 1e-6 AS small, fraction + 1e-9 AS tiny FROM km)
SELECT timepoint, mouse, category, {', '.join(f'round(ln({c}) - avg(ln({c})) OVER (PARTITION BY timepoint, mouse), 6) AS clr_{c}' for c in _RULES)} FROM r""")
def log_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred log-ratios of cell types under the three rules for zeros."""
    fr = composition.fractions(gated(spark, sf_dir), ["roi", "timepoint", "mouse"], "cell_type", _TYPES)
    keys = ["timepoint", "mouse"]
    mice = composition.replace_zeros(composition.to_subjects(fr, [*keys, "category"]), keys).withColumns({"small": F.col("fraction") + 1e-6, "tiny": F.col("fraction") + 1e-9})
    out = mice
    for value, name in (("replaced", "clr_bayes"), ("small", "clr_small"), ("tiny", "clr_tiny")):
        out = composition.clr(out, keys, value, name)
    return rounded(out.select(*keys, "category", "clr_bayes", "clr_small", "clr_tiny"))


@query(f"""WITH {SCORED_SQL}, c AS (SELECT roi, timepoint, mouse, interface AS category, count(*) AS n FROM scored GROUP BY ALL), t AS (SELECT roi, timepoint, mouse, sum(n) AS t FROM c GROUP BY ALL), f AS (SELECT t.timepoint, t.mouse, v.category, coalesce(n, 0) / t AS f FROM t CROSS JOIN (SELECT unnest([{', '.join(f"'{x}'" for x in gating.INTERFACES)}]) AS category) v LEFT JOIN c ON c.roi = t.roi AND c.category = v.category),
m AS (SELECT timepoint, mouse, category, avg(f) AS raw FROM f GROUP BY ALL), w AS (SELECT *, ln(raw + 1e-9) - avg(ln(raw + 1e-9)) OVER (PARTITION BY timepoint, mouse) AS clr FROM m), x AS MATERIALIZED (SELECT timepoint, mouse, category, metric, v FROM (UNPIVOT w ON raw, clr INTO NAME metric VALUE v)), {_PAIRS}, {effects_sql('x', 'v', ['category', 'metric'])}
SELECT category, metric, g1, g2, n1, n2, round(m1, 6) AS m1, round(m2, 6) AS m2, round(-g, 6) AS hedges_g, bad AS g_pathological FROM e2""")
def composite_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = composition.fractions(with_interface(scored(spark, sf_dir)), ["roi", "timepoint", "mouse"], "interface", gating.INTERFACES)
    mice = composition.to_subjects(fr, ["timepoint", "mouse", "category"]).withColumns({"raw": F.col("fraction"), "_tiny": F.col("fraction") + 1e-9})
    long = composition.clr(mice, ["timepoint", "mouse"], "_tiny").unpivot(["timepoint", "mouse", "category"], ["raw", "clr"], "metric", "v")
    made = effects.effect_sizes(long, ["category", "metric"], "timepoint", "v", effects.contrast_table(spark))
    return rounded(made.select("category", "metric", "g1", "g2", "n1", "n2", "m1", "m2", (-F.col("hedges_g")).alias("hedges_g"), "g_pathological"))


@query()
def power_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects a group that each type's largest effect would need, by t test and by rank test, and what the design can detect.

    The sizes are solved for each of a few dozen effects by numeric integration, beyond SQL; a test holds them against known values.
    """
    from pyspark.sql.types import LongType

    solve = F.udf(lambda g: None if g is None else effects.n_for_t_test(g), LongType())
    rank = F.udf(lambda g: None if g is None else effects.n_for_rank_test(g), LongType())
    top = largest_effects(spark, sf_dir)
    g = F.col("hedges_g")
    return rounded(top.withColumns({"n_t_test": solve(g), "n_rank_test": rank(g), "n_normal": effects.n_required(g), "detectable": F.lit(effects.detectable(2))}))


# Activation inside compartments, by region and scale.


def _tidy_sql(scale: int) -> str:
    ms = ("cd45", "cd31", "cd140b", "cd34", "cd44")
    base = BASE_SQL.replace(virtual.superpixel_sql(), virtual.superpixel_sql(scale))
    inside = {"cd45": "ex.cd45 > t.cd45", "cd31": "ex.cd31 > t.cd31", "cd140b": "ex.cd140b > t.cd140b", "endothelial": "ex.cd31 > t.cd31 AND ex.cd34 > t.cd34", "background": "NOT (ex.cd45 > t.cd45 OR ex.cd31 > t.cd31 OR ex.cd140b > t.cd140b)", "triple": "ex.cd45 > t.cd45 AND ex.cd31 > t.cd31 AND ex.cd140b > t.cd140b"}
    rows = " UNION ALL ".join(f"SELECT roi, region, timepoint, mouse, '{c}' AS compartment, avg((ex.cd44 > t.cd44)::INT) AS rate, count(*) AS n FROM ex, t WHERE {cond} GROUP BY ALL" for c, cond in inside.items())
    return f"""SELECT {scale} AS scale_um, * FROM (WITH {base}, t AS (SELECT {', '.join(f'round(avg({m}), 9) AS {m}' for m in ms)} FROM (SELECT mouse, {', '.join(f'quantile_cont({m}, 0.75) AS {m}' for m in ms)} FROM ex WHERE timepoint = 'Sham' GROUP BY mouse)), r AS ({rows})
SELECT compartment, 'Pooled' AS region, timepoint, mouse, avg(rate) AS cd44_rate, sum(n)::BIGINT AS n_support FROM r GROUP BY compartment, timepoint, mouse UNION ALL SELECT compartment, region, timepoint, mouse, avg(rate), sum(n)::BIGINT FROM r GROUP BY compartment, region, timepoint, mouse)"""


_TIDY = "td AS MATERIALIZED (" + " UNION ALL ".join(_tidy_sql(s) for s in SCALES) + ")"


def _activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scale_um, compartment, region, timepoint, mouse, cd44_rate, n_support): means over regions' rates, both parts together and apart."""
    ms = ["cd45", "cd31", "cd140b", "cd34", "cd44"]
    out = None
    for scale in SCALES:
        df = units(spark, sf_dir, scale)
        cut = df.filter(F.col("timepoint") == CONTROL).groupBy("mouse").agg(*(F.percentile(m, F.lit(0.75)).alias(m) for m in ms)).agg(*(F.round(F.avg(m), 9).alias(f"t_{m}") for m in ms))
        rows = df.join(F.broadcast(cut)).select("roi", "region", "timepoint", "mouse", *((F.col(m) > F.col(f"t_{m}")).alias(m) for m in ms))
        c = {m: F.col(m) for m in ms}
        inside = {"cd45": c["cd45"], "cd31": c["cd31"], "cd140b": c["cd140b"], "endothelial": c["cd31"] & c["cd34"], "background": ~(c["cd45"] | c["cd31"] | c["cd140b"]), "triple": c["cd45"] & c["cd31"] & c["cd140b"]}
        named = F.explode(F.filter(F.array(*(F.when(cond, F.lit(n)) for n, cond in inside.items())), lambda x: x.isNotNull()))
        per = rows.select("roi", "region", "timepoint", "mouse", "cd44", named.alias("compartment")).groupBy("roi", "region", "timepoint", "mouse", "compartment").agg(F.avg(F.col("cd44").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
        sets = per.groupingSets([["compartment", "timepoint", "mouse"], ["compartment", "region", "timepoint", "mouse"]], "compartment", "region", "timepoint", "mouse").agg(F.avg("rate").alias("cd44_rate"), F.sum("n").alias("n_support"), F.grouping("region").alias("_g"))
        one = sets.select(F.lit(scale).alias("scale_um"), "compartment", F.when(F.col("_g") == 1, "Pooled").otherwise(F.col("region")).alias("region"), "timepoint", "mouse", "cd44_rate", "n_support")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_TIDY} SELECT scale_um, compartment, region, timepoint, mouse, round(cd44_rate, 6) AS cd44_rate, n_support FROM td")
def activation_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_activation(spark, sf_dir))


@query(f"""WITH {_TIDY}, d AS (SELECT compartment, region, scale_um, avg(cd44_rate) FILTER (timepoint = 'Sham') AS s, avg(cd44_rate) FILTER (timepoint = 'D7') AS e FROM td GROUP BY ALL), g AS (SELECT compartment, region, {', '.join(f'max(s) FILTER (scale_um = {x}) AS sham_{x}, max(e) FILTER (scale_um = {x}) AS d7_{x}, max(e - s) FILTER (scale_um = {x}) AS delta_{x}' for x in SCALES)}, count(e - s) AS n_present, count(DISTINCT sign(e - s)) FILTER (e - s <> 0) AS signs FROM d GROUP BY ALL)
SELECT compartment, region, {', '.join(f'round({c}_{x}, 6) AS {c}_{x}' for x in SCALES for c in ('sham', 'd7', 'delta'))}, n_present AS n_scales_present, CASE WHEN n_present < 3 THEN 'thins_out' WHEN signs <= 1 THEN 'scale_robust' ELSE 'scale_dependent' END AS scale_reading FROM g""")
def activation_across_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the change from control to the last time reads across scales: robust, dependent on the scale, or thinning out."""
    at = lambda t: F.avg(F.when(F.col("timepoint") == t, F.col("cd44_rate")))
    d = _activation(spark, sf_dir).groupBy("compartment", "region", "scale_um").agg(at("Sham").alias("sham"), at("D7").alias("d7")).withColumn("delta", F.col("d7") - F.col("sham"))
    wide = [F.max(F.when(F.col("scale_um") == s, F.col(c))).alias(f"{c}_{s}") for s in SCALES for c in ("sham", "d7", "delta")]
    g = d.groupBy("compartment", "region").agg(*wide, F.count("delta").alias("n_scales_present"), F.count_distinct(F.when(F.col("delta") != 0, F.signum("delta"))).alias("_signs"))
    reading = F.when(F.col("n_scales_present") < len(SCALES), "thins_out").when(F.col("_signs") <= 1, "scale_robust").otherwise("scale_dependent")
    return rounded(g.withColumn("scale_reading", reading).drop("_signs"))


_NEUTRO = f"""{GATED_SQL}, nt AS (SELECT round(avg(c), 9) AS c FROM (SELECT mouse, quantile_cont(cd44, 0.75) AS c FROM labelled WHERE timepoint = 'Sham' GROUP BY mouse)), r AS (SELECT roi, timepoint, mouse, avg((cd44 > c)::INT) FILTER (cell_type = 'neutrophil') AS rate, count(*) FILTER (cell_type = 'neutrophil') AS n FROM labelled, nt GROUP BY ALL)"""


@query(f"WITH {_NEUTRO} SELECT timepoint, mouse, round(avg(rate), 6) AS neutrophil_rate, count(rate) AS neutrophil_rate_n_rois, sum(n)::BIGINT AS n_neutrophil FROM r GROUP BY ALL")
def neutrophil_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gated(spark, sf_dir)
    cut = df.filter(F.col("timepoint") == CONTROL).groupBy("mouse").agg(F.percentile("cd44", F.lit(0.75)).alias("c")).agg(F.round(F.avg("c"), 9).alias("_c"))
    mine = F.col("cell_type") == "neutrophil"
    per = df.join(F.broadcast(cut)).groupBy("roi", "timepoint", "mouse").agg(F.avg(F.when(mine, (F.col("cd44") > F.col("_c")).cast("double"))).alias("rate"), F.count_if(mine).alias("n"))
    return rounded(per.groupBy("timepoint", "mouse").agg(F.avg("rate").alias("neutrophil_rate"), F.count("rate").alias("neutrophil_rate_n_rois"), F.sum("n").alias("n_neutrophil")))


def _pct_sql(scale: int) -> str:
    n = "(lineage_immune > 0.5)::INT + (lineage_endothelial > 0.5)::INT + (lineage_stromal > 0.5)::INT"
    return f"SELECT {scale} AS scale_um, * FROM (WITH {scored_sql(scale)} SELECT roi, timepoint, mouse, {', '.join(f'avg(CASE WHEN {n} = {k} THEN 100.0 ELSE 0 END) AS pct_{k}' for k in range(4))} FROM scored GROUP BY ALL)"


_PCT = "sc AS MATERIALIZED (" + " UNION ALL ".join(_pct_sql(s) for s in SCALES) + ")"


def _lineage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for s in SCALES:
        one = gating.lineage_count_shares(scored(spark, sf_dir, s), ["roi", "timepoint", "mouse"]).withColumn("scale_um", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_PCT} SELECT scale_um, roi, {', '.join(f'round(pct_{k}, 6) AS pct_{k}' for k in range(4))} FROM sc")
def lineage_shares_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lineage_shares(spark, sf_dir).drop("timepoint", "mouse"))


@query(f"WITH {_PCT}, m AS (SELECT scale_um, timepoint, mouse, {', '.join(f'avg(pct_{k}) AS pct_{k}' for k in range(4))} FROM sc GROUP BY ALL) SELECT scale_um, timepoint, {', '.join(f'round(avg(pct_{k}), 6) AS pct_{k}' for k in range(4))}, count(*) AS n_mice FROM m GROUP BY ALL")
def lineage_shares_by_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [f"pct_{k}" for k in range(4)]
    mice = _lineage_shares(spark, sf_dir).groupBy("scale_um", "timepoint", "mouse").agg(*(F.avg(c).alias(c) for c in cols))
    return rounded(mice.groupBy("scale_um", "timepoint").agg(*(F.avg(c).alias(c) for c in cols), F.count(F.lit(1)).alias("n_mice")))


# How markers may be assigned to lineages; the first is the panel's own.
VARIANTS = {
    "current": {"immune": (["cd45"], "max"), "endothelial": (["cd31", "cd34"], "mean"), "stromal": (["cd140a"], "max")},
    "myeloid": {"immune": (["cd45", "cd11b"], "max"), "endothelial": (["cd31", "cd34"], "mean"), "stromal": (["cd140a"], "max")},
    "vessel_max": {"immune": (["cd45"], "max"), "endothelial": (["cd31", "cd34"], "max"), "stromal": (["cd140a"], "max")},
    "perivascular": {"immune": (["cd45"], "max"), "endothelial": (["cd31", "cd34"], "mean"), "stromal": (["cd140a", "cd140b"], "max")},
}


def _variant_sql(markers: list[str], how: str) -> str:
    s = [f"s_{m}" for m in markers]
    return s[0] if len(s) == 1 else f"greatest({', '.join(s)})" if how == "max" else f"({' + '.join(s)}) / {len(s)}"


_VARS = " UNION ALL ".join(f"SELECT '{v}' AS variant, '{axis}' AS axis, timepoint, roi, avg({_variant_sql(*spec)}) AS v FROM sig GROUP BY timepoint, roi" for v, axes in VARIANTS.items() for axis, spec in axes.items())


@query(f"""WITH {SCORED_SQL}, vr AS ({_VARS}), vt AS (SELECT variant, axis, timepoint, avg(v) AS v, CASE timepoint WHEN 'Sham' THEN 0 WHEN 'D1' THEN 1 WHEN 'D3' THEN 2 ELSE 3 END AS i FROM vr GROUP BY ALL),
vd AS (SELECT *, v - lag(v) OVER (PARTITION BY variant, axis ORDER BY i) AS d FROM vt), vv AS (SELECT variant, axis, {', '.join(f"max(v) FILTER (timepoint = '{t}') AS {t}" for t in virtual.TIMEPOINTS)}, coalesce(bool_and(d >= 0), true) AS mono FROM vd GROUP BY ALL)
SELECT variant, axis, {', '.join(f'round({t}, 6) AS {t}' for t in virtual.TIMEPOINTS)}, round(D7 - Sham, 6) AS change, mono AS monotone, count(*) FILTER (D7 - Sham > 0) OVER (PARTITION BY axis) IN (0, 4) AS same_direction FROM vv""")
def assignment_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean lineage scores by time under other assignments of markers; whether they rise throughout and in one direction in all variants."""
    df = units(spark, sf_dir)
    df = gating.sigmoids(df, reference(df), MARKERS)

    def merged(markers: list[str], how: str) -> Column:
        cs = [F.col(f"s_{m}") for m in markers]
        return cs[0] if len(cs) == 1 else F.greatest(*cs) if how == "max" else reduce(add, cs) / len(cs)

    per = df.groupBy("roi", "timepoint").agg(*(F.avg(merged(*spec)).alias(f"{v}.{axis}") for v, axes in VARIANTS.items() for axis, spec in axes.items()))
    names = [f"{v}.{axis}" for v, axes in VARIANTS.items() for axis in axes]
    long = per.select("timepoint", F.explode(F.array(*(F.struct(F.lit(n.split(".")[0]).alias("variant"), F.lit(n.split(".")[1]).alias("axis"), F.col(f"`{n}`").alias("v")) for n in names))).alias("x")).select("timepoint", "x.*")
    means = long.groupBy("variant", "axis", "timepoint").agg(F.avg("v").alias("v"))
    order = F.array_position(F.array(*map(F.lit, virtual.TIMEPOINTS)), F.col("timepoint"))
    steps = means.withColumn("d", F.col("v") - F.lag("v").over(Window.partitionBy("variant", "axis").orderBy(order)))
    wide = steps.groupBy("variant", "axis").agg(*(F.max(F.when(F.col("timepoint") == t, F.col("v"))).alias(t) for t in virtual.TIMEPOINTS), F.coalesce(F.bool_and(F.col("d") >= 0), F.lit(True)).alias("monotone"))
    up = F.count_if(F.col("change") > 0).over(Window.partitionBy("axis"))
    return rounded(wide.withColumn("change", F.col("D7") - F.col("Sham")).withColumn("same_direction", up.isin(0, len(VARIANTS))))


@query(f"""WITH {GATED_SQL}, a AS (SELECT roi, count(DISTINCT y * 1000 + x) / 1e6 AS mm2 FROM px GROUP BY roi), k AS (SELECT roi, cell_type, count(*) AS n FROM labelled GROUP BY ALL), tt AS (SELECT roi, count(*) AS t FROM labelled GROUP BY roi), m AS (SELECT cell_type, quantile_cont(n, 0.5) AS m FROM k GROUP BY cell_type), p AS (SELECT cell_type FROM m ORDER BY m DESC, cell_type LIMIT 1)
SELECT cell_type, count(*) AS n_regions, round(corr(n / mm2, n / t), 6) AS r, round(stddev_samp(mm2) / avg(mm2), 6) AS area_cv, round(avg(mm2), 6) AS mean_area FROM k JOIN p USING (cell_type) JOIN a USING (roi) JOIN tt USING (roi) GROUP BY cell_type""")
def density_and_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the type with the largest median count: how density over tissue area goes with its share."""
    area = virtual.pixels(spark, sf_dir).groupBy("roi").agg((F.count_distinct("x", "y") / 1e6).alias("mm2"))
    k = staged(gated(spark, sf_dir).groupBy("roi", "cell_type").agg(F.count(F.lit(1)).alias("n")), "type-counts")
    top = k.groupBy("cell_type").agg(F.percentile("n", F.lit(0.5)).alias("m")).orderBy(F.desc("m"), "cell_type").limit(1)
    total = k.groupBy("roi").agg(F.sum("n").alias("t"))
    rows = k.join(top, "cell_type", "left_semi").join(area, "roi").join(total, "roi")
    return rounded(rows.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_regions"), F.corr(F.col("n") / F.col("mm2"), F.col("n") / F.col("t")).alias("r"), (F.stddev_samp("mm2") / F.avg("mm2")).alias("area_cv"), F.avg("mm2").alias("mean_area")))


_PAIR = [(a, b) for i, a in enumerate(MARKERS) for b in MARKERS[i + 1 :]]


@query(f"""WITH {BASE_SQL}, p AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PAIR)}) AS v(a, b)), l AS (SELECT roi, spx, marker, value > 2 AS on_ FROM (UNPIVOT ex ON {M} INTO NAME marker VALUE value)),
j AS (SELECT x.roi, a, b, count(*) AS n, count(*) FILTER (x.on_) AS na, count(*) FILTER (y.on_) AS nb, count(*) FILTER (x.on_ AND y.on_) AS nab FROM p JOIN l x ON x.marker = a JOIN l y ON y.marker = b AND y.roi = x.roi AND y.spx = x.spx GROUP BY ALL)
SELECT roi, a, b, n, na AS n_a, nb AS n_b, nab AS n_ab, round(coalesce(nab / nullif(n, 0), 0), 6) AS overlap, round(coalesce(nab / nullif(na + nb - nab, 0), 0), 6) AS jaccard, round(coalesce(nab / nullif(na, 0), 0), 6) AS b_given_a, round(coalesce(nab / nullif(nb, 0), 0), 6) AS a_given_b FROM j""")
def marker_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap, Jaccard index and conditional shares of all pairs of positive markers, in one pass over the units."""
    on = lambda m: F.col(m) > 2.0
    s = units(spark, sf_dir).groupBy("roi").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(on(m)).alias(f"n_{m}") for m in MARKERS), *(F.count_if(on(a) & on(b)).alias(f"{a}_{b}") for a, b in _PAIR))
    rows = s.select("roi", "n", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n_{a}").alias("n_a"), F.col(f"n_{b}").alias("n_b"), F.col(f"{a}_{b}").alias("n_ab")) for a, b in _PAIR))).alias("p")).select("roi", "n", "p.*")
    over = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    n, na, nb, nab = (F.col(c) for c in ("n", "n_a", "n_b", "n_ab"))
    return rounded(rows.withColumns({"overlap": over(nab, n), "jaccard": over(nab, na + nb - nab), "b_given_a": over(nab, na), "a_given_b": over(nab, nb)}))


@query(f"""WITH {BASE_SQL}, l AS (SELECT roi, marker, value > 2 AS on_, value FROM (UNPIVOT ex ON {M} INTO NAME marker VALUE value)) SELECT roi, marker, count(*) FILTER (on_) AS n_positive, round(avg(on_::INT), 6) AS share, round(avg(value) FILTER (on_), 6) AS mean, round(stddev_pop(value) FILTER (on_), 6) AS sd, round(max(value) FILTER (on_), 6) AS top FROM l GROUP BY ALL""")
def marker_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = thresholds.unpivoted(units(spark, sf_dir), ["roi"], MARKERS)
    on = F.col("value") > 2.0
    v = F.when(on, F.col("value"))
    return rounded(long.groupBy("roi", "marker").agg(F.count_if(on).alias("n_positive"), F.avg(on.cast("double")).alias("share"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.max(v).alias("top")))


# Coarser squares as parents of finer ones.
_HIER = f"""{GATED_SQL}, c1 AS (SELECT roi, spx, cell_type, floor(x / 20)::BIGINT AS px_, floor(y / 20)::BIGINT AS py_, {M} FROM labelled), v1 AS (SELECT roi, px_, py_, cell_type, count(*) AS n FROM c1 GROUP BY ALL), m1 AS (SELECT roi, px_, py_, arg_min(cell_type, (-n, cell_type)) AS label FROM v1 GROUP BY ALL)"""


@query(f"WITH {_HIER} SELECT roi, count(*) AS n_units, count(DISTINCT px_ * 1000 + py_) AS n_parents, round(avg((cell_type = label)::INT), 6) AS coherence, avg((cell_type = label)::INT) >= 0.5 AS coherent FROM c1 JOIN m1 USING (roi, px_, py_) GROUP BY roi")
def hierarchy_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a unit has the label that most of its parent square's units have."""
    df = staged(binning.with_parents(gated(spark, sf_dir).select("roi", "spx", "x", "y", "cell_type", *MARKERS), 20.0), "hierarchy")
    parents = binning.coarsened(df, ["roi"], "cell_type", MARKERS).select("roi", "parent_x", "parent_y", F.col("label").alias("_l"))
    rows = df.join(parents, ["roi", "parent_x", "parent_y"])
    same = (F.col("cell_type") == F.col("_l")).cast("double")
    return rounded(rows.groupBy("roi").agg(F.count(F.lit(1)).alias("n_units"), F.count_distinct("parent_x", "parent_y").alias("n_parents"), F.avg(same).alias("coherence")).withColumn("coherent", F.col("coherence") >= 0.5))


@query(f"WITH {_HIER}, f AS (SELECT roi, px_, py_, count(*) AS n, {', '.join(f'avg({m}) AS {m}' for m in MARKERS)} FROM c1 GROUP BY ALL) SELECT roi, px_ AS parent_x, py_ AS parent_y, n AS n_units, label, {', '.join(r6(m, m) for m in MARKERS)} FROM f JOIN m1 USING (roi, px_, py_)")
def coarsened_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = binning.with_parents(gated(spark, sf_dir).select("roi", "spx", "x", "y", "cell_type", *MARKERS), 20.0)
    return rounded(binning.coarsened(staged(df, "hierarchy"), ["roi"], "cell_type", MARKERS))


def _scale_rows_sql() -> str:
    g = GATED_SQL
    return " UNION ALL ".join(f"SELECT {s} AS scale_um, * FROM (WITH {g.replace(virtual.superpixel_sql(), virtual.superpixel_sql(s))} SELECT roi, x, y, cell_type, {M} FROM labelled)" for s in SCALES)


def _scale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for s in SCALES:
        one = gating.annotate(gating.positivity(units(spark, sf_dir, s), ["roi"], MARKERS, gating.POSITIVITY), MARKERS).select(F.lit(s).alias("scale_um"), "roi", "x", "y", "cell_type", *MARKERS)
        out = one if out is None else out.unionByName(one)
    return staged(out, "scales")


@query(f"""WITH sr AS MATERIALIZED ({_scale_rows_sql()}), s AS (SELECT roi, scale_um, count(*) AS n, count(DISTINCT cell_type) AS k FROM sr GROUP BY ALL) SELECT roi, round(stddev_pop(k) / avg(k), 6) AS cv_clusters, round(stddev_pop(n) / avg(n), 6) AS cv_bins, max(n) FILTER (scale_um = 10) AS n_10, max(n) FILTER (scale_um = 40) AS n_40 FROM s GROUP BY roi""")
def scale_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scale_rows(spark, sf_dir).groupBy("roi", "scale_um").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell_type").alias("k"))
    cv = lambda c: F.stddev_pop(c) / F.avg(c)
    return rounded(s.groupBy("roi").agg(cv("k").alias("cv_clusters"), cv("n").alias("cv_bins"), *(F.max(F.when(F.col("scale_um") == x, F.col("n"))).alias(f"n_{x}") for x in (10, 40))))


@query(f"""WITH sr AS MATERIALIZED ({_scale_rows_sql()}), l AS (SELECT scale_um, marker, value FROM (UNPIVOT sr ON {M} INTO NAME marker VALUE value)) SELECT scale_um, marker, round(stddev_pop(value) / avg(abs(value)), 6) AS variation FROM l GROUP BY ALL""")
def scale_dependent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = thresholds.unpivoted(_scale_rows(spark, sf_dir), ["scale_um"], MARKERS)
    return rounded(long.groupBy("scale_um", "marker").agg((F.stddev_pop("value") / F.avg(F.abs("value"))).alias("variation")))


@query(f"""WITH sr AS MATERIALIZED ({_scale_rows_sql()}), c AS (SELECT scale_um, roi, cell_type, count(*) AS n FROM sr GROUP BY ALL) SELECT scale_um, count(*) AS n_clusters, round(avg(n), 6) AS mean_size, round(quantile_cont(n, 0.5), 6) AS median_size, min(n) AS min_size, max(n) AS max_size FROM c GROUP BY scale_um""")
def scale_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _scale_rows(spark, sf_dir).groupBy("scale_um", "roi", "cell_type").agg(F.count(F.lit(1)).alias("n"))
    return rounded(c.groupBy("scale_um").agg(F.count(F.lit(1)).alias("n_clusters"), F.avg("n").alias("mean_size"), F.percentile("n", F.lit(0.5)).alias("median_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size")))


_CENT = ", ".join(f"avg({m}) AS {m}" for m in MARKERS)
_DIST = " + ".join(f"pow(a.{m} - b.{m}, 2)" for m in MARKERS)


@query(f"""WITH sr AS MATERIALIZED ({_scale_rows_sql()}), c AS (SELECT scale_um, cell_type, {_CENT} FROM sr GROUP BY ALL), d AS (SELECT a.scale_um AS scale_a, b.scale_um AS scale_b, a.cell_type, min(sqrt({_DIST})) AS distance FROM c a JOIN c b ON a.scale_um < b.scale_um GROUP BY ALL)
SELECT scale_a, scale_b, count(*) AS n, round(avg(distance), 6) AS mean_distance, round(stddev_pop(distance), 6) AS sd_distance, round(max(distance), 6) AS max_distance FROM d GROUP BY ALL""")
def centroid_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each label's centroid is from the nearest centroid of a coarser scale."""
    c = staged(_scale_rows(spark, sf_dir).groupBy("scale_um", "cell_type").agg(*(F.avg(m).alias(m) for m in MARKERS)), "centroids")
    out = None
    for i, a in enumerate(SCALES):
        for b in SCALES[i + 1 :]:
            one = statistics.nearest_centroids(c.filter(F.col("scale_um") == a), c.filter(F.col("scale_um") == b), "cell_type", MARKERS).select(F.lit(a).alias("scale_a"), F.lit(b).alias("scale_b"), "distance")
            out = one if out is None else out.unionByName(one)
    return rounded(out.groupBy("scale_a", "scale_b").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"), F.stddev_pop("distance").alias("sd_distance"), F.max("distance").alias("max_distance")))


@query(f"""WITH {_BEADS}, m AS (SELECT batch, bead, quantile_cont(value, 0.5) AS m FROM beads GROUP BY ALL HAVING quantile_cont(value, 0.5) >= 1), r AS (SELECT bead, quantile_cont(m, 0.5) AS ref FROM m GROUP BY bead), f AS (SELECT batch, greatest(least(ref / (m + 1e-10), 10), 0.1) AS f FROM m JOIN r USING (bead)),
g AS (SELECT batch, coalesce(quantile_cont(f, 0.5) FILTER (abs(f - 1) > 1e-9), 1) AS factor FROM f GROUP BY batch), n AS (SELECT batch, bead, value, value * factor AS v FROM beads JOIN g USING (batch)), b0 AS (SELECT bead, batch, quantile_cont(value, 0.5) AS a, quantile_cont(v, 0.5) AS b FROM n GROUP BY ALL)
SELECT bead, round(stddev_pop(a) / avg(a), 6) AS cv_before, round(stddev_pop(b) / avg(b), 6) AS cv_after, round((stddev_pop(a) / avg(a) - stddev_pop(b) / avg(b)) / nullif(stddev_pop(a) / avg(a), 0), 6) AS improvement FROM b0 GROUP BY bead""")
def bead_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values times their batch's bead factor, and how far that narrows the spread of batch medians."""
    beads = _beads(spark, sf_dir)
    factors = batches.bead_factors(beads, "batch", "bead", "value", "ord").select("batch", "factor")
    rows = beads.join(F.broadcast(factors), "batch").groupBy("bead", "batch").agg(F.percentile("value", F.lit(0.5)).alias("a"), F.percentile(F.col("value") * F.col("factor"), F.lit(0.5)).alias("b"))
    cv = lambda c: F.stddev_pop(c) / F.avg(c)
    s = rows.groupBy("bead").agg(cv("a").alias("cv_before"), cv("b").alias("cv_after"))
    return rounded(s.withColumn("improvement", (F.col("cv_before") - F.col("cv_after")) / F.when(F.col("cv_before") != 0, F.col("cv_before"))))


@query(f"""WITH {BASE_SQL}, long AS ({LONG_SQL}), k AS (SELECT marker, count(DISTINCT roi) AS n FROM long WHERE NOT (marker = 'cd34' AND roi % 5 = 0) GROUP BY marker) SELECT marker, n AS n_batches, n = 24 AS in_all FROM k""")
def batch_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which markers every batch has; one marker is taken out of some batches."""
    long = thresholds.unpivoted(units(spark, sf_dir), ["roi"], MARKERS).filter("NOT (marker = 'cd34' AND roi % 5 = 0)").select("roi", "marker").distinct()
    long = staged(long, "batches")
    shared = batches.shared_markers(long, "roi", "marker").withColumn("_s", F.lit(True))
    counts = long.groupBy("marker").agg(F.count(F.lit(1)).alias("n_batches"))
    return counts.join(shared, "marker", "left").select("marker", "n_batches", F.coalesce("_s", F.lit(False)).alias("in_all"))


_LENS = {t: "immune" for t in gating.GATES if "endothelial" not in t and "fibroblast" not in t} | {t: "endothelial" for t in gating.GATES if "endothelial" in t} | {t: "stromal" for t in gating.GATES if "fibroblast" in t}
_LENS_SQL = "CASE " + " ".join(f"WHEN cell_type = '{t}' THEN '{lens}'" for t, lens in _LENS.items()) + " ELSE 'unassigned' END"


def as_lens(label: Column) -> Column:
    return reduce(lambda c, item: c.when(label == item[0], item[1]), _LENS.items(), F.when(F.lit(False), "")).otherwise("unassigned")


@query(f"WITH {GATED_SQL}, sure AS (SELECT * FROM labelled WHERE confidence > 0), named AS (SELECT roi, spx, {_LENS_SQL} AS l FROM sure), {knn_sql('sure')}, {_ENRICH} SELECT roi, focal, neighbour, n_focal, {', '.join(r6(c, c) for c in ('expected', 'observed', 'enrichment', 'log2_enrichment'))} FROM en")
def lineage_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhood enrichment of lineages, by the family of each cell type."""
    df = kept(gated(spark, sf_dir).filter("confidence > 0"))
    rows = neighbours.enrichment(df.select("roi", F.col("spx").alias("id"), as_lens(F.col("cell_type")).alias("lens")), knn(df), ["roi"], "lens")
    return rounded(rows.select("roi", "focal", "neighbour", "n_focal", "expected", "observed", "enrichment", "log2_enrichment"))


_WE = f"{GATED_SQL}, sure AS (SELECT * FROM labelled WHERE confidence > 0), named AS (SELECT roi, spx, cell_type AS l FROM sure), {knn_sql('sure')}, {_ENRICH}, d AS MATERIALIZED (SELECT en.*, {virtual.design_sql('en.roi')} FROM en)"


@query(f"""WITH {_WE} SELECT timepoint, focal, neighbour, round(sum(n_focal * observed) / sum(n_focal), 6) AS observed, round(sum(n_focal * expected) / sum(n_focal), 6) AS expected, round(sum(n_focal * enrichment) / sum(n_focal), 6) AS enrichment,
round(CASE WHEN count(log2_enrichment) = count(*) THEN sum(n_focal * log2_enrichment) / sum(n_focal) END, 6) AS log2_enrichment, sum(n_focal)::BIGINT AS n_focal, count(*) AS n_rois FROM d GROUP BY ALL""")
def weighted_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over regions weighted by focal cells; the log is null where any region's is."""
    d = virtual.with_design(cell_enrichment(spark, sf_dir))
    w = lambda c: F.sum(F.col("n_focal") * F.col(c)) / F.sum("n_focal")
    out = d.groupBy("timepoint", "focal", "neighbour").agg(*(w(c).alias(c) for c in ("observed", "expected", "enrichment")), F.when(F.count("log2_enrichment") == F.count(F.lit(1)), w("log2_enrichment")).alias("log2_enrichment"), F.sum("n_focal").alias("_n"), F.count(F.lit(1)).alias("n_rois"))
    return rounded(out.withColumnRenamed("_n", "n_focal"))


@query(f"WITH {_WE}, m AS (SELECT focal, neighbour, timepoint, avg(enrichment) AS v FROM d GROUP BY ALL) SELECT focal, neighbour, round(var_samp(v), 6) AS variance, count(*) AS n FROM m GROUP BY ALL")
def pair_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = virtual.with_design(cell_enrichment(spark, sf_dir)).groupBy("focal", "neighbour", "timepoint").agg(F.avg("enrichment").alias("v"))
    return rounded(m.groupBy("focal", "neighbour").agg(F.var_samp("v").alias("variance"), F.count(F.lit(1)).alias("n")))


@query(f"WITH {_WE} SELECT timepoint, focal, {', '.join(f'''round(avg(enrichment) FILTER (neighbour = '{t}'), 6) AS {t}''' for t in gating.GATES)} FROM d GROUP BY ALL")
def enrichment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = virtual.with_design(cell_enrichment(spark, sf_dir))
    return rounded(d.groupBy("timepoint", "focal").pivot("neighbour", list(gating.GATES)).agg(F.avg("enrichment")))


@query(f"""WITH {_WE}, w AS (SELECT timepoint, focal, neighbour, CASE WHEN count(log2_enrichment) = count(*) THEN sum(n_focal * log2_enrichment) / sum(n_focal) END AS o FROM d GROUP BY ALL), m AS (SELECT timepoint, focal, neighbour, avg(v) AS n FROM (SELECT timepoint, mouse, focal, neighbour, avg(log2_enrichment) AS v FROM d GROUP BY ALL) GROUP BY ALL),
b AS MATERIALIZED (SELECT timepoint, round(n, 9) AS n, round(o, 9) AS o FROM m JOIN w USING (timepoint, focal, neighbour) WHERE n IS NOT NULL AND o IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY timepoint ORDER BY n) + (count(*) OVER (PARTITION BY timepoint, n) - 1) / 2.0 AS rn, rank() OVER (PARTITION BY timepoint ORDER BY o) + (count(*) OVER (PARTITION BY timepoint, o) - 1) / 2.0 AS ro FROM b)
SELECT timepoint, count(*) AS n_both, round(corr(rn, ro), 6) AS rho, round(avg((sign(n) = sign(o))::INT) FILTER (abs(o) > 0.1), 6) AS sign_agree, round(quantile_cont(abs(n - o), 0.5), 6) AS delta_median, round(max(abs(n - o)), 6) AS delta_max FROM r GROUP BY timepoint""")
def marginal_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the mean of subjects' means goes with the weighted mean of regions: ranks, signs, differences."""
    d = staged(virtual.with_design(cell_enrichment(spark, sf_dir)), "enrichment")
    key = ["timepoint", "focal", "neighbour"]
    log = F.col("log2_enrichment")
    w = d.groupBy(*key).agg(F.when(F.count(log) == F.count(F.lit(1)), F.sum(F.col("n_focal") * log) / F.sum("n_focal")).alias("o"))
    m = d.groupBy(*key, "mouse").agg(F.avg(log).alias("v")).groupBy(*key).agg(F.avg("v").alias("n"))
    b = m.join(w, key).filter("n IS NOT NULL AND o IS NOT NULL").select("timepoint", F.round("n", 9).alias("n"), F.round("o", 9).alias("o"))
    r = b.withColumns({"rn": statistics.average_rank("n", ["timepoint"]), "ro": statistics.average_rank("o", ["timepoint"])})
    gap = F.abs(F.col("n") - F.col("o"))
    return rounded(r.groupBy("timepoint").agg(F.count(F.lit(1)).alias("n_both"), F.corr("rn", "ro").alias("rho"), F.avg(F.when(F.abs("o") > 0.1, (F.signum("n") == F.signum("o")).cast("double"))).alias("sign_agree"), F.percentile(gap, F.lit(0.5)).alias("delta_median"), F.max(gap).alias("delta_max")))

