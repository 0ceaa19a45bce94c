"""Plans of the endpoint families: composition, neighbourhoods, activation; their sweeps, flags and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.folders import staged
from quadrille.operators import composition, effects, endpoints, gating, neighbours
from quadrille.plans.common import SCORED_SQL, query, rounded, scored, units
from quadrille.plans.contrasts import _PAIRS
from quadrille.plans.space import kept, knn, knn_sql
from quadrille.plans.units import COMPOSITE_SQL, GATED_SQL, gated
from quadrille.sources.virtual import BASE_SQL, CONTROL, MARKERS

_SCORE = ("lineage_immune", "lineage_endothelial", "lineage_stromal")
PERCENTILES, SUPPORTS, THRESHOLDS = (65, 75, 85), (10, 20, 40), (0.2, 0.3, 0.4)


def effects_sql(source: str, value: str, keys: list[str], name: str = "e2") -> str:
    """CTEs for the effect sizes of a table (keys, timepoint, value), the last called `name`."""
    k, on = ", ".join(keys), " AND ".join
    same = lambda a: on(f"{a}.{x} = k.{x}" for x in keys)
    return f"""st_{name} AS MATERIALIZED (SELECT {k}, timepoint, count({value}) AS n, avg({value}) AS m, var_samp({value}) AS v FROM {source} GROUP BY ALL),
e0_{name} AS (SELECT {', '.join(f'k.{x}' for x in keys)}, g1, g2, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2 FROM (SELECT DISTINCT {k} FROM {source}) k CROSS JOIN con LEFT JOIN st_{name} a ON {same('a')} AND a.timepoint = g1 LEFT JOIN st_{name} b ON {same('b')} AND b.timepoint = g2),
e1_{name} AS (SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2 AND ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) > 1e-24 THEN (m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3 / (4.0 * (n1 + n2 - 2) - 1)) END AS g FROM e0_{name}),
e3_{name} AS (SELECT *, abs(g) > 3 AND sqrt((v1 + v2) / 2) < 0.01 AS bad, CASE WHEN least(n1, n2) >= 2 THEN 2.0 / least(n1, n2) + g * g / (4 * least(n1, n2)) END AS var FROM e1_{name}),
{name} AS MATERIALIZED (SELECT *, CASE WHEN NOT bad THEN g / (1 + var) END AS shrunk FROM e3_{name})"""


def _effects(spark: SparkSession, df: DataFrame, keys: list[str], value: str) -> DataFrame:
    made = effects.effect_sizes(df, keys, "timepoint", value, effects.contrast_table(spark))
    return made.select(*keys, "g1", "g2", "n1", "n2", "m1", "m2", "hedges_g", "g_pathological", "g_shrunk_neutral")


_OUT = "g1, g2, n1, n2, round(m1, 6) AS m1, round(m2, 6) AS m2, round(g, 6) AS hedges_g, bad AS g_pathological, round(shrunk, 6) AS g_shrunk_neutral"

# Family A: composition by interface category, on scores at three thresholds and on raw markers at three control percentiles.
_RAW_T = f"""rt AS (SELECT p, round(avg(im), 9) AS im, round(avg(en), 9) AS en, round(avg(st), 9) AS st FROM ({' UNION ALL '.join(f"SELECT {p} AS p, mouse, quantile_cont(cd45, {p / 100}) AS im, quantile_cont((cd31 + cd34) / 2, {p / 100}) AS en, quantile_cont(cd140a, {p / 100}) AS st FROM ex WHERE timepoint = 'Sham' GROUP BY mouse" for p in PERCENTILES)}) GROUP BY p)"""
_CAT = "coalesce(nullif(concat_ws('+', CASE WHEN en THEN 'endothelial' END, CASE WHEN im THEN 'immune' END, CASE WHEN st THEN 'stromal' END), ''), 'none')"
_CATS = ", ".join(f"'{c}'" for c in gating.INTERFACES)
_A = f"""{SCORED_SQL}, {_RAW_T}, va AS (SELECT roi, timepoint, mouse, 'sigmoid' AS basis, t AS level, lineage_immune > t AS im, lineage_endothelial > t AS en, lineage_stromal > t AS st FROM scored, (SELECT unnest([0.2, 0.3, 0.4]) AS t)
UNION ALL SELECT roi, timepoint, mouse, 'no_none', 0.3, lineage_immune > 0.3, lineage_endothelial > 0.3, lineage_stromal > 0.3 FROM scored UNION ALL SELECT roi, timepoint, mouse, 'raw', p, cd45 > rt.im, (cd31 + cd34) / 2 > rt.en, cd140a > rt.st FROM scored, rt),
vc AS MATERIALIZED (SELECT roi, timepoint, mouse, basis, level::DOUBLE AS level, {_CAT} AS category, count(*) AS n FROM va GROUP BY ALL), vr AS (SELECT roi, timepoint, mouse, basis, level, sum(n) AS t FROM vc GROUP BY ALL),
vf AS (SELECT r.*, c.category, coalesce(n, 0) AS n FROM vr r CROSS JOIN (SELECT unnest([{_CATS}]) AS category) c LEFT JOIN vc ON vc.roi = r.roi AND vc.basis = r.basis AND vc.level = r.level AND vc.category = c.category WHERE NOT (r.basis = 'no_none' AND c.category = 'none')),
vm AS (SELECT basis, level, timepoint, mouse, category, avg(n / t) AS fraction, sum(t) AS n_total FROM vf GROUP BY ALL),
vz AS (SELECT *, CASE WHEN sum(fraction) OVER w > 0 THEN (fraction * n_total + 0.5) / (n_total + count(*) OVER w * 0.5) ELSE 1.0 / count(*) OVER w END AS z FROM vm WINDOW w AS (PARTITION BY basis, level, timepoint, mouse)),
vl AS MATERIALIZED (SELECT *, ln(z) - avg(ln(z)) OVER (PARTITION BY basis, level, timepoint, mouse) AS clr FROM vz), {_PAIRS}, {effects_sql('vl', 'clr', ['basis', 'level', 'category'])}"""


def raw_thresholds(df: DataFrame, percentiles: tuple[int, ...]) -> DataFrame:
    """One row of t_<percentile>_<lineage>: means over control subjects of percentiles of raw markers; the endothelial one is a mean of two markers."""
    values = {"im": F.col("cd45"), "en": (F.col("cd31") + F.col("cd34")) / 2, "st": F.col("cd140a")}
    per = df.filter(F.col("timepoint") == CONTROL).groupBy("mouse").agg(*(F.percentile(v, F.lit(p / 100)).alias(f"t_{p}_{k}") for p in percentiles for k, v in values.items()))
    return per.agg(*(F.round(F.avg(f"t_{p}_{k}"), 9).alias(f"t_{p}_{k}") for p in percentiles for k in values))


def _family_a_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basis, level, timepoint, mouse, category, clr): all variants as rows of one plan."""
    df = kept(scored(spark, sf_dir))
    df = df.join(F.broadcast(raw_thresholds(df, PERCENTILES)))
    variant = lambda basis, level, im, en, st: F.struct(F.lit(basis).alias("basis"), F.lit(float(level)).alias("level"), im.alias("im"), en.alias("en"), st.alias("st"))
    above = lambda t: [F.col(s) > t for s in _SCORE]
    raw = lambda p: [F.col("cd45") > F.col(f"t_{p}_im"), (F.col("cd31") + F.col("cd34")) / 2 > F.col(f"t_{p}_en"), F.col("cd140a") > F.col(f"t_{p}_st")]
    variants = F.array(*(variant("sigmoid", t, *above(t)) for t in THRESHOLDS), variant("no_none", 0.3, *above(0.3)), *(variant("raw", p, *raw(p)) for p in PERCENTILES))
    rows = df.select("roi", "timepoint", "mouse", F.explode(variants).alias("v")).select("roi", "timepoint", "mouse", "v.*")
    joined = F.concat_ws("+", *(F.when(F.col(c), n) for c, n in (("en", "endothelial"), ("im", "immune"), ("st", "stromal"))))
    rows = rows.withColumn("category", F.when(joined == "", "none").otherwise(joined))
    parts = composition.fractions(rows, ["basis", "level", "roi", "timepoint", "mouse"], "category", gating.INTERFACES).filter("NOT (basis = 'no_none' AND category = 'none')")
    mice = composition.to_subjects(parts, ["basis", "level", "timepoint", "mouse", "category"])
    keys = ["basis", "level", "timepoint", "mouse"]
    return staged(composition.clr(composition.replace_zeros(mice, keys), keys, "replaced"), "family-a")


@query(f"WITH {_A} SELECT basis, level, category, {_OUT} FROM e2")
def family_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_effects(spark, _family_a_subjects(spark, sf_dir), ["basis", "level", "category"], "clr"))


_A_FLAGS = """fl AS (SELECT category, g1, g2, count(DISTINCT sign(g)) > 1 AS flips FROM e2 WHERE basis = 'sigmoid' GROUP BY ALL), a0 AS (SELECT * FROM e2 WHERE basis = 'sigmoid' AND level = 0.3),
af AS MATERIALIZED (SELECT a.category, a.g1, a.g2, a.g, a.shrunk, a.bad, fl.flips, coalesce(sign(a.g) <> sign(n.g) AND a.g IS NOT NULL AND n.g IS NOT NULL, false) AS none_flip, r.g AS g_other, coalesce(sign(a.g) <> sign(r.g), false) AS sign_reverse, coalesce(abs(a.g) > 0.5 AND abs(r.g) < 0.2 * abs(a.g), false) AS g_collapse,
coalesce(a.g IS NOT NULL AND r.g IS NOT NULL AND greatest(abs(a.g), abs(r.g)) > 0.5 AND abs(a.g - r.g) / greatest(abs(a.g), abs(r.g)) > 0.5, false) AS magnitude_disagree
FROM a0 a JOIN fl ON fl.category = a.category AND fl.g1 = a.g1 AND fl.g2 = a.g2 LEFT JOIN e2 n ON n.basis = 'no_none' AND n.category = a.category AND n.g1 = a.g1 AND n.g2 = a.g2 LEFT JOIN e2 r ON r.basis = 'raw' AND r.level = 75 AND r.category = a.category AND r.g1 = a.g1 AND r.g2 = a.g2)"""


def _family_a_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = staged(_effects(spark, _family_a_subjects(spark, sf_dir), ["basis", "level", "category"], "clr"), "family-a-effects")
    on = ["category", "g1", "g2"]
    pick = lambda basis, level: made.filter((F.col("basis") == basis) & (F.col("level") == level)).drop("basis", "level")
    flips = endpoints.sign_flips(made.filter("basis = 'sigmoid'"), on)
    none = pick("no_none", 0.3).select(*on, F.col("hedges_g").alias("_n"))
    flagged = endpoints.basis_flags(pick("sigmoid", 0.3), pick("raw", 75.0), on).join(flips, on).join(none, on, "left")
    return flagged.withColumn("none_flip", F.coalesce(F.signum("hedges_g") != F.signum("_n"), F.lit(False))).drop("_n")


@query(f"WITH {_A}, {_A_FLAGS} SELECT category, g1, g2, round(g, 6) AS hedges_g, round(g_other, 6) AS g_other, flips AS threshold_sensitive, none_flip, sign_reverse, g_collapse, magnitude_disagree FROM af")
def family_a_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_family_a_flagged(spark, sf_dir).select("category", "g1", "g2", "hedges_g", "g_other", "threshold_sensitive", "none_flip", "sign_reverse", "g_collapse", "magnitude_disagree"))


_TYPES = [*gating.GATES, "unassigned"]
_A2 = f"""{GATED_SQL}, kc AS (SELECT roi, timepoint, mouse, cell_type, count(*) AS n FROM labelled GROUP BY ALL), kr AS (SELECT roi, timepoint, mouse, sum(n) AS t FROM kc GROUP BY ALL), kf AS (SELECT r.*, c.category, coalesce(n, 0) AS n FROM kr r CROSS JOIN (SELECT unnest([{', '.join(f"'{t}'" for t in _TYPES)}]) AS category) c LEFT JOIN kc ON kc.roi = r.roi AND kc.cell_type = c.category),
km AS (SELECT timepoint, mouse, category, avg(n / t) AS fraction, sum(t) AS n_total FROM kf GROUP BY ALL), kz AS (SELECT *, CASE WHEN sum(fraction) OVER w > 0 THEN (fraction * n_total + 0.5) / (n_total + count(*) OVER w * 0.5) ELSE 1.0 / count(*) OVER w END AS z FROM km WINDOW w AS (PARTITION BY timepoint, mouse)),
kl AS MATERIALIZED (SELECT *, ln(z) - avg(ln(z)) OVER (PARTITION BY timepoint, mouse) AS clr FROM kz)"""


def _type_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = composition.fractions(gated(spark, sf_dir), ["roi", "timepoint", "mouse"], "cell_type", _TYPES)
    mice = composition.to_subjects(fr, ["timepoint", "mouse", "category"])
    return staged(composition.clr(composition.replace_zeros(mice, ["timepoint", "mouse"]), ["timepoint", "mouse"], "replaced"), "types")


@query(f"WITH {_A2}, {_PAIRS}, {effects_sql('kl', 'clr', ['category'])} SELECT category, {_OUT} FROM e2")
def family_a_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_effects(spark, _type_subjects(spark, sf_dir), ["category"], "clr"))


# The prevalence sweep: rare types merged at three limits before the log-ratios.
_PREV = f"""{_A2}, kt AS (SELECT category, max(m) AS top FROM (SELECT category, timepoint, avg(fraction) AS m FROM km GROUP BY ALL) GROUP BY category), pv AS (SELECT p, timepoint, mouse, CASE WHEN top < p THEN 'other_rare' ELSE category END AS category, sum(fraction) AS fraction, max(n_total) AS n_total FROM km JOIN kt USING (category), (SELECT unnest([0.005, 0.01, 0.02]) AS p) GROUP BY ALL),
pz AS (SELECT *, (fraction * n_total + 0.5) / (n_total + count(*) OVER (PARTITION BY p, timepoint, mouse) * 0.5) AS z FROM pv), pl AS MATERIALIZED (SELECT p::DOUBLE AS level, timepoint, mouse, category, ln(z) - avg(ln(z)) OVER (PARTITION BY p, timepoint, mouse) AS clr FROM pz)"""


@query(f"WITH {_PREV}, {_PAIRS}, {effects_sql('pl', 'clr', ['level', 'category'])} SELECT level, category, {_OUT} FROM e2")
def prevalence_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    mice = _type_subjects(spark, sf_dir).select("timepoint", "mouse", "category", "fraction", "n_total")
    out = None
    for least in (0.005, 0.01, 0.02):
        one = composition.merge_rare(mice, "timepoint", ["mouse"], least).withColumn("level", F.lit(least))
        out = one if out is None else out.unionByName(one)
    keys = ["level", "timepoint", "mouse"]
    return rounded(_effects(spark, composition.clr(composition.replace_zeros(out, keys), keys, "replaced"), ["level", "category"], "clr"))


# Family B: neighbours' scores less the unit's own, by composite label and by cell type, at three supports, on scores and on raw markers.
_RAW = {"lineage_immune": "cd45", "lineage_endothelial": "(cd31 + cd34) / 2", "lineage_stromal": "cd140a"}
_B = f"""{SCORED_SQL}, gt AS (WITH {GATED_SQL} SELECT roi, spx, cell_type FROM labelled), un AS MATERIALIZED (SELECT s.roi, s.spx, s.x, s.y, s.timepoint, s.mouse, {', '.join(_SCORE)}, {', '.join(f'{e} AS raw_{k[8:]}' for k, e in _RAW.items())}, {COMPOSITE_SQL} AS composite, cell_type FROM scored s JOIN gt USING (roi, spx)), {knn_sql('un')},
du AS MATERIALIZED (SELECT e.roi, e.src, any_value(a.timepoint) AS timepoint, any_value(a.mouse) AS mouse, any_value(a.composite) AS composite, any_value(a.cell_type) AS cell_type, {', '.join(f'avg(b.{s}) - any_value(a.{s}) AS {s}' for s in _SCORE)}, {', '.join(f'avg(b.raw_{s[8:]}) - any_value(a.raw_{s[8:]}) AS raw_{s[8:]}' for s in _SCORE)}
FROM e JOIN un a ON e.roi = a.roi AND e.src = a.spx JOIN un b ON e.roi = b.roi AND e.dst = b.spx GROUP BY e.roi, e.src),
bl AS (SELECT roi, timepoint, mouse, 'first' AS axis, composite AS label, 'sigmoid' AS basis, {', '.join(_SCORE)} FROM du UNION ALL SELECT roi, timepoint, mouse, 'second', cell_type, 'sigmoid', {', '.join(_SCORE)} FROM du UNION ALL SELECT roi, timepoint, mouse, 'first', composite, 'raw', {', '.join(f'raw_{s[8:]}' for s in _SCORE)} FROM du),
br AS (SELECT roi, timepoint, mouse, axis, label, basis, count(*) AS n, {', '.join(f'avg({s}) AS {s}' for s in _SCORE)} FROM bl GROUP BY ALL), bs AS (SELECT br.*, k AS min_support FROM br, (SELECT unnest([10, 20, 40]) AS k) WHERE n >= k),
bm AS (SELECT axis, basis, min_support, label, timepoint, mouse, {', '.join(f'avg({s}) AS {s}' for s in _SCORE)} FROM bs GROUP BY ALL), bf AS (SELECT axis, basis, min_support, label FROM bm GROUP BY ALL HAVING count(DISTINCT timepoint) = 4),
bd AS (SELECT axis, basis, min_support, label, timepoint, mouse, {', '.join(f"{s} - avg({s}) FILTER (timepoint = 'Sham') OVER (PARTITION BY axis, basis, min_support, label) AS {s}" for s in _SCORE)} FROM bm SEMI JOIN bf USING (axis, basis, min_support, label)),
bx AS MATERIALIZED (SELECT axis, basis, min_support, label, timepoint, mouse, endpoint, v FROM (UNPIVOT bd ON {', '.join(_SCORE)} INTO NAME endpoint VALUE v)), {_PAIRS}, {effects_sql('bx', 'v', ['axis', 'basis', 'min_support', 'label', 'endpoint'])}"""


def _family_b_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    df = gating.annotate(gating.positivity(df, ["roi"], MARKERS, gating.POSITIVITY), MARKERS)
    label = gating.composite_label({n: F.col(f"lineage_{n}") for n in gating.LINEAGES}, F.col("subtype"), {a: F.col(f"activation_{a}") for a in gating.ACTIVATION})
    raw = {"raw_immune": F.col("cd45"), "raw_endothelial": (F.col("cd31") + F.col("cd34")) / 2, "raw_stromal": F.col("cd140a")}
    df = staged(df.withColumns({"composite": label, **raw}).select("roi", "spx", "x", "y", "timepoint", "mouse", "composite", "cell_type", *_SCORE, *raw), "family-b-units")
    values = [*_SCORE, *raw]
    delta = neighbours.neighbour_minus_self(df.select("roi", F.col("spx").alias("id"), "timepoint", "mouse", "composite", "cell_type", *values), knn(df), ["roi"], values)
    of = lambda axis, label, basis, cols: F.struct(F.lit(axis).alias("axis"), F.col(label).alias("label"), F.lit(basis).alias("basis"), *(F.col(f"d_{c}").alias(s) for c, s in zip(cols, _SCORE)))
    rows = delta.select("roi", "timepoint", "mouse", F.explode(F.array(of("first", "composite", "sigmoid", _SCORE), of("second", "cell_type", "sigmoid", _SCORE), of("first", "composite", "raw", list(raw)))).alias("r")).select("roi", "timepoint", "mouse", "r.*")
    per = rows.groupBy("roi", "timepoint", "mouse", "axis", "label", "basis").agg(F.count(F.lit(1)).alias("n"), *(F.avg(s).alias(s) for s in _SCORE))
    supported = per.withColumn("min_support", F.explode(F.filter(F.array(*map(F.lit, SUPPORTS)), lambda k: F.col("n") >= k)))
    keys = ["axis", "basis", "min_support", "label"]
    mice = staged(supported.groupBy(*keys, "timepoint", "mouse").agg(*(F.avg(s).alias(s) for s in _SCORE)), "family-b-mice")
    complete = mice.groupBy(*keys).agg(F.count_distinct("timepoint").alias("_t")).filter("_t = 4").select(*keys)
    base = Window.partitionBy(*keys)
    versus = mice.join(complete, keys, "left_semi").withColumns({s: F.col(s) - F.avg(F.when(F.col("timepoint") == CONTROL, F.col(s))).over(base) for s in _SCORE})
    long = versus.unpivot([*keys, "timepoint", "mouse"], list(_SCORE), "endpoint", "v")
    return _effects(spark, long, [*keys, "endpoint"], "v")


@query(f"WITH {_B} SELECT axis, basis, min_support, label, endpoint, {_OUT} FROM e2")
def family_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_family_b_effects(spark, sf_dir))


@query(f"""WITH {_B}, f AS (SELECT * FROM e2 WHERE axis = 'first' AND basis = 'sigmoid' AND min_support = 20), s AS (SELECT * FROM e2 WHERE axis = 'first' AND basis = 'raw' AND min_support = 20),
m AS (SELECT label, endpoint, g1, g2, f.shrunk AS a, s.shrunk AS b, coalesce(abs(f.shrunk) > 0.5, false) AND NOT coalesce(f.bad, false) AS fa, coalesce(abs(s.shrunk) > 0.5, false) AND NOT coalesce(s.bad, false) AS sa FROM f FULL JOIN s USING (label, endpoint, g1, g2))
SELECT label, endpoint, g1, g2, round(a, 6) AS g_first, round(b, 6) AS g_second, CASE WHEN fa AND sa THEN 'both_above' WHEN fa THEN 'first_only' WHEN sa THEN 'second_only' ELSE 'both_below' END AS status, coalesce(a = 0 OR b = 0 OR (a > 0) = (b > 0), true) AS sign_agree FROM m""")
def basis_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = staged(_family_b_effects(spark, sf_dir).filter("axis = 'first' AND min_support = 20"), "family-b-effects")
    pick = lambda basis: made.filter(F.col("basis") == basis).drop("basis", "axis", "min_support")
    return rounded(endpoints.divergence(pick("sigmoid"), pick("raw"), ["label", "endpoint", "g1", "g2"]))


# Family C: activation rates inside compartments at three control percentiles.
_COMP = {"cd45": "cd45", "cd31": "cd31", "cd140b": "cd140b"}
_C = f"""{BASE_SQL}, ct AS (SELECT p, {', '.join(f'round(avg({m}), 9) AS {m}' for m in (*_COMP, 'cd44'))} FROM ({' UNION ALL '.join(f"SELECT {p} AS p, mouse, {', '.join(f'quantile_cont({m}, {p / 100}) AS {m}' for m in (*_COMP, 'cd44'))} FROM ex WHERE timepoint = 'Sham' GROUP BY mouse" for p in PERCENTILES)}) GROUP BY p),
cr AS (SELECT p, roi, timepoint, mouse, {', '.join(f"avg((ex.cd44 > ct.cd44)::INT) FILTER (ex.{m} > ct.{m}) AS {m}_rate" for m in _COMP)}, avg((ex.cd44 > ct.cd44)::INT) FILTER (NOT ({' OR '.join(f'ex.{m} > ct.{m}' for m in _COMP)})) AS background_rate, avg(({' AND '.join(f'ex.{m} > ct.{m}' for m in _COMP)})::INT) AS triple_overlap FROM ex, ct GROUP BY ALL),
cm AS (SELECT p::DOUBLE AS level, timepoint, mouse, avg(cd45_rate) AS cd45_rate, avg(cd31_rate) AS cd31_rate, avg(cd140b_rate) AS cd140b_rate, avg(background_rate) AS background_rate, avg(triple_overlap) AS triple_overlap FROM cr GROUP BY ALL),
cx AS MATERIALIZED (SELECT level, timepoint, mouse, endpoint, v FROM cm UNPIVOT INCLUDE NULLS (v FOR endpoint IN (cd45_rate, cd31_rate, cd140b_rate, background_rate, triple_overlap))), {_PAIRS}, {effects_sql('cx', 'v', ['level', 'endpoint'])}"""


def _family_c_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = units(spark, sf_dir)
    ms = [*_COMP, "cd44"]
    per = df.filter(F.col("timepoint") == CONTROL).groupBy("mouse").agg(*(F.percentile(m, F.lit(p / 100)).alias(f"t_{p}_{m}") for p in PERCENTILES for m in ms))
    cuts = per.agg(F.array(*(F.struct(F.lit(float(p)).alias("level"), *(F.round(F.avg(f"t_{p}_{m}"), 9).alias(f"t_{m}") for m in ms)) for p in PERCENTILES)).alias("cuts"))
    rows = df.join(F.broadcast(cuts)).withColumn("c", F.explode("cuts")).select("roi", "timepoint", "mouse", F.col("c.level").alias("level"), *(((F.col(m) > F.col(f"c.t_{m}"))).alias(m) for m in ms))
    act = F.col("cd44").cast("double")
    outside = ~(F.col("cd45") | F.col("cd31") | F.col("cd140b"))
    regions = rows.groupBy("level", "roi", "timepoint", "mouse").agg(*(F.avg(F.when(F.col(m), act)).alias(f"{m}_rate") for m in _COMP), F.avg(F.when(outside, act)).alias("background_rate"), F.avg((F.col("cd45") & F.col("cd31") & F.col("cd140b")).cast("double")).alias("triple_overlap"))
    rates = [*(f"{m}_rate" for m in _COMP), "background_rate", "triple_overlap"]
    mice = regions.groupBy("level", "timepoint", "mouse").agg(*(F.avg(r).alias(r) for r in rates))
    return _effects(spark, mice.unpivot(["level", "timepoint", "mouse"], rates, "endpoint", "v"), ["level", "endpoint"], "v")


@query(f"WITH {_C} SELECT level, endpoint, {_OUT} FROM e2")
def family_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_family_c_effects(spark, sf_dir))


_MAP = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in endpoints.LINEAGE_OF.items()) + ") AS mp(t, l)"
_KEYS = "family, axis, endpoint, label, g1, g2"


@query(f"""WITH fa AS MATERIALIZED (WITH {_A}, {_A_FLAGS} SELECT * FROM af), f2 AS MATERIALIZED (WITH {_A2}, {_PAIRS}, {effects_sql('kl', 'clr', ['category'])} SELECT * FROM e2), fb AS MATERIALIZED (WITH {_B} SELECT * FROM e2 WHERE basis = 'sigmoid'), fc AS MATERIALIZED (WITH {_C} SELECT * FROM e2),
bn AS (SELECT axis, label, endpoint, g1, g2, count(*) AS k FROM fb GROUP BY ALL),
al AS (SELECT 'A' AS family, 'first' AS axis, category AS endpoint, NULL::VARCHAR AS label, g1, g2, g, shrunk, bad, magnitude_disagree, NULL::BOOLEAN AS support_sensitive FROM fa UNION ALL SELECT 'A', 'second', category, NULL, g1, g2, g, shrunk, bad, NULL, NULL FROM f2
UNION ALL SELECT 'B', fb.axis, fb.endpoint, fb.label, fb.g1, fb.g2, g, shrunk, bad, NULL, k < 3 FROM fb JOIN bn ON bn.axis = fb.axis AND bn.label = fb.label AND bn.endpoint = fb.endpoint AND bn.g1 = fb.g1 AND bn.g2 = fb.g2 WHERE min_support = 20 UNION ALL SELECT 'C', 'first', endpoint, NULL, g1, g2, g, shrunk, bad, NULL, NULL FROM fc WHERE level = 75),
fl AS (SELECT 'A' AS family, category AS endpoint, g1, g2, flips FROM fa UNION ALL SELECT 'B', endpoint, g1, g2, count(DISTINCT sign(g)) > 1 FROM fb GROUP BY endpoint, g1, g2 UNION ALL SELECT 'C', endpoint, g1, g2, count(DISTINCT sign(g)) > 1 FROM fc GROUP BY endpoint, g1, g2),
ru AS MATERIALIZED (SELECT al.*, coalesce(flips, false) AS threshold_sensitive, CASE al.family WHEN 'A' THEN coalesce(abs(g) > 0.5, false) AND NOT coalesce(bad, false) AND NOT coalesce(magnitude_disagree, false) WHEN 'B' THEN coalesce(abs(shrunk) > 0.5, false) AND NOT coalesce(bad, false) AND NOT coalesce(support_sensitive, false) ELSE coalesce(abs(shrunk) > 0.5, false) AND NOT coalesce(bad, false) END AS rule_pass
FROM al LEFT JOIN fl ON fl.family = al.family AND fl.endpoint = al.endpoint AND fl.g1 = al.g1 AND fl.g2 = al.g2),
wi AS (SELECT DISTINCT family, CASE WHEN family = 'A' THEN '-' ELSE endpoint END AS e, CASE WHEN family = 'A' THEN endpoint ELSE regexp_replace(label, '^c:', '') END AS l, g1, g2 FROM ru WHERE axis = 'first' AND rule_pass),
de AS (SELECT ru.*, axis = 'second' AND rule_pass AND EXISTS (SELECT 1 FROM wi WHERE wi.family = ru.family AND wi.g1 = ru.g1 AND wi.g2 = ru.g2 AND wi.e = CASE WHEN ru.family = 'A' THEN '-' ELSE ru.endpoint END AND ((ru.family = 'B' AND wi.l = ru.label) OR wi.l = (SELECT l FROM {_MAP} WHERE t = CASE WHEN ru.family = 'A' THEN ru.endpoint ELSE ru.label END))) AS clash FROM ru)
SELECT {_KEYS}, round(g, 6) AS hedges_g, round(shrunk, 6) AS g_shrunk_neutral, threshold_sensitive, rule_pass, CASE WHEN clash THEN 'cross_axis_co_headline_forbidden' END AS demoted_reason, rule_pass AND NOT clash AS is_headline FROM de""")
def endpoint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a1 = staged(_family_a_flagged(spark, sf_dir), "summary-a")
    a2 = _effects(spark, _type_subjects(spark, sf_dir), ["category"], "clr")
    b = staged(_family_b_effects(spark, sf_dir).filter("basis = 'sigmoid'"), "summary-b")
    c = staged(_family_c_effects(spark, sf_dir), "summary-c")
    on = ["axis", "label", "endpoint", "g1", "g2"]
    supports = b.groupBy(*on).agg((F.count(F.lit(1)) < len(SUPPORTS)).alias("support_sensitive"))
    cols = ["family", "axis", "endpoint", "label", "g1", "g2", "hedges_g", "g_shrunk_neutral", "g_pathological"]
    tag = lambda df, family, axis: df.withColumns({"family": F.lit(family), "axis": axis, "endpoint": F.col("endpoint") if "endpoint" in df.columns else F.col("category"), "label": F.col("label") if "label" in df.columns else F.lit(None).cast("string")})
    families = [
        tag(a1, "A", F.lit("first")).select(*cols, "magnitude_disagree"), tag(a2, "A", F.lit("second")).select(*cols),
        tag(b.filter("min_support = 20").join(supports, on), "B", F.col("axis")).select(*cols, "support_sensitive"), tag(c.filter("level = 75"), "C", F.lit("first")).select(*cols),
    ]
    key = ["family", "endpoint", "g1", "g2"]
    flips = tag(a1, "A", F.lit("first")).select(*key, "threshold_sensitive")
    for df, family in ((b, "B"), (c, "C")):
        flips = flips.unionByName(endpoints.sign_flips(df.withColumn("family", F.lit(family)), key))
    out = endpoints.summary(families, staged(flips, "summary-flips"))
    return rounded(out.select("family", "axis", "endpoint", "label", "g1", "g2", "hedges_g", "g_shrunk_neutral", "threshold_sensitive", "rule_pass", "demoted_reason", "is_headline"))

