"""What the plans share: registration, rounding at the edge, annotated superpixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.rounding import tidy, tidy_sql
from quadrille.operators import gating, thresholds
from quadrille.sources import virtual

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = tidy_sql(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded at the edge of a plan, where results are compared."""
    return df.withColumns({c: tidy(c, digits) for c, t in df.dtypes if t in ("double", "float")})


def units(spark: SparkSession, sf_dir: str, scale: int = 10) -> DataFrame:
    """Superpixels with stabilised markers and their place in the design."""
    return virtual.with_design(virtual.expression(virtual.superpixels(spark, sf_dir, scale)))


def reference(df: DataFrame) -> DataFrame:
    """Control-group reference of the panel, rounded so that both engines compare alike."""
    long = thresholds.unpivoted(df, ["timepoint", "mouse"], virtual.MARKERS)
    made = thresholds.reference_distribution(long, 60.0, {"cd206": 50.0, "ly6g": 70.0})
    return made.select("marker", F.round("threshold", 9).alias("threshold"), F.round("scale", 9).alias("scale"))


def scored(spark: SparkSession, sf_dir: str, scale: int = 10) -> DataFrame:
    """Units with lineage, subtype and activation scores."""
    df = units(spark, sf_dir, scale)
    return gating.memberships(gating.sigmoids(df, reference(df), virtual.MARKERS))


LONG_SQL = "SELECT roi, spx, timepoint, mouse, region, marker, value FROM (UNPIVOT ex ON " + ", ".join(virtual.MARKERS) + " INTO NAME marker VALUE value)"
REFERENCE_SQL = f"""long AS ({LONG_SQL}),
per_mouse AS (
  SELECT marker, mouse, CASE marker WHEN 'cd206' THEN quantile_cont(value, 0.5) WHEN 'ly6g' THEN quantile_cont(value, 0.7) ELSE quantile_cont(value, 0.6) END AS t
  FROM long WHERE timepoint = 'Sham' GROUP BY marker, mouse),
ref AS (
  SELECT marker, round(threshold, 9) AS threshold, round(CASE WHEN iqr >= 1e-6 THEN iqr WHEN quarter >= 1e-6 THEN quarter ELSE 1e-6 END, 9) AS scale
  FROM (SELECT marker, avg(t) AS threshold FROM per_mouse GROUP BY marker)
  JOIN (SELECT marker, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, (max(value) - min(value)) / 4 AS quarter FROM long GROUP BY marker) USING (marker))"""


def _sigmoid_sql(m: str) -> str:
    t, s = (f"(SELECT {c} FROM ref WHERE marker = '{m}')" for c in ("threshold", "scale"))
    return f"1 / (1 + exp(-greatest(least(10.0 / greatest({s}, 1e-6) * ({m} - {t}), 500.0), -500.0)))"


SCORED_SQL = f"""{virtual.BASE_SQL}, {REFERENCE_SQL},
sig AS (SELECT *, {", ".join(f"{_sigmoid_sql(m)} AS s_{m}" for m in virtual.MARKERS)} FROM ex),
lin AS (SELECT *, round(s_cd45, 9) AS lineage_immune, round((s_cd31 + s_cd34) / 2, 9) AS lineage_endothelial, round(s_cd140a, 9) AS lineage_stromal,
        round(s_cd44, 9) AS activation_cd44, round(s_cd140b, 9) AS activation_cd140b FROM sig),
sub AS (SELECT *, round(CASE WHEN lineage_immune >= 0.3 THEN s_ly6g ELSE 0 END, 9) AS u1, round(CASE WHEN lineage_immune >= 0.3 THEN pow(s_cd11b * s_cd206, 0.5) ELSE 0 END, 9) AS u2,
        round(CASE WHEN lineage_immune >= 0.3 THEN pow(s_cd11b * (1 - s_cd206) * (1 - s_ly6g), 1.0 / 3) ELSE 0 END, 9) AS u3,
        round(CASE WHEN lineage_immune >= 0.3 THEN pow((1 - s_cd11b) * (1 - s_ly6g), 0.5) ELSE 0 END, 9) AS u4 FROM lin),
scored AS (SELECT *, CASE WHEN greatest(u1, u2, u3, u4) <= 0 THEN 'none' WHEN u1 = greatest(u1, u2, u3, u4) THEN 'neutrophil' WHEN u2 = greatest(u1, u2, u3, u4) THEN 'm2_macrophage'
        WHEN u3 = greatest(u1, u2, u3, u4) THEN 'myeloid' ELSE 'non_myeloid_immune' END AS subtype,
        coalesce(nullif(concat_ws('+', CASE WHEN lineage_endothelial > 0.3 THEN 'endothelial' END, CASE WHEN lineage_immune > 0.3 THEN 'immune' END, CASE WHEN lineage_stromal > 0.3 THEN 'stromal' END), ''), 'none') AS interface FROM sub)"""


def scored_sql(scale: int) -> str:
    """SCORED_SQL over units of another scale."""
    return SCORED_SQL.replace(virtual.superpixel_sql(), virtual.superpixel_sql(scale))


def lineages() -> dict:
    return {n: F.col(f"lineage_{n}") for n in gating.LINEAGES}


def with_interface(df: DataFrame) -> DataFrame:
    return df.withColumn("interface", gating.interface(lineages()))


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"
