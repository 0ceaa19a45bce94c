"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

Texts are lower-cased runs of letters and digits. A mask keeps some of the positions of a
window of ten tokens and ignores the others, so that one seed still hits where ignored tokens
were replaced. The seeds of every window of every document are joined with those of the
benchmark. A hit fixes how document and item lie against each other; along that line the best
run is scored, one for each token that agrees and `PENALTY` off for each that does not, which
tolerates replaced tokens and ends where the texts part. A pair is reported if its best run
scores `MIN_SCORE` or, for a shorter item, its whole length.

Items of the same tokens are looked for once, and told apart only in the report. What is broadcast is
measured in bytes first; beyond the limit a shuffle joins it.

Defined results: null texts have no tokens and match nothing; so do items and documents of
fewer than ten tokens. Of repeated items, each is reported. A document is what its id and text say: rows equal
in both are reported once, rows of one id and different texts each for itself, under the same id. If the best run lies on
several lines, the first of them is told. Texts of any length are read whole. Empty tables give an empty report, and
`decontaminate` then keeps all rows. Other columns are carried along by it whatever their names, and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.shared import fresh, small, staged, table

MASKS = ("1110101101", "1101110011", "1011011101")
SPAN = 10
PENALTY, MIN_SCORE = 2, 12
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def seeds(rows: DataFrame) -> DataFrame:
    """(key, at, seed) of every window and mask. rows: (key, tokens)."""
    kept = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
    at_start = lambda i: F.array(*(F.xxhash64(F.lit(m), *(F.get("tokens", i + p) for p in where)) for m, where in enumerate(kept)))
    windows = F.flatten(F.transform(F.sequence(F.lit(0), F.size("tokens") - SPAN), at_start))
    return rows.filter(F.size("tokens") >= SPAN).select("key", F.posexplode(windows).alias("place", "seed")).select("key", F.expr(f"place div {len(MASKS)}").cast("int").alias("at"), "seed")


def _score(shift: str) -> Column:
    """Best run along the line on which the document's token at + shift lies at the item's token at."""
    low = F.greatest(-F.col(shift), F.lit(0))
    n = F.greatest(F.least(F.size("item_tokens"), F.size("tokens") - F.col(shift)) - low, F.lit(0))
    agree = F.zip_with(F.slice("tokens", low + F.col(shift) + 1, n), F.slice("item_tokens", low + 1, n), lambda x, y: F.when(x == y, 1).otherwise(-PENALTY))
    step = lambda acc, x: F.struct(F.greatest(acc["run"] + x, F.lit(0)).alias("run"), F.greatest(acc["best"], acc["run"] + x).alias("best"))
    return F.aggregate(agree, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda acc: acc["best"])


def identity(id_: Column, text: Column) -> Column:
    """What a document is known by: its id, if it has one, and a hash of its text."""
    return F.concat_ws("#", id_.cast("string"), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, shift) of each document and benchmark item that share a passage."""
    found = leaks_by_key(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return found.select("doc_id", "item_id", "score", "shift")


def leaks_by_key(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(key, doc_id, item_id, score, shift), key the document's identity."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = staged(benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("tokens")).withColumn("item", F.xxhash64("tokens")).distinct(), "leak-items")
    by_item = items.groupBy("item", "tokens").agg(F.collect_set("item_id").alias("item_ids"), F.count_if(F.col("item_id").isNull()).alias("nulls"))
    by_item = staged(by_item.withColumn("item_ids", F.when(F.col("nulls") > 0, F.concat("item_ids", F.array(F.lit(None).cast(items.schema["item_id"].dataType)))).otherwise(F.col("item_ids"))).drop("nulls"), "leak-texts")
    of_items = seeds(by_item.select(F.col("item").alias("key"), "tokens")).select("seed", F.col("at").alias("item_at"), F.col("key").alias("item"))
    looked_up = small(staged(of_items.distinct(), "leak-seeds"))
    of_docs = seeds(texts.select(identity(F.col("doc_id"), F.col("text")).alias("key"), tokens(F.col("text")).alias("tokens")))
    hits = of_docs.join(looked_up, "seed").select("key", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = staged(hits, "leak-hits")
    hit_docs = texts.withColumn("key", identity(F.col("doc_id"), F.col("text"))).join(small(staged(hits.select("key").distinct(), "leak-docs")), "key").dropDuplicates(["key"]).select("key", "doc_id", tokens(F.col("text")).alias("tokens"))
    lined = hits.join(small(by_item.select("item", F.col("tokens").alias("item_tokens"))), "item").join(hit_docs, "key").withColumn("score", _score("shift"))
    found = lined.filter(F.col("score") >= F.least(F.lit(MIN_SCORE), F.size("item_tokens")))
    best = found.groupBy("key", "item").agg(F.max(F.struct("score", (-F.col("shift")).alias("back"))).alias("best"), F.first("doc_id").alias("doc_id"))
    each = best.join(small(by_item.select("item", "item_ids")), "item").withColumn("item_id", F.explode("item_ids"))
    return each.select("key", "doc_id", "item_id", F.col("best.score").alias("score"), (-F.col("best.back")).alias("shift"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that share no passage with the benchmark, each judged by its own text."""
    key = fresh(docs, "_q_key")
    leaks = staged(leaks_by_key(docs, benchmark, id_col, text_col, "item_id", "text").select(F.col("key").alias(key)).distinct(), "leak-keys")
    return docs.join(small(leaks), identity(docs[id_col], docs[text_col]) == F.col(key), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _seed_sql(source: str) -> str:
    at = lambda mask: " || ' ' || ".join(f"t[i + {p + 1}]" for p, c in enumerate(mask) if c == "1")
    return " UNION ALL ".join(f"SELECT * EXCLUDE (t), '{m}' || {at(mask)} AS seed FROM (SELECT *, unnest(range(0, len(t) - {SPAN - 1})) AS i FROM {source})" for m, mask in enumerate(MASKS))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM benchmark),
ds AS ({_seed_sql("d")}),
bs AS ({_seed_sql("b")}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS shift FROM ds JOIN bs USING (seed)),
lined AS (
  SELECT doc_id, item_id, shift, d.t AS dt, b.t AS bt,
         unnest(range(greatest(-shift, 0), least(len(b.t), len(d.t) - shift))) AS j
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
), summed AS (
  SELECT doc_id, item_id, shift, j, len(bt) AS n,
         sum(CASE WHEN dt[j + shift + 1] = bt[j + 1] THEN 1 ELSE -{PENALTY} END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS c
  FROM lined
), runs AS (
  SELECT doc_id, item_id, shift, n, c - least(0, coalesce(min(c) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS run
  FROM summed
), scored AS (SELECT doc_id, item_id, shift, n, max(run) AS score FROM runs GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(score) AS INTEGER) AS score, CAST(arg_max(shift, (score, -shift)) AS INTEGER) AS shift
FROM scored WHERE score >= least({MIN_SCORE}, n) GROUP BY doc_id, item_id
"""
