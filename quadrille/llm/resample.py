"""Quality by importance resampling.

Two generative models over hashed n-grams, one of the target texts and one of all raw texts, give
each document the log of their likelihood ratio. Gumbel noise, drawn by a hash of the id, is
added, and the documents with the largest sums are taken: a sample without replacement in
proportion to the ratios. The raw model counts every document. The target model counts a bounded
sample of the labelled ones, at most about TARGET of them, picked by a hash of the id.

The k-th largest sum is found by counting ever narrower bins, so no sort gathers the rows.

Defined results: null texts and texts without words have a ratio of one (log 0). Labels of null
or unknown ids, or without a quality, are passed over; repeated labels count once. Rows with
equal sums, such as repeated rows, stand or fall together, so that more than k may be taken.
Without target texts every log ratio is 0 and the sample is even. An empty table gives an
empty report.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.shared import drawn, staged, table

BUCKETS = 10_000
TARGET = 20_000
SHARE = 0.5
SMOOTHING = 1.0
WORD = re.compile(r"\w+")
BINS, FEW = 1_000, 10_000
#: Odd multiplier that tells the first word of a bigram from the second.
FIRST = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Hash of each word; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


def buckets(text: str | None, hashes: Hashes) -> np.ndarray:
    """Buckets of the words and word pairs of a text."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return (np.concatenate([h, h[:-1] * FIRST + h[1:]]) % np.uint64(BUCKETS)).astype(np.int64)


def count_buckets(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target) counts. docs: (text, is_target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = Hashes(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1)):
                found = np.bincount(buckets(text.as_py(), hashes), minlength=BUCKETS)
                counts[0] += found
                if target.as_py():
                    counts[1] += found
        some = np.nonzero(counts.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["bucket", "raw", "target"])

    parts = docs.select("text", "is_target").mapInArrow(run, "bucket bigint, raw bigint, target bigint")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(docs: DataFrame, target_ids: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Log of target over raw probability of each bucket. target_ids: (id), of bounded size."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(target_ids.withColumn("is_target", F.lit(True))), "id", "left")
    counts = np.zeros((2, BUCKETS))
    for r in count_buckets(named).collect():  # one row a bucket at most
        counts[:, r["bucket"]] = r["raw"], r["target"]
    if not counts[1].any():
        return np.zeros(BUCKETS)
    raw, target = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    return np.log(target) - np.log(raw)


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, log_weight) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            weights = [float(ratios[buckets(t.as_py(), hashes)].sum()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64())], names=["doc_id", "log_weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, log_weight double")


def kth_largest(rows: DataFrame, col: str, k: int) -> float:
    """The k-th largest value of a column without nulls, by counting in bins that narrow around it."""
    low, high = rows.agg(F.min(col), F.max(col)).first()
    inside = rows.select(F.col(col).alias("v"))
    while low < high:
        width = (high - low) / BINS
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).alias("at")
        counts = {r["at"]: r for r in inside.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
        for i in sorted(counts, reverse=True):
            if k <= counts[i]["n"]:
                break
            k -= counts[i]["n"]
        n, low, high = counts[i]["n"], counts[i]["low"], counts[i]["high"]
        inside = inside.filter(F.col("v").between(low, high))
        if n <= FEW:
            return sorted((r["v"] for r in inside.collect()), reverse=True)[k - 1]
    return low


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, seed: int = 7, target: int = TARGET) -> DataFrame:
    """(doc_id, log_weight, priority, selected) of each row; labels: (id, quality 0/1, toxic 0/1)."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct()
    part = min(1.0, target / max(1, good.count()))
    ratios = log_ratios(docs, good.filter(drawn(F.lit(part), "id")), id_col, text_col)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    scored = staged(weigh(docs, ratios, id_col, text_col).withColumn("priority", F.col("log_weight") - F.log(-F.log(uniform))), "resample-weights")
    n = scored.count()
    if not n:
        return scored.withColumn("selected", F.lit(True))
    least = kth_largest(scored, "priority", max(1, round(share * n)))
    return scored.withColumn("selected", F.col("priority") >= least)


def op6_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
