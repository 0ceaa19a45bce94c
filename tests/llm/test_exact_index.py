"""The index with keys that are made to collide: chains, bytes compared, buckets split as far as keys allow."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from quadrille.llm import exact_dedup

KIND = "doc_id bigint, text string"
TEXTS = ["aa", "bb", "cc", "a", "b", "abc", "abd", "aa", "bb", None, "", "abcd", "aa", "x" * 5_000, "y" * 5_000]
ROWS = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "aa"), (None, "only null ids"), (7, "aa")]


def length(text):
    return F.length(text).cast("bigint") % 7


def wanted():
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    out = []
    for i, t in ROWS:
        keep = max((x for x in groups[t or ""] if x is not None), default=None)
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("key", [length, lambda text: F.lit(-1).cast("bigint"), F.xxhash64], ids=["length", "one key", "hash"])
@pytest.mark.parametrize("capacity", [4_096, 1])
def test_colliding_keys(spark, key, capacity):
    docs = spark.createDataFrame(ROWS, KIND)
    got = exact_dedup.report(docs, capacity=capacity, key=key).collect()
    assert sorted((tuple(r) for r in got), key=str) == wanted()


def test_index_holds_what_it_says(spark):
    docs = spark.createDataFrame(ROWS, KIND)
    index, buckets = exact_dedup.build_index(docs, "doc_id", "text", 1, length)
    rows = index.collect()
    assert len(rows) == len({t or "" for _, t in ROWS}) and sum(r["group_size"] for r in rows) == len(ROWS)
    by_key = collections.defaultdict(list)
    for r in rows:
        by_key[r["key"]].append(r)
        prefix, depth = buckets[r["bucket"]]
        assert depth == 0 or (r["key"] >> (64 - depth)) == prefix
    assert len({r["bucket"] for r in rows}) == len(by_key)  # a bucket holds one key, as capacity asks
    for chain in by_key.values():
        assert sorted(r["chain"] for r in chain) == list(range(1, len(chain) + 1)) and all(r["chain_length"] == len(chain) for r in chain)
        assert all((r["text"] is None) == (len(chain) == 1) for r in chain)


def test_directory_covers_every_key_once(spark):
    keys = spark.range(3_000).select(F.xxhash64("id").alias("key"))
    buckets = exact_dedup.directory(keys, 16)
    assert sum(2.0**-d for _, d in buckets) == 1.0
    sizes = exact_dedup.in_buckets(keys, buckets).groupBy("bucket").count().toPandas()
    assert sizes["count"].sum() == 3_000 and sizes["count"].max() <= 16
    assert exact_dedup.directory(keys.limit(0), 16) == [(0, 0)]
