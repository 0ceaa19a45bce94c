"""Exact deduplication over an extendible-hash index kept as files in the shared folder.

Every text has a 64-bit key. A directory over the leading key bits doubles, from one bucket on,
until no bucket holds more keys than its capacity, or all of its bits are used. Directory slots
point to buckets; a bucket that was not split is pointed to by several. The entries are dealt
to owner tasks by ranges of bucket and key. An owner chains the texts of each of its keys: it compares
them byte by byte, merges equal ones, numbers different ones, and writes its part of the index
as files sorted by bucket and key. Documents find their bucket through the directory and their
entry in the bucket by key; where a chain holds several texts, by comparing bytes.

A key of a single row has nothing to be compared with, so its entry is made without its text.
Texts of keys with several rows are merged within salted parts first, so that a group of copies,
however large, reaches its owner as a few rows.

Defined results: a null text counts as empty. Rows of equal doc_id and text are one document;
the report flags each of them alike, `deduplicate` returns one. Null doc_ids lose to any other
id; if a group has only null ids, keep_id is null and its rows are flagged kept. An empty table
gives an empty report. Other columns are never read by the report, and carried along by
`deduplicate` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.shared import fresh, small, staged, table

#: Keys that a bucket may hold; more if there would be over MOST buckets, so that the driver can hold the directory.
CAPACITY, MOST = 4_096, 1 << 19
#: Bits by which the directory looks deeper at once at most, and bits of a key.
STEP_BITS, KEY_BITS = 20, 64
#: Parts that rows of one key are merged in before they go to its owner.
SALTS = 16


def leading(key: Column, bits: int) -> Column:
    """The leading bits of a 64-bit key."""
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("bigint")


def split(prefix: int, depth: int, counts: dict[int, int], bits: int, capacity: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """The buckets (prefix, depth) that a bucket splits into, and those that are overfull still at depth + bits, with their keys.

    counts: keys by the `bits` that follow the prefix.
    """
    done, overfull, open_ = [], [], [(prefix, depth, sorted(counts.items()))]
    while open_:
        at, deep, inside = open_.pop()
        if (n := sum(n for _, n in inside)) <= capacity:
            done.append((at, deep))
        elif deep == depth + bits:
            overfull.append((at, deep, n))
        else:
            bit = 1 << (depth + bits - deep - 1)
            open_ += [(at * 2 + half, deep + 1, [x for x in inside if bool(x[0] & bit) == bool(half)]) for half in (0, 1)]
    return done, overfull


def directory(keys: DataFrame, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """The buckets (prefix, depth) of a table of distinct keys, in key order: together they hold every key once.

    The driver sees counts by prefix: of all keys by as many bits as they need if they are spread evenly, and by
    further bits of what is overfull then.
    """
    total = keys.count()
    capacity = max(capacity, -(-total // MOST))
    buckets, by_depth = [], {0: [(0, total)]} if total > capacity else {}
    if not by_depth:
        return [(0, 0)]
    while by_depth:
        depth = min(by_depth)
        overfull = by_depth.pop(depth)
        bits = min(STEP_BITS, KEY_BITS - depth, math.ceil(math.log2(max(n for _, n in overfull) / capacity)) + 1)
        if depth == KEY_BITS:  # all bits are used: one key
            buckets += [(p, depth) for p, _ in overfull]
            continue
        prefix, then = leading(F.col("key"), depth), F.pmod(leading(F.col("key"), depth + bits), F.lit(1 << bits))
        asked = keys if depth == 0 else keys.filter(prefix.isin([p for p, _ in overfull]))
        found: dict[int, dict[int, int]] = {}
        for r in asked.groupBy(prefix.alias("prefix"), then.alias("then")).agg(F.count(F.lit(1)).alias("n")).collect():
            found.setdefault(r["prefix"], {})[r["then"]] = r["n"]
        for p, _ in overfull:
            done, more = split(p, depth, found.get(p, {}), bits, capacity)
            buckets += done
            for at, deep, n in more:
                by_depth.setdefault(deep, []).append((at, n))
    return sorted(buckets, key=lambda b: (b[0] % (1 << b[1])) << (KEY_BITS - b[1]))


def in_buckets(rows: DataFrame, buckets: list[tuple[int, int]]) -> DataFrame:
    """rows with the `bucket` that the directory's slot for their key points to.

    Buckets of one depth are slots of one size: one look-up for each depth that occurs, mostly two or three.
    """
    spark = rows.sparkSession
    depths = sorted({d for _, d in buckets})
    signed = lambda p: p - (1 << KEY_BITS) if p >> (KEY_BITS - 1) else p
    slots = spark.createDataFrame([(d, signed(p), i) for i, (p, d) in enumerate(buckets)], "_depth int, _prefix bigint, _bucket int")
    found = rows
    for d in depths:
        of = slots.filter(F.col("_depth") == d).select(F.col("_prefix").alias(f"_p{d}"), F.col("_bucket").alias(f"_b{d}"))
        found = found.join(small(of), leading(F.col("key"), d) == F.col(f"_p{d}"), "left").drop(f"_p{d}")
    return found.withColumn("bucket", F.coalesce(*(f"_b{d}" for d in depths))).drop(*(f"_b{d}" for d in depths))


def build_index(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The index (bucket, key, chain, chain_length, keep_id, group_size, text), one entry for each distinct text, and its directory.

    text is kept where a chain has several entries, to be compared with.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", key(F.col("text")))
    keys = staged(texts.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id")), "dedup-keys")
    buckets = directory(keys, capacity)
    alone = keys.filter("group_size = 1").select("key", F.lit(None).cast("string").alias("text"), "keep_id", "group_size")
    several = staged(keys.filter("group_size > 1").select("key"), "dedup-several")
    salted = texts.join(small(several), "key", "left_semi").groupBy("key", "text", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    merged = salted.agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop("salt")
    dealt = in_buckets(alone.unionByName(merged), buckets)
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = dealt.repartitionByRange(owners, "bucket", "key")
    # Within an owner: equal texts of a key are merged, different ones are links of its chain.
    entries = owned.groupBy("bucket", "key", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chain = Window.partitionBy("bucket", "key")
    numbered = entries.withColumns({"chain": F.row_number().over(chain.orderBy("text")), "chain_length": F.count(F.lit(1)).over(chain)})
    kept = numbered.withColumn("text", F.when(F.col("chain_length") > 1, F.col("text")))
    return staged(kept.sortWithinPartitions("bucket", "key", "chain"), "dedup-index"), buckets


def look_up(rows: DataFrame, index: DataFrame, buckets: list[tuple[int, int]]) -> DataFrame:
    """rows (id, key, sha, text) with keep_id and group_size of their entry; text is read of those alone whose chain holds several."""
    placed = in_buckets(rows, buckets)
    entry = index.select("bucket", "key", "keep_id", "group_size")
    chained = index.filter("chain_length > 1")
    if chained.isEmpty():
        return placed.drop("text").join(entry, ["bucket", "key"])
    shared = small(staged(chained.select("bucket", "key").distinct(), "dedup-chained"))
    plain = placed.join(shared, ["bucket", "key"], "left_anti").drop("text").join(entry, ["bucket", "key"])
    of_chain = chained.select("bucket", "key", F.col("text").alias("_text"), "keep_id", "group_size")
    compared = placed.join(shared, ["bucket", "key"], "left_semi").join(of_chain, ["bucket", "key"]).filter(F.col("text") == F.col("_text")).drop("text", "_text")
    return plain.unionByName(compared)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    index, buckets = build_index(docs, id_col, text_col, capacity, key)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", "text", key(F.col("text")).alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    found = look_up(rows, index, buckets)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    id_, sha_ = fresh(docs, "_q_id"), fresh(docs, "_q_sha")
    verdicts = staged(report(docs, id_col, text_col, capacity).select(F.col("doc_id").alias(id_), "kept", F.col("text_sha256").alias(sha_)), "dedup-verdicts")
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)
    dropped = verdicts.filter(~F.col("kept")).select(id_, sha_).distinct()
    repeated = staged(verdicts.filter("kept").groupBy(id_, sha_).count().filter("count > 1").select(id_, sha_), "dedup-repeated")
    same = [docs[id_col].eqNullSafe(F.col(id_)), sha == F.col(sha_)]
    stay = docs.join(small(staged(dropped, "dedup-dropped")), same, "left_anti")
    if repeated.isEmpty():
        return stay
    repeated = small(repeated)
    return stay.join(repeated, same, "left_anti").unionByName(stay.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
