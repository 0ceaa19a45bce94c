"""Prefix trie of conversations, built level by level.

A node is a distinct sequence of first turns; its name is its depth and the smallest conv_id of those that start with
it. At each depth the conversations that still share their node are grouped by (node, next turn): each group is a
node one deeper. A conversation that is alone in its node shares nothing below it, so that the rest of its path is known
at once and takes no further level; as many levels are built as the longest shared prefix is deep. Then, from the deepest
level up, each level's nodes are joined with what their children add up to.

Turns are compared by the SHA-256 of role and text. Levels are tables in the shared folder.

Numbering the turns of a conversation does not gather it: turns are sorted by range, counted within their range, and
ranges of one conversation are shifted by what earlier ones hold. The conv_ids that end in a node are joined in order
in pieces of at most PIECE ids, and a node's pieces are hashed as a stream.

Defined results: turns are ordered by turn (null first), then role, then their SHA-256; repeated rows are turns like any
other. A null role or text is an empty one. Rows with a null conv_id belong to no conversation and are left out. An empty
table has no node, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.shared import shared_dir, small, staged, table

#: conv_id - conv_id % FAMILY is the conversation that others take their first turns of: crc32 % HEADS of them.
FAMILY, HEADS = 20, 4
#: Ids that are joined at once.
PIECE = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def turns(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, digest, words) of each turn; place: from 0."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = chats.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "words")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for conv in batch.column(0).to_pylist():
                n = n + 1 if conv == last else 0
                last = conv
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())], names=["conv", "digest", "words", "part", "place"])

    numbered = staged(dealt.mapInArrow(number, "conv bigint, digest binary, words bigint, part int, place bigint"), "trie-numbered")
    # Of the conversations that lie in several ranges there are fewer than ranges.
    held = numbered.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    over = held.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts")).filter(F.size("parts") > 1)
    before = F.aggregate(F.filter("parts", lambda p: p["part"] < F.col("at.part")), F.lit(0).cast("bigint"), lambda s, p: s + p["n"])
    shifts = over.select("conv", "parts", F.explode("parts").alias("at")).select("conv", F.col("at.part").alias("part"), before.alias("shift"))
    placed = numbered.join(small(staged(shifts, "trie-shifts")), ["conv", "part"], "left")
    return placed.select("conv", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"), "digest", "words")


def heads(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, words) of each rebuilt turn, depth from 1, and (conv, len) of each conversation, the turnless too."""
    base = F.col("conv") - F.col("conv") % FAMILY
    sizes = own.groupBy("conv").agg(F.max("place").alias("last")).select("conv", (F.col("last") + 1).alias("n"), heads(F.col("conv")).alias("h"), base.alias("base"))
    sizes = staged(sizes, "trie-sizes")
    of_base = sizes.filter(F.col("conv") == F.col("base")).select("base", F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = staged(sizes.join(of_base, "base", "left").select("conv", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-convs")
    first = own.filter((F.col("place") < HEADS - 1) & (F.col("conv") == base)).select(F.col("conv").alias("base"), "place", "digest", "words")
    given = convs.filter("taken > 0").select("conv", "base", "taken").join(first, "base").filter("place < taken").select("conv", (F.col("place") + 1).alias("depth"), "digest", "words")
    kept = own.join(convs.select("conv", "h", "taken"), "conv").filter("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "words")
    made = given.unionByName(kept)
    return staged(made.repartitionByRange("depth", "conv").sortWithinPartitions("depth", "conv"), "trie-turns"), convs.select("conv", "len")


class Levels:
    """Tables by depth in one folder."""

    def __init__(self, spark: SparkSession, name: str, columns: str):
        self.spark, self.columns = spark, columns
        self.path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"

    def put(self, depth: int, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.path}/depth={depth}")
        return self.at(depth)

    def at(self, depth: int) -> DataFrame:
        return self.spark.read.schema(self.columns).parquet(f"{self.path}/depth={depth}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, depth bigint").option("basePath", self.path).parquet(self.path)


def descend(path: DataFrame, convs: DataFrame) -> tuple[Levels, Levels, int]:
    """Nodes and shared paths of each depth, and the deepest depth with nodes.

    nodes: (node, parent, n, words, len), n members; len is that of a lone member. paths: (conv, node, len), of nodes with several members (and the root).
    """
    spark = path.sparkSession
    nodes, paths = Levels(spark, "trie-nodes", "node bigint, parent bigint, n bigint, words bigint, len bigint"), Levels(spark, "trie-paths", "conv bigint, node bigint, len bigint")
    root, n = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    nodes.put(0, spark.createDataFrame([(root, None, n, 0, 0)], nodes.columns))
    live = paths.put(0, convs.select("conv", F.lit(root).cast("bigint").alias("node"), "len"))
    for depth in itertools.count(1):
        going = live.filter(F.col("len") >= depth)
        steps = staged(going.join(path.filter(F.col("depth") == depth).select("conv", "digest", "words"), "conv"), "trie-steps")
        groups = steps.groupBy("node", "digest").agg(F.min("conv").alias("top"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"), F.max("len").alias("len"))
        groups = staged(groups, "trie-groups")
        nodes.put(depth, groups.select(F.col("top").alias("node"), F.col("node").alias("parent"), "n", "words", "len"))
        shared = groups.filter("n > 1").select("node", "digest", "top")
        if shared.isEmpty():
            return nodes, paths, depth
        live = paths.put(depth, steps.join(small(shared), ["node", "digest"]).select("conv", F.col("top").alias("node"), "len"))


def ascend(nodes: Levels, deepest: int) -> DataFrame:
    """(depth, node, parent, n, children, leaves, saved) of the root and of nodes with several members."""
    spark = nodes.spark
    out = Levels(spark, "trie-sums", "node bigint, parent bigint, n bigint, children bigint, leaves bigint, saved bigint")
    below = None
    for depth in range(deepest, -1, -1):
        here = nodes.at(depth)
        alone = here.filter("n = 1 AND parent IS NOT NULL").select("parent", F.lit(1).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved"))
        if depth == deepest:
            below = alone
            continue
        kids = below.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("under"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
        sums = here.filter("n > 1 OR parent IS NULL").join(kids, "node", "left").select("node", "parent", "n", zero("children").alias("children"), F.coalesce("leaves", F.lit(1).cast("bigint")).alias("leaves"), ((F.col("n") - 1) * F.col("words") + zero("under")).alias("saved"))
        below = out.put(depth, sums).select("parent", "leaves", "saved").unionByName(alone)
    return out.all()


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256): the hash of the ascending conv_ids, comma-joined, of each node that conversations end in. ends: (depth, node, conv)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((key[0], pa.int64()), (key[1], pa.int64()), (ids[0], pa.int64()), (",".join(map(str, ids)), pa.string()))], names=["depth", "node", "first", "ids"])

        for batch in batches:
            for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (key != (depth, node) or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                key = (depth, node)
                ids.append(conv)
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((key[0], pa.int64()), (key[1], pa.int64()), (sha.hexdigest(), pa.string()))], names=["depth", "node", "ends_sha256"])
        for batch in batches:
            for depth, node, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == (depth, node):
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    yield out()
                key, sha = (depth, node), hashlib.sha256(ids.encode())
        if key is not None:
            yield out()

    order = ["depth", "node", "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "depth bigint, node bigint, first bigint, ids string")
    streams = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").select("depth", "node", "ids")
    return streams.mapInArrow(digest, "depth bigint, node bigint, ends_sha256 string")


def trie(path: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node, from paths (conv, depth, digest, words), depth from 1, and conversations (conv, len)."""
    if convs.isEmpty():
        return path.sparkSession.createDataFrame([], NODES)
    nodes, paths, deepest = descend(path, convs)
    sums = ascend(nodes, deepest)
    ended = end_digests(paths.all().filter("len = depth"))
    shared = sums.join(ended, ["depth", "node"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    # The rest of the path of a conversation that is alone from some depth on.
    alone = nodes.all().filter("n = 1 AND parent IS NOT NULL").select(F.col("node").alias("conv"), F.col("depth").alias("from"), "parent", "len")
    one, last = F.lit(1).cast("bigint"), F.col("depth") == F.col("len")
    chains = path.select("conv", "depth").join(alone, "conv").filter("depth >= from").select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"))
    return shared.unionByName(chains)


def conversation_trie(chats: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations."""
    return trie(*rebuilt(turns(chats)))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: unicode(x)::BIGINT)), lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295::BIGINT)"
OP13_SQL = rf"""
WITH said AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), keyed AS (
  SELECT *, sha256(length(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM said
), own AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, digest) - 1 AS place FROM keyed
), convs AS (
  SELECT c, c - c % {FAMILY} AS base, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT c FROM own)
), bases AS (
  SELECT v.c, v.h, v.base, least(v.h, coalesce(b.n, 0)) AS taken FROM convs v LEFT JOIN (SELECT c, count(*) AS n FROM own GROUP BY c) b ON b.c = v.base
), path AS (
  SELECT v.c, o.place + 1 AS depth, o.digest, o.words FROM bases v JOIN own o ON o.c = v.base AND o.place < v.taken
  UNION ALL SELECT v.c, o.place - v.h + v.taken + 1, o.digest, o.words FROM bases v JOIN own o ON o.c = v.c AND o.place >= v.h
), prefixes AS (
  SELECT c, depth, string_agg(digest, ',') OVER (PARTITION BY c ORDER BY depth) AS key, words FROM path
  UNION ALL SELECT c, 0, '', 0 FROM convs
), lens AS (
  SELECT c, max(depth) AS len FROM prefixes GROUP BY c
), nodes AS (
  SELECT depth, key, min(c) AS conv_id, count(*) AS n, max(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = depth), '')) AS ends
  FROM prefixes JOIN lens USING (c) GROUP BY depth, key
), placed AS (
  SELECT n.*, p.key AS parent_key, q.conv_id AS parent FROM nodes n
  LEFT JOIN prefixes p ON p.c = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes q ON q.depth = p.depth AND q.key = p.key
), kids AS (
  SELECT depth - 1 AS depth, parent_key AS key, count(*) AS children FROM placed WHERE depth > 0 GROUP BY 1, 2
), full_nodes AS (
  SELECT placed.*, coalesce(children, 0) AS children FROM placed LEFT JOIN kids USING (depth, key)
), sums AS (
  SELECT p.depth, p.key, sum(CASE WHEN f.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.words) AS saved
  FROM full_nodes f JOIN prefixes p ON p.c = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.key
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, CAST(children AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM full_nodes JOIN sums USING (depth, key)
"""
