"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints are made in one scan. Each distinct fingerprint is put into a tile by the
population counts of its bands (contiguous runs of bits). Two fingerprints that differ in r
bits have band counts that differ by r in all at most, so a pair of tiles whose counts differ
by more than the radius is skipped; every other pair is compared exactly with numpy's
exclusive-or and bit counts. A task that compares emits, not the linked pairs, but for each
fingerprint one link to the smallest of those it is connected to within the batch; components
come from these links by large-star and small-star rounds. Every pair of blocks is a key of its
own, so that a tile that holds many fingerprints is compared by many tasks.

Defined results: null and word-less texts have fingerprint zero and link like any other.
Repeated rows each get a row with the same answer. A null doc_id gets a row; it never names a
component unless its component has no other id. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.shared import fresh, holding, modest, small, staged, table

SEED = 42
#: A tile of n fingerprints is cut in blocks of BLOCK, or of SPREAD times the root of n if that is more: a block meets each
#: other one, so that blocks of a fixed size would be copied n times; pairs that are compared at once in memory.
BLOCK, SPREAD = 1024, 32
PAIRS = 1 << 18
#: Base of one digit of a tile number: over twice the largest count plus the largest radius.
BASE = 256
#: 64-bit words of the fingerprints that near-duplicates are found by.
WORDS = 4
#: A group of so many rows and shingle hashes at most is settled whole in one task; a larger one in rounds.
GROUP_ROWS, GROUP_HASHES = 256, 1 << 22
#: Heads that a large group's members are compared with in one round: so many in the first, STEP times more in each further one, HEADS at most.
STEP, HEADS = 16, 256
#: Odd multiplier that mixes the hashes for the further words of a fingerprint.
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word shingles, repeats included; a text of fewer words is one shingle, of no words none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(width)))))


def fingerprint(grams: list[bytes], n_words: int = 1) -> list[int]:
    """SimHash as signed 64-bit words: a bit is set if it is set in over half of the hashes. Words after the first take the hashes mixed anew."""
    ones = np.zeros((n_words, 64), np.int64)
    for at in range(0, len(grams), 65_536):
        part = grams[at : at + 65_536]
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in part), np.uint64, len(part))
        for w in range(n_words):
            ones[w] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(31))) * MIX
            h ^= h >> np.uint64(29)
    return np.packbits(2 * ones > len(grams), axis=1, bitorder="little").view(np.int64).ravel().tolist()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, fp) for each row: the 64-bit fingerprint of its shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingles(text.as_py(), width))[0] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return modest(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp bigint")


def neighbour_offsets(bands: int, radius: int, sized: bool) -> list[int]:
    """Differences of tile numbers that can hold links, one of each pair of opposite ones."""
    ball = [v for v in itertools.product(range(-radius, radius + 1), repeat=bands) if sum(map(abs, v)) <= radius]
    number = lambda v: sum(x * BASE**i for i, x in enumerate(v))
    return sorted(o for o in (number((*v, s)) for v in ball for s in ((0, 1, -1) if sized else (0,))) if o >= 0)


def tiles(fps: DataFrame, bands: int, step: int, sized: bool) -> tuple[DataFrame, DataFrame]:
    """Fingerprints in tiles by band counts, `step` counts to a tile, and blocks; and how many blocks those tiles have that have several.

    (tile, block, fps): of each fingerprint its words and its node, flat. (tile, blocks).
    """
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    count = lambda m: F.floor(F.bit_count(F.col("words")[0].bitwiseAND(F.lit(m))) / step).cast("long")
    tile = sum((count(m) * F.lit(BASE**i) for i, m in enumerate(signed)), F.lit(0).cast("long"))
    if sized:
        tile = tile + F.col("size_class") * F.lit(BASE**bands)
    placed = fps.select("fp", "words", tile.alias("tile"))
    n = placed.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    several = staged(n.select("tile", F.ceil(F.col("n") / F.greatest(F.lit(BLOCK), F.ceil(SPREAD * F.sqrt("n")))).alias("blocks")).filter("blocks > 1"), "simhash-blocks")
    block = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).alias("block")
    flat = F.flatten(F.collect_list(F.concat("words", F.array("fp")))).alias("fps")
    return staged(placed.join(small(several), "tile", "left").select("fp", "words", "tile", block).groupBy("tile", "block").agg(flat), "simhash-tiles"), several


def _within(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, oa: np.ndarray, ob: np.ndarray, first: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the linked ones among the pairs of each row's two lists, lists given by offset and length.

    a, b: one row of words a fingerprint. The first words are compared for all pairs, within `first`; all words for those that pass.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    a0, b0 = np.ascontiguousarray(a[:, 0]), np.ascontiguousarray(b[:, 0])

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        if a.shape[1] > 1:
            near = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64) <= radius
            i, j = i[near], j[near]
        found.append((i, j))

    n = la * lb
    large = n > 65_536
    for r in np.nonzero(large)[0]:
        right = b0[ob[r] : ob[r] + lb[r]]
        step = max(1, PAIRS // len(right))
        for at in range(oa[r], oa[r] + la[r], step):
            left = a0[at : min(at + step, oa[r] + la[r])]
            i, j = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= first)
            keep(i + at, j + ob[r])
    rows = np.nonzero(~large)[0]
    ends = np.cumsum(n[rows])
    for start in range(0, int(ends[-1]) if len(rows) else 0, PAIRS):
        k = np.arange(start, min(start + PAIRS, int(ends[-1])))
        at = np.searchsorted(ends, k, side="right")
        row, inside = rows[at], k - (ends[at] - n[rows[at]])
        i, j = oa[row] + inside // lb[row], ob[row] + inside % lb[row]
        hit = np.bitwise_count(a0[i] ^ b0[j]) <= first
        keep(i[hit], j[hit])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the links of a batch: each value but the smallest of its component, with that one."""
    keep = left != right
    nodes, at = np.unique(np.concatenate([left[keep], right[keep]]).view(np.int64), return_inverse=True)
    i, j = at[: keep.sum()], at[keep.sum() :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def links(fps: DataFrame, radius: int, bands: int, sized: bool = False, n_words: int = 1, first: int | None = None) -> DataFrame:
    """(a, b): links that connect exactly what distinct fingerprints within the radius connect.

    fps: (fp, words), fp the node that stands for the words. Fingerprints of several words are tiled by their first,
    which may differ by `first` bits.
    """
    first = radius if first is None else first
    step = 1 if n_words == 1 else first
    all_tiles, several = tiles(fps, bands, step, sized)
    offsets = F.array(*(F.lit(o).cast("long") for o in neighbour_offsets(bands, -(-first // step), sized)))
    probe = all_tiles.select("tile", "block", F.col("fps").alias("a"), F.explode(offsets).alias("offset")).withColumn("want", F.col("tile") + F.col("offset"))
    # A block meets every block of the other tile, and within its own tile those from itself on.
    partners = F.sequence(F.when(F.col("offset") == 0, F.col("block")).otherwise(0), F.coalesce("blocks", F.lit(1)) - 1)
    probe = probe.join(small(several.withColumnRenamed("tile", "want")), "want", "left").select("want", "a", F.explode(partners).alias("partner"))
    other = all_tiles.select(F.col("tile").alias("want"), F.col("block").alias("partner"), F.col("fps").alias("b"))
    pairs = probe.join(other, ["want", "partner"])
    stride = n_words + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = [batch.column(i) for i in (0, 1)]
                value = [x.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, stride) for x in lists]
                length = [np.asarray(x.value_lengths(), dtype=np.int64) // stride for x in lists]
                start = [np.cumsum(n) - n for n in length]
                i, j = _within(*(v[:, :n_words] for v in value), *length, *start, first, radius)
                a, b = _stars(value[0][i, n_words], value[1][j, n_words])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return pairs.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b); root: the component's smallest node."""
    state = None
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        large = staged(large, "cc-large")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small_star = large.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = staged(small_star.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "cc-small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, bands: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; component_id: the smallest doc_id reachable."""
    prints = staged(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    first = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(first.select("fp", F.array("fp").alias("words")), radius, bands))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 60, first: int = 22, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay when, in order of doc_id, each goes that is a near-duplicate of one that stays.

    Near-duplicates have shingle sets of a Jaccard similarity of `similarity` or more, and fingerprints within the
    radius. Fingerprints are those of the sets, of 256 bits: at a similarity of 0.8 two of them differ by some 39
    bits, give or take 6, and by 10, give or take 3, in the first word, while unrelated ones differ by 128, give or
    take 8. Groups are what fingerprints within the radius connect; their size classes (a factor of 1/similarity each)
    prune tiles, as sets of such different sizes cannot be so similar. Within a group every decision is by the sets.
    A group of GROUP_ROWS rows at most is settled in one task. In a larger one the smallest that are left are its
    heads; in each round all others are compared with them, heads with each other too. Heads that are like no
    smaller head that stays stay, what is like those goes, and the rest waits for the next round or, once it is
    small, for one task. No pair is left out, and no round is the last before nothing is left.

    A row is what its doc_id and text say: of two rows of one doc_id and different texts each is judged by itself.
    Rows equal in both stay or go together. Rows with a null doc_id come last in order, by a hash of their text.
    Null and word-less texts are near-duplicates of each other. An empty table stays empty. Other columns are
    carried along unread.
    """
    identity = [F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("hash")]
    sized = F.floor(F.log(F.greatest("n_shingles", F.lit(1))) / F.log(F.lit(1 / similarity))).cast("long")
    prints = set_prints(docs.select(*identity, F.col(text_col).alias("text")), width).groupBy("id", "hash").agg(F.first("words").alias("words"), F.first("n_shingles").alias("n_shingles"))
    prints = staged(prints.withColumn("size_class", sized).withColumn("fp", F.xxhash64("words")), "near-prints")
    # The same fingerprint in two size classes is in two tiles; links join them all the same.
    roots = components(links(prints.select("fp", "words", "size_class").distinct(), radius, bands=1, sized=True, n_words=WORDS, first=first))
    grouped = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    several = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("root")
    members = staged(grouped.join(several, "root").select("root", "id", "hash", "words"), "near-members")
    if members.isEmpty():
        return docs
    # From here on the few that have company are all that is read: their shingle sets as sorted hashes.
    sets = shingle_sets(_matching(docs.select(*identity, F.col(text_col).alias("text")), members.select("id", "hash"), "left_semi"), width).dropDuplicates(["id", "hash"])
    same = [F.col("m.id").eqNullSafe(F.col("s.id")), F.col("m.hash") == F.col("s.hash")]
    order = F.struct(F.col("m.id").isNull().alias("no_id"), "m.id", "m.hash").alias("at")
    open_ = staged(members.alias("m").join(sets.alias("s"), same).select("m.root", order, "m.words", "s.grams"), "near-open")
    dropped, heads_n = [], 1
    while True:
        sizes = open_.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("grams")).alias("m"))
        large = staged(sizes.filter((F.col("n") > GROUP_ROWS) | (F.col("m") > GROUP_HASHES)).select("root"), "near-large")
        is_large = small(large)
        dropped.append(staged(_settled(open_.join(is_large, "root", "left_anti"), radius, first, similarity), "near-gone"))
        if large.isEmpty():
            break
        open_ = open_.join(is_large, "root", "left_semi")
        place = F.row_number().over(Window.partitionBy("root").orderBy("at"))
        chosen = open_.select("root", "at").withColumn("_place", place).filter(F.col("_place") <= heads_n).drop("_place")
        heads = staged(open_.join(small(staged(chosen, "near-chosen")), ["root", "at"], "left_semi"), "near-heads")
        like = staged(_like(heads, open_, radius, first, similarity), "near-like")
        not_kept = staged(_not_kept(like.join(heads.select("at"), "at", "left_semi")), "near-not-kept")
        gone = staged(like.join(not_kept.select(F.col("at").alias("head")), "head", "left_anti").select("at").unionByName(not_kept).distinct(), "near-gone")
        dropped.append(gone)
        open_ = staged(open_.join(small(staged(heads.select("at").unionByName(gone).distinct(), "near-done")), "at", "left_anti"), "near-open")
        heads_n = min(HEADS, heads_n * STEP)
    gone = dropped[0]
    for more in dropped[1:]:
        gone = gone.unionByName(more)
    return _matching(docs, gone.select("at.id", "at.hash"), "left_anti", id_col, text_col)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _matching(docs: DataFrame, rows: DataFrame, how: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """docs semi- or anti-joined with rows (id, hash); a null id matches a null id."""
    id_, hash_ = fresh(docs, "_q_id"), fresh(docs, "_q_hash")
    named = small(rows.select(F.col("id").alias(id_), F.col("hash").alias(hash_)))
    return docs.join(named, docs[id_col].eqNullSafe(F.col(id_)) & (text_hash(docs[text_col]) == F.col(hash_)), how)


def set_prints(rows: DataFrame, width: int) -> DataFrame:
    """(id, hash, words, n_shingles) of the sets of shingles. rows: (id, hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("simhash")
        for batch in batches:
            prints, sizes = [], []
            for text in batch.column(2):
                grams = list(set(shingles(text.as_py(), width)))
                prints.append(fingerprint(grams, WORDS))
                sizes.append(len(grams))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["id", "hash", "words", "n_shingles"])

    return modest(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, hash bigint, words array<bigint>, n_shingles bigint")


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """(id, hash, grams): the distinct shingles as sorted 64-bit hashes. rows: (id, hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.array(sorted({xxhash.xxh64_intdigest(g, SEED) for g in shingles(t.as_py(), width)}), np.uint64).view(np.int64) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sets, pa.list_(pa.int64()))], names=["id", "hash", "grams"])

    return modest(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, hash bigint, grams array<bigint>")


def _settled(groups: DataFrame, radius: int, first: int, similarity: float) -> DataFrame:
    """(at): the rows that go, of groups that are small enough for one task each. groups: (root, at, words, grams)."""

    def run(group: pa.Table) -> pa.Table:
        ats = group["at"].to_pylist()
        rows = sorted(range(len(ats)), key=lambda i: _key(ats[i]))
        words = group["words"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)[rows]
        sets = [frozenset(group["grams"][i].values.to_numpy().tolist()) for i in rows]
        n = np.array([len(s) for s in sets])
        here = np.ones(len(rows), bool)
        for i in range(len(rows)):
            if not here[i]:
                continue
            apart = np.bitwise_count(words[i + 1 :] ^ words[i]).astype(np.int64)
            near = here[i + 1 :] & (apart[:, 0] <= first) & (apart.sum(axis=1) <= radius) & (np.minimum(n[i + 1 :], n[i]) >= similarity * np.maximum(n[i + 1 :], n[i]))
            for j in np.nonzero(near)[0] + i + 1:
                shared = len(sets[i] & sets[j])
                here[j] = shared < similarity * (n[i] + n[j] - shared)
        return group.select(["at"]).take(pa.array([rows[i] for i in np.nonzero(~here)[0]], pa.int64()))

    return groups.groupBy("root").applyInArrow(run, f"at {groups.schema['at'].dataType.simpleString()}")


def _key(at: dict) -> tuple:
    """What rows are ordered by in Python, as Spark orders the struct."""
    return tuple(at[k] if at[k] is not None else 0 for k in ("no_id", "id", "hash"))


def _like(heads: DataFrame, members: DataFrame, radius: int, first: int, similarity: float) -> DataFrame:
    """(root, at, head): members with each smaller head of their group whose shingle set is similar enough."""
    of = heads.select("root", F.col("at").alias("head"), F.col("words").alias("_words"), F.col("grams").alias("_grams"))
    apart = [F.bit_count(F.col("words")[i].bitwiseXOR(F.col("_words")[i])) for i in range(WORDS)]
    n, m = F.size("grams"), F.size("_grams")
    near = (F.col("head") < F.col("at")) & (apart[0] <= first) & (sum(apart[1:], apart[0]) <= radius) & (F.least(n, m) >= similarity * F.greatest(n, m))
    shared = F.size(F.array_intersect("grams", "_grams"))
    # One condition that looks at the sets only of those that come near.
    return members.join(small(of), "root").filter(F.when(near, shared >= similarity * (n + m - shared)).otherwise(False)).select("root", "at", "head")


def _not_kept(like: DataFrame) -> DataFrame:
    """(at): those of heads that are like a smaller head that stays. like: (root, at, head), both heads, at most HEADS of a root."""

    def run(links: pa.Table) -> pa.Table:
        member, head = ([_key(x) for x in links[c].to_pylist()] for c in ("at", "head"))
        gone: dict[tuple, int] = {}
        for i in sorted(range(len(member)), key=lambda i: (member[i], head[i])):
            if head[i] not in gone:
                gone.setdefault(member[i], i)
        return links.select(["at"]).take(pa.array(list(gone.values()), pa.int64()))

    return like.groupBy("root").applyInArrow(run, f"at {like.schema['at'].dataType.simpleString()}")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
