"""Language identification by word-first backoff.

A word known from the labelled texts scores its log frequency in each language. An unseen
word backs off to its character n-grams, from the longest order down: the first order at which
any of its n-grams is known scores it. The language with the largest sum wins; the score is
its share of the posterior over the learned languages.

Words are runs of letters, whatever stands around them ("m²" holds the word "m").

The model is fitted on a bounded sample: about `sample` labelled texts of each language, or fewer
if the languages are so many that this is more than `most` texts in all, picked by a hash of the
id. All words and n-grams of these texts are kept. Texts are predicted whole.

Defined results: a null text, or one without a letter, is `und` with score 0. So is every text if
nothing was learned. Of equally likely languages the first by name wins; a text of which not one
character is known is equally likely in all, and scores one over their number. Rows with a null id
are predicted, and neither held out nor learned from. Repeated rows are predicted alike, and of
labelled ones all or none are learned from. However many labels there are, a sample of their texts is learned from: a
label of which none is drawn is never predicted. An empty table gives an empty report.

The model is one file that Spark hands to each executor; its workers map it into memory and share its pages.
"""

from __future__ import annotations

import mmap
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.shared import drawn, holding, modest, small, staged, table

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: Labelled texts of each language to learn from, and of all languages.
SAMPLE, MOST = 4_000, 400_000
#: Languages for which a row an entry is written out.
FEW = 32
#: Unseen words that a worker remembers the score of.
CACHE = 50_000
#: Added to each count, for words and n-grams that a language has not been seen with.
SMOOTHING = 0.5


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. The pattern's runs may hold numbers that are no digits, such as ² and ½: those part words too."""
    found = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def grams(word: str, order: int) -> list[str]:
    """Character n-grams of a word between end marks; single characters go without marks."""
    if order == 1:
        return list(word)
    marked = f" {word} "
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Counts:
    """How often entries are seen in each language, entry by entry, as few are seen in several.

    keys: sorted 64-bit hashes of the entries; of entry i, langs and more [start[i]:start[i + 1]] are the languages it is seen in and what its
    log frequency is more there than that of an entry never seen; never: that one's log frequency in each language.
    """

    keys: np.ndarray
    start: np.ndarray
    langs: np.ndarray
    more: np.ndarray
    never: np.ndarray

    def score(self, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The summed log frequencies of entries, each so many times, in each language."""
        first = self.start[at]
        n = self.start[at + 1] - first
        where = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.langs[where], self.more[where] * np.repeat(times, n), len(self.never)) + times.sum() * self.never


@dataclass
class Table:
    """The same with a row of log frequencies for each entry, which is quicker where languages are few."""

    keys: np.ndarray
    cells: np.ndarray
    never: np.ndarray

    def score(self, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        return times @ self.cells.reshape(-1, len(self.never))[at]


@dataclass
class Model:
    """Log frequencies by kind: 0 for words, else the n-gram order."""

    langs: list[str]
    counts: dict[int, Counts | Table] = field(default_factory=dict)

    def rows(self, kind: int, entries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries stand, and which of them are known."""
        asked = np.fromiter(map(key, entries), np.int64, len(entries))
        if kind not in self.counts or not len(known := self.counts[kind].keys):
            return np.zeros(len(entries), np.int64), np.zeros(len(entries), bool)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return at, known[at] == asked

    def of_word(self, word: str) -> np.ndarray | None:
        """What an unseen word scores; None if not one of its characters is known."""
        for order in ORDERS:
            at, found = self.rows(order, grams(word, order))
            if (n := np.count_nonzero(found)):
                return self.counts[order].score(at[found], np.ones(n)) / n
        return None

    def predict(self, text: str | None, cache: dict[str, np.ndarray | None]) -> tuple[str, float]:
        """The language of a text and its posterior. cache: keeps what unseen words score."""
        seen = Counter(words(text))
        if not self.langs or not seen:
            return UNDETERMINED, 0.0
        entries, times = list(seen), np.fromiter(seen.values(), float, len(seen))
        at, found = self.rows(0, entries)
        total = self.counts[0].score(at[found], times[found]) if found.any() else np.zeros(len(self.langs))
        for i in np.nonzero(~found)[0]:
            word = entries[i]
            if word not in cache:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[word] = self.of_word(word)
            if (v := cache[word]) is not None:
                total += v * times[i]
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def key(entry: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(entry) - (1 << 63)


def counted(found: pa.Table, langs: list[str]) -> Counts | Table:
    """found: (lang, key, n), each language and key once."""
    keys, row = np.unique(found["key"].to_numpy(), return_inverse=True)
    lang, n = pc.index_in(found["lang"], pa.array(langs, pa.string())).to_numpy(), found["n"].to_numpy()
    order = np.lexsort((lang, row))
    totals = np.bincount(lang, n, len(langs)) + SMOOTHING * len(keys)
    with np.errstate(divide="ignore"):
        never = np.log(SMOOTHING / totals) if len(keys) else np.zeros(len(langs))
    if len(langs) <= FEW:
        cells = np.tile(never, (len(keys), 1))
        cells[row, lang] += np.log(n / SMOOTHING + 1)
        return Table(keys, cells.ravel(), never)
    return Counts(keys, np.searchsorted(row[order], np.arange(len(keys) + 1)), lang[order].astype(np.int32), np.log(n[order] / SMOOTHING + 1), never)


@dataclass
class Filed:
    """A model as a file that Spark hands out: its name, its languages, and kind, array, type, place and length of each array in it."""

    name: str
    langs: list[str]
    arrays: list[tuple[int, str, str, int, int]]


def filed(spark: SparkSession, model: Model) -> Filed:
    """Puts the model in a file of its own that each executor fetches once."""
    out = Filed(f"language-{uuid.uuid4().hex}.bin", model.langs, [])
    path = f"{tempfile.mkdtemp(prefix='spark-')}/{out.name}"
    with open(path, "wb") as f:
        f.write(b"counts__")
        for kind, counts in model.counts.items():
            for name, array in vars(counts).items():
                out.arrays.append((kind, name, array.dtype.str, f.tell(), len(array)))
                f.write(array.tobytes())
                f.write(b" " * (-f.tell() % 8))
    spark.sparkContext.addFile(path)
    return out


@lru_cache(maxsize=1)
def _mapped(path: str, arrays: tuple) -> dict[int, Counts | Table]:
    with open(path, "rb") as f:
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    parts: dict[int, dict[str, np.ndarray]] = {}
    for kind, name, dtype, at, n in arrays:  # plain arrays: those of np.memmap are slow to index
        parts.setdefault(kind, {})[name] = np.frombuffer(whole, dtype, n, at)
    return {kind: (Table if "cells" in p else Counts)(**p) for kind, p in parts.items()}


def opened(file: Filed) -> Model:
    """The model, its arrays mapped from the file."""
    return Model(file.langs, _mapped(SparkFiles.get(file.name), tuple(file.arrays)))


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, so that what is counted of one stays small."""
    holding("language")
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
    pa.default_memory_pool().release_unused()


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most: int = MOST) -> Model:
    """A model of the labelled rows; rows without a text or a language teach nothing."""
    rows = modest(labelled).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = staged(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "lang-sizes")
    if not (n_langs := sizes.count()):
        return Model([])
    each = F.lit(min(float(sample), most / n_langs))
    rows = rows.join(small(sizes), "lang").filter(drawn(F.least(F.lit(1.0), each / F.col("_n")), "id")).select("id", "text", "lang")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # no more than the sample has texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1_000):
            found: Counter[tuple[str, str]] = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((lang, w) for w in words(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2_000):
            found: Counter[tuple[str, int, int]] = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                found[lang, 0, key(word)] += n
                for order in ORDERS:
                    for g in grams(word, order):
                        found[lang, order, key(g)] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array([k[2] for k in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["lang", "kind", "key", "n"])

    vocabulary = staged(rows.select("text", "lang").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    entries = staged(vocabulary.mapInArrow(spell, "lang string, kind int, key bigint, n bigint").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "lang-entries")
    # What the words of the bounded sample are made of.
    return Model(langs, {kind: counted(entries.filter(F.col("kind") == kind).toArrow(), langs) for kind in (0, *ORDERS)})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    file = filed(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("language")
        learned, cache = opened(file), {}
        for batch in batches:
            said = [learned.predict(t.as_py(), cache) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return modest(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, whose language is found with a score of `least` or more.

    Rows pass through the tasks as they come, so that no text is shuffled and no id is needed.
    """
    file = filed(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("language")
        learned, cache = opened(file), {}
        for batch in sliced(batches, 1_000):
            said = [learned.predict(t.as_py(), cache) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in said], pa.bool_()))
        cache.clear()
        pa.default_memory_pool().release_unused()

    return modest(docs).mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
