"""License scans by the Dice coefficient of word bigrams, in DataFrame functions alone.

Both sides are normalised to lower-cased words, and compared by counted bigrams: of m and n bigrams of which k
are shared, with repeats, the coefficient is 2 k / (m + n). A place is a run of words of a text, anywhere in it, that
begins and ends with a bigram of the template. As k is m at most, a place within the least coefficient d has
between n d / (2 - d) and n (2 - d) / d bigrams: these size bounds prune templates of which a text holds too few
bigrams, and end the search for the end of a place.

For each start the end with the largest coefficient by the template's bigrams in between is taken; of the places so found the
best, and of those that do not overlap it the next best, and so on. Their coefficients are then counted exactly, and
once more the best that do not overlap stay, now of all templates: the licence that says it best has the place.

Of a text nothing is looked at before it holds one of a few words: those that so many of each template's bigrams
touch that without them too few are left. The templates are a fixed list and go along as a literal; nothing is shuffled but
the finds.

Defined results: null and empty texts hold no licence, whatever other columns are called. One row for each document and licence,
with the best coefficient and the number of places. Of equal coefficients the longer place counts, then the
first by place and name. Rows of one id count together, rows of null ids too. Texts of any length are read whole. An empty table gives an
empty report.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.licence_texts import CLOSE, NOTICES, WHOLE
from quadrille.llm.shared import let, table

WORD = r"[\p{L}\p{N}]+"
LEAST = 0.8
TEMPLATES = NOTICES


def words_of(text: str) -> list[str]:
    """Words of a template; the same as Spark's pattern finds in it."""
    return re.findall(r"[^\W_]+", text.lower())


def signal_words(texts: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which each place with the least coefficient holds one: a template's bigrams without them are too few for it.

    Taken in turn is the word that goes farthest, a letter more counting double, as long words are rare in other texts.
    """
    bigrams = [list(zip(w, w[1:])) for w in (words_of(t) for _, t in texts)]
    #: How many bigrams may be left untouched at most.
    room = [math.ceil(len(b) * least / (2 - least) - 1e-9) - 1 for b in bigrams]
    left, chosen = [list(b) for b in bigrams], []
    while any(len(b) > r for b, r in zip(left, room)):
        gain: Counter[str] = Counter()
        for b, r in zip(left, room):
            if len(b) > r:
                for pair in b:
                    for w in set(pair):
                        gain[w] += 1 / (len(b) - r)
        word = max(gain, key=lambda w: (gain[w] * 2 ** len(w), w))
        chosen.append(word)
        left = [[p for p in b if word not in p] for b in left]
    return chosen


def _hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def templates(spark: SparkSession, texts: list[tuple[str, str]]) -> list[tuple[str, int, list[int], list[int]]]:
    """(licence, n, grams, times) of each template: its number of bigrams, their distinct hashes, how often each occurs."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    rows = spark.createDataFrame(texts, "licence string, text string").select("licence", words.alias("w")).select("licence", F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: _hash(a, b)).alias("grams")).collect()
    out = []
    for r in rows:
        counts = Counter(r["grams"][:-1])  # the last word has no follower
        out.append((r["licence"], sum(counts.values()), sorted(counts), [counts[g] for g in sorted(counts)]))
    return out


def _longs(values: list[int], suffix: str = "L") -> str:
    return f"array({', '.join(f'{v}{suffix}' for v in values)})"


def _apart(places: Column, kind: str) -> Column:
    """Of places sorted with the best first those that overlap none before them."""
    taken = lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] <= y["end"]) & (y["start"] <= x["end"])), acc).otherwise(F.concat(acc, F.array(x).cast(kind)))
    return F.aggregate(places, F.array().cast(kind), taken)


_SPAN = "array<struct<rank:double,shorter:int,start:int,licence:string,end:int>>"


def _places(hits: Column, t: Column, least: float) -> Column:
    """Places of one template. hits: (at, gram) of the text's bigrams that some template has, in order."""
    most = F.floor(t["n"] * ((2 - least) / least) + 1e-9).cast("int")

    def ending(at: Column, i: Column) -> Column:
        begin = F.get(at, i)
        dice = lambda k, x: 2.0 * F.least(k, t["n"]) / (x - begin + 1 + t["n"])
        step = lambda acc, x: F.struct((acc["k"] + 1).alias("k"), F.greatest(acc["best"], F.struct(dice(acc["k"] + 1, x).alias("dice"), x.alias("end"))).alias("best"))
        best = F.aggregate(F.slice(at, i + 1, F.least(most, F.size(at) - i)), F.struct(F.lit(0).alias("k"), F.struct(F.lit(0.0).alias("dice"), begin.alias("end")).alias("best")), step, lambda acc: acc["best"])
        return let(best, lambda b: F.struct((-b["dice"]).alias("rank"), (begin - b["end"]).alias("shorter"), begin.alias("start"), t["licence"].alias("licence"), b["end"].alias("end")))

    def exact(mine: Column, s: Column) -> Column:
        inside = F.transform(F.filter(mine, lambda h: (h["at"] >= s["start"]) & (h["at"] <= s["end"])), lambda h: h["gram"])
        shared = let(inside, lambda grams: F.aggregate(F.arrays_zip(t["grams"].alias("g"), t["times"].alias("n")), F.lit(0), lambda n, g: n + F.least(g["n"], F.size(F.filter(grams, lambda x: x == g["g"])))))
        return F.struct((-2.0 * shared / (s["end"] - s["start"] + 1 + t["n"])).alias("rank"), s["shorter"].alias("shorter"), s["start"].alias("start"), s["licence"].alias("licence"), s["end"].alias("end"))

    def found(mine: Column) -> Column:
        begun = let(F.transform(mine, lambda h: h["at"]), lambda at: F.filter(F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda i: ending(at, i)), lambda s: -s["rank"] >= least - 1e-9))
        return F.filter(F.transform(_apart(F.sort_array(begun), _SPAN), lambda s: exact(mine, s)), lambda s: -s["rank"] >= least - 1e-9)

    return let(F.filter(hits, lambda h: F.array_contains(t["grams"], h["gram"])), found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: list[tuple[str, str]] = [*NOTICES, *CLOSE, *WHOLE], least: float = LEAST) -> DataFrame:
    """(doc_id, licence, dice, n_places) of each licence found in a document."""
    known = templates(docs.sparkSession, texts)
    literal = F.expr("array(" + ", ".join(f"named_struct('licence', '{name}', 'n', {n}, 'grams', {_longs(grams)}, 'times', {_longs(times, '')})" for name, n, grams, times in known) + ")")
    every = sorted({g for _, _, grams, _ in known for g in grams})
    once = lambda x: F.explode(F.array(x))  # noqa: E731  (else a filter after it makes the column anew)
    lowered = F.lower(F.col(text_col))
    signals = signal_words(texts, least)
    # First whether they are there at all, which is quick, then whether as words.
    asked = docs.filter(reduce(or_, (lowered.contains(w) for w in signals))).filter(lowered.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(signals)})(?![\p{{L}}\p{{N}}])"))
    words = asked.select(F.col(id_col).alias("doc_id"), once(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))).alias("words")).filter(F.size("words") > 1)
    grams = F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words")), _hash)
    hit = words.select("doc_id", once(grams).alias("grams")).select("doc_id", once(F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda h: h["gram"].isin(every))).alias("hits"))
    own = F.array_distinct(F.transform("hits", lambda h: h["gram"]))
    # Each distinct bigram of a template that is missing leaves one less to share.
    missing = lambda t: F.size(t["grams"]) - F.size(F.array_intersect("own", t["grams"]))
    held = hit.filter(F.size("hits") > 1).select("doc_id", "hits", once(own).alias("own"))
    fitting = held.select("doc_id", "hits", once(F.filter(literal, lambda t: t["n"] - missing(t) >= t["n"] * (least / (2 - least)) - 1e-9)).alias("ts")).filter(F.size("ts") > 0)
    places = fitting.select("doc_id", once(F.sort_array(F.flatten(F.transform("ts", lambda t: _places(F.col("hits"), t, least))))).alias("places"))
    best = places.select("doc_id", F.explode(_apart(F.col("places"), _SPAN)).alias("s"))
    return best.groupBy("doc_id", F.col("s.licence").alias("licence")).agg(F.round(F.max(-F.col("s.rank")), 6).alias("dice"), F.count(F.lit(1)).alias("n_places"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _bigrams_sql(words: str) -> str:
    return f"list_distinct(CASE WHEN len({words}) = 1 THEN {words} ELSE list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]) END)"


OP10_SQL = f"""
WITH templates AS (
  SELECT licence, {_bigrams_sql("w")} AS grams FROM (
    SELECT licence, regexp_extract_all(lower(text), '{WORD}') AS w FROM (VALUES {", ".join("('%s', '%s')" % (a, b.replace("'", "''")) for a, b in TEMPLATES)}) AS v(licence, text))
), blocks AS (
  SELECT doc_id, row_number() OVER () AS block, text FROM (
    SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n')) AS text FROM documents)
), lines AS (
  SELECT doc_id, block, false AS whole, unnest(string_split(text, chr(10))) AS line FROM blocks
  UNION ALL SELECT doc_id, block, true, text FROM blocks WHERE contains(text, chr(10))
), places AS (
  SELECT doc_id, block, whole, place, {_bigrams_sql("w")} AS grams FROM (
    SELECT doc_id, block, whole, row_number() OVER () AS place, regexp_extract_all(lower(line), '{WORD}') AS w FROM lines WHERE line <> '')
), scored AS (
  SELECT doc_id, block, whole, place, licence, 2 * len(list_intersect(p.grams, t.grams)) / (len(p.grams) + len(t.grams)) AS dice
  FROM places p JOIN templates t ON len(p.grams) > 0 AND 2 * least(len(p.grams), len(t.grams)) >= {LEAST} * (len(p.grams) + len(t.grams))
), best AS (
  -- A block and a line in it are one place: the one that is more alike, the line if they are equally so.
  SELECT *, max(dice) FILTER (whole) OVER (PARTITION BY doc_id, block) AS of_block, max(dice) FILTER (NOT whole) OVER (PARTITION BY doc_id, block) AS of_line
  FROM scored WHERE dice >= {LEAST}
)
SELECT doc_id, licence, round(max(dice), 6) AS dice, count(DISTINCT place) AS n_places
FROM best WHERE whole = coalesce(of_block > of_line, whole) GROUP BY doc_id, licence
"""
