"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are values of eight characters and more that are assigned to a name that means a
credential, bearer tokens, signed web tokens, private key blocks, passwords in addresses, and any run of 16 characters and
more of the alphabets that keys are written in; an assignment's name is context, not part of the value.
Their features are their length, how their characters follow each other (switches between classes, and how
common their letter pairs are in the corpus' words), how far their words are in a dictionary of the
corpus' most frequent words, the path (source) they were found under, and the words beside them.

The forest learns from labelled findings. The caller may give them; else they are planted: documents
picked by a hash, PLANTS at most, carry one snippet each, of a kind in SECRETS (label 1: keys, tokens, passwords in
assignments, files of variables, JSON, headers and addresses) or in LOOKALIKES (label 0: digests, commits, identifiers, paths,
placeholders, data addresses, numbers, long words), with values drawn by hash. What such a document holds besides is not labelled.

Defined results: null and empty texts have no candidates; a null path counts as empty. Repeated
rows give repeated findings. If the labelled findings have one label only, or there are none,
each finding has the share of that label (or zero) as its probability. Candidates and texts of any length are read
whole; of what stands beside a candidate CONTEXT characters. Rows with a null id are scanned like others. An empty
table gives an empty report. Columns besides id, text and path are not read.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.shared import cut, drawn, staged, table

# Names that credentials are assigned to.
NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey", "private_key", "auth", "credential", "bearer")
_NAME = "|".join(NAMES)
PATTERNS = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]++-----END [A-Z ]{0,20}PRIVATE KEY-----",
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    rf"(?<=[=:][\"' ]{{0,2}})(?<=(?i:{_NAME})[\"']?\s?[=:]\s?[\"']?)[^\s\"',;]{{7,}}[^\s\"',;.)\]}}]",
    r"(?<=(?i:bearer) )[A-Za-z0-9_.~+/-]{8,}=*",
    r"(?<=://[A-Za-z0-9_.-]{1,32}:)[^\s@/:]{8,}(?=@)",
    r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_+/=-])",
)
CANDIDATE = "|".join(PATTERNS)
#: Words of the dictionary, documents that labelled findings are planted in, characters of context on either side.
DICTIONARY, PLANTS, CONTEXT = 1_000, 8_000, 64
#: Labelled findings of each label that the forest is trained on at most.
SAMPLE = 10_000
TREES, DEPTH, SEED = 30, 8, 7
FEATURES = ["length", "digits", "uppers", "lowers", "others", "switches", "letter_digit", "distinct_share", "hex_share", "pairs", "coverage", "path_depth", "path_test", "name_before", "name_near", "assigned", "quoted", "before_known", "after_known", "before_length", "after_length"]


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """(doc_id, path, place, found, before, after): each candidate with what stands around it."""
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), cut(F.col(text_col), CANDIDATE).alias("pieces")).filter(F.size("pieces") > 1)
    at = F.sequence(F.lit(1), F.size("pieces") - 1, F.lit(2))
    around = F.transform(at, lambda i: F.struct(((i - 1) / 2).cast("int").alias("place"), F.get("pieces", i).alias("found"), F.right(F.get("pieces", i - 1), F.lit(CONTEXT)).alias("before"), F.left(F.get("pieces", i + 1), F.lit(CONTEXT)).alias("after")))
    return pieces.select("doc_id", "path", F.explode(around).alias("c")).select("doc_id", "path", "c.*")


def dictionary(docs: DataFrame, text_col: str, size: int = DICTIONARY) -> dict[str, int]:
    """The most frequent ASCII words of three letters and more of all texts, with their counts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?<![\p{L}])[a-z]{3,15}(?![\p{L}])"), F.lit(0))).alias("w"))
    return {r["w"]: r["count"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()}


def letter_pairs(words: dict[str, int]) -> dict[str, float]:
    """Log of how often each pair of letters follows in the words, over an even spread; pairs never seen are left out."""
    seen = Counter()
    for word, n in words.items():
        for pair in zip(word, word[1:]):
            seen["".join(pair)] += n
    total = sum(seen.values())
    return {p: math.log(n / total * 676) for p, n in sorted(seen.items())}


def featured(found: DataFrame, words: dict[str, int]) -> DataFrame:
    """The candidates with their features, besides all their columns."""
    c = F.col("found")
    n = F.length(c)
    known = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    rates = letter_pairs(words)
    pairs = F.create_map(*(F.lit(x) for item in rates.items() for x in item)) if rates else F.create_map().cast("map<string,double>")
    share = lambda keep: F.length(F.regexp_replace(c, f"[^{keep}]", "")) / n
    switches = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")) - 1
    parts = F.split(F.lower(c), "[^a-z]+")
    covered = F.aggregate(F.filter(parts, lambda p: F.length(p) > 2), F.lit(0), lambda s, p: s + F.when(F.array_contains("_words", p), F.length(p)).otherwise(0))
    # A pair that no word has counts as one of e^-6 of an even spread.
    rate = lambda i: F.coalesce(F.element_at(F.col("_pairs"), F.substring(F.lower(c), i, F.lit(2))), F.lit(-6.0))
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), F.lit(0.0), lambda s, i: s + rate(i)) / F.greatest(F.lit(1), n - 1)
    before, after = F.lower(F.col("before")), F.lower(F.col("after"))
    number = lambda x: x.cast("double")
    flag = lambda x: x.cast("int").cast("double")
    last, first = F.regexp_extract(before, r"([a-z]+)[^a-z]*$", 1), F.regexp_extract(after, r"^[^a-z]*([a-z]+)", 1)
    return found.withColumns({"_words": known, "_pairs": pairs}).select(
        *found.columns,
        number(n).alias("length"), share("0-9").alias("digits"), share("A-Z").alias("uppers"), share("a-z").alias("lowers"), (1 - share("0-9A-Za-z")).alias("others"),
        number(switches).alias("switches"), number(F.regexp_count(c, F.lit("(?:[A-Za-z](?=[0-9]))|(?:[0-9](?=[A-Za-z]))"))).alias("letter_digit"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct_share"), share("0-9a-fA-F").alias("hex_share"), common.alias("pairs"), (covered / n).alias("coverage"),
        number(F.size(F.split("path", "/"))).alias("path_depth"), flag(F.lower("path").rlike("test|example|doc|sample")).alias("path_test"),
        flag(before.rlike(rf"(?:{_NAME})\W*$")).alias("name_before"), flag(before.rlike(_NAME)).alias("name_near"), flag(before.rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        flag(before.rlike("[\"']$") & after.rlike("^[\"']")).alias("quoted"), flag(F.array_contains("_words", last)).alias("before_known"), flag(F.array_contains("_words", first)).alias("after_known"),
        number(F.length(F.regexp_extract("before", r"(\S*)\s*$", 1))).alias("before_length"), number(F.length(F.regexp_extract("after", r"^\s*(\S*)", 1))).alias("after_length"),
    )


def _values() -> dict[str, Column]:
    """Strings drawn by a hash of the carrier's id."""
    digest = lambda salt: F.sha2(F.concat(F.lit(f"plant{salt}:"), F.col("_seed")), 256)
    base64 = lambda salt: F.regexp_replace(F.base64(F.unhex(digest(salt))), "=", "")
    return {
        "hex40": F.substring(digest(1), 1, 40), "hex64": digest(2), "hex32": F.substring(digest(3), 1, 32), "hex12": F.substring(digest(4), 1, 12),
        "b64": base64(5), "b24": F.substring(base64(6), 1, 24), "b20": F.substring(base64(7), 1, 20), "long": F.concat(base64(8), base64(9), base64(10)),
        "upper16": F.upper(F.substring(F.regexp_replace(base64(11), "[^A-Za-z0-9]", "Q"), 1, 16)), "word36": F.substring(F.regexp_replace(F.concat(base64(12), base64(13)), "[^A-Za-z0-9]", "x"), 1, 36),
        "phrase": F.concat(F.substring(base64(14), 1, 7), F.lit("!"), F.substring(base64(15), 1, 4), F.lit("$%"), F.substring(digest(16), 1, 3)),
        "number16": F.lpad(F.pmod(F.xxhash64(digest(17)), F.lit(10**16)).cast("string"), 16, "7"), "number": F.pmod(F.xxhash64(digest(18)), F.lit(900)).cast("string"),
        "uuid": F.concat_ws("-", F.substring(digest(19), 1, 8), F.substring(digest(19), 9, 4), F.substring(digest(19), 13, 4), F.substring(digest(19), 17, 4), F.substring(digest(19), 21, 12)),
        "word": F.get("_own", F.pmod(F.xxhash64(digest(20)), F.size("_own")).cast("int")), "word2": F.get("_own", F.pmod(F.xxhash64(digest(21)), F.size("_own")).cast("int")), "word3": F.get("_own", F.pmod(F.xxhash64(digest(22)), F.size("_own")).cast("int")),
    }


# What is planted: before the value, the value's parts, after it. A part in braces names a value drawn by hash.
SECRETS = [
    ('api_key = "', "{b64}", '"'), ("token = '", "{hex40}", "'"), ('token = "', "{hex40}", '"'), ("secret: ", "{hex32}", ""), ('"secret": "', "{word36}", '",'), ('{"access_key": "', "{upper16}{number}", '"}'),
    ("export API_KEY=", "{b24}", ""), ("AUTH_TOKEN=", "{word36}", ""), ("Authorization: Bearer ", "{long}", ""), ("postgres://admin:", "{word36}", "@db/main"), ('password = "', "{phrase}", '"'),
    ("passwd: ", "{b20}", ""), ("the key is AKIA", "{upper16}{number}", " so"), ("use ghp_", "{word36}", " here"), ("private_key=", "{long}", ""), ("curl -H 'X-Auth: ", "{hex64}", "'"),
]
LOOKALIKES = [
    ("sha256: ", "{hex64}", ""), ("commit ", "{hex40}", ""), ('uuid = "', "{uuid}", '"'), ('"etag": "', "{hex32}", '",'), ("call get_", "{word}_{word2}_{word3}_handler", "()"), ("class ", "{word}{word2}{word3}Controller", ":"),
    ("see /usr/local/", "{word}/{word2}/{word3}/{word}-{number}", " or"), ('api_key = "', "your_{word}_api_key_here", '"'), ('password = "', "xxxxxxxxxxxxxxxx", '"'), ('token = "', "EXAMPLE_{word}_TOKEN_{word2}", '"'), ("secret: ", "changeme-{word}-changeme", ""),
    ("img data:image/png;base64,", "{long}", ""), ("order ", "{number16}", " came"), ("so ", "{word}{word2}{word3}{word}{word2}", " was"), ("https://host/", "{word}-{word2}-{word3}-{word}-{number}", " and"), ("integrity=sha512-", "{b64}", ""), ("id: ", "{hex32}", ""), ("----------", "--------------", "-"),
]


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", most: int = PLANTS) -> DataFrame:
    """Labelled findings: candidates of snippets planted in documents picked by a hash, with `label` and `kind`."""
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("path")).filter("id IS NOT NULL AND length(text) > 40")
    n = some.count()
    some = some.filter(drawn(min(1.0, most / max(1, n)), "id")).withColumn("_seed", F.col("id").cast("string"))
    some = some.withColumn("_own", F.concat(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,9}"), F.lit(0)), lambda w: F.length(w) > 2), F.array(F.lit("node"))))
    kinds = [(b, v, a, 1) for b, v, a in SECRETS] + [(b, v, a, 0) for b, v, a in LOOKALIKES]
    forms = docs.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "kind int, b string, form string, a string, label int")
    dealt = some.withColumn("kind", F.pmod(F.xxhash64(F.lit("kind"), "id"), F.lit(len(kinds))).cast("int")).join(F.broadcast(forms), "kind")
    # Each named value stands in the form in braces; all are drawn, which is cheap for so few rows and keeps the expression small.
    value = F.col("form")
    for name, drawn_value in _values().items():
        value = F.replace(value, F.lit(f"{{{name}}}"), drawn_value)
    put = dealt.withColumn("s", F.struct("b", value.alias("v"), "a", "label", "kind"))
    # In the middle, where a word ends.
    left = F.regexp_extract(F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")), r"(?s)^(.*)\s", 1)
    right = F.substring("text", F.length("_left") + 2, F.length("text"))
    put = put.withColumn("_left", left).withColumn("_text", F.concat("_left", F.lit(" "), "s.b", "s.v", "s.a", F.lit(" "), right))
    carriers = staged(put.select(F.struct("id", "s.v", "s.label", "s.kind").alias("id"), F.col("_text").alias("text"), "path"), "secret-plants")
    found = candidates(carriers, "id", "text", "path")
    # The value itself, or a candidate that is most of it; what else the carrier holds says nothing.
    own = F.col("doc_id.v").contains(F.col("found")) | F.col("found").contains(F.col("doc_id.v"))
    return found.filter(own & (F.length("found") * 2 >= F.length("doc_id.v"))).select(F.col("doc_id.id").alias("doc_id"), "path", "place", "found", "before", "after", F.col("doc_id.label").alias("label"), F.col("doc_id.kind").alias("kind"))


def judge(findings: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """findings with `probability`. labelled: findings with `label` 0 or 1; both with features."""
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect() if r["label"] in (0, 1)}
    if len(sizes) < 2:
        return findings.withColumn("probability", F.lit(float(max(sizes, default=0))))
    part = F.create_map(*(F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, sample / n))))
    some = labelled.filter(drawn(part[F.col("label")], "doc_id", "place", "found"))
    some = staged(some.select(*FEATURES, "label", "doc_id", "place", "found").orderBy("doc_id", "place", "found"), "secret-sample")
    gather = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(gather.transform(some).select("_features", "label"))
    judged = forest.transform(gather.transform(findings))
    return judged.select(*findings.columns, vector_to_array("probability")[1].alias("probability"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """All candidates with features and probability. labelled: (doc_id, path, place, found, before, after, label); planted findings if not given."""
    words = dictionary(docs, text_col)
    found = featured(candidates(docs, id_col, text_col, path_col), words)
    known = planted(docs, id_col, text_col, path_col) if labelled is None else labelled
    return judge(found, staged(featured(known, words), "secret-labelled"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = scan(table(spark, sf_dir, "documents"))
    return judged.filter("probability >= 0.5").select("doc_id", "place", F.sha2(F.col("found").cast("binary"), 256).alias("secret_sha256"), F.col("length").cast("bigint").alias("length"), "probability")
