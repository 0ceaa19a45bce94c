"""Each operator on tables with nulls, empty and very long texts, ties, repeated rows, clashing extra columns, and on empty ones."""

import pytest
from pyspark.sql import functions as F

from quadrille.llm import chat, decontaminate, exact_dedup, language_id, licences, pii, resample, secrets, sentencepieces, simhash

CLASHES = ["key", "id", "found", "fp", "kept", "tokens", "digest", "bucket", "score", "pii", "_q_id", "_q_key", "_q_sha", "_q_hash", "_q_cut", "_q_new", "_words", "_pairs", "root", "at", "words", "hits"]
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)
LONG = " ".join(f"word{i % 977} and{i % 89}" for i in range(60_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seventeen sailors sing loudly about home and hearth"


def row(i, text, lang="en"):
    return (i, text, lang, None, None, *["x"] * len(CLASHES))


ROWS = [row(1, None), row(2, ""), row(3, "same words here"), row(4, "same words here"), row(4, "same words here"), row(5, LONG), row(None, "same words here"), row(None, None, None), row(6, "12 34 ..."), row(7, PASSAGE), row(8, PASSAGE.replace("lazy", "idle")), row(9, "Mail: ann@example.org, card 4111 1111 1111 1111, on 2021-02-28."), row(10, "Released under the MIT License.")]


@pytest.fixture(scope="module")
def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", params=["full", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "full" else [], KIND)


def count(docs):
    return docs.count()


def test_language(docs):
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).collect()
    assert len(got) == count(docs)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 6))
    assert all(r["lang_pred"] == "en" for r in got if r["doc_id"] in (3, 4, 5))
    assert language_id.keep(docs, model, 0.5).columns == docs.columns


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == count(docs)
    for r in got:
        if r["doc_id"] in (1, 2):
            assert (r["fingerprint"], r["component_id"]) == ("0" * 16, 1)
        if r["doc_id"] in (3, 4):
            assert r["component_id"] == 3
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 2 and one null row are empty like 1; 4 (twice) and the other null row are as 3.
    assert sorted(ids) == ([1, 3, 5, 6, 7, 8, 9, 10] if ids else [])


def test_simhash_judges_a_row_by_id_and_text(spark):
    rows = [(1, LONG), (2, LONG + " and one word more"), (2, PASSAGE), (2, PASSAGE), (None, PASSAGE + " all day long and through the night until dawn comes up"), (None, None)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"))
    # Rows equal in id and text stay or go together; the null id comes last.
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in kept.collect()) == [(0, ""), (0, PASSAGE[:9]), (1, LONG[:9]), (2, PASSAGE[:9]), (2, PASSAGE[:9])]


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, PASSAGE), (None, PASSAGE)], "item_id bigint, text string")
    full = count(docs) > 0
    leaks = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert leaks == ({(d, i) for d in (7, 8) for i in (1, 4, None)} if full else set())
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == (len(ROWS) - 2 if full else 0)
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_decontaminate_judges_a_row_by_its_own_text(spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    rows = [(1, PASSAGE), (1, "a clean text of more than ten words that has nothing to do with the passage"), (None, "x " + PASSAGE), (None, "y"), (2, LONG + " " + PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["text"][:2]) for r in decontaminate.decontaminate(docs, bench).collect()) == [(0, "y"), (1, "a ")]
    assert sorted(r["doc_id"] or 0 for r in decontaminate.find_leaks(docs, bench).collect()) == [0, 1, 2]


def test_pii(docs):
    got = pii.pseudonymise(docs, "k").collect()
    assert len(got) == count(docs)
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(pii.pseudonymise(docs, "k").drop("_pii"), "k", back=True).collect()}
    for r in got:
        assert r["pii"] == "x"  # the caller's own; the counts go by another name
        if r["doc_id"] == 9:
            assert r["_pii"]["card"] == r["_pii"]["date"] == r["_pii"]["email"] == 1
            assert "4111 1111 1111 1111" not in r["text"] and "ann@" not in r["text"]
            assert back[9] == ROWS[11][1]
        if r["doc_id"] == 1:
            assert r["text"] is None


def test_resample(spark, docs):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, None), (4, 0, 0), (None, 1, 0), (99, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = resample.resample(docs, known).collect()
        assert len(got) == count(docs)
        assert all(r["log_weight"] == 0 for r in got if r["doc_id"] in (1, 2))
        assert not got or sum(r["selected"] for r in got) >= round(0.5 * len(got))


def test_secrets(spark, docs):
    assert secrets.scan(docs).count() >= 0
    key = 'api_key = "aZ3xY7qL0pT5vB2nM8kJ"'
    known = spark.createDataFrame([(i, "", 0, f"{'aZ3xY7' if i % 2 else 'documentation'}_{i:012d}", 'api_key = "' if i % 2 else "see ", '"' if i % 2 else " here", i % 2) for i in range(40)], "doc_id bigint, path string, place int, found string, before string, after string, label int")
    planted = spark.createDataFrame([(i, key if i % 2 else "see documentation_about_tokens here", None) for i in range(40)] + [(None, None, None), (41, "", "a/b"), (None, key, "a")], "doc_id bigint, text string, source string")
    got = secrets.scan(planted, labelled=known).collect()
    assert {r["doc_id"] for r in got if r["probability"] >= 0.5} == {i for i in range(40) if i % 2} | {None}
    one = secrets.scan(planted, labelled=known.filter("label = 1")).collect()
    assert {r["probability"] for r in one} == {1.0}


def test_exact_dedup(spark, docs):
    for capacity in (4_096, 1):  # the second splits buckets as far as it can
        got = exact_dedup.report(docs, capacity=capacity).collect()
        assert len(got) == count(docs)
        for r in got:
            if r["doc_id"] in (1, 2):
                assert (r["keep_id"], r["group_size"], r["kept"]) == (2, 3, r["doc_id"] == 2)
            if r["doc_id"] in (3, 4):
                assert (r["keep_id"], r["group_size"], r["kept"]) == (4, 4, r["doc_id"] == 4)
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(ids) == ([2, 4, 5, 6, 7, 8, 9, 10] if ids else [])


def test_sentencepiece(docs, model_path):
    assert exact(sentencepieces.digests(docs, model_path)) == count(docs)
    back = sentencepieces.decode(sentencepieces.encode(docs, model_path), model_path)
    assert all(r["text"] == "same words here" for r in back.collect() if r["doc_id"] in (3, 4))


def exact(df):
    return len(df.collect())


def test_licences(docs):
    got = licences.scan(docs).collect()
    assert [(r["doc_id"], r["licence"], r["dice"], r["n_places"]) for r in got] == ([(10, "MIT", 1.0, 1)] if count(docs) else [])


def test_chat(spark):
    kind = "conv_id bigint, turn int, role string, text string, turns string, segments string"
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 200_000), (None, None, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 1, "assistant", ""), (3, 0, "tool", "[AS]")]
    rows = [(*r, "x", "x") for r in rows]
    for some in (rows, []):
        out = chat.read_back(chat.format_chats(spark.createDataFrame(some, kind).withColumn("valid", F.lit(1))))
        got = {r["conv_id"]: r for r in out.collect()}
        if some:
            assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["valid"]) == (2, 200_000, True)
            assert (got[2]["n_turns"], got[2]["first_bad_turn"]) == (2, 1)
            assert (got[3]["n_turns"], got[3]["first_bad_turn"]) == (2, 0)
            assert got[None]["n_turns"] == 1
        else:
            assert not got
