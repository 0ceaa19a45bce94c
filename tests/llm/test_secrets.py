"""Candidates against a search in plain Python, and the forest on findings it has not seen."""

import regex
from pyspark.sql import functions as F

from quadrille.llm import secrets
from quadrille.llm.shared import table

FORMS = {
    'api_key = "' + "aB3" * 100 + '"': "aB3" * 100, "API_KEY=abcDEF0123456789xyz": "abcDEF0123456789xyz", "token: 9f8e7d6c5b4a39281706": "9f8e7d6c5b4a39281706",
    '"token": "zXy9-aaBBcc11"': "zXy9-aaBBcc11", "Authorization: Bearer abc.def-ghi_123": "abc.def-ghi_123", 'password = "hunter2!abcDEF$%9"': "hunter2!abcDEF$%9",
    "postgres://admin:s3cretpass@db/x": "s3cretpass", "eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0": "eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0", "see 0123456789abcdef0123== there": "0123456789abcdef0123==",
    "-----BEGIN RSA PRIVATE KEY-----\nMIIabc\nxyz\n-----END RSA PRIVATE KEY-----": "-----BEGIN RSA PRIVATE KEY-----\nMIIabc\nxyz\n-----END RSA PRIVATE KEY-----",
}


def test_forms_are_candidates_whole(spark):
    rows = [(i, f"some words {text} and more") for i, text in enumerate(FORMS)]
    found = secrets.candidates(spark.createDataFrame(rows, "doc_id int, text string").withColumn("source", F.lit("s")), "doc_id", "text", "source").collect()
    assert {r["doc_id"]: r["found"] for r in found} == dict(enumerate(FORMS.values()))


def test_candidates_and_features_against_plain_python(spark, sf):
    docs = table(spark, sf, "documents")
    pattern = regex.compile("|".join(secrets.PATTERNS), regex.ASCII)
    words = secrets.dictionary(docs, "text")
    got = secrets.featured(secrets.candidates(docs, "doc_id", "text", "source"), words).collect()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        for place, m in enumerate(pattern.finditer(r["text"] or "")):
            want[r["doc_id"], place] = (m[0], r["text"][: m.start()], r["text"][m.end() :])
    assert {(r["doc_id"], r["place"]): r["found"] for r in got} == {k: v[0] for k, v in want.items()} and want
    rates = secrets.letter_pairs(words)
    for r in got:
        c, before, after = want[r["doc_id"], r["place"]]
        assert before.endswith(r["before"]) and after.startswith(r["after"]) and (r["length"], r["distinct_share"]) == (len(c), len(set(c)) / len(c))
        kinds = ["a" if x.islower() and x.isascii() else "A" if x.isupper() and x.isascii() else "0" if x.isdigit() else "-" for x in c]
        assert r["switches"] == sum(a != b for a, b in zip(kinds, kinds[1:]))
        assert abs(r["digits"] - kinds.count("0") / len(c)) < 1e-12 and abs(r["others"] - kinds.count("-") / len(c)) < 1e-12
        pairs = [rates.get(c[i : i + 2].lower(), -6.0) for i in range(len(c) - 1)]
        assert abs(r["pairs"] - sum(pairs) / max(1, len(pairs))) < 1e-9
        assert abs(r["coverage"] - sum(len(p) for p in regex.split("[^a-z]+", c.lower()) if len(p) > 2 and p in words) / len(c)) < 1e-12


def test_held_out_findings(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    known = secrets.featured(secrets.planted(docs), secrets.dictionary(docs, "text"))
    held = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(3)) == 0
    judged = secrets.judge(known.filter(held), known.filter(~held)).toPandas()
    flagged = judged.probability >= 0.5
    assert len(judged) > 200 and set(judged.kind) == set(range(len(secrets.SECRETS) + len(secrets.LOOKALIKES)))
    assert flagged[judged.label == 1].mean() > 0.95  # secrets found
    assert (~flagged)[judged.label == 0].mean() > 0.95  # look-alikes removed
