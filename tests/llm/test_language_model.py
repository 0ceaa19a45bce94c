"""Predictions against a model of its own in plain Python."""

import math
import zlib
from collections import Counter

import pandas as pd
import pytest

from quadrille.llm import language_id, registry

ORDERS = (5, 4, 3, 2, 1)


def letter_runs(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def pieces(word, order):
    marked = word if order == 1 else f" {word} "
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def fitted(rows):
    """Log frequency of each (kind, entry) in each language, half a count added to each."""
    counts = {}
    for lang, text in rows:
        for w in letter_runs(text):
            for kind in (0, *ORDERS):
                for entry in [w] if kind == 0 else pieces(w, kind):
                    counts.setdefault(kind, {}).setdefault(entry, Counter())[lang] += 1
    langs = sorted({lang for lang, _ in rows})
    model = {}
    for kind, entries in counts.items():
        total = {lang: sum(c[lang] + 0.5 for c in entries.values()) for lang in langs}
        model[kind] = {e: {lang: math.log((c[lang] + 0.5) / total[lang]) for lang in langs} for e, c in entries.items()}
    return langs, model


def predicted(text, langs, model):
    words = letter_runs(text)
    if not words:
        return "und", 0.0
    sums = dict.fromkeys(langs, 0.0)
    for w in words:
        if w in model[0]:
            scores = [model[0][w]]
        else:
            scores = next((s for o in ORDERS if (s := [model[o][g] for g in pieces(w, o) if g in model[o]])), [])
        for lang in langs if scores else ():
            sums[lang] += sum(s[lang] for s in scores) / len(scores)
    best = max(sums, key=lambda lang: (sums[lang], [-ord(c) for c in lang]))
    return best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())


def test_against_plain_python(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs.index}
    langs, model = fitted([(r.lang, r.text) for i, r in docs.iterrows() if not held[i] and r.lang and r.text is not None])
    got = registry.QUERIES["op1_language_id"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, text in docs.text.items():
        lang, score = predicted(text, langs, model)
        assert got.lang_pred[i] == lang and got.score[i] == pytest.approx(score, abs=1e-6), i


def test_letters_beside_numbers():
    model = language_id.Model(["de", "en"])
    for text, words in {"m² x½ y²": ["m", "x", "y"], "12 _ ² Ⅷ": [], "a_b c1d": ["a", "b", "c", "d"], "ＡＢ 中文": ["ａｂ", "中文"]}.items():
        assert language_id.words(text) == words == letter_runs(text)
        assert (model.predict(text, {})[0] == "und") == (not words)


def test_all_entries_of_the_sample_are_kept(spark):
    rows = [(i, f"seltenes{chr(97 + i)} wort", "de") for i in range(10)] + [(20, "one rare thing", "en")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.counts[0].keys) == 14 and all(len(model.counts[o].keys) for o in ORDERS)


def test_any_number_of_labels(spark):
    docs = spark.range(2_000).selectExpr("id AS doc_id", "translate(CAST(id AS STRING), '0123456789', 'abcdefghij') AS text", "CAST(id AS STRING) AS lang")
    model = language_id.fit(docs, most=500)
    assert 300 < len(model.langs) < 700
    got = language_id.predict(docs.filter(f"lang = '{model.langs[7]}'"), model).collect()
    assert [r["lang_pred"] for r in got] == [model.langs[7]]
