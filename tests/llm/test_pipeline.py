"""The pipeline against plain Python over the whole of the smallest tables."""

import hashlib
import itertools
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, language_id, simhash
from quadrille.llm.shared import staged, table

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def best_run(a, b):
    """Best score over all lines, one for each agreement and -2 for each difference."""
    a, b, best = np.array([hash(w) for w in a]), np.array([hash(w) for w in b]), 0
    for shift in range(-len(b) + 1, len(a)):
        low, n = max(0, -shift), min(len(b), len(a) - shift)
        c = np.concatenate([[0], np.cumsum(np.where(a[low + shift : n + shift] == b[low:n], 1, -decontaminate.PENALTY))])
        best = max(best, int((c - np.minimum.accumulate(c)).max()))
    return best


def test_against_plain_python(spark, sf):
    import public_tokenizers
    import sentencepiece

    docs = table(spark, sf, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    rows = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    found = {i: t for i, t in zip(rows.doc_id, rows.text) if (s := model.predict(t, {}))[0] != "und" and s[1] >= corpus_pipeline.LEAST_SCORE}
    last = {t: i for i, t in sorted(found.items())}
    sets, kept = {i: set(simhash.shingles(t, 5)) for t, i in last.items()}, []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]) for k in kept):
            kept.append(i)
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [w for t in pd.read_parquet(f"{sf}/benchmark.parquet").text if len(w := words(t)) >= decontaminate.SPAN]
    grams = {g for w in items for g in itertools.pairwise(w)}
    clean = []
    for i in kept:
        own = words(found[i])
        if len(own) < decontaminate.SPAN or not grams & set(itertools.pairwise(own)) or all(best_run(own, w) < min(decontaminate.MIN_SCORE, len(w)) for w in items):
            clean.append(i)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: (len(ids := sp.encode(found[i], add_eos=True)), sha(" ".join(map(str, ids))), sha(sp.decode(ids))) for i in clean}
    assert {r[0]: tuple(r)[1:] for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_stages_keep_the_columns(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_stages_on_a_hostile_table(spark, sf):
    kind = spark.read.parquet(f"{sf}/documents.parquet").schema
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*kind.fieldNames()).orderBy("doc_id").limit(30).collect()]
    text, lang = kind.fieldNames().index("text"), kind.fieldNames().index("lang")
    odd = lambda r, i, t: (i, *[t if k == text else None if k == lang else v for k, v in enumerate(r)][1:])
    passage = pd.read_parquet(f"{sf}/benchmark.parquet").text.dropna().iloc[0]
    rows = [*real, real[0], odd(real[0], None, real[0][text]), odd(real[0], 500, None), odd(real[0], 501, ""), odd(real[0], 502, "12 !"), odd(real[0], 503, " ".join(reversed(real[1][text].split())) * 200), odd(real[0], 504, f"so it says {passage} and on"), odd(real[0], 505, real[2][text] + " more")]
    docs = spark.createDataFrame(rows, kind).select("*", *(F.lit("x").alias(c) for c in ("_q_id", "_q_sha", "_q_hash", "_q_key", "key", "bucket", "root", "at")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = staged(stage(spark, docs, sf), f"hostile-{name}")
        assert left.columns == docs.columns, name
        docs = left
    found = docs.collect()
    ids = [r["doc_id"] for r in found]
    assert len(ids) == len(set(ids)) and not {None, 500, 501, 502, 504} & set(ids) and 503 in ids
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(found)
