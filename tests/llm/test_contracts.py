"""The registered queries: SQL agreement, and the contracts that SQL cannot express, against plain Python over whole tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from agreement import of_duckdb, of_spark

from quadrille.llm import chat, registry, resample

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees_with_sql_on_more_rows(spark, name):
    larger = "/root/testdata/sf0.01"
    assert of_spark(registry.QUERIES[name](spark, larger)) == of_duckdb(registry.SQL[name], larger)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees_with_sql(spark, sf, name):
    assert of_spark(registry.QUERIES[name](spark, sf)) == of_duckdb(registry.SQL[name], sf)


def test_language_of_held_out_documents(spark, documents):
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    got = registry.QUERIES["op1_language_id"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in docs.index)
    assert got.score.between(0, 1).all()
    lettered = docs.text.map(lambda t: bool(t) and any(map(str.isalpha, t)))
    assert (got.lang_pred[~lettered] == "und").all() and (got.lang_pred[lettered] != "und").all()
    judged = got.held_out & docs.lang.notna() & lettered
    assert (got.lang_pred == docs.lang)[judged].mean() > 0.95


def test_chat_survives_hostile_text():
    hostile = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "", "<s>", "<\\s>", "[ROLE]x[AS]y[/ROLE]", "<" * 3 + "s>", "[[INST]INST]"]
    for a, b in itertools.product(hostile, repeat=2):
        turns = [("user", a), ("assistant", b), ("[AS]", a), ("", b)]
        pieces = chat.segments(turns, chat.INSTRUCT)
        assert chat.parse("".join(t for t, _ in pieces), chat.INSTRUCT) == turns
        assert "".join(chat.unescape(t) for t, loss in pieces if loss) == b
    assert chat.first_bad_turn(["user", "assistant"], chat.INSTRUCT) is None
    assert chat.first_bad_turn(["assistant"], chat.INSTRUCT) == 0
    assert chat.first_bad_turn(["user"], chat.INSTRUCT) == 1


def test_simhash_against_all_pairs(spark, sf, documents):
    prints = {}
    for i, text in zip(documents.doc_id, documents.text.fillna("")):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = registry.QUERIES["op3_simhash_near_dedup"](spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{p:016x}", top(i)) for i, p in prints.items()}


def test_pseudonyms(spark, sf, documents):
    got = registry.QUERIES["op5_pii"](spark, sf).toPandas().set_index("doc_id")
    whole = documents.set_index("doc_id").text
    assert len(got) == len(whole)
    kinds = [c for c in got.columns if c.startswith("n_")]
    clean = got[kinds].sum(axis=1) == 0
    assert (got.text[clean].fillna("-") == whole[clean].fillna("-")).all()
    assert (got.text[~clean] != whole[~clean]).all() and (~clean).any()


def test_resampling_by_weight_and_noise(spark, sf, documents):
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    good = set(labels[(labels.quality == 1) & (labels.toxic.fillna(0) == 0)].doc_id)
    counts = np.zeros((2, resample.BUCKETS))
    found = {i: resample.buckets(t, resample.Hashes()) for i, t in zip(documents.doc_id, documents.text)}
    for i, b in found.items():
        np.add.at(counts[0], b, 1)
        if i in good:
            np.add.at(counts[1], b, 1)
    raw, target = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    got = registry.QUERIES["op6_quality_resample"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(found)
    for i, b in found.items():
        assert got.log_weight[i] == pytest.approx(float((np.log(target) - np.log(raw))[b].sum()), abs=1e-6)
    least = np.sort(got.priority)[::-1][round(0.5 * len(got)) - 1]
    assert (got.selected == (got.priority >= least)).all()
    # What is added is Gumbel noise: its mean is 0.5772, its spread 1.2825, and it does not follow the weights.
    noise = got.priority - got.log_weight
    assert abs(noise.mean() - 0.5772) < 4 * 1.2825 / len(noise) ** 0.5 and abs(noise.std() - 1.2825) < 0.3
    assert abs(np.corrcoef(noise, got.log_weight)[0, 1]) < 0.3


def test_secret_findings(spark, sf):
    got = registry.QUERIES["op7_secret_scan"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) and got.probability.between(0.5, 1).all() and (got.length >= 8).all()


def test_sentencepiece_against_the_library(spark, sf, documents):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = registry.QUERIES["op9_sentencepiece"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(documents)
    for i, text in zip(documents.doc_id, documents.text.fillna("")):
        ids = sp.encode(text, add_eos=True)
        assert tuple(got.loc[i]) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))


def test_sentencepiece_on_odd_texts():
    import random
    from pathlib import Path

    import public_tokenizers
    import sentencepiece

    from quadrille.llm.sentencepieces import PrefixTable

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), PrefixTable(Path(path).read_bytes())
    rng = random.Random(1)
    odd = ["", " ", "  a  b ", "\n\n\t", "▁▁a▁", "</s><s><unk>", "日本語テキスト", "é́ﬁ", "​", "😀" * 9, "a" * 5_000, "ab" * 3_000, "<0x41>"]
    odd += ["".join(rng.choice("abe thin.,▁'\n é1日") for _ in range(rng.randint(1, 60))) for _ in range(3_000)]
    for text in odd:
        ids = sp.encode(text, add_eos=True)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == sp.decode(ids)
