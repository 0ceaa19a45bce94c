"""The prefix trie of rebuilt conversations against plain Python, and its numbering over ranges."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quadrille.llm import trie

KIND = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        own_saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        parts = [below(k) for k in kids[p]]
        return (sum(a for a, _ in parts) or 1, own_saved + sum(b for _, b in parts))

    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


def rows_of(found):
    rows = [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in found.collect()]
    return set(rows), len(rows)


def test_hostile_conversations(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b\n", "", None, "é c d"])) for c in [*range(0, 45), -7, -20, -41, 1000] for t in range(rng.randint(1, 5))]
    rows += [(60 + c, t, "user", f"turn {t}") for c in (0, 1, 2, 3, 9) for t in range(12)]  # the same long conversation
    rows += [(3, 1, "user", "again"), (3, 1, "user", "again"), (3, None, "user", "first"), (None, 0, "user", "nobody"), (None, None, None, None), (80, 0, "user", "word " * 50_000)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("clash") for c in ("conv", "depth", "node", "digest", "words")})
    assert rows_of(trie.conversation_trie(table)) == brute(rows)


def test_one_conversation_over_many_ranges(spark):
    rows = [(20, t, "user", f"say {t % 7}") for t in range(3_000)] + [(c, t, "user", "say 0") for c in (21, 22, 40) for t in range(3)]
    got = trie.turns(spark.createDataFrame(rows, KIND).repartition(8)).filter("conv = 20").orderBy("place")
    assert [r["place"] for r in got.collect()] == list(range(3_000))
    digests = [r["digest"] for r in got.collect()]
    assert all(digests[i] == digests[i % 7] for i in range(3_000)) and len(set(digests)) == 7


def test_many_that_end_in_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 16)
    rows = [(20 * c, 0, "user", "hello there") for c in range(500)]
    assert rows_of(trie.conversation_trie(spark.createDataFrame(rows, KIND).repartition(5))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "a")], [(20, 0, None, None)], [(7, 0, "user", "x")]])
def test_small_tables(spark, rows):
    assert rows_of(trie.conversation_trie(spark.createDataFrame(rows, KIND))) == (brute(rows) if any(r[0] is not None for r in rows) else (set(), 0))


def test_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(trie.op13_conversation_trie(spark, sf)) == brute(rows)
