"""Near-duplicates against a choice by all pairs of shingle sets."""

import random

from quadrille.llm import simhash

KIND = "doc_id bigint, text string"


def chosen(rows):
    """In order of doc_id: those that are like none that stays."""
    sets, kept = {i: set(simhash.shingles(t, 5)) for i, t in rows}, []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]) for k in kept):
            kept.append(i)
    return kept


def test_families_of_texts_that_are_less_than_similar(spark):
    rng = random.Random(3)
    rows = []
    for family in range(3):
        page = [f"w{family}x{i}" for i in range(300)]
        for n in range(40):
            own = list(page)
            for k in rng.sample(range(300), rng.choice([3, 7, 9])):
                own[k] = f"own{family}x{n}x{k}"
            rows.append((len(rows), " ".join(own)))
    kept = chosen(rows)
    assert 30 < len(kept) < len(rows) - 10
    assert sorted(r[0] for r in simhash.deduplicate(spark.createDataFrame(rows, KIND)).collect()) == kept


def test_repeats_do_not_count(spark):
    texts = [" ".join(f"t{n}x{i}" for i in range(n)) for n in (60, 150, 400)]
    often = texts[1] + " " + " ".join(["one line that comes again and again"] * 40)
    once = texts[1] + " one line that comes again and again one line that comes"
    rows = list(enumerate([x for t in texts[::2] for x in (t, t + " " + t)] + [often, once]))
    kept = chosen(rows)
    assert kept == [0, 2, 4]
    assert sorted(r[0] for r in simhash.deduplicate(spark.createDataFrame(rows, KIND)).collect()) == kept


def test_large_groups_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 6)
    monkeypatch.setattr(simhash, "HEADS", 16)
    rng = random.Random(5)
    rows = []
    for family, sizes in enumerate(([3, 7, 9], [1, 2], [12, 16, 20])):
        page = [f"v{family}x{i}" for i in range(250)]
        for n in range(50):
            own = list(page)
            for k in rng.sample(range(250), rng.choice(sizes)):
                own[k] = f"own{family}x{n}x{k}"
            rows.append((len(rows), " ".join(own)))
    kept = chosen(rows)
    assert 20 < len(kept) < len(rows) - 40
    rows += [(None, rows[0][1]), (None, rows[60][1] + " more")]
    assert sorted(r[0] or -1 for r in simhash.deduplicate(spark.createDataFrame(rows, KIND)).collect()) == sorted(x or -1 for x in kept)


def test_several_blocks_to_a_tile(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "SPREAD", 1)
    rng = random.Random(9)
    rows = [(i, f"{i} " + " ".join(rng.choice("abcdefgh") for _ in range(30))) for i in range(60)]
    rows += [(i + 100, t) for i, t in rows[::3]]
    docs = spark.createDataFrame(rows, KIND)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, radius=12, bands=2).collect()}
    prints = {i: simhash.fingerprint(simhash.shingles(t, 3))[0] & (2**64 - 1) for i, t in rows}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 12 and top(a) != top(b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert got == {i: top(i) for i in prints}
