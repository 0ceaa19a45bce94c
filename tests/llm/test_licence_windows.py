"""Notices that share their line or block with other words."""

from collections import Counter

from quadrille.llm import licences


def test_notices_among_other_words(spark):
    of = {(a, i): t for i, (a, t) in enumerate([*licences.TEMPLATES, *licences.CLOSE])}
    gpl = next(t for (a, _), t in of.items() if a == "GPL-3.0" and t.startswith("This program"))
    bsd = next(t for (a, _), t in of.items() if a == "BSD-3-Clause")
    texts = {
        1: "# prog: does things with words\n#\n# " + gpl.replace("under the", "under\n# the") + "\n#\n# This program is distributed in the hope that it will be useful, but without any warranty\n#\n# You should have got a copy\nimport os",
        2: "/* Copyright some one, all rights reserved by the holder.\n * " + bsd.replace("with or", "with\n * or") + "\n * 1. Redistributions of source code must retain the above notice\n * and more words here that go on for long */\nint x;",
        3: "The code in this folder is Released under the MIT License. See the file LICENSE for details.",
        4: "This work is licensed under the GNU General Public License, version 2.",
        5: "This work is licensed under the GNU General Public License, version 3.",
        6: "nothing of the kind under the sea, of the General Public",
    }
    got = {(r["doc_id"], r["licence"], r["n_places"]) for r in licences.scan(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == {(1, "GPL-3.0", 1), (2, "BSD-3-Clause", 1), (3, "MIT", 1), (4, "GPL-2.0", 1), (5, "GPL-3.0", 1)}


def coefficient(a, b):
    """Dice over counted word bigrams."""
    a, b = (Counter(zip(w, w[1:])) for w in (a, b))
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def test_whole_texts_and_places(spark):
    whole = dict(licences.WHOLE)
    comment = lambda text: "\n".join(" * " + line for line in text.split("\n"))
    texts = {
        1: f"/*\n{comment(whole['MIT'])}\n */\nint x;",
        2: f"{whole['BSD-2-Clause']}\n\nand then\n\n{whole['BSD-3-Clause']}",
        3: "Licensed under the MIT License. Released under the MIT License.",
        4: whole["Zlib"].replace("software", "library"),
        5: " ".join(whole["Zlib"].split()[: len(whole["Zlib"].split()) * 3 // 4]) + " and then it goes on with something else " * 20,
        6: "word " * 50_000 + whole["Unlicense"] + " word" * 50_000,
        7: None, 8: "", 9: "license",
    }
    got = {(r["doc_id"], r["licence"]): (r["dice"], r["n_places"]) for r in licences.scan(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert {k: v[1] for k, v in got.items()} == {(1, "MIT"): 1, (2, "BSD-2-Clause"): 1, (2, "BSD-3-Clause"): 1, (3, "MIT"): 2, (4, "Zlib"): 1, (5, "Zlib"): 1, (6, "Unlicense"): 1}
    assert all(got[k][0] == 1.0 for k in got if k[0] in (1, 2, 3, 6))
    words = licences.words_of(whole["Zlib"])
    assert abs(got[5, "Zlib"][0] - coefficient(licences.words_of(texts[5].split(" and then it goes")[0]), words)) < 2e-6
    assert 0.8 <= got[4, "Zlib"][0] < 1


def test_no_place_without_a_signal_word():
    texts = [*licences.NOTICES, *licences.CLOSE, *licences.WHOLE]
    signals = set(licences.signal_words(texts, licences.LEAST))
    for _, text in texts:
        w = licences.words_of(text)
        untouched = sum(not {a, b} & signals for a, b in zip(w, w[1:]))
        assert untouched < (len(w) - 1) * licences.LEAST / (2 - licences.LEAST)
