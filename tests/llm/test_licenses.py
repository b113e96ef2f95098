import random

import numpy as np

from inkstrata.llm import licenses
from inkstrata.llm.queries import QUERIES

DDL = "doc_id long, path string, text string"


def test_own_inherited_none(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c.txt", "hello"),
        (3, "x", None),
        (4, None, ""),
        (5, "a/b/d/COPYING", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991\nfoo bar baz and so on"),
        (6, "a/b/d/e/f.c", "int main"),
        (7, "a/b/d/g.c", "first line\n\n" + "words " * 500 + "\nLicensed under the Apache License, Version 2.0.\n" + "more " * 500),
        (8, "ab/c.txt", "a sibling whose folder's name begins alike"),
        (6, "a/b/d/e/f.c", "int main"),
    ]
    out = licenses.scan(spark.createDataFrame(rows, DDL)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.license, r.origin, r.from_dir) for r in out}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: (None, "none", None), 4: (None, "none", None), 5: ("GPL-2.0", "own", None), 6: ("GPL-2.0", "inherited", "a/b/d"), 7: ("Apache-2.0", "own", None), 8: (None, "none", None)}


def test_wrapped_notice_and_like_words(spark):
    notice = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\nany later version."
    rows = [(1, "a/x.c", notice), (2, "b/y.c", "the licence fee and the general public were pleased")] + [(10 + i, f"c/{i}", "ordinary words about nothing in particular") for i in range(200)]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, DDL)).collect()}
    assert got[1] == ("GPL-3.0", "own") and got[2] == (None, "none")


def test_query_finds_each_planted_line(spark, sf):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    texts = {r.doc_id: set(r.text.split("\n")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op10_licenses"](spark, sf).collect():
        planted = {v for k, v in lines.items() if k in texts[r.doc_id]}
        assert (r.origin == "own") == bool(planted) and (r.origin != "own" or r.license in planted)


def test_notices_on_many_lines(spark):
    def found(rows):
        return {r.doc_id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, DDL)).collect()}

    # half of all lines are a notice; the other half has words of templates too
    common = [(i, f"d{i}/x", "Licensed under the Apache License, Version 2.0.\nthe software of the year" if i % 3 else "plain words\nthe use of it") for i in range(300)]
    common += [(i, f"d{i}/x", "Licensed under the Apache License, Version 2.0.") for i in range(300, 500)]
    got = found(common)
    assert all(got[i] == (("Apache-2.0", "own") if i >= 300 or i % 3 else (None, "none")) for i in got)
    # a small table of one notice only
    assert set(found([(i, f"d{i}/x", "Released under the MIT License.") for i in range(3)]).values()) == {("MIT", "own")}


def test_runs_against_brute_force():
    m = licenses.Matcher(licenses.TEMPLATES)
    rng = random.Random(4)
    pieces = [x for t in licenses.TEMPLATES.values() for x in t] + ["", "some words", "the License of the year", "mit mit mit"]
    texts = []
    for _ in range(60):
        words = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))).split()
        texts.append("".join(w + rng.choice([" "] * 6 + ["\n", "\n\n", " odd "]) for w in words))
    texts[0] = "x\n" * 2040 + licenses.TEMPLATES["MIT"][2].replace(" ", "\n", 12) + "\ny" * 30  # a run over the edge of two pieces
    lines = [x for t in texts for x in t.split("\n")]
    h = [set(m.places(licenses.word_hashes([x])[0]).tolist()) for x in lines]
    m.weigh(np.array([sum(w in x for x in h) for w in range(len(m.vocabulary))], float), len(lines))
    names, scores, shares = m.best(texts, 0.75)
    for text, name, score, share in zip(texts, names, scores, shares, strict=True):
        rows = text.split("\n")
        want = max(m.cosine(licenses.word_hashes(["\n".join(rows[i : i + s])])[0])[0] for i in range(len(rows)) for s in licenses.SPANS)
        assert (name is None and score == share == 0) if want < 0.75 else (name is not None and abs(score - want) < 1e-9 and share > 0)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], DDL)).count() == 0


def test_directories_are_not_written(spark, monkeypatch):
    names = []

    def written(df, name, keep=licenses.written):
        names.append(name)
        return keep(df, name)

    monkeypatch.setattr(licenses, "written", written)
    rows = [(0, "LICENSE", "Released under the MIT License.")] + [(i, "/".join(f"d{i % k}" for k in range(2, 2 + i % 5)) + f"/{i}.c", "int main") for i in range(1, 60)] + [(99, "d1/d1/NOTICE", "Licensed under CC BY 4.0.")]
    got = {r.doc_id: (r.license, r.origin, r.from_dir) for r in licenses.scan(spark.createDataFrame(rows, DDL)).collect()}
    assert got[0] == ("MIT", "own", None) and got[99] == ("CC-BY-4.0", "own", None) and len(got) == 61
    for i, path, _ in rows[1:-1]:
        below = path.startswith("d1/d1/")
        assert got[i] == (("CC-BY-4.0", "inherited", "d1/d1") if below else ("MIT", "inherited", ""))
    assert sorted(names) == ["license-dirs", "license-own", "nearest"]
