import itertools
import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from inkstrata.llm import simhash
from inkstrata.llm.components import components
from inkstrata.llm.queries import QUERIES


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(values, budget=3):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= budget:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab AÀ\t\n\x0b　 é.", max_size=40), max_size=6))
def test_fingerprints_match_the_definition(texts):
    assert simhash.simhash([*texts, None]) == [plain(t) for t in [*texts, None]]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 120), st.sampled_from([1, 16, 4096]))
def test_trie_finds_every_near_pair_once(seed, n, leaf):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    values = sorted({rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(n)} | {0, 2**64 - 1})
    got = [(int(i), int(j)) for a, b in simhash.trie_links(np.zeros(len(values), np.int64), np.array(values, np.uint64), 3, leaf) for i, j in zip(a, b, strict=True)]
    want = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 3]
    assert sorted(got) == want


def test_components_equal_brute_force_with_hot_subtrees(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(300)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.fingerprint_links(fps, slice_rows=8)
    found = {r.node: r.component for r in components(links).collect()}
    want = groups(values)
    classes = {}
    for v, w in zip(signed, want, strict=True):
        classes.setdefault(w, set()).add(found.get(v, v))
    assert all(len(c) == 1 for c in classes.values())
    assert len({c.pop() for c in classes.values()}) == len(set(want))


def test_rows_of_every_kind(spark):
    rows = [(3, "Same words here now", 1), (1, "same WORDS here now", 2), (1, "same WORDS here now", 2), (5, None, 3), (4, "", 4), (6, " \n", 5), (None, "alone " * 9, 6), (7, "x" * 100_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    out = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert len(out) == len(rows)
    by = {r[0]: r for r in out}
    assert by[3][2] == by[1][2] == 1
    assert by[5] == (5, "0" * 16, 4) and by[6][2] == by[4][2] == 4
    assert by[None][2] is None
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    prints = [plain(texts[k]) for k in ids]
    want = {k: (f"{fp:016x}", ids[root]) for k, fp, root in zip(ids, prints, groups(prints), strict=True)}
    got = QUERIES["op1_simhash"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(ids)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 80), st.sampled_from([1, 4, 4096]))
def test_pairs_of_sides_only(seed, n, leaf):
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    rows = sorted((rng.randrange(3), rng.randrange(2), v) for v in {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(n)})
    g, side, v = (np.array(x, t) for x, t in zip(zip(*rows, strict=True), (np.int64, np.int64, np.uint64), strict=True))
    got = sorted((int(i), int(j)) for a, b in simhash.trie_links(g, v, 3, leaf, side) for i, j in zip(a, b, strict=True))
    whole = {k for k in set(g.tolist()) if not side[g == k].any()}
    want = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if g[i] == g[j] and (side[i] != side[j] or int(g[i]) in whole) and int(v[i] ^ v[j]).bit_count() <= 3]
    only = {k for k in set(g.tolist()) if side[g == k].all()}  # a side without another has no pair
    assert got == [p for p in want if int(g[p[0]]) not in only]


def test_wide_hot_subtrees_equal_brute_force(spark):
    rng = random.Random(12)
    centres = [[rng.getrandbits(64) for _ in range(2)] for _ in range(3)]
    rows = set()
    for c, spread in ((0, 10), (1, 14), (2, 40)):
        for _ in range(150):
            flips = rng.sample(range(128), rng.randint(0, spread))
            rows.add(tuple(centres[c][w] ^ sum(1 << (b % 64) for b in flips if b // 64 == w) for w in range(2)))
    rows = sorted(rows)
    signed = [tuple(v - (1 << 64) if v >> 63 else v for v in r) for r in rows]
    df = spark.createDataFrame([(*r, 0, 0) for r in signed], "w0 long, w1 long, trie int, top long")
    found = {r.node: r.component for r in components(simhash._joined(df, ["w0", "w1"], 16, 40)).collect()}
    names = [r.h for r in df.select(F.xxhash64("w0", "w1").alias("h"), "w0", "w1").collect()]
    want = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if want[i] != want[j] and sum((a ^ b).bit_count() for a, b in zip(rows[i], rows[j], strict=True)) <= 16:
            want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    classes = {}
    for name, w in zip(names, want, strict=True):
        classes.setdefault(w, set()).add(found.get(name, name))
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 90)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert {got[i] for i in range(1, 91)} == {1} and got[501] == 500


def test_walk_over_several_words():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    rows = []
    for _ in range(150):
        v = centre.copy()
        for b in rng.choice(256, rng.integers(0, 30), replace=False):
            v[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append(tuple(v.tolist()))
    v = np.array(sorted(set(rows)), np.uint64)
    for leaf in (1, 64, 4096):
        got = sorted((int(i), int(j)) for a, b in simhash.trie_links(np.zeros(len(v), np.int64), v, 20, leaf) for i, j in zip(a, b, strict=True))
        want = [(i, j) for i, j in itertools.combinations(range(len(v)), 2) if int(np.bitwise_count(v[i] ^ v[j]).sum()) <= 20]
        assert got == want


def test_alike_documents_are_found(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        texts.append(base)
        for edits in (0.0, 0.004, 0.02):  # a changed word spoils five shingles
            copy = list(base)
            for k in range(len(copy)):
                if rng.random() < edits:
                    copy[k] = rng.choice(words)
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    assert sum(got[a] == got[b] for a, b in alike) >= 0.97 * len(alike)
    assert all(a // 4 == b // 4 for a, b in got.items())  # never two families


def test_alike_rows_of_every_kind(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g", 1), (1, "A b c d e f g", 1), (1, "A b c d e f g", 1), (3, None, 1), (4, "", 1), (None, "other words", 1), (5, "x " * 60_000, 1)], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.similar_documents(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (None, None), (5, 5)], key=str)
    assert simhash.similar_documents(docs.limit(0)).count() == 0


def test_repeated_lines_neither_link_nor_part(spark):
    rng = random.Random(7)
    line = "the same line over and over "
    own = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(200)) + " " for _ in range(3)]
    rows = [(1, own[0] + line), (2, own[0] + line * 20), (3, own[1] + line * 60), (4, own[2] + line * 60)]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_links_are_confirmed_exactly(spark):
    rng = random.Random(8)
    rows, word = [], iter(f"u{i}" for i in range(10**6))
    for f in range(40):
        text = [next(word) for _ in range(104)]
        for _ in range(6):  # a drifting family: neighbours near the threshold on either side
            rows.append((len(rows), " ".join(text)))
            for at in rng.sample(range(2, 100, 6), rng.choice([1, 2, 3])):
                text[at] = next(word)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = list(range(len(rows)))
    for _ in rows:
        for a, b in itertools.combinations(range(len(rows)), 2):
            if a // 6 == b // 6 and want[a] != want[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want = [min(want[a], want[b]) if x in (want[a], want[b]) else x for x in want]
    assert all(want[a] == want[got[a]] for a in got)  # nothing linked that exact similarities don't connect
    assert sum(got[a] == want[a] for a in got) >= 0.95 * len(rows)
