import hashlib
import itertools

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.llm import fingerprint as fp

WORDS = ["stone", "river", "lantern", "orchard", "velvet", "copper", "harbour", "meadow", "thunder", "quill", "amber", "willow"]


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS) + str(rng.integers(0, 999)) for _ in range(n))


def test_interior_phrases_do_not_depend_on_the_offset():
    a = text(1, 300)
    for shift in ("x", "some words in front ", "yyyyyyyyyy"):
        assert fp.likeness(fp.sketches([a]), fp.sketches([shift + a]))[0] > 0.8
    assert fp.likeness(fp.sketches([a]), fp.sketches([text(2, 300)]))[0] < 0.2


def test_share_of_phrases_follows_the_share_of_text():
    a, b = text(3, 800), text(4, 800)
    mixed = fp.edited(a, b)
    assert 0.4 < fp.likeness(fp.sketches([a]), fp.sketches([mixed]))[0] < 0.8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=300), min_size=1, max_size=5), st.text(max_size=50))
def test_sketch_of_a_text_does_not_depend_on_its_batch(texts, other):
    together = fp.sketches([other, *texts, other])
    assert all((together[i + 1] == fp.sketches([t])[0]).all() for i, t in enumerate(texts))


def test_repeats_and_runs():
    s = fp.sketches(["a" * 5000, "a" * 5000, "ab" * 2500, "", None])
    assert (s[0] == s[1]).all() and (s[3] == fp.NONE).all() and (s[4] == fp.NONE).all()
    assert fp.likeness(s[3:4], s[4:5])[0] == 1.0


M = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & M
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & M
    return x ^ x >> 33


def coin(x, y):
    low = 0 if x == y else ((x ^ y) & -(x ^ y)).bit_length() - 1
    return 2 * low + (x >> low & 1)


def plain_sketch(t):
    """The bins of one text, parsed name by name."""
    bins = [None] * fp.BINS
    names = [mix(ord(c) + 1) for c in t]
    while names:
        runs = [(k, len(list(g))) for k, g in itertools.groupby(names)]
        names = [mix(k + n * 0x9E3779B97F4A7C15 & M) if n > 1 else k for k, n in runs]
        labels = names
        for _ in range(3):
            labels = [0] + [coin(x, y) for y, x in itertools.pairwise(labels)]
        n = len(names)
        cuts = [0, *(i for i in range(2, n) if labels[i - 1] < labels[i] >= (labels[i + 1] if i + 1 < n else 0)), n]
        names = [mix(sum(x * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, x in enumerate(names[a:b])) + 0x51ED270B7A1F3C95 & M) for a, b in itertools.pairwise(cuts)]
        for x in names:
            top = min(x >> 32, 0xFFFEFFFF)
            bins[x % fp.BINS] = top if bins[x % fp.BINS] is None else min(bins[x % fp.BINS], top)
        if len(names) == 1:
            break
    return [fp.NONE if x is None else x >> 16 for x in bins]


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab ", max_size=200), st.integers(0, 99).map(lambda k: text(k, 40))))
def test_parsing_name_by_name(t):
    assert fp.sketches([t])[0].tolist() == plain_sketch(t)


def test_likeness_has_no_step_in_length():
    found = []
    for n in (20, 60, 198, 199, 200, 201, 400, 1000):
        texts = [text(k, n)[:n] for k in range(60)]
        found.append(fp.likeness(fp.sketches(texts), fp.sketches([t + "q" for t in texts])).mean())
    assert all(b > a - 0.04 for a, b in itertools.pairwise(found)) and found[-1] > 0.9


def test_query_against_brute_force(spark):
    rows = [(i * 3, text(i, 5 + i * 7) if i % 5 else ("" if i else None)) for i in range(60)] + [(177, "last"), (177, "least"), (None, "no key")]
    for kind, cast in (("long", lambda k: k), ("string", lambda k: None if k is None else f"{k:05}")):
        keyed = [(cast(k), t) for k, t in rows]
        docs = spark.createDataFrame([(k, t, 1) for k, t in keyed], f"doc_id {kind}, text string, bucket int")
        out = {(r.doc_id, r.fingerprint): r for r in fp.with_edits(docs, bucket_rows=7).collect()}
        th = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64)  # noqa: E731  as a signed number
        order = sorted(keyed, key=lambda r: (r[0] is not None, r[0] or cast(0), th(r[1])))
        texts = [t or "" for _, t in order]
        assert len(out) == len(rows)
        for (k, _), t, nxt in zip(order, texts, texts[1:] + texts[:1], strict=True):
            e = fp.edited(t, nxt)
            own, other, after = (np.array([plain_sketch(x)], ">u2") for x in (t, e, nxt))
            r = out[k, fp._hex(own)[0]]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.edited_fingerprint == fp._hex(other)[0]
            assert r.near_edited == fp.likeness(own, other)[0] and r.near_next == fp.likeness(own, after)[0]


def test_odd_tables(spark):
    odd = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "zz"), (9, "é😀x")], "doc_id long, text string")
    out = fp.with_edits(odd, bucket_rows=1).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "1", "9", "None"]
    assert fp.with_edits(odd.limit(0)).count() == 0
    (one,) = fp.with_edits(odd.where("doc_id = 9")).collect()
    assert one.near_next == 1.0 and one.n_chars == 3
