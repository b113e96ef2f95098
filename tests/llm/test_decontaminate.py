import collections
import re

import numpy as np

from inkstrata.llm import decontaminate as d
from inkstrata.llm.queries import QUERIES


def slow_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_subsequence_lengths():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(0, 60))
        assert d.lcs(len(a), d.bits_of(a), b) == slow_lcs(a, b)


def _corpus(spark, n=300):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(3000)]
    say = lambda k: list(rng.choice(words, k))
    items = [say(int(k)) for k in rng.integers(8, 130, 12)]
    docs = [say(int(k)) for k in rng.integers(0, 400, n)]
    planted = {}
    for i, item in enumerate(items):
        at = 7 * i + 3
        cut = len(docs[at]) // 2
        copy = list(item)
        if i % 3 == 1:  # a paraphrase: every fifth word replaced, the answer kept
            copy[: len(copy) - 6 : 5] = say(len(copy[: len(copy) - 6 : 5]))
        if i % 3 == 2:
            copy = [w.upper() + "," for w in copy]
        docs[at][cut:cut] = copy
        planted[at] = i
    docs[5] += items[0][: len(items[0]) // 3]  # a third of an item is no leak
    rows = [(i, " ".join(t)) for i, t in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"), planted


def test_planted_items_and_paraphrases(spark):
    docs, items, planted = _corpus(spark)
    got = d.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(planted.items())


def test_cosines_of_windows(spark):
    rng = np.random.default_rng(4)
    terms = np.concatenate((rng.standard_normal((1 << 15, 8)), np.zeros((1, 8)))).astype(np.float32)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 50, k)) for k in (0, 5, 70, 33)]
    items = d.Items([1, 2], [texts[2], "t1 t2 t3"], terms, 15)
    h, at = d.word_hashes(texts)
    for t, i, lo, hi, c in d.candidates(h, at, terms, items, 15, 0.3):
        w = terms[d.buckets_of(h[at[t] + lo : at[t] + hi], 15)].sum(axis=0)
        places = [p for which, p in items.scales for k, p in zip(which, p, strict=True) if k == i]
        assert abs(max(float(w @ p) / np.linalg.norm(w) for p in places) - c) < 1e-4 or len(places) > 1


def test_odd_tables(spark):
    docs, items, planted = _corpus(spark, 90)
    odd = docs.selectExpr("doc_id", "text", "1 AS item_id", "2.0 AS cosine").union(spark.createDataFrame([(None, None, 1, 2.0), (3, "", 1, 2.0)], "doc_id long, text string, item_id int, cosine double"))
    more = items.union(spark.createDataFrame([(None, "x"), (70, None), (71, ""), (0, "copy of an id")], "item_id long, text string"))
    assert {r.doc_id for r in d.leaks(odd, more).collect()} == set(planted)
    assert d.leaks(docs.limit(0), items).count() == 0 and d.leaks(docs, items.limit(0)).count() == 0
    doubled = d.leaks(docs.union(docs), items).count()
    assert doubled == 2 * len(planted)


def test_svd_against_numpy(spark):
    docs, items, _ = _corpus(spark)
    idf, total = d.inverse_frequencies(docs, "text", 15)
    rows = d.sampled_bags(docs, items, total, key="doc_id", text="text", sample=10**6, log2_buckets=15, seed=3)
    assert rows.rdd.getNumPartitions() > 1
    bags = [r.bag for r in rows.collect()]
    a = np.zeros((len(bags), 1 << 15))
    for row, bag in zip(a, bags, strict=True):
        ids, n = np.unique(np.frombuffer(bag, np.int32), return_counts=True)
        row[ids] = n * idf[ids]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    few = spark.createDataFrame([(b,) for b in bags[:60]], "bag binary").repartition(5)
    vectors, sigma = d.randomised_svd(few, idf, 64)  # as many columns as passages: exact
    _, want, right = np.linalg.svd(a[:60], full_matrices=False)
    assert len(sigma) == 60 and np.allclose(sigma, want, atol=1e-4)
    assert np.allclose(vectors @ vectors.T[:, :500], right.T @ right[:, :500], atol=1e-3)
    _, sigma = d.randomised_svd(rows, idf, 16)  # fewer columns: close below
    want = np.linalg.svd(a, compute_uv=False)[:16]
    assert (sigma <= want + 1e-6).all() and (sigma >= 0.6 * want).all()


def test_all_item_passages_are_fitted(spark):
    docs = spark.createDataFrame([(i, f"filler{i} " * 80) for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join(f"q{i}" for i in range(64 * 90)))], "item_id long, text string")
    _, total = d.inverse_frequencies(docs, "text", 15)
    rows = d.sampled_bags(docs, items, total, key="doc_id", text="text", sample=4, log2_buckets=15, seed=3).collect()
    assert 90 <= len(rows) <= 110


def test_query_against_brute_force(spark, sf):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for i, item in items.items():
        n, bag = len(item), collections.Counter(item)
        for k, doc in docs.items():
            if sum(min(c, bag[w]) for w, c in collections.Counter(doc).items() if w in bag) < 0.6 * n:
                continue
            for lo in range(0, max(1, len(doc) - 2 * n), max(1, n // 4)):
                part = doc[lo : lo + 3 * n]
                if sum((collections.Counter(part) & bag).values()) < 0.6 * n:
                    continue
                share = slow_lcs(item, part) / n
                if share >= 0.7 or share >= 0.6 and slow_lcs(item[-6:], part) >= 0.8 * min(6, n):
                    want.add((k, i))
                    break
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, sf).collect()}
    assert want and got == want


def test_every_passage_is_fitted(spark, monkeypatch):
    """All passages of documents and items, each distinct one once; IDF counts the documents' with repeats."""
    seen, svd = [], d.randomised_svd
    monkeypatch.setattr(d, "randomised_svd", lambda rows, *a, **k: (seen.extend(r.bag for r in rows.collect()), svd(rows, *a, **k))[1])
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(64 * (1 + i % 3)))) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(0, " ".join(f"q{i}" for i in range(64 * 3)))], "item_id long, text string")
    assert d.leaks(docs.unionAll(docs.where("doc_id < 50")), items).count() == 0
    passages = [w[k : k + 64] for t in [r[1] for r in rows] + [items.first().text] for w in [t.split(" ")] for k in range(0, len(w), 64)]
    h, _ = d.word_hashes([" ".join(p) for p in passages])
    want = {np.sort(b).astype(np.uint16).tobytes() for b in d.buckets_of(h, 15).reshape(-1, 64)}
    assert len(seen) == len(want) == len(passages) > 24_000 and set(seen) == want


def test_frequencies_count_passages(spark):
    texts = spark.createDataFrame([("a a b", 1), ("a a b", 1), ("b c", 1), (None, 1), ("", 1), ("c d", 0)], "text string, n int")
    idf, total = d.frequencies(d.passage_bags(texts, 15), 15)
    h, _ = d.word_hashes(["a b c d"])
    assert total == 3 and np.allclose(idf[d.buckets_of(h, 15)], np.log(4 / np.array([3, 4, 2, 1])))
