import zlib

import numpy as np

from inkstrata.llm import langid, textvec, toxicity
from inkstrata.llm.queries import QUERIES


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["One two, ONE!", "", None, "äöü zwei_drei 4"]
    h, at = textvec.word_hashes(texts)
    assert at.tolist() == [0, 3, 3, 3, 7] and h[0] == h[2]
    for i, t in enumerate(texts):
        own, _ = textvec.word_hashes([t])
        assert (h[at[i] : at[i + 1]] == own).all()


def test_language_scores_by_hand():
    names, bits = ["a", "b"], 8
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, (3, 2, 1 << bits)).astype(float)
    m = langid.LanguageModel.fit(names, counts, bits)
    text = "Hello there"
    grams, at = langid.ngram_buckets([text], bits)
    total = np.zeros(2)
    for k, g in enumerate(grams):
        rates = (counts[k] + 0.5) / (counts[k] + 0.5).sum(axis=1, keepdims=True)
        total += np.log(rates)[:, g].sum(axis=1)
    scaled = total / np.sqrt(at[1])
    p = np.exp(scaled - scaled.max())
    p /= p.sum()
    got = m.score([text, None, "123 !", text])
    assert got[0] == [names[int(p.argmax())], "und", "und", names[int(p.argmax())]]
    assert abs(got[1][0] - p.max()) < 1e-4 and got[1][1:3] == [0.0, 0.0]


def test_language_holds_out(spark, sf):
    out = QUERIES["op3_langid"](spark, sf).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").lang
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in out.iterrows())
    held = out[out.held_out]
    assert (held.lang_pred == truth[held.index]).mean() > 0.95 and out.score.between(0, 1).all()


def _labelled(spark, n=600):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        t = list(rng.choice(words, 40))
        bad = i % 4 == 0
        if bad:
            t[rng.integers(0, 40)] = str(rng.choice(["vile", "Nasty!!", "grim***"]))
        rows.append((i, " ".join(t), "en" if i % 2 else "de", int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_toxicity_learns_words_and_keeps_clean_texts(spark):
    rows = _labelled(spark)
    model = toxicity.fit(rows.where("doc_id % 3 > 0").drop("toxic"), rows.where("doc_id % 3 > 0").select("doc_id", "toxic"))
    out = toxicity.score(rows.where("doc_id % 3 = 0"), model, keep=("doc_id", "toxic")).toPandas()
    assert (out.predicted == out.toxic).mean() > 0.97
    assert ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_toxicity_scores_do_not_depend_on_the_batch(spark):
    rows = _labelled(spark, 300)
    model = toxicity.fit(rows.drop("toxic"), rows.select("doc_id", "toxic"))
    texts = ["a b c", "", None, "vile", "x " * 5000 + "nasty"]
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts])


def test_every_gradient_by_differences():
    rng = np.random.default_rng(4)
    m = toxicity.ToxicityModel(6)
    for name in ("first", "second", "kernel", "bias", "out"):  # double, so that differences are exact enough
        setattr(m, name, rng.standard_normal(getattr(m, name).shape) * 0.4)
    sizes = [7, 0, 1, 12]
    a, b, at = m.padded(*(rng.integers(0, 64, sum(sizes)).astype(np.int32) for _ in range(2)), np.concatenate(([0], np.cumsum(sizes))))
    y, w = np.array([1.0, 0, 1, 0]), np.array([0.5, 0.2, 0.9, 0.4])
    _, grads, base, gx = toxicity.gradients(m, a, b, at, y, w)

    def slope(array, spot):
        kept = array[spot]
        found = []
        for d in (1e-5, -1e-5):
            array[spot] = kept + d
            found.append(toxicity.gradients(m, a, b, at, y, w)[0])
        array[spot] = kept
        return (found[0] - found[1]) / 2e-5

    for name, grad in grads.items():
        for spot in [tuple(rng.integers(0, k) for k in grad.shape) for _ in range(25)]:
            assert abs(slope(getattr(m, name), spot) - grad[spot]) < 1e-4
    for word in np.unique(a[a >= 0])[:12]:
        assert abs(slope(m.first, (word, 1)) - gx[a == word, 1].sum()) < 1e-4
    m.base += 1e-5
    up = toxicity.gradients(m, a, b, at, y, w)[0]
    m.base -= 2e-5
    assert abs((up - toxicity.gradients(m, a, b, at, y, w)[0]) / 2e-5 - base) < 1e-4


def test_training_is_what_tells_toxic_texts():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) + (f" bad{rng.integers(0, 6)} tail" if i % 3 == 0 else "") for i in range(900)]
    toxic = np.array([i % 3 == 0 for i in range(900)], np.int64)
    h, at = textvec.word_hashes(texts)
    right = {}
    for epochs in (0, 8):
        m = toxicity.train(h[: at[700]], at[:701], toxic[:700], np.zeros(700, np.int64), epochs=epochs)
        right[epochs] = ((m.score(texts[700:]) >= 0.5) == toxic[700:]).mean()
    assert right[8] > 0.95 and right[0] < 0.75


def test_responses_by_loops():
    """The convolution's responses, pooled by hand."""
    m = toxicity.ToxicityModel(6)
    rng = np.random.default_rng(3)
    m.first[:], m.second[:] = rng.standard_normal(m.first.shape), rng.standard_normal(m.second.shape)
    h, at = textvec.word_hashes(["one two three four", "five"])
    a, b = m.rows(h)
    got = m.pooled(*m.padded(a, b, at))
    for i in range(2):
        x = np.concatenate((m.first[a[at[i] : at[i + 1]]], m.second[b[at[i] : at[i + 1]]]), axis=1)
        x = np.concatenate((x, np.zeros((3, x.shape[1]))))
        col, want = 0, []
        for k, w in enumerate(toxicity.WIDTHS):
            r = [sum(x[p + j] @ m.kernel[:, col + j * m.filters : col + (j + 1) * m.filters] for j in range(w)) + m.bias[k * m.filters : (k + 1) * m.filters] for p in range(at[i + 1] - at[i])]
            empty = m.bias[k * m.filters : (k + 1) * m.filters]
            want.append(np.maximum(np.maximum(np.max(r, axis=0), empty), 0))
            col += w * m.filters
        assert np.allclose(got[i], np.concatenate(want), atol=1e-5)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "en", 5.0), (1, None, "en", 5.0), (None, "words", None, 1.0), (3, "", "de", 2.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None
    out = toxicity.score(docs, None).collect()
    assert len(out) == 4 and all(r.score == 0 and r.predicted == 0 for r in out)
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == 4 and {r.lang_pred for r in got if r.doc_id == 1} == {"und"}
    assert langid.fit(docs.limit(0)) is None and langid.predict(docs.limit(0), None).count() == 0
    assert toxicity.score(docs.limit(0), None).count() == 0


def test_letters_are_those_of_category_l(spark):
    rows = [(i, "plain words of a language", "en") for i in range(6)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, odds = model.score(["\u00b2 \u00bd \u2167 12", "\u02b0", "\u4e2d", "\u0661\u0301_"])
    assert names == ["und", "en", "en", "und"] and odds[0] == odds[3] == 0.0
