"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, map_text, stratified
from .textvec import word_hashes

WIDTHS = (1, 2, 3)


class ToxicityModel:
    """Words have two hashed embeddings each (two words share both with odds of 2^-2b only); filters of several widths slide over them; each filter's largest
    response in the text goes to a logistic unit. A naive Bayes table over the same buckets guesses the language, whose slope and offset calibrate the score:
    0.5 is each language's own threshold."""

    def __init__(self, log2_buckets: int, half: int = 4, filters: int = 6, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.log2_buckets, self.half, self.filters = log2_buckets, half, filters
        self.first = np.zeros((1 << log2_buckets, half), np.float32)
        self.second = np.zeros((1 << log2_buckets, half), np.float32)
        spans = sum(WIDTHS)
        self.kernel = (rng.standard_normal((2 * half, spans * filters)) * 0.15).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * filters, np.float32)
        self.out = (np.abs(rng.standard_normal(len(WIDTHS) * filters)) * 0.3).astype(np.float32)
        self.base = -1.0
        self.lang_logs = np.zeros((1 << log2_buckets, 1), np.float32)
        self.slope = np.ones(1)
        self.offset = np.zeros(1)

    def rows(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.log2_buckets) - 1)
        return (hashes & mask).astype(np.int32), ((hashes >> np.uint64(32)) & mask).astype(np.int32)

    @staticmethod
    def padded(a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """After every text come empty places, so that no window spans two texts and an empty text has one; -1 marks them."""
        gap = max(WIDTHS)
        n = len(offsets) - 1
        at = offsets + gap * np.arange(n + 1)
        place = np.arange(len(a)) + gap * np.repeat(np.arange(n), np.diff(offsets))
        pa, pb = np.full(at[-1], -1, np.int32), np.full(at[-1], -1, np.int32)
        pa[place], pb[place] = a, b
        return pa, pb, at

    def embed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = np.concatenate((self.first[a], self.second[b]), axis=1)
        x[a < 0] = 0
        return x

    def responses(self, x: np.ndarray, empty: np.ndarray) -> list[np.ndarray]:
        """Each filter's response to the window that begins at each place. One that begins at an empty place would reach into the next text: it counts as an empty window."""
        z = x @ self.kernel
        f, col, found = self.filters, 0, []
        for k, width in enumerate(WIDTHS):
            r = z[:, col : col + f].copy()
            for j in range(1, width):
                r[:-j] += z[j:, col + j * f : col + (j + 1) * f]
            col += width * f
            r[empty] = 0
            r += self.bias[k * f : (k + 1) * f]
            found.append(r)
        return found

    def pooled(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        made = [np.maximum.reduceat(r, at[:-1], axis=0) for r in self.responses(self.embed(a, b), a < 0)]
        return np.maximum(np.concatenate(made, axis=1), 0)

    def languages(self, a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros((1, self.lang_logs.shape[1])), np.cumsum(self.lang_logs[a], axis=0, dtype=np.float64)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]).argmax(axis=1)

    def logits(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        raw, lang = np.full(n, self.base), np.zeros(n, np.int64)
        a, b = self.rows(hashes)
        lo = 0
        while lo < n:  # some 60,000 words at a time
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 60_000, "right")) - 1)
            part = slice(offsets[lo], offsets[hi])
            own = offsets[lo : hi + 1] - offsets[lo]
            raw[lo:hi] += self.pooled(*self.padded(a[part], b[part], own)) @ self.out
            lang[lo:hi] = self.languages(a[part], own)
            lo = hi
        return raw, lang

    def score(self, texts: list) -> np.ndarray:
        raw, lang = self.logits(*word_hashes(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope[lang] * (raw + self.offset[lang]), -30, 30)))


def train(hashes: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, langs: np.ndarray, *, aside: int = 5, **how: object) -> ToxicityModel:
    """A model from labelled texts in random order (langs: numbers from 0, -1 unknown); the last of ``aside`` parts is kept aside for the thresholds. No copy of the words is made."""
    cut = len(toxic) - len(toxic) // aside
    at = int(offsets[cut])
    model = _learn(hashes[:at], offsets[: cut + 1], toxic[:cut], langs[:cut], **how)
    _calibrate(model, hashes[at:], offsets[cut:] - at, toxic[cut:], model.lang_logs.shape[1])
    return model


def gradients(m: ToxicityModel, a: np.ndarray, b: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray], float, np.ndarray]:
    """The weighted logistic loss of padded texts, and its gradients by out, bias and kernel, by base, and by the embedding of every place."""
    f, n = m.filters, len(y)
    x = m.embed(a, b)
    responses = m.responses(x, a < 0)
    top = np.concatenate([[at[i] + r[at[i] : at[i + 1]].argmax(axis=0) for i in range(n)] for r in responses], axis=1)
    values = np.concatenate([np.take_along_axis(r, t, axis=0) for r, t in zip(responses, np.split(top, len(WIDTHS), axis=1), strict=True)], axis=1)
    h = np.maximum(values, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.base, -30, 30)))
    loss = -float((weight * np.where(y > 0, np.log(np.maximum(p, 1e-12)), np.log(np.maximum(1 - p, 1e-12)))).sum())
    g = ((p - y) * weight).astype(np.float32)
    gh = g[:, None] * m.out * (values > 0)
    grads = {"out": h.T @ g, "bias": gh.sum(axis=0), "kernel": np.zeros_like(m.kernel)}
    gx = np.zeros_like(x)
    col = 0
    for k, width in enumerate(WIDTHS):
        first = top[:, k * f : (k + 1) * f]
        full = a[first] >= 0  # a window that begins at an empty place sees nothing
        for j in range(width):
            cols = np.arange(col + j * f, col + (j + 1) * f)
            place = np.minimum(first + j, len(x) - 1)
            part = gh[:, k * f : (k + 1) * f] * (full & (first + j < len(x)))
            grads["kernel"][:, cols] += np.einsum("nfd,nf->df", x[place], part)
            np.add.at(gx, place.ravel(), part.reshape(-1, 1) * np.broadcast_to(m.kernel[:, cols].T, (n, f, x.shape[1])).reshape(-1, x.shape[1]))
        col += width * f
    return loss, grads, float(g.sum()), gx


def _learn(
    hashes: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, langs: np.ndarray, *, log2_buckets: int = 17, epochs: int = 8, batch: int = 32, rate: float = 0.05, word_rate: float = 10.0, start: float = 0.0003, least: int = 3, seed: int = 7
) -> ToxicityModel:
    """Embeddings and filters from random numbers: nothing is known of any word beforehand. Words of under ``least`` texts have no embedding, so that chance finds teach nothing."""
    m = ToxicityModel(log2_buckets, seed=seed)
    n = len(toxic)
    y = toxic.astype(np.float32)
    a, b = m.rows(hashes)
    size = 1 << log2_buckets
    rng = np.random.default_rng(seed)
    share = y.mean()
    names = int(max(langs.max(initial=0), 0)) + 1
    counts = np.full((size, names), 0.1)
    seen_in = np.zeros((2, size))
    for lo in range(0, n, 500):  # some texts at a time: the driver stays small
        hi = min(n, lo + 500)
        part = slice(int(offsets[lo]), int(offsets[hi]))
        doc = np.repeat(np.arange(lo, hi), np.diff(offsets[lo : hi + 1]))
        for k, ids in enumerate((a[part], b[part])):
            seen_in[k] += np.bincount(np.unique(doc * np.int64(size) + ids) % size, minlength=size)  # once per text
        known = langs[doc] >= 0
        np.add.at(counts, (a[part][known], langs[doc][known]), 1)
    for table, texts in zip((m.first, m.second), seen_in, strict=True):
        table[:] = rng.standard_normal(table.shape).astype(np.float32) * start * (texts >= least)[:, None]
    m.lang_logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    squares = {k: np.full_like(getattr(m, k), 1e-3) for k in ("kernel", "bias", "out")}
    base_sq = 1e-3
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            pick = order[lo : lo + batch]
            spans = [np.arange(offsets[i], offsets[i + 1]) for i in pick]
            own = np.concatenate(([0], np.cumsum([len(s) for s in spans]))).astype(np.int64)
            words = np.concatenate(spans) if own[-1] else np.zeros(0, np.int64)
            pa, pb, at = m.padded(a[words], b[words], own)
            _, grads, base, gx = gradients(m, pa, pb, at, y[pick], weight[pick] / len(pick))
            for k, grad in grads.items():
                grad += 1e-4 * getattr(m, k)
                squares[k] += grad**2
                getattr(m, k)[...] -= rate * grad / np.sqrt(squares[k])
            base_sq += base**2
            m.base -= rate * base / np.sqrt(base_sq)
            hit = np.flatnonzero(np.any(gx != 0, axis=1) & (pa >= 0))
            for table, ids, part in ((m.first, pa, gx[:, : m.half]), (m.second, pb, gx[:, m.half :])):
                live = hit[np.any(table[ids[hit]] != 0, axis=1)]
                np.add.at(table, ids[live], -word_rate * part[live])
    return m


def _calibrate(m: ToxicityModel, hashes: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, names: int, least: int = 10) -> None:
    """For each guessed language the cut between the two labels' logits that errs least, in the middle of the best gap; the overall cut where a language has under ``least`` texts of a label."""
    raw, lang = m.logits(hashes, offsets)

    def cut(r: np.ndarray, t: np.ndarray) -> float:
        order = np.argsort(r, kind="stable")
        r, t = r[order], t[order].astype(np.int64)
        wrong = np.concatenate(([0], np.cumsum(t))) + np.concatenate((np.cumsum((1 - t)[::-1])[::-1], [0]))  # below the cut: clean
        edges = np.concatenate(([r[0] - 2], (r[1:] + r[:-1]) / 2, [r[-1] + 2]))
        gaps = np.concatenate(([4.0], np.diff(r), [4.0]))
        best = np.flatnonzero(wrong == wrong.min())
        return float(edges[best[gaps[best].argmax()]])

    whole = cut(raw, toxic) if len(raw) else 0.0
    m.slope, m.offset = np.full(names, 1.5), np.full(names, -whole)
    for k in range(names):
        own = lang == k
        if min(toxic[own].sum(), (1 - toxic[own]).sum()) >= least:
            m.offset[k] = -float(np.clip(cut(raw[own], toxic[own]), whole - 0.75, whole + 0.75))  # few texts must not pull a threshold far away


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = 5000, log2_buckets: int = 17) -> ToxicityModel | None:
    """A model of the documents with a toxic label (0 or 1): ``bound`` of each label at most, picked by a hash of the key; both must occur, else None.

    ``lang`` of these rows teaches the language guess; it is no input of a score. Words are hashed on the executors; the driver gets their hashes only.
    A document with several labels counts as toxic if one of them says so.
    """
    arrow_batches(docs.sparkSession)
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = F.broadcast(stratified(marked, key, "toxic", bound))  # by its size: 2 * bound rows or so
    rows = docs.select(key, text, lang).join(picked, key)

    def hashed(texts: list) -> dict:
        h, at = word_hashes(texts)
        return {"words": [h[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]}

    kind = dict(docs.dtypes)[key]
    found = map_text(rows, hashed, f"`{key}` {kind}, `{lang}` string, toxic int, words binary", keep=[key, lang, "toxic"], text=text).toArrow()
    toxic = np.array(found["toxic"].to_pylist(), np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    ids, langs = found[key].to_pylist(), found[lang].to_pylist()
    sizes = pc.binary_length(found["words"]).to_numpy() // 8
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), str(ids[i]), int(sizes[i])))  # random, but the same whatever the partitions
    offsets = np.concatenate(([0], np.cumsum(sizes[order]))).astype(np.int64)
    hashes = np.empty(offsets[-1], np.uint64)
    for place, i in enumerate(order):
        hashes[offsets[place] : offsets[place + 1]] = np.frombuffer(found["words"][i].as_buffer() or b"", np.uint64)
    del found
    names = sorted({x for x in langs if x is not None})
    number = {x: k for k, x in enumerate(names)}
    return train(hashes, offsets, toxic[order], np.array([number.get(langs[i], -1) for i in order]), log2_buckets=log2_buckets)


def score(docs: DataFrame, model: ToxicityModel | None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score (0 to 1, higher: likelier toxic), predicted (1 from 0.5 on) for every row, from the whole text alone.

    Null and empty texts score as a text without words does (0.0 where no model could be learnt, as for all rows then). Repeated rows stay and score alike; columns
    besides ``keep`` go; an empty table gives none. The model is broadcast; its size depends on the parameters (2^17 buckets: some 7 MB).
    """
    arrow_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> dict:
        odds = np.zeros(len(texts)) if sent.value is None else sent.value.score(texts)
        return {"score": odds, "predicted": (odds >= 0.5).astype(np.int32)}

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double", "predicted int"])
    return map_text(docs, run, schema, keep=list(keep), text=text)
