"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, map_text, stratified
from .textvec import code_points

ORDERS = (1, 2, 3)
_STEPS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def ngram_buckets(texts: list, log2_buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram that ends at each character of the lower-cased texts (every text begins and ends with a space), and n + 1 offsets."""
    points, offsets = code_points([f" {(t or '').lower()} " for t in texts])
    points = np.where(points <= 32, np.uint32(32), points).astype(np.uint32)
    shift = np.uint32(32 - log2_buckets)
    found = []
    sums = np.zeros(len(points), np.uint32)
    for k, order in enumerate(ORDERS):
        moved = np.zeros(len(points), np.uint32)
        moved[k:] = points[: len(points) - k] * _STEPS[k]
        sums = sums + moved
        mixed = (sums ^ (sums >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * order)
        found.append((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x297A2D39) >> shift)
    return found, offsets


class LanguageModel:
    """Log probabilities of buckets by language (orders x buckets x languages)."""

    def __init__(self, names: list[str], logs: np.ndarray, log2_buckets: int) -> None:
        self.names, self.logs, self.log2_buckets = names, logs, log2_buckets

    @classmethod
    def fit(cls, names: list[str], counts: np.ndarray, log2_buckets: int, smoothing: float = 0.5) -> LanguageModel:
        """counts: orders x languages x buckets."""
        rates = counts + smoothing
        logs = np.log(rates / rates.sum(axis=2, keepdims=True))
        return cls(names, np.ascontiguousarray(logs.transpose(0, 2, 1), np.float32), log2_buckets)

    def score(self, texts: list) -> tuple[list[str], list[float]]:
        """The likeliest language and its probability. A language's log likelihood is divided by the root of the number of
        n-grams, as n-grams of one text depend on each other; und with 0.0 for texts without a letter."""
        grams, offsets = ngram_buckets(texts, self.log2_buckets)
        total = np.zeros((len(texts), len(self.names)))
        step = 1 << 18
        n = len(grams[0])
        for lo in range(0, n, step):  # rows of the matrix are gathered piece by piece
            hi = min(n, lo + step)
            sums = sum(self.logs[k][g[lo:hi]] for k, g in enumerate(grams))
            first = int(np.searchsorted(offsets, lo, "right")) - 1
            last = int(np.searchsorted(offsets, hi, "left"))
            cuts = np.maximum(offsets[first:last], lo) - lo
            total[first:last] += np.add.reduceat(sums, cuts, axis=0, dtype=np.float64)
        scaled = total / np.sqrt(np.maximum(1, np.diff(offsets)))[:, None]
        odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        letters = [any(map(str.isalpha, t or "")) for t in texts]  # Unicode category L
        return [self.names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], [float(p[b]) if ok else 0.0 for p, b, ok in zip(odds, best, letters, strict=True)]


def fit(rows: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = 4000, log2_buckets: int = 15) -> LanguageModel | None:
    """A model of rows with a language: ``bound`` rows of each at most are counted, picked by a hash of the key. None without any such row.

    Counting is distributed; the driver gets orders x languages x buckets sums, whatever the number of rows.
    """
    arrow_batches(rows.sparkSession)
    picked = stratified(rows.where(F.col(lang).isNotNull()), key, lang, bound)
    buckets = 1 << log2_buckets

    def count(texts: list) -> dict:
        # one sparse row per text: ids hold order * buckets + bucket
        grams, offsets = ngram_buckets(texts, log2_buckets)
        made: dict[str, list] = {"ids": [], "counts": []}
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            ids, n = np.unique(np.concatenate([g[a:b].astype(np.int64) + k * buckets for k, g in enumerate(grams)]), return_counts=True)
            made["ids"].append(ids.astype(np.int32))
            made["counts"].append(n.astype(np.int32))
        return made

    sparse = map_text(picked, count, f"`{lang}` string, ids array<int>, counts array<int>", keep=[lang], text=text)
    cells = sparse.select(lang, F.explode(F.arrays_zip("ids", "counts")).alias("c")).groupBy(lang, F.col("c.ids").alias("id")).agg(F.sum("c.counts").alias("n"))
    found = cells.toPandas()
    if not len(found):
        return None
    names = sorted(found[lang].unique())
    counts = np.zeros((len(ORDERS), len(names), buckets))
    ids = found["id"].to_numpy()
    counts[ids // buckets, np.searchsorted(names, found[lang].to_numpy(str)), ids % buckets] = found["n"].to_numpy()
    return LanguageModel.fit(names, counts, log2_buckets)


def predict(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score for every row of docs, from the whole text alone.

    ``und`` and 0.0 for null texts, texts without a letter, and where no model could be learnt. Ties go to the first language by name.
    Repeated rows stay; columns besides ``keep`` go; an empty table gives none. The matrix is broadcast: its size depends on the parameters
    and the number of languages only (4 languages, 2^15 buckets, 3 orders: 1.5 MB).
    """
    arrow_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> dict:
        if sent.value is None:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
        names, odds = sent.value.score(texts)
        return {"lang_pred": names, "score": odds}

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"])
    return map_text(docs, run, schema, keep=list(keep), text=text)
