"""Benchmark decontamination by latent semantic retrieval: TF-IDF passages, randomised SVD, cosine candidates, then subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_batches, map_text, trimmed, written
from .textvec import word_hashes

BLOCK = 8  # words; windows begin at multiples of it
SCALES = (2, 4, 6)  # window lengths in blocks


def buckets_of(hashes: np.ndarray, log2_buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - log2_buckets)).astype(np.int32)


def passages(offsets: np.ndarray, words: int = 64) -> np.ndarray:
    """The number of the fixed passage of ``words`` words that each word belongs to, counted over all texts."""
    sizes = np.diff(offsets)
    count = -(-sizes // words)
    first = np.cumsum(count) - count
    return np.repeat(first, sizes) + (np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)) // words


def passage_bags(texts: DataFrame, log2_buckets: int) -> DataFrame:
    """(bag, n): every distinct passage of all texts (text, n), as its words' buckets in order (16 bits each up to 2^16 buckets), and the sum of n over where it stands. Written once; IDF and SVD both read it."""
    arrow_batches(texts.sparkSession)
    size = 1 << log2_buckets
    kind = bag_kind(log2_buckets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, 100):
                h, at = word_hashes(batch.column(0).slice(lo, 100).to_pylist())
                if not len(h):
                    continue
                p = passages(at)
                words = (np.sort(p * size + buckets_of(h, log2_buckets)) % size).astype(kind)
                first = np.flatnonzero(np.diff(p, prepend=-1))
                ends = (np.append(first, len(p)) * kind.itemsize).astype(np.int32)
                bags = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(words.tobytes())])
                yield pa.RecordBatch.from_arrays([bags, pa.array(n[lo + np.searchsorted(at, first, side="right") - 1], pa.int64())], ["bag", "n"])

    rows = texts.select("text", F.col("n").cast("long").alias("n")).mapInArrow(trimmed(cut), "bag binary, n long")
    return written(rows.groupBy("bag").agg(F.sum("n").alias("n")), "lsa-passages")


def bag_kind(log2_buckets: int) -> np.dtype:
    return np.dtype(np.uint16 if log2_buckets <= 16 else np.int32)


def term_counts(bags: list, size: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bag, bucket, times) of all bags, in this order."""
    lengths = np.fromiter(map(len, bags), np.int64, len(bags)) // kind.itemsize
    keys = np.repeat(np.arange(len(bags)), lengths) * size + np.frombuffer(b"".join(bags), kind)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first] // size, keys[first] % size, np.diff(first, append=len(keys))


def frequencies(rows: DataFrame, log2_buckets: int) -> tuple[np.ndarray, int]:
    """log((1 + passages) / (1 + passages with the bucket)) over all passages (bag, n), and their number; partial counts are combined before the shuffle, and 2^log2_buckets sums reach the driver."""
    size = 1 << log2_buckets
    kind = bag_kind(log2_buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        total = 0
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            row, b, _ = term_counts(batch.column(0).to_pylist(), size, kind)
            np.add.at(found, b, n[row])
            total += int(n.sum())
        live = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(live, -1)), pa.array(np.append(found[live], total))], ["b", "n"])

    sums = rows.select("bag", "n").mapInArrow(trimmed(count), "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    b, n = sums["b"].to_numpy(), sums["n"].to_numpy()
    df = np.zeros(size)
    df[b[b >= 0]] = n[b >= 0]
    total = int(n[b < 0].sum())
    return np.log((1 + total) / (1 + df)).astype(np.float32), total


def inverse_frequencies(docs: DataFrame, text: str, log2_buckets: int) -> tuple[np.ndarray, int]:
    """``frequencies`` over the passages of all documents."""
    return frequencies(passage_bags(docs.select(F.col(text).alias("text"), F.lit(1).alias("n")), log2_buckets), log2_buckets)


def sampled_bags(docs: DataFrame, items: DataFrame, total: int, *, key: str, text: str, sample: int, log2_buckets: int, seed: int, spread: int = 8, tasks: int = 16) -> DataFrame:
    """(bag): the distinct passages of all items, and about ``sample`` of the ``total`` passages of the corpus, in ``tasks`` partitions, as 32-bit buckets. For trials on a part; ``leaks`` fits on every passage.

    A hash of key and text picks ``spread`` times as many passages' documents as wanted; of these, wherever in the text, a hash of the passage picks one in ``spread``.
    """
    of_docs = min(1.0, spread * sample / max(total, 1))
    of_passages = min(1.0, sample / max(total, 1) / of_docs)
    whole = 1 << 30
    picked = docs.where(F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(seed)), F.lit(whole)) < int(of_docs * whole)).select(F.col(text).alias("text"), F.lit(of_passages).alias("share"))
    chosen = picked.unionAll(items.select("text", F.lit(1.0).alias("share")))

    def bags(texts: list) -> dict:
        h, at = word_hashes(texts)
        b = buckets_of(h, log2_buckets)
        return {"bags": [[np.sort(b[k : min(k + 64, hi)]).tobytes() for k in range(lo, hi, 64)] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]}

    rows = map_text(chosen, bags, "share double, bags array<binary>", keep=["share"], text="text").select("share", F.explode("bags").alias("bag"))
    rows = rows.where(F.pmod(F.xxhash64("bag", F.lit(seed)), F.lit(whole)) < F.col("share") * whole)
    return written(rows.select("bag").distinct().repartition(tasks, "bag"), "lsa-sample")


def randomised_svd(rows: DataFrame, idf: np.ndarray, rank: int, *, extra: int = 16, seed: int = 11, kind: np.dtype = np.dtype(np.int32)) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, singular values) of the matrix A of the passages' unit TF-IDF vectors (bag, of buckets of this kind) in rows: the ``rank`` largest.

    Executors project their passages, Y = A W with a random W, and sum Y'Y (small) and A'Y (buckets x columns) in one pass; the sums are added up in Spark by bucket, and the driver
    gets one row a bucket whatever the number of passages. With Y'Y = R'R the range finder's basis is Y R^-1, so A'Q = A'Y R^-1, whose SVD is that of A on this basis.
    Passages are multiplied 64 at a time, as a dense matrix of the buckets they have, in single precision; sums over more than some thousand passages are doubles, and of A'Y singles are sent. Directions under 1e-7 of the largest eigenvalue are below that precision and go.
    """
    spark = rows.sparkSession
    size, width = len(idf), rank + extra
    sent = spark.sparkContext.broadcast((idf, np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, random = sent.value
        total = np.zeros((size, width))  # A'Y
        square = np.zeros((width, width))  # Y'Y
        part, held = np.zeros((size, width), np.float32), 0  # A'Y of some thousand passages
        here, place = np.zeros(size, bool), np.zeros(size, np.int64)
        for batch in batches:
            row, bucket, times = term_counts(batch.column(0).to_pylist(), size, kind)
            w = times * idf[bucket].astype(np.float64)
            w = (w / np.maximum(np.sqrt(np.bincount(row, w * w, batch.num_rows)), 1e-9)[row]).astype(np.float32)
            cuts = np.searchsorted(row, np.arange(0, batch.num_rows + 64, 64))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                here[bucket[lo:hi]] = True
                ids = np.flatnonzero(here)
                here[ids] = False
                place[ids] = np.arange(len(ids))
                a = np.zeros((64, len(ids)), np.float32)
                a[row[lo:hi] % 64, place[bucket[lo:hi]]] = w[lo:hi]
                y = a @ random[ids]
                part[ids] += a.T @ y
                y = y.astype(np.float64)
                square += y.T @ y
            held += batch.num_rows
            if held >= 8000:
                total += part
                part[:], held = 0, 0
        total += part
        live = np.flatnonzero(total.any(axis=1))
        values = [total[k].astype(np.float32).tobytes() for k in live] + [v.tobytes() for v in square]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(live, size + np.arange(width))), pa.array(values, "binary")], ["b", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[b] = held.get(b, 0) + np.frombuffer(v, np.float32 if b < size else np.float64).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), "int64"), pa.array([v.tobytes() for v in held.values()], "binary")], ["b", "v"])

    sums = rows.select("bag").mapInArrow(trimmed(multiply), "b long, v binary").repartition("b").mapInArrow(trimmed(add), "b long, v binary").toArrow()
    total = np.zeros((size + width, width))
    if sums.num_rows:
        total[sums["b"].to_numpy()] = np.frombuffer(b"".join(sums["v"].to_pylist())).reshape(-1, width)
    values, turn = np.linalg.eigh(total[size:])
    good = values > max(values[-1], 1e-12) * 1e-7
    back = total[:size] @ (turn[:, good] / np.sqrt(values[good]))  # A'Q
    squares, turn = np.linalg.eigh(back.T @ back)
    top = [k for k in np.argsort(squares)[::-1][:rank] if squares[k] > 1e-6 * squares.max()]
    sigma = np.sqrt(squares[top])
    return (back @ turn[:, top]) / sigma, sigma


def fit(rows: DataFrame, idf: np.ndarray, *, rank: int = 64, seed: int = 11) -> np.ndarray:
    """The term matrix (buckets x rank) that takes a bag of words to its place: IDF times the right singular vectors of TF-IDF passages, each divided by its singular value.

    Fitted on every passage in rows (``passage_bags``), each distinct one once, so that copies don't take the place of other texts.
    """
    vectors, sigma = randomised_svd(rows, idf, rank, seed=seed, kind=bag_kind(len(idf).bit_length() - 1))
    out = np.zeros((len(idf), rank), np.float32)
    out[:, : len(sigma)] = vectors / sigma * idf[:, None]
    return out


def bits_of(a: np.ndarray) -> dict[int, int]:
    """For each word the places where it stands, as a bit set."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    return places


def lcs(n: int, places: dict[int, int], b: np.ndarray) -> int:
    """Length of the longest common subsequence with n words of these places, bit-parallel."""
    full = (1 << n) - 1
    v = full
    for m in map(places.get, b.tolist()):
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Items:
    """The benchmark's items: their words, the last words as answers, and the places of their passages by window scale."""

    def __init__(self, ids: list, texts: list, terms: np.ndarray, log2_buckets: int, answer: int = 6) -> None:
        h, at = word_hashes(texts)
        self.ids = ids
        self.words = [h[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        self.places = [bits_of(w) for w in self.words]
        self.tails = [bits_of(w[-answer:]) for w in self.words]
        self.counts = [np.unique(w, return_counts=True) for w in self.words]
        self.answer = answer
        self.scales: list[tuple[np.ndarray, np.ndarray]] = []
        cuts: dict[int, list[tuple[int, np.ndarray]]] = {s: [] for s in SCALES}
        longest = SCALES[-1] * BLOCK
        for k, w in enumerate(self.words):
            if not len(w):
                continue
            scale = next((s for s in reversed(SCALES) if len(w) >= s * BLOCK * 3 // 4), SCALES[0])
            for lo in range(0, max(1, len(w) - longest // 2), longest):  # long items in several passages
                cuts[scale].append((k, terms[buckets_of(w[lo : lo + longest], log2_buckets)].sum(axis=0)))
        for s in SCALES:
            v = np.stack([x for _, x in cuts[s]]) if cuts[s] else np.zeros((0, terms.shape[1]), np.float32)
            self.scales.append((np.array([k for k, _ in cuts[s]], np.int64), (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)))


def candidates(hashes: np.ndarray, offsets: np.ndarray, terms: np.ndarray, items: Items, log2_buckets: int, least: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, item, first word, last word, cosine) of windows that are near a passage of an item. The last row of terms is zero."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    if not len(full):
        return
    count = -(-sizes[full] // BLOCK)
    base = np.cumsum(count) - count
    text = np.repeat(full, count)
    begin = offsets[full][np.repeat(np.arange(len(full)), count)] + (np.arange(count.sum()) - np.repeat(base, count)) * BLOCK
    # eight gathers of one word a block each; words past a text's end are the zero row behind the matrix
    end = np.repeat(offsets[full + 1], count)
    ids = np.append(buckets_of(hashes, log2_buckets), len(terms) - 1)
    sums = terms[ids[begin]]
    for j in range(1, BLOCK):
        at = begin + j
        sums += terms[ids[np.where(at < end, at, len(ids) - 1)]]
    nblocks = len(sums)
    end_of_text = np.repeat(base + count, count)
    def ahead(blocks: np.ndarray, by: int) -> np.ndarray:
        """Each block's successor within its text, ``by`` blocks on."""
        inside = (np.arange(nblocks - by) + by) < end_of_text[: nblocks - by]
        return blocks[by:] * inside[:, None]

    windows = {1: sums}
    for s in SCALES:  # each scale from two smaller ones
        small = max(w for w in windows if w < s and s - w in windows or w * 2 == s)
        made = windows[small].copy()
        if nblocks > small:
            made[:-small] += ahead(windows[s - small], small)
        windows[s] = made
    for s, (which, places) in zip(SCALES, items.scales, strict=True):
        if not len(which):
            continue
        window = windows[s]
        norm = np.sqrt(np.einsum("ij,ij->i", window, window))
        norm = np.maximum(norm, 1e-9)
        for w0 in range(0, nblocks, 8192):  # windows and items meet in blocks: memory doesn't grow with either
            for i0 in range(0, len(which), 1024):
                near = window[w0 : w0 + 8192] @ places[i0 : i0 + 1024].T
                some = np.flatnonzero(near.max(axis=1) >= least * norm[w0 : w0 + 8192])
                hit, hit_i = np.nonzero(near[some] >= least * norm[w0 + some][:, None])
                for a, i in zip(some[hit].tolist(), hit_i.tolist(), strict=True):
                    w = w0 + a
                    t = int(text[w])
                    yield t, int(which[i0 + i]), int(begin[w] - offsets[t]), int(min(begin[w] + s * BLOCK, offsets[t + 1]) - offsets[t]), float(near[a, i] / norm[w])


def verdicts(texts: list, terms: np.ndarray, items: Items, log2_buckets: int, least: float, copy: float, paraphrase: float) -> list[list[tuple]]:
    """For each text its leaks: (item, cosine, share of the item's words in order, share of the answer's words in order)."""
    hashes, offsets = word_hashes(texts)
    best: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    for t, i, lo, hi, c in candidates(hashes, offsets, terms, items, log2_buckets, least):
        best.setdefault((t, i), []).append((c, lo, hi))
    out: list[list[tuple]] = [[] for _ in texts]
    for (t, i), spots in best.items():
        words = hashes[offsets[t] : offsets[t + 1]]
        item = items.words[i]
        margin = len(item)
        spans: list[list[int]] = []  # overlapping surroundings are one region
        for _, lo, hi in sorted(spots, key=lambda x: x[1]):
            a, b = max(0, lo - margin), min(len(words), hi + margin)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        share, tail = 0.0, 0.0
        for a, b in spans:
            # a region is read in pieces of four item lengths, so far apart words don't add up
            step = max(1, margin)
            for at in range(a, max(a + 1, b - 2 * step), step):
                region = words[at : min(b, at + 3 * step)]
                known, times = items.counts[i]
                place = np.minimum(np.searchsorted(known, region), len(known) - 1)
                seen = np.zeros(len(known), bool)
                seen[place[known[place] == region]] = True
                if times[seen].sum() < paraphrase * len(item):
                    continue  # the words that occur at all bound the subsequence
                got = lcs(len(item), items.places[i], region) / len(item)
                if got > share:
                    share = got
                    n = min(items.answer, len(item))
                    tail = lcs(n, items.tails[i], region) / n
        if share >= copy or (share >= paraphrase and tail >= 0.8):
            out[t].append((items.ids[i], max(c for c, _, _ in spots), share, tail))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rank: int = 64, log2_buckets: int = 15, least: float = 0.5, copy: float = 0.7, paraphrase: float = 0.6, most_items: int = 200_000) -> DataFrame:
    """(key, item, cosine, lcs, answer): documents that hold a benchmark item or a paraphrase of one.

    A window of a document is a candidate if its cosine with a passage of the item is ``least`` or more. A pair is a leak if ``copy`` of the item's words are in the document's surroundings of the window
    in the same order, or ``paraphrase`` of them with 0.8 of the answer (the item's last six words). Null and empty texts and items leak nothing. Repeated rows of docs give repeated rows; repeated items with one id one row each.
    Columns besides these go; empty tables give none. The benchmark is the stated query set: at most ``most_items`` items (more raise an error) are sent to every task, with the term matrix (2^15 x 64 floats: 8 MB).
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    queries = benchmark.select(F.col(item), F.col(item_text).alias("text")).where(F.col("text").isNotNull() & F.col(item).isNotNull())
    rows = queries.limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError("too many benchmark items to send to every task")
    kinds = dict(docs.dtypes)
    ddl = f"`{key}` {kinds[key]}, `{item}` {dict(benchmark.dtypes)[item]}, cosine double, lcs double, answer double"
    rows.sort(key=lambda r: (str(r[0]), r[1]))
    texts = docs.select(F.col(text).alias("text"), F.lit(1).alias("n")).unionAll(queries.select("text", F.lit(0).alias("n")))
    bags = passage_bags(texts, log2_buckets)
    idf, _ = frequencies(bags, log2_buckets)  # over the documents
    terms = fit(bags, idf, rank=rank)
    terms = np.concatenate((terms, np.zeros((1, rank), np.float32)))
    sent = spark.sparkContext.broadcast((terms, [r[0] for r in rows], [r[1] for r in rows]))
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids, texts = sent.value
        items = Items(ids, texts, terms, log2_buckets)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            made: list[tuple] = []
            lo = 0
            while lo < batch.num_rows:
                part: list = []
                size = 0
                while lo + len(part) < batch.num_rows and size < 1 << 17:
                    part.append(batch.column(1)[lo + len(part)].as_py())
                    size += len(part[-1] or "") + 16
                for k, found in enumerate(verdicts(part, terms, items, log2_buckets, least, copy, paraphrase)):
                    made += [(keys[lo + k], *f) for f in found]
                lo += len(part)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return docs.select(key, text).mapInArrow(trimmed(search), ddl)
