"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_batches, trimmed
from .textvec import _powers, code_points, mix64

BINS = 64
NONE = 0xFFFF


def _coin_table() -> np.ndarray:
    a, b = np.meshgrid(np.arange(128, dtype=np.int64), np.arange(128, dtype=np.int64), indexing="ij")
    d = a ^ b
    low = np.bitwise_count((d & -d) - 1).astype(np.int64)
    low[d == 0] = 0
    return (2 * low + ((a >> low) & 1)).astype(np.uint8)


_COIN = _coin_table()


def phrases(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of parsing: the phrase names of all sequences, and each sequence's first phrase. starts: the first name of each (non-empty) sequence.

    Runs of one name become one name. Coin tossing then gives each name the place and value of the lowest bit in which it differs from its left neighbour, thrice
    over, so labels come from a small alphabet and neighbours differ; phrases begin at local maxima. A boundary depends on a few neighbours only:
    equal substrings are cut alike but for their ends.
    """
    n = len(names)
    head = np.zeros(n, bool)
    head[starts] = True
    new = head.copy()
    new[1:] |= names[1:] != names[:-1]
    if not new.all():
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, n)).astype(np.uint64)
        names = np.where(run > 1, mix64(names[at] + run * np.uint64(0x9E3779B97F4A7C15)), names[at])
        head = head[at]
        starts = np.flatnonzero(head)
        n = len(names)
    before = np.concatenate((names[:1], names[:-1]))
    d = names ^ before
    low = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)).astype(np.uint8)
    np.minimum(low, 63, out=low)
    label = 2 * low + ((names >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    label[starts] = 0
    for _ in range(2):
        step = _COIN[label, np.concatenate((label[:1], label[:-1]))]
        step[starts] = 0
        label = step
    left = np.concatenate((label[:1], label[:-1]))
    right = np.concatenate((label[1:], label[:1]))
    cut = (label > left) & (label >= right)
    cut[1:] &= ~head[:-1]
    cut[starts] = True
    at = np.flatnonzero(cut)
    up, down = _powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(names * up[:n], out=sums[1:])
    ends = np.append(at[1:], n)
    return mix64((sums[ends] - sums[at]) * down[at] + np.uint64(0x51ED270B7A1F3C95)), np.flatnonzero(head[at])


def sketches(texts: list) -> np.ndarray:
    """n x BINS: in each bin the top 16 bits of the least phrase name that falls into it of any level, NONE for an empty bin."""
    points, offsets = code_points(texts)
    out = np.full(len(texts) * BINS, np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        names, starts = mix64(points.astype(np.uint64) + np.uint64(1)), offsets[full]
        while len(names):
            names, starts = phrases(names, starts)
            sizes = np.diff(np.append(starts, len(names)))
            doc = np.repeat(full, sizes)
            np.minimum.at(out, doc * BINS + (names & np.uint64(BINS - 1)).astype(np.int64), np.minimum(names >> np.uint64(32), np.uint64(0xFFFEFFFF)).astype(np.uint32))
            live = sizes > 1  # a text of one phrase is done
            names, full = names[np.repeat(live, sizes)], full[live]
            starts = (np.cumsum(sizes[live]) - sizes[live]).astype(np.int64)
    return (out >> np.uint32(16)).astype(">u2").reshape(-1, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the share of equal bins among those that either fills; 1 for two empty ones. Estimates the Jaccard likeness of the phrase sets."""
    used = (a != NONE) | (b != NONE)
    n = used.sum(axis=1)
    return np.where(n == 0, 1.0, (used & (a == b)).sum(axis=1) / np.maximum(n, 1))


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first code points of the text that follows."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _rank(there: bool, k: object, th: int) -> tuple:
    """The order of rows: those without a key first, then by key, then by the hash of their texts."""
    return (there, k if there else 0, th)


def with_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text", bucket_rows: int = 500, most_buckets: int = 20_000) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs.

    The next document is that with the next larger key (numbers, strings or any other ordered type); after the last comes the first, and a lone document follows itself. Rows of one key follow each
    other by the XXH64 of their texts. A null text is empty; a null key comes first. A fingerprint has four hex digits a bin. Columns besides key and text go; an empty table gives none.

    Rows are cut into buckets at quantiles of key and text hash, so a frequent key has several; a bucket's rows are sorted and streamed through one task, and the first row of each bucket goes to the
    bucket before it as well. The driver holds the bounds (from at most 16 random rows a bucket) and first rows' keys of the buckets only. Texts travel compressed.
    """
    spark = docs.sparkSession
    arrow_batches(spark, 500)
    there = F.col(key).isNotNull().alias("there")
    placed = docs.select(there, F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("t"))
    plain = placed.select("there", "k", "th")
    n = plain.count()
    buckets = max(1, min(most_buckets, n // bucket_rows))
    drawn = plain.where(F.rand(5) < min(1.0, 16 * buckets / max(n, 1))).collect() if buckets > 1 else []
    ranked = sorted({_rank(*r) for r in drawn})
    bounds = [ranked[i * len(ranked) // buckets] for i in range(1, buckets)] if ranked else []
    place = f"there boolean, k {dict(docs.dtypes)[key]}, th long"

    def ranks(batch: pa.RecordBatch) -> list[tuple]:
        return [_rank(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("there", "k", "th")), strict=True)]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ranks(batch)
            least: dict[int, int] = {}
            for i, r in enumerate(rows):
                b = bisect_right(bounds, r)
                if b not in least or r < rows[least[b]]:
                    least[b] = i
            yield pa.RecordBatch.from_arrays([pa.array(list(least), "int32"), *(batch.column(c).take(pa.array(list(least.values()), "int64")) for c in ("there", "k", "th"))], ["bucket", "there", "k", "th"])

    firsts = plain.mapInArrow(number, f"bucket int, {place}").groupBy("bucket").agg(F.min(F.struct("there", "k", "th")).alias("m"))
    rows = sorted((r.bucket, _rank(*r.m)) for r in firsts.collect())
    goes_to = {first: rows[i - 1][0] for i, (_, first) in enumerate(rows)}  # the bucket before; the last one for the first
    deal = f"bucket int, tail int, {place}, z binary"
    deal_schema = to_arrow_schema(StructType.fromDDL(deal))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        sent = set()  # a first row that is repeated goes ahead once a task
        for batch in batches:
            of: list[int] = []
            tail: list[int] = []
            rows_: list[int] = []
            packed: list[bytes] = []
            for i, (r, t) in enumerate(zip(ranks(batch), batch.column("t").to_pylist(), strict=True)):
                z = packer.compress((t or "").encode("utf-8", "surrogatepass"))
                for b, is_tail in ((bisect_right(bounds, r), 0), *([(goes_to[r], 1)] if r in goes_to and r not in sent else [])):
                    of.append(b)
                    tail.append(is_tail)
                    rows_.append(i)
                    packed.append(z)
                if r in goes_to:
                    sent.add(r)
            at = pa.array(rows_, "int64")
            yield pa.RecordBatch.from_arrays([pa.array(of, "int32"), pa.array(tail, "int32"), *(batch.column(c).take(at).cast(deal_schema.field(c).type) for c in ("there", "k", "th")), pa.array(packed, "binary")], schema=deal_schema)

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        reader = zstandard.ZstdDecompressor()
        held: tuple | None = None  # the row whose successor is yet to come
        ready: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            texts = [r[1] for r in ready]
            after = [r[2] for r in ready]
            changed = [edited(t, x) for t, x in zip(texts, after, strict=True)]
            # a row's successor is mostly the next row: only the others are sketched beside
            odd = [i for i in range(len(ready)) if i + 1 == len(ready) or after[i] is not texts[i + 1]]
            made = sketches([*texts, *changed, *(after[i] for i in odd)])
            m = len(ready)
            own, other = made[:m], made[m : 2 * m]
            follow = np.concatenate((own[1:], own[:1]))
            follow[odd] = made[2 * m :]
            columns = [
                [r[0] for r in ready],
                [len(t) for t in texts],
                [hashlib.sha256(c.encode()).hexdigest() for c in changed],
                _hex(own),
                _hex(other),
                likeness(own, other),
                likeness(own, follow),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        for batch in batches:
            for bucket, tail, k, z in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "k", "z")), strict=True):
                if tail and (held is None or held[0] != bucket):
                    continue  # a further row of the first key
                t = reader.decompress(z).decode("utf-8", "surrogatepass")
                if held is not None:
                    ready.append((held[1], held[2], t))
                    size += 2 * len(held[2])
                held = None if tail else (bucket, k, t)
                if size >= 1 << 18:  # arrays of this size stay in the CPU cache
                    yield flush()
                    ready, size = [], 0
        if ready:
            yield flush()

    packed = placed.mapInArrow(trimmed(pack), deal)
    return packed.repartition(max(buckets // 4, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket", "tail", "there", "k", "th").mapInArrow(trimmed(walk), schema)
