"""SimHash near-duplicates: fingerprints, a binary trie self-join, components."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, map_text, trimmed, written
from .components import components
from .textvec import mix64

BITS = 64


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included; of the whole sequence if it is shorter; none without a word."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    ends = (np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1).tolist()
    k = max(1, n - width + 1)
    starts = [0, *(e + 1 for e in ends[: k - 1])]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[n - k :], strict=True)), np.uint64, k)


def majority(hashes: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """The bits that over half of the hashes have; with keys one word for each, of the hashes mixed with it."""
    words = 1 if keys is None else len(keys)
    sums = np.zeros(BITS * words, np.int64)
    for lo in range(0, len(hashes), 20_000):  # long texts in pieces
        h = hashes[lo : lo + 20_000, None]
        h = h if keys is None else mix64(h ^ keys)
        sums += np.unpackbits(np.ascontiguousarray(h, "<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * sums > len(hashes), bitorder="little").view("<u8")


def simhash(texts: list, width: int = 3, seed: int = 42) -> list[int]:
    """Fingerprints of whole texts: a bit is 1 if over half the shingle hashes have it. No word: 0."""
    return [int(majority(shingle_hashes(t, width, seed))[0]) for t in texts]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""
    arrow_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return map_text(docs, lambda texts: {"fp": np.array(simhash(texts), np.uint64).view(np.int64)}, f"`{key}` {kind}, fp long", keep=[key], text=text, budget=1 << 17)


def trie_links(groups: np.ndarray, values: np.ndarray, budget: int, leaf: int = 4, sides: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of positions within ``budget`` differing bits and in one group, by a joint walk over pairs of trie nodes.

    values: one 64-bit word each, or several (a row each). groups and values are sorted by (group, side, words in order) and values are distinct within a group. A trie node is a range of the
    sorted values, so a pair of nodes is two ranges, with the bits that differ so far. Pairs over the budget are pruned; a pair of nodes with ``leaf`` pairs of members at most is compared member by member,
    on all bits at once. A group with sides (0 and 1) is a pair of nodes to begin with: only members of different sides link. Others begin with their root and itself.
    """
    words = values.reshape(len(values), -1)
    n, bits = len(words), 64 * words.shape[1]
    if n < 2:
        return
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    last = np.append(first[1:], n)
    a0, a1, b0, b1 = first, last, first, last
    if sides is not None:
        middle = last - np.add.reduceat(sides.astype(np.int64), first)  # where side 1 begins
        paired = middle < last
        a1, b0 = np.where(paired, middle, last), np.where(paired, middle, first)
    err = np.zeros(len(first), np.int64)
    for depth in range(bits + 1):
        size = (a1 - a0) * (b1 - b0)
        done = (size <= leaf) | (depth == bits)
        pick = np.flatnonzero(done)
        for lo in range(0, len(pick), 1024):
            p = pick[lo : lo + 1024]
            m = size[p]
            if not m.sum():
                continue
            which = np.repeat(np.arange(len(p)), m)
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            wide = (b1 - b0)[p][which]
            i, j = a0[p][which] + inner // wide, b0[p][which] + inner % wide
            ahead = i < j
            i, j = i[ahead], j[ahead]
            apart = np.bitwise_count(words[i, 0] ^ words[j, 0]).astype(np.int64)
            for w in range(1, words.shape[1]):
                apart += np.bitwise_count(words[i, w] ^ words[j, w])
            near = apart <= budget
            if near.any():
                yield i[near], j[near]
        keep = ~done
        if not keep.any():
            return
        a0, a1, b0, b1, err = a0[keep], a1[keep], b0[keep], b1[keep], err[keep]
        bit = np.uint64(1) << np.uint64(63 - depth % 64)
        ones = np.concatenate(([0], np.cumsum((words[:, depth // 64] & bit) != 0)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # sorted: zeros first
        same = (a0 == b0) & (a1 == b1)
        kids = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        other = ~same  # a pair of a node with itself meets its mixed pair once
        kids.append((am[other], a1[other], b0[other], bm[other], err[other] + 1))
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*kids, strict=True))
        live = (err <= budget) & (a1 > a0) & (b1 > b0)
        a0, a1, b0, b1, err = a0[live], a1[live], b0[live], b1[live], err[live]


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest reachable position of each of n positions: pairs are folded in as they come and never kept."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            root = root[root]
            ri, rj = root[i], root[j]
            differ = ri != rj
            if not differ.any():
                break
            i, j, ri, rj = i[differ], j[differ], ri[differ], rj[differ]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
    while (root[root] != root).any():
        root = root[root]
    return root


STEP = 6  # bits that a hot pair of nodes is descended by at a time


def _descended(rows: DataFrame, budget: int, steps: list[list[int]], slice_rows: int) -> DataFrame:
    """(fp, g, side): members dealt out as pairs of trie nodes g with at most ``slice_rows`` members each, as far as bits go.

    rows: fp, trie, g, a row for each subtree g that a fingerprint is in. A hot pair of nodes is replaced by the pairs of its child nodes, STEP bits on, that stay within the budget with the bits that differed before; a child pair without members
    on both sides goes. steps: for each trie the lowest bits of its steps. A member is in at most as many pairs as there are choices of ``budget`` of the bits descended.
    """
    codes = F.array(*[F.lit(c) for c in range(1 << STEP)])
    now = rows.select("fp", "trie", "g", F.lit(0).alias("side"), F.lit(0).alias("err"))
    ready = []
    for step in range(len(steps[0]) + 1):
        # pairs with members on both sides, or one node with several
        sizes = now.groupBy("g").agg(F.sum(1 - F.col("side")).alias("n0"), F.sum("side").alias("n1"), F.max("paired").alias("paired")) if "paired" in now.columns else now.groupBy("g").agg(F.count(F.lit(1)).alias("n0"), F.lit(0).cast("long").alias("n1"), F.lit(False).alias("paired"))
        hot = written(sizes.where((F.col("n0") + F.col("n1") > slice_rows) & (F.col("n0") > 0) & (~F.col("paired") | (F.col("n1") > 0))).select("g"), "hot-nodes")
        if step == len(steps[0]) or not hot.limit(1).count():
            ready.append(now.select("fp", "g", "side"))
            break
        ready.append(now.join(hot, "g", "left_anti").select("fp", "g", "side"))
        lowest = F.element_at(F.array(*[F.lit(s[step]) for s in steps]), F.col("trie") + 1)
        own = F.expr("shiftrightunsigned(fp, low)").bitwiseAND(F.lit((1 << STEP) - 1)).cast("int")
        paired = F.col("paired") if "paired" in now.columns else F.lit(False)
        met = now.join(hot, "g").withColumn("low", lowest).withColumn("own", own).withColumn("whole", ~paired)
        near = F.filter(codes, lambda c: F.bit_count(c.bitwiseXOR(F.col("own"))) + F.col("err") <= budget)
        met = met.select("fp", "trie", "g", "side", "err", "own", "whole", F.explode(near).alias("other"))
        x = F.when(F.col("whole"), F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
        y = F.when(F.col("whole"), F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
        now = met.select(
            "fp",
            "trie",
            F.xxhash64("g", F.lit(step), x, y).alias("g"),
            F.when(F.col("whole"), (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side")).alias("side"),
            (F.col("err") + F.bit_count(F.col("own").bitwiseXOR(F.col("other")))).alias("err"),
            (~F.col("whole") | (F.col("own") != F.col("other"))).alias("paired"),
        )
        now = written(now, "descended")
        both = now.groupBy("g").agg(F.max("paired").alias("p"), F.min("side").alias("lo"), F.max("side").alias("hi"), F.count(F.lit(1)).alias("n"))
        now = written(now.join(both.where((F.col("p") & (F.col("lo") < F.col("hi"))) | (~F.col("p") & (F.col("n") > 1))).select("g"), "g", "left_semi"), "descended")
    out = ready[0]
    for r in ready[1:]:
        out = out.unionAll(r)
    return out


def fingerprint_links(fps: DataFrame, budget: int = 3, slice_rows: int = 4096, most_rows: int = 1 << 26) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all those within ``budget`` bits; a spanning forest of each task's pairs, not all pairs.

    The 64 bits are cut into blocks; two fingerprints within the budget agree on all but ``budget`` of them. Each choice of agreeing blocks is one
    trie whose upper levels are those blocks, where no bit may differ: their nodes meet themselves only, and the shuffle finds them. From there on pairs of nodes are walked together, with the bits that differ: in Spark
    while a pair has more than ``slice_rows`` members (_descended), in a task below (trie_links). Over ``most_rows`` fingerprints the bits are cut into more blocks, which makes more and deeper tries; the links are the same.
    """
    n = fps.count()
    blocks = budget + 1
    while n > most_rows * 4 ** (blocks - budget - 1) and blocks < 16:
        blocks += 1
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    tries = list(combinations(range(blocks), blocks - budget))
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen) for chosen in tries]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # the bits of the other blocks, STEP at a time; a block's last step may reach into agreeing bits
    steps = [[low for b in range(blocks) if b not in chosen for low in range(edges[b], edges[b + 1], STEP)] for chosen in tries]
    deepest = max(map(len, steps))
    steps = [[min(x, BITS - STEP) for x in s] + [s[-1]] * (deepest - len(s)) for s in steps]
    keys = F.array(*[F.struct(F.lit(k).alias("trie"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("top")) for k, m in enumerate(signed)])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", F.col("k.trie").alias("trie"), F.xxhash64("k.trie", "k.top").alias("g"))
    return _walked(_descended(rows, budget, steps, slice_rows).withColumn("id", F.col("fp")), ["fp"], budget)


def _walked(dealt: DataFrame, words: list[str], budget: int) -> DataFrame:
    """Links (a, b) of the ids of dealt (words, id, g, side), by the joint walk within each g; a task holds some 100,000 rows, or one g."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size = 0

        def flush(frame: pd.DataFrame) -> pa.RecordBatch:
            g, side = frame["g"].to_numpy(), frame["side"].to_numpy()
            v = frame[words].to_numpy().view(np.uint64)
            order = np.lexsort((*(v[:, k] for k in range(len(words) - 1, -1, -1)), side, g))
            g, v = g[order], v[order]
            ids = frame["id"].to_numpy()[order]
            root = spanning(len(v), trie_links(g, v, budget, sides=side[order]))
            linked = np.flatnonzero(root != np.arange(len(v)))
            return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[root[linked]])], ["a", "b"])

        for batch in batches:
            held.append(batch.to_pandas())
            size += batch.num_rows
            if size >= 100_000:
                frame = pd.concat(held)
                tail = frame["g"].iloc[-1]  # sorted by g: only the last group can go on
                cut = int((frame["g"].to_numpy() != tail).sum())
                if cut:
                    yield flush(frame.iloc[:cut])
                held, size = [frame.iloc[cut:]], len(frame) - cut
        if held:
            yield flush(pd.concat(held))

    return dealt.select(*words, "id", "g", "side").repartition("g").sortWithinPartitions("g").mapInArrow(trimmed(join), "a long, b long").distinct()


def _joined(rows: DataFrame, words: list[str], budget: int, slice_rows: int) -> DataFrame:
    """Links (a, b) of the members of subtrees (trie, top): of hashes of their words, as connect all those within the budget.

    With so wide a budget the upper levels of a subtree prune nothing. In one of more than ``slice_rows`` members each is compared with the least first (the pivot): those near it are connected by that, so only
    the others (strays) still have to meet: every stray meets all members, dealt out as pairs of slices. A large group of alike texts costs its size, not its square.
    """
    ident = F.xxhash64(*words)
    keys = rows.select(*words, ident.alias("id"), F.xxhash64("trie", "top").alias("g"))
    hot = written(keys.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*words)).alias("pivot")).where(F.col("n") > slice_rows).select("g", "pivot"), "hot-subtrees")
    if not hot.limit(1).count():
        return _walked(keys.withColumn("side", F.lit(0)), words, budget)
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"pivot.{w}"))) for w in words), F.lit(0))
    crowd = written(keys.join(hot, "g").select(*words, "id", "g", (apart > budget).alias("stray"), F.xxhash64(*[F.col(f"pivot.{w}") for w in words]).alias("to")), "hot-members")
    half = max(1, slice_rows // 2)
    parts = written(crowd.groupBy("g").agg(F.ceil(F.sum(F.col("stray").cast("long")) / half).cast("int").alias("strays"), F.ceil(F.sum((~F.col("stray")).cast("long")) / half).cast("int").alias("others")).where("strays > 0"), "hot-slices")
    dealt = crowd.join(parts, "g").withColumn("own", F.pmod("id", F.when(F.col("stray"), F.col("strays")).otherwise(F.col("others"))).cast("int"))
    spot = lambda kind, x, y, side: F.struct(F.xxhash64(F.col("g"), F.lit(kind), x, y).alias("g"), side.alias("side"))
    zero = F.lit(0)
    among = F.transform(F.sequence(zero, F.col("strays") - 1), lambda k: spot("s", F.least("own", k), F.greatest("own", k), zero))
    with_others = F.transform(F.sequence(zero, F.greatest(F.col("others") - 1, zero)), lambda k: spot("o", F.col("own"), k, F.lit(1)))
    with_strays = F.transform(F.sequence(zero, F.col("strays") - 1), lambda k: spot("o", k, F.col("own"), zero))
    tasks = F.when(F.col("stray"), F.concat(among, F.when(F.col("others") > 0, with_others).otherwise(F.slice(with_others, 1, 0)))).otherwise(with_strays)
    dealt = dealt.select(*words, "id", F.explode(tasks).alias("t")).select(*words, "id", "t.g", "t.side")
    cold = keys.join(hot.select("g"), "g", "left_anti").select(*words, "id", "g", F.lit(0).alias("side"))
    direct = crowd.where(~F.col("stray") & (F.col("id") != F.col("to"))).select(F.col("id").alias("a"), F.col("to").alias("b"))
    return _walked(cold.unionByName(dealt), words, budget).unionAll(direct).distinct()


def wide_simhash(texts: list, width: int = 5, words: int = 4, seed: int = 42) -> np.ndarray:
    """n x words fingerprints of 64 bits a word: each distinct shingle's hash is mixed anew for every word. Texts without a word have zeros."""
    keys = mix64(np.arange(1, words + 1, dtype=np.uint64))
    return np.array([majority(np.unique(shingle_hashes(t, width, seed)), keys) for t in texts], np.uint64).reshape(len(texts), words)


class SetIndex:
    """Sorted sets of hashes, of which those alike to another set are found at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def alike(self, other: np.ndarray, similarity: float) -> np.ndarray:
        """Positions of the sets whose Jaccard similarity with other is ``similarity`` or more."""
        lo = np.searchsorted(self.hashes, other)
        m = np.searchsorted(self.hashes, other, "right") - lo
        at = np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(m.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero((shared > 0) & (shared >= similarity * (self.sizes + len(other) - shared) - 1e-9))


def _by_root(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bool, np.ndarray]]]]:
    """(root, its rows (id, first, set)) of rows sorted by root, one row at a time."""
    rows = ((r, i, f, np.frombuffer(s, np.uint64)) for b in batches for r, i, f, s in zip(*(b.column(c).to_pylist() for c in ("root", "id", "first", "s")), strict=True))
    for root, members in groupby(rows, lambda x: x[0]):
        yield root, (m[1:] for m in members)


def _confirmed(docs: DataFrame, whole: DataFrame, text: str, similarity: float, width: int, seed: int = 42) -> DataFrame:
    """(id, part) of the classes that exact similarities take out of their root's component: what stays with the root isn't listed.

    whole: id, th (hash of a text of that class), root. Within a component each class is compared with the root's; the others (strays) with one another and with those like the root. The strays
    of a component are held in one task; the rest, also of very large components, streams by.
    """
    crowds = written(whole.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root"), "wide-crowds")
    linked = written(whole.join(crowds, "root").select("id", "th", "root"), "wide-linked")
    bodies = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text")).join(linked, "th").select("id", "root", "text")
    made = map_text(bodies, lambda texts: {"s": [np.unique(shingle_hashes(t, width, seed)).tobytes() for t in texts]}, "id long, root long, s binary", keep=["id", "root"], text="text", budget=1 << 17)
    sets = written(made.dropDuplicates(["id"]), "wide-sets")

    def unlike_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for root, members in _by_root(batches):
            head = SetIndex([next(members)[2]])
            ids = [i for i, _, s in members if not len(head.alike(s, similarity))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root] * len(ids), pa.int64())], ["id", "root"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for root, members in _by_root(batches):
            ids: list[int] = []
            held: list[np.ndarray] = []
            index = None
            for i, stray, s in members:
                if stray:
                    ids.append(i)
                    held.append(s)
                    continue
                if index is None:
                    index = SetIndex(held)
                    near = [(np.full(len(j), k), j) for k, t in enumerate(held) for j in [index.alike(t, similarity)]]
                    group = spanning(len(ids), iter(near))
                    joins = np.zeros(len(ids), bool)  # by the group's first position
                if not joins[group].all():
                    joins[group[index.alike(s, similarity)]] = True
            ids_ = np.array(ids, np.int64)
            out = ~joins[group]
            yield pa.RecordBatch.from_arrays([pa.array(ids_[out]), pa.array(ids_[group[out]])], ["id", "part"])

    heads = sets.select("root", "id", (F.col("id") == F.col("root")).alias("first"), "s")
    strays = written(heads.repartition("root").sortWithinPartitions("root", F.desc("first")).mapInArrow(trimmed(unlike_root), "id long, root long"), "wide-strays")
    mixed = sets.join(strays.select("root").distinct(), "root", "left_semi").join(strays.select("id", F.lit(True).alias("stray")), "id", "left")
    mixed = mixed.select("root", "id", F.coalesce("stray", F.lit(False)).alias("first"), "s")
    return written(mixed.repartition("root").sortWithinPartitions("root", F.desc("first")).mapInArrow(trimmed(parts), "id long, part long"), "wide-parts")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5, bits: int = 512, recall: float = 0.99, slice_rows: int = 1024) -> DataFrame:
    """(key, text_hash, group, component_id): documents whose sets of five-word shingles are alike by ``similarity`` (Jaccard) or more, and what they connect; rows as near_duplicates() has them.

    ``bits`` SimHash bits of the distinct shingles propose links; exact similarities of the linked texts decide. group is the component's own number, also where two components share their least key;
    text_hash is the XXH64 of the text (of "" for a null): key and text_hash name a row's result.

    Bits differ with the angle between two shingle vectors: alike by J, the share acos(2 J / (1 + J)) / pi of them. Fingerprints link within that share plus a standard deviation. So many bits
    can't be cut into blocks of which one is sure to agree; instead each of several tries is entered at a random choice of bits, as many as keep subtrees small for the number of fingerprints, with as many tries as find
    a pair at the threshold with probability ``recall`` (more alike pairs, and those of larger groups, more surely).
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    kind = dict(docs.dtypes)[key]
    words = [f"w{i}" for i in range(bits // 64)]
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    budget = round(bits * angle + math.sqrt(bits * angle * (1 - angle)))

    hashed = docs.select(key, text, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))

    def prints(texts: list) -> dict:
        f = wide_simhash(texts, width, len(words)).view(np.int64)
        return {w: np.ascontiguousarray(f[:, i]) for i, w in enumerate(words)}

    fps = written(map_text(hashed, prints, f"`{key}` {kind}, text_hash long, " + ", ".join(f"{w} long" for w in words), keep=[key, "text_hash"], text=text, budget=1 << 17).withColumn("id", F.xxhash64(*words)), "wide-fingerprints")
    classes = written(fps.groupBy("id", *words).agg(F.min(key).alias("least"), F.min("text_hash").alias("th")), "wide-classes")
    n = classes.count()
    depth = max(14, math.ceil(math.log2(max(n, 2))) - 4)
    tries = math.ceil(math.log(1 - recall) / math.log(1 - (1 - angle) ** depth))
    rng = random.Random(5)
    masks = [sum(1 << b for b in rng.sample(range(64), depth)) for _ in range(tries)]
    tops = F.array(*[F.struct(F.lit(k).alias("trie"), F.col(words[k % len(words)]).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("top")) for k, m in enumerate(masks)])
    rows = classes.select(*words, F.explode(tops).alias("g")).select(*words, "g.trie", "g.top")
    member = components(written(_joined(rows, words, budget, slice_rows), "wide-links"))
    whole = written(classes.join(member, classes.id == member.node, "left").select("id", "least", "th", F.coalesce("component", "id").alias("root")), "wide-members")
    whole = written(whole.join(_confirmed(docs, whole, text, similarity, width), "id", "left").select("id", "least", F.coalesce("part", "root").alias("root")), "wide-confirmed")
    roots = written(whole.groupBy("root").agg(F.min("least").alias("component_id")), "wide-components")
    found = written(whole.select("id", "root").join(roots, "root").select("id", F.col("root").alias("group"), "component_id"), "wide-found")
    return fps.select(key, "text_hash", "id").join(found, "id").select(key, "text_hash", "group", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 3) -> DataFrame:
    """(key, fingerprint, component_id, group_size) for every row of docs.

    Fingerprints within ``budget`` bits link; component_id is the smallest key reachable, itself included; fingerprint has 16 lowercase hex digits.
    group_size counts the rows of a component.
    Null and empty texts have fingerprint 0 and link like any other. Repeated rows (also of one key) stay, each with the same component.
    A null key stays null and counts only if its component has no other. An empty table gives none. Columns besides key and text go.
    """
    fps = written(fingerprints(docs, key, text), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("copies")), "fp-classes")
    links = written(fingerprint_links(classes.select("fp"), budget), "fp-links")
    member = components(links)
    whole = written(classes.join(member, classes.fp == member.node, "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("root")), "fp-members")
    roots = written(whole.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("group_size")), "components")
    found = written(whole.select("fp", "root").join(roots, "root").select("fp", "component_id", "group_size"), "fp-components")
    return fps.join(found, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group_size")
