"""SentencePiece encoding and decoding through a distinct-chunk table."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, map_text, trimmed

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_ODD = re.compile(f"{MARK}|\\A | \\Z|  ")


def chunks(text: str) -> list[str]:
    """The chunks of a text in order, each without its first marker: a chunk is a run of whitespace markers and the characters up to the next marker."""
    if not text:
        return []
    if not _ODD.search(text):
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]


class Segmenter:
    """The library's ids of single chunks, and what they decode to.

    No piece of the vocabulary holds a marker after another character (checked here), so no merge crosses from one chunk to the next: a text's ids are its chunks'
    ids in a row, and as every chunk begins with a marker, what they decode to is what its chunks decode to in a row, but for the first marker.
    """

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers; its chunks can't be segmented alone")
        if self.model.encode("a  b") + [] != self.model.encode("a") + self.model.encode(" b"):
            raise ValueError("this model's normaliser changes whitespace; its chunks can't be segmented alone")
        self.mark_id = self.model.piece_to_id(MARK)
        self.eos = self.model.eos_id()

    def rows(self, keys: list[str]) -> tuple[list[str], list[str]]:
        """The ids of each chunk, joined by spaces, and what it decodes to, with the space of its marker."""
        # the model puts one marker in front: that which the chunk lacks
        ids = [i if k else [self.mark_id] for k, i in zip(keys, self.model.encode([k.replace(MARK, " ") for k in keys], num_threads=1), strict=True)]
        return [" ".join(map(str, i)) for i in ids], self.model.decode([[self.mark_id, *i] for i in ids], num_threads=1) if ids else []


class ChunkTable:
    """Rows of distinct chunks, from which whole texts are put together by position: the frequent ones of the corpus, and those of the block of texts at hand."""

    def __init__(self, segmenter: Segmenter, frequent: tuple[list[str], list[str], list[str]] = ((), (), ()), most: int = 1 << 25) -> None:
        self.segmenter, self.most = segmenter, most
        self.shared = dict(zip(frequent[0], frequent[1], strict=True)), dict(zip(frequent[0], frequent[2], strict=True))
        self.begin()

    def begin(self) -> None:
        self.ids, self.surface = (dict(d) for d in self.shared)
        self.weight = 0

    def whole(self, texts: list) -> Iterator[tuple[str, str]]:
        """Each text's ids with the end id, joined by spaces, and what they decode to. Chunks that are new to the block are segmented, once; a table of some ``most`` bytes ends it."""
        if self.weight > self.most:
            self.begin()
        split = [chunks(t or "") for t in texts]
        fresh = list(set().union(*split) - self.ids.keys())
        if fresh:
            ids, surfaces = self.segmenter.rows(fresh)
            self.ids.update(zip(fresh, ids, strict=True))
            self.surface.update(zip(fresh, surfaces, strict=True))
            self.weight += sum(map(len, fresh)) * 4 + 300 * len(fresh)
        end = str(self.segmenter.eos)
        for keys in split:
            yield " ".join([*map(self.ids.__getitem__, keys), end]), "".join(map(self.surface.__getitem__, keys))[1:]


def frequent_chunks(docs: DataFrame, model_file: str, text: str, most: int, longest: int = 64) -> tuple[list[str], list[str], list[str]]:
    """(chunks, ids, surfaces) of the ``most`` chunks that occur most often in all texts, each segmented once. Chunks of over ``longest`` characters and those that a task meets once stay out: the table's size has a bound.

    Counts are combined in the task before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            found = [(k, n) for k, n in held.items() if n > 1 and len(k) <= longest]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], "string"), pa.array([n for _, n in found], "int64")], ["chunk", "n"])

        for batch in batches:
            for value in batch.column(0):
                held.update(chunks(value.as_py() or ""))
                if len(held) > 400_000:
                    yield flush()
        yield flush()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, surfaces = Segmenter(model_file).rows(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, "string"), pa.array(surfaces, "string")], ["chunk", "ids", "surface"])

    counts = docs.select(text).mapInArrow(trimmed(count), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "chunk").limit(most).select("chunk")
    found = top.mapInArrow(trimmed(segment), "chunk string, ids string, surface string").toArrow()
    return tuple(found[c].to_pylist() for c in ("chunk", "ids", "surface"))


def encode_texts(docs: DataFrame, model_file: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False, frequent: int = 50_000) -> DataFrame:
    """Every text's ids (end id only, no sampling) and what they decode to.

    Columns: ``keep``, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids and decoded.
    A null or empty text has the end id alone and decodes to "". Repeated rows stay; columns besides ``keep`` go. An empty table gives none.

    The distinct-chunk table has two parts. The ``frequent`` most frequent chunks of the corpus are found by one aggregation, segmented once in all and broadcast (at most so many rows of
    bounded length). The rest is segmented once for a block of texts, which ends where its table is full; ids are joined back to every text by position. Which part a chunk is in doesn't change its ids.
    """
    arrow_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_chunks(docs, model_file, text, frequent))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>", "decoded string"] if with_ids else [])])

    def build() -> Callable[[list], dict]:
        held: list[ChunkTable] = []

        def run(texts: list) -> dict:
            if not held:
                held.append(ChunkTable(Segmenter(model_file), sent.value))
            made: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], **({"ids": [], "decoded": []} if with_ids else {})}
            for ids, decoded in held[0].whole(texts):
                made["n_tokens"].append(ids.count(" ") + 1)
                made["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                made["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    made["ids"].append(np.fromstring(ids, np.int32, sep=" "))
                    made["decoded"].append(decoded)
            return made

        return run

    return map_text(docs, build(), schema, keep=list(keep), text=text)
