"""A training-data pipeline over documents: toxicity, SimHash near-duplicates, benchmark decontamination, PII, SentencePiece.

Each stage takes (spark, docs, sf_dir) and gets all rows its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm import decontaminate, pii, sentencepiece_codec, simhash, toxicity
from inkstrata.llm.common import held_out, table, written
from inkstrata.llm.queries import piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from the labelled rows of docs that aren't held out."""
    learn = ~held_out(F.col("doc_id"))
    model = toxicity.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    scored = toxicity.score(docs.select(*COLUMNS), model, keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def text_hash() -> Column:
    """XXH64 of the text, of "" for a null. Results are joined to rows by it: doc_id alone may be null or repeated."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are alike by 0.8 or more in their five-word shingles the one with the smallest doc_id stays, once. Documents without a doc_id all stay if their group has none with one.

    Of alike texts that share the smallest doc_id the one with the smallest hash stays, of rows with the same text the smallest by text, lang, source and n_chars; unlike texts that share a doc_id are in different groups, so each may stay.
    Most documents stay, so the list of those that do grows with the input: it is merged at every size, never broadcast.
    """
    groups = simhash.similar_documents(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = groups.groupBy("group", "doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("each")).agg(F.min("text_hash").alias("hash"), F.count(F.lit(1)).alias("rows"))
    stay = written(stay.select(F.col("doc_id").alias("stays"), "hash", "rows"), "representatives")
    kept = docs.withColumn("h", text_hash()).join(stay.hint("merge"), F.col("doc_id").eqNullSafe(F.col("stays")) & (F.col("h") == F.col("hash")), "left_semi")
    if not stay.where("stays is not null and rows > 1").limit(1).count():
        return kept.select(*COLUMNS)
    once = kept.where("doc_id is not null").groupBy("doc_id", "h").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return once.select(*COLUMNS).unionAll(kept.where("doc_id is null").select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or a paraphrase of one go, each by its own text."""
    texts = docs.select(text_hash().alias("h"), "text")
    found = written(decontaminate.leaks(texts, table(spark, sf_dir, "benchmark"), key="h").select(F.col("h").alias("leaking")).distinct(), "leaks")
    return docs.join(found, text_hash() == F.col("leaking"), "left_anti").select(*COLUMNS)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its personal data is replaced by the kind in brackets, and n_chars counts anew. Spans belong to a text, so rows of the same text share them."""
    spans = pii.find(docs.select(text_hash().alias("h"), "text"), key="h").where(F.size("found") > 0).select(F.col("h").alias("spans_of"), "found")
    spans = written(spans.dropDuplicates(["spans_of"]), "pii-spans")
    joined = docs.join(spans, text_hash() == F.col("spans_of"), "left")
    text = F.when(F.col("found").isNull(), F.col("text")).otherwise(pii.masked(F.col("text"), F.col("found")))
    return joined.select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of what they decode to."""
    return sentencepiece_codec.encode_texts(docs, piece_model(), with_ids=True).drop("decoded")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("pii", mask_pii), ("sentencepiece", encode)]

# The classifier's training, the fingerprints' majority vote, the SVD and the tokenizer have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
