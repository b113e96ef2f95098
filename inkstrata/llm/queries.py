"""The thin opN_ queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, html_text, langid, licenses, pii, sentencepiece_codec, simhash, toxicity, warc
from .common import held_out, table


def piece_model() -> str:
    """The public model file that the SentencePiece query is defined by."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = ~held_out(F.col("doc_id"))
    model = toxicity.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents"), piece_model())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below source/lang; the digits of doc_id, two a level, are the directories and the name."""
    digits = F.col("doc_id").cast("string")
    pairs = F.regexp_replace(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits), r"([0-9]{2})(?=[0-9])", "$1/")
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.concat(pairs, F.lit(".txt"))))
    return licenses.scan(docs)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_fingerprint, op3_langid, op4_html, op5_toxicity, op6_decontaminate, op7_sentencepiece, op8_warc, op9_pii, op10_licenses)}
# The driver's pages hold one article of plain headings and paragraphs each, so SQL can read it by pattern; other pages are for the tests.
_OP4 = """WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<br>', ' ', 'g') AS inner_html FROM pages),
l AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(inner_html, '</?(?:p|h1)>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM l)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""
_OP8 = """WITH d AS (SELECT page_id, coalesce(html, '') AS h FROM pages), x AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS s FROM d),
v AS (SELECT page_id, payload_bytes, list_transform(range(0, 8), lambda i: ('0x' || substr(s, i::INT * 5 + 1, 5))::INT) AS five FROM x),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(five, lambda n: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31) + 1, 1)), '') AS payload_digest FROM v),
m AS (SELECT payload_digest, max(page_id) AS most FROM b GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> most THEN most END AS refers_to FROM b JOIN m USING (payload_digest)"""
ORACLE: dict[str, str] = {"op4_html": _OP4, "op8_warc": _OP8}
