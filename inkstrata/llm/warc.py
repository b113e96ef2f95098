"""WARC archives of pages: written as monolithic gzip, normalised to a member a record with an offset index, read back."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_batches, fresh_path, trimmed, written

# Fixed values of the format.
END = "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_id string, record_type string"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8 bytes: five hex digits make four base32 digits."""
    hexed = F.sha1(F.encode(payload, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def classified(pages: DataFrame, key: str, html: str, least_bytes: int) -> DataFrame:
    """(key, digest, refers_to, revisit) of the distinct pairs of key and digest. Hot payloads are combined before the shuffle and joined salted: a third of all pages may share one."""
    payload = F.coalesce(F.col(html), F.lit(""))
    digests = written(pages.select(key, payload_digest(payload).alias("digest"), F.octet_length(payload).alias("bytes")).distinct(), "digests")
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(64)).cast("int")
    salted = digests.withColumn("salt", salt)
    most = salted.groupBy("digest").agg(F.max(key).alias("most"), F.count(F.lit(1)).alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    most = written(most.select("digest", "most", F.explode("salts").alias("salt")), "shared-payloads")
    joined = salted.join(most, ["digest", "salt"], "left")
    revisit = F.col("most").isNotNull() & ~F.col(key).eqNullSafe(F.col("most")) & (F.col("bytes") >= least_bytes)
    return written(joined.select(key, "digest", F.when(revisit, F.col("most")).alias("refers_to"), revisit.alias("revisit")), "record-kinds")


def record(key: Column, url: Column, payload: Column, digest: Column, revisit: Column, refers_to: Column, date: str) -> Column:
    """A whole record as text, without the two line ends that close it. A revisit has the HTTP head only; its Content-Length there is the payload's."""
    name = lambda k: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(k.cast("string")), F.lit(">")), F.lit("<urn:null>"))
    target = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(payload))
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        name(key),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        digest,
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(refers_to))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )


def write_monolithic(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records_a_file: int = 4000) -> None:
    """One gzip stream a file, a record for every row of pages. The record end doubles as Spark's line separator, so the text writer makes the archives on any store."""
    kinds = classified(pages, key, html, least_bytes)
    payload = F.coalesce(F.col(html), F.lit(""))
    src = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), payload.alias("p"), payload_digest(payload).alias("d"))
    joined = src.join(kinds, F.col("k").eqNullSafe(F.col(key)) & (F.col("d") == F.col("digest")))
    text = joined.select(record(F.col("k"), F.col("u"), F.col("p"), F.col("d"), F.col("revisit"), F.col("refers_to"), date).alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive, each from its version line to its closing line ends; only the record at hand is held."""
    held = bytearray()
    need = 0
    for piece in stream:
        held += piece
        while True:
            if not need:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                head = bytes(held[:at])
                if not head.startswith(b"WARC/"):
                    raise ValueError("not at the beginning of a record")
                length = next((int(line[15:]) for line in head.split(b"\r\n") if line[:15].lower() == b"content-length:"), None)
                if length is None:
                    raise ValueError("a record without Content-Length")
                need = at + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("the archive ends within a record")


def inflated(stream: BinaryIO, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, some at a time; the file is read as it goes."""
    reader = zlib.decompressobj(31)
    while piece := stream.read(step):
        while piece:
            out = reader.decompress(piece, step)
            if out:
                yield out
            if reader.eof:
                piece = reader.unused_data
                reader = zlib.decompressobj(31)
            else:
                piece = reader.unconsumed_tail


def member(data: bytes, level: int = 6) -> bytes:
    maker = zlib.compressobj(level, zlib.DEFLATED, 31)
    return maker.compress(data) + maker.flush()


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrites every archive in the folder ``source`` with a member a record into ``target``; the sidecar index, one row a record, is written to target/index and returned.

    An archive is read and inflated once, as a stream from the store, so memory holds one record, whatever the archive's size; its member file appears under its final name by a move after its last byte: a lost executor leaves no half archive, and a second
    attempt makes the same bytes. Files are reached through Arrow's file systems, by the URI of the shared folder.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")  # the listing only
    schema = to_arrow_schema(StructType.fromDDL(INDEX))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rpartition("/")[2]
                stem = name.removesuffix(".txt.gz").removesuffix(".gz")
                archive = f"{target}/{stem}.warc.gz"
                store, path = fs.FileSystem.from_uri(archive)
                draft = f"{path}.{uuid.uuid4().hex}"
                rows: list[tuple] = []
                offset = 0
                store.create_dir(path.rpartition("/")[0])
                origin, origin_path = fs.FileSystem.from_uri(f"{source}/{name}")
                with origin.open_input_stream(origin_path, compression=None) as given, store.open_output_stream(draft, compression=None) as out:
                    for whole in records(inflated(given)):
                        h = headers(whole[: whole.index(b"\r\n\r\n")])
                        packed = member(whole)
                        out.write(packed)
                        rows.append((archive, offset, len(packed), h["warc-record-id"], h["warc-type"]))
                        offset += len(packed)
                store.move(draft, path)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files.mapInArrow(trimmed(rewrite), INDEX).write.parquet(f"{target}/index")
    arrow_batches(spark)
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def read_back(index: DataFrame, kind: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, html) of every record of the index, each read at its offset. html is null for revisits; kind is the type of the ids.

    A response whose payload doesn't match its digest or length raises an error.
    """
    ddl = f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, url string, html string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def ident(name: str | None) -> int | str | None:
        if not name or name == "<urn:null>":
            return None
        found = unquote_plus(name.removeprefix("<urn:page:").removesuffix(">"))
        return found if kind == "string" else int(found)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at: str | None = None
        file = None
        for batch in batches:
            rows: list[tuple] = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != at:
                    if file is not None:
                        file.close()
                    store, path = fs.FileSystem.from_uri(archive)
                    file, at = store.open_input_file(path), archive
                whole = zlib.decompress(file.read_at(length, offset), 31)
                cut = whole.index(b"\r\n\r\n")
                h = headers(whole[:cut])
                block = whole[cut + 4 : cut + 4 + int(h["content-length"])]
                mid = block.index(b"\r\n\r\n")
                body = block[mid + 4 :]
                size = int(headers(block[:mid])["content-length"])
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                response = h["warc-type"] == "response"
                if response and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                    raise ValueError(f"record {h['warc-record-id']} in {archive} is damaged")
                rows.append((ident(h["warc-record-id"]), size, digest, h["warc-type"], ident(h.get("warc-refers-to")), h["warc-target-uri"], body.decode() if response else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if file is not None:
            file.close()

    spark = index.sparkSession
    arrow_batches(spark, 500)
    return index.mapInArrow(trimmed(fetch), ddl)


def archive(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record for every row of pages, normalises the archives and reads them back: one row a record, as read_back() has it.

    Of the records whose payloads are equal and have ``least_bytes`` bytes at least, those with the largest key are responses and the others revisit it; smaller ones are all responses.
    Rows that repeat the largest key and the payload are responses each. A null payload is empty; a null key is smaller than any other (a payload that only null keys have is in responses). A null URL becomes "". An empty table gives none. Keys are whole numbers or strings.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_monolithic(pages, f"{path}/monolithic", key=key, url=url, html=html, least_bytes=least_bytes)
    return read_back(normalise(spark, f"{path}/monolithic", f"{path}/members"), dict(pages.dtypes)[key])
