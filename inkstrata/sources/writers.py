"""Writers: committed tables with a pointer, JSON documents, layer records, vector drawings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.text import safe_relative_path

PHASES = ("prepared", "old_moved", "published")


def write_document(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, one a line; the job's commit makes them appear at once."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def plain(value: Column, kind: T.DataType) -> Column:
    """A value of types that JSON has: names of maps as strings, bytes as numbers, dates and times as text, decimals as doubles; lists and structs item by item."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), plain(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda e: plain(e, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[plain(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.BinaryType):
        pairs = F.regexp_extract_all(F.hex(value), F.lit("(..)"), F.lit(1))
        return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))
    if isinstance(kind, T.DecimalType):
        return value.cast("double")
    return value.cast("string") if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else value


def plain_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): the other columns of each row as one JSON object in the order of their names; nulls stay as null."""
    fields = sorted((f for f in df.schema if f.name not in keys), key=lambda f: f.name)
    row = F.struct(*[plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])
    return df.select(*keys, F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def publish(df: DataFrame, root: str) -> str:
    """Writes a new version of a table below ``root`` and then its pointer row. Readers follow the last pointer, so they see the old or the new version, never part of one; works on any store, as nothing is renamed."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{version}")
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def published(spark: SparkSession, root: str) -> DataFrame:
    """The last published version."""
    try:
        last = spark.read.parquet(f"{root}/pointer").agg(F.max_by("version", F.struct("at", "version")).alias("v")).first()
    except AnalysisException as e:
        raise FileNotFoundError(f"nothing published in {root}") from e
    return spark.read.parquet(f"{root}/versions/{last.v}")


def recovery(target: Column, backup: Column, phase: Column) -> Column:
    """What to do about an interrupted directory swap, from whether target and backup exist and the journal's phase."""
    known = phase.isin(*PHASES)
    return (
        F.when(~F.coalesce(known, F.lit(False)), "error_unknown_phase")
        .when(target & backup, "drop_backup_and_journal")
        .when(target, "drop_journal")
        .when(backup, "restore_backup")
        .when(phase == "prepared", "drop_journal")
        .otherwise("error_ambiguous")
    )


def layer_records(layers: DataFrame, document: str) -> DataFrame:
    """File name, offset and box of every layer to export, numbered from the bottom."""
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace("name", r"[^0-9A-Za-z._ -]+", "_"), r"\s+", "_"), r"^[._]+|[._]+$", "")
    slug = F.when(slug == "", F.col("id").cast("string")).otherwise(F.substring(slug, 1, 60))
    return layers.select(document, "id", F.concat(F.lpad(F.col("z").cast("string"), 2, "0"), F.lit("_"), slug, F.lit(".png")).alias("file"), F.col("x0").alias("left"), F.col("y0").alias("top"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))


def member_name_ok(name: Column) -> Column:
    """True for archive members that stay within the archive."""
    return safe_relative_path(name) & ~F.contains(name, F.lit("\\"))


# Limits of a vector drawing.
MAX_PATHS, MAX_COMMANDS, MAX_BYTES = 150_000, 2_000_000, 256 * 1024 * 1024


def svg_statistics(df: DataFrame, svg: str, keys: list[str], images: int = 0) -> DataFrame:
    """Paths, path commands, distinct fills, embedded images and what breaks the limits."""
    d = F.array_join(F.regexp_extract_all(F.col(svg), F.lit(r"(?s)<path\b[^>]*?\bd=\"([^\"]*)\""), F.lit(1)), " ")
    out = df.select(
        *keys,
        F.regexp_count(F.col(svg), F.lit(r"<path\b")).alias("paths"),
        F.regexp_count(d, F.lit("[MmLlHhVvCcSsQqTtAaZz]")).alias("commands"),
        F.size(F.array_distinct(F.regexp_extract_all(F.col(svg), F.lit(r"\bfill=\"([^\"]*)\""), F.lit(1)))).alias("fills"),
        F.regexp_count(F.col(svg), F.lit(r"<image\b")).alias("images"),
        F.octet_length(svg).alias("bytes"),
    )
    errors = F.array(F.when(F.col("paths") > MAX_PATHS, F.lit("paths")), F.when(F.col("commands") > MAX_COMMANDS, F.lit("commands")), F.when(F.col("bytes") > MAX_BYTES, F.lit("bytes")), F.when(F.col("images") != images, F.lit("images")))
    return out.withColumn("errors", F.array_compact(errors))
