"""ZIP archives whose bytes depend on their members alone, put together by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .writers import member_name_ok

# Flags for UTF-8 names, the date 1980-01-01, made on Unix by version 2.0, a regular file of mode 644.
FLAGS, DATE, MADE_BY, NEEDED, ATTRIBUTES = 0x0800, 0x0021, 0x0314, 20, 0o100644 << 16
MOST_MEMBERS, MOST_BYTES = 0xFFFF, 0xFFFFFFFF


def little(value: Column | int, size: int) -> Column:
    """A number as little-endian bytes."""
    value = F.lit(value) if isinstance(value, int) else value
    h = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))]))


def zipped(members: DataFrame, keys: list[str], name: str, content: str) -> DataFrame:
    """(keys, members, archive): one ZIP of stored members a group, in the order of their names' bytes, with a fixed date and mode. Contents are binary; null is empty.

    A name that is null, repeated in its archive or leads out of it is an error, as is an archive beyond the format's 65,535 members or 4 GB (in Spark a value holds 2 GB). An archive is one value, so its members meet in one task."""
    data, path = F.coalesce(F.col(content), F.unhex(F.lit(""))), F.encode(F.col(name), "UTF-8")
    safe = F.coalesce(member_name_ok(F.col(name)), F.lit(False))
    d = members.select(*keys, F.when(safe, path).otherwise(F.raise_error(F.concat(F.lit("unsafe member name: "), F.coalesce(name, F.lit("null"))))).alias("_path"), data.alias("_data"))
    w = Window.partitionBy(*keys).orderBy("_path")
    d = d.withColumn("_path", F.when(F.lag("_path").over(w) == F.col("_path"), F.raise_error(F.lit("repeated member name"))).otherwise(F.col("_path")))
    size, length = F.octet_length("_data"), F.octet_length("_path")
    before = F.coalesce(F.sum(30 + length + size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    about = F.concat(little(FLAGS, 2), little(0, 2), little(0, 2), little(DATE, 2), little(F.crc32("_data"), 4), little(size, 4), little(size, 4), little(length, 2), little(0, 2))
    d = d.withColumn("_at", before).withColumn("_about", about)
    d = d.select(
        *keys,
        "_path",
        F.concat(F.unhex(F.lit("504B0304")), little(NEEDED, 2), "_about", "_path", "_data").alias("_local"),
        F.concat(F.unhex(F.lit("504B0102")), little(MADE_BY, 2), little(NEEDED, 2), "_about", little(0, 2), little(0, 2), little(0, 2), little(ATTRIBUTES, 4), little(F.col("_at"), 4), "_path").alias("_central"),
    )
    joined = lambda c: F.expr(f"listagg({c}, X'') WITHIN GROUP (ORDER BY _path)")
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), joined("_local").alias("_body"), joined("_central").alias("_directory"))
    end = F.concat(F.unhex(F.lit("504B0506")), little(0, 4), little(F.col("members"), 2), little(F.col("members"), 2), little(F.octet_length("_directory"), 4), little(F.octet_length("_body"), 4), little(0, 2))
    fits = (F.col("members") <= MOST_MEMBERS) & (F.octet_length("_body").cast("long") + F.octet_length("_directory") <= MOST_BYTES)
    return g.select(*keys, "members", F.when(fits, F.concat("_body", "_directory", end)).otherwise(F.raise_error(F.lit("archive too large"))).alias("archive"))
