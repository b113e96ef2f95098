"""Tables of the operators' own shapes, derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import as_raster


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """A hundred boxes an image."""
    p = table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    return p.select(k.alias("id"), F.floor(k / 100).alias("image"), (k % 97).alias("x0"), (k % 89).alias("y0"), (k % 97 + 1 + s % 23).alias("x1"), (k % 89 + 1 + s % 17).alias("y1"), s.alias("size"), F.col("p_retailprice").alias("price"))


BOXES = """boxes AS (SELECT p_partkey AS id, p_partkey // 100 AS image, p_partkey % 97 AS x0, p_partkey % 89 AS y0, p_partkey % 97 + 1 + p_size::BIGINT % 23 AS x1, p_partkey % 89 + 1 + p_size::BIGINT % 17 AS y1, p_size::BIGINT AS size, p_retailprice AS price FROM part)"""
AREA = "(greatest(0, {0}x1 - {0}x0) * greatest(0, {0}y1 - {0}y0))"
COMMON = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
A, B = AREA.format("a."), AREA.format("b.")
IOU = f"(CASE WHEN {A} + {B} - {COMMON} = 0 THEN 0.0 ELSE {COMMON} / ({A} + {B} - {COMMON})::DOUBLE END)"


def readings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("cluster"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 2 == 0, "paddle_ppocrv6_medium").otherwise("tesseract_vie").alias("engine"), (F.col("value") / 500).alias("confidence"))


READINGS = """readings AS (SELECT user_id AS cluster, event_type AS text, CASE WHEN event_id % 2 = 0 THEN 'paddle_ppocrv6_medium' ELSE 'tesseract_vie' END AS engine, value / 500 AS confidence FROM events)"""


def raster(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 x 8 rasters in long form."""
    return as_raster(table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), "label", "embedding"), "embedding")


RASTER = """raster AS (SELECT vec_id AS image, label, (i - 1) // 8 AS y, (i - 1) % 8 AS x, round_even(greatest(0.0, least(1.0, (embedding[i]::DOUBLE + 1) / 2)) * 255, 0)::BIGINT AS v FROM embeddings, range(1, 65) t(i))"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each raster with the next of its label, pixel by pixel. Rasters meet as whole vectors; only pairs are exploded."""
    e = table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    nxt = e.select(F.col("vec_id").alias("image"), "label", F.lead("vec_id").over(w).alias("other")).where("other is not null")
    both = nxt.join(e.select(F.col("vec_id").alias("image"), F.col("embedding").alias("a")), "image").join(e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("b")), "other")
    pixel = lambda c: F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c).cast("double") + 1) / 2)) * 255).cast("long")
    r = both.select("image", "label", "other", F.posexplode(F.arrays_zip("a", "b")).alias("i", "p")).select("image", "label", "other", "i", "p.a", "p.b")
    return r.select("other", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), "image", "label", pixel("a").alias("v"), pixel("b").alias("w"))


_PIXEL = "round_even(greatest(0.0, least(1.0, ({0}[i]::DOUBLE + 1) / 2)) * 255, 0)::BIGINT"
PAIRS = RASTER + f""", nxt AS (SELECT vec_id AS image, label, embedding AS e, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS o FROM embeddings), pairs AS (SELECT image, label, (i - 1) // 8 AS y, (i - 1) % 8 AS x, {_PIXEL.format("e")} AS v, {_PIXEL.format("o")} AS w FROM nxt, range(1, 65) t(i) WHERE o IS NOT NULL)"""


def forest(spark: SparkSession, d: str) -> DataFrame:
    """A tree of layers for every 40 parts (an image): the tables' size sets how many."""
    k = F.col("p_partkey")
    below = F.when(k % 40 > 0, k - k % 40 + F.floor(k % 40 / 3))
    category = F.when(F.col("p_size") % 5 == 0, "text_raster").when(F.col("p_size") % 2 == 0, "object").otherwise("detail_group")
    return table(spark, d, "part").select(k.alias("id"), below.alias("parent"), category.alias("category"), (F.col("p_size") % 7).alias("display_order"))


FOREST = """forest AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 > 0 THEN p_partkey - p_partkey % 40 + p_partkey % 40 // 3 END AS parent, CASE WHEN p_size % 5 = 0 THEN 'text_raster' WHEN p_size % 2 = 0 THEN 'object' ELSE 'detail_group' END AS category, p_size % 7 AS display_order FROM part)"""
