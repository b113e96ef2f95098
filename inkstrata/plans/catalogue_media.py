"""Queries over image headers, names, archives, sizes and layer reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import budget, raster, resample
from ..sources import archives, headers, readers, writers
from . import fixtures as fx
from .catalogue import query
from .catalogue_scalars import _images
from .fixtures import BOXES, RASTER, table


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), digits, "0")


# Parts as images: JPEG with an orientation, PNG (some with several frames), BMP and plain text, by key.
@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS t, 1 + p_partkey % 3000 AS w, 1 + p_size AS h FROM part) SELECT k AS id, CASE t WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'bmp' END AS format, CASE WHEN t = 0 AND 1 + k % 8 >= 5 THEN h WHEN t < 3 THEN w END AS width,
CASE WHEN t = 0 AND 1 + k % 8 >= 5 THEN w WHEN t < 3 THEN h END AS height, CASE t WHEN 0 THEN 'RGB' WHEN 1 THEN CASE WHEN k % 5 = 0 THEN 'RGBA' ELSE 'RGB' END WHEN 2 THEN 'RGB' END AS mode, CASE WHEN t = 1 AND k % 7 = 0 THEN 'multi_frame' WHEN t = 3 THEN 'not_an_image' END AS error FROM p""")
def header_probe(spark: SparkSession, d: str) -> DataFrame:
    k, w, h = F.col("p_partkey"), 1 + F.col("p_partkey") % 3000, 1 + F.col("p_size")
    jpeg = F.concat(F.lit("FFD8FFE100224578696600004D4D002A0000000800010112000300000001"), _hex(1 + k % 8, 4), F.lit("000000000000FFC0001108"), _hex(h, 4), _hex(w, 4), F.lit("03"), F.lit("00" * 9))
    frames = F.when(k % 7 == 0, "000000086163544C000000030000000000000000").otherwise("")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 8), _hex(h, 8), F.lit("08"), F.when(k % 5 == 0, "06").otherwise("02"), F.lit("00000000000000"), frames, F.lit("0000000049444154"))
    bmp = F.concat(F.lit("424D" + "00" * 16), F.hex(archives.little(w, 4)), F.hex(archives.little(h, 4)), F.lit("01001800"))
    text = F.hex("p_name")
    content = F.unhex(F.when(k % 4 == 0, jpeg).when(k % 4 == 1, png).when(k % 4 == 2, bmp).otherwise(text))
    p = table(spark, d, "part").select(k.alias("id"), headers.probe(content).alias("h"))
    return p.select("id", "h.format", "h.width", "h.height", "h.mode", "h.error")


# A file a part, of three kinds below INPUT or beside it; tokens with and without extension, some in two places, some nowhere.
_KINDS = "CASE p_size % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' ELSE 'txt' END"


@query(f"""WITH f AS (SELECT 'INPUT/a' || p_partkey // 2 || '.' || {_KINDS} AS path FROM part WHERE p_partkey % 3 > 0 UNION SELECT 'a' || p_partkey // 2 || '.png' FROM part WHERE p_partkey % 5 = 0), t AS (SELECT DISTINCT 'a' || p_partkey // 2 || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '.png' END AS token FROM part UNION SELECT DISTINCT 'a' || p_partkey // 2 || '.txt' FROM part),
r AS (SELECT token, contains(token, '.') AS named, (SELECT count(*) FROM f WHERE path = 'INPUT/' || token) AS below, (SELECT count(*) FROM f WHERE path = token) AS beside, (SELECT count(*) FROM f WHERE path IN ('INPUT/' || token || '.png', 'INPUT/' || token || '.jpg', 'INPUT/' || token || '.webp')) AS probes, (SELECT min(path) FROM f WHERE path IN ('INPUT/' || token || '.png', 'INPUT/' || token || '.jpg', 'INPUT/' || token || '.webp')) AS probed FROM t)
SELECT token, CASE WHEN named AND token LIKE '%.txt' THEN NULL WHEN below > 0 THEN 'INPUT/' || token WHEN beside > 0 THEN token WHEN NOT named AND probes = 1 THEN probed END AS path, CASE WHEN named AND below + beside > 0 AND token LIKE '%.txt' THEN 'unsupported' WHEN below + beside > 0 THEN NULL WHEN named OR probes = 0 THEN 'missing' WHEN probes > 1 THEN 'ambiguous' END AS problem FROM r""")
def source_resolution(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    stem = F.concat(F.lit("a"), F.floor(k / 2).cast("string"))
    below = p.where(k % 3 > 0).select(F.concat(F.lit("INPUT/"), stem, F.lit("."), F.expr(_KINDS)).alias("path"))
    files = below.union(p.where(k % 5 == 0).select(F.concat(stem, F.lit(".png")))).withColumn("is_dir", F.lit(False))
    tokens = p.select(F.concat(stem, F.when(k % 2 == 0, "").otherwise(".png")).alias("token")).union(p.select(F.concat(stem, F.lit(".txt"))))
    return readers.resolved(tokens, files)


@query("""WITH c AS (SELECT l_orderkey AS tool, l_linenumber AS ord, 'tool-' || l_linenumber AS path, l_linenumber = 1 AS bundled, l_partkey % 3 > 0 AS ok, l_suppkey % 4 > 0 AND l_returnflag = 'N' AS fits FROM lineitem), s AS (SELECT *, ok AND (bundled OR fits) AS good FROM c), b AS (SELECT tool, arg_min(path, ord) FILTER (good) AS path, min(ord) FILTER (good) AS at FROM s GROUP BY tool)
SELECT b.tool, b.path, coalesce(string_agg(s.path, ';' ORDER BY ord) FILTER (s.ok AND NOT s.bundled AND NOT s.good AND (b.at IS NULL OR s.ord < b.at)), '') AS incompatible FROM s JOIN b USING (tool) GROUP BY b.tool, b.path""")
def tool_discovery(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tool"), n.alias("ord"), F.concat(F.lit("tool-"), n.cast("string")).alias("path"), (n == 1).alias("bundled"), (F.col("l_partkey") % 3 > 0).alias("exists"), F.when(F.col("l_suppkey") % 4 > 0, 0).otherwise(1).alias("exit_code"), F.concat(F.lit("version "), F.col("l_returnflag")).alias("output"))
    t = readers.pinned_tools(c, ["tool"], r"version N\b")
    return t.select("tool", "path", F.array_join("incompatible", ";").alias("incompatible"))


_LINE = """SELECT event_id, event_id % 50 AS "left", event_id % 30 AS top, round(value / 5, 3) AS conf, """


@query(_LINE + """'"' || event_type || ' x' AS text FROM events WHERE event_id % 9 > 0""")
def recognition_words(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    line = F.concat_ws("\t", F.lit("5\t1\t1\t1\t1"), k.cast("string"), (k % 50).cast("string"), (k % 30).cast("string"), F.lit("8\t5"), F.when(k % 9 == 0, "-1").otherwise(F.col("value").cast("string")), F.concat(F.lit('"'), F.col("event_type"), F.lit(" x")))
    w = readers.recognition_rows(table(spark, d, "events").select("event_id", line.alias("value")), ["event_id"])
    return w.select("event_id", F.col("left").cast("long").alias("left"), F.col("top").cast("long").alias("top"), F.round(F.col("conf") / 5, 3).alias("conf"), "text")


@query(_LINE + """event_type || ' x' AS text FROM events""")
def recognition_words_quoted(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    line = F.concat_ws("\t", F.lit("5\t1\t1\t1\t1"), k.cast("string"), (k % 50).cast("string"), (k % 30).cast("string"), F.lit("8\t5"), F.col("value").cast("string"), F.concat(F.lit('"'), F.col("event_type"), F.lit(' x"')))
    w = readers.recognition_rows(table(spark, d, "events").select("event_id", line.alias("value")), ["event_id"], quoted=True)
    return w.select("event_id", F.col("left").cast("long").alias("left"), F.col("top").cast("long").alias("top"), F.round(F.col("conf") / 5, 3).alias("conf"), "text")


@query(f"WITH {RASTER} SELECT image, y::BIGINT AS y, x::BIGINT AS x, (a * v + (255 - a) * 255 + 127) // 255 AS v FROM (SELECT *, (x * 37 + y * 11 + image) % 256 AS a FROM raster)")
def white_composite(spark: SparkSession, d: str) -> DataFrame:
    y, x = (F.col(c).cast("long") for c in "yx")
    return fx.raster(spark, d).select("image", y.alias("y"), x.alias("x"), numeric.over_white(F.col("v"), (x * 37 + y * 11 + F.col("image")) % 256).alias("v"))


@query("""SELECT conv_id, count(*) AS members, sum(2 * strlen('turn_' || turn || '.txt') + strlen(text) + 76)::BIGINT + 22 AS bytes, string_agg('turn_' || turn || '.txt', ';' ORDER BY 'turn_' || turn || '.txt') AS names FROM conversations GROUP BY conv_id""")
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("turn_"), F.col("turn").cast("string"), F.lit(".txt"))
    c = table(spark, d, "conversations").select("conv_id", name.alias("name"), F.encode("text", "UTF-8").alias("content"))
    z = archives.zipped(c, ["conv_id"], "name", "content")
    tail = F.decode(F.col("archive"), "ISO-8859-1")
    names = F.regexp_extract_all(tail, F.lit(r"(?s)PK\x01\x02.{42}(turn_[0-9]+\.txt)"), F.lit(1))
    return z.select("conv_id", "members", F.octet_length("archive").cast("long").alias("bytes"), F.array_join(names, ";").alias("names"))


@query(f"WITH {RASTER} SELECT r.image, j.y, i.x, r.v FROM raster r JOIN (SELECT unnest(range(5)) AS y) j ON r.y = (2 * j.y + 1) * 8 // 10 JOIN (SELECT unnest(range(13)) AS x) i ON r.x = (2 * i.x + 1) * 8 // 26")
def resize_nearest(spark: SparkSession, d: str) -> DataFrame:
    r = resample.nearest(fx.raster(spark, d), ["image"], (8, 8), (13, 5))
    return r.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")


def _kernel(name: str, new: int) -> str:
    """Lanczos weights of 8 places resized to ``new``, as a table (o, i, k)."""
    wide = max(8 / new, 1.0)
    sinc = "CASE WHEN {0} = 0 THEN 1 ELSE sin(pi() * {0}) / (pi() * {0}) END"
    return f"""{name}_t AS (SELECT o, i, (i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {8 / new}) / {wide} AS t FROM range({new}) a(o), range(8) b(i)), {name}_w AS (SELECT o, i, CASE WHEN abs(t) < 3 THEN ({sinc.format("t")}) * ({sinc.format("(t / 3)")}) ELSE 0 END AS w FROM {name}_t), {name} AS (SELECT o, i, round(w / sum(w) OVER (PARTITION BY o) * 4194304)::BIGINT AS k FROM {name}_w)"""


_TO8 = "greatest(0, least(255, (sum(k * v)::BIGINT + 2097152) >> 22))"


@query(f"WITH {RASTER}, {_kernel('h', 12)}, {_kernel('u', 5)}, a AS (SELECT image, r.y, h.o AS x, {_TO8} AS v FROM raster r JOIN h ON h.i = r.x GROUP BY ALL) SELECT image, u.o AS y, a.x, {_TO8} AS v FROM a JOIN u ON u.i = a.y GROUP BY image, u.o, a.x")
def resize_lanczos(spark: SparkSession, d: str) -> DataFrame:
    def one(row: dict) -> dict:
        return {"image": row["vec_id"], "pixels": resample.lanczos(np.asarray(row["pixels"]).reshape(8, 8), (12, 5)).ravel().tolist()}

    r = raster.per_image(_images(spark, d), ["vec_id", "pixels"], "image long, pixels array<long>", one)
    return r.select("image", F.posexplode("pixels").alias("i", "v")).select("image", F.floor(F.col("i") / 12).alias("y"), (F.col("i") % 12).cast("long").alias("x"), "v")


@query(f"""WITH {BOXES}, c AS (SELECT image, CASE WHEN size % 5 = 0 THEN 'text_raster' WHEN size % 2 = 0 THEN 'object' ELSE 'detail_group' END AS category, id % 10 > 0 AS child, * EXCLUDE (image) FROM boxes), n AS (SELECT image, count(*) AS layers, count(*) FILTER (child) AS edges, count(*) FILTER (category = 'detail_group') AS details, count(*) FILTER (category = 'object') AS objects, count(*) FILTER (category = 'text_raster') AS texts FROM c GROUP BY image),
p AS (SELECT image, child, y, unnest(range(x0, x1)) AS x FROM (SELECT image, child, x0, x1, unnest(range(y0, y1)) AS y FROM c)), u AS (SELECT image, y, x, bool_and(child) AS child FROM p GROUP BY ALL), s AS (SELECT image, round(count(*) / 12720.0, 6) AS coverage, round(count(*) FILTER (NOT child) / 12720.0, 6) AS top_level FROM u GROUP BY image) SELECT * FROM n JOIN s USING (image)""")
def layer_report(spark: SparkSession, d: str) -> DataFrame:
    category = F.when(F.col("size") % 5 == 0, "text_raster").when(F.col("size") % 2 == 0, "object").otherwise("detail_group")
    c = fx.boxes(spark, d).withColumn("category", category).withColumn("parent", F.when(F.col("id") % 10 > 0, F.col("id") - F.col("id") % 10))
    r = budget.layer_report(c, "image", "category", "parent", F.lit(12720.0))
    of = lambda name: F.coalesce(F.col("by_category")[name], F.lit(0))
    return r.select("image", "layers", "edges", of("detail_group").alias("details"), of("object").alias("objects"), of("text_raster").alias("texts"), "coverage", "top_level")


# A text of n letters is 0.55 n sizes wide and 1.2 sizes high; its box comes from the document's key.
@query("""WITH t AS (SELECT doc_id, 1 + doc_id % 40 AS n, 40 + doc_id % 900 AS w, 8 + doc_id % 120 AS h FROM documents) SELECT doc_id, (SELECT max(s) FROM range(1, 512) r(s) WHERE s <= greatest(8, 4 * h) AND ceil(s * n * 55 / 100.0) <= w AND ceil(s * 12 / 10.0) <= h) AS size FROM t""")
def font_size(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    n, w, h = 1 + k % 40, 40 + k % 900, 8 + k % 120
    fits = lambda s: (F.ceil(s * n * 55 / 100.0) <= w) & (F.ceil(s * 12 / 10.0) <= h)
    return table(spark, d, "documents").select("doc_id", budget.largest_fitting(F.lit(1), F.greatest(F.lit(8), 4 * h), fits).alias("size"))


@query("""WITH b AS (SELECT p_partkey AS id, 60 + p_partkey % 700 AS width, 10 + p_size AS height, 2 + p_partkey % 19 AS n FROM part), f(rank, family, subfamily, pace) AS (VALUES (0, 'Serif', 'Regular', 50), (1, 'Sans', 'Bold', 62), (1, 'Sans', 'Regular', 57)), c AS (SELECT b.*, f.*, 75 + 5 * i AS axis FROM b, f, range(11) r(i)),
s AS (SELECT *, (SELECT max(s) FROM range(1, 512) q(s) WHERE s <= greatest(8, 4 * height) AND s * n * pace * axis // 10000 <= width AND s * 12 // 10 <= height) AS size FROM c), g AS (SELECT *, (size * n * pace * axis // 10000) / width::DOUBLE AS wide, (size * 12 // 10) / height::DOUBLE AS high FROM s WHERE size IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(least(wide, high) * 100 + wide * high * 10 - rank * 0.05::DOUBLE, 9) DESC, rank, family DESC, subfamily DESC, axis) AS rn FROM g) SELECT id, family, subfamily, axis::DOUBLE AS axis, size FROM r WHERE rn = 1""")
def font_geometry(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    fonts = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(f).alias("family"), F.lit(s).alias("subfamily"), F.lit(p).alias("pace")) for r, f, s, p in ((0, "Serif", "Regular", 50), (1, "Sans", "Bold", 62), (1, "Sans", "Regular", 57))])
    c = table(spark, d, "part").select(k.alias("id"), (60 + k % 700).alias("width"), (10 + F.col("p_size")).alias("height"), (2 + k % 19).alias("n"), F.inline(fonts))
    measure = lambda s, a: (F.floor(s * F.col("n") * F.col("pace") * a / 10000), F.floor(s * 12 / 10))
    return budget.font_geometry(c, ["id"], (F.lit(75.0), F.lit(125.0)), measure).select("id", "family", "subfamily", "axis", "size")


@query("""SELECT o_orderkey, '{"bytes":[' || array_to_string(list_transform(range(1, strlen(o_orderstatus) + 1), lambda i: ord(o_orderstatus[i])), ',') || '],"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","names":{"' || o_custkey || '":["' || o_orderpriority || '",null]},"nothing":null}' AS json FROM orders""")
def plain_json(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    names = F.create_map("o_custkey", F.array("o_orderpriority", F.lit(None).cast("string")))
    rows = o.select("o_orderkey", names.alias("names"), F.encode("o_orderstatus", "UTF-8").alias("bytes"), F.to_date("o_orderdate").alias("day"), F.lit(None).cast("string").alias("nothing"))
    return writers.plain_json(rows, ["o_orderkey"])
