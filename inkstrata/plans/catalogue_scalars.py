"""Further queries: scalars, hashes, gates, tiles, text, folds, stencils, streams."""

from __future__ import annotations



import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import hashing, numeric, spans, text
from ..operators import folds, manifest, raster, review, stencils, tiles
from ..sources import readers, writers
from ..streaming import lines
from . import fixtures as fx
from . import fold_sql, models, resources
from .catalogue import query
from .fixtures import BOXES, PAIRS, RASTER, table

# --- geometry and numbers ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {BOXES}, p AS (SELECT id, greatest(1, y1 - y0) AS h, greatest(1, x1 - x0) AS w, * EXCLUDE (id) FROM boxes), q AS (SELECT *, greatest(1, round_even(least(h * 0.10, w * 0.04), 0)::BIGINT) AS px, greatest(1, round_even(h * 0.12, 0)::BIGINT) AS py FROM p) SELECT id, greatest(0, x0 - px) AS x0, greatest(0, y0 - py) AS y0, least(110, x1 + px) AS x1, least(110, y1 + py) AS y1 FROM q""")
def expanded_box(spark: SparkSession, d: str) -> DataFrame:
    e = g.text_padding(g.box(), F.lit(110).cast("long"), F.lit(110).cast("long"))
    return fx.boxes(spark, d).select("id", *[c.alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), e, strict=True)])


@query(f"""WITH {BOXES} SELECT id, CASE WHEN (y0 + y1) / 220.0 < 0.20 THEN 'top' WHEN (y0 + y1) / 220.0 < 0.42 THEN 'upper' WHEN (y0 + y1) / 220.0 < 0.66 THEN 'middle' WHEN (y0 + y1) / 220.0 < 0.86 THEN 'lower' ELSE 'bottom' END || '_' || CASE WHEN (x0 + x1) / 240.0 < 0.38 THEN 'left' WHEN (x0 + x1) / 240.0 > 0.62 THEN 'right' ELSE 'center' END AS hint FROM boxes""")
def position_hint(spark: SparkSession, d: str) -> DataFrame:
    return fx.boxes(spark, d).select("id", g.position_hint(g.box(), F.lit(120), F.lit(110)).alias("hint"))


@query(f"WITH {RASTER} SELECT image, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS pixels FROM raster WHERE v >= 150 GROUP BY image")
def mask_bbox(spark: SparkSession, d: str) -> DataFrame:
    return fx.raster(spark, d).where("v >= 150").groupBy("image").agg(F.min("x").cast("long").alias("x0"), F.min("y").cast("long").alias("y0"), (F.max("x") + 1).cast("long").alias("x1"), (F.max("y") + 1).cast("long").alias("y1"), F.count(F.lit(1)).alias("pixels"))


LIN = "(CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END)"


@query(f"WITH {RASTER}, l AS (SELECT v, v / 255.0::DOUBLE AS s FROM raster) SELECT v, count(*) AS n, round({LIN.format('s')}, 9) AS linear, round({LIN.format('s')} * 0.5, 9) AS half FROM l GROUP BY v, s")
def srgb_linear(spark: SparkSession, d: str) -> DataFrame:
    lin = numeric.srgb_to_linear(F.col("v") / 255.0)
    return fx.raster(spark, d).groupBy("v").agg(F.count(F.lit(1)).alias("n")).select("v", "n", F.round(lin, 9).alias("linear"), F.round(lin * 0.5, 9).alias("half"))


BLEND = f"0.7 * {LIN.format('(v / 255.0::DOUBLE)')} + 0.3 * {LIN.format('(w / 255.0::DOUBLE)')}"


@query(f"WITH {PAIRS}, m AS (SELECT *, {BLEND} AS l FROM pairs) SELECT image, sum(round_even((CASE WHEN l <= 0.0031308 THEN l * 12.92 ELSE 1.055 * pow(l, 1 / 2.4) - 0.055 END) * 255, 0)::BIGINT)::BIGINT AS total FROM m GROUP BY image")
def linear_blend(spark: SparkSession, d: str) -> DataFrame:
    return fx.pairs(spark, d).groupBy("image").agg(F.sum(numeric.linear_blend(F.col("v"), F.col("w"), 0.3)).cast("long").alias("total"))


@query(f"WITH {PAIRS}, m AS (SELECT image, v, w, 0.2126::DOUBLE * v + 0.7152::DOUBLE * w + 0.0722::DOUBLE * ((v + w) // 2) AS luma FROM pairs) SELECT image, round(avg(luma), 11) AS mean, round(quantile_cont(luma, 0.99) - quantile_cont(luma, 0.01), 8) AS dynamic_range FROM m GROUP BY image")
def luma_stats(spark: SparkSession, d: str) -> DataFrame:
    y = numeric.luma(F.col("v"), F.col("w"), F.floor((F.col("v") + F.col("w")) / 2))
    return fx.pairs(spark, d).groupBy("image").agg(F.round(F.avg(y), 11).alias("mean"), F.round(F.percentile(y, 0.99) - F.percentile(y, 0.01), 8).alias("dynamic_range"))


@query(f"WITH {PAIRS}, m AS (SELECT image, y, x, v / 255.0::DOUBLE AS s, w / 255.0::DOUBLE AS t FROM pairs) SELECT image, y, x, greatest(0, least(255, round_even(greatest(0.0, least(1.0, CASE WHEN s < 1e-4 THEN t ELSE s * ((t + 1e-5) / (s + 1e-5)) END)) * 255, 0)::BIGINT)) AS v FROM m")
def luma_replace(spark: SparkSession, d: str) -> DataFrame:
    return fx.pairs(spark, d).select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), numeric.replaced_luma(F.col("v") / 255.0, F.col("v") / 255.0, F.col("w") / 255.0).alias("v"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN greatest(l_discount, 0.02) > 1e-9 THEN round(l_tax / greatest(l_discount, 0.02), 9) WHEN l_tax <= 1e-9 THEN 1.0 ELSE 'inf'::DOUBLE END AS floored, CASE WHEN l_discount > 1e-9 THEN round(l_tax / l_discount, 9) WHEN l_tax <= 1e-9 THEN 1.0 ELSE 'inf'::DOUBLE END AS plain FROM lineitem")
def safe_ratios(spark: SparkSession, d: str) -> DataFrame:
    t, b = F.col("l_tax"), F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.rounded(numeric.safe_ratio(t, b, 0.02), 9).alias("floored"), numeric.rounded(numeric.safe_ratio(t, b), 9).alias("plain"))


@query("""SELECT p_partkey AS id, greatest(1, ceil(p_size / 7.0 * 3.0))::BIGINT AS radius, round(greatest(1e-6, CASE WHEN 3 < p_size % 9 THEN 0.5 - 0.5 * cos(pi() * 3.5 / (p_size % 9)) ELSE 1.0 END), 9) AS taper FROM part""")
def kernel_and_taper(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), numeric.kernel_radius(s / 7.0).cast("long").alias("radius"), F.round(numeric.cosine_taper(F.lit(3), F.lit(64), s % 9, F.lit(0)), 9).alias("taper"))


FD = "(CASE WHEN ({0}) >= 0 THEN ({0}) // ({1}) ELSE -((-({0}) + ({1}) - 1) // ({1})) END)"
CD = "(-" + FD.format("-({0})", "{1}") + ")"


def _clamp(x: str) -> str:
    return f"greatest(0, least(255, {x}))"


_LO, _HI = CD.format("255 * t - 127 - (255 - a) * b", "greatest(a, 1)"), FD.format("255 * t + 127 - (255 - a) * b", "greatest(a, 1)")
_NEAR = _clamp(FD.format("2 * (255 * t - (255 - a) * b) + greatest(a, 1)", "2 * greatest(a, 1)"))
_BLO, _BHI = _clamp(CD.format("255 * t - 127 - 255 * a", "greatest(255 - a, 1)")), _clamp(FD.format("255 * t + 127", "greatest(255 - a, 1)"))
ALPHA_SQL = f"""WITH t AS (SELECT DISTINCT l_orderkey % 256 AS t, l_partkey % 256 AS b, l_suppkey * 7 % 256 AS a FROM lineitem), s AS (SELECT *, {_clamp(f"CASE WHEN t > b THEN {CD.format('255 * t - 127 - 255 * b', 'greatest(255 - b, 1)')} WHEN t < b THEN {CD.format('255 * b - 255 * t - 127', 'greatest(b, 1)')} ELSE 0 END")} AS least_alpha,
CASE WHEN a = 0 THEN t = b ELSE {_LO} <= 255 AND {_HI} >= 0 AND {_clamp(_LO)} <= {_clamp(_HI)} END AS feasible, CASE WHEN a = 255 THEN b ELSE least(greatest(b, {_BLO}), {_BHI}) END AS below FROM t), f AS (SELECT *, CASE WHEN a = 0 THEN t WHEN feasible THEN least(greatest({_NEAR}, {_clamp(_LO)}), {_clamp(_HI)}) ELSE {_NEAR} END AS fore FROM s) SELECT t, b, a, least_alpha, feasible, below, fore, (a * fore + (255 - a) * b + 127) // 255 AS composed FROM f"""


@query(ALPHA_SQL)
def alpha_algebra(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select((F.col("l_orderkey") % 256).alias("t"), (F.col("l_partkey") % 256).alias("b"), (F.col("l_suppkey") * 7 % 256).alias("a")).distinct()
    t, tt, b, a = t, F.col("t"), F.col("b"), F.col("a")
    f = numeric.foreground(tt, b, a)
    t = t.select("t", "b", "a", numeric.least_alpha(tt, b).alias("least_alpha"), f["feasible"].alias("feasible"), numeric.feasible_below(tt, b, a).alias("below"), f["foreground"].alias("fore"))
    return t.withColumn("composed", numeric.composite(a, F.col("fore"), b))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity * 0.35, 0)::BIGINT AS alpha, ((l_partkey % 256) * (l_suppkey % 256) + (255 - l_partkey % 256) * 255 + 127) // 255 AS on_white FROM lineitem")
def alpha_multiply(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.scaled_alpha(F.col("l_quantity"), 0.35).alias("alpha"), numeric.over_white(F.col("l_suppkey") % 256, F.col("l_partkey") % 256).alias("on_white"))


_TG = "SELECT b.id, greatest(1.0, b.x1 - b.x0) AS tw, greatest(1.0, b.y1 - b.y0) AS th, greatest(1.0, b.x1 - b.x0 + size % 3 - 1) AS rw, greatest(1.0, b.y1 - b.y0 + size % 2) AS rh, abs((size % 3 - 1) * 0.5) / greatest(1.0, b.x1 - b.x0) AS cx, abs((size % 2) * 0.5) / greatest(1.0, b.y1 - b.y0) AS cy FROM boxes b"


@query(f"WITH {BOXES}, t AS ({_TG}) SELECT id, round(rw / tw, 6) AS width_ratio, round(abs(ln((rw / rh) / (tw / th))), 6) AS aspect_log_error, rw / tw BETWEEN 0.78 AND 1.12 AND rh / th BETWEEN 0.78 AND 1.12 AND abs(ln((rw / rh) / (tw / th))) <= 0.18 AND cx <= 0.10 AND cy <= 0.10 AS passed FROM t")
def typography_gate(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("size")
    t = g.box()
    gate = g.typography_gate(t, g.Box(t.x0, t.y0, t.x1 + s % 3 - 1, t.y1 + s % 2))
    return fx.boxes(spark, d).select("id", F.round(gate["width_ratio"], 6).alias("width_ratio"), F.round(gate["aspect_log_error"], 6).alias("aspect_log_error"), gate["passed"].alias("passed"))


@query(f"WITH {BOXES} SELECT id, CASE size % 3 WHEN 0 THEN x0 WHEN 1 THEN x1 - size ELSE x0 + floor((x1 - x0 - size) / 2.0)::BIGINT END AS at FROM boxes")
def alignment(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("size")
    how = F.when(s % 3 == 0, "left").when(s % 3 == 1, "end").otherwise("center")
    return fx.boxes(spark, d).select("id", g.placed(how, F.col("x0"), F.col("x1"), s).cast("long").alias("at"))


@query(f"WITH {BOXES}, c AS (SELECT id, greatest(206.0 / (size + 100), 146.0 / (id % 50 + 100)) AS scale, size + 100 AS w, id % 50 + 100 AS h FROM boxes) SELECT id, round(scale, 9) AS scale, round((200 - w * scale) / 2, 6) AS \"left\", w * scale >= 205.5 AND h * scale >= 145.5 AS covers FROM c")
def cover_fit(spark: SparkSession, d: str) -> DataFrame:
    c = g.cover_fit(F.col("size") + 100, F.col("id") % 50 + 100, F.lit(200.0), F.lit(140.0), F.lit(3.0))
    return fx.boxes(spark, d).select("id", F.round(c["scale"], 9).alias("scale"), F.round(c["left"], 6).alias("left"), c["covers"].alias("covers"))


# --- gates ---------------------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, CASE WHEN (CASE WHEN p_size % 9 BETWEEN 5 AND 8 THEN p_retailprice * 2 ELSE p_retailprice END) BETWEEN 10 AND 2400 THEN (CASE WHEN p_size % 9 BETWEEN 5 AND 8 THEN p_retailprice * 2 ELSE p_retailprice END) END AS dpi FROM part")
def canonical_dpi(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_retailprice")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), numeric.canonical_dpi(p, p * 2, F.col("p_size") % 9).alias("dpi"))


SIZES = "SELECT l_orderkey, l_linenumber, (l_quantity * 300)::BIGINT * (l_linenumber * 700) AS s, (l_quantity * 900)::BIGINT * (l_linenumber * 2000) AS o, l_returnflag = 'R' AS huge, 8 + l_linenumber * 9 AS layers FROM lineitem"
GIB = "1073741824.0"


@query(f"""WITH z AS ({SIZES}) SELECT l_orderkey, l_linenumber, CASE WHEN s * 16 / 1e6 > 750 OR o / 1e6 > 750 THEN 'hard_limit' WHEN o / 1e6 > 500 AND NOT huge THEN 'soft_limit' ELSE 'admitted' END AS standard, round_even(greatest(s * 16 * 24, o * 20) / {GIB} + 2, 2) AS print_ram_gib,
CASE WHEN s / 1e6 > 64 OR s * 16 / 1e6 > 750 OR o / 1e6 > 750 THEN 'hard_limit' WHEN (s / 1e6 > 12 OR o / 1e6 > 500) AND NOT huge THEN 'soft_limit' WHEN s * 16 * 5 + o * 12 + 1073741824 > 16e9 * 0.8 THEN 'disk' WHEN greatest(s * 16 * 24, o * 20) + 2147483648 > 8e9 * 0.85 THEN 'memory' ELSE 'admitted' END AS print,
CASE WHEN layers NOT BETWEEN 4 AND 60 THEN 'layer_count' WHEN s / 1e6 > 64 OR o / 1e6 > 300 THEN 'hard_limit' WHEN o / 1e6 > 120 AND NOT huge THEN 'soft_limit' WHEN o * 20 + 2147483648 > 16e9 * 0.8 THEN 'disk' WHEN s * 420 + o * (32 + 5 * layers) + 3221225472 > 8e9 * 0.85 THEN 'memory' ELSE 'admitted' END AS layered,
CASE WHEN s / 1e6 > 64 OR o / 1e6 > 300 THEN 'hard_limit' WHEN o / 1e6 > 120 AND NOT huge THEN 'soft_limit' WHEN s * 30 + o * 14 + 1073741824 > 16e9 * 0.8 THEN 'disk' WHEN s * 150 + o * 24 + 4294967296 > 8e9 * 0.85 THEN 'memory' ELSE 'admitted' END AS repair FROM z""")
def resource_plans(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    s, o, huge, layers = F.col("s"), F.col("o"), F.col("huge"), F.col("layers")
    z = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((q * 300).cast("long") * (n * 700)).alias("s"), ((q * 900).cast("long") * (n * 2000)).alias("o"), (F.col("l_returnflag") == "R").alias("huge"), (8 + n * 9).alias("layers"))
    disk, ram = F.lit(16e9), F.lit(8e9)
    p = resources.print_plan(s, o, F.lit(False), huge, disk, ram)
    return z.select("l_orderkey", "l_linenumber", resources.standard(s, o, huge)["decision"].alias("standard"), p["ram_gib"].alias("print_ram_gib"), p["decision"].alias("print"), resources.layer_plan(s, o, layers, huge, disk, ram)["decision"].alias("layered"), resources.repair_plan(s, o, huge, disk, ram)["decision"].alias("repair"))


@query("""WITH s AS (SELECT p_partkey AS id, p_size * 97 AS w, p_partkey % 4000 + 50 AS h, CASE WHEN p_size % 3 = 0 THEN p_retailprice * 20 END AS mm, p_size % 4 * 25.0 AS bleed FROM part), n AS (SELECT *, coalesce(mm, w / 96.0 * 25.4) AS width_mm FROM s), g AS (SELECT *, width_mm * h / w AS height_mm FROM n), d AS (SELECT *, greatest(1, ceil((greatest(width_mm, height_mm) + 2 * bleed) / 5000.0)) AS den FROM g)
SELECT id, round(width_mm, 6) AS width_mm, round(height_mm, 6) AS height_mm, den::BIGINT AS denominator, round(width_mm / den + 2 * bleed / den, 6) AS outer_w_mm FROM d""")
def print_geometry(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("p_size"), F.col("p_partkey")
    z = resources.print_geometry(s * 97, k % 4000 + 50, F.lit(96.0), F.when(s % 3 == 0, F.col("p_retailprice") * 20), s % 4 * 25.0)
    return table(spark, d, "part").select(k.alias("id"), F.round(z["width_mm"], 6).alias("width_mm"), F.round(z["height_mm"], 6).alias("height_mm"), z["denominator"].cast("long").alias("denominator"), F.round(z["outer_w_mm"], 6).alias("outer_w_mm"))


@query(fold_sql.PAGE_BOXES)
def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    mm = resources.MM
    w, h, b = s + 100.0, s + 150.0, F.lit(3.0)
    outer = F.array(F.lit(0.0), F.lit(0.0), (w + 2 * b) * mm, (h + 2 * b) * mm)
    trim = F.array(b * mm, b * mm, (w + b) * mm + F.when(k % 7 == 0, 9.0).otherwise(0.0), (h + b) * mm)
    media = F.when(k % 5 == 0, F.array(F.lit(50.0), F.lit(0.0), F.lit(40.0), F.lit(9.0))).otherwise(outer)
    return table(spark, d, "part").select(k.alias("id"), F.array_join(resources.page_box_errors(media, outer, trim, w, h, b), ";").alias("errors"))


@query("""WITH x AS (SELECT p_partkey AS id, greatest(0, round_even(p_size - 5.5, 0)::BIGINT) AS x0, greatest(0, round_even(p_partkey % 40 - 3.5, 0)::BIGINT) AS y0, least(200, round_even(p_size * 3.5, 0)::BIGINT) AS x1, least(100, round_even(p_partkey % 40 + p_size, 0)::BIGINT) AS y1, lower(trim(p_brand)) AS label FROM part) SELECT id, x0, y0, x1, y1, label FROM x WHERE greatest(0, x1 - x0) * greatest(0, y1 - y0) > 16 AND greatest(0, x1 - x0) * greatest(0, y1 - y0) / 20000.0 <= 0.55""")
def detection_filter(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    x = table(spark, d, "part").select(k.alias("id"), (s - 5.5).alias("x0"), (k % 40 - 3.5).alias("y0"), (s * 3.5).alias("x1"), (k % 40 + s).cast("double").alias("y1"), F.col("p_brand").alias("label"), F.lit(200).cast("long").alias("w"), F.lit(100).cast("long").alias("h"))
    return resources.detection_filter(x, "w", "h").select("id", "x0", "y0", "x1", "y1", "label")


@query(f"WITH {BOXES} SELECT id, (x1 - x0) * (y1 - y0) / 9000.0 BETWEEN 0.00012 AND 0.72 AND x1 - x0 >= 3 AND y1 - y0 >= 3 AS candidate, (x1 - x0) * (y1 - y0) / 1500.0 > 0.17 OR ((x1 - x0) * (y1 - y0) / 1500.0 > 0.025 AND size / 50.0 > 0.72 AND price % 60 < 34) AS background FROM boxes")
def mask_gates(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return fx.boxes(spark, d).select("id", resources.mask_filter(w * h, F.lit(9000.0), w, h).alias("candidate"), resources.background_like(w * h, F.lit(1500.0), F.col("size") / 50.0, F.col("price") % 60).alias("background"))


@query("SELECT doc_id, regexp_matches(text, '[0-9]|%') AS critical FROM documents")
def critical_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace("text", "(?iU)(₫|đ|sđt|đt|tel|hotline|sku|mã|giá|km)", "x")
    return table(spark, d, "documents").select("doc_id", text.is_critical(t).alias("critical"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/abs/x' WHEN 1 THEN 'a/../b' WHEN 2 THEN 'C:\\x' WHEN 3 THEN '' ELSE 'ok/' || page_id::VARCHAR || '.png' END AS path FROM pages) SELECT page_id, page_id % 6 >= 4 AS safe FROM p""")
def path_safety(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    p = F.when(k % 6 == 0, "/abs/x").when(k % 6 == 1, "a/../b").when(k % 6 == 2, "C:\\x").when(k % 6 == 3, "").otherwise(F.concat(F.lit("ok/"), k.cast("string"), F.lit(".png")))
    return table(spark, d, "pages").select(k, text.safe_relative_path(p).alias("safe"))


@query("SELECT event_id, props NOT LIKE '%\"k\": 7%' AS portable FROM events")
def portable_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.portable(F.col("props"), '"k": 7').alias("portable"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'bbox_invalid' ELSE '' END || CASE WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN ';' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'status_invalid' ELSE '' END AS errors FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0""")
def review_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    x1 = F.when(k % 5 == 0, k).otherwise(k + 9)
    box = F.array(k, F.lit(1).cast("long"), x1, F.lit(9).cast("long"))
    rows = table(spark, d, "documents").select(k, F.lit(0).alias("document"), k.cast("string").alias("region_id"), box.alias("bbox"), F.col("text").alias("selected_text"), F.when(k % 3 == 0, "blue").otherwise("green").alias("status"), F.lit("keep").alias("action"), F.lit(1 << 40).alias("w"), F.lit(20).alias("h"))
    rows = rows.withColumn("region_fingerprint", hashing.region_fingerprint(F.col("bbox"), F.col("selected_text")))
    return review.document_errors(rows, "document", "w", "h").select(F.col("region_id").cast("long").alias("doc_id"), F.array_join("errors", ";").alias("errors"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size < 40 THEN CASE WHEN p_size * 3 >= 128 THEN '' ELSE 'tile;' END || CASE WHEN p_size BETWEEN 8 AND p_size * 3 // 2 THEN '' ELSE 'overlap;' END ELSE CASE WHEN p_size * 3 >= 128 THEN '' ELSE 'tile;' END END AS errors FROM part""")
def config_validation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(4.0).alias("scale"), (F.col("p_size") * 3).alias("tile"), F.col("p_size").alias("overlap"))
    return c.select("id", F.array_join(F.transform(resources.config_errors(c), lambda e: F.concat(e, F.lit(";"))), "").alias("errors"))


@query("SELECT p_partkey AS id, (p_partkey & 2) <> 0 AS restricted, (p_partkey & 15) = 0 AS installable, (p_partkey & 8) <> 0 AS editable, (p_partkey & 256) <> 0 AS no_subsetting, (p_partkey & 2) = 0 AS embeddable FROM part")
def embedding_policy(spark: SparkSession, d: str) -> DataFrame:
    e = resources.embedding_policy(F.col("p_partkey"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[e[n].alias(n) for n in ("restricted", "installable", "editable", "no_subsetting", "embeddable")])


@query("""SELECT l_orderkey AS document, sum((l_quantity * 400)::BIGINT * (l_linenumber * 1500) * 4)::BIGINT AS raw_bytes, CASE WHEN max(greatest(l_quantity * 700, 100)) > 30000 THEN 'side_too_long' WHEN sum((l_quantity * 400)::BIGINT * (l_linenumber * 1500) * 4) > 1600000000 THEN 'raw_too_large' END AS psd_reason FROM lineitem GROUP BY 1""")
def export_gates(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), (q * 400).cast("long").alias("w"), (n * 1500).cast("long").alias("h"), (q * 700).alias("canvas_w"), F.lit(100.0).alias("canvas_h"))  # noqa: E741
    return resources.export_gates(l, "document", F.lit(1e12)).select("document", "raw_bytes", "psd_reason")


@query("""WITH a AS (SELECT p_partkey AS id, ['onload', 'fill', 'style', 'x y', 'href', 'data-a'][p_size % 6 + 1] AS name, ['red', 'javascript:x', 'url(#a)', '3.5'][p_partkey % 4 + 1] AS value FROM part) SELECT id, name IN ('fill', 'data-a') AND value IN ('red', '3.5') AS safe FROM a""")
def attribute_allow_list(spark: SparkSession, d: str) -> DataFrame:
    names, values = F.array(*[F.lit(x) for x in ("onload", "fill", "style", "x y", "href", "data-a")]), F.array(*[F.lit(x) for x in ("red", "javascript:x", "url(#a)", "3.5")])
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), text.safe_attribute(F.get(names, s % 6), F.get(values, (k % 4).cast("int"))).alias("safe"))


@query("""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'pipeline' END, CASE WHEN o_custkey % 3 = 0 THEN 'size' END, CASE WHEN o_orderkey % 5 = 0 THEN 'scale' END, CASE WHEN o_orderstatus = 'O' THEN 'status' END, CASE WHEN o_custkey % 7 = 0 THEN 'nested_qa' END], lambda x: x IS NOT NULL), ';') AS errors FROM orders""")
def launcher_gates(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    e = resources.launcher_errors(F.when(k % 2 == 0, "x").otherwise("V7"), "V7", c, c, F.when(c % 3 == 0, c + 1).otherwise(c), c, F.lit(4.0), F.when(k % 5 == 0, 4.5).otherwise(4.0), F.when(F.col("o_orderstatus") == "O", "?").otherwise("PASS"), F.array(F.lit(True), c % 7 != 0))
    return table(spark, d, "orders").select(k.alias("id"), F.array_join(e, ";").alias("errors"))


# --- hashes and text -----------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS lower_hex, upper(sha256(text)) AS upper_hex, sha256(lower(replace(source || '\\' || lang, '\\', '/'))) AS path_identity FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    h = hashing.sha256(F.col("text"))
    return table(spark, d, "documents").select("doc_id", h.alias("lower_hex"), F.upper(h).alias("upper_hex"), hashing.path_identity(F.concat(F.col("source"), F.lit("\\"), F.col("lang"))).alias("path_identity"))


@query("""SELECT vec_id, sha256('{"id":' || vec_id::VARCHAR || ',"label":' || label::VARCHAR || ',"name":"v' || vec_id::VARCHAR || '"}') AS json_hash FROM embeddings""")
def json_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", hashing.json_sha256(name=F.concat(F.lit("v"), F.col("vec_id").cast("string")), id=F.col("vec_id"), label=F.col("label")).alias("json_hash"))


@query("""SELECT doc_id, sha256('{"lang":"' || lang || '","n":' || n_chars::VARCHAR || '}') AS ascii_hash FROM documents""")
def ascii_json_hashes(spark: SparkSession, d: str) -> DataFrame:
    j = F.format_string('{ "n": %d, "lang": "%s" }', "n_chars", "lang")
    return table(spark, d, "documents").select("doc_id", hashing.ascii_json_sha256(j).alias("ascii_hash"))


@query("SELECT p_partkey AS id, sha256(encode('V7-RGB-U8') || '\\x00'::BLOB || encode('2x' || p_size::VARCHAR) || '\\x00'::BLOB || encode(p_name)) AS rows, sha256(encode('RESIZE_CANONICAL_SRGB_WHITE_V1') || '\\x00'::BLOB || encode(p_size::VARCHAR || 'x2:RGB') || '\\x00'::BLOB || encode(p_name)) AS canonical FROM part")
def pixel_hashes(spark: SparkSession, d: str) -> DataFrame:
    px = F.encode("p_name", "UTF-8")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[hashing.pixel_sha256(F.col("p_size"), F.lit(2), px, n).alias(n) for n in ("rows", "canonical")])


@query("""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'missing:seed' END, CASE WHEN o_orderkey % 6 = 0 THEN 'invalid:config_sha256' END, CASE WHEN o_orderkey % 5 = 0 THEN 'mismatch:output_pixel_sha256' END], lambda x: x IS NOT NULL), ';') AS errors FROM orders""")
def determinism_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    h = F.sha2(k.cast("string"), 256)
    e = hashing.determinism_errors(F.when(k % 4 != 0, k), h, F.when(k % 6 == 0, "zz").otherwise(h), h, h, F.when(k % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(h))
    return table(spark, d, "orders").select(k.alias("id"), F.array_join(e, ";").alias("errors"))


@query("""SELECT label, sha256('{"engine":"e' || label::VARCHAR || '","files":' || count(*)::VARCHAR || ',"model":' || sum(vec_id)::VARCHAR || '}') AS signature FROM embeddings GROUP BY label""")
def cache_signature(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("s"))
    return e.select("label", hashing.json_sha256(engine=F.concat(F.lit("e"), F.col("label").cast("string")), files=F.col("n"), model=F.col("s")).alias("signature"))


@query("SELECT page_id AS path, octet_length(encode(html))::BIGINT AS bytes, sha256(html) AS sha256, octet_length(encode(html)) > 0 AS non_empty FROM pages")
def asset_records(spark: SparkSession, d: str) -> DataFrame:
    return manifest.asset_records(table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")), "page_id").withColumnRenamed("page_id", "path")


@query("SELECT doc_id, nfc_normalize(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS clean FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.nfc(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " "))).alias("clean"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS numbers, regexp_matches(text, '[\\p{L}\\p{N}]') AS has_alnum FROM documents")
def digit_span_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"), text.has_alnum(F.col("text")).alias("has_alnum"))


@query("WITH t AS (SELECT conv_id, turn, repeat(' ', (turn % 3)::INT) || text || repeat(chr(10), (conv_id % 4)::INT) AS s FROM conversations), e AS (SELECT *, regexp_extract(s, '^\\s*') AS prefix FROM t), f AS (SELECT *, CASE WHEN prefix = s THEN '' ELSE regexp_extract(s, '\\s*$') END AS suffix FROM e) SELECT conv_id, turn, prefix, substr(s, length(prefix) + 1, length(s) - length(prefix) - length(suffix)) AS core, suffix FROM f")
def edge_whitespace(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.repeat(F.lit(" "), (F.col("turn") % 3).cast("int")), F.col("text"), F.repeat(F.lit("\n"), (F.col("conv_id") % 4).cast("int")))
    e = text.edge_whitespace(s)
    return table(spark, d, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in e.items()])


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size::VARCHAR || 'p25' WHEN 2 THEN p_size::VARCHAR || 'p5' ELSE p_size::VARCHAR || 'p75' END AS tag FROM part")
def scale_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.scale_tag(F.col("p_size") + F.col("p_size") % 4 * 0.25).alias("tag"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'a;b' WHEN o_orderkey % 3 = 1 THEN 'b;a' ELSE 'a' END AS reasons, CASE WHEN o_orderkey % 3 = 0 THEN 'the two readers don''t agree' ELSE '' END AS friendly FROM orders""")
def reason_lists(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    r = F.when(k % 3 == 0, lit("a", " ", "b", "a ")).when(k % 3 == 1, lit("b", "", "a")).otherwise(lit(" a", "a"))
    codes = F.when(k % 3 == 0, lit("no_independent_engine_agreement", "x", "no_independent_engine_agreement")).otherwise(lit("x"))
    return table(spark, d, "orders").select(k.alias("id"), F.array_join(text.first_reasons(r), ";").alias("reasons"), F.array_join(review.friendly_reasons(codes), ";").alias("friendly"))


@query()
def protected_spans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.explode(spans.spans(F.col("text"))).alias("s"))
    return s.select("doc_id", "s.start", "s.end", "s.kind", "s.text")


@query("SELECT doc_id, text AS restored FROM documents")
def protected_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select("doc_id", "text", spans.masked(F.col("text")).alias("m"))
    return m.select("doc_id", "m.restored")


@query()
def conservative_proposals(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", spans.proposal(F.col("text"), F.regexp_replace("text", "0", "1"), F.lit(0.9)).alias("p"))
    return p.select("doc_id", "p.safe", "p.changed", "p.confidence", F.array_join("p.reasons", ";").alias("reasons"))


@query("SELECT conv_id, turn, upper(text) AS cased FROM conversations WHERE regexp_matches(text, '^[\\x00-\\x7F]*[A-Za-z][\\x00-\\x7F]*$')")
def case_transfer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where(F.col("text").rlike(r"^[\x00-\x7F]*[A-Za-z][\x00-\x7F]*$"))
    return c.select("conv_id", "turn", text.case_pattern(F.upper("text"), F.lower("text")).alias("cased"))


@query(fold_sql.SAFE_NAMES)
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


# --- tiles and seams -----------------------------------------------------------------------------------------------------------------


TILE = """p AS (SELECT p_partkey AS id, p_size * 61 AS len FROM part), n AS (SELECT *, ceil((len - 512) / 384.0)::BIGINT AS n FROM p), s AS (SELECT id, len, 0 AS i, 0 AS start FROM n WHERE len <= 512 UNION ALL SELECT id, len, i, round_even(i * (len - 512) / n::DOUBLE, 0)::BIGINT FROM n, range(0, 20) t(i) WHERE len > 512 AND i <= n)"""


@query(f"WITH {TILE} SELECT id, i, start, coalesce(greatest(0, lag(start) OVER w + 512 - start), 0) AS \"left\", coalesce(greatest(0, start + 512 - lead(start) OVER w), 0) AS \"right\" FROM s WINDOW w AS (PARTITION BY id ORDER BY i)")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 61).alias("len"))
    return tiles.tile_rows(p, ["id"], F.col("len"), F.lit(512), F.lit(128)).withColumn("i", F.col("i").cast("long"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size * 61 AS len FROM part), c AS (SELECT *, least(8, greatest(2, ceil(len / 384.0)))::BIGINT AS n FROM p) SELECT id, 0::BIGINT AS origin FROM c WHERE len <= 384 UNION SELECT id, round_even(i * (len - 384) / (n - 1)::DOUBLE, 0)::BIGINT FROM c, range(0, 8) t(i) WHERE len > 384 AND i < n""")
def crop_grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(tiles.crop_origins(F.col("p_size") * 61, F.lit(384), 8)).alias("origin"))


@query("""WITH i AS (SELECT user_id AS k, floor(value)::BIGINT AS lo, floor(value)::BIGINT + 20 AS hi FROM events), b AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i) SELECT k, sum(greatest(0, hi - greatest(lo, coalesce(before, lo))))::BIGINT AS covered FROM b GROUP BY k""")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    lo = F.floor("value")
    i = table(spark, d, "events").select(F.col("user_id").alias("k"), lo.alias("lo"), (lo + 20).alias("hi"))
    return tiles.covered(i, ["k"], "lo", "hi").withColumn("covered", F.col("covered").cast("long"))


@query("SELECT p_partkey AS id, i, round_even(i * p_size / 4.0, 0)::BIGINT AS start, round_even((i + 1) * p_size / 4.0, 0)::BIGINT AS \"end\" FROM part, range(0, 4) t(i)")
def grid_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(tiles.grid_bounds(F.col("p_size"))).alias("i", "b"))
    return b.select("id", F.col("i").cast("long").alias("i"), "b.start", "b.end")


@query(f"WITH {TILE}, m AS (SELECT id, len, round_even((start + 512 + lead(start) OVER (PARTITION BY id ORDER BY i)) / 2.0 * 2.5, 0)::BIGINT AS seam FROM s) SELECT id, seam FROM m WHERE seam >= 1 AND seam < len * 2.5")
def seam_positions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 61).alias("len"))
    t = tiles.tile_rows(p.select("id", "len"), ["id", "len"], F.col("len"), F.lit(512), F.lit(128))
    return tiles.seams(t, ["id", "len"], "start", F.lit(512), 2.5, F.col("len") * 2.5).select("id", "seam")


STEPS = "s AS (SELECT a.image, a.x AS p, avg(abs(a.v - b.v)) AS step FROM raster a JOIN raster b ON a.image = b.image AND a.y = b.y AND a.x = b.x + 1 GROUP BY ALL)"


@query(f"""WITH {RASTER}, {STEPS}, q AS (SELECT DISTINCT image, 4 AS seam FROM raster), n AS (SELECT q.image, median(step) AS near FROM q JOIN s ON s.image = q.image AND s.p IN (q.seam - 2, q.seam - 1, q.seam + 1, q.seam + 2) GROUP BY 1) SELECT q.image, round(s.step, 6) AS step, round(near, 6) AS near, round(s.step / greatest(1e-9, near), 6) AS ratio FROM q JOIN s ON s.image = q.image AND s.p = 4 JOIN n ON n.image = q.image""")
def seam_probe(spark: SparkSession, d: str) -> DataFrame:
    r = fx.raster(spark, d)
    p = tiles.seam_probe(tiles.boundary_steps(r, ["image"]), r.select("image").distinct().withColumn("seam", F.lit(4)), ["image"], (-2, -1, 1, 2))
    return p.select("image", F.round("step", 6).alias("step"), F.round("near", 6).alias("near"), F.round("ratio", 6).alias("ratio"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size * 16 AS r FROM part WHERE p_size >= 8), c AS (SELECT id, r, unnest([r, 384, 320, 256, 192, 160, 128]) AS v FROM p), t AS (SELECT DISTINCT id, r, v - v % 16 AS tile FROM c) SELECT id, tile, greatest(16, least(round_even(tile * (r // 4) / r::DOUBLE / 16, 0)::BIGINT * 16, tile // 2)) AS overlap FROM t WHERE tile <= r AND tile >= 64""")
def fallback_ladder(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_size >= 8").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 16).alias("r"))
    return p.select("id", F.explode(tiles.ladder(F.col("r"), F.lit(16), F.floor(F.col("r") / 4))).alias("t")).select("id", "t.tile", "t.overlap")


@query("""SELECT p_partkey AS id, CASE WHEN n = 1 THEN 0 WHEN k < n THEN k ELSE 2 * (n - 1) - k END AS source FROM (SELECT p_partkey, p_size % 7 + 1 AS n, p_partkey % greatest(2 * (p_size % 7), 1) AS k FROM part)""")
def reflect_padding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tiles.reflected(F.col("p_partkey"), F.col("p_size") % 7 + 1).cast("long").alias("source"))


@query(f"WITH {RASTER} SELECT image, y, x, v::DOUBLE AS v FROM raster")
def tiled_blend(spark: SparkSession, d: str) -> DataFrame:
    r = fx.raster(spark, d)
    t = r.select("image", "y", "x", "v", F.explode(F.array(F.lit(0), F.lit(3))).alias("tx")).where((F.col("x") >= F.col("tx")) & (F.col("x") < F.col("tx") + 5))
    t = t.select("*", F.lit(0).alias("ty"), F.lit(5).alias("tile_w"), F.lit(8).alias("tile_h"), F.when(F.col("tx") == 3, 2).otherwise(0).alias("left"), F.when(F.col("tx") == 0, 2).otherwise(0).alias("right"), F.lit(0).alias("top"), F.lit(0).alias("bottom"))
    return tiles.blended(t, ["image"]).select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("v", 6).alias("v"))


# --- folds ---------------------------------------------------------------------------------------------------------------------------


@query(fold_sql.NMS)
def nms_dedup(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d).select("image", F.col("id").alias("raw_id"), F.lit(1).alias("component_id"), "x0", "y0", "x1", "y1", F.col("price").alias("score"))
    return folds.component_nms(b, ["image"])


@query(fold_sql.DETECTIONS)
def detection_dedup(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d).select("image", "id", "x0", "y0", "x1", "y1", F.col("price").alias("score"), (F.col("size") % 3).cast("string").alias("label"))
    return folds.detections(b, ["image"], "id")


@query(fold_sql.DRAFTS)
def draft_dedup(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d).select("image", "id", "x0", "y0", "x1", "y1", F.col("price").alias("quality"), F.col("id").cast("string").alias("text"), F.col("size").alias("area"))
    return folds.mask_near_duplicates(folds.text_draft_nms(b, ["image"]), ["image"], "id")


@query(fold_sql.LAYERS)
def layer_suppression(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d).select("image", "id", "x0", "y0", "x1", "y1", (F.col("price") / 2000).alias("score"), F.when(F.col("size") % 4 == 0, "text_raster").when(F.col("size") % 4 == 1, "object").otherwise("detail_group").alias("category"))
    return folds.layer_suppression(b, ["image"], "id")


@query(fold_sql.READINGS_SQL)
def ocr_cluster(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d).select("image", F.col("id").alias("reading"), "x0", "y0", "x1", "y1")
    return folds.reading_clusters(b, ["image"])


@query(fold_sql.SYMMETRIC)
def symmetric_merge(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d).select("image", "id", "x0", "y0", "x1", "y1", F.when(F.col("size") % 5 == 0, "standalone_row").otherwise("standalone_object").alias("role"), F.lit(120).alias("width"), F.lit(106).alias("height"))
    return folds.symmetric_pairs(b, ["image"], "id")


@query(fold_sql.OBJECTS)
def object_assignment(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.spatial import overlap_join

    b = fx.boxes(spark, d)
    j = overlap_join(b.where("id % 4 = 0"), b.where("id % 4 <> 0"), ["image"])
    p = j.select("image", F.col("a_id").alias("detection"), F.col("b_id").alias("candidate"), g.match_score(g.intersection(g.box("a_"), g.box("b_")), g.area(g.box("b_")), g.area(g.box("a_"))).alias("match"), *[F.col(f"b_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return folds.assign_objects(p, ["image"])


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, len(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), r AS (SELECT conv_id, i, turn, 0 AS context, 1 AS k, n AS size FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.i, o.turn, CASE WHEN r.k >= 8 OR r.size + o.n + 1 > 190 THEN r.context + 1 ELSE r.context END, CASE WHEN r.k >= 8 OR r.size + o.n + 1 > 190 THEN 1 ELSE r.k + 1 END, CASE WHEN r.k >= 8 OR r.size + o.n + 1 > 190 THEN o.n + 1 ELSE r.size + o.n + 1 END FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1) SELECT conv_id, turn, context FROM r""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return folds.context_groups(table(spark, d, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "context")


@query(fold_sql.NAMES)
def collision_names(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.stats import duplicate_stems

    k = F.col("page_id")
    f = table(spark, d, "pages").select(F.lit("in").alias("parent"), F.concat(F.lit("Scan"), (k % 40).cast("string")).alias("stem"), F.when(k % 3 == 0, ".PNG").when(k % 3 == 1, ".jpg").otherwise(".png").alias("suffix"), k)
    f = f.withColumn("relative", F.concat(F.lit("in/"), "stem", F.lit("."), k.cast("string"), "suffix"))
    return folds.output_names(duplicate_stems(f, "parent", "stem"), ["parent"]).select("relative", "stem_out")


@query(fold_sql.EVICTIONS)
def budget_evictions(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d).select("image", "id", "x0", "y0", "x1", "y1", F.when(F.col("id") % 10 < 4, "draft").otherwise("layer").alias("kind"), (F.col("size") % 2 == 0).alias("optional"), (F.col("size") % 3 > 0).alias("leaf"), (F.col("size") % 5 == 0).alias("decoration"), F.col("price").alias("salience"), (F.col("price") / 2000).alias("quality"))
    return folds.evictions(b, ["image"], 60).select("image", "id", "action")


# --- rasters -------------------------------------------------------------------------------------------------------------------------


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as one row a raster: vec_id, label, pixels (64 values)."""
    e = F.transform("embedding", lambda x: F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x.cast("double") + 1) / 2)) * 255).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", "label", e.alias("pixels"))


def _square(row: dict) -> np.ndarray:
    return raster.decoded(8, 8, np.asarray(row["pixels"]))


@query()
def raster_metrics(spark: SparkSession, d: str) -> DataFrame:
    def one(row: dict) -> dict:
        return {"vec_id": row["vec_id"], **{k: round(v, 8) for k, v in raster.metrics(_square(row)).items()}, "photographic": raster.photographic(_square(row))}

    return raster.per_image(_images(spark, d), ["vec_id", "pixels"], "vec_id long, sharpness double, noise double, halo double, clipped double, dynamic_range double, photographic double", one)


@query(f"""WITH {RASTER}, k AS (SELECT o, (o + d + 14) % 14 AS p, exp(-0.5 * d * d) AS w FROM range(8) a(o), range(-3, 4) b(d)), m AS (SELECT o, CASE WHEN p < 8 THEN p ELSE 14 - p END AS i, w / sum(w) OVER (PARTITION BY o) AS w FROM k), h AS (SELECT image, y, o AS x, sum(w * v) AS b FROM raster JOIN m ON i = x GROUP BY image, y, o),
u AS (SELECT image, o AS y, h.x, sum(w * b) AS b FROM h JOIN m ON i = h.y GROUP BY image, o, h.x) SELECT image AS vec_id, sum(greatest(0, least(255, round_even(v + 0.1::DOUBLE * (v - b), 0)::BIGINT)))::BIGINT AS total, true AS stripes_agree FROM raster JOIN u USING (image, y, x) GROUP BY image""")
def usm_stencil(spark: SparkSession, d: str) -> DataFrame:
    def one(row: dict) -> dict:
        a = _square(row)
        whole = raster.unsharp(a, a, 0.0, 0.1, 1.0, 1.0)
        return {"vec_id": row["vec_id"], "total": int(whole[..., 0].sum()), "stripes_agree": bool((raster.unsharp_stripes(a, a, 0.0, 0.1, 1.0, 3) == whole).all())}

    return raster.per_image(_images(spark, d), ["vec_id", "pixels"], "vec_id long, total long, stripes_agree boolean", one)


def _twice(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    i = _images(spark, d)
    return i.withColumn("other", F.coalesce(F.lead("pixels").over(w), "pixels"))


@query()
def restoration_compare(spark: SparkSession, d: str) -> DataFrame:
    def one(row: dict) -> dict:
        a, b = _square(row), raster.decoded(8, 8, np.asarray(row["other"]))
        m = raster.restoration_metrics(a, b)
        gate = raster.restoration_gate(m)
        c = raster.comparison(a, b)
        return {"vec_id": row["vec_id"], "ssim": round(m["ssim_mean"], 6), "edge_f1": round(m["edge_f1"], 6), "acutance_ratio": round(m["acutance_ratio"], 6), "mean_delta": round(c["mean_delta"], 8), "lost": ";".join(gate["lost"]), "passed": bool(gate["passed"])}

    return raster.per_image(_twice(spark, d), ["vec_id", "pixels", "other"], "vec_id long, ssim double, edge_f1 double, acutance_ratio double, mean_delta double, lost string, passed boolean", one)


@query()
def guarded_stages(spark: SparkSession, d: str) -> DataFrame:
    def one(row: dict) -> list[dict]:
        _, reports = raster.restored(_square(row), [("deblur", raster.deblurred), ("detail", raster.detailed)])
        return [{"vec_id": row["vec_id"], "stage": r["stage"], "accepted": r["accepted"], "reasons": ";".join(r["reasons"])} for r in reports]

    return raster.per_image(_images(spark, d), ["vec_id", "pixels"], "vec_id long, stage string, accepted boolean, reasons string", one)


@query()
def band_fusion(spark: SparkSession, d: str) -> DataFrame:
    def one(row: dict) -> dict:
        a, b = _square(row), raster.decoded(8, 8, np.asarray(row["other"]))
        return {"vec_id": row["vec_id"], "total": int(raster.fused(a, b, a).sum()), "spatial_ok": bool(raster.spatial_coverage(a, a, b)["passed"])}

    return raster.per_image(_twice(spark, d), ["vec_id", "pixels", "other"], "vec_id long, total long, spatial_ok boolean", one)


@query()
def mask_topology(spark: SparkSession, d: str) -> DataFrame:
    def one(row: dict) -> dict:
        m = np.asarray(row["pixels"]).reshape(8, 8) >= 128
        n = np.asarray(row["other"]).reshape(8, 8) >= 128
        t = stencils.topology(m, 2)
        return {"vec_id": row["vec_id"], **t, "kept": not any(stencils.correspondence(m, n).values()), "cleaned": int(stencils.cleanup(m, 3).sum())}

    return raster.per_image(_twice(spark, d), ["vec_id", "pixels", "other"], "vec_id long, pixels long, components long, micro long, holes long, kept boolean, cleaned long", one)


@query()
def alpha_pipeline(spark: SparkSession, d: str) -> DataFrame:
    def one(row: dict) -> dict:
        v = np.asarray(row["pixels"]).reshape(8, 8)
        m = v >= 110
        a, report = stencils.constrained_alpha(v / 255.0, m)
        soft = stencils.soft_alpha(m)
        base = np.repeat(v[..., None], 3, axis=2).astype(np.uint8)
        out = stencils.feathered(base, 255 - base, m, 2.0)
        return {"vec_id": row["vec_id"], **{k: int(x) for k, x in report.items()}, "alpha": round(float(a.sum()), 6), "soft": round(float(soft.sum()), 6), "untouched": bool((out[~m] == base[~m]).all())}

    return raster.per_image(_images(spark, d), ["vec_id", "pixels"], "vec_id long, at_25 long, at_50 long, at_75 long, outside long, weak_cores long, empty long, alpha double, soft double, untouched boolean", one)


@query(f"WITH {RASTER} SELECT image AS vec_id, sum(3 * v)::BIGINT AS total, sum((y * 8 + x + 1) * v)::BIGINT AS placed FROM raster GROUP BY image")
def stack_planning(spark: SparkSession, d: str) -> DataFrame:
    def one(row: dict) -> dict:
        a, b = _square(row), raster.decoded(8, 8, np.asarray(row["other"]))
        alphas = [a[..., 0], b[..., 0]]
        back, targets = raster.planned_stack(a, b, alphas)
        shown = raster.rendered_stack(back, targets, alphas).astype(np.int64)
        return {"vec_id": row["vec_id"], "total": int(shown.sum()), "placed": int((shown[..., 1].ravel() * np.arange(1, 65)).sum())}

    return raster.per_image(_twice(spark, d), ["vec_id", "pixels", "other"], "vec_id long, total long, placed long", one)


@query()
def surface_fit(spark: SparkSession, d: str) -> DataFrame:
    def one(row: dict) -> dict:
        v = np.asarray(row["pixels"], float).reshape(8, 8)
        ys, xs = np.mgrid[0:8, 0:8]
        s = raster.surface(xs.ravel(), ys.ravel(), np.repeat(v.reshape(-1, 1), 3, axis=1), 8, 8)
        c = raster.robust_fit(np.column_stack([np.ones(64), xs.ravel() / 8, ys.ravel() / 8]), v.reshape(-1, 1) / 255)
        pick = raster.dominant_cluster(np.repeat(v.reshape(-1, 1), 3, axis=1))
        return {"vec_id": row["vec_id"], "surface": s["name"], "mae": None if s["mae"] is None else round(s["mae"], 5), "slope_x": round(float(c[1, 0]), 6), "cluster": int(pick.sum()), "chosen": raster.chosen_surface([("constant", 2.0, 3.0), ("affine", 1.5, 2.5), ("quadratic", 1.49, 2.49)])}

    return raster.per_image(_images(spark, d), ["vec_id", "pixels"], "vec_id long, surface string, mae double, slope_x double, cluster long, chosen string", one)


@query()
def edit_gates(spark: SparkSession, d: str) -> DataFrame:
    def one(row: dict) -> dict:
        a = _square(row)
        roi = np.zeros((8, 8), bool)
        roi[2:6, 2:6] = True
        b = a.copy()
        b[roi] = 128
        old = roi & (a[..., 0] > 128)
        r = raster.edit_checks(a, b, roi, old, np.zeros((8, 8), bool), stencils.boundary(roi))
        m, q = raster.text_mask(np.repeat(np.repeat(a, 4, 0), 4, 1), (8, 8, 24, 20))
        return {"vec_id": row["vec_id"], "outside_ok": bool(r["outside_ok"]), "ghost_ratio": round(r["ghost_ratio"], 6), "seam_p95": round(r["seam_p95"], 6), "passed": bool(r["passed"]), "text_pixels": int(m.sum()), "text_quality": round(float(q), 6)}

    return raster.per_image(_images(spark, d), ["vec_id", "pixels"], "vec_id long, outside_ok boolean, ghost_ratio double, seam_p95 double, passed boolean, text_pixels long, text_quality double", one)


@query(f"WITH {RASTER} SELECT image AS vec_id, 4 * (max(x) + 1) AS width, sum(3 * 16 * v)::BIGINT AS total, max(v) AS brightest, NULL::VARCHAR AS error FROM raster GROUP BY image")
def model_contract(spark: SparkSession, d: str) -> DataFrame:
    def one(model: models.Nearest, row: dict) -> dict:
        out, _ = models.with_fallback(model, _square(row))
        return {"width": out.shape[1], "total": int(out.astype(np.int64).sum()), "brightest": int(out.max())}

    return models.infer(_images(spark, d).select("vec_id", "pixels"), lambda: models.Nearest(memory=256), one, "vec_id long, width long, total long, brightest long, error string")


# --- sources, sinks, streams ---------------------------------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN true ELSE false END AS image FROM pages")
def image_discovery(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    f = table(spark, d, "pages").select(k, F.concat(F.lit("in/"), k.cast("string"), F.when(k % 4 == 0, ".PNG").when(k % 4 == 1, ".jpeg").when(k % 4 == 2, ".txt").otherwise("")).alias("path"))
    return f.join(readers.listed(f, "path").select(k, F.lit(True).alias("image")), "page_id", "left").select(k, F.coalesce("image", F.lit(False)).alias("image"))


@query("SELECT event_id, event_id % 4 <> 0 AS ok, CASE WHEN event_id % 4 <> 0 THEN (props::JSON ->> 'k')::BIGINT END AS k FROM events")
def json_line_reader(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 3)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("\ufeff"), "props")).otherwise(F.col("props"))
    r = readers.json_lines(e.select("event_id", line.alias("value")).withColumn("value", F.concat("value", F.lit(" "))), "k LONG")
    rows = e.select("event_id", F.regexp_replace(F.concat(line, F.lit(" ")), "^\\uFEFF+", "").alias("line"))
    return rows.join(r.select("line", "ok", F.col("request.k").alias("k")).distinct(), "line").select("event_id", "ok", "k")


@query("""WITH l AS (SELECT p_partkey AS id, sha256(p_partkey::VARCHAR) AS h FROM part) SELECT id, h AS sha256 FROM l WHERE id % 3 <> 0""")
def hash_manifest_reader(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    lines_ = table(spark, d, "part").select(F.when(k % 3 == 0, F.lit("# note")).otherwise(F.concat(F.upper(F.sha2(k.cast("string"), 256)), F.lit("  m\\"), k.cast("string"))).alias("value"))
    entries, _ = readers.hash_manifest(lines_)
    return entries.select(F.regexp_extract("path", "m/([0-9]+)", 1).cast("long").alias("id"), "sha256")


@query("SELECT 'a-b-' || (p_partkey % 50)::VARCHAR AS package, min(p_size)::VARCHAR || '.0' AS version FROM part GROUP BY 1")
def requirement_pins(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("k")).agg(F.min("p_size").alias("v"))
    pins, _ = readers.pinned(p.select(F.concat(F.lit("A_.b-"), F.col("k").cast("string"), F.lit("=="), F.col("v").cast("string"), F.lit(".0")).alias("value")))
    return pins


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 2 = 0 THEN 'drop_backup_and_journal' WHEN o_orderkey % 2 = 0 THEN 'drop_journal' WHEN o_custkey % 2 = 0 THEN 'restore_backup' WHEN o_orderkey % 3 = 0 THEN 'drop_journal' ELSE 'error_ambiguous' END AS action FROM orders")
def publish_recovery(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(k.alias("id"), writers.recovery(k % 2 == 0, c % 2 == 0, F.when(k % 3 == 0, "prepared").otherwise("old_moved")).alias("action"))


@query("""SELECT page_id, 2 AS paths, 5 AS commands, 2 AS fills, (page_id % 2)::INT AS images FROM pages""")
def svg_statistics(spark: SparkSession, d: str) -> DataFrame:
    svg = F.concat(F.lit('<svg><path fill="red" d="M0 0 L1 1 Z"/><path fill="blue" d="M0 0 h3"/>'), F.when(F.col("page_id") % 2 == 1, '<image href="x"/>').otherwise(""), F.lit("</svg>"))
    return writers.svg_statistics(table(spark, d, "pages").select("page_id", svg.alias("svg")), "svg", ["page_id"]).select("page_id", "paths", "commands", "fills", "images")


@query(f"WITH {BOXES} SELECT id, lpad((id % 100)::VARCHAR, 2, '0') || '_Layer_' || size::VARCHAR || '.png' AS file, x0 AS \"left\", y1 - y0 AS height FROM boxes")
def layer_records(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d).select("image", "id", (F.col("id") % 100).alias("z"), F.concat(F.lit("Layer "), F.col("size").cast("string")).alias("name"), "x0", "y0", "x1", "y1")
    return writers.layer_records(b, "image").select("id", "file", "left", "height")


@query()
def review_updates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    t = table(spark, d, "labels").select(k.cast("string").alias("region"), F.lit("pending").alias("action"), F.lit("").alias("approved_text"), (k % 3).alias("version"))
    dec = table(spark, d, "labels").where("doc_id % 2 = 0").select(k.cast("string").alias("region"), F.lit(1).cast("long").alias("expected_version"), F.when(k % 4 == 0, "replace").otherwise("keep").alias("action"), F.lit(" new ").alias("approved_text"))
    updated, rejected = review.apply_decisions(t, dec, "region")
    return review.keep_pending(updated).join(rejected, "region", "left").select("region", "action", "approved_text", "version", "why")


@query()
def line_service(spark: SparkSession, d: str) -> DataFrame:
    """The stream's responses; a test holds them against the batch's."""

    c = table(spark, d, "conversations").select(F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("propose").alias("op"), "text")).alias("value"))
    made = lines.responses(c)
    return made.select(F.get_json_object("response", "$.id").alias("id"), F.get_json_object("response", "$.ok").alias("ok"), F.get_json_object("response", "$.proposal.safe").alias("safe"))
