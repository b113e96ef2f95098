"""Queries over drafts, rows, styles and job options."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text
from ..operators import drafts, graph, raster, stencils
from . import fixtures as fx
from . import resources
from .catalogue import ROW, query
from .catalogue_scalars import _images, _square
from .fixtures import BOXES, RASTER, table


@query(f"""WITH {BOXES}, p AS (SELECT *, (x1 - x0) * (y1 - y0) - size AS area, x1 - x0 AS w, y1 - y0 AS h FROM boxes) SELECT id, area / 1200.0 >= 0.035 AND (area / 1200.0 >= 0.075 OR w / greatest(1, h)::DOUBLE >= 3.0) AND area / greatest(1, w * h)::DOUBLE >= 0.55 AS owner,
area / 1200.0 >= 0.0025 AND w / greatest(1, h)::DOUBLE BETWEEN 0.25 AND 3.8 AND least(w, h) >= 0.048 * 106 AND price % 60 >= 18 AS child FROM p""")
def panel_drafts(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    area = w * h - F.col("size")
    return fx.boxes(spark, d).select("id", drafts.owner_panel(area, F.lit(1200.0), w, h).alias("owner"), drafts.child_object(area, F.lit(1200.0), w, h, F.col("price") % 60, F.lit(106.0)).alias("child"))


@query(f"""WITH {BOXES}, p AS (SELECT *, image * 10 + size % 5 AS raw_id, (x1 - x0) * (y1 - y0) AS area FROM boxes) SELECT a.image, a.id AS bar, b.id AS sibling FROM p a JOIN p b ON a.image = b.image AND a.raw_id = b.raw_id AND a.id <> b.id WHERE a.x1 - a.x0 >= 2 * (a.y1 - a.y0) AND greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0))::DOUBLE >= 0.72 AND b.area / 12000.0 >= 0.003 AND greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) <= 0.18 * 120""")
def bar_siblings(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    p = fx.boxes(spark, d).withColumn("raw_id", F.col("image") * 10 + F.col("size") % 5).withColumn("area", w * h).withColumn("is_bar", w >= 2 * h)
    return drafts.bar_siblings(p, ["image"], "id", F.lit(12000.0), F.lit(120.0))


@query(f"""WITH {BOXES}, p AS (SELECT id, x1 - x0 AS w, y1 - y0 AS h, (size % 11) * 10.0 AS conf, (size % 7) / 7.0 AS best, (id % 13) / 13.0 AS occ, (size % 9) / 60.0 AS sup, (id % 5) / 5.0 AS span FROM boxes) SELECT id, CASE WHEN id % 17 = 0 THEN 'non_alphanumeric_text' WHEN id % 19 = 0 THEN 'invalid_confidence' WHEN w < 3 OR h < 3 THEN 'tiny_box' WHEN NOT (w * h / 12000.0 BETWEEN 0.00008 AND 0.38) THEN 'implausible_box_area' WHEN best < 0.43 THEN 'no_sam_support' WHEN NOT (occ BETWEEN 0.015 AND 0.85) THEN 'implausible_text_occupancy'
WHEN sup < 0.015 THEN 'weak_sam_support' WHEN conf < 35 AND (sup < 0.10 OR occ < 0.025 OR span < 0.28) THEN 'low_confidence_weak_geometry' WHEN (w / greatest(1, h)::DOUBLE > 14 OR w / 120.0 > 0.85 OR w * h / 12000.0 > 0.2) AND (sup < 0.06 OR span < 0.55) THEN 'wide_box_weak_geometry' END AS reason, round(best * 0.58 + least(1.0, conf / 100.0) * 0.27 + least(1.0, sup) * 0.15, 6) AS quality FROM p""")
def text_draft_gates(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("id"), F.col("size")
    conf, best, occ, sup, span = (s % 11) * 10.0, (s % 7) / 7.0, (k % 13) / 13.0, (s % 9) / 60.0, (k % 5) / 5.0
    why = drafts.text_rejection(F.when(k % 17 == 0, "--").otherwise("word"), F.when(k % 19 == 0, -1.0).otherwise(conf), g.box(), F.lit(12000.0), best, occ, sup, span, F.lit(120))
    return fx.boxes(spark, d).select("id", why.alias("reason"), F.round(drafts.text_quality(best, conf, sup), 6).alias("quality"))


STAT = "s AS (SELECT image, size % 6 AS row, count(*) AS n, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h, median(y1 - y0) AS mh, min(y1 - y0) / greatest(1, max(y1 - y0))::DOUBLE AS hr, stddev_pop(y1) / greatest(1.0, median(y1 - y0)) AS spread, sum(x1 - x0) / greatest(1, max(x1) - min(x0))::DOUBLE AS cov FROM boxes GROUP BY ALL)"


@query(f"""WITH {BOXES}, {STAT} SELECT image, row, n, round(spread, 9) AS baseline_spread, CASE WHEN n < 3 THEN 'too_few_components' WHEN w / greatest(1, h)::DOUBLE < 1.65 OR w / 200.0 < 0.11 OR h / 150.0 > 0.40 OR mh < greatest(4.0, 150 * 0.035) OR hr < 0.52 THEN 'implausible_row_geometry' WHEN spread > 0.28 THEN 'unstable_baseline' WHEN NOT (cov BETWEEN 0.28 AND 1.35) THEN 'implausible_horizontal_coverage' WHEN n < 9 THEN 'low_local_contrast' END AS reason FROM s""")
def visual_row_gates(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d).withColumn("row", F.col("size") % 6).withColumn("score", F.lit(0.9))
    s = drafts.row_statistics(b, ["image", "row"])
    why = drafts.visual_rejection(F.col("n"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(200.0), F.lit(150.0), F.col("median_h"), F.col("height_ratio"), F.col("baseline_spread"), F.col("coverage"), F.lit(0.5), F.lit(99), F.when(F.col("n") < 9, 3.0).otherwise(50.0))
    return s.select("image", "row", "n", F.round("baseline_spread", 9).alias("baseline_spread"), why.alias("reason"))


@query(f"""WITH {RASTER}, dr AS (SELECT image, y, x, v // 86 AS draft FROM raster), pr AS (SELECT image, y, x FROM raster WHERE x >= 4 AND image % 3 = 0), b AS (SELECT image, draft, count(*) AS before FROM dr GROUP BY ALL), a AS (SELECT dr.image, draft, count(*) AS after FROM dr WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.image = dr.image AND pr.y = dr.y AND pr.x = dr.x) GROUP BY ALL)
SELECT b.image, b.draft, round(1 - coalesce(after, 0) / before::DOUBLE, 9) AS removed, CASE WHEN coalesce(after, 0) / before::DOUBLE < 0.12 THEN 'protected_overlap_left_weak_text' END AS reason FROM b LEFT JOIN a ON a.image = b.image AND a.draft = b.draft""")
def protected_subtraction(spark: SparkSession, d: str) -> DataFrame:
    r = fx.raster(spark, d)
    px = r.select("image", "y", "x", F.floor(F.col("v") / 86).alias("draft"))
    _, fate = drafts.without_protected(px, r.where("x >= 4 and image % 3 = 0"), ["image"])
    return fate.select("image", "draft", F.round("removed", 9).alias("removed"), "reason")


@query(f"""WITH RECURSIVE {BOXES}, e AS (SELECT a.id AS u, b.id AS v FROM boxes a JOIN boxes b ON a.image = b.image AND a.id <> b.id WHERE {ROW}), r AS (SELECT id AS n, id AS l FROM boxes UNION SELECT e.v, r.l FROM r JOIN e ON r.n = e.u), g AS (SELECT n AS id, min(l) AS component FROM r GROUP BY n),
p AS (SELECT image, id, component, x0, y0, x1, y1, median(x1 - x0) OVER w AS m, count(*) OVER w AS n FROM boxes JOIN g USING (id) WINDOW w AS (PARTITION BY component)), q AS (SELECT *, n >= 4 AND x1 - x0 > 1.9 * m AND (x1 - x0) / greatest(1, y1 - y0)::DOUBLE > 1.40 AS wide FROM p), t AS (SELECT *, count(*) FILTER (NOT wide) OVER (PARTITION BY component) AS slim FROM q),
k AS (SELECT *, count(*) OVER w AS parts, (max(x1) OVER w - min(x0) OVER w) / greatest(1, max(y1) OVER w - min(y0) OVER w)::DOUBLE AS shape FROM t WHERE NOT wide OR slim < 2 WINDOW w AS (PARTITION BY component)) SELECT image, id, component FROM k WHERE parts >= 3 OR (parts = 2 AND shape >= 1.05)""")
def text_rows(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    edges = drafts.row_edges(b, ["image"], "id", F.abs(F.col("a_size") - F.col("b_size")))
    rows = b.join(graph.components(b.select("id"), edges, "id").hint("merge"), "id")
    return drafts.trimmed_rows(rows, ["component"]).select("image", "id", "component")


@query("""SELECT n_nationkey AS id, n_name AS text, 'NFC' AS form, round(list_count(list_filter(list_distinct(string_split(replace(n_name, ' ', ''), '')), lambda c: c BETWEEN 'A' AND 'P')) / list_count(list_distinct(string_split(replace(n_name, ' ', ''), '')))::DOUBLE, 9) AS coverage FROM nation""")
def font_coverage(spark: SparkSession, d: str) -> DataFrame:
    points = F.array(*[F.lit(i) for i in range(65, 81)])
    f = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), text.for_font(F.col("n_name"), points).alias("f"))
    return f.select("id", "f.text", "f.form", F.round("f.coverage", 9).alias("coverage"))


@query("SELECT page_id, 2 * (page_id % 5) + 1 AS operators FROM pages")
def path_operator_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.path_operators(F.concat(F.repeat(F.lit("0 0 m 1 1 l\n"), (F.col("page_id") % 5).cast("int")), F.repeat(F.lit("f "), F.length("url") % 3), F.lit("2 2 re m2 x"), F.col("page_id").cast("string"))).cast("long").alias("operators"))


@query("""WITH j AS (SELECT o_orderkey AS id, ['fast', 'repair', 'layers', 'zoom'][o_orderkey % 4 + 1] AS mode, (o_custkey % 23) / 2.0 AS scale, CASE WHEN o_orderkey % 3 = 0 THEN 30 + o_custkey % 40 END AS layers FROM orders) SELECT id, array_to_string(list_filter([CASE WHEN mode = 'zoom' THEN 'mode' END, CASE WHEN mode = 'zoom' OR NOT (scale BETWEEN CASE WHEN mode = 'fast' THEN 2 ELSE 1 END AND 20) OR (mode = 'repair' AND scale > 1 AND scale < 2) THEN 'scale' END, CASE WHEN layers > 60 THEN 'max_layers' END, CASE WHEN layers IS NOT NULL AND mode <> 'layers' THEN 'max_layers_not_for_mode' END], lambda x: x IS NOT NULL), ';') AS errors FROM j""")
def job_options(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    half = (c % 23) / 2.0
    jobs = table(spark, d, "orders").select(k.alias("id"), F.get(F.array(*[F.lit(m) for m in ("fast", "repair", "layers", "zoom")]), (k % 4).cast("int")).alias("mode"), F.regexp_replace(half.cast("string"), r"\.", ",").alias("scale"), F.when(k % 3 == 0, (30 + c % 40).cast("string")).alias("max_layers"))
    return jobs.select("id", F.array_join(resources.job_errors(jobs), ";").alias("errors"))


@query()
def ink_styles(spark: SparkSession, d: str) -> DataFrame:
    def one(row: dict) -> dict:
        a = _square(row)
        m = a[..., 0] >= 110
        style = raster.text_style(a, m) if m.any() else {"fill": (0, 0, 0), "stroke": None, "confidence": 0.0}
        support = stencils.dilate(m, 1)
        report = stencils.matte_report(a[..., 0] * m, a[..., 0], support)
        lone = stencils.promoted_singletons(a[..., 0] * m, a[..., 0] / 512.0, m, a.astype(float), most=9)
        return {"vec_id": row["vec_id"], "fill": style["fill"][0], "outlined": style["stroke"] is not None, "confidence": round(style["confidence"], 6), "outside": report["outside"], "topology": bool(report["topology"]), "lone": len(lone)}

    return raster.per_image(_images(spark, d), ["vec_id", "pixels"], "vec_id long, fill int, outlined boolean, confidence double, outside long, topology boolean, lone int", one)
