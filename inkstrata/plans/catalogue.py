"""Queries over the driver's tables, one or more an operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import hashing, numeric, text
from ..operators import budget, graph, manifest, review, spatial, stats, tiles, votes
from . import fixtures as fx
from . import fold_sql, resources
from .fixtures import A, B, BOXES, COMMON, FOREST, IOU, PAIRS, RASTER, READINGS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- recognition ---------------------------------------------------------------------------------------------------------------------


VOTE_SQL = f"""WITH {READINGS}, e AS (SELECT cluster, text, engine, sum(greatest(0.05, confidence) * CASE WHEN engine LIKE 'paddle%' THEN 1.0 ELSE 0.82 END) AS votes, max(confidence) AS best FROM readings GROUP BY ALL),
t AS (SELECT cluster, text, round(sum(votes), 9) AS votes, count(*) AS engines, max(best) AS strongest, max(best) FILTER (engine LIKE 'paddle%') AS paddle, max(best) FILTER (engine LIKE 'tess%') AS tesseract FROM e GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY votes DESC, engines DESC, text DESC) AS rn FROM t) WHERE rn = 1)"""


@query(VOTE_SQL + " SELECT cluster, text, round(votes, 6) AS votes, engines, round(strongest, 6) AS strongest FROM w")
def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    v = votes.weighted_vote(fx.readings(spark, d))
    return v.select("cluster", "text", F.round("votes", 6).alias("votes"), "engines", F.round("strongest", 6).alias("strongest"))


GATE_SQL = VOTE_SQL + """, s AS (SELECT cluster, text, paddle IS NOT NULL AND tesseract IS NOT NULL AS both_, coalesce(paddle >= 0.84 AND tesseract >= 0.70, false) AS gate, strongest, regexp_matches(text, '(?i)[0-9]|%|\\b(tel|hotline|sku|km)\\b') AS critical FROM w)
SELECT cluster, critical, CASE WHEN strongest < 0.38 THEN 'red' WHEN critical OR NOT gate THEN 'yellow' ELSE 'green' END AS status,
array_to_string(list_filter([CASE WHEN critical THEN 'protected_or_numeric_content_requires_approval' END, CASE WHEN NOT both_ THEN 'no_independent_engine_agreement' WHEN NOT gate THEN 'independent_engine_confidence_below_green_gate' END, CASE WHEN NOT gate THEN 'recognition_confidence_below_green_gate' END, CASE WHEN strongest < 0.38 THEN 'unreadable_text_requires_user_entry' END], lambda x: x IS NOT NULL), ';') AS reasons FROM s"""


@query(GATE_SQL)
def confidence_gates(spark: SparkSession, d: str) -> DataFrame:
    return votes.gated(votes.weighted_vote(fx.readings(spark, d))).select("cluster", "critical", "status", F.array_join("reasons", ";").alias("reasons"))


@query(GATE_SQL.replace("SELECT cluster, critical, CASE", "SELECT count(*) FILTER (status = 'green') AS green_count, count(*) FILTER (status = 'yellow') AS yellow_count, count(*) FILTER (status = 'red') AS red_count FROM (SELECT cluster, critical, CASE") + ")")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return votes.status_counts(votes.gated(votes.weighted_vote(fx.readings(spark, d))).withColumn("k", F.lit(1)), ["k"]).drop("k")


@query("""SELECT l_orderkey AS line, min(l_linenumber * 10) AS x0, min(l_linenumber) AS y0, max(l_linenumber * 10 + 8) AS x1, max(l_linenumber + 5) AS y1, round(greatest(0.0, least(1.0, avg(l_quantity) / 100)), 9) AS confidence,
string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS text FROM lineitem GROUP BY l_orderkey""")
def line_assembly(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("line"), n.alias("ord"), (n * 10).alias("left"), n.alias("top"), F.lit(8).alias("width"), F.lit(5).alias("height"), F.col("l_quantity").alias("conf"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return votes.assemble_lines(words, ["line"]).withColumn("confidence", F.round("confidence", 9))


@query(f"WITH {BOXES} SELECT image, round_even(median(x0), 0)::BIGINT AS x0, round_even(median(y0), 0)::BIGINT AS y0, round_even(median(x1), 0)::BIGINT AS x1, round_even(median(y1), 0)::BIGINT AS y1 FROM boxes GROUP BY image")
def median_box(spark: SparkSession, d: str) -> DataFrame:
    return votes.median_box(fx.boxes(spark, d), ["image"])


@query(f"WITH {BOXES} SELECT image, id, 'text_' || lpad((row_number() OVER (PARTITION BY image ORDER BY y0, x0, id))::VARCHAR, 4, '0') AS region_id FROM boxes")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("image").orderBy("y0", "x0", "id")
    return fx.boxes(spark, d).select("image", "id", F.format_string("text_%04d", F.row_number().over(w)).alias("region_id"))


@query("""WITH t AS (SELECT conv_id, turn, len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ')) AS words, text FROM conversations WHERE trim(text) <> ''), s AS (SELECT conv_id, turn, words, coalesce(sum(words) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first FROM t)
SELECT conv_id, turn, words::BIGINT AS words, first::BIGINT AS first FROM s""")
def word_alignment(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where(F.trim("text") != "")
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")), " "))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("words", words.cast("long")).select("conv_id", "turn", "words", (F.coalesce(F.sum("words").over(w), F.lit(0)) + 1).cast("long").alias("first"))


@query(fold_sql.REALIGNED)
def realigned_proposals(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = c.withColumn("proposed", F.array_join(F.collect_list("text").over(w), " ")).withColumnRenamed("turn", "ord")
    return votes.realigned(whole, ["conv_id"]).select("conv_id", "ord", "aligned", "candidate")


@query("""SELECT o_orderpriority AS k, o_orderkey AS id, CASE WHEN NOT (o_orderstatus <> 'F' AND o_totalprice > 1000) THEN 'FAILED_QA' WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS status FROM orders""")
def stage_status(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(F.col("o_orderpriority").alias("k"), k.alias("id"), votes.stage_status(F.col("o_orderstatus") != "F", F.col("o_totalprice") > 1000, k % 7 == 0, k % 11 == 0, k % 13 == 0).alias("status"))


@query(f"""WITH {BOXES}, t AS (SELECT * FROM boxes WHERE id % 2 = 0), r AS (SELECT * FROM boxes WHERE id % 2 = 1), j AS (SELECT a.image, a.id AS target, a.size % 5 AS want, b.id AS region, b.size % 5 AS got, {IOU} AS iou FROM t a JOIN r b ON a.image = b.image WHERE {COMMON} > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY image, target ORDER BY iou DESC, region) AS rn FROM j WHERE iou >= 0.16) SELECT t.id AS target, coalesce(max(CASE WHEN rn <= 2 AND want = got THEN 1 ELSE 0 END), 0) = 1 AS exact FROM t LEFT JOIN k ON t.id = k.target GROUP BY t.id""")
def ocr_backcheck(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    t, r = b.where("id % 2 = 0"), b.where("id % 2 = 1")
    j = spatial.overlap_join(t, r, ["image"])
    p = j.select(F.col("a_id").alias("target"), F.col("b_id").alias("region"), g.iou(g.box("a_"), g.box("b_")).alias("iou")).where("iou >= 0.16")
    name = lambda c: (F.col(c) % 5).cast("string")
    out = votes.exact_readback(t.select(F.col("id").alias("target"), name("size").alias("text")), r.select(F.col("id").alias("region"), name("size").alias("text")), p)
    return out.select("target", "exact")


# --- statistics ----------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority AS k, round(median(o_totalprice), 4) AS median, round(mad(o_totalprice), 4) AS mad, round(1.4826 * mad(o_totalprice), 4) AS sigma FROM orders GROUP BY 1")
def robust_sigma(spark: SparkSession, d: str) -> DataFrame:
    m = stats.median_mad(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "k"), ["k"], "o_totalprice")
    return m.select("k", *[F.round(c, 4).alias(c) for c in ("median", "mad", "sigma")])


@query("""WITH e AS (SELECT event_type AS k, value AS v FROM events WHERE value > 480), s AS (SELECT n_name AS k FROM nation UNION SELECT DISTINCT event_type FROM events)
SELECT s.k, round(coalesce(avg(v), 0), 6) AS mean, round(coalesce(median(v), 0), 6) AS median, round(coalesce(quantile_cont(v, 0.95), 0), 6) AS p95, round(coalesce(max(v), 0), 6) AS max FROM s LEFT JOIN e USING (k) GROUP BY s.k""")
def statistics_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("k"), F.col("value").alias("v"))
    groups = table(spark, d, "nation").select(F.col("n_name").alias("k")).union(e.select("k")).distinct()
    out = stats.with_defaults(groups, e.where("v > 480"), ["k"], "v")
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "max")])


@query("""WITH q AS (SELECT l_returnflag AS k, quantile_cont(l_extendedprice, 0.1) AS lo, quantile_cont(l_extendedprice, 0.9) AS hi, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k, round(avg(CASE WHEN n < 4 THEN l_extendedprice ELSE least(greatest(l_extendedprice, lo), hi) END), 4) AS winsorized_mean FROM lineitem JOIN q ON l_returnflag = k GROUP BY k""")
def winsorized_mean(spark: SparkSession, d: str) -> DataFrame:
    w = stats.winsorized_mean(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "k"), ["k"], "l_extendedprice")
    return w.select("k", F.round("winsorized_mean", 4).alias("winsorized_mean"))


@query("""WITH q AS (SELECT event_type AS k, quantile_cont(value, 0.95) AS cut FROM events GROUP BY 1) SELECT k, round(avg(value), 6) AS tail_mean, count(*) AS tail_rows FROM events JOIN q ON event_type = k WHERE value >= cut GROUP BY k""")
def top_tail_mean(spark: SparkSession, d: str) -> DataFrame:
    t = stats.tail_mean(table(spark, d, "events").withColumnRenamed("event_type", "k"), ["k"], "value")
    return t.select("k", F.round("tail_mean", 6).alias("tail_mean"), "tail_rows")


@query("""WITH r AS (SELECT user_id AS k, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT k, round(avg(value), 6) AS strongest_mean FROM r WHERE rn <= ceil(n * 0.1) GROUP BY k""")
def strongest_decile_mean(spark: SparkSession, d: str) -> DataFrame:
    t = stats.strongest_mean(table(spark, d, "events").withColumnRenamed("user_id", "k"), ["k"], "value", ["event_id"])
    return t.select("k", F.round("strongest_mean", 6).alias("strongest_mean"))


QUANTILE_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.1), 6) AS p10, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.9), 6) AS p90, round(max({c}), 6) AS max, count(*) AS finite_count, 0::BIGINT AS nonfinite_count FROM lineitem"
    for m, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax"))
)


@query(QUANTILE_SQL)
def metric_quantiles(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return stats.metric_quantiles(li, ["quantity", "price", "discount", "tax"])


@query("""SELECT l_returnflag AS k, round(avg((l_discount <= 0.05)::INT), 6) AS retention, round(avg((l_tax >= 0.02)::INT), 6) AS edge, round(avg((l_quantity > 10)::INT), 6) AS energy, round(avg((l_discount <= 0.05 AND l_tax >= 0.02 AND l_quantity > 10)::INT), 6) AS joint FROM lineitem GROUP BY 1""")
def pass_fractions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "k")
    return stats.pass_fractions(li, ["k"], {"retention": F.col("l_discount") <= 0.05, "edge": F.col("l_tax") >= 0.02, "energy": F.col("l_quantity") > 10})


@query("""WITH r AS (SELECT unnest(list_filter([CASE WHEN o_totalprice < 50000 THEN 'too_small' END, CASE WHEN o_orderstatus = 'F' THEN 'closed' END, CASE WHEN o_orderkey % 3 = 0 THEN 'third' END], lambda x: x IS NOT NULL)) AS reason FROM orders) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    r = F.array_compact(F.array(F.when(F.col("o_totalprice") < 50000, F.lit("too_small")), F.when(F.col("o_orderstatus") == "F", F.lit("closed")), F.when(F.col("o_orderkey") % 3 == 0, F.lit("third"))))
    return stats.reason_counts(o.select(r.alias("reasons")), "reasons")


@query("""WITH b AS (SELECT o_orderpriority AS k, o_totalprice AS v, floor(o_totalprice / 16000) AS bin FROM orders), c AS (SELECT k, bin, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, bin) AS rn FROM c) WHERE rn = 1)
SELECT b.k, t.bin::BIGINT AS dominant, t.n AS in_bin, round(median(v), 4) AS centre FROM b JOIN t ON b.k = t.k AND abs(b.bin - t.bin) <= 1 GROUP BY ALL""")
def dominant_bin(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("v"))
    return stats.dominant_bin(o, ["k"], "v", 16000).select("k", "dominant", "in_bin", F.round("centre", 4).alias("centre"))


PSNR = "CASE WHEN avg((v - w) * (v - w)) = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025.0 / avg((v - w) * (v - w))) END"


@query(f"WITH {PAIRS} SELECT image, round(avg(abs(v - w)), 6) AS mae, round(quantile_cont(abs(v - w), 0.95), 6) AS p95, max(abs(v - w))::DOUBLE AS max_error, round({PSNR}, 6) AS psnr, {PSNR} >= 8.0 AND quantile_cont(abs(v - w), 0.95) <= 200 AS passed FROM pairs GROUP BY image")
def psnr_gate(spark: SparkSession, d: str) -> DataFrame:
    e = stats.image_error(fx.pairs(spark, d), ["image"], "v", "w")
    return e.select("image", F.round("mae", 6).alias("mae"), F.round("p95", 6).alias("p95"), "max_error", F.round("psnr", 6).alias("psnr"), ((F.col("psnr") >= 8.0) & (F.col("p95") <= 200)).alias("passed"))


@query("""WITH n AS (SELECT o_custkey AS layer, count(*) AS new FROM orders GROUP BY 1), f AS (SELECT c_custkey AS layer, c_nationkey % 3 AS removed FROM customer) SELECT coalesce(n.layer, f.layer) AS layer, (coalesce(new, 0) + coalesce(removed, 0))::BIGINT AS total, coalesce(new, 0) + coalesce(removed, 0) > 12 AS over FROM n FULL JOIN f ON n.layer = f.layer""")
def removal_budget(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "customer").select(F.col("c_custkey").alias("layer"), (F.col("c_nationkey") % 3).cast("long").alias("removed"))
    return stats.over_budget(table(spark, d, "orders").withColumnRenamed("o_custkey", "layer"), done, "layer", 12)


@query("""WITH f AS (SELECT page_id, lower(regexp_extract(url, '//([^/]+)', 1)) AS p, lower(regexp_extract(url, '/([0-9]+)', 1)) AS s FROM pages), c AS (SELECT p, s, count(*) AS same_stem FROM f GROUP BY ALL) SELECT page_id, same_stem FROM f JOIN c USING (p, s)""")
def duplicate_stems(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("parent"), F.regexp_extract("url", "/([0-9]+)", 1).alias("stem"))
    return stats.duplicate_stems(p, "parent", "stem").select("page_id", "same_stem")


@query("""WITH p AS (SELECT l_orderkey AS k, l_discount * 10 AS c, l_quantity AS px, CASE WHEN l_linenumber % 3 = 0 THEN 'validated_surface_linear' WHEN l_returnflag = 'R' THEN 'validated_surface_constant' WHEN l_returnflag = 'A' THEN 'poster_surface' ELSE 'validated_surface_linear' END AS m FROM lineitem)
SELECT k, round(sum(c * px) / greatest(1, sum(px)), 9) AS confidence, CASE WHEN count(DISTINCT m) = 1 THEN min(m) WHEN bool_and(m LIKE 'validated_surface_%') THEN 'componentwise_validated_surface' WHEN bool_and(m LIKE 'poster_surface_%') THEN 'componentwise_poster_surface' ELSE 'componentwise_mixed' END AS method FROM p GROUP BY k""")
def weighted_confidence(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("l_linenumber") % 3 == 0, "validated_surface_linear").when(F.col("l_returnflag") == "R", "validated_surface_constant").when(F.col("l_returnflag") == "A", "poster_surface").otherwise("validated_surface_linear")
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_quantity").alias("pixels"), m.alias("method"))
    return stats.weighted_confidence(p, ["k"]).withColumn("confidence", F.round("confidence", 9))


# --- boxes and joins -----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {BOXES} SELECT a.id AS a, b.id AS b, {A} AS area_a, {COMMON} AS common, round({IOU}, 9) AS iou, greatest(a.x0 - b.x1, b.x0 - a.x1, 0) AS gap_x, round(sqrt(greatest(a.x0 - b.x1, b.x0 - a.x1, 0) ^ 2 + greatest(a.y0 - b.y1, b.y0 - a.y1, 0) ^ 2), 9) AS distance,
round(greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0))::DOUBLE, 9) AS overlap_y, greatest(0, a.x0 - 3) AS ex0, least(90, a.x1 + 3) AS ex1 FROM boxes a JOIN boxes b ON b.id = a.id + 1""")
def box_measures(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    cols = ("id", "x0", "y0", "x1", "y1")
    l = b.select(*[F.col(c).alias(f"a_{c}") for c in cols])  # noqa: E741
    r = b.select(*[F.col(c).alias(f"b_{c}") for c in cols]).withColumn("k", F.col("b_id") - 1)
    j = l.join(r, l.a_id == r.k)
    p, q = g.box("a_"), g.box("b_")
    e = g.expand(p, 3, F.lit(90), F.lit(90))
    return j.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), g.area(p).alias("area_a"), g.intersection(p, q).alias("common"), F.round(g.iou(p, q), 9).alias("iou"), g.gap_x(p, q).alias("gap_x"), F.round(g.distance(p, q), 9).alias("distance"), F.round(g.vertical_overlap(p, q), 9).alias("overlap_y"), e.x0.alias("ex0"), e.x1.alias("ex1"))


@query(f"WITH {BOXES} SELECT a.image, a.id AS a, b.id AS b, round({IOU}, 9) AS iou FROM boxes a JOIN boxes b ON a.image = b.image AND a.id < b.id WHERE {IOU} >= 0.2")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spatial.iou_pairs(fx.boxes(spark, d), ["image"], "id", 0.2).withColumn("iou", F.round("iou", 9))


@query(f"""WITH {BOXES}, h AS (SELECT a.image, a.id AS "inner", b.id AS "outer", {B} AS outer_area, row_number() OVER (PARTITION BY a.image, a.id ORDER BY {B}, b.id) AS rn FROM boxes a JOIN boxes b ON a.image = b.image AND a.id <> b.id WHERE {COMMON} > 0 AND {COMMON} / greatest(1, {A})::DOUBLE >= 0.88) SELECT image, "inner", "outer", outer_area FROM h WHERE rn = 1""")
def smallest_container(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    return spatial.smallest_container(b, b, ["image"], "id")


@query(f"""WITH {BOXES}, c AS (SELECT *, 2 * size + 5 AS pixels, CASE WHEN size % 5 = 0 THEN 'text_raster' ELSE 'object' END AS category FROM boxes), h AS (SELECT a.image, a.id AS child, b.id AS parent, row_number() OVER (PARTITION BY a.image, a.id ORDER BY b.pixels, b.id) AS rn FROM c a JOIN c b ON a.image = b.image AND a.id <> b.id
WHERE b.category <> 'text_raster' AND {COMMON} > 0 AND NOT (b.pixels < a.pixels * 1.05 AND {B} < {A} * 1.08) AND ({COMMON} / a.pixels::DOUBLE >= 0.62 OR ({COMMON} / greatest(1, {A})::DOUBLE >= 0.88 AND {B} / greatest(1, {A})::DOUBLE <= 14))) SELECT image, child, parent FROM h WHERE rn = 1""")
def hierarchy_parents(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d).withColumn("pixels", 2 * F.col("size") + 5).withColumn("category", F.when(F.col("size") % 5 == 0, "text_raster").otherwise("object"))
    return spatial.parents(b, ["image"], "id", "pixels")


@query(f"""WITH {BOXES}, j AS (SELECT a.image, a.id AS a, b.id AS b, {COMMON} AS px, 2 * b.size + 5 AS mask, {A} AS box FROM boxes a JOIN boxes b ON a.image = b.image AND a.id <> b.id WHERE {COMMON} > 0) SELECT image, a, b, round(px / greatest(1, mask)::DOUBLE * 0.62 + px / greatest(1, box)::DOUBLE * 0.23 + least(mask, box) / greatest(mask, box)::DOUBLE * 0.15, 6) AS match FROM j WHERE px / greatest(1, mask)::DOUBLE * 0.62 + px / greatest(1, box)::DOUBLE * 0.23 + least(mask, box) / greatest(mask, box)::DOUBLE * 0.15 > 0.57""")
def box_mask_match(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    j = spatial.overlap_join(b, b, ["image"]).where("a_id <> b_id")
    score = g.match_score(g.intersection(g.box("a_"), g.box("b_")), 2 * F.col("b_size") + 5, g.area(g.box("a_")))
    return j.select("image", F.col("a_id").alias("a"), F.col("b_id").alias("b"), score.alias("match")).where("match > 0.57").withColumn("match", F.round("match", 6))


@query("""WITH p AS (SELECT l_partkey AS part, l_suppkey AS owner, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), s AS (SELECT *, q / sum(q) OVER (PARTITION BY part) AS cov FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY cov DESC, owner) AS rn FROM s) SELECT part, CASE WHEN cov >= 0.3 THEN owner END AS owner, round(cov, 9) AS coverage FROM r WHERE rn = 1""")
def owner_argmax(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("owner_id")).agg(F.sum("l_quantity").alias("q"))
    total = p.groupBy("part").agg(F.sum("q").alias("t"))
    return spatial.owners(p.join(total, "part"), "part", "owner_id", F.col("q") / F.col("t"), 0.3).withColumn("coverage", F.round("coverage", 9))


@query(f"""WITH {BOXES}, t AS (SELECT * FROM boxes WHERE id % 2 = 0), r AS (SELECT * FROM boxes WHERE id % 2 = 1), h AS (SELECT a.image, a.id AS draft, b.id AS layer, greatest({IOU}, {COMMON} / greatest(1, least({A}, {B}))::DOUBLE) AS match FROM t a JOIN r b ON a.image = b.image WHERE {COMMON} > 0 AND ({IOU} >= 0.3 OR {COMMON} / greatest(1, least({A}, {B}))::DOUBLE >= 0.62)), k AS (SELECT *, row_number() OVER (PARTITION BY image, draft ORDER BY match DESC, layer) AS rn FROM h) SELECT image, draft, layer, round(match, 9) AS match FROM k WHERE rn = 1""")
def existing_text_match(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    return spatial.best_text_match(b.where("id % 2 = 0"), b.where("id % 2 = 1"), ["image"], "id").withColumn("match", F.round("match", 9))


@query(f"""WITH {BOXES}, t AS (SELECT * FROM boxes WHERE id % 2 = 0), r AS (SELECT *, 'L' || (size % 7)::VARCHAR AS label, price AS score FROM boxes WHERE id % 2 = 1), h AS (SELECT a.image, a.id AS box, b.id, b.label, b.score FROM t a JOIN r b ON a.image = b.image WHERE {COMMON} > 0 AND ({COMMON} / greatest(1, {A})::DOUBLE >= 0.15 OR {IOU} >= 0.08)), k AS (SELECT *, row_number() OVER (PARTITION BY image, box ORDER BY score DESC, label, id) AS rank FROM h) SELECT image, box, rank, label, score FROM k WHERE rank <= 4""")
def semantic_hints(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    r = b.where("id % 2 = 1").withColumn("label", F.concat(F.lit("L"), (F.col("size") % 7).cast("string"))).withColumn("score", F.col("price"))
    return spatial.semantic_hints(b.where("id % 2 = 0"), r, ["image"], "id")


LABELS = RASTER + ", e AS (SELECT image, y, x, v // 100 AS label FROM raster), a AS (SELECT image, y, x, v // 90 AS label FROM raster)"


@query(f'WITH {LABELS} SELECT e.image, e.label AS "left", a.label AS "right", count(*) AS pixels FROM e JOIN a USING (image, y, x) WHERE e.label > 0 AND a.label > 0 GROUP BY ALL')
def label_overlaps(spark: SparkSession, d: str) -> DataFrame:
    r = fx.raster(spark, d)
    e, a = (r.select("image", "y", "x", F.floor(F.col("v") / n).alias("label")) for n in (100, 90))
    return spatial.label_overlaps(e, a, ["image"])


@query(f"""WITH {LABELS}, p AS (SELECT DISTINCT e.image, e.label AS l, a.label AS r FROM e JOIN a USING (image, y, x) WHERE e.label > 0 AND a.label > 0), pl AS (SELECT image, l, count(*) AS n FROM p GROUP BY ALL), pr AS (SELECT image, r, count(*) AS n FROM p GROUP BY ALL), i AS (SELECT DISTINCT image FROM raster),
mi AS (SELECT e.image, count(*) AS n FROM e JOIN a USING (image, y, x) WHERE e.label > 0 AND a.label = 0 GROUP BY 1), orp AS (SELECT image, count(*) AS n FROM (SELECT DISTINCT image, label FROM a WHERE label > 0) q WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.image = q.image AND pr.r = q.label) GROUP BY 1), me AS (SELECT image, count(*) AS n FROM pr WHERE n > 1 GROUP BY 1), sp AS (SELECT image, count(*) AS n FROM pl WHERE n > 1 GROUP BY 1)
SELECT i.image, coalesce(mi.n, 0) AS missing_expected_pixels, coalesce(orp.n, 0) AS orphan_actual_components, coalesce(me.n, 0) AS merged_actual_components, coalesce(sp.n, 0) AS split_expected_components, greatest(coalesce(mi.n, 0), coalesce(orp.n, 0), coalesce(me.n, 0), coalesce(sp.n, 0)) = 0 AS passed FROM i LEFT JOIN mi USING (image) LEFT JOIN orp USING (image) LEFT JOIN me USING (image) LEFT JOIN sp USING (image)""")
def topology_relations(spark: SparkSession, d: str) -> DataFrame:
    r = fx.raster(spark, d)
    e, a = (r.select("image", "y", "x", F.floor(F.col("v") / n).alias("label")) for n in (100, 90))
    return spatial.topology_relations(e, a, ["image"])


FP = "sha256(concat('V7_REVIEW_REGION_V1', chr(0), to_json({'bbox': [doc_id, 1, doc_id + 2, 3], 'selected_text': text})))"


@query(f"""WITH d AS (SELECT doc_id, text, source, lang, n_chars, {FP} AS fingerprint FROM documents) SELECT d.doc_id, d.fingerprint, coalesce(CASE WHEN l.quality = 1 THEN 'keep' WHEN l.quality = 0 THEN 'skip' END, 'pending') AS action FROM d LEFT JOIN labels l ON d.doc_id = l.doc_id""".replace("concat('V7_REVIEW_REGION_V1', chr(0), ", "encode('V7_REVIEW_REGION_V1') || '\\x00'::BLOB || encode(").replace("'selected_text': text})))", "'selected_text': text})))"))
def fingerprint_join(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", hashing.region_fingerprint(F.array(k, F.lit(1).cast("long"), k + 2, F.lit(3).cast("long")), F.col("text")).alias("fingerprint"))
    rows = docs.join(table(spark, d, "labels"), "doc_id").select("fingerprint", F.col("fingerprint").alias("recomputed"), F.when(F.col("quality") == 1, "keep").otherwise("skip").alias("action"), F.lit("").alias("approved_text"), "doc_id")
    merged, problems = review.merge_decisions(docs, rows.drop("doc_id"))
    return merged.select("doc_id", "fingerprint", "action")


@query("""SELECT 'stale' AS problem, count(*) AS n FROM (SELECT doc_id FROM labels WHERE quality IN (0, 1)) WHERE doc_id % 3 = 0""")
def stale_decisions(spark: SparkSession, d: str) -> DataFrame:
    fp = F.sha2(F.col("doc_id").cast("string"), 256)
    current = table(spark, d, "documents").where("doc_id % 3 <> 0").select(fp.alias("fingerprint"))
    rows = table(spark, d, "labels").select(fp.alias("fingerprint"), fp.alias("recomputed"), F.when(F.col("quality") == 1, "keep").otherwise("replace").alias("action"), F.lit("x").alias("approved_text"))
    _, problems = review.merge_decisions(current, rows)
    return problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT conv_id AS id, turn, CASE role WHEN 'user' THEN 'replace' WHEN 'assistant' THEN 'keep' ELSE 'pending' END AS action, trim(text) AS text FROM conversations WHERE turn >= conv_id % 3), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS rn FROM r) WHERE rn = 1), k AS (SELECT DISTINCT conv_id AS id FROM conversations)
SELECT k.id, CASE WHEN action = 'replace' AND text <> '' THEN 'replace' WHEN action = 'keep' THEN 'keep' ELSE 'unresolved' END AS outcome, CASE WHEN action = 'replace' AND text <> '' THEN text END AS text FROM k LEFT JOIN f USING (id)""")
def region_resolve(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    rows = c.where("turn >= conv_id % 3").select(F.col("conv_id").alias("id"), "turn", F.when(F.col("role") == "user", "replace").when(F.col("role") == "assistant", "keep").otherwise("pending").alias("action"), F.col("text").alias("approved_text"))
    return review.resolve(c.select(F.col("conv_id").alias("id")), rows, "id", "turn")


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS path, o_custkey % 4 AS face, o_orderpriority AS axes, o_custkey % 40 + 1 AS size FROM orders WHERE o_orderkey % 10 <> 3), f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE o_orderstatus END AS path, o_custkey % 4 AS face, o_orderpriority AS axes, (o_custkey % 40 + 1) * 3 + (o_orderkey % 19 = 0)::INT AS size FROM orders WHERE o_orderkey % 10 <> 4)
SELECT coalesce(s.id, f.id) AS id, coalesce(s.path = f.path AND s.face = f.face, false) AS same_face, coalesce(s.axes = f.axes, false) AS same_axes, coalesce(f.size = s.size * 3, false) AS same_size, coalesce(s.path = f.path AND s.face = f.face AND s.axes = f.axes AND f.size = s.size * 3, false) AS passed FROM s FULL JOIN f ON s.id = f.id""")
def lock_fidelity(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    size = F.col("o_custkey") % 40 + 1
    s = o.where("o_orderkey % 10 <> 3").select(k.alias("id"), F.col("o_orderstatus").alias("path"), (F.col("o_custkey") % 4).alias("face_index"), F.col("o_orderpriority").alias("axes"), size.alias("size"))
    f = o.where("o_orderkey % 10 <> 4").select(k.alias("id"), F.when(k % 17 == 0, "x").otherwise(F.col("o_orderstatus")).alias("path"), (F.col("o_custkey") % 4).alias("face_index"), F.col("o_orderpriority").alias("axes"), (size * 3 + (k % 19 == 0).cast("int")).alias("size"))
    return review.lock_fidelity(s, f, "id", 3.0)


@query("""WITH q AS (SELECT vec_id AS request, label, sha256(vec_id::VARCHAR) AS canonical FROM embeddings), e AS (SELECT vec_id AS entry, label, CASE WHEN vec_id % 2 = 0 THEN sha256(vec_id::VARCHAR) END AS new_id, sha256(vec_id::VARCHAR) AS old_id, vec_id % 5 <> 0 AS whole FROM embeddings UNION ALL SELECT vec_id + 1000000, label, sha256(vec_id::VARCHAR), NULL, true FROM embeddings WHERE vec_id % 3 = 0)
SELECT q.request, min(e.entry) AS entry FROM q LEFT JOIN e ON e.whole AND e.label = q.label AND coalesce(e.new_id, e.old_id) = q.canonical GROUP BY q.request""")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "embeddings"), F.col("vec_id")
    h = F.sha2(k.cast("string"), 256)
    requests = e.select(k.alias("request"), "label", h.alias("canonical"))
    one = e.select(k.alias("entry"), "label", F.when(k % 2 == 0, h).alias("canonical"), h.alias("legacy"), F.lit("a").alias("recorded_sha256"), F.when(k % 5 != 0, "a").otherwise("b").alias("actual_sha256"))
    two = e.where("vec_id % 3 = 0").select((k + 1000000).alias("entry"), "label", h.alias("canonical"), F.lit(None).cast("string").alias("legacy"), F.lit("a").alias("recorded_sha256"), F.lit("a").alias("actual_sha256"))
    entries = one.union(two).withColumn("ord", F.col("entry"))
    return manifest.cache_lookup(requests, entries, "request", ["label"], ("canonical", "legacy"), "ord").select("request", "entry")


@query("""WITH s AS (SELECT p_partkey AS id, sha256(p_partkey::VARCHAR) AS h FROM part), n AS (SELECT s_suppkey AS native, list_transform(range(0, 5), lambda i: sha256((s_suppkey * 7 + i)::VARCHAR)) AS hs, s_suppkey % 4 <> 0 AS whole FROM supplier), x AS (SELECT native, unnest(hs) AS h FROM n WHERE whole) SELECT id, min(native) AS native FROM s JOIN x USING (h) GROUP BY id""")
def provenance_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    natives = table(spark, d, "supplier").select(k.alias("native"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.sha2((k * 7 + i).cast("string"), 256)).alias("source_hashes"), F.lit("a").alias("recorded_sha256"), F.when(k % 4 != 0, "a").otherwise("b").alias("actual_sha256"))
    sources = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"))
    return manifest.provenance(natives, sources, "id")


@query("""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'bad_' || vec_id ELSE 'sam_' || lpad((vec_id % 50)::VARCHAR, 4, '0') || '_cc_' || lpad((vec_id % 7)::VARCHAR, 3, '0') END AS reference FROM embeddings), c AS (SELECT a AS raw_id, b AS component_id FROM range(40) x(a), range(1, 6) y(b)) SELECT vec_id, reference, EXISTS (SELECT 1 FROM c WHERE vec_id % 4 <> 0 AND raw_id = vec_id % 50 AND component_id = vec_id % 7) AS resolved FROM r""")
def component_resolver(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id")
    ref = F.when(k % 4 == 0, F.concat(F.lit("bad_"), k.cast("string"))).otherwise(F.concat(F.lit("sam_"), F.lpad((k % 50).cast("string"), 4, "0"), F.lit("_cc_"), F.lpad((k % 7).cast("string"), 3, "0")))
    refs = table(spark, d, "embeddings").select(k, F.lit(0).alias("document"), ref.alias("reference"))
    parts = spark.range(40).select(F.lit(0).alias("document"), F.col("id").cast("int").alias("raw_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("component_id"))
    return manifest.resolve_components(refs, parts, "document").select("vec_id", "reference", "resolved")


FILES = """f AS (SELECT p_partkey // 9 AS bundle, CASE p_partkey % 9 WHEN 0 THEN 'manifest.json' WHEN 1 THEN 'RESULT.png' WHEN 2 THEN 'x_BEFORE_AFTER.png' WHEN 3 THEN 'technical/SOURCE.png' WHEN 4 THEN 'a_CLEAN_BASE_x4.png' WHEN 5 THEN 'TECHNICAL/overlay.png' WHEN 6 THEN 'TEXT_REVIEW.json' WHEN 7 THEN CASE WHEN p_size % 2 = 0 THEN 'technical/QA.json' ELSE 'technical/text_review.json' END ELSE 'notes' || p_size::VARCHAR || '.txt' END AS path FROM part)"""
ROLE = """CASE WHEN regexp_matches(lower(path), '^(technical/)?manifest\\.json$') THEN 'manifest' WHEN regexp_matches(lower(path), '^(result\\.png|review_required\\.png|[^/]*_repaired_x[^/]*\\.png)$') THEN 'result' WHEN regexp_matches(lower(path), '^(comparison\\.png|[^/]*_before_after\\.png)$') THEN 'comparison' WHEN regexp_matches(lower(path), '^(technical/source\\.png|[^/]*_source_normalized\\.png)$') THEN 'source'
WHEN regexp_matches(lower(path), '^(technical/clean\\.png|[^/]*_clean_base_x[^/]*\\.png)$') THEN 'clean' WHEN regexp_matches(lower(path), '^(technical/overlay\\.png|[^/]*_qa_overlay\\.png)$') THEN 'overlay' WHEN regexp_matches(lower(path), '^(technical/)?text_review\\.json$') THEN 'review' WHEN regexp_matches(lower(path), '^(technical/)?qa\\.json$') THEN 'qa' END"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    names = ["manifest.json", "RESULT.png", "x_BEFORE_AFTER.png", "technical/SOURCE.png", "a_CLEAN_BASE_x4.png", "TECHNICAL/overlay.png", "TEXT_REVIEW.json"]
    path = F.when(s % 2 == 0, "technical/QA.json").otherwise("technical/text_review.json")
    path = F.when(k % 9 == 7, path).otherwise(F.concat(F.lit("notes"), s.cast("string"), F.lit(".txt")))
    for i, n in enumerate(names):
        path = F.when(k % 9 == i, n).otherwise(path)
    return table(spark, d, "part").select(F.floor(k / 9).alias("bundle"), path.alias("path"))


@query(f"WITH {FILES}, r AS (SELECT bundle, {ROLE} AS role, path FROM f) SELECT bundle, role, count(*) AS claims, CASE WHEN count(*) = 1 THEN min(path) END AS path FROM r WHERE role IS NOT NULL GROUP BY ALL")
def role_collision(spark: SparkSession, d: str) -> DataFrame:
    return manifest.roles(_files(spark, d), "bundle").select("bundle", "role", "claims", "path")


@query(f"WITH {FILES}, r AS (SELECT bundle, {ROLE} AS role FROM f), w AS (SELECT DISTINCT bundle, unnest(['result', 'comparison', 'source', 'clean', 'overlay', 'review', 'qa', 'manifest']) AS role FROM f) SELECT w.bundle, w.role FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.bundle = w.bundle AND r.role = w.role)")
def missing_roles(spark: SparkSession, d: str) -> DataFrame:
    return manifest.missing_roles(_files(spark, d), "bundle")


@query(f"""WITH {FILES}, r AS (SELECT bundle, path, {ROLE} AS role FROM f), p AS (SELECT bundle, CASE role WHEN 'result' THEN CASE WHEN bundle % 2 = 0 THEN 'RESULT.png' ELSE 'REVIEW_REQUIRED.png' END WHEN 'comparison' THEN 'COMPARISON.png' WHEN 'source' THEN 'TECHNICAL/SOURCE.png' WHEN 'clean' THEN 'TECHNICAL/CLEAN.png' WHEN 'overlay' THEN 'TECHNICAL/OVERLAY.png' WHEN 'review' THEN 'TECHNICAL/TEXT_REVIEW.json' WHEN 'qa' THEN 'TECHNICAL/QA.json' WHEN 'manifest' THEN 'TECHNICAL/manifest.json' ELSE CASE WHEN lower(path) LIKE 'technical/%' THEN path ELSE 'TECHNICAL/_OTHER/' || path END END AS destination FROM r)
SELECT bundle, lower(destination) AS k, 'claimed_twice' AS problem FROM p GROUP BY ALL HAVING count(*) > 1""")
def bundle_layout_problems(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).withColumn("status", F.when(F.col("bundle") % 2 == 0, "PASS").otherwise("REVIEW_REQUIRED"))
    return manifest.layout_plan(f, "bundle", "status")[1]


@query("""SELECT o_orderkey AS id, lower(replace('C:\\In\\' || o_custkey::VARCHAR, '\\', '/')) = lower('c:/in/' || (o_custkey + (o_orderkey % 5 = 0)::INT)::VARCHAR) AS owned FROM orders""")
def bundle_ownership(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("string")
    return table(spark, d, "orders").select(k.alias("id"), manifest.owned_by(F.concat(F.lit("C:\\In\\"), c.cast("string")), F.concat(F.lit("c:/in/"), (c + (k % 5 == 0).cast("int")).cast("string")), none, none).alias("owned"))


@query("""WITH e AS (SELECT o_orderkey AS id, sha256(o_custkey::VARCHAR) AS h FROM orders WHERE o_orderkey % 11 <> 0), f AS (SELECT o_orderkey AS id, upper(sha256((o_custkey + (o_orderkey % 7 = 0)::INT)::VARCHAR)) AS h FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(e.id, f.id) AS id, CASE WHEN f.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'extra' ELSE 'changed' END AS difference FROM e FULL JOIN f ON e.id = f.id WHERE f.id IS NULL OR e.id IS NULL OR lower(e.h) <> lower(f.h)""")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    e = o.where("o_orderkey % 11 <> 0").select(k.alias("id"), F.sha2(c.cast("string"), 256).alias("h"))
    f = o.where("o_orderkey % 13 <> 0").select(k.alias("id"), F.upper(F.sha2((c + (k % 7 == 0).cast("int")).cast("string"), 256)).alias("h"))
    return manifest.three_way(e, f, "id", "h")


@query("""SELECT o_orderkey AS path, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'sha256_mismatch' END AS failure FROM orders""")
def hash_verification(spark: SparkSession, d: str) -> DataFrame:
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    e = o.select(k.alias("path"), F.sha2(c.cast("string"), 256).alias("sha256"))
    f = o.where("o_orderkey % 13 <> 0").select(k.alias("path"), F.upper(F.sha2((c + (k % 7 == 0).cast("int")).cast("string"), 256)).alias("sha256"))
    return manifest.verified(e, f).select("path", "failure")


# --- groups, graphs, orders ----------------------------------------------------------------------------------------------------------


ROW = "least(a.y1 - a.y0, b.y1 - b.y0) / greatest(1, greatest(a.y1 - a.y0, b.y1 - b.y0))::DOUBLE >= 0.62 AND greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0))::DOUBLE >= 0.58 AND greatest(a.x0 - b.x1, b.x0 - a.x1, 0) <= 0.78 * greatest(a.y1 - a.y0, b.y1 - b.y0) AND abs(a.size - b.size) <= 32"


@query(f"WITH {BOXES} SELECT a.image, a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.image = b.image AND a.id < b.id WHERE {ROW}")
def row_relations(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    j = spatial.overlap_join(b, b, ["image"], reach=16).where("a_id < b_id")
    return j.where(spatial.row_related(g.box("a_"), g.box("b_"), F.abs(F.col("a_size") - F.col("b_size")))).select("image", F.col("a_id").alias("a"), F.col("b_id").alias("b"))


GROUP = "sqrt(greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) ^ 2 + greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) ^ 2) <= 0.023 * sqrt(106.0 ^ 2 + 120.0 ^ 2) AND greatest(a.x1, b.x1) - least(a.x0, b.x0) <= 0.43 * 120 AND greatest(a.y1, b.y1) - least(a.y0, b.y0) <= 0.30 * 106"


@query(f"WITH {BOXES} SELECT a.image, a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.image = b.image AND a.id < b.id WHERE {GROUP}")
def spatial_relations(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    j = spatial.overlap_join(b, b, ["image"], reach=4).where("a_id < b_id")
    return j.where(spatial.near_group(g.box("a_"), g.box("b_"), F.lit(120.0), F.lit(106.0))).select("image", F.col("a_id").alias("a"), F.col("b_id").alias("b"))


VROW = "least(a.size, b.size) / greatest(1.0, greatest(a.size, b.size)) >= 0.58 AND greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0))::DOUBLE >= 0.52 AND abs(a.y1 - b.y1) <= 0.28 * greatest(a.size, b.size) AND greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) <= 1.65 * greatest(a.size, b.size)"


@query(f"WITH {BOXES} SELECT a.image, a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.image = b.image AND a.id < b.id WHERE {VROW}")
def visual_rows(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    j = spatial.overlap_join(b, b, ["image"], reach=96, reach_y=0).where("a_id < b_id")
    return j.where(spatial.same_visual_row(g.box("a_"), g.box("b_"), F.col("a_size").cast("double"), F.col("b_size").cast("double"))).select("image", F.col("a_id").alias("a"), F.col("b_id").alias("b"))


JOINED = f"{COMMON} / greatest(1, {A})::DOUBLE > 0.86 OR {COMMON} / greatest(1, {B})::DOUBLE > 0.86 OR (greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0))::DOUBLE > 0.42 AND greatest(a.y1 - a.y0, b.y1 - b.y0) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0))::DOUBLE < 3.2 AND greatest(a.x0 - b.x1, b.x0 - a.x1, 0) < 1.35 * greatest(a.y1 - a.y0, b.y1 - b.y0) AND abs(a.price - b.price) < 82) OR ({IOU} > 0.08 AND greatest(a.x1 - a.x0, b.x1 - b.x0) < 120 * 0.32 AND greatest(a.y1 - a.y0, b.y1 - b.y0) < 106 * 0.32 AND abs(a.price - b.price) < 105)"


@query(f"WITH {BOXES} SELECT a.image, a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.image = b.image AND a.id < b.id WHERE {JOINED}")
def residual_joins(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d).withColumn("area", g.area(g.box()))
    j = spatial.overlap_join(b, b, ["image"], reach=24, reach_y=0).where("a_id < b_id")
    p, q = g.box("a_"), g.box("b_")
    both, one = g.intersection(p, q), F.lit(1)
    over = g.share(both, F.col("a_area") + F.col("b_area") - both)
    joined = spatial.should_join(p, q, both / F.greatest(one, "a_area"), both / F.greatest(one, "b_area"), F.abs(F.col("a_price") - F.col("b_price")), F.lit(120.0), F.lit(106.0), over)
    return j.where(joined).select("image", F.col("a_id").alias("a"), F.col("b_id").alias("b"))


@query(f"""WITH RECURSIVE {BOXES}, e AS (SELECT a.id AS u, b.id AS v FROM boxes a JOIN boxes b ON a.image = b.image AND a.id <> b.id WHERE {IOU} >= 0.2), r AS (SELECT id AS n, id AS l FROM boxes UNION SELECT e.v, r.l FROM r JOIN e ON r.n = e.u) SELECT n AS id, min(l) AS component FROM r GROUP BY n""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    return graph.components(b.select("id"), spatial.iou_pairs(b, ["image"], "id", 0.2), "id")


@query(f"""WITH {RASTER}, m AS (SELECT image, v >= 128 AS hi, y, x FROM raster), a AS (SELECT image, label, y, x FROM raster WHERE v >= 120), b AS (SELECT image, y, x FROM raster WHERE v <= 160), s AS (SELECT i.image, coalesce((SELECT count(*) FROM a WHERE a.image = i.image), 0) AS na, coalesce((SELECT count(*) FROM b WHERE b.image = i.image), 0) AS nb, coalesce((SELECT count(*) FROM a JOIN b USING (image, y, x) WHERE image = i.image), 0) AS c FROM (SELECT DISTINCT image FROM raster) i)
SELECT image, na AS area_a, nb AS area_b, c AS common, round(c / (na + nb - c)::DOUBLE, 9) AS iou, round(c / na::DOUBLE, 9) AS a_in_b FROM s WHERE c > 0""")
def mask_relations(spark: SparkSession, d: str) -> DataFrame:
    r = fx.raster(spark, d)
    a = r.where("v >= 120").select("image", F.lit(1).alias("mask"), "y", "x")
    b = r.where("v <= 160").select("image", F.lit(2).alias("mask"), "y", "x")
    return spatial.mask_relations(a, b, ["image"]).select("image", "area_a", "area_b", "common", F.round("iou", 9).alias("iou"), F.round("a_in_b", 9).alias("a_in_b"))


@query(f"WITH RECURSIVE {FOREST}, r AS (SELECT id, 0 AS depth FROM forest WHERE parent IS NULL UNION ALL SELECT f.id, r.depth + 1 FROM forest f JOIN r ON f.parent = r.id) SELECT id, depth FROM r")
def hierarchy_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(graph.repaired(fx.forest(spark, d))).select("id", "depth")


@query(f"WITH RECURSIVE {FOREST}, r AS (SELECT parent AS ancestor, id AS descendant, 1 AS distance FROM forest WHERE parent IS NOT NULL UNION ALL SELECT r.ancestor, f.id, r.distance + 1 FROM r JOIN forest f ON f.parent = r.descendant) SELECT * FROM r")
def descendants(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(fx.forest(spark, d))


@query(f"""WITH RECURSIVE {FOREST}, k AS (SELECT *, CASE category WHEN 'object' THEN 1 WHEN 'text_raster' THEN 2 ELSE 0 END AS c FROM forest), r AS (SELECT id, [struct_pack(a := c, b := display_order, i := id)] AS path FROM k WHERE parent IS NULL UNION ALL SELECT k.id, list_append(r.path, struct_pack(a := k.c, b := k.display_order, i := k.id)) FROM k JOIN r ON k.parent = r.id) SELECT id, row_number() OVER (PARTITION BY id // 40 ORDER BY path) AS z FROM r""")
def z_order(spark: SparkSession, d: str) -> DataFrame:
    p = graph.z_order(fx.forest(spark, d))
    return p.select("id", F.row_number().over(Window.partitionBy(F.floor(F.col("id") / 40)).orderBy("path")).cast("long").alias("z"))


@query("""WITH c AS (SELECT p_partkey AS ord, CASE WHEN p_size % 2 = 0 THEN upper('dir/' || (p_partkey % 300)::VARCHAR || 'x') ELSE 'dir\\' || (p_partkey % 300)::VARCHAR || 'x' END AS path FROM part), k AS (SELECT *, lower(replace(path, '\\', '/')) AS path_key FROM c) SELECT path_key, arg_min(path, ord) AS path, min(ord) AS ord FROM k GROUP BY path_key""")
def seen_union(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), (F.col("p_partkey") % 300).cast("string")
    c = table(spark, d, "part").select(k.alias("ord"), F.when(F.col("p_size") % 2 == 0, F.upper(F.concat(F.lit("dir/"), n, F.lit("x")))).otherwise(F.concat(F.lit("dir\\"), n, F.lit("x"))).alias("path"))
    return manifest.first_seen(c, "path", "ord")


@query("""WITH m AS (SELECT o_custkey AS archive, 'layer' || (o_orderkey % 6)::VARCHAR AS name FROM orders), r AS (SELECT c_custkey AS archive, 'layer' || i::VARCHAR AS name FROM customer, range(4) t(i) WHERE c_custkey IN (SELECT archive FROM m))
SELECT archive, 'unreferenced' AS problem, name FROM (SELECT DISTINCT * FROM m EXCEPT SELECT * FROM r) UNION ALL SELECT archive, 'absent', name FROM (SELECT * FROM r EXCEPT SELECT * FROM m) UNION ALL SELECT archive, 'repeated', name FROM m GROUP BY ALL HAVING count(*) > 1""")
def member_sets(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("archive"), F.concat(F.lit("layer"), (F.col("o_orderkey") % 6).cast("string")).alias("name"), F.col("o_orderkey").alias("ord"))
    r = table(spark, d, "customer").select(F.col("c_custkey").alias("archive")).join(m.select("archive").distinct(), "archive").select("archive", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("layer"), i.cast("string")))).alias("name"))
    return manifest.member_problems(m, r, "archive", (), "layer0").where("problem <> 'first_member'")


@query("""WITH a AS (SELECT o_orderkey AS path, o_orderstatus AS s, o_custkey AS c FROM orders WHERE o_orderkey % 9 <> 0), b AS (SELECT o_orderkey AS path, o_orderstatus AS s, o_custkey + (o_orderkey % 5 = 0)::INT AS c FROM orders WHERE o_orderkey % 8 <> 0)
SELECT coalesce(a.path, b.path)::VARCHAR AS path, CASE WHEN a.path IS NULL THEN 'extra' WHEN b.path IS NULL THEN 'missing' ELSE 'changed' END AS difference FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.c <> b.c""")
def tree_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    node = lambda ord_: [F.lit(0).alias("document"), k.cast("string").alias("path"), F.col("o_orderstatus").alias("name"), F.lit("pixel").alias("kind"), F.lit(True).alias("visible"), F.array(k, k, k, k).alias("bbox"), ord_.alias("ord")]
    a = o.where("o_orderkey % 9 <> 0").select(*node(F.col("o_custkey")))
    b = o.where("o_orderkey % 8 <> 0").select(*node(F.col("o_custkey") + (k % 5 == 0).cast("int")))
    return manifest.tree_differences(a, b, "document").select("path", "difference")


@query("""SELECT o_orderpriority AS k, count(*) FILTER (o_orderkey % 5 <> 0) AS done, count(*) FILTER (o_orderkey % 5 = 0) AS failed, CASE WHEN count(*) FILTER (o_orderkey % 5 = 0) > 0 THEN 1 ELSE 0 END AS exit_code FROM orders GROUP BY 1""")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "boom").alias("error"))
    return manifest.batch_summary(o, ["k"]).drop("messages")


# --- budgets and ranks ---------------------------------------------------------------------------------------------------------------


BUDGET = """r AS (SELECT p_partkey // 50 AS document, p_partkey AS token, ['owner_panel', 'standalone_row', 'standalone_object', 'symmetric_decoration'][p_size % 4 + 1] AS role, p_retailprice AS salience, p_partkey % 89 AS y0, p_partkey % 97 AS x0 FROM part WHERE p_partkey % 5 < 2), c AS (SELECT p_partkey // 50 AS document, p_partkey AS token, p_partkey - p_partkey % 5 AS parent, p_retailprice AS salience FROM part WHERE p_partkey % 5 >= 2)"""


@query(f"""WITH {BUDGET}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY CASE role WHEN 'owner_panel' THEN 4 WHEN 'standalone_row' THEN 3 WHEN 'standalone_object' THEN 2 ELSE 1 END DESC, salience DESC, y0, x0, token) AS rn FROM r) WHERE rn <= 24), l AS (SELECT document, 24 - count(*) AS room FROM k GROUP BY 1), f AS (SELECT c.*, row_number() OVER (PARTITION BY c.document ORDER BY c.salience DESC, c.token) AS rn FROM c JOIN k ON k.document = c.document AND k.token = c.parent)
SELECT document, token, 'root' AS kind FROM k UNION ALL SELECT f.document, f.token, 'child' FROM f JOIN l USING (document) WHERE rn <= room""")
def budget_topk(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    role = F.when(s % 4 == 0, "owner_panel").when(s % 4 == 1, "standalone_row").when(s % 4 == 2, "standalone_object").otherwise("symmetric_decoration")
    p = table(spark, d, "part").withColumn("document", F.floor(k / 50)).withColumn("token", k).withColumn("salience", F.col("p_retailprice"))
    roots = p.where("p_partkey % 5 < 2").select("document", "token", role.alias("role"), "salience", (k % 89).alias("y0"), (k % 97).alias("x0"))
    return budget.select_budget(roots, p.where("p_partkey % 5 >= 2").select("document", "token", (k - k % 5).alias("parent"), "salience"), "document", 24)


@query("""WITH l AS (SELECT p_partkey // 50 AS document, p_partkey AS id, p_size % 3 <> 0 AS optional, p_retailprice AS salience, p_size AS display_order, CASE WHEN p_partkey % 5 > 0 THEN p_partkey - p_partkey % 5 END AS parent FROM part), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY optional, CASE WHEN optional THEN -salience END, display_order, id) AS rn FROM l) WHERE rn <= 30) SELECT k.document, k.id FROM k WHERE parent IS NULL OR EXISTS (SELECT 1 FROM k q WHERE q.document = k.document AND q.id = k.parent)""")
def cap_layers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(F.floor(k / 50).alias("document"), k.alias("id"), (F.col("p_size") % 3 != 0).alias("optional"), F.col("p_retailprice").alias("salience"), F.col("p_size").alias("display_order"), F.when(k % 5 > 0, k - k % 5).alias("parent"))
    return budget.cap_layers(p, "document", 30).select("document", "id")


@query(f"""WITH {BOXES}, l AS (SELECT image AS document, id, (x1 - x0) * (y1 - y0) AS area, 12720 AS canvas, price / 2000 AS score, ['text_raster', 'object', 'detail_group'][size % 3 + 1] AS category FROM boxes) SELECT document, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY CASE category WHEN 'text_raster' THEN 3 WHEN 'object' THEN 2 ELSE 1 END DESC, sqrt(area / canvas::DOUBLE) * score DESC, id) AS rank FROM l) WHERE rank <= 10""")
def priority_cap(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    l = b.select(F.col("image").alias("document"), "id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), F.lit(12720).alias("canvas"), (F.col("price") / 2000).alias("score"), F.when(F.col("size") % 3 == 0, "text_raster").when(F.col("size") % 3 == 1, "object").otherwise("detail_group").alias("category"))  # noqa: E741
    return budget.priority_cap(l, "document", 10).select("document", "id", "rank")


@query("SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_type DESC, event_id) AS rank FROM events) WHERE rank <= 2")
def per_layer_topk(spark: SparkSession, d: str) -> DataFrame:
    return budget.top_each(table(spark, d, "events"), ["user_id"], [F.col("value"), F.desc("event_type"), F.col("event_id")], 2).select("user_id", "event_id", "rank")


@query("SELECT event_id, value FROM events ORDER BY event_type <> 'purchase', value, event_id LIMIT 5")
def worst_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.col("event_type") != "purchase", "value", "event_id").limit(5).select("event_id", "value")


@query(fold_sql.FONTS)
def font_selection(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "nation").select(F.col("n_nationkey").alias("text_id"), F.transform(F.filter(F.split("n_name", ""), lambda c: c != ""), lambda c: F.ascii(c)).alias("points"))
    fonts = spark.createDataFrame([(1, "Arial", "Bold", "/a.ttf", list(range(32, 127))), (2, "Arial", "Regular", "/b.ttf", list(range(32, 127))), (3, "Tahoma", "Italic", "/c.ttf", list(range(32, 91)))], "font_id int, family string, subfamily string, path string, codepoints array<int>")
    return budget.select_font(texts, fonts, ["Arial", "Tahoma"])


LADDER = """c AS (SELECT c_custkey % 5 AS candidate, c_custkey AS crop, c_acctbal > 0 AS retention, c_nationkey % 4 > 0 AS edge, c_nationkey % 5 > 0 AS energy, c_acctbal AS ssim FROM customer), f AS (SELECT candidate, avg((retention AND edge AND energy)::INT) AS gate, avg(retention::INT) AS retained, avg(edge::INT) AS edged, avg(energy::INT) AS energetic, quantile_cont(ssim, 0.1) AS ssim, count(*) AS n FROM c GROUP BY 1), p AS (SELECT *, gate >= 0.4 AS passed FROM f)"""


@query(f"""WITH {LADDER}, r AS (SELECT *, row_number() OVER (ORDER BY passed DESC, gate DESC, retained DESC, edged DESC, energetic DESC, ssim DESC, candidate) AS rank FROM p), control AS (SELECT * FROM p WHERE candidate = 0), deep AS (SELECT * FROM r WHERE candidate > 0 AND passed ORDER BY rank LIMIT 1)
SELECT candidate, rank, round(gate, 6) AS gate, passed, CASE WHEN (SELECT passed FROM control) THEN CASE WHEN (SELECT d.gate - c.gate >= greatest(0.02, 2.0 / c.n) AND d.retained >= c.retained FROM deep d, control c) THEN candidate = (SELECT candidate FROM deep) ELSE candidate = 0 END ELSE coalesce(candidate = (SELECT candidate FROM deep), false) END AS selected FROM r""")
def ladder_select(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.selection import ladder

    c = table(spark, d, "customer").select((F.col("c_custkey") % 5).alias("candidate"), (F.col("c_acctbal") > 0).alias("retention"), (F.col("c_nationkey") % 4 > 0).alias("edge"), (F.col("c_nationkey") % 5 > 0).alias("energy"), F.col("c_acctbal").alias("ssim"))
    return ladder(c, least=0.4).select("candidate", "rank", F.round("gate", 6).alias("gate"), "passed", "selected")
