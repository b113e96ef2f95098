"""Recognition: words to lines, readings to a vote, confidence gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..functions.text import is_critical

PADDLE, TESSERACT = "paddle_ppocrv6_medium", "tesseract_vie"


def assemble_lines(words: DataFrame, keys: list[str], *, order: str = "ord", scale: float = 1.0) -> DataFrame:
    """Words (left, top, width, height, conf in 0-100, text) to lines: the enclosing box, the mean confidence in 0-1, the texts in row order.

    Words without text or with a negative confidence don't count.
    """
    good = words.where((F.col("conf") >= 0) & (F.trim("text") != ""))
    at = lambda c: half_even(c / scale)
    return good.groupBy(*keys).agg(
        at(F.min("left")).alias("x0"),
        at(F.min("top")).alias("y0"),
        at(F.max(F.col("left") + F.col("width"))).alias("x1"),
        at(F.max(F.col("top") + F.col("height"))).alias("y1"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("conf") / 100)).alias("confidence"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda w: w["text"]), " ").alias("text"),
    )


def weighted_vote(readings: DataFrame, cluster: str = "cluster") -> DataFrame:
    """The winning text of each cluster of (text, engine, confidence).

    A reading weighs its confidence, 0.05 at least, times 1 for the primary engine or 0.82 for others. Votes are rounded to nine decimals, so that equal sums stay
    equal in any order of addition; ties go to more engines, then to the larger text. Partial sums by (cluster, text) precede the shuffle.
    """
    weight = F.when(F.col("engine").startswith("paddle"), 1.0).otherwise(0.82)
    best = lambda engine: F.max(F.when(F.col("engine") == engine, F.col("confidence")))
    by_text = readings.groupBy(cluster, "text").agg(
        F.round(F.sum(F.greatest(F.lit(0.05), F.col("confidence")) * weight), 9).alias("votes"),
        F.size(F.collect_set("engine")).cast("long").alias("engines"),  # a handful of names
        F.max("confidence").alias("strongest"),
        best(PADDLE).alias("paddle"),
        best(TESSERACT).alias("tesseract"),
    )
    # max over a struct combines before the shuffle; a window would sort every reading
    best = by_text.groupBy(cluster).agg(F.max(F.struct("votes", "engines", "text", "strongest", "paddle", "tesseract")).alias("w"))
    return best.select(cluster, "w.text", "w.votes", "w.engines", "w.strongest", "w.paddle", "w.tesseract")


def gated(votes: DataFrame) -> DataFrame:
    """status (green, yellow, red) and the ordered reasons of each winning text."""
    both = F.col("paddle").isNotNull() & F.col("tesseract").isNotNull()
    gate = F.coalesce(both & (F.col("paddle") >= 0.84) & (F.col("tesseract") >= 0.70), F.lit(False))
    critical = is_critical(F.col("text"))
    red = ~F.coalesce(F.col("text").rlike("[0-9A-Za-zÀ-ỹĐđ]"), F.lit(False)) | (F.col("strongest") < 0.38)
    reasons = F.array(
        F.when(critical, F.lit("protected_or_numeric_content_requires_approval")),
        F.when(~both, F.lit("no_independent_engine_agreement")).when(~gate, F.lit("independent_engine_confidence_below_green_gate")),
        F.when(~gate, F.lit("recognition_confidence_below_green_gate")),
        F.when(red, F.lit("unreadable_text_requires_user_entry")),
    )
    return votes.withColumn("critical", critical).withColumn("status", F.when(red, "red").when(critical | ~gate, "yellow").otherwise("green")).withColumn("reasons", F.array_compact(reasons))


def reading_order(regions: DataFrame, document: list[str]) -> DataFrame:
    """region_id text_0001 and on, by top, then left edge, within each document."""
    w = Window.partitionBy(*document).orderBy("y0", "x0")
    return regions.withColumn("region_id", F.format_string("text_%04d", F.row_number().over(w)))


def median_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(*[half_even(F.median(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def status_counts(regions: DataFrame, keys: list[str]) -> DataFrame:
    return regions.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("green", "yellow", "red")])


def realigned(groups: DataFrame, keys: list[str], *, order: str = "ord", text: str = "text", proposed: str = "proposed") -> DataFrame:
    """The words of each group's proposal handed back to its members by their own word counts; null (aligned = false) where the totals differ."""
    count = lambda c: F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))
    w = Window.partitionBy(*keys)
    before = F.sum("words").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    d = groups.withColumn("words", count(F.col(text))).withColumn("start", F.coalesce(before, F.lit(0)) + 1).withColumn("total", F.sum("words").over(w))
    ok = F.col("total") == count(F.col(proposed))
    part = F.array_join(F.slice(F.split(F.trim(F.col(proposed)), r"\s+"), F.col("start").cast("int"), F.col("words").cast("int")), " ")
    return d.withColumn("aligned", ok).withColumn("candidate", F.when(ok, part)).drop("words", "start", "total")


def exact_readback(targets: DataFrame, readings: DataFrame, pairs: DataFrame, *, best: int = 2) -> DataFrame:
    """For each target whether one of the readings of its ``best`` nearest regions is its text. pairs: (target, region, iou)."""
    w = Window.partitionBy("target").orderBy(F.desc("iou"), "region")
    top = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best)
    got = top.join(readings, "region").groupBy("target").agg(F.sort_array(F.collect_set("text")).alias("readings"))
    out = targets.join(got, "target", "left")
    return out.withColumn("exact", F.coalesce(F.array_contains("readings", F.col("text")), F.lit(False)))


def stage_status(qa_passed: Column, typography_passed: Column, unresolved: Column, no_text: Column, restore_review: Column) -> Column:
    """FAILED_QA before REVIEW_REQUIRED before PASS."""
    return F.when(~(qa_passed & typography_passed), "FAILED_QA").when(unresolved | no_text | restore_review, "REVIEW_REQUIRED").otherwise("PASS")
