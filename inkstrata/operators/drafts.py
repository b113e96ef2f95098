"""Drafts of layers and text rows: ordered gates as column expressions, protected pixels taken out by anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from .spatial import overlap_join, row_related


def owner_panel(area: Column, canvas: Column, width: Column, height: Column) -> Column:
    """Large well filled components: cards (0.075 of the canvas) or bars (three times as wide as high) from 0.035 of it on."""
    share, aspect, fill = area / canvas, width / F.greatest(F.lit(1), height), area / F.greatest(F.lit(1), width * height)
    return (share >= 0.035) & ((share >= 0.075) | (aspect >= 3.0)) & (fill >= 0.55)


def bar_siblings(parts: DataFrame, on: list[str], key: str, canvas: Column, width: Column) -> DataFrame:
    """(on, bar, sibling): pieces of one raw mask beside a bar, on its height (0.72), not tiny (0.003 of the canvas), near it (0.18 of the width)."""
    cols = [*on, "raw_id", key, "x0", "y0", "x1", "y1", "area"]
    a = parts.where("is_bar").select(*cols)
    j = a.select(*on, "raw_id", *[F.col(c).alias(f"a_{c}") for c in cols if c not in (*on, "raw_id")]).join(parts.select(*on, "raw_id", *[F.col(c).alias(f"b_{c}") for c in cols if c not in (*on, "raw_id")]), [*on, "raw_id"])
    lap = F.greatest(F.lit(0), F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"))
    low = F.greatest(F.lit(1), F.least(F.col("a_y1") - F.col("a_y0"), F.col("b_y1") - F.col("b_y0")))
    gap = F.greatest(F.lit(0), F.greatest("a_x0", "b_x0") - F.least("a_x1", "b_x1"))
    fit = (F.col(f"a_{key}") != F.col(f"b_{key}")) & (lap / low >= 0.72) & (F.col("b_area") / canvas >= 0.003) & (gap <= 0.18 * width)
    return j.where(fit).select(*on, F.col(f"a_{key}").alias("bar"), F.col(f"b_{key}").alias("sibling"))


def child_object(total_area: Column, canvas: Column, width: Column, height: Column, contrast: Column, shortest_side: Column) -> Column:
    """Groups that are worth a layer of their own on a panel: large enough, of moderate proportions, not a strip, different from the panel."""
    aspect = width / F.greatest(F.lit(1), height)
    return (total_area / canvas >= 0.0025) & aspect.between(0.25, 3.8) & (F.least(width, height) >= 0.048 * shortest_side) & (contrast >= 18.0)


def accent_of(mark: Box, row: Box, share: Column, width: Column, height: Column) -> Column:
    """Small marks just above a row and within its sides are its accents."""
    return (
        (mark.x1 - mark.x0 < 0.25 * width)
        & (mark.x0 >= row.x0 - 0.03 * width)
        & (mark.x1 <= row.x1 + 0.03 * width)
        & ((mark.y0 + mark.y1) / 2.0 < (row.y0 + row.y1) / 2.0)
        & (mark.y0 <= row.y0 + 0.20 * (row.y1 - row.y0))
        & (F.greatest(F.lit(0), row.y0 - mark.y1) <= 0.035 * height)
        & (share < 0.01)
    )


def text_rejection(text: Column, confidence: Column, b: Box, canvas: Column, best_match: Column, occupancy: Column, support: Column, span: Column, width: Column) -> Column:
    """Why a recognised line makes no draft: the first reason that holds, or null. confidence is 0 to 100."""
    w, h = b.x1 - b.x0, b.y1 - b.y0
    area = F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)
    weak = (support < 0.10) | (occupancy < 0.025) | (span < 0.28)
    wide = (w / F.greatest(F.lit(1), h) > 14.0) | (w / F.greatest(F.lit(1), width) > 0.85) | (area / canvas > 0.20)
    return (
        F.when(~F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False)), "non_alphanumeric_text")
        .when(F.coalesce(F.isnan(confidence) | (F.abs(confidence) == float("inf")) | (confidence < 0), F.lit(True)), "invalid_confidence")
        .when((w < 3) | (h < 3), "tiny_box")
        .when(~(area / canvas).between(0.00008, 0.38), "implausible_box_area")
        .when(F.coalesce(best_match, F.lit(0.0)) < 0.43, "no_sam_support")
        .when(~occupancy.between(0.015, 0.85), "implausible_text_occupancy")
        .when(support < 0.015, "weak_sam_support")
        .when((confidence < 35.0) & weak, "low_confidence_weak_geometry")
        .when(wide & ((support < 0.06) | (span < 0.55)), "wide_box_weak_geometry")
    )


def text_quality(best_match: Column, confidence: Column, support: Column) -> Column:
    return best_match * 0.58 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence / 100.0)) * 0.27 + F.least(F.lit(1.0), support) * 0.15


def visual_rejection(n: Column, width: Column, height: Column, parent_w: Column, parent_h: Column, median_h: Column, height_ratio: Column, baseline_spread: Column, coverage: Column, occupancy: Column, ring: Column, contrast: Column) -> Column:
    """Why a row of marks without recognised text makes no draft: the first reason that holds, or null."""
    most = F.when(parent_w / F.greatest(F.lit(1), parent_h) >= 5.0, 0.78).otherwise(0.40)
    shape = (width / F.greatest(F.lit(1), height) < 1.65) | (width / parent_w < 0.11) | (height / parent_h > most) | (median_h < F.greatest(F.lit(4.0), parent_h * 0.035)) | (height_ratio < 0.52)
    return (
        F.when(n < 3, "too_few_components")
        .when(shape, "implausible_row_geometry")
        .when(baseline_spread > 0.28, "unstable_baseline")
        .when(~coverage.between(0.28, 1.35), "implausible_horizontal_coverage")
        .when(~occupancy.between(0.10, 0.82), "implausible_visual_occupancy")
        .when(ring < 16, "missing_local_background")
        .when(contrast < 16.0, "low_local_contrast")
    )


def visual_quality(score: Column, n: Column, width: Column, parent_w: Column, baseline_spread: Column, contrast: Column) -> Column:
    one = F.lit(1.0)
    return (
        score * 0.28
        + F.least(one, n / 12.0) * 0.20
        + F.least(one, width / F.greatest(one, parent_w * 0.68)) * 0.18
        + F.greatest(F.lit(0.0), 1.0 - baseline_spread / 0.28) * 0.17
        + F.least(one, contrast / 55.0) * 0.17
    )


def row_statistics(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Per row: its box, how many parts, their median height, how alike heights are, how far base lines spread (in heights), how much of the width parts cover."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    s = parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.median(h).alias("median_h"), (F.min(h) / F.greatest(F.lit(1), F.max(h))).alias("height_ratio"),
        F.stddev_pop("y1").alias("_sd"), F.sum(w).alias("_w"), F.avg("score").alias("score"),
    )
    return s.withColumn("baseline_spread", F.col("_sd") / F.greatest(F.lit(1.0), F.col("median_h"))).withColumn("coverage", F.col("_w") / F.greatest(F.lit(1), F.col("x1") - F.col("x0"))).drop("_sd", "_w")


def trimmed_rows(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of four parts or more lose parts that are far wider than the median (1.9) and wide themselves (1.4), if two stay; then rows of three, or wider than high by 1.05, remain."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    every = Window.partitionBy(*keys)
    m = parts.groupBy(*keys).agg(F.median(w).alias("_m"), F.count(F.lit(1)).alias("_n"))
    d = parts.join(m.hint("merge"), keys).withColumn("_wide", (w > 1.9 * F.col("_m")) & (w / F.greatest(F.lit(1), h) > 1.40) & (F.col("_n") >= 4))
    d = d.withColumn("_left", F.sum((~F.col("_wide")).cast("int")).over(every)).where(~F.col("_wide") | (F.col("_left") < 2))
    box = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), ((F.max("x1") - F.min("x0")) / F.greatest(F.lit(1), F.max("y1") - F.min("y0"))).alias("_a"))
    ok = box.where((F.col("_k") >= 3) | ((F.col("_k") >= 2) & (F.col("_a") >= 1.05))).select(*keys)
    return d.join(ok.hint("merge"), keys, "left_semi").select(*parts.columns)


def row_edges(parts: DataFrame, on: list[str], key: str, lab: Column, reach: int = 32) -> DataFrame:
    """Pairs of parts on one row; the components of these pairs are the rows. Twice the reach bounds 0.78 times the largest height; rows share height, so nothing grows up or down."""
    from ..functions.geometry import box

    j = overlap_join(parts, parts, on, reach=reach, reach_y=0).where(F.col(f"a_{key}") < F.col(f"b_{key}"))
    return j.where(row_related(box("a_"), box("b_"), lab)).select(*on, F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"))


def without_protected(drafts: DataFrame, protected: DataFrame, on: list[str], least: float = 0.12) -> tuple[DataFrame, DataFrame]:
    """(pixels, fate): draft pixels (on, draft, y, x) that no protected pixel (on, y, x) covers; a draft of which under ``least`` stays is dropped."""
    cut = drafts.join(protected.select(*on, "y", "x").distinct(), [*on, "y", "x"], "left_anti")
    before = drafts.groupBy(*on, "draft").agg(F.count(F.lit(1)).alias("before"))
    after = cut.groupBy(*on, "draft").agg(F.count(F.lit(1)).alias("after"))
    fate = before.join(after, [*on, "draft"], "left").select(*on, "draft", (1 - F.coalesce("after", F.lit(0)) / F.col("before")).alias("removed"))
    fate = fate.withColumn("reason", F.when(1 - F.col("removed") < least, "protected_overlap_left_weak_text"))
    return cut.join(fate.where("reason is null").select(*on, "draft"), [*on, "draft"], "left_semi"), fate
