"""Rectangle joins by grid cells, and the relations built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, area, box, gap_x, intersection, iou, share, vertical_overlap


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], *, cell: int = 32, reach: int = 0, reach_y: int | None = None, lp: str = "a_", rp: str = "b_") -> DataFrame:
    """Pairs of boxes of one image whose boxes, each grown by ``reach`` pixels (up and down by ``reach_y`` where given), meet; columns get the two prefixes.

    Both sides are dealt to grid cells and joined on (on, cell). A pair is kept only in the cell that holds the first corner of its common area, so no pair comes twice and no
    distinct is needed. A cell is as long as a box grows, at least, so that a box falls into two or three along an axis. A hot image is split by its cells.
    The sides are merged, never broadcast: Spark estimates a dealt side by the file it comes from, far too small.
    """
    by = {"x": reach, "y": reach if reach_y is None else reach_y}
    long = {axis: max(cell, 2 * r) for axis, r in by.items()}

    def dealt(df: DataFrame, p: str) -> DataFrame:
        d = df.select(*on, *[F.col(c).alias(p + c) for c in df.columns if c not in on])
        for z, r in by.items():
            first, last = F.col(f"{p}{z}0") - r, F.greatest(F.col(f"{p}{z}1") - 1, F.col(f"{p}{z}0")) + r
            d = d.withColumn(f"_{p}{z}", F.floor(first / long[z])).withColumn(f"_c{z}", F.explode(F.sequence(F.col(f"_{p}{z}"), F.floor(last / long[z]))))
        return d

    a, b = dealt(left, lp), dealt(right, rp).hint("merge")
    meets = lambda z: F.least(f"{lp}{z}1", f"{rp}{z}1") + 2 * by[z] > F.greatest(f"{lp}{z}0", f"{rp}{z}0")
    first = lambda z: F.col(f"_c{z}") == F.greatest(f"_{lp}{z}", f"_{rp}{z}")
    return a.join(b, [*on, "_cx", "_cy"]).where(meets("x") & meets("y") & first("x") & first("y")).drop(*[f"_{k}{z}" for k in ("c", lp, rp) for z in by])


def iou_pairs(boxes: DataFrame, on: list[str], key: str, least: float, cell: int = 32) -> DataFrame:
    """(on, a, b, iou) of the pairs of one image, a < b, from a threshold on."""
    j = overlap_join(boxes, boxes, on, cell=cell).where(F.col(f"a_{key}") < F.col(f"b_{key}"))
    return j.select(*on, F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), iou(box("a_"), box("b_")).alias("iou")).where(F.col("iou") >= least)


def smallest_container(inner: DataFrame, outer: DataFrame, on: list[str], key: str, least: float = 0.88) -> DataFrame:
    """The smallest outer box that holds ``least`` of each inner box; ties go to the smaller key. Inner boxes without one are absent."""
    j = overlap_join(inner, outer, on)
    inside = intersection(box("a_"), box("b_")) / F.greatest(F.lit(1), area(box("a_")))
    hit = j.where((inside >= least) & (F.col(f"a_{key}") != F.col(f"b_{key}")))
    best = hit.groupBy(*on, F.col(f"a_{key}").alias("inner")).agg(F.min(F.struct(area(box("b_")).alias("area"), F.col(f"b_{key}").alias("outer"))).alias("m"))
    return best.select(*on, "inner", F.col("m.outer").alias("outer"), F.col("m.area").alias("outer_area"))


def parents(layers: DataFrame, on: list[str], key: str, pixels: str, inside_pixels: Column | None = None) -> DataFrame:
    """Each layer's parent: the layer of fewest pixels that is no text, larger in pixels (1.05) or box (1.08), and holds 0.62 of its pixels or 0.88 of its box at up to 14 times the box.

    inside_pixels: the pixels that child (a_) and parent (b_) share; the boxes' common area where not given.
    """
    j = overlap_join(layers, layers, on).where(F.col(f"a_{key}") != F.col(f"b_{key}"))
    ca, pa, cb, pb = F.col(f"a_{pixels}"), F.col(f"b_{pixels}"), area(box("a_")), area(box("b_"))
    both = intersection(box("a_"), box("b_"))
    shared = both if inside_pixels is None else inside_pixels
    large = ~((pa < ca * 1.05) & (pb < cb * 1.08))
    holds = (share(shared, ca) >= 0.62) | ((both / F.greatest(F.lit(1), cb) >= 0.88) & (pb / F.greatest(F.lit(1), cb) <= 14.0))
    hit = j.where((F.col("b_category") != "text_raster") & large & holds)
    return hit.groupBy(*on, F.col(f"a_{key}").alias("child")).agg(F.min(F.struct(pa.alias("pixels"), F.col(f"b_{key}").alias("parent"))).alias("m")).select(*on, "child", F.col("m.parent").alias("parent"))


def owners(parts: DataFrame, part: str, owner: str, coverage: Column, least: float = 0.72) -> DataFrame:
    """The owner that covers most of each part, the first of equals; null below ``least``. One combining aggregate."""
    best = parts.groupBy(part).agg(F.min(F.struct((-coverage).alias("minus"), F.col(owner).alias("owner"))).alias("m"))
    return best.select(part, F.when(-F.col("m.minus") >= least, F.col("m.owner")).alias("owner"), (-F.col("m.minus")).alias("coverage"))


def best_text_match(drafts: DataFrame, layers: DataFrame, on: list[str], key: str) -> DataFrame:
    """The layer whose overlap (0.30) or containment (0.62) with a draft is largest."""
    j = overlap_join(drafts, layers, on)
    both = intersection(box("a_"), box("b_"))
    held = both / F.greatest(F.lit(1), F.least(area(box("a_")), area(box("b_"))))
    over = iou(box("a_"), box("b_"))
    hit = j.where((over >= 0.30) | (held >= 0.62)).withColumn("match", F.greatest(over, held))
    return hit.groupBy(*on, F.col(f"a_{key}").alias("draft")).agg(F.max(F.struct("match", (-F.col(f"b_{key}")).alias("minus"))).alias("m")).select(*on, "draft", (-F.col("m.minus")).alias("layer"), F.col("m.match").alias("match"))


def semantic_hints(boxes: DataFrame, detections: DataFrame, on: list[str], key: str, most: int = 4) -> DataFrame:
    """The best detections that share 0.15 of a box or have an IoU of 0.08 with it, by score, then label."""
    j = overlap_join(boxes, detections, on)
    both = intersection(box("a_"), box("b_"))
    hit = j.where((both / F.greatest(F.lit(1), area(box("a_"))) >= 0.15) | (iou(box("a_"), box("b_")) >= 0.08))
    w = Window.partitionBy(*on, f"a_{key}").orderBy(F.desc("b_score"), "b_label", f"b_{key}")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*on, F.col(f"a_{key}").alias("box"), "rank", F.col("b_label").alias("label"), F.col("b_score").alias("score"))


def label_overlaps(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct pairs of non-zero labels that share a pixel."""
    a = left.where("label > 0").select(*on, "y", "x", F.col("label").alias("left"))
    b = right.where("label > 0").select(*on, "y", "x", F.col("label").alias("right"))
    return a.join(b, [*on, "y", "x"]).groupBy(*on, "left", "right").agg(F.count(F.lit(1)).alias("pixels"))


def topology_relations(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Per image: expected pixels without actual ones, actual components without expected ones, and merged and split components."""
    pairs = label_overlaps(expected, actual, on)
    per_right = pairs.groupBy(*on, "right").agg(F.count(F.lit(1)).alias("n"))
    per_left = pairs.groupBy(*on, "left").agg(F.count(F.lit(1)).alias("n"))
    e, a = expected.where("label > 0"), actual.where("label > 0")
    missing = e.join(a.select(*on, "y", "x"), [*on, "y", "x"], "left_anti").groupBy(*on).agg(F.count(F.lit(1)).alias("missing_expected_pixels"))
    orphan = a.select(*on, F.col("label").alias("right")).distinct().join(per_right, [*on, "right"], "left_anti").groupBy(*on).agg(F.count(F.lit(1)).alias("orphan_actual_components"))
    merged = per_right.where("n > 1").groupBy(*on).agg(F.count(F.lit(1)).alias("merged_actual_components"))
    split = per_left.where("n > 1").groupBy(*on).agg(F.count(F.lit(1)).alias("split_expected_components"))
    out = expected.select(*on).union(actual.select(*on)).distinct()
    names = ("missing_expected_pixels", "orphan_actual_components", "merged_actual_components", "split_expected_components")
    for part in (missing, orphan, merged, split):
        out = out.join(part, on, "left")
    out = out.select(*on, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return out.withColumn("passed", F.greatest(*names) == 0)


def colour_distance(p: str, q: str, names: tuple[str, ...] = ("l", "a", "b")) -> Column:
    total = sum((F.col(p + n) - F.col(q + n)) * (F.col(p + n) - F.col(q + n)) for n in names)
    return F.sqrt(total)


def row_related(a: Box, b: Box, lab: Column) -> Column:
    """Components of one text row: like heights, the same height on the page, near each other, of like colour."""
    ha, hb = a.y1 - a.y0, b.y1 - b.y0
    low, high = F.least(ha, hb), F.greatest(ha, hb)
    shared = F.greatest(F.lit(0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return (low / F.greatest(F.lit(1), high) >= 0.62) & (shared / F.greatest(F.lit(1), low) >= 0.58) & (gap_x(a, b) <= 0.78 * high) & (lab <= 32.0)


def near_group(a: Box, b: Box, width: Column, height: Column) -> Column:
    """Parts of one object: a small gap for the canvas, and a common box that is not too large for it."""
    dx = F.greatest(F.lit(0), F.greatest(a.x0, b.x0) - F.least(a.x1, b.x1))
    dy = F.greatest(F.lit(0), F.greatest(a.y0, b.y0) - F.least(a.y1, b.y1))
    wide = F.greatest(a.x1, b.x1) - F.least(a.x0, b.x0)
    tall = F.greatest(a.y1, b.y1) - F.least(a.y0, b.y0)
    return (F.hypot(dx, dy) <= 0.023 * F.hypot(height, width)) & (wide <= 0.43 * width) & (tall <= 0.30 * height)


def same_visual_row(a: Box, b: Box, ha: Column, hb: Column) -> Column:
    """Word groups of one line: like median heights, the same height and base line, near each other; colour may change."""
    high = F.greatest(ha, hb)
    shared = F.greatest(F.lit(0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return (
        (F.least(ha, hb) / F.greatest(F.lit(1.0), high) >= 0.58)
        & (shared / F.greatest(F.lit(1), F.least(a.y1 - a.y0, b.y1 - b.y0)) >= 0.52)
        & (F.abs(a.y1 - b.y1) <= 0.28 * high)
        & (F.greatest(F.lit(0), F.greatest(a.x0, b.x0) - F.least(a.x1, b.x1)) <= 1.65 * high)
    )


def should_join(a: Box, b: Box, inside_a: Column, inside_b: Column, colour: Column, width: Column, height: Column, over: Column | None = None) -> Column:
    """Residual masks that belong together: one in the other, on one row, or near parts of a small object. over: the boxes' IoU where it is at hand; spelled out here it takes a join's code over the 8,000 bytes that the JVM compiles."""
    ha, hb, wa, wb = a.y1 - a.y0, b.y1 - b.y0, a.x1 - a.x0, b.x1 - b.x0
    high = F.greatest(ha, hb)
    row = (vertical_overlap(a, b) > 0.42) & (high / F.greatest(F.lit(1), F.least(ha, hb)) < 3.2) & (gap_x(a, b) < 1.35 * high) & (colour < 82.0)
    parts = ((iou(a, b) if over is None else over) > 0.08) & (F.greatest(wa, wb) < width * 0.32) & (high < height * 0.32) & (colour < 105.0)
    return (inside_a > 0.86) | (inside_b > 0.86) | row | parts


def mask_relations(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Areas, common area, IoU and containment of masks given as pixel rows (on, mask, y, x); 0 where a denominator is."""
    sa = a.groupBy(*on, F.col("mask").alias("a")).agg(F.count(F.lit(1)).alias("area_a"))
    sb = b.groupBy(*on, F.col("mask").alias("b")).agg(F.count(F.lit(1)).alias("area_b"))
    both = a.select(*on, "y", "x", F.col("mask").alias("a")).join(b.select(*on, "y", "x", F.col("mask").alias("b")), [*on, "y", "x"]).groupBy(*on, "a", "b").agg(F.count(F.lit(1)).alias("common"))
    j = both.join(sa, [*on, "a"]).join(sb, [*on, "b"])
    return j.withColumn("iou", share(F.col("common"), F.col("area_a") + F.col("area_b") - F.col("common"))).withColumn("a_in_b", share(F.col("common"), F.col("area_a"))).withColumn("b_in_a", share(F.col("common"), F.col("area_b")))
