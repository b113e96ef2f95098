"""Top-k under budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiles import covered

ROOT_PRIORITY = {"owner_panel": 4, "standalone_row": 3, "standalone_object": 2, "symmetric_decoration": 1}
CATEGORY_PRIORITY = {"text_raster": 3, "object": 2, "detail_group": 1}


def ranked(value: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, rank in table.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def select_budget(roots: DataFrame, children: DataFrame, document: str, most: int) -> DataFrame:
    """(document, token, kind) of what a budget keeps: roots by role, salience, top, left and token; then, in the places left, children of kept roots by salience and token."""
    w = Window.partitionBy(document).orderBy(F.desc(ranked(F.col("role"), ROOT_PRIORITY)), F.desc("salience"), "y0", "x0", "token")
    kept = roots.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(document, "token")
    left = kept.groupBy(document).agg((F.lit(most) - F.count(F.lit(1))).alias("room"))
    fit = children.join(kept.withColumnRenamed("token", "parent"), [document, "parent"], "left_semi")
    v = Window.partitionBy(document).orderBy(F.desc("salience"), "token")
    below = fit.withColumn("rank", F.row_number().over(v)).join(left, document).where(F.col("rank") <= F.col("room"))
    return kept.select(document, "token", F.lit("root").alias("kind")).union(below.select(document, "token", F.lit("child").alias("kind")))


def cap_layers(layers: DataFrame, document: str, most: int) -> DataFrame:
    """The layers that a cap keeps: mandatory ones in order, then optional ones by salience, order and id; a child without its parent goes."""
    w = Window.partitionBy(document).orderBy(F.col("optional").cast("int"), F.when(F.col("optional"), -F.col("salience")), "display_order", "id")
    kept = layers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
    known = kept.select(document, F.col("id").alias("parent"))
    return kept.where(F.col("parent").isNull()).unionByName(kept.where(F.col("parent").isNotNull()).join(known, [document, "parent"], "left_semi").select(*kept.columns))


def priority_cap(layers: DataFrame, document: str, most: int) -> DataFrame:
    """The first layers by category and by the root of their share of the canvas times their score."""
    weight = F.sqrt(F.col("area") / F.col("canvas")) * F.col("score")
    w = Window.partitionBy(document).orderBy(F.desc(ranked(F.col("category"), CATEGORY_PRIORITY)), F.desc(weight), "id")
    return layers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def top_each(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def select_font(texts: DataFrame, fonts: DataFrame, preferred: list[str], style: str = "") -> DataFrame:
    """The font of each text (points: its code points) with the highest score: coverage, family, style, no unwanted slant; ties by family, style and path.

    fonts is a dimension table; the join is a nested loop over it.
    """
    family, tokens = F.lower("family"), F.split(F.regexp_replace(F.lower("subfamily"), "-", " "), r"\s+")
    wanted = [t for t in style.lower().replace("-", " ").split() if t]
    bonus = F.lit(0.0)
    part = F.lit(0.0)
    for rank in range(len(preferred) - 1, -1, -1):
        name = preferred[rank].lower().strip()
        part = F.greatest(part, F.when(F.contains(family, F.lit(name)) | F.contains(F.lit(name), family), 80.0 - rank * 3.0).otherwise(0.0))
        bonus = F.when(family == name, 180.0 - rank * 5.0).otherwise(bonus)
    bonus = F.when(bonus > 0, bonus).otherwise(part)
    shared = F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in wanted]).cast("array<string>")))
    slanted = F.arrays_overlap(tokens, F.array(F.lit("italic"), F.lit("oblique"), F.lit("slanted"))) & F.lit(not {"italic", "oblique", "slanted"} & set(wanted))
    regular = F.lit(0.0) if wanted else F.when(F.array_contains(tokens, "regular"), 1.0).otherwise(0.0)
    covered = F.when(F.size("points") == 0, 1.0).otherwise(F.size(F.array_intersect("points", "codepoints")) / F.size(F.array_distinct("points")))
    scored = texts.join(fonts, covered >= 0, "inner").withColumn("coverage", covered)
    scored = scored.withColumn("score", F.round(F.col("coverage") * 1000.0 + bonus + 12.0 * shared + regular - F.when(slanted, 30.0).otherwise(0.0), 9))
    best = scored.groupBy("text_id").agg(F.max(F.struct("score", F.lower("family").alias("f"), F.lower("subfamily").alias("s"), F.lower("path").alias("p"), "font_id", "coverage")).alias("m"))
    return best.select("text_id", F.col("m.font_id").alias("font_id"), F.col("m.score").alias("score"), F.col("m.coverage").alias("coverage"))


def largest_fitting(low: Column, high: Column, fits: Callable[[Column], Column], steps: int = 32) -> Column:
    """The largest whole number of [low, high] that fits, by halving; null if none does. ``fits`` must be monotone: what fits a number fits all below it. ``steps`` halvings settle any range under 2^steps."""
    start = F.struct(low.cast("long").alias("lo"), high.cast("long").alias("hi"), F.lit(None).cast("long").alias("best"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2)
        fit = F.coalesce(fits(middle), F.lit(False))
        lo, hi = F.when(fit, middle + 1).otherwise(s["lo"]), F.when(fit, s["hi"]).otherwise(middle - 1)
        moved = F.struct(lo.alias("lo"), hi.alias("hi"), F.when(fit, middle).otherwise(s["best"]).alias("best"))
        return F.when(s["lo"] <= s["hi"], moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["best"])


def font_geometry(candidates: DataFrame, keys: list[str], axis: tuple[Column, Column], measure: Callable[[Column, Column], tuple[Column, Column]], samples: int = 11) -> DataFrame:
    """The font (rank, family, subfamily) and place on its width axis that fill each box (width, height) best.

    ``measure(size, axis value)`` gives width and height of the text, the contract of a shaper. At each of the axis' evenly spaced samples the largest size that fits counts, up to four heights or 8: 100 times the smaller fill, 10 times the common one, 0.05 less a rank.
    Ties go to the lower rank, the later family and subfamily, the lower axis value. Boxes that no font fits have no row."""
    lo, hi = axis
    places = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: lo + (hi - lo) * i / (samples - 1))
    d = candidates.withColumn("axis", F.explode(F.array_distinct(places)))

    def fits(size: Column) -> Column:
        w, h = measure(size, F.col("axis"))
        return (w <= F.col("width")) & (h <= F.col("height"))

    d = d.withColumn("size", largest_fitting(F.lit(1), F.greatest(F.lit(8), F.col("height") * 4), fits)).where("size is not null")
    w, h = measure(F.col("size"), F.col("axis"))
    d = d.withColumn("wide", w / F.col("width")).withColumn("high", h / F.col("height"))
    score = F.round(F.least("wide", "high") * 100 + F.col("wide") * F.col("high") * 10 - F.col("rank") * 0.05, 9)
    best = F.max(F.struct(score.alias("score"), (-F.col("rank")).alias("r"), F.lower("family").alias("f"), F.lower("subfamily").alias("s"), (-F.col("axis")).alias("a"), "family", "subfamily", "rank", "axis", "size"))
    return d.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.family", "b.subfamily", "b.rank", "b.axis", "b.size", "b.score")


def layer_report(layers: DataFrame, image: str, category: str, parent: str, canvas: Column) -> DataFrame:
    """Layers of an image by category, layers with a parent, and the shares of its canvas that all boxes and those without a parent cover together, overlaps once.

    A box is dealt to its pixel rows, and each row's union is a length: at most boxes x height rows, combined by row before anything meets by image."""
    d = layers.select(image, F.col(category).alias("_c"), F.col(parent).isNotNull().alias("_child"), "x0", "y0", "x1", "y1", canvas.alias("_area"))
    counts = d.groupBy(image, "_c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_child").cast("long")).alias("edges"), F.max("_area").alias("_area"))
    counts = counts.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("_c", "n"))).alias("by_category"), F.sum("n").alias("layers"), F.sum("edges").alias("edges"), F.max("_area").alias("_area"))
    rows = d.where("x1 > x0 and y1 > y0").select(image, F.explode(F.sequence("y0", F.col("y1") - 1)).alias("_y"), "x0", "x1", "_child")
    whole = covered(rows, [image, "_y"], "x0", "x1").groupBy(image).agg(F.sum("covered").alias("_all"))
    top = covered(rows.where("not _child"), [image, "_y"], "x0", "x1").groupBy(image).agg(F.sum("covered").alias("_top"))
    share = lambda c: F.round(F.coalesce(c, F.lit(0)) / F.col("_area"), 6)
    j = counts.join(whole, image, "left").join(top, image, "left")
    return j.select(image, "layers", "edges", F.map_from_entries("by_category").alias("by_category"), share("_all").alias("coverage"), share("_top").alias("top_level"))
