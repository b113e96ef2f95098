"""Tiles, crops, seams and coverage along an axis, as arrays and exploded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import cosine_taper, half_even


def starts(length: Column, tile: Column, overlap: Column) -> Column:
    """Evenly spaced starts of tiles that cover a length; one at 0 if it fits."""
    n = F.ceil((length - tile) / (tile - overlap)).cast("int")
    return F.when(length <= tile, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), lambda i: half_even(i * (length - tile) / n)))


def tile_rows(df: DataFrame, keys: list[str], length: Column, tile: Column, overlap: Column) -> DataFrame:
    """(keys, i, start, left, right): each tile with its overlaps with the neighbours."""
    s = df.select(*keys, tile.alias("_tile"), F.posexplode(starts(length, tile, overlap)).alias("i", "start"))
    w = Window.partitionBy(*keys).orderBy("i")
    side = lambda c: F.coalesce(F.greatest(F.lit(0), c), F.lit(0)).cast("long")
    return s.select(*keys, "i", "start", side(F.lag("start").over(w) + F.col("_tile") - F.col("start")).alias("left"), side(F.col("start") + F.col("_tile") - F.lead("start").over(w)).alias("right"))


def crop_origins(length: Column, crop: Column, grid: int) -> Column:
    """Stratified crop origins along an axis, sorted, each once."""
    n = F.least(F.lit(grid), F.greatest(F.lit(2), F.ceil(length / crop))).cast("int")
    many = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: half_even(i * (length - crop) / (n - 1)))))
    return F.when(length <= crop, F.array(F.lit(0).cast("long"))).otherwise(many)


def covered(intervals: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """The length of the union of each group's intervals. Islands come from the running end of those before."""
    w = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(hi).over(w)
    d = intervals.withColumn("_new", F.greatest(F.lit(0), F.col(hi) - F.greatest(F.col(lo), F.coalesce(before, F.col(lo)))))
    return d.groupBy(*keys).agg(F.sum("_new").alias("covered"))


def grid_bounds(length: Column, parts: int = 4) -> Column:
    """(start, end) of the parts of an axis."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(half_even(i * length / parts).alias("start"), half_even((i + 1) * length / parts).alias("end")))


def seams(df: DataFrame, keys: list[str], start: str, tile: Column, ratio: float, limit: Column) -> DataFrame:
    """Output positions of the middles of tile overlaps, those within the canvas."""
    w = Window.partitionBy(*keys).orderBy(start)
    at = df.withColumn("seam", half_even((F.col(start) + tile + F.lead(start).over(w)) / 2.0 * ratio))
    return at.where(F.col("seam").isNotNull() & (F.col("seam") >= 1) & (F.col("seam") < limit)).select(*keys, "seam")


def boundary_steps(pixels: DataFrame, keys: list[str], axis: str = "x", value: str = "v") -> DataFrame:
    """The mean absolute step across every boundary of an axis: one self-join on the neighbour."""
    other = "y" if axis == "x" else "x"
    a = pixels.select(*keys, F.col(axis).alias("p"), F.col(other).alias("o"), F.col(value).alias("v1"))
    b = pixels.select(*keys, (F.col(axis) + 1).alias("p"), F.col(other).alias("o"), F.col(value).alias("v0"))
    return a.join(b, [*keys, "p", "o"]).groupBy(*keys, "p").agg(F.avg(F.abs(F.col("v1") - F.col("v0"))).alias("step"))


def seam_probe(steps: DataFrame, positions: DataFrame, keys: list[str], offsets: tuple[int, ...] = (-30, -20, -10, 10, 20, 30)) -> DataFrame:
    """Each seam's step against the median of its neighbours'; ratio over 1e-9 at least."""
    near = positions.select(*keys, "seam", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("o")).select(*keys, "seam", (F.col("seam") + F.col("o")).alias("p"))
    middle = near.join(steps, [*keys, "p"]).groupBy(*keys, "seam").agg(F.median("step").alias("near"))
    own = positions.join(steps.withColumnRenamed("p", "seam"), [*keys, "seam"])
    j = own.join(middle, [*keys, "seam"], "left").withColumn("near", F.coalesce("near", F.lit(0.0)))
    return j.withColumn("ratio", F.col("step") / F.greatest(F.lit(1e-9), F.col("near")))


def continuous(probe: DataFrame, keys: list[str]) -> DataFrame:
    """likely_continuous: the median ratio is 1.15 at most and the largest 1.75."""
    g = probe.groupBy(*keys).agg(F.median("ratio").alias("median_ratio"), F.max("ratio").alias("max_ratio"), F.count(F.lit(1)).alias("seams"))
    return g.withColumn("likely_continuous", (F.col("median_ratio") <= 1.15) & (F.col("max_ratio") <= 1.75))


def blended(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Tile predictions (keys, tile, x, y, v and the tile's geometry tx, ty, tile_w, tile_h, left, right, top, bottom) merged by taper weights: sum(w v) / sum(w)."""
    w = cosine_taper(F.col("x") - F.col("tx"), F.col("tile_w"), F.col("left"), F.col("right")) * cosine_taper(F.col("y") - F.col("ty"), F.col("tile_h"), F.col("top"), F.col("bottom"))
    return tiles.withColumn("_w", w).groupBy(*keys, "y", "x").agg((F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("v"))


def ladder(requested: Column, alignment: Column, overlap: Column) -> Column:
    """(tile, overlap) to try when memory runs out: the requested size, then the fixed smaller ones, aligned, with overlaps in proportion."""
    sizes = F.concat(F.array(requested.cast("long")), F.array(*[F.lit(x).cast("long") for x in (384, 320, 256, 192, 160, 128)]))

    def pair(v: Column) -> Column:
        t = v - F.pmod(v, alignment)
        lap = half_even(t * (overlap / requested) / alignment) * alignment
        return F.struct(t.alias("tile"), F.greatest(alignment.cast("long"), F.least(lap, F.floor(t / 2))).alias("overlap"))

    return F.array_distinct(F.filter(F.transform(sizes, pair), lambda p: (p["tile"] <= requested) & (p["tile"] >= 64)))


def reflected(i: Column, length: Column) -> Column:
    """The source place of a padded place: mirrored at the ends again and again, the only place of an axis of one."""
    period = 2 * (length - 1)
    k = F.pmod(i, F.greatest(period, F.lit(1)))
    return F.when(length == 1, F.lit(0)).otherwise(F.when(k < length, k).otherwise(period - k))
