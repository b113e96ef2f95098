"""Admission gates: resource plans, print geometry, page boxes, configurations, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GIB = 1024**3
MAX_PAGE_MM, MM, TOLERANCE = 5000.0, 72.0 / 25.4, 1.0
# Hard and soft limits in megapixels.
HARD_RASTER, SOFT_RASTER = 750.0, 500.0
PRINT_HARD_SOURCE, PRINT_SOFT_SOURCE = 64.0, 12.0
LAYER_HARD, LAYER_SOFT = 300.0, 120.0


def _decision(hard: Column, soft: Column, disk: Column, ram: Column) -> Column:
    return F.when(hard, "hard_limit").when(soft, "soft_limit").when(disk, "disk").when(ram, "memory").otherwise("admitted")


def standard(source: Column, output: Column, huge: Column) -> dict[str, Column]:
    """Plain enlargement (source and output in pixels): 16 times the source as master."""
    native, out = source * 16 / 1e6, output / 1e6
    hard = (native > HARD_RASTER) | (out > HARD_RASTER)
    no = F.lit(False)
    return {"native_mp": F.bround(native, 3), "output_mp": F.bround(out, 3), "decision": _decision(hard, (out > SOFT_RASTER) & ~huge, no, no)}


def print_plan(source: Column, proof: Column, full_vector: Column, huge: Column, free_disk: Column, free_ram: Column) -> dict[str, Column]:
    native = source * F.when(full_vector, 4).otherwise(16)
    ram = F.greatest(native * 24, proof * 20) + 2 * GIB
    disk = native * 5 + proof * 12 + GIB
    hard = (source / 1e6 > PRINT_HARD_SOURCE) | (native / 1e6 > HARD_RASTER) | (proof / 1e6 > HARD_RASTER)
    soft = ((source / 1e6 > PRINT_SOFT_SOURCE) | (proof / 1e6 > SOFT_RASTER)) & ~huge
    return {"ram_bytes": ram, "disk_bytes": disk, "ram_gib": F.bround(ram / GIB, 2), "disk_gib": F.bround(disk / GIB, 2), "decision": _decision(hard, soft, disk > free_disk * 0.8, ram > free_ram * 0.85)}


def layer_plan(source: Column, output: Column, layers: Column, huge: Column, free_disk: Column, free_ram: Column) -> dict[str, Column]:
    """Layered output of 4 to 60 layers; before segmentation only 20 bytes a pixel of disk are needed for sure."""
    ram = source * 420 + output * (32 + 5 * layers) + 3 * GIB
    disk = output * (12 + 14 * layers) + 2 * GIB
    least = output * 20 + 2 * GIB
    hard = (source / 1e6 > PRINT_HARD_SOURCE) | (output / 1e6 > LAYER_HARD)
    d = F.when(~layers.between(4, 60), "layer_count").otherwise(_decision(hard, (output / 1e6 > LAYER_SOFT) & ~huge, least > free_disk * 0.8, ram > free_ram * 0.85))
    return {"ram_bytes": ram, "disk_bytes": disk, "least_disk_bytes": least, "ram_gib": F.bround(ram / GIB, 2), "disk_gib": F.bround(disk / GIB, 2), "decision": d}


def repair_plan(source: Column, output: Column, huge: Column, free_disk: Column, free_ram: Column) -> dict[str, Column]:
    ram = source * 150 + output * 24 + 4 * GIB
    disk = source * 30 + output * 14 + GIB
    hard = (source / 1e6 > PRINT_HARD_SOURCE) | (output / 1e6 > LAYER_HARD)
    return {"ram_bytes": ram, "disk_bytes": disk, "ram_gib": F.bround(ram / GIB, 2), "disk_gib": F.bround(disk / GIB, 2), "decision": _decision(hard, (output / 1e6 > LAYER_SOFT) & ~huge, disk > free_disk * 0.8, ram > free_ram * 0.85)}


def print_geometry(width: Column, height: Column, dpi: Column, wanted_mm: Column, bleed: Column) -> dict[str, Column]:
    """The finished size, and the page at 1:denominator that keeps the longest side with bleed within the largest page."""
    natural = width / dpi * 25.4
    w = F.coalesce(wanted_mm, natural)
    h = w * height / width
    d = F.greatest(F.lit(1), F.ceil((F.greatest(w, h) + 2.0 * bleed) / MAX_PAGE_MM))
    return {"natural_mm": natural, "width_mm": w, "height_mm": h, "denominator": d, "page_w_mm": w / d, "page_h_mm": h / d, "page_bleed_mm": bleed / d, "outer_w_mm": w / d + 2.0 * bleed / d, "outer_h_mm": h / d + 2.0 * bleed / d}


def page_box_errors(media: Column, bleed: Column, trim: Column, width_mm: Column, height_mm: Column, bleed_mm: Column) -> Column:
    """What is wrong with three page boxes (arrays of left, bottom, right, top in points), in order; expectations may be null together."""

    def valid(b: Column) -> Column:
        return F.coalesce((F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (b[2] > b[0]) & (b[3] > b[1]), F.lit(False))

    def holds(o: Column, i: Column) -> Column:
        return (o[0] <= i[0] + TOLERANCE) & (o[1] <= i[1] + TOLERANCE) & (o[2] >= i[2] - TOLERANCE) & (o[3] >= i[3] - TOLERANCE)

    def off(b: Column, w: Column, h: Column) -> Column:
        return (F.abs(b[2] - b[0] - w * MM) > TOLERANCE) | (F.abs(b[3] - b[1] - h * MM) > TOLERANCE)

    most = MAX_PAGE_MM * MM + TOLERANCE
    good = valid(media) & valid(bleed) & valid(trim)
    expected = width_mm.isNotNull() & height_mm.isNotNull() & bleed_mm.isNotNull()
    some = width_mm.isNotNull() | height_mm.isNotNull() | bleed_mm.isNotNull()
    sides = [trim[0] - bleed[0], trim[1] - bleed[1], bleed[2] - trim[2], bleed[3] - trim[3]]
    wrong_side = F.lit(False)
    for s in sides:
        wrong_side = wrong_side | (F.abs(s - bleed_mm * MM) > TOLERANCE)
    ow, oh = width_mm + 2 * bleed_mm, height_mm + 2 * bleed_mm
    return F.array_compact(
        F.array(
            *[F.when(~valid(b), F.lit(f"{n}_invalid")) for n, b in (("media", media), ("bleed", bleed), ("trim", trim))],
            F.when(good & ~holds(media, bleed), F.lit("media_misses_bleed")),
            F.when(good & ~holds(bleed, trim), F.lit("bleed_misses_trim")),
            *[F.when(good & (F.greatest(b[2] - b[0], b[3] - b[1]) > most), F.lit(f"{n}_too_large")) for n, b in (("media", media), ("bleed", bleed))],
            F.when(some & ~expected, F.lit("expectation_incomplete")),
            F.when(good & expected & off(trim, width_mm, height_mm), F.lit("trim_size")),
            F.when(good & expected & off(bleed, ow, oh), F.lit("bleed_size")),
            F.when(good & expected & off(media, ow, oh), F.lit("media_size")),
            F.when(good & expected & wrong_side, F.lit("bleed_side")),
        )
    )


# The ranges of a restoration's settings.
CONFIG_RANGES = {
    "scale": (1.0, 20.0), "deblur_strength": (0.0, 1.0), "deblur_sigma": (0.2, 4.0), "deblur_iterations": (1, 20), "denoise_strength": (0.0, 1.0), "noise_trigger": (0.0, 1.0), "detail_strength": (0.0, 1.0), "detail_sigma": (0.2, 4.0),
}


def config_errors(df: DataFrame) -> Column:
    """Settings that are out of range, not finite, or inconsistent (tiles of 128 at least, overlap of 8 to half a tile)."""
    out = []
    for name, (lo, hi) in CONFIG_RANGES.items():
        if name in df.columns:
            c = F.col(name).cast("double")
            out.append(F.when(~F.coalesce(~F.isnan(c) & c.between(lo, hi), F.lit(False)), F.lit(name)))
    if "tile" in df.columns:
        out.append(F.when(~F.coalesce(F.col("tile") >= 128, F.lit(False)), F.lit("tile")))
    if {"tile", "overlap"} <= set(df.columns):
        out.append(F.when(~F.coalesce(F.col("overlap").between(8, F.floor(F.col("tile") / 2)), F.lit(False)), F.lit("overlap")))
    return F.array_compact(F.array(*out))


def detection_filter(detections: DataFrame, width: str, height: str) -> DataFrame:
    """Detections clipped to their canvas, labels trimmed and in lower case; those of 16 pixels or less or over 0.55 of the canvas go."""
    at = lambda c, lo, hi: F.least(hi, F.greatest(lo, F.rint(c).cast("long")))
    zero = F.lit(0).cast("long")
    d = detections.withColumn("x0", F.greatest(zero, F.rint("x0").cast("long"))).withColumn("y0", F.greatest(zero, F.rint("y0").cast("long")))
    d = d.withColumn("x1", at(F.col("x1"), F.lit(-(1 << 40)), F.col(width))).withColumn("y1", at(F.col("y1"), F.lit(-(1 << 40)), F.col(height)))
    a = F.greatest(zero, F.col("x1") - F.col("x0")) * F.greatest(zero, F.col("y1") - F.col("y0"))
    return d.where((a > 16) & (a / (F.col(width) * F.col(height)) <= 0.55)).withColumn("label", F.lower(F.trim("label")))


def mask_filter(area: Column, canvas: Column, w: Column, h: Column) -> Column:
    return (area / canvas).between(0.00012, 0.72) & (w >= 3) & (h >= 3)


def background_like(area: Column, canvas: Column, fill: Column, std: Column) -> Column:
    ratio = area / canvas
    return (ratio > 0.17) | ((ratio > 0.025) & (fill > 0.72) & (std < 34.0))


def embedding_policy(fs_type: Column) -> dict[str, Column]:
    """What a font's embedding bits allow."""
    v = F.coalesce(fs_type, F.lit(0)).cast("int")
    bit = lambda b: v.bitwiseAND(F.lit(b)) != 0
    return {"restricted": bit(2), "preview_print": bit(4), "editable": bit(8), "installable": v.bitwiseAND(F.lit(15)) == 0, "embeddable": ~bit(2), "no_subsetting": bit(0x100), "bitmap_only": bit(0x200)}


def export_gates(layers: DataFrame, document: str, free_disk: Column) -> DataFrame:
    """Per document the raw bytes of its layers (4 a pixel), whether a layered file can be made, why not, and whether the containers fit."""
    g = layers.groupBy(document).agg(F.sum(F.col("w") * F.col("h") * 4).alias("raw_bytes"), F.max(F.greatest("canvas_w", "canvas_h")).alias("side"))
    why = F.when(F.col("side") > 30000, "side_too_long").when(F.col("raw_bytes") > 1_600_000_000, "raw_too_large")
    return g.withColumn("psd_created", why.isNull()).withColumn("psd_reason", why).withColumn("containers", F.when(F.col("raw_bytes") > 12_000_000_000, "too_large").when(F.col("raw_bytes") * 2 > free_disk * 0.75, "disk").otherwise("ok"))


def launcher_errors(pipeline: Column, wanted_pipeline: str, width: Column, height: Column, want_w: Column, want_h: Column, scale: Column, want_scale: Column, status: Column, nested: Column) -> Column:
    """Why a finished run isn't accepted."""
    return F.array_compact(
        F.array(
            F.when(~pipeline.eqNullSafe(F.lit(wanted_pipeline)), F.lit("pipeline")),
            F.when(~(width.eqNullSafe(want_w) & height.eqNullSafe(want_h)), F.lit("size")),
            F.when(~F.coalesce(F.abs(scale - want_scale) < 1e-9, F.lit(False)), F.lit("scale")),
            F.when(~F.coalesce(status.isin("PASS", "REVIEW_REQUIRED", "FAILED_QA"), F.lit(False)), F.lit("status")),
            F.when(~F.coalesce(F.forall(nested, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)), F.lit("nested_qa")),
        )
    )


# The modes of a job, their scales and the options that only some modes take.
MODES = {"fast": (2.0, 20.0), "high": (2.0, 20.0), "print": (2.0, 20.0), "layers": (1.0, 20.0), "repair": (1.0, 20.0)}
OPTION_MODES = {"width_mm": ("print",), "bleed_mm": ("print",), "max_layers": ("layers",), "review": ("repair",), "ocr_passes": ("repair",)}


def job_errors(jobs: DataFrame) -> Column:
    """What is wrong with a job's options: mode, scale (a repair takes none between 1 and 2), ranges, options of other modes. Numbers may have a decimal comma."""
    number = lambda c: F.expr(f"try_cast(replace({c}, ',', '.') AS DOUBLE)")
    mode, scale = F.lower("mode"), number("scale")
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    for m, (a, b) in MODES.items():
        lo, hi = F.when(mode == m, a).otherwise(lo), F.when(mode == m, b).otherwise(hi)
    out = [F.when(~F.coalesce(mode.isin(*MODES), F.lit(False)), F.lit("mode")), F.when(~F.coalesce(scale.between(lo, hi) & ~((mode == "repair") & (scale > 1) & (scale < 2)), F.lit(False)), F.lit("scale"))]
    ranges = {"width_mm": (10, 100_000), "bleed_mm": (0, 100), "max_layers": (4, 60), "ocr_passes": (1, 3)}
    for name, (a, b) in ranges.items():
        if name in jobs.columns:
            out.append(F.when(F.col(name).isNotNull() & ~F.coalesce(number(name).between(a, b), F.lit(False)), F.lit(name)))
    for name, modes in OPTION_MODES.items():
        if name in jobs.columns:
            out.append(F.when(F.col(name).isNotNull() & ~F.coalesce(mode.isin(*modes), F.lit(False)), F.lit(f"{name}_not_for_mode")))
    return F.array_compact(F.array(*out))
