"""Boxes as four integer columns, half open: area, overlap, distance, padding, placement, gates. All are column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "") -> Box:
    """The box in the columns prefix + x0, y0, x1, y1."""
    return Box(*(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")))


def _pos(c: Column) -> Column:
    return F.greatest(F.lit(0), c)


def area(b: Box) -> Column:
    return _pos(b.x1 - b.x0) * _pos(b.y1 - b.y0)


def intersection(a: Box, b: Box) -> Column:
    return _pos(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * _pos(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return share(both, area(a) + area(b) - both)


def gap_x(a: Box, b: Box) -> Column:
    return F.greatest(a.x0 - b.x1, b.x0 - a.x1, F.lit(0))


def gap_y(a: Box, b: Box) -> Column:
    return F.greatest(a.y0 - b.y1, b.y0 - a.y1, F.lit(0))


def distance(a: Box, b: Box) -> Column:
    return F.hypot(gap_x(a, b), gap_y(a, b))


def vertical_overlap(a: Box, b: Box) -> Column:
    """Shared height over the smaller height, which counts as 1 at least."""
    return _pos(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)) / F.greatest(F.lit(1), F.least(a.y1 - a.y0, b.y1 - b.y0))


def expand(b: Box, pixels: Column | int, width: Column, height: Column) -> Box:
    """Padded on all sides and clipped to the canvas."""
    p = F.lit(pixels) if isinstance(pixels, int) else pixels
    return Box(_pos(b.x0 - p), _pos(b.y0 - p), F.least(width, b.x1 + p), F.least(height, b.y1 + p))


def clip(b: Box, width: Column, height: Column) -> Box:
    at = lambda v, most: F.greatest(F.lit(0), F.least(most, v))
    return Box(at(b.x0, width), at(b.y0, height), at(b.x1, width), at(b.y1, height))


def text_padding(b: Box, width: Column, height: Column, scale: float = 1.0) -> Box:
    """A text line's box, scaled, with room for accents: a tenth of the height or 4 % of the width to the sides, 12 % of the height above and below."""
    s = Box(*(F.rint(v * scale).cast("long") for v in b))
    tall, wide = F.greatest(F.lit(1), s.y1 - s.y0), F.greatest(F.lit(1), s.x1 - s.x0)
    px = F.greatest(F.lit(1), F.rint(F.least(tall * 0.10, wide * 0.04)).cast("long"))
    py = F.greatest(F.lit(1), F.rint(tall * 0.12).cast("long"))
    return Box(_pos(s.x0 - px), _pos(s.y0 - py), F.least(width, s.x1 + px), F.least(height, s.y1 + py))


def position_hint(b: Box, width: Column, height: Column) -> Column:
    """One of fifteen names such as upper_left for the box's centre."""
    cx, cy = (b.x0 + b.x1) / (2.0 * width), (b.y0 + b.y1) / (2.0 * height)
    across = F.when(cx < 0.38, "left").when(cx > 0.62, "right").otherwise("center")
    down = F.when(cy < 0.20, "top").when(cy < 0.42, "upper").when(cy < 0.66, "middle").when(cy < 0.86, "lower").otherwise("bottom")
    return F.concat(down, F.lit("_"), across)


def match_score(inside_px: Column, mask_area: Column, box_area: Column) -> Column:
    """How well a mask fits a box: its share inside, the box's share covered, and the likeness of the two areas."""
    one = F.lit(1)
    return F.when(inside_px == 0, F.lit(0.0)).otherwise(
        inside_px / F.greatest(one, mask_area) * 0.62 + inside_px / F.greatest(one, box_area) * 0.23 + F.least(mask_area, box_area) / F.greatest(mask_area, box_area) * 0.15
    )


def tight_or(tight: Box, fallback: Box) -> Box:
    """tight where it has three pixels a side at least, else fallback."""
    ok = (tight.x1 - tight.x0 >= 3) & (tight.y1 - tight.y0 >= 3)
    return Box(*(F.when(ok, t).otherwise(f) for t, f in zip(tight, fallback, strict=True)))


def typography_gate(target: Box, drawn: Box) -> dict[str, Column]:
    """How far drawn ink is from the ink that it replaces, and whether that is within the limits."""
    size = lambda lo, hi: F.greatest(F.lit(1.0), (hi - lo).cast("double"))
    tw, th, rw, rh = size(target.x0, target.x1), size(target.y0, target.y1), size(drawn.x0, drawn.x1), size(drawn.y0, drawn.y1)
    wide, tall = rw / tw, rh / th
    aspect = F.abs(F.log(F.greatest(F.lit(1e-9), (rw / rh) / (tw / th))))
    cx = F.abs(((drawn.x0 + drawn.x1) - (target.x0 + target.x1)) * 0.5) / tw
    cy = F.abs(((drawn.y0 + drawn.y1) - (target.y0 + target.y1)) * 0.5) / th
    passed = wide.between(0.78, 1.12) & tall.between(0.78, 1.12) & (aspect <= 0.18) & (cx <= 0.10) & (cy <= 0.10)
    return {"width_ratio": wide, "height_ratio": tall, "aspect_log_error": aspect, "center_x_error": cx, "center_y_error": cy, "passed": passed}


def placed(align: Column, lo: Column, hi: Column, size: Column) -> Column:
    """Where something of a size begins between lo and hi; the middle is rounded down, also below zero."""
    return F.when(align.isin("left", "top", "start"), lo).when(align.isin("right", "bottom", "end"), hi - size).otherwise(lo + F.floor((hi - lo - size) / 2))


def cover_fit(width: Column, height: Column, page_w: Column, page_h: Column, bleed: Column) -> dict[str, Column]:
    """An image scaled to cover page and bleed, centred; covered within half a millimetre."""
    ow, oh = page_w + 2 * bleed, page_h + 2 * bleed
    scale = F.greatest(ow / width, oh / height)
    w, h = width * scale, height * scale
    return {"scale": scale, "draw_w": w, "draw_h": h, "left": (page_w - w) / 2, "top": (page_h - h) / 2, "covers": (w >= ow - 0.5) & (h >= oh - 0.5)}
