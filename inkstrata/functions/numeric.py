"""Rounding, ratios, colour and exact 8-bit compositing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LUMA = (0.2126, 0.7152, 0.0722)


def half_even(c: Column) -> Column:
    """To the nearest integer; halves go to the even one."""
    return F.rint(c).cast("long")


def floor_div(a: Column, b: Column) -> Column:
    """Floor of the quotient of integers, also for negative ones; b is positive."""
    a, b = a.cast("long"), b.cast("long")
    return ((a - F.pmod(a, b)) / b).cast("long")


def ceil_div(a: Column, b: Column) -> Column:
    return -floor_div(-a, b)


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimal places by scaling, as SQL engines round doubles: the scaled product is what halves go away from zero by, not x's shortest decimal. Zeros keep their sign; a product beyond doubles leaves x as it is."""
    scaled = x * F.lit(10.0**digits)
    near = F.signum(scaled) * F.round(F.abs(scaled)) / F.lit(10.0**digits)
    return F.when(F.isnan(scaled) | (F.abs(scaled) == float("inf")), x).otherwise(near)


def safe_ratio(after: Column, before: Column, floor: float = 0.0) -> Column:
    low = F.greatest(before, F.lit(floor))
    return F.when(low > 1e-9, after / low).when(after <= 1e-9, F.lit(1.0)).otherwise(F.lit(float("inf")))


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def replaced_luma(channel: Column, y: Column, target: Column) -> Column:
    """A channel (0 to 1) after its pixel's luma y became target; almost black pixels become grey."""
    out = F.when(y < 1e-4, target).otherwise(channel * ((target + 1e-5) / (y + 1e-5)))
    return F.greatest(F.lit(0), F.least(F.lit(255), half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)) * 255.0)))


def linear_blend(base: Column, sharp: Column, alpha: float) -> Column:
    """Two 8-bit values mixed in linear light."""
    mixed = (1.0 - alpha) * srgb_to_linear(base / 255.0) + alpha * srgb_to_linear(sharp / 255.0)
    return F.greatest(F.lit(0), F.least(F.lit(255), half_even(linear_to_srgb(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))) * 255.0)))


def cosine_taper(i: Column, length: Column, left: Column, right: Column) -> Column:
    """The weight of place i on an axis that fades over left and right places; 1e-6 at least."""
    ramp = lambda k, n: 0.5 - 0.5 * F.cos(F.pi() * (k + 0.5) / n)
    w = F.when(i < left, ramp(i, left)).otherwise(F.lit(1.0)) * F.when(i >= length - right, ramp(length - 1 - i, right)).otherwise(F.lit(1.0))
    return F.greatest(w, F.lit(1e-6))


def kernel_radius(sigma: Column, truncate: float = 3.0) -> Column:
    if not 2.0 <= truncate <= 6.0:
        raise ValueError("truncation must be 2 to 6 sigma")
    return F.greatest(F.lit(1), F.ceil(sigma * truncate))


def composite(alpha: Column, fore: Column, below: Column) -> Column:
    """8-bit source over an opaque channel, rounded as integers: floor((a f + (255 - a) b + 127) / 255)."""
    return floor_div(alpha * fore + (255 - alpha) * below + 127, F.lit(255))


def least_alpha(target: Column, below: Column) -> Column:
    """The smallest 8-bit alpha with which some foreground over ``below`` gives ``target``."""
    up = ceil_div(255 * target - 127 - 255 * below, F.greatest(255 - below, F.lit(1)))
    down = ceil_div(255 * below - 255 * target - 127, F.greatest(below, F.lit(1)))
    return F.greatest(F.lit(0), F.least(F.lit(255), F.when(target > below, up).when(target < below, down).otherwise(F.lit(0))))


def foreground(target: Column, below: Column, alpha: Column) -> dict[str, Column]:
    """lower and upper legal foregrounds, whether any is (feasible), and the one nearest to the analytic solution."""
    safe = F.greatest(alpha, F.lit(1))
    rest = (255 - alpha) * below
    lo, hi = ceil_div(255 * target - 127 - rest, safe), floor_div(255 * target + 127 - rest, safe)
    inside = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v))
    clear = alpha == 0
    lower, upper = F.when(clear, target).otherwise(inside(lo)), F.when(clear, target).otherwise(inside(hi))
    feasible = F.when(clear, target == below).otherwise((lo <= 255) & (hi >= 0) & (inside(lo) <= inside(hi)))
    nearest = inside(floor_div(2 * (255 * target - rest) + safe, 2 * safe))
    chosen = F.when(clear, target).when(feasible, F.least(F.greatest(nearest, lower), upper)).otherwise(nearest)
    return {"lower": lower, "upper": upper, "feasible": feasible, "foreground": chosen}


def feasible_below(target: Column, clean: Column, alpha: Column) -> Column:
    """The colour nearest to ``clean`` over which ``target`` can be had exactly at this alpha."""
    safe = F.greatest(255 - alpha, F.lit(1))
    inside = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v))
    lo = inside(ceil_div(255 * target - 127 - 255 * alpha, safe))
    hi = inside(floor_div(255 * target + 127, safe))
    return F.when(alpha == 255, clean).otherwise(F.least(F.greatest(clean, lo), hi))


def scaled_alpha(alpha: Column, opacity: float) -> Column:
    return half_even(alpha * opacity)


def over_white(channel: Column, alpha: Column) -> Column:
    """A channel over white."""
    return composite(alpha, channel, F.lit(255))


def canonical_dpi(x: Column, y: Column, orientation: Column, least: float = 10.0, most: float = 2400.0) -> Column:
    """The horizontal resolution after rotation by EXIF orientation (5 to 8 swap the axes); null unless finite and plausible."""
    dpi = F.when(orientation.between(5, 8) & y.isNotNull(), y).otherwise(x)
    return F.when(dpi.isNotNull() & ~F.isnan(dpi) & dpi.between(least, most), dpi)
