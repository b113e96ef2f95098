"""Images at other sizes: nearest by index, Lanczos as a product with 22-bit integer weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stencils

BITS = 22


def source_place(i: Column, old: Column, new: Column) -> Column:
    """The place of an axis that place i of the resized axis shows: floor((i + 1/2) old / new), in integers."""
    return F.floor((2 * i + 1) * old / (2 * new)).cast("int")


def nearest(pixels: DataFrame, keys: list[str], old: tuple[int, int], new: tuple[int, int], value: str = "v") -> DataFrame:
    """(keys, y, x, v) of images in long form, old and new as (width, height). Each source pixel goes to the places that show it: no join, no shuffle."""
    def places(axis: str, a: int, b: int) -> Column:
        i = F.sequence(F.lit(0), F.lit(b - 1))
        return F.filter(i, lambda j: source_place(j, F.lit(a), F.lit(b)) == F.col(axis))

    d = pixels.select(*keys, F.col(value).alias("v"), F.explode(places("y", old[1], new[1])).alias("_y"), "x")
    return d.select(*keys, F.col("_y").alias("y"), F.explode(places("x", old[0], new[0])).alias("x"), "v")


def weights(old: int, new: int, lobes: int = 3) -> np.ndarray:
    """new x old integer weights of a windowed sinc, each row rounded from weights that add to one."""
    step = old / new
    wide = max(step, 1.0)
    centre = (np.arange(new) + 0.5) * step
    lo = np.maximum((centre - lobes * wide + 0.5).astype(int), 0)
    hi = np.minimum((centre + lobes * wide + 0.5).astype(int), old)
    at = np.arange(old)
    t = (at + 0.5 - centre[:, None]) / wide
    w = np.where((at >= lo[:, None]) & (at < hi[:, None]) & (np.abs(t) < lobes), np.sinc(t) * np.sinc(t / lobes), 0.0)
    w /= w.sum(axis=1, keepdims=True)
    return np.trunc(w * (1 << BITS) + np.copysign(0.5, w)).astype(np.int64)


def lanczos(image: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """An 8-bit image (height, width[, bands]) at ``size`` (width, height): rows first, rounded to 8 bits, then columns. The same size is a copy."""
    out = np.asarray(image, np.uint8)
    for axis, new in ((1, size[0]), (0, size[1])):
        old = out.shape[axis]
        if new < 1 or old < 1:
            raise ValueError("sizes must be positive")
        if new != old:
            total = np.tensordot(weights(old, new), out.astype(np.int64), (1, axis))
            out = np.moveaxis(np.clip((total + (1 << BITS - 1)) >> BITS, 0, 255).astype(np.uint8), 0, axis)
    return out.copy()


def resized_alpha(mask: np.ndarray, matte: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """A matte of 0 to 1 within its mask, by Lanczos over 8 bits; under 1/255 is nothing. A matte of another shape, out of range or outside its mask is an error."""
    mask = np.asarray(mask, bool)
    matte = np.asarray(matte, np.float32)
    if mask.ndim != 2 or matte.shape != mask.shape:
        raise ValueError("mask and matte must be of one two-dimensional shape")
    if not np.isfinite(matte).all() or matte.min(initial=0) < 0 or matte.max(initial=0) > 1 or (matte[~mask] > 0).any():
        raise ValueError("a matte is 0 to 1, and 0 outside its mask")
    return lanczos(np.floor(matte * np.float32(255) + np.float32(0.5)).astype(np.uint8), size).astype(np.float32) / 255


def resized_support(mask: np.ndarray, size: tuple[int, int], *, runway: bool = False) -> np.ndarray:
    """A mask at ``size`` by nearest places; with ``runway`` it is first grown by a cross, the room that a resampled matte may use."""
    mask = np.asarray(mask, bool)
    if runway:
        mask = np.logical_or.reduce([s for s in (mask, *(stencils.shifted(mask, dy, dx, False) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))))])
    y, x = ((2 * np.arange(n) + 1) * old // (2 * n) for n, old in zip((size[1], size[0]), mask.shape, strict=True))
    return mask[np.ix_(y, x)]
