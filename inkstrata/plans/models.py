"""Model contracts: batch inference behind an interface, with deterministic stand-ins. Neural models, codecs and desktop tools are plugged in by the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class SuperResolution(Protocol):
    """Enlarges an 8-bit RGB image by native_scale."""

    native_scale: int

    def upscale(self, image: np.ndarray, tile: int, overlap: int) -> np.ndarray: ...


class Recogniser(Protocol):
    """Readings of an image: box, text, confidence (0 to 1)."""

    engine: str

    def read(self, image: np.ndarray) -> list[tuple[tuple[int, int, int, int], str, float]]: ...


class Segmenter(Protocol):
    """Masks of an image with scores."""

    def masks(self, image: np.ndarray) -> list[tuple[np.ndarray, float]]: ...


class Nearest:
    """A stand-in that repeats pixels; it fails on tiles over ``memory`` pixels a side, as a device without memory would."""

    native_scale = 4

    def __init__(self, memory: int = 1 << 30) -> None:
        self.memory = memory

    def upscale(self, image: np.ndarray, tile: int, overlap: int) -> np.ndarray:
        if tile > self.memory:
            raise MemoryError("out of memory")
        return image.repeat(self.native_scale, axis=0).repeat(self.native_scale, axis=1)


def ladder(requested: int, alignment: int, overlap: int) -> list[tuple[int, int]]:
    """Tile sizes and overlaps to try, largest first."""
    out: list[tuple[int, int]] = []
    for v in (requested, 384, 320, 256, 192, 160, 128):
        v -= v % alignment
        lap = max(alignment, min(round(v * overlap / requested / alignment) * alignment, v // 2))
        if 64 <= v <= requested and (v, lap) not in out:
            out.append((v, lap))
    if not out:
        raise ValueError("the tile is too small for its alignment")
    return out


def with_fallback(model: SuperResolution, image: np.ndarray, tile: int = 512, alignment: int = 16, overlap: int = 128) -> tuple[np.ndarray, int]:
    """(output, tile used): smaller tiles are tried only when memory runs out; the size of the output is checked."""
    last: MemoryError | None = None
    for size, lap in ladder(tile, alignment, overlap):
        try:
            out = model.upscale(image, size, lap)
        except MemoryError as e:
            last = e
            continue
        if out.shape != (image.shape[0] * model.native_scale, image.shape[1] * model.native_scale, 3) or not np.isfinite(out.astype(float)).all():
            raise ValueError("the model broke its contract")
        return out, size
    raise last or MemoryError()


def infer(images: DataFrame, load: Callable[[], Any], fn: Callable[[Any, dict[str, Any]], dict[str, Any]], schema: str) -> DataFrame:
    """fn(model, row) over a table, the model loaded once a Python worker; a row that fails gives its error and stops no other. schema needs a column error."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    rows.append({**row, **fn(model, row), "error": None})
                except (ValueError, MemoryError, RuntimeError) as e:
                    rows.append({**row, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows).reindex(columns=names)

    return images.mapInPandas(run, schema)
