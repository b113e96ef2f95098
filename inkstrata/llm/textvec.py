"""Vectorised word and character hashing for numpy kernels."""

from __future__ import annotations

import numpy as np

_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("r", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("r", _R), ("i", _RINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["r"], _POWERS["i"]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words (runs of ASCII letters, digits and non-ASCII bytes) of all texts, and each text's first word: n + 1 offsets."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    inside = _WORD[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    starts, stops = edges[0::2], edges[1::2]
    offsets = np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    up, down = _powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix64((sums[stops] - sums[starts]) * down[starts]), offsets


def code_points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one array, and n + 1 offsets."""
    lengths = [len(t or "") for t in texts]
    joined = "".join(t or "" for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
