"""Neighbourhood operations on rasters in numpy: blur, gradients, morphology, labelling, distances. Edges mirror without repeating the border pixel unless said otherwise."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def gaussian(image: np.ndarray, sigma_x: float, sigma_y: float | None = None, radius: tuple[int, int] | None = None) -> np.ndarray:
    """Separable Gaussian blur with a finite kernel (3 sigma unless given)."""
    sy = sigma_x if sigma_y is None else sigma_y
    rx, ry = radius or (max(1, math.ceil(3 * sigma_x)), max(1, math.ceil(3 * sy)))
    out = np.asarray(image, np.float64)
    for axis, sigma, r in ((1, sigma_x, rx), (0, sy, ry)):
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        k /= k.sum()
        at = mirrored(np.arange(-r, out.shape[axis] + r), out.shape[axis])
        padded = np.take(out, at, axis=axis)
        n = out.shape[axis]
        out = sum(w * np.take(padded, np.arange(i, i + n), axis=axis) for i, w in enumerate(k))
    return out


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Places beyond an axis mapped back by mirroring at its ends, again and again."""
    if n == 1:
        return np.zeros_like(i)
    k = np.mod(i, 2 * (n - 1))
    return np.where(k < n, k, 2 * (n - 1) - k)


def shifted(image: np.ndarray, dy: int, dx: int, fill: float | None = None) -> np.ndarray:
    """The neighbour at (dy, dx) of every pixel; mirrored at the edges, or ``fill`` beyond them."""
    h, w = image.shape[:2]
    ys, xs = np.arange(h) + dy, np.arange(w) + dx
    out = image[mirrored(ys, h)][:, mirrored(xs, w)]
    if fill is not None:
        out = out.copy()
        out[(ys < 0) | (ys >= h)] = fill
        out[:, (xs < 0) | (xs >= w)] = fill
    return out


def sobel(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.asarray(gray, np.float64)
    gx = sum(w * (shifted(g, dy, 1) - shifted(g, dy, -1)) for dy, w in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(w * (shifted(g, 1, dx) - shifted(g, -1, dx)) for dx, w in ((-1, 1), (0, 2), (1, 1)))
    return gx, gy


def gradient(gray: np.ndarray) -> np.ndarray:
    return np.hypot(*sobel(gray))


def laplacian(gray: np.ndarray) -> np.ndarray:
    """The 3 x 3 kernel 2 0 2 / 0 -8 0 / 2 0 2."""
    g = np.asarray(gray, np.float64)
    return 2 * sum(shifted(g, dy, dx) for dy in (-1, 1) for dx in (-1, 1)) - 8 * g


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic kernel of 2 radius + 1 pixels a side."""
    out = []
    for dy in range(-radius, radius + 1):
        half = round(radius * math.sqrt(max(0.0, (radius * radius - dy * dy) / (radius * radius)))) if radius else 0
        out += [(dy, dx) for dx in range(-half, half + 1)]
    return out


def square(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def highest(image: np.ndarray, kernel: list[tuple[int, int]]) -> np.ndarray:
    """Largest value under the kernel; nothing beyond the edges counts."""
    low = False if image.dtype == bool else -np.inf
    src = image if image.dtype == bool else np.asarray(image, np.float64)
    out = np.full(src.shape, low, src.dtype)
    for dy, dx in kernel:
        out = np.maximum(out, shifted(src, dy, dx, low))
    return out


def lowest(image: np.ndarray, kernel: list[tuple[int, int]]) -> np.ndarray:
    if image.dtype == bool:
        return ~highest(~image, kernel)
    return -highest(-np.asarray(image, np.float64), kernel)


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    return mask.copy() if radius <= 0 else highest(mask, ellipse(radius))


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    return mask.copy() if radius <= 0 else lowest(mask, ellipse(radius))


def close(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    return erode(dilate(mask, radius), radius)


def boundary(mask: np.ndarray) -> np.ndarray:
    return mask & ~erode(mask, 1)


def local_range(gray: np.ndarray) -> np.ndarray:
    return highest(gray, square(1)) - lowest(gray, square(1))


def label(mask: np.ndarray, corners: bool = True) -> tuple[np.ndarray, int]:
    """Component numbers from 1 in raster order of their first pixels; neighbours touch by sides, and by corners too unless told otherwise.

    Runs of each row are linked to the overlapping runs of the row above by union-find: work and memory grow with runs, not with pixels squared.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[1]
    parent = list(range(len(ys)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if corners else 0
    row = np.searchsorted(ys, np.arange(h + 1))
    for y in range(1, h):
        a, b = row[y - 1], row[y]
        for i in range(row[y], row[y + 1]):
            while a < b and x1[a] + reach <= x0[i]:
                a += 1
            k = a
            while k < b and x0[k] < x1[i] + reach:
                p, q = find(k), find(i)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                k += 1
    roots = np.array([find(i) for i in range(len(ys))], np.int64)
    names = np.unique(roots)
    out = np.zeros((h, w), np.int32)
    for y, a, b, r in zip(ys.tolist(), x0.tolist(), x1.tolist(), (np.searchsorted(names, roots) + 1).tolist(), strict=True):
        out[y, a:b] = r
    return out, len(names)


def holes(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Enclosed background, labelled by sides, on the mask framed by one background pixel."""
    framed = np.pad(mask, 1)
    labels, n = label(~framed, corners=False)
    outside = labels[0, 0]
    keep = [k for k in range(1, n + 1) if k != outside]
    table = np.zeros(n + 1, np.int32)
    table[keep] = np.arange(1, len(keep) + 1)
    return table[labels], len(keep)


def cleanup(mask: np.ndarray, least: int, keep_largest: bool = True) -> np.ndarray:
    """Components of ``least`` pixels or more; the largest if none is."""
    labels, n = label(mask)
    if not n:
        return mask.copy()
    sizes = np.bincount(labels.ravel(), minlength=n + 1)
    keep = np.flatnonzero(sizes >= least)
    keep = keep[keep > 0]
    if not len(keep) and keep_largest:
        keep = np.array([1 + int(sizes[1:].argmax())])
    return np.isin(labels, keep)


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of every pixel of the mask to the nearest pixel outside it; beyond the edges nothing is outside. Exact, by parabola envelopes along both axes."""
    h, w = mask.shape
    far = float(h * h + w * w)
    d = np.where(mask, far, 0.0)

    def one(f: np.ndarray) -> np.ndarray:
        n = len(f)
        q = np.arange(n)
        return (f[None, :] + (q[:, None] - q[None, :]) ** 2).min(axis=1)

    d = np.apply_along_axis(one, 0, d)
    d = np.apply_along_axis(one, 1, d)
    return np.sqrt(np.minimum(d, far)) if not mask.all() else np.full((h, w), math.sqrt(far))


def topology(mask: np.ndarray, micro: int) -> dict[str, int]:
    """Pixels, components (by sides and corners), components of ``micro`` pixels or fewer, enclosed holes (by sides)."""
    labels, n = label(mask)
    sizes = np.bincount(labels.ravel(), minlength=n + 1)[1:]
    return {"pixels": int(mask.sum()), "components": n, "micro": int((sizes <= micro).sum()), "holes": holes(mask)[1] if n else 0}


def correspondence(expected: np.ndarray, actual: np.ndarray, scale: float = 1.0) -> dict[str, int]:
    """Components and holes of two masks paired by common pixels: what is missing, born, merged, split, and how far the actual mask enters the cores of expected holes. All zero: the topology is kept."""

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = (a > 0) & (b > 0)
        return np.unique(np.stack((a[both], b[both]), 1), axis=0) if both.any() else np.zeros((0, 2), int)

    def tally(p: np.ndarray, na: int, nb: int) -> tuple[int, int, int, int]:
        left, right = np.bincount(p[:, 0], minlength=na + 1)[1:], np.bincount(p[:, 1], minlength=nb + 1)[1:]
        return int((left == 0).sum()), int((right == 0).sum()), int((left > 1).sum()), int((right > 1).sum())

    (le, ne), (la, na) = label(expected), label(actual)
    _, orphan, split, merged = tally(pairs(le, la), ne, na)
    (he, me), (ha, ma) = holes(expected), holes(actual)
    gone, new, hsplit, hmerged = tally(pairs(he, ha), me, ma)
    core = erode(he > 0, max(1, math.ceil(0.5 * scale)))
    return {
        "missing_expected_pixels": int((expected & ~actual).sum()), "orphan_actual_components": orphan, "merged_actual_components": merged, "split_expected_components": split,
        "missing_expected_holes": gone, "new_actual_holes": new, "split_expected_holes": hsplit, "merged_actual_holes": hmerged, "expected_hole_core_intrusion_pixels": int((core & np.pad(actual, 1)).sum()),
    }


def soft_alpha(mask: np.ndarray, edge: float = 1.35) -> np.ndarray:
    """Coverage from 0 to 1 that rises from the mask's edge inwards; never outside it."""
    if edge <= 0 or not math.isfinite(edge):
        raise ValueError("edge must be positive")
    return np.where(mask, np.clip(distance(mask) / edge, 0, 1), 0.0) if mask.any() else np.zeros(mask.shape)


def trimap(mask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """0, 128, 255 for surely outside, open, surely inside; every component has a sure pixel, its innermost if erosion leaves none."""
    sure = erode(mask, radius)
    labels, n = label(mask)
    for k in range(1, n + 1):
        own = labels == k
        if not (own & sure).any():
            d = distance(own)
            sure |= own & (d >= d[own].max() - 1e-6)
    out = np.zeros(mask.shape, np.uint8)
    out[dilate(mask, radius)] = 128
    out[sure] = 255
    return out, sure


def anchored(alpha: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Alpha without the islands that hold no sure pixel."""
    labels, _ = label(alpha > 0)
    keep = np.unique(labels[sure & (labels > 0)])
    return np.where(np.isin(labels, keep) & (labels > 0), alpha, 0.0)


def constrained_alpha(alpha: np.ndarray, mask: np.ndarray, radius: int = 1) -> tuple[np.ndarray, dict[str, int]]:
    """Alpha held inside the mask, 1 on its cores, without values under 1/255 and without unanchored islands; counts at 0.25, 0.5 and 0.75, and errors of the result."""
    _, sure = trimap(mask, radius)
    a = np.where(mask, np.clip(np.nan_to_num(alpha), 0, 1), 0.0)
    a[sure] = 1.0
    a[a < 1 / 255] = 0.0
    a = anchored(a, sure)
    report = {f"at_{q}": int((a >= q / 100).sum()) for q in (25, 50, 75)}
    report |= {"outside": int(((a > 0) & ~mask).sum()), "weak_cores": int((a[sure] < 1).sum()), "empty": int(not a.any())}
    return a, report


def feathered(source: np.ndarray, new: np.ndarray, footprint: np.ndarray, width: float) -> np.ndarray:
    """new blended into source towards the footprint's edge; pixels outside stay byte by byte."""
    out = source.copy()
    if width <= 0:
        out[footprint] = new[footprint]
        return out
    a = np.clip(distance(footprint) / width, 0, 1)
    a = a[..., None] if source.ndim == 3 else a
    mixed = np.rint(source.astype(np.float64) * (1 - a) + new.astype(np.float64) * a).astype(source.dtype)
    out[footprint] = mixed[footprint]
    return out


def tinted(image: np.ndarray, mask: np.ndarray, colour: tuple[int, ...], alpha: float) -> np.ndarray:
    out = image.copy()
    out[mask] = np.rint(out[mask].astype(np.float64) * (1 - alpha) + np.asarray(colour, np.float64) * alpha).astype(image.dtype)
    return out


def promoted_singletons(alpha: np.ndarray, matte: np.ndarray, mask: np.ndarray, colours: np.ndarray, radius: int = 5, near: float = 34.0, least: int = 4, most: int = 2) -> list[tuple[int, int]]:
    """Lone opaque pixels (y, x) that the matte hardly owns and whose colour is that of the background around them; the ``most`` nearest to it, by distance, support and place."""
    labels, _ = label(alpha >= 128)
    sizes = np.bincount(labels.ravel())
    found = []
    for y, x in np.argwhere((labels > 0) & (sizes[labels] == 1)):
        if not 0 < matte[y, x] < 0.5:
            continue
        ys, xs = slice(max(0, y - radius), y + radius + 1), slice(max(0, x - radius), x + radius + 1)
        ground = ~mask[ys, xs] | (matte[ys, xs] < 0.25)
        ground[y - ys.start, x - xs.start] = False
        d = np.linalg.norm(colours[ys, xs][ground] - colours[y, x], axis=1)
        close_by = np.sort(d[d <= near])
        if len(close_by) < least:
            continue
        back = np.median(colours[ys, xs][ground][np.argsort(d, kind="stable")[: min(16, len(close_by))]], axis=0)
        off = float(np.linalg.norm(colours[y, x] - back))
        if off <= near:
            found.append((off, -len(close_by), int(y), int(x)))
    return [(y, x) for _, _, y, x in sorted(found)[:most]]


def pruned_to_rest(matte: np.ndarray, mask: np.ndarray, render: Callable[[np.ndarray, np.ndarray], np.ndarray], colours: np.ndarray, passes: int = 3, most: int = 2) -> tuple[np.ndarray, np.ndarray, int]:
    """(matte, mask, pixels removed): renders, takes promoted pixels out of mask and matte, and renders again until none is left; an error if that takes more passes or pixels."""
    matte, mask, removed = matte.copy(), mask.copy(), 0
    for _ in range(passes + 1):
        found = promoted_singletons(render(matte, mask), matte, mask, colours, most=most)
        if not found:
            return matte, mask, removed
        removed += len(found)
        if removed > most:
            raise RuntimeError("more promoted pixels than the safe cap")
        for y, x in found:
            matte[y, x], mask[y, x] = 0.0, False
    raise RuntimeError("pruning did not converge")


def matte_report(alpha: np.ndarray, reference: np.ndarray, support: np.ndarray, scale: float = 1.0) -> dict[str, object]:
    """Ownership and topology of a rendered alpha against its support and its reference alpha, at the levels 64, 128 and 192."""
    high = alpha >= 128
    labels, n = label(high)
    sizes = np.sort(np.bincount(labels.ravel(), minlength=n + 1)[1:])[::-1]
    kept = {level: not any(correspondence((reference >= level) & support, alpha >= level, scale).values()) for level in (64, 128, 192)}
    return {"outside": int(((alpha > 0) & ~support).sum()), "components": n, "detached": float(sizes[1:].sum() / max(1, high.sum())), "soft": int(((alpha > 0) & (alpha < 255)).sum()), "topology": all(kept.values()) and not ((alpha > 0) & ~support).any()}
