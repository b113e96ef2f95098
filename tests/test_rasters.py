"""Stencils, exact compositing and gates against plain loops and algebra."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.operators import raster, stencils
from inkstrata.plans import models

RNG = np.random.default_rng(7)


def flood(mask, corners):
    seen, n = np.zeros(mask.shape, int), 0
    step = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        seen[y, x] = n
        while todo:
            p, q = todo.pop()
            for a, b in step:
                r, c = p + a, q + b
                if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and not seen[r, c]:
                    seen[r, c] = n
                    todo.append((r, c))
    return seen, n


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 12), st.integers(1, 12), st.booleans())
def test_labels(seed, h, w, corners):
    mask = np.random.default_rng(seed).random((h, w)) < 0.5
    got, n = stencils.label(mask, corners)
    want, m = flood(mask, corners)
    assert n == m and (got == want).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_distances(seed):
    mask = np.random.default_rng(seed).random((9, 7)) < 0.7
    if mask.all():
        return
    out = np.argwhere(~mask)
    want = np.array([[min(math.dist((y, x), p) for p in out) if mask[y, x] else 0 for x in range(7)] for y in range(9)])
    assert np.allclose(stencils.distance(mask), want)


def test_every_alpha_and_colour_composes_exactly():
    """For all targets and colours below, the least alpha works and the one under it doesn't; solved foregrounds are exact."""
    t, b = (x.ravel() for x in np.meshgrid(np.arange(256), np.arange(256), indexing="ij"))
    for a in (0, 1, 2, 63, 64, 127, 128, 200, 254, 255):
        image, below = t.reshape(256, 256, 1).repeat(3, 2).astype(np.uint8), b.reshape(256, 256, 1).repeat(3, 2).astype(np.uint8)
        alpha = np.full((256, 256), a, np.uint8)
        back, targets = raster.planned_stack(image, below, [alpha])
        assert (raster.rendered_stack(back, targets, [alpha]) == image).all()
        if a == 255:
            assert (back == below).all()
        if a == 0:
            assert (back == image).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 4))
def test_stacks_compose_exactly(seed, layers):
    rng = np.random.default_rng(seed)
    master, back = (rng.integers(0, 256, (6, 5, 3)).astype(np.uint8) for _ in range(2))
    alphas = [rng.choice([0, 1, 40, 128, 254, 255], (6, 5)).astype(np.uint8) for _ in range(layers)]
    plan, targets = raster.planned_stack(master, back, alphas)
    assert (raster.rendered_stack(plan, targets, alphas) == master).all()


def test_blur_keeps_constants_and_matches_direct_sums():
    assert np.allclose(stencils.gaussian(np.full((5, 6), 3.0), 1.2), 3.0)
    image = RNG.random((7, 9))
    r = 3
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / 1.0) ** 2)
    k /= k.sum()
    pad = np.pad(image, r, mode="reflect")
    want = np.array([[sum(k[i] * k[j] * pad[y + i, x + j] for i in range(7) for j in range(7)) for x in range(9)] for y in range(7)])
    assert np.allclose(stencils.gaussian(image, 1.0), want)


def test_stripes_equal_the_whole():
    a, b = (RNG.integers(0, 256, (37, 20, 3)).astype(np.uint8) for _ in range(2))
    whole = raster.unsharp(a, b, 0.1, 0.2, 1.5, 1.5)
    assert all((raster.unsharp_stripes(a, b, 0.1, 0.2, 1.5, n) == whole).all() for n in (1, 4, 16, 100))


def test_morphology():
    mask = np.zeros((9, 9), bool)
    mask[4, 4] = True
    assert stencils.dilate(mask, 1).sum() == 5 and (stencils.erode(stencils.dilate(mask, 2), 2) == mask).all()
    gray = RNG.random((6, 6))
    pad = np.pad(gray, 1, constant_values=np.nan)
    want = np.array([[np.nanmax(pad[y : y + 3, x : x + 3]) - np.nanmin(pad[y : y + 3, x : x + 3]) for x in range(6)] for y in range(6)])
    assert np.allclose(stencils.local_range(gray), want)


def test_equal_counts_with_other_topology_fail():
    two = np.zeros((9, 20), bool)
    two[2:7, 2:5] = two[2:7, 8:11] = True
    other = np.zeros((9, 20), bool)
    other[2:7, 2:11] = other[2:7, 14:16] = True  # merged, and one born: still two components
    assert stencils.topology(two, 2)["components"] == stencils.topology(other, 2)["components"] == 2
    bad = stencils.correspondence(two, other)
    assert bad["merged_actual_components"] == 1 and bad["orphan_actual_components"] == 1
    assert not any(stencils.correspondence(two, two).values())
    ring = np.zeros((9, 9), bool)
    ring[1:8, 1:8] = True
    ring[3:6, 3:6] = False
    assert stencils.topology(ring, 1)["holes"] == 1
    full = ring.copy()
    full[3:6, 3:6] = True
    assert stencils.correspondence(ring, full)["missing_expected_holes"] == 1


def test_alpha_stays_inside_its_mask():
    mask = np.zeros((12, 12), bool)
    mask[2:9, 3:10] = True
    mask[10, 0] = True
    a, report = stencils.constrained_alpha(RNG.random((12, 12)), mask)
    assert report["outside"] == report["weak_cores"] == report["empty"] == 0 and a[10, 0] == 1.0
    soft = stencils.soft_alpha(mask)
    assert (soft[~mask] == 0).all() and soft.max() == 1
    image = RNG.integers(0, 256, (12, 12, 3)).astype(np.uint8)
    out = stencils.feathered(image, 255 - image, mask, 3)
    assert (out[~mask] == image[~mask]).all()


def test_float_input():
    v = np.array([[0.5, np.nan], [np.inf, -np.inf]])
    assert raster.as_rgb(v)[..., 0].tolist() == [[0, 0], [255, 0]]
    assert raster.as_rgb(np.array([[0.5, 1.0]]))[..., 0].tolist() == [[128, 255]]


def test_restoration_metrics_of_equal_images():
    a = RNG.integers(0, 256, (24, 24, 3)).astype(np.uint8)
    m = raster.restoration_metrics(a, a)
    assert m["ssim_mean"] == pytest.approx(1) and m["edge_f1"] == 1 and m["acutance_ratio"] == pytest.approx(1)
    gate = raster.restoration_gate(m)
    assert not gate["lost"] and not gate["passed"]  # safe, but no better
    blurred = np.rint(stencils.gaussian(a.astype(float), 2.0)).astype(np.uint8)
    assert "acutance_low" in raster.restoration_gate(raster.restoration_metrics(a, blurred))["lost"]


def test_stages_are_taken_back():
    a = RNG.integers(60, 200, (20, 20, 3)).astype(np.uint8)

    def fails(image):
        raise ValueError

    out, reports = raster.restored(a, [("deblur", lambda i: i), ("detail", fails), ("denoise", lambda i: 255 - i)])
    assert (out == a).all() and [r["accepted"] for r in reports] == [False] * 3
    assert reports[0]["reasons"][0] == "no_material_change" and reports[1]["reasons"] == ["stage_error:ValueError"]


def test_surfaces():
    ys, xs = (v.ravel() for v in np.mgrid[0:40, 0:40])
    flat = np.full((1600, 3), 90.0)
    tilted = flat + xs[:, None] * 2
    curved = flat + ((xs - 20) ** 2)[:, None] * 0.3
    assert [raster.surface(xs, ys, v, 40, 40)["name"] for v in (flat, tilted, curved)] == ["constant", "linear", "quadratic"]
    design = np.column_stack([np.ones(1600), xs / 40, ys / 40])
    spoiled = tilted / 255
    spoiled[::9] = 0
    assert np.allclose(raster.robust_fit(design, spoiled)[:, 0], [90 / 255, 80 / 255, 0], atol=1e-3)
    assert raster.chosen_surface([("c", 2.0, 3.0), ("a", 1.9, 2.0), ("q", 1.0, 1.0)]) == "q"
    assert raster.chosen_surface([("c", 2.0, 3.0), ("a", 1.95, 2.0), ("q", 1.5, 2.95)]) == "c"


def test_edit_gates():
    a = np.full((40, 60, 3), 200, np.uint8)
    old = np.zeros((40, 60), bool)
    old[15:25, 20:40] = True
    a[old] = 20
    roi = np.zeros((40, 60), bool)
    roi[8:32, 10:50] = True
    none = np.zeros((40, 60), bool)
    clean = np.full_like(a, 200)
    assert raster.edit_checks(a, clean, roi, old, none, none)["passed"]
    assert not raster.edit_checks(a, a, roi, old, none, none)["ghost_ok"]
    leak = clean.copy()
    leak[0, 0] = 0
    assert not raster.edit_checks(a, leak, roi, old, none, none)["outside_ok"]
    assert not raster.edit_checks(a, clean, roi, old, roi, none)["clipping_ok"]
    mask, quality = raster.text_mask(a, (18, 13, 42, 27))
    assert (mask & old).sum() >= 0.9 * old.sum() and quality >= 0.45


def test_models_fall_back_and_keep_their_contract():
    image = RNG.integers(0, 256, (4, 5, 3)).astype(np.uint8)
    assert models.with_fallback(models.Nearest(memory=256), image)[1] == 256
    assert models.ladder(512, 16, 128)[:3] == [(512, 128), (384, 96), (320, 80)]
    with pytest.raises(MemoryError):
        models.with_fallback(models.Nearest(memory=8), image)

    class Wrong(models.Nearest):
        def upscale(self, image, tile, overlap):
            return image

    with pytest.raises(ValueError):
        models.with_fallback(Wrong(), image)


def test_winsorized_and_agreement():
    assert raster.winsorized(np.array([])) == 0 and raster.winsorized(np.array([1, 2, 9])) == 4
    flat = np.full((16, 16, 3), 9, np.uint8)
    assert raster.edge_agreement(flat, flat) == {"precision": 1.0, "recall": 1.0, "f1": 1.0}
    assert all(stencils.mirrored(np.arange(-9, 14), 5)[i] == v for i, v in enumerate(itertools.islice(itertools.cycle([0, 1, 2, 3, 4, 3, 2, 1]), 7, 7 + 23)))


def test_promoted_pixels_leave_and_pruning_rests():
    colours = np.full((20, 20, 3), 200.0)
    mask, matte = np.zeros((20, 20), bool), np.zeros((20, 20))
    mask[5:15, 5:9] = True
    matte[mask] = 1.0
    colours[mask] = 10.0
    mask[10, 15], matte[10, 15] = True, 0.2  # background colour: promoted
    mask[3, 15], matte[3, 15], colours[3, 15] = True, 0.2, 10.0  # ink colour: an accent

    def render(matte, mask):
        return np.where(mask, 255, 0).astype(np.uint8)

    assert stencils.promoted_singletons(render(matte, mask), matte, mask, colours) == [(10, 15)]
    m, k, n = stencils.pruned_to_rest(matte, mask, render, colours)
    assert n == 1 and not k[10, 15] and k[3, 15] and m[10, 15] == 0
    for y in (12, 17):  # three in all are over the cap
        mask[y, 17], matte[y, 17] = True, 0.2
    with pytest.raises(RuntimeError):
        stencils.pruned_to_rest(matte, mask, render, colours)


def test_matte_report():
    a = np.zeros((12, 12), np.uint8)
    a[2:6, 2:6] = 255
    support = a > 0
    assert stencils.matte_report(a, a, support)["topology"]
    b = a.copy()
    b[9, 9] = 255
    r = stencils.matte_report(b, a, support)
    assert not r["topology"] and r["outside"] == 1 and r["components"] == 2


def test_text_styles():
    image = np.full((40, 40, 3), 250, np.uint8)
    mask = np.zeros((40, 40), bool)
    mask[8:32, 8:32] = True
    image[mask] = (200, 0, 0)
    inner = np.zeros((40, 40), bool)
    inner[11:29, 11:29] = True
    image[inner] = (0, 0, 120)
    s = raster.text_style(image, mask)
    assert s["fill"] == (0, 0, 120) and s["stroke"] == (200, 0, 0) and s["stroke_width"] > 1
    assert raster.text_style(image, inner)["stroke"] is None
