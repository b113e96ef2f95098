"""Folds whose result depends on the order of rows: one group a document or image, by applyInPandas.

A group is bounded by what one image or document holds. Each function sorts by its own order; none relies on how rows arrive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BOX = ["x0", "y0", "x1", "y1"]


def areas(b: np.ndarray) -> np.ndarray:
    return np.maximum(0, b[:, 2] - b[:, 0]) * np.maximum(0, b[:, 3] - b[:, 1])


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common areas of one box with many."""
    w = np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0])
    h = np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1])
    return np.maximum(0, w) * np.maximum(0, h)


def ratios(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """IoU, and the common area over the smaller one, of one box with many; 0 where a denominator is."""
    both = common(a, b).astype(float)
    own, other = float(areas(a[None])[0]), areas(b).astype(float)
    union, small = own + other - both, np.minimum(own, other)
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0), np.divide(both, small, out=np.zeros_like(both), where=small > 0)


def _grouped(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], extra: str = "") -> DataFrame:
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *([extra] if extra else [])])
    return df.groupBy(*keys).applyInPandas(fn, schema)


def suppressed(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], duplicate: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Rows in order (column, ascending), each kept unless it duplicates a kept one: duplicate(row, kept rows, boxes, their sizes) says of which. Kept rows are numbers in one growing array."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([c for c, _ in order], ascending=[a for _, a in order], kind="stable").reset_index(drop=True)
        boxes = g[BOX].to_numpy()
        size = g["area"].to_numpy(float) if "area" in g else areas(boxes).astype(float)
        kept, n = np.empty(len(g), np.int64), 0
        for i in range(len(g)):
            if not duplicate(i, kept[:n], boxes, size).any():
                kept[n] = i
                n += 1
        return g.iloc[kept[:n]]

    return _grouped(df, keys, run)


def component_nms(df: DataFrame, keys: list[str]) -> DataFrame:
    """Components by score, area and id; a duplicate has an IoU of 0.82, or covers 0.94 of the smaller at an area ratio of 0.72."""

    def duplicate(i: int, kept: np.ndarray, boxes: np.ndarray, size: np.ndarray) -> np.ndarray:
        over, held = ratios(boxes[i], boxes[kept])
        a, b = areas(boxes[i : i + 1])[0], areas(boxes[kept])
        return (over >= 0.82) | ((held >= 0.94) & (np.minimum(a, b) / np.maximum(np.maximum(a, b), 1) >= 0.72))

    src = df.withColumn("_area", (df.x1 - df.x0) * (df.y1 - df.y0))
    return suppressed(src, keys, [("score", False), ("_area", False), ("raw_id", True), ("component_id", True)], duplicate).drop("_area")


def mask_near_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Candidates in model order; a duplicate of an accepted one has a like area (1.35), a box IoU of 0.52 and a mask IoU over 0.82."""

    def duplicate(i: int, kept: np.ndarray, boxes: np.ndarray, size: np.ndarray) -> np.ndarray:
        over, _ = ratios(boxes[i], boxes[kept])
        a, b = size[i], size[kept]
        return (np.maximum(a, b) / np.maximum(1, np.minimum(a, b)) <= 1.35) & (over >= 0.52) & (over > 0.82)

    return suppressed(df, keys, [(order, True)], duplicate)


def text_draft_nms(df: DataFrame, keys: list[str]) -> DataFrame:
    """Text drafts by quality; duplicates overlap by IoU 0.55, containment 0.86 or box IoU 0.78."""

    def duplicate(i: int, kept: np.ndarray, boxes: np.ndarray, size: np.ndarray) -> np.ndarray:
        over, held = ratios(boxes[i], boxes[kept])
        return (over >= 0.55) | (held >= 0.86)

    return suppressed(df, keys, [("quality", False), ("y0", True), ("x0", True), ("text", True)], duplicate)


def detections(df: DataFrame, keys: list[str], order: str, most: int = 24) -> DataFrame:
    """Detections in model order: a better one replaces the first kept one with its label and an IoU over 0.72, and goes to the end; then the best by score."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable").reset_index(drop=True)
        b, score = g[BOX].to_numpy(), g["score"].to_numpy()
        kept: dict[object, list[int]] = {}  # by label, in order
        stays = np.zeros(len(g), bool)
        for i, label in enumerate(g["label"]):
            same = kept.setdefault(label, [])
            over = ratios(b[i], b[same])[0] > 0.72 if same else np.zeros(0, bool)
            if over.any():
                first = int(over.argmax())
                if not score[i] > score[same[first]]:
                    continue
                stays[same.pop(first)] = False
            same.append(i)
            stays[i] = True
        return g[stays].sort_values("score", ascending=False, kind="stable").head(most)

    return _grouped(df, keys, run)


def layer_suppression(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Layers in order: one that conflicts with a kept one takes its place if it has more area times score, and goes otherwise. Text and other layers never conflict."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable").reset_index(drop=True)
        b = g[BOX].to_numpy()
        size = areas(b).astype(float)
        kept: list[int] = []
        for i in range(len(g)):
            place = None
            for at, k in enumerate(kept):
                text_i, text_k = g.at[i, "category"] == "text_raster", g.at[k, "category"] == "text_raster"
                if text_i != text_k:
                    continue
                over, _ = ratios(b[i], b[[k]])
                both = common(b[i], b[[k]])[0]
                inside = min(both / max(size[i], 1), both / max(size[k], 1))
                like = max(size[i], size[k]) / max(1, min(size[i], size[k])) < 2.2
                if (not text_i and over[0] > 0.42 and like) or (g.at[i, "category"] == g.at[k, "category"] and (over[0] > 0.58 or inside > 0.88)):
                    place = at
                    break
            if place is None:
                kept.append(i)
            elif size[i] * g.at[i, "score"] > size[kept[place]] * g.at[kept[place], "score"]:
                kept[place] = i
        return g.loc[kept]

    return _grouped(df, keys, run)


def reading_clusters(df: DataFrame, keys: list[str]) -> DataFrame:
    """cluster of each reading: by top and left, it joins the cluster whose median box it overlaps most (IoU 0.28, or the same line), the last of equals, or begins one. The median moves as readings join."""

    def same_line(a: np.ndarray, b: np.ndarray) -> bool:
        lap = max(0, min(a[3], b[3]) - max(a[1], b[1]))
        wa, wb = max(1, a[2] - a[0]), max(1, b[2] - b[0])
        off = abs((a[0] + a[2]) - (b[0] + b[2])) / 2
        return lap / max(1, min(a[3] - a[1], b[3] - b[1])) >= 0.72 and off <= max(wa, wb) * 0.20 and min(wa, wb) / max(wa, wb) >= 0.55

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["y0", "x0", "reading"], kind="stable").reset_index(drop=True)
        b = g[BOX].to_numpy(float)
        members: list[list[int]] = []
        for i in range(len(g)):
            best: tuple[float, int] | None = None
            for c, rows in enumerate(members):
                middle = np.rint(np.median(b[rows], axis=0))
                over = float(ratios(b[i], middle[None])[0][0])
                if over >= 0.28 or same_line(b[i], middle):
                    best = max(best, (over, c)) if best else (over, c)
            if best:
                members[best[1]].append(i)
            else:
                members.append([i])
        out = np.empty(len(g), np.int64)
        for c, rows in enumerate(members):
            out[rows] = c
        return g.assign(cluster=out)

    return _grouped(df, keys, run, "cluster long")


def symmetric_pairs(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """partner of each draft: the first later free one that mirrors it across the canvas's middle (0.065 of the width, 0.055 of the height, areas alike by 0.55); rows of text have none."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable").reset_index(drop=True)
        b = g[BOX].to_numpy(float)
        size = areas(b)
        cx, cy = (b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2
        free = (g["role"] != "standalone_row").to_numpy()
        partner = np.full(len(g), -1)
        for i in range(len(g)):
            if not free[i]:
                continue
            later = np.flatnonzero(free[i + 1 :]) + i + 1
            w, h = float(g.at[i, "width"]), float(g.at[i, "height"])
            fit = later[(np.abs(cx[i] + cx[later] - w) <= 0.065 * w) & (np.abs(cy[i] - cy[later]) <= 0.055 * h) & (np.minimum(size[i], size[later]) / np.maximum(1, np.maximum(size[i], size[later])) >= 0.55)]
            free[i] = False
            if len(fit):
                partner[i], partner[fit[0]] = fit[0], i
                free[fit[0]] = False
        return g.assign(partner=[None if p < 0 else g.at[p, order] for p in partner])

    return _grouped(df, keys, run, f"partner {dict(df.dtypes)[order]}")


def assign_objects(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, detection, candidate, match): detections in order take their best unused candidate (match 0.43), unless its IoU with a chosen one is over 0.62.

    pairs: detection, candidate, match and the candidate's box, one row a possible pair.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        chosen: list[np.ndarray] = []
        out = []
        for _, rows in g.sort_values(["detection", "match", "candidate"], ascending=[True, False, True], kind="stable").groupby("detection", sort=True):
            rows = rows[~rows["candidate"].isin(used)]
            if not len(rows) or rows.iloc[0]["match"] < 0.43:
                continue
            top = rows.iloc[0]
            box = top[BOX].to_numpy(float)
            if chosen and (ratios(box, np.array(chosen))[0] > 0.62).any():
                continue
            used.add(top["candidate"])
            chosen.append(box)
            out.append(rows.iloc[:1])
        return pd.concat(out) if out else g.iloc[:0]

    return _grouped(pairs, keys, run)


def context_groups(df: DataFrame, keys: list[str], order: str, text: str, most: int = 8, longest: int = 190) -> DataFrame:
    """context of each text: texts in order share one until it has ``most`` of them or would be longer than ``longest`` characters with the spaces between."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        out, size, n, at = [], 0, 0, 0
        for t in g[text].fillna(""):
            extra = len(t) + (1 if n else 0)
            if n and (n >= most or size + extra > longest):
                at, size, n, extra = at + 1, 0, 0, len(t) + 1  # the space that the new context's first text doesn't need still counts
            out.append(at)
            size += extra
            n += 1
        return g.assign(context=out)

    return _grouped(df, keys, run, "context int")


def output_names(df: DataFrame, keys: list[str]) -> DataFrame:
    """stem_out of files (relative, parent, stem, suffix, same_stem) in the order of their relative paths: the suffix is added to repeated stems, eight hex digits of a SHA-1 where that is taken, whatever the case."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(_k=g["relative"].str.casefold()).sort_values(["_k", "relative"], kind="stable").drop(columns="_k")
        used: set = set()
        out = []
        for r in g.itertuples():
            stem = f"{r.stem}_{r.suffix.lstrip('.').lower()}" if r.same_stem > 1 else r.stem
            if (r.parent.casefold(), stem.casefold()) in used:
                stem = f"{stem}_{hashlib.sha1(r.relative.encode()).hexdigest()[:8]}"
            used.add((r.parent.casefold(), stem.casefold()))
            out.append(stem)
        return g.assign(stem_out=out)

    return _grouped(df, keys, run, "stem_out string")


def evictions(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """action of layers that must make room: drafts by quality enter while the layers number under ``most``; beyond, an optional leaf leaves: first one that a draft covers (0.82), else the least salient decoration if the draft's quality is 0.80 or more; else the draft stays out.

    Rows: kind (layer or draft), id, optional, leaf, decoration, salience, quality and a box.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["kind", "id"], kind="stable").reset_index(drop=True)
        b = g[BOX].to_numpy(float)
        action = pd.Series(["keep" if k == "layer" else "out" for k in g["kind"]])
        inside = [i for i in range(len(g)) if g.at[i, "kind"] == "layer"]
        drafts = g[g["kind"] == "draft"].sort_values(["quality", "id"], ascending=[False, True], kind="stable").index
        for d in drafts:
            if len(inside) >= most:
                loose = [i for i in inside if g.at[i, "optional"] and g.at[i, "leaf"]]
                over = [i for i in loose if common(b[i], b[[d]])[0] / max(1.0, areas(b[[i]])[0]) >= 0.82]
                weak = sorted((i for i in loose if g.at[i, "decoration"]), key=lambda i: (g.at[i, "salience"], g.at[i, "id"]))
                victim = over[0] if over else weak[0] if weak and g.at[d, "quality"] >= 0.80 else None
                if victim is None:
                    continue
                inside.remove(victim)
                action[victim] = "evicted"
            inside.append(d)
            action[d] = "in"
        return g.assign(action=action)

    return _grouped(df, keys, run, "action string")
