"""Anomalies and marked boxes of a colour pair (numpy), for use in Arrow batches.

The rules are those of the columns and tables (``pixels.color_mask``,
``boxes.dedup_boxes``, ``boxes.box_contained``, ``boxes.extreme_box``,
``boxes.looks_anomalous``), on one pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from argusline.functions import kernels as K
from argusline.functions.layout import hsv, of_color
from argusline.functions.masks import region_boxes

#: ord, x, y, w, h.
Marked = tuple[int, int, int, int, int]
Found = tuple[str, int, int, int, int, int]


def deduped(boxes: Sequence[Marked], tol: int) -> list[Marked]:
    """Boxes, in order, of which no kept one is near in x, y, w and h."""
    kept: list[Marked] = []
    for b in boxes:
        if not any(all(abs(p - q) < tol for p, q in zip(b[1:], k[1:], strict=True)) for k in kept):
            kept.append(b)
    return kept


def contained(top: Marked, boxes: Sequence[Marked], share: float = 0.85, slack: int = 20) -> list[Marked]:
    """Boxes inside the largest one: smaller than ``share`` of it."""
    _, left, up, wide, high = top
    inside = lambda x, y, w, h: x >= left - slack and y >= up - slack and x + w <= left + wide + slack and y + h <= up + high + slack
    return [b for b in boxes if b[0] != top[0] and b[3] * b[4] < share * (wide * high) and inside(*b[1:])]


def gray(planes: Sequence[np.ndarray]) -> np.ndarray:
    r, g, b = planes
    return 0.299 * r + 0.587 * g + 0.114 * b


def marks(planes: Sequence[np.ndarray]) -> np.ndarray:
    p = hsv(*planes)
    return of_color(p, "green") | of_color(p, "red") | of_color(p, "blue")


def unlike(gab: Sequence[np.ndarray], test: Sequence[np.ndarray], ui: int, border: int, win: int, similar: float, color: float, open_: int, close: int) -> np.ndarray:
    """Where both differ in structure and colour, without the marks' colours and the border."""
    h, w = gab[0].shape
    hidden = K.morph(marks(gab) | marks(test), "dilate", ui, times=2)
    gab, test = ([K.blur(p, 3) for p in planes] for planes in (gab, test))
    alike = K.ssim_map(gray(gab), gray(test), win, full=True)
    mask = (np.floor(np.maximum(alike, 0) * 255) <= similar) & (gray([np.abs(a - b) for a, b in zip(gab, test, strict=True)]) > color) & ~hidden
    inner = np.zeros_like(mask)
    inner[border : h - border, border : w - border] = mask[border : h - border, border : w - border]
    return K.morph(K.morph(inner, "open", open_, ellipse=True, times=2), "close", close)


def anomalies(gab: Sequence[np.ndarray | None], test: Sequence[np.ndarray | None], h: int | None, w: int | None, least_box: int, tol: int, pad: int, least: int, **how: float) -> list[Found]:
    """kind, ord, x, y, w, h of a pair; see ``images.detect_anomalies``.  An odd image (None) shows nothing."""
    boxes: list[Marked] = []
    if all(p is not None for p in test):
        boxes = [(i + 1, *b[:4]) for i, b in enumerate(region_boxes(of_color(hsv(*test), "green"))) if b[2] > least_box and b[3] > least_box]
        boxes = deduped(boxes, tol)
    top = max(boxes, key=lambda b: (b[3] * b[4], -b[0]), default=None)
    out: list[Found] = [("global", *(top or (0, 0, 0, w, h)))]
    out += [("epicentre", *b) for b in (contained(top, boxes) if top else [])]
    if any(p is None for p in (*gab, *test)):
        return out
    x1, y1, x2, y2 = 0, 0, w, h
    if top:
        x1, y1, x2, y2 = max(0, top[1] - pad), max(0, top[2] - pad), min(w, top[1] + top[3] + pad), min(h, top[2] + top[4] + pad)
    cut = lambda planes: [p[y1:y2, x1:x2] for p in planes]
    room = (y2 - y1) * (x2 - x1)
    for i, (x, y, wide, high, area) in enumerate(region_boxes(unlike(cut(gab), cut(test), **how))):
        if area >= least and wide * high <= 0.4 * room and max(wide, high) / max(1, min(wide, high)) <= 25 and area / (wide * high) >= 0.05:
            out.append(("anomaly", i + 1, x + x1, y + y1, wide, high))
    return out
