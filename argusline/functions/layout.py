"""Bars and photos of a screen (numpy), for use in Arrow batches.

The rules are those of the columns and tables (``pixels.to_hsv``,
``boxes.largest_bar``, ``boxes.sibling_box``, ``sequences.photo_extent``), on
one frame: bars are regions of a colour, photos are found by the share of
interface gray in each row and column of the strips below the bars.
"""

from __future__ import annotations

import numpy as np

from argusline.functions.masks import region_boxes
from argusline.functions.pixels import COLORS

Box = tuple[int, int, int, int]


def hsv(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue 0..180, saturation and value 0..255."""
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = top - low
    some = np.where(d == 0, 1, d)
    h = np.where(top == r, 60 * (g - b) / some, np.where(top == g, 120 + 60 * (b - r) / some, 240 + 60 * (r - g) / some))
    h = np.where(d == 0, 0, h)
    return np.where(h < 0, h + 360, h) / 2, np.where(top == 0, 0, 255 * d / np.where(top == 0, 1, top)), top


def of_color(planes: tuple[np.ndarray, ...], name: str) -> np.ndarray:
    out = np.zeros(planes[0].shape, bool)
    for low, high in COLORS[name]:
        out |= np.logical_and.reduce([(p >= a) & (p <= z) for p, a, z in zip(planes, low, high, strict=True)])
    return out


def neutral(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Interface gray: spread up to 15, mean 178 to 218, saturation up to 25."""
    mean = np.floor((r + g + b) / 3)
    spread = np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b)
    return (spread <= 15) & (mean >= 178) & (mean <= 218) & (hsv(r, g, b)[1] <= 25)


def largest(boxes: list[Box], least: int) -> Box | None:
    """The first of the largest boxes above an area."""
    big = [b for b in boxes if b[2] * b[3] > least]
    return max(big, key=lambda b: b[2] * b[3]) if big else None


def beside(ref: Box, boxes: list[Box], least: int) -> Box | None:
    """The largest box that can be the reference bar's sibling."""
    x, y, w, h = ref
    fits = [
        b for b in boxes
        if b[2] * b[3] >= least and b[2] >= 2 * b[3] and abs(b[1] - y) <= 30 and 0.3 * h <= b[3] <= 2 * h and b[2] >= 0.3 * w and abs(b[0] - x) >= 0.5 * w
    ]
    return max(fits, key=lambda b: b[2] * b[3]) if fits else None


def sustained(flags: np.ndarray, remaining: int = 15, share: float = 0.9, least: int = 5) -> tuple[int, int]:
    """From the first free band to where flagged ones prevail; else the whole."""
    n, free = len(flags), np.flatnonzero(~flags)
    if not len(free):
        return 0, n
    left = n - np.arange(n)
    prevail = np.cumsum(flags[::-1])[::-1] / left >= share
    stops = np.flatnonzero(flags & prevail & (left >= remaining) & (np.arange(n) > free[0]))
    top, bottom = int(free[0]), int(stops[0] if len(stops) else free[-1] + 1)
    return (top, bottom) if bottom - top >= least else (0, n)


def unbroken(flags: np.ndarray, gap: int = 6, least: int = 5) -> tuple[int, int]:
    """From the first free band through flagged gaps shorter than ``gap``; else the whole."""
    free = np.flatnonzero(~flags)
    if not len(free):
        return 0, len(flags)
    broken = np.flatnonzero(np.diff(free) - 1 >= gap)
    left, right = int(free[0]), int(free[broken[0] if len(broken) else -1]) + 1
    return (left, right) if right - left >= least else (0, len(flags))


def extent(gray: np.ndarray, level: float = 0.75) -> tuple[int, int, int, int]:
    """top, bottom, left, right of the photo in a strip: its gray rows, then its gray columns."""
    top, bottom = sustained(gray.mean(axis=1) >= level)
    left, right = unbroken(gray[top:bottom].mean(axis=0) >= level)
    return top, bottom, left, right


def layout(r: np.ndarray, g: np.ndarray, b: np.ndarray, bar: int, sibling: int, tallest: int, least: int) -> tuple[str, Box | None, Box | None]:
    """(status, golden, suspect) of a frame; see ``images.detect_layout``."""
    planes = hsv(r, g, b)
    blue = largest([x[:4] for x in region_boxes(of_color(planes, "blue"))], bar)
    if blue is None:
        return "no blue bar", None, None
    reds = [x[:4] for x in region_boxes(of_color(planes, "red"))]
    red = beside(blue, reds, sibling) or largest(reds, bar)
    if red is None:
        return "no red bar", None, None
    h, w = r.shape
    tall = min(tallest, h - max(blue[1] + blue[3], red[1] + red[3]) - 50)
    found = []
    for x, y, wide, high in (blue, red):
        x1, y1, x2, y2 = max(0, x), y + high, min(w, x + wide), min(h, y + high + tall)
        if y2 - y1 < least or x2 - x1 < least:
            return "empty photo", None, None
        top, bottom, left, right = extent(neutral(*(c[y1:y2, x1:x2] for c in (r, g, b))))
        found.append((x1 + left, y1 + top, right - left, bottom - top))
    return "ok", found[0], found[1]
