"""Kernels of image pairs (numpy), for use in Arrow batches.

Windows are summed-area tables and running extremes, so that a pixel costs the
same for any window; Gaussians are separable.  The conventions are those of
``pixels``: stencils mirror at the border without its pixels, morphology does
not count what is outside, gradients repeat the border.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from argusline.functions.masks import linked_to
from argusline.functions.pixels import GAUSS, TAN, element


def grid(px: np.ndarray | None, h: int | None, w: int | None) -> np.ndarray | None:
    """The image, or None if it is null, empty, of another size or has null or NaN pixels."""
    if px is None or not h or not w or h < 0 or w < 0 or len(px) != h * w:
        return None
    out = np.asarray(px, float).reshape(h, w)
    return None if np.isnan(out).any() else out


def _along(x: np.ndarray, taps: Sequence[float], axis: int, mode: str = "reflect") -> np.ndarray:
    """``axis`` 0 is down and 1 across an image, or each of a stack."""
    r, axis = len(taps) // 2, x.ndim - 2 + axis
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, r)
    p, n = np.pad(x, pad, mode=mode), x.shape[axis]
    out = 0.0
    for i, k in enumerate(taps):
        if k:
            out = out + k * p[(slice(None),) * axis + (slice(i, i + n),)]
    return out


def blur(x: np.ndarray, size: int) -> np.ndarray:
    taps = np.array(GAUSS[size], float) / sum(GAUSS[size])
    return _along(_along(x, taps, 1), taps, 0)


def local_ink(x: np.ndarray, size: int, c: float) -> np.ndarray:
    """Darker than the Gaussian mean around by ``c``."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    one = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    one /= one.sum()
    return x <= _along(_along(x, one, 1), one, 0) - c


def window_sums(x: np.ndarray, win: int) -> np.ndarray:
    """Sums of all ``win`` x ``win`` windows that lie inside."""
    s = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return s[win:, win:] - s[:-win, win:] - s[win:, :-win] + s[:-win, :-win]


def ssim_map(a: np.ndarray, b: np.ndarray, win: int = 7, full: bool = False) -> np.ndarray | None:
    """Structural similarity of every window inside (or, mirrored, of every pixel); None if none fits."""
    if full:
        a, b = (np.pad(x, win // 2, mode="symmetric") for x in (a, b))
    if min(a.shape) < win:
        return None
    n = win * win
    k, c1, c2 = n / (n - 1), (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ua, ub, aa, bb, ab = (window_sums(x, win) / n for x in (a, b, a * a, b * b, a * b))
    va, vb, vab = k * (aa - ua * ua), k * (bb - ub * ub), k * (ab - ua * ub)
    return ((2 * ua * ub + c1) * (2 * vab + c2)) / ((ua * ua + ub * ub + c1) * (va + vb + c2))


def _reach(mask: np.ndarray, left: int, right: int, axis: int) -> np.ndarray:
    """Whether any of the pixels from ``left`` to ``right`` of each is set."""
    n = mask.shape[axis]
    total = np.concatenate([np.zeros_like(mask[:1] if axis == 0 else mask[:, :1], np.int32), mask.cumsum(axis, dtype=np.int32)], axis)
    at = np.arange(n)
    low, high = np.clip(at + left, 0, n), np.clip(at + right + 1, 0, n)
    return total.take(high, axis) > total.take(np.minimum(low, high), axis)


def _dilated(mask: np.ndarray, size: int | tuple[int, int], ellipse: bool) -> np.ndarray:
    rows = element(size, ellipse)
    if not ellipse:
        return _reach(_reach(mask, *rows[0][1:], axis=1), rows[0][0], rows[-1][0], axis=0)
    h, out = len(mask), np.zeros_like(mask)
    for dy, left, right in rows:
        if abs(dy) < h:
            wide = _reach(mask, left, right, axis=1)
            out[max(0, -dy) : h - max(0, dy)] |= wide[max(0, dy) : h + min(0, dy)]
    return out


def morph(mask: np.ndarray, op: str, size: int | tuple[int, int] = 3, ellipse: bool = False, times: int = 1) -> np.ndarray:
    """dilate, erode, open or close, ``times`` over."""
    if op in ("open", "close"):
        first, then = ("erode", "dilate") if op == "open" else ("dilate", "erode")
        return morph(morph(mask, first, size, ellipse, times), then, size, ellipse, times)
    for _ in range(times):
        mask = _dilated(mask, size, ellipse) if op == "dilate" else ~_dilated(~mask, size, ellipse)
    return mask


def edges(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Ridges of the Sobel magnitude over ``low`` that are linked with one over ``high``; of an image or a stack."""
    gx = _along(_along(x, (-1, 0, 1), 1, "edge"), (1, 2, 1), 0, "edge")
    gy = _along(_along(x, (1, 2, 1), 1, "edge"), (-1, 0, 1), 0, "edge")
    u, v = np.abs(gx), np.abs(gy)
    m = u + v
    p, (h, w) = np.pad(m, [(0, 0)] * (x.ndim - 2) + [(1, 1)] * 2), x.shape[-2:]
    near = lambda dy, dx: p[..., 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    level = (m > near(0, -1)) & (m >= near(0, 1))
    plumb = (m > near(-1, 0)) & (m >= near(1, 0))
    falling = gx * gy < 0
    slant = np.where(falling, (m > near(-1, 1)) & (m > near(1, -1)), (m > near(-1, -1)) & (m > near(1, 1)))
    ridge = (m > low) & np.where(v < TAN * u, level, np.where(v > (TAN + 2) * u, plumb, slant))
    # A stack is one tall image, an empty row below each.
    tall = lambda y: np.pad(y, [(0, 0)] * (x.ndim - 2) + [(0, 1), (0, 0)]).reshape(-1, w)
    return linked_to(tall(ridge), tall(ridge & (m > high))).reshape(*x.shape[:-2], h + 1, w)[..., :h, :]


@lru_cache(maxsize=64)
def _hann(h: int, w: int) -> np.ndarray:
    return np.outer(*(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1)) for n in (h, w)))


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Displacement (dx, dy) of ``b`` against ``a``, with parts of pixels.

    The peak of the windowed, normalised cross-power spectrum gives whole
    pixels; what is left is fitted by least squares over the gradients of the
    part that both images show.
    """
    h, w = a.shape
    fa, fb = (np.fft.fft2((x - x.mean()) * _hann(h, w)) for x in (a, b))
    cross = fb * fa.conj()
    size = np.abs(cross)
    if not size.max() > 1e-9:
        return 0.0, 0.0
    c = np.fft.ifft2(cross / np.maximum(size, 1e-9 * size.max())).real
    y, x = (int(i) for i in np.unravel_index(int(c.argmax()), c.shape))
    y, x = y - h * (y > h // 2), x - w * (x > w // 2)
    cut = lambda n, d: (slice(max(0, -d), n - max(0, d)), slice(max(0, d), n + min(0, d)))
    (ay, by), (ax, bx) = cut(h, y), cut(w, x)
    dx, dy = _rest(a[ay, ax], b[by, bx])
    return x + dx, y + dy


def _rest(a: np.ndarray, b: np.ndarray, rounds: int = 4) -> tuple[float, float]:
    """The displacement, within a pixel, of ``b`` against ``a``; none where the gradients do not tell."""
    h, w = a.shape
    dx = dy = 0.0
    if min(h, w) < 5:
        return dx, dy
    inner = np.s_[2:-2, 2:-2]
    for _ in range(rounds):
        near = _sampled(b, np.arange(h) + dy, np.arange(w) + dx)
        gy, gx = (g[inner].ravel() for g in np.gradient((a + near) / 2))
        t = (near - a)[inner].ravel()
        xx, xy, yy = gx @ gx, gx @ gy, gy @ gy
        det = xx * yy - xy * xy
        if det <= 1e-9 * max(xx, yy, 1e-300) ** 2:
            return 0.0, 0.0
        sx, sy = (yy * (gx @ t) - xy * (gy @ t)) / det, (xx * (gy @ t) - xy * (gx @ t)) / det
        dx, dy = dx - sx, dy - sy
        if max(abs(dx), abs(dy)) > 1:
            return 0.0, 0.0
    return float(dx), float(dy)


def moved(x: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """``x`` moved by (dx, dy), bilinear, borders repeat; as it is from a quarter of the size."""
    h, w = x.shape
    if not (abs(dx) < 0.25 * w and abs(dy) < 0.25 * h):
        return x
    return _sampled(x, np.arange(h) - dy, np.arange(w) - dx)


def _sampled(x: np.ndarray, sy: np.ndarray, sx: np.ndarray) -> np.ndarray:
    h, w = x.shape
    sy, sx = np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)
    y, z = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = (sy - y)[:, None], (sx - z)[None, :]
    rows = x[y] * (1 - fy) + x[np.minimum(h - 1, y + 1)] * fy
    return rows[:, z] * (1 - fx) + rows[:, np.minimum(w - 1, z + 1)] * fx


def resample(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear with half-pixel centres."""
    return _sampled(x, (np.arange(h) + 0.5) * x.shape[0] / h - 0.5, (np.arange(w) + 0.5) * x.shape[1] / w - 0.5)


def histogram(x: np.ndarray, high: float, bins: int) -> np.ndarray:
    at = np.floor(x.ravel() * bins / high)
    return np.bincount(at[(at >= 0) & (at < bins)].astype(int), minlength=bins).astype(float)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson's; two constants agree, one does not with anything."""
    x, y = a - a.mean(), b - b.mean()
    n = math.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / n) if n > 0 else float(not x.any() and not y.any())


def structure(x: np.ndarray, side: int = 64, parts: int = 4, bins: int = 32) -> np.ndarray:
    """128 numbers: edge shares and gray means of 4 x 4 tiles, histograms of hue, saturation and value (gray: the value's only)."""
    x = resample(x, side, side)
    tiles = lambda m: m.reshape(parts, side // parts, parts, side // parts).mean(axis=(1, 3)).ravel()
    flat = histogram(np.zeros_like(x), 1, bins)
    counts = [flat, flat, histogram(x, 256, bins)]
    return np.concatenate([tiles(edges(x, 50, 150)), tiles(x) / 255, *[c / max(np.sqrt((c * c).sum()), 1e-300) for c in counts]])


def block_means(x: np.ndarray, block: int) -> np.ndarray:
    """Means of ``block`` x ``block`` tiles of each image of a stack, row by row, / 255."""
    n, h, w = x.shape
    cells = [x[:, i : h // block * block : block, j : w // block * block : block] for i in range(block) for j in range(block)]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    return (total / (block * block) / 255).reshape(n, -1)


def histograms(x: np.ndarray, high: float, bins: int) -> np.ndarray:
    """L2-normalised counts of ``bins`` equal bins from 0 for each row; the upper bound is exclusive."""
    row, _ = np.nonzero(ok := (x >= 0) & (x < high))
    counts = np.bincount(row * bins + np.floor(x[ok] * bins / high).astype(int), minlength=len(x) * bins).reshape(len(x), bins).astype(float)
    size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, size, out=np.zeros_like(counts), where=size > 0)


def structures(hue: np.ndarray, s: np.ndarray, v: np.ndarray, gray: np.ndarray, block: int, low: float, high: float, bins: int = 32) -> np.ndarray:
    """For each image of four stacks: means of edge and of gray tiles, then histograms of hue (to 180), saturation and value."""
    n = len(gray)
    counts = [histograms(x.reshape(n, -1), top, bins) for x, top in ((hue, 180.0), (s, 256.0), (v, 256.0))]
    return np.hstack([block_means(np.where(edges(gray, low, high), 255.0, 0.0), block), block_means(gray, block), *counts])
