"""Colour columns and row-major image arrays (values 0..255)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from argusline.functions.vectors import histogram, norm

# Colour ranges (low and high h, s, v; h up to 180) of the marks.
COLORS = {
    "blue": (((100, 150, 50), (130, 255, 255)),),
    "red": (((0, 150, 50), (10, 255, 255)), ((170, 150, 50), (180, 255, 255))),
    "green": (((40, 100, 50), (80, 255, 255)),),
    "tight green": (((50, 150, 100), (75, 255, 255)),),
}
TAN = 0.4142135623730951  #: of 22.5 degrees
GAUSS = {3: (1, 2, 1), 5: (1, 4, 6, 4, 1), 7: (2, 7, 14, 18, 14, 7, 2)}


def to_gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0..180, saturation and value 0..255, as doubles."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    h = F.when(d == 0, 0.0).when(top == r, 60 * F.try_divide(g - b, d)).when(top == g, 120 + 60 * F.try_divide(b - r, d)).otherwise(240 + 60 * F.try_divide(r - g, d))
    h = F.when(h < 0, h + 360).otherwise(h) / 2
    return h, F.coalesce(255 * F.try_divide(d, top), F.lit(0.0)), top.cast("double")


def color_mask(h: Column, s: Column, v: Column, ranges) -> Column:
    """Whether a colour lies in one of the inclusive ranges."""
    out = F.lit(False)
    for low, high in ranges:
        out = out | (h.between(low[0], high[0]) & s.between(low[1], high[1]) & v.between(low[2], high[2]))
    return out


def neutral_mask(r: Column, g: Column, b: Column, s: Column) -> Column:
    """Interface gray: spread up to 15, mean 178 to 218, saturation up to 25."""
    return (F.greatest(r, g, b) - F.least(r, g, b) <= 15) & F.floor((r + g + b) / 3).between(178, 218) & (s <= 25)


def crop(px: Column, h: Column, w: Column, x: Column, y: Column, cw: Column, ch: Column) -> Column:
    """Pixels of a box clamped to the image; the whole image if nothing is left."""
    x1, y1 = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    x2, y2 = F.least(w, x + cw), F.least(h, y + ch)
    rows = F.flatten(F.transform(F.sequence(y1, y2 - 1), lambda r: F.slice(px, (r * w + x1 + 1).cast("int"), (x2 - x1).cast("int"))))
    return F.when((x2 > x1) & (y2 > y1), rows).otherwise(px)


Box = tuple[Column, Column, Column, Column]


def central_box(h: Column, w: Column, top: float, side: float) -> Box:
    """x, y, w, h without the shares ``top`` above and below and ``side`` left and right."""
    y, x = F.floor(h * top).cast("int"), F.floor(w * side).cast("int")
    degenerate = (2 * y >= h) | (2 * x >= w)
    pick = lambda a, b: F.when(degenerate, b).otherwise(a)
    return pick(x, F.lit(0)), pick(y, F.lit(0)), pick(w - 2 * x, w), pick(h - 2 * y, h)


def grown_box(x: Column, y: Column, w: Column, h: Column, least: float, share: float = 0.0) -> Box:
    """A box with a margin of ``least`` pixels or a share of its longer side, if more."""
    by = F.greatest(F.lit(least), F.greatest(w, h) * share).cast("int")
    return x - by, y - by, w + 2 * by, h + 2 * by


def _reflect(i: Column, n: Column) -> Column:
    """Border without repeating the edge pixel."""
    i = F.abs(i)
    return F.when(i >= n, 2 * (n - 1) - i).otherwise(i)


def let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once.

    The optimizer would else put a computed array's expression wherever a
    lambda reads an element of it.
    """
    return F.element_at(F.transform(F.array(value), of), 1)


def _at(px: Column, i: Column) -> Column:
    return F.get(px, i.cast("int"))


def _grid(h: Column, w: Column, of) -> Column:
    """Array of ``of(y, x)`` over all pixels, row by row."""
    return F.transform(F.sequence(F.lit(0), h * w - 1), lambda i: of(F.floor(i / w).cast("int"), (i % w).cast("int")))


def stencil(px: Column, h: Column, w: Column, kernel: Sequence[Sequence[float]], repeat: bool = False) -> Column:
    """Weighted sum of each neighbourhood, mirrored at the border (or its pixels repeated)."""
    ky, kx = len(kernel) // 2, len(kernel[0]) // 2
    inner = (lambda i, n: F.greatest(F.lit(0), F.least(n - 1, i))) if repeat else _reflect

    def of(px: Column, y: Column, x: Column) -> Column:
        out = None
        for dy, row in enumerate(kernel):
            for dx, k in enumerate(row):
                if k:
                    term = _at(px, inner(y + (dy - ky), h) * w + inner(x + (dx - kx), w)) * float(k)
                    out = term if out is None else out + term
        return out

    return let(px, lambda p: _grid(h, w, lambda y, x: of(p, y, x)))


def gaussian(size: int) -> list[list[float]]:
    one = GAUSS[size]
    total = sum(one) ** 2
    return [[a * b / total for b in one] for a in one]


def element(size: int | tuple[int, int], ellipse: bool = False) -> list[tuple[int, int, int]]:
    """Rows (dy, first dx, last dx) of a morphology element; size is a side or (w, h).

    The anchor is ``size // 2``, so even sizes reach one pixel further back.
    """
    w, h = (size, size) if isinstance(size, int) else size
    rows = []
    for dy in range(-(h // 2), h - h // 2):
        if ellipse:
            reach = round(w // 2 * (1 - (dy / (h // 2)) ** 2) ** 0.5) if h > 1 else w // 2
            rows.append((dy, -reach, reach))
        else:
            rows.append((dy, -(w // 2), w - w // 2 - 1))
    return rows


def _passed(mask: Column, h: Column, w: Column, dilate: bool, rows: Sequence[tuple[int, int, int]]) -> Column:
    """One pass of an element; pixels outside the image do not count."""
    hit = (lambda part: F.exists(part, lambda v: v)) if dilate else (lambda part: F.forall(part, lambda v: v))

    def of(mask: Column, y: Column, x: Column) -> Column:
        terms = []
        for dy, left, right in rows:
            x1, x2 = F.greatest(F.lit(0), x + left), F.least(w - 1, x + right)
            part = F.slice(mask, ((y + dy) * w + x1 + 1).cast("int"), F.greatest(F.lit(0), x2 - x1 + 1).cast("int"))
            terms.append(F.when((y + dy >= 0) & (y + dy < h), hit(part)).otherwise(not dilate))
        out = terms[0]
        for t in terms[1:]:
            out = (out | t) if dilate else (out & t)
        return out

    return let(mask, lambda m: _grid(h, w, lambda y, x: of(m, y, x)))


def morph(mask: Column, h: Column, w: Column, op: str, size: int | tuple[int, int] = 3, ellipse: bool = False, times: int = 1) -> Column:
    """dilate, erode, open or close of a boolean mask, ``times`` over.

    The element is a rectangle, worked along rows and then columns, or an ellipse.
    """
    if op in ("open", "close"):
        first, then = ("erode", "dilate") if op == "open" else ("dilate", "erode")
        return morph(morph(mask, h, w, first, size, ellipse, times), h, w, then, size, ellipse, times)
    rows = element(size, ellipse)
    steps = [rows] if ellipse else [[(0, *rows[0][1:])], [(dy, 0, 0) for dy, _, _ in rows]]
    for _ in range(times):
        for step in steps:
            mask = _passed(mask, h, w, op == "dilate", step)
    return mask


def mask_op(a: Column, b: Column, op: str) -> Column:
    f = {"or": lambda x, y: x | y, "and": lambda x, y: x & y, "xor": lambda x, y: x != y}[op]
    return F.zip_with(a, b, f)


def mask_not(a: Column) -> Column:
    return F.transform(a, lambda x: ~x)


def count_true(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda x: x))


def border_ignore(mask: Column, h: Column, w: Column, margin: int) -> Column:
    """Flags in the outer margin are cleared."""
    inside = lambda i, n: (i >= margin) & (i < n - margin)
    return let(mask, lambda m: _grid(h, w, lambda y, x: _at(m, y * w + x) & inside(y, h) & inside(x, w)))


def threshold(px: Column, level: float, inverse: bool = False) -> Column:
    return F.transform(px, (lambda v: v <= level) if inverse else (lambda v: v > level))


def local_threshold(px: Column, h: Column, w: Column, size: int = 15, c: float = 3) -> Column:
    """Darker than the Gaussian mean around it by more than ``c``."""
    import math

    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    one = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    one = [v / sum(one) for v in one]
    mean = stencil(stencil(px, h, w, [one]), h, w, [[v] for v in one])
    return F.zip_with(px, mean, lambda v, m: v <= m - c)


def resample(px: Column, h: Column, w: Column, oh: Column | int, ow: Column | int) -> Column:
    """Bilinear with half-pixel centres."""
    oh, ow = F.lit(oh), F.lit(ow)

    def of(px: Column, y: Column, x: Column) -> Column:
        sy = F.greatest(F.lit(0.0), F.least(h - 1.0, (y + 0.5) * h / oh - 0.5))
        sx = F.greatest(F.lit(0.0), F.least(w - 1.0, (x + 0.5) * w / ow - 0.5))
        y0, x0 = F.floor(sy).cast("int"), F.floor(sx).cast("int")
        y1, x1 = F.least(h - 1, y0 + 1), F.least(w - 1, x0 + 1)
        fy, fx = sy - y0, sx - x0
        top = _at(px, y0 * w + x0) * (1 - fx) + _at(px, y0 * w + x1) * fx
        low = _at(px, y1 * w + x0) * (1 - fx) + _at(px, y1 * w + x1) * fx
        return top * (1 - fy) + low * fy

    return let(px, lambda p: _grid(oh, ow, lambda y, x: of(p, y, x)))


def apply_shift(px: Column, h: Column, w: Column, dx: Column, dy: Column, zero: bool = False) -> Column:
    """Moved by (dx, dy) if under a quarter of the size; borders repeat or are 0."""

    def of(px: Column, y: Column, x: Column) -> Column:
        sy, sx = y - dy, x - dx
        inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
        clamp = lambda i, n: F.greatest(F.lit(0), F.least(n - 1, i))
        value = _at(px, clamp(sy, h) * w + clamp(sx, w))
        return F.when(inside, value).otherwise(0.0) if zero else value

    fits = (F.abs(dx) < 0.25 * w) & (F.abs(dy) < 0.25 * h)
    return F.when(fits, let(px, lambda p: _grid(h, w, lambda y, x: of(p, y, x)))).otherwise(px)


def gradients(px: Column, h: Column, w: Column) -> Column:
    """Sobel magnitude |gx| + |gy|."""
    gx = stencil(px, h, w, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    gy = stencil(px, h, w, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
    return F.zip_with(gx, gy, lambda a, b: F.abs(a) + F.abs(b))


def edge_classes(px: Column, h: Column, w: Column, low: float, high: float) -> Column:
    """2 on strong and 1 on weak ridges of the Sobel magnitude |gx| + |gy|, else 0.

    A ridge is no lower than its two neighbours across the edge (in one of four
    directions) and over ``low``; strong ones are over ``high``.
    """
    gx = stencil(px, h, w, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], repeat=True)
    gy = stencil(px, h, w, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]], repeat=True)

    def of(g: Column, m: Column, y: Column, x: Column) -> Column:
        i = y * w + x
        here, u, v = _at(m, i), F.abs(_at(g["x"], i)), F.abs(_at(g["y"], i))
        near = lambda dy, dx: F.when((y + dy >= 0) & (y + dy < h) & (x + dx >= 0) & (x + dx < w), _at(m, i + dy * w + dx)).otherwise(0.0)
        s = F.when(_at(g["x"], i) * _at(g["y"], i) < 0, -1).otherwise(1)
        level = (here > near(0, -1)) & (here >= near(0, 1))
        plumb = (here > near(-1, 0)) & (here >= near(1, 0))
        slant = (here > near(F.lit(-1), -s)) & (here > near(F.lit(1), s))
        ridge = F.when(v < TAN * u, level).when(v > (TAN + 2) * u, plumb).otherwise(slant)
        return F.when((here > low) & ridge, F.when(here > high, 2).otherwise(1)).otherwise(0)

    return let(F.struct(gx.alias("x"), gy.alias("y")), lambda g: let(F.zip_with(g["x"], g["y"], lambda a, b: F.abs(a) + F.abs(b)), lambda m: _grid(h, w, lambda y, x: of(g, m, y, x))))


def padded(px: Column, h: Column, w: Column, r: int) -> Column:
    """The image with ``r`` pixels more on each side, mirrored with the edge pixel."""
    fold = lambda i, n: F.when(i < 0, -1 - i).when(i >= n, 2 * n - 1 - i).otherwise(i)
    return let(px, lambda p: _grid(h + 2 * r, w + 2 * r, lambda y, x: _at(p, fold(y - r, h) * w + fold(x - r, w))))


def ssim_full(a: Column, b: Column, h: Column, w: Column, win: int = 7) -> Column:
    """Structural similarity of every pixel's window, mirrored at the border."""
    r = win // 2
    return let(padded(a, h, w, r), lambda p: let(padded(b, h, w, r), lambda q: ssim(p, q, h + 2 * r, w + 2 * r, win)))


def block_means(px: Column, h: Column, w: Column, block: int) -> Column:
    """Means of ``block`` x ``block`` tiles, row by row, / 255."""

    def of(px: Column, y: Column, x: Column) -> Column:
        cells = [_at(px, (y * block + i) * w + x * block + j) for i in range(block) for j in range(block)]
        total = cells[0]
        for c in cells[1:]:
            total = total + c
        return total / (block * block) / 255

    return let(px, lambda p: _grid(F.floor(h / block).cast("int"), F.floor(w / block).cast("int"), lambda y, x: of(p, y, x)))


def ssim(a: Column, b: Column, h: Column, w: Column, win: int = 7) -> Column:
    """Per interior pixel the structural similarity of its window."""
    r, n = win // 2, win * win
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    sums = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    def of(i: Column) -> Column:
        y, x = F.floor(i / (w - 2 * r)).cast("int"), (i % (w - 2 * r)).cast("int")
        window = lambda px: F.flatten(F.transform(F.sequence(y, y + (win - 1)), lambda row: F.slice(px, (row * w + x + 1).cast("int"), win)))
        parts = F.array(total(window(a)), total(window(b)), sums(window(a), window(a)), sums(window(b), window(b)), sums(window(a), window(b)))
        # One element, so that the sums are computed once.
        return F.element_at(F.transform(F.array(parts), _of_sums), 1)

    def _of_sums(s: Column) -> Column:
        ua, ub = s[0] / n, s[1] / n
        k = n / (n - 1)
        va, vb, vab = k * (s[2] / n - ua * ua), k * (s[3] / n - ub * ub), k * (s[4] / n - ua * ub)
        return ((2 * ua * ub + c1) * (2 * vab + c2)) / ((ua * ua + ub * ub + c1) * (va + vb + c2))

    return F.transform(F.sequence(F.lit(0), (h - 2 * r) * (w - 2 * r) - 1), of)


def hsv_histograms(h: Column, s: Column, v: Column, bins: int = 32) -> Column:
    """Three L2-normalised histograms, one after the other."""
    parts = []
    for a, high in ((h, 180.0), (s, 256.0), (v, 256.0)):
        counts = histogram(a, 0.0, high, bins)
        # A second parameter of the inner lambda would be the element's index.
        parts.append(let(counts, lambda c: F.transform(c, lambda x: F.coalesce(F.try_divide(x, norm(c)), F.lit(0.0)))))
    return F.concat(*parts)
