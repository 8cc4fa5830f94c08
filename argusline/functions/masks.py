"""Connected regions of boolean masks (numpy), for use in Arrow batches."""

from __future__ import annotations

import numpy as np


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Horizontal runs of a mask: row, first and last + 1 column, and the region of each.

    Regions are 8-connected and numbered by their first pixel.
    """
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    begin = np.searchsorted(row, np.arange(mask.shape[0] + 1)).tolist()
    a, b = first.tolist(), end.tolist()
    for y in range(1, mask.shape[0]):
        i, j = begin[y - 1], begin[y]
        while i < begin[y] and j < begin[y + 1]:
            if a[i] <= b[j] and a[j] <= b[i]:  # they touch, corners too
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    return row, first, end, np.array([find(i) for i in range(len(row))], np.int64)


def region_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x, y, w, h and pixels of each region, in the order of first pixels."""
    row, first, end, region = runs_of(mask)
    if not len(row):
        return []
    order = np.argsort(region, kind="stable")
    at = np.flatnonzero(np.diff(region[order], prepend=-1))
    over = lambda f, v: f.reduceat(v[order], at)
    x, y = over(np.minimum, first), over(np.minimum, row)
    w, h = over(np.maximum, end) - x, over(np.maximum, row) + 1 - y
    return list(zip(*(v.tolist() for v in (x, y, w, h, over(np.add, end - first))), strict=True))


def linked_to(mask: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The regions of ``mask`` that hold a seed."""
    row, first, end, region = runs_of(mask)
    total = np.pad(np.cumsum(seeds.astype(np.int64), axis=1), ((0, 0), (1, 0)))
    kept = np.isin(region, region[total[row, end] > total[row, first]])
    out = np.zeros_like(mask)
    for y, x, e in zip(row[kept], first[kept], end[kept], strict=True):
        out[y, x:e] = True
    return out
