"""Regions of masks too large for a row, against the same regions found in one piece."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from argusline.functions.masks import region_boxes
from argusline.operators.components import components_of_masks, joined_parts, tile_parts


def pixels(spark, masks):
    """(image_id, y, x) of {image_id: mask}."""
    frames = []
    for i, m in masks.items():
        y, x = np.nonzero(m)
        frames.append(pd.DataFrame({"image_id": np.full(len(y), i), "y": y.astype(np.int32), "x": x.astype(np.int32)}))
    return spark.createDataFrame(pd.concat(frames))


def boxes(df):
    return {tuple(r) for r in df.collect()}


def want(masks):
    return {(i, n + 1, *map(int, b)) for i, m in masks.items() for n, b in enumerate(region_boxes(m))}


def test_random_masks(spark):
    rng = np.random.default_rng(4)
    masks = {i: rng.random((37, 53)) < share for i, share in enumerate((0.1, 0.3, 0.4, 0.6))}
    rows = pixels(spark, masks)
    assert boxes(components_of_masks(rows, tile=8)) == want(masks)
    assert boxes(components_of_masks(rows.unionByName(rows), tile=16)) == want(masks)  # repeated pixels


def test_a_spiral_through_many_tiles_is_one_region(spark):
    m = np.zeros((65, 65), bool)
    for k in range(0, 32, 2):  # rings, each joined with the next
        m[k, k : 65 - k] = m[64 - k, k : 65 - k] = m[k : 65 - k, k] = m[k : 65 - k, 64 - k] = True
        m[k + 1, k] = False
        m[k + 2, k + 1 : k + 2] = True
    assert boxes(components_of_masks(pixels(spark, {7: m}), tile=8)) == want({7: m})


def test_large_mask_shuffles_rims_only(spark):
    """8192 x 8192: filled rectangles, a frame around all and a diagonal line."""
    rng = np.random.default_rng(3)
    m = np.zeros((8192, 8192), bool)
    for y, x in rng.integers(100, 7900, (300, 2)).tolist():
        m[y : y + 70, x : x + 90] = True
    m[0] = m[-1] = m[:, 0] = m[:, -1] = True
    m[np.arange(20, 90), np.arange(20, 90)] = True
    rows = pixels(spark, {1: m})
    assert boxes(components_of_masks(rows)) == want({1: m})
    parts = tile_parts(rows)
    n = {r.kind: r["count"] for r in parts.groupBy("kind").count().collect()}
    assert n["at"] + n["to"] < 0.1 * rows.count()
    assert joined_parts(parts).count() < 2_000  # what the rounds work on


def test_odd_rows(spark):
    kind = "image_id string, y int, x int, area int"
    cells = [("a", -1, -1, 5), ("a", 0, 0, 5), ("a", None, 3, 5), (None, 1, 1, 5), ("b", 2_000_000, 2_000_000, 5), ("b", 2_000_001, 1_999_999, 5)]
    got = boxes(components_of_masks(spark.createDataFrame(cells, kind), tile=4))
    assert got == {("a", 1, -1, -1, 2, 2, 2), ("b", 1, 1_999_999, 2_000_000, 2, 2, 2)}
    assert components_of_masks(spark.createDataFrame(cells, kind).where(F.lit(False))).count() == 0
