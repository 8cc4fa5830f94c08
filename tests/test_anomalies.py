"""Anomalies of a pair: the rules of boxes against the table operators, one pass over the pairs."""

import numpy as np
from pyspark.sql import functions as F

from argusline.functions import anomalies as A
from argusline.functions import pixels as P
from argusline.operators import boxes, images
from argusline.plans import catalog


def test_boxes_equal_the_table_operators(spark):
    rng = np.random.default_rng(8)
    rows = [(i, j, *map(int, rng.integers(0, 25, 2)), *map(int, rng.integers(5, 60, 2))) for i in range(80) for j in range(1, 9)]
    table = spark.createDataFrame(rows, "image_id long, ord int, x int, y int, w int, h int")
    kept = boxes.dedup_boxes(table, 12)
    inner = boxes.box_contained(kept)
    top = {r.image_id: r.ord for r in boxes.extreme_box(kept, largest=True).collect()}
    own = {i: A.deduped([r[1:] for r in rows if r[0] == i], 12) for i in range(80)}
    assert {(i, *b) for i, bs in own.items() for b in bs} == {tuple(r) for r in kept.collect()}
    first = {i: max(bs, key=lambda b: (b[3] * b[4], -b[0])) for i, bs in own.items()}
    assert {i: b[0] for i, b in first.items()} == top
    want = {(r.image_id, r.ord) for r in inner.collect()}
    assert {(i, b[0]) for i, bs in own.items() for b in A.contained(first[i], bs)} == want and len(want) > 20


def test_differences_equal_the_columns(spark):
    rng = np.random.default_rng(9)
    side, names = 20, [f"{s}_{c}" for s in ("gab", "test") for c in "rgb"]
    planes = [[x, x + 3, x - 5] for x in (rng.integers(20, 90, (side, side)).astype(float) for _ in range(6))]
    pairs = []
    for n, p in enumerate(planes):
        q = [x.copy() for x in p]
        for k, x in enumerate(q):
            x[4 + n : 13 + n, 5:16] = 255 - x[4 + n : 13 + n, 5:16] - 7 * k
            x[1:3, 1:4] = (0, 200, 0)[k]
        pairs.append((p, q))
    df = spark.createDataFrame([(i, side, side, *(x.ravel().tolist() for x in (*p, *q))) for i, (p, q) in enumerate(pairs)], "i int, h int, w int, " + ", ".join(f"{n} array<double>" for n in names))
    h, w = F.col("h"), F.col("w")
    df = df.withColumn("ui", P.mask_op(images.color_pixels("gab_", "green", "red", "blue"), images.color_pixels("test_", "green", "red", "blue"), "or"))
    df = df.withColumns({n: P.stencil(F.col(n), h, w, P.gaussian(3)) for n in names})
    gray = lambda *c: F.transform(F.arrays_zip(*[x.alias(str(i)) for i, x in enumerate(c)]), lambda p: P.to_gray(p["0"], p["1"], p["2"]))
    apart = gray(*[F.zip_with(f"gab_{c}", f"test_{c}", lambda a, b: F.abs(a - b)) for c in "rgb"])
    df = df.select("i", "h", "w", P.morph(F.col("ui"), h, w, "dilate", 3, times=2).alias("ui"), apart.alias("d"), gray(*[F.col(f"gab_{c}") for c in "rgb"]).alias("a"), gray(*[F.col(f"test_{c}") for c in "rgb"]).alias("b"))
    df = df.withColumn("m", P.ssim_full(F.col("a"), F.col("b"), h, w, 3))
    mask = F.zip_with(F.zip_with(F.transform("m", lambda v: F.floor(F.greatest(v, F.lit(0.0)) * 255) <= 100), F.transform("d", lambda v: v > 30), lambda x, y: x & y), "ui", lambda x, y: x & ~y)
    df = df.select("i", "h", "w", P.border_ignore(mask, h, w, 2).alias("m"))
    df = df.select("i", P.morph(P.morph(F.col("m"), h, w, "open", 3, ellipse=True, times=2), h, w, "close", 3).alias("m"))
    got = {r.i: np.array(r.m).reshape(side, side) for r in df.collect()}
    for i, (p, q) in enumerate(pairs):
        mine = A.unlike(p, q, 3, 2, 3, 100, 30, 3, 3)
        assert (mine == got[i]).all()
    assert any(m.any() for m in got.values())


def test_anomalies_are_one_pass(spark):
    """No join and no shuffle but that of the line items; odd images fail no job."""
    plan = catalog.QUERIES["detect_anomalies"](spark, "/root/testdata/sf0.01")._jdf.queryExecution()
    assert "Join" not in plan.optimizedPlan().toString() and plan.executedPlan().toString().count("Exchange") == 1
    plain = [80.0] * 100
    rows = [(1, 10, 10, *[plain] * 6), (2, 10, 10, *[plain] * 5, None), (3, 10, 10, None, *[plain] * 5), (4, 9, 10, *[plain] * 6)]
    pairs = spark.createDataFrame(rows, "pair_id long, h int, w int, " + ", ".join(f"{s}_{c} array<double>" for s in ("gab", "test") for c in "rgb"))
    assert sorted(tuple(r) for r in images.detect_anomalies(pairs).collect()) == [(i, "global", 0, 0, 0, 10, 9 if i == 4 else 10) for i in (1, 2, 3, 4)]
