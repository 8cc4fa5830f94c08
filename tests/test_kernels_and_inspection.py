"""Image kernels at real sizes, odd images, part index and end-to-end inspection."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from argusline.functions import kernels as K
from argusline.functions import pixels as P
from argusline.functions.masks import linked_to
from argusline.operators import images, inspection, knn, routing


def pair_table(spark, pairs):
    rows = [(i, *(a.shape if a is not None else (4, 4)), *(None if x is None else x.ravel().tolist() for x in (a, b))) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "pair_id int, h int, w int, gab array<double>, test array<double>")


def textured(rng, h, w, rounds=2):
    x = rng.normal(size=(h, w))
    for _ in range(rounds):
        x = K.blur(x, 5)
    return np.clip(128 + 60 * x / x.std(), 0, 255)


def test_kernels_equal_the_columns(spark):
    rng = np.random.default_rng(0)
    rows = [(i, h, w, rng.integers(0, 255, h * w).astype(float).tolist()) for i, (h, w) in enumerate([(12, 15), (9, 9), (20, 7)])]
    df = spark.createDataFrame(rows, "i int, h int, w int, px array<double>")
    h, w, px = F.col("h"), F.col("w"), F.col("px")
    mask = F.transform("px", lambda v: v > 150)
    got = df.select(
        "h", "w", "px", P.stencil(px, h, w, P.gaussian(5)).alias("blur"), P.local_threshold(px, h, w, 7, 3).alias("ink"), P.edge_classes(px, h, w, 50, 150).alias("edges"),
        P.morph(mask, h, w, "open", 2).alias("open"), P.morph(mask, h, w, "close", (4, 3)).alias("close"), P.morph(mask, h, w, "dilate", 5, ellipse=True).alias("ellipse"),
        P.ssim_full(px, F.reverse(px), h, w).alias("ssim"), P.resample(px, h, w, 8, 11).alias("resampled"), P.apply_shift(px, h, w, F.lit(1), F.lit(-1)).alias("moved"),
    ).collect()
    for r in got:
        x = np.array(r.px).reshape(r.h, r.w)
        classes = np.array(r.edges).reshape(x.shape)
        assert np.abs(K.blur(x, 5).ravel() - r.blur).max() < 1e-9 and (K.local_ink(x, 7, 3).ravel() == r.ink).all()
        assert (K.edges(x, 50, 150) == linked_to(classes > 0, classes == 2)).all()
        assert (K.morph(x > 150, "open", 2).ravel() == r.open).all() and (K.morph(x > 150, "close", (4, 3)).ravel() == r.close).all()
        assert (K.morph(x > 150, "dilate", 5, ellipse=True).ravel() == r.ellipse).all()
        assert np.abs(K.ssim_map(x, x.ravel()[::-1].reshape(x.shape), 7, full=True).ravel() - r.ssim).max() < 1e-9
        assert np.abs(K.resample(x, 8, 11).ravel() - r.resampled).max() < 1e-9 and np.abs(K.moved(x, 1, -1).ravel() - r.moved).max() < 1e-9


def test_phase_shift_over_the_full_range(spark):
    big = textured(np.random.default_rng(1), 420, 420)
    moves = [(0, 0), (3, -5), (40.5, -30.25), (-55, 60), (0.4, 0.3), (64, 64), (-17.75, 0)]
    at = np.arange(80, 336)
    pairs = [(big[80:336, 80:336], K._sampled(big, at - dy, at - dx)) for dx, dy in moves]
    got = {r.pair_id: (r.dx, r.dy) for r in images.phase_shift(pair_table(spark, [*pairs, (np.zeros((4, 9)), np.zeros((4, 9)))])).collect()}
    for i, (dx, dy) in enumerate(moves):
        assert got[i] == pytest.approx((dx, dy), abs=0.1)
    assert got[len(moves)] == (None, None)
    flat = np.full((20, 20), 7.0)
    assert K.phase_shift(flat, flat) == (0.0, 0.0) and K.phase_shift(flat, big[:20, :20])[0] is not None


def plain_ink(a, b, dx, dy, size=15, c=3, grow=4, border=3, close=(15, 5), tolerance=0.05, least=10, margin=5):
    """Every step by its definition, window by window."""
    h, w = a.shape
    b = np.array([[b[min(h - 1, max(0, y + dy)), min(w - 1, max(0, x + dx))] for x in range(w)] for y in range(h)])
    mirror = lambda i, n: abs(i) if i < n else 2 * (n - 1) - i
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    taps = np.array([math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)])
    taps /= taps.sum()

    def weighted(x, k):
        r = len(k) // 2
        return np.array([[sum(k[i] * k[j] * x[mirror(y + i - r, h), mirror(z + j - r, w)] for i in range(len(k)) for j in range(len(k))) for z in range(w)] for y in range(h)])

    def passed(m, ew, eh, any_):
        look = lambda y, x: m[max(0, y - eh // 2) : y + eh - eh // 2, max(0, x - ew // 2) : x + ew - ew // 2]
        return np.array([[look(y, x).any() if any_ else look(y, x).all() for x in range(w)] for y in range(h)])

    masks = []
    for x in (a, b):
        soft = weighted(x, np.array([0.25, 0.5, 0.25]))
        masks.append(passed(passed(soft <= weighted(soft, taps) - c, 2, 2, False), 2, 2, True))
    diff = passed(masks[0], grow, grow, True) ^ masks[1]
    for y in range(h):
        for x in range(w):
            if y <= border or x <= border or y >= h - border or x >= w - border:
                diff[y, x] = False
    diff = passed(passed(diff, *close, True), *close, False)
    error = diff.mean()
    if error <= tolerance:
        return error, False, None
    seen, best = np.zeros_like(diff), (0, None)
    for y, x in np.argwhere(diff):
        todo, cells = [(y, x)], []
        while todo:
            p = todo.pop()
            if 0 <= p[0] < h and 0 <= p[1] < w and diff[p] and not seen[p]:
                seen[p] = True
                cells.append(p)
                todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        if len(cells) > best[0]:
            ys, xs = zip(*cells)
            best = len(cells), (max(0, min(xs) - margin), max(0, min(ys) - margin), min(w, max(xs) - min(xs) + 1 + 2 * margin), min(h, max(ys) - min(ys) + 1 + 2 * margin))
    return error, True, best[1] if best[0] > least else None


def test_ink_error_by_its_definition_at_defaults(spark):
    rng = np.random.default_rng(2)
    pairs, moves = [], [(0, 0), (2, -1), (0, 0)]
    for k, (dx, dy) in enumerate(moves):
        a = 200 + rng.integers(-2, 3, (48, 64)).astype(float)
        for x in range(8, 56, 9):
            a[10:38, x : x + 3] = 40
        b = np.roll(a, (dy, dx), axis=(0, 1)) + rng.integers(-2, 3, a.shape)
        if k != 2:
            b[14:30, 20:50] = 90 + 100 * (np.arange(30) % 6 > 2)
        pairs.append((a, b))
    for r in images.ink_error(pair_table(spark, pairs)).collect():
        a, b = pairs[r.pair_id]
        ex, ey = K.phase_shift(*(K.edges(x, 50, 150).astype(float) for x in (a, b)))
        assert (ex, ey) == pytest.approx(moves[r.pair_id], abs=0.5)
    # By a whole displacement, so that the plain computation needs no parts of pixels.
    found = {i: images.ink_of(a, b, tuple(map(float, moves[i]))) for i, (a, b) in enumerate(pairs)}
    for i, (a, b) in enumerate(pairs):
        error, bad, box = plain_ink(a, b, *moves[i])
        assert found[i][:2] == (pytest.approx(error, abs=1e-12), bad)
        assert (tuple(found[i][2].values()) if found[i][2] else None) == box
    assert found[0][1] and found[1][1]


def test_large_images_take_a_second_at_most(spark):
    rng = np.random.default_rng(3)
    a = textured(rng, 512, 512)
    b = np.roll(a, (3, -4), axis=(0, 1))
    b[200:260, 100:180] = 255 - b[200:260, 100:180]
    df = pair_table(spark, [(a, b)])
    r = images.ink_error(df).first()
    assert r.error is not None
    began = time.time()
    images.ink_of(a, b, (-4.0, 3.0))
    images.texture(a, b)
    images.macro_regions(a, b)
    assert time.time() - began < 6
    got = {c.pair_id: c for c in images.pair_metrics(df).collect()}[0]
    assert -1 < got.ssim < 1 and got.mean_diff == pytest.approx(np.abs(a - b).mean() / 255)


def test_odd_images_give_nulls_and_fail_nothing(spark):
    good = np.random.default_rng(4).integers(0, 255, (16, 18)).astype(float)
    pairs = [(good, good), (good, None), (None, good), (good[:2, :2], good[:2, :2]), (good[:6, :6], good[:6, :6]), (good[:0], good[:0]), (good[:1, :9], good[:1, :9])]
    df = pair_table(spark, pairs)
    odd = spark.createDataFrame([(90, 4, 4, [1.0] * 15, [1.0] * 16), (91, 2, 2, [1.0, None, 1.0, 1.0], [1.0] * 4), (92, None, 3, [1.0] * 3, [1.0] * 3)], df.schema)
    df = df.unionByName(odd)
    bad = {1, 2, 5, 90, 91, 92}
    every = {r.pair_id for r in df.select("pair_id").collect()}
    for name, columns in (("diff_metrics", ("mean_diff", "pct_changed")), ("gross_diff", ("gross", "structural")), ("edge_change", ("edge_change",)), ("pair_metrics", ("mean_diff", "pct_changed", "edge_change", "hist_corr"))):
        got = {r.pair_id: r for r in getattr(images, name)(df).collect()}
        assert set(got) == every
        assert {i for i, r in got.items() if all(r[c] is None for c in columns)} == bad, name
    got = {r.pair_id: r.ssim for r in images.ssim(df).collect()}
    assert got[0] == pytest.approx(1) and all(got[i] is None for i in bad | {3, 4, 6})
    got = {r.pair_id: r.error for r in images.ink_error(df).collect()}
    assert all((r is None) == (i in bad | {3, 6}) for i, r in got.items())
    assert {r.pair_id for r in images.shift_estimate(df).collect()} == {0, 4}
    assert images.macro_boxes(df).collect() == []


def test_parts_within(spark):
    rng = np.random.default_rng(5)
    word = lambda k: "".join(rng.choice(list("AB1"), k))
    held = sorted({word(int(rng.integers(0, 9))) for _ in range(120)} | {"Z"})
    asked = sorted({word(int(rng.integers(0, 6))) for _ in range(60)} | {"", "QQQQ", "Z"})
    a, b = spark.createDataFrame([(x,) for x in asked], "q_part string"), spark.createDataFrame([(x,) for x in [*held, None]], "m_part string")
    df = knn.parts_within(a, b)
    assert sorted(map(tuple, df.collect())) == sorted((x, y) for x in asked for y in held if x in y)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = knn.parts_within(a, b)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_inspection_end_to_end(spark):
    """Planted defects, each seen by the engine for it; engines not routed to stay silent."""
    rng = np.random.default_rng(6)
    base = textured(rng, 160, 160, 3)[20:140, 20:140]
    wide = textured(np.random.default_rng(6), 160, 160, 3)
    shifted = wide[20:140, 32:152]
    stained = base.copy()
    stained[40:80, 40:80] = 255 - stained[40:80, 40:80] // 2
    boxes = [{"x": 38, "y": 38, "w": 44, "h": 44}]
    calm = np.add.outer(np.arange(120.0), np.arange(120.0)) / 2 + 60  # without edges: dilated edges differ from themselves
    rows = [("same", calm, calm), ("shifted", 128 + (base - 128) / 4, 128 + (shifted - 128) / 4), ("stained", base, stained), ("quiet", base, stained), ("blank", base, None), ("unknown", base, base)]
    ids = {n: k for k, (n, _, _) in enumerate(rows)}
    table = [(ids[n], 120, 120, a.ravel().tolist(), None if b is None else b.ravel().tolist(), boxes, boxes if n != "shifted" else None) for n, a, b in rows]
    box = "array<struct<x:int,y:int,w:int,h:int>>"
    pairs = spark.createDataFrame(table, f"insp_id long, h int, w int, gab array<double>, test array<double>, anomalies {box}, focus {box}")
    told = {"same": "all", "shifted": "Shifted", "stained": "all", "quiet": "memory", "blank": "all", "unknown": "other"}
    info = spark.createDataFrame([(ids[n], "R1", c, "10k", [1.0, 0.0]) for n, c in told.items()], "insp_id long, part string, category string, value string, emb array<double>")
    routes = routing.routes(spark, {"all": ("shift", "silk", "ssim", "semantic", "knn"), "Shifted": ("shift",), "memory": ("knn",)})
    held = [(i, "OK" if i % 4 else "NG", "XR1Y", c, [1.0, 0.01 * i], f"m{i}") for i, c in enumerate(["ALL", "MEMORY"] * 4)]
    memory = spark.createDataFrame(held, "sample_id long, label string, part_key string, category_key string, sig array<double>, path string")
    out = inspection.inspect(pairs, info, memory, routes)
    got = {r.insp_id: r for r in out.collect()}
    assert set(got) == set(ids.values())
    same, moved, stain, quiet, blank, other = (got[ids[n]] for n in ("same", "shifted", "stained", "quiet", "blank", "unknown"))
    assert not any(same[n].is_defect for n in ("shift", "silk", "semantic", "ssim") if same[n]) and same.physical < 0.45
    # A displacement of 12 of 120 pixels is over the tolerance; only that engine ran, and no memory was asked.
    assert moved.shift.is_defect and moved.shift.reason == "displacement" and (moved.macro_dx, moved.macro_dy) == pytest.approx((-12, 0), abs=0.1)
    assert moved.silk is None and moved.semantic is None and moved.ssim is None and not moved.has_memory
    assert moved.final_score == pytest.approx(max(0.8, min(1, 10 * moved.shift.score))) and moved.is_defect and moved.verdict == "real defect"
    assert stain.best.local > 0.45 and stain.silk.is_defect and stain.is_defect and "ssim" in stain.all_boxes and stain.ssim.box.x == 38
    assert stain.active_engines == ["shift", "silk", "ssim", "semantic", "knn"] and stain.n_neighbors == 4
    assert quiet.shift is None and quiet.best is None and quiet.has_memory and quiet.active_engines == ["knn"]
    assert blank.verdict == "ignored" and blank.confidence == 0 and not blank.is_defect and blank.shift is None
    # A category without a route takes the default one, and its memory is that of the part.
    assert other.active_engines == ["shift", "silk", "ssim", "semantic", "knn"] and other.n_neighbors == 5
    # The texture of an anomaly in the focus, step by step.
    a, b = (K.blur(K.resample(x[38:82, 38:82], 64, 64), 3) for x in (base, stained))
    ssim, mean, pct, edge, hist = images.texture(a, b)
    plain = max(0, (0.85 - ssim) / 0.85) * 0.35 + min(1, mean / 0.25) * 0.2 + min(1, pct / 0.4) * 0.2 + min(1, edge / 0.25) * 0.15 + max(0, (0.8 - hist) / 0.8) * 0.1
    plain = min(1, 1.3 * min(1, plain))
    assert stain.best.local == pytest.approx(max(plain, 0.95) if "macro" in stain.all_boxes else plain)
    long = {(r.insp_id, r.engine): r for r in inspection.engine_scores(out).collect()}
    assert long[ids["stained"], "silk"].is_defect and (ids["shifted"], "silk") not in long and len([k for k in long if k[0] == ids["same"]]) >= 3
