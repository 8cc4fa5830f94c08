"""Operators without a SQL oracle against plain computations, files and streams end to end."""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from argusline.functions import masks
from argusline.functions import pixels as P
from argusline.operators import images, knn, ml, sequences
from argusline.plans import bindings as B
from argusline.plans import catalog, text_queries
from argusline.sources import files
from argusline.streaming import streams

SF = "/root/testdata/sf0.001"


def rows_of(arrays) -> list[list[float]]:
    return [np.asarray(a, float).ravel().tolist() for a in arrays]


def pair_table(spark, gab, test):
    h, w = gab[0].shape
    rows = [(i, h, w, *rows_of(p)) for i, p in enumerate(zip(gab, test, strict=True))]
    return spark.createDataFrame(rows, "pair_id long, h int, w int, gab array<double>, test array<double>")


def plain_regions(mask):
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        first = min(left)
        todo, got = [first], {first}
        left.discard(first)
        while todo:
            y, x = todo.pop()
            for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    got.add(q)
                    todo.append(q)
        ys, xs = [p[0] for p in got], [p[1] for p in got]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(got)))
    return out


def test_regions_and_hysteresis():
    rng = np.random.default_rng(1)
    for k in range(60):
        m = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.2 + 0.1 * (k % 6)
        assert masks.region_boxes(m) == plain_regions(m)
        seeds = m & (rng.random(m.shape) < 0.1)
        grown = seeds.copy()
        for _ in range(m.size):
            wide = np.pad(grown, 1)
            grown = m & np.any([wide[1 + i : wide.shape[0] - 1 + i, 1 + j : wide.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        assert (masks.linked_to(m, seeds) == (grown if seeds.any() else False)).all()


def shifted(m, dy, dx, fill):
    out = np.full(m.shape, fill)
    h, w = m.shape
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    out[ys, xs] = m[max(0, dy) : min(h, h + dy), max(0, dx) : min(w, w + dx)]
    return out


def plain_morph(m, op, size, ellipse=False, times=1):
    if op in ("open", "close"):
        first, then = ("erode", "dilate") if op == "open" else ("dilate", "erode")
        return plain_morph(plain_morph(m, first, size, ellipse, times), then, size, ellipse, times)
    for _ in range(times):
        parts = [shifted(m, dy, dx, op == "erode") for dy, a, b in P.element(size, ellipse) for dx in range(a, b + 1)]
        m = np.any(parts, axis=0) if op == "dilate" else np.all(parts, axis=0)
    return m


def test_morphology_with_elements(spark):
    rng = np.random.default_rng(2)
    grids = [rng.random((9, 11)) < 0.4 for _ in range(4)]
    assert [b - a + 1 for _, a, b in P.element(5, ellipse=True)] == [1, 5, 5, 5, 1]
    df = spark.createDataFrame([(i, 9, 11, [bool(v) for v in g.ravel()]) for i, g in enumerate(grids)], "i int, h int, w int, m array<boolean>")
    h, w, m = F.col("h"), F.col("w"), F.col("m")
    cases = [("dilate", 4, False, 1), ("erode", (3, 2), False, 1), ("open", 2, False, 1), ("close", (5, 3), False, 1), ("open", 5, True, 2), ("dilate", 5, True, 1)]
    got = df.select("i", *[P.morph(m, h, w, *c).alias(f"c{k}") for k, c in enumerate(cases)]).collect()
    for r in got:
        for k, c in enumerate(cases):
            assert (np.array(r[f"c{k}"]).reshape(9, 11) == plain_morph(grids[r.i], *c)).all(), c


def plain_blur(a, size, repeat=False):
    one = np.array(P.GAUSS[size], float) / sum(P.GAUSS[size])
    p = np.pad(a, size // 2, mode="edge" if repeat else "reflect")
    return sum(one[i] * one[j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(size) for j in range(size))


def plain_edges(a, low, high):
    p = np.pad(a, 1, mode="edge")
    at = lambda dy, dx: p[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    m = np.abs(gx) + np.abs(gy)
    q, t = np.pad(m, 1), math.tan(math.pi / 8)
    ridge = np.zeros(a.shape, bool)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            u, v, s = abs(gx[y, x]), abs(gy[y, x]), -1 if gx[y, x] * gy[y, x] < 0 else 1
            near = lambda dy, dx: q[y + 1 + dy, x + 1 + dx]
            if v < t * u:
                ridge[y, x] = m[y, x] > near(0, -1) and m[y, x] >= near(0, 1)
            elif v > (t + 2) * u:
                ridge[y, x] = m[y, x] > near(-1, 0) and m[y, x] >= near(1, 0)
            else:
                ridge[y, x] = m[y, x] > near(-1, -s) and m[y, x] > near(1, s)
    return masks.linked_to(ridge & (m > low), ridge & (m > high))


def test_macro_boxes(spark):
    rng = np.random.default_rng(3)
    gab = [np.round(np.kron(rng.integers(0, 255, (4, 5)), np.ones((6, 6)))) for _ in range(3)]
    test = [g.copy() for g in gab]
    test[0][4:18, 6:22] = 255 - test[0][4:18, 6:22]
    test[1] += rng.integers(0, 3, test[1].shape)
    got = images.macro_boxes(pair_table(spark, gab, test), blur=3, grow=3, close=4, open_=2, least=20).collect()
    for i, (g, t) in enumerate(zip(gab, test, strict=True)):
        a, b = (plain_edges(plain_blur(x, 3), 50, 150) for x in (g, t))
        mask = plain_morph(plain_morph(plain_morph(a, "dilate", 3, True) ^ b, "close", 4), "open", 2)
        assert sorted((r.x, r.y, r.w, r.h, r.area) for r in got if r.pair_id == i) == sorted(b for b in plain_regions(mask) if b[4] > 20)
    assert {r.pair_id for r in got} >= {0}


def plain_ssim_map(a, b, win):
    r, n = win // 2, win * win
    p, q = (np.pad(x, r, mode="symmetric") for x in (a, b))
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, (win, win)).reshape(*a.shape, -1)
    p, q = view(p), view(q)
    ua, ub = p.mean(-1), q.mean(-1)
    k = n / (n - 1)
    va, vb, vab = k * (p.var(-1)), k * (q.var(-1)), k * ((p * q).mean(-1) - ua * ub)
    c1, c2 = 2.55**2, 7.65**2
    return (2 * ua * ub + c1) * (2 * vab + c2) / ((ua**2 + ub**2 + c1) * (va + vb + c2))


def test_context_localized(spark):
    rng = np.random.default_rng(4)
    gab = [rng.integers(0, 255, (24, 24)).astype(float) for _ in range(4)]
    test = [g.copy() for g in gab]
    test[0][9:12, 9:12] = 255 - test[0][9:12, 9:12]
    for y in range(6, 18, 5):
        for x in range(6, 18, 5):
            test[1][y, x] = 255 - test[1][y, x]
    test[2] = 255 - test[2]
    pairs = pair_table(spark, gab, test).withColumns({"bx": F.when(F.col("pair_id") == 3, 90).otherwise(10), "by": F.lit(10), "bw": F.lit(4), "bh": F.lit(3)})
    got = {r.pair_id: r for r in images.context_localized(pairs, side=12).collect()}
    for i in range(3):
        # The cut is 12 x 11, 10 - 4 on each side; rows are resampled to 12.
        sy = np.clip((np.arange(12) + 0.5) * 11 / 12 - 0.5, 0, 10)
        y0 = np.floor(sy).astype(int)
        y1, fy = np.minimum(10, y0 + 1), (sy - y0)[:, None]
        cut = [(lambda c: c[y0] * (1 - fy) + c[y1] * fy)(x[i][6:17, 6:18]) for x in (gab, test)]
        m = plain_ssim_map(*cut, 7)
        assert got[i].ctx_ssim == pytest.approx(m.mean(), abs=1e-9)
        assert got[i].n_clusters == len(plain_regions(np.floor((1 - m) * 255) > 100)) and got[i].is_localized == (got[i].n_clusters <= 3)
    assert (got[3].ctx_ssim, got[3].n_clusters, got[3].is_localized) == (1.0, 0, True)


def test_ink_error(spark):
    rng = np.random.default_rng(5)
    gab = [np.full((24, 30), 200.0) + rng.integers(0, 2, (24, 30)) for _ in range(3)]
    for g in gab:
        g[6:10, 5:25] = 40
    test = [g.copy() for g in gab]
    test[1][14:20, 8:20] = 30
    test[2] = np.roll(test[2], 1, axis=1)
    got = {r.pair_id: r for r in images.ink_error(pair_table(spark, gab, test), size=5, border=1, close=(3, 3), tolerance=0.02, least=5, margin=2, radius=2).collect()}
    assert not got[2].is_critical or got[2].error <= got[1].error
    assert got[1].is_critical and got[1].error > got[0].error
    b = got[1].box
    assert b.x <= 8 and b.y <= 14 and b.x + b.w >= 20 and b.y + b.h >= 20


def test_shift_estimate(spark):
    rng = np.random.default_rng(6)
    gab = [rng.integers(0, 255, (12, 12)).astype(float) for _ in range(5)]
    moves = [(0, 0), (1, 0), (0, -2), (-2, 1), (2, 2)]
    test = [np.roll(g, m, axis=(0, 1)) for g, m in zip(gab, moves, strict=True)]
    got = {r.pair_id: (r.dy, r.dx) for r in images.shift_estimate(pair_table(spark, gab, test)).collect()}
    assert got == dict(enumerate(moves))


def test_local_threshold_and_photo_extent(spark):
    flags = np.ones((40, 50), bool)
    flags[8:22, 10:30] = False
    flags[12, 40] = False
    rows = [(1, y, x, bool(flags[y, x])) for y in range(40) for x in range(50)] + [(2, y, x, False) for y in range(40) for x in range(50)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, flag boolean")
    got = {r.image_id: (r.top, r.bottom, r.left, r.right) for r in sequences.photo_extent(pixels, 40, 50).collect()}
    assert got == {1: (8, 22, 10, 30), 2: (0, 40, 0, 50)}


def painted(h, w, parts):
    out = np.full((h, w, 3), 200.0)
    for (y1, y2, x1, x2), color in parts:
        out[y1:y2, x1:x2] = color
    return out


def test_detect_layout(spark):
    blue, red, photo = (0, 0, 255), (255, 0, 0), (90, 80, 20)
    bars = [((5, 15, 10, 90), blue), ((5, 15, 110, 190), red)]
    photos = [((20, 60, 20, 70), photo), ((22, 58, 120, 180), photo)]
    screens = [painted(160, 200, bars + photos), painted(160, 200, bars[1:] + photos), painted(160, 200, bars[:1] + photos), painted(70, 200, bars), painted(160, 200, [((5, 15, 10, 90), blue), ((90, 100, 110, 190), red)])]
    rows = [(i, s.shape[0], s.shape[1], *rows_of(s[:, :, c] for c in range(3)), "Board: B7\nParts: R12 Value: 4K7") for i, s in enumerate(screens)]
    frames = spark.createDataFrame(rows, "frame_id long, h int, w int, r array<double>, g array<double>, b array<double>, raw_text string")
    got = {r.frame_id: r for r in images.detect_layout(frames, bar=500, sibling=300).collect()}
    assert [got[i].status for i in range(5)][:4] == ["ok", "no blue bar", "no red bar", "empty photo"]
    assert tuple(got[0].golden) == (20, 20, 50, 40) and tuple(got[0].suspect) == (120, 22, 60, 36)
    assert got[0].board and got[0].parts and got[1].golden is None


def test_detect_anomalies(spark):
    rng = np.random.default_rng(7)
    base = np.repeat(rng.integers(60, 90, (60, 60, 1)), 3, axis=2).astype(float)
    test = base.copy()
    for y1, y2, x1, x2 in ((10, 50, 10, 50), (20, 30, 20, 32)):
        for line in ((y1, y1 + 1, x1, x2), (y2 - 1, y2, x1, x2), (y1, y2, x1, x1 + 1), (y1, y2, x2 - 1, x2)):
            test[line[0] : line[1], line[2] : line[3]] = (0, 200, 0)
    test[36:44, 34:44] = 255 - 2 * (base[36:44, 34:44] - 60)
    rows = [(7, 60, 60, *rows_of(base[:, :, c] for c in range(3)), *rows_of(test[:, :, c] for c in range(3)))]
    pairs = spark.createDataFrame(rows, "pair_id long, h int, w int, " + ", ".join(f"{s}_{c} array<double>" for s in ("gab", "test") for c in "rgb"))
    got = images.detect_anomalies(pairs, least_box=5, tol=4, pad=5, ui=3, border=2, close=3, open_=3, least=10).collect()
    by = {k: [(r.x, r.y, r.w, r.h) for r in got if r.kind == k] for k in ("global", "epicentre", "anomaly")}
    assert by["global"] == [(10, 10, 40, 40)] and by["epicentre"] == [(20, 20, 12, 10)]
    (x, y, w, h), = by["anomaly"]
    assert abs(x - 34) <= 2 and abs(y - 36) <= 2 and abs(w - 10) <= 4 and abs(h - 8) <= 4


def test_structural_embedding(spark):
    got = catalog.QUERIES["structural_embedding"](spark, SF).collect()
    items = B.table(spark, SF, "lineitem").select("l_suppkey").groupBy("l_suppkey").count().collect()
    images_ = {(r.image_id, r.tile) for r in got}
    assert len(images_) == sum(-(-r["count"] // 64) for r in items) and len(got) == len(images_) * 128
    by = {}
    for r in got:
        by.setdefault((r.image_id, r.tile), {})[r.pos] = r.value
    for v in by.values():
        for k in range(32, 128, 32):
            assert sum(v[i] ** 2 for i in range(k, k + 32)) == pytest.approx(1, abs=1e-3)
        assert all(0 <= v[i] <= 1 for i in range(32))


def test_fuzzy_categories_and_rewritten_values(spark):
    ratio = lambda word, category: SequenceMatcher(None, category.upper(), word.upper()).ratio()
    want = {}
    for r in B.table(spark, SF, "part").select("p_partkey", "p_name").collect():
        text = r.p_name.replace("i", "1")
        words = [w for w in re.sub("[^A-Za-z0-9]+", " ", text).strip().upper().split(" ") if len(w) >= 3 and not w.isdigit()]
        found = None
        for n, cutoff in ((1, 0.6), (2, 0.65), (3, 0.65)):
            for i in range(len(words) - n + 1):
                fits = [(ratio(" ".join(words[i : i + n]), c), c.upper(), c) for c in text_queries.PART_CATEGORIES]
                fits = [f for f in fits if f[0] >= cutoff]
                if fits and found is None:
                    found = max(fits)[2]
        value = text
        if found:
            for w in re.sub(r"[<>=\s]+", " ", text).strip().split(" "):
                if len(w) >= 3 and not w.isdigit() and ratio(w, found) >= 0.5:
                    value = text.replace(w, found)
                    break
        want[r.p_partkey] = (found or "Unknown", None if found else ", ".join(words), value)
    got = {r.p_partkey: (r.category, r.trace) for r in catalog.QUERIES["fuzzy_category"](spark, SF).collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    assert {r.p_partkey: r.value for r in catalog.QUERIES["rewrite_value"](spark, SF).collect()} == {k: v[2] for k, v in want.items()}


def test_heads_reports_and_models(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist(), int(v[0] + v[1] > 0)) for i, v in enumerate(rng.normal(size=(400, 8)))]
    df = spark.createDataFrame(rows, "i int, sig array<double>, label int")
    model = ml.train_head(df)
    report = ml.train_report(model)
    assert report["accuracy"] > 0.95 and report["loss"][-1] < report["loss"][0]
    scored = ml.score_head(model, df.withColumnRenamed("sig", "emb")).collect()
    w, b = model.coefficients.toArray(), model.intercept
    for r in scored[:50]:
        assert r.p_defect == pytest.approx(1 / (1 + math.exp(-max(-700, min(700, np.dot(w, r.emb) + b)))), abs=1e-9)
    ml.save_model(model, f"file://{tmp_path}/head")
    assert (ml.load_model(f"file://{tmp_path}/head").coefficients.toArray() == w).all()


def test_lsh_votes_find_nine_tenths(spark):
    q, m = B.queries(spark, "/root/testdata/sf0.1"), B.memory(spark, "/root/testdata/sf0.1")
    exact = {(r.query_id, r.sample_id) for r in knn.nearest(q, m, 5, own=False).collect()}
    unit = ml.lsh_pairs(q, m)
    found = {(r.query_id, r.sample_id) for r in unit.collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    votes = {r.query_id: r for r in ml.knn_vote_lsh(q, m, own=False).collect()}
    want = {r.query_id: r for r in knn.knn_vote(q, m, own=False).collect()}
    assert set(votes) == set(want) and all(votes[i].tier == want[i].tier and votes[i].has_memory == want[i].has_memory for i in want)


def test_images_are_scanned_and_memory_is_fresh(spark, tmp_path):
    for name in ("a/x.png", "a/b/y.png", "z.txt"):
        (tmp_path / "im" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "im" / name).write_bytes(b"\x89PNG" + name.encode())
    got = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in files.scan_images(spark, f"file://{tmp_path}/im").collect()}
    assert got == {"x.png": b"\x89PNGa/x.png", "y.png": b"\x89PNGa/b/y.png"}
    path = f"file://{tmp_path}/memory"
    assert files.memory_now(spark, path).count() == 0
    one = spark.createDataFrame([("NG", "Bad/Cat", 1.0)], "label string, category string, x double").select("label", "category", F.timestamp_seconds(F.lit(5)).alias("ts"), F.array(F.lit(1.0)).alias("embedding"))
    files.write_samples(one, path, save_images=False)
    assert files.with_fresh_memory(spark, path, lambda m: m.count()) == 1
    files.write_samples(one, path, save_images=False)
    assert files.with_fresh_memory(spark, path, lambda m: m.count()) == 2
    assert files.memory_now(spark, path).select("label", "category_key", "part_key").distinct().collect()[0][0] == "NG"


def test_decisions_take_part_in_the_next_votes(spark, tmp_path):
    """A stream of decisions is appended; a stream of queries votes with them, batch by batch."""
    memory, votes = f"file://{tmp_path}/memory", []
    decided = "label string, part string, category string, ts timestamp, embedding array<float>"
    asked = "query_id long, part string, category string, emb array<float>"

    def ask(i: int) -> None:
        spark.createDataFrame([(i, "r-1", "cat", [1.0, 0.0])], asked).write.mode("append").parquet(f"{tmp_path}/asked")
        stream = spark.readStream.schema(asked).parquet(f"{tmp_path}/asked")
        streams.knn_stream(stream, memory, f"{tmp_path}/c1", lambda df: votes.extend(df.collect())).awaitTermination()

    def decide(label: str, v: list[float], t: int) -> None:
        row = spark.createDataFrame([(label, "R1X", "cat", t, v)], "label string, part string, category string, t int, embedding array<float>")
        row.select("label", "part", "category", F.timestamp_seconds("t").alias("ts"), "embedding").write.mode("append").parquet(f"{tmp_path}/decided")
        streams.feedback_loop(spark.readStream.schema(decided).parquet(f"{tmp_path}/decided"), memory, f"{tmp_path}/c2").awaitTermination()

    ask(1)
    decide("NG", [1.0, 0.1], 10)
    ask(2)
    decide("OK", [1.0, 0.0], 20)
    ask(3)
    assert [v.query_id for v in votes] == [1, 2, 3]
    assert [v.has_memory for v in votes] == [False, True, True] and [v.n_neighbors for v in votes] == [0, 1, 2]
    assert votes[0].vote_defect == 0.5 and votes[1].vote_defect == 0.6 and votes[2].vote_defect < 0.1
    assert votes[2].best_match_label == "OK" and votes[1].tier == 1


def test_frames_meet_their_decisions_in_a_stream(spark, tmp_path):
    f = spark.createDataFrame([(1, 10, 100), (2, 20, 100), (1, 11, 5000)], "key long, msg_id long, t int").select("key", "msg_id", F.timestamp_seconds("t").alias("ts"))
    d = spark.createDataFrame([(1, "OK", 130), (2, "NG", 90), (2, "NG", 900), (1, "NG", 5100)], "key long, command string, t int").select("key", "command", F.timestamp_seconds("t").alias("ts"))
    f.write.parquet(f"{tmp_path}/f")
    d.write.parquet(f"{tmp_path}/d")
    left = spark.readStream.schema(f.schema).parquet(f"{tmp_path}/f")
    right = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/d")
    out = []
    streams.decision_stream_join(left, right).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {(r.key, r.msg_id, r.command) for r in out} == {(1, 10, "OK"), (1, 11, "NG")}
