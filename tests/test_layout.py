"""Screen layout: the rules of a frame against the table operators, and whole screens."""

import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from argusline.functions import layout as L
from argusline.functions import masks
from argusline.functions import pixels as P
from argusline.operators import boxes, images, sequences


def test_extents_equal_the_table_operator(spark):
    rng = np.random.default_rng(3)
    strips = [np.ones((40, 50), bool), np.zeros((40, 50), bool)]
    for _ in range(30):
        m = rng.random((40, 50)) < rng.choice([0.3, 0.8, 0.97])
        y, x = rng.integers(0, 30, 2)
        m[y : y + rng.integers(1, 30), x : x + rng.integers(1, 40)] = False
        m[:, x + 5 : x + 5 + rng.integers(0, 9)] = True
        strips.append(m)
    pixels = spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(strips)], "image_id long, f array<boolean>").select("image_id", F.posexplode("f").alias("i", "flag"))
    pixels = pixels.select("image_id", F.floor(F.col("i") / 50).cast("int").alias("y"), (F.col("i") % 50).alias("x"), "flag")
    want = {r.image_id: (r.top, r.bottom, r.left, r.right) for r in sequences.photo_extent(pixels, 40, 50).collect()}
    assert {i: L.extent(m) for i, m in enumerate(strips)} == want


def test_bars_equal_the_table_operators(spark):
    rng = np.random.default_rng(4)
    rows = [(i, j, *map(int, rng.integers(0, 60, 2)), *map(int, rng.integers((8, 3), (60, 14)))) for i in range(60) for j in range(1, 8)]
    table = spark.createDataFrame(rows, "image_id long, ord int, x int, y int, w int, h int")
    blue, red = table.where("ord <= 3"), table.where("ord > 3")
    ref = boxes.largest_bar(blue, 200)
    bar = {r.image_id: tuple(r[c] for c in boxes.BOX) for r in ref.collect()}
    sib = {r.image_id: tuple(r[c] for c in boxes.BOX) for r in boxes.sibling_box(ref, red, 100).where("is_sibling").collect()}
    own = {i: ([r[2:] for r in rows if r[0] == i and r[1] <= 3], [r[2:] for r in rows if r[0] == i and r[1] > 3]) for i in range(60)}
    mine = {i: L.largest(b, 200) for i, (b, _) in own.items()}
    assert {i: b for i, b in mine.items() if b} == bar and len(sib) > 5
    assert {i: s for i, b in mine.items() if b and (s := L.beside(b, own[i][1], 100))} == sib


def test_colours_equal_the_columns(spark):
    rng = np.random.default_rng(5)
    px = np.vstack([rng.integers(0, 256, (3000, 3)), rng.integers(0, 3, (200, 3)) * 100, rng.integers(170, 225, (2000, 1)) + rng.integers(0, 18, (2000, 3))]).astype(float)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(px.tolist())], "i int, r double, g double, b double")
    h, s, v = P.to_hsv(F.col("r"), F.col("g"), F.col("b"))
    got = df.select("i", *[P.color_mask(h, s, v, P.COLORS[c]).alias(c) for c in ("blue", "red")], P.neutral_mask(F.col("r"), F.col("g"), F.col("b"), s).alias("gray")).orderBy("i").toPandas()
    planes = tuple(px.T)
    for c in ("blue", "red"):
        assert (got[c].to_numpy() == L.of_color(L.hsv(*planes), c)).all() and got[c].any()
    assert (got["gray"].to_numpy() == L.neutral(*planes)).all() and got["gray"].any()


def test_regions_of_noise_take_no_time():
    """As many regions as pixels allow: their boxes cost no pass each."""
    m = np.zeros((600, 600), bool)
    m[::2, ::2] = True
    m[100:200, 100:203] = True
    begin = time.time()
    got = masks.region_boxes(m)
    assert time.time() - begin < 5
    assert len(got) == 300 * 300 - 51 * 52 + 1 and sum(b[4] for b in got) == int(m.sum())
    # The dots below touch the block by their upper side.
    assert (100, 100, 103, 101, 10300 + 52) in got and masks.region_boxes(m & False) == []


def screen(*parts):
    out = np.full((1080, 1920, 3), 200.0, np.float32)
    for (x, y, w, h), color in parts:
        out[y : y + h, x : x + w] = color
    return out


def test_screens_of_1080p_and_odd_frames(spark, tmp_path):
    blue, red, photo = (0, 0, 255), (255, 0, 0), (90, 80, 20)
    a, b = ((100, 50, 800, 40), blue), ((1000, 52, 800, 38), red)
    left, right = (160, 120, 640, 400), (1100, 130, 500, 420)
    screens = [screen(a, b, (left, photo), (right, photo)), screen(b), screen(a), screen(a, ((1000, 950, 800, 100), red)), None, np.full((3, 3, 3), 200.0, np.float32)]
    planes = {c: pa.array([None if s is None else s[:, :, k].ravel() for s in screens], pa.list_(pa.float32())) for k, c in enumerate("rgb")}
    text = [None if i == 1 else "Board: B7\nParts: R12 Value: 4K7" for i in range(6)]
    pq.write_table(pa.table({"frame_id": range(6), "h": [1080] * 6, "w": [1920] * 6, **planes, "raw_text": text}), f"{tmp_path}/frames.parquet", row_group_size=1)
    frames = spark.read.parquet(f"{tmp_path}/frames.parquet")
    out = images.detect_layout(frames)
    plan = out._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {r.frame_id: r for r in out.collect()}
    assert [got[i].status for i in range(6)] == ["ok", "no blue bar", "no red bar", "empty photo", "no blue bar", "no blue bar"]
    assert tuple(got[0].golden) == left and tuple(got[0].suspect) == right
    assert got[0].parts and all(got[i].golden is None and got[i].board is None for i in range(1, 6))
