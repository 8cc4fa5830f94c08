"""Hand-derived values and properties of the rules."""

from difflib import get_close_matches

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from argusline.functions import pixels as P
from argusline.functions import text as T
from argusline.functions.fixed import CATEGORIES
from argusline.operators import boxes, fuzzy, images, scoring, sequences
from argusline.operators.components import components_of_masks
from argusline.operators.routing import Registry, route_engines, routes
from argusline.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_keys_and_categories(spark):
    rows = spark.createDataFrame([("r-1 ç",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(T.clean_key(F.col("t"))).collect()] == ["R1", "", ""]
    assert [r[0] for r in rows.select(T.sanitize_category(F.col("t"))).collect()] == ["r-1 ç", "Unknown", "Unknown"]


def test_fuzzy_category_matches_the_standard_library(spark):
    texts = ["0 <= 82 <= 10 Sifted", "reverze part", "litle solder", "mach adhesiv x", "up sid down", "brigde", "123 45", None, "-", "xyz qqq"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r for r in fuzzy.fuzzy_category(rows, "id", "t").collect()}
    upper = [c.upper() for c in CATEGORIES]
    for i, t in enumerate(texts):
        if t is None or t == "-" or i == 0:
            continue
        words = [w.upper() for w in t.split() if len(w) >= 3 and not w.isdigit()]
        want = None
        for n, cut in ((1, 0.6), (2, 0.65), (3, 0.65)):
            for k in range(len(words) - n + 1):
                m = get_close_matches(" ".join(words[k : k + n]), upper, 1, cut)
                if m and want is None:
                    want = CATEGORIES[upper.index(m[0])]
        assert got[i].category == (want or "Unknown"), t
    assert got[0].category == "Shifted" and got[7].category == got[8].category == "Unknown"
    value = {r.id: r.value for r in fuzzy.rewrite_value(fuzzy.fuzzy_category(rows, "id", "t")).collect()}
    assert value[0] == "0 <= 82 <= 10 Shifted" and value[5] == "Bridge"


@pytest.mark.parametrize(
    ("p", "flag", "mem", "vote", "sim", "want"),
    [
        (0.8, True, True, 0.2, 0.9, 0.44), (0.8, True, True, 0.30, 0.9, 0.65), (0.8, True, True, 0.2, 0.80, 0.62),
        (0.4, False, True, 1.0, 0.90, 0.88), (0.4, False, True, 1.0, 0.75, 0.70), (0.4, False, True, 1.0, 0.5, 0.58), (0.4, False, False, 1.0, 0.95, 0.4),
    ],
)
def test_fusion_table(spark, p, flag, mem, vote, sim, want):
    assert one(spark, scoring.master_fusion(*[F.lit(x) for x in (p, flag, mem, vote, sim)])) == pytest.approx(want)


def test_confidence_is_bounded_and_monotone(spark):
    rows = spark.range(101).select((F.col("id") / 100).alias("s")).withColumn("c", scoring.confidence(F.col("s"))).orderBy("s").collect()
    assert all(0.5 <= r.c <= 0.99 for r in rows)
    up = [r.c for r in rows if r.s > 0.45]
    assert up == sorted(up) and min(rows, key=lambda r: abs(r.s - 0.45)).c == pytest.approx(0.5)


def test_touching_is_not_overlapping(spark):
    b = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 10, 0, 5, 5)], "image_id long, ord int, x int, y int, w int, h int")
    assert boxes.box_pairs(b, b).where("a_ord < b_ord").count() == 0
    assert boxes.box_pairs(b, b, closed=True).where("a_ord < b_ord").count() == 1
    assert boxes.dedup_boxes(boxes.dedup_boxes(b)).count() == boxes.dedup_boxes(b).count()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=1, max_size=40), min_size=1, max_size=8))
def test_series_bounds_against_loops(spark, many):
    rows = spark.createDataFrame([(s, i, f) for s, fs in enumerate(many) for i, f in enumerate(fs)], "series_id long, i int, flag boolean")
    spans = {r.series_id: (r.left, r.right) for r in sequences.gap_limited_span(rows, gap=3).collect()}
    tops = {r.series_id: (r.top, r.bottom) for r in sequences.sustained_bounds(rows).collect()}
    for s, fs in enumerate(many):
        free = [i for i, f in enumerate(fs) if not f]
        left = right = None
        if free:
            left, right = free[0], free[0] + 1
            for i in free[1:]:
                if i - right >= 3:
                    break
                right = i + 1
        assert spans[s] == ((left, right) if left is not None and right - left >= 5 else (None, None))
        top = bottom = None
        if free:
            top, bottom = free[0], free[-1] + 1
            for i in range(top + 1, len(fs)):
                tail = fs[i:]
                if fs[i] and len(tail) >= 15 and sum(tail) / len(tail) >= 0.9:
                    bottom = i
                    break
        assert tops[s] == ((top, bottom) if top is not None and bottom - top >= 5 else (None, None))


def test_image_identities(spark):
    px = [float((i * 37) % 251) for i in range(64)]
    moved = [px[(i // 8) * 8 + max(0, i % 8 - 1)] for i in range(64)]
    pairs = spark.createDataFrame([(1, 8, 8, px, px), (2, 8, 8, px, moved)], "pair_id long, h int, w int, gab array<double>, test array<double>")
    assert images.ssim(pairs).where("pair_id = 1").first().ssim == pytest.approx(1)
    assert images.diff_metrics(pairs).where("pair_id = 1").first().mean_diff == 0
    assert images.pair_metrics(pairs).where("pair_id = 1").first().hist_corr == pytest.approx(1)
    assert {(r.pair_id, r.dx, r.dy) for r in images.shift_estimate(pairs).collect()} == {(1, 0, 0), (2, 1, 0)}
    assert images.components(pairs.select("pair_id", "w", F.array_repeat(F.lit(False), 64).alias("mask"))).count() == 0


def test_components_do_not_depend_on_order(spark):
    cells = [(1, 0, 0), (1, 1, 1), (1, 0, 5), (1, 3, 3), (1, 4, 4), (1, 5, 5), (1, 5, 6)]
    rows = spark.createDataFrame(cells, "image_id long, y int, x int")
    a = {tuple(r) for r in components_of_masks(rows).collect()}
    assert a == {tuple(r) for r in components_of_masks(rows.orderBy(F.desc("x"))).collect()}
    assert sorted(r[-1] for r in a) == [1, 2, 4]


def test_crop_falls_back_to_the_whole(spark):
    px = F.array(*[F.lit(float(i)) for i in range(16)])
    crop = lambda *b: one(spark, P.crop(px, F.lit(4), F.lit(4), *[F.lit(v) for v in b]))
    assert crop(1, 1, 2, 2) == [5.0, 6.0, 9.0, 10.0]
    assert len(crop(9, 9, 2, 2)) == 16


def test_registry_runs_engines_on_their_routes(spark):
    insp = spark.createDataFrame([(1, "Dust"), (2, "none")], "insp_id long, category string")
    r = Registry()
    for name in ("silk", "shift"):
        r.add(name, lambda df: df.select("insp_id", F.lit(True).alias("is_defect"), F.lit(1.0).alias("score"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("box"), F.create_map().alias("m")))
    got = {(x.insp_id, x.engine) for x in r.run(route_engines(insp, routes(spark))).collect()}
    assert got == {(1, "silk"), (2, "silk"), (2, "shift")}


def test_stream_gate_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.sql("SELECT id AS msg_id, timestamp_seconds(1700000000 + id) AS ts, id % 3 AS key, CASE id % 4 WHEN 0 THEN 'CMD_OK' WHEN 1 THEN '17' WHEN 2 THEN '' ELSE '9' END AS header FROM range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    routed = streams.route_stream(rows)
    want = {(r.key, r.msg_id) for r in sequences.inflight_gate(routed).collect()}
    stream = streams.route_stream(streams.message_stream(spark, str(tmp_path / "in")))
    q = streams.inflight_gate(stream).writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.msg_id) for r in spark.table("gate").collect()} == want


def test_feedback_reaches_the_next_batch(spark, tmp_path):
    rows = spark.sql("SELECT id, 'NG' AS label, 'Dust' AS category, timestamp_seconds(id) AS ts, array(1.0D) AS embedding FROM range(5)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        streams.feedback_loop(stream, str(tmp_path / "memory"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "memory")).count() == 5


def test_structural_embedding_reads_every_row(spark):
    import numpy as np
    import pyarrow.parquet as pq

    from argusline.plans import catalog

    d = "/root/testdata/sf0.001"
    columns = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    rows = sorted(tuple(r[c] for c in columns) for r in pq.read_table(f"{d}/lineitem.parquet", columns=columns).to_pylist())
    groups = {}
    for supplier, order, line, part, quantity in rows:
        r, g, b = part % 256, supplier * 7 % 256, int(quantity * 5) % 256
        groups.setdefault(supplier, []).append(((order, line, r, b), 0.299 * r + 0.587 * g + 0.114 * b, max(r, g, b)))
    want = {}
    for supplier, pixels in groups.items():
        pixels.sort()
        for tile in range(-(-len(pixels) // 64)):
            part = pixels[64 * tile : 64 * tile + 64]
            gray, high = (np.array([p[k] for p in part] + [0.0] * (64 - len(part))) for k in (1, 2))
            counts = np.bincount((high // 8).astype(int), minlength=32)
            want[supplier, tile] = np.r_[gray.reshape(4, 2, 4, 2).mean(axis=(1, 3)).ravel() / 255, counts / np.linalg.norm(counts)]
    got = {}
    for r in catalog.QUERIES["structural_embedding"](spark, d).collect():
        got.setdefault((r.image_id, r.tile), {})[r.pos] = r.value
    assert sum(map(len, groups.values())) == len(rows) and set(got) == set(want)
    for k, values in got.items():
        assert sorted(values) == list(range(128))
        assert np.abs([values[i] for i in [*range(16, 32), *range(96, 128)]] - want[k]).max() < 1e-4
