"""Box geometry and ordered series."""

from __future__ import annotations

from pyspark.sql import functions as F

from argusline.functions import pixels as P
from argusline.operators import boxes as X
from argusline.operators import scoring as S
from argusline.operators import sequences as Q
from argusline.plans import bindings as B

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


BOX = B.with_("boxes")
OPEN = "a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"
CLOSED = OPEN.replace("<", "<=")
BEST = "max_by(ord, w::BIGINT * h * 100 - ord)"


@query("box_overlap", BOX + f" SELECT a.image_id, a.ord AS a_ord, b.ord AS b_ord FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.ord < b.ord AND {OPEN}")
def box_overlap(spark, d):
    b = B.boxes(spark, d)
    return X.box_pairs(b, b).where("a_ord < b_ord").select("image_id", "a_ord", "b_ord")


@query("first_overlap", BOX + f" SELECT a.image_id, a.ord, count(b.ord) > 0 AS hit, min(b.ord) AS first_b FROM boxes a LEFT JOIN boxes b ON a.image_id = b.image_id AND b.ord % 2 = 0 AND {OPEN} WHERE a.ord % 2 = 1 GROUP BY 1, 2")
def first_overlap(spark, d):
    b = B.boxes(spark, d)
    return X.first_overlap(b.where("ord % 2 = 1"), b.where("ord % 2 = 0"))


@query("box_touch", BOX + f" SELECT a.image_id, a.ord AS a_ord, b.ord AS b_ord FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.ord < b.ord AND {CLOSED}")
def box_touch(spark, d):
    b = B.boxes(spark, d)
    return X.box_pairs(b, b, closed=True).where("a_ord < b_ord").select("image_id", "a_ord", "b_ord")


@query("veto_unconfirmed", BOX + f" SELECT a.image_id, a.ord FROM boxes a WHERE a.ord % 2 = 1 AND (a.x % 2 = 0 OR EXISTS (SELECT 1 FROM boxes b WHERE a.image_id = b.image_id AND b.ord % 2 = 0 AND {CLOSED}))")
def veto_unconfirmed(spark, d):
    b = B.boxes(spark, d)
    return X.veto_unconfirmed(b.where("ord % 2 = 1"), b.where("ord % 2 = 0"), F.col("x") % 2 == 1).select("image_id", "ord")


@query("box_contained", BOX + ", t AS (SELECT image_id, " + BEST + " AS t_ord FROM boxes GROUP BY 1) SELECT a.image_id, a.ord, b.ord AS outer_ord FROM boxes a JOIN t USING (image_id) JOIN boxes b ON b.image_id = a.image_id AND b.ord = t_ord WHERE a.ord <> t_ord AND a.w::BIGINT * a.h < 0.85::DOUBLE * (b.w::BIGINT * b.h) AND a.x >= b.x - 20 AND a.y >= b.y - 20 AND a.x + a.w <= b.x + b.w + 20 AND a.y + a.h <= b.y + b.h + 20")
def box_contained(spark, d):
    return X.box_contained(B.boxes(spark, d)).select("image_id", "ord", "outer_ord")


@query("largest_bar", BOX + " SELECT image_id, " + BEST + " AS ord FROM boxes WHERE w::BIGINT * h > 2000 GROUP BY 1")
def largest_bar(spark, d):
    return X.largest_bar(B.boxes(spark, d)).select("image_id", "ord")


FITS = "a.w::BIGINT * a.h >= 1000 AND a.w >= 2 * a.h AND abs(a.y - r.y) <= 30 AND a.h <= 2 * r.h AND a.h >= 0.3::DOUBLE * r.h AND a.w >= 0.3::DOUBLE * r.w AND abs(a.x - r.x) >= 0.5::DOUBLE * r.w"


@query("sibling_box", BOX + f" SELECT a.image_id, count(*) FILTER ({FITS}) > 0 AS is_sibling, coalesce(max_by(a.ord, a.w::BIGINT * a.h * 100 - a.ord) FILTER ({FITS}), max_by(a.ord, a.w::BIGINT * a.h * 100 - a.ord)) AS ord FROM boxes a JOIN boxes r ON r.image_id = a.image_id AND r.ord = 1 GROUP BY 1")
def sibling_box(spark, d):
    b = B.boxes(spark, d)
    return X.sibling_box(b.where("ord = 1"), b).select("image_id", "is_sibling", "ord")


DEDUP = B.with_("dense", recursive=True) + """,
n AS (SELECT image_id, max(ord) AS m FROM dense GROUP BY 1),
k AS (
  SELECT image_id, 1::BIGINT AS ord, [{'o': ord, 'x': x, 'y': y, 'w': w, 'h': h}] AS kept FROM dense WHERE ord = 1
  UNION ALL
  SELECT k.image_id, b.ord, CASE WHEN len(list_filter(k.kept, lambda p: abs(p.x - b.x) < 10 AND abs(p.y - b.y) < 10 AND abs(p.w - b.w) < 10 AND abs(p.h - b.h) < 10)) > 0 THEN k.kept ELSE list_append(k.kept, {'o': b.ord, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}) END
  FROM k JOIN dense b ON b.image_id = k.image_id AND b.ord = k.ord + 1)
SELECT image_id, unnest(list_transform(kept, lambda p: p.o)) AS ord FROM k JOIN n USING (image_id) WHERE k.ord = n.m"""


@query("dedup_boxes", DEDUP)
def dedup_boxes(spark, d):
    return X.dedup_boxes(B.boxes(spark, d, dense=True)).select("image_id", "ord")


@query("union_box", BOX + ", u AS (SELECT image_id, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2 FROM boxes WHERE w::BIGINT * h > 5 GROUP BY 1) SELECT image_id, greatest(0, x1 - 5) AS x, greatest(0, y1 - 5) AS y, x2 + 5 - greatest(0, x1 - 5) AS w, y2 + 5 - greatest(0, y1 - 5) AS h FROM u")
def union_box(spark, d):
    return X.union_box(B.boxes(spark, d))


@query("largest_global_box", BOX + " SELECT image_id, " + BEST + " AS ord FROM boxes GROUP BY 1")
def largest_global_box(spark, d):
    return X.extreme_box(B.boxes(spark, d), largest=True).select("image_id", "ord")


@query("smallest_focus_box", BOX + " SELECT image_id, min_by(ord, w::BIGINT * h * 100 + ord) AS ord FROM boxes GROUP BY 1")
def smallest_focus_box(spark, d):
    return X.extreme_box(B.boxes(spark, d), largest=False).select("image_id", "ord")


NEAR = "SELECT *, sqrt((400 - (x + w / 2)) * (400 - (x + w / 2)) + (300 - (y + h / 2)) * (300 - (y + h / 2))) AS dist FROM boxes WHERE w > 15 AND h > 15 AND w < 680 AND h < 510"


@query("nearest_to_center", BOX + f", n AS ({NEAR}), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY dist, ord) AS rn FROM n) SELECT image_id, ord, round(dist, 6) AS dist FROM r WHERE rn = 1")
def nearest_to_center(spark, d):
    return X.nearest_to_center(B.boxes(spark, d), 800, 600).select("image_id", "ord", F.round("dist", 6).alias("dist"))


@query(
    "focus_box",
    BOX + """, i AS (SELECT image_id, max(w) AS gw, max(h) AS gh FROM boxes GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (200 - (x + w / 2)) * (200 - (x + w / 2)) + (100 - (y + h / 2)) * (100 - (y + h / 2)), ord) AS rn FROM boxes WHERE ord % 2 = 1 AND w > 15 AND h > 15 AND w < 340 AND h < 170),
o AS (SELECT image_id, max_by({'x': x, 'y': y, 'w': w, 'h': h}, w::BIGINT * h * 100 - ord) FILTER (w > 20 AND h > 20 AND w < 360 AND h < 180) AS b FROM boxes WHERE ord % 2 = 0 GROUP BY 1)
SELECT i.image_id, CASE WHEN n.ord IS NOT NULL THEN n.x WHEN o.b IS NOT NULL THEN o.b.x WHEN o.image_id IS NULL AND gw > 20 AND gh > 20 AND gw < 360 AND gh < 180 THEN 0 END AS x,
CASE WHEN n.ord IS NOT NULL THEN n.w WHEN o.b IS NOT NULL THEN o.b.w WHEN o.image_id IS NULL AND gw > 20 AND gh > 20 AND gw < 360 AND gh < 180 THEN gw END AS w
FROM i LEFT JOIN n ON n.image_id = i.image_id AND n.rn = 1 LEFT JOIN o ON o.image_id = i.image_id""",
)
def focus_box(spark, d):
    b = B.boxes(spark, d)
    size = b.groupBy("image_id").agg(F.max("w").alias("gw"), F.max("h").alias("gh"))
    return X.focus_box(b.where("ord % 2 = 1"), b.where("ord % 2 = 0"), size, 400, 200).select("image_id", "x", "w")


@query("rank_boxes", BOX + " SELECT image_id, ord, row_number() OVER (PARTITION BY image_id ORDER BY w::BIGINT * h DESC, ord) AS rank FROM boxes")
def rank_boxes(spark, d):
    return X.rank_boxes(B.boxes(spark, d)).select("image_id", "ord", F.col("rank").cast("long").alias("rank"))


@query("anomaly_boxes", BOX + ", a AS (SELECT *, (w::BIGINT * h) // (1 + ord * 9) AS area FROM boxes) SELECT image_id, ord, x + 7 AS x, y + 9 AS y FROM a WHERE area >= 40 AND w::BIGINT * h <= 0.4::DOUBLE * 60000 AND greatest(w, h) / greatest(least(w, h), 1) <= 25 AND area / (w * h) >= 0.05::DOUBLE")
def anomaly_boxes(spark, d):
    b = B.boxes(spark, d).withColumn("area", F.expr("(CAST(w AS BIGINT) * h) div (1 + ord * 9)"))
    return X.anomaly_boxes(b, focus_area=60000, dx=7, dy=9).select("image_id", "ord", "x", "y")


@query("strip_geometry", BOX + " SELECT image_id, ord, y + h AS strip_y, CASE WHEN least(600, 700 - (y + h) - 50) >= 20 THEN least(600, 700 - (y + h) - 50) END AS strip_h, greatest(0, y - 400) AS text_y1, greatest(0, y) AS text_y2, greatest(0, x - 50) AS text_x1, least(800, x + w + 50) AS text_x2 FROM boxes")
def strip_geometry(spark, d):
    return X.strip_geometry(B.boxes(spark, d), 700, 800)


@query("best_texture", BOX + ", s AS (SELECT image_id AS insp_id, ord, (x % 7) AS score, x FROM boxes) SELECT insp_id, max(score) AS best_score, max_by(ord, score * 100 - ord) AS best_ord, min_by(x, ord) FILTER (score > 0) AS first_x FROM s GROUP BY 1")
def best_texture(spark, d):
    s = B.boxes(spark, d).select(F.col("image_id").alias("insp_id"), "ord", (F.col("x") % 7).alias("score"), X.box_struct().alias("box"))
    return S.best_texture(s).select("insp_id", "best_score", "best_ord", F.col("first_box.x").alias("first_x"))


@query("main_box", BOX + " SELECT image_id, ord, CASE WHEN x % 4 = 0 THEN 'semantic' WHEN x % 3 = 0 THEN 'shift' WHEN x % 2 = 0 THEN 'silk' WHEN x % 5 = 0 THEN 'ssim' END AS main, (x % 4 = 0)::INT + (x % 3 = 0)::INT + (x % 2 = 0)::INT + (x % 5 = 0)::INT AS n, CASE WHEN x % 4 = 0 THEN NULL WHEN x % 3 = 0 THEN 'shift' WHEN x % 2 = 0 THEN 'silk' WHEN x % 5 = 0 THEN 'ssim' END AS legacy FROM boxes")
def main_box(spark, d):
    x = F.col("x")
    names = ["semantic", "shift", "silk", "ssim"]
    marks = [F.when(x % m == 0, n) for n, m in zip(names, (4, 3, 2, 5), strict=True)]
    legacy = S.main_box(F.lit(None).cast("string"), *marks[1:], legacy=True, semantic_defect=x % 4 == 0)
    return B.boxes(spark, d).select("image_id", "ord", S.main_box(*marks).alias("main"), F.size(F.map_keys(X.present_boxes(marks, names))).alias("n"), legacy.alias("legacy"))


@query("knn_focus", BOX + " SELECT image_id, ord, CASE WHEN x % 4 = 0 THEN x WHEN y % 3 = 0 THEN y ELSE 0 END AS fx FROM boxes")
def knn_focus(spark, d):
    """Crop for the memory: texture box, else ink box, else the whole."""
    fx = F.coalesce(F.when(F.col("x") % 4 == 0, F.col("x")), F.when(F.col("y") % 3 == 0, F.col("y")), F.lit(0))
    return B.boxes(spark, d).select("image_id", "ord", fx.alias("fx"))


# -- colours ------------------------------------------------------------------
HSV = B.with_("rgb") + ", m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM rgb), h0 AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN 60 * (g - b)::DOUBLE / (hi - lo) WHEN hi = g THEN 120 + 60 * (b - r)::DOUBLE / (hi - lo) ELSE 240 + 60 * (r - g)::DOUBLE / (hi - lo) END AS hh FROM m), hsv AS (SELECT *, CASE WHEN hh < 0 THEN hh + 360 ELSE hh END / 2 AS h, CASE WHEN hi = 0 THEN 0 ELSE 255 * (hi - lo)::DOUBLE / hi END AS s, hi::DOUBLE AS v FROM h0)"


def _hsv(spark, d):
    h, s, v = P.to_hsv(F.col("r"), F.col("g"), F.col("b"))
    return B.rgb(spark, d).withColumns({"h": h, "s": s, "v": v})


@query("to_gray", B.with_("rgb") + " SELECT l_orderkey, l_linenumber, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS gray FROM rgb")
def to_gray(spark, d):
    return B.rgb(spark, d).select("l_orderkey", "l_linenumber", F.round(P.to_gray(F.col("r"), F.col("g"), F.col("b")), 6).alias("gray"))


@query("to_hsv", HSV + " SELECT l_orderkey, l_linenumber, round(h, 4) AS h, round(s, 4) AS s, v FROM hsv")
def to_hsv(spark, d):
    return _hsv(spark, d).select("l_orderkey", "l_linenumber", F.round("h", 4).alias("h"), F.round("s", 4).alias("s"), "v")


@query("color_mask", HSV + " SELECT count(*) FILTER (h BETWEEN 100 AND 130 AND s >= 150 AND v >= 50) AS blue, count(*) FILTER ((h <= 10 OR h BETWEEN 170 AND 180) AND s >= 150 AND v >= 50) AS red, count(*) FILTER (h BETWEEN 40 AND 80 AND s >= 100 AND v >= 50) AS green, count(*) FILTER (h BETWEEN 50 AND 75 AND s >= 150 AND v >= 100) AS tight_green, l_linenumber FROM hsv GROUP BY l_linenumber")
def color_mask(spark, d):
    counts = [F.count_if(P.color_mask(F.col("h"), F.col("s"), F.col("v"), P.COLORS[c])).alias(c.replace(" ", "_")) for c in P.COLORS]
    return _hsv(spark, d).groupBy("l_linenumber").agg(*counts)


@query("neutral_mask", HSV + " SELECT l_orderkey, l_linenumber FROM hsv WHERE hi - lo <= 15 AND (r + g + b) // 3 BETWEEN 178 AND 218 AND s <= 25")
def neutral_mask(spark, d):
    return _hsv(spark, d).where(P.neutral_mask(F.col("r"), F.col("g"), F.col("b"), F.col("s"))).select("l_orderkey", "l_linenumber")


# -- series ---------------------------------------------------------------------
WIN1 = B.with_("series", "tailed") + """,
t AS (SELECT *, avg(flag::INT) OVER w AS share, count(*) OVER w AS rest, min(CASE WHEN NOT flag THEN i END) OVER (PARTITION BY series_id) AS top FROM tailed WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT series_id, min(top) AS top, coalesce(min(i) FILTER (flag AND i > top AND rest >= 15 AND share >= 0.9), max(i) FILTER (NOT flag) + 1) AS bottom FROM t GROUP BY 1)
SELECT series_id, CASE WHEN bottom - top >= 5 THEN top END AS top, CASE WHEN bottom - top >= 5 THEN bottom END AS bottom FROM g"""


@query("sustained_bounds", WIN1)
def sustained_bounds(spark, d):
    return Q.sustained_bounds(B.series(spark, d, tail=True))


WIN2 = B.with_("series") + """,
f AS (SELECT *, i - lag(i) OVER (PARTITION BY series_id ORDER BY i) - 1 AS gap FROM series WHERE NOT flag),
k AS (SELECT *, sum((coalesce(gap, 0) >= 3)::INT) OVER (PARTITION BY series_id ORDER BY i) AS brk FROM f),
g AS (SELECT series_id, min(i) AS l, max(i) + 1 AS r FROM k WHERE brk = 0 GROUP BY 1)
SELECT s.series_id, g.l AS "left", g.r AS "right" FROM (SELECT DISTINCT series_id FROM series) s LEFT JOIN g ON g.series_id = s.series_id AND r - l >= 5"""


@query("gap_limited_span", WIN2)
def gap_limited_span(spark, d):
    return Q.gap_limited_span(B.series(spark, d), gap=3)


BAND = "band AS (SELECT l_suppkey AS image_id, (l_partkey % 40)::INT AS y, (l_orderkey % 40)::INT AS x, bool_or(l_quantity > 12) AS flag FROM lineitem GROUP BY 1, 2, 3)"


def _bands(spark, d):
    rows = B.table(spark, d, "lineitem").selectExpr("l_suppkey AS image_id", "CAST(l_partkey % 40 AS INT) AS y", "CAST(l_orderkey % 40 AS INT) AS x", "l_quantity > 12 AS f")
    return rows.groupBy("image_id", "y", "x").agg(F.bool_or("f").alias("flag"))


@query("band_fraction", f"WITH {BAND} SELECT image_id, y, round(avg(flag::INT), 6) AS share, avg(flag::INT) >= 0.75 AS band FROM band GROUP BY 1, 2")
def band_fraction(spark, d):
    return Q.band_fraction(_bands(spark, d), "y").withColumn("share", F.round("share", 6))


EXTENT = f"WITH {BAND}," + """
r AS (SELECT image_id, y AS i, avg(flag::INT) >= 0.75 AS flag FROM band GROUP BY 1, 2),
t AS (SELECT *, avg(flag::INT) OVER w AS share, count(*) OVER w AS rest, min(CASE WHEN NOT flag THEN i END) OVER (PARTITION BY image_id) AS top FROM r WINDOW w AS (PARTITION BY image_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT image_id, min(top) AS top, coalesce(min(i) FILTER (flag AND i > top AND rest >= 15 AND share >= 0.9), max(i) FILTER (NOT flag) + 1) AS bottom FROM t GROUP BY 1),
e AS (SELECT image_id, CASE WHEN bottom - top >= 5 THEN top ELSE 0 END AS top, CASE WHEN bottom - top >= 5 THEN bottom ELSE 40 END AS bottom FROM g),
c AS (SELECT image_id, x AS i, avg(flag::INT) >= 0.75 AS flag FROM band JOIN e USING (image_id) WHERE y >= top AND y < bottom GROUP BY 1, 2),
f AS (SELECT *, i - lag(i) OVER (PARTITION BY image_id ORDER BY i) - 1 AS gap FROM c WHERE NOT flag),
k AS (SELECT *, sum((coalesce(gap, 0) >= 6)::INT) OVER (PARTITION BY image_id ORDER BY i) AS brk FROM f),
s AS (SELECT image_id, min(i) AS l, max(i) + 1 AS r FROM k WHERE brk = 0 GROUP BY 1)
SELECT e.image_id, top, bottom, coalesce(l, 0) AS "left", coalesce(r, 40) AS "right" FROM e LEFT JOIN s ON s.image_id = e.image_id AND r - l >= 5"""


@query("photo_extent", EXTENT)
def photo_extent(spark, d):
    return Q.photo_extent(_bands(spark, d), 40, 40)


OTSU = """WITH h AS (SELECT event_type, floor(value)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 255 GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER w AS w0, sum(bin * n) OVER w AS s0, sum(n) OVER (PARTITION BY event_type) AS wt, sum(bin * n) OVER (PARTITION BY event_type) AS st FROM h WINDOW w AS (PARTITION BY event_type ORDER BY bin)),
v AS (SELECT *, round(coalesce(CASE WHEN wt > w0 THEN w0::DOUBLE * (wt - w0) * (s0 / w0 - (st - s0) / (wt - w0)) * (s0 / w0 - (st - s0) / (wt - w0)) END, 0), 4) AS var FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY var DESC, bin) AS rn FROM v)
SELECT event_type, bin AS threshold FROM r WHERE rn = 1"""


@query("otsu_threshold", OTSU)
def otsu_threshold(spark, d):
    return Q.otsu_threshold(B.table(spark, d, "events"), "value", ["event_type"]).select("event_type", "threshold")


GATE = B.with_("messages") + """,
e AS (SELECT *, sum((kind = 'command')::INT) OVER (PARTITION BY key ORDER BY ts, msg_id) AS epoch, first_value(CASE WHEN kind = 'command' THEN command END IGNORE NULLS) OVER w AS decision, first_value(CASE WHEN kind = 'command' THEN ts END IGNORE NULLS) OVER w AS decided_at FROM messages WINDOW w AS (PARTITION BY key ORDER BY ts, msg_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, epoch ORDER BY ts, msg_id) AS rn FROM e WHERE kind = 'frame') WHERE rn = 1)
"""


@query("inflight_gate", GATE + "SELECT key, msg_id FROM g")
def inflight_gate(spark, d):
    return Q.inflight_gate(B.messages(spark, d)).select("key", "msg_id")


@query("decision_match", GATE + "SELECT key, msg_id, decision FROM g")
def decision_match(spark, d):
    return Q.decision_match(B.messages(spark, d)).select("key", "msg_id", "decision")


@query("latency", GATE + "SELECT key, count(*) AS n, round(avg((epoch_us(decided_at) - epoch_us(ts)) / 1e6), 3) AS mean_s, round(max((epoch_us(decided_at) - epoch_us(ts)) / 1e6), 3) AS max_s FROM g WHERE decided_at IS NOT NULL GROUP BY 1")
def latency(spark, d):
    out = Q.latency(Q.decision_match(B.messages(spark, d)))
    return out.withColumns({"mean_s": F.round("mean_s", 3), "max_s": F.round("max_s", 3)})


@query("heartbeat", B.with_("messages") + ", n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, msg_id) AS n FROM messages WHERE kind = 'blank') SELECT key, msg_id FROM n WHERE n % 15 = 0")
def heartbeat(spark, d):
    return Q.heartbeat(B.messages(spark, d).where("kind = 'blank'")).select("key", "msg_id")


@query("capture_once", B.with_("messages") + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, msg_id) AS rn FROM messages WHERE kind = 'frame') SELECT key, msg_id FROM r WHERE rn = 1")
def capture_once(spark, d):
    return Q.capture_once(B.messages(spark, d).where("kind = 'frame'")).select("key", "msg_id")
