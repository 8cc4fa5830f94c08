"""Geometry over tables of boxes: image_id, ord, x, y, w, h (top-left corner)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOX = ("x", "y", "w", "h")


def area(p: str = "") -> Column:
    return F.col(f"{p}w").cast("long") * F.col(f"{p}h")


def box_struct(p: str = "") -> Column:
    return F.struct(*[F.col(f"{p}{c}").alias(c) for c in BOX])


def _renamed(boxes: DataFrame, p: str) -> DataFrame:
    return boxes.select("image_id", *[F.col(c).alias(f"{p}{c}") for c in ("ord", *BOX)])


def intersects(p: str, q: str, closed: bool = False) -> Column:
    """Open rectangles overlap; closed ones may touch."""
    c = lambda a, b: (a <= b) if closed else (a < b)
    x, y = F.col(f"{p}x"), F.col(f"{p}y")
    u, v = F.col(f"{q}x"), F.col(f"{q}y")
    return c(x, u + F.col(f"{q}w")) & c(u, x + F.col(f"{p}w")) & c(y, v + F.col(f"{q}h")) & c(v, y + F.col(f"{p}h"))


def box_pairs(a: DataFrame, b: DataFrame, closed: bool = False) -> DataFrame:
    """All intersecting pairs of one image: a_ and b_ columns."""
    return _renamed(a, "a_").join(_renamed(b, "b_"), "image_id").where(intersects("a_", "b_", closed))


def first_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """For every box of ``a`` whether one of ``b`` overlaps it, and the first."""
    hits = box_pairs(a, b).groupBy("image_id", F.col("a_ord").alias("ord")).agg(F.min("b_ord").alias("first_b"))
    return a.join(hits, ["image_id", "ord"], "left").select("image_id", "ord", F.col("first_b").isNotNull().alias("hit"), "first_b")


def veto_unconfirmed(alarms: DataFrame, confirmed: DataFrame, flagged: Column) -> DataFrame:
    """Alarms without those that are flagged and touch no confirmed box."""
    touch = box_pairs(alarms, confirmed, closed=True).select("image_id", F.col("a_ord").alias("ord")).distinct()
    return alarms.where(~flagged).unionByName(alarms.where(flagged).join(touch, ["image_id", "ord"], "left_semi").select(*alarms.columns))


def box_contained(boxes: DataFrame, share: float = 0.85, slack: int = 20) -> DataFrame:
    """Boxes inside their image's largest one: smaller than ``share`` of it."""
    top = boxes.groupBy("image_id").agg(F.max_by(F.struct("ord", *BOX), F.struct(area(), -F.col("ord"))).alias("t")).select("image_id", *[F.col(f"t.{c}").alias(f"t_{c}") for c in ("ord", *BOX)])
    x, y = F.col("x"), F.col("y")
    inside = (x >= F.col("t_x") - slack) & (y >= F.col("t_y") - slack) & (x + F.col("w") <= F.col("t_x") + F.col("t_w") + slack) & (y + F.col("h") <= F.col("t_y") + F.col("t_h") + slack)
    return boxes.join(top, "image_id").where((F.col("ord") != F.col("t_ord")) & (area() < share * area("t_")) & inside).select(*boxes.columns, F.col("t_ord").alias("outer_ord"))


def largest_bar(boxes: DataFrame, least: int = 2000) -> DataFrame:
    """The largest box of each image above an area, or none."""
    return boxes.where(area() > least).groupBy("image_id").agg(F.max_by(F.struct("ord", *BOX), F.struct(area(), -F.col("ord"))).alias("b")).select("image_id", "b.*")


def sibling_box(ref: DataFrame, boxes: DataFrame, least: int = 1000) -> DataFrame:
    """The bar beside a reference bar: largest box of similar height and level.

    ``ref`` has one box for each image.  Images without such a box fall back
    to their largest box of any kind (``is_sibling`` false).
    """
    r = _renamed(ref, "r_")
    fits = (
        (area() >= least) & (F.col("w") >= 2 * F.col("h")) & (F.abs(F.col("y") - F.col("r_y")) <= 30)
        & (F.col("h") <= 2 * F.col("r_h")) & (F.col("h") >= 0.3 * F.col("r_h")) & (F.col("w") >= 0.3 * F.col("r_w"))
        & (F.abs(F.col("x") - F.col("r_x")) >= 0.5 * F.col("r_w"))
    )
    order = F.struct(area(), -F.col("ord"))
    out = boxes.join(r, "image_id").groupBy("image_id").agg(F.max_by(F.struct("ord", *BOX), F.when(fits, order)).alias("s"), F.max_by(F.struct("ord", *BOX), order).alias("f"))
    return out.select("image_id", F.col("s").isNotNull().alias("is_sibling"), *[F.coalesce(f"s.{c}", f"f.{c}").alias(c) for c in ("ord", *BOX)])


def dedup_boxes(boxes: DataFrame, tol: int = 10) -> DataFrame:
    """Greedy dedup in input order: a box whose x, y, w and h are each less than
    ``tol`` from those of a kept box of its image goes.  An image's boxes are one array."""
    listed = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", *BOX))).alias("all"))

    def near(a: Column, b: Column) -> Column:
        x, y, w, h = (F.abs(a[c] - b[c]) < tol for c in BOX)
        return x & y & w & h

    empty = F.filter("all", lambda b: F.lit(False))
    kept = F.aggregate("all", empty, lambda acc, b: F.when(F.exists(acc, lambda k: near(k, b)), acc).otherwise(F.array_append(acc, b)))
    return listed.select("image_id", F.explode(kept).alias("b")).select("image_id", "b.*")


def union_box(boxes: DataFrame, least: int = 5, margin: int = 5) -> DataFrame:
    """Box around all boxes above an area, with a margin, clamped at 0."""
    big = boxes.where(area() > least)
    out = big.groupBy("image_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    x, y = F.greatest(F.lit(0), F.col("x1") - margin), F.greatest(F.lit(0), F.col("y1") - margin)
    return out.select("image_id", x.alias("x"), y.alias("y"), (F.col("x2") + margin - x).alias("w"), (F.col("y2") + margin - y).alias("h"))


def extreme_box(boxes: DataFrame, largest: bool) -> DataFrame:
    """Largest or smallest box of each image by w * h; ties to the smaller ord."""
    pick = F.max_by(F.struct("ord", *BOX), F.struct(area(), -F.col("ord"))) if largest else F.min_by(F.struct("ord", *BOX), F.struct(area(), F.col("ord")))
    return boxes.groupBy("image_id").agg(pick.alias("b")).select("image_id", "b.*")


def nearest_to_center(boxes: DataFrame, width: int, height: int, least: int = 15, share: float = 0.85) -> DataFrame:
    """The box of fitting size whose centre is nearest the image's."""
    fits = (F.col("w") > least) & (F.col("h") > least) & (F.col("w") < width * share) & (F.col("h") < height * share)
    dx, dy = F.lit(width / 2) - (F.col("x") + F.col("w") / 2), F.lit(height / 2) - (F.col("y") + F.col("h") / 2)
    near = boxes.where(fits).withColumn("dist", F.sqrt(dx * dx + dy * dy))
    return near.groupBy("image_id").agg(F.min_by(F.struct("ord", *BOX, "dist"), F.struct("dist", "ord")).alias("b")).select("image_id", "b.*")


def focus_box(boxes: DataFrame, legacy: DataFrame, size: DataFrame, width: int, height: int) -> DataFrame:
    """Nearest to the centre, else the largest legacy box with sides between 20
    and 90 %; only without legacy boxes the whole component from 0, 0."""
    fits = lambda w, h: (F.col(w) > 20) & (F.col(h) > 20) & (F.col(w) < 0.9 * width) & (F.col(h) < 0.9 * height)
    near = nearest_to_center(boxes, width, height).select("image_id", box_struct().alias("near"))
    old = legacy.groupBy("image_id").agg(F.max_by(box_struct(), F.when(fits("w", "h"), F.struct(area(), -F.col("ord")))).alias("old"), F.lit(True).alias("has_old"))
    whole = F.when(F.col("has_old").isNull() & fits("gw", "gh"), F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("gw").alias("w"), F.col("gh").alias("h")))
    out = size.join(near, "image_id", "left").join(old, "image_id", "left").withColumn("b", F.coalesce("near", "old", whole))
    return out.select("image_id", "b.*")


def rank_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("rank", F.row_number().over(W.partitionBy("image_id").orderBy(area().desc(), "ord")))


def looks_anomalous(area: Column, w: Column, h: Column, room: Column | int, least: int = 40, aspect: float = 25, solidity: float = 0.05) -> Column:
    """Whether a region of ``area`` pixels is of a size and form to be an anomaly."""
    ratio = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1))
    return (area >= least) & (w.cast("long") * h <= 0.4 * F.lit(room)) & (ratio <= aspect) & (area / (w * h) >= solidity)


def anomaly_boxes(components: DataFrame, least: int = 40, focus_area: int = 1_000_000, aspect: float = 25, solidity: float = 0.05, dx: int = 0, dy: int = 0) -> DataFrame:
    """Components that may be anomalies, in absolute coordinates.

    ``area`` is the component's pixel count.
    """
    ok = looks_anomalous(F.col("area"), F.col("w"), F.col("h"), focus_area, least, aspect, solidity)
    return components.where(ok).withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def strip_geometry(bars: DataFrame, height: int, width: int) -> DataFrame:
    """Photo strip below a bar and text zone above it, clamped to the frame."""
    bottom = F.col("y") + F.col("h")
    strip = F.least(F.lit(600), F.lit(height) - bottom - 50)
    return bars.select(
        "image_id", "ord", bottom.alias("strip_y"), F.when(strip >= 20, strip).alias("strip_h"),
        F.greatest(F.lit(0), F.col("y") - 400).alias("text_y1"), F.greatest(F.lit(0), F.col("y")).alias("text_y2"),
        F.greatest(F.lit(0), F.col("x") - 50).alias("text_x1"), F.least(F.lit(width), F.col("x") + F.col("w") + 50).alias("text_x2"),
    )


def present_boxes(boxes: Sequence[Column], names: Sequence[str]) -> Column:
    """Map of the boxes that are there, by engine."""
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*boxes)), lambda k, v: v.isNotNull())
