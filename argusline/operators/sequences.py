"""Ordered series: sustained runs, gap-limited spans, gates and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sustained_bounds(series: DataFrame, remaining: int = 15, share: float = 0.9, least: int = 5) -> DataFrame:
    """top and bottom of each series (series_id, i, flag).

    Top is the first unflagged row; bottom the first flagged row after it from
    which ``remaining`` rows or more are left, ``share`` of them flagged; else
    the row after the last unflagged one.  Extents under ``least`` are null.
    """
    # From the end, so that each row adds one to a running frame.
    tail = W.partitionBy("series_id").orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy("series_id")
    rows = series.withColumns({
        "tail_share": F.avg(F.col("flag").cast("double")).over(tail), "left": F.count("*").over(tail),
        "top": F.min(F.when(~F.col("flag"), F.col("i"))).over(all_),
    })
    stop = F.col("flag") & (F.col("i") > F.col("top")) & (F.col("left") >= remaining) & (F.col("tail_share") >= share)
    out = rows.groupBy("series_id").agg(F.first("top").alias("top"), F.min(F.when(stop, F.col("i"))).alias("stop"), F.max(F.when(~F.col("flag"), F.col("i"))).alias("last"))
    bottom = F.coalesce("stop", F.col("last") + 1)
    ok = bottom - F.col("top") >= least
    return out.select("series_id", F.when(ok, F.col("top")).alias("top"), F.when(ok, bottom).alias("bottom"))


def gap_limited_span(series: DataFrame, gap: int = 6, least: int = 5) -> DataFrame:
    """left and right of each series: from the first unflagged row through
    flagged gaps shorter than ``gap``; right is exclusive."""
    order = W.partitionBy("series_id").orderBy("i")
    rows = series.withColumn("left", F.min(F.when(~F.col("flag"), F.col("i"))).over(W.partitionBy("series_id"))).where(F.col("i") >= F.col("left"))
    # Distance of each unflagged row to the one before it: longer means a long run of flags.
    free = rows.where(~F.col("flag")).withColumn("before", F.lag("i").over(order))
    broken = F.coalesce(F.col("i") - F.col("before") - 1 >= gap, F.lit(False)).cast("int")
    kept = free.withColumn("breaks", F.sum(broken).over(order)).where(F.col("breaks") == 0)
    out = kept.groupBy("series_id").agg(F.min("i").alias("left"), (F.max("i") + 1).alias("right"))
    ok = F.col("right") - F.col("left") >= least
    return series.select("series_id").distinct().join(out.where(ok), "series_id", "left")


def band_fraction(pixels: DataFrame, axis: str, level: float = 0.75) -> DataFrame:
    """Share of flagged pixels of each row (``y``) or column (``x``), and the flag."""
    out = pixels.groupBy("image_id", axis).agg(F.avg(F.col("flag").cast("double")).alias("share"))
    return out.withColumn("band", F.col("share") >= level)


def photo_extent(pixels: DataFrame, height: int | Column, width: int | Column) -> DataFrame:
    """Rows and columns of the photo in a frame (image_id, y, x, flag).

    Flagged bands bound it: rows by sustained bounds, then, within those rows,
    columns by the gap-limited span.  Without unflagged rows it is the whole
    height, without a span the whole width.
    """
    rows = band_fraction(pixels, "y").select(F.col("image_id").alias("series_id"), F.col("y").alias("i"), F.col("band").alias("flag"))
    bounds = sustained_bounds(rows).withColumnRenamed("series_id", "image_id")
    bounds = bounds.select("image_id", F.coalesce("top", F.lit(0)).alias("top"), F.coalesce("bottom", F.lit(height)).alias("bottom"))
    inner = pixels.join(bounds, "image_id").where((F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom")))
    columns = band_fraction(inner, "x").select(F.col("image_id").alias("series_id"), F.col("x").alias("i"), F.col("band").alias("flag"))
    span = gap_limited_span(columns).withColumnRenamed("series_id", "image_id")
    return bounds.join(span, "image_id", "left").select("image_id", "top", "bottom", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(width)).alias("right"))


def otsu_threshold(df: DataFrame, value: str, by: list[str], bins: int = 256) -> DataFrame:
    """Bin that splits values 0..bins-1 with the most variance between classes.

    Ties go to the smallest bin; groups of one bin have variance 0.
    """
    hist = df.where(F.col(value).between(0, bins - 1)).groupBy(*by, F.floor(value).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    upto = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy(*by)
    x = hist.withColumns({
        "w0": F.sum("n").over(upto), "s0": F.sum(F.col("bin") * F.col("n")).over(upto), "wt": F.sum("n").over(all_), "st": F.sum(F.col("bin") * F.col("n")).over(all_),
    })
    w1 = F.col("wt") - F.col("w0")
    d = F.try_divide(F.col("s0"), F.col("w0")) - F.try_divide(F.col("st") - F.col("s0"), w1)
    var = F.coalesce(F.col("w0").cast("double") * w1 * d * d, F.lit(0.0))
    return x.withColumn("var", F.round(var, 4)).groupBy(*by).agg(F.min_by("bin", F.struct(-F.col("var"), "bin")).alias("threshold"), F.max("var").alias("var"))


def inflight_gate(messages: DataFrame, key: str = "key", frame: Column | None = None, decision: Column | None = None) -> DataFrame:
    """Frames that pass: the first of each key after a decision (or the start).

    ``messages`` has the key, ts and msg_id; other messages are ignored.
    """
    frame = F.col("kind") == "frame" if frame is None else frame
    decision = F.col("kind") == "command" if decision is None else decision
    order = W.partitionBy(key).orderBy("ts", "msg_id")
    epochs = messages.withColumn("epoch", F.sum(decision.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    first = F.row_number().over(W.partitionBy(key, "epoch").orderBy("ts", "msg_id"))
    return epochs.where(frame).withColumn("n", first).where("n = 1").drop("n")


def decision_match(messages: DataFrame, key: str = "key") -> DataFrame:
    """Accepted frames with the next decision of their key; null if none came."""
    # From the end, so that the next decision is the last one met so far.
    later = W.partitionBy(key).orderBy(F.desc("ts"), F.desc("msg_id")).rowsBetween(W.unboundedPreceding, -1)
    mark = lambda c: F.last(F.when(F.col("kind") == "command", c), ignorenulls=True).over(later)
    rows = messages.withColumns({"decision": mark(F.col("command")), "decided_at": mark(F.col("ts"))})
    return inflight_gate(rows, key)


def heartbeat(polls: DataFrame, key: str = "key", every: int = 15) -> DataFrame:
    """Every ``every``-th poll of a key."""
    n = F.row_number().over(W.partitionBy(key).orderBy("ts", "msg_id"))
    return polls.withColumn("n", n).where(F.col("n") % every == 0)


def capture_once(frames: DataFrame, key: str = "key") -> DataFrame:
    return frames.groupBy(key).agg(F.min_by("msg_id", F.struct("ts", "msg_id")).alias("msg_id"), F.min("ts").alias("ts"))


def latency(matched: DataFrame, key: str = "key") -> DataFrame:
    """Seconds from a frame to its decision, by key."""
    s = (F.unix_micros(F.col("decided_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return matched.where(F.col("decided_at").isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(s).alias("mean_s"), F.max(s).alias("max_s"))
