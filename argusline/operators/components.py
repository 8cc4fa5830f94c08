"""Connected components of pixel masks."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusline.functions.masks import runs_of


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; a temporary one only in a local session without."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="argusline-checkpoint-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder of ``spark.checkpoint.dir``."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Side of a tile.
TILE = 256

PART = "image_id {kind}, part long, kind string, y int, x int, far_y int, far_x int, area long"


def tile_parts(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """What is left of a mask once each tile is labelled by itself; pixels are (image_id, y, x), shuffled once.

    ``part`` is a region of a tile, named by its first pixel.  Of each there is
    a ``box`` row (first and last row and column, pixels), and on the tile's rim
    an ``at`` row for each pixel and a ``to`` row for each pixel of a later tile
    that it would touch.
    """
    kind = pixels.schema["image_id"].dataType.simpleString()
    inside = (F.pmod("y", F.lit(tile)) * tile + F.pmod("x", F.lit(tile))).cast("int")
    tiles = pixels.groupBy("image_id", F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"))
    # A set: repeated pixels count once, and a tile holds no more than its area.
    tiles = tiles.agg(F.collect_set(inside).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, ty, tx, at in zip(b.column("image_id"), b.column("ty").to_pylist(), b.column("tx").to_pylist(), b.column("at"), strict=True):
                mask = np.zeros(tile * tile, bool)
                mask[at.values.to_numpy()] = True
                mask = mask.reshape(tile, tile)
                row, first, end, region = runs_of(mask)
                # The part of each pixel, run by run; a region is named by its first run's start.
                name = ((row[region] + ty * tile).astype(np.int64) << 32) + (first[region] + tx * tile + (1 << 31))
                order = np.argsort(region, kind="stable")
                cut = np.flatnonzero(np.diff(region[order], prepend=-1))
                over = lambda f, v: f.reduceat(v[order], cut)
                out = [(name[order][cut], "box", over(np.minimum, row), over(np.minimum, first), over(np.maximum, row), over(np.maximum, end) - 1, over(np.add, end - first))]
                part = np.repeat(name, end - first)
                y, x = np.nonzero(mask)  # in the order of runs
                rim = (y == 0) | (x == 0) | (y == tile - 1) | (x == tile - 1)
                out.append((part[rim], "at", y[rim], x[rim], y[rim], x[rim], np.zeros(rim.sum(), int)))
                for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
                    to = ((y + dy) // tile != 0) | ((x + dx) // tile != 0)
                    out.append((part[to], "to", y[to] + dy, x[to] + dx, y[to] + dy, x[to] + dx, np.zeros(to.sum(), int)))
                columns = [np.concatenate([o[j] for o in out]) for j in (0, 2, 3, 4, 5, 6)]
                kinds = np.concatenate([np.full(len(o[0]), o[1], object) for o in out])
                yy, xx = ty * tile, tx * tile
                arrays = [pa.repeat(image, len(kinds)), pa.array(columns[0], pa.int64()), pa.array(kinds, pa.string())]
                arrays += [pa.array((v + o).astype(np.int32)) for v, o in zip(columns[1:5], (yy, xx, yy, xx), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(columns[5].astype(np.int64))], ["image_id", "part", "kind", "y", "x", "far_y", "far_x", "area"])

    return tiles.mapInArrow(run, PART.format(kind=kind))


def joined_parts(parts: DataFrame, max_rounds: int = 200) -> DataFrame:
    """image_id, part, label: the first part that each part on a rim is connected with, over tiles.

    Each round a part takes the smallest label around it and then the label of
    that label's part, which doubles the reach.  Rows are regions of tiles that
    touch another tile's, not pixels.
    """
    at = parts.where("kind = 'at'").select("image_id", "y", "x", F.col("part").alias("b"))
    links = durable(parts.where("kind = 'to'").select("image_id", "y", "x", F.col("part").alias("a")).join(at, ["image_id", "y", "x"]).select("image_id", "a", "b").distinct())
    both = durable(links.unionByName(links.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    state = durable(both.select("image_id", F.col("a").alias("part")).distinct().withColumn("label", F.col("part")))
    for _ in range(max_rounds):
        low = both.join(state.select("image_id", F.col("part").alias("b"), "label"), ["image_id", "b"]).groupBy("image_id", F.col("a").alias("part")).agg(F.min("label").alias("low"))
        met = state.join(low, ["image_id", "part"]).withColumn("low", F.least("low", "label"))
        jump = state.select("image_id", F.col("part").alias("low"), F.col("label").alias("far"))
        after = met.join(jump, ["image_id", "low"]).select("image_id", "part", F.least("low", "far").alias("new"), (F.least("low", "far") != F.col("label")).alias("moved"))
        after = durable(after.withColumnRenamed("new", "label"))
        state = after.drop("moved")
        if after.where("moved").isEmpty():
            return state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components_of_masks(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """A box for each 8-connected component, numbered by its first pixel; area in pixels.

    For images that do not fit a row: tiles are labelled by themselves, and only
    what touches on their rims is joined over the tiles.  Repeated pixels count
    once, pixels with a null take no part.
    """
    parts = durable(tile_parts(pixels.dropna(subset=["image_id", "y", "x"]), tile))
    label = F.coalesce("label", "part")
    whole = parts.where("kind = 'box'").join(joined_parts(parts), ["image_id", "part"], "left").groupBy("image_id", label.alias("label")).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("far_x") - F.min("x") + 1).alias("w"), (F.max("far_y") - F.min("y") + 1).alias("h"), F.sum("area").alias("area")
    )
    # Of the parts of a component the one with the first pixel has the smallest name.
    ordered = F.row_number().over(W.partitionBy("image_id").orderBy("label"))
    return whole.withColumn("ord", ordered).select("image_id", "ord", "x", "y", "w", "h", "area")
