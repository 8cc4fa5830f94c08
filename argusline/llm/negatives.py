"""Hard negatives by a secondary sort of pair scores.

Anchors meet all rows in blocks (a matrix product each).  A first pass keeps
every block's best rows of an anchor's own label and settles its positives.
The second pass knows their scores, so a block hands on only its first
negatives of each positive's window.  Positives and negatives travel as packed
keys (anchor, score downwards, kind, id) through
``repartitionAndSortWithinPartitions``; an iterator then reads each partition
once, opens a window at every positive, closes it when it is full or the scores
have fallen below it, and emits negatives as they pass.  No anchor's rows are
held: the state is an anchor's open windows.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argusline.llm.common import Stages

#: Rows and anchors that meet in one block, about.
ROWS, ANCHORS = 4096, 2048
#: Anchors that are scored at once within a block.
AT_ONCE = 256
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Scores leave 64 bits only for components beyond about a thousand million; they end there.
MOST = (1 << 63) - 1

_KEY = struct.Struct(">QQBQ")
_SIGN = 1 << 63


def pack(anchor: int, score: int, kind: int, row: int) -> bytes:
    """A key whose byte order is (anchor, score downwards, kind, row)."""
    return _KEY.pack(anchor + _SIGN, MOST - score, kind, row + _SIGN)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    a, s, kind, r = _KEY.unpack(key)
    return a - _SIGN, MOST - s, kind, r - _SIGN


def anchor_partition(key: bytes) -> int:
    return zlib.crc32(key[:8])


def emit(keys: Iterable[bytes], per_positive: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Negatives of the sorted keys' positives: at most ``per_positive`` open windows' worth of state.

    A positive comes before every negative of its window, for a window lies at
    or below its positive's score (ties put positives first); a positive of
    negative score has an empty window if ``low < high``.
    """
    at, open_windows = None, []
    for key in keys:
        anchor, score, kind, row = unpack(key)
        if anchor != at:
            at, open_windows = anchor, []
        if kind == 0:
            if low * score <= high * score:
                open_windows.append([row, score, 0])
            continue
        still = []
        for window in open_windows:
            positive, best, n = window
            if 100 * score < low * best:
                continue
            if 100 * score <= high * best:
                window[2] = n = n + 1
                yield anchor, positive, n, row, best, score
            if n < per_positive:
                still.append(window)
        open_windows = still


def usable(rows: DataFrame, anchors: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, v, is_anchor``: one row for each id that takes part, with whole numbers for components."""
    # The condition is evaluated among the user's columns, before they get names of ours.
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(math.inf)) & ~F.isnan(x.cast("double")))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(finite)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("double")))
    least = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("m"), F.max("is_anchor").alias("is_anchor"))
    return least.select("id", "m.label", "m.v", "is_anchor")


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, held within 64 bits."""
    most = (np.abs(a).max(initial=0) or 1) * (np.abs(b).max(initial=0) or 1) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(y) for y in r] for r in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


def _first(scores: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores in each row where ``mask``; earlier ones first; -1 where there are fewer."""
    n = scores.shape[1]
    out = np.full((len(scores), k), -1, np.int64)
    if n == 0:
        return out
    if n < 2**20 and np.abs(scores).max(initial=0) < 2**42:
        # One number says score and place, so that ties need no second look.
        joint = np.where(mask, scores * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
        kk = min(k, n)
        top = np.sort(np.partition(joint, n - kk, axis=1)[:, n - kk :], axis=1)[:, ::-1]
        found = top > np.iinfo(np.int64).min
        out[:, :kk][found] = (n - 1 - top % n)[found]
        return out
    for i, (row, m) in enumerate(zip(scores, mask, strict=True)):
        at = np.flatnonzero(m)
        best = at[np.lexsort((at, [-int(x) for x in row[at]]))][:k]
        out[i, : len(best)] = best
    return out


def _blocks(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray]]:
    """Parts of a block: anchors, rows by id, and their scores."""
    if not len(anchors) or not len(rows):
        return
    rows = rows.sort_by([("id", "ascending")])
    right = _matrix(rows.column("v"))
    for i in range(0, len(anchors), AT_ONCE):
        part = anchors.slice(i, AT_ONCE)
        yield part, rows, _scores(_matrix(part.column("w")), right)


def _cells(n: int, block: int) -> int:
    return max(1, -(-n // block))


def mine(
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    per_positive: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``rows``.  An anchor's positives are its first
    ``positives`` other rows of its label; for each, the first ``per_positive``
    rows of other labels whose score is between ``low`` and ``high`` hundredths
    of the positive's.  First is by score downwards, then by id.

    Rows without id, label or vector, or with a null or non-finite component,
    take no part.  Of several rows with one id the smallest (label, vector)
    stands for it, and it is an anchor if one of them is.  Vectors of another
    length are not compared; those of length 0 are, and score 0.  An empty table
    gives an empty table.  Further columns may have any names.
    """
    spark = rows.sparkSession
    stages = Stages(spark, "negatives")
    everything = stages.write(usable(rows, anchors, id_col, vector_col, label_col), "rows")
    chosen = everything.where("is_anchor").select(F.col("id").alias("anchor"), F.col("label").alias("own"), F.col("v").alias("w"))
    down, across = _cells(everything.count(), ROWS), _cells(chosen.count(), ANCHORS)
    dealt = everything.select("id", "label", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(down)).cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"))

    def cells(df: DataFrame) -> DataFrame:
        return df.select("*", F.size("w").alias("dim"), F.pmod(F.xxhash64("anchor"), F.lit(across)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"))

    def meet(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        """Parts of a block: anchors, their ids, rows' ids, scores, which labels agree, which are other rows."""
        for a, r, s in _blocks(left, right):
            ids, others = a.column("anchor").to_numpy(), r.column("id").to_numpy()
            same = np.array(a.column("own").to_pylist())[:, None] == np.array(r.column("label").to_pylist())[None, :]
            yield a, ids, others, s, same, ids[:, None] != others[None, :]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((0, 3), np.int64)]
        for _, ids, others, s, same, apart in meet(left, right):
            at = _first(s, same & apart, positives)
            i, j = np.nonzero(at >= 0)
            out.append(np.stack([ids[i], others[at[i, j]], s[i, at[i, j]]], axis=1))
        return pa.table(dict(zip(("anchor", "id", "score"), np.concatenate(out).T.copy(), strict=True)))

    keys = ["x", "y", "dim"]
    near = cells(chosen).groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(best, "anchor long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    near = stages.write(near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p")), "positives")

    wanted = chosen.join(near.select("anchor", F.col("p.score").alias("best")), "anchor")

    def window(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((0, 3), np.int64)]
        for a, ids, others, s, same, apart in meet(left, right):
            listed = a.column("best").to_pylist()
            for k in range(positives):
                # ceil(low * p / 100) <= score <= floor(high * p / 100), in whole numbers.
                p = [x[k] if k < len(x) and low * x[k] <= high * x[k] else None for x in listed]
                floor = np.array([-(-low * x // 100) if x is not None else 1 for x in p], np.int64)[:, None]
                roof = np.array([high * x // 100 if x is not None else 0 for x in p], np.int64)[:, None]
                at = _first(s, ~same & apart & (s >= floor) & (s <= roof), per_positive)
                i, j = np.nonzero(at >= 0)
                out.append(np.stack([ids[i], others[at[i, j]], s[i, at[i, j]]], axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table({"key": pa.array([pack(a, s, 1, r) for a, r, s in found.tolist()], pa.binary())})

    hard = cells(wanted).groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(window, "key binary").rdd.map(lambda r: (bytes(r[0]), None))
    good = near.select("anchor", F.explode("p").alias("p")).rdd.map(lambda r: (pack(r[0], r[1].score, 0, r[1].id), None))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = good.union(hard).repartitionAndSortWithinPartitions(parts, anchor_partition)
    found = ordered.mapPartitions(lambda it: emit((k for k, _ in it), per_positive, low, high))
    return spark.createDataFrame(found, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
