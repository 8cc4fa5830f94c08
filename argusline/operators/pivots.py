"""Exact nearest neighbours by cosine in a whole memory, most of which is skipped.

Cosine distance is half the squared distance of unit vectors, and that is a
metric.  Pivots are memory vectors picked by hash; a memory row belongs to its
nearest pivot and, there, to a band of distances from it.  Such a cell lies
between two spheres around its pivot, so the triangle inequality bounds how
near its rows can be to a query: a query meets first the cells that surely hold
enough rows, then those that may hold a nearer one than found.  Large cells are
cut into blocks by salt, so that no task gets a cell.

How much is skipped depends on the data: clusters are skipped well, vectors
that are spread evenly over many dimensions hardly at all.  Even then no query
meets a block twice, and there are about three blocks at most for each full one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusline.functions.vectors import norm
from argusline.operators.components import shared_dir

#: Queries and memory rows that meet at once.
Q_BLOCK, M_BLOCK = 256, 4096
#: Pivots, and bands around each, at most: their product bounds what the driver learns of the cells.
PIVOTS, BANDS = 256, 32
#: Rounding of distances of unit vectors.
SLACK = 1e-6

FOUND = "query_id long, tier int, sample_id long, label string, path string, dist double"


def usable(v: str | Column) -> Column:
    """Neither null nor empty nor zero, without null or non-finite components."""
    n = norm(F.col(v) if isinstance(v, str) else v)
    return F.coalesce((n > 0) & (n < float("inf")), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def alike(asked: pa.StructArray, held: pa.StructArray) -> np.ndarray | bool:
    """Whether ``codes`` agree in one place at least, for each query and row; always without codes."""
    if "codes" not in [f.name for f in asked.type]:
        return True
    p, q = (x.field("codes").flatten().to_numpy().reshape(len(x), -1) for x in (asked, held))
    out = np.zeros((len(p), len(q)), bool)
    for t in range(p.shape[1]):
        out |= p[:, t, None] == q[None, :, t]
    return out


def meet(k: int, own: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's queries (``asked``) with each of its memory rows (``held``): the ``k`` nearest of each query.

    One matrix product tells which rows can be among them; the distances of
    those are then summed in the order of the components, so that equal vectors
    are equally far wherever they are met.  Ties go to OK, then to the smaller id.
    If the rows have ``codes``, only rows that are ``alike`` are met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                tier, asked, held = whole.column("tier")[at].as_py(), whole.column("asked")[at].values, whole.column("held")[at].values
                emb, sig = asked.field("emb"), held.field("sig")
                dim = len(emb[0])
                x, y = _matrix(emb, dim), _matrix(sig, dim)
                ids, sids, ng = asked.field("query_id").to_numpy(), held.field("sample_id").to_numpy(), held.field("label").to_numpy(zero_copy_only=False) != "OK"
                one, two = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
                fit = (two > 0) & np.isfinite(two)
                near = np.broadcast_to(alike(asked, held), (len(ids), len(sids)))
                with np.errstate(all="ignore"):
                    about = 1 - (x @ y.T) / one[:, None] / two
                who, where, far = [], [], []
                for c in range(len(ids)):
                    ok = np.flatnonzero(fit & near[c] & (own | (sids != ids[c]))) if one[c] > 0 and np.isfinite(one[c]) else np.zeros(0, int)
                    if len(ok) > k:
                        d = about[c, ok]
                        ok = ok[d <= np.partition(d, k - 1)[k - 1] + 1e-9]
                    d = 1 - (y[ok] * x[c]).sum(axis=1) / (two[ok] * one[c])
                    first = np.lexsort((sids[ok], ng[ok], d))[:k]
                    who.append(np.full(len(first), ids[c]))
                    where.append(ok[first])
                    far.append(d[first])
                who, where, far = np.concatenate(who), pa.array(np.concatenate(where).astype(np.int64)), np.concatenate(far)
                taken = [held.field(f).take(where) for f in ("sample_id", "label", "path")]
                columns = [pa.array(who, pa.int64()), pa.array(np.full(len(who), tier), pa.int32()), *taken, pa.array(far, pa.float64())]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([v.cast(t) for v, t in zip(columns, kinds, strict=True)], ["query_id", "tier", "sample_id", "label", "path", "dist"])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("dist", F.desc("label"), "sample_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _units(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each vector length: it, which rows have it, and these as unit vectors."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        x = _matrix(column.take(pa.array(at)), int(dim))
        yield int(dim), at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (u @ v.T)))


class PivotIndex:
    """A memory (sample_id, label, path, sig) in cells, written below ``spark.checkpoint.dir``.

    ``cells`` has for each: vector length, pivot, rows, least and greatest
    distance from the pivot, and blocks.  Vectors of a length that no pivot has
    are one cell, which nothing is known of.  Unusable vectors are left out.
    """

    def __init__(self, memory: DataFrame, block: int = M_BLOCK, pivots: int = PIVOTS, bands: int = BANDS):
        spark = self.spark = memory.sparkSession
        self.folder = f"{shared_dir(spark)}/pivots-{uuid.uuid4().hex[:12]}"
        rows = memory.select("sample_id", "label", "path", F.col("sig").cast("array<double>").alias("sig")).where(usable("sig"))
        n = -(-2 * rows.count() // block)
        some = rows.select("sig").orderBy(F.xxhash64("sample_id", "sig")).limit(max(1, min(pivots, n))).collect()
        by_dim: dict[int, list] = {}
        for r in some:
            by_dim.setdefault(len(r.sig), []).append(r.sig)
        self.pivots = {dim: np.unique(np.array([np.array(v) / np.sqrt((np.array(v) ** 2).sum()) for v in vs]), axis=0) for dim, vs in by_dim.items()}
        points = self.pivots

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dim, pivot, r = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
                for d, at, u in _units(b.column("sig")):
                    dim[at] = d
                    if d in points:
                        far = _apart(u, points[d])
                        pivot[at], r[at] = far.argmin(axis=1), far.min(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dim), pa.array(pivot), pa.array(r)], [*b.schema.names, "dim", "pivot", "r"])

        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        placed = self._written(rows.mapInArrow(place, f"{kind}, dim int, pivot int, r double"), "rows")
        # As many rows as pivots, and one for each vector length without.
        around = placed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
        around = around.withColumn("bands", F.least(F.lit(bands), F.ceil(F.col("n") / block))).drop("n")
        at = F.floor(F.coalesce(F.try_divide(F.col("r") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * F.col("bands"))
        banded = placed.join(F.broadcast(around), ["dim", "pivot"]).withColumn("band", F.least(F.col("bands") - 1, at).cast("int")).drop("lo", "hi", "bands")
        spans = banded.groupBy("dim", "pivot", "band").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
        self.cells = spans.orderBy("dim", "pivot", "band").collect()  # at most PIVOTS * BANDS, and one for each length without
        self.blocks = [-(-c.n // block) for c in self.cells]
        table = [(i, c.dim, c.pivot, c.band, s) for i, (c, s) in enumerate(zip(self.cells, self.blocks, strict=True))]
        self._table = spark.createDataFrame(table, "cell int, dim int, pivot int, band int, salts int")
        salt = F.pmod(F.xxhash64("sample_id"), F.col("salts")).cast("int")
        dealt = banded.join(F.broadcast(self._table), ["dim", "pivot", "band"]).withColumn("salt", salt)
        held = F.collect_list(F.struct("sample_id", "label", "path", "sig")).alias("held")
        self.held = self._written(dealt.groupBy("cell", "salt").agg(held), "blocks")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _chosen(self, asked: DataFrame, choose: Callable) -> DataFrame:
        """``asked`` with its ``cells``: what ``choose`` takes of the row, given rows, near and far of all."""
        bounds = _Bounds(self.pivots, [(c.dim, c.pivot, c.n, c.lo, c.hi) for c in self.cells])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [[] for _ in range(b.num_rows)]
                limit = b.column("bound").to_numpy(zero_copy_only=False)
                met = b.column("met")
                for dim, at, u in _units(b.column("emb")):
                    cells, n, near, far = bounds(dim, u)
                    for i, row in enumerate(at.tolist()):
                        old = set(met[row].as_py() or ())
                        out[row] = [c for c in cells[choose(n, near[i], far[i], limit[row])].tolist() if c not in old]
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("emb"), pa.array(out, pa.list_(pa.int32()))], ["query_id", "emb", "cells"])

        return asked.select("query_id", "emb", "bound", "met").mapInArrow(run, "query_id long, emb array<double>, cells array<int>")

    def first_cells(self, queries: DataFrame, k: int, own: bool = True) -> DataFrame:
        """The cells that surely hold ``k`` rows nearest by their far ends (all, if there are fewer)."""
        need = k + (not own)

        def choose(n, near, far, bound):
            order = np.argsort(far, kind="stable")
            return order[: int(np.searchsorted(np.cumsum(n[order]), need)) + 1]

        asked = queries.select("query_id", F.col("emb").cast("array<double>").alias("emb")).where(usable("emb"))
        blank = asked.withColumn("bound", F.lit(None).cast("double")).withColumn("met", F.lit(None).cast("array<int>"))
        return self._written(self._chosen(blank, choose), "first")

    def further_cells(self, first: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """The other cells that may hold a row as near as the ``k``-th found."""

        def choose(n, near, far, bound):
            return np.flatnonzero(near <= bound + SLACK)

        last = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("dist").alias("last"))
        bound = F.when(F.col("n") >= k, F.sqrt(2 * F.greatest(F.lit(0.0), "last"))).otherwise(F.lit(float("inf")))
        asked = first.join(last, "query_id", "left").select("query_id", "emb", F.coalesce(bound, F.lit(float("inf"))).alias("bound"), F.col("cells").alias("met"))
        return self._written(self._chosen(asked, choose), "further")

    def compared(self, chosen: DataFrame, k: int, own: bool) -> DataFrame:
        """The ``k`` nearest of each query in each block of its cells."""
        each = chosen.select("query_id", "emb", F.explode("cells").alias("cell"))
        # As many rows as cells.
        per = each.groupBy("cell").agg(F.ceil(F.count("*") / Q_BLOCK).cast("int").alias("parts"))
        each = each.join(F.broadcast(per), "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        asked = each.groupBy("cell", "part").agg(F.collect_list(F.struct("query_id", "emb")).alias("asked"))
        asked = asked.join(F.broadcast(self._table.select("cell", "salts")), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        return asked.join(self.held, ["cell", "salt"]).select(F.lit(3).alias("tier"), "asked", "held").mapInArrow(meet(k, own), FOUND)

    def nearest(self, queries: DataFrame, k: int, own: bool = True) -> DataFrame:
        """query_id, tier (3), sample_id, label, path, dist, rank of the ``k`` nearest; not ``own``: rows of the query's id are none."""
        first = self.first_cells(queries, k, own)
        found = self._written(ranked(self.compared(first, k, own), k).drop("rank"), "found")
        more = self.compared(self.further_cells(first, found, k), k, own)
        return ranked(found.unionByName(more), k)


class _Bounds:
    """How near and how far the rows of each cell of a vector length can be from a query."""

    def __init__(self, pivots: dict[int, np.ndarray], shape: list[tuple]):
        self.pivots, self.by_dim = pivots, {}
        for i, c in enumerate(shape):
            self.by_dim.setdefault(c[0], []).append((i, *c[1:]))

    def __call__(self, dim: int, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = self.by_dim.get(dim, [])
        at, pivot, n, lo, hi = (np.array([r[j] for r in rows], t) for j, t in enumerate((int, int, int, float, float)))
        if dim not in self.pivots or not rows:
            return at, n, np.zeros((len(u), len(at))), np.full((len(u), len(at)), 2.0)
        d = _apart(u, self.pivots[dim])[:, pivot]
        return at, n, np.maximum(0, np.maximum(d - hi, lo - d)), d + hi
