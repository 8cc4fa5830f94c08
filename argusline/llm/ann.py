"""Approximate nearest neighbours by NN-descent and greedy graph search.

Vectors that are equal (up to a power of two) are one node, which answers with
its smallest ids: they tie.  NN-descent starts
from random neighbours and joins, for every node, its neighbours and those it
is a neighbour of: they are likely neighbours of each other.  A round is a
join that brings the vectors to the nodes whose neighbourhood they are in, a
local comparison of each neighbourhood (only of pairs with a new member, and
only what beats the current worst neighbour is sent on), and a merge that
keeps the best.  Queries then walk the graph greedily: the best unexpanded
nodes of a query's beam are joined with their neighbours until the beam holds
none.  What is found is scored on the original vectors in double precision.

Graph and search use 32-bit copies of the unit vectors, taken from their mean:
that changes no distance between them (and their distances rank as cosines
do), but leaves the copies exact where one component dominates all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusline.llm.common import Stages

DEGREE = 24  #: neighbours kept for a node
REVERSE = 24  #: of those it is a neighbour of, how many join a round
START = 32  #: nodes of a random group that start as neighbours
ROUNDS = 8  #: at most; fewer when under a thousandth of the edges change
SENT = 8  #: best new pairs that a neighbourhood sends for each member
BEAM, WIDTH, STEPS = 384, 64, 12  #: nodes a query holds, expands at once, and how often
ENTRIES = 16  #: nodes where every query starts


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: finite, non-zero vectors only, padded with zeros to one length."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(vectors: list[list[float]], dim: int) -> np.ndarray:
    """Rows padded with zeros and divided by a power of two near their largest component.

    That is exact and keeps squares from over- and underflowing.
    """
    m = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        m[i, : min(dim, len(v))] = v[:dim]
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, initial=0))[1][:, None]) + 0.0


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _read(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(-1, dim).astype(np.float64)


class Graph:
    """A neighbour graph over the distinct vectors of a table."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.stages = Stages(vectors.sparkSession, "ann")
        st = self.stages
        rows = _clean(vectors, id_col, vector_col)
        self.dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
        dim = self.dim

        self.mean = mean = self._mean(rows)

        def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = _matrix(b.column("v").to_pylist(), dim)
                marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in m), np.int64).reshape(-1, 2)
                q = [x.tobytes() for x in (_unit(m) - mean).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(q, pa.binary())], ["vec_id", "h1", "h2", "q"])

        # Equal vectors are one node: a common vector is one node, not many.
        told = st.write(rows.mapInArrow(small, "vec_id long, h1 long, h2 long, q binary"), "small")
        least = st.write(told.groupBy("h1", "h2").agg(F.min("vec_id").alias("node")), "least")
        self.of = st.write(told.join(least, ["h1", "h2"]).select("vec_id", "node").distinct(), "of")
        self.nodes = st.write(told.join(least.select("node"), F.col("vec_id") == F.col("node")).select("node", "q").dropDuplicates(["node"]), "nodes")
        self.exact = rows
        self.edges = self._descend()

    def _mean(self, rows: DataFrame) -> np.ndarray:
        """Mean of the unit vectors: one sum a task, one number a component."""
        dim = self.dim

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(dim), 0
            for b in batches:
                total += _unit(_matrix(b.column("v").to_pylist(), dim)).sum(axis=0)
                n += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["s", "n"])

        parts = rows.select("v").mapInArrow(sums, "s array<double>, n long").select(F.posexplode("s").alias("i", "s"), "n")
        each = parts.groupBy("i").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1))).alias("s")).orderBy("i").collect()  # `dim` rows
        return np.array([r.s for r in each]) if each else np.zeros(dim)

    def _neighbourhoods(self, rows: DataFrame) -> DataFrame:
        """Pairs that beat a node's worst: src, dst, sim, new.

        ``rows`` has u (whose neighbourhood), v, q, worst and new.
        """
        dim, sent = self.dim, SENT

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                src, dst, sim = [], [], []
                for own in b.column("own").to_pylist():
                    if len(own) < 2:
                        continue
                    ids = np.array([x["v"] for x in own])
                    m = _read([x["q"] for x in own], dim)
                    new = np.array([x["new"] for x in own])
                    square = np.einsum("ij,ij->i", m, m)
                    # Less the squared distances, near 0 for near vectors.
                    g = (2 * (m @ m.T) - square[:, None] - square[None, :]).astype(np.float32)
                    ok = (g > np.array([x["worst"] for x in own], np.float32)[:, None]) & (new[:, None] | new[None, :]) & (ids[:, None] != ids[None, :])
                    g = np.where(ok, g, -99)
                    r = min(sent, len(ids) - 1)
                    best = np.argpartition(-g, r - 1, axis=1)[:, :r]
                    i, j = np.repeat(np.arange(len(ids)), r), best.ravel()
                    keep = g[i, j] > -50
                    src.append(ids[i[keep]])
                    dst.append(ids[j[keep]])
                    sim.append(g[i, j][keep])
                empty = np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src or [empty]).astype(np.int64)), pa.array(np.concatenate(dst or [empty]).astype(np.int64)), pa.array(np.concatenate(sim or [empty]).astype(np.float32))], ["src", "dst", "sim"])

        whole = rows.groupBy("u").agg(F.collect_list(F.struct("v", "q", "worst", "new")).alias("own"))
        return whole.select("own").mapInArrow(run, "src long, dst long, sim float").withColumn("new", F.lit(True))

    @staticmethod
    def _best(edges: DataFrame) -> DataFrame:
        """The nearest ``DEGREE`` of each node, an old edge before a new equal."""
        one = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
        rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst"))
        return one.withColumn("r", rank).where(F.col("r") <= DEGREE).drop("r")

    def _reverse(self, edges: DataFrame, turn: int) -> DataFrame:
        """Up to ``REVERSE`` nodes that have a node as neighbour, new ones first."""
        order = W.partitionBy("dst").orderBy(F.desc("new"), F.xxhash64("src", "dst", F.lit(turn)))
        return edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= REVERSE).select(F.col("dst").alias("u"), F.col("src").alias("v"), "new")

    def _descend(self) -> DataFrame:
        st, n = self.stages, self.nodes.count()
        groups = max(1, -(-n // START))
        starts = None
        for turn in range(3):  # three random groups a node, so that groups connect
            own = self.nodes.select(F.concat(F.lit(f"{turn}-"), F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(groups))).alias("u"), F.col("node").alias("v"), "q", F.lit(-9.0).cast("float").alias("worst"), F.lit(True).alias("new"))
            starts = own if starts is None else starts.union(own)
        edges = st.write(self._best(self._neighbourhoods(starts)), "edges")
        for turn in range(ROUNDS):
            worst = edges.groupBy("src").agg(F.when(F.count("*") >= DEGREE, F.min("sim")).otherwise(-9.0).cast("float").alias("worst"))
            near = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "new").union(self._reverse(edges, turn))
            near = near.groupBy("u", "v").agg(F.max("new").alias("new"))
            known = self.nodes.join(worst, F.col("node") == F.col("src"), "left").select(F.col("node").alias("v"), "q", F.coalesce("worst", F.lit(-9.0).cast("float")).alias("worst"))
            found = self._neighbourhoods(near.join(known, "v"))
            after = st.write(self._best(edges.withColumn("new", F.lit(False)).union(found)), "edges")
            st.drop(edges)
            edges = after
            st.release()
            changed = edges.where("new").count()
            if changed * 1000 <= n * DEGREE:
                break
        return edges

    def adjacency(self) -> DataFrame:
        """node, near: its neighbours with their vectors."""
        both = self.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        named = both.join(self.nodes.select(F.col("node").alias("v"), "q"), "v")
        return named.groupBy(F.col("u").alias("node")).agg(F.collect_list(F.struct("v", "q")).alias("near"))

    def search(self, queries: DataFrame, k: int, id_col: str = "query_id", vector_col: str = "v", own: bool = True) -> DataFrame:
        """query_id, rank, vec_id, score: the nearest found for each query.

        ``own``: queries are rows of the table, start at their own node and do
        not find themselves.
        """
        st, dim = self.stages, self.dim
        graph = st.write(self.adjacency(), "graph")
        asked = _clean(queries, id_col, vector_col).withColumnRenamed("vec_id", "query_id").distinct()

        mean = self.mean

        def pad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = (_unit(_matrix(b.column("v").to_pylist(), dim)) - mean).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array([x.tobytes() for x in m], pa.binary())], ["query_id", "qv"])

        wanted = st.write(asked.mapInArrow(pad, "query_id long, qv binary"), "queries")
        # Entry points: a fixed number of nodes by hash, and a query's own node.
        entries = [r.node for r in self.nodes.orderBy(F.xxhash64("node")).limit(ENTRIES).collect()]
        begin = wanted.withColumn("first", F.array(*[F.lit(i).cast("long") for i in entries]).cast("array<long>"))
        if own:
            begin = begin.join(self.of.withColumnRenamed("vec_id", "query_id"), "query_id", "left").withColumn("first", F.array_compact(F.array_append("first", F.col("node"))))
        state = st.write(begin.select("query_id", "qv", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("sims"), F.array().cast("array<long>").alias("done"), "first").withColumnRenamed("first", "ask"), "beam")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The neighbours of a node and how near they are to the query."""
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    b = whole.slice(at, 500)
                    near = b.column("near")
                    flat, many = near.flatten(), np.diff(near.offsets.to_numpy())
                    apart = _read(flat.field("q").to_pylist(), dim) - np.repeat(_read(b.column("qv").to_pylist(), dim), many, axis=0)
                    sims = pa.array(-np.einsum("ij,ij->i", apart, apart).astype(np.float32))
                    offsets = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, x) for x in (flat.field("v"), sims)]
                    yield pa.RecordBatch.from_arrays([b.column("query_id"), *lists], ["query_id", "ids", "sims"])

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    ids, sims = np.array(r["ids"], np.int64), np.array(r["sims"], np.float32)
                    done = np.union1d(np.array(r["done"], np.int64), np.array(r["ask"], np.int64))
                    for x in r["found"] or ():
                        ids, sims = np.r_[ids, np.array(x["ids"], np.int64)], np.r_[sims, np.array(x["sims"], np.float32)]
                    ids, first = np.unique(ids, return_index=True)
                    sims = sims[first]
                    top = np.argsort(-sims, kind="stable")[:BEAM]
                    ids, sims = ids[top], sims[top]
                    ask = ids[~np.isin(ids, done)][:WIDTH]
                    out.append({"query_id": r["query_id"], "qv": r["qv"], "ids": ids.tolist(), "sims": sims.tolist(), "done": done.tolist(), "ask": ask.tolist()})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("query_id", pa.int64()), ("qv", pa.binary()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("done", pa.list_(pa.int64())), ("ask", pa.list_(pa.int64()))]))

        kind = "query_id long, qv binary, ids array<long>, sims array<float>, done array<long>, ask array<long>"
        for _ in range(STEPS):
            front = state.select("query_id", "qv", F.explode("ask").alias("node"))
            # The entry nodes themselves are candidates too: a node is near itself.
            met = front.join(graph, "node").select("query_id", "qv", "near").mapInArrow(meet, "query_id long, ids array<long>, sims array<float>")
            found = met.groupBy("query_id").agg(F.collect_list(F.struct("ids", "sims")).alias("found"))
            after = st.write(state.join(found, "query_id", "left").mapInArrow(step, kind), "beam")
            st.drop(state)
            state = after
            st.release()
            if state.where(F.size("ask") > 0).isEmpty():
                break
        # Exact: every id of the best nodes, on the original vectors.
        nodes = state.select("query_id", F.explode(F.slice("ids", 1, 8 * k + 8)).alias("node"))
        if own:
            nodes = nodes.union(self.of.join(wanted.select("query_id"), F.col("vec_id") == F.col("query_id")).select("query_id", "node")).distinct()
        rank = F.row_number().over(W.partitionBy("node").orderBy("vec_id"))
        # Vectors of a node tie, so its smallest ids stand for all of them.
        kin = self.of.withColumn("r", rank).where(F.col("r") <= k + 1).drop("r")
        pairs = nodes.join(kin, "node").select("query_id", "vec_id").where(F.col("query_id") != F.col("vec_id") if own else F.lit(True))
        pairs = pairs.join(self.exact, "vec_id").join(asked.select("query_id", F.col("v").alias("w")), "query_id")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                wide = max([dim, *(len(w) for w in b.column("w").to_pylist())])
                x, y = (_matrix(b.column(c).to_pylist(), wide) for c in ("v", "w"))
                s = [float(u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v))) for u, v in zip(x, y, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

        scored = pairs.mapInArrow(score, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found by cosine for queries that are rows of ``vectors``.

    Vectors that are null, zero, or hold null or non-finite components take no
    part; shorter ones count as padded with zeros.  Ties go to the smaller id.
    Repeated rows count once; with fewer candidates all are returned, and an empty table
    gives none.
    """
    graph = Graph(vectors, id_col, vector_col)
    return graph.search(queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("v")), k)
