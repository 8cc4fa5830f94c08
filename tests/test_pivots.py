"""Votes over a whole memory: equal to brute force, with most of it skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from argusline.operators import knn
from argusline.operators.pivots import PivotIndex

ROW = "sample_id long, label string, part_key string, category_key string, path string, sig array<double>"


def brute(queries, memory, k, own):
    out = set()
    for i, v in queries:
        rows = []
        for s, label, _, _, path, w in memory:
            if w is None or len(w) != len(v) or not own and s == i or None in w:
                continue
            x, y = np.array(v, float), np.array(w, float)
            both = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
            if both > 0 and np.isfinite(both):
                rows.append((1 - (x * y).sum() / both, label != "OK", s, label, path))
        out |= {(i, r + 1, s, label, path, round(d, 9) + 0.0) for r, (d, _, s, label, path) in enumerate(sorted(rows)[:k])}
    return out


@pytest.fixture(scope="module")
def clusters():
    """Clusters in 16 dimensions, a third copies of one vector, few rows of another length, and unusable ones."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(24, 16))
    vectors = [(centres[i % 24] + rng.normal(scale=0.05, size=16)).tolist() for i in range(3000)]
    vectors += [centres[0].tolist()] * 1500 + [rng.normal(size=8).tolist() for _ in range(40)]
    vectors += [[0.0] * 16, None, [], [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [3.0]]
    return [(i, ("NG", "OK")[i % 3 > 0], "P", "C", f"m/{i}", v) for i, v in enumerate(vectors)]


def rows_of(found):
    return {(r.query_id, r["rank"], r.sample_id, r.label, r.path, round(r.dist, 9) + 0.0) for r in found.collect()}


@pytest.mark.parametrize("own", [True, False])
def test_equal_to_brute_force_and_most_blocks_are_skipped(spark, clusters, own):
    asked = [(i, clusters[i][5]) for i in range(0, 4540, 50)] + [(9_000, [3.0, 1.0]), (9_001, [-2.0]), (4546, [3.0])]
    q = spark.createDataFrame([*asked, (9_002, [0.0] * 16), (9_003, None), (9_004, [])], "query_id long, emb array<double>")
    index = PivotIndex(spark.createDataFrame(clusters, ROW), block=64)
    assert rows_of(index.nearest(q, 5, own)) == brute(asked, clusters, 5, own)

    blocks = lambda chosen: sum(index.blocks[c] for r in chosen.collect() for c in r.cells)
    first = index.first_cells(q, 5, own)
    found = knn.ranked(index.compared(first, 5, own), 5)
    further = index.further_cells(first, found, 5)
    before = {r.query_id: set(r.cells) for r in first.collect()}
    assert all(before[r.query_id].isdisjoint(r.cells) for r in further.collect())
    full = sum(b for c, b in zip(index.cells, index.blocks) if c.dim == 16) * 90
    # Queries that are the repeated vector must meet its blocks; the others a cluster or two.
    assert blocks(first) + blocks(further) < 0.4 * full
    assert index.held.agg(F.max(F.size("held"))).first()[0] < 3 * 64  # a repeated vector is dealt by salt


def test_evenly_spread_vectors_lose_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "OK", "P", "C", None, rng.normal(size=32).tolist()) for i in range(600)]
    asked = [(i, rows[i][5]) for i in range(0, 600, 50)]
    q = spark.createDataFrame(asked, "query_id long, emb array<double>")
    assert rows_of(PivotIndex(spark.createDataFrame(rows, ROW), block=32).nearest(q, 7)) == brute(asked, rows, 7, True)


def test_empty_tables(spark):
    q = spark.createDataFrame([(1, [1.0])], "query_id long, emb array<double>")
    m = spark.createDataFrame([(1, "OK", "P", "C", "p", [2.0])], ROW)
    assert PivotIndex(m.limit(0)).nearest(q, 3).count() == 0
    assert PivotIndex(m).nearest(q.limit(0), 3).count() == 0
    assert PivotIndex(m).nearest(q, 3, own=False).count() == 0
    assert [r.sample_id for r in PivotIndex(m).nearest(q, 3).collect()] == [1]


def test_votes_beyond_a_block_go_through_pivots(spark, clusters, monkeypatch):
    """Tier 3 in one block and through the index give the same votes."""
    q = spark.createDataFrame([(i, ("none", "p")[i % 100 > 0], "C", clusters[i][5]) for i in range(0, 3000, 50)], "query_id long, part string, category string, emb array<double>")
    m = spark.createDataFrame(clusters, ROW)
    made = []
    monkeypatch.setattr(knn, "PivotIndex", lambda memory: made.append(1) or PivotIndex(memory, block=256))
    through = {tuple(r) for r in knn.nearest(q, m, 5, own=False).collect()}
    assert made == [1] and {r[1] for r in through} == {1, 3}
    monkeypatch.setattr(knn, "M_BLOCK", 10_000)
    assert {tuple(r) for r in knn.nearest(q, m, 5, own=False).collect()} == through and made == [1]
