"""What an executor holds at once while near duplicates are sought."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from argusline.llm import parity_join
from argusline.llm.common import READ, Stages


def texts(n, words, seed):
    """Texts in families of near copies, of many lengths."""
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        own = [f"f{i % 7}w{k}" for k in range(words // (1 + i % 3))]
        for k in rng.integers(0, len(own), rng.integers(0, 4)):
            own[k] = f"x{i}y{k}"
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("block", [4, 512])
def test_cells_are_met_row_by_row(spark, monkeypatch, block):
    """No list of a cell's members is made, and no pair that the bits allow is lost."""
    monkeypatch.setattr(parity_join, "BLOCK", block)
    monkeypatch.setattr(parity_join, "PAIRS", 50)
    docs = spark.createDataFrame(texts(60, 90, 1), "doc_id long, text string")
    join = parity_join.ParityJoin(docs)
    members = join.classes.select(F.lit(1).alias("key"), "cid", "n", (F.col("first") % 5).alias("label"))
    members = members.union(members.where("label < 3").withColumn("key", F.lit(2)))
    found = join.cells(members)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    got = sorted((r.a, r.b) for r in found.collect())
    label = {r.cid: r.label for r in members.collect()}
    sets = {r.row: set(r["items"]) for r in join.texts.where("items IS NOT NULL").collect() if r.row in label}
    links = {(a, b) for a in sets for b in sets if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links and links <= set(got) and len(set(got)) == len(got)
    assert all(a < b and label[a] != label[b] for a, b in got)


def test_runs_go_on_over_batches():
    rows = [(k // 5, k // 3) for k in range(40)]
    table = pa.table({"x": [r[0] for r in rows], "y": [r[1] for r in rows]})
    for size in (1, 2, 7, 50):
        parts = [list(zip(*(c.to_pylist() for c in t.columns), strict=True)) for t in parity_join.whole_runs(iter(table.to_batches(size)), ["x", "y"])]
        assert [r for part in parts for r in part] == rows
        assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert not list(parity_join.whole_runs(iter(table.slice(0, 0).to_batches()), ["x", "y"]))


def test_sets_are_written_in_small_row_groups(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(8000))) for i in range(300)], "doc_id long, text string").coalesce(1)
    join = parity_join.ParityJoin(docs)
    _, path = join.stages.paths[id(join.texts)]
    groups = [m.row_group(k) for f in glob.glob(path.removeprefix("file:") + "/*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 300
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) < 12 << 20


def test_sets_are_read_a_few_at_a_time(spark, monkeypatch):
    """While tables are written that read whole sets, and not after."""
    seen, write, usual = {}, Stages.write, spark.conf.get(READ)

    def told(self, df, label="t", batch=None, read=None, **options):
        seen.setdefault(label, set()).add(read)
        return write(self, df, label, batch, read, **options)

    monkeypatch.setattr(Stages, "write", told)
    docs = spark.createDataFrame(texts(60, 90, 1), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in parity_join.near_duplicates(docs).collect()}
    assert len(found) == 60 and any(k != v for k, v in found.items())
    for label in ("words", "own", "links"):
        assert seen[label] == {parity_join.READ} and int(usual) > parity_join.READ
    assert spark.conf.get(READ) == usual
