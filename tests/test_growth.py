"""What queries shuffle and compute follows their input; their rows stay those of plain computations."""

import numpy as np
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from argusline.functions import kernels as K
from argusline.functions import pixels as P
from argusline.operators import images, knn, ml
from argusline.operators.images import pair_align
from argusline.plans import bindings as B
from argusline.plans import catalog

SF = "/root/testdata/sf0.1"


def shuffled(spark) -> int:
    """Bytes that all stages so far wrote to shuffles."""
    store, total, missing, i = spark.sparkContext._jsc.sc().statusStore(), 0, 0, 0
    while missing < 50:
        try:
            total, missing = total + store.lastStageAttempt(i).shuffleWriteBytes(), 0
        except Exception:
            missing += 1
        i += 1
    return total


def test_lsh_votes_shuffle_no_pairs(spark):
    q, m = B.queries(spark, SF), B.memory(spark, SF)
    before = shuffled(spark)
    votes = {r.query_id: r for r in ml.knn_vote_lsh(q, m, own=False).collect()}
    assert shuffled(spark) - before < 10 << 20  # with pairs: 50 MB
    unit = lambda df, i, v: df.select(F.col(i).alias("id"), array_to_vector(F.transform(F.col(v).cast("array<double>"), lambda x: x / F.sqrt(F.aggregate(F.col(v), F.lit(0.0), lambda s, y: s + y.cast("double") * y)))).alias("unit"))
    a, b = unit(q, "query_id", "emb"), unit(m, "sample_id", "sig")
    lsh = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=0.5, numHashTables=8, seed=5).fit(b)
    pairs = lsh.approxSimilarityJoin(a, b, 3.0, "d").selectExpr("datasetA.id query_id", "datasetB.id sample_id", "d * d / 2 dist")
    tier = knn.candidates(q, m, own=False).select("query_id", "sample_id", "label").unionByName(
        knn.candidate_counts(q, m, own=False).where("tier = 3").select("query_id").crossJoin(m.select("sample_id", "label")).where("sample_id <> query_id"))
    near = {}
    for r in pairs.join(tier, ["query_id", "sample_id"]).collect():
        near.setdefault(r.query_id, []).append((r.dist, r.label != "OK", r.sample_id))
    assert near and {i for i, v in votes.items() if v.has_memory} == set(near)
    for i, rows in near.items():
        best = sorted(rows)[:5]
        assert abs(votes[i].best_similarity - (1 - best[0][0])) < 1e-6 and votes[i].n_neighbors == len(best) and votes[i].best_match_path == f"m/{best[0][2]}.png"


def test_lsh_tier_three_meets_every_block(spark, monkeypatch):
    """Blocks and cells lose no row, and rows that share no bucket are none."""
    monkeypatch.setattr(knn, "M_BLOCK", 50)
    monkeypatch.setattr(knn, "CELLS", 4)
    rng = np.random.default_rng(3)
    rows = [(i, "NG" if i % 3 else "OK", f"R{i % 5}X", "C", rng.normal(size=6).tolist(), f"{i}") for i in range(900)] + [(900, "OK", "R1X", "C", [0.0] * 6, "z"), (901, "OK", "R1X", "C", None, "n")]
    memory = spark.createDataFrame(rows, "sample_id long, label string, part_key string, category_key string, sig array<double>, path string")
    queries = spark.createDataFrame([(2000 + i, "none", "C", rng.normal(size=6).tolist()) for i in range(30)], "query_id long, part string, category string, emb array<double>")
    q, m = ml.coded(queries, memory, bucket=0.1, tables=2)
    got = {}
    for r in knn.nearest(q, m, 3).collect():
        got.setdefault(r.query_id, []).append(r.sample_id)
    held = [(r.sample_id, r.label, np.array(r.sig), r.codes) for r in m.collect()]
    assert len(held) == 900
    want = {}
    for r in q.collect():
        x = np.array(r.emb)
        near = sorted((1 - x @ v / np.linalg.norm(x) / np.linalg.norm(v), label != "OK", i) for i, label, v, c in held if any(s == t for s, t in zip(c, r.codes, strict=True)))
        assert 3 < len(near) < 900
        want[r.query_id] = [i for _, _, i in near[:3]]
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def test_frames_are_drawn_after_joins_and_by_numpy(spark):
    """Frames are fifty times their line items: they are not shuffled, nor drawn pixel by pixel."""
    plan = catalog.QUERIES["detect_layout"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("MapInArrow") :]
    assert plan.count("MapInArrow") == 2 and "Join" in below and "Join" not in plan[: plan.rindex("MapInArrow")]
    assert "sequence(0" not in plan


def test_context_is_one_pass(spark):
    """No lambdas over pixels, no join but that of the pair; null boxes are the whole side, odd images are null."""
    pairs = pair_align(*(spark.createDataFrame([(i, 8, 8, [float((7 * i + 3 * k * (s + 1)) % 251) for k in range(64)]) for i in range(5)], "pair_id long, h int, w int, px array<double>") for s in range(2)))
    box = lambda *v: F.array(*[F.lit(x).cast("int") for x in v])
    boxes = F.when(F.col("pair_id") == 0, box(None, 0, 8, 8)).when(F.col("pair_id") == 1, box(0, 0, 8, 8)).when(F.col("pair_id") == 2, box(90, 90, 2, 2)).otherwise(box(1, 1, 2, 2))
    pairs = pairs.withColumns({c: boxes[i] for i, c in enumerate(("bx", "by", "bw", "bh"))}).withColumn("test", F.when(F.col("pair_id") == 3, F.slice("test", 1, 9)).otherwise(F.col("test")))
    whole = pairs.where("pair_id = 0").withColumn("bx", F.lit(0))
    out = images.context_localized(pairs, side=12)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = {r.pair_id: tuple(r)[1:] for r in out.collect()}
    assert got[0] == tuple(images.context_localized(whole, side=12).first())[1:] and got[0][0] < 1
    assert got[2] == (1.0, 0, True) and got[3] == (None, 0, True) and 0 < abs(got[4][0]) < 1


def test_structures_equal_the_columns(spark):
    """A stack gives what each image gives by columns; no lambda counts bins in the query's plan."""
    rng = np.random.default_rng(2)
    gray = rng.integers(0, 256, (40, 8, 8)).astype(float)
    hue, sat, val = (rng.choice([0.0, 5.625, 67.5, top - 0.5, top, -1.0, 33.3], (40, 64)) for top in (180.0, 256.0, 256.0))
    hue[0] = sat[0] = val[0] = 300.0  # no bin at all
    rows = [(i, 8, 8, hue[i].tolist(), sat[i].tolist(), val[i].tolist(), gray[i].ravel().tolist()) for i in range(40)]
    rows += [(40, 8, 8, *[rows[1][3]] * 3, None), (41, 4, 8, *[rows[1][3]] * 4), (42, 4, 4, *[[9.0] * 16] * 4)]
    df = spark.createDataFrame(rows, "i int, h int, w int, hue array<double>, s array<double>, v array<double>, gray array<double>")
    got = {r.i: r.vector for r in images.structural_vectors(df, 2).collect()}
    eight = F.lit(8)
    masks = images.edge_masks(df.where("i < 40"), edges=("gray", 50, 150)).withColumn("e", F.transform("edges", lambda e: F.when(e, 255.0).otherwise(0.0)))
    want = masks.select("i", F.concat(P.block_means(F.col("e"), eight, eight, 2), P.block_means(F.col("gray"), eight, eight, 2), P.hsv_histograms(F.col("hue"), F.col("s"), F.col("v"))).alias("vector"))
    assert {r.i: r.vector for r in want.collect()} == {i: got[i] for i in range(40)}
    assert got[40] is None and got[41] is None and len(got[42]) == 8 + 96
    assert any(K.edges(g, 50, 150).any() for g in gray) and all((K.edges(gray, 50, 150)[i] == K.edges(gray[i], 50, 150)).all() for i in range(40))
    plan = catalog.QUERIES["structural_embedding"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
