"""Votes, fusion and verdicts over the embedding memory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from argusline.functions import text as T
from argusline.functions import vectors as V
from argusline.operators import inspection, knn, routing, scoring as S
from argusline.operators.images import pair_align
from argusline.operators.pivots import PivotIndex
from argusline.plans import bindings as B

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


TIERS = (
    B.with_("queries", "memory")
    + """,
q AS (SELECT *, regexp_replace(upper(part), '[^A-Z0-9]', '', 'g') AS qp, regexp_replace(upper(category), '[^A-Z0-9]', '', 'g') AS qc FROM queries),
c AS (SELECT q.query_id, m.*, CASE WHEN contains(m.part_key, qp) AND m.category_key = qc THEN 1 WHEN contains(m.part_key, qp) THEN 2 ELSE 3 END AS tier, qc, emb FROM q JOIN memory m ON m.sample_id <> q.query_id),
o AS (SELECT * FROM c WHERE tier = 1 OR qc NOT IN ('SHIFTED', 'UPSIDEDOWN', 'REVERSE')),
cand AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM o) WHERE tier = best),
d AS (SELECT *, 1 - list_cosine_similarity(emb, sig) AS dist FROM cand),
k AS (SELECT query_id, min(tier) AS tier, count(*) FILTER (label = 'OK') AS ok, count(*) FILTER (label = 'NG') AS ng FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, label DESC, sample_id) AS rn FROM d),
v AS (SELECT query_id, sum(CASE WHEN label = 'NG' THEN 1 / greatest(dist, 1e-4) ELSE 0 END) / sum(1 / greatest(dist, 1e-4)) AS raw, min(dist) AS nearest, count(*) AS n, min_by(path, rn) AS path, min_by(label, rn) AS label FROM r WHERE rn <= 5 GROUP BY 1),
vote AS (SELECT q.query_id, v.n IS NOT NULL AS has_memory, k.tier AS tier,
  coalesce(CASE WHEN ok = 0 THEN least(0.60::DOUBLE, raw) WHEN ng = 0 THEN greatest(0.40::DOUBLE, raw) ELSE raw END, 0.5::DOUBLE) AS vote_defect,
  coalesce(greatest(0.0::DOUBLE, 1 - nearest), 0.0::DOUBLE) AS best_similarity, coalesce(v.n, 0) AS n_neighbors, v.path AS best_match_path, v.label AS best_match_label
  FROM queries q LEFT JOIN v USING (query_id) LEFT JOIN k USING (query_id))
"""
)


def _vote(spark, d):
    return knn.knn_vote(B.queries(spark, d), B.memory(spark, d), own=False)


@query("knn_vote", TIERS + "SELECT * REPLACE (round(vote_defect, 6) AS vote_defect, round(best_similarity, 6) AS best_similarity) FROM vote")
def knn_vote(spark, d):
    return _vote(spark, d).withColumns({"vote_defect": F.round("vote_defect", 6), "best_similarity": F.round("best_similarity", 6)})


@query(
    "nearest_in_all",
    B.with_("queries", "memory")
    + """, d AS (SELECT query_id, sample_id, label, 1 - list_dot_product(emb, sig) / (sqrt(list_dot_product(emb, emb)) * sqrt(list_dot_product(sig, sig))) AS dist FROM queries, memory WHERE sample_id <> query_id)
SELECT query_id, rank, sample_id, label, round(dist, 6) AS dist FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY dist, label DESC, sample_id))::INT AS rank FROM d) WHERE rank <= 5""",
)
def nearest_in_all(spark, d):
    """The five nearest in the whole memory, whatever its keys, through pivots."""
    found = PivotIndex(B.memory(spark, d), block=256).nearest(B.queries(spark, d), 5, own=False)
    return found.select("query_id", "rank", "sample_id", "label", F.round("dist", 6).alias("dist"))


@query("tiered_candidates", TIERS + "SELECT query_id, min(tier) AS tier, count(*) AS n FROM cand GROUP BY 1")
def tiered_candidates(spark, d):
    return knn.candidate_counts(B.queries(spark, d), B.memory(spark, d), own=False).select("query_id", "tier", "n")


@query("candidates", TIERS + "SELECT query_id, sample_id FROM c WHERE tier = 1")
def candidates(spark, d):
    return knn.candidates(B.queries(spark, d), B.memory(spark, d), own=False).where("tier = 1").select("query_id", "sample_id")


@query("strict_block", TIERS + "SELECT query_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM cand)")
def strict_block(spark, d):
    q = B.queries(spark, d)
    return q.join(knn.candidate_counts(q, B.memory(spark, d), own=False).select("query_id"), "query_id", "left_anti").select("query_id")


@query("candidates_open", B.with_("queries", "memory") + " SELECT query_id, count(*) AS n FROM queries q JOIN memory m ON contains(m.part_key, regexp_replace(upper(part), '[^A-Z0-9]', '', 'g')) AND m.category_key = upper(category) AND m.sample_id <> q.query_id GROUP BY 1")
def candidates_open(spark, d):
    """The older judge: no strict categories, exact tier only."""
    return knn.candidate_counts(B.queries(spark, d), B.memory(spark, d), strict=(), own=False).where("tier = 1").select("query_id", "n")


@query("memory_summary", B.with_("memory") + " SELECT category_key, part_key, count(*) FILTER (label = 'OK') AS n_ok, count(*) FILTER (label = 'NG') AS n_ng, count(*) AS n_total FROM memory GROUP BY 1, 2")
def memory_summary(spark, d):
    return knn.memory_summary(B.memory(spark, d), ["category_key", "part_key"])


@query("union_memory", B.with_("memory") + " SELECT label, count(*) AS n, sum(sample_id)::BIGINT AS s FROM memory GROUP BY 1")
def union_memory(spark, d):
    m = B.memory(spark, d)
    both = knn.union_memory(m.where("label = 'OK'").drop("label"), m.where("label = 'NG'").drop("label"))
    return both.groupBy("label").agg(F.count("*").alias("n"), F.sum("sample_id").alias("s"))


@query("cosine_distance", "SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_distance(spark, d):
    e = B.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return e.join(other, "vec_id").select("vec_id", F.round(V.cosine_distance(F.col("e"), F.col("f")), 6).alias("dist"))


MUTUAL = """WITH a AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 1),
d AS (SELECT a.id AS a_id, b.id AS b_id, a.label AS label, 1 - list_cosine_similarity(a.e, b.e) AS dist FROM a JOIN b ON a.label = b.label),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY dist, b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY dist, a_id) AS rb FROM d) WHERE ra = 1 AND rb = 1)
"""


def _mutual(spark, d):
    e = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("emb"))
    return knn.mutual_nearest(e.where("id % 2 = 0"), e.where("id % 2 = 1"))


@query("mutual_nearest", MUTUAL + "SELECT a_id, b_id, round(dist, 6) AS dist FROM m")
def mutual_nearest(spark, d):
    return _mutual(spark, d).withColumn("dist", F.round("dist", 6))


@query("top_fraction", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank, floor(count(*) OVER (PARTITION BY o_custkey) * 0.5) AS k FROM orders) SELECT o_custkey, o_orderkey, rank FROM r WHERE rank <= k AND k >= 5")
def top_fraction(spark, d):
    o = B.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    out = knn.top_fraction(o, ["o_custkey"], ["o_totalprice", "o_orderkey"], fraction=0.5, least=5)
    return out.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


# Scores of an inspection from the distance of its golden and suspect vectors.
SCORES = TIERS + """,
e AS (SELECT v.*, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM vote v JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = query_id + 1),
s AS (SELECT *, 1 - list_cosine_similarity(x, y) AS dist, abs(x[1]) AS shift_pct, abs(y[1]) AS error FROM e),
l AS (SELECT *, least(1.0::DOUBLE, 0.5 * dist) AS loss, shift_pct > 0.2 AS sd, error > 0.2 AS kd FROM s),
p0 AS (SELECT *, loss > 0.45 AS md, least(1.0::DOUBLE, abs(x[2]) + 0.2) AS local, 0.3::DOUBLE AS ctx FROM l),
p AS (SELECT *, greatest(CASE WHEN sd THEN greatest(0.8::DOUBLE, least(1.0::DOUBLE, shift_pct * 10)) ELSE 0 END, CASE WHEN kd THEN 0.85::DOUBLE ELSE 0 END, CASE WHEN md THEN least(1.0::DOUBLE, greatest(0.85::DOUBLE, loss * 1.5)) ELSE 0 END, local * 0.65 + ctx * 0.35) AS physical, sd OR kd OR md AS is_physical FROM p0),
f AS (SELECT *, CASE WHEN NOT has_memory THEN physical WHEN is_physical AND vote_defect < 0.30 AND best_similarity > 0.80 THEN physical * 0.4 + vote_defect * 0.6 WHEN is_physical THEN physical * 0.7 + vote_defect * 0.3 WHEN best_similarity >= 0.9 THEN physical * 0.2 + vote_defect * 0.8 WHEN best_similarity >= 0.75 THEN physical * 0.5 + vote_defect * 0.5 ELSE physical * 0.7 + vote_defect * 0.3 END AS final_score FROM p),
z AS (SELECT *, final_score > 0.45 AS is_defect, greatest(0.5::DOUBLE, least(0.99::DOUBLE, 0.5 + 0.49 * CASE WHEN final_score > 0.45 THEN (final_score - 0.45) / 0.55 ELSE (0.45 - final_score) / 0.45 END)) AS confidence FROM f)
"""


def _scores(spark, d):
    e = B.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    y = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    rows = _vote(spark, d).join(e.join(y, "vec_id").withColumnRenamed("vec_id", "query_id"), "query_id")
    rows = rows.withColumns({"dist": V.cosine_distance(F.col("x"), F.col("y")), "shift_pct": F.abs(F.col("x")[0]), "error": F.abs(F.col("y")[0])})
    rows = rows.withColumn("loss", S.semantic_loss(F.col("dist") / 5)).withColumns({
        "sd": F.col("shift_pct") > 0.2, "kd": F.col("error") > 0.2, "md": F.col("loss") > 0.45, "local": F.least(F.lit(1.0), F.abs(F.col("x")[1]) + 0.2), "ctx": F.lit(0.3),
    })
    p, flag = S.physical_score(*[F.col(c) for c in ("sd", "shift_pct", "kd", "md", "loss", "local", "ctx")])
    rows = rows.withColumns({"physical": p, "is_physical": flag})
    final = S.master_fusion(*[F.col(c) for c in ("physical", "is_physical", "has_memory", "vote_defect", "best_similarity")])
    return rows.withColumn("final_score", final).withColumns({"is_defect": F.col("final_score") > 0.45, "confidence": S.confidence(F.col("final_score"))})


def _rounded(df, *names):
    return df.select("query_id", *[F.round(n, 5).alias(n) if dict(df.dtypes)[n] == "double" else n for n in names])


def _sql(*names, flags=()):
    return SCORES + "SELECT query_id, " + ", ".join([f"round({n}, 5) AS {n}" for n in names] + list(flags)) + " FROM z"


def inspections(spark, d):
    """pairs and info of the query set: an inspection's vector is its suspect, the next one its golden image."""
    im = B.images(spark, d)
    golden = im.where("vec_id % 50 = 1").withColumn("pair_id", F.col("vec_id") - 1).drop("vec_id")
    pairs = pair_align(golden, im.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "pair_id")).withColumnRenamed("pair_id", "insp_id")
    # Every pixel four times wide and high, so that no engine's input is too small; two boxes and a focus in each.
    wide = lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda y: F.flatten(F.transform(F.slice(c, F.floor(y / 4).cast("int") * 8 + 1, 8), lambda v: F.array_repeat(v, 4)))))
    pairs = pairs.select("insp_id", F.lit(32).alias("h"), F.lit(32).alias("w"), wide("gab").alias("gab"), wide("test").alias("test"))
    box = lambda x, y, w, h: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(n) for v, n in zip((x, y, w, h), "xywh")])
    at = F.col("insp_id") % 16
    pairs = pairs.withColumns({"anomalies": F.array(box(at, 4, 12, 12), box(2, at, 14, 16)), "focus": F.array(box(at, at, 14, 14))})
    q = B.queries(spark, d)
    kinds = F.array(*[F.lit(c) for c in ("Missing", "Bridge", "Shifted", "Dust", "other")])
    info = q.select(F.col("query_id").alias("insp_id"), "part", F.get(kinds, (F.col("query_id") / 50 % 5).cast("int")).alias("category"), F.concat(F.lit("R"), F.col("query_id")).alias("value"), "emb")
    return pairs, info


@query("inspect")
def inspect(spark, d):
    """Flagship: engines, vote, fusion and verdict of every inspection."""
    pairs, info = inspections(spark, d)
    out = inspection.inspect(pairs, info, B.memory(spark, d), routing.routes(spark), own=False)
    named = lambda n: [F.col(f"{n}.is_defect").alias(f"{n}_defect"), F.round(f"{n}.score", 5).alias(f"{n}_score")]
    return out.select("insp_id", "is_defect", F.round("final_score", 5).alias("final_score"), F.round("confidence", 5).alias("confidence"), "verdict", F.array_join("active_engines", ",").alias("engines"), *[c for n in ("shift", "silk", "semantic", "ssim") for c in named(n)], "n_neighbors")


@query("fused_verdict", _sql("final_score", "confidence", flags=("is_defect", "CASE WHEN is_defect THEN 'real defect' ELSE 'false alarm' END AS verdict", "n_neighbors")))
def fused_verdict(spark, d):
    """Fusion and verdict of scores that stand for the engines'."""
    rows = _scores(spark, d).withColumn("verdict", S.final_status(F.lit(1), F.col("is_defect"), F.lit(True)))
    return _rounded(rows, "final_score", "confidence", "is_defect", "verdict", "n_neighbors")


@query("physical_score", _sql("physical", flags=("is_physical",)))
def physical_score(spark, d):
    return _rounded(_scores(spark, d), "physical", "is_physical")


@query("master_fusion", _sql("final_score"))
def master_fusion(spark, d):
    return _rounded(_scores(spark, d), "final_score")


@query("confidence", _sql("confidence"))
def confidence(spark, d):
    return _rounded(_scores(spark, d), "confidence")


@query("semantic_loss", "SELECT a.vec_id AS query_id, round(least(1.0::DOUBLE, 2.5 * (1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5) AS loss, 2.5 * (1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) > 0.45 AS is_defect FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def semantic_loss(spark, d):
    e = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("e"))
    y = e.select((F.col("query_id") - 1).alias("query_id"), F.col("e").alias("f"))
    rows = e.join(y, "query_id").withColumn("loss", S.semantic_loss(V.cosine_distance(F.col("e"), F.col("f"))))
    return rows.select("query_id", F.round("loss", 5).alias("loss"), (F.col("loss") > 0.45).alias("is_defect"))


@query("judge_fusion", SCORES + "SELECT query_id, round(CASE WHEN NOT has_memory THEN local * 0.65 + ctx * 0.35 WHEN best_similarity >= 0.9 THEN local * 0.1 + ctx * 0.1 + vote_defect * 0.8 WHEN best_similarity >= 0.75 THEN local * 0.3 + ctx * 0.2 + vote_defect * 0.5 ELSE local * 0.5 + ctx * 0.2 + vote_defect * 0.3 END, 5) AS score FROM z")
def judge_fusion(spark, d):
    rows = _scores(spark, d).withColumn("score", S.judge_fusion(*[F.col(c) for c in ("local", "ctx", "has_memory", "vote_defect", "best_similarity")]))
    return _rounded(rows, "score")


@query("reason_text", SCORES + "SELECT query_id, CASE WHEN sd AND kd THEN 'shift | ink' WHEN sd THEN 'shift' WHEN kd THEN 'ink' ELSE 'no significant anomaly' END || CASE WHEN has_memory THEN ' || memory: ' || floor(round(vote_defect, 6) * 100)::INT || '% NG (sim ' || floor(round(best_similarity, 6) * 100)::INT || '%)' ELSE '' END AS reason FROM z")
def reason_text(spark, d):
    reasons = [F.when(F.col("sd"), "shift"), F.when(F.col("kd"), "ink")]
    text = S.reason_text(reasons, F.col("has_memory"), F.round("vote_defect", 6), F.round("best_similarity", 6))
    return _scores(spark, d).select("query_id", text.alias("reason"))


@query("final_status", SCORES + "SELECT query_id, CASE WHEN query_id % 30 = 0 THEN 'ignored' WHEN NOT is_physical AND NOT is_defect THEN 'none detected' WHEN is_defect THEN 'real defect' ELSE 'false alarm' END AS status FROM z")
def final_status(spark, d):
    status = S.final_status(F.col("is_physical").cast("int"), F.col("is_defect"), F.col("query_id") % 30 != 0)
    return _scores(spark, d).select("query_id", status.alias("status"))


@query("fmt_metrics", SCORES + "SELECT query_id, floor(round(vote_defect, 6) * 100)::INT AS vote_pct, floor(round(confidence, 6) * 100)::INT AS conf_pct, 100 - floor(round(vote_defect, 6) * 100)::INT AS ok_pct FROM z")
def fmt_metrics(spark, d):
    v = T.percent(F.round("vote_defect", 6))
    return _scores(spark, d).select("query_id", v.alias("vote_pct"), T.percent(F.round("confidence", 6)).alias("conf_pct"), (100 - v).alias("ok_pct"))


@query("compat_fields", SCORES + "SELECT query_id, round(coalesce(CASE WHEN query_id % 3 = 0 THEN vote_defect END, CASE WHEN query_id % 3 = 1 THEN best_similarity END, 0.5::DOUBLE), 6) AS score FROM z")
def compat_fields(spark, d):
    score = T.compat(F.when(F.col("query_id") % 3 == 0, F.col("vote_defect")), F.when(F.col("query_id") % 3 == 1, F.col("best_similarity")), 0.5)
    return _scores(spark, d).select("query_id", F.round(score, 6).alias("score"))


@query("gauge", SCORES + "SELECT query_id, round(least(shift_pct / 0.15, 1.0::DOUBLE), 5) AS shift_gauge, round(least(error / 0.5, 1.0::DOUBLE), 5) AS area_gauge FROM z")
def gauge(spark, d):
    return _rounded(_scores(spark, d).select("query_id", *T.gauge(F.col("shift_pct"), F.col("error"))), "shift_gauge", "area_gauge")


@query("shift_score", SCORES + "SELECT query_id, CASE WHEN error > 0.15 THEN 'structure' WHEN shift_pct > 0.08 THEN 'displacement' WHEN dist > 0.08 THEN 'focus displacement' ELSE '' END AS reason, round(CASE WHEN error > 0.15 THEN error WHEN shift_pct > 0.08 THEN shift_pct ELSE dist END, 5) AS score FROM z")
def shift_score(spark, d):
    s = S.shift_score(F.col("error"), F.col("shift_pct"), F.col("dist"), F.lit(0.08))
    return _scores(spark, d).select("query_id", s.alias("s")).select("query_id", "s.reason", F.round("s.score", 5).alias("score"))


@query("ink_score", SCORES + "SELECT query_id, error > 0.05 AND query_id % 40 > 10 AS is_defect, CASE WHEN error > 0.15 AND query_id % 40 > 10 THEN 'ink missing or reversed' WHEN error > 0.05 AND query_id % 40 > 10 THEN 'ink differs' ELSE '' END AS reason FROM z")
def ink_score(spark, d):
    s = S.ink_score(F.col("error"), F.lit(0.05), F.col("query_id") % 40)
    return _scores(spark, d).select("query_id", s.alias("s")).select("query_id", "s.is_defect", "s.reason")


@query("displacement_kind", SCORES + "SELECT query_id, CASE WHEN is_defect AND query_id % 20 = 0 AND error > 0.15 THEN 'structural' ELSE 'displacement' END AS kind FROM z")
def displacement_kind(spark, d):
    return _scores(spark, d).select("query_id", S.displacement_kind(F.col("is_defect"), F.col("query_id") % 20, F.lit(0), F.col("error")).alias("kind"))


@query("ctx_score", SCORES + "SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 0.3::DOUBLE ELSE round(least(1.0::DOUBLE, CASE WHEN sd THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN kd THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END), 5) END AS ctx FROM z")
def ctx_score(spark, d):
    c = S.ctx_score(F.when(F.col("query_id") % 3 != 0, F.col("sd")), F.col("kd"))
    return _scores(spark, d).select("query_id", F.round(c, 5).alias("ctx"))


@query("detail_merge", SCORES + "SELECT query_id, round(coalesce(CASE WHEN md THEN loss END, CASE WHEN kd THEN error END, shift_pct), 5) AS pct FROM z")
def detail_merge(spark, d):
    pct = S.detail_merge(F.col("shift_pct"), F.when(F.col("kd"), F.col("error")), F.when(F.col("md"), F.col("loss")))
    return _scores(spark, d).select("query_id", F.round(pct, 5).alias("pct"))
