"""Sources, sinks and trained heads over the standard tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from argusline.operators import ml
from argusline.operators.components import shared_dir
from argusline.plans import bindings as B
from argusline.sources import files

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _decided(spark, d):
    e = B.table(spark, d, "embeddings")
    return e.selectExpr("vec_id", "CASE WHEN vec_id % 3 = 0 THEN 'NG' ELSE 'OK' END AS label", "concat('C', label, '/') AS category", "timestamp_seconds(1700000000 + vec_id) AS ts", "embedding")


@query("write_samples", "SELECT CASE WHEN vec_id % 3 = 0 THEN 'NG' ELSE 'OK' END AS label, 'C' || label AS category, count(*) AS n, sum(vec_id)::BIGINT AS s FROM embeddings GROUP BY 1, 2")
def write_samples(spark, d):
    path = f"{shared_dir(spark)}/samples-{uuid.uuid4().hex[:12]}"
    files.write_samples(_decided(spark, d), path, save_images=False)
    back = spark.read.parquet(path)
    return back.groupBy("label", "category").agg(F.count("*").alias("n"), F.sum("vec_id").alias("s"))


@query("scan_memory", "SELECT CASE WHEN label < 5 THEN 'OK' ELSE 'NG' END AS label, 'C' || label AS category_key, count(*) AS n, round(sum(embedding[1]::DOUBLE), 3) AS s FROM embeddings WHERE vec_id % 4 <> 0 GROUP BY 1, 2")
def scan_memory(spark, d):
    root = f"{shared_dir(spark)}/sidecars-{uuid.uuid4().hex[:12]}"
    rows = B.table(spark, d, "embeddings").selectExpr(
        "label", "CAST(timestamp_seconds(1700000000 + vec_id) AS STRING) AS timestamp", "concat(vec_id, '.png') AS image_file",
        "named_struct('board', 'b', 'parts', concat('r-', vec_id), 'category', concat('c', label), 'value', '') AS aoi_info",
        "named_struct('embedding', CASE WHEN vec_id % 4 = 0 THEN array() ELSE embedding END) AS analysis",
    )
    for name, kept in (("ok", "label < 5"), ("ng", "label >= 5")):
        rows.where(kept).drop("label").write.json(f"{root}/{name}")
    # One record a line here, where the machine writes one a file.
    memory = files.scan_memory(spark, f"{root}/ok", f"{root}/ng", multi_line=False)
    return memory.groupBy("label", "category_key").agg(F.count("*").alias("n"), F.round(F.sum(F.col("sig")[0].cast("double")), 3).alias("s"))


@query("train_head")
def train_head(spark, d):
    """Scores of a linear head trained on all vectors."""
    e = B.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("emb"), (F.col("label") % 2).alias("y"))
    return ml.score_head(ml.train_head(e, "emb", "y"), e).select("vec_id", "prediction", F.round("p_defect", 4).alias("p_defect"))


@query("knn_lsh")
def knn_lsh(spark, d):
    """Votes over neighbours that random projections find."""
    votes = ml.knn_vote_lsh(B.queries(spark, d), B.memory(spark, d), own=False)
    return votes.withColumns({"vote_defect": F.round("vote_defect", 6), "best_similarity": F.round("best_similarity", 6)})
