"""Linear head on frozen embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusline.functions.fixed import STRICT
from argusline.functions.vectors import cosine_distance, norm
from argusline.operators.knn import CELLS, knn_vote, nearest, written_keys
from argusline.operators.pivots import usable


def train_head(memory: DataFrame, emb: str = "sig", label: str = "label", max_iter: int = 20) -> LogisticRegressionModel:
    """Logistic regression on embeddings; ``label`` is 0 or 1."""
    rows = memory.select(array_to_vector(F.col(emb).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=max_iter).fit(rows)


def train_report(model: LogisticRegressionModel) -> dict[str, list[float] | float]:
    s = model.summary
    return {"loss": list(s.objectiveHistory), "accuracy": s.accuracy}


def score_head(model: LogisticRegressionModel, df: DataFrame, emb: str = "emb") -> DataFrame:
    rows = model.transform(df.withColumn("features", array_to_vector(F.col(emb).cast("array<double>"))))
    return rows.withColumn("p_defect", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def save_model(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def coded(queries: DataFrame, memory: DataFrame, bucket: float = 0.5, tables: int = 8, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """Both with ``codes``: the bucket of the unit vector in each random projection; unusable vectors go."""

    def unit(df: DataFrame, vector: str) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        return df.where(usable(v)).withColumn("n", norm(v)).withColumn("unit", array_to_vector(F.transform(v, lambda x: x / F.col("n"))))

    q, m = unit(queries, "emb"), unit(memory, "sig")
    lsh = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(m)
    codes = F.array(*[vector_to_array(F.col("hashes")[t])[0].cast("int") for t in range(tables)])
    return tuple(lsh.transform(df).withColumn("codes", codes).drop("n", "unit", "hashes") for df in (q, m))


def lsh_pairs(queries: DataFrame, memory: DataFrame, **lsh) -> DataFrame:
    """query_id, sample_id, dist of the pairs that share a bucket of a random projection.

    Projections of unit vectors; ``dist`` is the cosine distance.  No pair is
    left out for its distance, so there may be as many as queries times rows;
    they are found block by block and not shuffled.
    """
    q, m = coded(queries, memory, **lsh)
    asked = q.select("query_id", F.col("emb").cast("array<double>").alias("emb"), "codes", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell"))
    held = m.select("sample_id", F.col("sig").cast("array<double>").alias("sig"), F.col("codes").alias("held"), F.pmod(F.xxhash64("sample_id"), F.lit(CELLS)).cast("int").alias("cell"))
    near = asked.join(held, "cell").where(F.exists(F.zip_with("codes", "held", lambda a, b: a == b), lambda same: same))
    return near.select("query_id", "sample_id", cosine_distance(F.col("emb"), F.col("sig")).alias("dist"))


def knn_vote_lsh(queries: DataFrame, memory: DataFrame, k: int = 5, strict: Sequence[str] = STRICT, own: bool = True, **lsh) -> DataFrame:
    """``knn_vote`` over neighbours that random projections find: the same contract and tiers.

    Blocks of queries meet blocks of memory rows of their tier; a row counts
    if it shares a bucket with the query, and a block gives out the ``k``
    nearest of these, so that no pairs are shuffled.
    """
    q, m = coded(queries, memory, **lsh)
    near = nearest(q, m, k, strict, own, written_keys(queries, memory, strict))
    return knn_vote(queries, memory, k, strict, own, near)
