"""A training-data pipeline over ``documents``: five stages, in this order.

``quality_classifier`` drops documents that the weak-label scorer rejects,
``near_duplicates`` keeps the document with the smallest id of each group of
texts whose five-word shingles agree to 0.8 or more, ``secret_scan`` replaces
secrets in the texts, ``mix_sources`` repeats and cuts documents to the target
weights, and ``pack_sequences`` gives the pieces of packed token sequences.

Every stage takes nulls in any column, empty and very long texts, repeated rows,
an empty table and columns of any further names, and says below what it makes
of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusline.llm import mixing, packing, parity_join, quality, secrets
from argusline.llm.common import BATCH, Stages, fresh, table

#: Rows that a Python worker is handed at once: texts may be long, and workers share
#: the executor's memory with the JVM.
ROWS = 1000
#: Words whose ids a worker remembers: it keeps them while it works for later stages.
WORDS = 50_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _short_batches(spark: SparkSession) -> None:
    """The session's setting for what the stages return, which is computed when it is written."""
    spark.conf.set(BATCH, str(ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the scorer takes for good.

    Texts without words (null, empty) score 0 and go; repeated rows are judged
    alike; a column of the name ``quality`` is the user's and stays.
    """
    _short_batches(spark)
    score = fresh(docs.columns, "quality")
    return quality.classify(docs, out_col=score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: of the smallest id, one if several rows have it.

    Rows that share an id are one node, so one of them stays.  Rows without an
    id cannot be told apart and stay; texts without words link with nothing.
    """
    _short_batches(spark)
    groups = parity_join.near_duplicates(docs, width=5, num=80, den=100)
    told = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count("*").alias("n"))
    told = Stages(spark, "near-duplicates").write(told.where("first <> doc_id OR n > 1"), "told")
    kept = docs.join(told.where("first <> doc_id"), "doc_id", "left_anti")
    several = told.where("first = doc_id").select("doc_id")
    once = kept.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with secrets in its text replaced; null texts stay null."""
    return secrets.train_scanner(docs).redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole or partial use of a document in the mix.

    Texts without words have nothing to take and go; null is a source of its
    own; columns named like those of the mix are the user's and stay.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows; null and empty texts have the end id only."""
    _short_batches(spark)
    return packing.pack(docs, remember=WORDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Training, graph components and bin packing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    tables = Stages(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = tables.write(stage(spark, docs, sf_dir), name)
        tables.drop(docs)
        docs = out
    return docs
