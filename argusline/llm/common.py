"""Durable intermediate tables and small helpers shared by the operators.

Iterative operators cut their lineage by writing Parquet below the folder that
the cluster names in ``spark.checkpoint.dir``.  That folder is shared, so a
lost executor costs a re-run of its tasks only, never lost data.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words, wherever words are counted here.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    A temporary one is made only in a local session that names none; on a
    cluster the executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="argusline-checkpoint-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


#: Rows that Spark hands to a Python worker at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that Spark reads from a Parquet file at once; arrays of all of them are held together.
READ = "spark.sql.parquet.columnarReaderBatchSize"


class Stages:
    """Intermediate tables of one operator run, written once and read back.

    ``write`` materialises a DataFrame and returns it with its lineage cut;
    ``drop`` deletes tables that no later step reads.  What a returned, still
    lazy result reads stays until the folder is cleared with the cluster's
    checkpoint folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # the frame is held, so its id stays its own

    def write(self, df: DataFrame, label: str = "t", batch: int | None = None, read: int | None = None, **options: str) -> DataFrame:
        """``df`` written and read back; ``batch``: rows handed to Python at once meanwhile, ``read``: and read."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{label}"
        meanwhile = {k: n for k, n in ((BATCH, batch), (READ, read)) if n}
        usual = {k: self.spark.conf.get(k) for k in meanwhile}
        try:
            for k, n in meanwhile.items():
                self.spark.conf.set(k, str(n))
            df.write.options(**{"compression": "zstd"} | options).parquet(path)
        finally:
            for k, n in usual.items():
                self.spark.conf.set(k, n)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)

    def release(self) -> None:
        """Let the context cleaner drop shuffle files of finished jobs now.

        The cleaner acts on driver garbage collection only; a long loop would
        otherwise keep every round's shuffle files until its end (a cluster may
        set ``spark.cleaner.periodicGC.interval`` instead).
        """
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], base: str) -> str:
    """A column name that none of ``columns`` has (compared without case)."""
    taken, name = {c.lower() for c in columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of ASCII-space separated words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
