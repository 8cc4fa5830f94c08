"""Labelled memory and images on a file system."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusline.functions.text import clean_key, sanitize_category, stamp
from argusline.operators.components import durable

#: Bytes of files in a partition of a held memory part.
PART_BYTES = 64 << 20

#: Records written beside every kept image.
SIDECAR = (
    "label string, timestamp string, image_file string, image_type string, "
    "aoi_info struct<board:string,parts:string,category:string,value:string>, "
    "analysis struct<verdict:string,is_defect:boolean,confidence:string,reason:string,ssim:double,pct_changed:double,edge_change:double,"
    "hist_corr:double,local_score:double,ctx_score:double,db_score:double,final_score:double,embedding:array<float>>, _corrupt_record string"
)


def scan_memory(spark: SparkSession, ok_root: str, ng_root: str, multi_line: bool = True) -> DataFrame:
    """Memory rows of the JSON records below two roots.

    The root gives the label; records that cannot be read or hold no embedding
    are skipped; the image path is taken beside the record.
    """

    def root(path: str, label: str) -> DataFrame:
        raw = spark.read.schema(SIDECAR).option("multiLine", multi_line).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
        rows = raw.where(F.col("_corrupt_record").isNull() & (F.size("analysis.embedding") > 0))
        folder = F.regexp_replace(F.col("_metadata.file_path"), "[^/]*$", "")
        return rows.select(
            F.lit(label).alias("label"),
            clean_key(F.col("aoi_info.parts")).alias("part_key"),
            F.coalesce(F.nullif(clean_key(F.col("aoi_info.category")), F.lit("")), F.lit("UNKNOWN")).alias("category_key"),
            F.col("analysis.embedding").alias("sig"),
            F.when(F.coalesce("image_file", F.lit("")) != "", F.concat(folder, "image_file")).alias("path"),
            F.try_to_timestamp("timestamp").alias("ts"),
        )

    return root(ok_root, "OK").unionByName(root(ng_root, "NG"))


def label_from_path(df: DataFrame, path_col: str) -> DataFrame:
    """Class of the first folder of a path, numbered in alphabetical order.

    Distinct labels are dealt by ranges and numbered within each; the only
    rows that one task sees together are the counts of the ranges.
    """
    label = F.regexp_extract(path_col, "^/*([^/?#]+)", 1)
    rows = df.withColumn("label", label)
    # Written, so that every label keeps the range that it was dealt to.
    ranged = durable(rows.select("label").distinct().repartitionByRange("label").withColumn("range", F.spark_partition_id()))
    each = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = each.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("range").orderBy("label")) - 1
    classes = ranged.withColumn("place", place).join(before, "range").select("label", (F.col("before") + F.col("place")).cast("int").alias("class"))
    return rows.join(classes, "label")


def scan_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def samples(df: DataFrame, save_images: bool = True) -> DataFrame:
    """Decisions as they are written; see ``write_samples``."""
    label = F.when(F.col("label") == "NG", "NG").otherwise("OK")
    name = F.concat(stamp(label, F.col("ts")), F.lit(".png"))
    out = df.withColumns({"label": label, "category": sanitize_category(F.col("category"))})
    out = out.withColumn("image_file", name if save_images else F.lit(""))
    if "image" in df.columns and not save_images:
        out = out.withColumn("image", F.lit(None).cast("binary"))
    return out


def write_samples(df: DataFrame, path: str, save_images: bool = True) -> None:
    """Appends decisions by label and category.

    ``df`` has label, category, ts, embedding and, if wanted, part and image.
    Labels other than NG count as OK.  Without images the payload and name are
    blank.  ``as_memory`` reads them as rows to vote with.
    """
    samples(df, save_images).write.mode("append").partitionBy("label", "category").parquet(path)


def _files(spark: SparkSession, path: str):
    """(file system, Path of a string) where ``path`` lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _listed(fs, folder) -> list[tuple[str, int]]:
    """Parquet files below a folder with their sizes; hidden ones (``_``, ``.``) are left out."""
    if not fs.exists(folder):
        return []
    root, out, found = fs.makeQualified(folder).toString(), [], fs.listFiles(folder, True)
    while found.hasNext():
        s = found.next()
        name = s.getPath().toString()
        inner = name[len(root) :].strip("/").split("/")
        if name.endswith(".parquet") and not any(x[0] in "_." for x in inner):
            out.append((name, s.getLen()))
    return sorted(out)


def append_once(df: DataFrame, path: str, writer: str, batch: int, save_images: bool = False) -> bool:
    """``write_samples`` that adds a batch of a writer once, however often it is run.

    The batch is written aside, then committed by a log entry (one rename) that
    names its files, then moved in.  Without an entry the batch counts for
    nothing and is written anew; with one, only the moves that are left are
    made.  So a reader never meets a row twice, though it may meet a batch
    half moved.  False if the entry was there.  A writer's batches come one
    after the other; an object store without an atomic rename weakens this.
    """
    spark = df.sparkSession
    fs, at = _files(spark, path)
    safe = re.sub(r"[^A-Za-z0-9-]", lambda m: f"_{ord(m[0]):x}_", writer)
    entry = at(f"{path}/_commits/{safe}/{batch:020d}")
    aside = f"{path}/_arriving/{safe}/{batch:020d}"
    known = fs.exists(entry)
    if not known:
        fs.delete(at(aside), True)
        samples(df, save_images).write.partitionBy("label", "category").parquet(aside)
        root = fs.makeQualified(at(aside)).toString()
        moves = [name[len(root) + 1 :] for name, _ in _listed(fs, at(aside))]
        draft = at(f"{path}/_commits/{safe}/.{batch:020d}-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray("\n".join(moves).encode("utf-8")))
        finally:
            out.close()
        if not fs.rename(draft, entry):
            raise RuntimeError(f"batch {batch} of {writer} is being committed by another run")
    stream = fs.open(entry)
    try:
        moves = [m for m in bytes(stream.readAllBytes()).decode("utf-8").split("\n") if m]
    finally:
        stream.close()
    for name in moves:
        source, goal = at(f"{aside}/{name}"), at(f"{path}/{name.rsplit('/', 1)[0]}/{safe}-{batch:020d}-{name.rsplit('/', 1)[1]}")
        if fs.exists(source):
            fs.mkdirs(goal.getParent())
            if not fs.rename(source, goal):
                raise RuntimeError(f"{source.toString()} cannot be moved in")
    fs.delete(at(aside), True)
    return not known


def as_memory(samples: DataFrame) -> DataFrame:
    """Memory rows (sample_id, label, part_key, category_key, sig, path) of written decisions."""
    part = F.col("part") if "part" in samples.columns else F.lit("")
    key = clean_key(F.col("category").cast("string"))
    return samples.select(
        F.xxhash64("ts", "label", F.col("category").cast("string"), "embedding").alias("sample_id"), "label", F.coalesce(clean_key(part), F.lit("")).alias("part_key"),
        F.coalesce(F.nullif(key, F.lit("")), F.lit("UNKNOWN")).alias("category_key"), F.col("embedding").alias("sig"), F.nullif("image_file", F.lit("")).alias("path"),
    )


#: What an empty memory holds.
NO_SAMPLES = "label string, category string, ts timestamp, embedding array<float>, image_file string"


def memory_now(spark: SparkSession, path: str) -> DataFrame:
    """The memory below ``path`` as it is now; empty before the first decision."""
    fs, at = _files(spark, path)
    if not _listed(fs, at(path)):
        return as_memory(spark.createDataFrame([], NO_SAMPLES))
    return as_memory(spark.read.parquet(path))


class GrowingMemory:
    """The memory below a path, of which a refresh reads only the files added since the last.

    The rows of each refresh are held by the executors (memory, then disk); what
    a lost executor held is read again from its files.  Parts double: each one
    is as large as all the smaller ones together, so that a vote's plan unites
    few of them and a row is taken over into a larger part a few times only.
    ``reads`` lists the files of each refresh.  Files are never changed by this
    library; one that is gone is forgotten by a new object only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.seen: set[str] = set()
        self.parts: list[tuple[int, DataFrame]] = []  # bytes of the files, rows
        self.reads: list[list[str]] = []

    def refresh(self) -> DataFrame:
        """Memory rows as of now."""
        fs, at = _files(self.spark, self.path)
        new = [(name, size) for name, size in _listed(fs, at(self.path)) if name not in self.seen]
        self.reads.append([name for name, _ in new])
        if new:
            self.seen.update(self.reads[-1])
            rows = as_memory(self.spark.read.option("basePath", self.path).parquet(*self.reads[-1])).persist(StorageLevel.MEMORY_AND_DISK)
            self.parts.append((sum(size for _, size in new), rows))
            while len(self.parts) > 1 and self.parts[-2][0] <= 2 * self.parts[-1][0]:
                (m, old), (n, late) = self.parts[-2:]
                both = old.unionByName(late).coalesce(max(1, (m + n) // PART_BYTES + 1)).persist(StorageLevel.MEMORY_AND_DISK)
                both.count()  # filled from what is held before that is given up
                old.unpersist()
                late.unpersist()
                self.parts[-2:] = [(m + n, both)]
        if not self.parts:
            return as_memory(self.spark.createDataFrame([], NO_SAMPLES))
        return reduce(DataFrame.unionByName, [rows for _, rows in self.parts])

    def close(self) -> None:
        for _, rows in self.parts:
            rows.unpersist()
        self.seen, self.parts = set(), []


def with_fresh_memory(spark: SparkSession, path: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn`` of the memory as it is now: files are listed anew at every call."""
    return fn(spark.read.parquet(path))
