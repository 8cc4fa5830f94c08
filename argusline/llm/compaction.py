"""Size-tiered compaction of immutable shards under a versioned manifest.

A table is a folder with Parquet shards that never change and manifests
``_manifest/v<number>.json`` that list them.  An arrival adds small shards and
commits the next manifest; compaction merges shards of a similar size (a tier:
sizes within a factor ``fan_in``) into files of up to ``target`` bytes and
commits a manifest with the merged files in place of their inputs.  A manifest
is written aside and renamed to its number, which fails if the number exists,
so readers see one version or the next, and of two writers one must retry.
(The rename is atomic on HDFS and local file systems.  On an object store
without it the folder needs a committer with conditional writes.)  A manifest
also holds the schema, which arrivals may widen: columns are matched by name
and null where a shard lacks them, and a merge writes all of them.

Files of older versions stay, so that a reader of a version can finish, until
``vacuum`` removes those that none of the last ``keep`` manifests lists.

Merging shuffles nothing: Spark's file scan packs small files into partitions
of up to the target size, and every partition writes one file.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Collection
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Shard:
    """A file of the table, relative to its folder."""

    path: str
    size: int
    rows: int


class Conflict(RuntimeError):
    """Another writer has committed the version meanwhile."""


class ShardTable:
    """Shards and manifests below ``root`` (any file system Spark can reach).

    ``keep``: manifests whose files compaction leaves in place.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, fan_in: int = 4, least: int = 1 << 20, keep: int = 8):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fan_in, self.least, self.keep = target, fan_in, least, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests -------------------------------------------------------------
    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], T.StructType | None]:
        """(version, shards, schema) of a manifest, the latest if none is named."""
        known = self.versions()
        if not known:
            return 0, [], None
        version = known[-1] if version is None else version
        stream = self._fs.open(self._path(f"{self.root}/_manifest/v{version:08d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()
        told = json.loads(text)
        return version, [Shard(**s) for s in told["shards"]], T.StructType.fromJson(told["schema"])

    def shards(self, version: int | None = None) -> tuple[int, list[Shard]]:
        return self.manifest(version)[:2]

    def commit(self, base: int, shards: list[Shard], schema: T.StructType) -> int:
        """Makes ``shards`` the version after ``base``, or raises ``Conflict``."""
        aside = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        goal = self._path(f"{self.root}/_manifest/v{base + 1:08d}.json")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps({"version": base + 1, "schema": json.loads(schema.json()), "shards": [asdict(s) for s in shards]}).encode("utf-8")))
        finally:
            stream.close()
        if self._fs.exists(goal) or not self._fs.rename(aside, goal):
            self._fs.delete(aside, False)
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    # -- data --------------------------------------------------------------------
    def _written(self, folder: str, parts: DataFrame) -> list[Shard]:
        """Shards of a folder that a job wrote, with their row counts."""
        found = self._fs.listStatus(self._path(f"{self.root}/{folder}"))
        sizes = {s.getPath().getName(): s.getLen() for s in found if s.getPath().getName().startswith("part-")}
        counts = {r.name: r.n for r in parts.groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name")).agg(F.count("*").alias("n")).collect()}
        return [Shard(f"{folder}/{name}", size, counts[name]) for name, size in sorted(sizes.items()) if counts.get(name)]

    def _write(self, df: DataFrame, kind: str) -> list[Shard]:
        folder = f"{kind}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._written(folder, self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}"))

    def _discard(self, shards: list[Shard]) -> None:
        """Removes the folders of shards that no manifest lists."""
        for folder in {s.path.rsplit("/", 1)[0] for s in shards}:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    @classmethod
    def nullable(cls, kind: T.DataType) -> T.DataType:
        """The type with nulls allowed at every depth: tables take them everywhere."""
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, cls.nullable(f.dataType), True) for f in kind])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(cls.nullable(kind.elementType), True)
        if isinstance(kind, T.MapType):
            return T.MapType(cls.nullable(kind.keyType), cls.nullable(kind.valueType), True)
        return kind

    @classmethod
    def widened(cls, known: T.StructType | None, new: T.StructType) -> T.StructType:
        """Both schemas' columns by name (without case); a clash of types is an error.

        Types that differ only in where nulls may be are one.
        """
        fields = {f.name.lower(): T.StructField(f.name, cls.nullable(f.dataType), True) for f in known or ()}
        for f in new:
            kind = cls.nullable(f.dataType)
            old = fields.setdefault(f.name.lower(), T.StructField(f.name, kind, True))
            if old.dataType != kind:
                raise ValueError(f"column {f.name} is {f.dataType.simpleString()} here and {old.dataType.simpleString()} in the table")
        return T.StructType(list(fields.values()))

    def append(self, arrival: DataFrame, attempts: int = 5) -> int:
        """Adds an arrival as shards of its own; returns the new version."""
        self.widened(self.manifest()[2], arrival.schema)  # refused before anything is written
        new = self._write(arrival, "arrival")
        for _ in range(attempts):
            base, old, schema = self.manifest()
            try:
                return self.commit(base, old + new, self.widened(schema, arrival.schema))
            except Conflict:
                continue
            except ValueError:
                self._discard(new)
                raise
        self._discard(new)
        raise Conflict("too many writers")

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.least, self.fan_in))) if size > self.least else 0

    def due(self, shards: list[Shard], settled: Collection[int] = ()) -> list[Shard]:
        """Shards of the lowest tier, but for settled ones, that has ``fan_in`` below the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target // 2:
                tiers.setdefault(self.tier(s.size), []).append(s)
        ready = [t for t, own in tiers.items() if len(own) >= self.fan_in and t not in settled]
        return tiers[min(ready)] if ready else []

    def merge(self, shards: list[Shard], schema: T.StructType) -> list[Shard]:
        """The rows of ``shards`` in files of up to the target size."""
        session = self.spark.newSession()  # these settings are for this scan only
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        return self._write(session.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards]), "merged")

    def compact(self, rounds: int = 16) -> int:
        """Merges due tiers until none is left; returns the latest version.

        A tier whose merge makes no fewer files is settled, and higher ones go on.
        """
        settled: set[int] = set()
        for _ in range(rounds):
            base, old, schema = self.manifest()
            ripe = self.due(old, settled)
            if not ripe:
                break
            gone = set(ripe)
            new = self.merge(ripe, schema)
            if len(new) >= len(ripe):
                self._discard(new)
                settled.add(self.tier(ripe[0].size))  # the files are as large as the scan lets them be
                continue
            try:
                self.commit(base, [s for s in old if s not in gone] + new, schema)
            except Conflict:
                self._discard(new)
        self.vacuum()
        return self.shards()[0]

    def vacuum(self, keep: int | None = None) -> None:
        """Removes files and manifests that none of the last ``keep`` versions needs."""
        keep, known = max(1, self.keep if keep is None else keep), self.versions()
        listed = {s.path for v in known[-keep:] for s in self.shards(v)[1]}
        for v in known[:-keep]:
            for s in self.shards(v)[1]:
                if s.path not in listed:
                    self._fs.delete(self._path(f"{self.root}/{s.path}"), False)
            self._fs.delete(self._path(f"{self.root}/_manifest/v{v:08d}.json"), False)

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """The rows of a version (the schema says what an empty table holds)."""
        _, shards, known = self.manifest(version)
        schema = schema or known
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards])


def ingest(rows: DataFrame, root: str, arrivals: int = 4, key: str | None = None, **options) -> ShardTable:
    """Appends ``rows`` in ``arrivals`` batches, by a hash of ``key``, and compacts.

    Any columns and values go, nulls and empty tables too; repeated rows stay
    repeated.
    """
    out = ShardTable(rows.sparkSession, root, **options)
    draw = F.pmod(F.xxhash64(*([key] if key else rows.columns)), F.lit(arrivals))
    for i in range(arrivals):
        out.append(rows.where(draw == i))
    out.compact()
    return out
