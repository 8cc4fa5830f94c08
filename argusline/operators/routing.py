"""Routes of engines and their registry."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusline.functions.fixed import DEFAULT_ROUTE, ROUTES

#: An engine gives insp_id, engine, is_defect, score, reason, box and m.
Engine = Callable[[DataFrame], DataFrame]
ENGINE_COLUMNS = ("insp_id", "engine", "is_defect", "score", "reason", "box", "m")


def routes(spark: SparkSession, table: Mapping[str, Sequence[str]] = ROUTES) -> DataFrame:
    return spark.createDataFrame([(k, list(v)) for k, v in table.items()], "category string, engines array<string>")


def route_engines(insp: DataFrame, table: DataFrame, default: Sequence[str] = DEFAULT_ROUTE) -> DataFrame:
    """``insp`` with its category's engines; others take the default route."""
    return insp.join(table, "category", "left").withColumn("engines", F.coalesce("engines", F.array(*[F.lit(e) for e in default])))


class Registry:
    """Named engines; ``run`` lets each see only the inspections routed to it."""

    def __init__(self):
        self.engines: dict[str, Engine] = {}

    def add(self, name: str, engine: Engine) -> None:
        self.engines[name] = engine

    def run(self, routed: DataFrame) -> DataFrame:
        out = None
        for name, engine in self.engines.items():
            own = engine(routed.where(F.array_contains("engines", name)).drop("engines"))
            own = own.withColumn("engine", F.lit(name)).select(*ENGINE_COLUMNS)
            out = own if out is None else out.unionByName(own)
        return out
