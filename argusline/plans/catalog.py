"""Registered queries of the inspection operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from argusline.plans import box_queries, image_queries, io_queries, knn_queries, text_queries

_PARTS = (knn_queries, text_queries, box_queries, image_queries, io_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
