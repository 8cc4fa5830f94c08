"""The engine's tables as views of the standard tables, in Spark and in SQL.

``CTE`` has the same definitions as DuckDB common table expressions, so that
an oracle starts from the rows that the query starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts and categories of queries: of five in a row two ask for what there is, one for
#: another category, one for another part, and one for a strict category.
PART = "concat(CASE vec_id % 250 WHEN 150 THEN 's-' ELSE 'r-' END, vec_id % 7)"
CATEGORY = "CASE vec_id % 250 WHEN 100 THEN 'other' WHEN 200 THEN 'SHIFTED' ELSE concat('C', label) END"


def queries(spark: SparkSession, d: str) -> DataFrame:
    """The query set of searches: ids divisible by 50."""
    e = table(spark, d, "embeddings").where("vec_id % 50 = 0")
    return e.selectExpr("vec_id AS query_id", f"{PART} AS part", f"{CATEGORY} AS category", "embedding AS emb")


def memory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr(
        "vec_id AS sample_id", "CASE WHEN label = 7 THEN 'NG' WHEN label = 8 THEN 'OK' WHEN vec_id % 3 = 0 THEN 'NG' ELSE 'OK' END AS label",
        "concat('R', vec_id % 7, 'X') AS part_key", "concat('C', label) AS category_key", "embedding AS sig", "concat('m/', vec_id, '.png') AS path",
    )


def images(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as an 8 x 8 gray image: pair_id, h, w, px."""
    px = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round((v + 1) * 127.5))))
    return table(spark, d, "embeddings").select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), px.alias("px"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Golden vec_id 2n, suspect 2n + 1."""
    from argusline.operators.images import pair_align

    im = images(spark, d).withColumn("pair_id", F.floor(F.col("vec_id") / 2))
    return pair_align(im.where("vec_id % 2 = 0").drop("vec_id"), im.where("vec_id % 2 = 1").drop("vec_id"))


def boxes(spark: SparkSession, d: str, dense: bool = False) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS image_id",
        "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord",
        *(
            ["CAST(l_partkey % 60 AS INT) AS x", "CAST(l_suppkey % 40 AS INT) AS y", "CAST(12 + l_quantity * 2 AS INT) AS w", "CAST(12 + (l_partkey % 37) * 2 AS INT) AS h"]
            if dense
            else ["CAST(l_partkey % 600 AS INT) AS x", "CAST(l_suppkey % 400 AS INT) AS y", "CAST(5 + l_quantity * 4 AS INT) AS w", "CAST(5 + (l_partkey % 37) * 5 AS INT) AS h"]
        ),
    )
    return rows


def rgb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_partkey % 256 AS INT) AS r", "CAST(l_suppkey * 7 % 256 AS INT) AS g", "CAST(CAST(l_quantity * 5 AS BIGINT) % 256 AS INT) AS b")


def series(spark: SparkSession, d: str, tail: bool = False) -> DataFrame:
    rows = table(spark, d, "events").selectExpr(
        "user_id AS series_id", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS i",
        "count(*) OVER (PARTITION BY user_id) AS n", "event_type IN ('view', 'click') AS seen",
    )
    return rows.selectExpr("series_id", "i", "(seen OR i * 10 >= 6 * n) AS flag" if tail else "seen AS flag")


def messages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr(
        "event_id AS msg_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id AS key",
        "CASE event_type WHEN 'view' THEN CAST(event_id AS STRING) WHEN 'purchase' THEN 'CMD_OK' WHEN 'error' THEN 'CMD_NG' ELSE ' ' END AS header",
    )
    from argusline.functions.text import route_message

    return rows.withColumn("m", route_message(F.col("header"))).select("msg_id", "ts", "key", "header", "m.kind", "m.command", "m.size")


def panel_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey AS insp_id", "concat('Board: ', p_brand, chr(10), 'Parts: ', p_name, ' Value: ', p_type) AS raw_text", "p_name", "p_type", "p_size", "p_brand", "p_retailprice")


CTE = {
    "queries": f"queries AS (SELECT vec_id AS query_id, {PART} AS part, {CATEGORY} AS category, embedding::DOUBLE[] AS emb FROM embeddings WHERE vec_id % 50 = 0)",
    "memory": "memory AS (SELECT vec_id AS sample_id, CASE WHEN label = 7 THEN 'NG' WHEN label = 8 THEN 'OK' WHEN vec_id % 3 = 0 THEN 'NG' ELSE 'OK' END AS label, 'R' || (vec_id % 7) || 'X' AS part_key, 'C' || label AS category_key, embedding::DOUBLE[] AS sig, 'm/' || vec_id || '.png' AS path FROM embeddings)",
    "px": "px AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, least(255.0, greatest(0.0, round((embedding[i]::DOUBLE + 1) * 127.5))) AS v FROM embeddings, range(1, 65) t(i))",
    "pp": "pp AS (SELECT a.vec_id // 2 AS pair_id, a.y, a.x, a.v AS g, b.v AS t FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND a.y = b.y AND a.x = b.x WHERE a.vec_id % 2 = 0)",
    "boxes": "boxes AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, (l_partkey % 600)::INT AS x, (l_suppkey % 400)::INT AS y, (5 + l_quantity * 4)::INT AS w, (5 + (l_partkey % 37) * 5)::INT AS h FROM lineitem)",
    "dense": "dense AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, (l_partkey % 60)::INT AS x, (l_suppkey % 40)::INT AS y, (12 + l_quantity * 2)::INT AS w, (12 + (l_partkey % 37) * 2)::INT AS h FROM lineitem)",
    "rgb": "rgb AS (SELECT l_orderkey, l_linenumber, (l_partkey % 256)::INT AS r, (l_suppkey * 7 % 256)::INT AS g, ((l_quantity * 5)::BIGINT % 256)::INT AS b FROM lineitem)",
    "series": "series AS (SELECT user_id AS series_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS i, event_type IN ('view', 'click') AS flag FROM events)",
    "tailed": "tailed AS (SELECT series_id, i, flag OR i * 10 >= 6 * (count(*) OVER (PARTITION BY series_id)) AS flag FROM series)",
    "messages": "messages AS (SELECT event_id AS msg_id, ts, user_id AS key, CASE event_type WHEN 'view' THEN 'frame' WHEN 'purchase' THEN 'command' WHEN 'error' THEN 'command' ELSE 'blank' END AS kind, CASE event_type WHEN 'purchase' THEN 'OK' WHEN 'error' THEN 'NG' END AS command, CASE event_type WHEN 'view' THEN event_id END AS size FROM events)",
}


def with_(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(CTE[n] for n in names)
