"""Text panels, categories, routes and messages."""

from __future__ import annotations


from pyspark.sql import functions as F

from argusline.functions import text as T
from argusline.functions.fixed import DEFAULT_ROUTE, PANEL
from argusline.operators import fuzzy, routing
from argusline.operators import scoring as S
from argusline.plans import bindings as B

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Words of the standard tables that stand in for misread categories.
PART_ALIASES = (("ROD", "Shifted"), ("BOLT", "Missing"), ("SPRING", "Bridge"), ("GEAR", "Dust"))
PART_CATEGORIES = ("Anvil", "Widget Small", "Copper", "Steel", "Economy")
SPACED = "upper(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')))"
TOKENS = f"list_filter(string_split({SPACED}, ' '), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+'))"
ALIAS_CASE = "CASE WHEN p_partkey % 11 = 0 THEN 'Unknown' " + " ".join(f"WHEN contains({SPACED}, '{a}') THEN '{c}'" for a, c in PART_ALIASES) + " END"


@query("clean_key", "SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS key FROM part")
def clean_key(spark, d):
    return B.table(spark, d, "part").select("p_partkey", T.clean_key(F.col("p_name")).alias("key"))


@query("sanitize_category", "SELECT doc_id, coalesce(nullif(trim(regexp_replace(source || '/' || lang || '#', '[^A-Za-z0-9 _-]', '', 'g')), ''), 'Unknown') AS category FROM documents")
def sanitize_category(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.sanitize_category(F.concat("source", F.lit("/"), "lang", F.lit("#"))).alias("category"))


_FIELD = "coalesce(list_filter(list_transform(string_split(raw, chr(10)), lambda l: trim(regexp_extract(l, '{}', 1))), lambda v: v <> '')[1], NULL)"
PARSE_SQL = (
    "WITH t AS (SELECT p_partkey AS insp_id, 'Board: ' || p_brand || chr(10) || 'Parts: ' || p_name || ' Value: ' || p_type AS raw FROM part) SELECT insp_id, "
    + ", ".join(f"{_FIELD.format(PANEL[k])} AS {k}" for k in PANEL)
    + " FROM t"
)


@query("parse_panel", PARSE_SQL)
def parse_panel(spark, d):
    return B.panel_text(spark, d).select("insp_id", T.parse_panel(F.col("raw_text")).alias("p")).select("insp_id", "p.*")


def _blanks():
    return F.when(F.col("p_partkey") % 22 == 0, F.lit(None)).when(F.col("p_partkey") % 11 == 0, F.lit(" - ")).otherwise(F.col("p_name"))


@query("alias_category", f"SELECT p_partkey, {ALIAS_CASE} AS category FROM part")
def alias_category(spark, d):
    return B.table(spark, d, "part").select("p_partkey", T.alias_category(_blanks(), PART_ALIASES).alias("category"))


@query("null_text_guard", "SELECT p_partkey % 11 = 0 AS blank, count(*) AS n FROM part GROUP BY 1")
def null_text_guard(spark, d):
    return B.table(spark, d, "part").groupBy(T.is_blank(_blanks()).alias("blank")).agg(F.count("*").alias("n"))


@query("unknown_trace", f"SELECT p_partkey, array_to_string({TOKENS}, ', ') AS trace FROM part")
def unknown_trace(spark, d):
    return B.table(spark, d, "part").select("p_partkey", T.unknown_trace(F.col("p_name")).alias("trace"))


def _fuzzy(spark, d):
    p = B.table(spark, d, "part").select("p_partkey", F.translate("p_name", "i", "1").alias("dirty"))
    return fuzzy.fuzzy_category(p, "p_partkey", "dirty", PART_CATEGORIES, ())


@query("fuzzy_category")
def fuzzy_category(spark, d):
    return _fuzzy(spark, d).select(F.col("id").alias("p_partkey"), "category", "trace")


@query("rewrite_value")
def rewrite_value(spark, d):
    return fuzzy.rewrite_value(_fuzzy(spark, d)).select(F.col("id").alias("p_partkey"), "category", "value")


@query("tolerance_rule", "SELECT event_id, CASE WHEN upper(event_type) LIKE '%SIGN%' THEN 'x' ELSE 'y' END AS probe, CASE WHEN event_type = 'click' THEN 0.04::DOUBLE ELSE 0.08::DOUBLE END AS shift_tol, CASE WHEN event_type = 'click' THEN 0.10::DOUBLE ELSE 0.05::DOUBLE END AS ink_tol, event_type = 'error' AS reversed FROM events")
def tolerance_rule(spark, d):
    e = B.table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "click", "sifted 0.3").when(F.col("event_type") == "error", "reversed").otherwise(F.col("event_type")))
    return e.select(
        "event_id", F.when(F.upper("event_type").contains("SIGN"), "x").otherwise("y").alias("probe"),
        T.tolerance_rule("shift", F.col("v"), F.lit("none")).alias("shift_tol"), T.tolerance_rule("silk", F.col("v")).alias("ink_tol"), T.reverse_flag(F.col("v")).alias("reversed"),
    )


@query("message_router", B.with_("messages") + " SELECT msg_id, kind, command, size FROM messages")
def message_router(spark, d):
    return B.messages(spark, d).select("msg_id", "kind", "command", "size")


@query("stamp", "SELECT o_orderkey, o_orderstatus || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S_%g') AS sample_id FROM orders")
def stamp(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", T.stamp(F.col("o_orderstatus"), F.col("o_orderdate")).alias("sample_id"))


@query("json_props", "SELECT event_id, coalesce((props::JSON ->> 'k')::INT, -1) AS k, coalesce(props::JSON ->> 'none', 'UNKNOWN') AS category FROM events")
def json_props(spark, d):
    e = B.table(spark, d, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("UNKNOWN")).alias("category"))


_ROUTE = "CASE p_type WHEN 'ECONOMY' THEN 'Shifted' WHEN 'STANDARD' THEN 'Missing' WHEN 'PROMO' THEN 'Bridge' ELSE 'none' END"
_ENGINES = "CASE p_type WHEN 'ECONOMY' THEN ['shift', 'knn'] WHEN 'STANDARD' THEN ['semantic', 'ssim', 'silk', 'knn'] WHEN 'PROMO' THEN ['ssim', 'knn'] ELSE ['shift', 'silk', 'ssim', 'semantic', 'knn'] END"


def _routed(spark, d):
    p = B.table(spark, d, "part").select("p_partkey", "p_size", F.expr(_ROUTE).alias("category"))
    return routing.route_engines(p, routing.routes(spark), DEFAULT_ROUTE)


@query("route_engines", f"SELECT p_partkey, unnest({_ENGINES}) AS engine FROM part")
def route_engines(spark, d):
    return _routed(spark, d).select("p_partkey", F.explode("engines").alias("engine"))


@query("active_engines", f"SELECT p_partkey, array_to_string(list_filter({_ENGINES}, lambda e: e <> 'ssim' OR p_size > 25), ',') AS engines FROM part")
def active_engines(spark, d):
    return _routed(spark, d).select("p_partkey", F.array_join(S.active_engines(F.col("engines"), F.col("p_size") > 25), ",").alias("engines"))


@query("label_from_path", "WITH c AS (SELECT page_id, regexp_extract(url, '://[^/]+/([^/?#]+)', 1) AS label FROM pages) SELECT page_id, label, dense_rank() OVER (ORDER BY label) - 1 AS class FROM c")
def label_from_path(spark, d):
    from argusline.sources.files import label_from_path as labelled

    p = B.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]+/", "").alias("path"))
    return labelled(p, "path").select("page_id", "label", F.col("class").cast("long").alias("class"))
