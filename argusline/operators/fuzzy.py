"""Fuzzy category join: words and word groups against a category vocabulary."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from argusline.functions import text as T
from argusline.functions.fixed import ALIASES, CATEGORIES, WORDINGS


@F.pandas_udf(DoubleType())
def similarity(word: pd.Series, category: pd.Series) -> pd.Series:
    """Sequence-matcher ratio with the category's characters first matched in the word."""
    return pd.Series([SequenceMatcher(None, c, w).ratio() for w, c in zip(word, category, strict=True)])


def category_matches(grams: DataFrame, categories: Sequence[str]) -> DataFrame:
    """gram, category, ratio of the best category at or over the gram's cutoff.

    Only distinct grams are compared; ties go to the greatest category.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c.upper()).alias("upper")) for c in categories]))
    pairs = grams.select("gram", "cutoff").distinct().withColumn("c", each)
    scored = pairs.withColumn("ratio", similarity(F.col("gram"), F.col("c.upper"))).where(F.col("ratio") >= F.col("cutoff"))
    return scored.groupBy("gram", "cutoff").agg(F.max_by("c.name", F.struct("ratio", "c.upper")).alias("category"))


def fuzzy_category(df: DataFrame, id_col: str, text_col: str, categories: Sequence[str] = CATEGORIES, aliases: Sequence[tuple[str, str]] = ALIASES) -> DataFrame:
    """id, category, trace: alias first, then words, pairs and triples of words.

    Words and groups are tried in order and the first with a match decides.
    Without one the category is Unknown and ``trace`` lists the words tried.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = base.withColumns({"alias": T.alias_category(F.col("text"), aliases), "words": F.when(T.is_blank(F.col("text")), F.array().cast("array<string>")).otherwise(T.tokens(F.col("text")))})

    def grams(n: int, cutoff: float) -> Column:
        at = F.sequence(F.lit(0), F.size("words") - n)
        made = F.transform(at, lambda i: F.struct(F.lit(n).alias("stage"), i.alias("pos"), F.array_join(F.slice("words", i + 1, n), " ").alias("gram"), F.lit(cutoff).alias("cutoff")))
        return F.when(F.size("words") >= n, made).otherwise(F.array().cast("array<struct<stage:int,pos:int,gram:string,cutoff:double>>"))

    open_ = base.where(F.col("alias").isNull())
    tried = open_.select("id", F.explode(F.concat(grams(1, 0.6), grams(2, 0.65), grams(3, 0.65))).alias("g")).select("id", "g.*")
    found = tried.join(category_matches(tried, categories), ["gram", "cutoff"]).groupBy("id").agg(F.min_by("category", F.struct("stage", "pos")).alias("fuzzy"))
    out = base.join(found, "id", "left").withColumn("category", F.coalesce("alias", "fuzzy", F.lit("Unknown")))
    return out.select("id", "text", "category", F.when(F.col("category") == "Unknown", F.array_join("words", ", ")).alias("trace"))


def rewrite_value(found: DataFrame) -> DataFrame:
    """``fuzzy_category`` rows with the recognised wording replaced in the text.

    Categories of several words replace their wording; one-word categories
    replace the first word that resembles them (ratio 0.5) wherever it stands.
    """
    wording = F.col("text")
    many = F.lit(False)
    out = None
    for name, pattern in WORDINGS.items():
        is_ = F.col("category") == name
        many = many | is_
        done = F.regexp_replace(wording, "(?i)" + pattern, name)
        out = F.when(is_, done) if out is None else out.when(is_, done)
    words = F.split(F.trim(F.regexp_replace("text", r"[<>=\s]+", " ")), " ")
    single = found.where(~many & (F.col("category") != "Unknown")).select("id", "category", F.posexplode(words).alias("pos", "word")).where((F.length("word") >= 3) & ~F.col("word").rlike("^[0-9]+$"))
    pairs = single.select("word", "category").distinct().withColumn("ratio", similarity(F.upper("word"), F.upper("category"))).where("ratio >= 0.5")
    first = single.join(pairs, ["word", "category"]).groupBy("id").agg(F.min_by("word", "pos").alias("word"))
    rows = found.join(first, "id", "left")
    value = out.when(F.col("word").isNotNull(), F.replace("text", "word", "category")).otherwise(F.col("text"))
    return rows.select("id", "category", value.alias("value"), "trace")
