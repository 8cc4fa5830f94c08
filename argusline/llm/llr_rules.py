"""Quality rules: plain counts, and a log-likelihood ratio of hashed n-grams.

Every text's words and word pairs fall into ``BUCKETS`` hashed buckets.  Two
multinomials over the buckets are counted, one over all texts and one over
trusted texts; the log of their ratio, in millionths, is a bucket's weight.
Both are smoothed by one occurrence at the size of the target, so that a bucket
from which the target could expect next to nothing says next to nothing.  A
text's score is the mean weight of its n-grams.  A quarter of the trusted texts
is held back from the target, and the scores of these give the threshold: one
spread (of the middle and the lowest hundredth) below the lowest hundredth.
Sums are whole numbers: equal texts are judged alike in every run.

All of it is DataFrame functions: one scan counts all texts and one the target
(combined before the shuffle, so at most ``BUCKETS`` rows leave a task), one
reads what is held back, one judges and shuffles nothing.  Every trusted text
counts, in the target or for the threshold; where their ids are too many to be
broadcast, a bitmap of them keeps most other texts from being shuffled.
Weights, threshold and bitmap are scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusline.llm.common import WORD, Stages

#: Buckets that words and word pairs are hashed to: the weights are one array of so many numbers.
BUCKETS = 1 << 16
#: One of so many trusted texts is held back for the threshold.
FOLDS = 4
#: Bits of the bitmap of trusted ids (2 MB): more of them sift better among more ids.
BITS = 1 << 24
#: A millionth of a natural logarithm is the unit of weights.
UNIT = 1_000_000
#: Base rules: fewer words, or a larger share of repeated words, fail.
LEAST_WORDS = 50
MOST_REPEATED = 50

_SYMBOLS = r"[#*$%&|<>]"
_SPACE = r"[\x20\x09-\x0D]"


def _tail(a: Column, start: int) -> Column:
    return F.slice(a, start, F.greatest(F.size(a), F.lit(1)))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, h, pair``: hashes of the words, and of each word with the next (the last one alone)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("h"))
    return words.select("id", "text", "h", F.zip_with("h", _tail(F.col("h"), 2), lambda a, b: F.xxhash64(a, b)).alias("pair"))


def _buckets(buckets: int) -> Column:
    at = lambda x: F.pmod(x, F.lit(buckets)).cast("int")
    return F.concat(F.transform("h", at), F.transform("pair", at))


def _trusted(trusted: DataFrame, id_col: str, limit: int | None) -> DataFrame:
    """``id, held``: every id once; with a ``limit`` the first so many by a hash."""
    ids = trusted.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    if limit is not None:
        ids = ids.orderBy(F.xxhash64("id"), "id").limit(limit)
    return ids.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(FOLDS)) == 0)


def _among(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, bits: int = BITS) -> DataFrame:
    """``id, text`` of the rows whose id is one of ``ids``, which a bitmap sifts before the join."""
    at = F.pmod(F.xxhash64("id"), F.lit(bits)).cast("int")
    word, flag = F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)))
    set_ = ids.groupBy(word.alias("i")).agg(F.bit_or(flag).alias("flags"))
    every = docs.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("i")).join(set_, "i", "left").select("i", F.coalesce("flags", F.lit(0).cast("long")).alias("flags"))
    bitmap = every.agg(F.sort_array(F.collect_list(F.struct("i", "flags"))).alias("c")).select(F.col("c.flags"))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.where(F.get(bitmap.scalar(), word).bitwiseAND(flag) != 0).join(ids.select("id"), "id", "left_semi")


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, limit: int | None = None) -> DataFrame:
    """One row ``weights``: for each bucket the log of target over corpus share.

    ``trusted`` holds ids; null ids and ids without a text say nothing, repeated
    ones count once.  Without any word of a trusted text all weights are 0.
    """
    ids = _trusted(trusted, id_col, limit).where("NOT held").select("id")
    grams = lambda read, n, t: read.select(F.explode(_buckets(buckets)).alias("b"), F.lit(n).alias("n"), F.lit(t).alias("t"))
    both = grams(_hashed(docs, id_col, text_col), 1, 0).unionByName(grams(_hashed(_among(docs, ids, id_col, text_col), "id", "text"), 0, 1))
    counts = both.groupBy("b").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    every = every.select("b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t"))
    row = every.agg(F.array_sort(F.collect_list(F.struct("b", "n", "t"))).alias("c"), F.sum("n").alias("all_n"), F.sum("t").alias("all_t"))
    share = F.coalesce(F.try_divide(F.col("all_t").cast("double"), F.col("all_n")), F.lit(0.0))
    ratio = lambda c: F.round(UNIT * F.log((c["t"] + 1) / (share * c["n"] + 1))).cast("long")
    return row.select(F.transform("c", ratio).alias("weights"))


def _scored(read: DataFrame, told: DataFrame) -> DataFrame:
    """``read`` (with ``grams``) and the sum and number of its n-grams' weights."""
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda s, b: s + F.get("weights", b))
    scored = read.withColumn("weights", told.scalar()).withColumn("total", total)
    return scored.withColumn("n_grams", F.size("grams").cast("long")).drop("weights", "grams")


def threshold_of(docs: DataFrame, trusted: DataFrame, told: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, limit: int | None = None) -> DataFrame:
    """One row ``threshold``, in units, from the trusted texts that are held back; null without any of enough words."""
    ids = _trusted(trusted, id_col, limit).where("held").select("id")
    read = _hashed(_among(docs, ids, id_col, text_col), "id", "text").where(F.size("h") >= LEAST_WORDS).select(_buckets(buckets).alias("grams"))
    score = _scored(read, told).select((F.col("total") / F.col("n_grams")).alias("score"))
    low, middle = F.percentile("score", 0.01), F.percentile("score", 0.5)
    return score.agg(F.floor(low - (middle - low)).alias("threshold"))


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in a window (hashes ``windows`` by start) found twice or more.

    Each step is a column of its own, so that none is computed twice; texts
    without a repeated window skip them.
    """
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("sorted", F.when(some, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.zip_with("sorted", _tail(F.col("sorted"), 2), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("starts", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))))
    covered = F.zip_with("starts", _tail(F.col("starts"), 2), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    limit: int | None = None,
    threshold: int | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: counts, ``base_failed``, ``score`` and ``kept``.

    ``threshold`` is a mean weight in units; by default the trusted texts give it,
    and without any of them the base rules alone decide.

    A null text is empty: it has no words, fails the base rules and scores 0.
    Repeated rows and texts of any length are judged like others, each by its
    text alone; an empty table gives an empty table.  Only the id and the text
    are read, so further columns may have any names.  Windows and word pairs
    are told apart by 64-bit hashes.  ``score`` is the mean weight in units.
    """
    stages = Stages(docs.sparkSession, "rules")
    told = stages.write(weights(docs, trusted, id_col, text_col, buckets, limit), "weights")
    if threshold is None:
        least = stages.write(threshold_of(docs, trusted, told, id_col, text_col, buckets, limit), "threshold").scalar()
    else:
        least = F.lit(threshold)
    read = _hashed(docs, id_col, text_col)
    n = F.size("h")
    windows = F.when(n >= 3, F.slice(F.zip_with("pair", _tail(F.col("h"), 3), lambda p, c: F.xxhash64(p, c)), 1, F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    read = read.select(
        "id",
        n.cast("long").alias("n_words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(_SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("windows"),
        _buckets(buckets).alias("grams"),
    )
    out = _repeated_words(_scored(read, told)).select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "total",
        "n_grams",
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    score = F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams")).otherwise(0.0)
    kept = ~failed & F.coalesce(F.col("total") >= least * F.col("n_grams"), F.lit(True))
    # Written, so that a filter on the verdict is not pushed below the counts, which would then be computed anew.
    out = out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.round(score, 6).alias("score"), kept.alias("kept"))
    return stages.write(out, "judged")
