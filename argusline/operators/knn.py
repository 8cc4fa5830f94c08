"""Filtered, tiered nearest-neighbour votes over a labelled memory.

``queries`` has query_id, part, category, emb; ``memory`` has sample_id, label
(OK or NG), part_key, category_key, sig and path.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusline.functions.fixed import STRICT
from argusline.functions.text import clean_key
from argusline.functions.vectors import dot, norm
from argusline.operators.components import shared_dir
from argusline.operators.pivots import FOUND, M_BLOCK, Q_BLOCK, PivotIndex, meet, ranked, usable


def with_keys(queries: DataFrame) -> DataFrame:
    return queries.withColumn("part_key", clean_key(F.col("part"))).withColumn("category_key", clean_key(F.col("category")))


def union_memory(ok: DataFrame, ng: DataFrame) -> DataFrame:
    """One memory with a label column from its two halves."""
    return ok.withColumn("label", F.lit("OK")).unionByName(ng.withColumn("label", F.lit("NG")))


def memory_summary(memory: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    is_ok = F.col("label") == "OK"
    return memory.groupBy(*by).agg(F.count_if(is_ok).alias("n_ok"), F.count_if(F.col("label") == "NG").alias("n_ng"), F.count("*").alias("n_total"))


#: Cells that a memory is dealt to where queries meet all of it.
CELLS = 64
#: Letters of the pieces that parts are indexed by.
GRAM = 3


def parts_within(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (q_part, m_part) of distinct parts, the first a piece of the second.

    Held parts are posted by all their pieces of up to ``GRAM`` letters.  An
    asked part looks up the rarest of its own (itself if it is as short), and
    what it finds there is verified, so that no parts meet that share nothing.
    The empty part is a piece of all.
    """
    def pieces(c: str, k: int):
        last = F.length(c) - (k - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    every = F.concat(F.array(F.lit("")), *[pieces("m_part", k) for k in range(1, GRAM + 1)])
    posted = held.select("m_part", F.explode(F.array_distinct(every)).alias("gram"))
    own = F.when(F.length("q_part") <= GRAM, F.array("q_part")).otherwise(F.array_distinct(pieces("q_part", GRAM)))
    looked = asked.select("q_part", F.explode(own).alias("gram")).join(posted.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = looked.groupBy("q_part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    return rarest.select("q_part", "r.gram").join(posted, "gram").where(F.col("m_part").contains(F.col("q_part"))).select("q_part", "m_part")


def tiered_keys(queries: DataFrame, memory: DataFrame, strict: Sequence[str] = STRICT) -> DataFrame:
    """For each (part_key, category_key) asked its tier and the memory keys in it.

    Tier 1 has the asked part within the memory's part and the asked category;
    tier 2 any category; tier 3 everything.  An empty key fits all.  Tiers 2
    and 3 are closed to strict categories.  Returns q_part, q_cat, tier, m_part,
    m_cat; tier 3 has one row without memory keys.  Parts are matched apart from
    categories, on distinct keys: the numbers of products and of categories.
    """
    asked = queries.select(F.col("part_key").alias("q_part"), F.col("category_key").alias("q_cat")).distinct()
    held = memory.select(F.col("part_key").alias("m_part"), F.col("category_key").alias("m_cat")).distinct()
    parts = parts_within(asked.select("q_part").distinct(), held.select("m_part").distinct())
    # Each table is read once: what no part fits stays as a row without memory keys.
    tier = F.when(F.col("m_part").isNull(), 3).when((F.col("q_cat") == "") | (F.col("m_cat") == F.col("q_cat")), 1).otherwise(2)
    near = asked.join(parts, "q_part", "left").join(held, "m_part", "left").withColumn("tier", tier)
    if strict:
        near = near.where((F.col("tier") == 1) | ~F.col("q_cat").isin(*strict))
    best = F.min("tier").over(W.partitionBy("q_part", "q_cat"))
    return near.withColumn("best", best).where("tier = best").select("q_part", "q_cat", "tier", "m_part", "m_cat")


def _asked(queries: DataFrame) -> DataFrame:
    return with_keys(queries).withColumnsRenamed({"part_key": "q_part", "category_key": "q_cat"})


def _memory(memory: DataFrame) -> DataFrame:
    return memory.select("sample_id", "label", F.col("part_key").alias("m_part"), F.col("category_key").alias("m_cat"), F.col("sig").cast("array<double>").alias("sig"), "path", *_codes(memory))


def _codes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "codes"]


def written_keys(queries: DataFrame, memory: DataFrame, strict: Sequence[str] = STRICT) -> DataFrame:
    """``tiered_keys``, written: as many rows as distinct keys fit, for plans that need them several times."""
    path = f"{shared_dir(queries.sparkSession)}/tiers-{uuid.uuid4().hex[:12]}"
    keys = tiered_keys(with_keys(queries), memory, strict)
    keys.write.parquet(path)
    return queries.sparkSession.read.schema(keys.schema).parquet(path)


def candidate_counts(queries: DataFrame, memory: DataFrame, strict: Sequence[str] = STRICT, own: bool = True, keys: DataFrame | None = None) -> DataFrame:
    """query_id, tier and how many memory rows (n, ok, ng) are in it.

    Counted by keys: no query meets a memory row.  Without ``own`` the row of
    the query's own id does not count.
    """
    keys = tiered_keys(with_keys(queries), memory, strict) if keys is None else keys
    size = F.size("sig").alias("dim")
    each = memory.groupBy(F.col("part_key").alias("m_part"), F.col("category_key").alias("m_cat"), size).agg(F.count_if(F.col("label") == "OK").alias("ok"), F.count_if(F.col("label") == "NG").alias("ng"), F.count("*").alias("n"))
    whole = each.groupBy("dim").agg(F.sum("ok").alias("ok"), F.sum("ng").alias("ng"), F.sum("n").alias("n"))
    some = keys.where("tier < 3").join(each, ["m_part", "m_cat"]).groupBy("q_part", "q_cat", "tier", "dim").agg(F.sum("ok").alias("ok"), F.sum("ng").alias("ng"), F.sum("n").alias("n"))
    # A row for each vector length, of which there are few.
    all_ = keys.where("tier = 3").select("q_part", "q_cat", "tier").join(whole, F.col("tier") == 3)
    asked = _asked(queries).select("query_id", "q_part", "q_cat", F.size("emb").alias("dim"))
    out = asked.join(some.unionByName(all_.select(*some.columns)), ["q_part", "q_cat", "dim"])
    if not own:
        me = memory.select(F.col("sample_id").alias("query_id"), F.col("label").alias("own_label"), F.col("part_key").alias("own_part"), F.col("category_key").alias("own_cat"), F.size("sig").alias("dim"))
        within = (F.col("tier") == 3) | ((F.col("q_part") == "") | F.col("own_part").contains(F.col("q_part"))) & ((F.col("tier") == 2) | (F.col("q_cat") == "") | (F.col("own_cat") == F.col("q_cat")))
        out = out.join(me, ["query_id", "dim"], "left").withColumn("me", F.coalesce(within, F.lit(False)).cast("int"))
        out = out.withColumns({"ok": F.col("ok") - F.when(F.col("own_label") == "OK", F.col("me")).otherwise(0), "ng": F.col("ng") - F.when(F.col("own_label") == "NG", F.col("me")).otherwise(0), "n": F.col("n") - F.when(F.col("own_label").isNotNull(), F.col("me")).otherwise(0)})
    return out.where("n > 0").select("query_id", "tier", "ok", "ng", "n")


def candidates(queries: DataFrame, memory: DataFrame, strict: Sequence[str] = STRICT, own: bool = True) -> DataFrame:
    """Pairs of queries with the memory rows of their first two tiers.

    Rows of other vector lengths do not fit.  Tier 3 is the whole memory and is
    not listed: votes work it in blocks.
    """
    keys = tiered_keys(with_keys(queries), memory, strict).where("tier < 3")
    q = _asked(queries).select("query_id", "q_part", "q_cat", F.col("emb").cast("array<double>").alias("emb"))
    found = q.join(keys, ["q_part", "q_cat"]).join(_memory(memory), ["m_part", "m_cat"]).where(F.size("sig") == F.size("emb"))
    return found if own else found.where("sample_id <> query_id")


def nearest(queries: DataFrame, memory: DataFrame, k: int, strict: Sequence[str] = STRICT, own: bool = True, keys: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """The ``k`` nearest memory rows by cosine in each query's tier.

    query_id, tier, rank, sample_id, label, path, dist; ties go to OK, then to
    the smaller id; unusable vectors (null, zero, null or non-finite components)
    take no part.  Queries of one key and memory rows of one key meet block by
    block, and a block gives out its ``k`` nearest for each query, so that no
    pairs are shuffled.  Tier 3 (left out without ``whole``) is one block if the
    memory is no larger, else it is searched through ``PivotIndex``.

    If both have ``codes`` (int arrays of one length), only rows whose codes
    agree in one place at least are neighbours; tier 3 then meets every block,
    each in one of ``CELLS`` cells that its queries are copied to.
    """
    keys = tiered_keys(with_keys(queries), memory, strict) if keys is None else keys

    def salted(df: DataFrame, by: Sequence[str], i: str | Column, n: int) -> DataFrame:
        # Counted apart: a window would sort all rows of a key in one task.
        per = df.groupBy(*by).agg(F.ceil(F.count("*") / n).cast("int").alias("blks"))
        return df.join(per, list(by)).withColumn("blk", F.pmod(F.xxhash64(i), F.col("blks")).cast("int")).drop("blks")

    codes = _codes(queries)
    asked = _asked(queries).select("query_id", "q_part", "q_cat", F.col("emb").cast("array<double>").alias("emb"), *codes).where(usable("emb"))
    q = salted(asked, ["q_part", "q_cat"], "query_id", Q_BLOCK)
    q = q.groupBy("q_part", "q_cat", F.size("emb").alias("dim"), "blk").agg(F.collect_list(F.struct("query_id", "emb", *codes)).alias("asked")).drop("blk")
    rows = _memory(memory).where(usable("sig"))
    row = F.struct("sample_id", "label", "path", "sig", *codes)
    m = salted(rows, ["m_part", "m_cat"], "sample_id", M_BLOCK).groupBy("m_part", "m_cat", F.size("sig").alias("dim"), "blk").agg(F.collect_list(row).alias("held")).drop("blk")
    found = q.join(keys.where("tier < 3"), ["q_part", "q_cat"]).join(m, ["m_part", "m_cat", "dim"]).select("tier", "asked", "held")
    last = keys.where("tier = 3").select("q_part", "q_cat", "tier")
    if not whole or last.isEmpty():
        return ranked(found.mapInArrow(meet(k, own), FOUND), k)
    if codes:
        cell = F.pmod(F.xxhash64("sample_id"), F.lit(CELLS)).cast("int").alias("cell")
        dealt = salted(rows.withColumn("cell", cell), ["cell"], F.hash("sample_id"), M_BLOCK)
        held = dealt.groupBy("cell", F.size("sig").alias("dim"), "blk").agg(F.collect_list(row).alias("held")).drop("blk")
        copies = q.join(last, ["q_part", "q_cat"]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
        every = copies.join(held, ["cell", "dim"]).select("tier", "asked", "held")
        return ranked(found.unionByName(every).mapInArrow(meet(k, own), FOUND), k)
    if rows.limit(M_BLOCK + 1).count() > M_BLOCK:
        far = PivotIndex(memory).nearest(asked.join(last, ["q_part", "q_cat"]), k, own).drop("rank")
        return ranked(found.mapInArrow(meet(k, own), FOUND).unionByName(far), k)
    all_ = rows.groupBy(F.size("sig").alias("dim")).agg(F.collect_list(row).alias("held"))
    every = q.join(last, ["q_part", "q_cat"]).join(all_, "dim").select("tier", "asked", "held")
    return ranked(found.unionByName(every).mapInArrow(meet(k, own), FOUND), k)


def distances(found: DataFrame) -> DataFrame:
    """1 - cosine of every candidate; zero vectors take no part."""
    d = 1 - F.try_divide(dot(F.col("emb"), F.col("sig")), norm(F.col("emb")) * norm(F.col("sig")))
    return found.withColumn("dist", d).where(F.col("dist").isNotNull())


def knn_vote(queries: DataFrame, memory: DataFrame, k: int = 5, strict: Sequence[str] = STRICT, own: bool = True, near: DataFrame | None = None) -> DataFrame:
    """Inverse-distance vote of the ``k`` nearest candidates.

    The vote is bounded by 0.60 above if the candidates hold no OK row, and by
    0.40 below if they hold no NG row.  Without candidates it is 0.5.  Ties go
    to OK, then to the smaller sample id.  Without ``own`` a memory row of the
    query's id is no candidate.  ``near`` may give neighbours found otherwise.
    """
    keys = written_keys(queries, memory, strict)
    kinds = candidate_counts(queries, memory, strict, own, keys).select("query_id", "tier", "ok", "ng")
    near = nearest(queries, memory, k, strict, own, keys) if near is None else near
    weight = 1 / F.greatest(F.col("dist"), F.lit(1e-4))
    votes = near.groupBy("query_id").agg(
        (F.sum(F.when(F.col("label") == "NG", weight).otherwise(0.0)) / F.sum(weight)).alias("raw"),
        F.min("dist").alias("nearest"),
        F.count("*").alias("n"),
        F.min_by("path", "rank").alias("path"),
        F.min_by("label", "rank").alias("label"),
    )
    vote = F.when(F.col("ok") == 0, F.least(F.lit(0.60), "raw")).when(F.col("ng") == 0, F.greatest(F.lit(0.40), "raw")).otherwise(F.col("raw"))
    joined = queries.select("query_id").join(votes.join(kinds, "query_id"), "query_id", "left")
    return joined.select(
        "query_id",
        F.col("n").isNotNull().alias("has_memory"),
        "tier",
        F.coalesce(vote, F.lit(0.5)).alias("vote_defect"),
        F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("nearest")), F.lit(0.0)).alias("best_similarity"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_neighbors"),
        F.col("path").alias("best_match_path"),
        F.col("label").alias("best_match_label"),
    )


def mutual_nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id, dist) that are each other's nearest by cosine.

    ``a`` and ``b`` have id, group and emb; only rows of one group are compared,
    block by block.  Ties go to the smaller id.
    """
    group = F.md5(F.col("group").cast("string"))  # digits and letters only

    def one(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = (df.where("group IS NOT NULL") for df in (x, y))
        asked = x.select(F.col("id").alias("query_id"), F.lit("").alias("part"), group.alias("category"), "emb")
        held = y.select(F.col("id").alias("sample_id"), F.lit("OK").alias("label"), F.lit("").alias("part_key"), clean_key(group).alias("category_key"), F.col("emb").alias("sig"), F.lit(None).cast("string").alias("path"))
        return nearest(asked, held, 1, whole=False).where("tier = 1")

    first = one(a, b).select(F.col("query_id").alias("a_id"), F.col("sample_id").alias("b_id"), "dist")
    second = one(b, a).select(F.col("query_id").alias("b_id"), F.col("sample_id").alias("a_id"))
    return first.join(second, ["a_id", "b_id"])


def top_fraction(df: DataFrame, by: Sequence[str], order: Sequence, fraction: float = 0.15, least: int = 10) -> DataFrame:
    """First ``int(fraction * n)`` rows of each group that has ``least`` of them."""
    n = F.count("*").over(W.partitionBy(*by))
    keep = F.floor(n * F.lit(fraction))
    ranked = df.withColumn("_keep", keep).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where((F.col("rank") <= F.col("_keep")) & (F.col("_keep") >= least)).drop("_keep")
