"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are counted in words.  A source's target is its weighted share of
``epochs`` times all words, but at most ``max_repeat`` times its own size; what
it cannot take is shared among the others by weight.  The mix is then dealt in
blocks of equally many words: the highest quotients ``target / (2 q + 1)`` give
every source a whole number of blocks, and the same rule deals a source's
blocks to its shards (parts of bounded size that a hash of the row chooses).
Blocks are short against the smallest target (``FINE`` of them or more, down to
one word), so that small sources too come near their targets.

In a shard the documents lie in seeded hash order on a ring of blocks.  With
``q`` blocks to take from ``n``, every block is taken ``q // n`` times and
``q % n`` blocks once more: those that follow a block which the seed selects.
Blocks that follow each other keep documents whole (a block is much shorter
than a document), and the words taken from one follow from its place alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusline.llm.common import Stages, fresh, word_count

#: Words of a shard on average at most, until there are MAX_SHARDS of them.
SHARD_WORDS = 500_000
MAX_SHARDS = 1 << 16
#: Blocks of the smallest target, unless a block is one word.
FINE = 16
#: Columns of a mix.
MIXED = ("size", "source_size", "target", "taken", "whole", "spans")


def targets(sizes: Sequence[int], weights: Sequence[float], epochs: float, max_repeat: float) -> list[float]:
    """Targets of sources: weighted shares of ``epochs * sum(sizes)``, capped."""
    total, caps = epochs * sum(sizes), [max_repeat * s for s in sizes]
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if total * weights[i] / weight > caps[i]]
        if not over:
            for i in open_:
                out[i] = total * weights[i] / weight
            break
        for i in over:
            out[i] = caps[i]
            total -= caps[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients ``votes / (2 q + 1)``, none above its cap.

    Equal quotients go to the first.  The smallest level is bisected above
    which there are no more quotients than seats; those above it win, and only
    the few that are left go through the queue, so that the cost does not grow
    with the seats.
    """
    most = [c if v > 0 else 0 for v, c in zip(votes, caps, strict=True)]
    if seats <= 0 or sum(most) <= seats:
        return most if seats > 0 else [0] * len(votes)

    def above(level: float) -> list[int]:
        """How many quotients of each are larger than ``level``."""
        out = []
        for v, c in zip(votes, most, strict=True):
            q = max(0, int(min(c, (v / level + 1) // 2)))
            while q < c and v / (2 * q + 1) > level:
                q += 1
            while q > 0 and v / (2 * q - 1) <= level:
                q -= 1
            out.append(q)
        return out

    low, high = 0.0, float(max(votes))  # none is above `high`
    while (mid := (low + high) / 2) not in (low, high):
        if sum(above(mid)) <= seats:
            high = mid
            if sum(above(mid)) == seats:
                break
        else:
            low = mid
    out = above(high)
    queue = [(-v / (2 * q + 1), i) for i, (v, q, c) in enumerate(zip(votes, out, caps, strict=True)) if q < c and v > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(out)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(queue, (-votes[i] / (2 * out[i] + 1), i))
    return out


def block_words(goal: Sequence[float], most: int) -> int:
    """Words of a block: ``most`` halved until the smallest target has ``FINE`` blocks."""
    least = min((g for g in goal if g > 0), default=float("inf"))
    while most > 1 and least < FINE * most:
        most //= 2
    return max(1, most)


def mix(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: Sequence[float] = (3, 1, 2),
    epochs: float = 1.5,
    max_repeat: int = 2,
    seed: int = 7,
    block: int = 32,
) -> DataFrame:
    """Every row of ``docs`` with ``size, source_size, target, taken`` and its arcs.

    Sources are ordered by code point, null last, and take ``weights`` in turn.
    ``taken`` counts the words taken with repeats; ``whole`` is how often the
    document is taken whole and ``spans`` lists further word ranges [start, end)
    taken once more.  Empty and null texts have size 0 and nothing taken.  Rows
    that are equal in id and text are told apart by nothing, so either may
    stand first.  ``block`` is the longest block (see ``block_words``).  Columns
    of ``docs`` with these names are replaced.  The table
    of sources must fit the driver (it is the configuration of a mix), and so
    must that of shards, at most about ``2 * MAX_SHARDS`` besides one for each source.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in MIXED and c not in (text_col, source_col, id_col)])
    order, shard, pos = (fresh([*docs.columns, *MIXED], c) for c in ("order", "shard", "pos"))
    stages = Stages(docs.sparkSession, "mixing")
    sized = docs.withColumn("size", word_count(F.col(text_col)))
    mark = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(source_col), F.xxhash64(F.col(text_col)))
    narrow = stages.write(sized.select(F.col(source_col).alias("source"), mark.alias("order"), "size"), "sizes")

    totals = narrow.groupBy("source").agg(F.sum("size").alias("n")).collect()
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], epochs, max_repeat)
    spark = docs.sparkSession
    if not sizes or sum(sizes) == 0:
        return sized.withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "taken": F.lit(0).cast("long"), "whole": F.lit(0).cast("int"), "spans": F.array().cast("array<struct<start:long,end:long>>")})

    # Shards of a source by a power of two, so that a hash's low bits name them.
    each = max(SHARD_WORDS, sum(sizes) // MAX_SHARDS)
    parts = [1 << max(0, (-(-n // each) - 1).bit_length()) for n in sizes]
    plan = spark.createDataFrame([(r.source, n, float(g), p) for r, n, g, p in zip(totals, sizes, goal, parts, strict=True)], "s string, source_size long, target double, parts int")
    keyed = lambda df, source, mark_: df.join(plan, F.col(source).eqNullSafe(F.col("s")), "inner").withColumn(shard, F.pmod(F.shiftright(mark_, 20), F.col("parts")).cast("int")).drop("s", "parts")

    block = block_words(goal, block)
    seats = sainte_lague(goal, round(sum(goal) / block), [-(-max_repeat * n // block) for n in sizes])
    quota = {}
    by_shard = keyed(narrow, "source", F.col("order")).groupBy("source", shard).agg(F.sum("size").alias("n")).collect()
    by_source: dict = {}
    for r in sorted(by_shard, key=lambda r: r[shard]):
        by_source.setdefault(r.source, []).append((r[shard], r.n))
    for r, q in zip(totals, seats, strict=True):
        ns = [n for _, n in by_source[r.source]]
        got = sainte_lague(ns, q, [-(-max_repeat * n // block) for n in ns])
        for (k, n), x in zip(by_source[r.source], got, strict=True):
            # The cap may cut the last block short.
            quota[r.source, k] = (n, min(x * block, max_repeat * n))
    shards = spark.createDataFrame([(s, k, n, x) for (s, k), (n, x) in quota.items()], "s string, k int, ring long, words long")

    wide = keyed(sized.withColumn(order, mark), source_col, F.col(order))
    w = W.partitionBy(source_col, shard).orderBy(order, id_col).rowsBetween(W.unboundedPreceding, -1)
    placed = wide.withColumn(pos, F.coalesce(F.sum("size").over(w), F.lit(0)))
    placed = placed.join(shards, F.col(source_col).eqNullSafe(F.col("s")) & (F.col(shard) == F.col("k")), "inner")
    # On the ring of `ring` words every word is taken `whole` times and the arc once more.
    ring, extra = F.greatest("ring", F.lit(1)), F.expr("words % greatest(ring, 1)")
    begin = block * F.pmod(F.xxhash64(F.lit(seed), F.col("s"), F.col("k")), F.ceil(ring / block))
    a, b = F.col(pos), F.col(pos) + F.col("size")
    cut = lambda lo, hi: F.struct((F.greatest(a, lo) - a).alias("start"), (F.least(b, hi) - a).alias("end"))
    spans = F.filter(F.array(cut(begin, begin + extra), cut(begin - ring, begin + extra - ring)), lambda x: x["start"] < x["end"])
    kept = [c for c in docs.columns]
    out = placed.withColumn("whole", F.expr("words div greatest(ring, 1)").cast("int")).withColumn("spans", spans)
    out = out.withColumn("taken", F.col("whole") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]))
    return out.select(*kept, "size", "source_size", "target", "taken", "whole", "spans")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns of ``docs``.

    A document taken twice gives two rows; a part that an arc cuts out gives a
    row with the text of those words.  ``n_chars``, if there, is set anew.
    """
    text = options.get("text_col", "text")
    used = {text, options.get("source_col", "source"), options.get("id_col", "doc_id")}
    # The user's columns with names of the mix go by others meanwhile.
    clashing = [c for c in docs.columns if c.lower() in MIXED and c not in used]
    aside: dict[str, str] = {}
    for c in clashing:
        aside[c] = fresh([*docs.columns, *MIXED, *aside.values()], f"own_{c}")
    mixed = mix(docs.withColumnsRenamed(aside), **options)
    row = fresh(mixed.columns, "row")
    many = mixed.withColumn(row, F.explode(F.concat(F.array_repeat(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")), F.col("whole")), F.col("spans"))))
    start, end = F.col(row)["start"], F.col(row)["end"]
    # The words [start, end) with the white space after each.
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    body = F.when((start == 0) & (end == F.col("size")), F.col(text)).otherwise(F.array_join(F.slice(words, (start + 1).cast("int"), (end - start).cast("int")), ""))
    out = many.where(F.col("size") > 0).withColumn(text, body)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast("long"))
    return out.drop(*MIXED).withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)
