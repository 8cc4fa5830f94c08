"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text and cuts it where the hash is the
largest among its neighbours.  The hash forgets a byte after 16 more, so equal
passages get equal cuts wherever they stand: an insertion shifts nothing but the
chunks around it.  Chunks are counted by a 64-bit digest.  A chunk that stands
elsewhere too is a seed: its match with its first occurrence (by id, then
place) is checked and extended byte by byte to both sides, and matches that
touch are one repeated passage.  All occurrences but the first can be removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusline.llm.common import Stages, fresh

#: A cut has the largest hash among as many bytes before and after it: cuts are
#: so far apart at least, twice as far on average, and no earlier cut shifts them.
AROUND = 24
MOST = 96  #: bytes of a chunk
#: Bytes of a run of extended matches that make a repeated passage.
PASSAGE = 192
#: Bytes compared on each side of a match: over two chunks and the bytes that cut them.
REACH = 256
#: Chunks that make up one in so many of all are hot.
HOT = 10_000
#: Bits of a place in a text; the text's variant stands above them.
VARIANT = 40
PLACE = (1 << VARIANT) - 1

_TABLE = np.random.default_rng(2024).integers(0, 1 << 16, 256, dtype=np.uint16)


def _largest_before(h: np.ndarray) -> np.ndarray:
    """The largest of the ``AROUND`` values before each one; -1 without any."""
    n = len(h)
    wide, width = np.r_[np.full(AROUND, -1, np.int32), h], 1
    while width < AROUND:
        step = min(width, AROUND - width)
        wide = np.maximum(wide[:-step], wide[step:])
        width += step
    return wide[:n]


def cuts(raw: bytes) -> np.ndarray:
    """Ends of the chunks of a text: the largest gear hashes of their surroundings.

    A chunk that finds no cut in ``MOST`` bytes (the text repeats itself) ends
    at the largest hash of its second half, which falls in step with the text's
    period.  Cuts stand before the first byte of a character.
    """
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    b = np.frombuffer(raw, np.uint8)
    g = _TABLE[b]
    h = g.copy()
    for j in range(1, min(16, n)):
        h[j:] += g[:-j] << np.uint16(j)
    h = h.astype(np.int32)
    # Of equal hashes the first.
    at = np.flatnonzero((h > _largest_before(h)) & (h >= _largest_before(h[::-1])[::-1])) + 1
    starts = (b & 0xC0) != 0x80
    ok = np.append(starts, True)
    out, last = [], 0

    def forced(last: int) -> int:
        c = last + MOST // 2 + int(h[last + MOST // 2 : last + MOST].argmax()) + 1
        while not ok[c]:
            c -= 1
        return c

    for c in at.tolist():
        while not ok[c]:
            c += 1
        while c - last > MOST:
            last = forced(last)
            out.append(last)
        if last < c < n:
            out.append(c)
            last = c
    while n - last > MOST:
        last = forced(last)
        out.append(last)
    out.append(n)
    return np.array(out, np.int64)


def chunks(texts: DataFrame) -> DataFrame:
    """doc_id, start, end (bytes), d of every chunk of every whole text.

    Places of a variant stand so far behind those of the one before that none
    touch: ``start`` has the variant above bit ``VARIANT``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends, digests = [], [], [], []

            def out() -> pa.RecordBatch:
                columns = [np.concatenate(ids), np.concatenate(starts), np.concatenate(ends), np.array(digests, np.uint64).view(np.int64)]
                for part in (ids, starts, ends, digests):
                    part.clear()
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "start", "end", "d"])

            for doc, text, variant in zip(*(b.column(c).to_pylist() for c in ("text_id", "text", "variant")), strict=True):
                raw = text.encode("utf-8")
                end = cuts(raw)
                if not len(end):
                    continue
                start = np.r_[0, end[:-1]]
                ids.append(np.full(len(end), doc, np.int64))
                starts.append(start + (variant << VARIANT))
                ends.append(end + (variant << VARIANT))
                digests += [xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                if len(digests) > 200_000:
                    yield out()
            if digests:
                yield out()

    return texts.mapInArrow(run, "doc_id long, start long, end long, d long")


def _grown(left: bytes, first_left: bytes, right: bytes, first_right: bytes) -> tuple[int, int]:
    """Bytes that a match grows to the left and right.

    Its ends stay before the first byte of a character.
    """
    n = min(len(left), len(first_left))
    low = 0
    while low < n and left[-1 - low] == first_left[-1 - low]:
        low += 1
    while low and left[-low] & 0xC0 == 0x80:
        low -= 1
    n = min(len(right), len(first_right))
    high = 0
    while high < n and right[high] == first_right[high]:
        high += 1
    # The byte after the match is not seen where the compared part ends.
    while high and (right[high] & 0xC0 == 0x80 if high < len(right) else high == REACH):
        high -= 1
    return low, high


def _extend(matches: DataFrame, texts: DataFrame) -> DataFrame:
    """``matches`` with ``start`` and ``end`` moved to the match's true edges.

    Each side is compared for ``REACH`` bytes.  A match that went on for longer
    would hold a whole chunk more, which is a match of its own.
    """

    def around(raw: str, start: Column, end: Column) -> tuple[Column, Column]:
        low = F.greatest(start - REACH, F.lit(0))
        return F.substring(F.col(raw), (low + 1).cast("int"), (start - low).cast("int")), F.substring(F.col(raw), (end + 1).cast("int"), F.lit(REACH))

    def seed(raw: str, at: Column) -> Column:
        return F.xxhash64(F.substring(F.col(raw), (at + 1).cast("int"), F.col("bytes").cast("int")))

    columns = matches.columns
    within = lambda c: F.col(c).bitwiseAND(PLACE)
    key = lambda i, c: (F.col(i) == F.col("text_id")) & (F.shiftright(c, VARIANT) == F.col("variant"))
    left, right = around("raw", within("start"), within("start") + F.col("bytes"))
    here = matches.join(texts, key("doc_id", "start")).select(*columns, left.alias("left"), right.alias("right"), seed("raw", within("start")).alias("hash"))
    first_left, first_right = around("raw", within("first_start"), within("first_start") + F.col("bytes"))
    # The digest's 64 bits and these decide that the seeds are equal.
    both = here.join(texts, key("first_id", "first_start")).where(F.col("hash") == seed("raw", within("first_start")))
    both = both.select(*columns, "left", "right", first_left.alias("first_left"), first_right.alias("first_right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [b.column(c).to_pylist() for c in ("left", "first_left", "right", "first_right")]
            grown = [_grown(*row) for row in zip(*sides, strict=True)]
            low, high = zip(*grown, strict=True) if grown else ((), ())
            new = {
                "start": pa.array(b.column("start").to_numpy() - np.array(low, np.int64)),
                "end": pa.array(b.column("end").to_numpy() + np.array(high, np.int64)),
                "first_start": pa.array(b.column("first_start").to_numpy() - np.array(low, np.int64)),
            }
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in columns], columns)

    return both.mapInArrow(run, matches.schema)


def _named(docs: DataFrame, id_col: str, text_col: str, stages: Stages) -> DataFrame:
    """text_id, text, variant of rows with an id and a text.

    Different texts of one id are variants 0, 1, ... of it in the order of a
    hash; nearly always there are none, and nothing but ids is shuffled.
    """
    told = docs.select(F.col(id_col).cast("long").alias("text_id"), F.col(text_col).alias("text")).where("text_id IS NOT NULL AND text IS NOT NULL")
    marks = told.select("text_id", F.xxhash64("text").alias("mark"))
    several = marks.groupBy("text_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo < hi").select("text_id")
    ranked = marks.join(several, "text_id", "left_semi").distinct().withColumn("variant", F.row_number().over(W.partitionBy("text_id").orderBy("mark")).cast("long") - 1)
    variants = stages.write(ranked.where("variant > 0"), "variants")
    joined = told.withColumn("mark", F.xxhash64("text")).join(variants, ["text_id", "mark"], "left")
    return joined.select("text_id", "text", F.coalesce("variant", F.lit(0).cast("long")).alias("variant"))


def passages(docs: DataFrame, id_col: str, text_col: str, passage: int) -> DataFrame:
    """``repeated_passages`` with the variant of the text that an id has several of."""
    stages = Stages(docs.sparkSession, "chunk-dedup")
    texts = _named(docs, id_col, text_col, stages)
    found = stages.write(chunks(texts), "chunks", **{"parquet.enable.dictionary": "false"})
    # Counted before the shuffle in each task: a chunk that a third of all
    # documents share is one row for each task.
    place = F.struct("doc_id", "start")
    seen = stages.write(found.groupBy("d").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    stages.release()
    # Digests that make up a ten-thousandth of all chunks are at most 10,000
    # rows: they are broadcast and their chunks stay where they are.
    total = found.count()
    hot = F.col("n") * HOT > F.lit(total)
    often = F.broadcast(seen.where(hot).select("d", "first"))
    again = found.join(often, "d").union(found.join(often, "d", "left_anti").join(seen.where(~hot).select("d", "first"), "d"))
    again = again.where(place > F.col("first")).select("doc_id", "start", "end", F.col("first.doc_id").alias("first_id"), F.col("first.start").alias("first_start"))
    again = stages.write(again, "again")
    stages.drop(found, seen)
    stages.release()
    # Chunks that touch here and at their first occurrences are one match.
    shift = F.col("start") - F.col("first_start")
    flat = again.distinct().withColumn("shift", shift)
    w = W.partitionBy("doc_id").orderBy("first_id", "shift", "start", "end")
    joins = (F.lag("first_id").over(w) == F.col("first_id")) & (F.lag("shift").over(w) == F.col("shift")) & (F.col("start") <= F.lag("end").over(w))
    lined = flat.withColumn("begins", F.when(joins, 0).otherwise(1)).withColumn("match", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    matches = lined.groupBy("doc_id", "match").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("first_id").alias("first_id"), F.min("first_start").alias("first_start"), F.count("*").alias("chunks")
    ).select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("bytes"), "first_id", "first_start", "chunks")
    matches = stages.write(matches, "matches")
    stages.drop(again)
    stages.release()
    # Repeated rows of a document are one text.
    raw = texts.select("text_id", "variant", F.col("text").cast("binary").alias("raw"))
    spans = stages.write(_extend(matches, raw).distinct(), "spans")
    stages.release()
    # Matches that touch make a passage.
    w = W.partitionBy("doc_id").orderBy("start", "end")
    fresh_run = F.when(F.col("start") <= F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), 0).otherwise(1)
    runs = spans.withColumn("begins", fresh_run).withColumn("run", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    first = F.struct(F.col("first_id").alias("doc_id"), F.col("first_start").alias("start"))
    # Of matches that start together the longest says where.
    out = runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"), F.sum("chunks").alias("chunks"),
        F.min_by(first, F.struct("start", -F.col("end"), "first_id", "first_start")).alias("first"),
    ).where(F.col("length") >= passage)
    return out.select(
        "doc_id", F.col("start").bitwiseAND(PLACE).alias("start"), "length", "chunks", F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.start").bitwiseAND(PLACE).alias("first_start"), F.shiftright("start", VARIANT).alias("variant"),
    )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """Passages that stand somewhere else before: one row for each.

    Returns doc_id, start, length (bytes of the UTF-8 text), chunks, and
    first_doc_id, first_start, where the passage's first match stands first.
    Rows that share an id and a text are one document; different texts of one
    id are searched one by one.  Null and empty texts and null ids have no
    passages; no rows give none; other columns are not read.  A passage may lie
    in one document twice: the later one counts.
    """
    return passages(docs, id_col, text_col, passage).drop("variant")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """``docs`` without the later occurrences of repeated passages.

    Rows without repeats are unchanged; a text that is a copy becomes empty.
    """
    cut, doc, mark, variant = (fresh(docs.columns, c) for c in ("spans", "doc", "mark", "variant"))
    stages = Stages(docs.sparkSession, "chunk-removal")
    names = _named(docs, id_col, text_col, stages).select(F.col("text_id").alias(doc), F.xxhash64("text").alias(mark), F.col("variant").alias(variant)).distinct()
    spans = passages(docs, id_col, text_col, passage).groupBy(F.col("doc_id").alias(doc), F.col("variant").alias(variant)).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias(cut))
    joined = docs.join(spans.join(names, [doc, variant]), (F.col(id_col) == F.col(doc)) & (F.xxhash64(text_col) == F.col(mark)), "left")
    # Byte ranges between the spans, put together again.
    raw = F.encode(F.col(text_col), "UTF-8")
    n = F.octet_length(F.col(text_col)).cast("long")
    ends = F.transform(cut, lambda s: s["start"] + s["length"])
    lows = F.concat(F.array(F.lit(0).cast("long")), ends)
    highs = F.concat(F.transform(cut, lambda s: s["start"]), F.array(n))
    kept = F.zip_with(lows, highs, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    return joined.withColumn(text_col, F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))).select(*docs.columns)
