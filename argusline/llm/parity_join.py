"""N-gram Jaccard join with parity sketches.

Two documents link when ``den * |A & B| >= num * |A | B|`` over their distinct
word shingles.  The join finds every link without comparing all pairs:

* **Sketch.**  A set is hashed into ``k`` words of 64 bits; every shingle is
  XORed into one of them.  A shingle that is in one set only changes at most
  one word, so the number of differing words is at most ``|A ^ B|``.
* **Size bands.**  Linked sets have ``|A ^ B| <= s * (den - num) / num`` with
  ``s`` the smaller size.  A band of sizes fixes ``d``, the largest such bound
  in it, and ``k = d + 1 + slack``.  By the pigeonhole principle linked sets
  share more than ``slack`` unchanged words.  A set joins the band of its own
  size and those of the smaller sizes that it may link to.
* **Empty words.**  Words without shingles would be hot keys.  They are left
  out unless a set has more than ``slack`` of them: of two linked sets either
  one has at most ``slack``, and then they share a filled word, or both state
  their empty words.  Nothing is lost.
* **Verification.**  Candidate pairs are sifted by bit-level parity sketches,
  whose Hamming distance is a lower bound too; those that remain are verified
  on the whole sets.

For components a pivot of each group is verified against the others first, in
a round or two, and only members of *different* components go on.  Groups of up to
``BLOCK`` members are then compared by their bits.  Members of larger groups
that are not in their group's largest component seek partners anew by their
rarest shingles: so many of them that the rest would not suffice for a link.
Shingles that nobody else has make no group, so near copies that differ too
much to link are not even candidates.  What is still large then is cut into
blocks and compared block by block, so that no link is lost, whatever the data.

Equal sets are one class from the start, represented by one row.  Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusline.llm.common import Stages
from argusline.llm.components import components
from argusline.llm.shingles import WordHashes, digests, mix, shingle_sets

#: Members of a group that are compared at once.
BLOCK = 512
#: Narrow bands in the range of smaller sizes that a set may link to.
NARROW = 4
#: Counters of shingles that say which are rare.
BUCKETS = 1 << 18
#: Texts whose digest a task remembers, to state the sets of copies once.
SEEN = 50_000
#: Texts and characters that are worked on at once.
SLICE, SLICE_CHARS = 256, 1 << 20
#: Pairs of members, and 64-bit words of their sketches, that are compared at once.
PAIRS, WORDS = 1 << 16, 1 << 18
#: Rows of sets that are read from a file at once.
READ = 256
#: Hashes do not repeat enough for dictionaries.  What is read of a file at once, a
#: column of a row group, takes memory beside the heap, so row groups are small.
PLAIN = {"parquet.enable.dictionary": "false", "parquet.block.size": str(4 << 20)}
#: Sets, in sorted order or as bits, do not shrink either.
SETS = PLAIN | {"compression": "uncompressed"}


def _likely_empty(n: int, k: int, slack: int) -> bool:
    """Whether over ``slack`` of ``k`` words may stay empty with ``n`` shingles.

    The union bound over the choices of ``slack + 1`` empty words, held against
    one in a thousand.  It only steers how often empty words are stated.
    """
    e = slack + 1
    if e >= k:
        return False
    ways = math.lgamma(k + 1) - math.lgamma(e + 1) - math.lgamma(k - e + 1)
    return ways + n * math.log1p(-e / k) > math.log(1e-3)


class Bands:
    """Size bands; ``of(n)`` gives (band, number of words, slack) to join."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low: list[int] = [1]
        self.plan: list[tuple[int, int, int]] = []
        self.known: dict[int, list[tuple[int, int, int]]] = {}

    def _grow(self, n: int) -> None:
        while self.low[-1] <= n or len(self.plan) < len(self.low) - 1:
            low = self.low[-1]
            high = max(low + 1, low * 3 // 2)
            d = (high - 1) * (self.den - self.num) // self.num
            slack = 0
            while d and _likely_empty(low, d + 1 + slack, slack):
                slack += 1
            self.plan.append((d, d + 1 + slack, slack))
            self.low.append(high)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        if n in self.known:
            return self.known[n]
        self._grow(n)
        least = -(-n * self.num // self.den)
        i = int(np.searchsorted(self.low, n, side="right")) - 1
        out = self.known[n] = []
        while i >= 0 and self.low[i + 1] - 1 >= least:
            d, k, slack = self.plan[i]
            if d:  # with d = 0 only equal sets link
                out.append((i, k, slack))
            i -= 1
        return out


def words_of(sets: list[np.ndarray], band: int, k: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the filled words of each set's sketch, and of the empty ones if many.

    Returns the keys and how many each set has.
    """
    s = np.concatenate(sets)
    place = np.repeat(np.arange(len(sets)) * k, [len(x) for x in sets])
    place += ((mix(s + np.uint64(band)) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    value = np.zeros(len(sets) * k, np.uint64)
    np.bitwise_xor.at(value, place, s)
    filled = (np.bincount(place, minlength=len(value)) > 0).reshape(-1, k)
    stated = filled | (k - filled.sum(axis=1) > slack)[:, None]
    keys = mix(value.reshape(-1, k) ^ mix(np.arange(k, dtype=np.uint64) + np.uint64(band << 32)))
    return keys[stated], stated.sum(axis=1)


def bit_sketches(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each set, 8 to 16 for each ninth shingle, a power of two long.

    Returns 64-bit words and how many each set has.
    """
    m = np.array([1 << max(6, int(n * 8 / 9).bit_length()) for n in sizes.tolist()], np.int64)
    begin = np.cumsum(m) - m
    at = (mix(flat ^ np.uint64(0xA5A5)) & np.repeat(m - 1, sizes).astype(np.uint64)).astype(np.int64)
    bits = np.bincount(at + np.repeat(begin, sizes), minlength=int(m.sum())) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64), m // 64


def _lists(flat: np.ndarray, sizes: np.ndarray, given: np.ndarray | None = None) -> pa.ListArray:
    """64-bit lists of the given sizes; null where not ``given`` (of size 0 there)."""
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    mask = None if given is None else pa.array(~given)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)), mask=mask)


def whole_runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Sorted rows as they come, cut only where one of the columns ``by`` changes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if held and any(held[-1].column(c)[-1].as_py() != v[0] for c, v in zip(by, cols, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            yield pa.Table.from_batches([*held, b.slice(0, cuts[-1])])
            held = []
        held.append(b.slice(cuts[-1] if len(cuts) else 0))
    if held:
        yield pa.Table.from_batches(held)


def near_in_cells(cells: pa.Table, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of differently labelled members of a cell, as sizes and bits allow.

    ``cells`` has key, i, j, cid, label, blk, n, bits, and the rows of a cell
    together.  A cell of two blocks pairs members of different ones.
    """
    key, i, j, cid, label, blk, n = (cells.column(c).to_numpy() for c in ("key", "i", "j", "cid", "label", "blk", "n"))
    lists = cells.column("bits").combine_chunks()
    bits, begin = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
    begin, wide = begin[:-1] - begin[0], np.diff(begin)
    rows = np.arange(len(key))
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    end = np.repeat(np.r_[first[1:], len(key)], np.diff(np.r_[first, len(key)]))
    many = end - rows - 1  # later members of the row's cell
    upto, at = np.cumsum(many), 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - many[at] + PAIRS, side="right")))
        own = many[at:to]
        p = np.repeat(rows[at:to], own)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(own) - own, own)
        at = to
        good = (label[p] != label[q]) & ((i[p] == j[p]) | (blk[p] != blk[q])) & (np.minimum(n[p], n[q]) * den >= num * np.maximum(n[p], n[q]))
        p, q = p[good], q[good]
        # The longer sketch first; it is folded, which keeps the bound.
        p, q = np.where(wide[p] < wide[q], q, p), np.where(wide[p] < wide[q], p, q)
        outs = [np.empty((2, 0), np.int64)]
        both = wide[p] << 32 | wide[q]
        for w, v in ((x >> 32, x & (1 << 32) - 1) for x in np.unique(both).tolist()):
            these = np.flatnonzero(both == (w << 32 | v))
            for k in range(0, len(these), max(1, WORDS // w)):
                x, y = p[these[k : k + max(1, WORDS // w)]], q[these[k : k + max(1, WORDS // w)]]
                long = np.bitwise_xor.reduce(bits[begin[x][:, None] + np.arange(w)].reshape(-1, w // v, v), axis=1)
                apart = np.bitwise_count(long ^ bits[begin[y][:, None] + np.arange(v)]).sum(axis=1, dtype=np.int64)
                near = apart * (den + num) <= (den - num) * (n[x] + n[y])
                x, y = cid[x[near]], cid[y[near]]
                outs.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
        a, c = np.concatenate(outs, axis=1)
        if len(a):
            yield a, c


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold few texts and, but for single texts, few characters."""
    at = chars = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()):
        if i > at and (i - at >= SLICE or chars + n > SLICE_CHARS):
            yield b.slice(at, i - at)
            at, chars = i, 0
        chars += n
    if at < b.num_rows:
        yield b.slice(at)


def _folded(x: str, y: str) -> str:
    """SQL: ``x`` folded to the length of ``y`` if it is twice as long.

    The place of a bit is its hash modulo the length, so halves fold.
    """
    return f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"


class ParityJoin:
    """Links and components of similar texts.

    ``width`` words a shingle; links at ``num / den`` or more.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.width, self.num, self.den = width, num, den
        self.stages = Stages(self.spark, "parity-join")
        st = self.stages
        self.texts = st.write(self.sets(), "texts", batch=1000, **SETS)
        # The first row of equal sets represents them; it always holds the set.
        told = self.texts.where("doc_id IS NOT NULL AND n > 0")
        self.classes = st.write(told.groupBy("d1", "d2").agg(F.min("row").alias("cid"), F.min("doc_id").alias("first"), F.min("n").alias("n")), "classes")

    # -- the pass over the texts -----------------------------------------------
    def sets(self) -> DataFrame:
        """A row for each document: row, doc_id, n, d1, d2, and bits and items.

        Copies of a text that the task has seen before hold no bits and items.
        """
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, seen, row = WordHashes(60_000), set(), TaskContext.get().partitionId() << 40
            for whole in batches:
                for b in _slices(whole):
                    flat, sizes = shingle_sets(b.column("text").to_pylist(), width, words)
                    ends = np.cumsum(sizes)
                    sets = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    marks = [digests(s) for s in sets]
                    new = np.zeros(len(sets), bool)
                    for i, (doc, d) in enumerate(zip(b.column("doc_id").to_pylist(), marks, strict=True)):
                        both = d[0] << 64 | d[1] & (1 << 64) - 1
                        if doc is not None and sizes[i] and both not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(both)
                            new[i] = True
                    held = np.concatenate([s for s, x in zip(sets, new, strict=True) if x] or [flat[:0]])
                    kept = np.where(new, sizes, 0)
                    bits, many = bit_sketches(held, sizes[new])
                    count = np.zeros(len(sets), np.int64)
                    count[new] = many
                    d1, d2 = (pa.array([d[i] for d in marks], pa.int64()) for i in (0, 1))
                    rows = pa.array(np.arange(row, row + len(sets)))
                    row += len(sets)
                    yield pa.RecordBatch.from_arrays(
                        [rows, b.column("doc_id"), pa.array(sizes), d1, d2, _lists(bits, count, new), _lists(held, kept, new)],
                        ["row", "doc_id", "n", "d1", "d2", "bits", "items"],
                    )

        return self.docs.mapInArrow(run, "row long, doc_id long, n long, d1 long, d2 long, bits array<long>, items array<long>")

    def keys(self) -> DataFrame:
        """Sketch words of every set: key, h (the set's first digest)."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bands = Bands(num, den)
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    b = whole.slice(at, SLICE)
                    flat, offsets = b.column("items").values.to_numpy().view(np.uint64), b.column("items").offsets.to_numpy()
                    h, own = b.column("d1").to_numpy(), {}
                    for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                        for plan in bands.of(y - x):
                            own.setdefault(plan, []).append((i, flat[x:y]))
                    for plan, members in own.items():
                        keys, many = words_of([s for _, s in members], *plan)
                        hs = np.repeat(h[[i for i, _ in members]], many)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(hs)], ["key", "h"])

        return self.texts.where("items IS NOT NULL").select("d1", "items").mapInArrow(run, "key long, h long")

    # -- groups of sets that share a sketch word -------------------------------
    def groups(self) -> DataFrame:
        """key, cid of every sketch word that two or more classes share.

        Rows are dealt by key and sorted, so that a task sees a key's members
        in one run and holds one batch at a time, however large the group.
        """

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last_key = last_h = None
            open_ = False  # whether the last row has been given out already
            for b in batches:
                if not b.num_rows:
                    continue
                key, h = b.column("key").to_numpy(), b.column("h").to_numpy()
                new = np.r_[last_key is None or (key[0], h[0]) != (last_key, last_h), (key[1:] != key[:-1]) | (h[1:] != h[:-1])]
                key, h = key[new], h[new]
                if not len(key):
                    continue
                same = key[1:] == key[:-1]
                joined = last_key is not None and key[0] == last_key
                keep = np.r_[joined, same] | np.r_[same, False]
                out_k, out_h = key[keep], h[keep]
                if joined and not open_:
                    out_k, out_h = np.r_[last_key, out_k], np.r_[last_h, out_h]
                last_key, last_h, open_ = key[-1], h[-1], bool(keep[-1])
                yield pa.RecordBatch.from_arrays([pa.array(out_k), pa.array(out_h)], ["key", "h"])

        st = self.stages
        found = st.write(self.keys().repartition("key").sortWithinPartitions("key", "h").mapInArrow(runs, "key long, h long"), "words", batch=2000, read=READ, **PLAIN)
        st.release()
        # Keys with the same members say the same: one of them is enough.
        sign = found.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h")).alias("y"), F.min("h").alias("z"))
        one = sign.groupBy("m", "x", "y", "z").agg(F.min("key").alias("key")).select("key")
        out = st.write(found.join(one, "key", "left_semi").join(self.classes.select(F.col("d1").alias("h"), "cid", "n"), "h").select("key", "cid", "n"), "groups")
        st.drop(found)
        return out

    def refined(self, members: DataFrame, seekers: DataFrame) -> DataFrame:
        """key, cid, n: groups of ``members`` (cid, n) by rare shingles of ``seekers``.

        Sets of ``n`` and ``m`` shingles that link have at least
        ``num * (n + m) / (num + den)`` of them in common, so of any ``n + 1``
        less so many of one set the other has one.  Seekers, which are members
        too, take the rarest for that, as many as partners in each of some
        narrow bands of sizes make needed; members with such a shingle and a
        size in its band join them.  How rare a shingle is, is read from
        ``BUCKETS`` counters, which decide how many candidates there are, not
        which links are found.
        """
        st, num, den = self.stages, self.num, self.den
        step = math.log(den / num) / NARROW
        sets = lambda who: who.join(self.texts.select("row", "items"), F.col("cid") == F.col("row")).select("cid", "n", "items")
        # Written, so that the sets are not shuffled where few of them are wanted.
        seekers, members = st.write(seekers, "seekers"), st.write(members, "members")
        asked = sets(seekers)
        counts = asked.select(F.explode("items").alias("item")).select(F.pmod("item", F.lit(BUCKETS)).alias("b")).groupBy("b").agg(F.count("*").alias("c")).toArrow()
        counters = np.zeros(BUCKETS, np.int64)
        counters[counts.column("b").to_numpy()] = counts.column("c").to_numpy()
        shared = self.spark.sparkContext.broadcast(counters)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out, held = [], 0
                for i, (cid, n) in enumerate(zip(b.column("cid").to_pylist(), b.column("n").to_pylist(), strict=True)):
                    s = b.column("items").slice(i, 1).flatten().to_numpy()
                    order = s[np.lexsort((s, shared.value[s % BUCKETS]))]
                    least, most = -(-n * num // den), n * den // num
                    bands = np.arange(math.floor(math.log(least) / step + 1e-9), math.floor(math.log(most) / step + 1e-9) + 1)
                    # The smallest size in a band; slightly less does no harm.
                    low = np.maximum(np.floor(np.exp(bands * step) - 1e-6), least)
                    many = (n + 1 - np.ceil(num * (low + n) / (num + den) - 1e-6)).astype(np.int64)
                    items = np.concatenate([order[:k] for k in many.tolist()])
                    out.append((items, np.repeat(bands, np.minimum(many, n)), np.full(len(items), cid), np.full(len(items), n)))
                    held += len(items)
                    if held > 100_000 or i == b.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["item", "band", "cid", "n"])
                        out, held = [], 0

        stated = st.write(asked.mapInArrow(run, "item long, band long, cid long, n long"), "stated", batch=1000, read=READ, **PLAIN)
        own = F.floor(F.log("n") / step + 1e-9)
        met = sets(members).select("cid", "n", own.alias("band"), F.explode("items").alias("item")).join(stated.select("item", "band").distinct(), ["item", "band"], "left_semi")
        rows = stated.select("item", "band", "cid", "n").union(met.select("item", "band", "cid", "n"))
        out = st.write(rows.select(F.xxhash64("band", "item").alias("key"), "cid", "n").distinct(), "refined", read=READ)
        st.drop(seekers, members, stated)
        return out

    # -- verification -----------------------------------------------------------
    def sift(self, pairs: DataFrame) -> DataFrame:
        """Pairs that the sizes and the bit sketches allow to link."""
        num, den = self.num, self.den
        side = lambda i, n, o: self.texts.select(F.col("row").alias(i), F.col("n").alias(n), F.col("bits").alias(o))
        both = pairs.join(side("b", "m", "y"), "b").join(side("a", "n", "x"), "a")
        apart = f"aggregate(zip_with({_folded('x', 'y')}, {_folded('y', 'x')}, (p, q) -> bit_count(p ^ q)), 0, (s, p) -> s + p)"
        return both.where(f"least(n, m) * {den} >= {num} * greatest(n, m)").where(f"{apart} * {den + num} <= {den - num} * (n + m)").select("a", "b")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b) those that link, on whole sets."""
        num, den = self.num, self.den
        # Few classes are in pairs at this point: only their sets are moved.
        st = self.stages
        named = st.write(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "row"), "named")
        own = st.write(self.texts.select("row", "items").join(named, "row", "left_semi"), "own", read=READ, **SETS)
        side = lambda i, o: own.select(F.col("row").alias(i), F.col("items").alias(o))
        both = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("all"))
        good = st.write(both.where(f"{den} * common >= {num} * (all - common)").select("a", "b").distinct(), "links", read=READ)
        st.drop(named, own)
        return good

    def cells(self, groups: DataFrame) -> DataFrame:
        """Pairs of differently labelled members of a group, as the bits allow.

        ``groups`` has key, cid, n, label.  A group of more than ``BLOCK``
        members is cut into blocks, and a cell holds two of them.
        """
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # The last cell of a batch may go on in the next one.
            for cells in whole_runs(batches, ["key", "i", "j"]):
                for a, c in near_in_cells(cells, num, den):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

        size = groups.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
        placed = groups.join(size, "key").withColumn("blk", F.pmod(F.hash("cid"), "blocks"))
        # A group of one block, as nearly all are, is not dealt any further.
        single = placed.where("blocks = 1").select("key", "cid", "label", "n", "blk", F.lit(0).alias("i"), F.lit(0).alias("j"))
        many = placed.where("blocks > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
            "key", "cid", "label", "n", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j")
        )
        rows = single.union(many).join(self.texts.select(F.col("row").alias("cid"), "bits"), "cid")
        # Rows of a cell follow each other, so that a task holds a cell and a batch, not lists of cells.
        dealt = rows.select("key", "i", "j", "cid", "label", "blk", "n", "bits").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return dealt.mapInArrow(run, "a long, b long").distinct()

    # -- components -------------------------------------------------------------
    def shared_ids(self) -> DataFrame:
        """Links a, b between the classes of texts that share an id."""
        told = self.texts.where("doc_id IS NOT NULL AND n > 0").join(self.classes, ["d1", "d2"]).select("doc_id", "cid")
        least = told.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a < b").select("doc_id", "a")
        return told.join(least, "doc_id").where("cid != a").select("a", F.col("cid").alias("b")).distinct()

    def roots(self) -> DataFrame:
        """cid, root of every class that is linked with others."""
        st = self.stages
        forest = components(self.shared_ids(), "a", "b", st).withColumnRenamed("node", "cid")
        forest = st.write(forest, "roots")

        def labelled(groups: DataFrame) -> DataFrame:
            """Members of groups with the component that each is in."""
            return groups.join(forest, "cid", "left").select("key", "cid", "n", F.coalesce("root", "cid").alias("label"))

        def live(groups: DataFrame, turn: int) -> DataFrame:
            """Members of the groups that still hold different components."""
            now, mark = labelled(groups), F.xxhash64("cid", F.lit(turn))
            split = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.min_by("cid", mark).alias("pivot"), F.min_by("label", mark).alias("plabel")).where("lo < hi").drop("lo", "hi")
            return st.write(now.join(split, "key"), "active")

        def linked(pairs: DataFrame) -> bool:
            """Takes the links among candidate pairs into the forest."""
            nonlocal forest
            pairs = st.write(pairs, "pairs", batch=500)
            left = st.write(self.sift(pairs), "left")
            if left.isEmpty():
                st.drop(pairs, left)
                st.release()
                return False
            good = self.verify(left)
            st.drop(pairs, left)
            st.release()
            if good.isEmpty():
                return False
            name = lambda df, c: df.join(forest.select(F.col("cid").alias(c), F.col("root").alias(f"{c}r")), c, "left").withColumn(c, F.coalesce(f"{c}r", c)).drop(f"{c}r")
            above = components(name(name(good, "a"), "b"), "a", "b", st).withColumnRenamed("node", "cid")
            higher = forest.join(above.select(F.col("cid").alias("root"), F.col("root").alias("top")), "root", "left").select("cid", F.coalesce("top", "root").alias("root"))
            forest = st.write(higher.union(above.join(forest, "cid", "left_anti").select("cid", "root")), "roots")
            st.release()
            return True

        groups = self.groups()
        st.release()
        for last in (False, True):
            for turn in range(1 if last else 2):
                active = live(groups, turn)
                linked(active.where("label != plabel").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct())
                st.drop(groups)
                groups = active.select("key", "cid", "n")
            active = live(groups, 2)
            if active.isEmpty():
                break
            small = active if last else active.where(F.col("m") <= BLOCK)
            linked(self.cells(small.select("key", "cid", "n", "label")))
            large = active.where(F.col("m") > BLOCK).select("key", "cid", "n")
            if last or large.isEmpty():
                break
            large = live(large, 3)
            votes = large.groupBy("key", "label").agg(F.count("*").alias("v")).groupBy("key").agg(F.max_by("label", F.struct("v", "label")).alias("main"))
            seekers = large.join(votes, "key").where("label != main").select("cid", "n").distinct()
            groups = self.refined(large.select("cid", "n").distinct(), seekers)
        return forest

    def links(self) -> DataFrame:
        """a, b: every pair of linked classes (``cid`` of ``classes``), a < b.

        Near copies of different texts all link with each other, so there may
        be many; equal texts are one class and are not expanded.
        """
        st, groups = self.stages, self.groups()
        m = groups.groupBy("key").agg(F.count("*").alias("m"))
        sized = st.write(groups.join(m, "key").withColumn("label", F.col("cid")), "sized")
        pairs = self.cells(sized.where(F.col("m") <= BLOCK))
        large = sized.where(F.col("m") > BLOCK).select("cid", "n").distinct()
        large = self.refined(large, large)
        pairs = pairs.union(self.cells(large.withColumn("label", F.col("cid"))))
        return self.verify(st.write(pairs.distinct(), "pairs", batch=500))

    def membership(self) -> DataFrame:
        """doc_id, cid of every row with an id and words."""
        return self.texts.where("doc_id IS NOT NULL AND n > 0").join(self.classes, ["d1", "d2"]).select("doc_id", "cid")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row of the documents."""
        roots = self.roots()
        joined = self.classes.join(roots, "cid")
        least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
        top = joined.join(least, "root").select("d1", "d2", "component_id").unionByName(self.classes.join(roots, "cid", "left_anti").select("d1", "d2", F.col("first").alias("component_id")))
        top = self.stages.write(top, "components")
        told = F.col("doc_id").isNotNull() & (F.col("n") > 0)
        out = self.texts.where(told).join(top, ["d1", "d2"]).select("doc_id", "n", "component_id")
        rest = self.texts.where(~told).select("doc_id", "n", F.col("doc_id").alias("component_id"))
        return out.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links.  Null ids give a
    null component; null and empty texts link with nothing; rows that share an
    id are one node; repeated rows give repeated results; an empty table gives
    an empty result.  Other columns of ``docs`` are not read, so their names
    cannot clash.
    """
    return ParityJoin(docs, id_col, text_col, width, num, den).run()


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(links, membership): every link between different texts, and who has them.

    Links are pairs a < b of class numbers; membership gives each row's class
    number.  Rows without an id or words are in neither.
    """
    join = ParityJoin(docs, id_col, text_col, width, num, den)
    return join.links(), join.membership()
