"""Collocations: phrases of two to four words, counted in HAT-tries.

Counting goes level by level: words, then pairs of frequent words, then longer
phrases whose pairs are all frequent.  Whatever is inside a frequent phrase is
as frequent, so nothing that matters is left out; what was frequent reaches the
next level's tasks as a bitmap of hashes of fixed size (a false hit only costs
a needless count).

A task gives words ids of its own and counts phrases in a trie over word ids
whose leaves are hash containers: a container bursts into one for each next
word when it grows beyond a bound.  When the trie is full its largest subtrees
are spilled whole, as runs sorted by prefix partition.  Runs are merged by prefix
partition: the prefix ends with the first word that is not among the few very
frequent ones, so that no prefix is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argusline.llm.common import Stages

#: Bits of the bitmaps of frequent words and pairs (8 MB); more of them prune better on more text.
BITS = 1 << 26
#: A word is very frequent if it is more than one of so many of all words: there are fewer of them than this.
HOT = 1000
#: Entries of a container before it bursts, and of a trie before subtrees are spilled.
BURST, FULL = 4096, 1_000_000
#: Words that a task remembers.
KNOWN = 400_000
#: Bytes of text that are worked on at once.
SLICE = 2 << 20

_BREAKS = b".,;:!?\n\x0b\x0c\r"
# Breaks become full stops and tabs spaces; then only spaces part words.
_PLAIN = bytes.maketrans(_BREAKS + b"\t", b"." * len(_BREAKS) + b" ")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words, with ``b"."`` where a piece ends."""
    return text.lower().translate(_PLAIN).replace(b".", b" . ").split()


class HatTrie:
    """Counts of sequences of word ids, each one number: its prefix's id and, in the low 32 bits, the rest.

    ``root`` maps a first word to a hash container (key to count).  A container
    that holds several prefixes bursts, when it grows, into one for each.
    """

    def __init__(self, burst: int = BURST, full: int = FULL):
        self.burst, self.full = burst, full
        self.root: dict[int, tuple[bool, dict]] = {}
        self.size: Counter[int] = Counter()

    def add(self, keys: np.ndarray, counts: np.ndarray, first: list[int] | None = None) -> None:
        """Adds distinct sorted keys; ``first`` has the first word of each prefix (none: it is the prefix)."""
        if not len(keys):
            return
        top = keys >> 32
        edges = np.flatnonzero(np.r_[True, top[1:] != top[:-1], True]).tolist()
        prefixes, keys, counts = top[edges[:-1]].tolist(), keys.tolist(), counts.tolist()
        for prefix, a, b in zip(prefixes, edges, edges[1:]):
            word = first[prefix] if first else prefix
            burst, held = self.root.get(word) or (False, {})
            leaf = held.setdefault(prefix, {}) if burst else held
            before = len(leaf)
            for k, n in zip(keys[a:b], counts[a:b]):
                leaf[k] = leaf.get(k, 0) + n
            self.size[word] += len(leaf) - before
            if not burst and first and len(held) > self.burst:
                leaves: dict[int, dict[int, int]] = {}
                for k, n in held.items():
                    leaves.setdefault(k >> 32, {})[k] = n
                burst, held = True, leaves
            self.root[word] = burst, held

    def take(self, everything: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Subtrees that leave the trie whole, largest first, until it is half empty: their keys and counts."""
        left = sum(self.size.values())
        if left <= self.full and not everything:
            return
        out: list[dict[int, int]] = []
        held_back = 0
        for word, n in self.size.most_common():
            if not everything and left <= self.full // 2:
                break
            burst, held = self.root.pop(word)
            del self.size[word]
            left -= n
            out += held.values() if burst else [held]
            held_back += n
            if held_back >= 1 << 16:
                yield self._told(out)
                out, held_back = [], 0
        if out:
            yield self._told(out)

    @staticmethod
    def _told(leaves: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        n = sum(map(len, leaves))
        return np.fromiter(chain.from_iterable(leaves), np.int64, n), np.fromiter(chain.from_iterable(x.values() for x in leaves), np.int64, n)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxhash64 of 8-byte numbers, as ``F.xxhash64`` of a long column (numbers wrap on purpose)."""
    h = (seed + _P5 + np.uint64(8)) ^ (_turn(x * _P2, 31) * _P1)
    h = _turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return hash_long(b, hash_long(a, np.full(1, 42, np.uint64)))


class Bits:
    """A set of 64-bit hashes as a bitmap, told by the rows of ``bitmap_construct_agg``."""

    def __init__(self, rows: list, bits: int):
        self.bits = bits
        self.flags = np.zeros(bits // 8, np.uint8)
        for r in rows:
            at = (r["bucket"] - 1) * 4096
            self.flags[at : at + 4096] = np.frombuffer(r["bitmap"], np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(self.bits - 1)
        return (self.flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(hashes: DataFrame, bits: int) -> Bits:
    """The bitmap of the column ``h``: ``bits / 32768`` rows of 4 KB reach the driver at most."""
    at = F.pmod("h", F.lit(bits)) + 1
    rows = hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    return Bits(rows.collect(), bits)


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes that end where pieces end."""
    start = 0
    while len(text) - start > size:
        cut = max(text.rfind(bytes([c]), start, start + size) for c in _BREAKS)
        if cut < 0:
            cut = min((at for c in _BREAKS if (at := text.find(bytes([c]), start + size)) >= 0), default=len(text))
        yield text[start : cut + 1]
        start = cut + 1
    yield text[start:]


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts, or parts of long ones, of one language at a time, about ``size`` bytes together."""
    for batch in batches:
        held: dict[str, list] = {}
        room = size
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in _parts(text.as_py(), size):
                held.setdefault(lang, []).append(part)
                room -= len(part)
                if room <= 0:
                    yield from held.items()
                    held, room = {}, size
        yield from held.items()


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("phrase", F.col("phrase").cast("string"))


def count_words(texts: DataFrame) -> DataFrame:
    """``lang, phrase, f`` of every word of ``lang, text``, summed by task: rows still to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                words = sorted(c)
                for i in range(0, len(words), 1 << 16):
                    part = words[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array([c[w] for w in part], pa.int64())], ["lang", "phrase", "f"])
            held.clear()

        for lang, some in _slices(batches, SLICE):
            c = held.setdefault(lang, Counter())
            for t in some:
                c.update(words_of(t))
            c.pop(b".", None)
            if sum(map(len, held.values())) > KNOWN:
                yield from out()
        yield from out()

    return _as_text(texts.mapInArrow(run, "lang string, phrase binary, f long"))


class Words:
    """A task's ids of frequent words; ``-1`` stands for rare ones and for the ends of pieces."""

    def __init__(self, frequent: Bits, hot: set[tuple[str, bytes]]):
        self.frequent, self.hot_words = frequent, hot
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, dict[bytes, int]] = {}
        self.names: list[bytes] = []
        self.langs: list[str] = []
        self.hashes, self.hot = np.zeros(0, np.uint64), np.zeros(0, bool)

    def __len__(self) -> int:
        return sum(map(len, self.ids.values()))

    def sequence(self, lang: str, told: list[bytes]) -> np.ndarray:
        known = self.ids.setdefault(lang, {b".": -1})
        new = list(set(told).difference(known))
        if new:
            seed = xxhash.xxh64_intdigest(lang.encode("utf-8"), 42)
            h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in new), np.uint64, len(new))
            good = self.frequent.holds(h)
            known.update(dict.fromkeys(new, -1))
            kept = [w for w, g in zip(new, good.tolist(), strict=True) if g]
            known.update(zip(kept, range(len(self.names), len(self.names) + len(kept)), strict=True))
            self.names += kept
            self.langs += [lang] * len(kept)
            self.hashes = np.r_[self.hashes, h[good]]
            self.hot = np.r_[self.hot, [(lang, w) in self.hot_words for w in kept]].astype(bool)
        return np.fromiter(map(known.__getitem__, told), np.int64, len(told))


def count_phrases(texts: DataFrame, words: Broadcast, pairs: Broadcast | None, hot: set[tuple[str, bytes]]) -> DataFrame:
    """Runs ``part, lang, phrase, f`` to be merged by ``part``.

    Counts pairs of words of the bitmap ``words`` or, if the bitmap ``pairs`` is
    given, phrases of three and four words all of whose pairs are in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = HatTrie(), Words(words.value, hot)
        pair_ids: dict[int, int] = {}  # of a good pair's two word ids
        pair_words: list[int] = []  # the same, by id
        first: list[int] = []  # word of each pair

        def runs(everything: bool) -> Iterator[pa.RecordBatch]:
            names = langs = None
            for keys, n in trie.take(everything):
                if names is None:
                    names, langs = pa.array(known.names, pa.binary()), pa.array(known.langs, pa.string())
                top, rest = keys >> 32, keys & 0xFFFFFFFF
                if pairs is None:
                    columns = [top, rest]
                else:
                    two = np.array(pair_words, np.int64)
                    longer = rest >> 31 == 1  # the rest is a pair, else a word
                    end = np.where(longer, two[np.where(longer, rest & 0x7FFFFFFF, 0)], rest << 32)
                    columns = [two[top] >> 32, two[top] & 0xFFFFFFFF, end >> 32, np.where(longer, end & 0xFFFFFFFF, -1)]
                # The prefix ends with the first word that is not very frequent.
                part, going = np.zeros(len(keys), np.uint64), np.ones(len(keys), bool)
                for c in columns:
                    going &= c >= 0
                    part[going] = pair_hash(part[going], known.hashes[c[going]])
                    going &= known.hot[np.maximum(c, 0)]
                part = (part >> np.uint64(40)).astype(np.int32)
                order = np.lexsort((keys, part))
                text = None
                for c in columns:
                    word = names.take(pa.array(c[order], mask=c[order] < 0))
                    text = word if text is None else pc.binary_join_element_wise(text, word, b" ", null_handling="skip")
                lang = langs.take(pa.array(columns[0][order]))
                yield pa.RecordBatch.from_arrays([pa.array(part[order]), lang, text, pa.array(n[order])], ["part", "lang", "phrase", "f"])

        for lang, some in _slices(batches, SLICE):
            if len(known) > KNOWN or len(first) > KNOWN:
                yield from runs(True)
                known.clear()
                pair_ids, pair_words, first = {}, [], []
            told = []
            for t in some:
                told += words_of(t)
                told.append(b".")
            seq = known.sequence(lang, told)
            del told
            hi = (seq[:-1] << 32) | seq[1:]
            ok = (seq[:-1] >= 0) & (seq[1:] >= 0)
            if pairs is None:
                trie.add(*np.unique(hi[ok], return_counts=True))
                yield from runs(False)
                continue
            h = known.hashes
            ok[ok] = pairs.value.holds(pair_hash(h[seq[:-1][ok]], h[seq[1:][ok]]))
            two, back = np.unique(hi[ok], return_inverse=True)
            for p in two.tolist():
                if p not in pair_ids:
                    pair_ids[p] = len(pair_words)
                    pair_words.append(p)
                    first.append(p >> 32)
            at = np.full(len(hi), -1, np.int64)
            at[ok] = np.fromiter(map(pair_ids.__getitem__, two.tolist()), np.int64, len(two))[back]
            three = ok[:-1] & ok[1:]
            four = three[:-1] & ok[2:]
            keys = np.r_[(at[:-1][three] << 32) | seq[2:][three], (at[:-2][four] << 32) | (1 << 31) | at[2:][four]]
            trie.add(*np.unique(keys, return_counts=True), first)
            yield from runs(False)
        yield from runs(True)

    return _as_text(texts.mapInArrow(run, "part int, lang string, phrase binary, f long"))


def frequent_phrases(docs: DataFrame, least: int, lang_col: str, text_col: str, bits: int, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """Counts ``lang, phrase, words, f`` of all phrases of 1 to 4 words found ``least`` times, and ``lang, n``."""
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(lang.alias("lang"), text.cast("binary").alias("text"))
    every = stages.write(count_words(texts).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    total = stages.write(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    word = stages.write(every.where(F.col("f") >= least), "frequent")
    stages.drop(every)
    all_words = total.agg(F.sum("n")).first()[0] or 0
    hot = {(r.lang, r.phrase.encode("utf-8")) for r in word.where(F.col("f") > all_words // HOT).collect()}
    context = docs.sparkSession.sparkContext
    words = context.broadcast(bitmap(word.select(F.xxhash64("lang", "phrase").alias("h")), bits))

    def merged(runs: DataFrame) -> DataFrame:
        # Dealt by the prefix once; the sum needs no other shuffle.
        return runs.repartition("part").groupBy("part", "lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least).drop("part")

    two = stages.write(merged(count_phrases(texts, words, None, hot)), "pairs")
    each = [F.xxhash64("lang", F.split_part("phrase", F.lit(" "), F.lit(i))) for i in (1, 2)]
    pairs = context.broadcast(bitmap(two.select(F.xxhash64(*each).alias("h")), bits))
    more = stages.write(merged(count_phrases(texts, words, pairs, hot)), "phrases")
    return word.unionByName(two).unionByName(more).withColumn("words", F.split("phrase", " ", -1)), total


def score_of(scale: int) -> Column:
    """``floor(scale * a / (l + r))`` by whole-number division of decimals: nothing is rounded."""
    return F.expr(f"(cast({scale} as decimal(12,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")


def collocations(
    docs: DataFrame,
    least: int = 30,
    most: int = 2000,
    overlap: int = 80,
    scale: int = 2_000_000,
    lang_col: str = "lang",
    text_col: str = "text",
    bits: int = BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``most`` phrases.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces,
    those at spaces and tabs into words.  A phrase of 2 to 4 words of one piece
    with ``a >= least`` occurrences is a candidate; its score is the smallest
    ``floor(scale * a / (l + r))`` over its cuts into a first part (found ``l``
    times) and a rest (``r``), the earliest cut of ties.  A candidate goes if a
    longer one holds its words and has ``overlap`` hundredths of its count.
    Rows go by score and ``a``, downwards, then by the phrase's bytes.

    A null language is ``und``; null and empty texts have no words; repeated
    rows count as often as they stand; a text of any length is read whole; an
    empty table gives an empty table; only the language and the text are read,
    so further columns may have any names.  Products are decimals of 38 digits.
    """
    stages = Stages(docs.sparkSession, "phrases")
    counted, total = frequent_phrases(docs, least, lang_col, text_col, bits, stages)
    m = F.size("words")
    candidates = counted.where(m > 1).select("lang", "phrase", F.col("f").alias("a"), "words")

    def part(start: Column | int, size: Column) -> Column:
        return F.array_join(F.slice("words", start, size), " ")

    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, m).alias("right"))
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score_of(scale).alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    inner = candidates.where(m > 2).select("lang", F.col("a").alias("longer"), "words", F.explode(F.sequence(F.lit(2), m - 1)).alias("k"))
    inner = inner.select("lang", "longer", "words", "k", F.explode(F.sequence(F.lit(1), m - F.col("k") + 1)).alias("at"))
    inner = inner.select("lang", "longer", part(F.col("at"), F.col("k")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(f"longer IS NULL OR cast(100 as decimal(5,0)) * cast(longer as decimal(20,0)) < cast({overlap} as decimal(5,0)) * cast(a as decimal(20,0))")

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
