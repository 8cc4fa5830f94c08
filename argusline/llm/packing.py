"""Packing of token sequences by minimum bin slack.

Documents become token ids with an end id; every full window of ``capacity``
ids is a sequence of its own and the rests (shorter than that) are packed.
The plan depends only on how many rests have each length, at most
``capacity - 1`` numbers however large the corpus, so it is made on the
driver: the longest rest is set, and a subset-sum bitset over the remaining
lengths (one bit for each sum, every length with its count, split in binary)
finds the multiset that leaves the least slack; backtracking through the
bitsets gives its counts.  A multiset is used as often as the counts allow, so
that the number of plan steps is bounded by the lengths, not by the documents.

Documents find their place by their rank among the rests of their length:
tasks count their own rests, the counts are summed over tasks, and nothing but
a few numbers for each piece is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusline.llm.common import Stages

END_ID = 1


#: Words that normalisation leaves as they are and that are one piece before merging.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte.

    Visible Latin-1 characters stand for themselves, the others for the
    characters from 256 on, in order.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


_LETTERS = _byte_letters()

#: ASCII marks that the vocabulary's rules always part from a letter or digit before them.
MARKS = b'.,|!%&*#$":;?'


#: Words whose ids a Python worker remembers; twice as many may take 250 MB.
REMEMBER = 400_000


class TokenBytes(dict):
    """Ids of a word as little-endian unsigned 32-bit bytes, remembered.

    The vocabulary drops white space, ignores case and none of its rules looks
    across white space, so the ids of a text are those of its words one after
    the other, and those of a word with marks at its end are the word's and the
    marks'.  At most two times ``limit`` words are kept, the recent ones.
    """

    def __init__(self, path: str, limit: int = REMEMBER):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.old = Tokenizer.from_file(path), limit, {}
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            core, text = word.rstrip(MARKS), word.decode("utf-8")
            # Other letters may end in a combining mark once they are normalised.
            if core != word and (core[-1:].isalnum() if core.isascii() else _PLAIN(core.decode("utf-8"))):
                out = self[core] + self[word[len(core) :]]
            else:
                if _PLAIN(text):  # nothing to normalise or to part: merge at once
                    ids = [t.id for t in self.model.tokenize("".join([_LETTERS[b] for b in word]))]
                else:
                    ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out = np.asarray(ids, "<u4").tobytes()
        self[word] = out
        return out

    def of(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8")
        # Lower case would turn look-alikes of special tokens into special tokens.
        return b"".join([self[w] for w in (raw if b"<|" in raw else raw.lower()).split()])


#: One for each vocabulary file, limit and Python worker, kept between tasks.
_WORDS: dict[tuple[str, int], TokenBytes] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, with_ids: bool, remember: int = REMEMBER) -> DataFrame:
    """Cut every document's ids at multiples of ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, remember) not in _WORDS:
            _WORDS[path, remember] = TokenBytes(path, remember)
        words, part = _WORDS[path, remember], TaskContext.get().partitionId()
        end, ranks = np.asarray([END_ID], "<u4").tobytes(), Counter()
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = words.of(text) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    length = len(own) // 4
                    rows.append((doc, start, length, zlib.crc32(own), n, part, ranks[length], own if with_ids else None))
                    ranks[length] += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, local long, ids binary"
    )


def best_fill(counts: dict[int, int], need: int) -> dict[int, int]:
    """The multiset of ``counts`` with the largest sum up to ``need``."""
    bits, mask, steps = 1, (1 << (need + 1)) - 1, []
    for length in sorted((x for x in counts if x <= need and counts[x]), reverse=True):
        left, k = min(counts[length], need // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, bits))
            bits |= (bits << (length * k)) & mask
            left -= k
            k *= 2
        if bits >> need & 1:
            break
    at, found = bits.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            found[length] = found.get(length, 0) + k
    return found


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Steps (multiset of lengths, how often) that use up ``counts``."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        use = Counter(best_fill(rest, capacity - longest))
        use[longest] += 1
        times = min(counts[x] // m for x, m in use.items())
        out.append((dict(use), times))
        for x, m in use.items():
            counts[x] -= m * times
            if not counts[x]:
                del counts[x]
    return out


def places(steps: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, from which rank on: (first rank, copies, sequence, offset)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequence = Counter(), 0
    for use, times in steps:
        offset = 0
        for length in sorted(use, reverse=True):
            rows.setdefault(length, []).append((used[length], use[length], sequence, offset))
            used[length] += use[length] * times
            offset += length * use[length]
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, with_ids: bool = False, remember: int = REMEMBER) -> DataFrame:
    """Pieces of all documents with their place in packed sequences.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, with ``with_ids``, the ids as little-endian unsigned 32-bit bytes.  A
    null or empty text has the end id only; ids may be null or repeat: every
    row is packed by itself.  No rows give no pieces.  Other columns are not
    read.  Workers remember the ids of at most two times ``remember`` words,
    also after the task, which changes their time and memory only.
    """
    stages = Stages(docs.sparkSession, "packing")
    cut = stages.write(pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), capacity, with_ids, remember), "pieces")
    each = stages.write(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(counts, capacity))
    before = each.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    # The counts grow with the tasks, so they are not broadcast.
    ranked = cut.join(before.hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("local"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, copies, base, off = table[int(x)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                q = rank[at] - first[i]
                sequence[at], offset[at] = base[i] + q // copies[i], off[i] + q % copies[i] * x
            keep = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset), b.column("ids")], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    out = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return out if with_ids else out.drop("ids")
