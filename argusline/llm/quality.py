"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every whole text.  Their
votes overlap and err; expectation-maximisation over the counts of vote
patterns (a table of at most ``3 ** labellers`` rows, counted over all texts)
estimates how often each labeller says what on good and bad texts, and so the
posterior of every pattern.  The posteriors are soft labels for a linear
scorer over hashed words, word shapes and word ends, which then scores every
text: a text's score is a mean over its words, so any length costs one pass;
the share of words that repeat the one before is a feature of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argusline.llm.common import Stages, fresh

#: Documents that the linear scorer is fitted on, at most.
SAMPLE = 2000
DIM = 1 << 14

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it on with as was by be this at from or are an "
    "le la les de des du et un une en que qui dans pour par sur pas au aux il elle avec "
    "der die das und zu den von mit sich auf für nicht ein eine dem im ist es auch "
    "el los las del y que no por con su se para al lo como más".split()
)
_STOPS = frozenset(w.encode() for w in STOP_WORDS)
_SYMBOLS = b"#$%&*<>{}[]=+~^_\\@|"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))

LABELLERS = ("symbols", "capitals", "separators", "stop_words", "word_length", "repetition", "exclamation", "sentences")


def votes(text: str | None) -> list[int]:
    """A vote of each labeller: 1 good, -1 bad, 0 none (as on short texts)."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    n, nw = len(raw), len(words)
    if nw < 5:
        return [0] * len(LABELLERS)
    rate = lambda marks: (n - len(raw.translate(None, marks))) / n
    upper, lower = rate(_UPPER), rate(_LOWER)
    low = raw.lower().split()
    once = [a for a, b in zip(low, [b"", *low]) if a != b]  # without repeats in a row
    stops = sum(w in _STOPS for w in once) / len(once)
    ends = sum(w[-1:] in b".?" for w in once) / len(once)
    # What praises running text has nothing to say on mere repetition.
    repetitive = nw >= 10 and nw - len(once) > 0.25 * nw
    bangs = raw.count(b"!") / nw
    length = (n - nw) / nw

    def vote(bad: bool, good: bool) -> int:
        return -1 if bad else int(good and not repetitive)

    # Alarms say bad or nothing: most bad texts are bad in one way only.
    return [
        vote(rate(_SYMBOLS) > 0.05, False),
        vote(upper > 0.5 * (upper + lower), False),
        vote((raw.count(b"|") + raw.count(b"\t")) / nw > 0.2, False),
        vote(nw >= 20 and stops < 0.06, stops > 0.15),
        vote(not 2.5 <= length <= 11, 3.5 <= length <= 8),
        vote(repetitive, False),
        vote(bangs > 0.15, False),
        vote(nw >= 60 and ends < 0.005, 0.03 < ends < 0.4),
    ]


def pattern(v: list[int]) -> int:
    """Votes as a number in base 3."""
    code = 0
    for x in v:
        code = code * 3 + x + 1
    return code


def fit_votes(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of good for each pattern, and P(vote | class) by labeller.

    Starts from the votes weighted by their rarity (an alarm that few texts
    raise says more than what most texts get), which also says which class is
    good.
    """
    if not counts:
        return {}, np.full((2, labellers, 3), 1 / 3)
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    said = np.array([[c // 3 ** (labellers - 1 - i) % 3 for i in range(labellers)] for c in codes]).reshape(len(codes), labellers)
    onehot = (said[:, :, None] == np.arange(3)).astype(float)
    rarity = -np.log((np.einsum("p,plv->lv", n, onehot) + 1) / (n.sum() + 3))
    p = 1 / (1 + np.exp(-np.einsum("plv,lv,v->p", onehot, rarity, [-1.0, 0.0, 1.0])))
    table = np.full((2, labellers, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([n * (1 - p), n * p])
        prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        table = np.einsum("cp,plv->clv", weight, onehot) + 1
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("plv,clv->cp", onehot, np.log(table))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return dict(zip(codes, p.tolist(), strict=True)), table


_SHAPES = bytes.maketrans(_LOWER + _UPPER + b"0123456789", b"a" * 26 + b"A" * 26 + b"9" * 10)
_RUNS = re.compile(r"(.)\1{2,}", re.S)


def features(word: bytes) -> tuple[int, int, int]:
    """Hashed places of a word, its shape and its end."""
    text = word.decode("utf-8")
    if word.isascii():
        shape = word.translate(_SHAPES).decode()
    else:
        shape = "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c for c in text)
    squeezed = _RUNS.sub(r"\1\1", shape)[:12]
    return tuple(xxhash.xxh32_intdigest(k + v.encode()) % DIM for k, v in ((b"w", text), (b"s", squeezed), (b"e", text[-2:])))


#: Place of the share of words that repeat the word before them.
REPEAT = xxhash.xxh32_intdigest(b"repeat") % DIM
#: Means are taken over so many words at least: a few words decide little.
LEAST_WORDS = 12


def repeats(words: list[bytes]) -> float:
    # Times 5: the share of a plainly repetitive text weighs as much as its words.
    return 5 * sum(map(bytes.__eq__, words, words[1:])) / max(LEAST_WORDS, len(words))


class WordScores(dict):
    """Summed weight of a word's features, remembered up to a bound."""

    def __init__(self, weights: np.ndarray, limit: int = 100_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        self[word] = s = float(sum(self.weights[i] for i in features(word)))
        return s


def fit_scorer(rows: list[tuple[list[int], list[float], float]], rounds: int = 150, rate: float = 0.3, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer on soft labels."""
    w = np.zeros(DIM + 1)
    if not rows:
        return w
    at = np.concatenate([np.asarray(i, np.int64) for i, _, _ in rows])
    x = np.concatenate([np.asarray(v, float) for _, v, _ in rows])
    doc = np.repeat(np.arange(len(rows)), [len(i) for i, _, _ in rows])
    y = np.array([p for _, _, p in rows])
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, x * w[at], len(rows)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.append(np.bincount(at, x * e[doc], DIM), e.sum()) + ridge * np.append(w[:-1], 0)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


def fit(docs: DataFrame, id_col: str, text_col: str, sample: int, seed: int) -> np.ndarray:
    """Votes over all texts, EM, and the scorer on a bounded seeded sample."""
    stages = Stages(docs.sparkSession, "quality")
    share = min(1.0, 1.5 * sample / max(1, docs.count()))
    draw = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    narrow = docs.select(F.col(text_col).alias("text"), draw.alias("draw"), (F.pmod(draw, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).alias("drawn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, places, values = [], [], []
            for text, drawn in zip(b.column("text").to_pylist(), b.column("drawn").to_pylist(), strict=True):
                v = votes(text)
                codes.append(pattern(v))
                words = (text or "").encode("utf-8").split() if drawn and any(v) else []
                hit = np.array([i for w in words for i in features(w)] + [REPEAT] * bool(words), np.int64)
                x = np.full(len(hit), 1 / max(LEAST_WORDS, len(words)))
                x[-1:] = repeats(words)
                at, back = np.unique(hit, return_inverse=True)
                places.append(at.tolist() or None)
                values.append(np.bincount(back, x, len(at)).tolist() or None)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), b.column("draw"), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["code", "draw", "at", "x"])

    told = stages.write(narrow.mapInArrow(run, "code int, draw long, at array<int>, x array<double>"), "votes", batch=1000)
    posterior, _ = fit_votes({r.code: r.n for r in told.groupBy("code").agg(F.count("*").alias("n")).collect()})
    # As Arrow: as rows of Python numbers the driver would hold many times their size.
    drawn = told.where(F.col("at").isNotNull()).orderBy("draw", "code").limit(sample).select("code", "at", "x").toArrow()
    stages.drop(told)
    codes, at, x = (drawn.column(c) for c in ("code", "at", "x"))
    return fit_scorer([(i.values.to_numpy(), v.values.to_numpy(), posterior[c]) for c, i, v in zip(codes.to_pylist(), at, x, strict=True)])


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """``docs`` with the probability of good quality; 0 without words."""
    name = fresh(docs.columns, out_col)
    names, schema = docs.columns, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bias = WordScores(weights), weights[-1]
        for b in batches:
            out = []
            for text in b.column(names.index(text_col)).to_pylist():
                words = (text or "").encode("utf-8").split()
                z = bias + sum([known[w] for w in words]) / max(LEAST_WORDS, len(words)) + weights[REPEAT] * repeats(words)
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) if words else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*names, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 11, out_col: str = "quality") -> DataFrame:
    """``docs`` with a column ``quality`` between 0 and 1 (good).

    Fits on ``docs`` itself without any given label.  Texts without words score
    0; texts under five words get no votes and are scored by their words and
    the bias.  If ``docs`` has a column ``quality`` the new one gets a trailing
    underscore.  An empty table stays empty.
    """
    return score(docs, fit(docs, id_col, text_col, sample, seed), text_col, out_col)
