"""Quality rules, collocations and hard negatives against plain computations."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from argusline.llm import llr_rules, negatives, phrases, queries
from argusline.llm.common import table
from tests import oracle

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality rules


def _hash(x: bytes | int, seed: int = 42) -> int:
    raw = x if isinstance(x, bytes) else (x % (1 << 64)).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(raw, seed)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grams(text: str, buckets: int) -> list[int]:
    h = [_hash(w.encode()) for w in WORDS.findall(text)]
    pairs = [_hash(b, _hash(a)) for a, b in zip(h, h[1:])] + [_hash(a) for a in h[-1:]]
    return [_signed(x) % buckets for x in h + pairs]


def _plain_rules(rows, trusted, buckets, threshold=None):
    every, target = Counter(), Counter()
    held = {i for i in trusted if _signed(_hash(i, _hash(b"held"))) % llr_rules.FOLDS == 0}
    for i, t in rows:
        g = _grams(t or "", buckets)
        every.update(g)
        if i in trusted - held:
            target.update(g)
    n, m = every.total(), target.total()
    weight = [round(1e6 * math.log((target[b] + 1) / (m / n * every[b] + 1))) for b in range(buckets)]
    if threshold is None:
        score = lambda t: np.mean([weight[b] for b in _grams(t, buckets)])
        low, middle = np.percentile([score(t) for i, t in rows if i in held and len(WORDS.findall(t or "")) >= 50], [1, 50])
        threshold = math.floor(low - (middle - low))
    out = []
    for i, t in rows:
        t = t or ""
        w = WORDS.findall(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if times[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        g = _grams(t, buckets)
        total = sum(weight[b] for b in g)
        score = total / len(g) if g else 0.0
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, score, not failed and total >= threshold * len(g)))
    return out


ODD = [None, "", " \n\t ", "one", "two words", "a b c a b c", "x " * 70, "é ü ß w \U0001f600" * 30, "same line\nsame line\n\n\nsame line\r\n", "# * $ % & | < >" * 9, "ab\x00cd \x1c\x85 ef " * 30]


def _same_rules(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=repr), sorted(want, key=repr), strict=True):
        assert g[:7] == w[:7] and g[8] == w[8] and g[7] == pytest.approx(w[7], abs=1.0)


def test_rules_against_a_plain_computation(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = list(enumerate(ODD)) + [(100 + k, " ".join(rng.choices(words[: 5 + k], k=rng.randint(1, 200)))) for k in range(50)]
    rows += [(150 + k, " ".join(f"junk{j}!!" for j in range(k, k + 80))) for k in range(3)]
    rows += [(200, rows[-1][1]), (200, rows[-1][1]), (None, rows[-2][1]), (7, "w1 w2 w3 " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(1).alias("weights"), F.lit("x").alias("h"), F.lit(2).alias("id"))
    trusted = set(range(100, 125))
    ids = spark.createDataFrame([(i,) for i in [*trusted, 101, 999, None]], "doc_id long")
    middle = int(np.median([w[7] for w in _plain_rules(rows, trusted, 512, 0) if not w[6]]))
    for threshold in (middle, None):
        got = llr_rules.judge(docs, ids, buckets=512, threshold=threshold)
        assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
        want = _plain_rules(rows, trusted, 512, threshold)
        _same_rules(got.collect(), want)
        assert any(w[8] for w in want) and (threshold is None or any(not w[8] and not w[6] for w in want))


def test_rules_without_trusted_texts_or_rows(spark):
    rows = [(1, " ".join(f"v{k}" for k in range(60))), (2, "few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert {r.doc_id: (r.kept, r.score) for r in llr_rules.judge(docs, none).collect()} == {1: (True, 0.0), 2: (False, 0.0)}
    assert llr_rules.judge(docs.limit(0), none).collect() == []
    bounded = llr_rules.weights(docs, docs, limit=1, buckets=64).first().weights
    assert len(bounded) == 64 and any(bounded)


def test_rules_on_labelled_documents(spark):
    """Texts that no label of the target told about: good ones stay, junk that passes the base rules goes."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = llr_rules.judge(docs, labels.where("quality = 1 AND toxic = 0").where(~held))
    seen = got.join(labels.where(held), "doc_id").where("NOT base_failed").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    told = {r.quality: (r.n, r.kept) for r in seen}
    assert told[1][1] >= 0.99 * told[1][0] > 1000 and told[0][1] <= 0.02 * told[0][0]


def test_rules_query_and_plan(spark, monkeypatch):
    plans = []
    write = llr_rules.Stages.write
    monkeypatch.setattr(llr_rules.Stages, "write", lambda self, df, *a: plans.append(df._jdf.queryExecution().toString()) or write(self, df, *a))
    df = queries.op12_llr_quality_rules(spark, SF)
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    trusted = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1 AND toxic = 0").collect()}
    _same_rules(df.collect(), _plain_rules([tuple(r) for r in docs], trusted, llr_rules.BUCKETS))
    assert len(plans) == 3 and not any(x in plan for plan in plans for x in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


# --- collocations


def _plain_phrases(rows, least=30, most=2000, overlap=80, scale=2_000_000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= overlap * c[p[i : i + m]]}
        rows = []
        for p, a in cand.items():
            if p not in gone:
                score, _, left, right = min((scale * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def test_collocations_against_a_plain_computation(spark):
    rng = random.Random(7)
    words = ["The", "la", "New", "York", "é", "Ünder", "x-y", "a\x00b", "ß", "\U0001f600", " "]
    rows = [(rng.choice(["en", "fr", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  ", "\r\n", "\x0b"]) for w in rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, 90)))) for _ in range(120)]
    rows += [("en", "Rock and roll, rock and roll! and rock on " * 40), ("fr", "il y a, il y avait " * 60)]
    rows += [("en", None), ("en", ""), ("de", "..."), ("en", "new york city hall " * 500), ("en", rows[0][1]), ("en", rows[0][1])]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("clash")).withColumn("f", F.lit(0))
    for least, most in ((30, 2000), (5, 7)):
        got = sorted(map(tuple, phrases.collocations(docs, least=least, most=most, bits=1 << 16).collect()))
        assert got == _plain_phrases(rows, least, most) and len(got) > 10
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_collocations_with_small_tries_and_parts(spark, monkeypatch):
    """Bursting, spilling, forgetting words and cutting long texts change nothing, nor does a full bitmap."""
    rng = random.Random(8)
    rows = [("en", " ".join(rng.choices([f"w{k}" for k in range(40)], range(40, 0, -1), k=3000)) + ". " + "tail of it ! " * 50) for _ in range(6)]
    want = _plain_phrases(rows, 12, 500)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs, least=12, most=500, bits=1 << 15).collect())) == want
    batch = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1].encode() for r in rows], pa.binary())], ["lang", "text"])]
    monkeypatch.setattr(phrases, "SLICE", 700)
    whole = [b" . ".join(b" ".join(phrases.words_of(t)) for t in some) for _, some in phrases._slices(iter(batch), 700)]
    assert Counter(b" ".join(whole).split()) - Counter({b".": 10**9}) == Counter(b" ".join(b" ".join(phrases.words_of(r[1].encode())) for r in rows).split()) - Counter({b".": 10**9})


def test_hat_trie_counts_and_spills():
    rng = np.random.default_rng(2)
    for first in (None, [k % 5 for k in range(60)]):
        trie, want, got, burst = phrases.HatTrie(burst=4, full=200), Counter(), Counter(), False
        for _ in range(40):
            keys = (rng.zipf(1.3, 300) % 60 << 32) | rng.zipf(1.3, 300) % (1 << 31)
            want.update(keys.tolist())
            trie.add(*np.unique(keys, return_counts=True), first)
            assert sum(trie.size.values()) == sum(len(x) if not b else sum(map(len, x.values())) for b, x in trie.root.values())
            burst |= any(b for b, _ in trie.root.values())
            before = set(trie.root)
            left = Counter()
            for keys, counts in trie.take():
                left.update(dict(zip(keys.tolist(), counts.tolist())))
            # Whole subtrees go: no first word is both told and held.
            gone = {first[k >> 32] if first else k >> 32 for k in left}
            assert gone == before - set(trie.root) and sum(trie.size.values()) <= 200
            got += left
        assert burst == bool(first)
        for keys, counts in trie.take(True):
            got.update(dict(zip(keys.tolist(), counts.tolist())))
        assert got == want and not trie.root


def test_pair_hashes(spark):
    rows = [(1, -5), (0, 0), (1 << 62, -(1 << 63)), (123456789, 987654321)]
    want = [r.h for r in spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()]
    a, b = (np.array(c, np.int64).view(np.uint64) for c in zip(*rows))
    assert phrases.pair_hash(a, b).view(np.int64).tolist() == want


def test_collocations_query(spark):
    con = oracle.connect(SF)
    assert oracle.differences(queries.op11_collocations(spark, SF), con, queries.ORACLE_SQL["op11_collocations"]) is None


def test_phrase_scores_beyond_64_bits(spark):
    """The arithmetic of scores: products of counts near the largest long stay exact."""
    a, left, right = (1 << 62) + 12345, (1 << 63) - 1, (1 << 63) - 3
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases.score_of(2_000_000).alias("s")).first()
    assert row.s == 2_000_000 * a // (left + right)


# --- hard negatives


def _plain_negatives(rows, positives=5, per_positive=3, low=50, high=95):
    least = {}
    for i, v, label, anchor in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * float(x)) for x in v)
        old = least.get(i)
        least[i] = (min((label, whole), old[:2]) if old else (label, whole)) + (anchor or bool(old and old[2]),)
    out = []
    for i, (label, v, anchor) in least.items():
        if not anchor:
            continue
        pairs = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, (m, w, _) in least.items() if j != i and len(w) == len(v))
        for s, j in [(-s, j) for s, j, m in pairs if m == label][:positives]:
            hard = [(j2, -s2) for s2, j2, m in pairs if m != label and low * s <= 100 * -s2 <= high * s][:per_positive]
            out += [(i, j, rank, j2, s, s2) for rank, (j2, s2) in enumerate(hard, 1)]
    return sorted(out)


def test_negatives_against_a_plain_computation(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=4).round(1)], int(rng.integers(3)), bool(i % 5 == 0)) for i in range(-40, 260)]
    rows += [(i, [1.0, 0.5, 0.25, 0.0], i % 2, False) for i in range(1000, 1150)]  # copies: ties of all kinds
    rows += [(2000, None, 1, True), (2001, [1.0, None, 0.0, 0.0], 1, True), (2002, [float("nan")] * 4, 0, True), (2003, [float("-inf")] * 4, 0, False), (2004, [1.0] * 4, None, True), (None, [1.0] * 4, 1, True)]
    rows += [(3000, [], 0, True), (3001, [], 0, False), (3002, [], 1, False), (3003, [1.0, 2.0], 0, True), (3004, [1.0, 1.0], 0, False), (3005, [0.5, 1.0], 1, False)]
    rows += [(5, [9.0, 9.0, 9.0, 9.0], 2, True), rows[3], rows[3], (7, rows[10][1], 0, True), (0, [0.0] * 4, 0, None)]
    rows += [(4000, [0.0] * 4, 1, True), (4001, [1e6, 0.0, -1e6, 3.0], 1, True), (4002, [2e5, 1.0, 0.0, 0.0], 0, False)]
    df = spark.createDataFrame([(i, v, label, a, "x", 1) for i, v, label, a in rows], "vec_id long, embedding array<double>, label int, own boolean, id string, v int")
    want = _plain_negatives(rows)
    for block, at_once in ((4096, 256), (40, 7)):
        monkeypatch.setattr(negatives, "ROWS", block)
        monkeypatch.setattr(negatives, "ANCHORS", block // 2)
        monkeypatch.setattr(negatives, "AT_ONCE", at_once)
        got = negatives.mine(df, F.col("own")).collect()
        assert sorted(map(tuple, got)) == want
    assert len(want) > 300 and any(w[4] == 0 for w in want)
    assert negatives.mine(df.where("false"), F.col("own")).collect() == []
    assert negatives.mine(df, F.lit(False)).collect() == []


def test_negatives_kernels():
    rng = np.random.default_rng(6)
    for big in (1, 1 << 45):
        s = rng.integers(-3, 4, (20, 50)) * big
        mask = rng.random((20, 50)) < 0.3
        mask[0] = False
        for k in (1, 3, 60):
            got = negatives._first(s, mask, k)
            for i in range(20):
                want = sorted(np.flatnonzero(mask[i]).tolist(), key=lambda j: (-int(s[i, j]), j))[:k]
                assert got[i].tolist() == want + [-1] * (k - len(want))
    a = np.array([[2.0**40, 1.0], [2.0**62, 2.0**62]])
    assert negatives._scores(a, a).tolist() == [[2**80 if 2**80 < negatives.MOST else negatives.MOST, negatives.MOST], [negatives.MOST, negatives.MOST]]
    keys = [(a, s, k, r) for a in (-5, 0, 7) for s in (-negatives.MOST, -1, 0, 9) for k in (0, 1) for r in (-3, 0, 4)]
    rng.shuffle(keys)
    keys = [tuple(map(int, k)) for k in keys]
    packed = sorted(negatives.pack(*k) for k in keys)
    assert [negatives.unpack(k) for k in packed] == sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3]))


def test_negatives_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op13_hard_negatives(spark, sf)
    assert oracle.differences(got, oracle.connect(sf), queries.ORACLE_SQL["op13_hard_negatives"]) is None
