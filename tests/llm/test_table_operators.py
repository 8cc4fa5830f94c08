"""Media, vectors, shards, URLs, mixing and the pipeline."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from argusline.llm import ann, compaction, media, mixing, queries, url_filter
from argusline.llm.common import table

SF = "/root/testdata/sf0.001"


def test_media_round_trip(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").limit(50).collect()] + [(None, None), (1, ""), (2, "é" * 100_001), (3, "x" * 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = media.audio(docs).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows, strict=True):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert media.from_wav(r.media)[0] == payload
    import pyarrow as pa

    back = pa.ipc.open_stream(got[0].tensors).read_all().column("mel")
    assert back.type.shape == [media.WINDOW, media.MELS] and len(back) == len(got[0].windows)


def test_features_against_a_plain_computation(spark):
    """The feature string, tensors and spans of small texts without blocks and branches."""
    rng = np.random.default_rng(3)
    texts = ["", "a", "x" * 64, "hello world " * 40, "".join(map(chr, rng.integers(32, 900, 3000))), "é" * 700 + " " * 5000 + "zyx" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = media.TAPS * media.UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / 2) / 2 * np.hamming(n)
    for r in media.audio(docs).collect():
        x = (np.frombuffer(media.from_wav(r.media)[0], "u1").astype(float) - 128) / 128
        y = np.convolve(x, h)[::2][: -(-len(x) // 2)]
        frames = max(1, -(-max(0, len(y) - 256) // 128) + 1)
        y = np.r_[y, np.zeros(frames * 128 + 256)]
        power = np.stack([np.abs(np.fft.rfft(y[i * 128 : i * 128 + 256] * np.hanning(256))) ** 2 for i in range(frames)])
        mel = np.log10(power @ media.mel_bank(8000).astype(float) + 1e-6)
        energy = (10**mel).sum(axis=1)
        on = energy > 0.75 * energy.mean()
        runs = np.flatnonzero(np.diff(np.r_[0, on, 0]))
        active = [(a, b) for a, b in zip(runs[::2], runs[1::2]) if (energy[a:b] > 1.25 * energy.mean()).any()]
        told = dict(p.split("=") for p in r.feature.split(";"))
        assert told["frames"] == str(frames) and told["windows"] == str(len(r.windows)) == str(-(-frames // 32))
        assert len(r.segments) == len(active) == int(told["segments"]) and int(told["active"]) == sum(b - a for a, b in active)
        assert [x for s in r.segments for x in (s.start_s, s.end_s)] == pytest.approx([x * 256 / 16000 for pair in active for x in pair])
        import pyarrow as pa

        array = pa.ipc.open_stream(r.tensors).read_all().column("mel").combine_chunks()
        got = array.to_numpy_ndarray().reshape(-1, 32) if hasattr(array, "to_numpy_ndarray") else array.chunk(0).to_numpy_ndarray().reshape(-1, 32)
        assert np.abs(got[:frames] - mel).max() < 2e-3 and (got[frames:] == -6).all()
        assert r.tensors_sha256 == hashlib.sha256(r.tensors).hexdigest()
    assert media.audio(docs.limit(0)).collect() == []
    slim = media.audio(docs, keep_media=False)
    assert slim.where("media is null and tensors is null and size(windows) > 0").count() == len(texts)


def test_resampling_blocks_and_segments():
    x = np.random.default_rng(1).normal(size=997).astype("f4")
    for up, down in ((1, 2), (3, 2), (2, 3)):
        h, z = media.phases(up, down).T.ravel(), np.zeros(len(x) * up)
        z[::up] = x
        want = np.convolve(z, h)[::down][: -(-len(x) * up // down)]
        assert np.abs(want - media.resample(x, up, down)).max() < 1e-5
    raw = np.random.default_rng(0).integers(0, 256, 400_000).astype("u1").tobytes()
    whole, media.BLOCK = media.BLOCK, 1 << 20
    one = media.log_mel(raw)
    media.BLOCK = whole
    assert np.abs(one - media.log_mel(raw)).max() < 1e-4
    tone = np.r_[np.zeros(4000), 100 * np.sin(np.arange(8000) * 0.3), np.zeros(4000)]
    energy = (10.0 ** media.log_mel((tone + 128).astype("u1").tobytes())).sum(axis=1)
    (a, b), = media.segments(energy)
    assert abs(a * media.HOP * 2 - 4000) < 1000 and abs(b * media.HOP * 2 - 12000) < 1000


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 24)))]
    rows += [(2000 + i, [1.0] * 24) for i in range(40)] + [(3000, None), (3050, [0.0] * 24), (3100, [float("nan")] * 24), (3150, [1.0, None] + [0.0] * 22), (3200, [float("inf")] + [0.0] * 23)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit(1))
    got = defaultdict(list)
    for r in ann.nearest(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:940]}
    hits = total = 0
    for q in [i for i in good if i % 50 == 0]:
        want = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        assert [k for k, _, _ in got[q]] == [1, 2, 3, 4, 5]
        hits += len({i for _, i in want} & {i for _, i, _ in got[q]})
        total += 5
        for _, i, s in got[q]:
            assert s == pytest.approx(float(good[q] @ good[i]), abs=1e-12)
    assert hits >= 0.9 * total
    assert [i for _, i, _ in got[2000]] == [2001, 2002, 2003, 2004, 2005]
    assert set(got) == {i for i in good if i % 50 == 0}
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).collect() == []
    assert len(ann.nearest(vectors.where("vec_id in (0, 1, 2)"), vectors.where("vec_id = 0")).collect()) == 2


def test_recall_on_the_given_vectors(spark):
    d = "/root/testdata/sf0.01"
    e = {r.vec_id: np.array(r.embedding, float) for r in table(spark, d, "embeddings").collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in e.items()}
    got = defaultdict(set)
    for r in queries.op4_nn_descent(spark, d).collect():
        got[r.query_id].add(r.vec_id)
    hits = sum(len(got[q] & {i for _, i in sorted((-float(unit[q] @ v), i) for i, v in unit.items() if i != q)[:5]}) for q in unit if q % 50 == 0)
    assert hits >= 0.9 * 5 * sum(q % 50 == 0 for q in unit)


def test_compaction(spark, tmp_path):
    docs = table(spark, SF, "documents")
    out = compaction.ShardTable(spark, f"file://{tmp_path}/t", target=1 << 20, fan_in=3, least=1 << 12)
    for i in range(7):
        out.append(docs.where(F.col("doc_id") % 7 == i).repartition(3))
    before = len(out.shards()[1])
    version = out.compact()
    after = out.shards()[1]
    assert len(after) < before and sum(s.rows for s in after) == docs.count() and version > 7
    assert out.read().exceptAll(docs).count() == docs.exceptAll(out.read()).count() == 0
    with pytest.raises(compaction.Conflict):
        out.commit(version - 1, [], docs.schema)
    assert out.shards()[0] == version
    import os

    out.vacuum(keep=1)
    kept = {os.path.join(p, f) for p, _, fs in os.walk(tmp_path / "t") for f in fs if f.startswith("part-")}
    assert len(kept) == len(after)


def test_compaction_keeps_added_columns(spark, tmp_path):
    out = compaction.ShardTable(spark, f"file://{tmp_path}/t", fan_in=3)
    first = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    out.append(first)
    for i in range(4):
        out.append(spark.createDataFrame([(10 + i, "b", 0.5 * i, i)], "doc_id long, text string, score double, `New Col` int"))
    assert out.read(version=1).columns == ["doc_id", "text"]
    with pytest.raises(ValueError):
        out.append(spark.createDataFrame([("x",)], "DOC_ID string"))
    out.compact()
    assert len(out.shards()[1]) < 5
    want = {(1, "a", None, None), (2, None, None, None)} | {(10 + i, "b", 0.5 * i, i) for i in range(4)}
    assert {tuple(r) for r in out.read().collect()} == want
    out.append(first.limit(0))
    assert {tuple(r) for r in out.read().collect()} == want


def test_readers_finish_and_failed_merges_leave_nothing(spark, tmp_path, monkeypatch):
    import os

    out = compaction.ShardTable(spark, f"file://{tmp_path}/t", fan_in=2)
    rows = spark.range(100).withColumn("v", F.lit("x"))
    for i in range(4):
        out.append(rows.where(F.col("id") % 4 == i))
    held = out.read()
    out.compact()
    assert held.count() == 100 and out.read().count() == 100
    out.vacuum(keep=1)
    listed = {s.path for s in out.shards()[1]}
    files = lambda: {os.path.relpath(os.path.join(p, f), tmp_path / "t") for p, _, fs in os.walk(tmp_path / "t") for f in fs if f.startswith("part-")}
    assert files() == listed and len(out.versions()) == 1
    for i in range(3):
        out.append(rows.limit(1))
    before, merge = files(), compaction.ShardTable.merge

    def beaten(self, shards, schema):  # another writer commits while this one merges
        new = merge(self, shards, schema)
        base, old, known = self.manifest()
        if len(self.versions()) < 6:
            self.commit(base, old, known)
        return new

    monkeypatch.setattr(compaction.ShardTable, "merge", beaten)
    out.compact()
    assert out.read().count() == 103
    assert files() - before == {s.path for s in out.shards()[1]} - before


def test_compaction_edge_cases(spark, tmp_path):
    rows = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 300_000)], "doc_id long, text string")
    out = compaction.ingest(rows, f"file://{tmp_path}/a", key="doc_id").read(schema=rows.schema)
    assert sorted(map(str, out.collect())) == sorted(map(str, rows.collect()))
    empty = compaction.ingest(rows.limit(0), f"file://{tmp_path}/b").read(schema=rows.schema)
    assert empty.collect() == [] and empty.columns == rows.columns


RULES = queries.URL_RULES


def brute_rule(host, path):
    fits = [(k, h, p) for k, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def test_url_rules_and_aliases(spark):
    urls = ["http://A.Example.com/en/7?x#y", "https://b.com/en/x", "https://b.org/es/", "http://c.example.net/de/8a", "net/de/", "http://net/de/1", "x://://d.com/en/", None, "", "http://e.com?/en/", "http://new.example/", "http://old.com/en/", "http://m.com/en/", "http://m2.info/"]
    page = "<html><head><link href='http://old.com/en/' rel=\"canonical\"></head>"
    html = {10: page, 13: '<META http-equiv="Refresh" content="0; url=http://m.com/en/">'}
    rows = [(i, u, html.get(i)) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judge(pages, RULES).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = rest[:end].lower()
            path = rest[end:].split("?")[0].split("#")[0]
        assert (got[i].host, got[i].path) == (host, path), u
        r = brute_rule(host, path)
        assert got[i].rule == (r and r[1] + r[2])
        if r:
            assert got[i].verdict == r[0]
    assert got[10].verdict == "block" and got[13].verdict == "block" and got[9].verdict == "allow"
    redirects = spark.createDataFrame([("http://m2.info/", "http://x.example.com/en/7")], "src string, dst string")
    allowed = pages.union(spark.createDataFrame([(99, "http://x.example.com/en/7", None, "")], pages.schema))
    again = {r.page_id: r.verdict for r in url_filter.judge(allowed, RULES, redirects=redirects).collect()}
    assert again[13] == "allow" and again[10] == "block"
    assert url_filter.judge(pages.limit(0), RULES).collect() == []


def test_link_targets_are_resolved_as_rfc_3986_says(spark):
    from urllib.parse import urljoin

    bases = ["http://a.com/b/c/d?q=1#f", "http://a.com", "http://a.com/", "https://h.org/x/y/"]
    goals = "g ./g g/ /g //g.com/x ?y g?y g#s . ./ .. ../ ../g ../../g ../../../g /../g g/./h g/../h http://z.com/a /go?u=http://bad.com/en/x other g;x=1/../y ?u=http://q/../r".split()
    none = "#s mailto:x@y javascript:void(0) a.b:c/d".split()
    rows = [(b, g) for b in bases for g in goals + none]
    for r in spark.createDataFrame(rows, "b string, g string").withColumn("o", url_filter.resolved(F.col("b"), F.col("g"))).collect():
        want = None if r.g in none else "http:" + r.g if r.g.startswith("//") else urljoin(r.b, r.g)
        assert (r.o or "").rstrip("/") == (want or "").rstrip("/"), (r.b, r.g)
    pages = spark.createDataFrame(
        [(1, "http://bad.com/safe", '<link rel="canonical" href="/go?u=http://x.com/en/x">'), (2, "http://q.com/dir/page", '<link rel=canonical href="other?a=1&amp;b=2">'), (3, "http://q.com/dir/other?a=1&b=2", '<link rel="canonical" href="//y.com/en/1">'), (4, "http://w.com/en", ""), (5, "http://w.com/en/", "")],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, RULES).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "block"}
    assert url_filter.judge(pages, RULES, spellings=False).where("page_id = 4").first().verdict == "allow"


def test_url_targets_that_are_no_pages_are_judged(spark):
    canonical = '<link rel="canonical" href="http://x.com/en/1">'
    rows = [
        (1, "http://a.info/", canonical), (2, "http://b.info/", '<meta http-equiv="refresh" content="0; url=http://x.com/en/2">'),
        (3, "http://c.info/", ""), (4, "http://d.info/", canonical.replace("en/1", "en/4")), (5, "http://e.info/", ""), (6, "http://f.info/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame(
        [("http://c.info/", "http://x.com/en/3"), ("http://d.info/", "http://example.com/en/7"), ("http://x.com/en/9", "http://e.info/")], "src string, dst string"
    )
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, queries.URL_RULES, redirects=redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow"}


def test_mixing(spark):
    docs = table(spark, SF, "documents")
    rows = docs.union(spark.createDataFrame([(9000, None, "en", None, 0), (9001, "a b " * 40_000, "en", None, 0), (9001, "a b " * 40_000, "en", None, 0), (None, "", "en", "zz", 0)], docs.schema))
    got = mixing.mix(rows.withColumn("size", F.lit("clash"))).collect()
    assert len(got) == rows.count()
    by = defaultdict(lambda: [0, 0, None, None])
    for r in got:
        assert r.size == len((r.text or "").encode().split()) and 0 <= r.taken <= 2 * r.size
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2:] = [r.source_size, r.target]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.targets([by[s][0] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2)
    for s, t in zip(order, want, strict=True):
        size, taken, source_size, target = by[s]
        assert source_size == size and target == pytest.approx(t) and target <= 2 * size + 1e-6
        assert abs(taken - target) <= 32 + 0.001 * target
    assert sum(want) == pytest.approx(1.5 * sum(v[0] for v in by.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(rows.withColumn("size", F.lit("clash"))).collect()))
    made = mixing.mixed_documents(rows)
    assert made.columns == rows.columns
    assert sum(len((r.text or "").encode().split()) for r in made.collect()) == sum(r.taken for r in got)
    own = rows.withColumns({"size": F.concat(F.lit("own"), F.col("doc_id")), "row": F.lit(4), "target": F.col("doc_id")})
    kept = mixing.mixed_documents(own)
    assert kept.columns == own.columns and kept.where("size <> concat('own', doc_id) or target <> doc_id or row <> 4").count() == 0
    assert mixing.mix(rows.limit(0)).collect() == []


def test_sainte_lague_against_the_plain_rule():
    import random

    rnd = random.Random(9)
    assert mixing.sainte_lague([1000] + [100] * 6, 160, [10**6] * 7) == [100] + [10] * 6
    for k in range(200):
        votes = [rnd.choice([0, 1, 2, 7, 100, rnd.randrange(1, 1000), 10**6]) for _ in range(rnd.randrange(1, 7 if k % 10 else 400))]
        seats, caps = rnd.randrange(0, 60 if k % 10 else 900), [rnd.choice([0, 1, rnd.randrange(5, 60), 10**6]) for _ in votes]
        caps = [c if v else 0 for v, c in zip(votes, caps, strict=True)]
        want = [0] * len(votes)
        for _ in range(min(seats, sum(caps))):
            i = max((i for i in range(len(votes)) if want[i] < caps[i]), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        assert mixing.sainte_lague(votes, seats, caps) == want


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = table(spark, SF, "documents")
    now = docs
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns, name
        if name == "secret_scan":
            assert after.count() == now.count()
            assert after.where(F.col("text").rlike(r'(?i)token = "[0-9a-f]{40}"')).count() == 0
        if name == "near_duplicates":
            assert after.groupBy("text").count().where("count > 1").count() == 0
        now = after.cache()
    assert cp.run(spark, SF).where("length > 2048").count() == 0


def recall_of(spark, vectors: dict[int, np.ndarray]) -> float:
    """Share of the 5 truly nearest that are found, for ids divisible by 50."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(dict)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got[r.query_id][r.vec_id] = r.score
    ids = np.array(list(vectors))
    m = np.stack(list(vectors.values()))
    m = m / np.abs(m).max(axis=1, keepdims=True)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        apart = ((m - m[q]) ** 2).sum(axis=1)
        apart[q] = 9
        near = np.argsort(apart, kind="stable")[:5]
        hits += sum(int(ids[i]) in got[int(ids[q])] for i in near)
        total += 5
        for i, s in got[int(ids[q])].items():
            assert s == pytest.approx(float(m[q] @ m[np.flatnonzero(ids == i)[0]]), abs=1e-12)
    return hits / total


def test_recall_where_one_component_dominates(spark):
    rng = np.random.default_rng(6)
    assert recall_of(spark, {i: np.r_[1000.0, rng.normal(size=15)] for i in range(600)}) >= 0.9


def test_recall_on_many_more_vectors_than_the_beam(spark):
    """Clusters of near copies of 3 to 300 vectors among spread ones."""
    rng = np.random.default_rng(7)
    rows = [*rng.normal(size=(6000, 16))]
    for n in (3, 10, 30, 100, 300) * 10:
        rows += [*(rng.normal(size=16) + rng.normal(size=(n, 16)) * 1e-3)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    assert len(rows) > 10_000
    assert recall_of(spark, dict(enumerate(rows))) >= 0.9


def test_very_large_and_small_vectors_and_repeated_rows(spark):
    rows = [(0, [1e-200, 0.0]), (0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [3.0, 0.0]), (3, [0.0, -5e-324]), (4, [1.7e308, 1.7e308]), (50, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id % 50 = 0"), k=3).collect()}
    half = 0.5**0.5
    assert {k: (v, pytest.approx(s, abs=1e-12)) for k, (v, s) in got.items()} == {
        (0, 1): (2, 1.0), (0, 2): (50, 1 / 1.25**0.5), (0, 3): (1, half), (50, 1): (1, 1.5 / 1.25**0.5 * half), (50, 2): (4, 1.5 / 1.25**0.5 * half), (50, 3): (0, 1 / 1.25**0.5),
    }


ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "The cat and the dog are in the house of the old man. It is a good day for them.", "en", "a", 9), (3, "The cat and the dog are in the house of the old man. It is a good day for them.", "en", "a", 9),
    (4, "the cat and the dog are in the house of the old man. it is a good day for them.", None, "b", None), (None, "Der Mann und die Frau gehen mit dem Hund in das Haus. Es ist ein schöner Tag.", "de", None, 1),
    (5, "That is what the people of the town said to all of us when we came to see it. " * 3000, "en", "b", 2), (6, "w " * 100_000, "en", "c", 3),
]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_odd_rows(spark, empty):
    """Nulls, empty and very long texts, repeated rows, an empty table and clashing columns."""
    import corpus_pipeline as cp

    docs = spark.createDataFrame([] if empty else ODD, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs.withColumns({"quality": F.lit("q"), "size": F.lit(1), "found": F.lit("f"), "row": F.lit(2), "first": F.lit(3), "cid": F.lit(4), "rank": F.lit(5)})
    out = {}
    for name, stage in cp.STAGES:
        out[name] = stage(spark, clashing, SF).collect()
        if name != "pack_sequences":
            assert stage(spark, clashing, SF).columns == clashing.columns, name
    if empty:
        assert not any(out.values())
        return
    ids = lambda name: sorted(str(r.doc_id) for r in out[name])
    assert not {"1", "2"} & set(ids("quality_classifier"))
    assert ids("near_duplicates") == sorted(["1", "2", "3", "5", "6", "None"])
    assert ids("secret_scan") == sorted(str(r[0]) for r in ODD)
    assert {(r.doc_id, r.text) for r in out["secret_scan"]} == {(r[0], r[1]) for r in ODD}
    assert not {"1", "2"} & set(ids("mix_sources")) and all(r.size == 1 and r.row == 2 for r in out["mix_sources"])
    assert {str(r.doc_id) for r in out["pack_sequences"]} == {str(r[0]) for r in ODD} and max(r.length for r in out["pack_sequences"]) <= 2048
