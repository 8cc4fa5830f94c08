"""The operators of this subpackage applied to the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusline.llm import ann, chunk_dedup, compaction, llr_rules, media, mixing, negatives, packing, parity_join, phrases, quality, secrets, url_filter
from argusline.llm.common import Stages, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: doc_id, start, length, token_sha256, score."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.train_scanner(docs).findings(docs)
    return found.select("doc_id", "start", "length", F.sha2("token", 256).alias("token_sha256"), "score")


def op2_media_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text stored as sound, its features, their tensors' digest and time spans."""
    return media.audio(table(spark, sf_dir, "documents"), keep_media=False).drop("media", "tensors")


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents and where they stand first."""
    return chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at 0.9 or more: doc_id, n_shingles, component_id."""
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op6_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, appended in four arrivals, compacted and read back."""
    root = Stages(spark, "shards").root
    shards = compaction.ingest(table(spark, sf_dir, "documents"), root, arrivals=4, key="doc_id")
    rows = shards.read(schema=table(spark, sf_dir, "documents").schema)
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


#: (verdict, host, path prefix) of the production list.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document and whether it is kept."""
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", F.round("quality", 6).alias("quality"), (F.col("quality") >= 0.5).alias("keep"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_llr_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, score and verdict of every document; trusted are labelled good, not toxic ones."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return llr_rules.judge(table(spark, sf_dir, "documents"), trusted)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of vectors whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_media_features": op2_media_features,
    "op3_chunk_dedup": op3_chunk_dedup,
    "op4_nn_descent": op4_nn_descent,
    "op5_parity_join": op5_parity_join,
    "op6_compaction": op6_compaction,
    "op7_min_slack_packing": op7_min_slack_packing,
    "op8_url_filter": op8_url_filter,
    "op9_sainte_lague_mix": op9_sainte_lague_mix,
    "op10_weak_label_quality": op10_weak_label_quality,
    "op11_collocations": op11_collocations,
    "op12_llr_quality_rules": op12_llr_quality_rules,
    "op13_hard_negatives": op13_hard_negatives,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
_FITS = "(host = '{1}' OR host LIKE '%.{1}') AND starts_with(path, '{2}')"


def _when(value) -> str:
    return "CASE " + " ".join(f"WHEN {_FITS.format(*r)} THEN '{value(r)}'" for r in _RULES) + " END"


#: The rest is training, graph search, packing or seeded choice; tests use brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_parity_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b),
c AS (SELECT a, min(b) AS root FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id""",
    "op6_compaction": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    # The standard pages declare no links, so aliases are spellings of one address.
    "op8_url_filter": f"""WITH u AS (SELECT page_id, url, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT *, regexp_replace('?' || regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\\1', 'gi') AS q0 FROM u),
v AS (SELECT *, CASE WHEN contains(url, '://') THEN host || regexp_replace(path, '(/index)?(\\.html?)?/*$', '') || regexp_replace(regexp_replace(regexp_replace(q0, '&+', '&', 'g'), '\\?&', '?', 'g'), '[?&]+$', '') END AS node, {_when(lambda r: r[1] + r[2])} AS rule, {_when(lambda r: r[0])} AS said FROM q),
b AS (SELECT node FROM v WHERE node IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (said = 'block') > 0 AND count(*) FILTER (said = 'allow') = 0)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN node IN (SELECT node FROM b) THEN 'block' END, 'allow') AS verdict FROM v""",
    "op11_collocations": f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m),
f AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT lang, phrase, m, f, ws, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.f AS a, k.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * k.f) // (x.f + y.f))::BIGINT AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k.k + 1:], ' ')),
b AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, f, ws, m, unnest(range(2, m)) AS k FROM c WHERE m > 2),
j AS (SELECT lang, f, unnest(list_transform(range(1, m - k + 2), lambda q: array_to_string(ws[q:q + k - 1], ' '))) AS phrase FROM i),
o AS (SELECT lang, phrase, max(f) AS f FROM j GROUP BY 1, 2),
e AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM e)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN t ON t.lang = z.lang WHERE rank <= 2000""",
    "op13_hard_negatives": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
w AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM w WHERE rank <= 3""",
}
