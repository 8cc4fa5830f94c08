"""Secret scan with a random forest against false positives.

Candidates are maximal runs of 16 or more key characters.  Features are their
length and make-up, how likely their characters follow each other in ordinary
words, how much of them dictionary words cover, whether they stand in a path,
and the words around them.  A random forest trained from labelled findings
decides which candidates are secrets.  Where no labelled findings are given,
secrets and look-alikes (digests, paths, identifiers, examples) of known kinds
are planted in texts of the corpus; a label says what was planted.

The scan is one expression on each row: the text is split at its candidates,
the forest is compiled to a nested condition, and nothing is shuffled.  Only
the dictionary needs the whole corpus: words that make up a hundred-thousandth
or more of all words, so there are at most 100,000 by count alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusline.llm.common import Stages, fresh

CANDIDATE = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}+={0,2}"
#: A dictionary word is at least one in so many of all words.
RARE = 100_000
#: Bits of the dictionary's bitmap.
BITS = 1 << 20
#: Findings that are planted in texts for training, at most.
SAMPLE = 12_000
#: Characters before and after a candidate whose words are looked at.
NEAR = 48

# Words that announce a credential, and words of examples.
KEY_WORDS = "token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer"
EXAMPLE_WORDS = "example|sample|dummy|placeholder|changeme|redacted|your|test|fake|checksum|sha1|sha256|md5|commit|digest|uuid"

FEATURES = ("length", "digits", "upper", "switches", "transitions", "coverage", "path", "key_word", "assigned", "quoted", "example", "marks")


@dataclass
class Language:
    """Character transitions and a bitmap of the words of a corpus."""

    transitions: list[float]  # 27 * 27 mean log-probabilities, 26: anything else
    bitmap: bytes


def _bit(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), seed=42) % BITS


def learn_language(docs: DataFrame, text_col: str = "text") -> Language:
    """Counts words of 3 to 15 letters over all whole texts."""
    stages = Stages(docs.sparkSession, "secrets")
    word = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]{3,15}"), F.lit(0)))
    counts = stages.write(docs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") * RARE >= F.lit(total)).collect()  # at most RARE rows
    stages.drop(counts)
    pairs, bitmap = Counter(), bytearray(BITS // 8)
    for r in rows:
        at = _bit(r.word)
        bitmap[at >> 3] |= 1 << (at & 7)
        for a, b in zip(r.word, r.word[1:]):
            pairs[ord(a) - 97, ord(b) - 97] += r.n
    first = Counter()
    for (a, _), n in pairs.items():
        first[a] += n
    table = [math.log((pairs[a, b] + 0.5) / (first[a] + 13.5)) if a < 26 and b < 26 else -7.0 for a in range(27) for b in range(27)]
    return Language(table, bytes(bitmap))


def _features(c: str, i: str, parts: str, language: str, bitmap: str) -> dict[str, str]:
    """SQL of each feature of candidate ``c``, the ``i``-th between ``parts``."""
    left = f"lower(right({parts}[{i}], {NEAR}))"
    right = f"{parts}[{i} + 1]"
    # Characters are parted once: `substr` walks from the start each time.
    code = lambda at: f"if(l[{at}] between 'a' and 'z', ascii(l[{at}]) - 97, 26)"
    hit = f"shiftright(cast(conv(hex(substring({bitmap}, cast(shiftright(h, 3) as int) + 1, 1)), 16, 10) as int), cast(h & 7 as int)) & 1"
    words = f"transform(regexp_extract_all(regexp_replace({c}, '([a-z])([A-Z])', '$1 $2'), '[A-Za-z]{{3,15}}', 0), w -> named_struct('n', length(w), 'h', pmod(xxhash64(lower(w)), {BITS})))"
    covered = f"aggregate({words}, 0D, (acc, x) -> acc + if({hit.replace('h,', 'x.h,').replace('(h &', '(x.h &')} = 1, x.n, 0))"
    return {
        "length": f"cast(length({c}) as double)",
        "digits": f"length(regexp_replace({c}, '[^0-9]', '')) / length({c})",
        "upper": f"length(regexp_replace({c}, '[^A-Z]', '')) / length({c})",
        "switches": f"regexp_count({c}, '(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]') / length({c})",
        "transitions": f"transform(array(split(lower({c}), '')), l -> aggregate(sequence(0, length({c}) - 2), 0D, (acc, p) -> acc + {language}[{code('p')} * 27 + {code('p + 1')}]))[0] / (length({c}) - 1)",
        "coverage": f"{covered} / length({c})",
        "path": f"cast(regexp_count({c}, '/') + if(right({parts}[{i}], 1) in ('/', '.', '@', ':') or left({right}, 1) in ('/', '.', '@'), 1, 0) as double)",
        "key_word": f"if({left} rlike '({KEY_WORDS})', 1D, 0D)",
        "assigned": f"if({left} rlike '({KEY_WORDS})[\\\\w\\\\-]*[\"\\']?\\\\s*(=|:|=>)\\\\s*[\"\\']?$', 1D, 0D)",
        "quoted": f"if(right({parts}[{i}], 1) in ('\"', '\\'') and left({right}, 1) in ('\"', '\\''), 1D, 0D)",
        "example": f"if(concat({left}, ' ', lower(left({right}, {NEAR}))) rlike '\\\\b({EXAMPLE_WORDS})\\\\b', 1D, 0D)",
        "marks": f"length(regexp_replace({c}, '[A-Za-z0-9]', '')) / length({c})",
    }


def candidates(docs: DataFrame, language: Language, text_col: str, out_col: str) -> DataFrame:
    """``docs`` with an array of candidates: token, at and features.

    The pieces of text between the candidates are left in a column ``parts``.
    """
    cands, parts, table, bitmap = (fresh([*docs.columns, out_col], c) for c in ("cands", "parts", "letters", "bits"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn(cands, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    split = split.withColumn(parts, F.when(F.size(cands) > 0, F.split(text, CANDIDATE, -1)))
    split = split.withColumn(table, F.array(*[F.lit(round(x, 4)) for x in language.transitions])).withColumn(bitmap, F.lit(language.bitmap))
    feats = ", ".join(f"'{k}', {v}" for k, v in _features("c", "i", parts, table, bitmap).items())
    made = F.expr(f"transform({cands}, (c, i) -> named_struct('token', c, 'at', i, {feats}))")
    return split.withColumn(out_col, made).drop(table, bitmap, cands if cands != out_col else "")


def train_forest(findings: DataFrame, label_col: str = "label", trees: int = 15, depth: int = 5, seed: int = 3) -> list[str] | None:
    """Trees as SQL over ``{x}.feature``; null without findings of both kinds.

    ``findings`` has the columns of ``FEATURES`` and a label 0 or 1.
    """
    kinds = {r[0] for r in findings.select(label_col).distinct().collect()}
    if kinds != {0, 1}:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(findings.select(*FEATURES, F.col(label_col).cast("double").alias("y")))
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    return [_sql_of(t.toDebugString.splitlines()[1:]) for t in model.trees]


def _sql_of(lines: list[str]) -> str:
    """A printed tree as nested conditions (features that are off are 0)."""

    def build() -> str:
        line = lines.pop(0).strip()
        if m := re.match(r"Predict: ([\d.]+)", line):
            return f"{float(m[1])}D"
        m = re.match(r"If \(feature (\d+) (<=|<|in) (.+)\)$", line)
        yes = build()
        lines.pop(0)  # Else
        no = build()
        return f"if({{x}}.{FEATURES[int(m[1])]} {m[2]} {float(m[3])!r}D, {yes}, {no})"

    return build()


@dataclass
class Scanner:
    """A trained scan: ``findings`` lists secrets, ``redact`` replaces them."""

    language: Language
    trees: list[str] | None
    cutoff: float = 0.5

    def scored(self, docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
        found = candidates(docs, self.language, text_col, out_col)

        if self.trees is None:
            return found.withColumn(out_col, F.transform(out_col, lambda x: x.withField("score", F.lit(0.0))))
        votes = " + ".join(t.replace("{x}", "x") for t in self.trees)
        fields = ", ".join(f"'{k}', x.{k}" for k in ("token", "at"))
        return found.withColumn(out_col, F.expr(f"transform({out_col}, x -> named_struct({fields}, 'score', ({votes}) / {len(self.trees)}D))"))

    def findings(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """A row for each secret: id, start (characters before it), length, token, score.

        Null and empty texts have none; repeated rows repeat theirs.
        """
        slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        slim = slim.where(F.col("text").rlike(CANDIDATE))
        # Not `explode`: the optimizer would add a filter that computes the whole array again.
        rows = self.scored(slim, "text", "found")
        # Where each candidate starts: a running sum of the pieces' and candidates' lengths.
        sums = "aggregate(found, named_struct('pos', 0L, 'out', cast(array() as array<bigint>)), (acc, x) -> named_struct('pos', acc.pos + length(parts[x.at]) + length(x.token), 'out', concat(acc.out, array(acc.pos + length(parts[x.at]))))).out"
        rows = rows.withColumn("starts", F.expr(sums)).select("doc_id", F.explode_outer(F.arrays_zip(F.col("found").alias("f"), F.col("starts").alias("start"))).alias("z"))
        rows = rows.select("doc_id", "z.f", "z.start").where(F.col("f.score") >= self.cutoff)
        return rows.select("doc_id", "start", F.length("f.token").cast("long").alias("length"), "f.token", F.round("f.score", 6).alias("score"))

    def redact(self, docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
        """``docs`` with secrets replaced by ``mark``; other rows unchanged."""
        found, parts = (fresh(docs.columns, c) for c in ("found", "parts"))
        rows = self.scored(docs, text_col, found)
        # `candidates` leaves the pieces between candidates in `parts`.
        joined = F.expr(f"array_join(transform({parts}, (p, i) -> concat(p, if(i < size({found}), if({found}[i].score >= {self.cutoff}D, '{mark}', {found}[i].token), ''))), '')")
        any_ = F.exists(found, lambda x: x["score"] >= self.cutoff)
        out = rows.withColumn(text_col, F.when(any_, joined).otherwise(F.col(text_col)))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.when(any_, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
        return out.select(*docs.columns)


def _planted_forms() -> list[tuple[int, str]]:
    """(label, SQL of a piece of text) with one finding each.

    ``hex``, ``mixed``, ``upper``, ``number`` and ``word`` are fields of ``t``:
    random letters and digits of several alphabets, and a word of the text.
    """
    name = "element_at(array('token', 'secret', 'password', 'api_key', 'access_key', 'auth'), 1 + t.pick % 6)"
    bare = [f"concat(' ', {x}, ' ')" for x in ("substr(t.mixed, 1, 24 + t.pick % 20)", "substr(t.mixed, 1, 32)", "substr(t.hex, 1, 40)", "concat('AK', substr(t.upper, 1, 18))", "concat('ghx_', substr(t.mixed, 1, 36))")]
    given = [f"concat(' ', {name}, ' = \"', {x}, '\" ')" for x in ("substr(t.hex, 1, 40)", "substr(t.hex, 1, 32)", "substr(t.mixed, 1, 20 + t.pick % 24)", "concat(substr(t.mixed, 1, 20), '/', substr(t.mixed, 21, 19))")]
    other = [
        f"concat(' ', {name}, ': ', substr(t.mixed, 1, 28), ' ')", "concat(' Authorization: Bearer ', t.mixed, ' ')",
        "concat(' https://', t.word, ':', substr(t.mixed, 1, 24), '@host/ ')", f"concat(' export ', upper({name}), '=', substr(t.hex, 1, 32), ' ')",
    ]
    looks = [
        "concat(' commit ', substr(t.hex, 1, 40), ' ')", "concat(' sha256:', t.hex, ' ')", "concat(' checksum ', substr(t.hex, 1, 32), ' ')",
        "concat(' ', t.uuid, ' ')", "concat(' id=', t.uuid, ' ')", "concat(' /usr/', t.word, '/', t.word, '/share/', t.word, '_', t.pick, ' ')",
        "concat(' ', t.word, t.word, t.word, t.word, t.word, ' ')", "concat(' ', t.word, '_', t.word, '_', t.word, '_of_the_', t.word, ' ')", "concat(' ', initcap(t.word), initcap(t.word), 'Factory', initcap(t.word), 'Builder ')",
        "concat(' ', t.number, ' ')", "concat(' 2024-01-', 10 + t.pick % 18, '-', t.number, ' ')", f"concat(' ', {name}, ' = \"your-', replace({name}, '_', '-'), '-goes-here\" ')",
        f"concat(' example ', {name}, '=', repeat('x', 20), ' ')", f"concat(' ', {name}, ' = \"', t.word, '-', t.word, '-', t.word, '-secret\" ')", "concat(' img/', t.word, '/', substr(t.hex, 1, 20), '.png ')", "concat(' ', repeat('=-', 12), t.word, ' ')",
        "concat(' etag ', substr(t.hex, 1, 32), ' ')", "concat(' ', upper(t.word), upper(t.word), upper(t.word), upper(t.word), ' ')",
    ]
    return [(1, x) for x in bare + given + other] + [(0, x) for x in looks]


def planted(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """Labelled texts: text, token, label.

    Secrets and look-alikes of many forms are planted between words of real
    texts, each form once in every text; the label is what was planted, whatever
    its features.  A hash chooses texts for ``sample`` findings at most, each
    distinct one once, so that common copies do not crowd out others.
    """
    forms = _planted_forms()
    most = max(1, sample // len(forms))
    draw = F.xxhash64(F.lit(seed), text_col)
    # About three times the sample, for the copies among it.
    share = int(min(1.0, 3 * most / max(1, docs.count())) * (1 << 30))
    drawn = docs.select(F.col(text_col).alias("text"), draw.alias("draw")).where(F.pmod("draw", F.lit(1 << 30)) < share).where(F.length("text") >= 40)
    # Words around a random place of the text stand for it.
    place = F.pmod(F.shiftright("draw", 30), F.length("text") - 39).cast("int") + 1
    chosen = drawn.select("draw", F.substring("text", place, F.lit(240)).alias("text")).groupBy("draw").agg(F.min("text").alias("text")).orderBy("draw").limit(most)
    chosen = chosen.select("text", F.col("draw").alias("host"), F.explode(F.sequence(F.lit(0), F.lit(len(forms) - 1))).alias("kind")).withColumn("draw", F.xxhash64("host", "kind"))
    # Random text from digests of the draw.
    hexes = "sha2(concat('a', draw), 256)"
    mixed = " || ".join(f"translate(base64(unhex(sha2(concat('{k}', draw), 256))), '+/=', '')" for k in "bc")
    words = "filter(split(text, '[^A-Za-z]+'), w -> length(w) between 3 and 9)"
    given = chosen.selectExpr("text", "host", "kind", "draw", f"coalesce(try_element_at({words}, 1 + cast(pmod(draw, 7) as int)), 'value') AS word", f"{hexes} AS hex", f"{mixed} AS mixed")
    t = (
        "named_struct('pick', cast(pmod(shiftright(draw, 8), 1000) as int), 'word', lower(word), 'hex', hex, 'mixed', mixed, 'upper', upper(mixed), 'number', translate(substr(hex, 1, 24), 'abcdef', '123456'), "
        "'uuid', concat_ws('-', substr(hex, 1, 8), substr(hex, 9, 4), substr(hex, 13, 4), substr(hex, 17, 4), substr(hex, 21, 12)))"
    )
    rows = given.withColumn("t", F.expr(t))
    piece = label = None
    for i, (y, form) in enumerate(forms):
        here = F.col("kind") == i
        piece = F.when(here, F.expr(form)) if piece is None else piece.when(here, F.expr(form))
        label = F.when(here, y) if label is None else label.when(here, y)
    # After the first word that ends in the second tenth of the text.
    gap = "locate(' ', text, cast(length(text) / 10 as int) + 1)"
    rows = rows.withColumn("piece", piece).withColumn("label", label).withColumn("gap", F.expr(f"if({gap} = 0, length(text) + 1, {gap})"))
    return rows.selectExpr("concat(substr(text, 1, gap - 1), piece, substr(text, gap)) AS text", "piece", "label", "host")


def labelled_findings(docs: DataFrame, language: Language, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Features and label of the findings in ``planted`` texts, and their text's hash."""
    rows = candidates(planted(docs, text_col, sample), language, "text", "found").select("piece", "label", "host", F.explode_outer("found").alias("f"))
    # Of the candidates in a text only what was planted is labelled.
    return rows.where(F.col("f").isNotNull() & F.col("piece").contains(F.col("f.token"))).select("f.*", "label", "host")


def report(scanner: Scanner, findings: DataFrame) -> dict[str, float]:
    """Precision, recall and count of a forest on labelled findings."""
    if scanner.trees is None:
        return {"precision": 0.0, "recall": 0.0, "n": 0.0}
    votes = " + ".join(t.replace("{x}.", "") for t in scanner.trees)
    said = F.expr(f"({votes}) / {len(scanner.trees)}D") >= scanner.cutoff
    r = findings.select(said.alias("said"), (F.col("label") == 1).alias("is")).agg(
        F.count_if(F.col("said") & F.col("is")).alias("hit"), F.count_if("said").alias("said"), F.count_if("is").alias("is"), F.count("*").alias("n")
    ).first()
    return {"precision": r.hit / max(1, r.said), "recall": r.hit / max(1, r["is"]), "n": float(r.n)}


def train_scanner(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, labelled: DataFrame | None = None) -> Scanner:
    """A scanner for ``docs``.

    ``labelled`` findings (columns ``FEATURES`` and ``label``) may be given;
    else ``sample`` findings at most, planted in texts of ``docs``, are used.
    Without findings of both kinds nothing is a secret.
    """
    stages = Stages(docs.sparkSession, "findings")
    language = learn_language(docs, text_col)
    if labelled is None:
        labelled = stages.write(labelled_findings(docs, language, text_col, sample), "labelled")
    # The driver holds broadcasts of each plan and of each level of the trees until then.
    stages.release()
    scanner = Scanner(language, train_forest(labelled))
    stages.release()
    return scanner
