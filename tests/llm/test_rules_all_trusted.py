"""Every trusted text tells the rules of op12 something."""

import math

from pyspark.sql import functions as F

from argusline.llm import llr_rules


def test_no_trusted_text_is_left_out(spark):
    """More trusted texts than were once looked at; joined by a shuffle as well as by a broadcast."""
    n, texts = 24_000, 26_000
    docs = spark.range(texts).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, F.concat(F.lit("good"), F.col("id") % 7)).otherwise("other").alias("text"))
    trusted = docs.where(F.col("doc_id") < n).select("doc_id")
    buckets = 1 << 16
    told = {r.text: (r.n, r.t) for r in docs.withColumn("t", (F.col("doc_id") < n) & (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(llr_rules.FOLDS)) != 0)).groupBy("text").agg(F.count("*").alias("n"), F.count_if("t").alias("t")).collect()}
    share = sum(t for _, t in told.values()) / texts
    # A text of one word is that word and, as a pair, the word alone.
    place = {r.text: (r.b, r.p) for r in docs.select("text").distinct().select("text", F.pmod(F.xxhash64("text"), F.lit(buckets)).alias("b"), F.pmod(F.xxhash64(F.xxhash64("text"), F.lit(None).cast("long")), F.lit(buckets)).alias("p")).collect()}
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most in (usual, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            weights = llr_rules.weights(docs, trusted, buckets=buckets).first().weights
            for text, (all_n, t) in told.items():
                want = round(llr_rules.UNIT * math.log((t + 1) / (share * all_n + 1)))
                assert all(abs(weights[b] - want) <= 1 for b in place[text])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
