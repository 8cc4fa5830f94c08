"""What the Python workers keep of packing while they work for other stages."""

import corpus_pipeline
from argusline.llm import packing


def test_the_pipelines_workers_remember_few_words(spark, monkeypatch):
    asked, of = [], packing.pieces
    monkeypatch.setattr(packing, "pieces", lambda *a: asked.append(a[-1]) or of(*a))
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{k}, the" for k in range(i * 7))) for i in range(12)], "doc_id long, text string")
    piped = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    assert asked == [corpus_pipeline.WORDS] and 2 * asked[0] <= 100_000
    # What is forgotten is made again, so the pieces are the same.
    few, many = packing.pack(docs, remember=3).collect(), packing.pack(docs).collect()
    assert asked[1:] == [3, packing.REMEMBER]
    assert sorted(piped) == sorted(few) == sorted(many) and len(piped) >= 12


def test_words_held_are_bounded():
    words = packing.TokenBytes(packing.default_tokenizer(), 10)
    whole = packing.TokenBytes(packing.default_tokenizer())
    for i in range(50):
        assert words.of(f"a{i} the b{i}, {i}") == whole.of(f"a{i} the b{i}, {i}")
        # A word with marks at its end may bring its parts along.
        assert len(words) + len(words.old) <= 2 * 12
