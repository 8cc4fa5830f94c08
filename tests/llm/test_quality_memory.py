"""What the driver holds while the quality scorer is fitted."""

import numpy as np

from argusline.llm import quality


def test_the_drawn_texts_reach_the_driver_as_arrays(spark, monkeypatch):
    """A number of a feature takes its own bytes, not those of a Python object."""
    seen, fit = [], quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda rows: seen.extend(rows) or fit(rows))
    docs = spark.createDataFrame([(i, f"the word{i} and of it stands here, as it was. " * (1 + i % 3)) for i in range(40)], "doc_id long, text string")
    weights = quality.fit(docs, "doc_id", "text", 25, 11)
    assert 0 < len(seen) <= 25 and all(isinstance(v, np.ndarray) for at, x, _ in seen for v in (at, x))
    assert all(len(at) == len(x) and (np.diff(at) > 0).all() for at, x, _ in seen)
    assert (weights == fit([(at.tolist(), x.tolist(), p) for at, x, p in seen])).all()
