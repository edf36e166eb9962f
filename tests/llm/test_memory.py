"""What Python workers are sent and keep is bounded, and results don't depend on it."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("xorweave.llm")
from xorweave.llm import toxicity  # noqa: E402

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_pipeline_batches(spark):
    """After any stage began, rows go to Python in batches of BATCH bytes; 19 MB went as one before."""
    import corpus_pipeline as p

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"bytes": pa.array([batch.nbytes], pa.int64()), "n": pa.array([len(batch)], pa.int64())})

    docs = spark.range(0, 9000, 1, 1).selectExpr("id AS doc_id", "repeat('ab ', 700) AS text", "'a' AS source")
    before = spark.conf.get(BYTES, None)
    try:
        for _, stage in p.STAGES:
            spark.conf.unset(BYTES)
            with pytest.raises(Exception):  # noqa: B017
                stage(spark, None, "/nowhere")
            rows = docs.mapInArrow(sizes, "bytes long, n long").collect()
            assert sum(r["n"] for r in rows) == 9000 and max(r["bytes"] for r in rows) <= 1.1 * p.BATCH
    finally:
        spark.conf.unset(BYTES) if before is None else spark.conf.set(BYTES, before)


def test_toxicity_known_words():
    """A task remembers some KNOWN words, however many its texts have, and scores texts as when each stands alone."""
    texts = [" ".join(f"w{i * 5000 + j}" for j in range(5000)) + " bad" * (i % 3) for i in range(90)]
    model = {"w": {"bad": 2.0, "w10-": 0.01, "w44999": 1.5}, "theta": [1.0, 2.0, 3.0]}
    features = toxicity.Features({x: i for i, x in enumerate(model["w"])})
    own = toxicity.severity(model, texts, features)
    assert len(features) < 300_000
    each = [toxicity.severity(model, [t]) for t in texts]
    for k in (0, 1):
        assert np.array_equal(own[k], np.concatenate([e[k] for e in each]))
