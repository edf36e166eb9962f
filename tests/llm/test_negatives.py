"""Hard negatives against brute force."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("xorweave.llm")
from xorweave.llm import negatives  # noqa: E402


def brute(rows, positives=5, wanted=10, low=Fraction(3, 10), high=Fraction(9, 10)):
    """``rows`` (id, label, whole numbers); anchors are ids divisible by 100."""
    out = []
    for i, label, v in rows:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, other, w in rows if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            found = [x for x in scored if x[2] != label and -s * low <= -x[0] <= -s * high][:wanted]
            out += [(i, j, n, k, -s, -t) for n, (t, k, _) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, score double, rank string")


def mined(spark, rows, **more):
    index, centres = negatives.build_index(frame(spark, [(*r, 0.5, "x") for r in rows]))
    found = negatives.mined(index, centres, index.filter("v_id % 100 = 0").select("v_id", "label", "v"), **more)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    other = c.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({negatives.OP13_SQL})").fetchall()
    assert sorted(map(tuple, negatives.op13_negatives(spark, f"/root/testdata/{sf}").collect())) == sorted(other) and other


def test_brute(spark):
    """Ties (few different vectors), a third of all rows of one label and vector, other windows."""
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(0, 3)), [float(x) for x in r.integers(-3, 4, 6) / 8]) for i in range(700)]
    rows = [(i, 1, [0.5] * 6) if i % 3 == 0 else x for i, x in enumerate(rows)]
    want = [(i, label, whole(v)) for i, label, v in rows]
    assert mined(spark, rows) == brute(want)
    assert mined(spark, rows, positives=2, negatives=3, low=Fraction(-1, 3), high=Fraction(2, 7)) == brute(want, 2, 3, Fraction(-1, 3), Fraction(2, 7))


def test_awkward_rows(spark):
    bad = [(900, None, [1.0, 2.0]), (901, 1, None), (902, 1, [1.0, None]), (903, 1, [float("nan"), 1.0]), (904, 1, [float("inf"), 1.0]), (905, 1, []), (None, 1, [1.0, 1.0])]
    good = [(0, 1, [0.0, 0.0]), (100, 1, [1.0, 0.5]), (200, 2, [-1.0, 0.25]), (201, 2, [0.5, 0.5]), (202, 2, [0.25, 0.125]), (203, 1, [0.75, 0.5]), (300, 1, [1.0, 2.0, 3.0]), (301, 1, [1.0, 1.0, 1.0]), (302, 2, [0.5, 0.5, 0.5]), (400, 1, [1e6, -1e6]), (401, 1, [1e6, 0.0])]
    assert mined(spark, good + good + bad) == brute([(i, label, whole(v)) for i, label, v in good])
    assert mined(spark, [(5, 2, [1.0, 1.0]), (5, 1, [1.0, 0.5]), *good]) == brute([(5, 1, whole([1.0, 0.5])), *[(i, label, whole(v)) for i, label, v in good]])
    assert mined(spark, bad) == []


def test_bounds_hold_and_filter(spark):
    """No interval misses its score, and few rows need one."""
    r = np.random.default_rng(8)
    x = np.floor(256 * r.standard_normal((3000, 32)) / 6).astype(np.int64)
    for centres in (negatives.centres_on(x[:1000]), None):
        codes, norms = negatives.encode(x, centres)
        block = negatives.Block(np.arange(3000), np.arange(3000) % 3, x, codes, norms, centres)
        for i in range(20):
            low, high = block.intervals(x[i])
            true = x @ x[i]
            assert (low <= true).all() and (true <= high).all()
    index, centres = negatives.build_index(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    every = F.array(F.struct(F.lit(0).alias("window"), F.lit(-negatives.FAR).alias("low"), F.lit(negatives.FAR).alias("high")))
    seen = negatives.search(index, centres, index.filter("v_id % 100 = 0").select("v_id", "label", "v").withColumn("windows", every), same=False, k=10, measured=True)
    exact, all_rows = seen.agg(F.sum("exact"), F.sum("candidates")).first()
    assert exact < 0.6 * all_rows  # blocks of 2000 / 8 rows here: ten of each are wanted
