"""A training corpus from ``documents``: toxic documents go, poor ones go, one of each group of near
copies stays, sources are mixed to weights, and the rest is encoded.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read as the next one's
docs. The two classifiers are fitted on a bounded sample of the labelled rows of sf_dir.

All stages share their executors' memory with the Python workers. Each stage therefore has its session send rows to Python
in Arrow batches of about BATCH bytes, however long the texts are, instead of by 10 000 rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xorweave.llm import bpe, dedup, mixing, quality, toxicity
from xorweave.llm.common import stored, table

#: Bytes of an Arrow batch, about (or one row): twice what bpe cuts at once.
BATCH = 1 << 22


def in_small_batches(stage: Callable) -> Callable:
    """``stage``, with batches of BATCH bytes from then on, as its result is computed after it returns."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(~toxicity.scored(F.col("text"), model)["toxic"])


@in_small_batches
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(quality.quality(F.col("text"), model) >= 0.3)


@in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.deduplicated(docs)


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", drop_copies), ("mixing", mix_sources), ("bpe", encode)]

#: SQL cannot express the two classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
