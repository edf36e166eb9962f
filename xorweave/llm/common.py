"""Helpers that the operators of this folder share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of a text that a classifier is fitted on, at most; longer labelled texts are scored like all, but not learned from.
SAMPLE_CHARS = 200_000

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and the session is local a temporary folder stands in; a cluster
    without the setting raises.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local(\[[^-]*)?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="xorweave-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return "file://" + _own_dirs[app]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and no copy
    depends on one executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/xorweave-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only if ``df`` is counted to hold at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, keep: Column | None = None) -> DataFrame:
    """At most ``bound`` labelled rows (text, y), twice as many where ids repeat, the ones with the smallest md5 of their id.

    ``keep`` filters the labels first. Rows without a label, rows of unknown documents, and texts of more
    than SAMPLE_CHARS characters don't count.
    """
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("y")).dropna()
    if keep is not None:
        rows = rows.filter(keep)
    rows = rows.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "y").limit(bound)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    return texts.join(F.broadcast(rows), "doc_id").orderBy("doc_id", "y", "text").limit(2 * bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, keep: Column | None = None):
    """The rows of ``labelled_rows`` on the driver."""
    return labelled_rows(docs, labels, label, bound, keep).toPandas()
