"""Stores of keys and shares: partitioned Parquet and sorted binary folders, pruned range reads, saved indexes,
routed, split and purged shares."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import msb
from ..functions.shares import REASONS, SHARE_KEY, dedup_shares, part_of, reject_reason
from ..operators.lists import bucket_index, sort_keys
from .binary import Probe, manifest, opened
from .tasks import index_path


#: Shares of a bucket, about; buckets at most (Spark's limit); parts a bucket.
BUCKET_SHARES, MOST_BUCKETS, PARTS = 500_000, 100_000, 16


def save_keys(keys: DataFrame, path: str, k: int, width: int = 64) -> None:
    """Keys (h) in a folder per prefix of ``k`` bits, each sorted."""
    rows = keys.select("h", msb(F.col("h"), k, width).alias("prefix"))
    rows.repartition(F.col("prefix")).sortWithinPartitions("prefix", "h").write.partitionBy("prefix").parquet(path)


def key_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """The keys of prefixes low to high - 1; no other folder is read."""
    rows = spark.read.schema("h long, prefix long").parquet(path)
    return rows.filter((F.col("prefix") >= low) & (F.col("prefix") < high)).select("h")


def save_index(keys: DataFrame, path: str, k: int, width: int = 64) -> None:
    bucket_index(keys, k, width).write.parquet(path)


def load_index(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(prefix, off) of 2^k + 1 prefixes; raises if there are fewer or more, or if they don't rise from 0."""
    rows = spark.read.schema("prefix long, off long").parquet(path)
    after = rows.select((F.col("prefix") - 1).alias("prefix"), F.col("off").alias("after"))
    n, low, high = rows.agg(F.count_distinct("prefix"), F.min("prefix"), F.max("prefix")).first()
    falls = rows.join(after, "prefix").filter("after < off").limit(1).count()
    if (n, low, high) != ((1 << k) + 1, 0, 1 << k) or rows.count() != n or falls:
        raise ValueError(f"{path} isn't an index of {(1 << k) + 1} prefixes")
    return rows


def save_sorted(keys: DataFrame, uri: str) -> None:
    """Keys (h) in ascending order without sign as a sorted folder: cut into ranges by Spark's sort, a part per task."""
    sort_keys(keys.select("h").dropna()).write.format("xor_keys").option("sorted", "true").mode("append").save(uri)


def sorted_keys(spark: SparkSession, uri: str) -> DataFrame:
    """(pos, h, before) of a sorted folder; raises where the order is broken."""
    return spark.read.format("xor_keys").option("positions", "true").option("ascending", "true").load(uri)


def duplicate_positions(spark: SparkSession, uri: str) -> DataFrame:
    """(pos, h): places whose key is the one in front of it again. No shuffle: ranges read the key in front of them."""
    return sorted_keys(spark, uri).filter(F.col("h") == F.col("before")).select("pos", "h")


def probed_index(spark: SparkSession, uri: str, k: int, width: int = 64, counted: bool = False) -> DataFrame:
    """(prefix, off) for prefix 0..2^k of a sorted folder, by binary search of each border in the part that holds it; ``counted``:
    and probes, the keys that were read for it."""
    parts = manifest(uri)
    ends = np.cumsum([0, *(p["n"] for p in parts)]).tolist()
    greatest = [p["greatest"] for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = opened(uri)
        files: dict[int, Probe] = {}
        for batch in batches:
            off, reads = [], []
            for prefix in batch.column(0).to_pylist():
                key = prefix << (width - k)
                i = bisect_left(greatest, key)
                if i == len(parts):
                    off.append(ends[-1])
                    reads.append(0)
                    continue
                if i not in files:
                    files = {i: Probe(where.open_input_file(parts[i]["path"]), parts[i]["n"])}
                seen = files[i].reads
                off.append(ends[i] + bisect_left(files[i], key))
                reads.append(files[i].reads - seen)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(off, pa.int64()), pa.array(reads, pa.int64())], ["prefix", "off", "probes"])

    borders = spark.range(0, (1 << k) + 1, 1, max(1, min(spark.sparkContext.defaultParallelism, (1 << k) // 256))).withColumnRenamed("id", "prefix")
    found = borders.mapInArrow(run, "prefix long, off long, probes long")
    return found if counted else found.select("prefix", "off")


def save_flat_index(spark: SparkSession, uri: str, k: int, width: int = 64) -> None:
    """Writes the index of a sorted folder beside its parts: 2^k + 1 offsets of 8 bytes."""
    off = [r["off"] for r in probed_index(spark, uri, k, width).orderBy("prefix").collect()]  # 2^k + 1 numbers
    where, path = opened(uri)
    with where.open_output_stream(index_path(path, k)) as f:
        f.write(np.array(off, dtype="<i8").tobytes())


def route_keys(shares: DataFrame, path: str) -> None:
    """Keys of shares (kind, h) in a folder per kind."""
    shares.select("h", "kind").write.partitionBy("kind").parquet(path)


def write_accounted(shares: DataFrame, path: str, zero_bits: int = 32) -> dict[str, int]:
    """Writes shares in one pass, in a folder per reason: ``ok``, or why a share can't be used; returns the number of
    rows by reason, as counted while they were written (reasons without rows: 0)."""
    rows = reject_reason(shares, zero_bits)
    seen = Observation(f"rejects-{uuid.uuid4().hex}")
    rows.observe(seen, *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS]).write.partitionBy("reason").parquet(path)
    return {r: int(seen.get[r]) for r in REASONS}


def split_shares(shares: DataFrame, path: str, n: int) -> None:
    """Shares in a folder per part."""
    shares.withColumn("part", part_of(n)).write.partitionBy("part").parquet(path)


def purge_shares(spark: SparkSession, source: str, target: str) -> int:
    """Writes the shares of one folder to another, without duplicates, and returns how many were dropped."""
    rows = spark.read.parquet(source)
    dedup_shares(rows).select(*rows.columns).write.parquet(target)
    return rows.count() - spark.read.parquet(target).count()


def buckets_for(rows: int) -> int:
    """Buckets of about BUCKET_SHARES shares each, 16 at least."""
    return max(16, min(MOST_BUCKETS, -(-rows // BUCKET_SHARES)))


def bucket_shares(shares: DataFrame, table: str, path: str, n: int) -> DataFrame:
    """Shares as a table of n buckets by their part, so that those that are alike stand in one bucket. There are PARTS times more parts than buckets, so that
    buckets, which take parts by hash, come out about even."""
    rows = shares.withColumn("part", part_of(n * PARTS))
    rows.repartition(n, "part").write.bucketBy(n, "part").option("path", path).format("parquet").saveAsTable(table)
    return shares.sparkSession.table(table)


def purged_by_part(bucketed: DataFrame) -> DataFrame:
    """One share per nonces, time and kind, of highest difficulty, bucket by bucket: no row leaves its task."""
    return bucketed.groupBy("part", *SHARE_KEY).agg(F.max("difficulty").alias("difficulty")).drop("part")


def save_list(keys: DataFrame, uri: str, k: int, width: int = 64) -> str:
    """A sorted folder with its flat index, for the join by tasks."""
    save_sorted(keys, uri)
    save_flat_index(keys.sparkSession, uri, k, width)
    return uri


def save_ids(keys: DataFrame, uri: str) -> str:
    """Ids in the order of their keys (h, id), which differ."""
    sort_keys(keys.select("h", "id")).select(F.col("id").alias("h")).write.format("xor_keys").mode("append").save(uri)
    return uri
