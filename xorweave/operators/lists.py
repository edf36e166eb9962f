"""Operators on lists of keys (one BIGINT column h)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import hash_key, msb, right_mask, unsigned_order


def random_keys(spark: SparkSession, n: int, seed: int, bits: int = 60) -> DataFrame:
    """n reproducible keys of ``bits`` bits."""
    return spark.range(n).select(hash_key(f"seed{seed}:", F.col("id"), bits).alias("h"))


def planted_lists(spark: SparkSession, n: int, bits: int = 60) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lists A, B, C of n keys (id, h), and the three planted pairs (a, b): the first rows, the last, and one inside."""
    lists = [spark.range(n).select("id", hash_key(f"seed{s}:", F.col("id"), bits).alias("h")) for s in (0, 1, 2)]
    picks = [(0, 0, 0), (n - 1, n - 1, n - 1), (n // 3, n // 2, n // 5)]
    at = spark.createDataFrame(picks, "c_id long, a_id long, b_id long")
    a, b = lists[0].toDF("a_id", "a"), lists[1].toDF("b_id", "b")
    planted = at.join(a, "a_id").join(b, "b_id").select("c_id", "a", "b", F.col("a").bitwiseXOR(F.col("b")).alias("x"))
    c = lists[2].join(F.broadcast(planted), F.col("id") == F.col("c_id"), "left").select("id", F.coalesce("x", "h").alias("h"))
    return lists[0], lists[1], c, planted.select("a", "b")


def sort_keys(keys: DataFrame) -> DataFrame:
    return keys.orderBy(unsigned_order(F.col("h")))


def unsorted_places(keys: DataFrame, pos: str) -> DataFrame:
    """Rows whose key is below the one before it in the order of ``pos`` (in ranges of positions, joined at
    their ends, so that no task sees the whole list)."""
    size = 1 << 20
    ranged = keys.select(F.col(pos).alias("p"), "h").withColumn("r", F.floor(F.col("p") / size))
    inner = ranged.withColumn("before", F.lag("h").over(Window.partitionBy("r").orderBy("p")))
    ends = ranged.groupBy((F.col("r") + 1).alias("r")).agg(F.max_by("h", "p").alias("end"))
    starts = inner.join(ends, "r", "left").withColumn("before", F.coalesce("before", "end"))
    return starts.filter(unsigned_order(F.col("h")) < unsigned_order(F.col("before"))).select(F.col("p").alias(pos), "h", "before")


def unique_keys(keys: DataFrame) -> DataFrame:
    return keys.select("h").distinct()


def duplicate_count(keys: DataFrame) -> DataFrame:
    """One row n_dups: rows beyond the first of each key; summed from counts by key."""
    return keys.groupBy("h").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_dups"))


def repeats(keys: DataFrame, order: str, ranges: int = 64) -> DataFrame:
    """Rows after the first of their key, by ``order``: h, the column, and rank (2 for the second).

    Ranks are counted within ``ranges`` ranges of each key, cut by the column between its least and greatest value, and
    what the ranges before hold is added; so a key that repeats often is ranked by many tasks. ``order`` is a whole number without nulls."""
    least = keys.groupBy("h").agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).filter("n > 1").drop("n")
    span = (F.col("high") - F.col("low")).cast("double") + 1
    own = keys.select("h", order).join(least, "h").withColumn("r", F.floor((F.col(order) - F.col("low")) / span * ranges))
    counts = own.groupBy("h", "r").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("h").orderBy("r")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("h", "r").orderBy(order)) + F.col("before")
    return own.join(before, ["h", "r"]).select("h", order, nth.cast("int").alias("nth")).filter("nth > 1")


def bucket_counts(keys: DataFrame, k: int, width: int = 64) -> DataFrame:
    return keys.groupBy(msb(F.col("h"), k, width).alias("prefix")).agg(F.count("*").alias("n"))


def bucket_index(keys: DataFrame, k: int, width: int = 64) -> DataFrame:
    """(prefix, off) for prefix 0..2^k: how many keys have a smaller prefix. The running sum goes over
    2^k counts, by their upper half first."""
    counts = bucket_counts(keys, k, width)
    every = keys.sparkSession.range((1 << k) + 1).withColumnRenamed("id", "prefix")
    rows = every.join(counts, "prefix", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("hi", F.shiftright("prefix", k // 2))
    tops = rows.groupBy("hi").agg(F.sum("n").alias("top"))
    base = tops.withColumn("base", F.sum("top").over(Window.orderBy("hi")) - F.col("top")).select("hi", "base")
    inside = F.sum("n").over(Window.partitionBy("hi").orderBy("prefix")) - F.col("n")
    return rows.withColumn("inside", inside).join(base, "hi").select("prefix", (F.col("base") + F.col("inside")).cast("long").alias("off"))


def bucket_skew(keys: DataFrame, k: int, width: int = 64) -> DataFrame:
    """One row: avg (integer), thin and fat: buckets of less than a third of avg, and of over 3 times it."""
    every = keys.sparkSession.range(1 << k).withColumnRenamed("id", "prefix")
    n = every.join(bucket_counts(keys, k, width), "prefix", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    avg = n.agg(F.expr(f"sum(n) div {1 << k}").alias("avg"))
    return n.crossJoin(F.broadcast(avg)).groupBy("avg").agg(F.count_if(F.col("n") < F.expr("avg div 3")).alias("thin"), F.count_if(F.col("n") > 3 * F.col("avg")).alias("fat"))


def advise(keys: DataFrame, most: int = 256) -> DataFrame:
    """One row prefix_width: the least width with at most ``most`` keys per bucket on average."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda w: F.call_function("shiftrightunsigned", F.col("n"), w) <= most)
    return keys.agg(F.count("*").alias("n")).select(F.element_at(fits, 1).cast("int").alias("prefix_width"))


def union_all(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


def masked(keys: DataFrame, bits: int) -> DataFrame:
    return keys.withColumn("h", F.col("h").bitwiseAND(F.lit(right_mask(bits))))
