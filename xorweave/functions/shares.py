"""Shares to keys: block assembly, double SHA-256 and key extraction as columns over hex strings.

A share has kind (0..2), difficulty, extraNonce2, extraNonce1, nonce, ntime; the last four are
unsigned 32-bit numbers in BIGINT columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 36 bytes before the merkle root by kind, and the coinbase before and after the nonces.
PREFIXES = (
    "464f4f2d20202020202020202020202020436861726c657320426f75696c6c6167756574",
    "4241522d202020202020202020202020205069657272652d416c61696e20466f75717565",
    "464f4f4241522d20202020202020202020202020436c616972652044656c61706c616365",
)
COINBASE_HEAD = "01000000010000000000000000000000000000000000000000000000000000000000000000ffffffff20020862062f503253482f04b8864e5008"
COINBASE_TAIL = "072f736c7573682f000000000100f2052a010000001976a914d23fcdf86f7e756a64a7a9688ef9903327048ed988ac00000000"
MARK = "deadbeef"
#: What shares that are the same have in common.
SHARE_KEY = ("extraNonce2", "extraNonce1", "nonce", "ntime", "kind")


def big_endian(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 8, "0")


def little_endian(x: Column) -> Column:
    h = big_endian(x)
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def double_sha(hex_text: Column) -> Column:
    return F.sha2(F.unhex(F.sha2(F.unhex(hex_text), 256)), 256)


def block_hex() -> Column:
    """The 80-byte block of a share row, in hex; null for another kind than 0..2."""
    coinbase = F.concat(F.lit(COINBASE_HEAD), big_endian(F.col("extraNonce1")), big_endian(F.col("extraNonce2")), F.lit(COINBASE_TAIL))
    prefix = F.when(F.col("kind") == 0, PREFIXES[0]).when(F.col("kind") == 1, PREFIXES[1]).when(F.col("kind") == 2, PREFIXES[2])
    return F.concat(prefix, double_sha(coinbase), little_endian(F.col("ntime")), F.lit(MARK), little_endian(F.col("nonce")))


def key_of(digest: Column) -> Column:
    """Bytes 19 to 26 of a digest, least significant first, as a 64-bit key."""
    return F.conv(F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(26, 18, -1)]), 16, -10).cast("long")


def with_key(shares: DataFrame, *, strict: bool = False) -> DataFrame:
    """Adds digest (hex), h (the key) and ok (the digest's last 32 bits are zero). Rows of other kinds go;
    with ``strict`` so do those that aren't ok."""
    rows = shares.filter(F.col("kind").between(0, 2)).withColumn("digest", double_sha(block_hex()))
    rows = rows.withColumn("h", key_of(F.col("digest"))).withColumn("ok", F.substring("digest", 57, 8) == "00000000")
    return rows.filter("ok") if strict else rows


#: What reject_reason says of a share.
REASONS = ("ok", "kind", "null", "digest")


def reject_reason(shares: DataFrame, zero_bits: int = 32) -> DataFrame:
    """Adds h and reason: ``kind`` for another kind than 0..2, ``null`` if a number of its block is missing (h is null in both
    cases), ``digest`` if the digest doesn't end with so many zero bits (a multiple of 4), else ``ok``."""
    rows = shares.withColumn("digest", double_sha(block_hex()))
    ends = F.right("digest", F.lit(zero_bits // 4)) == "0" * (zero_bits // 4)
    known = F.coalesce(F.col("kind").between(0, 2), F.lit(False))
    reason = F.when(~known, "kind").when(F.col("digest").isNull(), "null").when(~ends, "digest").otherwise("ok")
    return rows.withColumn("h", key_of(F.col("digest"))).withColumn("reason", reason).drop("digest")


def kind_stats(shares: DataFrame) -> DataFrame:
    """Per kind: number of shares, and the sum of cube roots of difficulty."""
    return shares.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum(F.cbrt(F.col("difficulty").cast("double"))), 4).alias("work"))


def work_bits(stats: DataFrame) -> DataFrame:
    """One row: log2 of the work of all kinds plus 32."""
    return stats.agg((F.sum(F.log2("work")) + 32).alias("bits"))


def part_of(n: int) -> Column:
    return F.col("extraNonce2").bitwiseXOR(F.col("nonce")).bitwiseXOR(F.col("ntime")) % n


def dedup_shares(shares: DataFrame) -> DataFrame:
    """One row per nonces, time and kind: the one of highest difficulty."""
    return shares.groupBy(*SHARE_KEY).agg(F.max("difficulty").alias("difficulty"))


def duplicate_shares(shares: DataFrame) -> DataFrame:
    """One row n_dups: shares beyond the first of their nonces, time and kind."""
    n = shares.groupBy(*SHARE_KEY).count()
    return n.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_dups"))


def winner_text() -> Column:
    """How a share of the best solution is printed."""
    return F.format_string('Share("%08x", "%08x", "%08x", kind=%d, D=%d, extranonce1="%08x")', "extraNonce2", "nonce", "ntime", "kind", "difficulty", "extraNonce1")


def share_text() -> Column:
    return F.format_string("(%d) -- %08x | %08x | %08x | %08x", "kind", "extraNonce2", "extraNonce1", "nonce", "ntime")
