"""Sharding against a plain best-fit-decreasing, and its promises on whole tables."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("xorweave.llm")
from xorweave.llm import shards  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain(weights, capacity):
    rooms, out = [], []
    for w in weights:
        fits = [(room, i) for i, room in enumerate(rooms) if room >= w] if w <= capacity else []
        if fits:
            i = min(fits)[1]
            rooms[i] -= w
        else:
            i = len(rooms)
            rooms.append(max(0, capacity - w))
        out.append(i)
    return out


def test_packing():
    r = random.Random(2)
    for trial in range(200):
        weights = sorted((r.randrange(1, 60) for _ in range(r.randrange(0, 80))), reverse=True)
        capacity = r.randrange(1, 120)
        bins = shards.pack(weights, capacity)
        assert bins == plain(weights, capacity), trial
        n = r.randrange(1, 12)
        least = shards.least_capacity(weights, n)
        assert max(shards.pack(weights, least), default=-1) < n
        filled = [0] * n
        for w, b in zip(weights, shards.pack(weights, least), strict=True):
            filled[b] += w
        rest = sorted(weights, reverse=True)
        while len(rest) > 0 and n > 1 and rest[0] * n >= sum(rest):
            rest, n = rest[1:], n - 1
        if rest:  # what isn't apart is near the even share
            assert least <= -(-sum(rest) // n) + rest[0]


def test_tree():
    r, tree, held = random.Random(4), None, set()
    for _ in range(4000):
        key = (r.randrange(300), r.randrange(5))
        if key in held:
            tree = shards.remove(tree, key)
            held.discard(key)
        else:
            tree = shards.insert(tree, key)
            held.add(key)
        asked = (r.randrange(300), -1)
        assert shards.at_least(tree, asked) == min((k for k in held if k >= asked), default=None)
        assert shards._height(tree) <= 1.45 * max(1, len(held)).bit_length() + 1


def checked(rows, out, n=None):
    """The promises of every row; returns the shards' sizes."""
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in out) == sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    text_of = {}
    for i, t in rows:
        text_of.setdefault((i, zlib.crc32((t or "").encode())), t or "")
    homes, sizes, slots = {}, {}, {}
    for r in out:
        homes.setdefault(text_of[r.doc_id, r.text_crc32], set()).add(r.shard)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and (n is None or 0 <= r.shard < n)
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_op12(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = shards.op12_sharding(spark, SF).collect()
    sizes = checked(rows, out, 24)
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 8
    weights = sorted(groups.values(), reverse=True)
    # every group is an item of its own here, so the shards are those of the plain packing
    capacity = shards.least_capacity(weights, 24)
    filled = {}
    for w, b in zip(weights, plain(weights, capacity), strict=True):
        filled[b] = filled.get(b, 0) + w
    assert sorted(sizes.values()) == sorted(filled.values())


def test_many_small_documents(spark):
    """Far more groups than items: lots. A third of all rows are copies of one text."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy " * 30).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    out = shards.sharded(docs, shards=24).collect()
    sizes = checked([(r.doc_id, r.text) for r in docs.collect()], out, 24)
    alone = max(sizes.values())
    rest = sorted(sizes.values())[:-1]
    assert alone == 20_000 * 158 and len(rest) == 23 and rest[-1] <= 1.03 * sum(rest) / 23 and rest[0] >= 0.9 * sum(rest) / 23


def test_capacity(spark, monkeypatch):
    monkeypatch.setattr(shards, "YARD", 4)
    docs = spark.range(3000).select("id", F.concat(F.lit("text "), (F.col("id") * 7919 % 1000).cast("string"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int"))).alias("body"))
    out = shards.sharded(docs.withColumn("size", F.lit("s")).withColumn("shard", F.lit(1)), capacity=3000, id_col="id", text_col="body").withColumnRenamed("id", "doc_id").collect()
    sizes = checked([(r.id, r.body) for r in docs.collect()], out)
    total = sum(sizes.values())
    assert max(sizes.values()) <= 3000 and sorted(sizes) == list(range(len(sizes))) and len(sizes) <= 1.3 * total / 3000


def test_awkward_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, None), (3, ""), (None, None), (4, "naïve \U0001f600"), (5, "ab cd " * 20_000), (6, "b")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, slot long, shard int")
    sizes = checked(rows, shards.sharded(docs, shards=3).collect(), 3)
    assert max(sizes.values()) == 120_008
    assert shards.sharded(docs.limit(0), shards=3).count() == 0
    with pytest.raises(ValueError, match="either"):
        shards.sharded(docs)
