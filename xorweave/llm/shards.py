"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all documents of equal text (a null text is the empty one); its weight is the sum of their
sizes. Groups in falling order of weight enter the shard with the tightest room that still holds
them, found in a balanced tree of the open shards; where none does, a shard is opened. A group heavier
than the capacity gets a shard of its own. ``shards`` asks for a number of shards: the least
capacity is searched at which the packing needs no more. ``capacity`` asks for as few shards of
that capacity as the packing finds.

What is packed in one task stays bounded: groups below an ITEMS-th of all sizes first join lots, dealt by a
hash of the text, and lots are packed like groups. With ``capacity``, the groups are dealt to yards of about
YARD shards, each packed by its own task. Weights are summed before anything is shuffled; documents learn their shard
from the packed items, and their slot from counts per part of the table, so that no task holds
a group or a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stored, table

#: Own items and lots of a yard, each, about; and its shards.
ITEMS, YARD = 1 << 14, 256
#: The capacity that is searched is met to this part of it.
FINE = 4096
#: Bytes of a document besides its text.
OVERHEAD = 8

# A balanced (AVL) tree of distinct keys: None, or (key, left, right, height).


def _height(t: tuple | None) -> int:
    return t[3] if t else 0


def _node(key: tuple, left: tuple | None, right: tuple | None) -> tuple:
    return key, left, right, 1 + max(_height(left), _height(right))


def _balanced(key: tuple, left: tuple | None, right: tuple | None) -> tuple:
    if _height(left) > _height(right) + 1:
        k, a, b, _ = left
        if _height(a) >= _height(b):
            return _node(k, a, _node(key, b, right))
        return _node(b[0], _node(k, a, b[1]), _node(key, b[2], right))
    if _height(right) > _height(left) + 1:
        k, a, b, _ = right
        if _height(b) >= _height(a):
            return _node(k, _node(key, left, a), b)
        return _node(a[0], _node(key, left, a[1]), _node(k, a[2], b))
    return _node(key, left, right)


def insert(t: tuple | None, key: tuple) -> tuple:
    if t is None:
        return _node(key, None, None)
    return _balanced(t[0], insert(t[1], key), t[2]) if key < t[0] else _balanced(t[0], t[1], insert(t[2], key))


def remove(t: tuple, key: tuple) -> tuple | None:
    k, left, right, _ = t
    if key < k:
        return _balanced(k, remove(left, key), right)
    if key > k:
        return _balanced(k, left, remove(right, key))
    if left is None or right is None:
        return left or right
    after = right
    while after[1]:
        after = after[1]
    return _balanced(after[0], left, remove(right, after[0]))


def at_least(t: tuple | None, key: tuple) -> tuple | None:
    """The least key that isn't below ``key``."""
    found = None
    while t:
        if t[0] >= key:
            found, t = t[0], t[1]
        else:
            t = t[2]
    return found


def pack(weights: list[int], capacity: int) -> list[int]:
    """The bin of each weight; ``weights`` don't rise. A weight above the capacity has a bin of its own."""
    tree, bins, out = None, 0, []
    for w in weights:
        found = at_least(tree, (w, -1)) if w <= capacity else None
        if found:
            tree, (room, at) = remove(tree, found), found
        else:
            room, at, bins = capacity, bins, bins + 1
        if room > w:
            tree = insert(tree, (room - w, at))
        out.append(at)
    return out


def least_capacity(weights: list[int], bins: int) -> int:
    """A capacity at which ``pack`` needs at most ``bins`` bins, and below which, by a FINE-th part, it was found to need
    more or none can do. ``weights`` don't rise. Weights that nothing could be packed beside stand apart first."""
    rest, apart = sum(weights), 0
    while apart < min(bins - 1, len(weights)) and weights[apart] * (bins - apart) >= rest:
        rest -= weights[apart]
        apart += 1
    low = -(-rest // (bins - apart))  # needed by what is left
    high = low + (weights[apart] if apart < len(weights) else 0)  # always enough
    low -= 1
    while high - low > max(1, low // FINE):
        middle = (low + high) // 2
        if max(pack(weights, middle), default=-1) < bins:
            high = middle
        else:
            low = middle
    return max(1, high)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d_id, size, crc, g, at) of each row, written: g tells texts apart (two texts that share it form one group), at is
    the row's place, its part of the table in the upper bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("d_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("g"), F.monotonically_increasing_id().alias("at")
    )
    return stored(rows, "sizes")


def packed(base: DataFrame, shards: int | None, capacity: int | None) -> tuple[DataFrame, int]:
    """(yard, own, key, shard) of the items, written, and the number of yards. ``own``: key is the g of a heavy group, else a lot."""
    total = base.agg(F.sum("size")).first()[0] or 0
    yards = max(1, -(-total // (capacity * YARD))) if capacity else 1
    groups = base.groupBy("g").agg(F.sum("size").alias("weight")).withColumn("own", F.col("weight") * (ITEMS * yards) >= total)
    key = F.when(F.col("own"), F.col("g")).otherwise(lot_of())
    items = groups.select(yard_of(yards), "own", key.alias("key"), "weight").groupBy("yard", "own", "key").agg(F.sum("weight").alias("weight"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["weight", "own", "key"], ascending=[False, False, True])
        weights = [int(w) for w in own["weight"]]
        own["bin"] = np.array(pack(weights, capacity or least_capacity(weights, shards)), dtype=np.int64)
        return own[["yard", "own", "key", "bin"]]

    found = stored(items.groupBy("yard").applyInPandas(run, "yard long, own boolean, key long, bin long"), "packed")
    bins = found.groupBy("yard").agg((F.max("bin") + 1).alias("bins")).select(F.col("yard").alias("first_yard"), (F.sum("bins").over(Window.orderBy("yard")) - F.col("bins")).alias("first"))
    return found.join(small(bins, 100_000), F.col("yard") == F.col("first_yard")).select("yard", "own", "key", (F.col("first") + F.col("bin")).cast("int").alias("shard")), yards


def yard_of(yards: int):
    return F.pmod(F.xxhash64("g", F.lit(1)), F.lit(yards)).cast("long").alias("yard")


def lot_of():
    return F.pmod(F.xxhash64("g", F.lit(2)), F.lit(ITEMS)).cast("long")


def sharded(docs: DataFrame, *, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, size, text_crc32, law, shard, slot, grown_shard. The law is always ``bytes``.

    Rows of equal text share a shard, null and empty ones too, whatever their ids; null ids and repeated rows are rows
    like others. A shard's slots follow the order of the table's parts and rows. ``shards`` (at most ITEMS / 16) are
    numbered from 0, and some stay empty where there are fewer groups; an empty table gives no rows. Other columns are ignored."""
    if (shards is None) == (capacity is None) or not 0 < (shards or capacity) or (shards or 0) > ITEMS // 16:
        raise ValueError(f"give either shards, 1 to {ITEMS // 16}, or a capacity")
    base = measured(docs, id_col, text_col)
    items, yards = packed(base, shards, capacity)
    own = items.filter("own").select(F.col("key").alias("o_key"), F.col("shard").alias("o_shard"))
    lots = items.filter("not own").select(F.col("yard").alias("l_yard"), F.col("key").alias("l_key"), F.col("shard").alias("l_shard"))
    most = 4 * ITEMS * 16
    rows = base.join(small(own, most), F.col("g") == F.col("o_key"), "left")
    rows = rows.join(small(lots, most), F.col("o_shard").isNull() & (yard_of(yards) == F.col("l_yard")) & (lot_of() == F.col("l_key")), "left")
    rows = rows.select("d_id", "size", "crc", F.coalesce("o_shard", "l_shard").alias("shard"), F.shiftright("at", 33).alias("part"), "at")
    n = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part")
    starts = n.select(F.col("shard").alias("n_shard"), F.col("part").alias("n_part"), (F.sum("n").over(before) - F.col("n")).alias("start"))
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("at")))
    placed = placed.join(small(starts, 100_000), (F.col("shard") == F.col("n_shard")) & (F.col("part") == F.col("n_part")))
    return placed.select(F.col("d_id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), shards=24)
