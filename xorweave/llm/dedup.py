"""Near-duplicates by MinHash with tensored banding.

A document is the set of its shingles, of 4 words in op3 and 5 in deduplicated. Instead of TABLES**2 independent bands, two
collections of TABLES sketches each (ROWS minhashes per sketch) are computed, and every pair of a
first and a second sketch is a table key: TABLES**2 tables for 2 * TABLES * ROWS minhashes.

1. Equal sets form classes; only the class's smallest id goes on.
2. Rows are grouped by first sketch; sketches that only one class has go. The second half of a table
   key is compared inside the group, so the TABLES**2 keys of a document are never written out.
3. In each group, the members are compared with one hub, chosen anew each round (linear in the
   members); groups whose members have grown into one component are done. What is left after
   HUB_ROUNDS is compared in blocks, on full sets, across components only.
4. Pairs that share a table key are first estimated from their minhashes, then confirmed on full sets.
5. Links become components by large-star and small-star steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored, table

ROWS = 5
TABLES = 28
HUB_ROUNDS = 2
#: Pairs whose minhashes agree on less than this share aren't confirmed: 5 standard deviations below 0.8.
LEAST_AGREEMENT = 0.68
#: Rows (of one or two numbers) that are sent to every task, at most; more go through a shuffle.
SENT = 1_000_000
#: Members of a group, and bytes of their sets, that a block holds, about.
MEMBERS, SET_BYTES = 1000, 1 << 25
#: Partners of a document that one task compares it with, about; pairs of one that has more are dealt into blocks.
PARTNERS = 1000
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_random = np.random.default_rng(20240613)
MULTIPLIERS = _random.integers(0, 2**31, 2 * TABLES * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _random.integers(0, 2**32, 2 * TABLES * ROWS, dtype=np.uint32)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: dict, k: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles (one of all words, if there are fewer)."""
    words = WORDS.findall((text or "").encode("utf-8", "replace").translate(AZ))
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), dtype=np.uint64)
    for i in range(min(k, len(h))):
        out = scramble(out * MIX[0] + h[i : i + n])
    return np.unique(out)


def minhashes(s: np.ndarray) -> np.ndarray:
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(MULTIPLIERS), 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(low), 64):  # blocks that stay in cache
        out = np.minimum(out, (low[i : i + 64, None] * MULTIPLIERS + OFFSETS).min(0))
    return out


def fold(parts: np.ndarray) -> np.ndarray:
    """One 64-bit key of each row."""
    out = np.full(parts.shape[0], 7, dtype=np.uint64)
    for i in range(parts.shape[1]):
        out = scramble(out * MIX[0] + parts[:, i])
    return out


SIGNED = "d_id long, n_shingles long, set_key binary, first array<long>, second array<long>, agree binary"


def sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, len(texts), 1000):
            rows: dict[str, list] = {name: [] for name in ("n", "key", "first", "second", "agree")}
            for text in texts.slice(at, 1000).to_pylist():
                s = shingles(text, hashes, k)
                rows["n"].append(len(s))
                if not len(s):
                    for name in ("key", "first", "second", "agree"):
                        rows[name].append(None)
                    continue
                m = minhashes(s)
                sketches = m.astype(np.uint64).reshape(2 * TABLES, ROWS)
                keys = fold(np.column_stack([np.arange(2 * TABLES, dtype=np.uint64), sketches])).view(np.int64)
                rows["key"].append(xxhash.xxh3_128_digest(s.tobytes()))
                rows["first"].append(keys[:TABLES])
                rows["second"].append(keys[TABLES:])
                rows["agree"].append(((m ^ (m >> np.uint32(8))) & np.uint32(255)).astype(np.uint8).tobytes())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, 1000).cast(pa.int64()), pa.array(rows["n"], pa.int64()), pa.array(rows["key"], pa.binary()), pa.array(rows["first"], longs), pa.array(rows["second"], longs), pa.array(rows["agree"], pa.binary())],
                ["d_id", "n_shingles", "set_key", "first", "second", "agree"],
            )


def set_bytes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            sets = [shingles(t, hashes, k).tobytes() for t in part.column(1).to_pylist()]
            keys = pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sets, pa.binary()), keys], ["s_id", "s_set", "set_key"])


def agreeing_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, block, v, second, agree) sorted by u, block and v, of which the one with a null v holds u's sketches: (u, v) that
    share a second sketch, and whose minhash bytes agree often enough, less what chance gives."""
    held, own, own_bytes = None, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    for batch in batches:
        u, block = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        v, none = np.asarray(batch.column(2).fill_null(0)), np.asarray(batch.column(2).is_null())
        second = np.asarray(batch.column(3).flatten()).reshape(len(batch), -1)
        agree = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
        cuts = np.flatnonzero((np.diff(u) != 0) | (np.diff(block) != 0) | none[1:]) + 1
        found: list[tuple] = []
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            if start < end and none[start]:
                held, own, own_bytes, start = (u[start], block[start]), second[start], agree[start], start + 1
            if start >= end or held != (u[start], block[start]):
                continue
            share = ((agree[start:end] == own_bytes).mean(1) - 1 / 256) / (1 - 1 / 256)
            rows = start + np.flatnonzero(share >= LEAST_AGREEMENT)
            rows = rows[(second[rows][:, :, None] == own).any((1, 2))]
            found.append((u[rows], v[rows]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *(f[i] for f in found)])) for i in (0, 1)], ["u", "v"])


def linked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, block, v, s_set) sorted by u, block and v, of which the one with a null v holds u's set:
    (u, v) where 100 * intersection >= 80 * union, on full sets."""
    held, own = None, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        found = []
        for u, block, v, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            other = np.frombuffer(raw, dtype=np.uint64)
            if v is None:
                held, own = (u, block), other
            elif held == (u, block):
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= 80 * (len(own) + len(other) - both):
                    found.append((u, v))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``links`` (u, v): comp is the smallest node reachable.

    Large-star then small-star, each a shuffle of the links with map-side minima, until the stars
    stay as they are (each round that changes something brings nodes closer to their smallest, so it ends); every round is
    written to the shared folder.
    """
    e = stored(links.select("u", "v").filter("u <> v").distinct(), "links")
    last = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def first_keys(reps: DataFrame) -> DataFrame:
    """(key, d_id, n, f, k_step, step): first sketches that two classes share, with their members and set sizes.

    Sets of similarity 0.8 differ in size by a quarter at most, so sizes are cut into steps of 1.25
    and each set goes by its own step and by the next: keys hold sets of like size only.
    """
    first = reps.select("d_id", "n", F.explode("first").alias("f"))
    shared = stored(first.groupBy("f").count().filter("count > 1").select("f"), "shared")
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.25)))
    own = first.join(small(shared, SENT), "f", "left_semi").withColumn("step", step).withColumn("k_step", F.explode(F.array("step", F.col("step") + 1)))
    own = stored(own.withColumn("key", F.xxhash64("f", "k_step")), "keys")
    twice = stored(own.groupBy("key").count().filter("count > 1").select("key"), "keys")
    return own.join(small(twice, SENT), "key", "left_semi")


def hub_pairs(placed: DataFrame, round_: int) -> DataFrame:
    """(u, v): a key's hub with each of its members, if they are of like size and not yet connected."""
    order = F.col("d_id") if round_ == 0 else F.xxhash64("d_id", F.lit(round_))
    hubs = placed.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("d_id").alias("hub"), F.col("comp").alias("hub_comp"), F.col("n").alias("hub_n"))).alias("h")).select("key", "h.*")
    like = F.expr("comp <> hub_comp and 100 * least(n, hub_n) >= 80 * greatest(n, hub_n)")
    return placed.join(hubs, "key").filter(like).select(F.col("hub").alias("u"), F.col("d_id").alias("v")).distinct()


def in_blocks(pairs: DataFrame) -> DataFrame:
    """(u, v, block): the partners of a document in blocks of about PARTNERS."""
    many = pairs.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > PARTNERS).select(F.col("u").alias("m_u"), F.ceil(F.col("n") / PARTNERS).alias("blocks"))
    rows = pairs.join(small(many, SENT), F.col("u") == F.col("m_u"), "left")
    return rows.select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("blocks", F.lit(1))).cast("long").alias("block"))


def beside(near: DataFrame, payload: DataFrame) -> DataFrame:
    """For each pair (u, v, block): u, block, v and the payload (d_id, ...) of v, after a row with that of u and a null v for each block."""
    own = [c for c in payload.columns if c != "d_id"]
    of = lambda rows, c, v: rows.join(payload, F.col(c) == F.col("d_id")).select("u", "block", v.alias("v"), *own)
    dealt = of(near, "v", F.col("v")).union(of(near.select("u", "block").distinct(), "u", F.lit(None).cast("long")))
    return dealt.repartition("u", "block").sortWithinPartitions("u", "block", F.asc_nulls_first("v"))


def agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of ``pairs`` that share a table key (a second sketch besides the first) and whose
    minhashes agree often enough."""
    near = in_blocks(stored(pairs, "pairs"))
    return beside(near, reps.select("d_id", "second", "agree")).mapInArrow(agreeing_rows, "u long, v long")


DEALT = ("key", "lo", "hi", "block", "d_id", "n", "comp", "second", "agree", "first", "f", "k_step", "step")


def candidates(rows: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """Rows (DEALT) of one key and pair of blocks: per row the later ones, or those of the other block, that share a table key with it
    under this key first, aren't connected to it, and agree often enough."""
    lo, hi = rows[0][1], rows[0][2]
    n, comp, step = (np.array([r[k] for r in rows]) for k in (5, 6, 12))
    second, first = np.array([r[7] for r in rows]), np.array([r[9] for r in rows])
    f, k_step = rows[0][10], rows[0][11]
    agree = np.frombuffer(b"".join(r[8] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
    of_lo, of_hi = (np.flatnonzero(np.array([r[3] for r in rows]) == b) for b in (lo, hi))
    for i in of_lo:
        other = of_hi[of_hi > i] if lo == hi else of_hi
        other = other[(comp[other] != comp[i]) & (np.maximum(step[other], step[i]) == k_step) & (100 * np.minimum(n[other], n[i]) >= 80 * np.maximum(n[other], n[i]))]
        other = other[((agree[other] == agree[i]).mean(1) - 1 / 256) / (1 - 1 / 256) >= LEAST_AGREEMENT]
        if len(other):
            same = first[other] == first[i]
            other = other[first[i][same.argmax(1)] == f]
            other = other[(second[other][:, :, None] == second[i]).any((1, 2))]
        if len(other):
            yield int(i), other


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each key and pair of blocks, of rows sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def with_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lo, hi, d_id) of the rows (DEALT) that have a candidate, or are one."""
    for rows in runs(batches):
        found = {x for i, other in candidates(rows) for x in (i, *other.tolist())}
        yield pa.RecordBatch.from_arrays([pa.array([rows[x][k] for x in sorted(found)], pa.int64()) for k in (0, 1, 2, 4)], ["key", "lo", "hi", "d_id"])


def linked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (DEALT and s_set): the links (u, v) among candidates, on full sets; a pair is looked at only while no link found here connects it."""
    for rows in runs(batches):
        sets, over, found = [np.frombuffer(r[13], dtype=np.uint64) for r in rows], {}, []

        def top(c: int) -> int:
            while c in over:  # noqa: B023
                c = over[c]  # noqa: B023
            return c

        for i, other in candidates(rows):
            for j in other.tolist():
                a, b = top(rows[i][6]), top(rows[j][6])
                if a == b:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    over[max(a, b)] = min(a, b)
                    found.append(sorted((rows[i][4], rows[j][4])))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])


def sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(d_id, s_set) of the ids (d_id), written: sets made anew from the texts; of rows that repeat an id, the one of the least hash."""
    texts = docs.join(small(ids, SENT), "d_id", "left_semi").select("d_id", "text")
    sets = texts.mapInArrow(lambda batches: set_bytes(batches, k), "s_id long, s_set binary, set_key binary")
    return stored(sets.filter("length(s_set) > 0").groupBy(F.col("s_id").alias("d_id")).agg(F.min_by("s_set", "set_key").alias("s_set")), "sets")


def rest_links(placed: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(u, v): links among a key's members that aren't connected, enough to connect what is linked. Keys of many or large
    members are cut into blocks, and pairs of blocks go to different tasks. Sketches are compared first; only members that have a candidate send their
    sets, once for each pair of blocks."""
    sizes = placed.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") * 8 / SET_BYTES)).alias("blocks"))
    own = placed.join(sizes, "key").join(reps.select("d_id", "first", "second", "agree"), "d_id").withColumn("block", F.pmod(F.xxhash64("d_id"), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).select(*DEALT)
    at = ["key", "lo", "hi"]
    some = dealt.repartition(*at).sortWithinPartitions(*at).mapInArrow(with_candidates, "key long, lo long, hi long, d_id long")
    some = stored(some, "candidates")
    sets = sets_of(stored(some.select("d_id").distinct(), "ids"), docs, k)
    full = dealt.join(some, [*at, "d_id"]).select(*DEALT).join(sets, "d_id").select(*DEALT, "s_set")
    return full.repartition(*at).sortWithinPartitions(*at).mapInArrow(linked_blocks, "u long, v long").distinct()


def confirmed(near: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The links among the pairs ``near`` (u, v), confirmed on full sets."""
    near = stored(in_blocks(stored(near, "near")), "blocks")
    ids = stored(near.select(F.col("u").alias("d_id")).distinct().union(near.select("v").distinct()).distinct(), "ids")
    return beside(near, sets_of(ids, docs, k)).mapInArrow(linked_rows, "u long, v long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hub_rounds: int = HUB_ROUNDS, k: int = 4) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id, kept; links are by shingles of ``k`` words.

    Null, empty and blank texts have no shingle, link with nothing and stay. Rows with a null id
    take the component of other rows with their set, and stay only if there is none.
    Rows that repeat an id share a node; if their sets differ, the one of the least hash stands for it.
    Ids are whole numbers, or texts of such; other texts raise. Other columns are ignored.
    A link of similarity exactly 0.8 is missed with a chance of about 1 in 30 000, closer ones less.
    """
    own = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).alias("text"))
    signed = stored(own.mapInArrow(lambda batches: sign(batches, k), SIGNED), "signed")
    fields = F.struct(F.col("n_shingles").alias("n"), "first", "second", "agree")
    classes = signed.filter("n_shingles > 0").groupBy("set_key").agg(F.min("d_id").alias("rep"), F.min_by(fields, "d_id").alias("of"))
    classes = stored(classes, "classes")
    reps = classes.filter("rep is not null").select(F.col("rep").alias("d_id"), "of.*", "set_key")
    again = stored(reps.groupBy("d_id").count().filter("count > 1").select("d_id"), "again")
    if not again.isEmpty():
        least = reps.join(again, "d_id", "left_semi").groupBy("d_id").agg(F.min_by(F.struct("n", "first", "second", "agree", "set_key"), "set_key").alias("of")).select("d_id", "of.*")
        reps = reps.join(again, "d_id", "left_anti").union(least)
    reps = reps.drop("set_key")
    placed = stored(first_keys(reps), "placed")
    near_ids = stored(placed.select("d_id").distinct(), "ids")
    reps = stored(reps.join(small(near_ids, SENT), "d_id", "left_semi"), "reps")
    placed = placed.withColumn("comp", F.col("d_id"))
    keys, links, comp = placed, None, None
    for r in range(hub_rounds + 1):
        if comp is not None:
            placed = keys.drop("comp").join(comp, F.col("d_id") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "d_id")).drop("node")
            split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
            keys = placed = stored(placed.join(split, "key", "left_semi"), "split")
            if placed.isEmpty():
                break
        found = stored(confirmed(agreeing(hub_pairs(placed, r), reps), own, k) if r < hub_rounds else rest_links(placed, reps, own, k), "found")
        links = found if links is None else links.union(found)
        comp = stored(components(links), "comp")
    member = classes.select("set_key", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("comp", "rep").alias("component"))
    out = signed.select("d_id", "n_shingles", "set_key").join(member, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("d_id"))
    kept = F.coalesce(F.col("d_id") == component, component.isNull())
    return out.select(F.col("d_id").alias(id_col), "n_shingles", component.alias("component_id"), kept.alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k, any_value(a.n) AS nu, any_value(b.n) AS nv
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM shared WHERE 100 * k >= 80 * (nu + nv - k)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM sets UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.v) AS component_id, s.doc_id = min(r.v) AS kept
FROM sets s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, s.s
"""


def deduplicated(docs: DataFrame, *, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps by shingles of ``k`` words, and one row of those that repeat an id; rows
    with a null id stay."""
    verdict = near_duplicates(docs, k=k)
    gone = stored(verdict.filter("not kept").select(F.col("doc_id").alias("g_id")).dropna().distinct(), "gone")
    stay = docs.join(gone, docs["doc_id"] == gone["g_id"], "left_anti")
    again = stored(docs.groupBy(F.col("doc_id").alias("r_id")).count().filter("count > 1 and r_id is not null").select("r_id"), "again")
    if again.isEmpty():
        return stay
    once = stay.join(again, stay["doc_id"] == again["r_id"], "left_anti")
    return once.unionByName(stay.join(again, stay["doc_id"] == again["r_id"], "left_semi").dropDuplicates(["doc_id"]))
