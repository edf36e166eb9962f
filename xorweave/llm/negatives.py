"""Hard negatives by product quantisation with stored residual norms.

Vectors become whole numbers, floor(scale * x). The index keeps of each the codes of its pieces of
PIECE numbers (the nearest of 256 centres each) and the norms of what the centres leave, in GROUPS parts.
For an anchor, lookup tables over the codes give an estimate of each inner product, and the anchor's
norms times the residual norms bound its error (Cauchy-Schwarz, part by part). So a row whose
interval misses a window, or lies below as many rows surely in the window as are wanted, can't be
among its first and goes; all others are scored exactly in whole numbers.

First an anchor's positives are searched, the first of its label; then, for each of them, the
first rows of other labels within the window that its score sets. All rows are indexed. Index rows are dealt by
hash into blocks of bounded size, anchors go to every block, and a shuffle merges the first of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ann import by_dimension
from .common import stored, table

#: Numbers (rows times dimension) of an index block, on average at most.
BLOCK = 1 << 24
#: Numbers per piece, centres per piece, and parts in which residual norms are kept.
PIECE, CENTRES, GROUPS = 2, 256, 4
#: Rows that the centres are fitted on, at most, and rounds of fitting.
SAMPLE, ROUNDS = 16_384, 8
#: Anchors that are searched for at a time.
AT_ONCE = 64
#: No score lies beyond.
FAR = 1 << 62


def usable(vector: Column) -> Column:
    """True for vectors that are not null or empty and hold neither null nor non-finite parts."""
    v = vector.cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def pieces_of(d: int) -> list[slice]:
    return [slice(at, min(at + PIECE, d)) for at in range(0, d, PIECE)]


def groups_of(d: int) -> list[slice]:
    return [slice(int(p[0]), int(p[-1]) + 1) for p in np.array_split(np.arange(d), min(GROUPS, d))]


def centres_on(x: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Centres of each piece by Lloyd's rounds over the rows of x."""
    out = []
    for piece in pieces_of(x.shape[1]):
        own = x[:, piece].astype(float)
        centres = np.unique(own, axis=0)
        if len(centres) > CENTRES:
            centres = centres[np.random.default_rng(seed).permutation(len(centres))[:CENTRES]]
            for _ in range(ROUNDS):
                nearest = coded(own, centres)
                n = np.bincount(nearest, minlength=len(centres))
                sums = np.stack([np.bincount(nearest, own[:, j], len(centres)) for j in range(own.shape[1])], 1)
                centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        out.append(centres)
    return out


def coded(own: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    out = np.empty(len(own), dtype=np.int64)
    for at in range(0, len(own), 1 << 14):
        part = own[at : at + (1 << 14)]
        out[at : at + len(part)] = ((centres**2).sum(1) - 2 * part @ centres.T).argmin(1)
    return out


def encode(x: np.ndarray, centres: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a byte per piece) and residual norms (one per group) of the rows of x; without centres, all is residual."""
    d = x.shape[1]
    codes, left = np.zeros((len(x), len(pieces_of(d))), dtype=np.uint8), x.astype(float)
    for i, piece in enumerate(pieces_of(d) if centres else []):
        nearest = coded(left[:, piece], centres[i])
        codes[:, i] = nearest
        left[:, piece] -= centres[i][nearest]
    return codes, np.stack([np.linalg.norm(left[:, g], axis=1) for g in groups_of(d)], 1)


class Block:
    """Index rows of one dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, centres: list[np.ndarray] | None) -> None:
        self.ids, self.labels, self.x, self.codes, self.norms, self.centres = ids, labels, x, np.ascontiguousarray(codes.T), norms, centres
        self.most = float(np.abs(x).max(initial=0))

    def intervals(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that each row can have with the anchor."""
        own = anchor.astype(float)
        middle = np.zeros(len(self.ids))
        for i, piece in enumerate(pieces_of(len(own)) if self.centres else []):
            middle += (self.centres[i] @ own[piece])[self.codes[i]]
        bound = self.norms @ np.array([np.linalg.norm(own[g]) for g in groups_of(len(own))])
        bound = bound + 1e-9 * (np.abs(middle) + bound) + 1e-9 * np.abs(own).sum() * self.most + 1e-6
        return middle - bound, middle + bound

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products, in Python's whole numbers where 64 bits might not hold them."""
        x = self.x[rows]
        if self.most * float(np.abs(anchor).max(initial=0)) * len(anchor) < 2**62:
            return x @ anchor
        return x.astype(object) @ anchor.astype(object)

    def first(self, anchor_id: int, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], same: bool, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Per window (low, high): ids and scores of the first k rows in it, best first, and how many were scored exactly."""
        low, high = self.intervals(anchor)
        other = (self.labels == label) == same
        other &= self.ids != anchor_id
        for least, most in windows:
            may = other & (high >= least) & (low <= most)
            sure = low[may & (low >= least) & (high <= most)]
            if len(sure) >= k:
                may &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            rows = np.flatnonzero(may)
            score = self.scores(rows, anchor)
            inside = (score >= least) & (score <= most)
            seen, rows, score = len(rows), rows[inside], score[inside]
            order = np.lexsort((self.ids[rows], -score))[:k]
            yield self.ids[rows][order], score[order], seen


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> tuple[DataFrame, dict]:
    """(v_id, label, v, codes, norms) of every usable row, written, and the centres by dimension, which are fitted
    on SAMPLE rows at most, those with the least hash of their id, of dimensions that CENTRES of them have."""
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))
    raw = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    raw = raw.select(F.col(id_col).cast("long").alias("v_id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))
    raw = stored(raw.groupBy("v_id").agg(F.min(F.struct("label", "v")).alias("own")).select("v_id", "own.label", "own.v"), "vectors")
    sample = raw.orderBy(F.xxhash64("v_id"), "v_id").limit(SAMPLE).select("v").toPandas()["v"]
    size = sample.map(len)
    centres = {int(d): centres_on(np.stack(sample[size == d].to_list())) for d, n in size.value_counts().items() if n >= CENTRES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in by_dimension(batch.column(2)):
                codes, norms = encode(x, centres.get(d))
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(norms), pa.list_(pa.float64()))], ["v_id", "label", "v", "codes", "norms"])

    return stored(raw.mapInArrow(run, "v_id long, label long, v array<long>, codes binary, norms array<double>"), "codes"), centres


def below(x: Column, share: Fraction) -> Column:
    """The greatest whole number not above ``share`` times x."""
    wide = x.cast("decimal(30,0)") * F.lit(share.numerator)
    return ((wide - F.pmod(wide, F.lit(share.denominator))) / share.denominator).cast("long")


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """An Arrow column of lists of one length."""
    return np.asarray(column.flatten(), dtype=kind).reshape(len(column), -1)


def search(index: DataFrame, centres: dict, asked: DataFrame, *, same: bool, k: int, measured: bool = False) -> DataFrame:
    """(anchor_id, window, vec_id, score): the first k rows of each window of ``asked`` (v_id, label, v, windows
    array<struct<window long, low long, high long>>), of the anchor's label or of others, best score first, ties to the smaller id.
    ``measured``: returns instead, per anchor, window and block, the rows that were scored exactly, and all."""
    width = index.agg(F.max(F.size("v"))).first()[0] or 1
    blocks = max(-(-index.count() * width // BLOCK), 2 * index.sparkSession.sparkContext.defaultParallelism)
    none = lambda kind: F.lit(None).cast(kind)
    windows = "array<struct<window:bigint,low:bigint,high:bigint>>"
    rows = index.select(F.pmod(F.xxhash64("v_id"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "v_id", "label", "v", "codes", "norms", none(windows).alias("windows"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    dealt = rows.union(asked.select(every, F.lit(1).alias("kind"), "v_id", "label", "v", none("binary"), none("array<double>"), F.col("windows").cast(windows)))

    def block_of(parts: list[pa.RecordBatch]) -> dict[int, Block]:
        whole, held = pa.concat_batches(parts), {}
        for d, mine, _ in by_dimension(whole.column(4)):
            own = whole.take(pa.array(mine))
            codes = np.frombuffer(b"".join(own.column(5).to_pylist()), dtype=np.uint8).reshape(len(mine), -1)
            held[d] = Block(np.asarray(own.column(2)), np.asarray(own.column(3)), matrix(own.column(4), np.int64), codes, matrix(own.column(6), np.float64), centres.get(d))
        return held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, held = None, [], {}
        for batch in batches:
            number, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero(np.diff(number) | np.diff(kind)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if number[start] != at:
                    at, waiting, held = number[start], [], {}
                if kind[start] == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    held, waiting = block_of(waiting), []
                for low in range(0, len(part), AT_ONCE):
                    found = []
                    for anchor in part.slice(low, AT_ONCE).select([2, 3, 4, 7]).to_pylist():
                        own = held.get(len(anchor["v"]))
                        if own is None:
                            continue
                        v, named = np.array(anchor["v"], dtype=np.int64), anchor["windows"]
                        got = own.first(anchor["v_id"], anchor["label"], v, [(w["low"], w["high"]) for w in named], same, k)
                        for w, (ids, score, seen) in zip(named, got, strict=True):
                            found += [(anchor["v_id"], w["window"], seen, len(own.ids))] if measured else [(anchor["v_id"], w["window"], int(i), int(s)) for i, s in zip(ids, score, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], ["anchor_id", "window", "vec_id", "score"])

    found = dealt.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, "anchor_id long, window long, vec_id long, score long")
    if measured:
        return found.withColumnsRenamed({"vec_id": "exact", "score": "candidates"})
    nth = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k)


def mined(
    index: DataFrame, centres: dict, anchors: DataFrame, *, positives: int = 5, negatives: int = 10, low: Fraction = Fraction(3, 10), high: Fraction = Fraction(9, 10)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the index rows ``anchors``: per anchor and
    each of its first ``positives`` rows of its label, the first ``negatives`` rows of other labels whose score
    is between ``low`` and ``high`` times the positive's, both included.

    Rows without id, label or vector, and those with null or non-finite parts, were left out of the index; a vec_id that
    stands on several rows counts once, by the least label and vector. A row is no partner of its own id, nor of
    vectors of another length. A negative positive score has an empty window. An empty table gives no rows."""
    every = F.array(F.struct(F.lit(0).cast("long").alias("window"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high")))
    best = stored(search(index, centres, anchors.withColumn("windows", every), same=True, k=positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # low <= score / positive_score <= high, in whole numbers
    least, most = -below(-F.col("positive_score"), low), below(F.col("positive_score"), high)
    asked = best.filter(least <= most).groupBy(F.col("anchor_id").alias("v_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("window"), least.alias("low"), most.alias("high")))).alias("windows"))
    found = search(index, centres, anchors.join(asked, "v_id"), same=False, k=negatives)
    named = found.select("anchor_id", F.col("window").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(best, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 have the next label, and those divisible by 100 are the anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    index, centres = build_index(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return mined(index, centres, index.filter("v_id % 100 = 0").select("v_id", "label", "v"))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
best AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM best JOIN p USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
