"""Nearest neighbours by randomly rotated one-bit codes.

The index keeps, of each vector less a centre, the signs of its rotated coordinates (packed bits),
its length, and the inner product of the unit vector with its own code, which corrects estimates.
For a query q the estimate of <q, o> is <q, code> / <o, code>, with an error bound that shrinks
with the dimension. <q, code> is summed from tables over the bytes of the packed code. The vectors
of the best estimates are compared exactly; of the rest, those whose lower bound of the distance
doesn't exceed the k-th distance so far are, and no others.

All rows are indexed. Index rows are dealt by hash into blocks of bounded size, queries go to every
block, and a shuffle by query merges the k best of each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Numbers (rows times dimension) of an index block, on average at most.
BLOCK = 1 << 24
#: Standard deviations of the estimate that the lower bound allows for.
EPSILON = 1.5
#: Exact distances per neighbour asked for that set the first bound.
FIRST = 4
BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float32) * 2 - 1


def rotation(d: int, seed: int = 20240521) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and hold neither null nor non-finite parts."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths, and <unit vector, code / sqrt(d)>, of the rows of x."""
    own = (x - centre) @ turn
    length = np.linalg.norm(own, axis=1)
    unit = own / np.where(length > 0, length, 1)[:, None]
    fit = np.abs(unit).sum(1) / np.sqrt(x.shape[1])
    return np.packbits(own > 0, axis=1), length, np.where(length > 0, fit, 1.0)


def tables(q: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each query: <unit query, code / sqrt(d)> split by the code's bytes, a row of 256 for each; and its length."""
    d = q.shape[1]
    own = (q - centre) @ turn
    size = np.linalg.norm(own, axis=1)
    unit = (own / np.where(size > 0, size, 1)[:, None] / np.sqrt(d)).astype(np.float32)
    unit = np.pad(unit, ((0, 0), (0, -d % 8))).reshape(len(q), -1, 8)
    return unit @ BITS.T, size


class Block:
    """Index rows of one dimension: ids, vectors, codes by byte, lengths and fits."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, length: np.ndarray, fit: np.ndarray, centre: np.ndarray, epsilon: float) -> None:
        self.ids, self.x, self.codes, self.length, self.fit, self.centre = ids, x, np.ascontiguousarray(codes.T), length, fit, centre
        self.turn = rotation(x.shape[1])
        self.error = epsilon * np.sqrt(np.maximum(1 - fit**2, 0)) / (fit * np.sqrt(max(1, x.shape[1] - 1)))

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """Per query: its id, the ids and distances of the k nearest other ids, and how many vectors were compared exactly."""
        table_, size = tables(q, self.centre, self.turn)
        for q_id, v, own, length in zip(q_ids, q, table_, size, strict=True):
            dot = own[0][self.codes[0]]
            for of_byte, code in zip(own[1:], self.codes[1:], strict=True):
                dot = dot + of_byte[code]
            middle = length**2 + self.length**2 - 2 * length * self.length * (dot / self.fit)
            slack = 2 * length * self.length * self.error + 1e-5 * (length**2 + self.length**2)
            other = np.flatnonzero(self.ids != q_id)
            first = other
            if len(other) > FIRST * k:
                first = other[np.argpartition(middle[other], FIRST * k)[: FIRST * k]]
            ids, dist = self.best(first, v, k)
            seen = len(first)
            if len(first) < len(other):
                limit = dist[-1] ** 2 if len(ids) == k else np.inf
                near = other[(middle - slack)[other] <= limit]
                seen += len(np.setdiff1d(near, first, assume_unique=True))
                ids, dist = self.best(np.union1d(first, near), v, k)
            yield int(q_id), ids, dist, seen

    def best(self, rows: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest ids among ``rows``, each by its nearest vector; ties to the smaller id."""
        total = np.zeros(len(rows))
        for part in ((self.x[rows] - v) ** 2).T:  # one after the other, as SQL sums them
            total += part
        dist = np.sqrt(total)
        order = np.lexsort((self.ids[rows], dist))
        ids, dist = self.ids[rows][order], dist[order]
        keep = np.sort(np.unique(ids, return_index=True)[1])[:k]
        return ids[keep], dist[keep]


def by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, matrix) of an Arrow column of lists without nulls."""
    ends = np.asarray(column.offsets) - column.offsets[0].as_py()
    flat, size = np.asarray(column.flatten(), dtype=np.float64), np.diff(ends)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, flat[(ends[:-1][rows][:, None] + np.arange(d))]


def centre_of(vectors: DataFrame) -> dict[int, list[float]]:
    """The mean vector of each dimension that occurs, from one row of sums per batch."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in by_dimension(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, dtype=np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, len(rows))), pa.array(x.sum(0))], ["d", "i", "n", "s"])

    means = vectors.select("v").mapInArrow(sums, "d int, i int, n long, s double").groupBy("d", "i").agg((F.sum("s") / F.sum("n")).alias("m")).groupBy("d").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("m"))
    return {r["d"]: [x["m"] for x in r["m"]] for r in means.collect()}


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict]:
    """(v_id, v, code, length, fit) of every usable row, written to the shared folder, and the centres.
    Rows that repeat id and vector are kept once."""
    raw = vectors.select(F.col(id_col).cast("long").alias("v_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("v_id").isNotNull())
    centres = centre_of(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = {d: rotation(d) for d in centres}
        for batch in batches:
            for d, rows, x in by_dimension(batch.column(1)):
                code, length, fit = encode(x, np.array(centres[d]), turns[d])
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(code).tobytes())]).cast(pa.binary())
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), codes, pa.array(length), pa.array(fit)], ["v_id", "v", "code", "length", "fit"])

    once = raw.dropDuplicates(["v_id", "v"])
    return stored(once.mapInArrow(run, "v_id long, v array<double>, code binary, length double, fit double"), "index"), centres


def search(index: DataFrame, centres: dict, queries: DataFrame, *, k: int = 10, epsilon: float = EPSILON, compared: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score for the rows (v_id, v) of ``queries``: the k nearest ids by Euclidean
    distance, ties to the smaller id. A vector with the query's id is no candidate, and vectors of
    another dimension aren't either. An id that stands on several vectors counts by the nearest one,
    and as a query by the least one (in the order of arrays). ``compared``: returns instead, per
    query and block, the vectors that it was compared with exactly, and those that it might have been."""
    spark = index.sparkSession
    width = max(centres, default=1)
    blocks = max(-(-index.count() * width // BLOCK), 2 * spark.sparkContext.defaultParallelism)
    block = F.pmod(F.xxhash64("v_id", "v"), F.lit(blocks)).alias("block")
    none = lambda kind: F.lit(None).cast(kind)
    rows = index.select(block, F.lit(0).alias("kind"), "v_id", "v", "code", "length", "fit")
    asked = queries.groupBy("v_id").agg(F.min("v").alias("v"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    dealt = rows.union(asked.select(every, F.lit(1).alias("kind"), "v_id", "v", none("binary"), none("double"), none("double")))

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
                    whole, waiting = pa.concat_batches(waiting), []
                    for d, mine, x in by_dimension(whole.column(3)):
                        own = whole.take(pa.array(mine))
                        codes = np.frombuffer(b"".join(own.column(4).to_pylist()), dtype=np.uint8).reshape(len(mine), -1)
                        held[d] = Block(np.asarray(own.column(2)), x, codes, np.asarray(own.column(5)), np.asarray(own.column(6)), np.array(centres[d]), epsilon)
                for d, mine, q in by_dimension(part.column(3)):
                    q_ids = np.asarray(part.column(2))[mine]
                    for lo in range(0, len(q) if d in held else 0, 256):
                        got = list(held[d].nearest(q_ids[lo : lo + 256], q[lo : lo + 256], k))
                        if compared:
                            columns = [np.array([g[0] for g in got]), np.array([g[3] for g in got]), np.array([len(held[d].ids) for _ in got], dtype=float)]
                        else:
                            columns = [np.repeat([g[0] for g in got], [len(g[1]) for g in got]), np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    found = dealt.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, "query_id long, vec_id long, score double")
    if compared:
        return found.select("query_id", F.col("vec_id").alias("exact"), F.col("score").cast("long").alias("candidates"))
    nearest = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return nearest.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The exact answer, for measuring recall.
OP9_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM d
WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10
"""


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, centres = build_index(table(spark, sf_dir, "embeddings"))
    return search(index, centres, index.filter("v_id % 100 = 0"))
