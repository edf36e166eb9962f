"""Linear algebra over GF(2) on lists of keys: a basis as a mergeable aggregate, spans, and changes of basis.

A basis is in reduced echelon form: (pivot, vector) by pivot, a vector's highest bit, which no other vector has. It
depends on the span of the keys alone, not on their order or on how they were dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import byte_tables, signed

#: Partial bases that a task merges, at most.
MERGE = 64


def echelon(keys: np.ndarray) -> np.ndarray:
    """The reduced echelon basis of the keys (uint64), by falling pivot: at most 64 vectors."""
    keys = keys[keys != 0]
    basis: list[np.uint64] = []
    for bit in range(63, -1, -1):
        if not len(keys):
            break
        has = np.flatnonzero(keys >> np.uint64(bit) & np.uint64(1))
        if len(has):
            own = keys[has[0]]
            keys[has] ^= own
            keys = keys[keys != 0]
            basis = [v ^ own if int(v) >> bit & 1 else v for v in basis] + [own]
    return np.array(basis, dtype=np.uint64)


def basis(keys: DataFrame) -> DataFrame:
    """(pivot, vector) of the span of keys (h): each task reduces its keys to 64 vectors at most, and tasks merge MERGE
    partial bases each until one is left. Nulls don't count; an empty list has no rows."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            held = echelon(np.concatenate([held, np.asarray(batch.column(0)).view(np.uint64)]))
        pivots = [int(v).bit_length() - 1 for v in held]
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(pivots, pa.int32())], ["vector", "pivot"])

    rows = keys.select("h").dropna().mapInArrow(reduce, "vector long, pivot int")
    parts = max(1, keys.sparkSession.sparkContext.defaultParallelism * MERGE)
    while parts > 1:
        parts = -(-parts // MERGE)
        rows = rows.select("vector").repartition(parts).mapInArrow(reduce, "vector long, pivot int")
    return rows.select("pivot", "vector")


def rank(of: DataFrame) -> DataFrame:
    """One row rank: the number of vectors of a basis."""
    return of.agg(F.count("*").alias("rank"))


def vectors(of: DataFrame) -> list[int]:
    """A basis on the driver: 64 numbers at most, by falling pivot."""
    return [r["vector"] & ((1 << 64) - 1) for r in of.orderBy(F.desc("pivot")).collect()]


def changes(own: list[int]) -> tuple[list[int], list[int]]:
    """Images of the 64 unit vectors under M, which sends the i-th vector of a reduced echelon basis to bit i, and under its inverse.

    The other unit vectors complete the basis. So a key's image has the bits of its pivots in front (bits 0 on), and then what
    its other bits are once these vectors are taken off; the key is in the span if those are zero."""
    pivots = [v.bit_length() - 1 for v in own]
    rest = [j for j in range(64) if j not in pivots]
    place = {j: len(own) + i for i, j in enumerate(rest)}
    there = [0] * 64
    for j in rest:
        there[j] = 1 << place[j]
    for i, (pivot, v) in enumerate(zip(pivots, own, strict=True)):
        there[pivot] = 1 << i
        for j in rest:
            there[pivot] |= (v >> j & 1) << place[j]
    return there, [*own, *[1 << j for j in rest]]


def basis_change(of: DataFrame) -> DataFrame:
    """(bit, m, m_inv): the rows of M and of its inverse, for bits.matvec or bits.byte_tables."""
    there, back = changes(vectors(of))
    return of.sparkSession.createDataFrame([(i, signed(m), signed(n)) for i, (m, n) in enumerate(zip(there, back, strict=True))], "bit int, m long, m_inv long")


def in_span(h: Column, own: list[int]) -> Column:
    """Whether a key is a sum of the vectors of a reduced echelon basis."""
    return F.shiftrightunsigned(byte_tables(h, changes(own)[0]), len(own)) == 0 if len(own) < 64 else F.lit(True)
