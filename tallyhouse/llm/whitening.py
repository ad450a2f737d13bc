"""Whitening of embedding vectors: projections on the leading components with variance one.

Method. Entries become whole numbers, so sums and distances from the mean are exact. Each task reduces its centred rows block by block to one
upper triangle (QR of the triangle so far on top of the next block); triangles of 16 tasks at a time become one, until 16 are left for
the driver. Their size is the dimension squared, whatever the number of vectors. The last triangle is made bidiagonal, its singular
values are found by qd transforms and its vectors by twisted factorisations (see ``bidiagonal``). The vectors are never put together
anywhere: every pass reads them, keeps its own sums, and returns a few rows.

Defined results: a vector that is null or holds a null or an entry that is not finite is dropped, and so is one with an entry beyond 2^30
in size, whose whole numbers would not fit. If vectors have different lengths (or none), those of the most frequent length stay, of the longest among equally
frequent ones; vectors without entries have no components. A component has a variance above rounding, so there are fewer than ``k`` where the vectors
span less, and none for one vector or for equal vectors. A ``deviation`` that no long holds is null. Repeated rows count as often as they occur.
Null row ids are kept. Extra columns are not used. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.bidiagonal import leading
from tallyhouse.llm.saved import saved

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = float(2**30)
BLOCK_ROWS = 4096
FAN_IN = 16
_SAFE = 2**62


def _whole_numbers(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that stay, and their entries as whole numbers."""
    column = batch.column(1)
    if isinstance(column, pa.FixedSizeListArray):
        column = column.cast(pa.list_(column.type.value_type))
    offsets = column.offsets.to_numpy().astype(np.int64)
    rows = np.flatnonzero((np.diff(offsets) == d) & column.is_valid().to_numpy(zero_copy_only=False))
    if not len(rows):
        return rows, np.zeros((0, d), dtype=np.int64)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    values = flat[offsets[rows][:, None] + np.arange(d)]
    good = (np.abs(values) <= LARGEST).all(axis=1)  # false for NaN
    return rows[good], np.floor(SCALE * values[good]).astype(np.int64) + SHIFT


def _dimension(vectors: DataFrame) -> int:
    """The most frequent length of the vectors that stay."""
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) <= LARGEST, F.lit(False)) & ~F.isnan(x))
    sizes = vectors.where(usable).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sizes["d"] if sizes else 0


def _sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                x = _whole_numbers(batch.slice(first, BLOCK_ROWS), d)[1]
                n, total = n + len(x), total + x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), type=pa.int32()), pa.array([n] * d, type=pa.int64()),
                                              pa.array([Decimal(int(t)) for t in total], type=pa.decimal128(38, 0))], names=["dim", "n", "total"])

    rows = vectors.mapInArrow(run, "dim int, n long, total decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    by_dim = {r["dim"]: r for r in rows}  # d rows
    return (by_dim[0]["n"], [int(by_dim[i]["total"]) for i in range(d)]) if by_dim else (0, [])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as int64 where that holds it, else as Python numbers."""
    if n * int(np.abs(x).max(initial=0)) < _SAFE and max(map(abs, sums)) < _SAFE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _deviations(y: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; null where a long does not hold it."""
    if y.dtype != object and y.shape[1] * float(np.abs(y).max(initial=0)) ** 2 < _SAFE:
        return (y * y).sum(axis=1).tolist()
    y = y.astype(object)
    return [t if t < 2**63 else None for t in (y * y).sum(axis=1)]


def _triangles(vectors: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """Upper triangle of the QR decomposition of all centred rows, divided by n."""
    schema = "part int, triangle array<double>"

    def as_batch(part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], type=pa.int32()), pa.array([r.ravel().tolist()], type=pa.list_(pa.float64()))],
                                          names=["part", "triangle"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                x = _whole_numbers(batch.slice(first, BLOCK_ROWS), d)[1]
                if len(x):
                    rows = (_centred(x, n, sums) / n).astype(float)
                    r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
        if r is not None:
            yield as_batch(TaskContext.get().partitionId(), r)

    def merge(table: pa.Table) -> pa.Table:
        stacked = np.vstack([np.array(x).reshape(-1, d) for x in table.column("triangle").to_pylist()])
        return pa.Table.from_batches([as_batch(int(table.column("part")[0].as_py()) // FAN_IN, np.linalg.qr(stacked, mode="r"))])

    left = saved(vectors.mapInArrow(reduce, schema), "triangles")
    parts = (left.agg(F.max("part").alias("p")).first()["p"] or 0) + 1
    while parts > FAN_IN:
        left = saved(left.groupBy(F.floor(F.col("part") / FAN_IN).alias("up")).applyInArrow(merge, schema), "triangles")
        parts = -(-parts // FAN_IN)
    last = [np.array(r["triangle"]).reshape(-1, d) for r in left.orderBy("part").collect()]  # at most FAN_IN rows
    return np.linalg.qr(np.vstack(last), mode="r")


def _identity_error(vectors: DataFrame, d: int, n: int, sums: list[int], project: np.ndarray) -> float:
    """Largest entry of the covariance of the whitened vectors less the identity, from the vectors themselves."""
    k = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                z = (_centred(_whole_numbers(batch.slice(first, BLOCK_ROWS), d)[1], n, sums) / n).astype(float) @ project
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), type=pa.int32()), pa.array(total.ravel())], names=["cell", "total"])

    cells = vectors.mapInArrow(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()  # k * k rows
    covariance = np.zeros(k * k)
    for cell, total in cells:
        covariance[cell] = total / n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def whitened(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Per vector that stays and component: row id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is the sum over dimensions of (n * x - S)^2 for the whole numbers x = floor(1024 * entry) + 100000 with sums S;
    ``explained`` the share of the component in the variance.
    """
    vectors = df.select(F.col(row_id).alias("id"), F.col(vector).alias("v"))
    kind = dict(vectors.dtypes)["id"]
    schema = f"`{row_id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = _dimension(vectors)
    n, sums = _sums(vectors, d) if d else (0, [])
    if n < 2:
        return df.sparkSession.createDataFrame([], schema)
    triangle = _triangles(vectors, d, n, sums)
    values, directions = leading(triangle, k)
    if not len(values):
        return df.sparkSession.createDataFrame([], schema)
    project = directions / np.sqrt(values / n)
    explained = values / np.square(triangle).sum()
    error = _identity_error(vectors, d, n, sums, project)
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                rows, x = _whole_numbers(part, d)
                y = _centred(x, n, sums)
                z = (y / n).astype(float) @ project
                at = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(rows)).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(at), n, dtype=np.int64)), pa.array(_deviations(y), type=pa.int64()).take(at), pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(at), error)),
                ], names=[row_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
