"""What the searches over embeddings share: usable rows, packed blocks of them, stated queries in chunks, exact products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK = 4096, 512
#: Bytes of queries that are sent to the tasks at once.
CHUNK = 16 << 20

_PACKED = "block long, ids binary, data binary, dim int, cuts binary"


def usable(vectors: DataFrame, *more: Column) -> DataFrame:
    """vec_id, v: floor(256 * x) of each component (at the limits of long beyond them), and the columns in more."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("v"), *more)


def packed(rows: DataFrame, size: int, *cuts: str) -> DataFrame:
    """Rows (vec_id, v, and the columns in cuts) packed by partition, in blocks numbered by partition and order in it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= size:
                yield made(held[:size], number)
                held, number = held[size:], number + 1
        if held:
            yield made(held, number)

    def made(rows: list[tuple], number: int) -> pa.RecordBatch:
        dim = max(1, *(len(r[1]) for r in rows))
        data = np.zeros((len(rows), dim))
        for i, r in enumerate(rows):
            data[i, : len(r[1])] = r[1]
        ids = np.array([r[0] for r in rows], np.int64)
        extra = np.array([r[2:] for r in rows], float)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary()), pa.array([dim], pa.int32()), pa.array([extra.tobytes()], pa.binary())], names=["block", "ids", "data", "dim", "cuts"])

    return rows.select("vec_id", "v", *cuts).mapInArrow(pack, _PACKED)


def unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dim)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Local scores of all queries against all rows. Doubles hold them exactly up to 2 ** 53, integers beyond."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) >= 2.0**52:
        q, x = (np.array([[int(c) for c in row] for row in m], object).reshape(m.shape) for m in (q, x))
    return q @ x.T


def within_long(scores) -> list[int]:
    """Exact scores as longs; those beyond their range at its limits."""
    return [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores]


def highest(scores: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
    """Places of the k highest, ties to the smaller id."""
    if k and len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


class Best:
    """The k best rows of each query over the blocks of a task, ties to the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if query in self.held:
            scores, ids, rows = (np.concatenate(x) for x in zip(self.held[query], (scores, ids, rows), strict=True))
        at = highest(scores, self.k, ids)
        self.held[query] = scores[at], ids[at], rows[at]


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row["block"], *unpack(row["ids"], row["data"], row["dim"])


def table_of(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def chunks(queries: DataFrame, *cuts: str) -> Iterator[list[tuple]]:
    """The queries as (ids, vectors, cuts), in lists of at most CHUNK bytes and one block more; the driver holds one at a time."""
    held, size = [], 0
    for row in packed(queries, QUERY_BLOCK, *cuts).toLocalIterator():
        ids, q = unpack(bytes(row.ids), bytes(row.data), row.dim)
        held.append((ids, q, np.frombuffer(bytes(row.cuts)).reshape(len(ids), -1)))
        size += q.nbytes
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held
