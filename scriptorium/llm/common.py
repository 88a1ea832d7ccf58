"""What the operators of this subpackage share: tables, the shared folder and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words everywhere here: the space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none, a temporary folder serves a
    local session, whose threads all see it; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables of the open scratch() blocks, the innermost last.
_open: list[list[DataFrame]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors. The scratch() block that it
    is made in removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path).withMetadata(df.columns[0], {"written": path})
    if _open:
        _open[-1].append(made)
    return made


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end the tables written in it, but for those that handed_on() gave to what lies around it."""
    _open.append([])
    try:
        yield
    finally:
        for made in _open.pop():
            forget(made)


def handed_on(df: DataFrame, label: str) -> DataFrame:
    """written() for the result of a scratch() block: it outlives that block, and goes with the one around it, if any."""
    inner = _open.pop()
    try:
        return written(df, label)
    finally:
        _open.append(inner)


def forget(df: DataFrame | None) -> None:
    """Removes a table that written() made and that nothing reads any more. No error where it is gone."""
    if df is None:
        return
    path = next((f.metadata["written"] for f in df.schema.fields if "written" in f.metadata), None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def by_batch(df: DataFrame, schema: T.StructType, work: Callable[..., dict], *args, carry: tuple[str, ...] = (), done: Callable[[], None] | None = None, most: int = 2 << 20) -> DataFrame:
    """mapInArrow in pieces of bounded size: work(columns as lists, *args) returns columns by name. Columns in carry stay Arrow.

    Very long texts make a batch large, so a batch is cut where its strings pass `most` bytes, a few MB. Workers serve many tasks: done(), at
    the end of each partition, frees what work keeps from piece to piece."""
    arrow = _arrow_schema(schema)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for piece in pieces(batch, most):
                    made = work({n: piece.column(i) if n in carry else piece.column(i).to_pylist() for i, n in enumerate(names)}, *args)
                    yield pa.RecordBatch.from_arrays([_array(made[f.name], f.type) for f in arrow], schema=arrow)
        finally:
            if done:
                done()
            _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Returns what a worker process no longer uses to the machine: allocators keep it else for the worker's life."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... in place of their names, and the new name of each: no name of theirs can clash with ours."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def least_by_hash(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most `most` rows, those with the least hash of their keys. One count sets a threshold by which all but a quarter more
    than these fall away in their own tasks, so that a table of many partitions does not send `most` rows from each."""
    mark, share = F.xxhash64(*keys), 1.25 * most / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.pmod(mark, F.lit(1 << 40)) < int(share * (1 << 40)) + 1)
    return rows.orderBy(F.pmod(mark, F.lit(1 << 40)), mark, *keys).limit(most)


def pieces(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    rows = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
