"""Helpers the operators of this folder share."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import checkpoint_root, ship_package

#: Bytes of an Arrow batch, one row at least: of those Spark sends and of their slices.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Python functions of this session get batches of about BATCH_BYTES instead of Spark's 64 MB.

    A batch is held whole by the JVM and by the worker, besides what the function makes of it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_KEPT: dict[Hashable, dict[Hashable, Any]] = {}


def keep_only(owner: Hashable = None) -> dict[Hashable, Any]:
    """What ``owner`` keeps in this process between its tasks; what others kept is dropped.

    Spark uses a worker process for one step after another. Without this it would
    hold the vocabularies of all steps it ever ran.
    """
    if owner not in _KEPT:
        dropped = any(_KEPT.values())
        _KEPT.clear()
        _KEPT[owner] = {}
        if dropped:
            _trim()
    return _KEPT[owner]


def kept(owner: Hashable, key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of ``key`` that the tasks of ``owner`` share in this process."""
    own = keep_only(owner)
    if key not in own:
        own[key] = make()
    return own[key]


def _trim() -> None:
    """Gives freed memory back to the system, where its library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(key: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; maps, which have no order, count as their JSON."""
    plain = [
        F.to_json(F.struct(docs[f.name])) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else docs[f.name]
        for f in docs.schema.fields
    ]
    return F.xxhash64(*plain)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text of an Arrow column; null counts as empty."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES of ``column``, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            held += size or 0
            if held >= BATCH_BYTES:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session has ended before its tables
        pass


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` as a table in the shared folder.

    Later steps read the table instead of computing the rows again, and a lost
    executor costs a read. Tables live until the program ends.
    """
    path = shared_path(rows.sparkSession, kind)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
