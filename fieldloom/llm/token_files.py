"""Token ids as flat files of unsigned integers with 64-bit document offsets.

Format of a folder. ``parts`` is a table with one row per part: number, file
stem, documents, ids, and base, the ids of all earlier parts. ``<stem>.bin``
holds the ids of the part's documents, one after another, as little-endian
unsigned integers (16 bits if the vocabulary allows, else 32). ``<stem>.idx``
holds their starts and the end of the last as little-endian unsigned 64-bit
integers, counted in ids from the first document of the folder. ``<stem>.doc``
holds their doc_ids as signed 64-bit integers (null: the smallest value).
Parts and documents are in ascending doc_id order, null first.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import as_bytes, shared_path, slices
from fieldloom.llm.tokenizing import tokenizer, word_encoder

END_ID = 1
NO_ID = -(2**63)

#: Schemes under which Spark and Arrow know the same store by different names.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def qualified(spark: SparkSession, where: str) -> str:
    """``where`` with the scheme under which Spark itself would write to it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _folder(where: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system and path of a folder; ``file:/x``, ``file:///x`` and ``/x`` are one."""
    scheme, colon, rest = where.partition(":")
    if not colon or "/" in scheme:
        scheme, rest = "file", where
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pa.fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def id_type(path: str, end_id: int) -> str:
    most = max(tokenizer(path).get_vocab_size(with_added_tokens=True) - 1, end_id)
    return "<u2" if most < 1 << 16 else "<u4"


def _write_part(path: str, dtype: str, end_id: int, where: str):
    """mapInArrow function: writes the ids of a partition, gives its row of ``parts``."""
    end = np.array([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        files, top = _folder(where)
        # Each attempt writes files of its own; the table names those that count.
        stem = f"part-{number:06d}-{uuid.uuid4().hex}"
        sizes, ids = [], []
        with files.open_output_stream(f"{top}/{stem}.bin") as out:
            for batch in slices(batches, "text"):
                for data in word_encoder(path, dtype).encode(as_bytes(batch.column("text"))):
                    out.write(data + end)
                    sizes.append(len(data) // width + 1)
                ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
        if not sizes:
            files.delete_file(f"{top}/{stem}.bin")
            return
        with files.open_output_stream(f"{top}/{stem}.doc") as out:
            out.write(np.concatenate(ids).astype("<i8").tobytes())
        with files.open_output_stream(f"{top}/{stem}.len") as out:
            out.write(np.array(sizes, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": [number], "stem": [stem], "n_docs": [len(sizes)], "n_ids": [sum(sizes)]}
        )

    return write_part


def _write_offsets(where: str):
    """mapInArrow function over rows of ``parts``: writes each part's document offsets."""

    def write_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _folder(where)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_stream(f"{top}/{row['stem']}.len") as lengths:
                    sizes = np.frombuffer(lengths.read(), "<u8")
                starts = np.concatenate((np.zeros(1, "<u8"), np.cumsum(sizes, dtype="<u8")))
                # Written under another name first: a second attempt may run at once.
                spare = f"{top}/{row['stem']}.{uuid.uuid4().hex}"
                with files.open_output_stream(spare) as out:
                    out.write((starts + np.uint64(row["base"])).astype("<u8").tobytes())
                files.move(spare, f"{top}/{row['stem']}.idx")
            yield batch

    return write_offsets


def write_tokens(docs: DataFrame, path: str, where: str, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` (doc_id, text) to folder ``where``; gives the ``parts`` table.

    Every whole text is encoded without special tokens around it and ends with
    ``end_id``; null and empty texts are that id alone. Rows of one doc_id are
    all written, in the order of a hash of their texts. Other columns are left
    aside. An empty table writes no part. A failed attempt at a part may leave
    files that no row of ``parts`` names.
    """
    spark = docs.sparkSession
    where = qualified(spark, where)
    dtype = id_type(path, end_id)
    files, top = _folder(where)
    files.create_dir(top)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = "part long, stem string, n_docs long, n_ids long"
    ordered.select("doc_id", "text").mapInArrow(
        _write_part(path, dtype, end_id, where), schema
    ).write.parquet(f"{where}/sizes")
    # One row per part: bases are the prefix sums of the parts' ids.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.schema(schema).parquet(f"{where}/sizes")
    parts = parts.withColumns(
        {"base": F.coalesce(F.sum("n_ids").over(before), F.lit(0)), "width": F.lit(int(dtype[2:]))}
    )
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(many, "part")
    dealt.mapInArrow(_write_offsets(where), dealt.schema).write.parquet(f"{where}/parts")
    return spark.read.schema(dealt.schema).parquet(f"{where}/parts")


def open_part(where: str, stem: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, doc_ids) of a part; memory-mapped where the folder is on a file system
    that allows it, else read."""
    files, top = _folder(where)
    arrays = []
    for kind, dtype in (("bin", f"<u{width}"), ("idx", "<u8"), ("doc", "<i8")):
        name = f"{top}/{stem}.{kind}"
        if isinstance(files, pa.fs.LocalFileSystem):
            arrays.append(np.memmap(name, dtype, "r"))
        else:
            with files.open_input_file(name) as source:
                arrays.append(np.frombuffer(source.read(), dtype))
    return tuple(arrays)


def _read_part(where: str):
    def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, docs = open_part(where, row["stem"], row["width"])
                local = (offsets - offsets[0]).astype(np.int64)
                for at in range(0, len(docs), 20_000):
                    span = range(at, min(at + 20_000, len(docs)))
                    sums = [zlib.crc32(ids[local[i] : local[i + 1]].astype("<u4").tobytes()) for i in span]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if d == NO_ID else int(d) for d in docs[span]], pa.int64()),
                            pa.array(offsets[span].astype(np.int64)),
                            pa.array(np.diff(local[at : span.stop + 1])),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read_part


def read_digest(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a folder."""
    where = qualified(spark, where)
    parts = spark.read.parquet(f"{where}/parts")
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(many, "part").mapInArrow(
        _read_part(where), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_digest(docs: DataFrame, path: str, where: str | None = None) -> DataFrame:
    """Writes the token files of ``docs`` and reads them back."""
    where = where or shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, where)
    return read_digest(docs.sparkSession, where)
