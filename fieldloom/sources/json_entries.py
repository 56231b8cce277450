"""Large JSON objects as tables: one row per entry, read by many tasks.

A label file is one JSON object, so a text reader makes it one row of one task.
Here each task reads one byte range of a file. Where its first entry begins
depends on what lies before it (a byte may stand in a string, or deep in a
value), so a first job reads every range once and notes how it changes that
state; the states are then handed on from range to range, a few numbers each,
and a second job cuts every range at the borders of its entries.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldloom.session import ship_package

SPLIT_BYTES = 64 << 20
SCHEMA = "path string, key string, value string, place long"
_BLOCK = 1 << 20
_SPACE = b" \t\r\n"
_QUOTE, _ESCAPE, _COMMA = b'"\\,'
_OPEN, _CLOSE = b"{[", b"}]"


class CorruptJson(ValueError):
    """A file that is not one JSON object."""


def marks(block: bytes, escaped: bool, quoted: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Places and bytes of braces, brackets and commas outside strings, and the state after the block.

    ``escaped``: the first byte follows an open backslash; ``quoted``: it stands
    in a string.
    """
    data = np.frombuffer(block, np.uint8)
    if not len(data):
        return np.empty(0, np.int64), data, escaped, quoted
    live = data == _QUOTE
    live[0] &= not escaped
    slashes, escaped_after = np.flatnonzero(data == _ESCAPE), False
    if len(slashes):
        # In a run of backslashes every second one is itself escaped.
        fresh = np.concatenate(([True], np.diff(slashes) > 1))
        first = slashes[np.maximum.accumulate(np.where(fresh, np.arange(len(slashes)), 0))]
        shift = (first == 0) & escaped
        escaping = slashes[(slashes - first + shift) % 2 == 0] + 1
        live[escaping[escaping < len(data)]] = False
        escaped_after = bool((escaping == len(data)).any())
    inside = (np.cumsum(live) + quoted) % 2 == 1
    at = np.flatnonzero(np.isin(data, list(_OPEN + _CLOSE + b",")) & ~inside)
    return at, data[at], escaped_after, bool(inside[-1])


def depths(kinds: np.ndarray) -> np.ndarray:
    """Change of depth up to and with each mark."""
    return np.cumsum(np.isin(kinds, list(_OPEN)).astype(np.int64) - np.isin(kinds, list(_CLOSE)))


def summary(blocks: Iterator[bytes], escaped: bool) -> tuple[bool, int, int]:
    """Whether bytes turn a string's state about, and the depth they gain if begun outside or in a string."""
    quoted, gained = [False, True], [0, 0]
    for block in blocks:
        for way in (0, 1):
            _, kinds, after, quoted[way] = marks(block, escaped, quoted[way])
            gained[way] += int(depths(kinds)[-1]) if len(kinds) else 0
        escaped = after
    return quoted[0], gained[0], gained[1]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, or of the files of the folder whose names are not hidden."""
    where, inner = _opened(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        return []
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    listed = where.get_file_info(fs.FileSelector(inner))
    return sorted(
        (f"{path.rstrip('/')}/{f.base_name}", f.size) for f in listed if f.is_file and f.base_name[0] not in "._"
    )


def _blocks(path: str, start: int, end: int | None = None) -> Iterator[bytes]:
    where, inner = _opened(path)
    with where.open_input_file(inner) as source:
        source.seek(start)
        while end is None or start < end:
            block = source.read(_BLOCK if end is None else min(_BLOCK, end - start))
            if not block:
                return
            start += len(block)
            yield block


def _escaped(path: str, place: int) -> bool:
    """Whether an odd run of backslashes ends right before ``place``."""
    run, stop = 0, place
    while stop > 0:
        block = b"".join(_blocks(path, max(0, stop - 4096), stop))
        own = len(block) - len(block.rstrip(b"\\"))
        run, stop = run + own, stop - len(block)
        if own < len(block):
            break
    return run % 2 == 1


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, quoted: bool, depth: int):
        self.path, self.start, self.end = path, start, end
        self.quoted, self.depth = quoted, depth


def _only_space(path: str, rest: bytes, place: int) -> None:
    if rest.strip(_SPACE):
        raise CorruptJson(f"{path}: there is more after the object, at byte {place}")


def entries(part: _Range) -> Iterator[tuple[str, str, str, int]]:
    """(path, key, value, place) of the entries that begin in one range of a file."""
    place, depth, quoted, escaped = part.start, part.depth, part.quoted, _escaped(part.path, part.start)
    over = place > 0 and depth == 0
    held, begin = [], None  # the bytes of an open entry, and where it begins
    for block in _blocks(part.path, part.start):
        at, kinds, escaped, quoted = marks(block, escaped, quoted)
        level = depth + depths(kinds)
        # Entries lie between the braces of the object and its own commas.
        closes = (level == 0) & (kinds == _CLOSE[0])
        border = closes | (level == 1) & ((kinds == _COMMA) | (kinds == _OPEN[0]) & (np.diff(level, prepend=depth) > 0))
        cut = 0
        for i in np.flatnonzero(border).tolist() if not over else ():
            where = int(at[i])
            if begin is not None:
                held.append(block[cut:where])
                yield from _entry(part.path, b"".join(held), begin, bool(closes[i]))
                held, begin = [], None
            if place + where >= part.end:
                return
            cut = where + 1
            if closes[i]:
                over = True
                break
            begin = place + cut
        if over:
            _only_space(part.path, block[cut : max(cut, part.end - place)], place + cut)
        elif begin is not None:
            held.append(block[cut:])
        depth = int(level[-1]) if len(level) else depth
        place += len(block)
        if begin is None and place >= part.end:
            return
    if begin is not None:
        raise CorruptJson(f"{part.path}: the entry at byte {begin} has no end")


_DECODER = json.JSONDecoder()


def _entry(path: str, raw: bytes, place: int, last: bool) -> Iterator[tuple[str, str, str, int]]:
    if last and not raw.strip(_SPACE):
        return  # the object is empty: a comma before its end is found by _edges
    try:
        text = raw.decode().strip()
        key, end = _DECODER.raw_decode(text)
        rest = text[end:].lstrip()
        if not isinstance(key, str) or rest[:1] != ":":
            raise ValueError("a key and a colon are expected")
        value = rest[1:].strip()
        json.loads(value)
    except ValueError as error:
        raise CorruptJson(f"{path}: the entry at byte {place} is not valid: {error}") from None
    yield path, key, value, place


class _Reader(DataSourceReader):
    def __init__(self, ranges: str):
        self.ranges = json.loads(ranges)

    def partitions(self):
        return [_Range(*r) for r in self.ranges]

    def read(self, partition):
        return entries(partition)


class JsonEntries(DataSource):
    """The second job: ranges with their states, as option ``ranges``, to entries."""

    @classmethod
    def name(cls):
        return "fieldloom_json_entries"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["ranges"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            blocks = _blocks(row["path"], row["start"], row["end"])
            turns, outside, inside = summary(blocks, _escaped(row["path"], row["start"]))
            found = {"path": row["path"], "start": row["start"], "turns": turns, "outside": outside, "inside": inside}
            yield pa.RecordBatch.from_pylist([found])


def _edges(path: str, size: int) -> None:
    """A file must begin and end with a brace, white space aside, without a comma before its end."""
    head, tail, start = b"", b"", size
    for block in _blocks(path, 0):
        head = block.lstrip(_SPACE)
        if head:
            break
    while start > 0 and len(tail.split()) < 2:
        start = max(0, start - _BLOCK)
        tail = b"".join(_blocks(path, start, size)).rstrip(_SPACE)
        if len(tail.rstrip(b"}").rstrip(_SPACE)):
            break
    if head[:1] != b"{" or tail[-1:] != b"}" or tail[:-1].rstrip(_SPACE)[-1:] == b",":
        raise CorruptJson(f"{path}: not one JSON object")


def json_entries(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, key, value, place): the entries of the JSON object in each file of ``path``.

    value is the entry's JSON text as it stands, place the byte at which it
    begins, so that the last of repeated keys can be told. A missing path is an
    empty table; a file that is not one JSON object is an error, here or when
    its entries are read. Ranges are ``split_bytes`` long; the driver holds a
    few numbers of each range. An entry is one row, whatever its size.
    """
    ship_package(spark)
    spark.dataSource.register(JsonEntries)
    files = _files(path)
    for name, size in files:
        _edges(name, size)
    cuts = [(name, a, min(a + split_bytes, size)) for name, size in files for a in range(0, size, split_bytes)]
    told = {}
    if len(cuts) > len(files):
        table = spark.createDataFrame(cuts, "path string, start long, end long").repartition(len(cuts))
        noted = table.mapInArrow(_summaries, "path string, start long, turns boolean, outside long, inside long")
        told = {(r.path, r.start): r for r in noted.collect()}
    ranges, sizes = [], dict(files)
    quoted, depth = False, 0
    for name, start, end in cuts:
        if start == 0:
            quoted, depth = False, 0
        ranges.append((name, start, end, quoted, depth))
        if (name, start) in told:
            own = told[name, start]
            quoted, depth = quoted != own.turns, depth + (own.inside if quoted else own.outside)
            if end == sizes[name] and (quoted or depth):
                raise CorruptJson(f"{name}: its braces or strings do not end")
    if not ranges:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format(JsonEntries.name()).option("ranges", json.dumps(ranges)).load()
