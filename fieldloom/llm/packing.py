"""Blocks of documents, and arrays of integers packed into binary columns.

Some operators ask a global table about every distinct key of a block of
documents. A row per key and document would move several times the input; a
block asks once per key, in one packed column per group of keys, and gets one
packed answer. Groups are ranges of the keys' hashes, so no key is hot: a block
asks for it once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Text of a block, at most, unless one document alone is longer.
BLOCK_BYTES = 16 << 20


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as zstd-compressed byte planes, with their number in front."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()
    head = len(values).to_bytes(6, "little") + width.to_bytes(2, "little")
    return head + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:6], "little"), int.from_bytes(data[6:8], "little")
    planes = pa.decompress(data[8:], n * width, codec="zstd", asbytes=True)
    table = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return np.ascontiguousarray(table).view(f"<u{width}").reshape(n)


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def group_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Group of each hash: equal ranges of its upper half, so order is kept."""
    return (hashes >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)


def group_slices(hashes: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """(group, start, end) of the groups that sorted hashes fall into."""
    of = group_of(hashes, groups).astype(np.int64)
    edges = np.searchsorted(of, np.arange(groups + 1))
    return [(g, int(a), int(b)) for g, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
