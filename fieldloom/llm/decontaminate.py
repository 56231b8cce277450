"""Benchmark decontamination by templates of words and typed slots.

Numbers, number words, units after a number and names become typed slots, so a
question with other values has the same template. Windows of eight template
tokens are joined by hash; each window has a second hash of the tokens
themselves, by which exact copies meet however few words they hold. The windows a document shares with an item are then
put on one alignment. Within a run, or within the windows that count as a share,
a slot value of the item must stand for one value in the document; other windows
of the alignment do not matter. A fixed bitmap of the items' window
hashes keeps the windows of clean text out of the join; it has no false
negatives, and its size does not depend on the data.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import as_bytes, kept, slices, written

#: Template tokens of a window, and how many of them must be words.
WINDOW = 8
LEAST_WORDS = 4
#: A run of so many matched tokens is a leak, as is this share of the item's windows.
RUN = 13
SHARE = 0.5
#: Bits of the bitmap, as a power of two (2 MB).
BITMAP_BITS = 24
REMEMBERED = 300_000

# Number words and units (fixed values).
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    " sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety"
    " hundred thousand million billion"
).split()
UNITS = (
    "% mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres"
    " kilometer kilometers kilometre kilometres mg g kg t oz lb lbs gram grams kilogram kilograms"
    " ounce ounces pound pounds ton tons ml cl l liter liters litre litres gallon gallons ms s sec"
    " second seconds min minute minutes h hr hour hours day days week weeks month months year years"
    " $ € £ dollar dollars cent cents euro euros percent degrees kmh mph"
).split()

WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
_SLOT = np.array([mark * 0x9E3779B97F4A7C15 % 2**64 for mark in (0, 11, 12, 13)], np.uint64)
#: Sets the hashes of tokens apart from those of templates.
_TOKENS = np.uint64(0xD6E8FEB86659FD93)
_NUMBERS, _UNITS = frozenset(NUMBER_WORDS), frozenset(UNITS)
_PART = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’\-][^\W\d_]+)*|[%$€£]")
_END = re.compile(r"[.!?…:]\W*$")

IS_NUMBER, IS_UNIT, IS_TITLED, IS_END = 1, 2, 4, 8


def _is_number(low: str) -> bool:
    """Number words, also with hyphens: twenty-five, one-hundred-and-five."""
    first, *rest = low.split("-")
    return first in _NUMBERS and all(p in _NUMBERS or p == "and" for p in rest)


class Reader:
    """Turns texts into numbers of template tokens; remembers the tokens of words."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.parts: dict[bytes, bytes] = {}
        self.known: dict[tuple[str, int], int] = {}
        self.values: list[str] = []
        self.hashed, self.flags = array("Q"), bytearray()

    def _number(self, low: str, flags: int) -> bytes:
        at = self.known.setdefault((low, flags), len(self.known))
        if at == len(self.values):
            self.values.append(low)
            self.hashed.append(xxhash.xxh3_64_intdigest(low.encode("utf-8", "replace")))
            self.flags.append(flags)
        return at.to_bytes(4, "little")

    def _learn(self, word: bytes) -> bytes:
        core = word.rstrip(b".,;:!?")
        bare = core.decode("utf-8", "replace")
        if bare.isalpha():  # most words: letters, then marks
            found, ended = (bare,), bool(word[len(core) :].strip(b",;"))
        else:
            shown = word.decode("utf-8", "replace")
            found, ended = _PART.findall(shown), bool(_END.search(shown))
        numbers = []
        for i, part in enumerate(found, 1):
            low = part.casefold()  # STRASSE is Straße
            flags = IS_NUMBER if part[0].isdigit() or _is_number(low) else 0
            flags |= IS_UNIT if low in _UNITS else 0
            flags |= IS_TITLED if low != part and len(part) > 1 and part.istitle() else 0
            flags |= IS_END if ended and i == len(found) else 0
            numbers.append(self._number(low, flags))
        return b"".join(numbers)

    def read(self, texts: list[bytes]) -> list[np.ndarray]:
        """The token numbers of each text; they hold until the next call."""
        if len(self.parts) > REMEMBERED:
            self.forget()
        known, rows = self.parts, []
        for text in texts:
            words = text.split()
            for w in set(words).difference(known):
                known[w] = self._learn(w)
            rows.append(np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4"))
        return rows


def _kinds(flags: np.ndarray) -> np.ndarray:
    """Slot types; a name is a capitalised word that does not begin a sentence."""
    kinds = np.zeros(len(flags), np.int64)
    if len(flags):
        number, before = flags & IS_NUMBER > 0, flags[:-1]
        kinds[1:][(flags[1:] & IS_TITLED > 0) & (before & IS_END == 0)] = NAME
        kinds[1:][(flags[1:] & IS_UNIT > 0) & (before & IS_NUMBER > 0)] = UNIT
        kinds[number] = NUMBER
    return kinds


def _rolled(marks: np.ndarray, width: int) -> np.ndarray:
    """The hash of each stretch of ``width`` marks."""
    n = len(marks) - width + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for i in range(width):
            total = total * np.uint64(0x100000001B3) + (marks[i : i + n] ^ (total >> np.uint64(29)))
    return total ^ np.uint64(width)


def rich_windows(kinds: np.ndarray, width: int) -> np.ndarray:
    """Positions of the windows that hold words enough for a template."""
    if len(kinds) < width:
        return np.zeros(0, np.int64)
    words = np.concatenate(([0], np.cumsum(kinds == WORD)))
    return np.flatnonzero(words[width:] - words[:-width] >= min(LEAST_WORDS, width))


def window_hashes(hashes: np.ndarray, kinds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and template hashes of a text's windows that hold words enough."""
    enough = rich_windows(kinds, width)
    if not len(enough):
        return enough, np.zeros(0, np.uint64)
    return enough, _rolled(np.where(kinds == WORD, hashes, _SLOT[kinds]), width)[enough]


def token_hashes(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all windows by the tokens themselves, slot or not."""
    found = _rolled(hashes, width)
    return np.arange(len(found)), found ^ _TOKENS


def _slots(row: np.ndarray, kinds: np.ndarray, reader: Reader, at: int, width: int) -> list[str]:
    """The window's slot values in order, each with its place."""
    return [f"{i}:{reader.values[row[at + i]]}" for i in range(width) if kinds[at + i] != WORD]


_WINDOW_ROW = "id long, text_key long, n_tokens long, n_windows long, n_rich long, at long, rich boolean, width long, hash long, slots array<string>"
_ARROW = pa.schema(
    [("id", pa.int64()), ("text_key", pa.int64()), ("n_tokens", pa.int64()), ("n_windows", pa.int64()), ("n_rich", pa.int64()),
     ("at", pa.int64()), ("rich", pa.bool_()), ("width", pa.int64()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))]
)
_LEAK_ROW = "doc_id long, item_id long, n_windows long, matched long, run long, exact boolean"
_LEAK_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("matched", pa.int64()),
     ("run", pa.int64()), ("exact", pa.bool_())]
)


def _windows(key: str, widths: tuple[int, ...] | None, bitmap: np.ndarray | None):
    """mapInArrow function: windows of texts. ``widths`` None: each text's own width, for items."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kept("templates", "reader", Reader)
        for batch in slices(batches, "text"):
            out = []
            texts = as_bytes(batch.column("text"))
            rows = reader.read(texts)
            hashes = np.array(reader.hashed, np.uint64)
            flags = np.frombuffer(bytes(reader.flags), np.uint8)
            for one, text, row in zip(batch.column(key).to_pylist(), texts, rows):
                kinds, text_key = _kinds(flags[row]), None
                for width in widths or (min(WINDOW, len(row)),):
                    if width == 0 or width > len(row):
                        continue
                    own, n = hashes[row], len(row) - width + 1
                    rich, marked = window_hashes(own, kinds, width)
                    of = len(rich)
                    for tokens in (False, True):
                        at, found = token_hashes(own, width) if tokens else (rich, marked)
                        if bitmap is not None:
                            bit = (found >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                            hit = np.flatnonzero(bitmap[bit >> 3] >> (bit & 7) & 1)
                            at, found = at[hit], found[hit]
                        if not len(at):
                            continue
                        if text_key is None:
                            text_key = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                        for a, r, h in zip(at.tolist(), np.isin(at, rich).tolist(), found.astype(np.int64).tolist()):
                            # In a document, windows met by their tokens have the item's own values.
                            slots = None if tokens and widths else _slots(row, kinds, reader, a, width)
                            out.append((one, text_key, len(row), n, of, a, r, width, h, slots))
                    if not widths and of and rich[0] == 0 and flags[row[0]] & IS_TITLED and kinds[0] == WORD:
                        # Within a document the item's first word may follow a sentence without end.
                        kinds = np.concatenate(([NAME], kinds[1:]))
                        first = window_hashes(own[:width], kinds[:width], width)[1]
                        for h in first.astype(np.int64).tolist():
                            slots = _slots(row, kinds, reader, 0, width)
                            out.append((one, text_key, len(row), n, of, 0, True, width, h, slots))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW
                )

    return windows


def _bitmap(rows: DataFrame) -> np.ndarray:
    """Bits of the items' windows, or-ed together per byte of the map."""
    bit = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    bytes_ = rows.groupBy(F.shiftright(bit, 3).alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7)).cast("int"))).alias("bits")
    )
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for row in bytes_.toLocalIterator():  # at most one row for each byte of the map
        out[row.byte] = row.bits
    return out


def _longest(places: list[int], pairs: dict[int, tuple[str, str]], width: int) -> int:
    """Tokens of the longest run of matched windows in which each item value stands for one value."""
    most, stands, start, last = 0, {}, 0, None
    for at in places:
        if last is None or at > last + 1:  # windows that do not follow each other are two runs
            stands, start, fresh = {}, at, at
        else:
            fresh = at + width - 1
        for place in range(fresh, at + width):
            if place in pairs:
                value, shown = pairs[place]
                old, seen = stands.get(value, (shown, place))
                if old != shown:
                    start = max(start, seen + 1)
                stands[value] = (shown, place)
            most = max(most, place + 1 - start)
        last = at
    return most if most >= width else 0


def _agreeing(groups: list[tuple[frozenset, int]], least: int = 0) -> int:
    """The largest weight of groups that ask for one value each, or ``least`` if no choice has more.

    A group asks for pairs (value of the item, value of the document). Branches
    on a value that is asked for in two ways, the heavier way first; a branch
    that cannot pass what has been found is left.
    """
    total = sum(n for _, n in groups)
    if total <= least:
        return least
    asked: dict[str, Counter] = {}
    for pairs, n in groups:
        for value, shown in pairs:
            asked.setdefault(value, Counter())[shown] += n
    contested = [v for v, ways in asked.items() if len(ways) > 1]
    if not contested:
        return total
    value = max(contested, key=lambda v: (sum(asked[v].values()) - max(asked[v].values()), v))
    for shown, _ in sorted(asked[value].items(), key=lambda x: (-x[1], x[0])):
        kept = [(p, n) for p, n in groups if all(v != value or s == shown for v, s in p)]
        least = _agreeing(kept, least)
    return least


def most_consistent(places: list[int], pairs: dict[int, tuple[str, str]], width: int) -> int:
    """The most windows that agree with one choice of a document's value for each value of the item.

    Values that never meet in a window are chosen apart from each other.
    """
    windows: Counter[frozenset] = Counter()
    for at in places:
        own = frozenset(pairs[p] for p in range(at, at + width) if p in pairs)
        if len({v for v, _ in own}) == len(own):  # else the window contradicts itself
            windows[own] += 1
    root: dict[str, str] = {}

    def find(v: str) -> str:
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for own in windows:
        first, *rest = [v for v, _ in own] or [""]
        for v in rest:
            root[find(v)] = find(first)
    parts: dict[str, list[tuple[frozenset, int]]] = {}
    for own, n in windows.items():
        parts.setdefault(find(next(iter(own))[0]) if own else "", []).append((own, n))
    return sum(_agreeing(part) for part in parts.values())


def _judge(run: int, share: float):
    """mapInArrow function over alignments: those that are leaks."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                width, pairs = row["width"], {}
                for window in row["found"]:
                    same = window["doc_slots"] is None
                    for s, d in zip(window["slots"], window["slots"] if same else window["doc_slots"]):
                        place, _, value = s.partition(":")
                        pairs[window["at"] + int(place)] = (value, d.partition(":")[2])
                places = sorted({window["at"] for window in row["found"]})
                longest = _longest(places, pairs, width)
                rich = sorted({window["at"] for window in row["found"] if window["rich"]})
                matched = most_consistent(places, pairs, width)
                matched_rich = most_consistent(rich, pairs, width)
                enough = (
                    matched >= max(1, math.ceil(row["n_windows"] * share))
                    or matched_rich >= max(1, math.ceil(row["n_rich"] * share))
                )
                if longest >= min(run, row["n_tokens"]) or enough:
                    exact = all(s == d for s, d in pairs.values())
                    out.append((row["doc_id"], row["item_id"], row["n_windows"], matched, longest, exact))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), _LEAK_ARROW.types)], schema=_LEAK_ARROW
                )

    return judge


def leaks(
    docs: DataFrame,
    items: DataFrame,
    run: int = RUN,
    share: float = SHARE,
) -> DataFrame:
    """Documents (doc_id, text) that hold an item (item_id, text): one row per pair.

    Columns doc_id, item_id, n_windows (windows of the item), matched (of them
    found with consistent slots on the best alignment), run (longest run of
    matched tokens with consistent slots), exact (whether all slot values of the
    alignment agree). A pair is a leak if, on one alignment, a run with
    consistent slots has ``run`` tokens (all of a shorter item), or ``share`` of
    the item's windows, or of those with words enough for a template, are found
    with consistent slots. Windows with fewer than LEAST_WORDS words are found by
    their tokens only, that is word for word and number for number; so are items
    of numbers only. Items of under eight tokens are one window. Empty and null
    items match nothing. Null and empty documents match nothing; rows without an id are
    left out, as a pair could not name them; repeated rows count once, and texts
    that share an id are judged apart. Other columns are left aside.
    """
    items = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    wanted = written(items.mapInArrow(_windows("item_id", None, None), _WINDOW_ROW), "items")
    widths = tuple(sorted(r.width for r in wanted.select("width").distinct().collect()))  # 8 at most
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    found = rows.mapInArrow(_windows("doc_id", widths or (WINDOW,), _bitmap(wanted)), _WINDOW_ROW)
    found = found.select(
        F.col("id").alias("doc_id"), F.col("text_key").alias("doc_key"), "hash",
        F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots"),
    )
    wanted = wanted.withColumnRenamed("id", "item_id").distinct()
    # An item has few windows: the windows of one alignment are a bounded list.
    hits = (
        found.join(wanted, "hash")
        .withColumn("shift", F.col("doc_at") - F.col("at"))
        .groupBy("doc_id", "doc_key", "item_id", "text_key", "n_tokens", "n_windows", "n_rich", "width", "shift")
        .agg(F.collect_set(F.struct("at", "rich", "slots", "doc_slots")).alias("found"))
    )
    judged = hits.mapInArrow(_judge(run, share), _LEAK_ROW)
    best = F.max(F.struct("matched", "run", "exact", "n_windows"))
    return (
        judged.groupBy("doc_id", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "item_id", "best.n_windows", "best.matched", "best.run", "best.exact")
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text leaks an item; all columns kept.

    A leak is a matter of the text alone: rows of one doc_id are judged apart,
    and rows without a doc_id like others.
    """
    told = F.xxhash64(docs["text"], F.length(docs["text"]))
    leaked = leaks(docs.select(told.alias("doc_id"), "text"), items).select("doc_id").distinct()
    return docs.join(leaked, told == leaked["doc_id"], "left_anti")
