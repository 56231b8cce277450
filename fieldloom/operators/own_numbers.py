"""Which requests keep the number their own file carries, for whole folders at once.

Within a family the numbers that are free on disk are handed out in rising
order to the requests that do not keep their own. So request r with own number
s keeps it exactly if the free numbers below s are used up when r comes: if the
earlier requests that kept nothing are at least as many. Let ``v`` be the own
requests so far that did not keep theirs. A request that asks for ``v`` of at
least ``a`` leaves v alone if it has that, and raises it by one if not; both are
one monotone step. What a block of requests does to v is therefore told by one
number per request: the least v at the block's start from which it keeps its
number. Blocks find these starts apart from each other; only v itself passes
from block to block.

The starts of a block are distinct, and a block adds to v as many as lie above
it. Every 64th start of each block bounds v at all blocks of a family; then the
exact starts are read where v can lie, and v is told. Both passes read the
starts once, whatever the number of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fieldloom.session import stored

#: Own requests of a family that are solved in one task.
BLOCK = 1 << 18
#: Of the starts of a block one in so many is told to the bounds.
STEP = 64
_LEAF = 32
_NEVER = 1 << 60


def least_starts(asked: np.ndarray) -> np.ndarray:
    """For each request in order, the least v before all of them from which it keeps its number.

    Request k keeps its number if v has reached ``asked[k]`` when it comes.
    From a start v, k requests leave v + k less those among them that keep
    theirs; these are the ones with a start of at most v. Short runs are solved
    side by side, request by request; then neighbours are put together, the
    starts of the right one carried over the left one.
    """
    n = len(asked)
    runs = np.full((-(-n // _LEAF), _LEAF), _NEVER, np.int64)
    runs.reshape(-1)[:n] = asked
    held = runs[:, :0]
    for k in range(_LEAF):
        reach = runs[:, k] - k
        passed = (held - np.arange(k) <= reach[:, None]).sum(axis=1)
        runs[:, k] = reach + passed
        held = np.sort(np.concatenate((held, runs[:, k : k + 1]), axis=1), axis=1)
    starts, ranked, width = runs.reshape(-1)[:n], held.reshape(-1)[:n], _LEAF
    while width < n:
        for middle in range(width, n, 2 * width):
            left, right = slice(middle - width, middle), slice(middle, middle + width)
            reach = starts[right] - width
            starts[right] = reach + np.searchsorted(ranked[left] - np.arange(width), reach, side="right")
            both = slice(middle - width, middle + width)
            ranked[both] = np.sort(np.concatenate((ranked[left], starts[right])))
        width *= 2
    return starts


def _solve(rows: pa.Table) -> pa.Table:
    order = np.argsort(rows["ordinal"].to_numpy())
    starts = np.empty(len(order), np.int64)
    starts[order] = least_starts(rows["_asked"].to_numpy()[order])
    ranks = np.empty(len(order), np.int64)
    ranks[np.argsort(starts)] = np.arange(len(order))
    rows = rows.append_column("_start", pa.array(starts))
    rows = rows.append_column("_rank", pa.array(ranks, mask=ranks % STEP != 0))
    return rows.append_column("_size", pa.array(np.full(len(order), len(order), np.int64)))


def _blocks(rows: pa.Table) -> list[tuple[int, int]]:
    """Where each block begins and ends in rows sorted by block."""
    cuts = np.flatnonzero(np.diff(rows["_block"].to_numpy())) + 1
    edges = [0, *cuts.tolist(), len(rows)]
    return list(zip(edges, edges[1:]))


def _told(rows: pa.Table, keys: list[str], **columns: list[int]) -> pa.Table:
    """One row per block: keys, number of the block, and the columns."""
    firsts = rows.select([*keys, "_block"]).take([first for first, _ in _blocks(rows)])
    for name, values in columns.items():
        firsts = firsts.append_column(name, pa.array(values, pa.int64()))
    return firsts


def _with_longs(rows: DataFrame, *names: str) -> StructType:
    return StructType([*rows.schema.fields, *(StructField(n, LongType()) for n in names)])


def _states(solved: DataFrame, keys: list[str]) -> DataFrame:
    """v at the start of each block, for families of several blocks."""
    several = stored(solved.where("_block > 0").select(*keys).distinct())

    def bounds(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_block", "ascending"), ("_start", "ascending")])
        starts, ranks, sizes = (rows[c].to_numpy() for c in ("_start", "_rank", "_size"))
        low, high, lows, highs = 0, 0, [], []
        for first, end in _blocks(rows):
            lows.append(low)
            highs.append(high)
            size = int(sizes[first])
            # At most so many starts are at most low, at least so many at most high.
            over = first + int(np.searchsorted(starts[first:end], low, side="right"))
            most = int(ranks[over]) if over < end else size
            under = first + int(np.searchsorted(starts[first:end], high, side="right")) - 1
            least = int(ranks[under]) + 1 if under >= first else 0
            low, high = low + size - most, high + size - least
        return _told(rows, keys, _low=lows, _high=highs)

    marks = solved.where(F.col("_rank").isNotNull()).join(several, keys, "left_semi")
    marks = marks.select(*keys, "_block", "_start", "_rank", "_size")
    bounded = _with_longs(solved.select(*keys, "_block"), "_low", "_high")
    bands = stored(marks.groupBy(*keys).applyInArrow(bounds, bounded))
    between = (F.col("_start") > F.col("_low")) & (F.col("_start") <= F.col("_high"))
    exact = (
        solved.select(*keys, "_block", "_start", "_size")
        .join(bands, [*keys, "_block"])
        .groupBy(*keys, "_block")
        .agg(
            (F.first("_size") - F.count_if(F.col("_start") <= F.col("_low"))).alias("_above"),
            F.sort_array(F.collect_list(F.when(between, F.col("_start")))).alias("_between"),
        )
    )

    def passed_on(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_block")
        v, states = 0, []
        for above, between in zip(rows["_above"].to_pylist(), rows["_between"]):
            states.append(v)
            v += above - int(np.searchsorted(between.values.to_numpy(), v, side="right"))
        return _told(rows, keys, _v=states)

    told = _with_longs(solved.select(*keys, "_block"), "_v")
    return stored(exact.groupBy(*keys).applyInArrow(passed_on, told))


def keepers(own: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Adds ``granted`` to own-number requests of families that no other family runs into.

    ``own``: keys of the family, ordinal (unique in it), ``free_below`` (numbers
    below the own one that are not on disk), ``before`` and ``own_before``
    (requests of the family that come earlier, and own requests among them).
    Each own number is asked for once. The last three are dropped.
    """
    kept = [c for c in own.columns if c not in ("free_below", "before", "own_before")]
    asked = own.withColumns(
        {
            "_asked": F.col("free_below") - (F.col("before") - F.col("own_before")),
            "_block": F.floor(F.col("own_before") / block),
        }
    ).select(*kept, "_asked", "_block")
    schema = _with_longs(asked, "_start", "_rank", "_size")
    solved = stored(asked.groupBy(*keys, "_block").applyInArrow(_solve, schema))
    v = F.lit(0).cast("long")
    told = solved
    if solved.agg(F.max("_block")).first()[0]:
        told = solved.join(_states(solved, keys), [*keys, "_block"], "left")
        v = F.coalesce("_v", v)
    return told.select(*kept, (F.col("_start") <= v).alias("granted"))
