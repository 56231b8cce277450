"""Running sums, maxima and positions over ordered groups of any size.

A plain window sorts a whole group in one task, which is right for groups of
moderate size. A larger group is cut into stretches of the order column that
hold about equally many rows, whatever its values: the cuts are quantiles from a
sketch of the group. Each stretch is summed on its own, and the totals of
earlier stretches are added: only one row per stretch is ever ordered across
the group. Cuts and totals are one row per stretch of a large group, so they are
small next to the rows; they are stored, and Spark sends them to the rows by
their measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import stored

#: Rows of a group that are ordered in one task, about; and the most stretches of a group.
STRETCH = 1 << 18
MOST_STRETCHES = 1000


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are keys like others."""
    own = {k: f"_right_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(own)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()))
    return left.join(renamed, same, how).drop(*own.values())


def stretch_cuts(rows: DataFrame, keys: list[str], order: str, stretch: int = STRETCH) -> DataFrame | None:
    """Where groups of over ``stretch`` rows are cut; None if there are none.

    Columns: keys, cuts (rising order values, each the first of a stretch), and
    heavy (values that fill stretches of their own, and how many).
    """
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > stretch)
    hot = stored(hot)
    if hot.isEmpty():
        return None
    shares = [i / MOST_STRETCHES for i in range(1, MOST_STRETCHES)]
    values = rows.select(*keys, F.col(order).alias("_value"))
    sketched = (
        _joined(values, hot, keys)
        .groupBy(*keys)
        .agg(
            F.percentile_approx("_value", shares, 4 * MOST_STRETCHES).alias("_at"),
            F.least(F.ceil(F.first("_n") / stretch), F.lit(MOST_STRETCHES)).cast("int").alias("_wanted"),
        )
    )
    picked = F.transform(
        F.sequence(F.lit(1), F.col("_wanted") - 1),
        lambda i: F.get("_at", F.floor(i * F.lit(MOST_STRETCHES) / F.col("_wanted")).cast("int") - 1),
    )
    chosen = sketched.where("_wanted > 1").withColumn("_picked", picked)
    cuts = F.array_distinct("_picked")
    often = F.transform(cuts, lambda c: F.struct(c.alias("value"), F.size(F.filter("_picked", lambda p: p == c)).alias("many")))
    # Sketches depend on the order in which they are merged, so they are made once.
    return stored(
        chosen.select(*keys, cuts.alias("_cuts"), F.filter(often, lambda h: h["many"] > 1).alias("_heavy"))
    )


def with_stretch(
    rows: DataFrame, keys: list[str], order: str, cuts: DataFrame, ties: tuple[str, ...] = (), how: str = "left"
) -> DataFrame:
    """Adds ``_stretch``, which rises with ``order``; nulls come first.

    Rows of one order value that fill several stretches are dealt to them by a
    hash, as their order is open; if ``ties`` order them, they stay together.
    An inner join keeps the groups that are cut only.
    """
    found = _joined(rows, cuts, keys, how).withColumn("_found", F.lit(0))
    # Binary search, a compiled projection for each step: how many cuts are at most the value.
    for step in (1 << i for i in range(MOST_STRETCHES.bit_length() - 1, -1, -1)):
        reached = F.get("_cuts", F.col("_found") + (step - 1)) <= F.col(order)
        found = found.withColumn("_found", F.when(reached, F.col("_found") + step).otherwise(F.col("_found")))
    stretch = F.col("_found").cast("long") * (MOST_STRETCHES + 1)
    if not ties:
        own = F.get(F.filter("_heavy", lambda h: h["value"] == F.col(order)), F.lit(0))["many"]
        dealt = F.pmod(F.xxhash64(*rows.columns), own.cast("long"))
        many = F.when(F.size("_heavy") > 0, dealt)
        stretch = stretch + F.coalesce(many, F.lit(MOST_STRETCHES).cast("long"))
    return found.withColumn("_stretch", stretch).drop("_cuts", "_heavy", "_found")


def _running(
    rows: DataFrame,
    keys: list[str],
    order: str,
    columns: dict[str, str],
    fold,
    combine,
    ties: tuple[str, ...],
    stretch: int,
) -> DataFrame:
    """``columns`` maps each result to the column folded over earlier rows."""

    def folds(keys: list[str]) -> dict[str, Column]:
        local = Window.partitionBy(*keys).orderBy(order, *ties)
        before = local.rowsBetween(Window.unboundedPreceding, -1)
        return {o: fold(c).over(before) for o, c in columns.items()}

    cuts = stretch_cuts(rows, keys, order, stretch)
    if cuts is None:
        return rows.select(*rows.columns, *[combine(F.lit(None), c).alias(o) for o, c in folds(keys).items()])
    cut = with_stretch(rows, keys, order, cuts, ties)
    folded = cut.withColumns({f"_local_{o}": c for o, c in folds([*keys, "_stretch"]).items()})
    # Groups that are not cut have nothing before their one stretch.
    totals = with_stretch(rows, keys, order, cuts, ties, "inner").groupBy(*keys, "_stretch").agg(
        *[fold(c).alias(f"_total_{o}") for o, c in columns.items()]
    )
    across = Window.partitionBy(*keys).orderBy("_stretch")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_stretch",
        *[fold(f"_total_{o}").over(earlier).alias(f"_offset_{o}") for o in columns],
    )
    joined = _joined(folded, stored(offsets), [*keys, "_stretch"], "left")
    return joined.select(
        *rows.columns,
        *[combine(F.col(f"_offset_{o}"), F.col(f"_local_{o}")).alias(o) for o in columns],
    )


def running_totals(
    rows: DataFrame,
    keys: list[str],
    order: str,
    columns: dict[str, str],
    ties: tuple[str, ...] = (),
    stretch: int = STRETCH,
) -> DataFrame:
    """Adds each result column: the sum of its weight over earlier rows."""

    def add(offset, local):
        return F.coalesce(offset, F.lit(0)) + F.coalesce(local, F.lit(0))

    return _running(rows, keys, order, columns, F.sum, add, ties, stretch)


def running_total(
    rows: DataFrame,
    keys: list[str],
    order: str,
    weight: str,
    out: str,
    ties: tuple[str, ...] = (),
    stretch: int = STRETCH,
) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over earlier rows of the group."""
    return running_totals(rows, keys, order, {out: weight}, ties, stretch)


def running_max(
    rows: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    out: str,
    ties: tuple[str, ...] = (),
    stretch: int = STRETCH,
) -> DataFrame:
    """Adds ``out``: the largest ``value`` among earlier rows; null for the first."""

    return _running(rows, keys, order, {out: value}, F.max, F.greatest, ties, stretch)


def position(
    rows: DataFrame, keys: list[str], order: str, out: str, stretch: int = STRETCH
) -> DataFrame:
    """Adds ``out``: the 0-based position of a row within its group."""
    weighed = rows.withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(weighed, keys, order, "_one", out, stretch=stretch).drop("_one")
