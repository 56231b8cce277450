"""Rename planning: preflight and collision-free destinations.

Requests of one batch claim names in batch order: the desired name, then
``stem (1)ext``, ``stem (2)ext`` and so on, skipping names on disk (a request's
own source excepted) and names claimed earlier. All requests for one desired
name in one folder form a family, and a family's candidates are numbered 0,
1, 2... A request then simply gets the k-th free number of its family, k being
its position in it. Two things bend that rule:

* a literal request for a name another family would generate, such as
  ``n (1).pdf`` next to ``n.pdf``: the first such request either takes the
  number out of the other family or finds it gone;
* a request whose own source carries one of its family's numbers, which it may
  keep.

Both are decided from a handful of figures per such request (how many of the
family came before it, how many lower numbers are taken), computed in
parallel. Own-name requests are settled for whole families at once
(``own_numbers``). Families and requests have numbers of their own, so that the
ordered steps pass on narrow rows, each request once. Only where families run into each other, or a file is asked
for twice, are the special rows of the families concerned folded in order; all
other rows are numbered by running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import is_plain_filename, split_name
from fieldloom.operators.ordered import _joined, position, running_total, running_totals
from fieldloom.operators.own_numbers import keepers
from fieldloom.session import stored as cut_lineage

FAMILY = ["batch_id", "dir", "desired_filename"]
CHAIN = ["batch_id", "dir", "root"]

# Longer numbers are past anything a table of requests could be given.
_NUMBER_TAIL = "^[1-9][0-9]{0,17}\\)\\z"


def numbered(name: Column) -> tuple[Column, Column]:
    """(family, number) of a generated name; nulls for any other name."""
    stem, extension = split_name(name)
    # The number holds no bracket, so it starts at the last one.
    tail = F.substring_index(stem, " (", -1)
    ahead = F.length(stem) - F.length(tail) - 2
    is_numbered = stem.endswith(")") & (ahead > 0) & tail.rlike(_NUMBER_TAIL)
    family = F.when(is_numbered, F.concat(F.left(stem, ahead), extension))
    number = F.when(is_numbered, F.left(tail, F.length(tail) - 1).cast("bigint"))
    return family, number


def root_name(name: Column) -> Column:
    """The name without any trailing numbers: what a chain of families shares."""
    stem, extension = split_name(name)
    bare = F.regexp_replace(stem, "( \\([1-9][0-9]{0,17}\\))+\\z", "")
    return F.concat(F.when(stem.endswith(")"), bare).otherwise(stem), extension)


def numbered_name(name: Column, number: Column) -> Column:
    stem, extension = split_name(name)
    return F.when(number == 0, name).otherwise(
        F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), extension)
    )


def occupied_elsewhere(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``taken``: the desired name is on disk and is not the own source."""
    on_disk = files.select("dir", F.col("name").alias("desired_filename")).distinct()
    marked = requests.join(
        on_disk.withColumn("_exists", F.lit(True)), ["dir", "desired_filename"], "left"
    )
    taken = F.col("_exists").isNotNull() & (F.col("desired_filename") != F.col("source_name"))
    return marked.withColumn("taken", taken).drop("_exists")


def preflight(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``problem`` per request and ``batch_ok`` for the whole batch."""
    # A path listed twice is one path.
    sources = files.groupBy("dir", F.col("name").alias("source_name")).agg(
        F.bool_or("is_file").alias("is_file")
    )
    checked = requests.join(sources, ["dir", "source_name"], "left")
    path = F.concat_ws("/", "dir", "source_name")
    # The texts of the messages below are results that must come out the same.
    problem = (
        F.when(
            ~is_plain_filename(F.col("desired_filename")),
            F.concat(path, F.lit(": invalid destination filename")),
        )
        .when(F.col("is_file").isNull(), F.concat(path, F.lit(": no longer exists")))
        .when(~F.col("is_file"), F.concat(path, F.lit(": not a file")))
    )
    judged = checked.withColumn("problem", problem).drop("is_file")
    verdicts = judged.groupBy("batch_id").agg(
        F.bool_and(F.col("problem").isNull()).alias("batch_ok")
    )
    return judged.join(verdicts, "batch_id")


def with_numbers(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``_base`` and ``_number``: ``numbered`` of a column, each part of the name found once."""
    stem, extension = split_name(F.col(name))
    parts = rows.withColumns({"_stem": stem, "_extension": extension})
    parts = parts.withColumn("_tail", F.substring_index("_stem", " (", -1))
    parts = parts.withColumn("_ahead", F.length("_stem") - F.length("_tail") - 2)
    told = F.col("_stem").endswith(")") & (F.col("_ahead") > 0) & F.col("_tail").rlike(_NUMBER_TAIL)
    parts = parts.withColumn("_told", told)
    base = F.concat(F.left("_stem", F.col("_ahead")), F.col("_extension"))
    number = F.left("_tail", F.length("_tail") - 1).cast("bigint")
    return parts.withColumns({"_base": F.when(F.col("_told"), base), "_number": F.when(F.col("_told"), number)}).drop(
        "_stem", "_extension", "_tail", "_ahead", "_told"
    )


def _disk_numbers(families: DataFrame, files: DataFrame) -> DataFrame:
    """(family, number) pairs whose name exists in the folder; ``files`` lists each name once."""
    own = files.select("dir", F.col("name").alias("desired_filename"), F.lit(0).cast("bigint").alias("number"))
    generated = files.filter(F.col("_base").isNotNull()).select(
        "dir", F.col("_base").alias("desired_filename"), F.col("_number").alias("number")
    )
    keys = ["dir", "desired_filename"]
    return own.unionByName(generated).join(families.select(*keys, "family"), keys).select("family", "number")


def _own_numbers(requests: DataFrame, files: DataFrame, families: DataFrame) -> DataFrame:
    """Per request: family, ordinal, and the number of the family its source carries, if any.

    ``files`` lists each name once, so a join with it repeats no row.
    """
    columns = ["family", "_row", "ordinal"]
    placed = _joined(
        requests.select(*FAMILY, "_row", "ordinal", "_own", "source_name"), families.select(*FAMILY, "family"), FAMILY
    )
    listed = files.select("dir", F.col("name").alias("source_name"), F.lit(True).alias("_there"))
    own = placed.filter(F.col("_own").isNotNull()).join(listed, ["dir", "source_name"], "left")
    other = placed.filter(F.col("_own").isNull())
    return own.select(*columns, F.when(F.col("_there"), F.col("_own")).alias("number")).unionByName(
        other.select(*columns, F.col("_own").alias("number"))
    )


def _children(families: DataFrame) -> DataFrame:
    """Families whose name another family of the folder would generate: that family, and its number of the name.

    Columns: family, child, dir, ordinal (of the first literal request), kind, number, name.
    """
    named = families.filter(F.col("_base").isNotNull()).select(
        "batch_id",
        "dir",
        F.col("_base").alias("desired_filename"),
        F.col("family").alias("child"),
        F.col("first_ordinal").alias("ordinal"),
        F.lit(0).alias("kind"),
        F.col("_number").alias("number"),
        F.col("desired_filename").alias("name"),
    )
    return named.join(families.select(*FAMILY, "family"), FAMILY).select(
        "family", "child", "dir", "ordinal", "kind", "number", "name"
    )


_DECISION = "family long, _row long, ordinal long, kind int, number long, child long, granted boolean"


def _decide(specials: DataFrame) -> DataFrame:
    """Folds the special rows of each chain of families in batch order.

    Rows stream through in sorted partitions; the state kept per chain is the
    set of numbers taken out of each family so far.
    """

    def fold(batches):
        from bisect import bisect_left, insort

        import pandas as pd

        chain, won, settled, lost, names = None, {}, {}, set(), set()
        for pdf in batches:
            granted = []
            for row in pdf.itertuples(index=False):
                key = (row.batch_id, row.dir, row.root)
                if key != chain:
                    chain, won, settled, lost, names = key, {}, {}, set(), set()
                family = row.desired_filename
                taken = won.setdefault(family, [])
                free = row.number - row.disk_below - bisect_left(taken, row.number)
                if family in lost and row.number > 0:
                    free -= 1
                used = row.family_before - settled.get(family, 0)
                if row.kind == 0:
                    ok = used <= free
                    if ok:
                        insort(taken, row.number)
                    else:
                        lost.add(row.name)
                else:
                    ok = used >= free and row.name not in names
                    if ok:
                        settled[family] = settled.get(family, 0) + 1
                        names.add(row.name)
                granted.append(ok)
            columns = ["family", "request", "ordinal", "kind", "number", "child"]
            told = pdf[columns].rename(columns={"request": "_row"})
            yield told.assign(granted=pd.Series(granted, dtype="bool", index=pdf.index))

    # pandas turns whole numbers with nulls into floats, and its tuples have no field "_row".
    whole = specials.withColumns(
        {"child": F.coalesce("child", F.lit(-1).cast("bigint")), "request": F.coalesce("_row", F.lit(-1).cast("bigint"))}
    ).drop("_row")
    placed = whole.repartition(*CHAIN).sortWithinPartitions("batch_id", "dir", "root", "ordinal", "kind")
    return placed.mapInPandas(fold, _DECISION)


def _entangled(own: DataFrame, children: DataFrame, literal: DataFrame, families: DataFrame) -> DataFrame:
    """Families of chains in which the order of the special rows matters across families, or a file is asked for twice."""
    twice = own.groupBy("family", "number").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("family")
    # One file may be the number of a family and the literal name of another.
    both = (
        children.join(own.select("family", "number"), ["family", "number"], "left_semi")
        .join(own.filter("number = 0").select(F.col("family").alias("child")), "child", "left_semi")
        .select("family")
    )
    mixed = cut_lineage(twice.unionByName(both).unionByName(literal.select("family")).distinct())
    rooted = families.select("family", "batch_id", "dir", root_name(F.col("desired_filename")).alias("root"))
    chains = rooted.join(mixed, "family", "left_semi").select(*CHAIN).distinct()
    return _joined(rooted, chains, CHAIN, "left_semi").select("family")


def _settle(measured: DataFrame, own: DataFrame, children: DataFrame, literal: DataFrame, families: DataFrame) -> DataFrame:
    """Adds ``granted`` to the measured special rows."""
    entangled = cut_lineage(_entangled(own, children, literal, families))
    named = families.select("family", *FAMILY, root_name(F.col("desired_filename")).alias("root"))
    folded = _decide(
        measured.join(entangled, "family", "left_semi")
        .join(named, "family")
        .withColumn("name", numbered_name(F.col("desired_filename"), F.col("number")))
    )
    if own.isEmpty():
        return folded
    alone = measured.join(entangled, "family", "left_anti").select(
        "family", "_row", "ordinal", "kind",
        (F.col("number") - F.col("disk_below")).alias("free_below"), F.col("family_before").alias("before"), "own_before",
    )
    none = F.lit(None).cast("bigint")
    settled = keepers(alone, ["family"]).select(
        "family", "_row", "ordinal", "kind", none.alias("number"), none.alias("child"), "granted"
    )
    return folded.unionByName(settled)


def plan_destinations(requests: DataFrame, files: DataFrame, stretch: int | None = None) -> DataFrame:
    """Adds ``number`` and ``destination_name`` to every request.

    ``requests``: batch_id, ordinal (unique in its batch), request_id, dir,
    source_name, desired_filename. ``files``: dir, name. Batches are planned
    against the same listing, independently of one another.
    """
    options = {"stretch": stretch} if stretch else {}
    one, zero, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    columns = requests.columns
    # Several steps read both tables; a single input file would keep each of them in one task.
    same = F.col("source_name") == F.col("desired_filename")
    requests = with_numbers(requests.repartition("batch_id", "ordinal"), "source_name").withColumns(
        {
            "_row": F.monotonically_increasing_id(),
            "_own": F.when(same, zero).when(F.col("_base") == F.col("desired_filename"), F.col("_number")),
        }
    )
    requests = cut_lineage(requests.select(*columns, "_row", "_own"))
    files = cut_lineage(with_numbers(files.select("dir", "name").distinct(), "name"))
    # Several steps read these as well.
    families = requests.groupBy(*FAMILY).agg(F.min("ordinal").alias("first_ordinal"))
    families = cut_lineage(
        with_numbers(families, "desired_filename").withColumn("family", F.monotonically_increasing_id())
    )
    disk = cut_lineage(_disk_numbers(families, files))
    placed = cut_lineage(_own_numbers(requests, files, families))
    children = cut_lineage(_children(families))
    # The few literal names are sent to the listing, not the listing to them.
    held = children.select("dir", "name").distinct().join(files.select("dir", "name"), ["dir", "name"])
    literal = cut_lineage(children.join(held, ["dir", "name"], "left_anti").drop("dir"))
    own = placed.filter(F.col("number").isNotNull())
    # Only families with special rows are measured; mostly there are none.
    touched = cut_lineage(own.select("family").unionByName(literal.select("family")).distinct())

    # How many requests of the family, and how many that carry numbers, came before each special row.
    carries = F.col("number").isNotNull()
    members = placed.join(touched, "family", "left_semi").select(
        "family", "_row", "ordinal", F.when(carries, 1).alias("kind"), "number", none.alias("child"),
        one.alias("_weight"), F.when(carries, one).otherwise(zero).alias("_carried"),
    )
    marks = literal.select(
        "family", none.alias("_row"), "ordinal", "kind", "number", "child", zero.alias("_weight"), zero.alias("_carried")
    )
    sums = {"family_before": "_weight", "own_before": "_carried"}
    arrivals = running_totals(members.unionByName(marks), ["family"], "ordinal", sums, ("_weight",), **options)
    arrivals = cut_lineage(arrivals.filter(F.col("kind").isNotNull()).drop("_weight", "_carried"))
    # How many lower numbers of the family are on disk, for special rows and for the numbers on disk.
    numbers = disk.withColumn("_weight", one)
    asked = arrivals.withColumn("_weight", zero)
    below = running_total(
        numbers.unionByName(asked, allowMissingColumns=True), ["family"], "number", "_weight", "disk_below", ("_weight",), **options
    )
    below = cut_lineage(below.drop("_weight"))
    measured = below.filter(F.col("kind").isNotNull())
    decided = cut_lineage(_settle(measured, own, children, literal, families))

    settled = decided.filter((F.col("kind") == 1) & F.col("granted")).select(
        "_row", none.alias("number"), F.lit(True).alias("_keeps")
    )
    taken_out = decided.filter((F.col("kind") == 0) & F.col("granted")).select("family", "number")
    gone = decided.filter((F.col("kind") == 0) & ~F.col("granted")).select(
        F.col("child").alias("family"), zero.alias("number")
    )

    # A blocked number b with m blocked numbers below it shifts every request
    # whose position is at least b - m by one. Numbers on disk know theirs.
    ranked = below.filter(F.col("kind").isNull()).select("family", (F.col("number") - F.col("disk_below")).alias("_place"))
    blocked = cut_lineage(taken_out.unionByName(gone))
    if not blocked.isEmpty():
        changed = cut_lineage(blocked.select("family").distinct())
        blocked = disk.join(changed, "family", "left_semi").unionByName(blocked)
        again = position(blocked, ["family"], "number", "_rank", **options)
        ranked = ranked.join(changed, "family", "left_anti").unionByName(
            again.select("family", (F.col("number") - F.col("_rank")).alias("_place"))
        )
    # Contiguous names on disk all stand at one place: they count as one row.
    steps = ranked.groupBy("family", "_place").agg(F.count(F.lit(1)).alias("_weight"))
    steps = cut_lineage(steps).select("family", "_place", "_weight", zero.alias("_order"), none.alias("_row"))
    unsettled = placed.filter(F.col("number").isNull()).select("family", "_row", "ordinal").unionByName(
        decided.filter((F.col("kind") == 1) & ~F.col("granted")).select("family", "_row", "ordinal")
    )
    waiting = cut_lineage(position(unsettled, ["family"], "ordinal", "_place", **options).drop("ordinal"))
    lined_up = steps.unionByName(waiting.select("family", "_place", zero.alias("_weight"), one.alias("_order"), "_row"))
    shifted = running_total(lined_up, ["family"], "_place", "_weight", "_shift", ("_order",), **options)
    given = shifted.filter(F.col("_row").isNotNull()).select(
        "_row", (F.col("_place") + F.col("_shift")).alias("number"), F.lit(False).alias("_keeps")
    )
    planned = requests.join(given.unionByName(settled), "_row", "left")
    return planned.select(
        *columns,
        "number",
        F.when(F.col("_keeps"), F.col("source_name"))
        .otherwise(numbered_name(F.col("desired_filename"), F.col("number")))
        .alias("destination_name"),
    )


def rename_plan(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, source, destination) for batches that pass preflight."""
    judged = preflight(requests, files)
    passed = cut_lineage(judged.filter("batch_ok").drop("problem", "batch_ok"))
    return plan_destinations(passed, files).select(
        "batch_id",
        "request_id",
        F.concat_ws("/", "dir", "source_name").alias("source_path"),
        F.concat_ws("/", "dir", "destination_name").alias("destination_path"),
    )


def rename_outcomes(plan: DataFrame, results: DataFrame) -> DataFrame:
    """The ledger: what became of every planned rename.

    ``results`` has request_id, error (null when moved) and identity (null
    when it could not be read). Nothing of the plan is lost when a result or
    an identity is missing.
    """
    joined = plan.join(results.withColumn("_reported", F.lit(True)), "request_id", "left")
    moved = F.col("_reported").isNotNull() & F.col("error").isNull()
    return joined.select(
        *plan.columns,
        F.when(moved, F.lit("renamed")).otherwise(F.lit("failed")).alias("outcome"),
        F.when(~moved, F.coalesce("error", F.lit("no result reported"))).alias("message"),
        F.when(moved, F.col("identity")).alias("identity"),
        (moved & F.col("identity").isNull()).alias("untracked"),
    )


def batch_outcomes(ledger: DataFrame) -> DataFrame:
    """Per batch: counts, whether it can be undone, and the untracked warning."""
    tracked = (F.col("outcome") == "renamed") & ~F.col("untracked")
    counts = ledger.groupBy("batch_id").agg(
        F.count_if(F.col("outcome") == "renamed").alias("renamed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if("untracked").alias("untracked"),
        F.bool_or(tracked).alias("undoable"),
    )
    return counts.withColumn(
        "history_warning",
        F.when(
            F.col("untracked") > 0,
            F.format_string("%d file(s) were renamed but could not be tracked for Undo", "untracked"),
        ),
    )
