"""Hosts, artefacts and their files: fit, audit, sizes, timings, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import cut_lineage

# Memory floor per tier in GB, severity bounds in percent.
TIER_FLOOR_GB = {"small": 8.0, "medium": 16.0, "large": 32.0}
CRITICAL_BELOW, WARNING_BELOW = 10, 25


def _short_number(value: Column) -> Column:
    """Six significant digits without trailing zeros, for everyday magnitudes."""
    rounded = F.round(value, 0)
    for limit, decimals in ((1e5, 1), (1e4, 2), (1e3, 3), (1e2, 4), (1e1, 5)):
        rounded = F.when(F.abs(value) < limit, F.round(value, decimals)).otherwise(rounded)
    text = rounded.cast("decimal(20,5)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")


def _one_decimal(value: Column) -> Column:
    """One decimal, rounded by the exact binary value, even on exact ties.

    The value is split in two parts whose hundredfolds are exact, so the sign
    of the distance to the midpoint is exact as well.
    """
    high = value.cast("float").cast("double")
    tenths = F.floor(value * 10)
    beyond = (high * 100 - (tenths * 10 + 5)) + (value - high) * 100
    up = (beyond > 0) | ((beyond == 0) & (tenths % 2 == 1))
    whole = tenths + F.when(up, 1).otherwise(0)
    return F.concat(
        F.floor(whole / 10).cast("string"), F.lit("."), (whole % 10).cast("string")
    )


def fit_hosts(pairs: DataFrame) -> DataFrame:
    """(host, model) pairs with capabilities to compatible, reasons and status.

    Which pairs to judge is the caller's choice; nothing is crossed here.
    """
    tiers = [F.lit(part) for item in TIER_FLOOR_GB.items() for part in item]
    floor = F.element_at(F.create_map(*tiers), F.col("memory_tier"))
    memory, disk = F.col("memory_gb").cast("double"), F.col("free_disk_gb").cast("double")
    size = F.col("size_gb").cast("double")
    installed = F.coalesce(F.col("installed"), F.lit(False))
    # The texts of the messages below are results that must come out the same.
    reasons = F.array_compact(
        F.array(
            F.when(
                memory < floor,
                F.concat(
                    F.lit("needs at least "), _short_number(floor), F.lit(" GB memory; this device has "),
                    _short_number(memory), F.lit(" GB"),
                ),
            ),
            F.when(
                ~installed & (disk < size),
                F.concat(
                    F.lit("needs "), _one_decimal(size), F.lit(" GB free disk; this device has "),
                    _one_decimal(disk), F.lit(" GB"),
                ),
            ),
        )
    )
    judged = pairs.withColumn("reasons", reasons)
    return judged.withColumns(
        {
            "compatible": F.size("reasons") == 0,
            "status": F.when(installed, F.lit("installed")).otherwise(F.lit("not_installed")),
        }
    )


def audit_files(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected against observed files, one verdict per (model, path)."""
    joined = expected.join(observed, ["model_id", "path"], "full")
    verdict = (
        F.when(F.col("expected_size").isNull(), F.lit("unexpected"))
        .when(F.col("observed_size").isNull(), F.lit("missing"))
        .when(F.col("observed_size") != F.col("expected_size"), F.lit("size mismatch"))
        .when(F.col("observed_digest") != F.col("expected_digest"), F.lit("checksum mismatch"))
        .otherwise(F.lit("verified"))
    )
    return joined.withColumn("verdict", verdict)


def installed_models(audit: DataFrame) -> DataFrame:
    """A model is installed when every expected file is there at full size."""
    sized = ~F.col("verdict").isin("missing", "size mismatch")
    expected = F.col("verdict") != "unexpected"
    return audit.filter(expected).groupBy("model_id").agg(F.bool_and(sized).alias("installed"))


def model_sizes(expected: DataFrame) -> DataFrame:
    return expected.groupBy("model_id").agg(F.sum("expected_size").cast("bigint").alias("total_size"))


def with_display_names(rows: DataFrame, names: DataFrame, key: str = "model_id") -> DataFrame:
    """Looks names up, falling back to the raw id."""
    looked_up = names.select(F.col("model_id").alias(key), "display_name")
    return rows.join(looked_up, key, "left").withColumn(
        "display_name", F.coalesce(F.col("display_name"), F.col(key).cast("string"))
    )


def memory_severity(available: Column, total: Column, stale: Column) -> Column:
    percent = available / total * 100
    return (
        F.when(stale | (total <= 0), F.lit("none"))
        .when(percent < CRITICAL_BELOW, F.lit("critical"))
        .when(percent < WARNING_BELOW, F.lit("warning"))
        .otherwise(F.lit("none"))
    )


def latest_memory(samples: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The last good sample per host, flagged stale when a later poll failed."""
    at = F.struct(*order)
    good = F.col("ok")
    sample = F.struct("total_mb", "available_mb", "loaded_entry_id")
    latest = samples.groupBy("host_id").agg(
        F.max_by(F.when(good, sample), F.when(good, at)).alias("last"),
        F.max(F.when(good, at)).alias("last_good"),
        F.max(F.when(~good, at)).alias("last_bad"),
    )
    stale = F.coalesce(
        F.col("last_bad") > F.col("last_good"), F.col("last_bad").isNotNull()
    )
    flagged = latest.select("host_id", "last.*", stale.alias("stale"))
    return flagged.withColumn(
        "severity", memory_severity(F.col("available_mb"), F.col("total_mb"), F.col("stale"))
    )


def residency_text(loaded_name: Column, stale: Column) -> Column:
    text = F.coalesce(F.concat(F.lit("Loaded "), loaded_name), F.lit("No model loaded"))
    return F.when(stale, F.concat(text, F.lit(" (last known)"))).otherwise(text)


def _octave(value: Column) -> Column:
    """An order-preserving bucket number, 64 per power of two."""
    step = F.floor(F.log2(F.abs(value)) * 64) + 100_000
    return F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0)).cast("bigint")


#: Distinct values that are ranked in one task, and the parts a crowded range is cut into.
RANKED, PARTS = 1 << 16, 1024


def _with_ranks(cells: DataFrame, segment: list[str], order: str) -> DataFrame:
    """The cells (_in, _before: rows before the segment) that hold a middle rank, each a segment now."""
    upto = Window.partitionBy(*segment).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.withColumn("_before", F.col("_before") + F.sum("_in").over(upto) - F.col("_in"))
    return placed.filter((F.col("_before") < F.col("_upper")) & (F.col("_before") + F.col("_in") >= F.col("_lower")))


def _inside(counted: DataFrame, segments: DataFrame, keys: list[str], value: str) -> DataFrame:
    return counted.join(segments, [*keys, "_bucket"]).filter(F.col(value).between(F.col("_lo"), F.col("_hi")))


def middle_segments(counted: DataFrame, keys: list[str], value: str, ranked: int = RANKED) -> DataFrame:
    """The value ranges [_lo, _hi] of each key that hold its middle ranks, with ``ranked`` values at most.

    A histogram over ordered buckets finds the ranges; a range with more values
    is cut into equal parts, again and again. Values of one bucket differ in
    their last 52 bits only, of which each round settles ten.
    """
    measures = [
        F.sum("_n").alias("_in"), F.count(F.lit(1)).alias("_values"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    ]
    total = F.sum("_in").over(Window.partitionBy(*keys))
    histogram = counted.groupBy(*keys, "_bucket").agg(*measures).withColumns(
        {"_lower": F.floor((total + 1) / 2), "_upper": F.floor(total / 2) + 1, "_before": F.lit(0).cast("long")}
    )
    segments = cut_lineage(_with_ranks(histogram, keys, "_bucket"))
    while True:
        crowded = segments.filter(F.col("_values") > ranked)
        if crowded.isEmpty():
            return segments
        segment = [*keys, "_bucket", "_first", "_lower", "_upper", "_before"]
        ranges = crowded.select(*keys, "_bucket", F.col("_lo").alias("_first"), "_lo", "_hi", "_lower", "_upper", "_before")
        reach = (F.col("_hi") - F.col("_lo")).cast("double")
        part = F.floor((F.col(value) - F.col("_lo")).cast("double") / reach * PARTS)
        cells = _inside(counted, ranges, keys, value).withColumn("_part", part).groupBy(*segment, "_part").agg(*measures)
        refined = _with_ranks(cells, segment[:-1], "_part").select(segments.columns)
        segments = cut_lineage(segments.filter(F.col("_values") <= ranked).unionByName(refined))


def exact_medians(rows: DataFrame, keys: list[str], value: str, ranked: int = RANKED) -> DataFrame:
    """The exact median per key without sorting a whole group in one task.

    Equal values are merged into counts first; then only the values around the
    middle ranks, ``ranked`` at most, are ranked.
    """
    counted = cut_lineage(
        rows.filter(F.col(value).isNotNull())
        .withColumn("_bucket", _octave(F.col(value)))
        .groupBy(*keys, "_bucket", value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    segments = middle_segments(counted, keys, value, ranked)
    inside = Window.partitionBy(*keys, "_bucket", "_lo").orderBy(value)
    through = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = _inside(counted, segments, keys, value).withColumn(
        "_through", F.col("_before") + F.sum("_n").over(through)
    )
    holds = lambda rank: F.when(
        (F.col("_through") - F.col("_n") < F.col(rank)) & (F.col(rank) <= F.col("_through")),
        F.col(value),
    )
    return found.groupBy(*keys).agg(
        ((F.max(holds("_lower")) + F.max(holds("_upper"))) / 2).alias("median")
    )


def launch_medians(timings: DataFrame) -> DataFrame:
    """First launch apart from the rest; phases differenced per run.

    Long form: (config_id, sample, phase, median). Runs without the phase
    split take part in ``total`` only.
    """
    sample = F.when(F.col("run_no") == 1, F.lit("first")).otherwise(F.lit("rest"))
    long = timings.select(
        "config_id",
        sample.alias("sample"),
        F.inline(
            F.array(
                F.struct(F.lit("total").alias("phase"), F.col("total").alias("value")),
                F.struct(F.lit("entry").alias("phase"), F.col("entry").alias("value")),
                F.struct(F.lit("ready").alias("phase"), (F.col("total") - F.col("entry")).alias("value")),
            )
        ),
    )
    return exact_medians(long, ["config_id", "sample", "phase"], "value")

