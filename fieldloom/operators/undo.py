"""Rename history: undo validation, remaining entries, paging, redo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import base_name, parent_dir
from fieldloom.operators.ordered import position
from fieldloom.session import cut_lineage


def merge_outcomes(previous: DataFrame, results: DataFrame) -> DataFrame:
    """New outcomes over old ones by request id; paths play no part."""
    columns = [c for c in previous.columns if c != "request_id"]
    fresh = results.select("request_id", F.struct(*columns).alias("_new"))
    old = previous.select("request_id", F.struct(*columns).alias("_old"))
    merged = old.join(fresh, "request_id", "full").select(
        "request_id", F.coalesce("_new", "_old").alias("_row")
    )
    return merged.select("request_id", "_row.*")


def remaining_entries(history: DataFrame) -> DataFrame:
    """Renamed entries that no later ``undone`` event has reversed."""
    keys = ["batch_id", "source_path", "destination_path"]
    undone = history.filter(F.col("event") == "undone").select(*keys)
    return history.filter(F.col("event") == "renamed").join(undone, keys, "left_anti")


def validate_entries(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``problem``: null where the entry can still be undone safely."""
    # A path listed twice is one path.
    listed = files.groupBy(F.concat_ws("/", "dir", "name").alias("_path")).agg(
        F.max("identity").alias("_identity")
    )
    at_destination = listed.select(
        F.col("_path").alias("destination_path"),
        F.col("_identity").alias("_found"),
        F.lit(True).alias("_there"),
    )
    at_source = listed.select(F.col("_path").alias("source_path"), F.lit(True).alias("_occupied"))
    joined = entries.join(at_destination, "destination_path", "left").join(
        at_source, "source_path", "left"
    )
    # The texts of the messages below are results that must come out the same.
    problem = (
        F.when(
            F.col("_there").isNull(), F.concat("destination_path", F.lit(": no longer exists"))
        )
        .when(
            ~F.col("_found").eqNullSafe(F.col("identity")),
            F.concat(
                "destination_path",
                F.lit(": a different file now exists here, cannot verify identity"),
            ),
        )
        .when(
            F.col("_occupied").isNotNull() & (F.col("source_path") != F.col("destination_path")),
            F.concat("source_path", F.lit(": another file now exists at the original name")),
        )
    )
    return joined.withColumn("problem", problem).drop("_found", "_there", "_occupied")


def undo_gate(validated: DataFrame) -> DataFrame:
    """Per batch: whether every entry may be undone, so that any may."""
    return validated.groupBy("batch_id").agg(
        F.bool_and(F.col("problem").isNull()).alias("can_undo"),
        F.count_if(F.col("problem").isNotNull()).alias("problems"),
    )


def batch_summaries(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Per undoable batch: how many entries it has and how many still hold.

    The entries themselves stay rows (``validate_entries``): a batch is not
    bounded, so it is never folded into one array.
    """
    return (
        validate_entries(entries, files)
        .groupBy("batch_id")
        .agg(
            F.max("applied_at").alias("applied_at"),
            F.count(F.lit(1)).alias("item_count"),
            F.count_if(F.col("problem").isNull()).alias("still_valid"),
        )
    )


def undo_pages(batches: DataFrame) -> DataFrame:
    """Most recent first: index and neighbours of each undoable batch.

    One row per batch takes part. The index is a running position over
    stretches of the append order, and neighbours are found by index.
    """
    keyed = batches.withColumns({"_all": F.lit(0), "_newest_first": -F.col("seq")})
    indexed = position(keyed, ["_all"], "_newest_first", "page").drop("_all", "_newest_first")
    indexed = cut_lineage(indexed)  # three readers
    ids = indexed.select("page", "batch_id")
    older = ids.select((F.col("page") - 1).alias("page"), F.col("batch_id").alias("older"))
    newer = ids.select((F.col("page") + 1).alias("page"), F.col("batch_id").alias("newer"))
    return indexed.join(older, "page", "left").join(newer, "page", "left")


def recent_batches(batches: DataFrame) -> DataFrame:
    """Reverse append order; the append sequence settles equal times."""
    return batches.orderBy(F.col("applied_at").desc(), F.col("seq").desc())


def redo_requests(undone: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The requests that re-apply what an undo reversed.

    ``undone`` has the undo's own direction: source_path is the renamed file,
    destination_path the restored one. The row that owned the renamed path
    lends its id; a path without owner becomes its own id.
    """
    owners = (
        outcomes.filter(F.col("outcome") == "renamed")
        .groupBy(F.col("destination_path").alias("source_path"))
        .agg(F.max("request_id").alias("_owner"))
    )
    return undone.join(owners, "source_path", "left").select(
        F.coalesce("_owner", "destination_path").alias("request_id"),
        F.col("destination_path").alias("source_path"),
        parent_dir(F.col("destination_path")).alias("dir"),
        base_name(F.col("source_path")).alias("desired_filename"),
    )


def redo_state(ledger: DataFrame, keys: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """Redo is open when the last operation of a workspace was an undo that
    reversed something. ``ledger``: workspace, seq, operation, n_reversed."""
    return ledger.groupBy(*keys).agg(
        F.max_by(
            F.struct("operation", "n_reversed"), F.col("seq")
        ).alias("_last")
    ).select(
        *keys,
        ((F.col("_last.operation") == "undo") & (F.col("_last.n_reversed") > 0)).alias("redo_available"),
        F.when(F.col("_last.operation") == "undo", F.col("_last.n_reversed"))
        .otherwise(F.lit(0))
        .alias("redo_count"),
    )
