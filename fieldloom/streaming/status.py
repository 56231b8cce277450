"""Continuously updated views of hosts and of undo/redo.

Both are plain aggregates, so the batch operators serve as they are; they are
re-exported here as the streaming surface (update mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldloom.operators.fleet import latest_memory
from fieldloom.operators.undo import redo_state


def memory_stream(samples: DataFrame) -> DataFrame:
    """The last good sample per host with its staleness and severity."""
    return latest_memory(samples)


def redo_stream(ledger: DataFrame) -> DataFrame:
    """Whether the last operation of each workspace can be redone."""
    return redo_state(ledger)
