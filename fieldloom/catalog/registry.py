"""Named queries: a Spark function, the inventory rows it covers, an SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldloom.session import apply_settings

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    covers: tuple[str, ...]
    sql: str | None
    module: str


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register ``name``; ``covers`` lists inventory ids, space separated."""

    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(apply_settings(spark), sf_dir)

        QUERIES[name] = Query(
            with_settings, tuple(covers.split()), sql, run.__module__.rsplit(".", 1)[-1]
        )
        return run

    return register


def load() -> dict[str, Query]:
    """Import every query module once and return the registry."""
    from fieldloom.catalog import (  # noqa: F401
        q_evaluation,
        q_jobs,
        q_naming,
        q_pages,
        q_plans,
        q_rename,
        q_responses,
        q_review,
        q_sources,
        q_xml,
    )

    return QUERIES
