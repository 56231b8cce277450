"""Run a registered query on Spark and its oracle on DuckDB, and compare."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

# Types both engines hand over the same way; queries return nothing else.
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


SMALL_SF_DIR = "/root/testdata/sf0.001"


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        table = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {table} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(frame, con, sql) -> list[str]:
    """Differences between the Spark frame and the oracle, empty when equal."""
    names = frame.columns
    mine = _rows(names, frame.collect())
    described = con.execute("describe " + sql).fetchall()
    types = {r[0]: r[1] for r in described}
    problems = []
    if sorted(names) != sorted(types):
        return [f"columns {sorted(names)} vs {sorted(types)}"]
    for name, spark_type in frame.dtypes:
        if SAME_TYPE.get(spark_type) != types[name]:
            problems.append(f"type of {name}: {spark_type} vs {types[name]}")
    theirs = _rows([r[0] for r in described], con.execute(sql).fetchall())
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} vs {len(theirs)}")
    if mine != theirs:
        left, right = set(mine) - set(theirs), set(theirs) - set(mine)
        problems.append(f"{len(left)}/{len(right)} rows differ (columns {sorted(names)})")
        problems += [f"  spark  {r}" for r in sorted(left, key=str)[:4]]
        problems += [f"  oracle {r}" for r in sorted(right, key=str)[:4]]
    return problems


def main() -> None:
    from fieldloom.catalog.registry import QUERIES
    import importlib

    from fieldloom.session import local_session

    sf, picks = sys.argv[1], sys.argv[2:]
    modules = [p for p in picks if p.startswith("q_")]
    picks = [p for p in picks if not p.startswith("q_")]
    if modules:
        for module in modules:
            importlib.import_module(f"fieldloom.catalog.{module}")
    else:
        from fieldloom.catalog.registry import load

        load()
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    failed = []
    for name, query in QUERIES.items():
        if modules and query.module not in modules:
            continue
        if picks and not any(p in name for p in picks):
            continue
        start = time.time()
        try:
            frame = query.run(spark, sf_dir)
            if query.sql is None:
                problems, note = [], f"rows only: {frame.count()}"
            else:
                problems, note = compare(frame, con, query.sql), ""
        except Exception as error:  # noqa: BLE001 - report and go on
            problems, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
        for line in problems:
            print("     ", line)
        if problems:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
