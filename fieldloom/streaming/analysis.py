"""The whole analysis on streams: documents, attachments and calls arrive in any order.

Per document a stateful operator keeps what has arrived: the names and distinct
contents of its attachments (checked and mapped before the shuffle, so no bytes
are kept), and one call of each attempt. Whenever that changes it emits the
gathered document with a version number, and the rest is the projection that
the batch analysis ends in. So a repair is a step of the state, not a stage:
the same document comes out as ``awaiting`` and, after the next call, ``done``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import attachments as attachment_ops
from fieldloom.operators import responses
from fieldloom.plans.analysis import PHASES, conclude

_FLAT = (
    "doc_id {key}, version long, extension string, shorten boolean, n_names long, max_revisions long, "
    "crowded_seen long, crowded_name string, crowded_revisions long, n_contents long, facts string, content_names string"
)


def _events(documents: DataFrame, attachments: DataFrame, calls: DataFrame, order: str) -> tuple[DataFrame, object]:
    """All arrivals in one stream of narrow rows, and the type of the facts, which travel as JSON."""
    known = attachment_ops.known_attachments(attachments)
    facts = attachment_ops.attachment_facts(attachments, order)
    carried = F.struct(*[c for c in facts.columns if c not in ("doc_id", "content_hash")])
    told = facts.select("doc_id", "content_hash", "attachment_name", F.col(order).cast("long").alias("at"), carried.alias("facts"))
    kind = told.schema["facts"].dataType
    parts = [
        documents.select("doc_id", F.lit("document").alias("kind"), "extension", "shorten"),
        known.select("doc_id", F.lit("name").alias("kind"), "attachment_name", F.col(order).cast("long").alias("at")),
        told.select("doc_id", F.lit("content").alias("kind"), "attachment_name", "at", "content_hash", F.to_json("facts").alias("facts")),
        responses.usable_completions(calls).select(
            "doc_id", F.lit("call").alias("kind"), "phase", F.col("attempt").cast("long").alias("attempt"), "response", "error"
        ),
    ]
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part, allowMissingColumns=True)
    return events, kind


def _least(held: list | None, new: list) -> list:
    return new if held is None or new < held else held


def _better_call(held: list | None, new: list) -> list:
    """Of two calls of one attempt the one with a response, then the larger texts, as in batch."""
    weigh = lambda c: (c[0] is not None, c[0] or "", c[1] is not None, c[1] or "")
    return new if held is None or weigh(new) > weigh(held) else held


def take(state: dict, row) -> None:
    """Puts one arrival into the state of its document."""
    if row.kind == "document":
        new = [row.extension, None if row.shorten is None else bool(row.shorten)]
        state["document"] = new
    elif row.kind == "name":
        count, seen = state["names"].get(row.attachment_name, (0, row.at))
        state["names"][row.attachment_name] = (count + 1, min(seen, row.at))
    elif row.kind == "content":
        new = [int(row.at), row.attachment_name, row.facts]
        state["contents"][row.content_hash] = _least(state["contents"].get(row.content_hash), new)
    else:
        attempt = f"{row.phase}/{int(row.attempt)}" if row.attempt == row.attempt and row.attempt is not None else "none/-1"
        call, n = state["calls"].get(attempt, (None, 0))
        state["calls"][attempt] = (_better_call(call, [row.response, row.error]), n + 1)


def gathered_row(state: dict, repairs: dict[str, int]) -> dict:
    """The state as the flat columns of a gathered document."""
    names, contents, calls = state["names"], state["contents"], state["calls"]
    most = attachment_ops.MAX_REVISIONS
    crowded = min(([seen, name, n] for name, (n, seen) in names.items() if n > most), default=[0, None, 0])
    first = min(contents.values(), default=[0, None, None])
    row = {
        "extension": state["document"][0], "shorten": state["document"][1], "n_names": len(names),
        "max_revisions": max((n for n, _ in names.values()), default=0), "crowded_seen": crowded[0],
        "crowded_name": crowded[1], "crowded_revisions": crowded[2], "n_contents": len(contents), "facts": first[2],
        "content_names": ", ".join(sorted({c[1] for c in contents.values()})) if contents else None,
    }
    used = {}
    for phase, prefix in PHASES.items():
        for k in range(repairs[phase] + 1):
            (response, error), n = calls.get(f"{phase}/{k}", ((None, None), 0))
            row[f"{prefix}response_{k}"], row[f"{prefix}error_{k}"] = response, error
            used[f"{phase}/{k}"] = n
    row["calls_ignored"] = sum(n for key, (_, n) in calls.items() if key not in used)
    row["calls_repeated"] = sum(max(n - 1, 0) for n in used.values())
    return row


def gathered_stream(
    documents: DataFrame,
    attachments: DataFrame,
    calls: DataFrame,
    max_repairs: int = 1,
    short_repairs: int = 1,
    order: str = "revision_no",
    kept_hours: float | None = None,
) -> DataFrame:
    """Gathered documents (``plans.analysis.gather``) with a ``version``, one row per trigger that changed them.

    A document comes out once it has itself arrived; attachments and calls may
    come before it. A second arrival of a document replaces the first.

    With ``kept_hours`` the state of a document not touched for so long is
    removed; that goes by the clock, and a query of that kind runs until it is
    stopped. Without it state stays, and the query ends when its input does.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    events, facts_type = _events(documents, attachments, calls, order)
    repairs = {"extraction": max_repairs, "shortening": short_repairs}
    flat = _FLAT.format(key=events.schema["doc_id"].dataType.simpleString())
    cells = [
        f"{prefix}{name}_{k}"
        for phase, prefix in PHASES.items() for k in range(repairs[phase] + 1) for name in ("response", "error")
    ]
    schema = flat + "".join(f", {c} string" for c in cells) + ", calls_ignored long, calls_repeated long"

    class Gather(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            ends = {} if kept_hours is None else {"ttlDurationMs": int(kept_hours * 3_600_000)}
            self.doc = handle.getValueState("doc", "held string", **ends)

        def handleInputRows(self, key, rows, timerValues):
            if self.doc.exists():
                state = json.loads(self.doc.get()[0])
            else:
                state = {"version": 0, "document": None, "names": {}, "contents": {}, "calls": {}}
            for chunk in rows:
                for row in chunk.astype(object).where(chunk.notna(), None).itertuples(index=False):
                    take(state, row)
            out = state["document"] is not None
            state["version"] += out
            self.doc.update((json.dumps(state),))
            if out:
                yield pd.DataFrame([{"doc_id": key[0], "version": state["version"]} | gathered_row(state, repairs)])

        def close(self) -> None:
            pass

    rows = events.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=Gather(),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None" if kept_hours is None else "ProcessingTime",
    )
    crowded = F.struct(
        F.col("crowded_seen").alias("seen"), F.col("crowded_name").alias("attachment_name"), F.col("crowded_revisions").alias("revisions")
    )
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    return rows.withColumns(
        {
            "n_names": some("n_names"),
            "n_contents": some("n_contents"),
            "crowded": F.when(F.col("crowded_name").isNotNull(), crowded),
            "facts": F.from_json("facts", facts_type),
        }
    ).drop("crowded_seen", "crowded_name", "crowded_revisions")


def analysis_stream(
    documents: DataFrame,
    attachments: DataFrame,
    calls: DataFrame,
    max_repairs: int = 1,
    short_repairs: int = 1,
    kept_hours: float | None = None,
) -> DataFrame:
    """Versions of the proposals that ``plans.analysis.analyse`` gives; the newest of a document counts."""
    gathered = gathered_stream(documents, attachments, calls, max_repairs, short_repairs, kept_hours=kept_hours)
    return conclude(gathered, max_repairs, short_repairs, kept=("version",))


def newest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each document, from a table of all of them."""
    columns = [c for c in versions.columns if c != "version"]
    newest = versions.groupBy("doc_id").agg(F.max_by(F.struct(*columns), "version").alias("row"))
    return newest.select("row.*")
