"""Queries over rename requests, history, undo and redo."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.catalog.views import oracle, spark_view
from fieldloom.functions import text
from fieldloom.operators import rename, undo
from fieldloom.sources import ledger

_NAMES_SQL = """names as (select ordinal, dir||'/'||source_name path, case ordinal%9 when 0 then '' when 1 then '..' when 2 then 'a/b.pdf' when 3 then 'a\\b.pdf'
  when 4 then 'noext' when 5 then 'x.tar.gz' when 6 then '.' else desired_filename end name from v_rename)"""


def names(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_rename").selectExpr(
        "ordinal",
        "dir||'/'||source_name path",
        """case ordinal%9 when 0 then '' when 1 then '..' when 2 then 'a/b.pdf' when 3 then 'a\\\\b.pdf'
        when 4 then 'noext' when 5 then 'x.tar.gz' when 6 then '.' else desired_filename end name""",
    )


@query(
    "flt7_plain_filenames",
    "FLT-7",
    oracle(f", {_NAMES_SQL} select ordinal, name, name not in ('','.','..') and not contains(name,'/') and not contains(name,'\\') plain from names", "v_rename"),
)
def plain_filenames(spark, sf_dir):
    return names(spark, sf_dir).select(
        "ordinal", "name", text.is_plain_filename(F.col("name")).alias("plain")
    )


@query(
    "str6_stem_and_extension",
    "STR-6",
    oracle(
        f""", {_NAMES_SQL} select ordinal, case when length(name)-position('.' in reverse(name))>0 and contains(name,'.') then left(name, length(name)-position('.' in reverse(name))) else name end stem,
 case when length(name)-position('.' in reverse(name))>0 and contains(name,'.') then right(name, position('.' in reverse(name))) else '' end extension from names""",
        "v_rename",
    ),
)
def stem_and_extension(spark, sf_dir):
    stem, extension = text.split_name(F.col("name"))
    return names(spark, sf_dir).select("ordinal", stem.alias("stem"), extension.alias("extension"))


@query(
    "str7_parent_and_base",
    "STR-7",
    oracle(
        f", {_NAMES_SQL} select ordinal, left(path, length(path)-position('/' in reverse(path))) dir, right(path, position('/' in reverse(path))-1) base from names",
        "v_rename",
    ),
)
def parent_and_base(spark, sf_dir):
    path = F.col("path")
    return names(spark, sf_dir).select(
        "ordinal", text.parent_dir(path).alias("dir"), text.base_name(path).alias("base")
    )


def requests(spark, sf_dir, view="v_rename"):
    return spark_view(spark, sf_dir, view).drop("on_disk")


def files(spark, sf_dir, view="v_rename_files"):
    return spark_view(spark, sf_dir, view)


@query(
    "join4_occupied_names",
    "JOIN-4",
    oracle(
        """select ordinal, desired_filename, f.name is not null and desired_filename<>source_name taken
from v_rename r left join (select distinct dir, name from v_rename_files) f on r.dir=f.dir and r.desired_filename=f.name""",
        "v_rename",
        "v_rename_files",
    ),
)
def occupied_names(spark, sf_dir):
    marked = rename.occupied_elsewhere(requests(spark, sf_dir), files(spark, sf_dir))
    return marked.select("ordinal", "desired_filename", "taken")


def planted_sources(listing):
    """The listing with a few sources missing or turned into folders."""
    number = F.regexp_extract("name", "^s([0-9]+)\\.pdf$", 1).try_cast("bigint")
    kept = listing.filter(~F.coalesce(number % 3001 == 1, F.lit(False)))
    return kept.withColumn("is_file", ~F.coalesce(number % 4999 == 2, F.lit(False)))


@query(
    "join5_preflight",
    "JOIN-5",
    oracle(
        """, judged as (select batch_id, ordinal, case when ordinal%6007=3 then dir||'/'||source_name||': invalid destination filename'
   when ordinal%3001=1 then dir||'/'||source_name||': no longer exists' when ordinal%4999=2 then dir||'/'||source_name||': not a file' end problem from v_rename)
select batch_id, ordinal, problem, bool_and(problem is null) over (partition by batch_id) batch_ok from judged""",
        "v_rename",
    ),
)
def preflight(spark, sf_dir):
    asked = requests(spark, sf_dir).withColumn(
        "desired_filename",
        F.when(F.col("ordinal") % 6007 == 3, F.lit("..")).otherwise(F.col("desired_filename")),
    )
    judged = rename.preflight(asked, planted_sources(files(spark, sf_dir)))
    return judged.select("batch_id", "ordinal", "problem", "batch_ok")


# Numbers free for a family, spelled out one by one; families do not interact here.
PLAN_SQL = """
members as (select *, row_number() over (partition by batch_id, dir, desired_filename order by ordinal) k from v_rename),
sizes as (select batch_id, dir, desired_filename, count(*) n from v_rename group by all),
listing as (select distinct dir, name from v_rename_files),
candidates as (select batch_id, dir, desired_filename, number, case when number=0 then desired_filename
    when desired_filename='.hidden' then '.hidden ('||number||')' else replace(desired_filename,'.pdf',' ('||number||').pdf') end name
  from (select batch_id, dir, desired_filename, unnest(range(0, n+20)) number from sizes)),
free as (select c.*, row_number() over (partition by c.batch_id, c.dir, c.desired_filename order by c.number) k
  from candidates c left join listing l on c.dir=l.dir and c.name=l.name where l.name is null),
planned as (select m.*, f.number, f.name destination_name from members m join free f
  on m.batch_id=f.batch_id and m.dir=f.dir and m.desired_filename=f.desired_filename and m.k=f.k)"""


@query(
    "trans1_destinations",
    "TRANS-1",
    oracle(f", {PLAN_SQL} select batch_id, ordinal, number, destination_name from planned", "v_rename", "v_rename_files"),
)
def destinations(spark, sf_dir):
    planned = rename.plan_destinations(requests(spark, sf_dir), files(spark, sf_dir))
    return planned.select("batch_id", "ordinal", "number", "destination_name")


# The claims of every folder and batch replayed one request at a time.
CLASH_SQL = oracle(
    """, listing as (select dir, list(distinct name) on_disk_names from v_clash_files group by dir),
queue as (select r.*, on_disk_names, row_number() over (partition by batch_id, r.dir order by ordinal) n
  from v_clash r join listing l on r.dir=l.dir),
step as (
  select batch_id, dir, cast(0 as bigint) n, cast(null as bigint) ordinal, cast(null as varchar) destination_name, cast([] as varchar[]) claimed
  from (select distinct batch_id, dir from v_clash)
  union all
  select q.batch_id, q.dir, q.n, q.ordinal, pick.name, list_append(s.claimed, pick.name)
  from step s join queue q on q.batch_id=s.batch_id and q.dir=s.dir and q.n=s.n+1,
  lateral (select list_filter(
      list_transform(range(0, len(s.claimed)+len(q.on_disk_names)+1), lambda i: case when i=0 then q.desired_filename
        else replace(q.desired_filename,'.pdf',' ('||i||').pdf') end),
      lambda c: not list_contains(s.claimed, c) and (c=q.source_name or not list_contains(q.on_disk_names, c)))[1] as name) pick)
select batch_id, ordinal, destination_name from step where n>0""",
    "v_clash",
    "v_clash_files",
).replace("with ", "with recursive ", 1)


@query("trans1_clashing_names", "TRANS-1", CLASH_SQL)
def clashing_names(spark, sf_dir):
    planned = rename.plan_destinations(
        requests(spark, sf_dir, "v_clash"), files(spark, sf_dir, "v_clash_files")
    )
    return planned.select("batch_id", "ordinal", "destination_name")


# Requests one at a time: ``used`` lists how many free numbers are used up before each.
NUMBERED_SQL = oracle(
    """, own_below as (select *, own - row_number() over (partition by dir order by own) + 1 free_below from v_numbered),
queues as (select dir, list(free_below order by ordinal) fs, list(ordinal order by ordinal) ordinals, list(own order by ordinal) owns
  from own_below group by dir),
replayed as (select dir, fs, ordinals, owns, list_reduce(list_transform(fs, lambda f: [f]),
    lambda used, f: list_append(used, used[-1] + case when used[-1] < f[1] then 1 else 0 end), [cast(0 as bigint)]) used from queues),
step as (select dir, unnest(ordinals) ordinal, unnest(owns) own, unnest(list_transform(fs, lambda f, i: used[i] >= f)) kept from replayed),
free as (select dir, number, row_number() over (partition by dir order by number) k
  from (select dir, unnest(range(0, max(own)+count(*)+1)) number from v_numbered group by dir) c
  anti join v_numbered v on c.dir=v.dir and c.number=v.own),
waiting as (select dir, ordinal, row_number() over (partition by dir order by ordinal) k from step where not kept)
select ordinal, 'n ('||own||').pdf' destination_name from step where kept
union all
select ordinal, case when number=0 then 'n.pdf' else 'n ('||number||').pdf' end from waiting join free using (dir, k)""",
    "v_numbered",
)


@query("trans1_numbered_folders", "TRANS-1", NUMBERED_SQL)
def numbered_folders(spark, sf_dir):
    asked = spark_view(spark, sf_dir, "v_numbered").drop("own")
    listing = asked.select("dir", F.col("source_name").alias("name"))
    return rename.plan_destinations(asked, listing).select("ordinal", "destination_name")


def plan(spark, sf_dir):
    listing = files(spark, sf_dir).withColumn("is_file", F.lit(True))
    return rename.rename_plan(requests(spark, sf_dir), listing)


@query(
    "snk5_rename_plan",
    "SNK-5",
    oracle(
        f", {PLAN_SQL} select batch_id, request_id, dir||'/'||source_name source_path, dir||'/'||destination_name destination_path from planned",
        "v_rename",
        "v_rename_files",
    ),
)
def rename_plan(spark, sf_dir):
    return plan(spark, sf_dir)


def results(spark, sf_dir):
    return requests(spark, sf_dir).selectExpr(
        "request_id",
        "case when ordinal%13=0 then 'permission denied' end error",
        "case when ordinal%17<>0 then 'i'||cast(ordinal as string) end identity",
    ).filter("request_id not like '%99'")


_RESULTS_SQL = f"""{PLAN_SQL},
reported as (select *, request_id not like '%99' seen, ordinal%13=0 refused, ordinal%17<>0 identified from planned),
told as (select *, seen and not refused moved from reported)"""


@query(
    "trans2_rename_ledger",
    "TRANS-2",
    oracle(
        f""", {_RESULTS_SQL} select request_id, dir||'/'||destination_name destination_path, case when moved then 'renamed' else 'failed' end outcome,
 case when not seen then 'no result reported' when refused then 'permission denied' end message, moved and not identified untracked from told""",
        "v_rename",
        "v_rename_files",
    ),
)
def rename_ledger(spark, sf_dir):
    told = rename.rename_outcomes(plan(spark, sf_dir), results(spark, sf_dir))
    return told.select("request_id", "destination_path", "outcome", "message", "untracked")


@query(
    "trans2_batch_outcomes",
    "TRANS-2",
    oracle(
        f""", {_RESULTS_SQL} select batch_id, count(*) filter (where moved) renamed, count(*) filter (where not moved) failed,
 bool_or(moved and identified) undoable, count(*) filter (where moved and not identified)||' file(s) were renamed but could not be tracked for Undo' history_warning
from told group by 1""",
        "v_rename",
        "v_rename_files",
    ),
)
def batch_outcomes(spark, sf_dir):
    told = rename.rename_outcomes(plan(spark, sf_dir), results(spark, sf_dir))
    return rename.batch_outcomes(told).drop("untracked")


# ---- outcomes, history, undo ------------------------------------------------


@query(
    "join6_merged_outcomes",
    "JOIN-6",
    oracle(
        """, old_rows as (select request_id, 'failed' outcome, 'old'||ordinal message from v_rename),
new_rows as (select request_id, 'renamed' outcome, 'new'||ordinal message from v_rename where on_disk)
select request_id, coalesce(n.outcome, o.outcome) outcome, coalesce(n.message, o.message) message from old_rows o full join new_rows n using (request_id)""",
        "v_rename",
    ),
)
def merged_outcomes(spark, sf_dir):
    view = spark_view(spark, sf_dir, "v_rename")
    # All requests have failed once; those whose file is there were tried again.
    old = view.selectExpr("request_id", "'failed' outcome", "'old'||ordinal message")
    new = view.filter("on_disk").selectExpr("request_id", "'renamed' outcome", "'new'||ordinal message")
    return undo.merge_outcomes(old, new)


def history(spark, sf_dir):
    view = spark_view(spark, sf_dir, "v_history").selectExpr(
        "batch_id", "seq", "applied_at", "dir||'/'||source_name source_path",
        "dir||'/'||destination_name destination_path", "identity", "undone",
    )
    done = view.drop("undone").withColumn("event", F.lit("renamed"))
    reversed_rows = view.filter("undone").drop("undone").withColumn("event", F.lit("undone"))
    return ledger.append_events(done, reversed_rows)


_LEFT_SQL = "entries as (select *, dir||'/'||source_name source_path, dir||'/'||destination_name destination_path from v_history where not undone)"
_VALID_SQL = f"""{_LEFT_SQL},
validated as (select *, case when ordinal%101=0 then destination_path||': no longer exists'
  when ordinal%103=0 then destination_path||': a different file now exists here, cannot verify identity'
  when ordinal%107=0 then source_path||': another file now exists at the original name' end problem from entries)"""


@query(
    "snk3_remaining_entries",
    "SNK-3",
    oracle(f", {_LEFT_SQL} select batch_id, source_path, destination_path from entries", "v_history"),
)
def remaining_entries(spark, sf_dir):
    return undo.remaining_entries(history(spark, sf_dir)).select(
        "batch_id", "source_path", "destination_path"
    )


def validated(spark, sf_dir):
    left = undo.remaining_entries(history(spark, sf_dir))
    return undo.validate_entries(left, spark_view(spark, sf_dir, "v_history_files"))


@query(
    "join7_undo_validation",
    "JOIN-7",
    oracle(f", {_VALID_SQL} select batch_id, source_path, problem from validated", "v_history"),
)
def undo_validation(spark, sf_dir):
    return validated(spark, sf_dir).select("batch_id", "source_path", "problem")


@query(
    "join7_undo_gate",
    "JOIN-7",
    oracle(f", {_VALID_SQL} select batch_id, bool_and(problem is null) can_undo, count(problem) problems from validated group by 1", "v_history"),
)
def undo_gate(spark, sf_dir):
    return undo.undo_gate(validated(spark, sf_dir))


@query(
    "agg12_undoable_batches",
    "AGG-12",
    oracle(
        f", {_VALID_SQL} select batch_id, strftime(max(applied_at),'%Y-%m-%d') applied_on, count(*) item_count, count(*) filter (where problem is null) still_valid from validated group by 1",
        "v_history",
    ),
)
def undoable_batches(spark, sf_dir):
    left = undo.remaining_entries(history(spark, sf_dir))
    summaries = undo.batch_summaries(left, spark_view(spark, sf_dir, "v_history_files"))
    return summaries.select(
        "batch_id", F.date_format("applied_at", "yyyy-MM-dd").alias("applied_on"), "item_count", "still_valid"
    )


def batches(spark, sf_dir):
    left = undo.remaining_entries(history(spark, sf_dir))
    return left.groupBy("batch_id").agg(F.max("seq").alias("seq"), F.max("applied_at").alias("applied_at"))


@query(
    "win5_undo_pages",
    "WIN-5",
    oracle(
        f""", {_LEFT_SQL}, b as (select batch_id, max(seq) seq from entries group by 1)
select batch_id, row_number() over (order by seq desc)-1 page, lead(batch_id) over (order by seq desc) older, lag(batch_id) over (order by seq desc) newer from b""",
        "v_history",
    ),
)
def undo_pages(spark, sf_dir):
    return undo.undo_pages(batches(spark, sf_dir)).select("batch_id", "page", "older", "newer")


@query(
    "sort1_recent_batches",
    "SORT-1",
    oracle(
        f", {_LEFT_SQL}, b as (select batch_id, max(seq) seq, max(applied_at) applied_at from entries group by 1) select batch_id, seq from b order by applied_at desc, seq desc",
        "v_history",
    ),
)
def recent_batches(spark, sf_dir):
    return undo.recent_batches(batches(spark, sf_dir)).select("batch_id", "seq")


@query(
    "join8_redo_requests",
    "JOIN-8",
    oracle(
        """select case when not undone_failed then 'r'||ordinal else dir||'/'||source_name end request_id, dir||'/'||source_name source_path, dir, destination_name desired_filename
from (select *, ordinal%7=0 undone_failed from v_history) where undone""",
        "v_history",
    ),
)
def redo_requests(spark, sf_dir):
    view = spark_view(spark, sf_dir, "v_history")
    undone = view.filter("undone").selectExpr(
        "dir||'/'||destination_name source_path", "dir||'/'||source_name destination_path"
    )
    # Outcomes of all requests; a failed one has no destination.
    outcomes = view.selectExpr(
        "'r'||ordinal request_id",
        "if(ordinal%7=0, 'failed', 'renamed') outcome",
        "if(ordinal%7=0, null, dir||'/'||destination_name) destination_path",
    )
    return undo.redo_requests(undone, outcomes)


@query(
    "st9_redo_state",
    "ST-9",
    oracle(
        """, ops as (select seq batch_seq, ordinal, case when ordinal%4=0 then 'undo' else 'rename' end operation, ordinal%6 n_reversed from v_history)
select batch_seq workspace_id, arg_max(operation, ordinal)='undo' and arg_max(n_reversed, ordinal)>0 redo_available,
  case when arg_max(operation, ordinal)='undo' then arg_max(n_reversed, ordinal) else 0 end redo_count from ops group by 1""",
        "v_history",
    ),
)
def redo_state(spark, sf_dir):
    operations = spark_view(spark, sf_dir, "v_history").selectExpr(
        "seq workspace_id",
        "ordinal seq",
        "case when ordinal%4=0 then 'undo' else 'rename' end operation",
        "ordinal%6 n_reversed",
    )
    return undo.redo_state(operations)
