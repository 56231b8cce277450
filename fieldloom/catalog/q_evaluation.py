"""Queries that score predictions against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.catalog.views import oracle, spark_view
from fieldloom.operators import evaluation
from fieldloom.sources import labels as label_source
from fieldloom.sources import reports

# Scores per row, stated independently: plain string functions, no patterns.
SCORES_SQL = """
lab as (select doc_id, bool_or(field='seller') has_seller, max(case when field='seller' then expected end) l_seller,
  bool_or(field='gross_total') has_total, max(case when field='gross_total' then expected end) l_total,
  bool_or(expected is null) has_null from v_labels group by doc_id),
paired as (select e.*, coalesce(has_seller,false) hs, coalesce(has_total,false) ht, l_seller, l_total, coalesce(has_null,false) hn
  from v_eval e left join lab using (doc_id)),
matched as (select *,
  case when not hs then null when seller is null or l_seller is null then seller is null and l_seller is null
    else regexp_matches(lower(seller), '(^|[^0-9a-z_#])'||lower(l_seller)||'($|[^0-9a-z_])') end match_seller,
  case when not ht then null when gross_total is null or l_total is null then gross_total is null and l_total is null
    else gross_total = cast(l_total as decimal(18,2)) end match_gross_total,
  hs and l_seller is null and seller is not null inv_seller, ht and l_total is null and gross_total is not null inv_total
  from paired),
scored as (select *, concat_ws(',', case when inv_seller then 'seller' end, case when inv_total then 'gross_total' end) hallucinated,
  failed or match_seller is not null or match_gross_total is not null judged,
  failed or coalesce(not match_seller,false) or coalesce(not match_gross_total,false) needs from matched)"""


def scored(spark, sf_dir):
    return evaluation.score_predictions(
        spark_view(spark, sf_dir, "v_eval"), spark_view(spark, sf_dir, "v_labels")
    )


def report(spark, sf_dir):
    return evaluation.model_report(scored(spark, sf_dir))


def _scores(columns: str) -> str:
    return oracle(f", {SCORES_SQL} select model_id, doc_id, {columns} from scored", "v_eval", "v_labels")


@query("join2_label_scores", "JOIN-2 STR-4 STR-5 NUM-3", _scores("match_seller, match_gross_total"))
def label_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("model_id", "doc_id", "match_seller", "match_gross_total")


@query(
    "str4_phrase_match",
    "STR-4",
    oracle(
        """, texts as (select doc_id, lower(s) s, lower(split_part(s,' ',2)) p from v_doctext)
select doc_id, p<>'' and (' '||regexp_replace(s,'[^\\pL\\pN\\pM_]',' ','g')||' ') like ('% '||regexp_replace(p,'[^\\pL\\pN\\pM_]',' ','g')||' %') found
from texts where regexp_full_match(p,'[\\pL]+')""",
        "v_doctext",
    ),
)
def phrase_match(spark, sf_dir):
    from fieldloom.functions.text import contains_phrase

    texts = spark_view(spark, sf_dir, "v_doctext").selectExpr(
        "doc_id", "lower(s) s", "lower(split_part(s, ' ', 2)) p"
    )
    return texts.filter(F.col("p").rlike("^\\p{L}+\\z")).select(
        "doc_id", contains_phrase(F.col("s"), F.col("p")).alias("found")
    )


@query(
    "str5_text_equality",
    "STR-5",
    oracle(
        """, texts as (select doc_id, '  '||upper(replace(s,' ','   '))||chr(10) l, s r from v_doctext)
select doc_id, replace(lower(trim(regexp_replace(l,'\\s+',' ','g'))),'ß','ss')=replace(lower(trim(regexp_replace(r,'\\s+',' ','g'))),'ß','ss') same from texts""",
        "v_doctext",
    ),
)
def text_equality(spark, sf_dir):
    from fieldloom.functions.text import fold_for_match

    texts = spark_view(spark, sf_dir, "v_doctext").selectExpr(
        "doc_id", "'  '||upper(replace(s,' ','   '))||chr(10) l", "s r"
    )
    return texts.select("doc_id", (fold_for_match(F.col("l")) == fold_for_match(F.col("r"))).alias("same"))


@query(
    "num3_numeric_match",
    "NUM-3",
    oracle(
        """, raw as (select model_id, doc_id, cast(gross_total as varchar) l, case doc_id%4 when 0 then cast(gross_total as varchar)||'0'
   when 1 then 'n/a' when 2 then cast(gross_total+1 as varchar) else ' '||cast(gross_total as varchar) end r from v_eval)
select model_id, doc_id, case when l is null or r is null then l is null and r is null else coalesce(try_cast(l as decimal(30,4))=try_cast(trim(r) as decimal(30,4)),false) end same from raw""",
        "v_eval",
    ),
)
def numeric_match(spark, sf_dir):
    raw = spark_view(spark, sf_dir, "v_eval").selectExpr(
        "model_id",
        "doc_id",
        "cast(gross_total as string) l",
        """case doc_id%4 when 0 then cast(gross_total as string)||'0' when 1 then 'n/a'
        when 2 then cast(gross_total+1 as string) else ' '||cast(gross_total as string) end r""",
    )
    return raw.select(
        "model_id", "doc_id", evaluation.field_matches("gross_total", F.col("l"), F.col("r")).alias("same")
    )


@query("flt8_judged_flags", "FLT-8", _scores("judged, hn judged_for_hallucination, needs"))
def judged_flags(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "model_id",
        "doc_id",
        F.col("judged_for_correction").alias("judged"),
        "judged_for_hallucination",
        F.col("needs_correction").alias("needs"),
    )


@query("flt9_hallucinated_fields", "FLT-9", _scores("hallucinated"))
def hallucinated_fields(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "model_id", "doc_id", F.array_join("hallucinated_fields", ",").alias("hallucinated")
    )


_RATES = {
    "accuracy_seller": "round(avg(match_seller::int),9)",
    "accuracy_gross_total": "round(avg(match_gross_total::int),9)",
    "failure_rate": "round(coalesce(avg(failed::int),0.0),9)",
    "correction_rate": "round(avg(case when judged then needs::int end),9)",
    "hallucination_rate": "round(avg(case when hn then (hallucinated<>'')::int end),9)",
    "average_total_ms": "round(avg(case when timing_complete then total_ms end),9)",
    "average_inference_ms": "round(avg(case when timing_complete then inference_ms end),9)",
}


def _report_sql(*names: str) -> str:
    picked = ", ".join(f"{_RATES[n]} {n}" for n in names)
    return oracle(f", {SCORES_SQL} select model_id, {picked} from scored group by model_id", "v_eval", "v_labels")


def _report_query(name: str, covers: str, *columns: str):
    @query(name, covers, _report_sql(*columns))
    def run(spark, sf_dir):
        return report(spark, sf_dir).select("model_id", *[F.round(c, 9).alias(c) for c in columns])

    return run


_report_query("agg3_field_accuracy", "AGG-3", "accuracy_seller", "accuracy_gross_total")
_report_query("agg4_failure_rate", "AGG-4", "failure_rate")
_report_query("agg5_correction_rate", "AGG-5", "correction_rate")
_report_query("agg6_hallucination_rate", "AGG-6", "hallucination_rate")
_report_query("agg7_mean_latency", "AGG-7", "average_total_ms", "average_inference_ms")
_report_query("agg14_model_report", "AGG-14", *_RATES)


@query(
    "snk4_result_json",
    "SNK-4",
    oracle(
        f""", {SCORES_SQL}
select model_id, doc_id, '{{"doc_id":'||doc_id||',"field_matches":{{"invoice_date":null,"seller":'||coalesce(match_seller::varchar,'null')
 ||',"product_summary":null,"gross_total":'||coalesce(match_gross_total::varchar,'null')||',"currency":null}},"hallucinated_fields":['
 ||case when hallucinated='' then '' else '"'||replace(hallucinated,',','","')||'"' end||'],"failed":'||failed::varchar||',"needs_correction":'||needs::varchar
 ||',"timing_complete":'||timing_complete::varchar||'}}' "result" from scored""",
        "v_eval",
        "v_labels",
    ),
)
def result_json(spark, sf_dir):
    return evaluation.result_json(scored(spark, sf_dir))


@query(
    "src5_label_load",
    "SRC-5",
    oracle(
        "select doc_id, field, expected is null explicit_null, expected from v_labels",
        "v_labels",
    ),
)
def label_load(spark, sf_dir):
    files = label_source.labels_to_json(spark_view(spark, sf_dir, "v_labels"))
    loaded = label_source.explode_labels(files)
    return loaded.select(
        F.col("document").cast("bigint").alias("doc_id"),
        "field",
        F.col("expected").isNull().alias("explicit_null"),
        "expected",
    )


_UPSERT = f"""old_report as (select model_id, count(*) runs, 'old' origin from v_eval group by model_id
   union all select 'kept', 1, 'old'),
fresh as (select model_id, count(*) runs, 'new' origin from v_eval where model_id='a' group by model_id)
select model_id, runs, origin from old_report where model_id not in (select model_id from fresh)
union all select model_id, runs, origin from fresh"""


def _upsert(spark, sf_dir):
    counts = spark_view(spark, sf_dir, "v_eval").groupBy("model_id").agg(F.count(F.lit(1)).alias("runs"))
    kept = spark.range(1).select(F.lit("kept").alias("model_id"), F.lit(1).cast("bigint").alias("runs"))
    old = counts.unionByName(kept).withColumn("origin", F.lit("old"))
    fresh = counts.filter("model_id='a'").withColumn("origin", F.lit("new"))
    return evaluation.upsert_reports(old, fresh)


query("snk1_report_upsert", "SNK-1 SET-1", oracle(f", {_UPSERT}", "v_eval"))(_upsert)


@query(
    "plan5_model_evaluation",
    "PIPE-5",
    oracle(
        f""", marked as (select *, failed or doc_id%59=0 failed2, doc_id%59=0 crashed, timing_complete and doc_id%59<>0 complete2 from v_eval),
lab as (select doc_id, bool_or(field='seller') hs, max(case when field='seller' then expected end) l_seller,
  bool_or(field='gross_total') ht, max(case when field='gross_total' then expected end) l_total, bool_or(expected is null) hn from v_labels group by doc_id),
matched as (select m.*, coalesce(hn,false) hn,
  case when not coalesce(hs,false) then null when crashed then false when seller is null or l_seller is null then seller is null and l_seller is null
    else regexp_matches(lower(seller), '(^|[^0-9a-z_#])'||lower(l_seller)||'($|[^0-9a-z_])') end ms,
  case when not coalesce(ht,false) then null when crashed then false when gross_total is null or l_total is null then gross_total is null and l_total is null
    else gross_total = cast(l_total as decimal(18,2)) end mt,
  not crashed and ((coalesce(hs,false) and l_seller is null and seller is not null) or (coalesce(ht,false) and l_total is null and gross_total is not null)) invented
  from marked m left join lab using (doc_id))
select model_id, round(avg(ms::int),9) accuracy_seller, round(avg(mt::int),9) accuracy_gross_total, round(avg(failed2::int),9) failure_rate,
  round(avg(case when failed2 or ms is not null or mt is not null then (failed2 or not coalesce(ms,true) or not coalesce(mt,true))::int end),9) correction_rate,
  round(avg(case when hn then invented::int end),9) hallucination_rate,
  round(avg(case when complete2 then total_ms end),9) average_total_ms from matched group by model_id""",
        "v_eval",
        "v_labels",
    ),
)
def model_evaluation(spark, sf_dir):
    from fieldloom.plans.evaluation import evaluate_models

    crashed = F.col("doc_id") % 59 == 0
    runs = spark_view(spark, sf_dir, "v_eval").withColumn("crashed", crashed)
    measured = evaluate_models(runs, spark_view(spark, sf_dir, "v_labels"))
    names = [n for n in _RATES if n != "average_inference_ms"]
    return measured.select("model_id", *[F.round(n, 9).alias(n) for n in names])


@query(
    "snk2_incremental_results",
    "SNK-2",
    oracle(
        f", {SCORES_SQL} select model_id, doc_id, failed, needs needs_correction from scored where not timing_complete",
        "v_eval",
        "v_labels",
    ),
)
def incremental_results(spark, sf_dir):
    """The rows a resumable writer still has to append: finished ones are skipped."""
    rows = scored(spark, sf_dir)
    finished = rows.filter("timing_complete").select("model_id", "doc_id")
    return reports.unfinished(rows.select("model_id", "doc_id", "failed", "needs_correction"), finished)
