"""Queries over model responses: parsing, salvage, repair and shortening."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.catalog.q_naming import _CODES_SQL
from fieldloom.catalog.registry import query
from fieldloom.catalog.views import oracle, spark_view
from fieldloom.functions import text, values
from fieldloom.operators import responses


def first_answers(spark, sf_dir):
    return responses.parse_responses(spark_view(spark, sf_dir, "v_calls"), "response")


def fence_sql(column: str) -> str:
    whole = f"trim({column}, ' '||chr(9)||chr(10)||chr(13))"
    inside = f"regexp_replace(substr({whole}, 4, length({whole})-6), '^[A-Za-z]*', '')"
    inside = f"ltrim({inside}, ' '||chr(9)||chr(10)||chr(13))"
    fenced = f"starts_with({whole}, '```') and ends_with({whole}, '```') and length({whole})>=6"
    return f"case when {fenced} then case when ends_with({inside}, chr(10)) then {inside}[:-2] else {inside} end else {column} end"


def answers_sql(source: str, name: str = "answers") -> str:
    """CTEs ending in ``name``: verdict, fault, values and rejections per row of ``source``."""
    return f"""
{name}_body as (select *, {fence_sql('response')} body from {source}),
{name}_json as (select *, case when json_valid(body) then case when json_type(body)='OBJECT' then body end end j,
   case when response is null then null when not json_valid(body) then 'response is not valid JSON'
        when json_type(body)<>'OBJECT' then 'response is not a JSON object' end json_fault from {name}_body),
{name}_typed as (select *,
   json_type(j,'$.invoice_date') k_date, json_extract_string(j,'$.invoice_date') t_date,
   json_type(j,'$.seller') k_seller, json_extract_string(j,'$.seller') t_seller,
   json_type(j,'$.product_summary') k_product, json_extract_string(j,'$.product_summary') t_product,
   json_type(j,'$.gross_total') k_total, json_extract_string(j,'$.gross_total') t_total,
   json_type(j,'$.currency') k_cur, json_extract_string(j,'$.currency') t_cur,
   json_type(j,'$.language') k_lang, json_extract_string(j,'$.language') t_lang from {name}_json),
{name}_valued as (select *,
   case when k_date='VARCHAR' and regexp_full_match(t_date,'[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(t_date as date) end v_date,
   case when k_seller='VARCHAR' then t_seller end v_seller,
   case when k_product='VARCHAR' then t_product end v_product,
   case when k_total in ('VARCHAR','BIGINT','UBIGINT','DOUBLE') then try_cast(t_total as decimal(18,2)) end n_total,
   case when k_cur='VARCHAR' and t_cur in {_CODES_SQL} then t_cur end v_cur,
   case when k_lang='VARCHAR' and t_lang in ('de','en','unknown') then t_lang end v_lang from {name}_typed),
{name}_checked as (select *, case when n_total>=0 then n_total end v_total,
   case when k_date<>'NULL' and v_date is null then 'must be a date written as YYYY-MM-DD' end e_date,
   case when k_seller not in ('NULL','VARCHAR') then 'must be a string' end e_seller,
   case when k_product not in ('NULL','VARCHAR') then 'must be a string' end e_product,
   case when k_total<>'NULL' and (n_total is null or n_total<0) then
      case when n_total<0 then 'a total below zero is not accepted' else 'must be a decimal number' end end e_total,
   case when k_cur<>'NULL' and v_cur is null then case when k_cur<>'VARCHAR' then 'must be a string'
      when not regexp_full_match(t_cur,'[A-Z]{{3}}') then 'three capital letters of a currency are expected'
      else ''''||t_cur||''' names no currency in use' end end e_cur,
   case when k_lang is not null and v_lang is null then 'must be ''de'', ''en'' or ''unknown''' end e_lang
   from {name}_valued),
{name}_listed as (select *,
   concat_ws('; ', 'invoice_date: '||e_date, 'seller: '||e_seller, 'product_summary: '||e_product,
     'gross_total: '||e_total, 'currency: '||e_cur, 'language: '||e_lang) rejected,
   (v_date is not null)::int + (coalesce(trim(v_seller),'')<>'')::int + (coalesce(trim(v_product),'')<>'')::int
     + (v_total is not null)::int + (v_cur is not null)::int usable from {name}_checked),
{name} as (select *,
   case when response is null then null when json_fault is not null then 'failed' when rejected='' then 'ok'
        when usable>0 then 'salvaged' else 'failed' end verdict,
   case when json_fault is not null then json_fault when rejected<>'' and usable=0 then 'no usable field: '||rejected end fault
   from {name}_listed)"""


@query(
    "str10_fence_strip",
    "STR-10",
    oracle(f"select doc_id, {fence_sql('response')} body from v_calls", "v_calls"),
)
def fence_strip(spark, sf_dir):
    calls = spark_view(spark, sf_dir, "v_calls")
    return calls.select("doc_id", text.strip_fence(F.col("response")).alias("body"))


@query(
    "json1_response_parse",
    "JSON-1",
    oracle(f", {answers_sql('v_calls')} select doc_id, j is not null parsed, json_fault fault from answers", "v_calls"),
)
def response_parse(spark, sf_dir):
    parsed = responses.parse_object(spark_view(spark, sf_dir, "v_calls"), "response", "v")
    return parsed.select("doc_id", F.col("v").isNotNull().alias("parsed"), F.col("v_fault").alias("fault"))


def _listed(answer: str = "answer"):
    return F.array_join(
        F.transform(f"{answer}.rejected", lambda r: F.concat_ws(": ", r["field"], r["message"])), "; "
    )


@query(
    "json2_typed_fields",
    "JSON-2 DATE-3",
    oracle(
        f""", {answers_sql('v_calls')}
select doc_id, strftime(v_date,'%Y-%m-%d') invoice_date, v_seller seller, cast(v_total as double) gross_total,
  v_cur currency, v_lang lang, rejected from answers""",
        "v_calls",
    ),
)
def typed_fields(spark, sf_dir):
    return first_answers(spark, sf_dir).select(
        "doc_id",
        F.col("answer.invoice_date").cast("string").alias("invoice_date"),
        F.col("answer.seller").alias("seller"),
        F.col("answer.gross_total").cast("double").alias("gross_total"),
        F.col("answer.currency").alias("currency"),
        F.col("answer.language").alias("lang"),
        _listed().alias("rejected"),
    )


@query(
    "json3_salvage",
    "JSON-3",
    oracle(
        f""", {answers_sql('v_calls')}
select doc_id, verdict, cast(usable as integer) usable, fault,
  case when verdict='salvaged' then rejected else '' end salvage_warnings from answers""",
        "v_calls",
    ),
)
def salvage(spark, sf_dir):
    return first_answers(spark, sf_dir).select(
        "doc_id",
        F.col("answer.verdict").alias("verdict"),
        F.col("answer.usable").alias("usable"),
        F.col("answer.fault").alias("fault"),
        F.when(F.col("answer.verdict") == "salvaged", F.array_join("answer.warnings", "; "))
        .otherwise("")
        .alias("salvage_warnings"),
    )


def both_attempts(spark, sf_dir):
    first = spark_view(spark, sf_dir, "v_calls").withColumn("error", F.lit(None).cast("string"))
    second = spark_view(spark, sf_dir, "v_repairs")
    columns = ["doc_id", "phase", "attempt", "response", "error"]
    return first.select(*columns).unionByName(second.select(*columns))


_BOTH = """both_attempts as (select doc_id, attempt, response, cast(null as varchar) error from v_calls
  union all select doc_id, attempt, response, error from v_repairs)"""


@query(
    "win3_best_salvage",
    "WIN-3",
    oracle(
        f""", {_BOTH}, {answers_sql('both_attempts')}
select doc_id, cast(attempt as bigint) attempt, cast(usable as integer) usable from (
  select *, row_number() over (partition by doc_id order by usable desc, attempt) rank from answers where verdict='salvaged')
where rank=1""",
        "v_calls",
        "v_repairs",
    ),
)
def best_salvage(spark, sf_dir):
    # Placed by document before they are parsed: parsing costs far more than reading,
    # and a small file has few splits.
    calls = both_attempts(spark, sf_dir).repartition("doc_id")
    answers = responses.parse_responses(calls, "response")
    return responses.best_salvage(answers).select(
        "doc_id",
        F.col("attempt").cast("bigint").alias("attempt"),
        F.col("answer.usable").alias("usable"),
    )


_LONG_REJECTED = """(
  select doc_id, 'invoice_date' field, e_date message from answers union all select doc_id, 'seller', e_seller from answers
  union all select doc_id, 'product_summary', e_product from answers union all select doc_id, 'gross_total', e_total from answers
  union all select doc_id, 'currency', e_cur from answers union all select doc_id, 'language', e_lang from answers)"""


@query(
    "agg16_rejected_fields",
    "AGG-16",
    oracle(f", {answers_sql('v_calls')} select doc_id, field, message from {_LONG_REJECTED} where message is not null", "v_calls"),
)
def rejected_fields(spark, sf_dir):
    return responses.rejected_fields(first_answers(spark, sf_dir)).select("doc_id", "field", "message")


@query(
    "set2_fields_to_ask",
    "SET-2",
    oracle(
        f""", {answers_sql('v_calls')}, refused as (select * from {_LONG_REJECTED} where message is not null),
nulls as (select doc_id, 'invoice_date' field from answers where v_date is null
  union all select doc_id, 'seller' from answers where coalesce(trim(v_seller),'')=''
  union all select doc_id, 'product_summary' from answers where coalesce(trim(v_product),'')=''
  union all select doc_id, 'gross_total' from answers where v_total is null
  union all select doc_id, 'currency' from answers where v_cur is null)
select coalesce(n.doc_id, r.doc_id) doc_id, coalesce(n.field, r.field) field,
  coalesce(r.message, 'nothing was given; look for it on other pages or under another name') message
from nulls n full join refused r on n.doc_id=r.doc_id and n.field=r.field""",
        "v_calls",
    ),
)
def fields_to_ask(spark, sf_dir):
    return responses.fields_to_ask(first_answers(spark, sf_dir)).select("doc_id", "field", "message")


_FIELDS = {"date": "v_date", "seller": "v_seller", "product": "v_product", "total": "v_total", "cur": "v_cur", "lang": "v_lang"}
_LABELS = {
    "date": "invoice_date",
    "seller": "seller",
    "product": "product_summary",
    "total": "gross_total",
    "cur": "currency",
    "lang": "language",
}


def _blank(alias: str, column: str) -> str:
    if column in ("v_seller", "v_product"):
        return f"coalesce(trim({alias}.{column}),'')=''"
    return f"{alias}.{column} is null"


def _asked(key: str) -> str:
    rejected = f"b.e_{key} is not null"
    if key == "lang":
        return f"(b.verdict='salvaged' and {rejected})"
    return f"({_blank('b', _FIELDS[key])} or (b.verdict='salvaged' and {rejected}))"


def _warn(key: str) -> str:
    """The salvage warning of one field, gone when the field was recovered."""
    label = _LABELS[key]
    return (
        f"case when mode='narrow' and b.verdict='salvaged' and not (replied and {_asked(key)} and not {_blank('r', _FIELDS[key])})"
        f" then '{label}: '||b.e_{key}"
        f" when mode='full' and r.verdict='salvaged' and r.error is null then '{label}: '||r.e_{key} end"
    )


# Needs a CTE both_attempts(doc_id, attempt, response, error); ends in resolved.
RESOLVE_SQL = f"""
{answers_sql('both_attempts')},
a0 as (select * from answers where attempt=0), a1 as (select * from answers where attempt=1),
paired as (select b.doc_id, case when b.verdict='failed' then 'full' else 'narrow' end mode,
   r.error, r.response second_response, r.fault second_fault, r.verdict second_verdict,
   coalesce(r.error is null and r.j is not null, false) replied
   from a0 b join a1 r using (doc_id)),
resolved as (
 select b.doc_id, mode,
   {', '.join(f"case when mode='narrow' and replied and {_asked(k)} and not {_blank('r', c)} then r.{c} when mode='narrow' then b.{c} when r.error is null and r.verdict in ('ok','salvaged') then r.{c} end f_{k}" for k, c in _FIELDS.items())},
   case when mode='full' and r.error is not null then 'model output could not be validated: repair generation failed: '||r.error
        when mode='full' and r.verdict='failed' then 'model output could not be validated: '||r.fault||'; raw response: '
          ||''''||case when length(r.response)>500 then left(r.response,500)||'...(truncated)' else r.response end||''''
        else concat_ws('|', {', '.join(_warn(k) for k in _FIELDS)}) end resolved_warnings
 from a0 b join a1 r using (doc_id) join paired using (doc_id))"""


@query(
    "plan2_extraction_with_repair",
    "PIPE-2 JSON-4 SET-3",
    oracle(
        f""", {_BOTH}, {RESOLVE_SQL}
select doc_id, strftime(f_date,'%Y-%m-%d') invoice_date, f_seller seller, f_product product_summary,
  cast(f_total as double) gross_total, f_cur currency, coalesce(f_lang,'unknown') lang, resolved_warnings from resolved""",
        "v_calls",
        "v_repairs",
    ),
)
def extraction_with_repair(spark, sf_dir):
    wide = responses.attempts_wide(both_attempts(spark, sf_dir), 1)
    return responses.resolve_attempts(wide, 1).select(
        "doc_id",
        F.col("value.invoice_date").cast("string").alias("invoice_date"),
        F.col("value.seller").alias("seller"),
        F.col("value.product_summary").alias("product_summary"),
        F.col("value.gross_total").cast("double").alias("gross_total"),
        F.col("value.currency").alias("currency"),
        F.coalesce(F.col("value.language"), F.lit("unknown")).alias("lang"),
        F.array_join("value.warnings", "|").alias("resolved_warnings"),
    )


@query(
    "set3_still_missing",
    "SET-3",
    oracle(
        f""", {_BOTH}, {answers_sql('both_attempts')},
a0 as (select * from answers where attempt=0), a1 as (select * from answers where attempt=1)
select b.doc_id, concat_ws(',', {', '.join(f"case when {_asked(k)} and not (r.error is null and r.j is not null and not {_blank('r', c)}) then '{_LABELS[k]}' end" for k, c in _FIELDS.items())}) still_missing
from a0 b join a1 r using (doc_id) where b.verdict<>'failed'""",
        "v_calls",
        "v_repairs",
    ),
)
def still_missing(spark, sf_dir):
    wide = responses.attempts_wide(both_attempts(spark, sf_dir), 2)
    resolved = responses.resolve_attempts(wide, 2)
    order = F.array(*[F.lit(n) for n in responses.ASKED_FIELDS])
    return resolved.filter((F.col("opened") != "failed") & F.col("mode").isin("narrow", "done")).select("doc_id", F.array_join(F.array_intersect(order, F.col("asked")), ",").alias("still_missing"))


@query(
    "flt11_completion_sanity",
    "FLT-11",
    oracle(
        """, raw as (select doc_id, finish_reason, case when doc_id%10=3 then '  ' else response end response from v_calls)
select doc_id, case when finish_reason='length' then '<incomplete completion' when trim(response)='' then '<empty completion' else 'kept' end outcome,
  not (finish_reason='length' or trim(response)='') usable from raw""",
        "v_calls",
    ),
)
def completion_sanity(spark, sf_dir):
    calls = spark_view(spark, sf_dir, "v_calls").withColumn(
        "response", F.when(F.col("doc_id") % 10 == 3, F.lit("  ")).otherwise(F.col("response"))
    )
    marked = responses.usable_completions(calls)
    kind = F.regexp_extract("response", "^(<(?:incomplete|empty) completion)", 1)
    return marked.select(
        "doc_id",
        F.when(kind != "", kind).otherwise(F.lit("kept")).alias("outcome"),
        (kind == "").alias("usable"),
    )


@query(
    "date3_strict_dates",
    "DATE-3",
    oracle(
        """, raw as (select doc_id, case doc_id%6 when 0 then strftime(d,'%Y-%m-%d') when 1 then strftime(d,'%Y') when 2 then strftime(d,'%Y-%m-%d')||'T00:00:00'
   when 3 then strftime(d,'%Y-%m-%d')||'T10:00:00' when 4 then strftime(d,'%d.%m.%Y') else strftime(d,'%Y-%m')||'-31' end t, d
   from (select o_orderkey doc_id, cast(o_orderdate as date) d from orders))
select doc_id, t, case when doc_id%6 in (0,2) then strftime(d,'%Y-%m-%d') when doc_id%6=5 then strftime(try_cast(t as date),'%Y-%m-%d') end parsed from raw""",
        "v_docs",
    ),
)
def strict_dates(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey doc_id",
        """case o_orderkey%6 when 0 then date_format(o_orderdate,'yyyy-MM-dd') when 1 then date_format(o_orderdate,'yyyy')
        when 2 then date_format(o_orderdate,'yyyy-MM-dd')||'T00:00:00' when 3 then date_format(o_orderdate,'yyyy-MM-dd')||'T10:00:00'
        when 4 then date_format(o_orderdate,'dd.MM.yyyy') else date_format(o_orderdate,'yyyy-MM')||'-31' end t""",
    )
    return raw.select("doc_id", "t", values.strict_date(F.col("t")).cast("string").alias("parsed"))


def short_attempts(spark, sf_dir):
    """Wide short-name answers: the first attempt only, one failed call in twenty."""
    short = spark_view(spark, sf_dir, "v_short")
    error = F.when(F.col("doc_id") % 20 == 7, F.lit("scorer stopped"))
    return short.select(
        "doc_id",
        F.when(error.isNull(), F.col("response")).alias("short_response_0"),
        error.alias("short_error_0"),
    )


@query(
    "json5_short_names",
    "JSON-5",
    oracle(
        """, joined as (select h.doc_id, seller, case when h.doc_id%5<>0 then 'Long product '||cast(h.doc_id as varchar) end product,
   case when h.doc_id%20<>7 then response end response from v_head h join v_short s using (doc_id)),
judged as (select *, case when response is null then null when not json_valid(response) then 'response is not valid JSON'
   when json_type(response,'$.seller_short') not in ('NULL','VARCHAR') then 'seller_short must be a string' end fault,
   case when json_valid(response) then response end j, seller is not null or product is not null wanted from joined)
select doc_id,
  case when wanted and fault is null and trim(coalesce(seller,''))<>'' and trim(coalesce(json_extract_string(j,'$.seller_short'),''))<>''
    then json_extract_string(j,'$.seller_short') end seller_short,
  case when wanted and fault is null and trim(coalesce(product,''))<>'' and trim(coalesce(json_extract_string(j,'$.product_short'),''))<>''
    then json_extract_string(j,'$.product_short') end product_short,
  case when not wanted then '' when response is null then 'field shortening failed: scorer stopped'
       when fault is not null then 'field shortening skipped: '||fault else '' end short_warnings
from judged""",
        "v_head",
        "v_short",
    ),
)
def short_names(spark, sf_dir):
    head = spark_view(spark, sf_dir, "v_head").select(
        "doc_id",
        "seller",
        F.when(
            F.col("doc_id") % 5 != 0, F.concat(F.lit("Long product "), F.col("doc_id").cast("string"))
        ).alias("product_summary"),
        F.array().cast("array<string>").alias("warnings"),
    )
    named = responses.apply_short_names(head.join(short_attempts(spark, sf_dir), "doc_id"), 0)
    return named.select(
        "doc_id",
        "seller_short",
        F.col("product_summary_short").alias("product_short"),
        F.array_join("warnings", "|").alias("short_warnings"),
    )
