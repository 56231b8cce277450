"""Queries over merged sources and the whole analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.catalog.q_naming import naming_sql
from fieldloom.catalog.q_pages import ROUTED_SQL, routed_pages
from fieldloom.catalog.q_responses import RESOLVE_SQL, both_attempts, first_answers, short_attempts
from fieldloom.catalog.q_responses import answers_sql
from fieldloom.catalog.q_xml import FROM_XML_SQL, mapped_documents
from fieldloom.catalog.registry import query
from fieldloom.catalog.views import oracle, spark_view, xml_documents
from fieldloom.operators import merge, pages, prompts, responses
from fieldloom.operators.evaluation import FAILURE_MARKER
from fieldloom.plans import analysis
from fieldloom.plans.evaluation import evaluate_modes

_XML = ("v_head", "v_lines")


@query(
    "flt4_xml_complete",
    "FLT-4 PRJ-4 ARR-1",
    oracle(
        f""", {FROM_XML_SQL}, used as (select doc_id, concat_ws(',', case when invoice_date is not null then 'invoice_date' end, case when seller is not null then 'seller' end,
  case when product_summary is not null then 'product_summary' end, case when gross_total is not null then 'gross_total' end, case when currency is not null then 'currency' end) fields_used from xml_fields)
select doc_id, fields_used, fields_used='invoice_date,seller,product_summary,gross_total,currency' complete,
  case when fields_used='invoice_date,seller,product_summary,gross_total,currency' then 'xml' when fields_used<>'' then 'xml_and_model' else 'model' end extraction_source from used""",
        *_XML,
    ),
)
def xml_complete(spark, sf_dir):
    mapped = mapped_documents(spark, sf_dir)
    routed = mapped.select(
        "doc_id",
        merge.fields_used(F.col).alias("used"),
        merge.supplies_filename(F.col).alias("complete"),
    )
    return routed.select(
        "doc_id",
        F.array_join("used", ",").alias("fields_used"),
        "complete",
        merge.extraction_source(F.size("used"), F.col("complete")).alias("extraction_source"),
    )


def header_extractions(spark, sf_dir):
    """Headers with a seller, as if read from XML."""
    return spark_view(spark, sf_dir, "v_head").filter("seller is not null").select(
        "doc_id",
        "invoice_date",
        "seller",
        F.lit(None).cast("string").alias("product_summary"),
        F.col("gross_total").cast("decimal(38,10)").alias("gross_total"),
        "currency",
        F.create_map(F.lit("seller"), F.lit("xml")).alias("evidence"),
        F.array(F.lit("xml note")).alias("warnings"),
    )


def model_extractions(spark, sf_dir):
    """Readable answers, as extraction rows."""
    answers = first_answers(spark, sf_dir).filter("answer.verdict <> 'failed'")
    fields = [F.col(f"answer.{f}").alias(f) for f in (*merge.FILENAME_FIELDS, "language")]
    return answers.select(
        "doc_id", *fields, F.create_map(F.lit("seller"), F.lit("model")).alias("evidence"), "answer.warnings"
    )


@query(
    "join1_merged_sources",
    "JOIN-1 SET-4",
    oracle(
        f""", {answers_sql('v_calls')}, x as (select * from v_head where seller is not null), m as (select * from answers where verdict<>'failed')
select coalesce(x.doc_id, m.doc_id) doc_id, strftime(coalesce(x.invoice_date, m.v_date),'%Y-%m-%d') invoice_date, coalesce(x.seller, m.v_seller) seller,
  cast(coalesce(x.gross_total, m.v_total) as double) gross_total, coalesce(x.currency, m.v_cur) currency, coalesce(m.v_lang,'unknown') lang,
  case when x.doc_id is not null then 'xml' else 'model' end evidence_from,
  concat_ws('|', case when x.doc_id is not null then 'xml note' end, case when m.verdict='salvaged' then replace(m.rejected,'; ','|') end) all_warnings
from x full join m on x.doc_id=m.doc_id""",
        "v_head",
        "v_calls",
    ),
)
def merged_sources(spark, sf_dir):
    merged = merge.merge_sources(header_extractions(spark, sf_dir), model_extractions(spark, sf_dir))
    return merged.select(
        "doc_id",
        F.col("invoice_date").cast("string").alias("invoice_date"),
        "seller",
        F.col("gross_total").cast("double").alias("gross_total"),
        "currency",
        F.col("language").alias("lang"),
        F.element_at("evidence", "seller").alias("evidence_from"),
        F.array_join("warnings", "|").alias("all_warnings"),
    )


def analysis_inputs(spark, sf_dir):
    """Documents, XML attachments for those in lists of line items, and calls."""
    documents = spark_view(spark, sf_dir, "v_head").select(
        "doc_id", F.lit(".pdf").alias("extension"), F.lit(True).alias("shorten")
    )
    attached = xml_documents(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.lit("notes.txt")).otherwise(F.lit("factur-x.xml")).alias("attachment_name"),
        F.lit(0).alias("revision_no"),
        F.col("xml").cast("binary").alias("content"),
    )
    crash = F.when((F.col("attempt") == 0) & (F.col("doc_id") % 59 == 0), F.lit("scorer down"))
    finish = spark_view(spark, sf_dir, "v_calls").select("doc_id", "attempt", "finish_reason")
    extraction = (
        both_attempts(spark, sf_dir)
        .join(finish, ["doc_id", "attempt"], "left")
        .withColumn("error", F.coalesce("error", crash))
        .withColumn("response", F.when(F.col("error").isNull(), F.col("response")))
    )
    shortening = short_attempts(spark, sf_dir).select(
        "doc_id",
        F.lit("shortening").alias("phase"),
        F.lit(0).alias("attempt"),
        F.col("short_response_0").alias("response"),
        F.col("short_error_0").alias("error"),
        F.lit("stop").alias("finish_reason"),
    )
    return documents, attached, extraction.unionByName(shortening)


def stray_calls(calls):
    """Calls that take no part: attempts beyond the last, unknown phases, and a second, silent row of an attempt."""
    first = calls.where("phase = 'extraction' and attempt = 0")
    late = first.where("doc_id % 17 = 0").withColumn("attempt", F.lit(7))
    other = first.where("doc_id % 23 = 0").withColumn("phase", F.lit("review"))
    negative = first.where("doc_id % 23 = 0").withColumn("attempt", F.lit(-1))
    silent = first.where("doc_id % 19 = 0").withColumns({c: F.lit(None).cast("string") for c in ("response", "error")})
    return late.unionByName(other).unionByName(negative).unionByName(silent)


ANALYSIS_SQL = f"""
{FROM_XML_SQL},
both_attempts as (select doc_id, 0 attempt, case when finish_reason='length' then '<incomplete' else response end response, cast(null as varchar) error from v_calls
  union all select doc_id, attempt, response, error from v_repairs),
{RESOLVE_SQL},
xml_part as (select doc_id, case when doc_id%3<>0 then invoice_date end x_date, case when doc_id%3<>0 then seller end x_seller,
   case when doc_id%3<>0 then product_summary end x_product, case when doc_id%3<>0 then gross_total end x_total,
   case when doc_id%3<>0 then currency end x_cur, case when doc_id%3<>0 then xml_warnings else '' end x_warn from xml_fields),
routed as (select *, x_date is not null and x_seller is not null and x_product is not null and x_total is not null and x_cur is not null complete,
   x_date is not null or x_seller is not null or x_product is not null or x_total is not null or x_cur is not null some_xml from xml_part),
merged as (select r.*, m.*exclude(doc_id), not complete and r.doc_id%59=0 crashed, not complete and r.doc_id%59<>0 modelled from routed r join resolved m using (doc_id)),
valued as (select doc_id, complete, crashed, some_xml,
   coalesce(x_date, case when modelled then f_date end) invoice_date, coalesce(x_seller, case when modelled then f_seller end) seller,
   coalesce(x_product, case when modelled then f_product end) product_summary, coalesce(x_total, case when modelled then f_total end) gross_total,
   coalesce(x_cur, case when modelled then f_cur end) currency,
   concat_ws('|', nullif(x_warn,''), case when modelled then nullif(resolved_warnings,'') end, case when crashed then 'model fallback failed: scorer down' end) warn
   from merged),
short as (select doc_id, case when doc_id%20<>7 then response end response from v_short),
judged as (select v.*, response, case when response is null then null when not json_valid(response) then 'response is not valid JSON'
   when json_type(response,'$.seller_short') not in ('NULL','VARCHAR') then 'seller_short must be a string' end short_fault,
   case when json_valid(response) then response end sj, not crashed and (seller is not null or product_summary is not null) wanted
   from valued v join short using (doc_id)),
shortened as (select *,
   case when wanted and short_fault is null and trim(coalesce(seller,''))<>'' and trim(coalesce(json_extract_string(sj,'$.seller_short'),''))<>'' then json_extract_string(sj,'$.seller_short') end seller_short,
   case when wanted and short_fault is null and trim(coalesce(product_summary,''))<>'' and trim(coalesce(json_extract_string(sj,'$.product_short'),''))<>'' then json_extract_string(sj,'$.product_short') end product_short,
   concat_ws('|', nullif(warn,''), case when wanted and response is null then 'field shortening failed: scorer stopped'
      when wanted and short_fault is not null then 'field shortening skipped: '||short_fault end) all_warnings from judged),
effective as (select *, coalesce(seller_short, seller) seller_eff, coalesce(product_short, product_summary) product_eff,
   case when crashed and not some_xml then 'failed' else 'done' end state from shortened),
{naming_sql('effective', 'product_eff', 'seller_eff')}"""


@query(
    "plan1_xml_first_analysis",
    "PIPE-1 PIPE-3",
    oracle(
        f""", {ANALYSIS_SQL}
select doc_id, state, case when state='done' then proposed_filename end proposed_filename, missing_fields, naming_warnings, all_warnings,
  missing_fields<>'' or naming_warnings<>'' or all_warnings<>'' requires_review,
  case when complete or crashed then 'xml' when some_xml then 'xml_and_model' else 'model' end extraction_source,
  case when complete then doc_id%20<>7 else true end inference_ran,
  case when doc_id%17=0 then 1 else 0 end + case when doc_id%23=0 then 2 else 0 end calls_ignored,
  case when doc_id%19=0 then 1 else 0 end calls_repeated from named""".replace(
            "calls_ignored,", "::bigint calls_ignored,"
        ).replace("calls_repeated from", "::bigint calls_repeated from"),
        *_XML,
        "v_calls",
        "v_repairs",
        "v_short",
    ),
)
def xml_first_analysis(spark, sf_dir):
    documents, attached, calls = analysis_inputs(spark, sf_dir)
    analysed = analysis.analyse(documents, attached, calls.unionByName(stray_calls(calls)), max_repairs=1, short_repairs=0)
    return analysed.select(
        "doc_id",
        "state",
        "calls_ignored",
        "calls_repeated",
        "proposed_filename",
        F.array_join("missing_fields", ",").alias("missing_fields"),
        F.array_join("naming_warnings", ",").alias("naming_warnings"),
        F.array_join("warnings", "|").alias("all_warnings"),
        "requires_review",
        "extraction_source",
        "inference_ran",
    )


@query(
    "plan1_pages_and_images",
    "PIPE-1 PIPE-4",
    oracle(
        f""", {ANALYSIS_SQL}, {ROUTED_SQL.replace("routed as", "paged as")},
counted as (select doc_id, count(*) n, string_agg(case when needs_ocr then cast(page_number as varchar) end, ',' order by page_number) ocr from paged group by doc_id),
kinds as (select doc_id, doc_id%10=0 image, complete and doc_id%10<>0 alone, some_xml and doc_id%10<>0 some_xml from valued)
select doc_id, case when not alone and doc_id%59=0 and not some_xml then 'failed' else 'done' end state,
  case when alone or doc_id%59=0 then 'xml' when some_xml then 'xml_and_model' else 'model' end extraction_source,
  case when image then 1 else coalesce(n, 0) end pages_total,
  case when image then '1' when alone then '' else coalesce(ocr, '') end pages_ocr from kinds left join counted using (doc_id)""",
        *_XML,
        "v_calls",
        "v_repairs",
        "v_short",
        "v_pages",
    ),
)
def pages_and_images(spark, sf_dir):
    documents, attached, calls = analysis_inputs(spark, sf_dir)
    extension = F.when(F.col("doc_id") % 10 == 0, F.lit(".JPG")).otherwise(F.col("extension"))
    analysed = analysis.analyse(
        documents.withColumn("extension", extension), attached, calls, 1, 0, routed_pages(spark, sf_dir)
    )
    return analysed.select(
        "doc_id", "state", "extraction_source", "pages_total", F.array_join("pages_ocr", ",").alias("pages_ocr")
    )


@query(
    "str12_shortening_prompts",
    "STR-12",
    oracle(
        f""", {ANALYSIS_SQL}
select doc_id, 'seller: '||coalesce(seller,'null')||chr(10)||'product_summary: '||coalesce(product_summary,'null')||chr(10)||chr(10)||'{prompts.SHORTEN}' prompt
from valued where not crashed and (seller is not null or product_summary is not null)""",
        *_XML,
        "v_calls",
        "v_repairs",
        "v_short",
    ),
)
def shortening_prompts(spark, sf_dir):
    documents, attached, calls = analysis_inputs(spark, sf_dir)
    extracted = calls.filter("phase = 'extraction'")
    analysed = analysis.analyse(documents, attached, extracted, max_repairs=1, short_repairs=0)
    return prompts.pending_shortening(analysed, extracted).select("doc_id", "prompt")


@query(
    "plan5_evaluation_modes",
    "PIPE-5",
    oracle(
        f""", {ANALYSIS_SQL},
lab as (select doc_id, bool_or(field='seller') hs, max(case when field='seller' then expected end) l_seller,
  bool_or(field='gross_total') ht, max(case when field='gross_total' then expected end) l_total, bool_or(expected is null) hn from v_labels group by doc_id),
mode_runs as (select 'xml_first' model_id, doc_id, seller, gross_total, crashed and not some_xml crashed, contains(warn, '{FAILURE_MARKER}') marked from valued
  union all select 'text_only', doc_id, case when doc_id%59<>0 then f_seller end, case when doc_id%59<>0 then f_total end, doc_id%59=0,
    doc_id%59<>0 and contains(coalesce(resolved_warnings,''), '{FAILURE_MARKER}') from resolved),
judged2 as (select m.model_id, m.crashed or coalesce(m.marked, false) failed, coalesce(hn,false) hn,
  case when not coalesce(hs,false) then null when crashed then false when seller is null or l_seller is null then seller is null and l_seller is null
    else regexp_matches(lower(seller), '(^|[^0-9a-z_#])'||lower(l_seller)||'($|[^0-9a-z_])') end ms,
  case when not coalesce(ht,false) then null when crashed then false when gross_total is null or l_total is null then gross_total is null and l_total is null
    else gross_total = cast(l_total as decimal(18,2)) end mt,
  not crashed and ((coalesce(hs,false) and l_seller is null and seller is not null) or (coalesce(ht,false) and l_total is null and gross_total is not null)) invented
  from mode_runs m left join lab using (doc_id))
select model_id, count(*) runs, round(avg(ms::int),9) accuracy_seller, round(avg(mt::int),9) accuracy_gross_total, round(avg(failed::int),9) failure_rate,
  round(avg(case when hn then invented::int end),9) hallucination_rate from judged2 group by model_id""",
        *_XML,
        "v_calls",
        "v_repairs",
        "v_short",
        "v_labels",
    ),
)
def evaluation_modes(spark, sf_dir):
    labels = spark_view(spark, sf_dir, "v_labels")
    report = evaluate_modes(*analysis_inputs(spark, sf_dir), labels, max_repairs=1, short_repairs=0)
    rates = ("accuracy_seller", "accuracy_gross_total", "failure_rate", "hallucination_rate")
    return report.select("model_id", "runs", *[F.round(n, 9).alias(n) for n in rates])


def prompt_states(spark, sf_dir):
    """Documents with pages and, where there is one, a first answer."""
    documents = pages.assemble_pages(routed_pages(spark, sf_dir))
    first = both_attempts(spark, sf_dir).filter("attempt = 0")
    wide = responses.attempts_wide(first, 1)
    return responses.resolve_attempts(documents.join(wide, "doc_id", "left"), 1)


@query(
    "str12_pending_prompts",
    "STR-12",
    oracle(
        f""", {answers_sql('v_calls')}, docs as (select distinct doc_id from v_pages),
state as (select d.doc_id, a.verdict, a.doc_id is null fresh,
   concat_ws(',', case when a.v_date is null or a.e_date is not null then 'invoice_date' end, case when coalesce(trim(a.v_seller),'')='' then 'seller' end,
     case when coalesce(trim(a.v_product),'')='' then 'product_summary' end, case when a.v_total is null then 'gross_total' end,
     case when a.v_cur is null then 'currency' end, case when a.verdict='salvaged' and a.e_lang is not null then 'language' end) asked
   from docs d left join answers a using (doc_id))
select doc_id, case when fresh then 'extract' when verdict='failed' then 'full repair' else 'field repair' end kind,
  case when fresh or verdict='failed' then 'invoice_date,seller,product_summary,gross_total,currency,language' else asked end fields
from state""",
        "v_pages",
        "v_calls",
    ),
)
def pending_prompts(spark, sf_dir):
    rows = prompts.pending_prompts(prompt_states(spark, sf_dir))
    text = F.col("prompt")
    kind = (
        F.when(F.contains(text, F.lit("The last answer could not be used.")), F.lit("full repair"))
        .when(F.contains(text, F.lit(prompts.REPAIR)), F.lit("field repair"))
        .otherwise(F.lit("extract"))
    )
    named = F.array_compact(
        F.array(
            *[
                F.when(F.contains(text, F.lit(prompts.INSTRUCTIONS[f])), F.lit(f))
                for f in responses.ASKED_FIELDS
            ]
        )
    )
    return rows.select("doc_id", kind.alias("kind"), F.array_join(named, ",").alias("fields"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EXTRACT_BODY = _literal(
    "\n\n" + "\n\n".join([prompts.EXTRACT, "\n".join(prompts.INSTRUCTIONS[f] for f in responses.ASKED_FIELDS), prompts.CLOSING])
)
_LAST, _REASON = _literal("\n\nThe last answer could not be used.\n\nLast answer:\n"), _literal("\n\nReason:\n")


@query(
    "plan1_next_prompts",
    "PIPE-1 STR-12",
    oracle(
        f""", {FROM_XML_SQL}, {ROUTED_SQL.replace("routed as", "paged as")},
calls0 as (select doc_id, 0 attempt, response, cast(null as varchar) error from v_calls where doc_id%4<>1),
{answers_sql('calls0')},
xml_part as (select doc_id, doc_id%3<>0 and invoice_date is not null and seller is not null and product_summary is not null
   and gross_total is not null and currency is not null complete, seller, product_summary from xml_fields),
blocks as (select doc_id, string_agg('--- Page '||page_number||' ---'||chr(10)||page_text, chr(10)||chr(10) order by page_number) block from paged group by doc_id),
states as (select x.doc_id, a.doc_id is null fresh, a.verdict, a.response, a.fault, coalesce(block,'')||{_EXTRACT_BODY} original
   from xml_part x left join answers a using (doc_id) left join blocks using (doc_id) where not complete)
select doc_id, 'extraction' phase, case when fresh then 0 else 1 end attempt,
  case when fresh then 'extract' when verdict='failed' then 'full repair' else 'field repair' end kind,
  case when fresh then original when verdict='failed' then original||{_LAST}||response||{_REASON}||fault||{_literal(chr(10) * 2 + prompts.CLOSING)} end prompt from states
union all
select doc_id, 'shortening', 0, 'shorten', 'seller: '||coalesce(seller,'null')||chr(10)||'product_summary: '||coalesce(product_summary,'null')||{_literal(chr(10) * 2 + prompts.SHORTEN)}
from xml_part where complete""",
        *_XML,
        "v_calls",
        "v_pages",
    ),
)
def next_prompts(spark, sf_dir):
    documents, attached, _ = analysis_inputs(spark, sf_dir)
    calls = spark_view(spark, sf_dir, "v_calls").where("doc_id % 4 <> 1").select(
        "doc_id", "phase", "attempt", "response", F.lit(None).cast("string").alias("error"), F.lit("stop").alias("finish_reason")
    )
    rows = analysis.next_prompts(documents, attached, calls, routed_pages(spark, sf_dir), 1, 0)
    text = F.col("prompt")
    kind = (
        F.when(F.col("phase") == "shortening", F.lit("shorten"))
        .when(F.contains(text, F.lit("The last answer could not be used.")), F.lit("full repair"))
        .when(F.contains(text, F.lit(prompts.REPAIR)), F.lit("field repair"))
        .otherwise(F.lit("extract"))
    )
    return rows.select(
        "doc_id", "phase", F.col("attempt").cast("int").alias("attempt"), kind.alias("kind"), F.when(kind != "field repair", text).alias("prompt")
    )


SCORED_SQL = oracle(
    """, docs as (select doc_id, string_agg('x','') marks from v_pages group by 1)
select doc_id, doc_id%5=0 raised, case when doc_id%5<>0 then length(cast(doc_id as varchar)) end response_length from docs""",
    "v_pages",
)


def keyed_prompts(spark, sf_dir):
    """Extraction prompts that begin with their document's number."""
    documents = pages.assemble_pages(routed_pages(spark, sf_dir))
    return documents.select(
        "doc_id",
        F.concat(
            F.col("doc_id").cast("string"), F.lit("\n"), prompts.extraction_prompt(F.col("pages"))
        ).alias("prompt"),
    )


def scored(calls):
    return calls.select(
        "doc_id",
        F.col("error").isNotNull().alias("raised"),
        F.length("response").cast("bigint").alias("response_length"),
    )


@query("udf1_batched_prompts", "UDF-1 UDF-3", SCORED_SQL)
def batched_prompts(spark, sf_dir):
    def load_scorer():
        def scorer(texts: list[str]) -> list:
            keys = [t.split("\n", 1)[0] for t in texts]
            return [ValueError("scripted failure") if int(k) % 5 == 0 else k for k in keys]

        return scorer

    return scored(prompts.score_batches(keyed_prompts(spark, sf_dir), "scripted", load_scorer))


@query("udf1_scored_prompts", "UDF-1 UDF-3", SCORED_SQL)
def scored_prompts(spark, sf_dir):
    def load_scorer():
        def scorer(prompt: str) -> str:
            key = prompt.split("\n", 1)[0]
            if int(key) % 5 == 0:
                raise ValueError("scripted failure")
            return key

        return scorer

    return scored(prompts.score_prompts(keyed_prompts(spark, sf_dir), load_scorer))


@query(
    "udf2_recognised_pages",
    "UDF-2",
    oracle(
        """select doc_id, page_number, 'seen '||ocr_text ocr_text from v_pages
where length(regexp_replace(text_layer,'\\s','','g'))<20""",
        "v_pages",
    ),
)
def recognised_pages(spark, sf_dir):
    def load_recogniser():
        def recognise(image: bytes):
            return "seen " + image.decode("utf-8"), None

        return recognise

    raw = spark_view(spark, sf_dir, "v_pages")
    rows = raw.select(
        "doc_id",
        "page_number",
        F.col("ocr_text").cast("binary").alias("image"),
        pages.is_sparse(F.col("text_layer")).alias("needs_ocr"),
    )
    return prompts.recognise_pages(rows, load_recogniser).select("doc_id", "page_number", "ocr_text")
