"""Queries over embedded invoice XML: discovery and field mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.catalog.q_naming import PRODUCTS_SQL, _CODES_SQL
from fieldloom.catalog.registry import query
from fieldloom.catalog.views import PROFILE, oracle, spark_view, xml_documents
from fieldloom.operators import attachments, invoice_xml, line_items

_KNOWN = "lower(attachment_name) in ('zugferd-invoice.xml','factur-x.xml','xrechnung.xml')"


def attached(spark, sf_dir, view):
    return spark_view(spark, sf_dir, view).withColumn("content", F.col("content").cast("binary"))


@query(
    "flt2_known_attachments",
    "FLT-2",
    oracle(
        f"select doc_id, attachment_name, cast(revision_no as bigint) revision_no from v_attach where {_KNOWN} and content<>''",
        "v_attach",
    ),
)
def known_attachments(spark, sf_dir):
    known = attachments.known_attachments(attached(spark, sf_dir, "v_attach"))
    return known.filter(F.length("content") > 0).select(
        "doc_id", "attachment_name", F.col("revision_no").cast("bigint").alias("revision_no")
    )


@query(
    "agg10_distinct_contents",
    "AGG-10 SORT-2",
    oracle(
        f""", kept as (select *, sha256(content) content_hash from v_attach where {_KNOWN} and content<>''),
firsts as (select doc_id, content_hash, arg_min(attachment_name, revision_no) first_name, min(revision_no) seen from kept group by all)
select doc_id, count(*) n_contents, arg_min(first_name, seen) first_name,
  array_to_string(list_sort(list_distinct(list(first_name))), ', ') content_names, count(*)>1 ambiguous
from firsts group by doc_id""",
        "v_attach",
    ),
)
def distinct_contents(spark, sf_dir):
    hashed = (
        attachments.known_attachments(attached(spark, sf_dir, "v_attach"))
        .filter(F.length("content") > 0)
        .select("doc_id", "attachment_name", "revision_no", F.sha2("content", 256).alias("content_hash"))
    )
    return attachments.distinct_contents(hashed).select(
        "doc_id",
        "n_contents",
        F.col("facts.attachment_name").alias("first_name"),
        "content_names",
        (F.col("n_contents") > 1).alias("ambiguous"),
    )


@query(
    "agg11_attachment_caps",
    "AGG-11",
    oracle(
        f""", per_name as (select doc_id, attachment_name, count(*) revisions, min(revision_no) seen from v_revisions where {_KNOWN} group by all)
select doc_id, count(*) n_names, max(revisions) max_revisions, max(revisions)>5 or count(*)>10 ambiguous,
  arg_min(attachment_name, seen) filter (where revisions>5) crowded_name from per_name group by doc_id""",
        "v_revisions",
    ),
)
def attachment_caps(spark, sf_dir):
    counts = attachments.name_counts(attached(spark, sf_dir, "v_revisions"))
    return counts.select(
        "doc_id",
        "n_names",
        "max_revisions",
        (
            (F.col("max_revisions") > attachments.MAX_REVISIONS)
            | (F.col("n_names") > attachments.MAX_KNOWN_NAMES)
        ).alias("ambiguous"),
        F.col("crowded.attachment_name").alias("crowded_name"),
    )


def _cascade_sql(view: str) -> str:
    return oracle(
        f""", docs as (select distinct doc_id from {view}),
per_name as (select doc_id, attachment_name, count(*) revisions, min(revision_no) seen from {view} where {_KNOWN} group by all),
names as (select doc_id, count(*) n_names, max(revisions) most,
   arg_min(attachment_name, seen) filter (where revisions>5) crowded,
   arg_min(revisions, seen) filter (where revisions>5) crowded_n from per_name group by doc_id),
firsts as (select doc_id, content, arg_min(attachment_name, revision_no) first_name, min(revision_no) seen
   from {view} where {_KNOWN} and content<>'' group by all),
contents as (select doc_id, count(*) n_contents, arg_min(first_name, seen) first_name,
   array_to_string(list_sort(list_distinct(list(first_name))), ', ') content_names from firsts group by doc_id)
select doc_id,
  case when n_names is null then 'none' when n_names>10 or most>5 then 'ambiguous' when n_contents is null then 'none'
       when n_contents>1 then 'ambiguous' else 'invalid' end xml_status,
  case when n_names>0 and n_names<=10 and most<=5 and n_contents=1 then first_name end xml_attachment_name,
  case when n_names is null then null
       when most>5 then ''''||crowded||''' has '||cast(crowded_n as varchar)||' attachment revisions, more than can be safely checked for conflicts; skipping XML extraction'
       when n_contents is null then null
       when n_contents>1 then 'multiple distinct invoice XML attachments found ('||content_names||'); skipping XML extraction'
       else ''''||first_name||''' is not valid XML: not well-formed' end xml_warning
from docs left join names using (doc_id) left join contents using (doc_id)""",
        view,
    )


def _discover(spark, sf_dir, view):
    rows = attached(spark, sf_dir, view)
    found = attachments.discover_xml(rows.select("doc_id").distinct(), rows)
    return found.select("doc_id", "xml_status", "xml_attachment_name", "xml_warning")


@query("xml1_discovery_names", "XML-1", _cascade_sql("v_attach"))
def discovery_names(spark, sf_dir):
    return _discover(spark, sf_dir, "v_attach")


@query("xml1_discovery_revisions", "XML-1 AGG-11", _cascade_sql("v_revisions"))
def discovery_revisions(spark, sf_dir):
    return _discover(spark, sf_dir, "v_revisions")


def planted_attachments(spark, sf_dir):
    """Invoice XML with a planted fault on some documents."""
    xml, key = F.col("xml"), F.col("doc_id")
    end = F.lit("</rsm:CrossIndustryInvoice>")
    variants = (
        F.when(key % 7 == 0, F.replace(xml, end, F.lit("")))
        .when(key % 11 == 0, F.replace(xml, F.lit("<rsm:Cross"), F.lit("<!DOCTYPE x><rsm:Cross")))
        .when(key % 13 == 0, F.replace(xml, F.lit("rsm:CrossIndustryInvoice"), F.lit("rsm:Order")))
        .when(key % 17 == 0, F.replace(xml, F.lit(PROFILE), F.lit("urn:other")))
        .when(key % 19 == 0, F.replace(xml, F.lit("</ram:ID>"), F.lit("</ram:ID><ram:ID>b</ram:ID>")))
        .when(key % 23 == 0, F.replace(xml, end, F.concat(F.repeat(F.lit("<q>"), F.lit(50)), F.repeat(F.lit("</q>"), F.lit(50)), end)))
        .when(key % 29 == 0, F.replace(xml, end, F.concat(F.repeat(F.lit("<q>"), F.lit(49)), F.repeat(F.lit("</q>"), F.lit(49)), end)))
        .when(key % 31 == 0, F.concat(xml, F.lit(" tail")))
        .when(key % 37 == 0, F.concat(xml, xml))
        .otherwise(xml)
    )
    return xml_documents(spark, sf_dir).select(
        "doc_id",
        F.lit("factur-x.xml").alias("attachment_name"),
        F.lit(0).alias("revision_no"),
        variants.cast("binary").alias("content"),
    )


_ROOT = "{urn:un:unece:uncefact:data:standard:CrossIndustryInvoice:100}Order"


@query(
    "xml1_discovery_invoices",
    "XML-1",
    oracle(
        f"""select doc_id,
 case when doc_id%7=0 or doc_id%11=0 then 'invalid' when doc_id%13=0 or doc_id%17=0 then 'unsupported'
      when doc_id%19=0 or doc_id%23=0 then 'invalid' when doc_id%29=0 then 'supported'
      when doc_id%31=0 or doc_id%37=0 then 'invalid' else 'supported' end xml_status,
 case when doc_id%7=0 then '''factur-x.xml'' is not valid XML: not well-formed'
      when doc_id%11=0 then '''factur-x.xml'' is not valid XML: declares a document type'
      when doc_id%13=0 then '''factur-x.xml'' has an unsupported root element ''{_ROOT}'''
      when doc_id%17=0 then '''factur-x.xml'' uses an unsupported invoice profile ''urn:other'''
      when doc_id%19=0 then '''factur-x.xml'' declares more than one conflicting invoice profile'
      when doc_id%23=0 then '''factur-x.xml'' is not valid XML: exceeds maximum XML nesting depth (50)'
      when doc_id%29=0 then null when doc_id%31=0 or doc_id%37=0 then '''factur-x.xml'' is not valid XML: not well-formed' end xml_warning,
 case when doc_id%7=0 or doc_id%11=0 or doc_id%13=0 then null when doc_id%17=0 then 'urn:other'
      when doc_id%19=0 or doc_id%23=0 then null when doc_id%29=0 then '{PROFILE}'
      when doc_id%31=0 or doc_id%37=0 then null else '{PROFILE}' end xml_profile_id
from v_head""",
        "v_head",
    ),
)
def discovery_invoices(spark, sf_dir):
    rows = planted_attachments(spark, sf_dir)
    documents = spark_view(spark, sf_dir, "v_head").select("doc_id")
    return attachments.discover_xml(documents, rows).select(
        "doc_id", "xml_status", "xml_warning", "xml_profile_id"
    )


FROM_XML_SQL = f"""
{PRODUCTS_SQL},
xml_fields as (
  select h.doc_id,
    case when h.doc_id%103=0 then null else invoice_date end invoice_date,
    case when h.doc_id%101=0 then null else trim(seller) end seller,
    product_summary, gross_total,
    case when currency in {_CODES_SQL} then currency end currency,
    concat_ws('|',
      case when h.doc_id%103=0 and invoice_date is not null
        then 'invoice_date: unsupported XML date format ''610''; falling back to AI extraction' end,
      case when h.doc_id%101=0 and seller is not null
        then 'seller: multiple conflicting XML seller names; falling back to AI extraction' end,
      product_warning,
      case when currency='eur' then 'currency: invalid XML currency code ''eur''; falling back to AI extraction' end) xml_warnings
  from v_head h left join summaries s using (doc_id))"""


def mapped_documents(spark, sf_dir):
    content = xml_documents(spark, sf_dir).withColumn("content", F.col("xml").cast("binary"))
    checked = invoice_xml.read_xml(content, "content", ["doc_id"])
    return invoice_xml.map_fields(checked, ["doc_id"])


@query(
    "xml3_field_mapping",
    "XML-3 XML-2 DATE-1",
    oracle(
        f""", {FROM_XML_SQL}
select doc_id, strftime(invoice_date,'%Y-%m-%d') invoice_date, seller, product_summary,
  cast(gross_total as double) gross_total, currency, xml_warnings,
  concat_ws(',', case when invoice_date is not null then 'invoice_date' end, case when seller is not null then 'seller' end,
    case when product_summary is not null then 'product_summary' end, case when gross_total is not null then 'gross_total' end,
    case when currency is not null then 'currency' end) evidence_fields
from xml_fields""",
        "v_head",
        "v_lines",
    ),
)
def field_mapping(spark, sf_dir):
    return mapped_documents(spark, sf_dir).select(
        "doc_id",
        F.col("invoice_date").cast("string").alias("invoice_date"),
        "seller",
        "product_summary",
        F.col("gross_total").cast("double").alias("gross_total"),
        "currency",
        F.array_join("warnings", "|").alias("xml_warnings"),
        F.array_join(F.map_keys("evidence"), ",").alias("evidence_fields"),
    )


@query(
    "xml2_unique_seller",
    "XML-2",
    oracle(
        """select doc_id, case when doc_id%101<>0 then trim(seller) end seller,
 (doc_id%101=0 and seller is not null) repeated from v_head""",
        "v_head",
    ),
)
def unique_seller(spark, sf_dir):
    mapped = mapped_documents(spark, sf_dir)
    repeated = F.exists("warnings", lambda w: w.startswith("seller: multiple conflicting"))
    return mapped.select("doc_id", "seller", repeated.alias("repeated"))


@query(
    "date1_compact_dates",
    "DATE-1",
    oracle(
        """, raw as (select doc_id, case doc_id%5 when 0 then strftime(invoice_date,'%Y%m%d') when 1 then strftime(invoice_date,'%Y-%m-%d')
   when 2 then strftime(invoice_date,'%Y')||'1332' when 3 then strftime(invoice_date,'%Y')||'0230' else strftime(invoice_date,'%Y%m%d')||'0' end t, invoice_date from v_head)
select doc_id, t, case when doc_id%5=0 then strftime(invoice_date,'%Y-%m-%d') end parsed from raw""",
        "v_head",
    ),
)
def compact_dates(spark, sf_dir):
    from fieldloom.functions.values import compact_date

    raw = spark_view(spark, sf_dir, "v_head").selectExpr(
        "doc_id",
        """case doc_id%5 when 0 then date_format(invoice_date,'yyyyMMdd') when 1 then date_format(invoice_date,'yyyy-MM-dd')
        when 2 then date_format(invoice_date,'yyyy')||'1332' when 3 then date_format(invoice_date,'yyyy')||'0230'
        else date_format(invoice_date,'yyyyMMdd')||'0' end t""",
    )
    return raw.select("doc_id", "t", compact_date(F.col("t")).cast("string").alias("parsed"))


@query(
    "udtf1_line_item_rows",
    "UDTF-1",
    oracle("select doc_id, ord, name, cast(amount as double) amount from v_lines join v_head using (doc_id)", "v_lines", "v_head"),
)
def line_item_rows(spark, sf_dir):
    return line_items.explode_items(mapped_documents(spark, sf_dir)).withColumn(
        "amount", F.col("amount").cast("double")
    )
