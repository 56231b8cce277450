"""Document-shaped views over the driver tables.

One SQL text per view serves both engines: ``$orders`` and the like become a
parquet path for Spark and the plain table name for the oracle.
"""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The line order inside one order: (l_orderkey, l_linenumber) is not unique.
_LINE_ORDER = "order by l_linenumber, l_partkey, l_suppkey, l_extendedprice"

# Pairs (m, r) with r <= m: an order with key%7 = m has revisions 0..m.
_REVISIONS = " union all ".join(f"select {m} m, {r} r" for m in range(7) for r in range(m + 1))


def _scorer(model_id: str, k: int) -> str:
    return f"""
select '{model_id}' model_id, o_orderkey doc_id,
 case when o_orderkey%{k}=0 then null when o_orderkey%{k}=1 then c_name||' - Region 1'
      when o_orderkey%{k}=2 then substr(c_name,1,4) else c_name end seller,
 case when o_orderkey%{k}=3 then cast(o_totalprice as decimal(18,2))+1
      else cast(o_totalprice as decimal(18,2)) end gross_total,
 o_orderkey%53=0 failed, o_orderkey%53<>0 timing_complete, o_orderkey%900 total_ms,
 o_orderkey%700 inference_ms
from $orders join $customer on o_custkey=c_custkey"""


VIEWS: dict[str, str] = {
    "v_head": """
select o_orderkey doc_id,
 case when o_orderkey%23=0 then null else cast(o_orderdate as date) end invoice_date,
 case when o_orderkey%19=0 then null when o_orderkey%17=0 then 'Müller & Söhne GmbH'
      when o_orderkey%31=0 then repeat('Word ',60) else c_name end seller,
 case when o_orderkey%29=0 then null else cast(o_totalprice as decimal(18,2)) end gross_total,
 case o_orderkey%7 when 0 then 'EUR' when 1 then 'USD' when 2 then 'GBP' when 3 then 'CHF'
      when 4 then 'EUR' when 5 then 'eur' else null end currency
from $orders left join $customer on o_custkey=c_custkey""",
    "v_lines": f"""
select l_orderkey doc_id,
 row_number() over (partition by l_orderkey {_LINE_ORDER}) ord,
 case when (l_orderkey*7+l_linenumber)%97=0 then null else p_name end name,
 case when (l_orderkey*5+l_linenumber)%89=0 then null else cast(l_extendedprice as decimal(18,2)) end amount
from $lineitem left join $part on l_partkey=p_partkey""",
    "v_docs": """
select doc_id, '/in/'||source||'/'||cast(doc_id as string)||case doc_id%5 when 0 then '.PDF'
   when 1 then '.pdf' when 2 then '.jpg' when 3 then '.jpeg' else '.png' end source_path,
 case when doc_id%7=0 then '89504E47' when doc_id%7<4 then '255044462D' else 'FFD8FF' end magic_hex,
 n_chars*20000 byte_len, n_chars%260 page_count, (n_chars*7)%9000 width, (n_chars*3)%9000 height
from $documents""",
    "v_doctext": "select doc_id, lang, text s from $documents",
    "v_pages": """
select conv_id doc_id, turn+1 page_number,
 case when (conv_id+turn)%11=0 then 'A'||repeat(' ',30)||'B'
      when (conv_id+turn)%6=0 then substr(text,1,21) else text end text_layer,
 'OCR '||text ocr_text, (conv_id*7+turn)%100/100.0 ocr_confidence
from $conversations""",
    "v_words": f"""
select l_orderkey doc_id, 1 page_number,
 row_number() over (partition by l_orderkey {_LINE_ORDER}) idx,
 l_linenumber%2 block, 0 par, l_partkey%3 line,
 case when l_partkey%13=0 then ' ' else p_name end word,
 case when l_partkey%10=0 then -1.0 else l_quantity end conf
from $lineitem left join $part on l_partkey=p_partkey""",
    "v_boxes": f"""
select l_orderkey doc_id, 1 page_number,
 row_number() over (partition by l_orderkey {_LINE_ORDER}) idx,
 p_name text, l_quantity conf, cast(l_suppkey%10 as double) x, cast(l_partkey%20 as double) y,
 cast(2 as double) w, cast(1+l_linenumber%3 as double) h
from $lineitem left join $part on l_partkey=p_partkey""",
    "v_attach": f"""
select o_orderkey doc_id, r revision_no,
 case (o_orderkey+r)%4 when 0 then 'factur-x.xml' when 1 then 'Factur-X.XML'
      when 2 then 'xrechnung.xml' else 'notes.txt' end attachment_name,
 case when (o_orderkey+r)%11=0 then '' when o_orderkey%3=0
      then 'inv '||cast(o_orderkey as string)||'/'||cast(r as string)
      else 'inv '||cast(o_orderkey as string) end content
from $orders join ({_REVISIONS}) k on o_orderkey%7 = m""",
    # Known names only, with enough equal revisions to pass the per-name bound.
    "v_revisions": f"""
select o_orderkey doc_id, r revision_no,
 case when o_orderkey%5=0 then 'factur-x.xml' when r%2=0 then 'xrechnung.xml'
      else 'XRechnung.xml' end attachment_name,
 case when o_orderkey%4=0 then '' else 'inv '||cast(o_orderkey as string) end content
from $orders join ({_REVISIONS}) k on o_orderkey%7 = m""",
    "v_calls": """
select o_orderkey doc_id, 'extraction' phase, 0 attempt,
 case when o_orderkey%37=0 then 'length' else 'stop' end finish_reason,
 case when o_orderkey%41=0 then '{"seller": ' when o_orderkey%43=0 then '[1]' else
  case when o_orderkey%5=0 then '```json'||chr(10) else '' end
  ||'{"invoice_date": "'||cast(cast(o_orderdate as date) as string)||'", "seller": '
  ||case when o_orderkey%9=0 then '["bad"]' when o_orderkey%10=0 then 'null' else '"'||c_name||'"' end
  ||', "gross_total": '||case when o_orderkey%8=0 then '"not-a-number"' when o_orderkey%12=1 then '-5'
     else '"'||cast(cast(o_totalprice as decimal(18,2)) as string)||'"' end
  ||', "currency": '||case o_orderkey%6 when 0 then '"EUR"' when 1 then '"eur"' when 2 then 'null'
     when 3 then '5' else '"USD"' end
  ||', "language": '||case when o_orderkey%15=0 then 'null' else '"en"' end||', "warnings": ["x"]}'
  ||case when o_orderkey%5=0 then chr(10)||'```' when o_orderkey%47=0 then ' trailing' else '' end end response
from $orders left join $customer on o_custkey=c_custkey""",
    # Second answers for the same documents: narrow, full, broken and missing ones.
    "v_repairs": """
select o_orderkey doc_id, 'extraction' phase, 1 attempt,
 case when o_orderkey%14=0 then cast(null as string) when o_orderkey%13=0 then '{"seller"'
  when o_orderkey%11=0 then '[]' else
  '{"seller": '||case when o_orderkey%4=0 then 'null' else '"Second '||c_name||'"' end
  ||', "gross_total": '||case when o_orderkey%3=0 then '"12.50"' else '"x"' end
  ||', "currency": "CHF", "invoice_date": "2001-02-03", "product_summary": '
  ||case when o_orderkey%2=0 then '"Cable"' else '"  "' end||'}' end response,
 case when o_orderkey%14=0 then 'scorer stopped' end error
from $orders left join $customer on o_custkey=c_custkey""",
    "v_short": """
select o_orderkey doc_id,
 case when o_orderkey%16=0 then 'no json' when o_orderkey%16=1 then '{"seller_short": 5}' else
 '{"seller_short": '||case when o_orderkey%4=0 then '"  "' when o_orderkey%4=1 then 'null'
    else '"'||substr(c_name,1,8)||'"' end
 ||', "product_short": '||case when o_orderkey%3=0 then '"Item"' else 'null' end||'}' end response
from $orders left join $customer on o_custkey=c_custkey""",
    "v_labels": """
select doc_id, 'seller' field, case when doc_id%6=1 then null else seller end expected
from (select o_orderkey doc_id, c_name seller from $orders join $customer on o_custkey=c_custkey) a
where doc_id%3<>0
union all
select o_orderkey, 'gross_total', case when o_orderkey%8=2 then null
   else cast(cast(o_totalprice as decimal(18,2)) as string) end from $orders where o_orderkey%4<>0""",
    "v_eval": _scorer("a", 7) + "\nunion all" + _scorer("b", 11),
    "v_runs": """
select o_orderkey doc_id, o_orderkey%500-2 total_ms, o_orderkey%9 pages_total, (o_orderkey*3)%10 ocr_page,
 o_orderkey%3=0 inference_ran,
 case o_orderkey%3 when 0 then 'model' when 1 then 'xml' else 'xml_and_model' end extraction_source,
 case o_orderkey%5 when 0 then 'none' when 1 then 'supported' when 2 then 'unsupported'
      when 3 then 'invalid' else 'ambiguous' end xml_status,
 case when o_orderkey%4=0 then 'urn:x' end xml_profile_id, o_orderkey%6 n_xml_fields,
 case when o_orderkey%17=0 then -1 else o_orderkey%90 end input_tokens,
 case when o_orderkey%19=0 then -0.5 when o_orderkey%2=0 then o_orderkey%50/2.0 end tokens_per_second
from $orders""",
    "v_items": """
select o_orderkey item_id, o_custkey batch_id,
 case o_orderkey%8 when 0 then 'pending' when 1 then 'queued' when 2 then 'running'
   when 3 then 'needs_review' when 4 then 'approved' when 5 then 'failed' when 6 then 'cancelled'
   else 'needs_review' end status,
 o_orderkey%3 n_warnings, o_orderkey%4=0 missing, 'in'||cast(o_orderkey as string)||'.pdf' file_name,
 case when o_orderkey%2=0 then 'p'||cast(o_orderkey as string)||'.pdf' end proposed,
 case when o_orderkey%9=0 then 'e.pdf' end edited, o_orderkey%16=4 renamed
from $orders""",
    "v_rename": """
select 'b'||cast(o_custkey%10 as string) batch_id, o_orderkey ordinal,
 'r'||cast(o_orderkey as string) request_id,
 '/d'||cast(o_custkey%50 as string) dir, 's'||cast(o_orderkey as string)||'.pdf' source_name,
 case when o_orderkey%71=0 then 'n (1).pdf' when o_orderkey%73=0 then '.hidden'
      else 'n'||cast(o_orderkey%4 as string)||'.pdf' end desired_filename,
 o_orderkey%6=0 on_disk
from $orders""",
    # Requests whose names run into each other's numbering, and own-name requests.
    "v_clash": """
select 'b'||cast(o_custkey%50 as string) batch_id, o_orderkey ordinal,
 'r'||cast(o_orderkey as string) request_id, '/c'||cast(o_custkey%200 as string) dir,
 case when o_orderkey%29=0 then 'n ('||cast(o_orderkey%9+1 as string)||').pdf'
      else 's'||cast(o_orderkey as string)||'.pdf' end source_name,
 case when o_orderkey%13=0 then 'n ('||cast(o_orderkey%5+1 as string)||').pdf'
      when o_orderkey%31=0 then 'n (2) (1).pdf' when o_orderkey%37=0 then 'n (2) ('||cast(o_orderkey%3+2 as string)||').pdf'
      else 'n.pdf' end desired_filename,
 o_orderkey%11=0 on_disk
from $orders""",
    "v_jobs": """
select user_id item_id, event_id seq, ts, user_id%7 batch_id,
 case event_type when 'signup' then 'queued' when 'view' then 'running' when 'purchase' then 'completed'
   when 'error' then 'failed' else 'cancel_requested' end status,
 sum(case when event_type='signup' then 1 else 0 end)
   over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) generation,
 cast(floor(value*100000) as bigint) bytes
from $events""",
    "v_mem": """
select user_id host_id, event_id seq, ts, event_type<>'error' ok, 16000 total_mb,
 cast(floor(value*10) as bigint)%16000 available_mb,
 case when event_id%3=0 then 'm'||cast(event_id%5 as string) end loaded_entry_id
from $events""",
    "v_timing": """
select user_id config_id, row_number() over (partition by user_id order by ts, event_id) run_no,
 value total, case when event_id%5=0 then null else value/2 end entry from $events""",
    # Host and artefact pairs that occur together in the line items.
    "v_fleet": """
select host_id, s_suppkey%5*8 memory_gb, abs(s_acctbal)/100 free_disk_gb, model_id,
 case p_partkey%3 when 0 then 'small' when 1 then 'medium' else 'large' end memory_tier,
 p_retailprice/50 size_gb, (s_suppkey+p_partkey)%6=0 installed
from (select distinct l_suppkey host_id, l_partkey model_id from $lineitem) pairs
join $supplier on s_suppkey=host_id join $part on p_partkey=model_id""",
    "v_manifest": """
select p_partkey%20 model_id, p_name||cast(p_partkey as string) path, p_size expected_size,
 digest expected_digest,
 case when p_partkey%9=0 then null when p_partkey%11=0 then p_size+1 else p_size end observed_size,
 case when p_partkey%9=0 then null when p_partkey%13=0 then 'bad' else digest end observed_digest
from (select p_partkey, p_name, p_size, md5(p_name) digest from $part) t""",
}


def _listing(view: str) -> str:
    """Names on disk: the sources, some desired names, some generated ones."""
    rows = VIEWS[view]
    return f"""
select dir, source_name name from ({rows}) a
union select dir, desired_filename from ({rows}) b where on_disk
union select dir, replace(desired_filename,'.pdf',' ('||cast(ordinal%7 as string)||').pdf') from ({rows}) c where ordinal%30=0"""


# Folders in which all files carry numbers of one name, asked for again in mixed order.
_QUARTERS = " union all ".join(f"select {q} q" for q in range(4))
VIEWS["v_numbered"] = f"""
select 'b' batch_id, ((o_orderkey*4+q)*387420489)%1000000007 ordinal, 'r'||cast(o_orderkey*4+q as string) request_id,
 '/n'||cast(o_custkey%3 as string) dir, o_orderkey*4+q+1 own, 'n ('||cast(o_orderkey*4+q+1 as string)||').pdf' source_name,
 'n.pdf' desired_filename
from $orders join ({_QUARTERS}) k on true"""
VIEWS["v_rename_files"] = _listing("v_rename")
VIEWS["v_clash_files"] = _listing("v_clash")

# Applied renames, one batch per customer, some of them undone since.
VIEWS["v_history"] = """
select 'u'||cast(o_custkey as string) batch_id, o_custkey seq, o_orderdate applied_at,
 '/h'||cast(o_custkey%50 as string) dir, 's'||cast(o_orderkey as string)||'.pdf' source_name,
 't'||cast(o_orderkey as string)||'.pdf' destination_name, 'i'||cast(o_orderkey as string) identity,
 o_orderkey ordinal, o_orderkey%5=0 undone from $orders"""
# The folders now: most renamed files in place, some gone, replaced or blocked.
VIEWS["v_history_files"] = f"""
select dir, destination_name name, case when ordinal%103=0 then 'other' else identity end identity
from ({VIEWS['v_history']}) a where ordinal%101<>0
union all select dir, source_name, 'new' from ({VIEWS['v_history']}) b where ordinal%107=0"""


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(Template(VIEWS[name]).substitute(tables))


def oracle(body: str, *views: str) -> str:
    """A DuckDB query: the named views as CTEs, then ``body``.

    ``body`` may itself start with ``, name as (...)`` to add more CTEs.
    """
    tables = {t: t for t in TABLES}
    ctes = ",\n".join(f"{v} as ({Template(VIEWS[v]).substitute(tables)})" for v in views)
    return f"with {ctes}\n{body}" if ctes else body


# ---- invoice XML ----------------------------------------------------------

# The namespaces and profile of a cross-industry invoice.
RSM = "urn:un:unece:uncefact:data:standard:CrossIndustryInvoice:100"
RAM = "urn:un:unece:uncefact:data:standard:ReusableAggregateBusinessInformationEntity:100"
UDT = "urn:un:unece:uncefact:data:standard:UnqualifiedDataType:100"
PROFILE = "urn:cen.eu:en16931:2017"


def _tag(name: str, body, attributes: str = ""):
    """``<name>body</name>``; null when the body is null, so absent stays absent."""
    opened = F.lit(f"<{name}{attributes}>")
    return F.concat(opened, body, F.lit(f"</{name}>"))


def _escaped(text):
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice XML per V_HEAD row, with planted conflicts and odd dates."""
    head, lines = spark_view(spark, sf_dir, "v_head"), spark_view(spark, sf_dir, "v_lines")
    blank = F.lit("")

    def opt(column):
        return F.coalesce(column, blank)

    item = _tag(
        "ram:IncludedSupplyChainTradeLineItem",
        F.concat(
            _tag("ram:SpecifiedTradeProduct", opt(_tag("ram:Name", _escaped(F.col("name"))))),
            _tag(
                "ram:SpecifiedLineTradeSettlement",
                _tag(
                    "ram:SpecifiedTradeSettlementLineMonetarySummation",
                    opt(_tag("ram:LineTotalAmount", F.col("amount").cast("string"))),
                ),
            ),
        ),
    )
    items = (
        lines.select("doc_id", "ord", item.alias("item"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "item"))).alias("items"))
        .select("doc_id", F.array_join(F.col("items.item"), "").alias("items_xml"))
    )
    doc_id = F.col("doc_id")
    date_text = F.date_format("invoice_date", "yyyyMMdd")
    date_tag = F.when(
        doc_id % 103 == 0, _tag("udt:DateTimeString", date_text, ' format="610"')
    ).otherwise(_tag("udt:DateTimeString", date_text, ' format="102"'))
    seller_tag = _tag("ram:Name", _escaped(F.col("seller")))
    sellers = F.when(doc_id % 101 == 0, F.concat(seller_tag, _tag("ram:Name", F.lit("Other")))).otherwise(
        seller_tag
    )
    xml = F.concat(
        F.lit(
            '<?xml version="1.0" encoding="UTF-8"?>\n'
            f'<rsm:CrossIndustryInvoice xmlns:rsm="{RSM}" xmlns:ram="{RAM}" xmlns:udt="{UDT}">'
        ),
        _tag(
            "rsm:ExchangedDocumentContext",
            _tag(
                "ram:GuidelineSpecifiedDocumentContextParameter",
                _tag("ram:ID", F.lit(PROFILE)),
            ),
        ),
        _tag("rsm:ExchangedDocument", _tag("ram:IssueDateTime", opt(date_tag))),
        _tag(
            "rsm:SupplyChainTradeTransaction",
            F.concat(
                opt(F.col("items_xml")),
                _tag(
                    "ram:ApplicableHeaderTradeAgreement",
                    _tag("ram:SellerTradeParty", opt(sellers)),
                ),
                _tag(
                    "ram:ApplicableHeaderTradeSettlement",
                    F.concat(
                        opt(_tag("ram:InvoiceCurrencyCode", F.col("currency"))),
                        _tag(
                            "ram:SpecifiedTradeSettlementHeaderMonetarySummation",
                            opt(_tag("ram:GrandTotalAmount", F.col("gross_total").cast("string"))),
                        ),
                    ),
                ),
            ),
        ),
        F.lit("</rsm:CrossIndustryInvoice>"),
    )
    return head.join(items, "doc_id", "left").select("doc_id", xml.alias("xml"))
