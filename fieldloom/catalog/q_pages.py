"""Queries over pages, recognised words and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.catalog.views import oracle, spark_view
from fieldloom.operators import ocr_layout, pages

_WS = "chr(32)||chr(9)||chr(10)||chr(13)"
ROUTED_SQL = f"""
routed as (
  select doc_id, page_number, needs_ocr,
    case when needs_ocr then ocr_text else trim(text_layer, {_WS}) end page_text,
    case when needs_ocr then ocr_confidence end ocr_confidence
  from (select *, length(regexp_replace(text_layer,'\\s','','g'))<20 needs_ocr from v_pages))"""


def routed_pages(spark, sf_dir):
    return pages.route_pages(spark_view(spark, sf_dir, "v_pages"))


@query(
    "flt1_sparse_pages",
    "FLT-1",
    oracle(f", {ROUTED_SQL} select doc_id, page_number, needs_ocr, page_text from routed", "v_pages"),
)
def sparse_pages(spark, sf_dir):
    return routed_pages(spark, sf_dir).select(
        "doc_id", "page_number", "needs_ocr", F.col("text").alias("page_text")
    )


@query(
    "src4_page_assembly",
    "SRC-4",
    oracle(
        f""", {ROUTED_SQL}
select doc_id, string_agg(cast(page_number as varchar)||':'||cast(needs_ocr as varchar)||':'
   ||coalesce(cast(cast(round(ocr_confidence*100) as bigint) as varchar),'-')||':'||page_text, '|' order by page_number) pages_flat,
 count(*) pages_total from routed group by doc_id""",
        "v_pages",
    ),
)
def page_assembly(spark, sf_dir):
    documents = pages.assemble_pages(routed_pages(spark, sf_dir))
    flat = F.transform(
        "pages",
        lambda p: F.concat_ws(
            ":",
            p["page_number"].cast("string"),
            p["needs_ocr"].cast("string"),
            F.coalesce(F.round(p["ocr_confidence"] * 100).cast("bigint").cast("string"), F.lit("-")),
            p["text"],
        ),
    )
    return documents.select("doc_id", F.array_join(flat, "|").alias("pages_flat"), "pages_total")


@query(
    "agg2_page_counters",
    "AGG-2",
    oracle(
        f""", {ROUTED_SQL}
select doc_id, count(*) pages_total,
  coalesce(string_agg(case when needs_ocr then cast(page_number as varchar) end, ',' order by page_number),'') pages_ocr
from routed group by doc_id""",
        "v_pages",
    ),
)
def page_counters(spark, sf_dir):
    return pages.assemble_pages(routed_pages(spark, sf_dir)).select(
        "doc_id", "pages_total", F.array_join("pages_ocr", ",").alias("pages_ocr")
    )


@query(
    "str11_page_text_block",
    "STR-11",
    oracle(
        f""", {ROUTED_SQL}
select doc_id, string_agg('--- Page '||cast(page_number as varchar)||' ---'||chr(10)||page_text,
   chr(10)||chr(10) order by page_number) block from routed group by doc_id""",
        "v_pages",
    ),
)
def page_text_block(spark, sf_dir):
    documents = pages.assemble_pages(routed_pages(spark, sf_dir))
    return documents.select("doc_id", pages.pages_block(F.col("pages")).alias("block"))


@query(
    "agg1_words_to_pages",
    "AGG-1",
    oracle(
        """, spoken as (select * from v_words where trim(word)<>''),
lines as (select doc_id, block, par, line, min(idx) first_idx, string_agg(word,' ' order by idx) line_text
  from spoken group by all),
texts as (select doc_id, string_agg(line_text, chr(10) order by first_idx) page_text from lines group by doc_id),
scores as (select doc_id, round(avg(case when conf>=0 then conf end)/100,9) confidence from spoken group by doc_id)
select doc_id, page_text, confidence from texts join scores using (doc_id)""",
        "v_words",
    ),
)
def words_to_pages(spark, sf_dir):
    return ocr_layout.words_to_pages(spark_view(spark, sf_dir, "v_words")).select(
        "doc_id", F.col("text").alias("page_text"), F.round("confidence", 9).alias("confidence")
    )


@query(
    "win6_visual_rows",
    "WIN-6",
    "with recursive "
    + oracle(
        """, ordered as (
  select doc_id, row_number() over (partition by doc_id order by y+h/2 desc, idx) n, text box_text, conf, x, h, y+h/2 centre
  from v_boxes),
walk as (
  select doc_id, n, box_text, conf, x, centre ref_centre, h ref_h, 1 row_no from ordered where n=1
  union all
  select o.doc_id, o.n, o.box_text, o.conf, o.x,
    case when abs(o.centre-w.ref_centre)<=0.5*greatest(o.h,w.ref_h) then w.ref_centre else o.centre end,
    case when abs(o.centre-w.ref_centre)<=0.5*greatest(o.h,w.ref_h) then w.ref_h else o.h end,
    case when abs(o.centre-w.ref_centre)<=0.5*greatest(o.h,w.ref_h) then w.row_no else w.row_no+1 end
  from walk w join ordered o on o.doc_id=w.doc_id and o.n=w.n+1),
rows_text as (select doc_id, row_no, string_agg(box_text,' ' order by x, n) row_text from walk group by all)
select doc_id, string_agg(row_text, chr(10) order by row_no) page_text,
  (select round(avg(conf),9) from v_boxes b where b.doc_id=r.doc_id) confidence
from rows_text r group by doc_id""",
        "v_boxes",
    )[len("with ") :],
)
def visual_rows(spark, sf_dir):
    return ocr_layout.boxes_to_pages(spark_view(spark, sf_dir, "v_boxes")).select(
        "doc_id", F.col("text").alias("page_text"), F.round("confidence", 9).alias("confidence")
    )
