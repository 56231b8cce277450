"""Queries over headers and line items: text functions, names, product summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.catalog.views import oracle, spark_view
from fieldloom.functions import text, values
from fieldloom.operators import line_items, naming

# ---- oracle fragments shared by several modules ----------------------------

PRODUCTS_SQL = """
ranked as (
  select *, row_number() over (partition by doc_id order by amount desc nulls last, ord) rank from v_lines),
products as (
  select doc_id, count(*) n_items, count(*) - count(name) n_unnamed, count(*) - count(amount) n_unpriced,
    max(case when rank=1 then name end) name1, max(case when rank=1 then amount end) amount1,
    max(case when rank=2 then name end) name2, max(case when rank=2 then amount end) amount2
  from ranked group by doc_id),
summaries as (
  select doc_id, n_items,
    case when n_items=1 then name1
         when n_unnamed>0 or n_unpriced>0 then null
         when amount1>0 and amount1>=2*amount2 then name1
         when length(name1||' + '||name2)<=500 then name1||' + '||name2 end product_summary,
    case when n_items<=1 then null
         when n_unnamed>0 then 'product_summary: multiple XML line items include one with no usable name; falling back to AI extraction'
         when n_unpriced>0 then 'product_summary: multiple XML line items include one with no usable amount; falling back to AI extraction'
         when not (amount1>0 and amount1>=2*amount2) and length(name1||' + '||name2)>500
           then 'product_summary: combined top line items exceed 500 characters; falling back to AI extraction'
         end product_warning
  from products)"""


def segment_sql(column: str) -> str:
    spelled = column
    for letter, spelling in text.GERMAN_SPELLINGS.items():
        spelled = f"replace({spelled},'{letter}','{spelling}')"
    folded = f"regexp_replace(strip_accents({spelled}),'[^\\x00-\\x7F]','','g')"
    glued = f"regexp_replace(trim({folded}, chr(32)||chr(9)||chr(10)||chr(13)),'\\s+','-','g')"
    kept = f"regexp_replace({glued},'[^A-Za-z0-9_-]','','g')"
    return f"nullif(trim(regexp_replace({kept},'-{{2,}}','-','g'),'-'),'')"


def naming_sql(source: str, product: str = "product_summary", seller: str = "seller") -> str:
    """Two CTEs, parts and named, over ``source``."""
    return f"""
parts as (
  select *, {segment_sql(seller)} seller_seg, {segment_sql(product)} product_seg from {source}),
pieces as (
  select *, '_'||coalesce(cast(cast(round(gross_total,0) as decimal(38,0)) as varchar),'0')||'-'||coalesce(currency,'XXX') suffix,
    coalesce(strftime(invoice_date,'%Y-%m-%d'),'0000-00-00')||'_'||coalesce(seller_seg,'Unknown')||'_'||coalesce(product_seg,'Unknown') prefix,
    11+length(coalesce(seller_seg,'Unknown')) seller_end from parts),
named as (
  select *, greatest(0,150-length(suffix)) budget,
    case when length(prefix)>greatest(0,150-length(suffix))
      then regexp_replace(left(prefix,greatest(0,150-length(suffix))),'[_-]+$','') else prefix end||suffix||'.pdf' proposed_filename,
    concat_ws(',', case when invoice_date is null then 'date' end, case when seller_seg is null then 'seller' end,
      case when product_seg is null then 'product' end, case when gross_total is null then 'amount' end,
      case when currency is null then 'currency' end) missing_fields,
    case when length(prefix)>greatest(0,150-length(suffix)) then
      case when greatest(0,150-length(suffix))>=seller_end then 'product'
           when greatest(0,150-length(suffix))>=10 then 'seller/product' else 'date/seller/product' end
      ||' truncated to fit the 150-character filename limit' else '' end naming_warnings
  from pieces)"""


def joined(column: str, glue: str = ","):
    return F.array_join(F.col(column), glue)


@query(
    "name1_proposed_filenames",
    "NAME-1 NAME-2 FLT-5 STR-3 DATE-2 NUM-2 ARR-1",
    oracle(
        f""", {PRODUCTS_SQL},
extracted as (
  select h.*, s.product_summary, s.product_warning from v_head h left join summaries s using (doc_id)),
{naming_sql('extracted')}
select doc_id, proposed_filename, missing_fields, naming_warnings,
  (missing_fields<>'' or naming_warnings<>'' or product_warning is not null) requires_review from named""",
        "v_head",
        "v_lines",
    ),
)
def proposed_filenames(spark, sf_dir):
    head = spark_view(spark, sf_dir, "v_head")
    products = line_items.summarize_products(spark_view(spark, sf_dir, "v_lines"))
    extracted = head.join(products, "doc_id", "left").withColumn(
        "warnings", F.array_compact(F.array("product_warning"))
    )
    return naming.propose_filenames(extracted).select(
        "doc_id",
        "proposed_filename",
        joined("missing_fields").alias("missing_fields"),
        joined("naming_warnings").alias("naming_warnings"),
        "requires_review",
    )


@query(
    "win1_dominant_product",
    "WIN-1",
    oracle(f", {PRODUCTS_SQL} select doc_id, n_items, product_summary, product_warning from summaries", "v_lines"),
)
def dominant_product(spark, sf_dir):
    return line_items.summarize_products(spark_view(spark, sf_dir, "v_lines"))


@query(
    "sort3_top_items",
    "SORT-3",
    oracle(
        """select doc_id, ord, name, cast(amount as double) amount, rank from (
  select *, row_number() over (partition by doc_id order by amount desc nulls last, ord) rank from v_lines)
where rank<=2""",
        "v_lines",
    ),
)
def top_items(spark, sf_dir):
    return line_items.top_items(spark_view(spark, sf_dir, "v_lines")).select(
        "doc_id",
        F.col("ord").cast("bigint").alias("ord"),
        "name",
        F.col("amount").cast("double").alias("amount"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "str1_german_spelling",
    "STR-1",
    oracle(
        "select doc_id, replace(replace(replace(replace(replace(replace(replace(s,'ä','ae'),'ö','oe'),"
        "'ü','ue'),'ß','ss'),'Ä','Ae'),'Ö','Oe'),'Ü','Ue') spelled from v_doctext",
        "v_doctext",
    ),
)
def german_spelling(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_doctext").select(
        "doc_id", text.spell_german(F.col("s")).alias("spelled")
    )


@query(
    "str2_ascii_fold",
    "STR-2",
    oracle(
        "select doc_id, regexp_replace(strip_accents(s),'[^\\x00-\\x7F]','','g') folded from v_doctext",
        "v_doctext",
    ),
)
def ascii_fold(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_doctext").select(
        "doc_id", text.ascii_fold(F.col("s")).alias("folded")
    )


@query(
    "str3_filename_segment",
    "STR-3",
    oracle(
        f"select doc_id, coalesce({segment_sql('s')},'Unknown') segment, {segment_sql('s')} is null missing from v_doctext",
        "v_doctext",
    ),
)
def filename_segment(spark, sf_dir):
    segments = spark_view(spark, sf_dir, "v_doctext").select(
        "doc_id", text.filename_segment(F.col("s")).alias("seg")
    )
    return segments.select(
        "doc_id",
        F.when(F.col("seg") == "", F.lit(text.MISSING_SEGMENT)).otherwise(F.col("seg")).alias("segment"),
        (F.col("seg") == "").alias("missing"),
    )


@query(
    "date2_date_or_placeholder",
    "DATE-2",
    oracle(
        "select doc_id, coalesce(strftime(invoice_date,'%Y-%m-%d'),'0000-00-00') date_part, invoice_date is null missing from v_head",
        "v_head",
    ),
)
def date_part(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_head").select(
        "doc_id",
        values.date_or_placeholder(F.col("invoice_date")).alias("date_part"),
        F.col("invoice_date").isNull().alias("missing"),
    )


@query(
    "num1_bounded_decimal",
    "NUM-1",
    oracle(
        """, raw as (select doc_id, case doc_id%5 when 0 then '1e3' when 1 then cast(gross_total as varchar)
   when 2 then '-'||cast(gross_total as varchar) when 3 then repeat('9',18+cast(doc_id%20 as int)) else cast(gross_total as varchar)||'.' end t from v_head)
select doc_id, case when length(t)<=32 and regexp_full_match(t,'-?[0-9]+(\\.[0-9]+)?')
   and abs(try_cast(t as decimal(38,4)))<=999999999999999999
   then cast(try_cast(t as decimal(38,4)) as double) end amount from raw""",
        "v_head",
    ),
)
def bounded_decimal(spark, sf_dir):
    raw = spark_view(spark, sf_dir, "v_head").selectExpr(
        "doc_id",
        """case doc_id%5 when 0 then '1e3' when 1 then cast(gross_total as string)
        when 2 then '-'||cast(gross_total as string) when 3 then repeat('9',18+cast(doc_id%20 as int))
        else cast(gross_total as string)||'.' end t""",
    )
    return raw.select("doc_id", values.bounded_decimal(F.col("t")).cast("double").alias("amount"))


@query(
    "num2_rounded_amount",
    "NUM-2",
    oracle(
        "select doc_id, coalesce(cast(cast(round(gross_total,0) as decimal(38,0)) as varchar),'0') amount_part, gross_total is null missing from v_head",
        "v_head",
    ),
)
def rounded_amount(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_head").select(
        "doc_id",
        F.coalesce(values.rounded_amount(F.col("gross_total")), F.lit("0")).alias("amount_part"),
        F.col("gross_total").isNull().alias("missing"),
    )


_CODES_SQL = "(" + ",".join(f"'{code}'" for code in values.CURRENCY_CODES) + ")"


@query(
    "join9_currency_check",
    "JOIN-9",
    oracle(
        f"select doc_id, currency, coalesce(regexp_full_match(currency,'[A-Z]{{3}}'),false) shaped, coalesce(currency in {_CODES_SQL},false) active from v_head",
        "v_head",
    ),
)
def currency_check(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_head").select(
        "doc_id",
        "currency",
        F.coalesce(values.is_currency_shape(F.col("currency")), F.lit(False)).alias("shaped"),
        values.is_currency(F.col("currency")).alias("active"),
    )


@query(
    "flt3_usable_values",
    "FLT-3",
    oracle(
        """select doc_id, coalesce(trim(case when doc_id%4=0 then chr(9)||' '||chr(10) else seller end, ' '||chr(9)||chr(10))<>'',false) seller_usable,
 case when doc_id%6=0 then 0 else gross_total end is not null total_usable from v_head""",
        "v_head",
    ),
)
def usable_values(spark, sf_dir):
    head = spark_view(spark, sf_dir, "v_head")
    seller = F.when(F.col("doc_id") % 4 == 0, F.lit("\t \n")).otherwise(F.col("seller"))
    total = F.when(F.col("doc_id") % 6 == 0, F.lit(0)).otherwise(F.col("gross_total"))
    return head.select(
        "doc_id", text.has_text(seller).alias("seller_usable"), total.isNotNull().alias("total_usable")
    )


@query(
    "str8_bounded_echo",
    "STR-8",
    oracle(
        "select doc_id, case when length(seller)>50 then left(seller,50)||'...' else seller end echo, case when length(seller)>5 then left(seller,5)||'...(truncated)' else seller end short_echo from v_head",
        "v_head",
    ),
)
def bounded_echo(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_head").select(
        "doc_id",
        text.bounded_echo(F.col("seller"), 50).alias("echo"),
        text.bounded_echo(F.col("seller"), 5, "...(truncated)").alias("short_echo"),
    )


@query(
    "str9_bounded_field",
    "STR-9",
    oracle(
        """, wide as (select doc_id, case when doc_id%7=0 then repeat(seller,30) else seller end t from v_head)
select doc_id, case when length(t)<=500 then t end value_kept,
 case when length(t)>500 then 'seller: XML value exceeds 500 characters; falling back to AI extraction' end warning from wide""",
        "v_head",
    ),
)
def bounded_field(spark, sf_dir):
    wide = spark_view(spark, sf_dir, "v_head").selectExpr(
        "doc_id", "case when doc_id%7=0 then repeat(seller,30) else seller end t"
    )
    return wide.select(
        "doc_id",
        text.bounded_value(F.col("t")).alias("value_kept"),
        text.bounded_warning(F.col("t"), "seller").alias("warning"),
    )
