"""Every document gets its one prompt from one pass over attachments and calls."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom.functions.stages import settle
from fieldloom.operators import pages as page_ops
from fieldloom.operators import prompts
from fieldloom.operators.line_items import rank_array
from fieldloom.plans import analysis

GOOD = '{"invoice_date": "2024-01-02", "seller": "A", "product_summary": "P", "gross_total": "5", "currency": "EUR", "language": "en"}'
PART = '{"seller": "A", "gross_total": "x"}'
CALLS = {
    1: [],
    2: [("extraction", 0, GOOD, None)],
    3: [("extraction", 0, PART, None)],
    4: [("extraction", 0, "{", None)],
    5: [("extraction", 0, None, "down")],
    6: [("extraction", 0, GOOD, None), ("shortening", 0, "{}", None)],
    7: [("extraction", 0, GOOD, None), ("shortening", 9, None, None)],
    8: [("extraction", 0, '{"currency": "EUR"}', None), ("extraction", 1, "[]", None)],
    9: [("extraction", 0, PART, None), ("extraction", 1, '{"gross_total": "7"}', None)],
    10: [("extraction", 0, "{", None), ("extraction", 1, GOOD, None), ("review", 0, "{}", None)],
    11: [("extraction", 0, "{}", None), ("extraction", 1, "{}", None), ("extraction", 2, "{}", None)],
}


@pytest.fixture(scope="module")
def inputs(spark):
    # Each set of calls with and without XML, as document and as image, shortened or not.
    kinds = spark.createDataFrame(
        [(0, ".pdf", True, "a"), (100, ".pdf", False, "a"), (200, ".JPG", True, "a"), (300, ".pdf", None, "b"), (400, ".pdf", True, "b")],
        "base long, extension string, shorten boolean, kind string",
    )
    cases = spark.createDataFrame([(i,) for i in CALLS], "case long")
    documents = cases.crossJoin(kinds).withColumn("doc_id", F.col("base") + F.col("case"))
    whole = analysis_xml()
    attachments = documents.where("kind = 'b'").select(
        "doc_id",
        F.lit("factur-x.xml").alias("attachment_name"),
        F.lit(0).alias("revision_no"),
        F.when(F.col("base") == 400, F.lit(whole)).otherwise(F.lit(whole.replace(">EUR<", ">EURO<"))).cast("binary").alias("content"),
    )
    calls = spark.createDataFrame(
        [(i, *c) for i, made in CALLS.items() for c in made], "case long, phase string, attempt int, response string, error string"
    ).crossJoin(kinds).select(
        (F.col("base") + F.col("case")).alias("doc_id"), "phase", "attempt", "response", "error", F.lit("stop").alias("finish_reason")
    )
    read = documents.where("case % 2 = 0").selectExpr(
        "doc_id", "explode(array(2, 1)) page_number", "'text' text", "false needs_ocr", "0.5d ocr_confidence"
    )
    return documents.select("doc_id", "extension", "shorten"), attachments, calls, read


def analysis_xml() -> str:
    from fieldloom.catalog.views import PROFILE, RAM, RSM, UDT

    return (
        f'<rsm:CrossIndustryInvoice xmlns:rsm="{RSM}" xmlns:ram="{RAM}" xmlns:udt="{UDT}"><rsm:ExchangedDocumentContext>'
        f"<ram:GuidelineSpecifiedDocumentContextParameter><ram:ID>{PROFILE}</ram:ID></ram:GuidelineSpecifiedDocumentContextParameter>"
        '</rsm:ExchangedDocumentContext><rsm:ExchangedDocument><ram:IssueDateTime><udt:DateTimeString format="102">20240102'
        "</udt:DateTimeString></ram:IssueDateTime></rsm:ExchangedDocument><rsm:SupplyChainTradeTransaction>"
        "<ram:IncludedSupplyChainTradeLineItem><ram:SpecifiedTradeProduct><ram:Name>Pipe</ram:Name></ram:SpecifiedTradeProduct>"
        "</ram:IncludedSupplyChainTradeLineItem><ram:ApplicableHeaderTradeAgreement><ram:SellerTradeParty><ram:Name>Shop</ram:Name>"
        "</ram:SellerTradeParty></ram:ApplicableHeaderTradeAgreement><ram:ApplicableHeaderTradeSettlement><ram:InvoiceCurrencyCode>EUR"
        "</ram:InvoiceCurrencyCode><ram:SpecifiedTradeSettlementHeaderMonetarySummation><ram:GrandTotalAmount>5"
        "</ram:GrandTotalAmount></ram:SpecifiedTradeSettlementHeaderMonetarySummation></ram:ApplicableHeaderTradeSettlement>"
        "</rsm:SupplyChainTradeTransaction></rsm:CrossIndustryInvoice>"
    )


def apart(documents, attachments, calls, pages, repairs, short):
    """Extraction and shortening prompts, each from its own analysis."""
    routed = analysis._route(analysis.gather(documents, attachments, calls, repairs, short))
    waiting = analysis._resolved(routed.where(~F.col("complete")), repairs).where("crashed is null and mode <> 'done'")
    read = waiting.join(page_ops.assemble_pages(pages).select("doc_id", "pages"), "doc_id", "left")
    none = F.expr("cast(array() as array<struct<page_number: int, text: string, needs_ocr: boolean, ocr_confidence: double>>)")
    extraction = prompts.pending_prompts(read.withColumn("pages", F.coalesce("pages", none)))
    return extraction.unionByName(
        prompts.pending_shortening(analysis.analyse(documents, attachments, calls, repairs, short), calls)
    )


@pytest.mark.parametrize("repairs, short", [(1, 0), (2, 1)])
def test_one_pass_gives_the_prompts_of_both_phases(inputs, repairs, short):
    told = analysis.next_prompts(*inputs, repairs, short)
    expected = apart(*inputs, repairs, short)
    assert told.dtypes == expected.dtypes
    got = sorted(map(tuple, told.collect()))
    assert got == sorted(map(tuple, expected.collect()))
    assert {phase for _, phase, _, _ in got} == {"extraction", "shortening"} and len({row[0] for row in got}) == len(got)
    assert {attempt for _, phase, attempt, _ in got if phase == "extraction"} == set(range(repairs + 1))
    # 401 to 411 have whole XML; all but the two with a shortening call are to be shortened.
    assert [row[0] for row in got if row[0] > 400] == [i for i in range(401, 412) if i not in (406, 407)]


def test_attachments_and_calls_are_read_once(inputs):
    plan = analysis.next_prompts(*inputs, 1, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "Union" not in plan


def test_settled_columns_are_computed_below_their_generator(spark):
    rows = settle(spark.range(3).withColumn("text", F.concat(F.lit("n"), "id")), {"text": F.upper("text"), "double": F.col("id") * 2})
    assert [tuple(r) for r in rows.where("text <> 'N1'").orderBy("id").collect()] == [(0, "N0", 0), (2, "N2", 4)]
    made = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
    assert len(made) == 1 and "upper" not in made[0]


def test_items_are_ranked_without_an_interpreted_comparison(spark):
    listed = ((1, "x", 5), (2, "y", None), (3, "z", 7), (4, "w", 7))
    items = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(a).cast("decimal(38,10)").alias("amount")) for i, n, a in listed]
    ranked = spark.range(1).select(F.array(*items).alias("items")).select(rank_array(F.col("items")).alias("r"))
    assert [t.name for t in ranked.first().r.top] == ["z", "w"]
    assert "array_sort" not in ranked._jdf.queryExecution().analyzed().toString()
