"""Steps whose cost per row decides how far the queries reach."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from fieldloom.operators import own_numbers, rename

NAMES = [
    "n.pdf", "n (1).pdf", "n (01).pdf", "n (0).pdf", "n (2) (13).pdf", " (1).pdf", "n (1)", "(1).pdf", ".hidden",
    ".hidden (4)", "a.b (7).c", "n (1).", "n (1) .pdf", "n (9999999999999999999).pdf", "n\n (3).pdf", "ü (5).ä", "",
    ".", "..", "n (1)x.pdf", "n (1)\n.pdf", "x. (2)", "n  (8).p\n", None,
]


def by_pattern(name):
    if name is None:
        return None, None
    parts = re.search(r"(?s)^(.+)(\.[^.]*)\Z", name)
    stem, extension = parts.groups() if parts else (name, "")
    found = re.search(r"(?s)^(.+) \(([1-9][0-9]{0,17})\)\Z", stem)
    return (found[1] + extension, int(found[2])) if found else (None, None)


def test_numbers_of_names_without_scanning_patterns(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id long, name string")
    family, number = rename.numbered(F.col("name"))
    told = rows.select("id", family.alias("family"), number.alias("number"))
    assert [(r.family, r.number) for r in told.orderBy("id").collect()] == [by_pattern(n) for n in NAMES]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan


def test_numbers_of_names_found_part_by_part(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id long, name string")
    told = rename.with_numbers(rows, "name").orderBy("id").collect()
    assert [(r["_base"], r["_number"]) for r in told] == [by_pattern(n) for n in NAMES]


def test_requests_of_one_file_are_planned_by_many_tasks(spark, monkeypatch):
    kept = []
    cut = rename.cut_lineage
    monkeypatch.setattr(rename, "cut_lineage", lambda rows: kept.append(cut(rows)) or kept[-1])
    asked = spark.range(3000).coalesce(1).selectExpr(
        "'b' batch_id", "id ordinal", "'r'||id request_id", "'/d' dir", "'s'||id||'.pdf' source_name", "'n.pdf' desired_filename"
    )
    listing = asked.selectExpr("dir", "source_name name")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        planned = rename.plan_destinations(asked, listing)
        assert kept[0].rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.number for r in planned.collect()) == list(range(3000))


_NS = {
    "rsm": "urn:un:unece:uncefact:data:standard:CrossIndustryInvoice:100",
    "ram": "urn:un:unece:uncefact:data:standard:ReusableAggregateBusinessInformationEntity:100",
    "udt": "urn:un:unece:uncefact:data:standard:UnqualifiedDataType:100",
}
_PLAIN = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<rsm:CrossIndustryInvoice '
    + " ".join(f'xmlns:{p}="{u}"' for p, u in _NS.items())
    + """><rsm:ExchangedDocumentContext><ram:GuidelineSpecifiedDocumentContextParameter><ram:ID> urn:cen.eu:en16931:2017 </ram:ID>
</ram:GuidelineSpecifiedDocumentContextParameter></rsm:ExchangedDocumentContext>
<rsm:ExchangedDocument><ram:IssueDateTime><udt:DateTimeString format="102">20240105</udt:DateTimeString></ram:IssueDateTime></rsm:ExchangedDocument>
<rsm:SupplyChainTradeTransaction><ram:IncludedSupplyChainTradeLineItem><ram:SpecifiedTradeProduct><ram:Name>Käse &amp; Brot</ram:Name>
</ram:SpecifiedTradeProduct><ram:SpecifiedLineTradeSettlement><ram:SpecifiedTradeSettlementLineMonetarySummation><ram:LineTotalAmount>5.50</ram:LineTotalAmount>
</ram:SpecifiedTradeSettlementLineMonetarySummation></ram:SpecifiedLineTradeSettlement></ram:IncludedSupplyChainTradeLineItem>
<ram:ApplicableHeaderTradeAgreement><ram:SellerTradeParty><ram:Name>A > B GmbH</ram:Name></ram:SellerTradeParty></ram:ApplicableHeaderTradeAgreement>
<ram:ApplicableHeaderTradeSettlement><ram:InvoiceCurrencyCode>EUR</ram:InvoiceCurrencyCode><ram:SpecifiedTradeSettlementHeaderMonetarySummation>
<ram:GrandTotalAmount>7.25</ram:GrandTotalAmount></ram:SpecifiedTradeSettlementHeaderMonetarySummation></ram:ApplicableHeaderTradeSettlement>
</rsm:SupplyChainTradeTransaction></rsm:CrossIndustryInvoice>
"""
)
_ITEM = _PLAIN[_PLAIN.index("<ram:Included") : _PLAIN.index("</ram:IncludedSupplyChainTradeLineItem>") + 39]
_SELLER = "<ram:Name>A > B GmbH</ram:Name>"
_END = "</rsm:CrossIndustryInvoice>"
#: (what is replaced, by what, whether the quick reader may take it)
_ODD = [
    ("", "", True),
    (_ITEM, _ITEM * 3, True),
    (_ITEM, "", True),
    (_ITEM, "<ram:IncludedSupplyChainTradeLineItem/>" + _ITEM, False),
    (_ITEM, _ITEM.replace("Käse &amp; Brot", " ") + _ITEM, False),
    ("<ram:Name>Käse &amp; Brot</ram:Name>", "", True),
    ("<ram:Name>Käse &amp; Brot</ram:Name>", "<ram:Name>a</ram:Name><ram:Name>b</ram:Name>", True),
    ("Käse &amp; Brot", "x &lt;b>y&lt;/b>", False),
    ("Käse &amp; Brot", "x &nbsp; y", False),
    ("Käse &amp; Brot", "x &#65; y", False),
    ("Käse &amp; Brot", "<b>x</b> y", False),
    ("Käse &amp; Brot", "a\x0bb", False),
    ("Käse &amp; Brot", "a ", True),
    ("Käse &amp; Brot", "a ]]> b", False),
    ("5.50", "5,50", True),
    ("5.50", "\n 5.50\t", True),
    ("<ram:LineTotalAmount>", '<ram:LineTotalAmount currencyID="EUR">', False),
    ("\n</ram:SpecifiedTradeProduct>", " stray </ram:SpecifiedTradeProduct>", False),
    (_SELLER, "", True),
    (_SELLER, _SELLER + "<ram:Name>Other</ram:Name>", True),
    (_SELLER, "<ram:Name></ram:Name>", False),
    (_SELLER, "<ram:Name> </ram:Name>", True),
    (_SELLER, '<z:Name xmlns:z="urn:other">No</z:Name>' + _SELLER, False),
    (_SELLER, "<!-- c -->" + _SELLER, False),
    (_SELLER, "<ram:Name><![CDATA[C & D]]></ram:Name>", False),
    ('xmlns:udt=', 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:udt=', True),
    (_NS["ram"], "urn:other", True),
    (' format="102"', "", False),
    ('format="102"', 'format="610"', True),
    ("20240105", "20241305", True),
    ("urn:cen.eu:en16931:2017", "urn:other", True),
    ("</ram:ID>", "</ram:ID><ram:ID>b</ram:ID>", True),
    ("rsm:CrossIndustryInvoice", "rsm:Order", True),
    ("rsm:CrossIndustryInvoice", "Order", True),
    ("UTF-8", "ISO-8859-1", False),
    (_END, "", False),
    (_END, "<q>" * 49 + "</q>" * 49 + _END, True),
    (_END, "<q>" * 50 + "</q>" * 50 + _END, False),
    (_END, "<q><r></q></r>" + _END, False),
    (_END, '<q a="1" a="2"/>' + _END, False),
    (_END, '<q a="x>y">t</q>' + _END, False),
    (_END, "<q/>" + _END, True),
    (_END, _END + " tail", False),
    (_END, "<?pi x?>" + _END, False),
    ("<rsm:Cross", "<!DOCTYPE x><rsm:Cross", False),
    ("<?xml", " <?xml", False),
    ("\n", "\r\n", False),
]


def test_quick_reader_of_xml_tells_what_the_full_checks_tell(spark, monkeypatch):
    from fieldloom.operators import invoice_xml

    rows = [(i, _PLAIN.replace(a, b).encode() if a else _PLAIN.encode()) for i, (a, b, _) in enumerate(_ODD)]
    rows += [(len(rows), None), (len(rows) + 1, b""), (len(rows) + 2, b"\xff<a/>"), (len(rows) + 3, b"<a/>")]
    documents = spark.createDataFrame(rows, "doc_id long, content binary")
    checks = ["doc_id", "xml_fault", "root_tag", "n_profiles", "profile_id"]

    def told():
        read = invoice_xml.read_xml(documents, "content", ["doc_id"])
        mapped = invoice_xml.map_fields(read, checks).orderBy("doc_id")
        return mapped.collect(), read.orderBy("doc_id").select(F.col("x.root_tag").isNotNull()).collect()

    found, quick = told()
    assert [q[0] for q in quick[: len(_ODD)]] == [taken for _, _, taken in _ODD]
    monkeypatch.setattr(invoice_xml, "QUICK_BYTES", -1)
    for mine, full in zip(found, told()[0], strict=True):
        assert mine == full, _ODD[mine.doc_id] if mine.doc_id < len(_ODD) else mine.doc_id


def test_line_items_are_exploded_from_one_reading(spark):
    from fieldloom.operators import invoice_xml, line_items

    documents = spark.createDataFrame([(1, _PLAIN.encode())], "doc_id long, content binary")
    mapped = invoice_xml.map_fields(invoice_xml.read_xml(documents, "content", ["doc_id"]), ["doc_id"])
    rows = line_items.explode_items(mapped)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1
    assert [(r.ord, r.name, float(r.amount)) for r in rows.collect()] == [(1, "Käse & Brot", 5.5)]


def test_still_missing_fields_parse_each_attempt_once(spark, monkeypatch):
    from fieldloom.catalog.registry import load
    from fieldloom.operators import responses

    parsed, parse = [], responses.parse_responses
    monkeypatch.setattr(responses, "parse_responses", lambda rows, r, *o: parsed.append(r) or parse(rows, r, *o))
    load()["set3_still_missing"].run(spark, "/root/testdata/sf0.001")
    assert parsed == ["response_0", "response_1", "response_2"]


def test_first_verdict_is_kept_by_the_repair_protocol(spark):
    from fieldloom.operators import responses

    rows = [(1, "no json", '{"seller": "A"}'), (2, '{"seller": "A"}', "no json"), (3, '{"seller": "A", "gross_total": "x"}', None), (4, None, "[]")]
    wide = spark.createDataFrame(rows, "doc_id long, response_0 string, response_1 string").selectExpr(
        "*", "cast(null as string) error_0", "cast(null as string) error_1"
    )
    told = responses.resolve_attempts(wide, 1).orderBy("doc_id").collect()
    assert [r.opened for r in told] == ["failed", "ok", "salvaged", None]


def test_stages_stay_below_the_size_that_java_compiles(spark):
    from fieldloom.session import apply_settings

    assert int(apply_settings(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_responses_of_one_small_file_are_parsed_by_many_tasks(spark):
    from fieldloom.catalog.registry import load

    plan = load()["win3_best_salvage"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan
    assert plan.index("RepartitionByExpression") > plan.index("try_variant_get")


def test_rename_planning_groups_its_tables_once(spark, monkeypatch):
    frames = []
    cut = rename.cut_lineage
    monkeypatch.setattr(rename, "cut_lineage", lambda rows: frames.append(rows) or cut(rows))
    asked = spark.createDataFrame(
        [("b", 1, "r1", "/d", "s1", "n (1).pdf"), ("b", 2, "r2", "/d", "n (2).pdf", "n.pdf"), ("b", 3, "r3", "/d", "s3", "n.pdf"),
         ("b", 4, "r4", "/d", "s4", "n (3).pdf")],
        "batch_id string, ordinal long, request_id string, dir string, source_name string, desired_filename string",
    )
    listing = spark.createDataFrame([("/d", n) for n in ("s1", "n (2).pdf", "n (2).pdf", "s3", "s4", "n (3).pdf")], "dir string, name string")
    planned = rename.plan_destinations(asked, listing)
    specials = next(f for f in frames if f.columns[-3:] == ["kind", "number", "name"])
    assert specials._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 1
    assert {r.ordinal: r.destination_name for r in planned.collect()} == {
        1: "n (1).pdf", 2: "n.pdf", 3: "n (4).pdf", 4: "n (3) (1).pdf",
    }


def test_own_numbers_of_many_blocks_take_as_many_passes_as_of_few(spark, monkeypatch):
    rng = random.Random(4)
    rows, expected = [], {}
    for family, size in ((1, 2000), (2, 450), (3, 60)):
        lost = 0
        for k in range(size):
            free = rng.randint(-5, size)
            rows.append((family, k, free, k, k))
            expected[family, k] = lost >= free
            lost += lost < free
    assert 0 < sum(expected.values()) < len(rows)
    own = spark.createDataFrame(rows, "family long, ordinal long, free_below long, before long, own_before long").repartition(3)
    tables, store = [], own_numbers.stored
    monkeypatch.setattr(own_numbers, "stored", lambda rows: tables.append(rows) or store(rows))
    passes = []
    for block in (300, 20):
        tables.clear()
        told = own_numbers.keepers(own, ["family"], block).collect()
        assert {(r.family, r.ordinal): r.granted for r in told} == expected
        passes.append(len(tables))
    assert passes[0] == passes[1]
