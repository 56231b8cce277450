"""Hand-written rows for the edge cases of each operator."""

import itertools
import random
import statistics
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.catalog.views import PROFILE, RAM, RSM, UDT
from fieldloom.functions import text, values
from fieldloom.operators import (
    attachments,
    evaluation,
    fleet,
    invoice_xml,
    jobs,
    line_items,
    naming,
    ocr_layout,
    ordered,
    own_numbers,
    pages,
    prompts,
    rename,
    responses,
    undo,
)


def apply(spark, function, inputs, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(function(F.col("v"))).collect()]


# ---- text -------------------------------------------------------------------


def test_ascii_fold_equals_decomposition_for_every_character(spark):
    chars = [chr(cp) for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and cp]
    lines = ["x" + "".join(chars[i : i + 4096]) for i in range(0, len(chars), 4096)]
    expected = [unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode() for s in lines]
    assert apply(spark, text.ascii_fold, lines) == expected


def test_strip_and_visible_length_follow_unicode_white_space(spark):
    samples = ["  a b \n", "\x1c\x1f", "", "plain", "　x​"]
    assert apply(spark, text.ustrip, samples) == [s.strip() for s in samples]
    assert apply(spark, text.visible_length, samples) == [len("".join(s.split())) for s in samples]


def test_filename_segments(spark):
    cases = {
        "Müller & Söhne GmbH": "Mueller-Soehne-GmbH",
        "  Café  Zürich ": "Cafe-Zuerich",
        "a / b": "a-b",
        "--x--": "x",
        "???": "",
        "   ": "",
        "ﬁne ½": "fine-12",
        "über": "uber",
    }
    assert apply(spark, text.filename_segment, list(cases)) == list(cases.values())


def test_phrase_is_whole_word_and_one_directional(spark):
    frame = spark.createDataFrame(
        [
            ("mediamarkt gmbh", "mediamarkt", True),
            ("mediamarkt", "mediamarkt gmbh", False),
            ("mediamarkt", "a", False),
            ("a.b (c)", "a.b (c)", True),
            ("x a\\eb y", "a\\eb", True),
            ("x a\\Eb y", "a\\Eb", True),
            ("größe", "größ", False),
        ],
        "t string, p string, e boolean",
    )
    got = frame.select(text.contains_phrase(F.col("t"), F.col("p")), "e").collect()
    assert all(a == b for a, b in got)


def test_text_equality_folds_case_and_white_space(spark):
    assert apply(spark, text.fold_for_match, [" Straße\tX ", "STRASSE  x"]) == ["strasse x", "strasse x"]


def test_fences(spark):
    cases = {
        '```json\n{"a":1}\n```': '{"a":1}',
        '  ```\n{"a":1}```  ': '{"a":1}',
        '{"a":1}': '{"a":1}',
        'x ```{"a":1}```': 'x ```{"a":1}```',
    }
    assert apply(spark, text.strip_fence, list(cases)) == list(cases.values())


def test_names_split_at_the_last_dot(spark):
    stems = apply(spark, lambda c: text.split_name(c)[0], ["a.b.c", ".hidden", "none", "x.", "a.b"])
    ends = apply(spark, lambda c: text.split_name(c)[1], ["a.b.c", ".hidden", "none", "x.", "a.b"])
    assert list(zip(stems, ends)) == [("a.b", ".c"), (".hidden", ""), ("none", ""), ("x", "."), ("a", ".b")]


def test_quotes_in_messages(spark):
    shown = apply(spark, text.quoted_echo, ["a", "it's", "a'b\"c", None, "n\n"])
    assert shown == ["'a'", '"it\'s"', "'a\\'b\"c'", "None", "'n\\n'"]


# ---- values -----------------------------------------------------------------


def test_compact_dates(spark):
    cases = ["20260115", "2026115", "202611", "20261301", "20260230", "00010101", "00000101", "2026-01-15"]
    got = [str(d) if d else None for d in apply(spark, values.compact_date, cases)]
    assert got == ["2026-01-15", "2026-11-05", "2026-01-01", None, None, "0001-01-01", None, None]


def test_strict_dates(spark):
    cases = ["2026-07-07", "2026-7-7", "2026", "2026-07-07T00:00:00", "2026-07-07T10:00:00", "2026-02-30", "07.07.2026"]
    got = [str(d) if d else None for d in apply(spark, values.strict_date, cases)]
    assert got == ["2026-07-07", None, None, "2026-07-07", None, None, None]


def test_decimals(spark):
    cases = ["12.50", "-3", "1e3", "1.", "999999999999999999", "1000000000000000000", "9" * 33, "1,5", ""]
    got = [None if v is None else float(v) for v in apply(spark, values.bounded_decimal, cases)]
    assert got == [12.5, -3.0, None, None, 999999999999999999.0, None, None, None, None]


def test_amounts_round_half_up(spark):
    frame = spark.sql("select explode(array(2180.5bd, 0.5bd, 0.4bd, 2180.49bd)) v")
    assert [r[0] for r in frame.select(values.rounded_amount(F.col("v"))).collect()] == ["2181", "1", "0", "2180"]


def test_currency_codes(spark):
    assert len(set(values.CURRENCY_CODES)) == len(values.CURRENCY_CODES) == 178
    assert apply(spark, values.is_currency, ["EUR", "eur", "ABC", "EURO", None, "R U"]) == [True, False, False, False, False, False]


def test_formats(spark):
    frame = spark.createDataFrame([(bytearray(b"%PDF-1.7"),), (bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b"\x89PNG"),)], "c binary")
    assert [r[0] for r in frame.select(values.document_format(F.col("c"))).collect()] == ["pdf", "jpeg", None]


# ---- line items and names ---------------------------------------------------


@pytest.mark.parametrize(
    ("items", "summary", "warned"),
    [
        ([("A", None)], "A", False),
        ([("A", 100), ("B", 50)], "A", False),
        ([("A", 100), ("B", 90), ("C", 10)], "A + B", False),
        ([("A", 10), ("B", 10)], "A + B", False),
        ([("B", 0), ("A", 0)], "B + A", False),
        ([(None, 10), ("B", 5)], None, True),
        ([("A", None), ("B", 5)], None, True),
        ([("A" * 300, 10), ("B" * 300, 9)], None, True),
        ([(None, None)], None, False),
    ],
)
def test_product_summary_rules(spark, items, summary, warned):
    rows = [(1, i, n, a) for i, (n, a) in enumerate(items)]
    frame = spark.createDataFrame(rows, "doc_id long, ord long, name string, amount int").withColumn("amount", F.col("amount").cast("decimal(38,10)"))
    got = line_items.summarize_products(frame).collect()[0]
    assert (got["product_summary"], got["product_warning"] is not None) == (summary, warned)
    ranked = frame.groupBy("doc_id").agg(line_items.rank_array(F.collect_list(F.struct("ord", "name", "amount"))).alias("r"))
    pair = ranked.select(*line_items.summary_of_ranked(F.col("r"))).collect()[0]
    assert (pair[0], pair[1] is not None) == (summary, warned)


def test_names_and_budget(spark):
    rows = [
        (1, "2026-09-12", "Apple", "MacBook Air", "2180.00", "EUR", None),
        (2, None, None, " ", None, None, None),
        (3, "2026-01-01", "S" * 90, "P" * 90, "10.5", "USD", None),
        (4, "2026-01-01", "S" * 160, "P", "1", "USD", None),
        (5, "2026-01-01", "Long Seller GmbH", "P", "1", "USD", "Short"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, invoice_date string, seller string, product_summary string, gross_total string, currency string, seller_short string")
    frame = frame.withColumns({"invoice_date": F.to_date("invoice_date"), "gross_total": F.col("gross_total").cast("decimal(38,10)")})
    got = {r["doc_id"]: r for r in naming.propose_filenames(frame).collect()}
    assert got[1]["proposed_filename"] == "2026-09-12_Apple_MacBook-Air_2180-EUR.pdf"
    assert not got[1]["requires_review"]
    assert got[2]["proposed_filename"] == "0000-00-00_Unknown_Unknown_0-XXX.pdf"
    assert got[2]["missing_fields"] == ["date", "seller", "product", "amount", "currency"]
    assert len(got[3]["proposed_filename"]) == 154 and got[3]["proposed_filename"].endswith("_11-USD.pdf")
    assert got[3]["naming_warnings"] == ["product truncated to fit the 150-character filename limit"]
    assert got[4]["naming_warnings"] == ["seller/product truncated to fit the 150-character filename limit"]
    assert got[5]["proposed_filename"] == "2026-01-01_Short_P_1-USD.pdf"


# ---- layout -----------------------------------------------------------------


def test_two_columns_read_row_by_row(spark):
    boxes = [
        (1, 1, 0, "Item", 1.0, 0.1, 0.80, 0.2, 0.02),
        (1, 1, 1, "Price", 0.8, 0.7, 0.805, 0.2, 0.02),
        (1, 1, 2, "9.99", 0.6, 0.7, 0.70, 0.2, 0.02),
        (1, 1, 3, "Cable", 0.6, 0.1, 0.705, 0.2, 0.02),
    ]
    frame = spark.createDataFrame(boxes, "doc_id long, page_number int, idx int, text string, conf double, x double, y double, w double, h double")
    row = ocr_layout.boxes_to_pages(frame).collect()[0]
    assert row["text"] == "Item Price\nCable 9.99" and abs(row["confidence"] - 0.75) < 1e-9


def test_words_keep_first_appearance_order(spark):
    words = [(1, 1, 0, 2, 1, 1, "b", 90.0), (1, 1, 1, 1, 1, 1, "a", -1.0), (1, 1, 2, 2, 1, 1, " c ", 70.0), (1, 1, 3, 1, 1, 1, " ", 50.0)]
    frame = spark.createDataFrame(words, "doc_id long, page_number int, idx int, block int, par int, line int, word string, conf double")
    row = ocr_layout.words_to_pages(frame.repartition(4)).collect()[0]
    assert (row["text"], round(row["confidence"], 9)) == ("b c\na", 0.8)


def test_all_pages_stay_whatever_their_numbers(spark):
    frame = spark.range(1, 202).selectExpr("1L doc_id", "cast(id * 3 as int) page_number", "'x' text", "id % 2 = 0 needs_ocr", "cast(null as double) ocr_confidence")
    row = pages.assemble_pages(frame.repartition(5)).collect()[0]
    assert row["pages_total"] == 201 and [p["page_number"] for p in row["pages"]] == list(range(3, 604, 3))
    assert row["pages_ocr"] == list(range(6, 604, 6))
    assert [tuple(r) for r in pages.refused_documents(frame).collect()] == [(1, 201, "201 pages, at most 200 are taken")]
    assert pages.refused_documents(frame, most=201).count() == 0


# ---- invoice XML ------------------------------------------------------------


def element(name, *inside, **attributes):
    """One XML element; ``inside`` holds markup or text."""
    shown = "".join(f' {k}="{v}"' for k, v in attributes.items())
    return f"<{name}{shown}>{''.join(inside)}</{name}>"


def ram(path, *inside):
    """Elements of the invoice vocabulary within each other, outermost first."""
    for name in reversed(path.split("/")):
        inside = (element(f"ram:{name}", *inside),)
    return inside[0]


def day(text, **attributes):
    return element("udt:DateTimeString", text, **attributes)


def cii(
    date=day("20260309", format="102"), seller=ram("Name", "Nordlicht Werke AG"), currency=ram("InvoiceCurrencyCode", "CHF"),
    total=ram("GrandTotalAmount", "842.30"), items=(("Lagerregal", "720.00"),), profile=PROFILE, extra="", prefix="rsm",
):
    """An invoice of the given parts, each of them markup that a test may spoil."""
    top = lambda name, *inside: element(f"{prefix}:{name}", *inside)
    lines = [
        ram(
            "IncludedSupplyChainTradeLineItem",
            ram("SpecifiedTradeProduct/Name", name),
            ram("SpecifiedLineTradeSettlement/SpecifiedTradeSettlementLineMonetarySummation/LineTotalAmount", amount),
        )
        for name, amount in items
    ]
    sums = ram("SpecifiedTradeSettlementHeaderMonetarySummation", total, ram("DuePayableAmount", "3.00"))
    body = [
        top("ExchangedDocumentContext", ram("GuidelineSpecifiedDocumentContextParameter/ID", profile)),
        top("ExchangedDocument", ram("IssueDateTime", date)),
        top(
            "SupplyChainTradeTransaction", *lines,
            ram("ApplicableHeaderTradeAgreement/SellerTradeParty", seller),
            ram("ApplicableHeaderTradeSettlement", currency, sums),
        ),
    ]
    spaces = {f"xmlns:{prefix}": RSM, "xmlns:ram": RAM, "xmlns:udt": UDT}
    return '<?xml version="1.0" encoding="UTF-8"?>' + element(f"{prefix}:CrossIndustryInvoice", *body, extra, **spaces)


def test_xml_is_read_as_a_parser_reads_it(spark):
    head = '<?xml version="1.0" ' + " " * 300 + 'encoding="{}"?>'
    plain = cii().split("?>", 1)[1]
    foreign = cii(seller='<z:Name>Fremd</z:Name>' + ram("Name", "Nordlicht Werke AG")).replace("xmlns:ram", 'xmlns:z="urn:other" xmlns:ram', 1)
    nested = cii(seller=ram("Name", "Nord<ram:ID>7</ram:ID>Süd"))
    noted = cii(extra="<!-- <!DOCTYPE x> --><![CDATA[<!DOCTYPE y>]]>")
    euro = head.format("windows-1252") + plain.replace("Nordlicht Werke AG", "Preis – 5 €")
    wide = head.format("iso-8859-15") + plain.replace("Nordlicht Werke AG", "Œuvre €")
    texts = {1: foreign.encode(), 2: nested.encode(), 3: noted.encode(), 4: euro.encode("cp1252"), 5: wide.encode("iso8859-15"), 6: cii(seller=ram("Name", "a &lt; b &gt; c")).encode(), 7: ("<!DOCTYPE x>" + plain).encode()}
    found = discover(spark, {i: [("factur-x.xml", t)] for i, t in texts.items()})
    sellers = {i: (r["xml_status"], r["facts"] and r["facts"]["seller"]) for i, r in found.items()}
    assert sellers == {
        1: ("supported", "Nordlicht Werke AG"), 2: ("supported", "Nord"), 3: ("supported", "Nordlicht Werke AG"),
        4: ("supported", "Preis – 5 €"), 5: ("supported", "Œuvre €"), 6: ("supported", "a < b > c"), 7: ("invalid", None),
    }


def discover(spark, contents):
    rows = []
    for doc_id, versions in contents.items():
        for i, (name, content) in enumerate(versions):
            rows.append((doc_id, name, i, bytearray(content if isinstance(content, bytes) else content.encode())))
    frame = spark.createDataFrame(rows, "doc_id long, attachment_name string, revision_no int, content binary")
    documents = spark.createDataFrame([(d,) for d in contents], "doc_id long")
    return {r["doc_id"]: r for r in attachments.discover_xml(documents, frame).collect()}


def test_discovery_cascade(spark):
    good, name = cii(), "factur-x.xml"
    deep = "<q>" * 50 + "</q>" * 50
    cases = {
        1: ([(name, good)], "supported"),
        2: ([("other.xml", good)], "none"),
        3: ([("Factur-X.XML", good), ("xrechnung.xml", good)], "supported"),
        4: ([(name, good), ("xrechnung.xml", cii(seller="<ram:Name>B</ram:Name>"))], "ambiguous"),
        5: ([(name, good)] * 6, "ambiguous"),
        6: ([(name, good)] * 5, "supported"),
        7: ([(name, "")], "none"),
        8: ([(name, good[:-5])], "invalid"),
        9: ([(name, good.replace("<rsm:Cross", "<!DOCTYPE x [<!ENTITY a 'b'>]><rsm:Cross", 1))], "invalid"),
        10: ([(name, cii(extra=deep))], "invalid"),
        11: ([(name, cii(extra="<q>" * 49 + "</q>" * 49))], "supported"),
        12: ([(name, "<Invoice xmlns='urn:oasis'/>")], "unsupported"),
        13: ([(name, cii(profile="urn:factur-x.eu:1p0:minimum"))], "unsupported"),
        14: ([(name, good.replace("</ram:ID>", "</ram:ID><ram:ID>x</ram:ID>"))], "invalid"),
        15: ([(name, good.encode().replace(b"Nordlicht", b"\xff\xfe"))], "invalid"),
        16: ([(name, good.replace('encoding="UTF-8"', 'encoding="nonsense"'))], "invalid"),
        17: ([(name, cii(prefix="a"))], "supported"),
        18: ([(name, good + " tail")], "invalid"),
        19: ([(name, good + "<B/>")], "invalid"),
        20: ([(name, good.replace(RSM, "urn:wrong"))], "unsupported"),
        21: ([(name, cii(extra="<q a='x/>y'>t</q><!-- <b> --><![CDATA[<c>]]>"))], "supported"),
        22: ([(name, good.replace('encoding="UTF-8"', 'encoding="UTF-16"').encode("utf-16"))], "supported"),
    }
    found = discover(spark, {k: v[0] for k, v in cases.items()})
    assert {k: found[k]["xml_status"] for k in cases} == {k: v[1] for k, v in cases.items()}
    assert found[3]["xml_attachment_name"] == "Factur-X.XML"
    assert found[4]["xml_warning"] == "multiple distinct invoice XML attachments found (factur-x.xml, xrechnung.xml); skipping XML extraction"
    assert found[12]["xml_warning"] == "'factur-x.xml' has an unsupported root element '{urn:oasis}Invoice'"
    assert found[13]["xml_profile_id"] == "urn:factur-x.eu:1p0:minimum"


def test_too_many_known_names(spark):
    spellings = ["".join(p) + "tur-x.xml" for p in itertools.product("fF", "aA", "cC", "xX")]
    names = [s.replace("xtur", "tur").replace("Xtur", "Tur") for s in spellings]
    assert len(set(names)) == 16
    found = discover(spark, {1: [(n, cii()) for n in names[:11]], 2: [(n, cii()) for n in names[:10]]})
    assert (found[1]["xml_status"], found[2]["xml_status"]) == ("ambiguous", "supported")


def test_fields_are_independent(spark):
    one = {
        1: cii(),
        2: cii(date='<udt:DateTimeString format="610">202601</udt:DateTimeString>'),
        3: cii(date=day("20260309")),
        4: cii(date='<udt:DateTimeString format="102">20261399</udt:DateTimeString>'),
        5: cii(seller="<ram:Name>A</ram:Name><ram:Name>B</ram:Name>"),
        6: cii(seller="<ram:Name>" + "x" * 501 + "</ram:Name>"),
        7: cii(total="<ram:GrandTotalAmount>-1</ram:GrandTotalAmount>"),
        8: cii(total="<ram:GrandTotalAmount>abc</ram:GrandTotalAmount>"),
        9: cii(currency="<ram:InvoiceCurrencyCode>EURO</ram:InvoiceCurrencyCode>"),
        10: cii(items=()),
        11: cii(items=(("A", "100.00"), ("B", "90.00"))),
        12: cii(items=(("A", "100.00"), ("B", ""))),
        13: cii(seller=""),
        14: cii(seller="<ram:Name>Müller &amp; Söhne</ram:Name>"),
        15: cii(total='<ram:GrandTotalAmount currencyID="EUR"> 7.50 </ram:GrandTotalAmount>'),
    }
    found = discover(spark, {k: [("factur-x.xml", v)] for k, v in one.items()})
    fact = {k: v["facts"] for k, v in found.items()}
    assert str(fact[1]["invoice_date"]) == "2026-03-09" and fact[1]["product_summary"] == "Lagerregal"
    assert float(fact[1]["gross_total"]) == 842.3 and fact[1]["warnings"] == []
    assert fact[1]["evidence"]["gross_total"]["xml_field"].endswith("ram:GrandTotalAmount")
    assert fact[2]["warnings"] == ["invoice_date: unsupported XML date format '610'; falling back to AI extraction"]
    assert fact[3]["warnings"] == ["invoice_date: unsupported XML date format None; falling back to AI extraction"]
    assert fact[4]["warnings"] == ["invoice_date: unparseable XML date '20261399'; falling back to AI extraction"]
    assert fact[5]["seller"] is None and "conflicting" in fact[5]["warnings"][0]
    assert fact[6]["seller"] is None and "exceeds 500" in fact[6]["warnings"][0]
    assert fact[7]["warnings"] == ["gross_total: XML grand total '-1' is negative; falling back to AI extraction"]
    assert fact[8]["warnings"] == ["gross_total: invalid or out-of-range XML amount 'abc'; falling back to AI extraction"]
    assert fact[9]["warnings"] == ["currency: invalid XML currency code 'EURO'; falling back to AI extraction"]
    assert fact[10]["product_summary"] is None and fact[10]["warnings"] == []
    assert fact[11]["product_summary"] == "A + B"
    assert fact[12]["warnings"] == [line_items.NO_AMOUNT_WARNING]
    assert fact[13]["seller"] is None and fact[13]["warnings"] == [] and "seller" not in fact[13]["evidence"]
    assert fact[14]["seller"] == "Müller & Söhne"
    assert float(fact[15]["gross_total"]) == 7.5


# ---- responses --------------------------------------------------------------


def answers(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, response string")
    return [r["answer"] for r in responses.parse_responses(frame, "response").orderBy("doc_id").collect()]


def test_response_verdicts(spark):
    full = '{"invoice_date":"2026-07-07","seller":"A","product_summary":"B","gross_total":21.42,"currency":"EUR","language":"de"}'
    got = answers(
        spark,
        [
            full,
            full + " trailing",
            full + "] x",
            "[1]",
            '{"seller": ',
            '{"seller": 5, "currency": "ABC", "gross_total": "1e3"}',
            '{"seller": 5}',
            "{}",
            '{"seller":"A","seller":"B"}',
            '{"seller":"A","gross_total":true}',
            '{"seller":"A","gross_total":" 21.42 "}',
            '{"seller":"A","language":null}',
            '{"seller":"A","evidence":[1]}',
            '{"seller":"A","evidence":{"seller":{"page":1}}}',
            '{"seller":"A","invoice_date":"2026-7-7"}',
            '{"seller":"A","warnings":5,"seller_short":9}',
        ],
    )
    assert [a["verdict"] for a in got] == [
        "ok", "failed", "failed", "failed", "failed", "salvaged", "failed", "ok", "ok", "salvaged",
        "ok", "salvaged", "salvaged", "ok", "salvaged", "ok",
    ]
    assert got[5]["warnings"] == [
        "seller: must be a string",
        "currency: 'ABC' names no currency in use",
    ]
    assert float(got[5]["gross_total"]) == 1000.0
    assert got[8]["seller"] == "B"
    assert float(got[10]["gross_total"]) == 21.42
    assert got[13]["evidence"]["seller"]["page"] == 1


def resolve(spark, attempts, max_repairs=1):
    rows = [(1, k, r, e) for k, (r, e) in enumerate(attempts)]
    frame = spark.createDataFrame(rows, "doc_id int, attempt int, response string, error string")
    return responses.resolve_attempts(responses.attempts_wide(frame, max_repairs), max_repairs).collect()[0]


def test_repair_protocol(spark):
    partial = '{"seller":"A","currency":"abc"}'
    got = resolve(spark, [(partial, None), ('{"currency":"EUR","seller":"Z","gross_total":"x"}', None)])
    assert (got["value"]["seller"], got["value"]["currency"], got["value"]["warnings"]) == ("A", "EUR", [])
    # A broken or failing repair keeps what was salvaged.
    for second in (("nonsense", None), (None, "boom")):
        kept = resolve(spark, [(partial, None), second])
        assert kept["value"]["seller"] == "A" and len(kept["value"]["warnings"]) == 1
    # A malformed first answer is asked again in full.
    again = resolve(spark, [("nonsense", None), ('{"seller":"B"}', None)])
    assert again["value"]["seller"] == "B" and again["value"]["warnings"] == []
    lost = resolve(spark, [("nonsense", None), ("still bad", None)])
    assert lost["value"]["warnings"] == ["model output could not be validated: response is not valid JSON; raw response: 'still bad'"]
    stopped = resolve(spark, [("nonsense", None), (None, "boom")])
    assert stopped["value"]["warnings"] == ["model output could not be validated: repair generation failed: boom"]
    crashed = resolve(spark, [(None, "down")])
    assert crashed["crashed"] == "down" and crashed["value"] is None
    waiting = resolve(spark, [(partial, None)])
    assert waiting["mode"] == "narrow" and sorted(waiting["asked"]) == ["currency", "gross_total", "invoice_date", "product_summary"]


def test_calls_are_taken_whole_and_counted(spark):
    """Two calls of one attempt are never mixed; calls beyond the protocol are counted."""
    rows = [(1, 0, "b", None), (1, 0, None, "boom"), (1, 0, "a", "x"), (1, 1, None, "late"), (1, 2, "{}", None), (1, None, "{}", None), (2, 0, None, "e")]
    frame = spark.createDataFrame(rows, "doc_id int, attempt int, response string, error string")
    got = {r["doc_id"]: r for r in responses.attempts_wide(frame, 1).collect()}
    assert (got[1]["response_0"], got[1]["error_0"], got[1]["error_1"]) == ("b", None, "late")
    assert (got[1]["calls_ignored"], got[1]["calls_repeated"]) == (2, 2)
    assert (got[2]["response_0"], got[2]["error_0"], got[2]["calls_ignored"], got[2]["calls_repeated"]) == (None, "e", 0, 0)


def test_worse_full_repair_never_wins(spark):
    """Evidence-only rejection asks in full; a poorer answer must not replace it."""
    rich = '{"invoice_date":"2026-01-01","seller":"A","product_summary":"B","gross_total":"1","currency":"EUR","evidence":[1]}'
    got = resolve(spark, [(rich, None), ('{"seller":"Z","currency":"abc"}', None)])
    assert got["value"]["seller"] == "A" and got["value"]["currency"] == "EUR"
    better = resolve(spark, [(rich, None), (rich.replace("[1]", "{}"), None)])
    assert better["value"]["warnings"] == []


def test_two_repairs_keep_asking_for_what_is_missing(spark):
    got = resolve(
        spark,
        [('{"seller":"A"}', None), ('{"gross_total":"5","currency":"abc"}', None), ('{"currency":"EUR","seller":"Z"}', None)],
        2,
    )
    assert (float(got["value"]["gross_total"]), got["value"]["currency"], got["value"]["seller"]) == (5.0, "EUR", "A")


def test_short_names_are_gated(spark):
    rows = [
        ("A GmbH", "Prod", '{"seller_short":"A","product_short":" "}', None, "A", None, 0),
        (None, "Prod", '{"seller_short":"A","product_short":"P"}', None, None, "P", 0),
        (None, None, "bad", None, None, None, 0),
        ("A GmbH", None, "bad", None, None, None, 1),
        ("A GmbH", None, None, "boom", None, None, 1),
    ]
    for seller, product, response, error, short, short_product, warned in rows:
        frame = spark.createDataFrame([(seller, product, response, error)], "seller string, product_summary string, short_response_0 string, short_error_0 string").withColumn("warnings", F.array().cast("array<string>"))
        got = responses.apply_short_names(frame, 0).collect()[0]
        assert (got["seller_short"], got["product_summary_short"], len(got["warnings"])) == (short, short_product, warned)


def test_prompts_follow_the_state(spark):
    page = "array(struct(1 as page_number, 'Total 5 EUR' as text))"
    frame = spark.createDataFrame([("first",)], "k string").selectExpr(
        "1 doc_id", f"{page} pages", "'narrow' mode", "array('currency','gross_total') asked", "1 attempts",
        "'{}' response_0", "cast(null as string) fault",
        "array(struct('currency' as field, 'must be a string' as message, '5' as previous)) rejected",
    )
    prompt = prompts.pending_prompts(frame).collect()[0]["prompt"]
    assert prompt.startswith("--- Page 1 ---\nTotal 5 EUR")
    assert prompt.index("- gross_total") < prompt.index("- currency")
    assert "Previous answer: 5 - must be a string" in prompt and prompts.CURRENCY_HINT in prompt
    assert responses.NOT_FOUND in prompt and "- seller" not in prompt


# ---- evaluation -------------------------------------------------------------


def test_scores_keep_absent_and_null_labels_apart(spark):
    runs = spark.createDataFrame(
        [("m", 1, "Shop GmbH", "5.00", False, False, 10), ("m", 2, "X", None, False, False, 20), ("m", 3, None, None, True, True, 99)],
        "model_id string, doc_id long, seller string, gross_total string, failed boolean, crashed boolean, total_ms long",
    ).withColumns({"timing_complete": ~F.col("crashed"), "inference_ms": F.lit(1)})
    labels = spark.createDataFrame(
        [(1, "seller", "shop"), (1, "gross_total", "5"), (2, "seller", None), (3, "seller", None)],
        "doc_id long, field string, expected string",
    )
    scored = {r["doc_id"]: r for r in evaluation.score_predictions(runs, labels).collect()}
    assert (scored[1]["match_seller"], scored[1]["match_gross_total"], scored[1]["match_currency"]) == (True, True, None)
    assert scored[2]["hallucinated_fields"] == ["seller"] and scored[2]["needs_correction"]
    assert scored[3]["match_seller"] is False and scored[3]["hallucinated_fields"] == []
    report = evaluation.model_report(evaluation.score_predictions(runs, labels)).collect()[0]
    assert report["average_total_ms"] == 15.0 and report["failure_rate"] == pytest.approx(1 / 3)
    assert report["hallucination_rate"] == 0.5 and report["accuracy_currency"] is None


# ---- rename -----------------------------------------------------------------


def plan_by_hand(requests, files):
    """The claims replayed one request at a time."""
    result, claimed = {}, {}
    on_disk = set(files)
    for batch, ordinal, directory, source, desired in sorted(requests, key=lambda r: (r[0], r[1])):
        taken = claimed.setdefault(batch, set())
        cut = desired.rfind(".")
        stem, end = (desired, "") if cut <= 0 else (desired[:cut], desired[cut:])
        name, attempt = desired, 1
        while (name != source and (directory, name) in on_disk) or (directory, name) in taken:
            name, attempt = f"{stem} ({attempt}){end}", attempt + 1
        taken.add((directory, name))
        result[(batch, ordinal)] = name
    return result


@pytest.mark.parametrize("seed", range(6))
def test_destinations_equal_replay(spark, seed):
    rng = random.Random(seed)
    pool = ["n.pdf", "n (1).pdf", "n (2).pdf", "n (1) (1).pdf", "n (1) (2).pdf", ".h", ".h (1)", "m", "m (1)", "n (01).pdf"]
    files = {(d, rng.choice(pool + ["n (3).pdf", "n (4).pdf"])) for d in ("/a", "/b") for _ in range(4)}
    requests = []
    for batch in ("x", "y"):
        for ordinal in range(60):
            directory = rng.choice(["/a", "/b"])
            source = rng.choice([f"s{ordinal}.pdf", rng.choice(pool), rng.choice(["n (5).pdf", "n (6).pdf"])])
            files.add((directory, source))
            requests.append((batch, ordinal * 3, directory, source, rng.choice(pool)))
    table = spark.createDataFrame(requests, "batch_id string, ordinal long, dir string, source_name string, desired_filename string").withColumn("request_id", F.col("ordinal").cast("string"))
    listing = spark.createDataFrame(sorted(files), "dir string, name string")
    planned = rename.plan_destinations(table.repartition(3), listing, stretch=16 if seed % 2 else None)
    got = {(r["batch_id"], r["ordinal"]): r["destination_name"] for r in planned.collect()}
    assert got == plan_by_hand(requests, files)


def starts_by_hand(asked):
    """The least start of each request, by trying all of them."""
    found = []
    for k in range(len(asked)):
        for start in range(-2 * len(asked) - 60, 70):
            v = start
            for a in asked[:k]:
                v += v < a
            if v >= asked[k]:
                found.append(start)
                break
    return found


@pytest.mark.parametrize("seed", range(4))
def test_least_starts(seed, monkeypatch):
    monkeypatch.setattr(own_numbers, "_LEAF", 1 + seed * 3)
    rng = random.Random(seed)
    asked = [rng.randint(-20, 40) for _ in range(40)]
    assert own_numbers.least_starts(asked).tolist() == starts_by_hand(asked)
    assert own_numbers.least_starts([]).tolist() == []


@pytest.mark.parametrize("seed,block", [(0, 5), (1, 1), (2, 1 << 18)])
def test_own_numbers_never_reach_the_fold(spark, seed, block, monkeypatch):
    """Numbered folders, with gaps and other requests between, in one block and in many."""
    rng = random.Random(seed)
    requests, files = [], set()
    for batch in ("x", "y"):
        for directory in ("/a", "/b"):
            numbers = rng.sample(range(60), 25)
            sources = [("n.pdf" if n == 0 else f"n ({n}).pdf") for n in numbers] + [f"s{i}.pdf" for i in range(10)]
            files |= {(directory, s) for s in sources} | {(directory, f"n ({n}).pdf") for n in rng.sample(range(1, 60), 8)}
            rng.shuffle(sources)
            start = 0 if directory == "/a" else 1000
            requests += [(batch, start + i, directory, s, "n.pdf") for i, s in enumerate(sources)]
    table = spark.createDataFrame(requests, "batch_id string, ordinal long, dir string, source_name string, desired_filename string").withColumn("request_id", F.col("ordinal").cast("string"))
    folded, decide = [], rename._decide
    monkeypatch.setattr(rename, "_decide", lambda rows: folded.append(rows.count()) or decide(rows))
    monkeypatch.setattr(rename, "keepers", lambda own, keys: own_numbers.keepers(own, keys, block))
    planned = rename.plan_destinations(table, spark.createDataFrame(sorted(files), "dir string, name string"))
    got = {(r["batch_id"], r["ordinal"]): r["destination_name"] for r in planned.collect()}
    assert got == plan_by_hand(requests, files) and folded == [0]
    assert any(got[r[0], r[1]] == r[3] for r in requests)


def test_numbers_of_any_length(spark):
    frame = spark.createDataFrame([("n (123456789012).pdf",), ("n (0).pdf",)], "name string")
    family, number = rename.numbered(F.col("name"))
    assert [tuple(r) for r in frame.select(family, number).collect()] == [("n.pdf", 123456789012), (None, None)]


def test_preflight_stops_the_whole_batch(spark):
    requests = spark.createDataFrame(
        [("a", 1, "1", "/d", "x.pdf", "n.pdf"), ("a", 2, "2", "/d", "gone.pdf", "n.pdf"), ("b", 1, "3", "/d", "x.pdf", "y.pdf")],
        "batch_id string, ordinal long, request_id string, dir string, source_name string, desired_filename string",
    )
    listing = spark.createDataFrame([("/d", "x.pdf", True)], "dir string, name string, is_file boolean")
    plan = rename.rename_plan(requests, listing).collect()
    assert [(r["request_id"], r["destination_path"]) for r in plan] == [("3", "/d/y.pdf")]


def test_undo_validation(spark):
    entries = spark.createDataFrame(
        [("b", "/d/s1", "/d/t1", "i1"), ("b", "/d/s2", "/d/t2", "i2"), ("b", "/d/s3", "/d/t3", "i3"), ("b", "/d/s4", "/d/t4", "i4"), ("b", "/d/t5", "/d/t5", "i5")],
        "batch_id string, source_path string, destination_path string, identity string",
    )
    files = spark.createDataFrame(
        [("/d", "t1", "i1"), ("/d", "t2", "other"), ("/d", "t4", "i4"), ("/d", "s4", "x"), ("/d", "t5", "i5")],
        "dir string, name string, identity string",
    )
    got = {r["source_path"]: r["problem"] for r in undo.validate_entries(entries, files).collect()}
    assert got["/d/s1"] is None and got["/d/t5"] is None
    assert got["/d/s2"].endswith("cannot verify identity") and got["/d/s3"].endswith("no longer exists")
    assert got["/d/s4"] == "/d/s4: another file now exists at the original name"


# ---- ordered groups, jobs, fleet ---------------------------------------------


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_running_totals_do_not_depend_on_the_stretch(spark, stretch):
    rng = random.Random(stretch)
    rows = [(rng.choice("ab"), i, rng.randint(-3, 9)) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, o long, w int").repartition(5)
    totals = ordered.running_total(frame, ["k"], "o", "w", "before", stretch=stretch)
    highest = ordered.running_max(totals, ["k"], "o", "w", "high", stretch=stretch)
    for r in highest.collect():
        earlier = [w for k, o, w in rows if k == r["k"] and o < r["o"]]
        assert r["before"] == sum(earlier) and r["high"] == (max(earlier) if earlier else None)


SPREADS = {
    "dense": lambda i: i,
    "sparse": lambda i: 3**i % (1 << 50) - (1 << 49),
    "narrow": lambda i: 10**15 + i % 97 if i else 0,
    "alike": lambda i: 5 if i % 10 else i,
}


@pytest.mark.parametrize("kind", SPREADS)
def test_stretches_hold_equal_counts_whatever_the_values(spark, kind):
    n, stretch = 6000, 300
    rows = [(k, i, SPREADS[kind](i)) for k in ("hot", None) for i in range(n)] + [("small", i, i) for i in range(50)]
    frame = spark.createDataFrame(rows, "k string, i int, o long").repartition(4)
    cuts = ordered.stretch_cuts(frame, ["k"], "o", stretch)
    cut = ordered.with_stretch(frame, ["k"], "o", cuts).groupBy("k", "_stretch").count().collect()
    sizes = {k: sorted(r["count"] for r in cut if r["k"] == k) for k in ("hot", None, "small")}
    assert sizes["small"] == [50]
    for k in ("hot", None):
        assert sum(sizes[k]) == n and len(sizes[k]) >= n / stretch / 2 and sizes[k][-1] <= 2 * stretch
    positions = ordered.position(frame, ["k"], "o", "p", stretch=stretch).collect()
    for k in ("hot", None, "small"):
        own = sorted((r["p"], r["o"]) for r in positions if r["k"] == k)
        assert [p for p, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted(o for _, o in own)


def test_running_figures_of_null_orders_and_ties(spark):
    rows = [("a", None, 5, 1), ("a", 1, 2, 2), ("a", 1, 1, 3), ("a", 2, 0, 4), (None, 3, 0, 5), (None, 1, 0, 6)] + [("b", 7, t, 1) for t in range(40)]
    frame = spark.createDataFrame(rows, "k string, o long, t long, w long")
    for stretch in (1, 3, 1000):
        got = ordered.running_total(frame, ["k"], "o", "w", "before", ("t",), stretch=stretch).collect()
        told = sorted((str(r["k"]), r["o"] or 0, r["t"], r["before"]) for r in got)
        assert told == [("None", 1, 0, 0), ("None", 3, 0, 6), ("a", 0, 5, 0), ("a", 1, 1, 1), ("a", 1, 2, 4), ("a", 2, 0, 6)] + [("b", 7, t, t) for t in range(40)]


def test_cancelled_jobs(spark):
    script = {
        1: "q c r d", 2: "q r c d", 3: "q r c f", 4: "q r d c", 5: "q", 6: "q r c", 7: "r d", 8: "q d r",
    }
    names = {"q": "queued", "c": "cancel_requested", "r": "running", "d": "completed", "f": "failed"}
    rows = [(job, 1, 1, seq, f"2024-01-01 00:00:{seq:02d}", names[e], 5) for job, events in script.items() for seq, e in enumerate(events.split())]
    frame = spark.createDataFrame(rows, "item_id long, generation long, batch_id long, seq long, ts string, status string, bytes long").withColumn("ts", F.to_timestamp("ts"))
    got = {r["item_id"]: (r["status"], r["cancel_requested"]) for r in jobs.lifecycle(frame).collect()}
    assert got == {
        1: ("cancelled", False), 2: ("cancelled", True), 3: ("failed", True), 4: ("completed", False),
        5: ("queued", False), 6: ("running", True), 8: ("running", False),
    }


def test_exact_medians(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([0.0, -2.5, 1.0, rng.uniform(0, 50)])) for k in "abc" for _ in range(rng.randint(1, 40))]
    got = {r["k"]: r["median"] for r in fleet.exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {k: pytest.approx(statistics.median([v for kk, v in rows if kk == k])) for k in "abc"}


@pytest.mark.parametrize("many", [20_000, 20_001])
def test_medians_of_crowded_values(spark, many):
    """Values within one percent, in a few last bits, and far apart; none is ranked with many others."""
    spreads = {
        "within": lambda i: 100 + (i * 7919 % 20_011) / 20_011,
        "bits": lambda i: float(np.float64(1.5) + (i % 9973) * 2.0**-52),
        "powers": lambda i: 1.0 + 2.0 ** -(i % 50) + (i % 4000) * 2.0**-44,
        "signs": lambda i: (-1.0) ** i * (1 + i * 1e-9),
    }
    rows = [(k, f(i)) for k, f in spreads.items() for i in range(many)]
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "v"])).repartition(4)
    counted = frame.withColumn("_bucket", fleet._octave(F.col("v"))).groupBy("k", "_bucket", "v").agg(F.count(F.lit(1)).alias("_n"))
    assert counted.groupBy("k", "_bucket").count().agg(F.max("count")).first()[0] > 5000
    assert fleet.middle_segments(counted, ["k"], "v", 100).agg(F.max("_values")).first()[0] <= 100
    got = {r["k"]: r["median"] for r in fleet.exact_medians(frame, ["k"], "v", 100).collect()}
    assert got == {k: statistics.median([v for kk, v in rows if kk == k]) for k in spreads}


def test_one_decimal_follows_the_binary_value(spark):
    samples = [18.15, 0.25, 0.35, 0.05, 2.5, 1234.45, 0.3, 99.95, 7.0]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(samples)], "i int, v double").orderBy("i")
    assert [r[0] for r in frame.select(fleet._one_decimal(F.col("v"))).collect()] == [f"{v:.1f}" for v in samples]
