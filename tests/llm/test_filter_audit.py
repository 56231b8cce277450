"""The filter audit against SQL on whole tables and a plain replay of all orders."""

from collections import Counter
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as contract
from compare import compare, connect
from fieldloom.llm import filter_audit

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    {"doc_id": 1, "text": LONG, "source": "a"},
    {"doc_id": 2, "text": LONG, "source": "a"},
    {"doc_id": 3, "text": LONG, "source": None},
    {"doc_id": 3, "text": LONG, "source": None},
    {"doc_id": 1, "text": LONG, "source": "b"},  # the smallest id again: no copy of itself
    {"doc_id": None, "text": LONG, "source": "a"},
    {"doc_id": 4, "text": None, "source": "a"},
    {"doc_id": 5, "text": "", "source": ""},
    {"doc_id": 6, "text": "A B & " * 40, "source": "b"},
    {"doc_id": 7, "text": " 　 ä\x0bb", "source": "b"},
    {"doc_id": 8, "text": "x " * 500_000, "source": "b"},
    {"doc_id": 9, "text": "\t one\n two ", "source": "b"},
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (2, 1, None), (3, None, 1), (None, 1, 1), (99, 1, 1)]


def plain(rows, labels):
    """Each order replayed document by document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = []
    for r in rows:
        text = r["text"] or ""
        words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
            fails.add("C")
        if set(text) & set("#$%&*|"):
            fails.add("D")
        ids = [x["doc_id"] for x in rows if (x["text"] or "") == text and x["doc_id"] is not None]
        if r["doc_id"] is not None and min(ids) < r["doc_id"]:
            fails.add("E")
        docs.append((r["source"] or "", fails, r["doc_id"] in good, r["doc_id"] in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in own)
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in own),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                )
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def labels(spark, rows=LABELS):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, part string")


def test_odd_rows(spark, make):
    found = filter_audit.filter_audit(make(ROWS, "part string"), labels(spark))
    assert sorted(map(tuple, found.collect())) == plain(ROWS, LABELS)
    assert found.schema.simpleString().startswith("struct<part:string,filter_order:string,step:int,kept:bigint")


def test_whole_table_equals_sql(spark):
    found = contract.queries()["op13_filter_audit"](spark, SMALL)
    assert compare(found, connect(SMALL), contract.oracle_sql()["op13_filter_audit"]) == []


def test_a_hot_group_of_copies(spark, make):
    rows = [{"doc_id": i, "text": LONG, "source": f"s{i % 3}"} for i in range(300, 0, -1)]
    found = filter_audit.filter_audit(make(rows), labels(spark)).where("filter_order = 'EABCD' and step = 1")
    assert {r.part: (r.removed, r.kept) for r in found.collect()} == {"s0": (100, 0), "s1": (99, 1), "s2": (100, 0)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=8, max_size=8))
def test_potential_gives_the_value_over_all_orders(counts):
    removed = filter_audit.removed_by(np.array(counts)).tolist()
    potential = filter_audit.potentials(removed, 3)
    for i in range(3):
        over_orders = 0
        for order in permutations(range(3)):
            before = sum(1 << p for p in order[: order.index(i)])
            over_orders += removed[before | 1 << i] - removed[before]
        assert potential[7] - potential[7 ^ (1 << i)] == over_orders


def test_empty_tables(spark, make):
    assert filter_audit.filter_audit(make([]), labels(spark)).count() == 0
    found = filter_audit.filter_audit(make(ROWS), labels(spark, [])).agg({"good_lost": "sum"}).first()
    assert found[0] == 0
