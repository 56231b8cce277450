"""Leaks of benchmark items: planted passages, other values, odd rows."""

import random
import re
from itertools import product

import pytest

from fieldloom.llm import decontaminate
from fieldloom.llm.common import documents

SMALL = "/root/testdata/sf0.001"
ITEMS = [
    (1, "A train with Anna leaves at 7 and drives 120 km to the coast. How long does the train of Anna"
        " need if it stops for 7 minutes in every town on the way?"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the farm"),
    (3, "short item of only six words"), (4, ""), (5, None), (6, "12 13 14 15 16 17 18 19 20 21"), (None, "x y z"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the farm"),
]


@pytest.fixture()
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def found(make, items, texts):
    rows = decontaminate.leaks(make([{"doc_id": d, "text": t} for d, t in texts]), items).collect()
    return sorted((r.doc_id, r.item_id, r.exact) for r in rows)


def test_copies_and_other_values(make, items):
    one = ITEMS[0][1]
    other = one.replace("Anna", "Maria").replace("120", "95").replace("7", "9")
    mixed = one.replace("at 7", "at 9")  # one value of the item becomes two
    texts = [
        (10, one), (11, "Before it. " + other + " After it."), (12, mixed),
        (13, "We said: THE QUICK, brown fox jumps\n over the lazy dog and runs away"),
        (14, "the quick brown fox jumps over a lazy dog and runs away to the farm"),
        (15, "here is a short item of only six words indeed"), (16, "short item of only seven words"),
        (17, "12 13 14 15 16 17 18 19 20 21"), (18, ""), (19, None), (None, one), (10, one),
        (20, "x " * 100_000 + other),
    ]
    result = found(make, items, texts)
    assert [r for r in result if r[0] != 12] == [
        (10, 1, True), (11, 1, False), (13, 2, True), (15, 3, True), (16, 3, False), (17, 6, True),
        (20, 1, False),
    ]
    # The windows around the value that differs do not agree with the rest.
    assert (12, 1, True) not in result


def test_clean_keeps_all_columns_and_rows_without_id(make, items):
    docs = make([{"doc_id": 1, "text": ITEMS[1][1]}, {"doc_id": 2, "text": "fine"}, {"doc_id": None, "text": None}])
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


def test_empty_tables(make, items):
    assert decontaminate.leaks(make([]), items).count() == 0
    assert decontaminate.leaks(make([{"doc_id": 1, "text": "a b"}]), items.limit(0)).count() == 0


def test_whole_table_against_word_runs(spark):
    """Every pair that shares thirteen words in a row is found, and no pair without eight."""
    docs, items = documents(spark, SMALL), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda t, n: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
    pairs = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    texts, asked = docs.select("doc_id", "text").collect(), items.collect()
    long = {n: {i.item_id: grams(i.text, n) for i in asked} for n in (8, 13)}
    for d in texts:
        own8, own13 = grams(d.text, 8), grams(d.text, 13)
        for i in asked:
            if own13 & long[13][i.item_id]:
                assert (d.doc_id, i.item_id) in pairs
            if (d.doc_id, i.item_id) in pairs:
                assert own8 & long[8][i.item_id]
    assert pairs


def test_a_long_run_counts_whatever_the_other_windows_say(make, items):
    mixed = ITEMS[0][1].replace("at 7", "at 9")  # pairs (7, 9) and (7, 7), far apart
    # A run of under RUN tokens on each side of every change, and under half of the windows.
    broken = ITEMS[1][1].replace("jumps", "leaps").replace("runs", "goes")
    rows = decontaminate.leaks(make([{"doc_id": 1, "text": mixed}, {"doc_id": 2, "text": broken}]), items).collect()
    # From the token after the first value, the seventh, to the end.
    n = len(re.findall(r"\w+", mixed))
    assert [(r.doc_id, r.item_id, r.run, r.exact) for r in rows] == [(1, 1, n - 7, False)]


def test_texts_that_share_an_id_are_judged_apart(make, items):
    one = ITEMS[0][1]
    texts = [(1, one.replace("7", "9")), (1, one.replace("7", "8")), (2, one), (2, "other")]
    assert found(make, items, texts) == [(1, 1, False), (2, 1, True)]


def test_items_poor_in_words_are_found_word_for_word(make, spark):
    asked = ["What is 12 + 7?", "Who wrote Hamlet?", "Add 12, 15, 18, 21, 24, 27 and 30."]
    passage = "Of 5 by 6 in 3 for 9 at 8 to 2 or 4 by 1 in 7 as Anna said"
    rows = [*enumerate([*asked, passage], 1)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    texts = [(10 * i, f"Some text. {t} And more.") for i, t in rows]
    texts += [(11, "What is 12 + 8?"), (21, "Who wrote Faust?"), (31, "Add 1, 2, 3, 4, 5, 6 and 7.")]
    assert found(make, items, texts) == [(10, 1, True), (20, 2, True), (30, 3, True), (40, 4, True)]
    rows = decontaminate.leaks(make([{"doc_id": 1, "text": passage}]), items).collect()
    assert [(r.item_id, r.run) for r in rows] == [(4, len(passage.split()))]


def test_numbers_alone_are_found_number_for_number(make, spark):
    items = spark.createDataFrame([(1, "12 + 7 = ?"), (2, "3, 1, 4, 1, 5, 9, 2, 6, 5, 3")], "item_id long, text string")
    texts = [(1, "Now 12 + 7 = ? Say it."), (2, "12 + 8"), (3, "so 3, 1, 4, 1, 5, 9, 2, 6, 5, 3 follow"), (4, "7 12")]
    assert found(make, items, texts) == [(1, 1, True), (3, 2, True)]


@pytest.mark.parametrize("seed", range(30))
def test_most_consistent_windows_by_trying_all_choices(seed):
    rng = random.Random(seed)
    width, places = 3, sorted(rng.sample(range(20), 12))
    pairs = {p: (rng.choice("abcdefghij"), rng.choice("xyz")) for p in rng.sample(range(22), 14)}
    options = {}
    for value, shown in pairs.values():
        options.setdefault(value, set()).add(shown)
    best = 0
    for chosen in product(*options.values()):
        choice = dict(zip(options, chosen))
        agree = [all(choice[pairs[p][0]] == pairs[p][1] for p in range(at, at + width) if p in pairs) for at in places]
        best = max(best, sum(agree))
    assert decontaminate.most_consistent(places, pairs, width) == best


def test_ten_values_that_each_stand_for_three(make, spark):
    """More choices than could be tried one by one; half of the windows agree with the right one."""
    words = [f"word{i} with 1{i} more of it {i}{i} and so" for i in range(10)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    text = " ".join(w.replace(f"1{i} ", f"{7 + i % 3}{i} ") for i, w in enumerate(words))
    assert found(make, items, [(1, text)]) == [(1, 1, False)]


def test_clean_judges_texts_not_ids(make, items):
    leak, other = ITEMS[1][1], "clean text of its own " * 5
    docs = make([{"doc_id": d, "text": t} for d, t in [(1, leak), (1, other), (None, leak), (None, other), (2, None)]], "leaked map<string,int>")
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, other), (2, None), (None, other)]


def test_copies_in_other_case_or_without_full_stops(make, spark):
    asked = [
        "What is the capital of France?", "Name the street: Große Straße in old Berlin. The answer is short. Then stop.",
        "The shop of Anna opens at 9:30 and shuts at 12:30 on every day but one, so how long is it open then",
        "He had twenty-five red apples in the basket and gave away most of them before noon on that day",
    ]
    items = spark.createDataFrame([*enumerate(asked, 1)], "item_id long, text string")
    texts = [(10 * i + k, f"x {t} y") for i, a in enumerate(asked, 1) for k, t in enumerate([a, a.lower(), a.upper()])]
    assert found(make, items, texts) == [(10 * i + k, i, True) for i in range(1, 5) for k in range(3)]
    texts = [
        (1, asked[1].replace(".", "")), (2, asked[2].replace("9:30", "10:30")),
        (3, asked[2].replace("9:30", "8:15").replace("12:30", "11:15")), (4, asked[3].replace("twenty-five", "thirty-one")),
        (5, asked[3].replace("twenty-five", "31")),
    ]
    assert found(make, items, texts) == [(1, 2, True), (2, 3, False), (3, 3, False), (4, 4, False), (5, 4, False)]
    assert [decontaminate._is_number(w) for w in ("twenty-five", "one-hundred-and-five", "one-way")] == [True, True, False]
