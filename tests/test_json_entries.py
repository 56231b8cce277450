"""JSON objects cut into byte ranges, against the plain parser."""

import json
import random

import pytest

from fieldloom.sources import json_entries as je
from fieldloom.sources import labels

CORRUPT = [
    b"", b"  ", b"[]", b"{", b'{"a": 1', b'{"a": 1,}', b'{"a": 1, }', b'{"a" 1}', b'{"a": 1}{"b": 2}', b'{"a": 1}, "b": 2}',
    b'{"a": "x}', b'{,"a": 1}', b'{"a": 1}}', b'{1: 2}', b'{"a": tru}', b'x{"a": 1}',
]


def texts(seed, n):
    """JSON objects with braces, quotes and backslashes in strings, deep values and odd white space."""
    rng = random.Random(seed)
    pieces = ["a", "{", "}", "[", "]", ",", '"', "\\", ":", "ü", "\n", " ", "日"]

    def value(depth):
        kind = rng.randrange(6 if depth < 4 else 3)
        if kind == 0:
            return rng.choice([None, True, 1.5, -3])
        if kind < 3:
            return "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        if kind == 3:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {value(9) or "k": value(depth + 1) for _ in range(rng.randrange(4))}

    for _ in range(n):
        made = {f"{i}\\{value(9)}": value(0) for i in range(rng.randrange(12))}
        yield made, json.dumps(made, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5).encode()


def cut(path, size, split):
    """The entries by ranges, with states handed on as the reader does."""
    found, quoted, depth = [], False, 0
    for start in range(0, size, split):
        end = min(size, start + split)
        found += list(je.entries(je._Range(path, start, end, quoted, depth)))
        turns, outside, inside = je.summary(je._blocks(path, start, end), je._escaped(path, start))
        quoted, depth = quoted != turns, depth + (inside if quoted else outside)
    assert (quoted, depth) == (False, 0)
    return found


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_ranges_of_any_length_give_every_entry_once(tmp_path, monkeypatch, block):
    monkeypatch.setattr(je, "_BLOCK", block)
    for n, (made, raw) in enumerate(texts(1, 12)):
        path = tmp_path / f"{n}.json"
        path.write_bytes(raw)
        for split in (5, 23, 10_000):
            found = cut(str(path), len(raw), split)
            places = [place for *_, place in found]
            assert [(key, json.loads(v)) for _, key, v, _ in found] == list(json.loads(raw).items())
            assert places == sorted(set(places))


@pytest.mark.parametrize("split", [4, 1 << 20])
@pytest.mark.parametrize("raw", CORRUPT)
def test_corrupt_files_are_errors(spark, folder, raw, split):
    with open(f"{folder}/bad.json", "wb") as out:
        out.write(raw)
    with pytest.raises(Exception, match="bad.json"):
        je.json_entries(spark, f"{folder}/bad.json", split).collect()
        raise AssertionError("no error")


def test_a_large_label_file_is_read_by_many_tasks(spark, folder):
    made = {f"{i}.pdf": {"seller": f"s, \"{i}\" {{", "total": None if i % 3 else "1.10"} for i in range(20_000)}
    raw = json.dumps(made).encode()[:-1] + b', "7.pdf": {"seller": "early", "seller": "last", "n": 3}}'
    with open(f"{folder}/labels.json", "wb") as out:
        out.write(raw)
    found = je.json_entries(spark, f"file:{folder}/labels.json", 100_000)
    assert found.rdd.getNumPartitions() == -(-len(raw) // 100_000) > 10
    held = found.selectExpr("spark_partition_id() p").groupBy("p").count().collect()
    assert len(held) > 10 and max(r["count"] for r in held) < 3 * 20_001 / len(held)
    got = {(r.document, r.field): r.expected for r in labels.read_labels(spark, folder, 100_000).collect()}
    wanted = {(d, f): v for d, fields in made.items() for f, v in fields.items() if d != "7.pdf"}
    assert got == wanted | {("7.pdf", "seller"): "last", ("7.pdf", "n"): "3"}


def test_missing_is_empty_and_files_stay_apart(spark, folder):
    assert je.json_entries(spark, f"{folder}/none").count() == 0
    assert labels.read_labels(spark, f"{folder}/none").count() == 0
    for name, text in (("a.json", '{"x": {"f": "1"}}'), ("b.json", ' {"x": {"f": "2"}, "y": null, "z": {}} \n'), ("_c", "no")):
        with open(f"{folder}/{name}", "w") as out:
            out.write(text)
    got = sorted(map(tuple, labels.read_labels(spark, folder).collect()))
    assert got == [("x", "f", "1"), ("x", "f", "2")]
