"""The mapped elements of invoice XML, read by the tags of the whole document.

Whether a document is well-formed, and which of its texts are mapped, depends on
its tags alone where there are no comments, CDATA or instructions. Documents of
like tags are many, so a parser looks once at each list of tags, with numbers in
the place of texts, and notes which texts to take.

This reads what nearly all documents are: UTF-8, well-formed, without comments,
CDATA, instructions or a document type, and with plain text in the elements that
are mapped. For any other document the result is null, and the checks and the
parser of ``invoice_xml`` decide; so nothing is judged here that could be judged
differently there.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pyexpat import ExpatError, ParserCreate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_COUNTED = ("n_profiles", "n_dates", "n_sellers", "n_currencies", "n_totals")
_SCALARS = (
    "root_tag", "n_profiles", "profile", "n_dates", "date", "date_format",
    "n_sellers", "seller", "n_currencies", "currency", "n_totals", "total",
)
#: n_<field>: how many elements there are; the texts of single ones; dates have their first format.
LEAVES = ", ".join(f"{n}: {'int' if n in _COUNTED else 'string'}" for n in _SCALARS) + (
    ", items: array<struct<name: string, total: string>>"
)
#: The scalars that are texts of elements.
_PLACES = [_SCALARS.index(name) for name in ("profile", "date", "seller", "currency", "total")]
_TYPES = [pa.int32() if n in _COUNTED else pa.string() for n in _SCALARS]
_ITEM = [pa.field("name", pa.string()), pa.field("total", pa.string())]

#: Mapped elements by local name; numbers tell the leaves apart.
PROFILE, DATE, SELLER, CURRENCY, TOTAL, NAME, AMOUNT = range(7)
_ITEM_TAG = "IncludedSupplyChainTradeLineItem"
_LINE = {
    "SpecifiedTradeProduct": {"Name": NAME},
    "SpecifiedLineTradeSettlement": {"SpecifiedTradeSettlementLineMonetarySummation": {"LineTotalAmount": AMOUNT}},
}
_TRADE = {
    "ApplicableHeaderTradeAgreement": {"SellerTradeParty": {"Name": SELLER}},
    "ApplicableHeaderTradeSettlement": {
        "InvoiceCurrencyCode": CURRENCY,
        "SpecifiedTradeSettlementHeaderMonetarySummation": {"GrandTotalAmount": TOTAL},
    },
    _ITEM_TAG: _LINE,
}
_ROOT = {
    "ExchangedDocumentContext": {"GuidelineSpecifiedDocumentContextParameter": {"ID": PROFILE}},
    "ExchangedDocument": {"IssueDateTime": {"DateTimeString": DATE}},
    "SupplyChainTradeTransaction": _TRADE,
}
#: A text that is not white space alone, between two tags.
_BETWEEN = re.compile(r">(\s*[^<\s][^<]*)<", re.ASCII)
_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);)")
_CONTROLS = bytes(c for c in range(32) if c not in (9, 10))
#: Lists of tags that are remembered, and the longest of them.
_KEPT, _LONGEST = 2048, 16 * 1024
_PREFIX = re.compile(r"[A-Za-z_][\w-]*\Z", re.ASCII)


class _Other(Exception):
    """The document is left to the full checks."""


def _parse(data: str, depth_limit: int, spaces: str):
    """The leaves of a document whose texts are numbers, in the order of ``LEAVES``; raises for others."""
    parser = ParserCreate("utf-8")
    parser.buffer_text = True
    parser.ordered_attributes = True
    found = ([], [], [], [], [], [], [])
    formats, items, foreign, stack = [], [], set(), []
    node, leaf, depth, skipped, root_tag = None, None, 0, 0, None
    item_start, trades, bindings = (0, 0), 0, 0
    pieces = []

    def declaration(version, encoding, standalone):
        if version != "1.0" or (encoding or "utf-8").lower() != "utf-8":
            raise _Other

    def started_root(tag, attributes):
        nonlocal root_tag, bindings
        given = dict(zip(attributes[::2], attributes[1::2]))
        for key, value in given.items():
            if not value.isprintable() or any(part in value for part in ("xmlns", "&", "<", "'", '"')):
                raise _Other
            if key.startswith("xmlns:"):
                bindings += 1
                if not _PREFIX.match(key[6:]):
                    raise _Other
                if not value.startswith(spaces):
                    foreign.add(key[6:])
            elif ":" in key or key in ("corrupt_record", "_corrupt_record"):
                raise _Other
        prefix, colon, name = tag.rpartition(":")
        if ":" in prefix or prefix in foreign:
            raise _Other
        space = given.get(f"xmlns:{prefix}" if colon else "xmlns")
        root_tag = f"{{{space}}}{name}" if space else name

    def started(tag, attributes):
        nonlocal node, leaf, depth, skipped, item_start, trades
        depth += 1
        if depth > depth_limit:
            raise _Other
        if skipped:
            skipped += 1
            return
        if leaf is not None:
            raise _Other
        if node is None:
            started_root(tag, attributes)
            node = _ROOT
            return
        local = tag.rpartition(":")[2]
        if foreign and tag.partition(":")[0] in foreign:
            local = ""
        below = node.get(local)
        if below is None:
            if local == "_corrupt_record":
                raise _Other
            skipped = 1
            return
        if attributes and (below != DATE or len(attributes) != 2 or attributes[0] != "format"):
            raise _Other
        if below.__class__ is int:
            leaf = below
            if leaf == DATE:
                if not attributes or not attributes[1].isalnum():
                    raise _Other
                formats.append(attributes[1])
            return
        stack.append(node)
        node = below
        if local == _ITEM_TAG:
            item_start = len(found[NAME]), len(found[AMOUNT])
        elif below is _TRADE:
            trades += 1

    def ended(tag):
        nonlocal node, leaf, depth, skipped
        depth -= 1
        if skipped:
            skipped -= 1
            return
        if leaf is not None:
            text = "".join(pieces)
            pieces.clear()
            if not text.isdigit():
                raise _Other
            found[leaf].append(int(text))
            leaf = None
            return
        if node is _LINE:
            names, totals = item_start
            mine, sums = found[NAME][names:], found[AMOUNT][totals:]
            items.append((mine[0] if len(mine) == 1 else None, sums[0] if len(sums) == 1 else None))
            if not mine and not sums:
                raise _Other
        node = stack.pop() if stack else None

    def text(piece):
        if leaf is not None:
            pieces.append(piece)
        elif not skipped and piece.strip(" \t\n"):
            raise _Other

    parser.XmlDeclHandler = declaration
    parser.StartElementHandler = started
    parser.EndElementHandler = ended
    parser.CharacterDataHandler = text
    parser.Parse(data, True)
    if not trades or data.count("xmlns:") != bindings:
        raise _Other

    def one(values):
        return values[0] if len(values) == 1 else None

    profiles, dates = found[PROFILE], found[DATE]
    row = [root_tag, len(profiles), profiles[0] if profiles else None, len(dates), one(dates), formats[0] if formats else None]
    for leaf_kind in (SELLER, CURRENCY, TOTAL):
        row += [len(found[leaf_kind]), one(found[leaf_kind])]
    return row, items


def _plan(tags: str, depth_limit: int, spaces: str):
    """What ``_parse`` finds behind a list of tags; None if the full checks have to look at it."""
    pieces = tags.split("\0")
    try:
        return _parse(
            pieces[0] + "".join(f">{i}<{piece}" for i, piece in enumerate(pieces[1:])), depth_limit, spaces
        )
    except (_Other, ExpatError):
        return None


_known_plan = lru_cache(_KEPT)(_plan)


def _text(text: str) -> str:
    if "&" in text:
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            text = text.replace(entity, char)
        if "<" in text:
            raise _Other
    return text


def _read(data: bytes, most: int, depth_limit: int, spaces: str):
    """The leaves of one document and its items; raises for documents that need the full checks."""
    if len(data) > most or data[:1] != b"<" or b"<!" in data or b"]]>" in data:
        raise _Other
    if data.count(b"<?") != data.startswith(b"<?xml ") or len(data.translate(None, _CONTROLS)) != len(data):
        raise _Other
    document = data.decode("utf-8")
    if not data.isascii() and ("\ufffe" in document or "\uffff" in document):
        raise _Other
    if b"&" in data and _ENTITY.search(document):
        raise _Other
    pieces = _BETWEEN.split(document)
    tags = "\0".join(pieces[::2])
    plan = (_known_plan if len(tags) <= _LONGEST else _plan)(tags, depth_limit, spaces)
    if plan is None:
        raise _Other
    texts = pieces[1::2]
    row = list(plan[0])
    for place in _PLACES:
        if row[place] is not None:
            row[place] = _text(texts[row[place]])
    items = [
        (None if n is None else _text(texts[n]), None if t is None else _text(texts[t])) for n, t in plan[1]
    ]
    return row, items


def _reader(most: int, depth_limit: int, spaces: str):
    def read(content: pa.Array) -> pa.Array:
        columns = [[] for _ in _SCALARS]
        offsets, names, totals, missing = [0], [], [], []
        for data in content.to_pylist():
            try:
                row, items = _read(data, most, depth_limit, spaces)
                missing.append(False)
            except (_Other, UnicodeDecodeError, TypeError):
                row, items = [None] * len(columns), []
                missing.append(True)
            for values, value in zip(columns, row):
                values.append(value)
            for name, total in items:
                names.append(name)
                totals.append(total)
            offsets.append(len(names))
        lines = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(totals, pa.string())], fields=_ITEM)
        arrays = [pa.array(values, kind) for values, kind in zip(columns, _TYPES)]
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines))
        fields = [pa.field(n, a.type) for n, a in zip((*_SCALARS, "items"), arrays)]
        return pa.StructArray.from_arrays(arrays, fields=fields, mask=pa.array(missing, pa.bool_()))

    return read


def read_leaves(content: Column, most: int, depth_limit: int, spaces: str) -> Column:
    """A struct of ``LEAVES`` per document; null for documents that need the full checks.

    ``most`` bounds the bytes, ``depth_limit`` the nesting, and ``spaces`` is how
    the namespaces of an invoice begin.
    """
    # Not deterministic for the planner: a filter pushed down would read all documents again.
    reader = F.arrow_udf(_reader(most, depth_limit, spaces), f"struct<{LEAVES}>")
    return reader.asNondeterministic()(F.when(F.length(content) <= most, content))
