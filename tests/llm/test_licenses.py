"""License notices against exact containment."""

import re

from fieldloom.llm import licenses


def words(text):
    return re.findall("[a-z0-9]+", re.sub("[^A-Za-z0-9]", " ", text or "").lower())


def shingles(ws):
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def plain(rows):
    best = {}
    for doc_id, text in rows:
        ws = words(text)
        for name, notice in licenses.TEMPLATES.items():
            n, wanted = licenses.window_of(len(words(notice))), shingles(words(notice))
            for a in range(0, len(ws), n // 2):
                share = len(shingles(ws[a : a + n]) & wanted) / len(wanted)
                if share >= licenses.CONTAINED:
                    old = best.get((doc_id, name), (set(), 0.0, a))
                    best[doc_id, name] = (old[0] | {a}, max(old[1], share), min(old[2], a))
    return sorted(((d, n, len(p), s, a) for (d, n), (p, s, a) in best.items()), key=str)


def test_scan_equals_exact_containment(make):
    filler = " ".join(f"w{i}" for i in range(90))
    rows = [(i, filler[: 9 * i] + " " + t + " " + filler) for i, t in enumerate(licenses.TEMPLATES.values())]
    gpl = licenses.TEMPLATES["gpl-notice"]
    rows += [
        (20, licenses.TEMPLATES["mit"].upper()), (21, "released, UNDER\n the (MIT) license"), (22, gpl.replace("free", "x", 1)),
        (23, gpl.replace("redistribute", "x").replace("terms", "y")), (24, "license " * 30_000), (25, ""), (26, None),
        (27, "?!"), (28, "MIT License"), (None, licenses.TEMPLATES["bsd"]), (20, licenses.TEMPLATES["mit"]),
        (29, filler * 300 + " Licensed under CC BY-NC 4.0."),
    ]
    found = licenses.license_scan(make([{"doc_id": d, "text": t} for d, t in rows])).collect()
    assert sorted(map(tuple, found), key=str) == plain(rows)
    assert licenses.license_scan(make([])).count() == 0


def test_bands_and_anchors_guarantee_retrieval():
    for notice in licenses.TEMPLATES.values():
        ws = words(notice)
        n, wanted = licenses.window_of(len(ws)), shingles(ws)
        assert n >= 2 * len(ws)
        found = -(-8 * len(wanted) // 10)
        least = found / (n - 4 + len(wanted) - found)
        assert (1 - least) ** licenses.bands_for(n, len(wanted)) <= licenses.MISS
        assert all(set(s) & set(licenses.anchors(licenses.TEMPLATES)) for s in wanted)


def test_usual_notices_of_other_licenses_are_found(make):
    texts = {
        "mit-licensed": "Licensed under the MIT License", "apache-2.0-short": "licensed under the Apache License 2.0",
        "lgpl-short": "Licensed under the GNU Lesser General Public License", "isc": "Licensed under the ISC License.",
        "agpl-notice": "modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "epl-2.0-short": "Licensed under the Eclipse Public License 2.0", "cc0-1.0": "Creative Commons CC0 1.0 Universal",
        "cc-by-4.0": "Licensed under CC BY 4.0", "cc-by-nd-4.0": "licensed under CC BY-ND 4.0",
    }
    docs = make([{"doc_id": i, "text": f"Some text before. {t} Some text after."} for i, t in enumerate(texts.values())])
    found = {(r.doc_id, r.license) for r in licenses.license_scan(docs).collect()}
    assert set(enumerate(texts)) <= found
