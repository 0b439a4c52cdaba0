from kymo.llm import licences as L


def test_known_texts_are_found_in_other_spellings(spark):
    mit = L.KNOWN["MIT"]
    texts = [
        ("MIT", "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,").replace("SUBLICENSE", "sub-licence")), ("MIT", mit.replace("\n", "\n\n   ").replace('"', "'")), (None, mit[:-20]), (None, mit + " and more"),
        ("ISC", L.KNOWN["ISC"]), ("BSD-3-Clause", "Copyright 2001, X. All rights reserved.\n" + L.KNOWN["BSD-3-Clause"]), ("Zlib", "(C) 1999 Y\n" + L.KNOWN["Zlib"]),
    ]
    rows = L.scanned(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.row.doc_id: r.licence for r in rows} == {i: n for i, (n, _) in enumerate(texts)}


def test_notices_are_entire_lines(spark):
    text = "Words.\n  Licensed under the Apache Licence, version 2.0\nReleased under the MIT License.\nReleased under the MIT License, mostly."
    r = L.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.licence is None and r.notices == ["Apache-2.0-notice", "MIT-notice"]


def test_digests_differ():
    assert len(L.digests()) == len(L.KNOWN)


def test_neighbouring_spellings_and_lines_of_any_words(spark):
    own = {L.hashlib.sha256(x.encode()).hexdigest(): n for n, x in (("twice", "licensed licensed under the mit"), ("plain", "free for all uses"), ("two", "for noncommercial noncommercial use"), ("over", "this is noninfringement"))}
    texts = ["Licenced licenced under the MIT", "intro\n*** Free, for ALL uses! ***\nout", "for non-commercial non commercial use", "This is non-\ninfringement", "licenced\nlicensed under the MIT"]
    rows = L.scanned(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), known=own).collect()
    assert {r.row.doc_id: (r.licence, r.notices) for r in rows} == {0: ("twice", ["twice"]), 1: (None, ["plain"]), 2: ("two", ["two"]), 3: ("over", []), 4: ("twice", [])}
    for t in texts:
        assert L.canonical_of(t) == spark.range(1).select(L.canonical(L.F.lit(t))).first()[0]


def test_whole_licences_among_documents(spark):
    """Planted whole texts, with other cases, spacing and spellings, among documents that only quote them."""
    import random

    rng = random.Random(3)
    whole = [n for n in L.KNOWN if not n.endswith(("-notice", "-header", "-tag"))]
    rows, want = [], {}
    for i in range(200):
        name = rng.choice(whole)
        text = L.KNOWN[name]
        kind = i % 4
        if kind == 0:
            text = "Copyright (c) 2011 A. Body\n" + text.replace("license", "licence").replace(", ", ",\t  ")
        elif kind == 1:
            text = text.swapcase()
        elif kind == 2:
            text = text + "\nAnd one more sentence."
        else:
            text = "word " * 40
        rows.append((i, text))
        want[i] = name if kind < 2 else None
    got = {r.row.doc_id: r.licence for r in L.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_odd_rows(odd_docs, no_docs):
    rows = L.scanned(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.licence is None and r.notices == [] for r in rows if r.row.text is not None)
    assert all(r.digest is None and r.licence is None for r in rows if r.row.text is None)
    assert L.scanned(no_docs).collect() == []


def test_full_texts_and_headers(spark):
    full = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"]
    texts = [(n, L.KNOWN[n]) for n in L.KNOWN if not n.endswith(("-notice", "-header", "-tag"))]
    assert set(full) <= {n for n, _ in texts} and all(len(L.KNOWN[n]) > 1000 for n in full)
    texts += [(n, L.KNOWN[n].replace("  ", " ").upper()) for n in full] + [(None, L.KNOWN["GPL-3.0"].replace("freedom", "liberty"))]
    rows = L.scanned(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.row.doc_id: r.licence for r in rows} == {i: n for i, (n, _) in enumerate(texts)}
    header = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n// SPDX-License-Identifier: MPL-2.0"
    assert L.scanned(spark.createDataFrame([(1, header)], "doc_id long, text string")).first().notices == ["Apache-2.0-header", "MPL-2.0-tag"]


def test_a_table_of_digests_given(spark):
    own = {L.hashlib.sha256(L.canonical_of("Our Own Licence").encode()).hexdigest(): "Own"}
    rows = L.scanned(spark.createDataFrame([(1, "OUR own license!"), (2, L.KNOWN["MIT"])], "doc_id long, text string"), known=own).collect()
    assert {r.row.doc_id: r.licence for r in rows} == {1: "Own", 2: None}
