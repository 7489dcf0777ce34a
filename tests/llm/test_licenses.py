import re

import duckdb

from veritrace.llm import licenses as li

BREAK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return BREAK.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w = words(text)
    places = [(i, label) for p, label in li.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(out, docs):
    key = lambda r: tuple((x is None, x or 0) for x in r[:3]) + r[3:]
    want = [(d, *base(x)) for d, x in docs]
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out]
    assert sorted(got, key=lambda r: str(r)) == sorted(want, key=lambda r: str(r))
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) for r in out)
    assert all((r["score"] == 1) for r in out if r["n_base"])
    return key


def test_odd_rows(odd, none, texts):
    check(li.license_scans(odd).collect(), texts)
    assert li.license_scans(none).count() == 0


def test_base_of_documents(spark, documents):
    check(li.op1_license_scans(spark, "/root/testdata/sf0.001").collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_parts_of_notices(spark):
    mit = next(x for label, _, x in li.NOTICES if label == "mit")
    rows = [
        (1, "x y " + mit + " z"),
        (2, "x y " + mit.replace("to deal", "to freely deal").replace("modify, ", "") + " z"),  # a word more, a word less
        (3, " ".join(mit.split()[:20])),  # too little of it
        (4, "under the Kit license"),  # no Latin letter
        (5, "Under The MIT License, under the mit license!"),
        (6, " ".join(w + " pad" * 40 for w in mit.split())),  # its words, but scattered
    ]
    got = {r["doc_id"]: r for r in li.license_scans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1 and got[1]["n_base"] == 0 and got[2]["labels"] == "mit" and got[2]["score"] > 0.8
    assert got[3]["labels"] == got[4]["labels"] == got[6]["labels"] == ""
    assert (got[5]["n_base"], got[5]["first_word"], got[5]["last_word"]) == (2, 0, 4)


def test_sql_agrees(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()  # noqa: F841  DuckDB reads it by name
    want = duckdb.sql(li.ORACLE)
    cols = want.columns
    got = li.op1_license_scans(spark, "/root/testdata/sf0.001").select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
LATER = "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"
WARRANTY = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
CASES = [
    (GPL + ", either version 3 " + LATER, "gpl-3"),
    (GPL + "; either version 2 " + LATER, "gpl-2"),
    (GPL.replace("General", "Lesser General") + "; either version 2.1 " + LATER, "lgpl"),
    (GPL.replace("General", "Affero General") + ", either version 3 " + LATER, "agpl-3"),
    ("This file is licensed under the GNU General Public License, version 2.", "gpl-2"),
    ("This file is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
    (next(x for label, _, x in li.NOTICES if label == "mit") + ":\n\n" + WARRANTY, "mit"),
    (GPL + ", either version 3 " + LATER + " filler" * 40 + " This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by,gpl-3"),
    ("The general public may use the license office, version 3 of the form, as published by the foundation.", ""),
    ("A creative commons of artists gave this work its attribution and an international license to sing.", ""),
    ("Permission to use this room is hereby granted, free of charge, to any person obtaining a key.", ""),
]


def test_siblings_are_told_apart(spark):
    df = spark.createDataFrame([(i, "Copyright 2020 Some One.\n" + x + "\nSource follows.") for i, (x, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in li.license_scans(df).collect()}
    assert {i: got[i] for i in got} == {i: label for i, (_, label) in enumerate(CASES)}


def brute_labels(text):
    """Labels by trying every place of every template, without hashes, joins or windows."""
    w, k, spans, labels = words(text), li.K, [], set()
    for t, (label, exact, tw, must) in enumerate(li.templates()):
        full = len(tw) - k + 1
        hits = [(p - q, q, p) for p in range(len(w) - k + 1) for q in range(full) if w[p : p + k] == tw[q : q + k]]
        group = []
        for diag in [*sorted({d for d, _, _ in hits}), None]:
            if group and (diag is None or exact or diag - group[-1] > li.DRIFT):
                own = [(q, p) for d, q, p in hits if d in group]
                covers, low, high = {q for q, _ in own}, min(p for _, p in own), max(p for _, p in own)
                if exact and len(covers) == full:
                    labels.add(label)
                if not exact and len(covers) >= li.COVERAGE * full - 1e-9 and must <= covers and high + k - low <= len(tw) * li.STRETCH:
                    spans.append((low, high, t, len(covers), label))
                group = []
            group.append(diag)
    end, island = -1, []
    for x in [*sorted(spans), None]:
        if island and (x is None or x[0] >= end):
            labels.add(min(island, key=lambda y: (-y[3], y[2], y[0]))[4])
            island = []
        if x:
            end = max(end, x[1] + k) if island else x[1] + k
            island.append(x)
    return ",".join(sorted(labels))


def test_labels_match_brute_force(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()][:120]
    docs += [(10_000 + i, x) for i, (x, _) in enumerate(CASES)] + [(20_000, " ".join(x for x, _ in CASES))]
    got = {r["doc_id"]: r["labels"] for r in li.license_scans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: brute_labels(x) for d, x in docs}
