from millrace.llm import licence_texts, licenses

ODD = "doc_id long, text string, lines string, digest string, license_id string"


#: A notice of several lines in a block of its own.
BLOCK = "This file may be used under\nthe terms of the Example licence,\nversion 2."
KNOWN = [*licence_texts.KNOWN, ("Example-2", BLOCK), ("Example-2-too", BLOCK)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], ODD)


def test_equivalent_texts_meet(spark):
    mit = licence_texts.MIT
    texts = [
        (1, mit),
        (2, mit.upper().replace("\n", "\r\n\r\n").replace(",", " ,")),
        (3, mit.replace("<year> <copyright holders>", "2024 Some One") + "\n\n  Copyright 2019 Another\n© 2020 Third\nAll rights reserved.\n"),
        (4, mit.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "NON-\nINFRINGEMENT").replace("MIT License", "MIT Licence")),
        (5, mit.replace("without restriction", "with restriction")),
        (6, "Prose.\nreleased under the MIT LICENCE\nmore\n* Licensed under CC BY-NC 4.0. *\nReleased under the MIT License."),
        (7, None),
        (8, ""),
        (9, "... !!"),
        (None, "no id"),
        (10, "word " * 60000),
        (10, "word " * 60000),
        (11, licence_texts.APACHE_NOTICE.replace("http:", "https:")),
        (12, "def f():\n    pass\n\n" + licence_texts.APACHE_NOTICE.strip("\n").replace("\n\n", "\n") + "\n\nmore text"),
        (13, f"one\ntwo\n\n{BLOCK.upper()}\n \nthree\nfour"),
    ]
    rows = licenses.scanned(table(spark, texts), KNOWN)
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and plan.count("BroadcastHashJoin") == 1 and "partial_count" in plan
    got = {r.doc_id: r for r in rows.collect()}
    assert [got[k].license_id for k in (1, 2, 3, 4, 11)] == ["MIT"] * 4 + ["Apache-2.0"]
    assert [got[k].license_id for k in (5, 6, 7, 8, 9, None, 10, 12, 13)] == [None] * 9
    assert (got[13].n_notices, got[13].notices) == (1, ["Example-2"])
    assert (got[6].n_notices, got[6].notices) == (3, ["CC-BY-NC-4.0", "MIT"])
    assert got[7].canonical_sha256 == got[8].canonical_sha256 == got[9].canonical_sha256
    assert got[5].n_notices == 0 and rows.count() == len(texts)


def test_empty_table_and_catalogue(spark):
    assert licenses.scanned(table(spark, []), licence_texts.KNOWN).count() == 0
    rows = licenses.scanned(table(spark, [(1, "Released under the MIT License.")]), []).collect()
    assert rows[0].license_id is None and rows[0].notices == []


def test_large_catalogue_is_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST", 1)
    texts = [(k, t) for k, (_, t) in enumerate(KNOWN)] + [(100, "x\nReleased under the MIT License."), (101, None)]
    rows = licenses.scanned(table(spark, texts), KNOWN)
    assert sorted(map(str, rows.collect())) == sorted(map(str, licenses.scanned(table(spark, texts), reversed(KNOWN)).collect()))
    got = {r.doc_id: r for r in rows.collect()}
    assert all(got[k].license_id is not None for k in range(len(KNOWN))) and got[100].notices == ["MIT"]


def test_planted_licences_are_found(spark):
    """Every known text, in other dress, is met by its whole digest; a word less is not."""
    dress = lambda t: "Copyright (c) 2021 A. Person\n" + t.upper().replace("\n", "\n\n  ").replace(" ", "  ")
    rows = {r.doc_id: r for r in licenses.scanned(table(spark, [(k, dress(t)) for k, (_, t) in enumerate(licence_texts.KNOWN)] + [(100 + k, t.rsplit(None, 1)[0]) for k, (_, t) in enumerate(licence_texts.KNOWN)]), licence_texts.KNOWN).collect()}
    assert all(rows[k].license_id is not None and rows[100 + k].license_id is None for k in range(len(licence_texts.KNOWN)))
