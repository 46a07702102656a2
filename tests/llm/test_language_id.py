import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    kept = "".join(chr(ord(c.lower()[0])) if unicodedata.category(c)[0] == "L" else c if unicodedata.category(c)[0] == "M" else " " for c in text or "")
    out = Counter()
    for w in kept.split(" "):
        p = f" {w} " if w else ""
        out.update(p[i : i + k] for k in (1, 2, 3) for i in range(len(p) - k + 1) if p[i : i + k] != " ")
    return out


def brute_ranks(counts, size):
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], g))[:size])}


def brute_language(text, profiles, size):
    own = brute_ranks(brute_counts(text), size)
    if not any(c.isalpha() for c in text or "") or not profiles:
        return "und", 0.0
    far = {lang: sum(abs(r - p[g]) if g in p else size for g, r in own.items()) for lang, p in profiles.items()}
    best = min(far, key=lambda lang: (far[lang], lang))
    return best, 1 - far[best] / (size * len(own))


def test_ngrams_equal_plain_counts(monkeypatch):
    texts = ["", "!!", "a", "A b", "Éá ñ-ß x9y", "हिन्दी में", "Σίσυφος İ", "ab" * 50, "a b " * 40]
    for block in (1 << 20, 7):
        monkeypatch.setattr(language_id, "BLOCK", block)
        for t in texts:
            keys, counts, letters = language_id.ngrams(t)
            string = lambda k: "".join(chr(c) for c in (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF) if c)
            assert {string(int(k)): int(n) for k, n in zip(keys, counts)} == brute_counts(t)
            assert letters == any(c.isalpha() for c in t)


def test_query_equals_brute_force_and_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    counts = {}
    for r in rows.values():
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(brute_counts(r.text))
    profiles = {lang: brute_ranks(c, language_id.PROFILE) for lang, c in counts.items()}
    found = {r.doc_id: r for r in queries.op12_language_id(spark, SF).collect()}
    assert found.keys() == rows.keys()
    for i in list(rows)[::10]:
        assert (found[i].lang_pred, found[i].score) == brute_language(rows[i].text, profiles, language_id.PROFILE)
    held = [i for i in rows if found[i].held_out]
    assert set(held) == {i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(found[i].lang_pred == rows[i].lang for i in held) >= 0.99 * len(held)


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_odd_rows(spark, monkeypatch, held):
    monkeypatch.setattr(language_id, "HELD", held)
    texts = [(1, "the the cat", "en"), (1, "the the cat", "en"), (2, "der die katze", "de"), (3, "der hund", "de"), (4, "zzz", None), (5, None, "en"), (None, "the dog", "en"), (6, "", "de"), (7, "12 !", "de"), (8, "the" * 200_000, "en"), (9, "́", "de")]
    docs = spark.createDataFrame([(*t, "a", 2) for t in texts], "doc_id long, text string, lang string, gram string, score int")
    known = language_id.profiles(docs, profile=30)
    counts = {lang: sum((brute_counts(t) for _, t, own in texts if own == lang), Counter()) for lang in ("en", "de")}
    profiles = {lang: brute_ranks(c, 30) for lang, c in counts.items()}
    assert known.langs == ("de", "en")
    found = Counter(tuple(r) for r in language_id.identified(docs, known, "text", "doc_id", F.col("score").alias("own")).collect())
    assert found == Counter((i, 2, *brute_language(t, profiles, 30)) for i, t, _ in texts)
    assert [r.lang_pred for r in language_id.identified(docs.filter("doc_id in (5, 6, 7, 9)"), known).collect()] == ["und"] * 4
    none = language_id.profiles(docs.filter("doc_id > 100"))
    assert none.langs == () and {tuple(r) for r in language_id.identified(docs, none).collect()} == {("und", 0.0)}
    assert language_id.identified(docs.filter("doc_id > 100"), known).collect() == []


def test_equal_distances_go_to_the_first_language():
    keys, _, _ = language_id.ngrams("ab")
    same = language_id.Profiles(("aa", "bb"), keys, np.stack([np.arange(len(keys))] * 2, axis=1), 400)
    assert same.language("ab")[0] == "aa" and same.language("xyz") == ("aa", 0.0)
