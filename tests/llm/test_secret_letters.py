import random
import string

import pytest

from millrace.llm import secret_scan as S


@pytest.fixture(scope="module")
def field():
    return S.trained()


@pytest.mark.parametrize("chars,size", [(string.ascii_letters, 20), (string.ascii_lowercase, 16), (string.digits, 12), (string.ascii_letters + string.digits, 7)])
def test_secrets_of_any_characters_after_asking_words(field, chars, size):
    rng, hit = random.Random(7), 0
    for _ in range(200):
        lead = rng.choice(["Authorization: Bearer ", "pwd is ", "the key: ", "auth token "])
        text = lead + "".join(rng.choice(chars) for _ in range(size)) + " and go on"
        hit += S.without(text, S.all_spans(text, field)).endswith("[SECRET] and go on")
    assert hit / 200 > (0.85 if size < 8 else 0.9)  # few characters can read like a word


def test_words_near_asking_words_stay(field):
    text = "The key idea is that every author should check JavaScript and getElementById. Your password is required; token missing, authentication failed."
    assert S.all_spans(text, field) == []


def test_parts_of_the_field_outside_patterns_stay(monkeypatch):
    text = "x password: abcdef12 ghijkl34 y " + "0a" * 12 + "-Tail99"
    a, b, c = text.index("abcdef"), text.index("ghijkl"), text.index("0a0a")
    monkeypatch.setattr(S, "field_spans", lambda t, f: [(a, b + 8), (c, len(t))])
    spans = S.all_spans(text, None)
    assert [s for s in spans if s[0] == "crf"] == [("crf", b, b + 8), ("crf", c + 24, len(text))]
    clean = S.without(text, spans)
    assert "abcdef" not in clean and "ghijkl" not in clean and "Tail" not in clean and clean.startswith("x [SECRET]")


def test_field_inside_a_pattern_adds_nothing(monkeypatch):
    text = "token = 'abcdef99'"
    monkeypatch.setattr(S, "field_spans", lambda t, f: [(text.index("abc"), text.index("abc") + 8)])
    assert [k for k, _, _ in S.all_spans(text, None)] == ["assign"]


def test_few_clean_words_are_added_in_many_documents(spark, field):
    """Over 10,000 documents, words in SS (an upper-cased ß) among them; what the patterns find aside."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(16)
    rows = S.scanned(docs, field).selectExpr("size(filter(spans, s -> s.kind = 'crf')) AS n").collect()
    assert len(rows) == 10_000 and sum(r.n for r in rows) <= 10


@pytest.mark.parametrize("text", ["password reset instructions", "Your password was changed yesterday", "the API keys and IDs of the PDFs", "the key SSte und SSzu SSber", "token expiration and McGregor, iPhone keys"])
def test_prose_near_asking_words_stays(field, text):
    assert S.all_spans(text, field) == []
