import random
import re
from collections import Counter
from itertools import permutations

import pytest

from millrace.llm import filter_audit


def brute(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        rows.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, share = [], Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [r for r in own if f in r[1] and not r[1] & set(order[:k])]
                share[part, f] += len(here)
                out.append((part, "".join(order), k + 1, sum(not r[1] & set(order[: k + 1]) for r in own), len(here), sum(f in r[1] for r in own) - len(here), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here), f))
    return sorted((*r[:-1], share[r[0], r[-1]]) for r in out)


def tables(spark, docs, labels):
    return (
        spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, lang string, part string, mask int, quality int").repartition(7),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.mark.parametrize("held", [1, 1 << 24])
def test_equals_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD", held)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeÄ") for _ in range(r.randint(1, 3)))
    texts = [" ".join(word() for _ in range(r.choice([3, 199, 200, 400]))) + r.choice(["", "", "|", " AB CD EF GH IJ KL MN"]) for _ in range(30)] + ["", None, "x\x0b\x1cy z", "hot"]
    docs = [(r.choice([None, *range(300)]), r.choice(texts + ["hot"] * 20), r.choice(["en", "de", None, ""])) for _ in range(400)]
    labels = [(r.randint(0, 300), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(200)]
    assert sorted(map(tuple, filter_audit.audited(*tables(spark, docs, labels)).collect())) == brute(docs, labels)


def test_texts_of_one_fingerprint_are_told_apart():
    """Chains compare whole texts."""
    rows = [(5, 7, b"x"), (1, 7, b"y |"), (4, 7, b"x"), (2, 7, b"y |"), (3, 7, b"z"), (5, 7, b"x")]
    for sent in (list(filter_audit._sent(rows)), [s for row in rows for s in filter_audit._sent([row])]):
        assert sorted(set(filter_audit._not_least(sent))) == [(2, 7), (5, 7)]


def test_a_hot_text_sends_one_copy_a_task():
    sent = list(filter_audit._sent([(i, 3, b"same text") for i in range(1000)]))
    assert sum(v[0] is not None for _, v in sent) == 1 and len(sent) == 1000


def test_empty_tables_and_long_texts(spark):
    docs, labels = tables(spark, [(1, "a b " * 500_000, "en"), (2, "a b " * 500_000, "en")], [(2, 1, 1)])
    assert filter_audit.audited(docs.filter("doc_id > 9"), labels).collect() == []
    assert sorted(map(tuple, filter_audit.audited(docs, labels.filter("doc_id > 9")).collect())) == brute([(1, "a b " * 500_000, "en"), (2, "a b " * 500_000, "en")], [])
