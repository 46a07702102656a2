import random

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import secret_scan, weak_quality
from tests.llm.test_near_copies import brute as near_brute
from tests.llm.test_near_copies import brute_links
from tests.llm.test_secret_scan import brute_patterns, whole_line_spans
from tests.llm.test_substring import brute

#: Names that clash with the operators' own.
ODD = "doc_id long, text string, lang string, source string, n_chars long, votes string, spans string, node string, place string, removed string, rank string, `of` string, one string, bands string, kept string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "v", "x", *"abcdefgh") for i, t in texts], ODD)


def prose(rng, n, words):
    out = []
    while n > 0:
        k = min(n, rng.randrange(5, 14))
        out.append(" ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else rng.choice(words) for _ in range(k)) + ".")
        n -= k
    return "\n".join(out)


def corpus(seed=5):
    """Texts with their truth: clean, junk of four kinds."""
    rng = random.Random(seed)
    words = ["w" + "".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts, clean = [], []
    for k in range(260):
        kind = rng.randrange(9) if k % 5 == 0 else 9
        t = prose(rng, rng.randrange(6 if kind >= 6 else 30, 500), words)
        if kind in (0, 1):
            t = " ".join(w + rng.choice(["###", "***", "$$$"]) for w in t.split())
        elif kind in (2, 3):
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif kind in (4, 5):
            t = " ".join(w for w in [w for w in t.split() if w.startswith("w")][:6] for _ in range(25))
        texts.append((k, t))
        clean.append(kind >= 6)
    return texts, clean


def test_label_model_recovers_accuracies():
    rng, counts = np.random.default_rng(1), {}
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.95, 0.85]
    for _ in range(30000):
        y = rng.random() < 0.8
        p = "".join("2" if rng.random() < 0.2 else str(int(y if rng.random() < r else not y)) for r in right)
        counts[p] = counts.get(p, 0) + 1
    model = weak_quality.estimate(counts)
    assert model.good == pytest.approx(0.8, abs=0.02)
    assert list(model.accuracy().values()) == pytest.approx(right, abs=0.02)


def test_classifier_without_true_labels(spark):
    texts, clean = corpus()
    docs = table(spark, texts + [(1000, None), (1001, ""), (1001, ""), (None, "the end of it is near and so on")])
    models = weak_quality.fitted(docs)
    rows = {r.doc_id: r for r in weak_quality.classified(docs, models).collect()}
    good = [rows[i].kept for i, _ in texts]
    held, junk = [g for g, c in zip(good, clean) if c], [g for g, c in zip(good, clean) if not c]
    assert np.mean(held) > 0.98 and np.mean(junk) < 0.05 and len(junk) > 20
    assert not rows[1000].kept and rows[1001].score == 0 and rows[None].kept
    assert weak_quality.kept(docs, models).count() == sum(good) + 1
    again = {r.doc_id: r for r in weak_quality.classified(docs.repartition(3)).collect()}
    assert again == rows
    empty = table(spark, [])
    assert weak_quality.classified(empty).count() == 0 and weak_quality.kept(empty).columns == empty.columns


def brute_masked(text, field):
    """Patterns and the field's whole-line spans by plain sets of places."""
    patterns = [tuple(map(int, p.split(":")[1:])) for p in brute_patterns(text)]
    taken = {n for a, b in patterns for n in range(a, b)}
    parts = []
    for a, b in whole_line_spans(text, field):
        run = []
        for n in [*range(a, b), None]:
            if n is not None and n not in taken:
                run.append(n)
            elif run:
                while run and text[run[0]].isspace():
                    run.pop(0)
                while run and text[run[-1]].isspace():
                    run.pop()
                parts += [(run[0], run[-1] + 1)] if run else []
                run = []
    out, at = "", 0
    for a, b in sorted(patterns + parts):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def plain_estimate(votes, rounds):
    """Expectation-maximisation document by document, in plain numbers."""
    good = []
    for v in votes:
        fine, alarms = sum(x == "1" for x in v) + 1, weak_quality.ALARM * sum(x == "0" for x in v) + 0.1
        good.append(fine / (fine + alarms))
    for _ in range(rounds):
        share = (sum(good) + 1) / (len(votes) + 2)
        chance = {}
        for i in range(len(votes[0])):
            for c in (0, 1):
                cast = [0.5 + sum((g if c else 1 - g) for v, g in zip(votes, good) if v[i] == str(x)) for x in (0, 1)]
                chance[i, c] = [x / sum(cast) for x in cast]
        good = []
        for v in votes:
            odds = [1 - share, share]
            for i, x in enumerate(v):
                if x != "2":
                    odds = [odds[c] * chance[i, c][int(x)] for c in (0, 1)]
            good.append(odds[1] / sum(odds))
    return share, good


def test_label_model_equals_plain_loops():
    rng = np.random.default_rng(4)
    votes = ["".join("2" if rng.random() < 0.2 else str(int((rng.random() < 0.8) == (k % 4 > 0))) for _ in range(8)) for k in range(300)]
    counts = {}
    for v in votes:
        counts[v] = counts.get(v, 0) + 1
    model = weak_quality.estimate(counts, rounds=7)
    share, good = plain_estimate(votes, 7)
    assert model.good == pytest.approx(share) and [model.posterior(v) for v in votes] == pytest.approx(good)


def test_accuracy_on_labelled_documents_outside_of_the_sample(spark):
    """Against the table of labels, which the fit never reads, on documents that the scorer was not trained on."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sample = 2000
    models = weak_quality.fitted(docs, sample)
    share = sample / docs.count()
    outside = weak_quality.votes(docs).filter(f"pick >= {int(share * (1 << 31))}").select("doc_id")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = weak_quality.classified(docs, models).join(outside, "doc_id").join(labels, "doc_id").select("kept", "quality").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert len(good) > 1000 and len(bad) > 100
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_stages_equal_brute_force(spark, tmp_path):
    texts, _ = corpus(6)
    rng = random.Random(7)
    for k in range(60):
        i, t = rng.choice(texts)
        w = t.split(" ")
        if k % 2:
            w[rng.randrange(len(w))] = "changed"
        texts.append((500 + k, " ".join(w)))
    shared = "here are many words of a line that is long enough to be one of those that are cut"
    texts += [(699, "of it\n" + shared + "\nand the end of it is near and so on to the last of them"), (700, shared + "\nthe unlike end of it all and more words to keep\n" + shared), (701, "the password=b7db7aa4a5fcc78305 of and to\n" + texts[9][1]), (702, None), (703, ""), (None, prose(rng, 40, ["no", "id", "here"])), texts[0], texts[0]]
    docs = table(spark, texts)
    models = weak_quality.fitted(docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    one = corpus_pipeline.quality(spark, docs, "")
    assert one.columns == docs.columns
    kept = [(i, t) for i, t in texts if weak_quality._judge(*models, (t or "").encode())[3]]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r.doc_id, r.text) for r in one.collect()], key=key) == sorted(kept, key=key)

    two = corpus_pipeline.near_duplicates(spark, one, "")
    assert two.columns == docs.columns
    distinct = sorted(set(kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    loose, close = brute_links(distinct)
    chosen = [distinct[n] for n in near_brute(distinct, loose | close)]
    assert sorted([(r.doc_id, r.text) for r in two.collect()], key=key) == sorted(chosen, key=key)
    assert len(chosen) < len(distinct)

    three = corpus_pipeline.repeats(spark, two, "")
    assert three.columns == docs.columns
    cut = brute(chosen)
    left = [(i, cut[i, t][0]) for i, t in chosen if cut[i, t][0].split() or not cut[i, t][1]]
    assert sorted([(r.doc_id, r.text) for r in three.collect()], key=key) == sorted(left, key=key) and any(s for _, s in cut.values())

    four = corpus_pipeline.secrets(spark, three, "")
    assert four.columns == docs.columns
    field = secret_scan.trained()
    masked = [(i, brute_masked(t, field)) for i, t in left]
    rows = four.collect()
    assert sorted([(r.doc_id, r.text) for r in rows], key=key) == sorted(masked, key=key)
    assert all(r.n_chars == len(r.text) for r in rows) and any("[SECRET]" in t for _, t in masked)

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((str(p.doc_id), p.doc_tokens), []).append((p.start, p.length))
    assert len(by_doc) == len(masked) and names[-1] == "packing"
    for (_, total), runs in by_doc.items():
        at = 0
        for start, length in sorted(runs):
            assert start == at
            at += length
        assert at == total


def test_empty_documents_pass_all_stages(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
