import random

import numpy as np

import corpus_pipeline
from millrace.llm import near_copies
from tests.llm.test_simhash import brute_fingerprint

KIND = "doc_id long, text string, n_chars long, node string, __k1 long"


def brute_shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_links(texts, least=0.8):
    """All pairs (positions) of that similarity, or of fingerprints of two differing bits or fewer."""
    sets, fps = [brute_shingles(t) for _, t in texts], [brute_fingerprint(t) for _, t in texts]
    every = [(a, b) for a in range(len(texts)) for b in range(a)]
    loose = {(a, b) for a, b in every if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
    return loose, {(a, b) for a, b in every if bin(fps[a] ^ fps[b]).count("1") <= 2}


def brute(texts, links):
    """Positions that stay: the first of each class, texts being in order."""
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = least
    return [n for n, x in enumerate(label) if n == x]


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(500)]
    texts = []
    for k in range(50):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        for c in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(c * len(base) // 60):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append((1000 - 10 * k - c, " ".join(copy)))
    return texts


def test_stage_equals_brute_force(spark):
    """The stage leaves one document of each class of links of either kind; fingerprints alone leave most loose copies."""
    texts = sorted(corpus()) + [(2001, None), (2002, ""), (2003, " \n"), (2004, "one"), (2005, "One"), (2006, "one two"), (None, "one"), (None, "no other has this")]
    rows = texts + [texts[0], texts[0], texts[3]]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x", 1) for i, t in rows], KIND)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    loose, close = brute_links(texts)
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    want = [texts[n] for n in brute(texts, loose | close)]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted(want, key=str)
    assert len(loose - close) > 10 and len(want) < len(texts)
    assert stage(spark, docs.limit(0), "").count() == 0


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    """A group of many blocks loses no link: the chain holds only where every two blocks meet."""
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    rng = random.Random(8)
    text = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(60):  # each differs a little from the one before, and the ends a lot
        text = list(text)
        text[rng.randrange(100)] = f"x{k}"
        texts.append((k, " ".join(text)))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, len(t), "x", 1) for i, t in texts], KIND)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert [r.doc_id for r in stage(spark, docs, "").collect()] == [0]
    groups = spark.createDataFrame([(n, 5 if n < 40 else 100 + n, 10) for n in range(43)], "node long, root long, size long")
    tasks = {}
    for r in near_copies.dealt(groups).collect():
        tasks.setdefault((r.root, r.i, r.j), set()).add(r.node)
    met = {(a, b) for t in tasks.values() for a in t for b in t}
    assert all((a, b) in met for a in range(40) for b in range(40)) and all((n, n) in met for n in range(40, 43))
    assert max(map(len, tasks.values())) < 40


def test_joined_equals_all_pairs():
    rng = random.Random(5)
    texts = corpus(9)
    rng.shuffle(texts)
    texts = [(n, t) for n, (_, t) in enumerate(texts)]
    got = near_copies.joined([near_copies.shingles(t.encode()) for _, t in texts])
    assert [n for n, r in enumerate(got) if n == r] == brute(texts, brute_links(texts)[0])


def test_pairs_at_the_similarity_meet():
    rng, met = np.random.default_rng(1), 0
    for _ in range(300):
        x = rng.integers(0, 2**64, 110, dtype=np.uint64)
        met += bool((near_copies.bands(x[:100]) == near_copies.bands(x[10:110])).any())  # 90 of 110
    assert met == 300
