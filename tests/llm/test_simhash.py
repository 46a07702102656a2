import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import components, simhash

ODD = "doc_id long, text string, lang string, fp string, a int, anchor string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", 7, "w") for i, t in texts], ODD)


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, threshold=2):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= threshold:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(items):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(items))]


def test_codes_are_perfect():
    rng = np.random.default_rng(1)
    for length, generator, radius in set(simhash.CODES):
        block = simhash.Block(length, generator, radius)
        x = rng.integers(0, 1 << length, 500).astype(np.uint32)
        near, _ = block.nearest(x)
        assert (np.bitwise_count(near ^ x) <= radius).all()
        assert (block.syndrome(near) == 0).all()
    assert sum(c[0] for c in simhash.CODES) == 64


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_every_pair_within_the_threshold_meets(threshold):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**64, 200, dtype=np.uint64)
    other = fps.copy()
    for k in range(len(fps)):
        for bit in rng.choice(64, threshold, replace=False):
            other[k] ^= np.uint64(1) << np.uint64(bit)
    sets = []
    for side in (fps, other):
        row, anchor = simhash.anchors(side, (threshold + 1) // 2)
        sets.append([set(anchor[row == k]) for k in range(len(fps))])
    assert all(a & b for a, b in zip(*sets))
    if threshold <= 2:
        assert max(map(len, sets[0])) <= 19


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["w%d" % k for k in range(400)]
    texts = [(None, "a null id"), (1, None), (2, ""), (3, "One"), (4, "one"), (5, "É two"), (6, "x\x0bY\tz"), (7, "long " * 30000)]
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([5, 200, 800]))]
        for c in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append((1000 - 10 * k - c, " ".join(copy)))
    texts.append(texts[-1])
    rows = simhash.near_duplicates(table(spark, texts)).collect()
    items = [(i, brute_fingerprint(t)) for i, t in texts]
    want = sorted(zip((str(i) for i, _ in items), (f for _, f in items), map(str, brute_components(items))))
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in rows) == want
    assert len({w[2] for w in want}) < len(want) - 10
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_crowded_points_lose_no_link(spark):
    """Hundreds of fingerprints around one point, and a chain: as by comparing all with all."""
    rng = random.Random(5)
    fps = {0, 2**64 - 1}
    for _ in range(300):
        fps.add(sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    x = rng.getrandbits(64)
    for k in range(32):
        x ^= 3 << (2 * k)
        fps.add(x)
    items = [(n, f) for n, f in enumerate(sorted(fps, key=lambda f: rng.random()))]
    rows = spark.createDataFrame([(n, f - 2**64 if f >> 63 else f) for n, f in items], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in rows.join(simhash.classes(rows), "fp").collect()}
    assert [got[n] for n, _ in items] == brute_components(items)


@pytest.mark.parametrize("hot", [3, 10**9])
def test_hot_anchors_lose_no_link(monkeypatch, hot):
    """Anchor groups joined over flips or with each other give the same components."""
    monkeypatch.setattr(simhash, "HOT_ANCHOR", hot)
    monkeypatch.setattr(simhash, "SLICE", 500)
    rng = np.random.default_rng(7)
    fps = np.unique(np.concatenate([rng.integers(0, 2**12, 300, dtype=np.uint64), rng.integers(0, 2**64, 20, dtype=np.uint64)]))
    row, anchor = simhash.anchors(fps)
    order = np.argsort(anchor, kind="stable")
    a, b = simhash._links(anchor[order], fps[row[order]], 2)
    assert (np.bitwise_count(a ^ b) > 0).all()
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(map(int, a), map(int, b)):
        parent[root(x)] = root(y)
    got = [root(int(f)) for f in fps]
    want = brute_components([(int(f), int(f)) for f in fps])
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_flip_links_in_slices(monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 1000)
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 2**9, 200, dtype=np.uint64))
    a, b = simhash._flip_links(fps)
    assert (np.bitwise_count(fps[:, None] ^ fps) <= 2).any()
    parent = {int(f): int(f) for f in fps} | dict(zip(map(int, a), map(int, b)))
    got = [parent[int(f)] for f in fps]
    want = brute_components([(int(f), int(f)) for f in fps])
    assert len(set(got)) == len(set(want)) and len(set(zip(got, want))) == len(set(want))


def test_components_of_chains_stars_and_odd_links(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2), (2, 3), (None, 5), (200, 199)]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r.node: r.root for r in rows}
    assert len(rows) == len(got)
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
