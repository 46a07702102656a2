import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import media, quality_rules, sharding

ODD = "doc_id long, text string, lang string, digest string, shard int, words string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", 7, "w") for i, t in texts], ODD)


TEXTS = [(0, "a b c " * 40), (1, None), (2, ""), (3, "é" * 70), (4, "a b c " * 40), (5, "x" * 200_000), (5, "x"), (None, "no id"), (6, "\n\n \t")]


def brute_rules(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_ledger_equals_brute_force(spark):
    rng = random.Random(3)
    texts = TEXTS + [(100 + k, "".join(rng.choice(["a ", "b ", "c\n", "d\t", "## ", "  ", "!e "]) for _ in range(rng.randrange(300)))) for k in range(60)]
    rows = quality_rules.ledger(table(spark, texts)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((str(i), *brute_rules(t)) for i, t in texts)
    assert any(g[5] for g in got) and any(g[4] for g in got)


def test_policies_and_ablation(spark):
    rows = quality_rules.judged(quality_rules.ledger(table(spark, TEXTS)))
    by = {r.rule: r for r in quality_rules.ablation(rows).collect()}
    all_rows = rows.collect()
    for r in quality_rules.RULES:
        bit = 1 << r.bit
        assert by[r.name].n_fail == sum(bool(x.fail_bits & bit) for x in all_rows)
        assert by[r.name].kept_without == sum(x.fail_bits & ~bit == 0 for x in all_rows)
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert quality_rules.ledger(table(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 40, 1000, 4097])
def test_permutation_and_its_inverse(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p) == list(range(n))
    assert list(sharding.permute(p, n, back=True)) == list(range(n))
    shard, slot = sharding.place(n - 1, n, 7)
    assert sharding.row_at(shard, slot, n, 7) == n - 1


def test_shards_are_even_and_reproducible(spark):
    texts = TEXTS + [(9, "same")] * 30 + [(k, f"t{k}") for k in range(200, 330)]
    a = sharding.sharded(table(spark, texts), 7)
    b = sharding.sharded(table(spark, texts).repartition(3), 7)
    key = lambda r: tuple(map(str, r))
    rows = sorted(a.collect(), key=key)
    assert rows == sorted(b.collect(), key=key) and len(rows) == len(texts)
    sizes = [sum(r.shard == s for r in rows) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        assert sharding.place(r.row_number, len(rows), 7) == (r.shard, r.slot)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 1} == {(16, 0)}
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 3} == {(156, zlib.crc32(("é" * 70).encode()))}
    assert sharding.sharded(table(spark, [])).count() == 0


def test_hot_identity_is_dealt_out_whole(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 4)
    rows = sharding.sharded(table(spark, [(1, "hot")] * 21), 2).collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted((p % 2, p // 2) for p in range(21))


def filtered_png(image, kinds):
    """An image written with given filter types, straight from their definitions."""
    lines, up = [], [0] * image.shape[1]
    for row, kind in zip(image.tolist(), kinds):
        out = []
        for x, v in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), up[x], (up[x - 1] if x else 0)
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - [0, a, b, (a + b) // 2, nearest][kind]) % 256)
        lines.append(bytes([kind, *out]))
        up = row
    plain = media.encode_png(image.tobytes(), image.shape[1])
    head = plain[: 8 + 25]
    return head + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")


def test_all_filters_and_checks():
    image = np.random.default_rng(5).integers(0, 256, (25, 64)).astype(np.uint8)
    data = filtered_png(image, [0, 1, 2, 3, 4] * 5)
    assert (media.decode_png(data) == image).all()
    for at in (3, 20, len(data) // 2, len(data) - 3):
        with pytest.raises(ValueError):
            media.decode_png(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(data[:-6])


def test_cosine_hash_follows_the_definition():
    image = np.random.default_rng(6).integers(0, 256, (40, 64)).astype(np.uint8)
    full = np.array([[sum(image[y, x] * np.cos(np.pi * u * (2 * y + 1) / 80) * np.cos(np.pi * v * (2 * x + 1) / 128) for y in range(40) for x in range(64)) for v in range(8)] for u in range(8)])
    full[0] /= 2**0.5
    full[:, 0] /= 2**0.5
    flat = full.ravel()[1:]
    bits = np.unpackbits(np.frombuffer(media.low_frequency_hash(image), np.uint8))
    assert list(bits[1:]) == list((flat > np.median(flat)).astype(int)) and bits[0] == 0


def test_media_columns_round_trip(spark):
    rows = media.features(media.with_media(table(spark, TEXTS))).collect()
    want = sorted((str(i), hashlib.sha256((t or "").encode() + bytes(-len((t or "").encode()) % 64 or 64 * (not t))).hexdigest()) for i, t in TEXTS)
    assert sorted((str(r.doc_id), hashlib.sha256(r.payload).hexdigest()) for r in rows) == want
    same = [(r.media, r.feature) for r in rows if r.doc_id in (0, 4)]
    assert same[0] == same[1]
    assert media.features(media.with_media(table(spark, []))).count() == 0
    nulls = media.features(spark.createDataFrame([(1, None)], "doc_id long, media binary"), ("doc_id",)).collect()
    assert nulls[0].payload is None and nulls[0].feature is None


def test_all_filter_types_are_written_and_read_back():
    """Images of many heights, read together; each type is the best of some row."""
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 256, (h, 64), dtype=np.uint8) for h in (1, 2, 50, 300)] + [np.cumsum(rng.integers(0, 3, (h, 64)), axis, dtype=np.uint8) for h in (1, 40) for axis in (0, 1)]
    images += [np.frombuffer((b"of the and that is here now " * 200)[: 64 * 30], np.uint8).reshape(30, 64), np.add.outer(np.arange(40), np.arange(64)).astype(np.uint8), np.zeros((3, 64), np.uint8)]
    stored = [media.encode_png(x.tobytes()) for x in images]
    assert {k for s in stored for k in media.inflated(s)[:, 0]} == {0, 1, 2, 3, 4}
    assert all((a == b).all() for a, b in zip(media.decoded(stored), images))
    assert media.decoded([]) == []
