import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, packing, pieces
from millrace.llm.tokens import ByteLevel, CachedEncoder

ODD = "doc_id long, text string, ids string, start string, done int, merge string"
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", "s", 7, "m") for i, t in texts], ODD)


def odd_texts(n=3000):
    rng = random.Random(2)
    marks = [" ", "\n", "\t", "a", "B", "1", "é", "'s", " ", "　", "\x00", "!", "\r", "🙂", "٣", "漢", "\x1c", "\x85"]
    own = ["a  b", "\n\nx y \n z\t q\n", "  ", "\n", "", " a", "a ", "it's  don't\n\n\n  x", "a\x00b  c", "<|endoftext|> x <|endoftext|>", "a<|endoftext|><|endoftext|>\n\n<|endoftext|",  "é " * 50, "w" * 3000]
    return own + ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_cached_encoders_equal_the_libraries(monkeypatch):
    import millrace.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHE", 500)
    whole, plain = Tokenizer.from_file(JSON), ByteLevel(JSON, P.PATTERN)
    by_json, ranks = CachedEncoder(plain, plain.added), bpe.read_ranks(RANKS)
    assert 50256 in whole.encode("<|endoftext|>", add_special_tokens=False).ids
    by_ranks, tik = CachedEncoder(bpe.RankFile(RANKS, P.PATTERN)), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in odd_texts():
        assert np.frombuffer(by_json.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(by_ranks.encode(t), "<u4").tolist() == tik.encode_ordinary(t)


def test_slices_of_texts_equal_single_texts(monkeypatch):
    import millrace.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHE", 3000)
    plain = ByteLevel(JSON, P.PATTERN)
    encoders = [CachedEncoder(plain, plain.added), CachedEncoder(bpe.RankFile(RANKS, P.PATTERN))]
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    whole = Tokenizer.from_file(JSON)
    marks = ["it's, word. é, ß.\nŁódź, ×, ÷. end.", "a,", ",", "x.", "2, 3.\n4,", ", .", "don't.\n,", "\u2003x, y.", "a\x85 b,", "e\u0301, o\u0308."]
    texts = marks + odd_texts(1500)
    for size in (1 << 22, 300, 1):
        monkeypatch.setattr(tokens, "sliced", lambda a, size=size: pieces.sliced(a, size))
        for encoder, want in zip(encoders, (lambda t: whole.encode(t, add_special_tokens=False).ids, tik.encode_ordinary)):
            got = [ids[a:b].tolist() for ids, edges in encoder.encoded(pieces.as_strings(texts)) for a, b in zip(edges, edges[1:])]
            assert got == [want(t) for t in texts]


def test_each_different_word_of_many_texts_is_looked_up_once():
    class Counted(dict):
        get = lambda self, p, otherwise=None: looked.append(p) or dict.get(self, p, otherwise)

    looked = []
    encoder = CachedEncoder(bpe.RankFile(RANKS, P.PATTERN))
    encoder.known = Counted()
    encoded = list(encoder.encoded(pieces.as_strings(["some words, and more words.\nagain " * 50 + "x"] * 200)))
    assert sum(len(edges) - 1 for _, edges in encoded) == 200 and len(looked) < 50


def test_single_words_equal_merging_by_rank():
    vocabulary = bpe.Vocabulary(bpe.read_ranks(RANKS))
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng, tokens, words = random.Random(3), list(vocabulary.ranks), []
    for k in range(6000):
        word = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6))) if k % 2 else bytes(rng.choice(b"aabe th\xc3\xa9\xe2\x82\xac ") for _ in range(rng.randrange(1, 40)))
        assert vocabulary.encode(word) == tik._core_bpe.encode_single_piece(word)
        words.append(word)
    ids, ends = vocabulary.encode_all(words)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == list(map(tik._core_bpe.encode_single_piece, words))


def test_tokens_that_merging_never_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"cd": 257, b"abcd": 258, b"bcd": 259, b"xbcd": 260}
    vocabulary = bpe.Vocabulary(ranks)
    tik = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(4000):
        word = bytes(rng.choice(b"abcdx") for _ in range(rng.randrange(1, 12)))
        assert vocabulary.encode(word) == tik._core_bpe.encode_single_piece(word)


def test_encode_decode_columns(spark):
    texts = [(k, t) for k, t in enumerate(odd_texts(60))] + [(None, "no id"), (5, None), (5, "again"), (5, "again"), (9, "long words " * 40000)]
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = bpe.decoded(bpe.encoded(table(spark, texts), RANKS, P.PATTERN), RANKS).collect()
    key = lambda r: (str(r[0]), r[2])
    want = sorted(((i, tik.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts), key=key)
    assert sorted(((r.doc_id, list(r.ids), bytes(r.data)) for r in rows), key=key) == want
    assert bpe.encoded(table(spark, []), RANKS, P.PATTERN).count() == 0
    nulls = bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS).collect()
    assert bytes(nulls[0].data) == b""


def check_windows(rows, texts, size, padding):
    """Every id of every document lies in one piece, sequences are gapless, and padding is little."""
    whole = Tokenizer.from_file(JSON)
    want = sorted((str(i), tuple(whole.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in texts)
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.length > 0 and r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    if len({i for i, _ in texts}) == len(texts):
        got = []
        for (i, total), pieces in by_doc.items():
            ids = []
            for start, piece in sorted(pieces):
                assert start == len(ids)
                ids += piece
            assert len(ids) == total
            got.append((i, tuple(ids)))
        assert sorted(got) == want
    padded = total = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
        total += at
        padded += 0 if at & (at - 1) == 0 else size - at
    assert total == sum(len(ids) for _, ids in want)
    assert padded <= padding * total


def test_packing_whole(spark):
    rng = random.Random(7)
    texts = [(k, " ".join(rng.choice(["word", "thing", "é", "x\n"]) for _ in range(int(rng.paretovariate(0.7) * 8) % 9000))) for k in range(150)]
    texts += [(900, None), (901, ""), (None, "no id"), (902, "very long " * 20000)]
    docs = table(spark, texts).repartition(5)
    check_windows(packing.packed(docs, JSON, P.PATTERN, with_ids=True).collect(), texts, 2048, 0.01)
    check_windows(packing.packed(docs, JSON, P.PATTERN, 64, 4, 2, 2, with_ids=True).collect(), texts, 64, 0.02)
    assert packing.packed(table(spark, []), JSON, P.PATTERN).count() == 0


def test_packing_repeated_rows(spark):
    texts = [(1, "one two three")] * 30 + [(2, "x")] * 5
    check_windows(packing.packed(table(spark, texts), JSON, P.PATTERN, with_ids=True).collect(), texts, 2048, 0)


@pytest.mark.parametrize("seed", range(30))
def test_packer_is_bounded_and_merge_is_whole(seed):
    rng = random.Random(seed)
    packer, done = packing.Packer(64, 4, 3), []
    pieces = [packing.Piece(k, 0, n, bytes(4 * n)) for k in range(200) for n in [rng.randrange(1, 150)]]
    for p in pieces:
        done += packer.put(p)
        assert len(packer.windows) == len(packer.gaps) <= 4
    assert all(64 - w.used < 3 for w in done)
    left = [p for w in packer.left() for p in w.pieces]
    rest = packing.merged(left, 64, 3)
    assert sum(w.used for w in done + rest) == sum(map(len, pieces))
    assert all(64 - w.used < 3 or w.used & (w.used - 1) == 0 for w in rest)
    assert all(w.used == sum(map(len, w.pieces)) for w in done + rest)
