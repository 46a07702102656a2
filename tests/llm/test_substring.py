import random
import re

import pytest

import corpus_pipeline
from millrace.llm import substring

ODD = "doc_id long, text string, rank string, `of` string, pos int, gone string, removed string, lines string"
SPACE = r"[\x20\x09-\x0D]"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "r", "o", 7, "g", "d", "l") for i, t in texts], ODD)


def brute(texts, kind="line", min_words=15, size=50):
    """Text left and spans cut by (id, text), written apart from the operator: plain dictionaries of plain strings."""
    from hashlib import md5

    order = sorted({x for x in texts if x[1] is not None}, key=lambda x: (x[0] is None, x[0] or 0, md5(x[1].encode()).digest()[:8]))
    lines, passages, out = {}, {}, {}
    sep = "\n" if kind == "line" else r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"
    for doc in order:
        t = doc[1]
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        low = [t[a:b].lower() for a, b in words]
        gone = set()
        at = 0
        for part in re.split(f"({sep})", t):
            own = [n for n, (a, b) in enumerate(words) if at <= a and b <= at + len(part)]
            if len(own) >= min_words:
                key = tuple(low[n] for n in own)
                if lines.setdefault(key, (doc, own[0])) != (doc, own[0]):
                    gone.update(own)
            at += len(part)
        for n in range(len(low) - size + 1):
            first, p = passages.setdefault(" ".join(low[n : n + size]), (doc, n))
            if first != doc or n >= p + size:
                gone.update(range(n, n + size))
        left, spans, at, n = "", [], 0, 0
        while n < len(words):
            if n not in gone:
                n += 1
                continue
            left += t[at : words[n][0]]
            first = n
            while n < len(words) and n in gone:
                n += 1
            spans.append((words[first][0], words[n - 1][1]))
            at = words[n][0] if n < len(words) else len(t)
            if "\n" in t[words[n - 1][1] : at] and first and "\n" not in t[words[first - 1][1] : words[first][0]]:
                left += "\n"
        out[doc] = (left + t[at:], spans)
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(900)] + ["É%d" % k for k in range(40)]
    some = lambda n, ends=" ": "".join(rng.choice(words) + rng.choice(ends) for _ in range(n))
    shared = [some(n, "  \n") for n in (49, 50, 51, 70, 200)]
    lines = [some(n).strip() for n in (14, 15, 16, 40)]
    texts = []
    for k in range(60):
        parts = [some(rng.randrange(1, 90), " " * 15 + "\n")]
        for s in rng.sample(shared, rng.randrange(3)):
            parts += [s if rng.random() < 0.5 else s.upper().replace(" ", "  "), some(rng.randrange(0, 60))]
        for s in rng.sample(lines, rng.randrange(3)):
            parts += ["\n", rng.choice(["", " ", "\t"]) + s.replace(" ", rng.choice([" ", "  "])), rng.choice(["\n", " \r\n\n"])]
        texts.append((k, "".join(parts)))
    texts += [(70, None), (71, ""), (72, "again " * 400), (73, shared[4] + shared[4]), (74, "é " * 60), (75, " \n "), (76, "  " + shared[3] + "\n")]
    texts += [(77, texts[3][1]), (78, texts[3][1].upper()), (2, shared[4] + "x"), (2, "y " + shared[4]), (None, shared[2]), (None, some(30) + shared[3]), texts[5], texts[5], (79, "word " * 60_000 + shared[4])]
    return texts


@pytest.mark.parametrize("kind", ["line", "paragraph"])
def test_equals_brute_force(spark, kind):
    texts = corpus(4)
    rows = substring.deduplicated(table(spark, texts), kind).collect()
    want = brute(texts, kind)
    assert len(rows) == len(texts)
    originals = {(i, t) for i, t in texts}
    got = sorted((str(r.doc_id), str(r.text), str([(s.start, s.end) for s in r.removed])) for r in rows)
    assert got == sorted((str(i), str(t if t is None else want[i, t][0]), str([] if t is None else want[i, t][1])) for i, t in texts)
    assert sum(bool(spans) for _, spans in want.values()) > 20 and len(originals) < len(texts)
    assert all((r.rank, r["of"], r.pos, r.gone, r.lines) == ("r", "o", 7, "g", "l") for r in rows)
    assert rows[0].__fields__ == ["doc_id", "text", "rank", "of", "pos", "gone", "removed", "lines"]


def test_edges(spark):
    assert substring.deduplicated(table(spark, [])).count() == 0
    line = " ".join(f"a{n}" for n in range(15))
    texts = [(2, f"{line.upper()}\nkept"), (1, line.replace(" ", "  ")), (3, "short line here\nx"), (4, "short line here\ny")]
    rows = {r.doc_id: r for r in substring.deduplicated(table(spark, texts)).collect()}
    assert rows[1].text == texts[1][1] and rows[2].text == "kept" and rows[3].text == texts[2][1] and rows[4].text == texts[3][1]
    assert [(s.start, s.end) for s in rows[2].removed] == [(0, len(line))]


def test_cuts_keep_line_ends():
    a, b = " ".join(f"a{n}" for n in range(50)), "x y"
    cut = lambda t, at: substring.cut(t, re.compile("\n").split, [], [at], False)[0]
    assert cut(f"{b} {a}\nz", 2) == "x y \nz"
    assert cut(f"{b}\n{a}\nz", 2) == "x y\nz"
    assert cut(f"{a} z", 0) == "z" and cut(f"{b} {a}", 2) == "x y "


def test_stage_leaves_no_passage_twice(spark):
    texts = [(i, t) for i, t in corpus(5) if i is not None and i != 2]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in texts], "doc_id long, text string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["substring dedup"]
    left = [(r.doc_id, r.text) for r in stage(spark, docs, "").collect()]
    assert all(r.text is None or r.n_chars == len(r.text) for r in stage(spark, docs, "").collect())
    again = brute(left)
    assert all(not again[x][1] for x in left if x[1] is not None)
    assert stage(spark, docs.limit(0), "").count() == 0


def test_a_group_of_copies_is_cut_whole(spark):
    """Copies of one text lose all but the first, whatever their number; unlike texts lose nothing."""
    rng = random.Random(1)
    words = ["w%d" % k for k in range(500)]
    base = " ".join(rng.choice(words) for _ in range(300))
    texts = [(k, base) for k in range(400)] + [(1000 + k, " ".join(rng.choice(words) for _ in range(120))) for k in range(40)]
    rows = {r.doc_id: r for r in substring.deduplicated(table(spark, texts)).collect()}
    assert rows[0].text == base and all(rows[k].text == "" for k in range(1, 400))
    assert all(not rows[1000 + k].removed for k in range(40))
