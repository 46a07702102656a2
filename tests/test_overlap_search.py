"""Stems, ROUGE, searches and weighted resamples against plain code."""

import hashlib
import random
import re
import statistics
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import overlap
from millrace.operators import search, stats
from millrace.plans import q_evaluation

#: Words and their stems, as the paper of 1980 gives them for its steps, and the extensions' own.
KNOWN = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky skies sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile
analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv
allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll dying die news news proceed proceed is is at at y y generalizations gener oscillators oscil""".split()


def test_stems_are_the_known_ones():
    for word, stem in zip(KNOWN[::2], KNOWN[1::2]):
        assert overlap.stem(word) == stem, word


def plain_longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def plain_rouge(text, reference, stems):
    a, b = ([overlap.stem(w) if stems and len(w) > 3 else w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w] for t in (text, reference))
    out = []
    for x, y in ((a, b), (list(zip(a, a[1:])), list(zip(b, b[1:])))):
        n = sum(min(c, Counter(y)[g]) for g, c in Counter(x).items())
        p, r = n / len(x) if x else 0, n / len(y) if y else 0
        out += [p, r, 2 * p * r / (p + r) if p + r else 0]
    n = plain_longest(a, b)
    p, r = n / len(a) if a else 0, n / len(b) if b else 0
    return out + [p, r, 2 * p * r / (p + r) if p + r else 0]


@pytest.mark.parametrize("stems", [False, True])
def test_rouge_equals_plain_counts(spark, stems):
    rng = random.Random(8)
    word = lambda: rng.choice(["running", "runs", "ran", "Cats", "cat", "the", "a", "hopping", "x9"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(30))) + "!", "\n".join(word() for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(100, None, "a b"), (101, "", ""), (102, "a", None), (103, "same words here", "same words here"), (104, "the " * 50_000, "the cat")]
    df = spark.createDataFrame(rows, "id long, t string, r string").select("id", overlap.rouge_scores(F.col("t"), F.col("r"), stems).alias("s"))
    for r in df.collect():
        i, t, ref = next(x for x in rows if x[0] == r.id)
        if i != 104:
            assert list(r.s) == pytest.approx(plain_rouge(t, ref, stems)), i
        else:
            assert list(r.s)[1] == 0.5 and list(r.s)[7] == 0.5


def test_stemmed_query_equals_plain_counts_on_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = q_evaluation.t16_rouge_stemmed(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[::7]:
        assert list(r)[1:] == pytest.approx(plain_rouge(texts[r.doc_id], items[r.doc_id % len(items)], True), abs=1e-6)


def test_few_texts_of_a_batch_are_strings_at_once():
    """Before, all texts of a batch were, beside a cache of twice as many stems."""
    texts = pa.array([None if i % 7 == 0 else f"text {i}" for i in range(1000)])
    parts = [list(rows) for rows in overlap.slices(texts, texts)]
    assert [len(p) for p in parts] == [256, 256, 256, 232] and [t for p in parts for t, _ in p] == texts.to_pylist()
    assert list(overlap.slices(texts[:0], texts[:0])) == [] and overlap.stem.cache_info().maxsize <= 1 << 17


def plain_search(text, corpus, default):
    hits = sorted({(rank, body) for rank, words, body in corpus if any(w and w.lower() in (text or "").lower() for w in words or [])})
    return len(hits), "\n\n".join(b for _, b in hits) or default


def test_search_equals_a_scan(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abÉ \n") for _ in range(rng.randrange(1, 6)))
    corpus = [(rng.randrange(20), [word() for _ in range(3)], f"entry {i % 25}") for i in range(40)] + [(5, [None, "", "prime minister"], "pm"), (5, None, "never"), (4, ["q"], "tie b"), (4, ["q"], "tie a")]
    texts = [(i, "".join(rng.choice("abcé \n") for _ in range(rng.randrange(40)))) for i in range(80)] + [(100, None), (101, ""), (102, "The PRIME Minister q"), (103, "x" * 300_000 + "q")]
    c = spark.createDataFrame(corpus, "rank int, keywords array<string>, body string")
    got = {r.id: (r.n_hits, r.result) for r in search.searched(spark.createDataFrame(texts, "id long, text string"), c, "none").collect()}
    assert got == {i: plain_search(t, corpus, "none") for i, t in texts}
    assert "tie a\n\ntie b\n\n" in got[102][1] and "pm" in got[102][1].split("\n\n") and got[100] == (0, "none")
    assert {r.n_hits for r in search.searched(spark.createDataFrame(texts, "id long, text string"), c.limit(0), "none").collect()} == {0}


def test_read_says_what_was_asked(spark):
    c = spark.createDataFrame([(1, ["tea"], "about tea"), (2, ["site"], "the site")], "rank int, keywords array<string>, body string")
    rows = spark.createDataFrame([(1, "http://site/x", "Tea?"), (2, "http://site/x", None), (3, "http://y", ""), (4, None, None)], "id long, url string, prompt string")
    got = {r.id: r.content for r in search.read(rows, c, "nothing").collect()}
    assert got == {1: "[Fetched: http://site/x]\nPrompt: Tea?\n\nabout tea", 2: "[Fetched: http://site/x]\n\nthe site", 3: "[Fetched: http://y]\n\nnothing", 4: "[Fetched: ]\n\nnothing"}


def test_digests_are_those_of_the_results(spark, monkeypatch):
    """Also where entries are put to the digests in several goes, ids are texts, and heads are null."""
    monkeypatch.setattr(search, "PAIRS", 7)
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abÉ \n") for _ in range(rng.randrange(1, 9)))
    corpus = [(rng.choice([None, *range(9)]), [word() for _ in range(3)], rng.choice([None, f"entry {i % 25}"])) for i in range(60)] + [(5, [None, ""], "never")]
    texts = [(f"t{i}", "".join(rng.choice("abcé \n") for _ in range(rng.randrange(60))), rng.choice([None, "", "Head é\n"])) for i in range(150)] + [("n", None, "x")]
    c = spark.createDataFrame(corpus, "rank int, keywords array<string>, body string")
    t = spark.createDataFrame(texts, "id string, text string, head string")
    for entries in (c, c.limit(0)):
        want = {r.id: (r.n_hits, r.result) for r in search.searched(t.select("id", "text"), entries, "none").collect()}
        got = {r.id: (r.n_hits, r.digest) for r in search.digested(t, entries, "none").collect()}
        heads = {i: h or "" for i, _, h in texts}
        assert got == {i: (n, hashlib.md5((heads[i] + x).encode()).hexdigest()) for i, (n, x) in want.items()}


def test_finds_are_not_shuffled(spark):
    """3,000 texts that each find 3,000 entries: before, these nine million finds went through a shuffle."""
    t = spark.range(3000).select("id", F.lit("a common word").alias("text"))
    c = spark.range(3000).select(F.col("id").alias("rank"), F.array(F.lit("common")).alias("keywords"), F.concat(F.lit("entry "), "id").alias("body"))
    rows = search.digested(t, c, "none")
    got = rows.collect()
    result = hashlib.md5("\n\n".join(f"entry {i}" for i in range(3000)).encode()).hexdigest()
    assert len(got) == 3000 and {(r.n_hits, r.digest) for r in got} == {(3000, result)}
    # What comes out of the pass over the entries is one row a text, and nothing is shuffled behind it.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow") and "Aggregate" not in plan.split("Repartition")[0]


def test_the_rarest_gram_keys_a_term(spark):
    """A term is looked for in few texts only, however common its other grams are."""
    texts = spark.createDataFrame([(i, "common words" + (" zq" if i == 7 else "")) for i in range(200)], "id long, text string")
    terms = spark.createDataFrame([("common words zq",), ("absent!",)], "term string")
    grams = texts.select("id", F.explode(search._all_grams(F.col("text"))).alias("gram"))
    (row,) = search.keyed(terms, grams).collect()
    assert row.term == "common words zq" and grams.filter(F.col("gram") == row.gram).count() == 1


def test_weights_have_the_chances_of_poisson(spark):
    rows = spark.range(200_000).select(stats.poisson(F.lower(F.lpad(F.hex((F.col("id") * (2**32 / 200_000)).cast("long")), 8, "0"))).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 200_000 for r in rows}
    assert [share[k] for k in range(4)] == pytest.approx([0.36788, 0.36788, 0.18394, 0.06131], abs=1e-4)


def test_weighted_intervals_are_those_of_draws(spark):
    rng = random.Random(10)
    items = [(g, f"q{k}", rng.gauss(0.2 if g == "a" else 0.0, 1.0)) for g in "ab" for k in range(150)]
    df = spark.createDataFrame(items, "g string, item string, x double")
    got = {r.g: r for r in stats.interval(stats.weighted_means(df, ["g"], ["item"], ["x"], 1000), ["g"], "x").collect()}
    for g in "ab":
        own = [x for h, _, x in items if h == g]
        means = sorted(statistics.fmean(rng.choices(own, k=len(own))) for _ in range(1000))
        assert got[g].lo == pytest.approx(means[25], abs=0.04) and got[g].hi == pytest.approx(means[975], abs=0.04)
        assert got[g].share == pytest.approx(sum(m <= 0 for m in means) / 1000, abs=0.06)
    # Groups draw the same items alike, so paired differences are narrow.
    twin = df.filter("g = 'a'").withColumn("g", F.lit("c")).withColumn("x", F.col("x") + 1).unionByName(df.filter("g = 'a'"))
    wide = stats.weighted_means(twin, ["g"], ["item"], ["x"], 50).groupBy("rep").pivot("g", ["a", "c"]).agg(F.first("x")).selectExpr("c - a AS d").collect()
    assert [r.d for r in wide] == pytest.approx([1.0] * 50)
    assert stats.weighted_means(df.limit(0), ["g"], ["item"], ["x"], 5).count() == 0
