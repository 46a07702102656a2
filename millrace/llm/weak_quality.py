"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document of the corpus. Votes are counted per
pattern (3 ** labellers at most, whatever the corpus), and expectation-maximisation over the counts
estimates each labeller's accuracy per class and the share of good documents, without any true label. The
posterior of a document's pattern is its soft label; a hashed linear scorer (logistic regression over hashed
words and votes) is trained on these labels and judges every document.

Passes over the texts: one for the votes, one for a sample of SAMPLE documents (expected; twice that at
most), chosen by a hash of id and text and each taken once, for training, and one for scoring. What reaches the driver is bounded: the
pattern counts, and the sample's hashed features (DIMENSIONS each at most).

Defined results: a text without a word (null, empty) is rejected with score 0; ties at one half are kept;
repeated rows are judged alike; null ids are carried; an empty table gives no rows. classified() reads id and
text only; kept() keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import forget, trim, whole_text

SAMPLE = 4000
DIMENSIONS = 1 << 16
EPOCHS = 6
ALARM = 5
GOOD, BAD, NONE = 1, 0, 2
#: Frequent words of the corpus's languages. Fixed values.
FUNCTION_WORDS = frozenset(
    b"the of and to a in is that it was for on are with as at by this be or an from "
    b"le la les de des et un une en dans que qui est du au pour par sur avec pas ce "
    b"der die das und ist von zu mit den ein eine nicht auf im sich des dem als auch es "
    b"el los las del que y en por con para una se no su al lo".split()
)
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Measures:
    """What the labellers look at."""

    n: int  # words
    symbols: float  # per word
    shouts: float  # exclamation marks per word
    upper: float  # share of upper-case ASCII letters among ASCII letters
    adjacent: float  # share of words equal to the one before
    distinct: float  # share of distinct words
    copies: float  # share of lines that occurred before
    lines: int
    function: float  # share of function words
    size: float  # bytes per word
    bare: float  # share of words without a letter


def measures(data: bytes) -> tuple[Measures, set[bytes]]:
    """Measures of a whole UTF-8 text, and its distinct words in lower case."""
    words = data.split()
    n = len(words)
    low = [w.lower() for w in words]
    distinct = set(low)
    letters = len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(n, 1)
    return (
        Measures(
            n,
            (len(data) - len(data.translate(None, SYMBOLS))) / m,
            data.count(b"!") / m,
            upper / max(letters, 1),
            sum(a == b for a, b in zip(low, low[1:])) / m,
            len(distinct) / m,
            1 - len(set(lines)) / max(len(lines), 1),
            len(lines),
            sum(w in FUNCTION_WORDS for w in low) / m,
            sum(map(len, words)) / m,
            sum(1 for w in low if w.isascii() and not w.strip(b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) / m,
        ),
        distinct,
    )


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: Labellers by name: measures -> GOOD, BAD or NONE. They overlap on purpose.
LABELLERS = {
    "symbols": lambda m: _vote(m.symbols > 0.25, m.symbols < 0.02 and m.n >= 10),
    "shouting": lambda m: _vote(m.shouts > 0.3, m.shouts < 0.02 and m.n >= 10),
    "capitals": lambda m: _vote(m.upper > 0.5 and m.n >= 5, m.upper < 0.1 and m.n >= 10),
    "stutter": lambda m: _vote(m.adjacent > 0.2, m.adjacent < 0.02 and m.n >= 20),
    "variety": lambda m: _vote(m.n >= 20 and m.distinct < 12 / math.sqrt(m.n + 400), m.n >= 20 and m.distinct > 20 / math.sqrt(m.n + 900)),
    "lines": lambda m: _vote(m.lines >= 4 and m.copies > 0.4, m.lines >= 2 and m.copies < 0.05),
    "function_words": lambda m: _vote(m.n >= 20 and m.function < 0.02, m.n >= 20 and m.function > 0.08),
    "bare_words": lambda m: _vote(m.n >= 10 and m.bare > 0.2, m.n >= 10 and m.bare < 0.05),
}


def votes_of(m: Measures) -> str:
    """One digit per labeller."""
    return "".join(str(f(m)) for f in LABELLERS.values())


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and P(vote | class, a vote is cast) as [labeller][class][vote]; silence tells nothing."""

    good: float
    chance: np.ndarray

    def posterior(self, pattern: str) -> float:
        """The probability that a document with these votes is good."""
        logs = [math.log(1 - self.good), math.log(self.good)]
        for i, v in enumerate(pattern):
            if int(v) != NONE:
                for c in (BAD, GOOD):
                    logs[c] += math.log(self.chance[i, c, int(v)])
        return 1 / (1 + math.exp(min(700.0, logs[BAD] - logs[GOOD])))

    def accuracy(self) -> dict[str, float]:
        """Each labeller's share of right votes among those it would cast on documents of either class."""
        right = self.chance[:, [BAD, GOOD], [BAD, GOOD]] @ np.array([1 - self.good, self.good])
        return dict(zip(LABELLERS, np.round(right, 6).tolist()))


def estimate(counts: dict[str, int], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over pattern counts; smoothed, so that no chance is 0.

    It starts from a weighted majority: each labeller knows one kind of fault, so that an alarm counts ALARM
    times as much as another labeller's finding nothing wrong.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([[int(v) for v in p] for p in patterns]).reshape(len(patterns), len(LABELLERS))
    fine, alarms = (votes == GOOD).sum(1) + 1, ALARM * (votes == BAD).sum(1) + 0.1
    good = fine / (fine + alarms)
    model = None
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        share = (weight[GOOD].sum() + 1) / (n.sum() + 2)
        chance = np.stack([[[(weight[c][votes[:, i] == v].sum() + 0.5) for v in (BAD, GOOD)] for c in (BAD, GOOD)] for i in range(len(LABELLERS))])
        chance /= chance.sum(2, keepdims=True)
        now = LabelModel(share, chance)
        new = np.array([now.posterior(p) for p in patterns])
        done = model is not None and np.abs(new - good).max(initial=0) < 1e-9
        model, good = now, new
        if done:
            break
    return model


def hashed(distinct: set[bytes], votes: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of the distinct words (sorted), and of the votes."""
    own = [zlib.crc32(w) % DIMENSIONS for w in distinct]
    return np.unique(np.array(own, np.int32)), np.array([zlib.crc32(f"\n{i}:{v}".encode()) % DIMENSIONS for i, v in enumerate(votes)], np.int32)


class Scorer:
    """Logistic regression over hashed features: words share one unit of weight, votes weigh one each."""

    def __init__(self):
        self.weights, self.bias = np.zeros(DIMENSIONS), 0.0

    def score(self, words: np.ndarray, votes: np.ndarray) -> float:
        z = self.bias + self.weights[votes].sum() + (self.weights[words].sum() / math.sqrt(len(words)) if len(words) else 0.0)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def train(self, rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS, rate: float = 0.3, shrink: float = 1e-5) -> Scorer:
        """Adagrad on the cross-entropy with soft labels, rows in a fixed order."""
        seen, seen_bias = np.full(DIMENSIONS, 1e-3), 1e-3
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                words, votes, label = rows[k]
                gap = label - self.score(words, votes)
                for at, scale in ((words, 1 / math.sqrt(max(len(words), 1))), (votes, 1.0)):
                    step = gap * scale - shrink * self.weights[at]
                    seen[at] += step**2
                    self.weights[at] += rate * step / np.sqrt(seen[at])
                seen_bias += gap**2
                self.bias += rate * gap / math.sqrt(seen_bias)
        return self


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pick (a hash of id and text below 2 ** 31) and votes of every row."""
    text = whole_text(text_col)
    pick = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 31))
    rows = docs.select(F.col(id_col).alias("doc_id"), pick.alias("pick"), text.cast("binary").alias("data"))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            found = [votes_of(measures(x.as_py())[0]) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], names=["doc_id", "pick", "votes"])

    return rows.mapInArrow(voted, f"doc_id {rows.dtypes[0][1]}, pick long, votes string")


def _sampled(docs: DataFrame, share: float, most: int, id_col: str, text_col: str) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Hashed features and votes of documents whose pick is in the lowest share, repeated rows once; the first most rows by pick."""
    text = whole_text(text_col)
    key = F.xxhash64(F.col(id_col), text)
    pick = F.pmod(key, F.lit(1 << 31))
    # Copies go before the cut, so that those of one row can't fill the sample; they are summed up before the shuffle.
    rows = docs.filter(pick < int(share * (1 << 31))).select(key.alias("key"), pick.alias("pick"), text.cast("binary").alias("data")).dropDuplicates(["key"]).select("pick", "data")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            found = [(votes_of(m), hashed(d, votes_of(m))) for m, d in (measures(x.as_py()) for x in b.column(1))]
            columns = [b.column(0), pa.array([v for v, _ in found], pa.string()), pa.array([f[0].tobytes() for _, f in found], pa.binary()), pa.array([f[1].tobytes() for _, f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["pick", "votes", "words", "marks"])

    picked = rows.mapInArrow(made, "pick long, votes string, words binary, marks binary").orderBy("pick", "words").limit(most).collect()
    picked.sort(key=lambda r: (r.pick, r.votes, bytes(r.words)))
    return [(np.frombuffer(r.words, np.int32), np.frombuffer(r.marks, np.int32), r.votes) for r in picked]


def fitted(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, Scorer]:
    """The label model of all documents' votes, and the scorer trained on the posterior labels of a sample."""
    counts = {r.votes: r.n for r in votes(docs, id_col, text_col).groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model, total = estimate(counts), sum(counts.values())
    rows = _sampled(docs, min(1.0, sample / max(total, 1)), 2 * sample, id_col, text_col) if total else []
    known = {p: model.posterior(p) for p in counts}
    scorer = Scorer().train([(w, m, known[v]) for w, m, v in rows])
    del rows
    trim()
    return model, scorer


def _judge(model: LabelModel, scorer: Scorer, data: bytes) -> tuple[str, float, float, bool]:
    m, distinct = measures(data)
    pattern = votes_of(m)
    if not m.n:
        return pattern, 0.0, 0.0, False
    score = scorer.score(*hashed(distinct, pattern))
    return pattern, round(model.posterior(pattern), 6), round(score, 6), score >= 0.5


def classified(docs: DataFrame, models: tuple[LabelModel, Scorer] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, votes, weak_label (posterior), score and kept of every row."""
    fit = models or fitted(docs, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("data"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            found = list(zip(*(_judge(*shared.value, x.as_py()) for x in b.column(1)))) or [(), (), (), ()]
            columns = [pa.array(c, k) for c, k in zip(found, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "votes", "weak_label", "score", "kept"])

    return rows.mapInArrow(judged, f"doc_id {rows.dtypes[0][1]}, votes string, weak_label double, score double, kept boolean")


def kept(docs: DataFrame, models: tuple[LabelModel, Scorer] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the scorer keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(models or fitted(docs, id_col=id_col, text_col=text_col))

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for data in batches:
            yield pd.Series([_judge(*shared.value, bytes(x))[3] for x in data], dtype=bool)

    return docs.filter(good(whole_text(text_col).cast("binary")))
