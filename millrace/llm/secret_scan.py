"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The text is tokens: runs of letters, digits, underscores and + (with . / - between them), and runs of other marks. Every
token of a line is tagged begin, inside or outside of a secret by a linear-chain conditional random field over its shape, the
neighbouring tokens and features of the file; the best path of the line is decoded by Viterbi.

All features but the file's belong to one token and how far it is from the tagged one, so a token's part of the scores is kept by its
spelling (KNOWN spellings at most) and scores are sums of rows, taken for all texts of a slice at once. A line goes through Viterbi only if a token of it could gain
by being in a secret, all steps taken at their best: on all other lines outside throughout is the best path, and that is exact.

The field is trained here, on generated lines of known truth (TRAIN_LINES of them, from SEED): it needs no pass over the corpus and is
the same for every input. The parts of its spans outside of the patterns' are added.

Defined results: a null or empty text has no spans; repeated rows and null ids are carried; an empty table
gives no rows. Offsets are code points, ends exclusive. Whole texts are scanned. scanned() reads id and text only;
masked() keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

import random
import re
import string
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pieces import as_strings, cut, sliced, spread
from millrace.llm.shared import kept, trim, whole_text

KINDS = ("assign", "access", "hex", "crf")
SPANS = "array<struct<kind:string,start:int,end:int>>"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Texts without this have no span of the patterns (in RE2, which takes ſ and the Kelvin sign for s and k, too).
MAY = r"""(?i:pass(?:word|wd)|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
MASK = "[SECRET]"

TRAIN_LINES = 9000
#: Of words of prose that turn from small to capital letters or back.
TURNED = 0.02
EPOCHS = 4
SEED = 11
#: Spellings whose parts of the scores one worker keeps in either of two generations.
KNOWN = 200_000
#: Fewer parts of lines than this are labelled one by one.
FEW = 8
#: Tokens whose gains are summed at once.
SUMMED = 1 << 17

#: A token, with the blank before it, or the end of a line.
TOKEN = re.compile(r"\n|[\x20\x09\x0B-\x0D]?(?:[\w+](?:[\w+/.\-]*[\w+])?|[^\w+\x20\x09-\x0D]+)")
TRIGGERS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")
ASKS = re.compile("|".join(TRIGGERS), re.IGNORECASE | re.ASCII)
#: So many tokens on, a word that asks for a secret is felt.
FELT = 4
#: A turn from a small to a capital letter, which words of prose don't have.
TURNS = re.compile(r"[a-z][A-Z]")
CONSONANTS = re.compile(r"[^b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]+")
#: Last marks before a token that tell something of it.
SIGNS = "=:@\"'`"
OUT, BEGIN, INSIDE = range(3)


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the fixed patterns, by start, then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _bucket(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


#: Bucket of a token's size.
SIZES = [_bucket(n, 4, 6, 8, 10, 12, 16, 20, 32) for n in range(33)]
VOWELS = "aeiouyàáâäèéêëìíîïòóôöùúûü"
VOWEL_EDGES, RUN_EDGES = (0.15, 0.25, 0.33, 0.42), (3, 4, 5, 7)
NO_VOWELS = str.maketrans("", "", VOWELS + VOWELS.upper())
NO_RARE = str.maketrans("", "", "jkqvwxzJKQVWXZ")
NO_DIGITS = str.maketrans("", "", string.digits)


def kind_of(token: str) -> str:
    """Classes of characters and size, in one word."""
    size = SIZES[min(len(token), 32)]
    if token.isalpha():
        return f"{'lower' if token.islower() else 'title' if token.istitle() else 'upper' if token.isupper() else 'mixed'}{size}"
    if not any(map(str.isalnum, token)):
        return f"mark{min(len(token), 3)}"
    cased = "" if token.isdigit() else "lower" if token == token.lower() else "upper" if token == token.upper() else "title" if token[0].isupper() and token[1:] == token[1:].lower() else "mixed"
    digits = "1" if any(map(str.isdigit, token)) else ""
    return f"{cased}{digits}{'' if token.isalnum() else '.'}{size}"


def _spelling(token: str, kind: str) -> tuple[str, int, int, int]:
    """The kind, and how a token of letters reads: its share of vowels, the longest run of consonants, and its rare letters."""
    vowels = (len(token) - len(token.translate(NO_VOWELS))) / len(token)
    rare = len(token) - len(token.translate(NO_RARE))
    return kind, _bucket(vowels, *VOWEL_EDGES), _bucket(max(map(len, CONSONANTS.split(token))), *RUN_EDGES), min(rare, 5)


#: Whether characters up to U+00FF, and the rest as one, are vowels, consonants that run on, and rare letters.
LETTERS = [chr(c) for c in range(256)] + ["\u0100"]
IS_VOWEL, IS_CONSONANT, IS_RARE = (np.array([test(c) for c in LETTERS], np.int32) for test in (lambda c: not c.translate(NO_VOWELS), lambda c: not CONSONANTS.match(c), lambda c: not c.translate(NO_RARE)))


def _spellings(tokens: list[str]) -> np.ndarray:
    """_spelling() of each token but for its kind; a row each."""
    size = np.array(list(map(len, tokens)))
    start = np.cumsum(size) - size
    chars = np.minimum(np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), "<u4"), 256)
    vowels = np.add.reduceat(IS_VOWEL[chars], start) / size
    at = np.arange(1, len(chars) + 1)
    # Of each character, the last one up to it that ends a run, or where its token starts.
    stop = np.where(IS_CONSONANT[chars], 0, at)
    stop[start] = np.where(IS_CONSONANT[chars[start]], start, start + 1)
    run = np.maximum.reduceat(at - np.maximum.accumulate(stop), start)
    rare = np.minimum(np.add.reduceat(IS_RARE[chars], start), 5)
    return np.stack([np.digitize(vowels, VOWEL_EDGES), np.digitize(run, RUN_EDGES), rare], 1)


def _read(kind: str, vowels: int, run: int, rare: int) -> list[str]:
    return [f"kind={kind}", f"vowels={kind},{vowels}", f"consonants={kind},{run}", f"rare={kind},{rare}", f"rare,run={rare},{run}"]


def is_plain(token: str, kind: str) -> bool:
    """Whether all features of a token's shape follow from _spelling()."""
    return kind[:5] in ("lower", "title") and token.isalpha()


def shape(token: str) -> list[str]:
    """Features of a token by itself."""
    kind, n = kind_of(token), len(token)
    if kind[:4] == "mark":
        return [f"kind={kind}", f"mark={token[:1]}", f"mark2={token[-1:]}"]
    out = _read(*_spelling(token, kind))
    if is_plain(token, kind):
        return out
    digits = n - len(token.translate(NO_DIGITS))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in token]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:])) / n
    longest = max(map(len, re.split(r"[\W\d_]+", token)))
    head = re.match(r"[A-Za-z]{1,10}[_-]", token)
    return out + [
        f"turns={kind},{_bucket(turns, 0.1, 0.2, 0.3, 0.4, 0.5)}",
        f"case={kind},{_bucket(len(TURNS.findall(token)), 1, 2, 3, 5)}",
        f"digits={_bucket(digits / n, 0.1, 0.25, 0.4, 0.6, 0.8)}",
        f"varied={_bucket(len(set(token)) / n, 0.3, 0.5, 0.7, 0.9)}",
        f"letters={_bucket(longest, 4, 6, 8, 12)}",
        f"dots={min(token.count('.'), 3)}",
        f"dashes={min(token.count('-'), 4)}",
        f"slashes={min(token.count('/'), 3)}",
        f"hex={all(c in '0123456789abcdef' for c in token)},{_bucket(n, 8, 12, 16, 18, 24)}",
        f"head={head[0].lower() if head else ''}",
        f"start={token[:2] if token[:2].isalpha() else ''}",
    ]


def _word(token: str) -> str:
    return "long" if len(token) > 12 else token.lower() if token.isalpha() or not any(map(str.isdigit, token)) else "num"


def _asks(token: str) -> int:
    """0, or 1 + the number of the trigger in the token."""
    m = ASKS.search(token)
    return 1 + TRIGGERS.index(m[0].lower()) if m else 0


def _sign(token: str) -> int:
    """0, or 1 + the number of the sign that a token of marks ends with; another mark counts as the last."""
    return 0 if not token or token[-1].isalnum() or token[-1] in "_+" else 1 + (SIGNS.index(token[-1]) if token[-1] in SIGNS else len(SIGNS))


#: What stands for a token beyond the line.
NOTHING = "\n"


def features(tokens: list[str], i: int) -> list[str]:
    """Features of token i of a line (tokens with the blank before them); the file's are added to them."""
    at = lambda n: tokens[n] if 0 <= n < len(tokens) else NOTHING
    own = at(i).lstrip()
    kind, before, after = kind_of(own), at(i - 1).strip(), at(i + 1).strip()
    asked = [_asks(at(i - d)) for d in range(1, FELT + 1)]
    near = next((d for d, t in enumerate(asked, 1) if t), 0)
    glued = int(i > 0 and own == at(i))
    return [
        "all",
        *shape(own),
        f"before={_word(before)}",
        f"before2={_word(at(i - 2).strip())}",
        f"after={_word(after)[:2]},{int(after == at(i + 1))}",
        *[f"asked{d}={t}" for d, t in enumerate(asked, 1)],
        f"kind,near={kind},{near}",
        f"kind,sign={kind},{_sign(before)},{glued}",
        *([f"again={glued}"] if own in (before, at(i - 2).strip()) else []),
    ]


def file_features(text: str) -> list[str]:
    """Features of the whole file."""
    return [f"assignments={_bucket(text.count('='), 1, 4, 16)}", f"file-asks={_bucket(text.count('password') + text.count('token') + text.count('key'), 1, 4)}"]


class Field:
    """A linear-chain conditional random field of three labels; it starts outside, and inside follows begin or inside only."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, 3))
        self.steps = np.zeros((3, 3))
        self.name = uuid.uuid4().hex  # tells a worker's tables of one field from another's

    def _steps(self) -> np.ndarray:
        steps = self.steps.copy()
        steps[OUT, INSIDE] = -np.inf
        return steps

    def weight(self, name: str) -> np.ndarray:
        at = self.index.get(name)
        return np.zeros(3) if at is None else self.weights[at]

    def train(self, chains: Iterable[tuple[list[list[str]], list[int]]], epochs: int, seed: int, rate: float = 0.2, shrink: float = 1e-4) -> Field:
        """Stochastic gradient ascent (Adagrad) on the likelihood of chains of (features per token, labels); of the features only their numbers are kept."""
        coded = []
        for rows, labels in chains:
            numbers = [self.index.setdefault(name, len(self.index)) for names in rows for name in names]
            own, at = np.unique(np.array(numbers, np.int32), return_inverse=True)
            sizes = np.array([len(names) for names in rows])
            coded.append((own, at.astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), sizes), np.cumsum(sizes) - sizes, labels))
        self.weights = np.zeros((len(self.index), 3))
        seen_w, seen_s = np.full_like(self.weights, 1e-6), np.full((3, 3), 1e-6)
        rng = random.Random(seed)
        # The mean of the later epochs' ends, which depends less on the order of the lines than the last one's.
        later = np.zeros_like(self.weights), np.zeros_like(self.steps)
        for epoch in range(epochs):
            rng.shuffle(coded)
            for own, at, token, starts, labels in coded:
                gap, step = self._expected(np.add.reduceat(self.weights[own[at]], starts))
                gap, step = -gap, -step
                gap[np.arange(len(labels)), labels] += 1
                np.add.at(step, ([OUT, *labels[:-1]], labels), 1)
                spread = gap[token]
                grown = np.stack([np.bincount(at, spread[:, k], len(own)) for k in range(3)], 1) - shrink * self.weights[own]
                seen_w[own] += grown**2
                self.weights[own] += rate * grown / np.sqrt(seen_w[own])
                step -= shrink * self.steps
                seen_s += step**2
                self.steps += rate * step / np.sqrt(seen_s)
            if epoch >= epochs // 2:
                later = later[0] + self.weights, later[1] + self.steps
        self.weights, self.steps = (x / (epochs - epochs // 2) for x in later)
        return self

    def _expected(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels per token and expected steps, by forward and backward sums of scaled chances."""
        steps = np.exp(self._steps())
        (s00, s01, s02), (s10, s11, s12), (s20, s21, s22) = steps.tolist()
        own = np.exp(score - score.max(1, keepdims=True)).tolist()
        # Plain numbers: a line's arrays are too short to gain by numpy.
        forward, scale, (a, b, c) = [], [], (1.0, 0.0, 0.0)
        for x, y, z in own:
            p, q, r = (a * s00 + b * s10 + c * s20) * x, (a * s01 + b * s11 + c * s21) * y, (a * s02 + b * s12 + c * s22) * z
            whole = p + q + r
            a, b, c = p / whole, q / whole, r / whole
            forward.append((a, b, c))
            scale.append(whole)
        backward, later, (a, b, c) = [(1.0, 1.0, 1.0)], [], (1.0, 1.0, 1.0)
        for (x, y, z), whole in zip(own[:0:-1], scale[:0:-1]):
            x, y, z = x * a / whole, y * b / whole, z * c / whole
            later.append((x, y, z))
            a, b, c = s00 * x + s01 * y + s02 * z, s10 * x + s11 * y + s12 * z, s20 * x + s21 * y + s22 * z
            backward.append((a, b, c))
        node = np.array(forward) * np.array(backward[::-1])
        edge = np.zeros((3, 3))
        edge[OUT] += node[0]
        if later:
            edge += np.array(forward[:-1]).T @ np.array(later[::-1]) * steps
        return node, edge

    def decode(self, score: np.ndarray) -> list[int]:
        """The best labels of a line's scores (Viterbi); in ties the smaller label."""
        steps = self._steps()
        best, back = steps[OUT] + score[0], []
        for s in score[1:]:
            through = best[:, None] + steps
            back.append(through.argmax(0))
            best = through.max(0) + s
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def steps_over_outside(self) -> list[list[float]]:
        """Steps, as gains over staying outside."""
        return (self._steps() - self.steps[OUT, OUT]).tolist()

    def slack(self) -> float:
        """What a token in a secret may gain by steps at most, over staying outside."""
        steps = self._steps() - self.steps[OUT, OUT]
        return float(steps[:, BEGIN:].max() + max(0.0, steps[BEGIN:, OUT].max()))


class Tables:
    """Gains (scores of begin and inside over outside) by spelling, for texts of any length.

    A gain is a sum: of the token's own spelling (as if no mark, blank or asking word before it told anything), of its neighbours', and
    of what the few that tell something change.
    """

    def __init__(self, field: Field):
        self.steps, self.slack = field.steps_over_outside(), field.slack()
        gains = dict(zip(field.index, map(tuple, (field.weights[:, BEGIN:] - field.weights[:, :1]).tolist())))
        self.gain = lambda name: gains.get(name, (0.0, 0.0))
        self.own = lambda names: tuple(map(sum, zip(*map(self.gain, names))))
        part = lambda head: {f[len(head) :]: g for f, g in gains.items() if f.startswith(head)}
        self.before, self.before2 = part("before="), part("before2=")
        self.after = {(f[:-2], int(f[-1])): g for f, g in part("after=").items()}
        asked = np.array([[self.gain(f"asked{d}={t}") for t in range(len(TRIGGERS) + 1)] for d in range(1, FELT + 1)])
        self.unasked, self.asked = asked[:, 0].sum(0), asked - asked[:, :1]
        self.again = np.array([self.gain("again=0"), self.gain("again=1")], np.float32)
        self.kinds: dict[str, int] = {}
        self.near, self.signed = np.zeros((0, FELT + 1, 2)), np.zeros((0, len(SIGNS) + 2, 2, 2), np.float32)
        self.read: dict[tuple, tuple] = {}
        self.known: dict[str, int] = {}
        self.parts = self.marks = None
        self._turn()

    def _turn(self) -> None:
        """Starts anew with no spellings; those known so far come back when they are met, and are forgotten at the next turn else."""
        self.older, self.older_parts, self.older_marks = self.known, self.parts, self.marks
        self.known = {}
        self.parts = np.zeros((KNOWN, 8), np.float32)  # own, as the one before, as the one before that, as the next
        self.marks = np.zeros((KNOWN, 4), np.int64)  # kind, trigger, 2 * sign + no blank before it, the spelling without the blank
        self._add([NOTHING])

    def _kind(self, kind: str) -> int:
        """The kind's number; what it says with neighbours is kept as the change from nothing said."""
        if kind not in self.kinds:
            self.kinds[kind] = len(self.kinds)
            near = np.array([self.gain(f"kind,near={kind},{d}") for d in range(FELT + 1)])
            signed = np.array([[self.gain(f"kind,sign={kind},{s},{n}") for n in (0, 1)] for s in range(len(SIGNS) + 2)], np.float32)
            self.near = np.concatenate([self.near, [near - near[0]]])
            self.signed = np.concatenate([self.signed, [signed - signed[0, 0]]])
        return self.kinds[kind]

    def _plainly(self, kind: str) -> np.ndarray:
        return np.add(self.gain(f"kind,near={kind},0"), self.gain(f"kind,sign={kind},0,0")) + self.unasked

    def _add(self, tokens: list[str]) -> None:
        back = [t for t in tokens if t in self.older]
        if back:
            n, at = len(self.known), [self.older[t] for t in back]
            self.known.update(zip(back, range(n, n + len(back))))
            self.parts[n : n + len(back)], self.marks[n : n + len(back)] = self.older_parts[at], self.older_marks[at]
            tokens = [t for t in tokens if t not in self.older]
        if not tokens:
            return
        n, owns = len(self.known), [t.strip() for t in tokens]
        kinds, words, glued = list(map(kind_of, owns)), list(map(_word, owns)), np.array(list(map(eq, owns, tokens)), np.int64)
        parts, marks = np.zeros((len(tokens), 8)), np.zeros((len(tokens), 4), np.int64)
        plain = [k for k, (own, kind) in enumerate(zip(owns, kinds)) if is_plain(own, kind)]
        if plain:
            number = {kind: k for k, kind in enumerate(dict.fromkeys(kinds[k] for k in plain))}
            read = np.column_stack([[number[kinds[k]] for k in plain], _spellings([owns[k] for k in plain])])
            read, which = np.unique(read @ [1000, 100, 10, 1], return_inverse=True)
            names = list(number)
            parts[plain, :2] = np.array([self._base(names[r // 1000], r // 100 % 10, r // 10 % 10, r % 10) for r in read.tolist()])[which]
        for k in sorted(set(range(len(tokens))).difference(plain)):
            marks[k, 2] = 2 * _sign(owns[k])
            if tokens[k] != NOTHING:
                parts[k, :2] = self._plainly(kinds[k]) + self.own(["all", *shape(owns[k])])
        for at, near in ((2, self.before), (4, self.before2)):
            told = [k for k, word in enumerate(words) if word in near]
            if told:
                parts[told, at : at + 2] = [near[words[k]] for k in told]
        none = (0.0, 0.0)
        parts[:, 6:] = [self.after.get((word[:2], g), none) for word, g in zip(words, glued.tolist())]
        marks[:, 0] = list(map(self._kind, kinds))
        # A token has no end of line within it, so what asks is looked for in all of them at once.
        ends = np.cumsum(list(map(len, tokens))) + np.arange(1, len(tokens) + 1)
        for m in ASKS.finditer(NOTHING.join(tokens)):
            k = int(np.searchsorted(ends, m.start(), "right"))
            marks[k, 1] = marks[k, 1] or 1 + TRIGGERS.index(m[0].lower())
        marks[:, 2] += glued
        marks[:, 3] = [xxhash.xxh64_intdigest(own) >> 1 for own in owns]
        self.known.update(zip(tokens, range(n, n + len(tokens))))
        self.parts[n : n + len(tokens)], self.marks[n : n + len(tokens)] = parts, marks

    def _base(self, kind: str, *spelling: int) -> tuple[float, float]:
        """The part of a plain token's own spelling."""
        key = kind, *spelling
        if key not in self.read:
            self.read[key] = tuple(self._plainly(kind) + self.own(["all", *_read(*key)]))
        return self.read[key]

    def rows(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts and marks of each token, however many spellings there are."""
        parts, marks, size = [], [], KNOWN // 2
        for start in range(0, len(tokens), size):
            some = tokens[start : start + size]
            ids = list(map(self.known.get, some))
            if None in ids:
                missing = {t for t, n in zip(some, ids) if n is None}
                if len(self.known) + len(missing) > KNOWN:
                    self._turn()
                    missing = set(some) - self.known.keys()
                self._add(list(missing))
                ids = list(map(self.known.__getitem__, some))
            parts.append(self.parts[ids])
            marks.append(self.marks[ids])
        return np.concatenate(parts), np.concatenate(marks)

    def gains(self, parts: np.ndarray, marks: np.ndarray, order: np.ndarray, file: np.ndarray) -> np.ndarray:
        """Gains of tokens in a row, of which row order[i] of parts and marks is the i-th's; row 0 is an end of line. file: the files' part of each."""
        out = np.empty((len(order), 2), np.float32)
        for start in range(0, len(order), SUMMED):
            a, b, end = max(0, start - FELT), min(len(order), start + SUMMED + 1), min(len(order), start + SUMMED)
            out[start:end] = self._summed(parts, marks, order[a:b], file[a:b])[start - a : end - a]
        return out

    def _summed(self, parts: np.ndarray, marks: np.ndarray, order: np.ndarray, file: np.ndarray) -> np.ndarray:
        n = len(order)
        padded = np.concatenate([np.zeros(2, order.dtype), order, [0]])
        nothing, ends = parts[0], padded == 0
        parts, marks = parts[padded], marks[padded]
        score = parts[2 : n + 2, :2] + file
        score += parts[1 : n + 1, 2:4]
        score += parts[:n, 4:6]
        score += parts[3:, 6:]
        heads = ends[1 : n + 1]  # tokens at a line's start have nothing before that
        score[heads] += nothing[4:6] - parts[:n, 4:6][heads]
        kind, own = marks[2 : n + 2, 0], marks[2:, 3][:n]
        before, glued = marks[1 : n + 1, 2] >> 1, (marks[2 : n + 2, 2] & 1) * ~heads
        told = np.flatnonzero((before > 0) | (glued > 0))
        score[told] += self.signed[kind[told], before[told], glued[told]]
        again = np.flatnonzero((~heads) & ((marks[1 : n + 1, 3] == own) | ((marks[:n, 3] == own) & ~ends[:n])))
        score[again] += self.again[glued[again]]
        trigger = marks[2 : n + 2, 1]
        # Words that ask are rare: what they change is added by itself.
        for p in np.flatnonzero(trigger).tolist():
            for d in range(1, FELT + 1):
                i = p + d
                if i >= n or order[i] == 0:
                    break
                score[i] += self.asked[d - 1, trigger[p]]
                if not trigger[p + 1 : i].any():
                    score[i] += self.near[kind[i], d]
        return score


#: Words that stand near those that ask for a secret.
COMMON = "the of and to in is was for with that this must should required invalid missing expired wrong changed reset your our their it be by from when after before please enter forgot never none null true false people through strength length rhythm thoughts idea point question moment value function field button card board stone note signature west east".split()
#: Longer words that stand there.
LONGER = "instructions requirements authentication configuration management verification protection administrator information notification registration application expiration encryption documentation confirmation permissions immediately automatically successfully temporarily regularly".split()
#: Words of which pass phrases are made.
PHRASE = "correct horse battery staple hunter summer winter dragon monkey shadow master sunshine princess football baseball welcome charlie tiger silver purple orange coffee guitar cheese rocket planet garden window yellow autumn spring monday friday river castle pepper cookie banana flower".split()


class Lines:
    """Generated lines of known truth."""

    def __init__(self, rng: random.Random):
        #: most: syllables of words of prose; where a secret is asked for, a long word would be one.
        self.rng, self.most = rng, 7

    def pick(self, chars: str, n: int) -> str:
        return "".join(self.rng.choice(chars) for _ in range(n))

    def spoken(self, n: int) -> str:
        """A made-up word of n syllables."""
        rng = self.rng
        return "".join(rng.choice(["", *"bcdfglmnprst", "st", "tr", "ch", "th", "nd", "qu"]) + rng.choice(["a", "e", "i", "o", "u", "ea", "ou", "é", "è", "ö", "ä", "í", "ó", "ei"] if rng.random() < 0.3 else list("aeiou")) + rng.choice(["", "", *"nrslt", "nt", "ng", "nd", "th", "ch", "ß", "tz", "sch", "ción", "x"] if rng.random() < 0.3 else ["", "", *"nrslt"]) for _ in range(n))

    def said(self) -> str:
        """A word of prose with the mark that may follow it."""
        rng = self.rng
        x = rng.random()
        word = rng.choice(COMMON) if x < 0.35 else self.spoken(min(self.most, rng.choice([1, 1, 2, 2, 2, 3, 3, 4, 5, 6, 7]))) if x < 0.9 else self.pick(string.ascii_lowercase, rng.randrange(1, 9))
        x = rng.random()
        word = "ß" + word if x > 0.95 else word
        # A capital ß is SS before small letters; names and abbreviations turn within a word, too.
        word = rng.choice([word.title(), word[:1].upper() + word[1:]]) if x < 0.12 or x > 0.96 else word.upper() if x < 0.15 else self.turned(word) if x < 0.15 + TURNED else word
        return word + rng.choice(["", "", "", "", "", "", ",", ".", ". ", ":", "!", "?", "***", "$$$", "!!"])

    def turned(self, word: str) -> str:
        """A word that turns from small to capital letters or back, as names, plurals of abbreviations and words run together do."""
        rng = self.rng
        return rng.choice([self.pick(string.ascii_uppercase, rng.randrange(2, 5)) + rng.choice(["s", "ed", word.lower()]), rng.choice(["Mc", "Mac", "De", "i", "e", "La"]) + word.title(), word.lower() + self.spoken(1).title()])

    def prose(self, least: int, most: int) -> str:
        return " ".join(self.said() for _ in range(self.rng.randrange(least, most))).rstrip(" ")

    def junk(self) -> str:
        """Words said again and again, with symbols, in tables or in capitals."""
        rng = self.rng
        word = lambda: rng.choice([self.spoken(rng.randrange(1, 7)), rng.choice(COMMON)])
        x, sign = rng.random(), rng.choice(["###", "***", "$$$", "%%%", "&&&", "!!", ""])
        if x < 0.4:
            return " ".join(" ".join([rng.choice([w, w.title()])] * rng.randrange(2, 40)) for w in (word() for _ in range(rng.randrange(1, 5))))
        if x < 0.6:
            return rng.choice([" | ", " ; ", ", "]).join(word() for _ in range(rng.randrange(3, 12)))
        return " ".join((w.upper() if x > 0.85 else w) + rng.choice([sign, sign, "###", ""]) for w in (word() for _ in range(rng.randrange(4, 20))))

    def opaque(self) -> str:
        """A secret that looks like one."""
        rng, pick = self.rng, self.pick
        low, up, num = string.ascii_lowercase, string.ascii_uppercase, string.digits
        word = low + up + num
        return rng.choice(
            [
                lambda: pick("0123456789abcdef", rng.choice([18, 20, 24, 32, 40, 64])),
                lambda: "AKIA" + pick(up + num, 16),
                lambda: rng.choice(["ghp_", "gho_", "glpat-", "npm_", "hf_", "pat_", "shpat_"]) + pick(word, rng.choice([20, 34, 36])),
                lambda: rng.choice(["sk_live_", "pk_live_", "rk_test_"]) + pick(word, 24),
                lambda: "xoxb-" + pick(num, 11) + "-" + pick(word, 24),
                lambda: "eyJ" + pick(word, 30) + "." + pick(word, 60) + "." + pick(word + "-_", 42) + "a",
                lambda: pick(word + "+", 40),
                lambda: pick(word + "+", 64),
                lambda: pick(word, rng.choice([16, 24, 32, 48])),
                lambda: "AIza" + pick(word + "-_", 34) + "b",
            ]
        )()

    def chosen(self) -> str:
        """A secret that a person chose; most only tell by what stands before."""
        rng, pick = self.rng, self.pick
        letters = string.ascii_letters
        words = lambda n: [rng.choice(PHRASE) for _ in range(n)]
        return rng.choice(
            [
                lambda: "".join(words(rng.randrange(2, 5))),
                lambda: "".join(w.title() for w in words(rng.randrange(2, 4))) + pick(string.digits, rng.randrange(0, 4)),
                lambda: rng.choice("-_.").join(words(rng.randrange(2, 5))),
                lambda: rng.choice(words(1)) + pick(string.digits, rng.randrange(1, 5)) + rng.choice(["", "!", "#", "$$"]) + rng.choice(words(1)),
                lambda: pick(letters, rng.randrange(3, 6)) + rng.choice("!@#$%&*") + pick(letters + string.digits, rng.randrange(3, 8)),
                lambda: pick(string.digits + letters, rng.randrange(2, 5)) + rng.choice("!#$%^&*?") + pick(letters, 3) + rng.choice("!#$%^&*?") + pick(letters + string.digits, rng.randrange(2, 5)),
                lambda: pick(letters, rng.randrange(12, 33)),
                lambda: pick(string.ascii_lowercase, rng.randrange(10, 21)),
                lambda: pick(string.ascii_lowercase, rng.randrange(10, 21)).title(),
                lambda: pick(string.digits, rng.randrange(8, 17)),
                lambda: pick(letters + string.digits, rng.randrange(7, 14)),
                lambda: pick(letters + string.digits, rng.randrange(6, 10)),
                lambda: pick(string.ascii_lowercase, 2) + pick(string.digits, 2) + pick(letters, 3),
            ]
        )()

    def plain(self) -> str:
        """What isn't a secret, but not prose either."""
        rng, pick = self.rng, self.pick
        low, up, num, digit = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
        name = lambda: self.spoken(rng.randrange(1, 4))
        return rng.choice(
            [
                lambda: f"v{rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(9)}-{rng.choice(['beta', 'rc', 'alpha'])}{rng.randrange(9)}",
                lambda: f"20{pick(num, 2)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}T1{rng.randrange(9)}:{pick(num, 2)}",
                lambda: f"{name()}.{rng.randrange(100)}@{name()}{rng.randrange(9)}.example.com",
                lambda: f"{name()}@{name()}.{rng.choice(['com', 'org', 'fr'])}",
                lambda: f"+{rng.randrange(1, 99)} ({pick(num, 3)}) {pick(num, 3)}-{pick(num, 4)}",
                lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
                lambda: pick(num, rng.randrange(1, 17)),
                lambda: rng.choice(["4", "5", "37"]) + pick(num, 15),
                lambda: " ".join(pick(num, 4) for _ in range(4)),
                lambda: f"https://{name()}{rng.randrange(100)}.example.com/{name()}/{name()}-{name()}-{rng.randrange(9999)}.html",
                lambda: f"http://www.{name()}.org/{name()}?{name()}={rng.randrange(99)}&{name()}={name()}",
                lambda: f"postgres://{name()}@{name()}.{name()}:5432/{name()}",
                lambda: f"{rng.choice(['report', 'image', 'chapter', 'invoice', 'section'])}{rng.randrange(2030)}_{rng.choice(['final', 'draft', 'copy'])}.{rng.choice(['pdf', 'png', 'txt'])}",
                lambda: f"{pick(up, 3)}-{pick(num, 5)}",
                lambda: f"{pick(digit, 8)}-{pick(digit, 4)}-4{pick(digit, 3)}-a{pick(digit, 3)}-{pick(digit, 12)}",
                lambda: f"/{pick(low, 5)}/{pick(low, 6)}{rng.randrange(99)}/{pick(low, 7)}",
                lambda: f"{name()}{rng.randrange(2030)}",
                lambda: f"{name()}{name().title()}{name().title()}",
                lambda: f"{name()}_{name()}_{name()}",
                lambda: f"{name().upper()}_{name().upper()}",
                lambda: f"{name()} = {rng.choice([name(), str(rng.randrange(99)), name() + '()'])}",
                lambda: f"def {name()}({name()}, {name()}={rng.randrange(9)}):",
                lambda: f"<{rng.choice(['div', 'a', 'p', 'td'])} class='{name()}-{name()}'>",
                lambda: f"ISBN{pick(num, 10)}",
                lambda: f"{rng.randrange(1, 900)}{rng.choice(['million', 'th-century', 'kilometres', 'percent'])}",
                lambda: f"x{rng.randrange(9)}+y{rng.randrange(9)}+z{rng.randrange(9)}+w{rng.randrange(9)}",
                lambda: f"Licensed under {rng.choice(['CC BY-NC 4.0', 'the MIT License', 'Apache-2.0', 'GPL-3.0-or-later'])}.",
            ]
        )()

    def line(self) -> tuple[str, list[tuple[int, int]]]:
        """A line and where its secrets are."""
        rng = self.rng
        text, spans = "", []

        def add(part: str, secret: bool = False) -> None:
            nonlocal text
            if secret:
                spans.append((len(text), len(text) + len(part)))
            text += part

        def head() -> None:
            if (before := self.prose(0, 9)) and rng.random() < 0.7:
                add(before + " ")

        asks = rng.choice(["password", "passwd", "pwd", "pass", "secret", "token", "api_key", "apikey", "auth", "access_key", "client_secret", "credentials", "key", "passphrase", "auth token", "secret key", "API key", "Password", "PASSWORD", "TOKEN", "DB_PASSWORD", "privateKey"])
        quote = rng.choice(["", "", '"', "'", "`"])
        x = rng.random()
        self.most = 4 if x < 0.44 or 0.72 <= x < 0.9 else 7
        head()
        if x < 0.25:
            add(rng.choice(["", "", "my ", "the ", "new ", "your "]) + asks + rng.choice(["=", " = ", ": ", ":", " is ", " is: ", " ", " => ", " := ", " was ", " to "]) + quote)
            add(self.chosen() if rng.random() < 0.65 else self.opaque(), True)
            add(quote)
        elif x < 0.33:
            add(rng.choice(["", "", "Bearer ", "Authorization: Bearer ", "Authorization: Basic ", "use ", "-H ", "login with ", "x-auth-key: "]))
            add(self.pick(string.ascii_letters, rng.randrange(16, 33)) if text.endswith(("Bearer ", "Basic ")) and rng.random() < 0.4 else self.opaque(), True)
        elif x < 0.39:
            add(rng.choice(["postgres", "mysql", "https", "ftp", "amqp", "redis", "mongodb+srv"]) + "://" + rng.choice([self.spoken(2), "root", "admin", "user", ""]) + ":")
            add(self.chosen() if rng.random() < 0.5 else self.opaque(), True)
            add("@" + self.spoken(2) + rng.choice([".example.com", "", ":5432", ".local"]) + rng.choice(["", "/" + self.spoken(1)]))
        elif x < 0.44:
            add(f"{asks}{rng.choice([': ', ' is ', '='])}")
            one, two = (self.opaque(), self.opaque()) if rng.random() < 0.4 else (self.chosen(), self.chosen())
            add(f"{one} {two}", True)
            if rng.random() < 0.6:  # words that follow a secret of two words stand apart
                add(rng.choice([".", ",", ";", " ."]))
        elif x < 0.72:
            for _ in range(rng.randrange(1, 4)):
                add(rng.choice(["", "", "version ", "see ", "file=", "id: ", "at ", "user ", "contact ", "commit ", "card ", "phone: ", "name: "]) + self.plain() + " " + self.prose(1, 8) + " ")
        elif x < 0.78:
            plain = self.plain()
            while re.fullmatch("[0-9]{7,}", plain):  # there it would be a secret
                plain = self.plain()
            add(asks + rng.choice([" ", " was ", " in ", ", "]) + plain)
        elif x < 0.9:
            add(rng.choice(["the ", "a ", "", "my ", "The ", "Your ", "this "]) + rng.choice([asks, asks, "author", "keyboard", "passage", "monkey", "authority", "tokens", "keys", "secretary", "passenger"]) + rng.choice([" ", " is ", " was ", " of ", ", ", ". ", ": ", " for ", " to "]))
            # What follows is a word that is used: a long one there would be a pass phrase.
            add(rng.choice([rng.choice(COMMON), rng.choice(COMMON), rng.choice(COMMON) + " " + rng.choice(LONGER), rng.choice(LONGER), self.spoken(rng.randrange(1, 4))[:10]]) + " " + self.prose(2, 9))
        elif x < 0.94:
            add(self.junk())
        else:
            add(self.prose(4, 30))
        if rng.random() < 0.7:
            add(rng.choice(["", ".", ",", ""]) + " " + self.prose(1, 9))
        return text, spans


def labelled(text: str, spans: list[tuple[int, int]]) -> list[tuple[list[str], list[int]]]:
    """Tokens and labels of every line."""
    out, line = [], ([], [])
    for m in TOKEN.finditer(text):
        if m[0] == NOTHING:
            out.append(line)
            line = ([], [])
            continue
        start = m.end() - len(m[0].lstrip())
        inside = next(((s, e) for s, e in spans if start < e and s < m.end()), None)
        line[0].append(m[0])
        line[1].append(OUT if inside is None else BEGIN if start <= inside[0] else INSIDE)
    return [x for x in [*out, line] if x[0]]


@lru_cache(maxsize=4)
def trained(lines: int = TRAIN_LINES, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """The field, trained on so many generated lines, in files of one to eight lines."""
    field = Field().train(_chains(lines, seed), epochs, seed)
    trim()
    return field


def _chains(lines: int, seed: int) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Features and labels of so many generated lines."""
    made, left = Lines(random.Random(seed)), lines
    while left > 0:
        own = [made.line() for _ in range(min(left, made.rng.randrange(1, 9)))]
        left -= len(own)
        file = file_features("\n".join(t for t, _ in own))
        for text, spans in own:
            for tokens, labels in labelled(text, spans):
                yield [features(tokens, i) + file for i in range(len(tokens))], labels


def _tables(field: Field) -> Tables:
    return kept(("secrets", field.name, KNOWN), lambda: Tables(field))


def _regions(gains: np.ndarray, ends: np.ndarray, slack: float) -> list[tuple[int, int]]:
    """Parts of lines that hold every run of tokens which gains by being in a secret, however the steps fall; outside of them outside is best.

    A token gains bound (its gain and slack) at most. A run that reaches beyond a part would have to make up for the negative bounds
    on the way with all positive ones of the line.
    """
    bound = gains.max(1) + slack
    bound[ends] = -np.inf
    hopeful = np.flatnonzero(bound > 0)
    if not len(hopeful):
        return []
    line = np.cumsum(ends)[hopeful]
    most = np.bincount(line, bound[hopeful])[line].tolist()
    parts: list[tuple[int, int]] = []
    for n, rest in zip(hopeful.tolist(), most):
        if parts and n < parts[-1][1]:
            continue
        a, left = n, rest
        while a and (left := left + min(0.0, bound[a - 1])) > 0:
            a -= 1
        b, left = n + 1, rest
        while b < len(bound) and (left := left + min(0.0, bound[b])) > 0:
            b += 1
        if parts and a <= parts[-1][1]:
            a = parts.pop()[0]
        parts.append((a, b))
    return parts


def best_labels(gains: list[list[float]], steps: list[list[float]], last: bool) -> list[int]:
    """The best labels (Viterbi) of a part of a line with outside before it, and after it unless it is the last; in ties the smaller label."""
    never = -np.inf
    best, back = [0.0, never, never], []
    for own in gains:
        through = [[best[k] + steps[k][label] for k in range(3)] for label in range(3)]
        back.append([max(range(3), key=t.__getitem__) for t in through])
        best = [max(through[0]), max(through[1]) + own[0], max(through[2]) + own[1]]
    if not last:
        best = [best[k] + steps[k][OUT] for k in range(3)]
    path = [max(range(3), key=best.__getitem__)]
    for b in reversed(back[1:]):
        path.append(b[path[-1]])
    return path[::-1]


def regions_labels(gains: np.ndarray, regions: list[tuple[int, int]], steps: list[list[float]], last: list[bool]) -> Iterator[tuple[int, list[int]]]:
    """Start and best_labels() of each region that isn't outside throughout, those of one length at once."""
    size, step = np.array([b - a for a, b in regions], np.int64), np.array(steps)
    for n in np.unique(size).tolist():
        some = np.flatnonzero(size == n)
        if len(some) < FEW:
            for (a, b), to_end in ((regions[k], last[k]) for k in some.tolist()):
                if any(labels := best_labels(gains[a:b].tolist(), steps, to_end)):
                    yield a, labels
            continue
        starts, ends = np.array([regions[k][0] for k in some.tolist()]), np.array([last[k] for k in some.tolist()])
        best, back = np.tile([0.0, -np.inf, -np.inf], (len(some), 1)), np.zeros((n, len(some), 3), np.int8)
        for k in range(n):
            through = best[:, :, None] + step
            back[k], best = through.argmax(1), through.max(1)
            best[:, 1:] += gains[starts + k]
        labels, row = np.zeros((len(some), n), np.int64), np.arange(len(some))
        labels[:, -1] = np.where(ends[:, None], best, best + step[:, OUT]).argmax(1)
        for k in range(n - 1, 0, -1):
            labels[:, k - 1] = back[k, row, labels[:, k]]
        for k in np.flatnonzero(labels.any(1)).tolist():
            yield int(starts[k]), labels[k].tolist()


def field_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """Spans that the field tags as secrets."""
    return next(_field_spans(as_strings([text]), field))


def _field_spans(texts: pa.Array, field: Field) -> Iterator[list[tuple[int, int]]]:
    """Spans that the field tags as secrets, of each text. Tokens never reach over a cut, so they are found once in each different piece."""
    tables = _tables(field)
    for part in sliced(texts):
        spelled, piece, edges = cut(part)
        # Rows 0 and 1 are ends of lines: the first alone stands for a line feed, both between texts. Pieces are parted by ends, too.
        tokens = [NOTHING, *TOKEN.findall("".join(NOTHING + ("" if p == NOTHING else p) for p in spelled))]
        parts, marks = tables.rows(tokens)
        bounds = np.append(np.flatnonzero([t == NOTHING for t in tokens])[1:], [len(tokens), len(tokens)])
        first, size = bounds[:-1] + 1, np.diff(bounds) - 1
        first[-1], size[-1] = 0, 2
        feed = [n for n, p in enumerate(spelled) if p == NOTHING]
        first[feed], size[feed] = 0, 1
        piece = np.insert(piece, edges[:-1], len(spelled))
        order = spread(first[piece], size[piece])
        order[order == 1] = 0
        heads = edges[:-1] + np.arange(len(part))
        starts = np.append(np.cumsum(size[piece])[heads], len(order))
        features = [file_features(t.as_py()) for t in part]
        file = np.array([np.add(*map(tables.gain, f)) for f in features]).astype(np.float32)
        gains = tables.gains(parts, marks, order, np.repeat(file, np.diff(np.append(starts[:-1] - 2, len(order))), 0)).astype(float)
        ends, found = order == 0, {}
        regions = _regions(gains, ends, tables.slack)
        last = [b == len(order) or bool(ends[b]) for _, b in regions]
        for a, labels in sorted(regions_labels(gains, regions, tables.steps, last)):
            found.setdefault(int(np.searchsorted(starts, a, "right")) - 1, []).append((a, labels))
        for k, text in enumerate(part):
            yield _labelled_spans(text.as_py(), int(starts[k]), found[k]) if k in found else []


def _labelled_spans(text: str, head: int, regions: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
    """Spans of the labels of a text's regions, whose tokens are counted from head."""
    starts, spans = [(m.end() - len(m[0].lstrip()), m.end()) for m in TOKEN.finditer(text)], []
    for a, labels in regions:
        for k, label in enumerate(labels, a - head):
            if label == BEGIN:
                spans.append(starts[k])
            elif label == INSIDE:
                spans[-1] = (spans[-1][0], starts[k][1])
    return spans


def all_spans(text: str, field: Field) -> list[tuple[str, int, int]]:
    """Spans of the patterns, and the parts of the field's that lie outside of them (white space at their ends aside); by start, then kind."""
    return next(_all_spans(as_strings([text]), field))


def _all_spans(texts: pa.Array, field: Field) -> Iterator[list[tuple[str, int, int]]]:
    """all_spans() of each text."""
    may = pc.match_substring_regex(texts, MAY)
    for text, some, own in zip(texts, may.to_pylist(), _field_spans(texts, field)):
        yield _joined(text.as_py(), pattern_spans(text.as_py()) if some else [], own) if some or own else []


def _joined(text: str, found: list[tuple[str, int, int]], own: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The patterns' spans, and the parts of the field's outside of them."""
    more, k = [], 0
    for start, end in own:
        # The field's spans go on by start, so patterns that end before one are behind for good.
        while k < len(found) and found[k][2] <= start:
            k += 1
        at, n, met = start, k, []
        while n < len(found) and found[n][1] < end:
            met.append(found[n][1:])
            n += 1
        for a, b in [*met, (end, end)]:
            part = text[at : max(at, min(a, end))]
            if part.strip():
                more.append(("crf", at + len(part) - len(part.lstrip()), at + len(part.rstrip())))
            at = max(at, b)
    return sorted(found + more, key=lambda s: (s[1], KINDS.index(s[0])))


def scanned(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(field or trained())
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in found] for found in _all_spans(b.column(1), model.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return rows.mapInArrow(found, f"doc_id {rows.dtypes[0][1]}, spans {SPANS}")


def without(text: str, spans: list[tuple[str, int, int]], mask: str = MASK) -> str:
    """The text with each span, or group of overlapping spans, replaced by the mask."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, field: Field | None = None, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """docs with secrets in the text column replaced; a null text stays null."""
    model = docs.sparkSession.sparkContext.broadcast(field or trained())

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        found = _all_spans(as_strings([t or "" for t in texts]), model.value)
        return pd.Series([None if t is None else without(t, spans, mask) for t, spans in zip(texts, found)], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))
