"""Overlap of a text with a reference: ROUGE-1, ROUGE-2 and ROUGE-L, on words or on their stems.

Words are runs of a-z and 0-9 of the lower-cased text. Stems are Porter's (1980), with the usual extensions: irregular forms, and
words of one or two letters as they are; only words of more than three characters are stemmed. A worker stems each word once, up to STEMS of
them at a time. One Arrow pass scores a row from its two texts: counts for n-grams, a bit per word of the shorter text for
the longest common subsequence. A null text has no words; without words on either side all scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.udfs import common_subsequence

STEMS = 1 << 17
ROWS = 256
WORDS = re.compile(r"[a-z0-9]+")
#: Words with stems of their own. Fixed values.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
#: Endings and what stands for them where the rest has a syllable (steps 2 and 3), and endings that go where it has two (step 4). Fixed values.
SECOND = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble fulli:ful"
THIRD = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _form(word: str) -> str:
    """The word as vowels (v) and consonants (c); y is a vowel behind a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often consonants follow vowels."""
    return len(re.findall("v+c+", _form(stem)))


def _short(stem: str) -> bool:
    """Whether it ends like 'hop', or is like 'at'."""
    form = _form(stem)
    return (form.endswith("cvc") and stem[-1] not in "wxy") or form == "vc"


def _swapped(word: str, rules: str) -> str:
    """The word by the first rule whose ending it has."""
    for rule in rules.split():
        ending, new = rule.split(":")
        if word.endswith(ending):
            return word[: -len(ending)] + new if _measure(word[: -len(ending)]) > 0 else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    rest = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in _form(word[: -len(e)])), None)
    if rest is None:
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if len(rest) > 1 and rest[-1] == rest[-2] and _form(rest)[-1] == "c":
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if _measure(rest) == 1 and _short(rest) else rest


def _second(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _second(word[:-2])
    found = _swapped(word, SECOND)
    if found == word and word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return found


def _fourth(word: str) -> str:
    for ending in FOURTH.split():
        if word.endswith(ending):
            rest = word[: -len(ending)]
            return rest if _measure(rest) > 1 and (ending != "ion" or rest[-1] in "st") else word
    return word


def _last(word: str) -> str:
    if word.endswith("e"):
        n = _measure(word[:-1])
        word = word[:-1] if n > 1 or (n == 1 and not _short(word[:-1])) else word
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=STEMS)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _form(word)[-2] == "c":
        word = word[:-1] + "i"
    return _last(_fourth(_swapped(_second(word), THIRD)))


def words_of(text: str | None, stems: bool) -> list[str]:
    words = WORDS.findall((text or "").lower())
    return [stem(w) if len(w) > 3 else w for w in words] if stems else words


def _shares(hits: int, own: int, other: int) -> tuple[float, float, float]:
    return hits / own if own else 0.0, hits / other if other else 0.0, 2 * hits / (own + other) if own + other else 0.0


def rouge(text: str | None, reference: str | None, stems: bool) -> tuple[float, ...]:
    """Precision, recall and F-measure of words, of pairs of words, and of the longest common subsequence."""
    a, b = words_of(text, stems), words_of(reference, stems)
    pairs = lambda w: list(zip(w, w[1:]))
    hits = lambda x, y: sum((Counter(x) & Counter(y)).values())
    longest = common_subsequence(*sorted((a, b), key=len))
    return (*_shares(hits(a, b), len(a), len(b)), *_shares(hits(pairs(a), pairs(b)), max(len(a) - 1, 0), max(len(b) - 1, 0)), *_shares(longest, len(a), len(b)))


FIELDS = [f"rouge{n}_{m}" for n in ("1", "2", "l") for m in "prf"]


def slices(texts: pa.Array, references: pa.Array) -> Iterator[Iterable[tuple[str | None, str | None]]]:
    """The pairs, ROWS at a time: no more texts of a batch than these are strings at once."""
    for at in range(0, len(texts), ROWS):
        yield zip(texts.slice(at, ROWS).to_pylist(), references.slice(at, ROWS).to_pylist())


def rouge_scores(text: Column, reference: Column, stems: bool = True) -> Column:
    """A struct of FIELDS for a text and its reference."""

    def score(texts: pa.Array, references: pa.Array) -> pa.Array:
        scores = [np.zeros(0)] + [np.array([rouge(t, r, stems) for t, r in rows], float).ravel() for rows in slices(texts, references)]
        table = np.concatenate(scores).reshape(-1, len(FIELDS))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], FIELDS)

    # The types are said by annotations; as strings they would not be read.
    score.__annotations__ = {"texts": pa.Array, "references": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, ", ".join(f"{f} double" for f in FIELDS))(text, reference)
