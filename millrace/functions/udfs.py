"""The few functions that SQL expressions can't give: parsers of code and lax JSON, and sequence matching. All take Arrow batches."""

from __future__ import annotations

import ast
import difflib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modules that checked code may import, and builtins that it may not call. Fixed values.
ALLOWED = frozenset("math statistics decimal fractions cmath random itertools functools operator collections numbers string re".split())
BLOCKED = frozenset("exec eval compile __import__ open breakpoint".split())


def code_problem(code: str | None) -> str:
    """'ok', or what forbids running the code. It is parsed, never run."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return "syntax_error"
    for node in ast.walk(tree):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        for name in names:
            if name and name.split(".")[0] not in ALLOWED:
                return f"blocked_import: {name}"
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in BLOCKED:
            return f"blocked_builtin: {node.func.id}"
    return "ok"


def first_object(text: str | None) -> tuple[str | None, str]:
    """The first balanced {...} of a noisy text that is JSON, and the text without it; code fences don't matter."""
    plain = re.sub(r"```(?:json)?", "", text or "")
    at = plain.find("{")
    while at >= 0:
        try:
            _, end = json.JSONDecoder(strict=False).raw_decode(plain, at)
            return plain[at:end], (plain[:at] + plain[end:]).strip()
        except ValueError:
            at = plain.find("{", at + 1)
        except RecursionError:
            break
    return None, plain.strip()


_ARGUMENT = re.compile(r"(\w+)\s*=\s*(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|([-+]?\d+(?:\.\d+)?))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\"}


def xml_call(inner: str | None) -> tuple[str, str] | None:
    """Name and arguments (JSON) of name(key=value, ...): triple-quoted, quoted with escapes, or numbers."""
    m = re.match(r"\s*(\w+)\s*\(", inner or "")
    if not m:
        return None
    arguments: dict[str, object] = {}
    for a in _ARGUMENT.finditer(inner, m.end()):
        quoted = a[4] if a[4] is not None else a[5]
        if a[2] is not None or a[3] is not None:
            arguments[a[1]] = a[2] if a[2] is not None else a[3]
        elif quoted is not None:
            arguments[a[1]] = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], "\\" + e[1]), quoted, flags=re.DOTALL)
        else:
            arguments[a[1]] = float(a[6]) if "." in a[6] else int(a[6])
    return m[1], json.dumps(arguments, ensure_ascii=False)


def repaired(code: str | None) -> str | None:
    """Doubly escaped code with its escapes undone, if only then it parses."""
    if code is None or code_problem(code) != "syntax_error":
        return code
    undone = code.replace("\\n", "\n").replace("\\t", "\t").replace('\\"', '"')
    return undone if code_problem(undone) != "syntax_error" else code


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit per word of a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _scalar(kind: str, f: Callable) -> Callable[..., Column]:
    """A column function that applies f to each row of Arrow batches; made when called, as types need a session."""

    def one(a: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in a], dtype=object)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)])

    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else two, kind)(*columns)


def _struct(kind: str, f: Callable, names: list[str]) -> Callable[..., Column]:
    def one(a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(x) or (None,) * len(names) for x in a], columns=names)

    return lambda value: F.pandas_udf(one, kind)(value)


def ratio(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


def rouge_l(a: str | None, b: str | None) -> float:
    """F-measure of the longest common subsequence of words."""
    p, q = re.findall(r"[a-z0-9]+", (a or "").lower()), re.findall(r"[a-z0-9]+", (b or "").lower())
    return 2 * common_subsequence(p, q) / (len(p) + len(q)) if p and q else 0.0


code_problem_udf = _scalar("string", code_problem)
repaired_udf = _scalar("string", repaired)
similarity_udf = _scalar("double", ratio)
rouge_l_udf = _scalar("double", rouge_l)
first_object_udf = _struct("found string, rest string", first_object, ["found", "rest"])
xml_call_udf = _struct("name string, arguments string", xml_call, ["name", "arguments"])
