"""A registry of tools as Column builders, and the hook for models.

A tool maps a call's arguments (a map of strings) to a result. What a tool can't compute in an expression (a search, printed output,
a stored memory) is a column that the caller gives; without it the result is what the tool says when it has no backend.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.scoring import ALWAYS_ON, PROFILES

Arguments = Callable[[str], Column]
#: What session tools say without a store, and the sections that there are. Fixed values.
EMPTY_PAD = "(scratchpad is empty — training example initialisation)"
NO_MEMORY = "(user memory not available in this session)"
PAD_UPDATED = "(scratchpad updated)"
MEMORY_SKIPPED = "(user memory update skipped — training context)"


@dataclass(frozen=True)
class Tool:
    """name, what it is for, its parameters (name -> whether it is needed), and its result as a builder over arguments."""

    name: str
    description: str
    parameters: dict[str, bool]
    result: Callable[[Arguments], Column]

    def schema(self) -> dict:
        properties = {p: {"type": "string"} for p in self.parameters}
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": properties, "required": [p for p, must in self.parameters.items() if must]}}}


class Registry:
    """Tools by name, in the order in which they were registered."""

    def __init__(self, tools: tuple[Tool, ...] = ()):
        self.tools: dict[str, Tool] = {}
        for tool in tools:
            self.register(tool)

    def register(self, tool: Tool) -> None:
        """Adds a tool, or takes the place of the one of its name."""
        self.tools[tool.name] = tool

    def deregister(self, name: str) -> None:
        """Removes a tool; none of that name is no error."""
        self.tools.pop(name, None)

    def schemas(self, profile: str) -> str:
        """JSON of the tools that a profile has, in order; byte for byte the same each time."""
        active = {*PROFILES.get(profile, ()), *ALWAYS_ON}
        return json.dumps([t.schema() for t in self.tools.values() if t.name in active], ensure_ascii=False)

    def call(self, name: Column, arguments: Column, active: Column, gated: bool = True) -> Column:
        """The result of a call: the tool's; an error if the session doesn't have the tool (always-on ones aside), or nobody knows it."""
        out = F.concat(F.lit("Error: unknown tool '"), F.coalesce(name, F.lit("")), F.lit("' — only registered tools are callable."))
        for tool in reversed(self.tools.values()):
            result = tool.result(lambda key: F.coalesce(F.try_element_at(arguments, F.lit(key)), F.lit("")))
            if gated and tool.name not in ALWAYS_ON:
                result = F.when(F.array_contains(active, tool.name), result).otherwise(f"Error: tool '{tool.name}' is not available in this session.")
            out = F.when(name == tool.name, result).otherwise(out)
        return out


def builtins(printed: Column | None = None, found: Column | None = None, page: Column | None = None, now: Column | None = None, pad: Column | None = None, memory: Column | None = None) -> Registry:
    """The ten tools; what code printed, a search found, a page says, the clock tells, and a pad or memory holds are columns."""
    none = F.lit(None).cast("string")
    given = lambda c: none if c is None else c
    return Registry((
        Tool("python_execute", "Run Python code.", {"code": True}, lambda a: F.coalesce(given(printed), F.lit("(no output)"))),
        Tool("web_search", "Search the web.", {"query": True}, lambda a: F.coalesce(given(found), F.concat(F.lit("No results for: "), a("query")))),
        Tool("read_url", "Read a page.", {"url": True, "prompt": False}, lambda a: F.concat(F.lit("[Fetched: "), a("url"), F.lit("]"), F.when(a("prompt") != "", F.concat(F.lit("\nPrompt: "), a("prompt"))).otherwise(""), F.lit("\n\n"), F.coalesce(given(page), F.lit("")))),
        Tool("get_datetime", "The time.", {}, lambda a: F.coalesce(given(now), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss 'UTC'"))),
        Tool("scratchpad_sections", "Names of the pad's sections.", {}, lambda a: F.lit("todo, notes, done")),
        Tool("scratchpad_read", "Read the pad.", {}, lambda a: F.coalesce(given(pad), F.lit(EMPTY_PAD))),
        Tool("scratchpad_update", "Write to the pad.", {"section": True, "content": True}, lambda a: F.lit(PAD_UPDATED)),
        Tool("user_memory_sections", "Names of the memory's sections.", {}, lambda a: F.lit("goals, role, notes")),
        Tool("user_memory_read", "Read what is known of the user.", {"prompt": False}, lambda a: F.coalesce(given(memory), F.lit(NO_MEMORY))),
        Tool("user_memory_update", "Remember something of the user.", {"section": True, "content": True}, lambda a: F.when(given(memory).isNotNull(), F.concat(F.lit("(user memory updated: section='"), a("section"), F.lit("')"))).otherwise(MEMORY_SKIPPED)),
    ))


def model_hook(answer: Callable[[str], str | None] | None = None) -> Callable[[Column], Column]:
    """prompt -> answer of a model, by an Arrow batch at a time; without one all answers are null."""
    if answer is None:
        return lambda prompt: F.lit(None).cast("string")

    @F.pandas_udf("string")
    def asked(prompts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else answer(p) for p in prompts], dtype=object)

    return asked


def scripted(replies: dict[str, str], other: str | None = None) -> Callable[[Column], Column]:
    """A fake model for tests: the reply of the first key that the prompt contains."""

    def answer(prompt: Column) -> Column:
        out = F.lit(other).cast("string")
        for key, reply in reversed(replies.items()):
            out = F.when(F.contains(prompt, F.lit(key)), reply).otherwise(out)
        return out

    return answer
