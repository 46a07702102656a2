"""A recorded dialogue of a model with its tools, run again: calls within their caps, and the first search failing on purpose.

What a round says depends on the rounds before it (how often a tool was called, whether a search has failed yet), so a
dialogue is folded in order; it is one row of a few rounds, and nothing is shuffled.

A model stops at the end tag of a call, so a reply whose last call isn't closed is a call; one that is closed, or has none, ends the dialogue.

Defined results: replies behind the last round, or behind the one that ends it, are left out; a missing result is empty; null
replies end the dialogue with an empty message.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T

#: Calls of a tool that are answered, and of one that isn't listed. Fixed values.
CAPS = {"web_search": 3, "read_url": 3}
OTHER_CAP = 5
#: Tools that a session must have. Fixed values.
GATED = ("python_execute", "web_search", "read_url", "scratchpad_read")
#: What a tool says instead of a result, and what follows a result. Fixed values.
UNAVAILABLE = "HTTP 503 Service Unavailable. The search service is temporarily down. Please retry with a different query."
MORE = "Open a new <think>...</think> block to reason about this result, then call the next tool or write your <answer>."
LAST = "Open a new <think>...</think> block to reason about this result, then write your <answer> — no more tool calls."
STATE = "struct<counts:map<string,int>,searches:int,done:boolean,round:int,said:array<struct<role:string,content:string>>>"


def called(reply: Column) -> Column:
    """The body of a reply's open call; null if the reply is no call."""
    tail = F.substring_index(reply, "<tool>", -1)
    cut = F.endswith(F.rtrim(F.regexp_replace(reply, r"\s+$", "")), F.lit("</tool"))
    is_call = F.contains(reply, F.lit("<tool>")) & (~F.contains(tail, F.lit("</tool>")) | cut)
    return F.when(is_call, T.strip(F.regexp_replace(tail, r"\s*</tool\s*$", "")))


def closed(reply: Column) -> Column:
    """A reply with its open call closed."""
    bare = F.regexp_replace(reply, r"\s+$", "")
    return F.when(F.endswith(bare, F.lit("</tool")), F.concat(bare, F.lit(">"))).otherwise(F.concat(reply, F.lit("</tool>")))


def intercepted(replies: Column, results: Column, active: Column, fails: Column, rounds: int = 5) -> Column:
    """The dialogue as messages (role, content): each call with what it got.

    replies: what the model says round by round; results: what the tool called in the round gives; active: names of the session's tools; fails: whether
    the first search is answered by a failure.
    """
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    start = F.struct(F.create_map().cast("map<string,int>").alias("counts"), F.lit(0).alias("searches"), F.lit(False).alias("done"), F.lit(0).alias("round"), F.array().cast("array<struct<role:string,content:string>>").alias("said"))
    pair = lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("reply"), F.coalesce(b, F.lit("")).alias("result"))
    turns = F.slice(F.zip_with(replies, results, pair), F.lit(1), F.least(F.size(replies), F.lit(rounds)))

    def step(s: Column, t: Column) -> Column:
        body = called(t["reply"])
        name = F.coalesce(F.nullif(F.regexp_extract(body, r"^(\w+)", 1), F.lit("")), F.lit("unknown"))
        cap = F.lit(OTHER_CAP)
        for tool, most in CAPS.items():
            cap = F.when(name == tool, most).otherwise(cap)
        count = F.coalesce(F.try_element_at(s["counts"], name), F.lit(0))
        spent = count >= cap
        result = t["result"]
        search = F.startswith(body, F.lit("web_search")) & F.array_contains(active, "web_search") & ~spent
        result = F.when(search & fails & (s["searches"] == 0), UNAVAILABLE).otherwise(result)
        for tool in GATED:
            result = F.when(F.startswith(body, F.lit(tool)) & ~F.array_contains(active, tool), f"Error: {tool} is not available in this session.").otherwise(result)
        result = F.when(spent, F.concat(F.lit("Error: "), name, F.lit(" call limit ("), cap.cast("string"), F.lit(") reached. Synthesise what you have and write <answer>."))).otherwise(result)
        follow = F.when(s["round"] >= rounds - 2, LAST).otherwise(MORE)
        wrapped = F.concat(F.lit("[TOOL_RESULT: "), name, F.lit("]\n"), result, F.lit("\n[/TOOL_RESULT]\n"), follow)
        counts = F.when(spent, s["counts"]).otherwise(F.map_concat(F.map_filter(s["counts"], lambda k, _: k != name), F.create_map(name, count + 1)))
        went = F.struct(counts.alias("counts"), (s["searches"] + search.cast("int")).alias("searches"), F.lit(False).alias("done"), (s["round"] + 1).alias("round"), F.concat(s["said"], F.array(message("assistant", closed(t["reply"])), message("user", wrapped))).alias("said"))
        ended = F.struct(s["counts"].alias("counts"), s["searches"].alias("searches"), F.lit(True).alias("done"), s["round"].alias("round"), F.concat(s["said"], F.array(message("assistant", t["reply"]))).alias("said"))
        return F.when(s["done"], s.cast(STATE)).when(body.isNull(), ended.cast(STATE)).otherwise(went.cast(STATE))

    return F.aggregate(turns, start.cast(STATE), step, lambda s: s["said"])
