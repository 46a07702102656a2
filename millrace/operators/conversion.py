"""Conversion of trajectories whose calls are XML text: arguments by tool, a turn for each call, and native calls.

A trajectory is one row: its key and messages, an array of (pos, role, content). All expressions are native; what a call's code
printed is an input column, as code isn't run here.

Defined results: null content is empty; a trajectory without calls passes unchanged; a call of an unknown tool or without an argument that
its tool needs is no call, and drops a trajectory from native conversion; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.curation import MOST_CALLS

#: How code is written in a call, in the order tried. Fixed values.
CODE = (r'(?s)python_execute\s*\(\s*code\s*=\s*"""(.*?)"""\s*\)', r"(?s)python_execute\s*\(\s*code\s*=\s*'(.*?)'\s*\)", r'(?s)python_execute\s*\(\s*code\s*=\s*"(.*?)"\s*\)')
QUERY = r"""(?s)web_search\s*\(\s*query\s*=\s*['"](.+?)['"]"""
URL = r"""(?s)read_url\s*\(\s*url\s*=\s*['"](.+?)['"]"""
SECTION = r"""section\s*=\s*['"](\w+)['"]"""
CONTENT = r"""(?s)content\s*=\s*["'](.+?)["']"""
ASKED = r"""(?s)prompt\s*=\s*['"](.+?)['"]"""
#: Arguments by tool: name, patterns, and whether the call needs it. Fixed values.
ARGUMENTS = {
    "python_execute": (("code", CODE, True),),
    "web_search": (("query", (QUERY,), True),),
    "read_url": (("url", (URL,), True), ("prompt", (ASKED,), False)),
    "get_datetime": (),
    "scratchpad_sections": (),
    "scratchpad_read": (),
    "scratchpad_update": (("section", (SECTION,), True), ("content", (CONTENT,), True)),
    "user_memory_sections": (),
    "user_memory_read": (("prompt", (ASKED,), False),),
    "user_memory_update": (("section", (SECTION,), True), ("content", (CONTENT,), True)),
}
#: Most characters of a result that is written into a trajectory, and what stands for results that are no longer there. Fixed values.
MOST_RESULT = 3000
SPLIT_FORMAT = "v3_multi_turn"
SEARCHED = "(Original training example — live result not available for replay. Model answer reflects the retrieved content.)"
READ = "(Original training example — live content not available for replay.)"
NOT_PARSED = "Error: could not parse code"
NO_RESULT = "(Tool result not available — synthetic placeholder)"
SPAN = r"(?s)<tool>(.*?)</tool>"
THOUGHT = r"(?is)^.*?</think\s*>"


def _argument(call: Column, patterns: tuple[str, ...]) -> Column:
    """What the first pattern that matches has; null if none does."""
    return F.coalesce(*[F.when(call.rlike(p), F.regexp_extract(call, p, 1)) for p in patterns])


def code_of(call: Column) -> Column:
    """The code of a python_execute call, its escaped line breaks, tabs and quotes made real; null if it has none."""
    code = _argument(call, CODE)
    for escaped, real in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"')):
        code = F.replace(code, F.lit(escaped), F.lit(real))
    return code


def xml_arguments(call: Column) -> Column:
    """name and arguments (JSON text) of an XML call's body; null if the tool is unknown or an argument that it needs is missing."""
    call = T.strip(call)
    name = T.strip(F.substring_index(call, "(", 1))
    out = F.lit(None).cast("struct<name:string,arguments:string>")
    for tool, arguments in ARGUMENTS.items():
        values = {n: code_of(call) if n == "code" else _argument(call, p) for n, p, _ in arguments}
        needed = [values[n] for n, _, must in arguments if must]
        whole = F.lit(True)
        for v in needed:
            whole = whole & v.isNotNull()
        given = F.to_json(F.struct(*[v.alias(n) for n, v in values.items()])) if values else F.lit("{}")
        out = F.when((name == tool) & whole, F.struct(F.lit(tool).alias("name"), given.alias("arguments"))).otherwise(out)
    return out


def replayed(call: Column, printed: Column, now: Column) -> Column:
    """tool and result of an XML call that isn't run again: printed is what its code printed, now the time that it is told."""
    call = T.strip(call)
    said = lambda pattern, other: F.coalesce(F.when(call.rlike(pattern), F.regexp_extract(call, pattern, 1)), F.lit(other))
    pair = lambda tool, result: F.struct(tool.alias("tool"), result.alias("result"))
    other = F.when(F.contains(call, F.lit("(")), T.strip(F.substring_index(call, "(", 1))).otherwise(F.left(call, F.lit(40)))
    return (
        F.when(F.startswith(call, F.lit("python_execute")), pair(F.lit("python_execute"), F.when(F.coalesce(code_of(call), F.lit("")) != "", F.coalesce(printed, F.lit(""))).otherwise(NOT_PARSED)))
        .when(F.startswith(call, F.lit("web_search")), pair(F.lit("web_search"), F.concat(F.lit("[Search results for: "), said(QUERY, "(query not parsed)"), F.lit(f"]\n{SEARCHED}"))))
        .when(F.startswith(call, F.lit("read_url")), pair(F.lit("read_url"), F.concat(F.lit("[Page content from: "), said(URL, "(URL not parsed)"), F.lit(f"]\n{READ}"))))
        .when(F.startswith(call, F.lit("get_datetime")), pair(F.lit("get_datetime"), now))
        .otherwise(pair(other, F.lit(NO_RESULT)))
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _behind_calls(post: Column) -> Column:
    """What follows the last call."""
    return F.element_at(F.split(post, SPAN, -1), -1)


def _after_thought(content: Column) -> Column:
    return F.regexp_replace(content, THOUGHT, "")


def split_turns(content: Column, printed: Column, now: Column) -> Column:
    """An assistant message as messages: a turn for each call outside of reasoning with its result after it, and the answer behind the last; null without calls."""
    post = _after_thought(content)
    thought = F.left(content, F.length(content) - F.length(post))
    spans = F.regexp_extract_all(post, F.lit(SPAN), 0)
    before = F.regexp_replace(F.concat(thought, F.substring_index(post, "<tool>", 1)), r"\s+$", "")

    def turns(span: Column, k: Column) -> Column:
        seen = replayed(F.regexp_extract(span, SPAN, 1), printed, now)
        body = F.when(F.length(seen["result"]) > MOST_RESULT, F.concat(F.left(seen["result"], F.lit(MOST_RESULT)), F.lit(T.CUT))).otherwise(seen["result"])
        said = F.when((k == 0) & (before != ""), T.strip(F.concat(before, F.lit("\n"), span))).otherwise(span)
        return F.array(_message("assistant", said), _message("tool", F.concat(F.lit("[TOOL_RESULT: "), seen["tool"], F.lit("]\n"), body, F.lit("\n[/TOOL_RESULT]"))))

    answer = F.regexp_extract(_behind_calls(post), "(?is)<answer>.*?</answer>", 0)
    last = F.when(answer != "", F.array(_message("assistant", answer))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return F.when(F.size(spans) > 0, F.concat(F.flatten(F.transform(spans, turns)), last))


def split(rows: DataFrame, printed: Column, now: Column, most: int = MOST_CALLS) -> DataFrame:
    """rows with messages of (role, content), status (transformed, unchanged, dropped_no_answer or dropped_too_many) and tool_format of those that were transformed."""
    plain = lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))
    parts = F.transform("messages", lambda m: F.coalesce(F.when(m["role"] == "assistant", split_turns(F.coalesce(m["content"], F.lit("")), printed, now)), F.array(plain(m))))
    done = F.exists("messages", lambda m: m["role"] == "tool")
    whole = F.transform("messages", lambda m: F.array(plain(m)))
    out = rows.withColumns({"messages": F.when(done, whole).otherwise(parts), "done": done})
    out = out.withColumns({"messages": F.flatten("messages"), "split": ~F.col("done") & F.exists("messages", lambda p: F.size(p) > 1)}).drop("done")
    results = F.size(F.filter("messages", lambda m: m["role"] == "tool"))
    status = F.when(~F.col("split"), "unchanged").when(F.element_at("messages", -1)["role"] == "tool", "dropped_no_answer").when(results > most, "dropped_too_many").otherwise("transformed")
    return out.withColumn("status", status).withColumn("tool_format", F.when(F.col("status") == "transformed", SPLIT_FORMAT)).drop("split")


NATIVE = "struct<role:string,content:string,name:string,arguments:string,call_id:string>"


def native(rows: DataFrame, key: str, printed: Column, now: Column) -> DataFrame:
    """rows with messages of (role, content, name, arguments, call_id) and route: no_tool, already_native, converted, or dropped if a call can't be read or both forms are mixed.

    A call's id follows from the trajectory, the message and the call's place in it. The results after a message go to its calls in order; a
    call without one gets what a replay would say.
    """
    entry = lambda role, content, name=None, arguments=None, call=None: F.struct(role.alias("role"), content.alias("content"), (F.lit(None) if name is None else name).cast("string").alias("name"), (F.lit(None) if arguments is None else arguments).cast("string").alias("arguments"), (F.lit(None) if call is None else call).cast("string").alias("call_id"))
    text = lambda m: F.coalesce(m["content"], F.lit(""))
    plain = lambda m: entry(m["role"], text(m))
    none = F.array().cast(f"array<{NATIVE}>")

    def converted(m: Column, i: Column) -> Column:
        content = text(m)
        post = _after_thought(content)
        calls = F.regexp_extract_all(post, F.lit(SPAN), 1)
        rest = F.slice("messages", i + 2, F.greatest(F.size("messages") - i - 1, F.lit(0)))
        until = F.array_position(F.transform(rest, lambda x: x["role"] == "tool"), False)
        results = F.transform(F.when(until == 0, rest).otherwise(F.slice(rest, 1, F.greatest(until - 1, F.lit(0)).cast("int"))), lambda x: T.unwrap_result(text(x)))
        thought = F.regexp_replace(F.left(content, F.length(content) - F.length(post)), r"\s+$", "")

        def pair(call: Column, k: Column) -> Column:
            fields = xml_arguments(call)
            own = F.concat(F.lit("call_"), F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), i.cast("string"), k.cast("string"))), 1, 8))
            said = entry(F.lit("assistant"), F.when(k == 0, thought).otherwise(""), fields["name"], fields["arguments"], own)
            return F.array(said, entry(F.lit("tool"), F.coalesce(F.get(results, k), replayed(call, printed, now)["result"]), call=own))

        answer = F.regexp_extract(_behind_calls(post), "(?is)<answer>.*?</answer>", 0)
        last = F.when(answer != "", F.array(entry(F.lit("assistant"), answer))).otherwise(none)
        return F.when(m["role"] == "tool", none).when((m["role"] == "assistant") & (F.size(calls) > 0), F.concat(F.flatten(F.transform(calls, pair)), last)).otherwise(F.array(plain(m)))

    said = F.filter("messages", lambda m: m["role"] == "assistant")
    has_native = F.exists(said, lambda m: F.contains(text(m), F.lit("<tool_call>")))
    stray = F.exists(said, lambda m: F.contains(text(m), F.lit("<tool>")) | F.contains(text(m), F.lit("</tool>")))
    calls = F.flatten(F.transform(said, lambda m: F.regexp_extract_all(_after_thought(text(m)), F.lit(SPAN), 1)))
    unread = (F.size(calls) == 0) | F.exists(calls, lambda c: xml_arguments(c).isNull())
    route = F.when(~F.exists("messages", lambda m: m["role"] == "tool"), "no_tool").when(has_native, F.when(stray, "dropped").otherwise("already_native")).when(unread, "dropped").otherwise("converted")
    out = rows.withColumn("route", route)
    return out.withColumn("messages", F.when(F.col("route") == "converted", F.flatten(F.transform("messages", converted))).otherwise(F.transform("messages", plain)))
