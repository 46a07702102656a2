"""Training examples from templates: variables drawn together, turns rendered, calls of tools that aren't served rewritten to served ones.

A template has what the user says and either turns (reasoning, call, result each) with an answer, or one of each. Rows carry template and
variables side by side; all is expressions within the row, so examples are built where their rows are. Draws are keyed hashes of the example.

Defined results: a null or empty part is left out; a placeholder without a variable stays; a call that can't be parsed keeps its text as its
name and has no arguments; of arguments that repeat the last one counts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.hashing import pick

MESSAGE = "array<struct<role:string,content:string>>"
#: A call, and one of its arguments: name, and value in single, in double or in no quotes.
CALL = r"(?s)^\s*([A-Za-z_]\w*)\((.*)\)\s*$"
ARGUMENT = r"""([A-Za-z_]\w*)\s*=\s*(?:'([^']*)'|"([^"]*)"|([^,)]+))"""
CODE = (r"(?s)^code\s*=\s*'(.*)'\s*$", r'(?s)^code\s*=\s*"(.*)"\s*$')
#: What stands behind a text whose mood is asked for, and what is asked of a memory. Fixed values.
MOOD = "\nlow = text.lower()\npos = sum(w in low for w in ('good','great','happy','love','excited','calm'))\nneg = sum(w in low for w in ('bad','sad','angry','hate','worried','anxious','scared'))\nprint('positive' if pos > neg else 'negative' if neg > pos else 'neutral')"
PROFILE = "retrieve the user's stored profile and preferences"
DEFAULT_TOOL = "python_execute"


def chosen(variables: Column, seed: str, *key: Column) -> Column:
    """One value of each variable (a map of arrays); arrays of one length are drawn at one place, so that values that belong together stay so."""
    return F.transform_values(variables, lambda _, values: F.get(values, pick(F.size(values), seed, *key, F.size(values)).cast("int")))


def rendered(template: Column, values: Column) -> Column:
    """The template with {name} replaced by each value, in the order of the map."""
    return F.aggregate(F.map_entries(values), template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def _there(part: Column) -> Column:
    return F.coalesce(part, F.lit("")) != ""


def _said(think: Column, tool: Column, values: Column) -> Column:
    """Reasoning and call of a turn, in tags; empty if it has neither."""
    thought = F.when(_there(think), F.concat(F.lit("<think>"), rendered(think, values), F.lit("</think>")))
    call = F.when(_there(tool), F.concat(F.lit("<tool>"), rendered(tool, values), F.lit("</tool>")))
    return F.concat_ws("\n", thought, call)


def _message(role: str, content: Column, there: Column) -> Column:
    return F.when(there, F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))).otherwise(F.array().cast(MESSAGE))


def quoted(text: Column) -> Column:
    """The text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def indented(entries: Column) -> Column:
    """An array of (key, values, many) as a JSON object with two blanks a level: a list where many is true, else the one value."""
    listed = lambda e: F.concat(F.lit("[\n    "), F.array_join(F.transform(e["values"], quoted), ",\n    "), F.lit("\n  ]"))
    value = lambda e: F.when(e["many"] & (F.size(e["values"]) == 0), "[]").when(e["many"], listed(e)).otherwise(quoted(F.get(e["values"], F.lit(0))))
    return F.concat(F.lit("{\n  "), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), value(e))), ",\n  "), F.lit("\n}"))


def conversation(rows: DataFrame, values: str = "values") -> DataFrame:
    """rows (system, user, turns of (think, tool, tool_result), think, tool, tool_result, answer, scrutiny of (key, values, many), and the values) with messages and metadata."""
    v = F.col(values)
    text = lambda c: rendered(F.col(c), v)
    many = F.coalesce(F.size("turns"), F.lit(-1)) >= 0
    noted = F.transform("scrutiny", lambda e: F.struct(e["key"].alias("key"), F.transform(e["values"], lambda x: rendered(x, v)).alias("values"), e["many"].alias("many")))
    scrutiny = F.when(F.coalesce(F.size("scrutiny"), F.lit(0)) > 0, F.concat(F.lit("\n<scrutiny>"), indented(noted), F.lit("</scrutiny>"))).otherwise("")
    bare = F.concat(F.lit("<answer>"), text("answer"), F.lit("</answer>"))
    closing = F.concat(bare, scrutiny)

    def turn(t: Column) -> Column:
        said = _said(t["think"], t["tool"], v)
        return F.concat(_message("assistant", said, said != ""), _message("tool", rendered(t["tool_result"], v), _there(t["tool_result"])))

    said, called = _said(F.col("think"), F.col("tool"), v), F.col("tool").isNotNull() & F.col("tool_result").isNotNull()
    long = F.concat(F.flatten(F.transform("turns", turn)), _message("assistant", closing, F.col("answer").isNotNull()))
    # Of one turn without a result the answer stands in the same message.
    with_answer = F.when(F.col("answer").isNotNull(), F.concat(said, F.lit("\n"), bare)).otherwise(said)
    short = F.when(called, F.concat(_message("assistant", said, F.lit(True)), _message("tool", text("tool_result"), F.lit(True)), _message("assistant", F.coalesce(closing, F.lit("")), F.lit(True)))).otherwise(_message("assistant", with_answer, F.lit(True)))
    start = F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")), F.struct(F.lit("user").alias("role"), text("user").alias("content")))
    calls = F.when(many, F.size(F.filter("turns", lambda t: _there(t["tool"])))).otherwise(F.col("tool").isNotNull().cast("int"))
    every = F.concat_ws(" ", F.to_json(F.struct("user", "turns", "think", "tool", "tool_result", "answer", "scrutiny")))
    about = F.struct(
        (calls > 0).alias("has_tools"), calls.alias("num_tool_calls"), (many & (F.size("turns") > 1)).alias("is_multi_turn"), F.contains("user", F.lit("profile")).alias("has_personalization"), (F.contains("user", F.lit("emotion")) | F.contains(every, F.lit("appraisal"))).alias("has_emotion")
    )
    return rows.withColumns({"messages": F.concat(start, F.when(many, long).otherwise(short)), "metadata": about})


def verifiable(rows: DataFrame, values: str = "values") -> DataFrame:
    """rows (question, steps of (step_number, description, reasoning, verification), tool_calls of (tool_name, parameters: map, expected_result, verification), answer, and the values) with all of them rendered, has_tool_calls and num_steps."""
    v = F.col(values)
    at = lambda x, *names: [rendered(x[n], v).alias(n) for n in names]
    steps = F.transform("steps", lambda s: F.struct(s["step_number"].alias("step_number"), *at(s, "description", "reasoning", "verification")))
    calls = F.transform(F.coalesce("tool_calls", F.array().cast(rows.schema["tool_calls"].dataType)), lambda c: F.struct(*at(c, "tool_name"), F.transform_values(c["parameters"], lambda _, p: rendered(p, v)).alias("parameters"), *at(c, "expected_result", "verification")))
    out = rows.withColumns({"question": rendered(F.col("question"), v), "steps": steps, "tool_calls": calls, "answer": rendered(F.col("answer"), v)})
    return out.withColumns({"has_tool_calls": F.size("tool_calls") > 0, "num_steps": F.size("steps")})


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where the value is worked out once, however often it is named: within a lambda Spark works an expression out at each place."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def parsed_call(call: Column) -> Column:
    """name and arguments (an array of key and value, in order) of a call written as name(key='value', ...)."""
    return _once(call, lambda c: F.when(c.rlike(CALL), _once(T.strip(F.regexp_extract(c, CALL, 2)), lambda inner: _read(F.regexp_extract(c, CALL, 1), inner))).otherwise(_unread(c)))


def _unread(call: Column) -> Column:
    return F.struct(F.regexp_replace(T.strip(call), r"[()]+$", "").alias("name"), F.array().cast("array<struct<key:string,value:string>>").alias("arguments"))


def _read(name: Column, inner: Column) -> Column:
    """A call by its name and what stands in its brackets."""
    code = F.when(inner.rlike(CODE[0]), F.regexp_extract(inner, CODE[0], 1)).when(inner.rlike(CODE[1]), F.regexp_extract(inner, CODE[1], 1)).otherwise(inner)
    pair = lambda k, x: F.struct(k.alias("key"), x.alias("value"))

    def arguments(found: Column) -> Column:
        keys, *forms = [found[f"g{g}"] for g in (1, 2, 3, 4)]
        value = lambda i: F.when(F.get(forms[0], i) != "", F.get(forms[0], i)).when(F.get(forms[1], i) != "", F.get(forms[1], i)).otherwise(T.strip(F.get(forms[2], i)))
        last = lambda k: (F.size(keys) - F.array_position(F.reverse(keys), k)).cast("int")
        return F.transform(F.array_distinct(keys), lambda k: pair(k, value(last(k))))

    found = F.struct(*[F.regexp_extract_all(inner, F.lit(ARGUMENT), g).alias(f"g{g}") for g in (1, 2, 3, 4)])
    return F.struct(name.alias("name"), F.when(name == "python_execute", F.array(pair(F.lit("code"), code))).otherwise(_once(found, arguments)).alias("arguments"))


def _python_text(text: Column) -> Column:
    """The text as Python writes a string: in single quotes unless only these are in it."""
    plain = text
    for found, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(found), F.lit(written))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def served_call(call: Column) -> Column:
    """A parsed call, with tools that aren't served put as calls of served ones."""
    return _once(call, _served)


def _served(call: Column) -> Column:
    name, arguments = call["name"], call["arguments"]
    given = lambda k: F.coalesce(F.get(F.transform(F.filter(arguments, lambda a: a["key"] == k), lambda a: a["value"]), F.lit(0)), F.lit(""))
    put = lambda tool, *pairs: F.struct(F.lit(tool).alias("name"), F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]).alias("arguments"))
    kept = F.array_join(F.transform(arguments, lambda a: F.concat(a["key"], F.lit("="), a["value"])), "; ")
    return (
        F.when(name == "get_exchange_rate", put("web_search", ("query", T.strip(F.concat(F.lit("current exchange rate "), given("from"), F.lit(" to "), given("to"))))))
        .when(name == "get_user_profile", put("user_memory_read", ("prompt", F.lit(PROFILE))))
        .when(name == "update_profile", put("user_memory_update", ("section", F.lit("profile")), ("content", kept)))
        .when(name == "analyze_sentiment", put("python_execute", ("code", F.concat(F.lit("text = "), _python_text(given("text")), F.lit(MOOD)))))
        .otherwise(call)
    )


def call_json(call: Column) -> Column:
    """A call as JSON: name and arguments."""
    pairs = F.array_join(F.transform(call["arguments"], lambda a: F.concat(quoted(a["key"]), F.lit(": "), quoted(a["value"]))), ", ")
    return F.concat(F.lit('{"name": '), quoted(call["name"]), F.lit(', "arguments": {'), pairs, F.lit("}}"))


def native(messages: Column) -> Column:
    """Messages with XML calls put as native ones, and results defused and wrapped under the tool that was called last before them."""
    span = r"(?s)<tool>(.*?)</tool>"
    kind = "array<struct<name:string,arguments:array<struct<key:string,value:string>>>>"
    assistant = lambda m: m["role"] == "assistant"
    calls = lambda m: F.transform(F.regexp_extract_all(m["content"], F.lit(span), 1), lambda c: served_call(parsed_call(c)))

    def rewritten(m: Column, own: Column) -> Column:
        put = F.transform(own, lambda c: F.concat(F.lit("<tool_call>\n"), call_json(c), F.lit("\n</tool_call>")))
        return _once(put, lambda put: F.array_join(F.flatten(F.transform(F.split(m["content"], span, -1), lambda b, i: F.array_compact(F.array(b, F.get(put, i))))), ""))

    def one(m: Column, i: Column, called: Column) -> Column:
        name = F.coalesce(F.get(F.reverse(F.flatten(F.slice(called, F.lit(1), i))), F.lit(0))["name"], F.lit(DEFAULT_TOOL))
        content = (
            F.when(assistant(m) & F.contains(m["content"], F.lit("<tool>")), rewritten(m, F.get(called, i)))
            .when(m["role"] == "tool", _once(name, lambda pending: T.sanitised(pending, m["content"])))
            .otherwise(m["content"])
        )
        return F.struct(m["role"].alias("role"), content.alias("content"))

    # Each message's calls are parsed once; a result looks only at the names before it.
    each = F.transform(messages, lambda m: F.when(assistant(m), F.coalesce(calls(m), F.array().cast(kind))).otherwise(F.array().cast(kind)))
    return _once(each, lambda called: F.transform(messages, lambda m, i: one(m, i, called)))
