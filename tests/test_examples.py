"""Example builders and the intercept fold against plain code written apart."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import examples as X
from millrace.operators import intercept as G
from millrace.plans.q_examples import TEMPLATE


def plain_parse(s):
    m = re.match(r"\s*([A-Za-z_]\w*)\((.*)\)\s*$", s, re.DOTALL)
    if not m:
        return s.strip().rstrip("()"), {}
    inner = m[2].strip()
    if m[1] == "python_execute":
        code = re.match(r"code\s*=\s*'(.*)'\s*$", inner, re.DOTALL) or re.match(r'code\s*=\s*"(.*)"\s*$', inner, re.DOTALL)
        return m[1], {"code": code[1] if code else inner}
    out = {}
    for k in re.finditer(r"([A-Za-z_]\w*)\s*=\s*(?:'([^']*)'|\"([^\"]*)\"|([^,)]+))", inner):
        out[k[1]] = next((v for v in (k[2], k[3]) if v is not None), (k[4] or "").strip())
    return m[1], out


@pytest.mark.parametrize("call", ["f(a='x', b=\"y, z\", c= 3 , a='last')", "f()", " f ( )", "python_execute(code='print(\"a\", 1)\nx')", 'python_execute(code="it\'s")', "python_execute(1 + 1)", "none", "f(x", "g(a='', b=\"\", c=)", "g(q='é\t\\n')", "f(a=b=c)", "x)()"])
def test_calls(spark, call):
    r = spark.createDataFrame([(call,)], "c string").select(X.parsed_call(F.col("c")).alias("p")).select("p", X.call_json(F.col("p")).alias("j")).first()
    name, arguments = plain_parse(call)
    assert (r.p.name, [tuple(a) for a in r.p.arguments]) == (name, list(arguments.items()))
    assert r.j == json.dumps({"name": name, "arguments": arguments}, ensure_ascii=False)


@pytest.mark.parametrize("text", ["plain", "it's", 'say "x"', "it's \"x\"", "a\nb\tc\\d", ""])
def test_remapped_code_runs_on_the_very_text(spark, text):
    name, arguments = spark.createDataFrame([(text,)], "t string").select(X.served_call(F.struct(F.lit("analyze_sentiment").alias("name"), F.array(F.struct(F.lit("text").alias("key"), F.col("t").alias("value"))).alias("arguments"))).alias("c")).first().c
    code = dict(arguments)["code"]
    assert name == "python_execute" and code.startswith(f"text = {text!r}\nlow")


def test_drawn_values_of_one_length_belong_together(spark):
    rows = spark.range(200).select("id", X.chosen(F.create_map(F.lit("a"), F.array(*map(F.lit, "xyz")), F.lit("b"), F.array(*map(F.lit, "XYZ")), F.lit("c"), F.array(*map(F.lit, "pq"))), "s", F.col("id")).alias("v")).collect()
    assert all(r.v["a"].upper() == r.v["b"] for r in rows) and {r.v["a"] for r in rows} == set("xyz") and {r.v["c"] for r in rows} == set("pq")


def messages(spark, *template):
    df = spark.createDataFrame([template], TEMPLATE).withColumns({"system": F.lit("S"), "values": F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit('"q"\né'))})
    r = X.conversation(df).select("messages", "metadata", X.native(F.col("messages")).alias("native")).first()
    return [tuple(m) for m in r.messages[2:]], r.metadata, [tuple(m) for m in r.native[2:]]


def test_forms_of_templates(spark):
    turns = [("t{a}", None, None), (None, "", "r{a}"), ("", None, None), ("x", "f(k='{a}')", None)]
    got, about, native = messages(spark, 0, "u", turns, None, None, None, "A{b}", [("k", ["{b}", "{a}"], True), ("e", [], True), ("o", ["{zz}"], False)])
    note = json.dumps({"k": ['"q"\né', "1"], "e": [], "o": "{zz}"}, indent=2, ensure_ascii=False)
    assert got == [("assistant", "<think>t1</think>"), ("tool", "r1"), ("assistant", "<think>x</think>\n<tool>f(k='1')</tool>"), ("assistant", f'<answer>A"q"\né</answer>\n<scrutiny>{note}</scrutiny>')]
    assert (about.num_tool_calls, about.has_tools, about.is_multi_turn) == (1, True, True)
    assert native[1] == ("tool", "[TOOL_RESULT: python_execute]\nr1\n[/TOOL_RESULT]") and native[2][1].endswith('<tool_call>\n{"name": "f", "arguments": {"k": "1"}}\n</tool_call>')
    got, about, _ = messages(spark, 0, "profile of emotion", [], "unused", None, None, None, None)
    assert got == [] and (about.num_tool_calls, about.is_multi_turn, about.has_personalization, about.has_emotion) == (0, False, True, True)
    got, about, _ = messages(spark, 0, "u", None, "t", "f()", None, "A", None)
    assert got == [("assistant", "<think>t</think>\n<tool>f()</tool>\n<answer>A</answer>")] and about.num_tool_calls == 1 and not about.has_emotion
    assert messages(spark, 0, "u", None, None, "f()", "appraisal", "A", None)[0] == [("assistant", "<tool>f()</tool>"), ("tool", "appraisal"), ("assistant", "<answer>A</answer>")]


def test_several_calls_in_one_message_and_the_tool_a_result_belongs_to(spark):
    rows = [("assistant", "<tool>get_user_profile()</tool> and <tool>web_search(query='a')</tool>."), ("tool", "found"), ("user", "<tool>no()</tool>"), ("tool", "x" * 2000)]
    got = spark.createDataFrame([(rows,)], "m array<struct<role:string,content:string>>").select(X.native(F.col("m")).alias("n")).first().n
    assert got[0].content.count("<tool_call>") == 2 and got[0].content.endswith("</tool_call>.") and " and " in got[0].content
    assert got[1].content == "[TOOL_RESULT: web_search]\nfound\n[/TOOL_RESULT]" and got[2].content == "<tool>no()</tool>" and len(got[3].content) < 1300


def test_calls_are_parsed_at_one_place(spark):
    """Before, each place that named a call had a parser of its own (a result's, one for every budget), and each result parsed all calls before it again."""
    rows = [("assistant", f"<tool>f(k='{i}')</tool>") if i % 2 == 0 else ("tool", f"r{i}") for i in range(200)]
    df = spark.createDataFrame([(rows,)], "m array<struct<role:string,content:string>>").select(X.native(F.col("m")).alias("n"))
    assert df._jdf.queryExecution().analyzed().toString().count(X.ARGUMENT) == 4
    got = df.first().n
    assert [m.content for m in got[:2]] == ['<tool_call>\n{"name": "f", "arguments": {"k": "0"}}\n</tool_call>', "[TOOL_RESULT: f]\nr1\n[/TOOL_RESULT]"] and got[199].content == "[TOOL_RESULT: f]\nr199\n[/TOOL_RESULT]"


def plain_intercept(replies, results, active, fails, rounds):
    out, counts, searches = [], {}, 0
    for n, r in enumerate(replies[:rounds]):
        r = r or ""
        at, bare = r.rfind("<tool>"), r.rstrip()
        cut = bare.endswith("</tool")
        if at == -1 or ("</tool>" in r[at:] and not cut):
            return [*out, ("assistant", r)]
        body = re.sub(r"\s*</tool\s*$", "", r[at + 6 :]).strip()
        name = m[1] if (m := re.match(r"(\w+)", body)) else "unknown"
        cap = {"web_search": 3, "read_url": 3}.get(name, 5)
        if counts.get(name, 0) >= cap:
            got = f"Error: {name} call limit ({cap}) reached. Synthesise what you have and write <answer>."
        else:
            counts[name] = counts.get(name, 0) + 1
            got = (results[n] if n < len(results) else None) or ""
            for tool in ("python_execute", "web_search", "read_url", "scratchpad_read"):
                if body.startswith(tool) and tool not in active:
                    got = f"Error: {tool} is not available in this session."
                elif body.startswith(tool) and tool == "web_search":
                    searches += 1
                    got = G.UNAVAILABLE if fails and searches == 1 else got
        out += [("assistant", bare + ">" if cut else r + "</tool>"), ("user", f"[TOOL_RESULT: {name}]\n{got}\n[/TOOL_RESULT]\n{G.LAST if n >= rounds - 2 else G.MORE}")]
    return out


def test_intercepted_equals_a_loop(spark):
    rng = random.Random(12)
    calls = ["web_search(query='x')", "web_search(q)", "read_url(url='u')", "python_execute(code='1')", "scratchpad_read()", "get_datetime()", "", "?x", "web_searcher(1)"]
    reply = lambda: rng.choice(["<think>a</think>", "", "<tool>done()</tool> "]) + "<tool>" + rng.choice(calls[:2] * 3 + calls) + rng.choice(["", "</tool", " </tool \n", "\n"])
    rows = []
    for i in range(150):
        replies = [reply() if rng.random() < 0.93 else rng.choice(["<answer>x</answer>", "<tool>a()</tool>", None, ""]) for _ in range(rng.randrange(0, 11))]
        rows.append((i, replies, [rng.choice(["r1", "r2", None]) for _ in range(rng.randrange(0, 12))], rng.sample(["web_search", "read_url", "python_execute", "scratchpad_read"], 3), rng.random() < 0.5))
    df = spark.createDataFrame(rows, "id int, replies array<string>, results array<string>, active array<string>, fails boolean")
    for rounds in (5, 9):
        got = df.select("id", G.intercepted(F.col("replies"), F.col("results"), F.col("active"), F.col("fails"), rounds).alias("m")).collect()
        for r in got:
            assert [tuple(m) for m in r.m] == plain_intercept(*rows[r.id][1:], rounds), rows[r.id]
