"""Rows that are built from a teacher's replies, or refused: solutions by code that ran, refusals, and clarifications with what follows them.

Every operator gives all its rows with a status; rows that are accepted have messages (role, content), the others a null. What code
printed, what the user would answer and what the teacher says next are input columns. Null replies are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

#: Least reasoning of an accepted reply, and kinds of request whose refusals must not hold code. Fixed values.
LEAST_THOUGHT = 150
NO_CODE = ("malware", "evasion", "unauthorized_access", "credential_theft")
BOUNDARIES = ("ask", "act", "answer")
#: Reasoning where a solution gives none. Fixed value.
STEPS = "Let me solve this step-by-step."
CALL = r'(?s)<tool>\s*python_execute\s*\(\s*code\s*=\s*"""(.*?)"""\s*\)\s*</tool>'
QUOTED_CALL = r"""(?s)<tool>\s*python_execute\s*\(\s*code\s*=\s*["']+(.*?)["']+\s*\)\s*</tool>"""
FENCED = r"(?s)```(?:python)?\n(.*?)```"
MESSAGE = "array<struct<role:string,content:string>>"


def _messages(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in pairs])


def solution_blocks(reply: Column) -> Column:
    """Code of a solution: of calls in triple quotes, else in others, else in fences."""
    found = [F.transform(F.regexp_extract_all(reply, F.lit(p), 1), T.strip) for p in (CALL, QUOTED_CALL, FENCED)]
    return F.when(F.size(found[0]) > 0, found[0]).when(F.size(found[1]) > 0, found[1]).otherwise(found[2])


def printed_number(output: Column) -> Column:
    """The first number in the last line that has one; null if none has."""
    found = F.transform(F.split(T.strip(output), "\n", -1), lambda line: F.regexp_extract(line, r"[-+]?\d*\.?\d+", 0))
    return F.try_element_at(F.filter(found, lambda n: n != ""), F.lit(-1))


def solution_thought(reply: Column, code: Column) -> Column:
    """The reasoning of a solution: its think block, else what stands before the call, else the code's comments."""
    before = F.when(F.contains(reply, F.lit("<tool>")), T.strip(F.substring_index(reply, "<tool>", 1))).otherwise("")
    bare = lambda line: T.strip(F.regexp_replace(line, "^[# ]+", ""))
    lines = F.filter(F.split(code, "\n", -1), lambda line: F.startswith(T.strip(line), F.lit("#")) & (T.strip(line) != "#"))
    told = F.array_join(F.transform(F.slice(lines, 1, 10), lambda line: F.concat(F.lit("- "), bare(line))), "\n")
    narrated = F.when(told != "", F.concat(F.lit(STEPS + "\n\n"), told)).otherwise(STEPS)
    return F.when(reply.rlike("(?s)<think>.*?</think>"), T.strip(F.regexp_extract(reply, "(?s)<think>(.*?)</think>", 1))).when(before != "", before).otherwise(narrated)


def solutions(rows: DataFrame, system: str) -> DataFrame:
    """rows (question, expected, reply, printed: what the code printed, null if it failed) with status (no_code, failed, no_number, wrong, accepted), computed and messages."""
    reply = F.coalesce("reply", F.lit(""))
    code = F.get(solution_blocks(reply), F.lit(0))
    computed = printed_number(F.col("printed"))
    right = F.coalesce(T.numbers_match(computed, F.col("expected")), F.lit(False))
    status = F.when(code.isNull(), "no_code").when(F.col("printed").isNull(), "failed").when(computed.isNull(), "no_number").when(right, "accepted").otherwise("wrong")
    said = F.concat(F.lit("<think>\n"), solution_thought(reply, code), F.lit('\n</think>\n<tool>python_execute(code="""'), code, F.lit('""")</tool>'))
    result = F.concat(F.lit("[TOOL_RESULT: python_execute]\n"), T.strip(F.col("printed")), F.lit("\n[/TOOL_RESULT]"))
    built = _messages(("system", F.lit(system)), ("user", F.col("question")), ("assistant", said), ("tool", result), ("assistant", F.concat(F.lit("<answer>"), computed, F.lit("</answer>"))))
    out = rows.withColumns({"status": status, "computed": computed})
    return out.withColumn("messages", F.when(F.col("status") == "accepted", built))


def _cleaned(reply: Column) -> tuple[Column, Column, Column]:
    """A reply with its reasoning in tags and one action, the action's kind, and whether it is there with reasoning enough."""
    wrapped = T.wrap_think(F.coalesce(reply, F.lit("")), BOUNDARIES)
    body, kind = T.clean_turn(wrapped), T.clean_turn_kind(wrapped)
    return body, kind, F.coalesce(kind.isNotNull() & (T.think_length(body) >= LEAST_THOUGHT), F.lit(False))


def refusals(rows: DataFrame, system: str) -> DataFrame:
    """rows (category, question, reply) with status (ok, unclean, compliant) and messages: a refusal reasons, answers, and holds no code where that would be compliance."""
    body, kind, fine = _cleaned(F.col("reply"))
    rows = rows.withColumns({"__body": body, "__fine": fine & (kind == "answer")})
    code = F.coalesce(F.col("category").isin(*NO_CODE), F.lit(False)) & F.contains("__body", F.lit("```"))
    status = F.when(~F.col("__fine"), "unclean").when(code, "compliant").otherwise("ok")
    out = rows.withColumn("status", status)
    built = _messages(("system", F.lit(system)), ("user", F.col("question")), ("assistant", F.col("__body")))
    return out.withColumn("messages", F.when(F.col("status") == "ok", built)).drop("__body", "__fine")


def clarifications(rows: DataFrame, system: str) -> DataFrame:
    """rows (question, first: the teacher's reply, human: what the user answers, second: the reply to that) with branch and messages.

    branch is B where one question is asked and the answer to it resolved, B_negative where the first reply acts or answers at once, else the reason of refusal:
    unclean, bad_question, no_answer or unresolved.
    """
    body, kind, fine = _cleaned(F.col("first"))
    body2, kind2, fine2 = _cleaned(F.col("second"))
    rows = rows.withColumns({"__one": body, "__kind": kind, "__fine": fine, "__two": body2, "__resolved": fine2 & kind2.isin("act", "answer")})
    asked = T.strip(T.tag_body(F.col("__one"), "ask"))
    human = T.strip(F.coalesce("human", F.lit("")))
    branch = (
        F.when(~F.col("__fine"), "unclean").when(F.col("__kind") != "ask", "B_negative").when((asked == "") | (F.regexp_count(asked, F.lit(r"\?")) != 1), "bad_question").when(human == "", "no_answer").when(~F.coalesce("__resolved", F.lit(False)), "unresolved").otherwise("B")
    )
    out = rows.withColumn("branch", branch)
    start = (("system", F.lit(system)), ("user", F.col("question")), ("assistant", F.col("__one")))
    built = F.when(F.col("branch") == "B_negative", _messages(*start)).when(F.col("branch") == "B", _messages(*start, ("user", human), ("assistant", F.col("__two"))))
    return out.withColumn("messages", built.cast(MESSAGE)).drop("__one", "__kind", "__fine", "__two", "__resolved")
