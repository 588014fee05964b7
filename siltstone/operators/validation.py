"""Filters with a reason for each row that they reject."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.text import strip

#: Clusters that are kept: fixed values.
ACCEPTED_CLUSTERS = tuple(c for c in range(1, 21) if c != 11)
VOCABULARY = 50_257

#: What the scope filter rejects, in order: fixed values.
SCOPE_PATTERNS = {
    "code": (
        r"```(?:python|javascript|typescript|java|c\+\+|rust|go|bash|sql)?",
        r"\b(?:write|implement|debug|refactor)\b.{0,40}\b(?:code|function|class|script|program)\b",
        r"\b(?:python|javascript|typescript|java|c\+\+|rust|golang)\b.{0,30}\b(?:code|function|class|program)\b",
    ),
    "tool_call": (r"<tool_call>|</tool_call>|<function_call>|</function_call>", r'"(?:tool_calls|function_call)"\s*:'),
    "long_reasoning_request": (
        r"\b(?:show|write|provide|reveal)\b.{0,30}\b(?:chain of thought|complete reasoning trace|internal reasoning)\b",
        r"\blet'?s think step by step\b",
    ),
    "advanced_math": (
        r"\b(?:olympiad|imo|putnam|abstract algebra|measure theory|functional analysis)\b",
        r"\\begin\{(?:align|equation|proof)\}|\\int_|\\sum_",
    ),
    "roleplay": (r"\b(?:pretend|act|role-?play)\s+(?:that\s+)?you are\b", r"\byou are now (?:a|an|the)\b"),
}
#: What tells a mathematics or a programming problem: fixed values.
MATH_TOPIC = (
    r"\b(?:algebra|algebraic|calculus|derivative|differentiate|integral|integrate|trigonometry|trigonometric|geometry|pythagorean|quadratic|"
    r"polynomial|factorial|combinatorics|combinatorial|matrix|matrices|determinant|eigenvalue|logarithm|logarithmic|arithmetic|number theory|"
    r"group theory|homomorphism|theorem|proof|probability distribution|standard deviation|variance|equation|inequality|fractions?)\b"
)
MATH_ACTION = r"\b(?:calculate|compute|solve|evaluate|simplify|derive|differentiate|integrate|find)\b"
MATH_NOTATION = r"(?:\d\s*[%+*/^=]|[%+*/^=]\s*\d|\$\s*\d|\\(?:frac|sqrt|boxed|sum|int|pi|theta)|\b(?:sin|cos|tan)\s*\()"
CODE_LANGUAGE = (
    r"\b(?:python|javascript|typescript|java\b|c\+\+|c#|golang|rust\b|sql\b|html\b|css\b|react\b|node\.js|pandas|numpy|tensorflow|pytorch|matlab|"
    r"maple|powershell|bash\b|shell script|regex)\b"
)
CODE_TASK = (
    r"(?:\b(?:write|create|implement|debug|fix|convert|generate|provide)\b.{0,80}\b(?:code|script|function|algorithm|query|computer program)\b|"
    r"\b(?:code|script|function|algorithm|query|computer program)\b.{0,80}\b(?:write|create|implement|debug|fix|convert|generate|provide)\b)"
)
CODE_LITERAL = (
    r"```|\bdef\s+\w+\s*\(|\bclass\s+\w+\s*[:({]|\bfrom\s+\w+(?:\.\w+)*\s+import\s+\w+|\b(?:const|let|var)\s+\w+\s*=|\bSELECT\s+.+\s+FROM\b|"
    r"\bfunction\s+\w*\s*\("
)
#: Marks that no text may hold: fixed values.
RESERVED = ("<think>", "</think>", "<answer>")


def _has(text: Column, pattern: str, across_lines: bool = True) -> Column:
    return F.rlike(text, F.lit(("(?is)" if across_lines else "(?i)") + pattern))


def scope_reason(source: Column, text: Column, allowed: list[str], most_characters: int = 40_000, roleplay: bool = True) -> Column:
    """The first reason against a conversation, or 'accepted'."""
    reason = F.when(~source.isin(allowed) | source.isNull(), "source_not_allowed").when(F.length(text) > most_characters, "too_many_characters")
    for name, patterns in SCOPE_PATTERNS.items():
        if name != "roleplay" or roleplay:
            found = F.lit(False)
            for p in patterns:
                found |= _has(text, p)
            reason = reason.when(found, name)
    return reason.otherwise("accepted")


def exclusion_reason(problem: Column) -> Column:
    """math_primary, code_primary, math_and_code_primary or null."""
    math = _has(problem, MATH_TOPIC) | (_has(problem, MATH_ACTION) & _has(problem, MATH_NOTATION))
    code = _has(problem, CODE_LANGUAGE) | _has(problem, CODE_TASK) | _has(problem, CODE_LITERAL, across_lines=False)
    return F.when(math & code, "math_and_code_primary").when(math, "math_primary").when(code, "code_primary")


def has_reserved(*texts: Column) -> Column:
    found = F.lit(False)
    for text in texts:
        for mark in RESERVED:
            found |= F.contains(F.coalesce(text, F.lit("")), F.lit(mark))
    return found


def dialogue_reason(messages: Column) -> Column:
    """Why an array of (role, content) in order is no dialogue, or 'accepted'."""
    roles = F.transform(messages, lambda m: m["role"])
    spoken = F.filter(roles, lambda r: r != "system")
    blank = F.exists(messages, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) == "")
    known = F.forall(roles, lambda r: r.isin("system", "user", "assistant"))
    late_system = F.exists(F.slice(roles, 2, F.greatest(F.size(roles) - 1, F.lit(0))), lambda r: r == "system")
    turns = F.transform(spoken, lambda r, i: r == F.when(i % 2 == 0, "user").otherwise("assistant"))
    return (
        F.when(F.size(messages) == 0, "empty").when(blank, "blank_content").when(~known, "unknown_role").when(late_system, "system_not_first")
        .when(F.size(spoken) == 0, "no_turns").when(F.get(spoken, F.lit(0)) != "user", "not_started_by_user")
        .when(~F.forall(turns, lambda t: t), "not_alternating").when(F.element_at(spoken, -1) != "assistant", "not_ended_by_assistant")
        .otherwise("accepted")
    )


def record_reason(raw: Column) -> Column:
    """The first of eleven reasons against a JSON record of cluster_id, tokens and token_count, or 'accepted'."""
    record = F.try_parse_json(raw)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(record, path, "variant"))
    cluster, tokens, count = kind("$.cluster_id"), kind("$.tokens"), kind("$.token_count")
    whole = lambda k: (k == "BIGINT") | F.rlike(k, F.lit(r"^DECIMAL\(\d+,0\)$"))
    items = F.try_variant_get(record, "$.tokens", "array<variant>")
    number = lambda v: F.try_variant_get(v, "$", "decimal(38,0)")
    flaw = F.transform(
        items,
        lambda v: F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v) == "BIGINT", F.lit(False)), "token_not_integer").when(
            (number(v) < 0) | (number(v) >= VOCABULARY), "token_out_of_range"
        ),
    )
    first_flaw = F.get(F.filter(flaw, lambda x: x.isNotNull()), F.lit(0))
    missing = lambda k: k.isNull() | (k == "VOID")
    id_value = F.try_variant_get(record, "$.cluster_id", "decimal(38,0)")
    return (
        F.when(record.isNull() | ~F.startswith(F.schema_of_variant(record), F.lit("OBJECT")), "json_parse_error")
        .when(missing(cluster), "missing_cluster_id").when(~whole(cluster), "cluster_id_not_integer")
        .when(~id_value.between(1, 20), "cluster_id_out_of_range")
        .when(missing(tokens), "missing_tokens").when(~F.startswith(tokens, F.lit("ARRAY")), "tokens_not_list")
        .when(F.size(items) == 0, "tokens_empty").when(first_flaw.isNotNull(), first_flaw)
        .when(count.isNotNull() & ~whole(count), "token_count_not_integer")
        .when(count.isNotNull() & (F.try_variant_get(record, "$.token_count", "decimal(38,0)") != F.size(items)), "token_count_mismatch")
        .otherwise("accepted")
    )


def histogram(rows: DataFrame, by: list[str], reason: str, **sums: str) -> DataFrame:
    """Rows by group and reason, with sums of columns."""
    return rows.groupBy(*by, reason).agg(F.count("*").alias("rows"), *[F.sum(c).alias(n) for n, c in sums.items()])


def key_reason(keys: Column, expected: list[str]) -> Column:
    """Whether an object has a key beyond those that it should, or lacks one."""
    want = F.array(*map(F.lit, expected))
    return F.when(F.size(F.array_except(keys, want)) > 0, "extra").when(F.size(F.array_except(want, keys)) > 0, "missing").otherwise("accepted")


def canonical(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows with these fields, none of them null or blank, without white space at their ends."""
    own = rows.withColumns({f: strip(F.col(f)) for f in fields})
    good = F.lit(True)
    for f in fields:
        good &= F.col(f) != ""
    return own.filter(good)


def run_kind(run: Column, excluded: list[str], kinds: dict[str, list[str]]) -> Column:
    """The first kind of whose marks a lower-case run id holds one; null where it holds none, or one that is excluded."""
    holds = lambda marks: F.rlike(run, F.lit("|".join(map(re.escape, marks))))
    kind = F.when(holds(excluded), F.lit(None))
    for name, marks in kinds.items():
        kind = kind.when(holds(marks), name)
    return kind


def judge_reason(raw: Column, expected: Column) -> Column:
    """The first reason against a judge's answer, a JSON array of id, verdict and reason for the expected ids in order, or 'accepted'."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    rows = F.from_json(raw, "array<struct<id:string,verdict:string,reason:string>>")
    return (
        F.when(kind.isNull() | ~F.startswith(kind, F.lit("ARRAY")), "not_an_array").when(F.size(rows) != F.size(expected), "wrong_length")
        .when(F.transform(rows, lambda r: r["id"]) != expected, "wrong_ids").when(~F.forall(rows, lambda r: F.coalesce(r["verdict"].isin("pass", "fail"), F.lit(False))), "unknown_verdict")
        .when(~F.forall(rows, lambda r: F.coalesce(strip(r["reason"]) != "", F.lit(False))), "empty_reason").otherwise("accepted")
    )
