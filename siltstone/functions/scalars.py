"""Scalar functions over texts, numbers, arrays and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.text import casefolded, sha, strip


def conversation_id(prefix: str, *fields: Column) -> Column:
    """A stable id: a prefix and twenty digits of the digest of the fields, joined by a unit separator."""
    return F.concat(F.lit(prefix), F.substring(sha(F.concat_ws("\x1f", *fields)), 1, 20))


def seed_of(base: int, label: Column) -> Column:
    """The first eight bytes of the digest of base seed and label, read little-endian, DECIMAL(20,0)."""
    digest = sha(F.concat(F.lit(f"{base}:"), label))
    turned = F.concat(*[F.substring(digest, i, 2) for i in range(15, 0, -2)])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def quantity(text: Column) -> Column:
    """"1,000" as 1000 and "1.5K" as 1500: digits, parted by commas, underscores or blanks, with K, M, B or T behind; null for anything that is no positive whole number."""
    compact = F.regexp_replace(strip(text), "[_, ]", "")
    form = r"^\+?(\d+\.?\d*|\.\d+)([KkMmBbTt]?)$"
    number = F.nullif(F.regexp_extract(compact, form, 1), F.lit("")).try_cast("decimal(25,12)")
    unit = F.upper(F.regexp_extract(compact, form, 2))
    factor = F.when(unit == "K", 10**3).when(unit == "M", 10**6).when(unit == "B", 10**9).when(unit == "T", 10**12).otherwise(1).cast("decimal(15,0)")
    amount = number * factor
    return F.when((amount > 0) & (amount == F.floor(amount)), amount).try_cast("long")


def slug(text: Column) -> Column:
    """Lower case, anything but letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def markdown_cell(text: Column, most: int = 200) -> Column:
    """A text for a table cell: line ends as blanks, bars escaped, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    short = F.when(F.length(flat) > most, F.concat(F.substr(flat, F.lit(1), F.lit(most - 1)), F.lit("…"))).otherwise(flat)
    return F.replace(short, F.lit("|"), F.lit("\\|"))


def has_role_leak(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?i)(?:^|\n)(?:system|user|assistant):"))


def safe_path(path: Column) -> Column:
    """Whether a relative path has no parent steps, backslashes, NULs or empty parts."""
    return path.isNotNull() & (path != "") & ~F.rlike(path, F.lit(r"^/|\\|\x00|(?:^|/)\.\.?(?:/|$)|//"))


def ended(tokens: Column, end: Column) -> Column:
    """tokens with end behind them, unless it is there."""
    return F.when(F.coalesce(F.element_at(tokens, -1) == end, F.lit(False)), tokens).otherwise(F.array_append(tokens, end))


def little_endian(tokens: Column) -> Column:
    """Tokens as unsigned 16-bit numbers, low byte first."""
    hexed = F.transform(tokens, lambda t: F.lpad(F.hex(t.cast("long")), 4, "0"))
    return F.unhex(F.array_join(F.transform(hexed, lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))), ""))


def from_little_endian(raw: Column) -> Column:
    """The numbers of pairs of bytes, low byte first; raw is a column that is there already, as it is read once for each number."""
    count = (F.octet_length(raw) / 2).cast("int")
    byte = lambda at: F.hex(F.substr(raw, at, F.lit(1)))
    each = lambda i: F.conv(F.concat(byte(i * 2 + 2), byte(i * 2 + 1)), 16, 10).cast("int")
    return F.when(count == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), each))


def control_tokens(tokens: Column, marks: list[str]) -> dict[str, Column]:
    """Of each mark its count and first place, from 0 (-1: none), and whether all stand once and in order."""
    is_mark = lambda m: lambda t: t == m
    counts = [F.size(F.filter(tokens, is_mark(m))) for m in marks]
    places = [(F.array_position(tokens, m) - 1).cast("int") for m in marks]
    good = F.lit(True)
    for i in range(len(marks)):
        good &= counts[i] == 1
        if i:
            good &= places[i - 1] < places[i]
    return {f"n_{i}": c for i, c in enumerate(counts)} | {f"at_{i}": p for i, p in enumerate(places)} | {"in_order": good}


def rule_checks(
    text: Column, exact: str | None = None, required: tuple[str, ...] = (), forbidden: tuple[str, ...] = (), regex: str | None = None, most_tokens: int | None = None,
    tokens: Column | None = None, most_words: int | None = None, suffix: str | None = None, ended: Column | None = None,
) -> dict[str, Column]:
    """The checks that a case asks for, and those that every response has to pass; ``passed`` is whether all hold.

    A response is compared without the white space at its ends, and but for ``exact`` and ``regex`` whatever its case.
    """
    bare = strip(text)
    low = casefolded(bare)
    checks: dict[str, Column] = {}
    if exact is not None:
        checks["exact"] = bare == exact
    checks |= {f"required_{i}": F.contains(low, F.lit(r.casefold())) for i, r in enumerate(required)}
    checks |= {f"forbidden_{i}": ~F.contains(low, F.lit(f.casefold())) for i, f in enumerate(forbidden)}
    if regex is not None:
        checks["regex"] = F.rlike(bare, F.lit(regex))
    if most_tokens is not None and tokens is not None:
        checks["maximum_response_tokens"] = tokens <= most_tokens
    if most_words is not None:
        checks["maximum_words"] = F.regexp_count(bare, F.lit(rf"(?U)[^\s\x1C-\x1F]+")) <= most_words
    if suffix is not None:
        checks["required_suffix"] = F.endswith(low, F.lit(suffix.casefold()))
    if ended is not None:
        checks["eos"] = ended
    checks |= {"no_role_leak": ~has_role_leak(bare), "non_empty": bare != ""}
    passed = F.lit(True)
    for check in checks.values():
        passed &= check
    return checks | {"passed": passed}


def kept_tokens(probabilities: Column, most: int, mass: float) -> Column:
    """Which tokens, by their places, a filter keeps: the most probable ones, of these as few as reach the mass, likeliest first, ties to the earlier."""
    ranked = F.sort_array(F.transform(probabilities, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    top = F.slice(ranked, 1, most)
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept"))
    step = lambda a, x: F.when(a["sum"] >= mass, a).otherwise(F.struct((a["sum"] - x["p"]).alias("sum"), F.array_append(a["kept"], x["i"]).alias("kept")))
    return F.aggregate(top, start, step)["kept"]


def six_digits(number: Column) -> Column:
    """A number with six digits that count, as %.6g has it."""
    plain = F.format_string("%.5e", number.cast("double"))
    exponent = F.regexp_extract(plain, r"e([+-]\d+)$", 1).cast("int")
    bare = lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    places = [F.when(exponent == e, bare(F.format_string(f"%.{5 - e}f", number.cast("double")))) for e in range(-4, 6)]
    science = F.concat(bare(F.regexp_extract(plain, r"^([^e]+)e", 1)), F.regexp_extract(plain, r"(e[+-]\d+)$", 1))
    return F.coalesce(*places, F.when(number == 0, "0"), science)


def wrapped(kind: str, prompt: Column) -> Column:
    """A prompt as a chat turn, as question and answer, or plain."""
    if kind == "chat":
        return F.concat(F.lit("User:\n"), prompt, F.lit("\nAssistant:\n"))
    if kind == "qa":
        return F.concat(F.lit("Question: "), prompt, F.lit("\nAnswer:"))
    return prompt


def format_checks(text: Column, answer: Column, level: Column) -> dict[str, Column]:
    """Checks of a response by what its level asks for: any form, the answer alone, one line, two lines; ``passed`` is whether all hold."""
    bare = strip(text)
    line = F.concat(F.lit("Answer: "), answer)
    lines = F.split(bare, "\n")
    one = ~F.contains(bare, F.lit("\n")) & F.startswith(bare, F.lit("Answer: ")) & (bare == line)
    two = (F.size(lines) == 2) & F.startswith(F.get(lines, F.lit(0)), F.lit("Answer: ")) & (F.get(lines, F.lit(1)) == "Done: yes") & (bare == F.concat(line, F.lit("\nDone: yes")))
    form = F.when(level == 0, F.lit(True)).when(level == 1, bare == answer).when(level == 2, one).otherwise(F.coalesce(two, F.lit(False)))
    checks = {"content_correct": F.contains(casefolded(bare), casefolded(answer)), "non_empty": bare != "", "no_role_leak": ~has_role_leak(bare), "format_constraints": form}
    return checks | {"passed": checks["content_correct"] & checks["non_empty"] & checks["no_role_leak"] & form}


def flattened(rows: DataFrame, keys: list[str], raw: str, depth: int = 4) -> DataFrame:
    """(keys, path, value): every value of JSON objects that is no object itself, with the keys that lead to it joined by slashes.

    Objects deeper than depth are given as they are.
    """
    level = rows.select(*keys, F.lit("").alias("path"), F.try_parse_json(raw).alias("v"))
    found = None
    for _ in range(depth):
        inner = level.select(*keys, "path", F.inline(F.expr("transform(json_object_keys(to_json(v)), k -> struct(k AS key))")), "v")
        inner = inner.select(*keys, F.concat("path", F.lit("/"), "key").alias("path"), F.try_variant_get("v", F.concat(F.lit("$['"), "key", F.lit("']")), "variant").alias("v"))
        is_object = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
        values = inner.filter(~F.coalesce(is_object, F.lit(False))).select(*keys, "path", F.try_variant_get("v", "$", "string").alias("value"))
        found = values if found is None else found.unionByName(values)
        level = inner.filter(is_object)
    return found.unionByName(level.select(*keys, "path", F.to_json("v").alias("value"))).withColumn("path", F.substr("path", F.lit(2)))
