"""Scalar text functions: normal forms, hashes, split draws, parsing."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F

#: Marks of reasoning text: fixed values.
THINK, THINK_END, ANSWER = "<think>", "</think>", "<answer>"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


#: White space, as a class of the JVM's patterns: the Unicode property and the four separators below the blank.
BLANK = r"[\s\x1C-\x1F]"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"^(?U){BLANK}+", ""), rf"(?U){BLANK}+$", "")


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, list[tuple[str, str]]]:
    """What full case folding does beyond lower case: characters and those they become, and characters that become several."""
    changed = {c: c.casefold() for c in map(chr, range(0x20000)) if c.lower() == c != c.casefold()}
    single = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), [(c, f) for c, f in changed.items() if len(f) > 1]


@lru_cache(maxsize=1)
def _rare() -> str:
    """A pattern for characters near those that lower case does not fold, as a few ranges, since a class of many single ones is slow."""
    singles, _, several = _foldings()
    ranges: list[list[int]] = []
    for n in sorted(map(ord, singles + "".join(c for c, _ in several if c != "ß"))):
        if ranges and n - ranges[-1][1] <= 64:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def casefolded(text: Column) -> Column:
    """Full Unicode case folding.  Sharp s is common, so it has a step of its own; the others are looked for first, as few texts hold one."""
    singles, folds, several = _foldings()
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    whole = F.translate(low, singles, folds)
    for char, fold in several:
        if char != "ß":
            whole = F.replace(whole, F.lit(char), F.lit(fold))
    plain = ~F.rlike(low, F.lit(r"[\xB5\x{149}-\x{10FFFF}]"))
    return F.when(plain, low).when(~F.rlike(low, F.lit(_rare())), low).otherwise(whole)


def collapsed(text: Column) -> Column:
    """White space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){BLANK}+", " "))


def folded(text: Column) -> Column:
    return casefolded(collapsed(text))


def bare_lines(text: Column) -> Column:
    """A text without white space at its ends and those of its lines, which end in a line feed."""
    ends = r"[ \t\x1F\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]*(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029])"
    return F.regexp_replace(strip(text), ends, "\n")


def json_string(text: Column) -> Column:
    """A text as a JSON string of ASCII characters alone."""
    code = lambda c: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(c)), 4, "0"))

    def escaped(c: Column) -> Column:
        n = F.ascii(c).cast("long")
        pair = F.concat(code(F.floor((n - 0x10000) / 0x400) + 0xD800), code((n - 0x10000) % 0x400 + 0xDC00))
        named = F.when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c == "\b", "\\b").when(c == "\f", "\\f")
        return F.when(c.isin('"', "\\"), F.concat(F.lit("\\"), c)).when(n.between(32, 126), c).when(named.isNotNull(), named).when(n < 0x10000, code(n)).otherwise(pair)

    whole = F.array_join(F.transform(F.split(text, ""), escaped), "")
    return F.concat(F.lit('"'), F.when(F.rlike(text, F.lit(r'[^ !#-\[\]-~]')), whole).otherwise(text), F.lit('"'))


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def prompt_hash(text: Column) -> Column:
    return sha(folded(text))


def first_64_bits(digest: Column) -> Column:
    """The first eight bytes of a hex digest as a number, DECIMAL(20,0)."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def _component(text: Column) -> Column:
    raw = text.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw)


def is_validation(version: str, seed: str, revision: str, filename: Column, record_start: Column, probability: float) -> Column:
    """Whether a record belongs to the validation split, by its identity alone; version names the rule and is hashed with it."""
    if probability <= 0:
        return F.lit(False)
    if probability >= 1:
        return F.lit(True)
    start = F.unhex(F.lpad(F.hex(record_start), 16, "0"))
    identity = F.concat(*(_component(c) for c in (F.lit(version), F.lit(seed), F.lit(revision), filename)), start)
    return first_64_bits(F.sha2(identity, 256)) < F.lit(int(probability * 2**64)).cast("decimal(20,0)")


def identity_split(group: Column, seed: int = 17, buckets: int = 10_000, train: float = 0.95, validation: float = 0.025) -> Column:
    """train, validation or test by a bucket of the group's hash."""
    bucket = first_64_bits(sha(F.concat(F.lit(f"{seed}:"), group))) % F.lit(buckets)
    return F.when(bucket < round(train * buckets), "train").when(bucket < round((train + validation) * buckets), "validation").otherwise("test")


def ordered_hash(*parts: Column) -> Column:
    """Key of a hash order: the digest of the parts joined by colons."""
    return sha(F.concat_ws(":", *parts))


def parsed_output(output: Column) -> Column:
    """STRUCT(reasoning, answer) of <think>...</think> answer; null where a part is missing or empty."""
    text = strip(output)
    close = F.locate(THINK_END, text, len(THINK) + 1)
    reasoning = strip(F.substr(text, F.lit(len(THINK) + 1), F.greatest(close - len(THINK) - 1, F.lit(0))))
    answer = strip(F.substr(text, close + len(THINK_END)))
    for tag in ("answer", "final"):
        opened = F.startswith(answer, F.lit(f"<{tag}>"))
        inner = F.regexp_replace(F.regexp_replace(answer, rf"^<{tag}>(?U)\s*", ""), rf"(?U)\s*</{tag}>$", "")
        answer = F.when(opened, inner).otherwise(answer)
    whole = F.startswith(text, F.lit(THINK)) & (close > 0) & (reasoning != "") & (answer != "")
    return F.when(whole, F.struct(reasoning.alias("reasoning"), answer.alias("answer")))


def trigram_repetition(items: Column) -> Column:
    """One less the share of distinct among all runs of three items; 0 for fewer than three."""
    n = F.size(items) - 2
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat_ws("\x1f", F.slice(items, i, 3)))
    return F.when(n < 1, 0.0).otherwise(1 - F.size(F.array_distinct(grams)) / n)


def canonical_json(values: dict[str, Column]) -> Column:
    """An object of values that are JSON already, its keys in order, without blanks."""
    parts = [F.concat(F.lit(f'"{key}":'), value) for key, value in sorted(values.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_list(answer: Column) -> Column:
    """A JSON list out of an answer that may be fenced as code; null where there is none."""
    bare = strip(answer)
    fenced = F.startswith(bare, F.lit("```")) & F.endswith(bare, F.lit("```")) & (F.length(bare) >= 6)
    inner = strip(F.regexp_replace(F.regexp_replace(bare, "^```(?:json)?", ""), "```$", ""))
    clean = F.when(fenced, inner).otherwise(bare)
    return F.when(F.startswith(F.schema_of_variant(F.try_parse_json(clean)), F.lit("ARRAY")), clean)


def snippet(text: Column, start: Column, end: Column, before: int = 120, after: int = 80) -> Column:
    """The span from start to end, widened to whole words, in brackets, with so many characters around it; dots where the text goes on."""
    word = r"[\p{L}\p{N}_'’]*"
    a = start - F.length(F.regexp_extract(F.substr(text, F.lit(1), start), rf"{word}\z", 0))  # $ would match before a last line feed, too
    b = end + F.length(F.regexp_extract(F.substr(text, end + 1), f"^{word}", 0))
    first, last = F.greatest(F.lit(0), a - before), F.least(F.length(text), b + after)
    part = lambda i, j: F.substr(text, i + 1, j - i)
    shown = collapsed(F.concat(part(first, a), F.lit("["), part(a, b), F.lit("]"), part(b, last)))
    return F.concat(F.when(first > 0, "...").otherwise(""), shown, F.when(last < F.length(text), "...").otherwise(""))
