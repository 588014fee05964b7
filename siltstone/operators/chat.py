"""Conversations as arrays of messages, and as tokens with a target mask."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def conversations(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, messages): messages (role, content) in order of turn; a conversation is one training example, whose length the context bounds."""
    own = turns.groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return own.select(conversation, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def words(text: Column) -> Column:
    """The default tokens: line feeds, and runs of anything but ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"\n|[^\x20\x09-\x0D]+"), 0)


def role_prefix(role: Column) -> Column:
    return F.concat(F.initcap(role), F.lit(":\n"))


def layout(messages: Column) -> Column:
    """Messages as text: each role's prefix and content, a line feed after all but an assistant's, and one between messages."""
    each = lambda m: F.concat(role_prefix(m["role"]), m["content"], F.when(m["role"] == "assistant", "").otherwise("\n"))
    return F.array_join(F.transform(messages, each), "\n")


def prompt_tokens(messages: Column, end: str = "<end>", encode: Callable[[Column], Column] = words) -> Column:
    """History as tokens up to where an assistant's next answer begins."""
    last = lambda m: F.when(m["role"] == "assistant", F.array(F.lit(end))).otherwise(encode(F.lit("\n")))
    none = F.array().cast("array<string>")
    each = lambda m, i: F.concat(F.when(i > 0, encode(F.lit("\n"))).otherwise(none), encode(role_prefix(m["role"])), encode(m["content"]), last(m))
    return F.concat(F.array(F.lit(end)), F.flatten(F.transform(messages, each)), encode(F.lit("\nAssistant:\n")))


def reasoning_tokens(text: Column, marks: tuple[str, ...] = ("<think>", "</think>", "<answer>")) -> Column:
    """Tokens of a text in which each mark is one, whatever stands beside it; the rest are words."""
    either = "|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True))
    return F.regexp_extract_all(text, F.lit(rf"{either}|\n|(?:(?!{either})[^\x20\x09-\x0D])+"), 0)


def serialised(rows: DataFrame, messages: str = "messages", end: str = "<end>", encode: Callable[[Column], Column] = words) -> DataFrame:
    """rows with ``tokens`` and ``mask``: an end mark, then for each message its role, its tokens and a closing mark, parted by line feeds.

    What is learnt, where the mask is true, are an assistant's tokens and the end that closes them.  encode is the tokenizer.
    """

    def piece(m: Column, i: Column) -> Column:
        none = F.array().cast("array<string>")
        head = F.concat(F.when(i > 0, encode(F.lit("\n"))).otherwise(none), encode(role_prefix(m["role"])))
        own = encode(m["content"])
        learnt = m["role"] == "assistant"
        tail = F.when(learnt, F.array(F.lit(end))).otherwise(encode(F.lit("\n")))
        mask = F.concat(F.array_repeat(F.lit(False), F.size(head)), F.array_repeat(learnt, F.size(own) + F.size(tail)))
        return F.struct(F.concat(head, own, tail).alias("tokens"), mask.alias("mask"))

    pieces = rows.withColumn("_p", F.transform(messages, piece))
    out = pieces.withColumn("tokens", F.concat(F.array(F.lit(end)), F.flatten(F.col("_p.tokens"))))
    return out.withColumn("mask", F.concat(F.array(F.lit(False)), F.flatten(F.col("_p.mask")))).drop("_p")
