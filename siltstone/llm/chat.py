"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions alone.

A chat that is logged anew after each turn leaves every prefix of itself behind.  Turns are numbered within
their conversation, each numbered turn is hashed, and the exclusive-or of the hashes up to a turn is that
prefix's hash: two words of 64 bits, rolled forward from turn to turn.  A conversation whose last hash is
the hash of a shorter prefix of another is dropped by an anti-join; of equal conversations the one with the
smallest id stays.  What is left is maximal, and is rendered.

Numbers and hashes are prefix sums, which are made without a conversation's rows in one task: rows are
range-partitioned by (conversation, turn), summed within a partition, and lifted by the totals of earlier
partitions.  Both sides of the anti-join are aggregated to one row a hash first, so a prefix that
many conversations share is one row.  Joins that bring a conversation's numbers back to its turns go by partition and
conversation together, so the turns of a very long one stay spread.  A rendered conversation comes in parts of
``part_turns`` turns, so that no row gathers more than that; one of at most that many turns is part 0
alone.  With ``part_turns`` None every conversation is one row, whatever its length, and has to fit into one.

Edge cases: rows without conversation id take no part; repeated rows count once; rows of one turn
number are ordered by role, then by a hash of their text; a null turn comes first; a null role is rendered
as "unknown" and a null text as an empty one; an empty table gives an empty result; columns beyond the
named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.llm.common import cut, pick

#: Turns in a row of rendered text, unless the caller says otherwise.
PART_TURNS = 256
#: Marks of a rendered turn: fixed values.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _hashes(salts: tuple[str, str], *columns: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), *columns) for salt in salts]


def _own(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, t1, t2): usable rows, with two hashes of role and text that tell null from empty."""
    own = pick(turns, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text").filter(F.col("conv").isNotNull())
    parts = (F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    t1, t2 = _hashes(("a", "b"), *parts)
    return own.withColumns({"t1": t1, "t2": t2})


def numbered(own: DataFrame) -> DataFrame:
    """(part, conv, turn, role, t1, t2, n, turns, h1, h2): each turn's number from 1, how many its conversation has, and the hashes of the prefix that it ends."""
    order = ["turn", "role", "t1", "t2"]
    distinct = own.select("conv", *order).distinct()
    ranged = distinct.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part", "conv").orderBy(*order)
    rows = cut(ranged.withColumn("n", F.row_number().over(within)))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("part", "conv").agg(F.count("*").alias("rows"))
        .withColumns({"start": F.coalesce(F.sum("rows").over(earlier), F.lit(0)), "turns": F.sum("rows").over(Window.partitionBy("conv"))}).drop("rows")
    )
    g1, g2 = _hashes(("c", "d"), F.col("n"), F.col("t1"), F.col("t2"))
    placed = rows.join(starts, ["part", "conv"]).withColumn("n", F.col("n") + F.col("start")).drop("start").withColumns({"g1": g1, "g2": g2})
    placed = cut(placed)
    lifts = placed.groupBy("part", "conv").agg(F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"))
    lifts = lifts.select("part", "conv", *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(y) for x, y in (("x1", "y1"), ("x2", "y2"))])
    rolled = Window.partitionBy("part", "conv").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({"h1": F.bit_xor("g1").over(rolled), "h2": F.bit_xor("g2").over(rolled)})
    return local.join(lifts, ["part", "conv"]).select(
        "part", "conv", *order, "n", "turns", F.col("h1").bitwiseXOR(F.col("y1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("y2")).alias("h2")
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv, turns): conversations that are no other's prefix, and of equal ones the first."""
    unique = prefixes.filter("n = turns").groupBy("turns", "h1", "h2").agg(F.min("conv").alias("conv"))
    # a prefix that is shorter than its conversation: one that a next turn follows
    shorter = prefixes.filter("n < turns").groupBy(F.col("n").alias("turns"), "h1", "h2").agg(F.count("*").alias("held"))
    return unique.join(shorter, ["turns", "h1", "h2"], "left_anti").select("conv", "turns")


def render(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int | None = PART_TURNS
) -> DataFrame:
    """(conv_col, part, n_turns, rendered): every maximal conversation as text, in parts of part_turns turns."""
    own = _own(turns, conv_col, turn_col, role_col, text_col)
    prefixes = cut(numbered(own))
    held = prefixes.select("part", "conv").distinct().join(maximal(prefixes).select("conv"), "conv")
    placed = prefixes.join(held, ["part", "conv"]).select(
        F.col("conv").alias("c"), "turns", "n", F.col("turn").alias("u"), F.col("role").alias("r"), F.col("t1").alias("k1"), F.col("t2").alias("k2")
    )
    met = own.join(
        placed,
        (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("u")) & F.col("role").eqNullSafe(F.col("r"))
        & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")),
    )
    turn = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    part = F.floor((F.col("n") - 1) / part_turns).cast("int") if part_turns else F.lit(0)
    parts = met.groupBy("conv", part.alias("part")).agg(
        F.first("turns").alias("n_turns"), F.sort_array(F.collect_set(F.struct("n", turn.alias("turn")))).alias("own")
    )
    return parts.select(F.col("conv").alias(conv_col), "part", F.col("n_turns").cast("long"), F.array_join(F.col("own.turn"), "").alias("rendered"))


SQL = """
WITH own AS (
    SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
    SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS turns,
           concat('<|', coalesce(role, 'unknown'), '|>', chr(10), coalesce(text, ''), '<|end|>', chr(10)) AS rendered
    FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), prefixes AS (
    SELECT conv_id, n, turns, string_agg(concat(role IS NULL, text IS NULL, rendered), '') OVER (PARTITION BY conv_id ORDER BY n) AS prefix FROM placed
), kept AS (
    SELECT min(conv_id) AS conv_id FROM prefixes w WHERE n = turns
    AND NOT EXISTS (SELECT 1 FROM prefixes s WHERE s.n < s.turns AND s.n = w.n AND s.prefix = w.prefix)
    GROUP BY turns, prefix
)
SELECT conv_id, CAST((n - 1) // 256 AS INTEGER) AS part, CAST(any_value(turns) AS BIGINT) AS n_turns, string_agg(rendered, '' ORDER BY n) AS rendered
FROM placed WHERE conv_id IN (SELECT conv_id FROM kept)
GROUP BY conv_id, (n - 1) // 256
"""
