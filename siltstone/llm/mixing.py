"""Mixing sources to target weights by systematic sampling.

The expected copies of a document are its source's rate, target over size.  Documents of a source are
put in order, the expected copies are summed from the first on, one random offset is added, and a document is
taken once for each integer that the sum crosses with it.  The order goes up in size with half of the
documents, chosen by a hash of their id, and down again with the others: neighbours are alike in size, and
both ends are small, so the words taken hardly depend on the offset.  They differ from the target
by about the largest document at most.

The order is global, without a source's rows in one task: rows are range-partitioned by the source and that
order, numbered within a partition, and lifted by what earlier partitions hold of the source; that
table has at most as many rows as there are partitions and sources together.  Both what is sorted and
what is numbered are written to the checkpoint folder, so a lost executor cannot change an order.

Edge cases: a null text has size 0; null is a source of its own, last in order; a source of size 0 has
target 0 and nothing taken; repeated rows count each on its own; empty tables give empty results;
columns beyond the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.llm.common import ByPlace, cut, key_of, pick

#: Weights of the sources in order, repeating, and the most copies of a document: fixed values.
WEIGHTS = (5, 2, 1)
MOST = 3
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the total shared by weight, no target above most times its size.

    Sources are taken from the smallest ratio of cap to weight on.  While that ratio is below the
    share a weight of one has of what is left, the source stops at its cap; the rest share.  The
    table has a row for each source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    share = F.array(*map(F.lit, weights))
    own = sizes.withColumn("w", F.element_at(share, F.pmod(rank - 1, F.lit(len(weights))) + 1)).withColumn("cap", most * F.col("source_size"))
    ratio = F.col("cap") / F.col("w")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    own = own.withColumn("level", left)
    own = own.withColumn("stops", ratio < F.col("level"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    own = own.withColumn("share", level)
    return own.select(
        "source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("share")).alias("target")
    )


def offset(source: Column, seed: int) -> Column:
    """A multiple of 2**-20 from 0 up to 1 for each source, from a hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(2**20))


def text_key(text: Column) -> Column:
    """What tells rows of one id apart: a digest of the text, null for null."""
    return F.sha2(text.cast("binary"), 256)


def _mixed(own: DataFrame, tie: list[str], seed: int, weights: tuple[int, ...], most: int) -> DataFrame:
    """own, rows of (id, source, size, ...), with source_size, target, taken and copies; rows alike in size and id go by the columns of tie."""
    falls = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) >= "8"
    sized = cut(own.withColumn("falls", falls).withColumn("rise", F.when(F.col("falls"), -F.col("size")).otherwise(F.col("size"))))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    order = ["falls", "rise", "id", *tie]
    ranged = sized.repartitionByRange(F.col("source").asc_nulls_last(), *order).withColumn("part", F.spark_partition_id())
    numbered = cut(ranged.withColumn("n", F.row_number().over(Window.partitionBy("part", "source").orderBy(*order))))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        numbered.groupBy("part", "source").agg(F.count("*").alias("rows"))
        .withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .withColumnRenamed("source", "s")
        .join(goal, F.col("s").eqNullSafe(F.col("source")))
        .select(F.col("part").alias("p"), "s", "start", "source_size", "target")
    )
    met = numbered.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    place, shift = F.col("start") + F.col("n"), offset(F.col("source"), seed)
    copies = F.floor(rate * place + shift) - F.floor(rate * (place - 1) + shift)
    return met.select(*own.columns, "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
) -> DataFrame:
    """(id_col, size, source_size, target, taken, copies) for every row of docs."""
    own = pick(docs, id_col, text_col, source_col).select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    return _mixed(own, [], seed, weights, most).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "copies")


def take(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
) -> DataFrame:
    """docs, all its columns, each row as often as the mix takes it.

    Rows are known by id, source and a digest of the text together, so which of several rows that share an id, or lack one,
    are taken is the same on every run.  Rows alike in all three share their copies: one of them, any, is
    repeated as often as they are taken together.
    """
    own = ByPlace(docs)
    ids, sources, texts = (F.col(own.name(c)) for c in (id_col, source_col, text_col))
    sizes = own.df.select(ids.alias("id"), sources.alias("source"), word_count(texts).alias("size"), text_key(texts).alias("text_key"))
    taken = _mixed(sizes, ["text_key"], seed, weights, most).filter("copies > 0")
    keys = ["key_id", "key_source", "key_text"]
    by_key = lambda *columns: dict(zip(keys, map(key_of, columns)))
    wanted = taken.withColumns(by_key(*map(F.col, ("id", "source", "text_key")))).groupBy(*keys).agg(F.sum("copies").alias("wanted"))
    once = own.df.withColumns(by_key(ids, sources, text_key(texts))).groupBy(*keys).agg(F.first(F.struct(*own.df.columns)).alias("row"))
    repeated = once.join(wanted, keys).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("wanted"))).alias("copy"))
    return own.back(repeated.select("row.*"))


SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
    FROM sized GROUP BY source
), levels AS (
    SELECT *, CAST((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE)
              / CAST((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS level
    FROM sources
    WINDOW before AS (ORDER BY 3 * source_size / CAST(w AS DOUBLE), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
    SELECT source, source_size,
           CASE WHEN 3 * source_size / CAST(w AS DOUBLE) < level THEN CAST(3 * source_size AS DOUBLE)
                ELSE w * max(CASE WHEN 3 * source_size / CAST(w AS DOUBLE) >= level THEN level END) OVER () END AS target
    FROM levels
), placed AS (
    SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY falls, CASE WHEN falls THEN -size ELSE size END, doc_id NULLS FIRST) AS place
    FROM (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '')) >= '8' AS falls FROM sized)
), rated AS (
    SELECT p.*, g.source_size, g.target,
           CASE WHEN g.source_size = 0 THEN 0.0::DOUBLE ELSE g.target / CAST(g.source_size AS DOUBLE) END AS rate,
           CAST(CAST(concat('0x', substr(sha256(concat('17:', coalesce(p.source, ''))), 1, 5)) AS UBIGINT) AS DOUBLE) / 1048576.0::DOUBLE AS shift
    FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate * place + shift) - floor(rate * (place - 1) + shift)) * size AS BIGINT) AS taken
FROM rated
"""
