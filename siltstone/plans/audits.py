"""Queries that summarise splits, behaviours and frontiers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.functions import text as X
from siltstone.functions.ordered import running
from siltstone.plans.corpus import DOCS, docs
from siltstone.plans.evaluation import SCORED, tokens
from siltstone.plans.registry import query, table

SHARDS = f"""WITH {DOCS}, shards AS (SELECT cluster AS shard, count(*) AS n FROM docs GROUP BY cluster),
placed AS (SELECT shard, CAST(n AS BIGINT) AS blocks, CAST(sum(n) OVER (ORDER BY shard) - n AS BIGINT) AS first, CAST(sum(n) OVER (ORDER BY shard) - 1 AS BIGINT) AS last FROM shards)"""


def frontier(spark, sf_dir):
    """Shards with the range of blocks that each holds; a cluster stands for a shard, a document for a block."""
    own = docs(spark, sf_dir).groupBy(F.col("cluster").alias("shard")).agg(F.count("*").alias("blocks"))
    placed = running(own, [], ["shard"], ["blocks"])
    return placed.select("shard", "blocks", F.col("before_blocks").alias("first"), (F.col("before_blocks") + F.col("blocks") - 1).alias("last"))


@query("st09_staging", f"{SHARDS} SELECT shard, first, last FROM placed WHERE last >= 150 ORDER BY first LIMIT 2")
def st09_staging(spark, sf_dir):
    """The shard that holds the next block to consume, and its successor."""
    return frontier(spark, sf_dir).filter("last >= 150").orderBy("first").limit(2).select("shard", "first", "last")


@query("st06_frontier", f"{SHARDS} SELECT CAST(count(*) AS BIGINT) AS shards, CAST(sum(blocks) AS BIGINT) AS blocks, max(last) + 1 = sum(blocks) AND min(first) = 0 AS contiguous FROM placed")
def st06_frontier(spark, sf_dir):
    """Whether the ready prefix begins at zero and has no gap."""
    return frontier(spark, sf_dir).agg(
        F.count("*").alias("shards"), F.sum("blocks").alias("blocks"), ((F.max("last") + 1 == F.sum("blocks")) & (F.min("first") == 0)).alias("contiguous")
    )


@query("a01_reasons", f"""
WITH {DOCS} SELECT source, CAST(count(*) AS BIGINT) AS seen, CAST(count(*) FILTER (n BETWEEN 20 AND 600) AS BIGINT) AS accepted, CAST(count(*) FILTER (n < 20) AS BIGINT) AS too_short,
CAST(count(*) FILTER (n > 600) AS BIGINT) AS too_long, CAST(coalesce(sum(n) FILTER (n BETWEEN 20 AND 600), 0) AS BIGINT) AS targets FROM docs GROUP BY source""")
def a01_reasons(spark, sf_dir):
    n = F.col("n")
    good = n.between(20, 600)
    return docs(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("seen"), F.count_if(good).alias("accepted"), F.count_if(n < 20).alias("too_short"), F.count_if(n > 600).alias("too_long"),
        F.coalesce(F.sum(F.when(good, n)), F.lit(0)).alias("targets"),
    )


@query("a07_split_summary", f"""
WITH {DOCS} SELECT CASE WHEN doc_id % 20 = 0 THEN 'validation' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS sequences, CAST(sum(n) AS BIGINT) AS tokens, min(doc_id) AS first, max(doc_id) AS last,
max(doc_id) - min(doc_id) + 1 = count(*) AS contiguous FROM docs GROUP BY 1""")
def a07_split_summary(spark, sf_dir):
    split = F.when(F.col("doc_id") % 20 == 0, "validation").otherwise("train")
    return docs(spark, sf_dir).groupBy(split.alias("split")).agg(
        F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
        (F.max("doc_id") - F.min("doc_id") + 1 == F.count("*")).alias("contiguous"),
    )


@query("a16_document_sums", f"WITH {SCORED} SELECT CAST(vec_id // 64 AS BIGINT) AS unit, round(sum(loss), 6) AS loss, CAST(count(*) AS BIGINT) AS tokens FROM tokens GROUP BY 1")
def a16_document_sums(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 64).alias("unit")).agg(F.round(F.sum("loss"), 6).alias("loss"), F.count("*").alias("tokens"))


@query("a19_behaviour", r"""
WITH r AS (SELECT conv_id % 3 AS category, regexp_replace(regexp_replace(text, '^[\s\x0B]+', ''), '[\s\x0B]+$', '') AS t, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM conversations WHERE role = 'assistant'),
c AS (SELECT *, len(w) AS n, regexp_matches(t, '[.!?]$') AS ended, regexp_matches(t, '(?i)(?:^|\n)(?:system|user|assistant):') AS leak,
    CASE WHEN len(w) < 3 THEN 0.0 ELSE 1 - len(list_distinct([w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] FOR i IN range(1, len(w) - 1)])) / (len(w) - 2)::DOUBLE END AS rep FROM r)
SELECT category, CAST(count(*) AS BIGINT) AS cases, round(avg((t <> '' AND ended AND NOT leak AND n <= 100)::INT), 9) AS pass_rate, round(avg(ended::INT), 9) AS eos_rate, round(avg((NOT ended)::INT), 9) AS runaway_rate, round(avg((t = '')::INT), 9) AS empty_rate,
       round(avg(leak::INT), 9) AS leak_rate, round(avg(n), 6) AS mean_tokens, round(avg(rep), 6) AS repetition FROM c GROUP BY category""")
def a19_behaviour(spark, sf_dir):
    """Answers by category; a sign that ends a sentence stands for the end mark."""
    from siltstone.functions.scalars import has_role_leak

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    own = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") % 3).alias("category"), X.strip(F.col("text")).alias("t"), words.alias("w"))
    n, ended, leak = F.size("w"), F.rlike("t", F.lit("[.!?]$")), has_role_leak(F.col("t"))
    rate = lambda c: F.round(F.avg(c.cast("int")), 9)
    return own.groupBy("category").agg(
        F.count("*").alias("cases"), rate((F.col("t") != "") & ended & ~leak & (n <= 100)).alias("pass_rate"), rate(ended).alias("eos_rate"), rate(~ended).alias("runaway_rate"), rate(F.col("t") == "").alias("empty_rate"),
        rate(leak).alias("leak_rate"), F.round(F.avg(n), 6).alias("mean_tokens"), F.round(F.avg(X.trigram_repetition(F.col("w"))), 6).alias("repetition"),
    )


@query("a22_wrappers", """
WITH m AS (SELECT label, event_type, avg(value) AS v FROM events e JOIN (SELECT DISTINCT label FROM embeddings) l ON e.user_id % 10 = l.label GROUP BY ALL)
SELECT m.label, m.event_type, round(m.v - b.v, 6) AS delta FROM m JOIN m b ON b.label = m.label AND b.event_type = 'click' WHERE m.event_type <> 'click'""")
def a22_wrappers(spark, sf_dir):
    """Means under each wrapper against those under the first."""
    models = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label")).distinct()
    own = table(spark, sf_dir, "events").withColumn("label", F.col("user_id") % 10).join(models, "label", "left_semi")
    means = own.groupBy("label", "event_type").agg(F.avg("value").alias("v"))
    base = means.filter("event_type = 'click'").select("label", F.col("v").alias("b"))
    out = means.filter("event_type <> 'click'").join(base, "label")
    return out.select(F.col("label").cast("int").alias("label"), "event_type", F.round(F.col("v") - F.col("b"), 6).alias("delta"))


@query("j10_paired", """
WITH o AS (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b, avg(value) FILTER (event_id % 2 = 0) AS parent, avg(value) FILTER (event_id % 2 = 1) AS tuned FROM events GROUP BY ALL)
SELECT user_id, event_type, round(parent, 6) AS parent, round(tuned, 6) AS tuned, CASE WHEN tuned > parent THEN 'win' WHEN tuned < parent THEN 'loss' ELSE 'tie' END AS outcome FROM o WHERE a > 0 AND b > 0""")
def j10_paired(spark, sf_dir):
    """Cases that both arms, even and odd events, have: what each scores, and which is better."""
    arm = lambda k: table(spark, sf_dir, "events").filter(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    met = arm(0).withColumnRenamed("v", "p").join(arm(1).withColumnRenamed("v", "t"), ["user_id", "event_type"])
    outcome = F.when(F.col("t") > F.col("p"), "win").when(F.col("t") < F.col("p"), "loss").otherwise("tie")
    return met.select("user_id", "event_type", F.round("p", 6).alias("parent"), F.round("t", 6).alias("tuned"), outcome.alias("outcome"))


@query("w18_phases", f"""
WITH {DOCS}, t AS (SELECT CAST(ceil(sum(n) / 2048.0::DOUBLE) AS BIGINT) AS blocks FROM docs)
SELECT blocks, greatest(1, CAST(ceil(blocks * 0.02::DOUBLE) AS BIGINT)) AS warmup, greatest(1, CAST(ceil(blocks * 0.2::DOUBLE) AS BIGINT)) AS decay FROM t""")
def w18_phases(spark, sf_dir):
    """Blocks of a run, of its warm-up and of its decay."""
    own = docs(spark, sf_dir).agg(F.ceil(F.sum("n") / F.lit(2048.0)).alias("blocks"))
    phase = lambda p: F.greatest(F.lit(1), F.ceil(F.col("blocks") * F.lit(p)))
    return own.select("blocks", phase(0.02).alias("warmup"), phase(0.2).alias("decay"))


@query("o04_latest", """
SELECT source, max_by(doc_id, (n_chars, doc_id)) AS artefact, CAST(count(*) AS BIGINT) AS candidates FROM documents WHERE regexp_matches(source, '^src[0-9]+$') GROUP BY source HAVING count(*) > 0""")
def o04_latest(spark, sf_dir):
    """The artefact that stands last in its listing."""
    own = table(spark, sf_dir, "documents").filter(F.rlike("source", F.lit("^src[0-9]+$")))
    return own.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("artefact"), F.count("*").alias("candidates"))


@query("relational_revenue", """
SELECT n_name, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY n_name""")
def relational_revenue(spark, sf_dir):
    """Revenue of a year by nation: filters and columns reach the scans, joins are the optimiser's."""
    orders = table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1996-01-01"))
    met = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    own = met.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
