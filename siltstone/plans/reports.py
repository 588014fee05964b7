"""Queries that check, score and account: predicates, joins of results, scorecards, verification, ledgers, cursors."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.functions import scalars as S, text as X
from siltstone.functions.ordered import running, running_max
from siltstone.operators import chat, metrics, selection, validation, verify
from siltstone.plans.corpus import DOCS, docs, sizes
from siltstone.plans.evaluation import SCORED, tokens
from siltstone.plans.registry import query, table

TOKENS = r"regexp_extract_all(text, '\n|[^\x20\x09-\x0D]+')"


@query("p13_schema", """
SELECT event_id, CASE WHEN len(list_filter(json_keys(props), lambda k: k <> 'k')) > 0 THEN 'extra' WHEN NOT list_contains(json_keys(props), 'k') THEN 'missing' ELSE 'accepted' END AS reason FROM events""")
def p13_schema(spark, sf_dir):
    """Whether a JSON object has exactly the keys that it should."""
    return table(spark, sf_dir, "events").select("event_id", validation.key_reason(F.json_object_keys("props"), ["k"]).alias("reason"))


@query("p14_canonical", r"""
WITH t AS (SELECT doc_id, trim(lang) AS lang, trim(source) AS source, regexp_replace(regexp_replace(text, '^[\s\x0B]+', ''), '[\s\x0B]+$', '') AS text FROM documents)
SELECT doc_id, lang, source, sha256(text) AS text_hash FROM t WHERE lang <> '' AND source <> '' AND text <> ''""")
def p14_canonical(spark, sf_dir):
    """Records whose fields, without white space at their ends, are all there."""
    own = validation.canonical(table(spark, sf_dir, "documents"), ["lang", "source", "text"])
    return own.select("doc_id", "lang", "source", X.sha(F.col("text")).alias("text_hash"))


@query("p16_run_class", """
WITH r AS (SELECT DISTINCT lower(concat(event_type, '-Run-', user_id)) AS run FROM events)
SELECT run, CASE WHEN contains(run, 'signup') THEN 'none' WHEN contains(run, 'purchase') THEN 'sft' WHEN contains(run, 'view') OR contains(run, 'click') THEN 'pretrained' ELSE 'none' END AS kind FROM r""")
def p16_run_class(spark, sf_dir):
    """Runs by what their id holds, some left out."""
    run = F.lower(F.concat("event_type", F.lit("-Run-"), "user_id"))
    own = table(spark, sf_dir, "events").select(run.alias("run")).distinct()
    return own.select("run", F.coalesce(validation.run_kind(F.col("run"), ["signup"], {"sft": ["purchase"], "pretrained": ["view", "click"]}), F.lit("none")).alias("kind"))


@query("p17_valid", """
SELECT event_type, CAST(count(*) AS BIGINT) AS results, CAST(count_if(value IS NOT NULL AND value >= 0 AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL AND event_type IN ('view', 'click', 'purchase')) AS BIGINT) AS valid
FROM events GROUP BY event_type""")
def p17_valid(spark, sf_dir):
    """Results that a mode accepts: a known mode, a figure, and a payload that parses."""
    good = F.col("value").isNotNull() & (F.col("value") >= 0) & F.get_json_object("props", "$.k").try_cast("long").isNotNull() & F.col("event_type").isin("view", "click", "purchase")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("results"), F.count_if(good).alias("valid"))


@query("p18_objective", """
SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 0 AND l.quality IS NOT NULL AND d.lang <> 'es' AND d.doc_id IN (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) = 1)""")
def p18_objective(spark, sf_dir):
    """Cases to judge: scored, not of the kind that is only read, and with an id of their own."""
    own = table(spark, sf_dir, "documents").filter("lang <> 'es'").select("doc_id")
    unique = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n = 1").select("doc_id")
    scored = table(spark, sf_dir, "labels").filter("toxic = 0 AND quality IS NOT NULL").select("doc_id")
    return own.join(unique, "doc_id", "left_semi").join(scored, "doc_id")


@query("p21_partition", """
SELECT item_id, kind FROM (SELECT item_id, CASE WHEN length(text) % 2 = 0 THEN 'diagnostic' ELSE 'qualification' END AS kind, row_number() OVER (PARTITION BY length(text) % 2 ORDER BY sha256(concat('17:', item_id)), item_id) AS r FROM benchmark) WHERE r <= 10""")
def p21_partition(spark, sf_dir):
    """Ten cases of each partition, the first in a seeded order."""
    own = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.length("text") % 2 == 0, "diagnostic").otherwise("qualification").alias("kind"), X.ordered_hash(F.lit("17"), F.col("item_id")).alias("k"))
    return selection.smallest(own, "kind", ["k", "item_id"], 10).select("item_id", "kind")


@query("s19_domain", "SELECT doc_id, n_chars FROM documents WHERE trim(lang) = 'de'")
def s19_domain(spark, sf_dir):
    """One domain's rows; the filter reaches the scan."""
    return table(spark, sf_dir, "documents").filter(F.trim("lang") == "de").select("doc_id", "n_chars")


@query("t09_early_stop", "SELECT lang, CAST(count(*) AS BIGINT) AS \"rows\" FROM (SELECT lang FROM documents ORDER BY doc_id LIMIT 150) GROUP BY lang")
def t09_early_stop(spark, sf_dir):
    """What the first 150 source rows hold; the stop is the feature."""
    return table(spark, sf_dir, "documents").orderBy("doc_id").limit(150).groupBy("lang").agg(F.count("*").alias("rows"))


@query("j09_scored", r"""
WITH a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'assistant'),
c AS (SELECT item_id, regexp_extract(lower(text), '[a-z]+') AS answer FROM benchmark)
SELECT item_id, contains(lower(a.text), answer) AS correct, CAST(length(a.text) AS INTEGER) AS chars FROM c JOIN a ON a.conv_id = c.item_id AND r = 1""")
def j09_scored(spark, sf_dir):
    """Last answers against the cases of the same number: whether they hold the case's first word."""
    answers = table(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"))
    cases = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("expected"))
    met = cases.join(answers, F.col("item_id") == F.col("conv_id"))
    return met.select("item_id", F.contains(F.lower("answer"), F.col("expected")).alias("correct"), F.length("answer").alias("chars"))


@query("j11_deltas", """
WITH m AS (SELECT user_id % 2 AS arm, event_type, user_id // 2 AS cell, avg(value) AS v FROM events GROUP BY ALL)
SELECT t.event_type, t.cell, round(t.v - p.v, 6) AS delta FROM m t JOIN m p ON p.event_type = t.event_type AND p.cell = t.cell WHERE t.arm = 1 AND p.arm = 0""")
def j11_deltas(spark, sf_dir):
    """Means of cells that both arms have, the tuned one's against the parent's."""
    cells = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 2).alias("arm"), "event_type", F.floor(F.col("user_id") / 2).alias("cell")).agg(F.avg("value").alias("v"))
    parent = cells.filter("arm = 0").select("event_type", "cell", F.col("v").alias("base"))
    return cells.filter("arm = 1").join(parent, ["event_type", "cell"]).select("event_type", "cell", F.round(F.col("v") - F.col("base"), 6).alias("delta"))


@query("j14_weighted", f"""
WITH {SCORED}, {DOCS}, l AS (SELECT cluster, avg(loss) AS l FROM tokens GROUP BY cluster), w AS (SELECT cluster % 4 AS cluster, sum(n) AS w FROM docs GROUP BY 1)
SELECT round(sum(l * w) / sum(w), 6) AS weighted_loss, CAST(count(*) AS BIGINT) AS clusters FROM l JOIN w USING (cluster)""")
def j14_weighted(spark, sf_dir):
    """Mean loss of clusters by the corpus's own weights."""
    losses = tokens(spark, sf_dir).groupBy("cluster").agg(F.avg("loss").alias("l"))
    weights = docs(spark, sf_dir).groupBy((F.col("cluster") % 4).alias("cluster")).agg(F.sum("n").alias("w"))
    return losses.join(weights, "cluster").agg(F.round(F.sum(F.col("l") * F.col("w")) / F.sum("w"), 6).alias("weighted_loss"), F.count("*").alias("clusters"))


@query("j17_models", """
WITH m AS (SELECT source AS label, lang, min(doc_id) AS first FROM documents GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY first) AS r FROM m)
SELECT CASE WHEN r = 1 THEN label ELSE concat(label, '-', first, '-', lang) END AS label, lang, r > 1 AS renamed FROM p""")
def j17_models(spark, sf_dir):
    """Models in the order in which they are met, those whose label is taken under a longer one."""
    own = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("label"), "lang").agg(F.min("doc_id").alias("first"))
    taken = own.groupBy("label").agg(F.min("first").alias("owner"))
    met = own.join(taken, "label")
    longer = S.slug(F.concat_ws("-", "label", "first", "lang"))
    return met.select(F.when(F.col("first") == F.col("owner"), F.col("label")).otherwise(longer).alias("label"), "lang", (F.col("first") != F.col("owner")).alias("renamed"))


@query("a06_totals", f"""
WITH {DOCS}, s AS (SELECT lang, cluster, n, CASE WHEN b < 9500 THEN 'train' WHEN b < 9750 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, CAST(concat('0x', substr(sha256(concat('17:', doc_id)), 1, 16)) AS UBIGINT) % 10000 AS b FROM docs))
SELECT coalesce(split, 'all') AS split, coalesce(lang, 'all') AS lang, CAST(coalesce(cluster, 0) AS INTEGER) AS cluster, CAST(sum(n) AS BIGINT) AS tokens FROM s GROUP BY GROUPING SETS ((split), (lang), (cluster), ())""")
def a06_totals(spark, sf_dir):
    """Tokens by split, by source and by cluster, and in all, which each of the three has to add up to."""
    own = docs(spark, sf_dir).select("lang", "cluster", "n", X.identity_split(F.col("doc_id").cast("string")).alias("split"))
    sets = own.groupingSets([["split"], ["lang"], ["cluster"], []], "split", "lang", "cluster").agg(F.sum("n").alias("tokens"))
    return sets.select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("cluster", F.lit(0)).alias("cluster"), "tokens")


@query("a08_sft_totals", f"""
WITH t AS (SELECT conv_id, turn, role, len({TOKENS}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
c AS (SELECT conv_id, arg_min(role, turn) AS source, 1 + sum(3 + n + CASE WHEN i > 1 THEN 1 ELSE 0 END) AS tokens, sum(CASE WHEN role = 'assistant' THEN n + 1 ELSE 0 END) AS targets FROM t GROUP BY conv_id)
SELECT source, CAST(count(*) AS BIGINT) AS records, CAST(sum(targets) AS BIGINT) AS targets, CAST(sum(tokens) AS BIGINT) AS serialized, CAST(min(tokens) AS BIGINT) AS shortest, CAST(max(tokens) AS BIGINT) AS longest FROM c GROUP BY source""")
def a08_sft_totals(spark, sf_dir):
    """Records, learnt and serialised tokens by source, for which the role that begins stands, with the shortest and the longest."""
    own = chat.serialised(chat.conversations(table(spark, sf_dir, "conversations")))
    own = own.select(F.get("messages.role", F.lit(0)).alias("source"), F.size("tokens").cast("long").alias("tokens"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("targets"))
    return own.groupBy("source").agg(
        F.count("*").alias("records"), F.sum("targets").alias("targets"), F.sum("tokens").alias("serialized"), F.min("tokens").alias("shortest"), F.max("tokens").alias("longest")
    )


@query("a23_skills", """
WITH r AS (SELECT event_type AS skill, user_id, avg((value > 50)::INT) AS a, count(*) AS n FROM events GROUP BY ALL)
SELECT skill, CAST(count(*) AS BIGINT) AS runs, CAST(sum(n) AS BIGINT) AS cases, round(avg(a), 9) AS pass_at_1, round(sum(a * n) / sum(n), 9) AS accuracy FROM r GROUP BY skill""")
def a23_skills(spark, sf_dir):
    """Accuracy by skill over all cases, and its mean over runs."""
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("skill"), "user_id").agg(F.avg((F.col("value") > 50).cast("int")).alias("a"), F.count("*").alias("n"))
    return runs.groupBy("skill").agg(
        F.count("*").alias("runs"), F.sum("n").alias("cases"), F.round(F.avg("a"), 9).alias("pass_at_1"), F.round(F.sum(F.col("a") * F.col("n")) / F.sum("n"), 9).alias("accuracy")
    )


@query("a24_families", """
SELECT lang AS family, CAST(count(*) AS BIGINT) AS judged, CAST(count_if(quality = 1 AND toxic = 0) AS BIGINT) AS passed, round(avg(quality), 9) AS quality_rate, round(avg(toxic), 9) AS toxic_rate
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def a24_families(spark, sf_dir):
    """Verdicts by family."""
    met = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return met.groupBy(F.col("lang").alias("family")).agg(
        F.count("*").alias("judged"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"), F.round(F.avg("quality"), 9).alias("quality_rate"), F.round(F.avg("toxic"), 9).alias("toxic_rate")
    )


@query("a25_structure", r"""
WITH t AS (SELECT item_id, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM benchmark)
SELECT CAST(count(*) AS BIGINT) AS cases, CAST(count(DISTINCT text) AS BIGINT) AS texts, CAST(count_if(n = 0) AS BIGINT) AS blank, round(avg(n), 6) AS mean_tokens, CAST(min(n) AS BIGINT) AS shortest, CAST(max(n) AS BIGINT) AS longest FROM t""")
def a25_structure(spark, sf_dir):
    """How a suite of prompts is made up."""
    own = table(spark, sf_dir, "benchmark").select("text", X.word_count(F.col("text")).alias("n"))
    return own.agg(
        F.count("*").alias("cases"), F.countDistinct("text").alias("texts"), F.count_if(F.col("n") == 0).alias("blank"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.min("n").alias("shortest"), F.max("n").alias("longest")
    )


@query("a31_usage", """
SELECT user_id, k AS counter, CAST(sum(CAST(json_extract_string(props, k) AS BIGINT)) AS BIGINT) AS used FROM (SELECT user_id, props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL""")
def a31_usage(spark, sf_dir):
    """Counters of all calls, summed by name for each client."""
    own = table(spark, sf_dir, "events").select("user_id", F.explode(F.from_json("props", "map<string,long>")).alias("counter", "n"))
    return own.groupBy("user_id", "counter").agg(F.sum("n").alias("used"))


@query("a34_lengths", f"WITH {DOCS} SELECT lang, CAST(min(n) AS BIGINT) AS shortest, CAST(max(n) AS BIGINT) AS longest, CAST(sum(n) AS BIGINT) AS tokens, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM docs GROUP BY lang")
def a34_lengths(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum("n").alias("tokens"), F.countDistinct("source").alias("sources"))


@query("a35_histogram", f"WITH {DOCS} SELECT CASE WHEN n = 0 THEN -1 ELSE length(bin(n)) - 1 END AS bucket, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS tokens FROM docs GROUP BY 1")
def a35_histogram(spark, sf_dir):
    """Documents by the power of two that their length reaches."""
    bucket = F.when(F.col("n") == 0, -1).otherwise(F.length(F.bin("n")) - 1).cast("long")
    return docs(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))


@query("k10_report", rf"""
WITH {DOCS}, t AS (SELECT source, count(*) AS d, sum(n) AS n, min(text) AS sample FROM docs GROUP BY source), c AS (SELECT *, trim(regexp_replace(sample, '[\s\x0B]+', ' ', 'g')) AS s FROM t)
SELECT source, concat('| ', source, ' | ', d, ' | ', n, ' | ', replace(CASE WHEN length(s) > 60 THEN concat(substr(s, 1, 59), '…') ELSE s END, '|', '\|'), ' |') AS line FROM c""")
def k10_report(spark, sf_dir):
    """A line of a table for each source: its documents, tokens and a sample, safe to print."""
    own = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.min("text").alias("sample"))
    cells = F.concat_ws(" | ", "source", "d", "n", S.markdown_cell(F.col("sample"), 60))
    return own.select("source", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


@query("x15_self_hash", """
SELECT doc_id, sha256(concat('{"doc_id":', doc_id, ',"lang":"', lang, '","n_chars":', n_chars, ',"source":"', source, '"}')) AS self_hash FROM documents""")
def x15_self_hash(spark, sf_dir):
    """A row's identity: the digest of its canonical JSON, keys in order and nothing between."""
    number = lambda c: F.col(c).cast("string")
    parts = {"source": X.json_string(F.col("source")), "lang": X.json_string(F.col("lang")), "doc_id": number("doc_id"), "n_chars": number("n_chars")}
    return table(spark, sf_dir, "documents").select("doc_id", X.sha(X.canonical_json(parts)).alias("self_hash"))


@query("x23_snippet", r"""
WITH d AS (SELECT doc_id, text, length(text) // 2 AS p FROM documents WHERE text <> ''),
s AS (SELECT doc_id, text, p - length(regexp_extract(substr(text, 1, p), '[\p{L}\p{N}_''’]*$')) AS a, p + length(regexp_extract(substr(text, p + 1), '^[\p{L}\p{N}_''’]*')) AS b FROM d),
w AS (SELECT *, greatest(0, a - 120) AS f, least(length(text), b + 80) AS t FROM s)
SELECT doc_id, concat(CASE WHEN f > 0 THEN '...' ELSE '' END, trim(regexp_replace(concat(substr(text, f + 1, a - f), '[', substr(text, a + 1, b - a), ']', substr(text, b + 1, t - b)), '[\s\x0B]+', ' ', 'g')), CASE WHEN t < length(text) THEN '...' ELSE '' END) AS snippet FROM w""")
def x23_snippet(spark, sf_dir):
    """The word in the middle of every text in brackets, with what stands around it."""
    own = table(spark, sf_dir, "documents").filter("text <> ''")
    middle = F.floor(F.length("text") / 2).cast("int")
    return own.select("doc_id", X.snippet(F.col("text"), middle, middle).alias("snippet"))


@query("x29_cleaned", """
WITH t AS (SELECT event_id, props, CASE event_id % 4 WHEN 0 THEN concat('```json', chr(10), '[', props, ']', chr(10), '```') WHEN 1 THEN concat('```', chr(10), '[', props, ']', chr(10), '```', chr(10)) WHEN 2 THEN concat(' [', props, ']') ELSE concat('```', props) END AS t FROM events)
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN concat('[', props, ']') ELSE 'none' END AS payload FROM t""")
def x29_cleaned(spark, sf_dir):
    """JSON lists out of answers that may be fenced as code; what is no list is none."""
    own = table(spark, sf_dir, "events")
    kinds = [F.concat(F.lit("```json\n["), "props", F.lit("]\n```")), F.concat(F.lit("```\n["), "props", F.lit("]\n```\n")), F.concat(F.lit(" ["), "props", F.lit("]")), F.concat(F.lit("```"), "props")]
    made = F.element_at(F.array(*kinds), (F.col("event_id") % 4 + 1).cast("int"))
    return own.select("event_id", F.coalesce(X.json_list(made), F.lit("none")).alias("payload"))


@query("x38_case_text", """
SELECT item_id, level, length(concat(text, CASE level WHEN 0 THEN '' WHEN 1 THEN concat(chr(10), 'Reply with the answer only.') WHEN 2 THEN concat(chr(10), 'Reply on one line: Answer: <answer>') ELSE concat(chr(10), 'Reply on two lines: Answer: <answer>', chr(10), 'Done: yes') END)) AS chars
FROM (SELECT item_id, text, unnest([0, 1, 2, 3]) AS level FROM benchmark)""")
def x38_case_text(spark, sf_dir):
    """Every case at every level, with what the level asks for."""
    asks = ["", "\nReply with the answer only.", "\nReply on one line: Answer: <answer>", "\nReply on two lines: Answer: <answer>\nDone: yes"]
    own = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, range(4)))).alias("level"))
    whole = F.concat("text", F.element_at(F.array(*map(F.lit, asks)), F.col("level") + 1))
    return own.select("item_id", "level", F.length(whole).cast("long").alias("chars"))


@query("v03_eval_verify", f"""
WITH {DOCS}, c AS (SELECT cluster, count(*) AS d, sum(n) AS n, count(DISTINCT doc_id) AS u FROM docs GROUP BY cluster),
p AS (SELECT cluster, CASE WHEN cluster = 11 THEN 'cluster_not_allowed' END AS a, CASE WHEN d < 10 THEN 'too_few_documents' END AS b, CASE WHEN n < 20000 THEN 'too_few_targets' END AS c, CASE WHEN u <> d THEN 'repeated_documents' END AS e FROM c)
SELECT cluster, unnest(list_filter([a, b, c, e], lambda x: x IS NOT NULL)) AS problem FROM p""")
def v03_eval_verify(spark, sf_dir):
    """What is wrong with an evaluation corpus, cluster by cluster."""
    own = docs(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.countDistinct("doc_id").alias("u"))
    return verify.problems(own, ["cluster"], {
        "cluster_not_allowed": ~F.col("cluster").isin(*validation.ACCEPTED_CLUSTERS), "too_few_documents": F.col("d") < 10, "too_few_targets": F.col("n") < 20_000, "repeated_documents": F.col("u") != F.col("d"),
    })


@query("v05_prepared", """
SELECT doc_id, unnest(list_filter([CASE WHEN n_chars <> length(text) THEN 'size' END, CASE WHEN trim(text) = '' THEN 'blank' END, CASE WHEN strlen(text) > 4 * n_chars THEN 'bytes' END], lambda x: x IS NOT NULL)) AS problem FROM documents""")
def v05_prepared(spark, sf_dir):
    """Prepared texts against what is recorded of them."""
    return verify.problems(table(spark, sf_dir, "documents"), ["doc_id"], {
        "size": F.col("n_chars") != F.length("text"), "blank": F.trim("text") == "", "bytes": F.octet_length("text") > 4 * F.col("n_chars"),
    })


@query("v08_listed", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM (SELECT doc_id FROM documents WHERE n_chars > 800) d FULL JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def v08_listed(spark, sf_dir):
    """Longer documents, which a manifest lists, against the labels, which are there."""
    listed, actual = table(spark, sf_dir, "documents").filter("n_chars > 800").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return verify.differences(listed, actual, ["doc_id"], [])


@query("v11_counters", f"""
WITH {DOCS}, t AS (SELECT cluster, doc_id // 50 AS shard, sum(n) AS n FROM docs GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY cluster ORDER BY shard) AS c FROM t)
SELECT cluster, CAST(max(c) AS BIGINT) AS cumulative, CAST(sum(n) AS BIGINT) AS total, max(c) = sum(n) AS consistent FROM c GROUP BY cluster""")
def v11_counters(spark, sf_dir):
    """Whether each cluster's last cumulative counter is the sum of its shards'."""
    own = sizes(spark, sf_dir).groupBy("cluster", F.floor(F.col("doc_id") / 50).alias("shard")).agg(F.sum("n").alias("n"))
    placed = running(own, ["cluster"], ["shard"], ["n"]).withColumn("c", F.col("before_n") + F.col("n"))
    return placed.groupBy("cluster").agg(F.max("c").alias("cumulative"), F.sum("n").alias("total")).withColumn("consistent", F.col("cumulative") == F.col("total"))


@query("v12_shape", """
SELECT 'documents' AS part, CAST(count(*) AS BIGINT) AS "rows", CAST(count_if(doc_id IS NULL OR text IS NULL) AS BIGINT) AS nulls, CAST(count(DISTINCT doc_id) AS BIGINT) AS ids FROM documents
UNION ALL SELECT 'labels' AS part, count(*), CAST(count_if(doc_id IS NULL OR quality IS NULL) AS BIGINT), count(DISTINCT doc_id) FROM labels UNION ALL SELECT 'conversations' AS part, count(*), CAST(count_if(conv_id IS NULL OR text IS NULL) AS BIGINT), count(DISTINCT conv_id) FROM conversations""")
def v12_shape(spark, sf_dir):
    """Rows, nulls and ids of what is about to be published."""
    def part(name: str, key: str, value: str):
        own = table(spark, sf_dir, name)
        return own.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull() | F.col(value).isNull()).alias("nulls"), F.countDistinct(key).alias("ids")).select(F.lit(name).alias("part"), "rows", "nulls", "ids")

    return part("documents", "doc_id", "text").unionByName(part("labels", "doc_id", "quality")).unionByName(part("conversations", "conv_id", "text"))


@query("v14_cursors", """
WITH c AS (SELECT lang, max(l.doc_id) AS cursor FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang), e AS (SELECT lang, max(doc_id) AS last FROM documents GROUP BY lang)
SELECT e.lang, coalesce(cursor, -1) AS cursor, last, cursor IS NOT NULL AND cursor <= last AS in_range FROM e JOIN c ON e.lang = c.lang""")
def v14_cursors(spark, sf_dir):
    """Each reader's cursor, the last labelled document, against the end of its file."""
    own = table(spark, sf_dir, "documents").select("doc_id", "lang")
    marked = own.join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("mark")), "doc_id", "left")
    ends = marked.groupBy("lang").agg(F.max(F.when(F.col("mark") == 1, F.col("doc_id"))).alias("c"), F.max("doc_id").alias("last"))
    return ends.select("lang", F.coalesce("c", F.lit(-1)).alias("cursor"), "last", (F.col("c").isNotNull() & (F.col("c") <= F.col("last"))).alias("in_range"))


@query("o01_profiles", """
SELECT c_custkey, coalesce(CASE WHEN n_nationkey % 5 <> 0 THEN r_name END, n_name) AS profile FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def o01_profiles(spark, sf_dir):
    """Names resolved to the profile that they are an alias of; some are profiles themselves."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    canonical = nations.select("n_nationkey", F.coalesce(F.when(F.col("n_nationkey") % 5 != 0, F.col("r_name")), F.col("n_name")).alias("profile"))
    return table(spark, sf_dir, "customer").join(canonical, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "profile")


@query("o06_anchored", f"""
WITH {DOCS}, b AS (SELECT n, row_number() OVER (ORDER BY doc_id) AS step, count(*) OVER () AS c FROM docs WHERE n > 0),
s AS (SELECT sum(n) AS total, sum(CASE WHEN step <= c // 50 THEN n ELSE 0 END) AS warm, sum(CASE WHEN step <= c // 2 THEN n ELSE 0 END) AS peak, sum(CASE WHEN step <= c // 2 + c // 25 THEN n ELSE 0 END) AS settle FROM b),
d AS (SELECT *, greatest(1, CAST(floor(total * 0.04::DOUBLE) AS BIGINT)) AS decay FROM s)
SELECT CAST(total AS BIGINT) AS total_tokens, CAST(warm AS BIGINT) AS warmup_tokens, CAST(peak - warm AS BIGINT) AS peak_tokens, CAST(settle - peak AS BIGINT) AS settle_tokens, CAST(decay AS BIGINT) AS decay_tokens, CAST(total - decay AS BIGINT) AS cooldown_start,
       round(ln(0.8::DOUBLE / 0.3::DOUBLE) / ln((total - decay) / settle::DOUBLE), 9) AS power FROM d""")
def o06_anchored(spark, sf_dir):
    """A schedule in tokens from anchors in steps: a fiftieth to warm up, half until the peak ends, a twenty-fifth to settle, and the last 4 per cent to cool down."""
    placed = running(sizes(spark, sf_dir).filter("n > 0").select("doc_id", "n"), [], ["doc_id"])
    count = placed.agg(F.count("*").alias("c"))
    upto = lambda bar: F.sum(F.when(F.col("number") <= bar, F.col("n")).otherwise(0))
    c = F.col("c")
    own = placed.crossJoin(F.broadcast(count)).agg(
        F.sum("n").alias("total"), upto(F.floor(c / 50)).alias("warm"), upto(F.floor(c / 2)).alias("peak"), upto(F.floor(c / 2) + F.floor(c / 25)).alias("settle")
    ).withColumn("decay", F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(0.04))))
    start = F.col("total") - F.col("decay")
    return own.select(
        F.col("total").alias("total_tokens"), F.col("warm").alias("warmup_tokens"), (F.col("peak") - F.col("warm")).alias("peak_tokens"), (F.col("settle") - F.col("peak")).alias("settle_tokens"),
        F.col("decay").alias("decay_tokens"), start.alias("cooldown_start"), F.round(F.ln(F.lit(0.8) / F.lit(0.3)) / F.ln(start / F.col("settle")), 9).alias("power"),
    )


@query("o08_publication", f"""
WITH {DOCS}, s AS (SELECT lang, n, CASE WHEN b < 9500 THEN 'train' WHEN b < 9750 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, CAST(concat('0x', substr(sha256(concat('17:', doc_id)), 1, 16)) AS UBIGINT) % 10000 AS b FROM docs))
SELECT concat(split, '/', lang, '-00000.bin') AS filename, split, CAST(sum(n + 1) * 2 AS BIGINT) AS byte_size FROM s GROUP BY split, lang""")
def o08_publication(spark, sf_dir):
    """One manifest from those of the splits, each split before its file's name."""
    own = docs(spark, sf_dir).select("lang", "n", X.identity_split(F.col("doc_id").cast("string")).alias("split"))
    files = own.groupBy("split", "lang").agg((F.sum(F.col("n") + 1) * 2).alias("byte_size"))
    return files.select(F.concat("split", F.lit("/"), "lang", F.lit("-00000.bin")).alias("filename"), "split", "byte_size")


@query("o09_discovery", "SELECT source, min(doc_id) AS doc_id FROM documents WHERE lang = 'es' GROUP BY source HAVING count(*) = 1")
def o09_discovery(spark, sf_dir):
    """The candidate of each place that has exactly one."""
    return table(spark, sf_dir, "documents").filter("lang = 'es'").groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query("o14_budget", """
WITH r AS (SELECT user_id, max(epoch(ts)) - min(epoch(ts)) AS s, sum(value) AS v FROM events GROUP BY user_id)
SELECT user_id, CAST(floor(s / 3600) AS BIGINT) AS hours, CAST(CAST(floor(s / 3600) AS BIGINT) * 0.35::DECIMAL(6, 2) AS DOUBLE) AS cost, CASE WHEN floor(s / 3600) * 0.35 > 240 THEN 'stop' WHEN floor(s / 3600) * 0.35 > 200 THEN 'warn' ELSE 'run' END AS decision FROM r""")
def o14_budget(spark, sf_dir):
    """Whole hours since each run began, what they cost, and what follows."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1_000_000
    own = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id").agg(F.floor(span / 3600).alias("hours"))
    cost = (F.col("hours") * F.lit("0.35").cast("decimal(6,2)")).cast("double")
    return own.select("user_id", "hours", cost.alias("cost"), F.when(cost > 240, "stop").when(cost > 200, "warn").otherwise("run").alias("decision"))


@query("o15_next_block", "SELECT user_id, CAST(count(*) AS BIGINT) AS next_block, CAST(count(*) // 15 AS BIGINT) AS shard, CAST(count(*) // 15 + 1 AS BIGINT) AS successor, count(*) % 15 >= 12 AS stage FROM events GROUP BY user_id")
def o15_next_block(spark, sf_dir):
    """The block that comes after all completed steps, its shard and the next, and whether to stage that now."""
    n = F.count("*")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("next_block"), F.floor(n / 15).alias("shard"), (F.floor(n / 15) + 1).alias("successor"), (n % 15 >= 12).alias("stage"))


@query("st02_acks", """
SELECT user_id, event_id, before FROM (SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY value, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE event_id < before""")
def st02_acks(spark, sf_dir):
    """Acknowledgements, in order of a figure, that fall behind an earlier one."""
    own = running_max(table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts"), ["user_id"], ["value", "ts", "event_id"], "event_id")
    return own.filter(F.col("event_id") < F.col("before")).select("user_id", "event_id", "before")


@query("st03_replay", """
WITH c AS (SELECT lang, max(l.doc_id) AS cursor FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0 GROUP BY lang)
SELECT d.doc_id, d.lang FROM documents d LEFT JOIN c ON d.lang = c.lang WHERE cursor IS NULL OR d.doc_id > cursor""")
def st03_replay(spark, sf_dir):
    """What is left to read of each file after its cursor, the last document of poor quality."""
    own = table(spark, sf_dir, "documents").select("doc_id", "lang")
    poor = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    cursors = own.join(poor, "doc_id", "left_semi").groupBy(F.col("lang").alias("l")).agg(F.max("doc_id").alias("cursor"))
    return own.join(cursors, F.col("lang") == F.col("l"), "left").filter(F.col("cursor").isNull() | (F.col("doc_id") > F.col("cursor"))).select("doc_id", "lang")


@query("st11_cadence", f"""
WITH {DOCS}, p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, sum(n) OVER (ORDER BY doc_id) AS t, n FROM docs)
SELECT doc_id, r % 40 = 0 AS by_documents, t // 10000 > (t - n) // 10000 AS by_tokens FROM p WHERE r % 40 = 0 OR t // 10000 > (t - n) // 10000""")
def st11_cadence(spark, sf_dir):
    """Where a checkpoint is due: after every 40 documents, and with every 10,000 tokens."""
    placed = running(sizes(spark, sf_dir).select("doc_id", "n"), [], ["doc_id"], ["n"])
    by_documents = F.col("number") % 40 == 0
    by_tokens = F.floor((F.col("before_n") + F.col("n")) / 10_000) > F.floor(F.col("before_n") / 10_000)
    return placed.filter(by_documents | by_tokens).select("doc_id", by_documents.alias("by_documents"), by_tokens.alias("by_tokens"))


@query("st15_activity", """
WITH a AS (SELECT user_id % 10 AS run, event_type AS task, max(epoch(ts)) - max(greatest(epoch(TIMESTAMP '2024-01-10'), (SELECT min(epoch(ts)) FROM events))) AS s FROM events WHERE value > 10 GROUP BY ALL)
SELECT run, CAST(floor(greatest(max(s), 0)) AS BIGINT) AS seconds FROM a GROUP BY run""")
def st15_activity(spark, sf_dir):
    """Seconds that a run has been active since a reset: the most of its tasks."""
    reset = F.unix_micros(F.lit("2024-01-10 00:00:00").cast("timestamp"))
    own = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    begun = own.agg(F.greatest(reset, F.min("us")).alias("begun"))
    tasks = own.filter("value > 10").groupBy((F.col("user_id") % 10).alias("run"), "event_type").agg(F.max("us").alias("last"))
    return tasks.crossJoin(F.broadcast(begun)).groupBy("run").agg(F.floor(F.greatest(F.max(F.col("last") - F.col("begun")), F.lit(0)) / 1_000_000).alias("seconds"))


@query("p15_keep", "SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def p15_keep(spark, sf_dir):
    """Candidates that curation keeps."""
    keep = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(keep, "doc_id", "left_semi")


@query("x05_probe", r"SELECT conv_id, turn, replace(lower(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'))), 'ß', 'ss') AS probe FROM conversations")
def x05_probe(spark, sf_dir):
    """Turns in the form in which they are looked for."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.folded(F.col("text")).alias("probe"))


@query("x09_tokens", f"SELECT conv_id, turn, CAST(len({TOKENS}) AS INTEGER) AS tokens, CAST(coalesce(list_max([length(x) FOR x IN {TOKENS}]), 0) AS INTEGER) AS longest FROM conversations")
def x09_tokens(spark, sf_dir):
    """Tokens of every turn by the default encoder, and the longest of them."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.words(F.col("text")).alias("t"))
    return own.select("conv_id", "turn", F.size("t").alias("tokens"), F.coalesce(F.array_max(F.transform("t", F.length)), F.lit(0)).alias("longest"))


@query("x14_digests", "SELECT page_id, sha256(html) AS html_hash, sha256(url) AS url_hash FROM pages")
def x14_digests(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.sha(F.col("html")).alias("html_hash"), X.sha(F.col("url")).alias("url_hash"))


@query("v07_coverage", """
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_durable' ELSE 'not_listed' END AS problem FROM (SELECT doc_id, 1 AS d FROM documents WHERE lang = 'en' AND n_chars > 2500) d FULL JOIN (SELECT doc_id, 1 AS l FROM labels WHERE quality = 0) l USING (doc_id) WHERE d IS NULL OR l IS NULL""".replace("l.doc_id IS NULL", "l IS NULL"))
def v07_coverage(spark, sf_dir):
    """Long English documents, which have to be durable, against those marked so, which stand for an inventory."""
    listed = table(spark, sf_dir, "documents").filter("lang = 'en' AND n_chars > 2500").select("doc_id")
    stored = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    found = verify.differences(listed, stored, ["doc_id"], [])
    return found.select("doc_id", F.when(F.col("problem") == "missing", "not_durable").otherwise("not_listed").alias("problem"))


@query("v10_drift", """
WITH c AS (SELECT lang, count(*) AS seen, count(DISTINCT source) AS sources, min(n_chars) AS shortest, max(n_chars) AS longest, count_if(text = '') AS blank, sum(n_chars) AS chars, count(DISTINCT text) AS texts FROM documents GROUP BY lang),
l AS (SELECT lang, counter, v FROM c UNPIVOT (v FOR counter IN (seen, sources, shortest, longest, blank, chars, texts)))
SELECT a.counter, CAST(a.v AS BIGINT) AS value, CAST(b.v AS BIGINT) AS frozen, a.v = b.v AS equal FROM l a JOIN l b USING (counter) WHERE a.lang = 'fr' AND b.lang = 'de'""")
def v10_drift(spark, sf_dir):
    """Seven counters of a corpus, French, against a frozen manifest's, for which German stands."""
    counters = ["seen", "sources", "shortest", "longest", "blank", "chars", "texts"]
    own = table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("seen"), F.countDistinct("source").alias("sources"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.count_if(F.col("text") == "").alias("blank"),
        F.sum("n_chars").alias("chars"), F.countDistinct("text").alias("texts"),
    )
    long = own.unpivot("lang", counters, "counter", "value")
    return verify.drift(long.filter("lang = 'fr'"), long.filter("lang = 'de'"), "counter", "value")


@query("v13_identity", """
SELECT source, sha256(string_agg(concat('{"chars":', c, ',"lang":"', lang, '"}'), ',' ORDER BY lang)) AS identity FROM (SELECT source, lang, sum(n_chars) AS c FROM documents GROUP BY ALL) GROUP BY source""")
def v13_identity(spark, sf_dir):
    """What a build of each source was made of, as a digest that a later run is held against: its parts in order."""
    parts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("c"))
    one = X.canonical_json({"chars": F.col("c").cast("string"), "lang": X.json_string(F.col("lang"))})
    lists = parts.select("source", F.struct("lang", one.alias("j")).alias("x")).groupBy("source").agg(F.sort_array(F.collect_list("x")).alias("l"))
    return lists.select("source", X.sha(F.array_join(F.col("l.j"), ",")).alias("identity"))


@query("o13_inventory", """
WITH lines AS (SELECT source, concat(lang, '/', doc_id, ':', strlen(text), ':', sha256(text)) AS line FROM documents), keyed AS (SELECT source, sha256(line) AS h FROM lines),
buckets AS (SELECT source, substr(h, 1, 4) AS bucket, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM keyed GROUP BY ALL)
SELECT source, sha256(string_agg(concat(bucket, ':', d), chr(10) ORDER BY bucket)) AS digest, CAST(sum(n) AS BIGINT) AS files FROM buckets GROUP BY source""")
def o13_inventory(spark, sf_dir):
    """Files of each tree, and the digest of their paths, sizes and contents."""
    line = F.concat("lang", F.lit("/"), "doc_id", F.lit(":"), F.octet_length("text"), F.lit(":"), X.sha(F.col("text")))
    own = table(spark, sf_dir, "documents").select("source", line.alias("line"))
    return verify.tree_digest(own, ["source"], "line").join(own.groupBy("source").agg(F.count("*").alias("files")), "source")


@query("st13_horizon", f"""
WITH {DOCS}, p AS (SELECT doc_id, sum(n + 1) OVER (ORDER BY doc_id) AS t, n FROM docs), b AS (SELECT *, (t - 1) // {128 * 16} AS block FROM p)
SELECT doc_id, CAST(block AS BIGINT) AS block FROM b WHERE block < 20""")
def st13_horizon(spark, sf_dir):
    """Documents that are whole within a horizon of twenty blocks; production ends there."""
    placed = running(sizes(spark, sf_dir).select("doc_id", (F.col("n") + 1).alias("len")), [], ["doc_id"], ["len"])
    block = F.floor((F.col("before_len") + F.col("len") - 1) / (128 * 16))
    return placed.select("doc_id", block.alias("block")).filter("block < 20")
