"""Queries that prepare training sets end to end, audit them, and plan schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltstone.functions import text as X
from siltstone.functions.ordered import running
from siltstone.functions.scalars import control_tokens, flattened
from siltstone.operators import chat, decontaminate, packing, selection, validation
from siltstone.plans.corpus import CONTEXT, DOCS, FOLDED, PER_BLOCK, docs, sizes
from siltstone.plans.registry import query, table

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


@query("e22_prepare", f"""
WITH own AS (SELECT doc_id, lang, {FOLDED} AS body, sha256({FOLDED}) AS h FROM documents),
placed AS (SELECT *, doc_id = min(doc_id) OVER (PARTITION BY h) AS first FROM own WHERE lang <> 'es'),
probes AS (SELECT {FOLDED} AS probe FROM benchmark),
judged AS (SELECT *, first AND EXISTS (SELECT 1 FROM probes WHERE body = probe OR (length(probe) >= 32 AND contains(body, probe))) AS dirty FROM placed),
split AS (SELECT *, CAST(concat('0x', substr(sha256(concat('17:', h)), 1, 16)) AS UBIGINT) % 10000 AS b FROM judged)
SELECT reason, CAST(count(*) AS BIGINT) AS "rows" FROM (
    SELECT CASE WHEN NOT first THEN 'duplicate' WHEN dirty THEN 'contaminated' WHEN b < 9500 THEN 'train' WHEN b < 9750 THEN 'validation' ELSE 'test' END AS reason FROM split
    UNION ALL SELECT 'unsupported' FROM own WHERE lang = 'es') GROUP BY reason""")
def e22_prepare(spark, sf_dir):
    """Sources, duplicates, contamination and split in that order: a contaminated text still shadows its later copies."""
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", X.folded(F.col("text")).alias("body")).withColumn("h", X.sha(F.col("body")))
    allowed = own.filter("lang <> 'es'")
    unique = selection.first_wins(allowed.select("doc_id", "h"), "h", "doc_id").withColumn("kept", F.lit(True)).drop("h")
    probes = table(spark, sf_dir, "benchmark").select(X.folded(F.col("text")).alias("probe"))
    dirty = decontaminate.contaminated(allowed, probes, "doc_id", "body", "probe").withColumn("dirty", F.lit(True))
    met = allowed.select("doc_id", "h").join(unique, "doc_id", "left").join(dirty, "doc_id", "left")
    reason = F.when(F.col("kept").isNull(), "duplicate").when(F.col("dirty"), "contaminated").otherwise(X.identity_split(F.col("h")))
    counts = met.select(reason.alias("reason")).unionByName(own.filter("lang = 'es'").select(F.lit("unsupported").alias("reason")))
    return counts.groupBy("reason").agg(F.count("*").alias("rows"))


#: Outputs made of documents: some without marks, some unfinished, most with reasoning and answer; in SQL and parsed.
MADE = rf"""made AS (SELECT doc_id, lang AS domain, text AS problem, len({WORDS}) AS n, CASE WHEN doc_id % 7 = 0 THEN text WHEN doc_id % 7 = 1 THEN concat('<think>', text)
    ELSE concat('<think>', substr(text, 1, length(text) // 2), '</think><answer>', substr(text, length(text) // 2 + 1), '</answer>') END AS o FROM documents),
cut AS (SELECT *, regexp_extract(o, '(?s)^<think>(.*?)</think><answer>(.*)</answer>$', ['r', 'a']) AS p FROM made),
parsed AS (SELECT *, regexp_matches(p.r, '[^\s\x0B]') AND regexp_matches(p.a, '[^\s\x0B]') AS good FROM cut)"""


def made_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain, problem, n, p): documents as problems, and outputs made of them, parsed; p is null where that fails."""
    half = F.floor(F.length("text") / 2).cast("int")
    whole = F.concat(F.lit("<think>"), F.substr("text", F.lit(1), half), F.lit("</think><answer>"), F.substr("text", half + 1), F.lit("</answer>"))
    made = F.when(F.col("doc_id") % 7 == 0, F.col("text")).when(F.col("doc_id") % 7 == 1, F.concat(F.lit("<think>"), "text")).otherwise(whole)
    return docs(spark, sf_dir).select("doc_id", F.col("lang").alias("domain"), F.col("text").alias("problem"), "n", X.parsed_output(made).alias("p"))


_MATH = f"(regexp_matches(problem, $$(?is){validation.MATH_TOPIC}$$) OR (regexp_matches(problem, $$(?is){validation.MATH_ACTION}$$) AND regexp_matches(problem, $$(?is){validation.MATH_NOTATION}$$)))"
_CODE = f"(regexp_matches(problem, $$(?is){validation.CODE_LANGUAGE}$$) OR regexp_matches(problem, $$(?is){validation.CODE_TASK}$$) OR regexp_matches(problem, $$(?i){validation.CODE_LITERAL}$$))"


@query("e24_rsft_prepare", f"""
WITH {MADE}, base AS (SELECT {FOLDED} AS h FROM benchmark),
hashed AS (SELECT *, {FOLDED.replace('text', 'problem')} AS h FROM parsed WHERE domain <> 'es'),
placed AS (SELECT *, good AND doc_id = min(CASE WHEN good THEN doc_id END) OVER (PARTITION BY h) AND h NOT IN (SELECT h FROM base) AS first FROM hashed)
SELECT CASE WHEN NOT good THEN 'rejected' WHEN NOT first THEN 'duplicate' WHEN {_MATH} AND {_CODE} THEN 'math_and_code_primary' WHEN {_MATH} THEN 'math_primary' WHEN {_CODE} THEN 'code_primary'
            WHEN contains(problem, '<think>') OR contains(problem, '</think>') OR contains(problem, '<answer>') THEN 'reserved' WHEN n <= 512 THEN 'fit' ELSE 'over_context' END AS route,
       CAST(count(*) AS BIGINT) AS "rows", CAST(sum(n) AS BIGINT) AS tokens FROM placed GROUP BY 1""")
def e24_rsft_prepare(spark, sf_dir):
    """Domain, parse, first-wins against a base and among themselves, exclusion, marks and fit, in that order: an excluded row shadows later copies, a malformed one does not."""
    own = made_outputs(spark, sf_dir).filter("domain <> 'es'").withColumn("h", X.prompt_hash(F.col("problem")))
    base = table(spark, sf_dir, "benchmark").select(X.prompt_hash(F.col("text")).alias("h")).distinct().withColumn("base", F.lit(True))
    firsts = own.filter("p IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("first"))
    met = own.join(firsts, "h", "left").join(base, "h", "left")
    excluded = validation.exclusion_reason(F.col("problem"))
    route = (
        F.when(F.col("p").isNull(), "rejected").when((F.col("doc_id") != F.col("first")) | F.col("base").isNotNull(), "duplicate").when(excluded.isNotNull(), excluded)
        .when(validation.has_reserved(F.col("problem"), F.col("p.reasoning"), F.col("p.answer")), "reserved").when(F.col("n") <= 512, "fit").otherwise("over_context")
    )
    return met.groupBy(route.alias("route")).agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))


@query("e08_shards", f"""
WITH {DOCS}, t AS (SELECT CAST((sum(n + 1) - 1) // {CONTEXT} + 1 AS BIGINT) AS seqs FROM docs), b AS (SELECT unnest(range(0, (seqs - 1) // {PER_BLOCK} + 1)) AS block, seqs FROM t)
SELECT block // 15 AS shard, CAST(count(*) AS BIGINT) AS blocks, min(block) AS first_block, max(block) AS last_block, CAST(sum(least({PER_BLOCK}, seqs - block * {PER_BLOCK})) AS BIGINT) AS sequences FROM b GROUP BY 1""")
def e08_shards(spark, sf_dir):
    """Blocks in shards of fifteen, the last block and shard in part."""
    total = docs(spark, sf_dir).agg(F.sum(F.col("n") + 1).alias("t")).select(packing.sequence_count(F.col("t"), CONTEXT).alias("seqs"))
    blocks = total.select("seqs", F.explode(F.sequence(F.lit(0).cast("long"), packing.block_of(F.col("seqs") - 1, PER_BLOCK))).alias("block"))
    held = F.least(F.lit(PER_BLOCK), F.col("seqs") - F.col("block") * PER_BLOCK)
    return blocks.groupBy(packing.shard_of(F.col("block"), 1, 15).alias("shard")).agg(
        F.count("*").alias("blocks"), F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.sum(held).alias("sequences")
    )


@query("e13_padding", r"""
WITH t AS (SELECT conv_id // 8 AS batch, conv_id, CAST(1 + sum(3 + len(regexp_extract_all(text, '\n|[^\x20\x09-\x0D]+')) + CASE WHEN turn > first THEN 1 ELSE 0 END) AS BIGINT) AS n
    FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) GROUP BY conv_id),
w AS (SELECT *, max(n) OVER (PARTITION BY batch) AS width FROM t)
SELECT conv_id, batch, CAST(width AS BIGINT) AS width, CAST(width - n AS BIGINT) AS padding FROM w""")
def e13_padding(spark, sf_dir):
    """Conversations in batches of eight, padded to the longest."""
    own = chat.serialised(chat.conversations(table(spark, sf_dir, "conversations"))).select("conv_id", F.floor(F.col("conv_id") / 8).alias("batch"), F.size("tokens").cast("long").alias("n"))
    widths = own.groupBy("batch").agg(F.max("n").alias("width"))
    return own.join(widths, "batch").select("conv_id", "batch", "width", (F.col("width") - F.col("n")).alias("padding"))


#: A text t as a JSON string of ASCII characters, in SQL.
JSON_T = r"""concat('"', list_aggregate([CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t'
    WHEN ord(c) BETWEEN 32 AND 126 THEN c WHEN ord(c) < 65536 THEN printf('\u%04x', ord(c))
    ELSE printf('\u%04x\u%04x', (ord(c) - 65536) // 1024 + 55296, (ord(c) - 65536) % 1024 + 56320) END FOR c IN string_split(t, '')], 'string_agg', ''), '"')"""


def _identity(turns: DataFrame, content) -> DataFrame:
    """(conv_id, list): the messages of a conversation as a JSON list, its keys in order."""
    one = F.concat(F.lit('{"content":'), X.json_string(content), F.lit(',"role":'), X.json_string(F.col("role")), F.lit("}"))
    lists = turns.select("conv_id", F.struct("turn", one.alias("m")).alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("l"))
    return lists.select("conv_id", F.concat(F.lit("["), F.array_join(F.col("l.m"), ","), F.lit("]")).alias("list"))


@query("x02_content_hash", rf"""
WITH c AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(regexp_replace(text, '^[\s\x0B]+', ''), '[\s\x0B]+$', ''), '[ \t]*(\r\n|[\n\r\x0B\x0C])', chr(10), 'g') AS t FROM conversations),
j AS (SELECT conv_id, turn, concat('{{"content":', {JSON_T}, ',"role":"', role, '"}}') AS m FROM c)
SELECT conv_id, sha256(concat('{{"messages":[', string_agg(m, ',' ORDER BY turn), ']}}')) AS content_hash FROM j GROUP BY conv_id""")
def x02_content_hash(spark, sf_dir):
    """A conversation's identity: the canonical JSON of its roles and texts, without white space at the ends of texts and lines."""
    own = _identity(table(spark, sf_dir, "conversations"), X.bare_lines(F.col("text")))
    return own.select("conv_id", X.sha(F.concat(F.lit('{"messages":'), "list", F.lit("}"))).alias("content_hash"))


@query("x03_group_id", rf"""
WITH c AS (SELECT conv_id, turn, role, {FOLDED} AS t FROM conversations WHERE role <> 'assistant'),
j AS (SELECT conv_id, turn, concat('{{"content":', {JSON_T}, ',"role":"', role, '"}}') AS m FROM c)
SELECT conv_id, sha256(concat('{{"context":[', string_agg(m, ',' ORDER BY turn), ']}}')) AS group_id FROM j GROUP BY conv_id""")
def x03_group_id(spark, sf_dir):
    """What a conversation asks, whatever is answered: the canonical JSON of its other turns, folded."""
    own = _identity(table(spark, sf_dir, "conversations").filter("role <> 'assistant'"), X.folded(F.col("text")))
    return own.select("conv_id", X.sha(F.concat(F.lit('{"context":'), "list", F.lit("}"))).alias("group_id"))


@query("x19_formats", r"""
WITH c AS (SELECT item_id, text, regexp_extract(text, '[^\x20\x09-\x0D]+') AS answer FROM benchmark), l AS (SELECT *, unnest([0, 1, 2, 3]) AS level FROM c),
r AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS form FROM l),
t AS (SELECT *, CASE form WHEN 0 THEN text WHEN 1 THEN concat(' ', answer, chr(10)) WHEN 2 THEN concat('Answer: ', answer) WHEN 3 THEN concat('Answer: ', answer, chr(10), 'Done: yes') ELSE '' END AS t0 FROM r),
b AS (SELECT *, regexp_replace(regexp_replace(t0, '^[\s\x0B]+', ''), '[\s\x0B]+$', '') AS t FROM t)
SELECT item_id, level, form, t <> '' AND contains(lower(t), lower(answer)) AND CASE level WHEN 0 THEN true WHEN 1 THEN t = answer WHEN 2 THEN NOT contains(t, chr(10)) AND starts_with(t, 'Answer: ') AND t = concat('Answer: ', answer)
    ELSE t = concat('Answer: ', answer, chr(10), 'Done: yes') END AS passed FROM b""")
def x19_formats(spark, sf_dir):
    """Every case's answer, its text's first word, in five forms, against what each level asks for."""
    from siltstone.functions.scalars import format_checks

    answer = F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0)
    own = table(spark, sf_dir, "benchmark").select("item_id", "text", answer.alias("answer")).withColumn("level", F.explode(F.array(*map(F.lit, range(4)))))
    forms = F.array(F.col("text"), F.concat(F.lit(" "), "answer", F.lit("\n")), F.concat(F.lit("Answer: "), "answer"), F.concat(F.lit("Answer: "), "answer", F.lit("\nDone: yes")), F.lit(""))
    each = own.select("item_id", "answer", "level", F.posexplode(forms).alias("form", "said"))
    return each.select("item_id", "level", "form", format_checks(F.col("said"), F.col("answer"), F.col("level"))["passed"].alias("passed"))


@query("x27_flatten", """
WITH d AS (SELECT event_id, event_type, user_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, 'event/kind' AS path, event_type AS value FROM d UNION ALL SELECT event_id, 'event/by/user' AS path, CAST(user_id AS VARCHAR) AS value FROM d UNION ALL SELECT event_id, 'props/k' AS path, k AS value FROM d
UNION ALL SELECT event_id, 'id' AS path, CAST(event_id AS VARCHAR) AS value FROM d""")
def x27_flatten(spark, sf_dir):
    """Objects within objects as paths, a row for each value that is none."""
    kind = F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user")).alias("by"))
    raw = F.concat(F.lit('{"event":'), F.to_json(kind), F.lit(',"props":'), "props", F.lit(',"id":'), "event_id", F.lit("}"))
    return flattened(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), ["event_id"], "raw")


@query("x35_planned", f"WITH {DOCS} SELECT cluster, CAST(ceil(sum(n) / ({CONTEXT * PER_BLOCK})::DOUBLE) AS BIGINT) AS blocks, CAST(sum(n) * 4 // 100 AS BIGINT) AS budget FROM docs GROUP BY cluster")
def x35_planned(spark, sf_dir):
    """Blocks that a cluster will fill, and a budget of four hundredths."""
    own = docs(spark, sf_dir).groupBy("cluster").agg(F.sum("n").alias("t"))
    return own.select("cluster", F.ceil(F.col("t") / (CONTEXT * PER_BLOCK)).alias("blocks"), F.floor(F.col("t") * 4 / 100).alias("budget"))


@query("a21_protocol", rf"""
WITH {MADE}, spaced AS (SELECT doc_id, domain, good, replace(replace(replace(o, '</think>', ' </think> '), '<think>', ' <think> '), '<answer>', ' <answer> ') AS s FROM parsed),
t AS (SELECT *, regexp_extract_all(s, '\n|[^\x20\x09-\x0D]+') AS t FROM spaced),
c AS (SELECT *, len([x FOR x IN t IF x = '<think>']) AS s1, len([x FOR x IN t IF x = '</think>']) AS e1, len([x FOR x IN t IF x = '<answer>']) AS a1, coalesce(list_position(t, '<think>'), 0) AS s0, coalesce(list_position(t, '</think>'), 0) AS e0, coalesce(list_position(t, '<answer>'), 0) AS a0 FROM t)
SELECT domain, CAST(count(*) AS BIGINT) AS cases, round(avg((s1 > 0)::INT), 9) AS started, round(avg((e1 > 0)::INT), 9) AS ended, round(avg((a1 > 0)::INT), 9) AS answered, round(avg((s1 = 1 AND e1 = 1 AND a1 = 1)::INT), 9) AS once_each,
       round(avg((s1 > 0 AND e1 > 0 AND a1 > 0 AND s0 < e0 AND e0 < a0)::INT), 9) AS ordered, round(avg((s0 = 1)::INT), 9) AS leads, round(avg(good::INT), 9) AS valid, round(avg(len(t)), 6) AS mean_tokens,
       round(avg(CASE WHEN e0 > s0 AND s0 > 0 THEN e0 - s0 - 1 END), 6) AS mean_reasoning FROM c GROUP BY domain""")
def a21_protocol(spark, sf_dir):
    """How well outputs keep to the marks of reasoning and answer."""
    half = F.floor(F.length("text") / 2).cast("int")
    whole = F.concat(F.lit("<think>"), F.substr("text", F.lit(1), half), F.lit("</think><answer>"), F.substr("text", half + 1), F.lit("</answer>"))
    made = F.when(F.col("doc_id") % 7 == 0, F.col("text")).when(F.col("doc_id") % 7 == 1, F.concat(F.lit("<think>"), "text")).otherwise(whole)
    own = table(spark, sf_dir, "documents").select(F.col("lang").alias("domain"), chat.reasoning_tokens(made).alias("t"), X.parsed_output(made).isNotNull().alias("good"))
    marks = control_tokens(F.col("t"), ["<think>", "</think>", "<answer>"])
    n, at = [marks[f"n_{i}"] for i in range(3)], [marks[f"at_{i}"] for i in range(3)]
    rate = lambda c: F.round(F.avg(c.cast("int")), 9)
    inside = F.when((at[0] >= 0) & (at[1] > at[0]), at[1] - at[0] - 1)
    return own.groupBy("domain").agg(
        F.count("*").alias("cases"), rate(n[0] > 0).alias("started"), rate(n[1] > 0).alias("ended"), rate(n[2] > 0).alias("answered"), rate((n[0] == 1) & (n[1] == 1) & (n[2] == 1)).alias("once_each"),
        rate((at[0] >= 0) & (at[0] < at[1]) & (at[1] < at[2])).alias("ordered"), rate(at[0] == 0).alias("leads"), rate(F.col("good")).alias("valid"), F.round(F.avg(F.size("t")), 6).alias("mean_tokens"),
        F.round(F.avg(inside), 6).alias("mean_reasoning"),
    )


@query("a26_task_means", """
WITH t AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL), p AS (SELECT user_id, count(*) AS n, avg(m) AS mean FROM t GROUP BY user_id)
SELECT user_id, CAST(n AS BIGINT) AS tasks, round(CASE WHEN n = 5 THEN mean ELSE -1 END, 6) AS mean FROM p""")
def a26_task_means(spark, sf_dir):
    """The mean over a model's tasks, only where it has all five."""
    tasks = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    own = tasks.groupBy("user_id").agg(F.count("*").alias("tasks"), F.avg("m").alias("mean"))
    return own.select("user_id", "tasks", F.round(F.when(F.col("tasks") == 5, F.col("mean")).otherwise(-1.0), 6).alias("mean"))


@query("a28_deltas", """
WITH c AS (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS metric FROM embeddings), m AS (SELECT label, metric, avg(x::DOUBLE) AS v FROM c GROUP BY ALL)
SELECT t.label, CAST(t.metric AS INTEGER) AS metric, round(t.v - p.v, 6) AS delta FROM m t JOIN m p ON p.metric = t.metric AND p.label = 0 WHERE t.label <> 0""")
def a28_deltas(spark, sf_dir):
    """All metrics of every model, the means of components, in long form against those of the parent."""
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("metric", "x"))
    means = long.groupBy("label", "metric").agg(F.avg(F.col("x").cast("double")).alias("v"))
    parent = means.filter("label = 0").select("metric", F.col("v").alias("base"))
    return means.filter("label <> 0").join(parent, "metric").select("label", "metric", F.round(F.col("v") - F.col("base"), 6).alias("delta"))


@query("p22_judge", """
WITH want AS (SELECT source, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM documents WHERE n_chars > 600 GROUP BY source),
got AS (SELECT source, count(*) AS n, string_agg(l.doc_id, ',' ORDER BY l.doc_id) AS ids, bool_and(toxic IN (0, 1)) AS known, bool_and(quality = 1) AS told FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source)
SELECT w.source, CASE WHEN g.source IS NULL THEN 'not_an_array' WHEN g.n <> w.n THEN 'wrong_length' WHEN g.ids <> w.ids THEN 'wrong_ids' WHEN NOT told THEN 'empty_reason' ELSE 'accepted' END AS outcome FROM want w LEFT JOIN got g ON g.source = w.source""")
def p22_judge(spark, sf_dir):
    """Verdicts of a source's labels as a JSON array, poor ones without a reason, held against its longer documents, which were asked for."""
    own, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    asked = own.filter("n_chars > 600").groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    met = own.join(labels, F.col("doc_id") == F.col("label_id"))
    verdict = F.struct(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "fail").otherwise("pass").alias("verdict"), F.when(F.col("quality") == 1, F.col("lang")).otherwise(" ").alias("reason"))
    said = met.groupBy(F.col("source").alias("s")).agg(F.sort_array(F.collect_list(F.struct("doc_id", verdict.alias("v")))).alias("l")).select("s", F.to_json("l.v").alias("raw"))
    whole = asked.join(said, F.col("source") == F.col("s"), "left")
    return whole.select("source", validation.judge_reason(F.coalesce("raw", F.lit("{}")), F.transform("ids", lambda i: i.cast("string"))).alias("outcome"))


@query("s09_interleave", """
WITH p AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 10 AS cycle, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 10 AS i FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY cycle, lang, i) AS place FROM p""")
def s09_interleave(spark, sf_dir):
    """The order in which files are read in turn, ten records of each at a time."""
    own = running(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"])
    own = own.select("doc_id", "lang", F.floor((F.col("number") - 1) / 10).alias("cycle"), ((F.col("number") - 1) % 10).alias("i"))
    return running(own, [], ["cycle", "lang", "i"]).select("doc_id", F.col("number").alias("place"))


@query("w04_projected", f"""
WITH {DOCS}, p AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('17:', doc_id))) AS r, greatest(1, CAST(round_even(count(*) OVER (PARTITION BY lang) * 0.05::DOUBLE, 0) AS BIGINT)) AS h FROM docs)
SELECT lang, CAST(sum(n) AS BIGINT) AS targets FROM p WHERE r > 2 * h GROUP BY lang""")
def w04_projected(spark, sf_dir):
    """Training targets that remain after the hold-out."""
    own = docs(spark, sf_dir).select("doc_id", "lang", "n", X.ordered_hash(F.lit("17"), F.col("doc_id")).alias("k"))
    return selection.hold_out(own, ["lang"], "k", 0.05).filter("split = 'train'").groupBy("lang").agg(F.sum("n").alias("targets"))


@query("t04_allocation", """
WITH have AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) // 2 AS want FROM have), w AS (SELECT lang, n, want // (SELECT count(*) FROM have) AS share, want FROM have, t),
spare AS (SELECT *, greatest(n - share, 0) AS more, sum(greatest(share - n, 0)) OVER () AS short, sum(greatest(n - share, 0)) OVER (ORDER BY lang) - greatest(n - share, 0) AS before FROM w)
SELECT lang, CAST(least(n, share) + greatest(0, least(more, short - before)) AS BIGINT) AS taken FROM spare""")
def t04_allocation(spark, sf_dir):
    """Half of all documents in even shares; what a language cannot give of its own, the others give in order."""
    have = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return selection.allocated(have, "lang", "n", F.floor(F.sum("n").over(Window.partitionBy()) / 2)).select("lang", "taken")


@query("t07_candidates", """
SELECT vec_id, CAST(r AS BIGINT) AS place, round(list_reverse_sort([CAST(x AS DOUBLE) FOR x IN embedding])[r], 6) AS value FROM embeddings, range(1, 4) t(r)""")
def t07_candidates(spark, sf_dir):
    """The three largest components of each vector."""
    best = F.slice(F.sort_array(F.transform("embedding", lambda x: x.cast("double")), asc=False), 1, 3)
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(best).alias("p", "v"))
    return own.select("vec_id", (F.col("p") + 1).cast("long").alias("place"), F.round("v", 6).alias("value"))


@query("j13_bytes", f"""
WITH b AS (SELECT label, label + 1 AS bytes FROM (SELECT DISTINCT label FROM embeddings))
SELECT e.label, CAST(count(*) AS BIGINT) AS tokens, CAST(sum(b.bytes) AS BIGINT) AS bytes FROM embeddings e JOIN b USING (label) GROUP BY e.label""")
def j13_bytes(spark, sf_dir):
    """Tokens with the bytes that a vocabulary gives them; the vocabulary is of fixed size."""
    own = table(spark, sf_dir, "embeddings").select("label")
    vocabulary = own.distinct().withColumn("bytes", F.col("label") + 1)
    return own.join(F.broadcast(vocabulary), "label").groupBy("label").agg(F.count("*").alias("tokens"), F.sum("bytes").alias("bytes"))


@query("j16_generation_plan", """
SELECT s.skill, d.difficulty, CAST(b AS BIGINT) AS batch FROM (VALUES ('ABD'), ('CSP'), ('DED'), ('IND'), ('INF'), ('MAG'), ('REL')) s(skill), (VALUES ('easy'), ('hard'), ('medium')) d(difficulty), range(0, 4) r(b)""")
def j16_generation_plan(spark, sf_dir):
    """A batch for each skill, difficulty and number; dimensions are fixed lists."""
    skills = spark.createDataFrame([(s,) for s in ("ABD", "CSP", "DED", "IND", "INF", "MAG", "REL")], "skill string")
    levels = spark.createDataFrame([(d,) for d in ("easy", "hard", "medium")], "difficulty string")
    return skills.crossJoin(levels).withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))


@query("j19_prefix", f"""
WITH {DOCS}, p AS (SELECT doc_id, n FROM docs), c AS (SELECT doc_id, n + CASE WHEN doc_id = 321 THEN 1 ELSE 0 END AS n FROM docs)
SELECT p.doc_id FROM p LEFT JOIN c USING (doc_id) WHERE c.n IS DISTINCT FROM p.n""")
def j19_prefix(spark, sf_dir):
    """Rows of the earlier frontier that the later one does not repeat."""
    from siltstone.operators import verify

    own = docs(spark, sf_dir).select("doc_id", "n")
    later = own.withColumn("n", F.col("n") + F.when(F.col("doc_id") == 321, 1).otherwise(0))
    return verify.differences(own, later, ["doc_id"], ["n"]).select("doc_id")


@query("v02_cache_verify", """
WITH m AS (SELECT doc_id AS block, CASE WHEN doc_id % 97 = 0 THEN doc_id + 1 ELSE doc_id END AS first, n_chars AS size, CASE WHEN doc_id % 89 = 0 THEN 0 ELSE n_chars END AS actual, CASE WHEN doc_id % 83 = 0 THEN 'other' ELSE 'train' END AS split FROM documents)
SELECT block, 'size' AS problem FROM m WHERE size <> actual UNION ALL SELECT block, 'split' FROM m WHERE split NOT IN ('train', 'validation') UNION ALL SELECT block, 'range' FROM m WHERE first <> block""")
def v02_cache_verify(spark, sf_dir):
    """Every problem of a manifest whose sizes, splits and ranges are wrong here and there; one scan gives all."""
    i = F.col("doc_id")
    own = table(spark, sf_dir, "documents").select(
        i.alias("block"), F.when(i % 97 == 0, i + 1).otherwise(i).alias("first"), F.col("n_chars").alias("size"),
        F.when(i % 89 == 0, 0).otherwise(F.col("n_chars")).alias("actual"), F.when(i % 83 == 0, "other").otherwise("train").alias("split"),
    )
    problems = F.array_compact(F.array(
        F.when(F.col("size") != F.col("actual"), "size"), F.when(~F.col("split").isin("train", "validation"), "split"), F.when(F.col("first") != F.col("block"), "range")
    ))
    return own.select("block", F.explode(problems).alias("problem"))


@query("o05_horizon", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 100 + user_id + 20 ELSE 90 + user_id END AS horizon FROM events""")
def o05_horizon(spark, sf_dir):
    """Where a schedule ends: warm-up, stable and decay, or the start of the cooldown and decay."""
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "purchase", 100 + u + 20).otherwise(90 + u).alias("horizon"))


@query("o11_progress", """
SELECT source, CAST(count(*) AS BIGINT) AS expected, CAST(count(l.doc_id) AS BIGINT) AS accepted, CAST(count(*) - count(l.doc_id) AS BIGINT) AS pending FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND quality = 1 GROUP BY source""")
def o11_progress(spark, sf_dir):
    done = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("l"))
    met = table(spark, sf_dir, "documents").join(done, F.col("doc_id") == F.col("l"), "left")
    return met.groupBy("source").agg(F.count("*").alias("expected"), F.count("l").alias("accepted"), (F.count("*") - F.count("l")).alias("pending"))


@query("p06_prompt", """
SELECT conv_id, max_by(role, turn) = 'user' AS asks FROM conversations GROUP BY conv_id""")
def p06_prompt(spark, sf_dir):
    """Conversations that end with a user's turn and can be answered."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max_by("role", "turn") == "user").alias("asks"))


@query("p08_domain", "SELECT CASE WHEN trim(coalesce(lang, '')) = '' THEN '<invalid>' ELSE trim(lang) END AS domain, CAST(count(*) AS BIGINT) AS \"rows\" FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN ' ' ELSE lang END AS lang FROM documents) GROUP BY 1")
def p08_domain(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 9 == 0, F.lit(None)).when(F.col("doc_id") % 9 == 1, " ").otherwise(F.col("lang"))
    own = table(spark, sf_dir, "documents").select(F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit("<invalid>")).alias("domain"))
    return own.groupBy("domain").agg(F.count("*").alias("rows"))


@query("st_sessions", """
WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, CAST(count(*) AS BIGINT) AS events FROM g GROUP BY user_id, session""")
def st_sessions(spark, sf_dir):
    """Sessions of users, ended by six hours without an event."""
    from siltstone.streaming import events

    own = events.sessions(table(spark, sf_dir, "events"), "6 hours")
    return own.select("user_id", F.date_format("began", "yyyy-MM-dd HH:mm:ss").alias("began"), "events")


@query("k03_shards", rf"""
WITH {DOCS}, t AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS d, [length(x) FOR x IN regexp_extract_all(text, '[^\x20\x09-\x0D]+')] || [50256] AS t FROM docs WHERE n > 0),
w AS (SELECT d, t, unnest(range(0, CAST(ceil((len(t) - 1) / 64.0) AS BIGINT))) AS w FROM t),
s AS (SELECT row_number() OVER (ORDER BY d, w) - 1 AS seq, t[w * 64 + 1 : w * 64 + 65] || [50256 FOR i IN range(0, 65 - len(t[w * 64 + 1 : w * 64 + 65]))] AS x FROM w),
h AS (SELECT seq, list_aggregate([printf('%02x%02x', v % 256, v // 256) FOR v IN x], 'string_agg', '') AS h FROM s)
SELECT CAST(seq // 64 AS BIGINT) AS shard, sha256(unhex(string_agg(h, '' ORDER BY seq))) AS checksum, CAST(count(*) * 130 AS BIGINT) AS byte_size, CAST(count(*) AS BIGINT) AS sequences,
       CAST(min(seq) // 16 AS BIGINT) AS first_block, CAST(max(seq) // 16 AS BIGINT) AS last_block FROM h GROUP BY 1""")
def k03_shards(spark, sf_dir):
    """The manifest of the corpus in shards of four blocks of sixteen windows; tokens are the lengths of words."""
    from siltstone.sources import shards

    tokens = F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0), F.length)
    windows = packing.windows(docs(spark, sf_dir).filter("n > 0").select("doc_id", tokens.alias("t")), "t", 64, 50_256, 50_256)
    numbered = running(windows.select("doc_id", "window", "window_tokens"), [], ["doc_id", "window"])
    return shards.manifest(shards.build(numbered.select((F.col("number") - 1).alias("seq"), F.col("window_tokens").alias("tokens")), 16, 4))
