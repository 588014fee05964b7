"""Queries over the corpus: validation, deduplication, splits, quotas, packing, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltstone.functions import text as X
from siltstone.functions.ordered import running
from siltstone.operators import decontaminate, mixture, packing, selection, validation, verify
from siltstone.plans.registry import query, table

#: Geometry of the packed queries.
CONTEXT, PER_BLOCK, TARGET_BYTES = 128, 16, 65_536
BLOCK_BYTES = PER_BLOCK * (CONTEXT + 1) * 2

#: documents in their role as pre-training records: cluster from the source's number, tokens as words.
DOCS = r"""docs AS (
    SELECT doc_id, text, lang, source, CAST(substr(source, 4) AS INTEGER) + 1 AS cluster,
           CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n
    FROM documents)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents")
    return own.withColumns({"cluster": F.substring("source", 4, 9).cast("int") + 1, "n": X.word_count(F.col("text"))})


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and counts alone, which is all that ordered operators are given."""
    return docs(spark, sf_dir).select("doc_id", "lang", "cluster", "n")


@query("e06_pack", f"""
WITH {DOCS}, placed AS (
    SELECT doc_id, cluster, sum(n + 1) OVER (ORDER BY doc_id) - (n + 1) AS s, sum(n + 1) OVER (ORDER BY doc_id) AS e FROM docs WHERE cluster <> 11
), seqs AS (
    SELECT *, unnest(range(CAST(CASE WHEN s <= 0 THEN 0 ELSE (s - 1) // {CONTEXT} END AS BIGINT), CAST(CASE WHEN e - 1 <= 0 THEN 0 ELSE (e - 2) // {CONTEXT} END AS BIGINT) + 1)) AS seq FROM placed
)
SELECT seq, CAST(count(*) AS BIGINT) AS documents, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
       CAST(sum(least(e, (seq + 1) * {CONTEXT} + 1) - greatest(s, CASE WHEN seq = 0 THEN 0 ELSE seq * {CONTEXT} + 1 END)) AS BIGINT) AS tokens
FROM seqs GROUP BY seq""")
def e06_pack(spark, sf_dir):
    """Sequences of the packed stream: which documents, and how many new tokens, each holds."""
    own = sizes(spark, sf_dir).filter(F.col("cluster").isin(*validation.ACCEPTED_CLUSTERS)).withColumn("n", F.col("n") + 1)
    held = packing.incidence(packing.positions(own, [], ["doc_id"], "n"), CONTEXT)
    return held.groupBy("seq").agg(
        F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("tokens").cast("long").alias("tokens")
    )


@query("e07_blocks", f"""
WITH {DOCS}, placed AS (
    SELECT cluster, sum(n + 1) OVER (ORDER BY doc_id) - (n + 1) AS s, sum(n + 1) OVER (ORDER BY doc_id) AS e FROM docs WHERE cluster <> 11
), seqs AS (
    SELECT *, unnest(range(CAST(CASE WHEN s <= 0 THEN 0 ELSE (s - 1) // {CONTEXT} END AS BIGINT), CAST(CASE WHEN e - 1 <= 0 THEN 0 ELSE (e - 2) // {CONTEXT} END AS BIGINT) + 1)) AS seq FROM placed
)
SELECT seq // {PER_BLOCK} AS block, (seq // {PER_BLOCK}) // {max(1, TARGET_BYTES // BLOCK_BYTES)} AS shard, cluster, CAST(count(DISTINCT seq) AS BIGINT) AS sequences,
       CAST(sum(least(e, (seq + 1) * {CONTEXT} + 1) - greatest(s, CASE WHEN seq = 0 THEN 0 ELSE seq * {CONTEXT} + 1 END)) AS BIGINT) AS tokens
FROM seqs GROUP BY ALL""")
def e07_blocks(spark, sf_dir):
    """Tokens of each cluster in every block and its shard."""
    own = sizes(spark, sf_dir).filter(F.col("cluster").isin(*validation.ACCEPTED_CLUSTERS)).withColumn("n", F.col("n") + 1)
    held = packing.incidence(packing.positions(own, [], ["doc_id"], "n"), CONTEXT).withColumn("block", packing.block_of(F.col("seq"), PER_BLOCK))
    return held.groupBy("block", packing.shard_of(F.col("block"), BLOCK_BYTES, TARGET_BYTES).alias("shard"), "cluster").agg(
        F.countDistinct("seq").alias("sequences"), F.sum("tokens").cast("long").alias("tokens")
    )


@query("e09_next_fit", f"""
WITH RECURSIVE {DOCS}, items AS (
    SELECT lang, doc_id, n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM docs
), fold AS (
    SELECT lang, doc_id, n, i, CAST(0 AS BIGINT) AS block, n AS held FROM items WHERE i = 1
    UNION ALL
    SELECT t.lang, t.doc_id, t.n, t.i, CASE WHEN f.held > 0 AND f.held + t.n > 30000 THEN f.block + 1 ELSE f.block END,
           CASE WHEN f.held > 0 AND f.held + t.n > 30000 THEN t.n ELSE f.held + t.n END
    FROM fold f JOIN items t ON t.lang = f.lang AND t.i = f.i + 1
)
SELECT lang, doc_id, n, block FROM fold""")
def e09_next_fit(spark, sf_dir):
    """Documents of a language in blocks of at most 30,000 words, none split."""
    return packing.next_fit(sizes(spark, sf_dir), "lang", "doc_id", "n", 30_000)


@query("w10_windows", f"""
WITH {DOCS}, ended AS (SELECT doc_id, n + 1 AS len FROM docs WHERE n > 0)
SELECT doc_id, w AS "window", CAST(least(256, len - 1 - w * 256) AS INTEGER) AS valid_targets
FROM (SELECT *, unnest(range(0, CAST(ceil((len - 1) / 256.0) AS INTEGER)))::INTEGER AS w FROM ended)""")
def w10_windows(spark, sf_dir):
    """Windows of 257 tokens at a stride of 256, with the targets that are no padding."""
    tokens = F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0), lambda w: F.pmod(F.xxhash64(w), F.lit(50_256)).cast("int"))
    own = docs(spark, sf_dir).select("doc_id", tokens.alias("tokens"))
    return packing.windows(own, "tokens", 256, 50_256, 50_256).select("doc_id", "window", "valid_targets")


@query("p02_cluster_allow", f"WITH {DOCS} SELECT cluster, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS tokens FROM docs WHERE cluster BETWEEN 1 AND 20 AND cluster <> 11 GROUP BY cluster")
def p02_cluster_allow(spark, sf_dir):
    own = docs(spark, sf_dir).filter(F.col("cluster").isin(*validation.ACCEPTED_CLUSTERS))
    return own.groupBy("cluster").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))


@query("p03_split_hash")
def p03_split_hash(spark, sf_dir):
    """Documents that the identity hash sends to validation, at a tenth; its bytes are tested against hashlib."""
    own = table(spark, sf_dir, "documents")
    held = X.is_validation("train-validation-v1", "17", "main", F.concat("lang", F.lit(".jsonl")), F.col("doc_id"), 0.1)
    return own.select("doc_id", "lang", held.alias("validation"))


@query("x04_identity_split", """
SELECT doc_id, CASE WHEN b < 9500 THEN 'train' WHEN b < 9750 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT doc_id, CAST(concat('0x', substr(sha256(concat('17:', CAST(doc_id AS VARCHAR))), 1, 16)) AS UBIGINT) % 10000 AS b FROM documents)""")
def x04_identity_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.identity_split(F.col("doc_id").cast("string")).alias("split"))


@query("p07_math_code", r"""
SELECT doc_id, CASE WHEN m AND c THEN 'math_and_code_primary' WHEN m THEN 'math_primary' WHEN c THEN 'code_primary' ELSE 'none' END AS reason
FROM (SELECT doc_id, regexp_matches(text, $$(?is)""" + validation.MATH_TOPIC + r"""$$) OR (regexp_matches(text, $$(?is)""" + validation.MATH_ACTION
       + r"""$$) AND regexp_matches(text, $$(?is)""" + validation.MATH_NOTATION + r"""$$)) AS m,
       regexp_matches(text, $$(?is)""" + validation.CODE_LANGUAGE + r"""$$) OR regexp_matches(text, $$(?is)""" + validation.CODE_TASK
       + r"""$$) OR regexp_matches(text, $$(?i)""" + validation.CODE_LITERAL + r"""$$) AS c FROM documents)""")
def p07_math_code(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(validation.exclusion_reason(F.col("text")), F.lit("none")).alias("reason"))


@query("p09_reserved", """
SELECT doc_id, (contains(text, '<think>') OR contains(text, '</think>') OR contains(text, '<answer>')) AS reserved FROM documents""")
def p09_reserved(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", validation.has_reserved(F.col("text")).alias("reserved"))


@query("p10_route_fit", f"WITH {DOCS} SELECT lang, CASE WHEN n <= 512 THEN 'fit' ELSE 'over_context' END AS route, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS tokens FROM docs GROUP BY ALL")
def p10_route_fit(spark, sf_dir):
    route = F.when(F.col("n") <= 512, "fit").otherwise("over_context").alias("route")
    return docs(spark, sf_dir).groupBy("lang", route).agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))


#: A folded text in SQL: the tables hold no white space beyond ASCII.
FOLDED = r"replace(lower(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'))), 'ß', 'ss')"


@query("w01_first_wins", f"SELECT min(doc_id) AS doc_id, sha256({FOLDED}) AS prompt_hash FROM documents GROUP BY sha256({FOLDED})")
def w01_first_wins(spark, sf_dir):
    """The first of the documents whose folded texts are equal."""
    own = table(spark, sf_dir, "documents").select("doc_id", X.prompt_hash(F.col("text")).alias("prompt_hash"))
    return selection.first_wins(own, "prompt_hash", "doc_id")


@query("j01_base_anti", f"""
WITH hashed AS (SELECT doc_id, lang, sha256({FOLDED}) AS h FROM documents)
SELECT min(doc_id) AS doc_id, h AS prompt_hash FROM hashed WHERE lang <> 'en' AND h NOT IN (SELECT h FROM hashed WHERE lang = 'en') GROUP BY h""")
def j01_base_anti(spark, sf_dir):
    """Documents of other languages whose text no English one has, the first of each text."""
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", X.prompt_hash(F.col("text")).alias("prompt_hash"))
    return selection.new_only(own.filter("lang <> 'en'"), own.filter("lang = 'en'"), "prompt_hash", "doc_id").select("doc_id", "prompt_hash")


@query("j06_decontam", f"""
WITH probes AS (SELECT item_id, trim({FOLDED}) AS probe FROM benchmark), own AS (SELECT doc_id, {FOLDED} AS body FROM documents)
SELECT doc_id FROM own WHERE NOT EXISTS (SELECT 1 FROM probes WHERE body = probe OR (length(probe) >= 32 AND contains(body, probe)))""")
def j06_decontam(spark, sf_dir):
    """Documents that neither equal a probe nor hold one of 32 characters or more."""
    probes = table(spark, sf_dir, "benchmark").select(X.folded(F.col("text")).alias("probe"))
    own = table(spark, sf_dir, "documents").select("doc_id", X.folded(F.col("text")).alias("body"))
    return own.select("doc_id").join(decontaminate.contaminated(own, probes, "doc_id", "body", "probe"), "doc_id", "left_anti")


@query("w02_hold_out", f"""
WITH {DOCS}, keyed AS (SELECT doc_id, lang, sha256(concat('17:holdout:', doc_id)) AS k FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k) AS r, greatest(1, CAST(round_even(count(*) OVER (PARTITION BY lang) * 0.01::DOUBLE, 0) AS BIGINT)) AS h FROM keyed)
SELECT doc_id, lang, CASE WHEN r <= h THEN 'validation' WHEN r <= 2 * h THEN 'test' ELSE 'train' END AS split FROM placed""")
def w02_hold_out(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", X.ordered_hash(F.lit("17"), F.lit("holdout"), F.col("doc_id")).alias("k"))
    return selection.hold_out(own, ["lang"], "k", 0.01).select("doc_id", "lang", "split")


@query("w05_quota", f"""
WITH {DOCS}, placed AS (
    SELECT doc_id, cluster, n, row_number() OVER w AS r, coalesce(sum(n) OVER (PARTITION BY cluster ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
    FROM docs WHERE cluster <> 11 WINDOW w AS (PARTITION BY cluster ORDER BY doc_id))
SELECT cluster, doc_id, n FROM placed WHERE r <= 8 OR b < 5000""")
def w05_quota(spark, sf_dir):
    """Each cluster's documents until it has eight of them and 5,000 tokens."""
    own = sizes(spark, sf_dir).filter(F.col("cluster").isin(*validation.ACCEPTED_CLUSTERS)).select("cluster", "doc_id", "n")
    return selection.quota(own, ["cluster"], ["doc_id"], "n", 8, 5000)


@query("w06_nested", f"""
WITH {DOCS}, placed AS (SELECT doc_id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS r FROM docs WHERE cluster <> 11)
SELECT doc_id, cluster, r <= 4 AS fast FROM placed WHERE r <= 12""")
def w06_nested(spark, sf_dir):
    """A small selection within a larger one, from one pass."""
    own = sizes(spark, sf_dir).filter(F.col("cluster").isin(*validation.ACCEPTED_CLUSTERS)).select("doc_id", "cluster")
    return selection.smallest(own, "cluster", ["doc_id"], 12).select("doc_id", "cluster", (F.col("place") <= 4).alias("fast"))


@query("w11_trailing", f"""
WITH {DOCS}, c AS (SELECT doc_id, cluster, n, sum(n) OVER (ORDER BY doc_id) AS c, sum(n) OVER () AS t FROM docs)
SELECT cluster, CAST(sum(least(n, c - (t - 100000))) AS BIGINT) AS tokens FROM c WHERE c > t - 100000 GROUP BY cluster""")
def w11_trailing(spark, sf_dir):
    """Tokens of each cluster among the last 100,000, the oldest document counted in part."""
    placed = running(sizes(spark, sf_dir), [], ["doc_id"], ["n"]).withColumn("c", F.col("before_n") + F.col("n"))
    bar = placed.agg((F.max("c") - 100_000).alias("bar"))
    own = placed.crossJoin(F.broadcast(bar)).filter("c > bar")
    return own.groupBy("cluster").agg(F.sum(F.least("n", F.col("c") - F.col("bar"))).alias("tokens"))


@query("t03_shortest", f"WITH {DOCS} SELECT doc_id, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n, doc_id) AS r FROM docs) WHERE r <= 25")
def t03_shortest(spark, sf_dir):
    return selection.smallest(sizes(spark, sf_dir), "lang", ["n", "doc_id"], 25).select("doc_id", "lang", "n")


@query("t10_budget_stop", f"""
WITH {DOCS}, placed AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) AS total FROM docs),
stop AS (SELECT min(doc_id) AS s FROM placed WHERE total > 101000 AND total - n < 100000)
SELECT doc_id, n, CAST(total AS BIGINT) AS total FROM placed, stop WHERE total - n < 100000 AND (s IS NULL OR doc_id < s)""")
def t10_budget_stop(spark, sf_dir):
    """Whole documents until 100,000 tokens, none that would pass 101,000."""
    return selection.budget(sizes(spark, sf_dir).select("doc_id", "n"), ["doc_id"], "n", 100_000, 101_000)


@query("e04_mixer", f"""
WITH {DOCS}, shares(lang, share) AS (VALUES ('en', 5), ('fr', 2), ('de', 2), ('es', 1)),
placed AS (SELECT doc_id, lang, n, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, share FROM docs JOIN shares USING (lang)),
keyed AS (SELECT *, round(CAST(b AS DECIMAL(20, 0)) * 1000000 / share) AS k FROM placed)
SELECT doc_id, lang, n, row_number() OVER (ORDER BY b * (10 // share), lang, doc_id) AS place FROM keyed""")
def e04_mixer(spark, sf_dir):
    """Documents in mixed order: next comes the source that has least of its share."""
    own = selection.mixed_order(sizes(spark, sf_dir), "lang", ["doc_id"], "n", {"en": 5, "fr": 2, "de": 2, "es": 1})
    placed = running(own.select("doc_id", "lang", "n", "sort_key"), [], ["sort_key", "lang", "doc_id"])
    return placed.select("doc_id", "lang", "n", F.col("number").alias("place"))


@query("e01_deficit")
def e01_deficit(spark, sf_dir):
    """The exact largest-deficit order; a fold without SQL, tested against a plain loop."""
    return mixture.scheduled(sizes(spark, sf_dir), "cluster", "doc_id", "n", {c: 1 + c % 3 for c in validation.ACCEPTED_CLUSTERS}, "17")


@query("a05_cluster_rollup", f"""
WITH {DOCS} SELECT coalesce(cluster, 0) AS cluster, coalesce(lang, 'all') AS lang, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS tokens, CAST(grouping(cluster, lang) AS BIGINT) AS level
FROM docs GROUP BY ROLLUP (cluster, lang)""")
def a05_cluster_rollup(spark, sf_dir):
    """Documents and tokens by cluster and language, by cluster, and in all (0 and 'all' stand for every one)."""
    own = docs(spark, sf_dir).rollup("cluster", "lang").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.grouping_id().cast("long").alias("level"))
    return own.fillna(0, ["cluster"]).fillna("all", ["lang"])


@query("a03_split_matrix", """
WITH splits AS (SELECT lang, CASE WHEN b < 9500 THEN 'train' WHEN b < 9750 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT lang, CAST(concat('0x', substr(sha256(concat('17:', CAST(doc_id AS VARCHAR))), 1, 16)) AS UBIGINT) % 10000 AS b FROM documents))
SELECT l.lang, s.split, CAST((SELECT count(*) FROM splits x WHERE x.lang = l.lang AND x.split = s.split) AS BIGINT) AS documents
FROM (SELECT DISTINCT lang FROM documents) l, (VALUES ('train'), ('validation'), ('test')) s(split)""")
def a03_split_matrix(spark, sf_dir):
    """Documents by language and split, with zeros."""
    own = table(spark, sf_dir, "documents").select("lang", X.identity_split(F.col("doc_id").cast("string")).alias("split"))
    counts = own.groupBy("lang", "split").agg(F.count("*").alias("documents"))
    cells = own.select("lang").distinct().withColumn("split", F.explode(F.array(*map(F.lit, ("train", "validation", "test")))))
    return cells.join(counts, ["lang", "split"], "left").fillna(0, ["documents"])


@query("a09_shares", f"WITH {DOCS} SELECT cluster, CAST(sum(n) AS BIGINT) AS total, round(sum(n) / (SELECT sum(n) FROM docs)::DOUBLE, 9) AS share FROM docs GROUP BY cluster")
def a09_shares(spark, sf_dir):
    from siltstone.operators import metrics

    return metrics.shares(docs(spark, sf_dir), "cluster", "n").withColumn("share", F.round("share", 9))


@query("x16_repetition", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS t FROM documents)
SELECT doc_id, round(CASE WHEN len(t) < 3 THEN 0.0 ELSE 1 - len(list_distinct([t[i] || chr(31) || t[i + 1] || chr(31) || t[i + 2] FOR i IN range(1, len(t) - 1)])) / (len(t) - 2)::DOUBLE END, 9) AS repetition FROM w""")
def x16_repetition(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    own = table(spark, sf_dir, "documents").select("doc_id", words.alias("t"))
    return own.select("doc_id", F.round(X.trigram_repetition(F.col("t")), 9).alias("repetition"))


@query("x06_think_parse", """
WITH made AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text WHEN doc_id % 7 = 1 THEN concat('<think>', text) ELSE concat('<think>', substr(text, 1, length(text) // 2), '</think><answer>', substr(text, length(text) // 2 + 1), '</answer>') END AS o FROM documents),
cut AS (SELECT doc_id, o, regexp_extract(o, '(?s)^<think>(.*?)</think>(.*)$', ['r', 'a']) AS p FROM made),
inner_text AS (SELECT doc_id, regexp_replace(regexp_replace(p.r, '^[\\s\\x0B]+', ''), '[\\s\\x0B]+$', '') AS r,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(p.a, '^<answer>', ''), '</answer>$', ''), '^[\\s\\x0B]+', ''), '[\\s\\x0B]+$', '') AS a FROM cut)
SELECT doc_id, (r <> '' AND a <> '') AS parsed, CASE WHEN r <> '' AND a <> '' THEN CAST(length(r) AS INTEGER) ELSE 0 END AS reasoning_chars, CASE WHEN r <> '' AND a <> '' THEN CAST(length(a) AS INTEGER) ELSE 0 END AS answer_chars FROM inner_text""")
def x06_think_parse(spark, sf_dir):
    """Outputs made of documents, one in seven without marks and one in seven unfinished, parsed into reasoning and answer."""
    half = F.floor(F.length("text") / 2).cast("int")
    whole = F.concat(F.lit("<think>"), F.substr("text", F.lit(1), half), F.lit("</think><answer>"), F.substr("text", half + 1), F.lit("</answer>"))
    made = F.when(F.col("doc_id") % 7 == 0, F.col("text")).when(F.col("doc_id") % 7 == 1, F.concat(F.lit("<think>"), "text")).otherwise(whole)
    own = table(spark, sf_dir, "documents").select("doc_id", X.parsed_output(made).alias("p"))
    return own.select("doc_id", F.col("p").isNotNull().alias("parsed"), *[F.coalesce(F.length(f"p.{c}"), F.lit(0)).alias(f"{c}_chars") for c in ("reasoning", "answer")])


@query("j03_curation", """
SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' WHEN toxic = 1 THEN 'exclude_safety' WHEN quality = 1 THEN 'keep' ELSE 'exclude_quality' END AS decision,
       CAST(count(*) AS BIGINT) AS documents FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def j03_curation(spark, sf_dir):
    """Decisions against candidates, with what either side lacks."""
    left, right = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    met = left.join(right, F.col("doc_id") == F.col("label_id"), "full_outer")
    decision = (
        F.when(F.col("label_id").isNull(), "missing").when(F.col("doc_id").isNull(), "extra").when(F.col("toxic") == 1, "exclude_safety")
        .when(F.col("quality") == 1, "keep").otherwise("exclude_quality")
    )
    return met.groupBy(decision.alias("decision")).agg(F.count("*").alias("documents"))


@query("j07_block_range", f"""
WITH {DOCS}, placed AS (SELECT doc_id, cluster, n, sum(n) OVER (ORDER BY doc_id) - n AS s, sum(n) OVER (ORDER BY doc_id) AS e FROM docs WHERE n > 0),
shards AS (SELECT cluster AS shard, count(*) AS b FROM docs GROUP BY cluster), r AS (SELECT shard, sum(b) OVER (ORDER BY shard) - b AS first, sum(b) OVER (ORDER BY shard) - 1 AS last FROM shards)
SELECT doc_id, shard, CAST(s // 400 - first AS BIGINT) AS "offset" FROM placed JOIN r ON s // 400 BETWEEN first AND last""")
def j07_block_range(spark, sf_dir):
    """The shard that holds a document's first block of 400 tokens, and the block's place in it; shards are ranges of unequal length, so this is a range join."""
    placed = packing.positions(sizes(spark, sf_dir).select("doc_id", "n"), [], ["doc_id"], "n").filter("n > 0").select("doc_id", F.floor(F.col("start") / 400).alias("block"))
    shards = running(docs(spark, sf_dir).groupBy(F.col("cluster").alias("shard")).agg(F.count("*").alias("b")), [], ["shard"], ["b"])
    ranges = shards.select("shard", F.col("before_b").alias("first"), (F.col("before_b") + F.col("b") - 1).alias("last"))
    return verify.in_ranges(placed, "block", ranges, "first", "last").select("doc_id", "shard", (F.col("block") - F.col("first")).alias("offset"))


@query("s04_splits", """
WITH files AS (SELECT lang AS path, CAST(sum(strlen(text) + 1) AS BIGINT) AS size FROM documents GROUP BY lang)
SELECT path, CAST(s AS BIGINT) AS range_start, least(s + 65536, size) AS range_end FROM (SELECT *, unnest(range(0, size, 65536)) AS s FROM files)""")
def s04_splits(spark, sf_dir):
    """Byte ranges of 64 KiB that cover every file; a language stands for a file."""
    from siltstone.sources import splits

    files = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("path")).agg(F.sum(F.octet_length("text") + 1).alias("size"))
    return splits.ranges(files, 65_536)


@query("s05_split_order", """
WITH files AS (SELECT lang AS path, CAST(sum(strlen(text) + 1) AS BIGINT) AS size FROM documents GROUP BY lang),
items AS (SELECT path, s, concat(path, ':', s) AS id FROM (SELECT *, unnest(range(0, size, 65536)) AS s FROM files))
SELECT id, row_number() OVER (ORDER BY sha256('17\\x00'::BLOB || encode(id)), id) - 1 AS place FROM items""")
def s05_split_order(spark, sf_dir):
    """The byte ranges in the order of their seeded hash."""
    from siltstone.sources import splits

    files = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("path")).agg(F.sum(F.octet_length("text") + 1).alias("size"))
    return splits.shuffled(splits.ranges(files, 65_536), "17")


@query("w13_gaps", """
WITH r AS (SELECT l_suppkey AS supplier, l_orderkey, l_linenumber, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS s, CAST(epoch(l_shipdate) // 86400 + l_quantity AS BIGINT) AS e FROM lineitem),
p AS (SELECT *, lag(e) OVER w AS before FROM r WINDOW w AS (PARTITION BY supplier ORDER BY s, e, l_orderkey, l_linenumber))
SELECT supplier, l_orderkey, l_linenumber, CASE WHEN s > before THEN 'gap' ELSE 'overlap' END AS problem, abs(s - before) AS size FROM p WHERE s <> before""")
def w13_gaps(spark, sf_dir):
    """Where a supplier's shipments, as intervals of as many days as goods in order, do not begin where the one before ended."""
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86_400)
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_orderkey", "l_linenumber", day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))
    return verify.discontinuities(own, ["supplier"], ["s", "e", "l_orderkey", "l_linenumber"], "s", "e").select("supplier", "l_orderkey", "l_linenumber", "problem", "size")


@query("p01_validate", rf"""
WITH {DOCS}, r AS (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) * 2 - 3 AS c, [length(x) * 2600 FOR x IN regexp_extract_all(text, '[^\x20\x09-\x0D]+')] AS t, len(string_split(text, ' ')) AS m FROM documents)
SELECT doc_id, CASE WHEN c NOT BETWEEN 1 AND 20 THEN 'cluster_id_out_of_range' WHEN len(t) = 0 THEN 'tokens_empty' WHEN list_max(t) >= 50257 THEN 'token_out_of_range' WHEN m <> len(t) THEN 'token_count_mismatch' ELSE 'accepted' END AS reason FROM r""")
def p01_validate(spark, sf_dir):
    """Documents as JSON records, cluster from the source's number, tokens from the lengths of words, and their count from blanks; every record's first flaw."""
    tokens = F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0), lambda w: F.length(w) * 2600)
    record = F.struct((F.substring("source", 4, 9).cast("int") * 2 - 3).alias("cluster_id"), tokens.alias("tokens"), F.size(F.split("text", " ")).alias("token_count"))
    return table(spark, sf_dir, "documents").select("doc_id", validation.record_reason(F.to_json(record)).alias("reason"))
