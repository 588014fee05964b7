"""Queries of scalar functions, set operations, and smaller joins and ledgers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.functions import scalars as S, text as X
from siltstone.functions.ordered import running
from siltstone.operators import selection
from siltstone.plans.corpus import DOCS, FOLDED, docs, sizes
from siltstone.plans.registry import query, table

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
#: A text without white space at its ends, and such a text t folded, in SQL.
BARE = r"regexp_replace(regexp_replace(text, '^[\s\x0B]+', ''), '[\s\x0B]+$', '')"
FOLD_T = "replace(lower(t), 'ß', 'ss')"


@query("x01_prompt_hash", f"SELECT doc_id, sha256({FOLDED}) AS prompt_hash FROM documents")
def x01_prompt_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.prompt_hash(F.col("text")).alias("prompt_hash"))


@query("x07_conversation_id", "SELECT doc_id, concat('rsft-', substr(sha256(concat_ws(chr(31), lang, source, text)), 1, 20)) AS id FROM documents")
def x07_conversation_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.conversation_id("rsft-", F.col("lang"), F.col("source"), F.col("text")).alias("id"))


@query("x12_end_mark", f"SELECT doc_id, CAST(CASE WHEN len({WORDS}) > 0 AND {WORDS}[-1] = 'the.' THEN len({WORDS}) ELSE len({WORDS}) + 1 END AS INTEGER) AS tokens FROM documents")
def x12_end_mark(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(S.ended(words, F.lit("the."))).alias("tokens"))


@query("x13_little_endian", """
SELECT vec_id, concat(lpad(lower(to_hex(t % 256)), 2, '0'), lpad(lower(to_hex(t // 256)), 2, '0')) AS h FROM (SELECT vec_id, (vec_id * 977) % 50257 AS t FROM embeddings)""")
def x13_little_endian(spark, sf_dir):
    token = ((F.col("vec_id") * 977) % 50_257).cast("int")
    raw = S.little_endian(F.array(token))
    own = table(spark, sf_dir, "embeddings").select("vec_id", raw.alias("raw"), token.alias("t"))
    return own.filter(F.get(S.from_little_endian(F.col("raw")), F.lit(0)) == F.col("t")).select("vec_id", F.lower(F.hex("raw")).alias("h"))


@query("x17_role_leak", r"SELECT conv_id, turn, regexp_matches(concat(role, ': ', text), '(?i)(?:^|\n)(?:system|user|assistant):') AS leak FROM conversations")
def x17_role_leak(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.has_role_leak(F.concat("role", F.lit(": "), "text")).alias("leak"))


@query("x18_rule_checks", rf"""
WITH c AS (SELECT conv_id, turn, {BARE} AS t, len(regexp_extract_all(text, '\n|[^\x20\x09-\x0D]+')) AS n FROM conversations WHERE role = 'assistant'),
k AS (SELECT *, t = 'Yes.' AS exact, contains({FOLD_T}, 'the') AS required_0, NOT contains({FOLD_T}, 'stupid') AS forbidden_0, regexp_matches(t, '[.!?]$') AS regex, n <= 60 AS maximum_response_tokens,
    len(regexp_extract_all(t, '[^\s\x0B]+')) <= 50 AS maximum_words, suffix({FOLD_T}, '.') AS required_suffix, length(t) % 2 = 0 AS eos,
    NOT regexp_matches(t, '(?i)(?:^|\n)(?:system|user|assistant):') AS no_role_leak, t <> '' AS non_empty FROM c)
SELECT conv_id, turn, exact, required_0, forbidden_0, regex, maximum_response_tokens, maximum_words, required_suffix, eos, no_role_leak, non_empty,
    exact AND required_0 AND forbidden_0 AND regex AND maximum_response_tokens AND maximum_words AND required_suffix AND eos AND no_role_leak AND non_empty AS passed FROM k""")
def x18_rule_checks(spark, sf_dir):
    """An assistant's turns against every kind of rule; an even length stands for a response that ended by itself."""
    from siltstone.operators import chat

    own = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    checks = S.rule_checks(
        F.col("text"), exact="Yes.", required=("The",), forbidden=("STUPID",), regex=r"[.!?]$", most_tokens=60, tokens=F.size(chat.words(F.col("text"))), most_words=50, suffix=".",
        ended=F.length(X.strip(F.col("text"))) % 2 == 0,
    )
    return own.select("conv_id", "turn", *[c.alias(n) for n, c in checks.items()])


@query("x20_control_tokens", """
WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(len([x FOR x IN r IF x = 'user']) AS INTEGER) AS n_0, CAST(len([x FOR x IN r IF x = 'assistant']) AS INTEGER) AS n_1,
       CAST(coalesce(list_position(r, 'user'), 0) - 1 AS INTEGER) AS at_0, CAST(coalesce(list_position(r, 'assistant'), 0) - 1 AS INTEGER) AS at_1,
       len([x FOR x IN r IF x = 'user']) = 1 AND len([x FOR x IN r IF x = 'assistant']) = 1 AND coalesce(list_position(r, 'user'), 0) < coalesce(list_position(r, 'assistant'), 0) AS in_order FROM t""")
def x20_control_tokens(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("m"))
    roles = F.col("m.role")
    return own.select("conv_id", *[c.alias(n) for n, c in S.control_tokens(roles, ["user", "assistant"]).items()])


@query("x22_nucleus", """
WITH s AS (SELECT vec_id, [CAST(x AS DOUBLE) * 8 FOR x IN embedding] AS z FROM embeddings),
p AS (SELECT vec_id, [exp(x - list_max(z)) / list_sum([exp(y - list_max(z)) FOR y IN z]) FOR x IN z] AS p FROM s),
u AS (SELECT vec_id, unnest(p) AS p, unnest(range(0, len(p))) AS i FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS r FROM u),
c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY r) - p AS b FROM r WHERE r <= 20)
SELECT vec_id, string_agg(i, ',' ORDER BY r) AS kept FROM c WHERE round(b, 9) < 0.9 GROUP BY vec_id""")
def x22_nucleus(spark, sf_dir):
    """Of every vector's components, as logits of tokens, those that the twenty likeliest and a mass of 0.9 leave."""
    z = F.transform("embedding", lambda x: x.cast("double") * 8)
    own = table(spark, sf_dir, "embeddings").select("vec_id", z.alias("z"))
    own = own.select("vec_id", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    kept = S.kept_tokens(F.transform("e", lambda x: x / total), 20, 0.9)
    return own.select("vec_id", F.array_join(kept.cast("array<string>"), ",").alias("kept"))


@query("x24_quantity", r"""
WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents),
texts AS (SELECT w AS text FROM words WHERE regexp_matches(w, '^[0-9]') UNION SELECT concat(substr(CAST(o_totalprice AS VARCHAR), 1, 3), ',', o_orderkey % 1000, ['K', ' m', 'B', '', '_0', '.5T', 'x'][1 + o_orderkey % 7]) FROM orders),
c AS (SELECT text, regexp_replace(trim(text), '[_, ]', '', 'g') AS c FROM texts),
p AS (SELECT text, regexp_extract(c, '^\+?(\d+\.?\d*|\.\d+)([KkMmBbTt]?)$', 1) AS d, upper(regexp_extract(c, '^\+?(\d+\.?\d*|\.\d+)([KkMmBbTt]?)$', 2)) AS u FROM c),
a AS (SELECT text, TRY_CAST(nullif(d, '') AS DECIMAL(25, 12)) * (CASE u WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 WHEN 'B' THEN 1000000000 WHEN 'T' THEN 1000000000000 ELSE 1 END)::DECIMAL(13, 0) AS a FROM p)
SELECT text, coalesce(CASE WHEN a > 0 AND a = floor(a) THEN TRY_CAST(a AS BIGINT) END, -1) AS amount FROM a""")
def x24_quantity(spark, sf_dir):
    """Words of the documents that begin with a digit, and prices with marks and units, as whole numbers; -1 for none."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("text")).filter("text RLIKE '^[0-9]'")
    unit = F.element_at(F.array(*map(F.lit, ("K", " m", "B", "", "_0", ".5T", "x"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    prices = table(spark, sf_dir, "orders").select(F.concat(F.substr(F.col("o_totalprice").cast("string"), F.lit(1), F.lit(3)), F.lit(","), F.col("o_orderkey") % 1000, unit).alias("text"))
    return words.unionByName(prices).distinct().select("text", F.coalesce(S.quantity(F.col("text")), F.lit(-1)).alias("amount"))


@query("x25_slug", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def x25_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.slug(F.col("url")).alias("slug"))


@query("x26_markdown", r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g')) AS t, n_chars FROM documents)
SELECT doc_id, replace(CASE WHEN length(t) > 200 THEN concat(substr(t, 1, 199), '…') ELSE t END, '|', '\|') AS cell, printf('%.6g', n_chars * 1234.5678 / 7) AS large, printf('%.6g', n_chars / 3e8::DOUBLE) AS small FROM f""")
def x26_markdown(spark, sf_dir):
    """Texts and numbers as cells of a table."""
    n = F.col("n_chars").cast("double")
    return table(spark, sf_dir, "documents").select("doc_id", S.markdown_cell(F.col("text")).alias("cell"), S.six_digits(n * 1234.5678 / 7).alias("large"), S.six_digits(n / 3e8).alias("small"))


@query("x31_seed", """
SELECT doc_id, CAST(CAST(concat('0x', substr(h, 15, 2), substr(h, 13, 2), substr(h, 11, 2), substr(h, 9, 2), substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2)) AS UBIGINT) AS VARCHAR) AS seed
FROM (SELECT doc_id, sha256(concat('17:', source)) AS h FROM documents)""")
def x31_seed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.seed_of(17, F.col("source")).cast("string").alias("seed"))


@query("x37_wrappers", """
SELECT item_id, length(concat('User:', chr(10), text, chr(10), 'Assistant:', chr(10))) AS chat, length(concat('Question: ', text, chr(10), 'Answer:')) AS qa, length(text) AS plain FROM (SELECT item_id, text FROM benchmark)""".replace("length(", "strlen("))
def x37_wrappers(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", *[F.octet_length(S.wrapped(k, F.col("text"))).cast("long").alias(k) for k in ("chat", "qa", "plain")])


@query("p20_safe_path", r"SELECT page_id, NOT regexp_matches(path, '^/|\\|(?:^|/)\.\.?(?:/|$)|//') AND path <> '' AS safe FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat('../', url) ELSE replace(url, '//', '/') END AS path FROM pages)")
def p20_safe_path(spark, sf_dir):
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../"), "url")).otherwise(F.replace("url", F.lit("//"), F.lit("/")))
    return table(spark, sf_dir, "pages").select("page_id", S.safe_path(path).alias("safe"))


@query("s08_identity", "SELECT doc_id, concat_ws(':', 'main', concat(lang, '.jsonl'), doc_id) AS id FROM documents")
def s08_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", F.lit("main"), F.concat("lang", F.lit(".jsonl")), "doc_id").alias("id"))


@query("u01_union", "SELECT doc_id, 'base' AS part FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'extra' AS part FROM documents WHERE lang = 'de'")
def u01_union(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    return own.filter("lang = 'en'").select("doc_id", F.lit("base").alias("part")).unionByName(own.filter("lang = 'de'").select("doc_id", F.lit("extra").alias("part")))


@query("u03_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u03_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("u04_intersection", "SELECT doc_id FROM documents WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def u04_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("n_chars > 1000").select("doc_id").intersect(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


@query("u05_distinct_ids", "SELECT CAST(count(*) AS BIGINT) AS rows_in, CAST(count(DISTINCT doc_id) AS BIGINT) AS ids, count(*) = count(DISTINCT doc_id) AS unique_ids FROM documents")
def u05_distinct_ids(spark, sf_dir):
    own = table(spark, sf_dir, "documents").agg(F.count("*").alias("rows_in"), F.countDistinct("doc_id").alias("ids"))
    return own.withColumn("unique_ids", F.col("rows_in") == F.col("ids"))


@query("j04_resume", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def j04_resume(spark, sf_dir):
    """What is to be kept and is not accepted yet."""
    keep = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return keep.join(table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id"), "doc_id", "left_anti")


@query("j08_block_index", f"""
WITH {DOCS}, shards AS (SELECT cluster AS shard, CAST(count(*) AS BIGINT) AS n FROM docs GROUP BY cluster),
placed AS (SELECT shard, n, sum(n) OVER (ORDER BY shard) - n AS first FROM shards)
SELECT shard, CAST(first + i AS BIGINT) AS block, i * 4128 AS "offset" FROM (SELECT *, unnest(range(0, n)) AS i FROM placed)""")
def j08_block_index(spark, sf_dir):
    """Blocks of each shard with their byte offsets."""
    shards = docs(spark, sf_dir).groupBy(F.col("cluster").alias("shard")).agg(F.count("*").alias("n"))
    placed = running(shards, [], ["shard"], ["n"]).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return placed.select("shard", (F.col("before_n") + F.col("i")).alias("block"), (F.col("i") * 4128).alias("offset"))


@query("j12_conditioned", """
WITH o AS (SELECT vec_id // 4 AS task, vec_id % 4 AS level, embedding[1] > 0 AS ok FROM embeddings)
SELECT level, CAST(count(*) AS BIGINT) AS cases, round(avg(ok::INT), 9) AS passed FROM o WHERE level > 0 AND task IN (SELECT task FROM o WHERE level = 0 AND ok) GROUP BY level""")
def j12_conditioned(spark, sf_dir):
    """Pass rates of the harder levels among tasks that passed the easiest."""
    own = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("task"), (F.col("vec_id") % 4).alias("level"), (F.get("embedding", F.lit(0)) > 0).alias("ok")
    )
    base = own.filter("level = 0 AND ok").select("task")
    return own.filter("level > 0").join(base, "task", "left_semi").groupBy("level").agg(F.count("*").alias("cases"), F.round(F.avg(F.col("ok").cast("int")), 9).alias("passed"))


@query("j18_nested", "SELECT CAST(count(*) AS BIGINT) AS outside FROM documents f WHERE n_chars > 3000 AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = f.doc_id AND d.n_chars > 1000)")
def j18_nested(spark, sf_dir):
    """How many of the smaller selection the larger one lacks."""
    own = table(spark, sf_dir, "documents")
    return own.filter("n_chars > 3000").join(own.filter("n_chars > 1000").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("outside"))


@query("a32_digest", """
WITH lines AS (SELECT lang, concat(doc_id, ':', sha256(text)) AS line FROM documents), keyed AS (SELECT lang, line, sha256(line) AS h FROM lines),
buckets AS (SELECT lang, substr(h, 1, 4) AS bucket, sha256(string_agg(h, '' ORDER BY h)) AS d FROM keyed GROUP BY ALL)
SELECT lang, sha256(string_agg(concat(bucket, ':', d), chr(10) ORDER BY bucket)) AS digest FROM buckets GROUP BY lang""")
def a32_digest(spark, sf_dir):
    """The identity of each file set: digests of its members in buckets by their first four digits, and the digest of at most 65,536 buckets."""
    from siltstone.operators import verify

    own = table(spark, sf_dir, "documents").select("lang", F.concat_ws(":", "doc_id", X.sha(F.col("text"))).alias("line"))
    return verify.tree_digest(own, ["lang"], "line")


@query("a10_matrix", """
SELECT l.lang, q.quality, CAST(count(y.doc_id) AS BIGINT) AS documents FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (VALUES (0), (1)) q(quality)
LEFT JOIN (SELECT d.doc_id, lang, quality FROM documents d JOIN labels USING (doc_id)) y ON y.lang = l.lang AND y.quality = q.quality GROUP BY ALL""")
def a10_matrix(spark, sf_dir):
    """Documents by language and verdict, cells without any included."""
    own = table(spark, sf_dir, "documents").select("doc_id", "lang")
    met = own.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("documents"))
    cells = own.select("lang").distinct().withColumn("quality", F.explode(F.array(F.lit(0), F.lit(1))))
    return cells.join(met, ["lang", "quality"], "left").fillna(0, ["documents"])


@query("a30_mixture_error", f"""
WITH {DOCS}, t AS (SELECT cluster, sum(n) AS n FROM docs WHERE cluster <> 11 GROUP BY cluster)
SELECT round(max(abs(n / (SELECT sum(n) FROM t)::DOUBLE - 1 / 19.0::DOUBLE)), 9) AS error FROM t""")
def a30_mixture_error(spark, sf_dir):
    """The largest distance of a cluster's share from an even one."""
    from siltstone.operators import metrics

    own = metrics.shares(docs(spark, sf_dir).filter("cluster <> 11"), "cluster", "n")
    return own.agg(F.round(F.max(F.abs(F.col("share") - F.lit(1 / 19))), 9).alias("error"))


@query("w03_fixed_cells", f"""
WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('17:', doc_id)), doc_id) AS r FROM documents)
SELECT doc_id, source, CASE WHEN r <= 3 THEN 'validation' WHEN r <= 6 THEN 'test' ELSE 'train' END AS split FROM k""")
def w03_fixed_cells(spark, sf_dir):
    """Three validation and three test rows of each cell."""
    own = table(spark, sf_dir, "documents").select("doc_id", "source", X.ordered_hash(F.lit("17"), F.col("doc_id")).alias("k"))
    placed = running(own, ["source"], ["k", "doc_id"])
    split = F.when(F.col("number") <= 3, "validation").when(F.col("number") <= 6, "test").otherwise("train")
    return placed.select("doc_id", "source", split.alias("split"))


@query("w07_retention", f"""
WITH {DOCS}, p AS (SELECT doc_id, source, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM docs)
SELECT doc_id, source, n FROM p WHERE b < 3000""")
def w07_retention(spark, sf_dir):
    """Each source's documents until 3,000 tokens are reached."""
    own = docs(spark, sf_dir).select("doc_id", "source", "n")
    return selection.quota(own, ["source"], ["doc_id"], "n", 0, 3000)


@query("w12_cumulative", f"""
WITH {DOCS}, t AS (SELECT doc_id // 100 AS shard, cluster, sum(n) AS n FROM docs GROUP BY ALL)
SELECT shard, cluster, CAST(n AS BIGINT) AS tokens, CAST(sum(n) OVER (PARTITION BY cluster ORDER BY shard) AS BIGINT) AS cumulative FROM t""")
def w12_cumulative(spark, sf_dir):
    """Each cluster's tokens by shard, and up to it."""
    own = sizes(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 100).alias("shard"), "cluster").agg(F.sum("n").alias("tokens"))
    placed = running(own, ["cluster"], ["shard"], ["tokens"])
    return placed.select("shard", "cluster", "tokens", (F.col("before_tokens") + F.col("tokens")).alias("cumulative"))


@query("w16_coverage", f"""
WITH {DOCS}, p AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id) - n AS b FROM docs) SELECT doc_id FROM p WHERE b < 50000""")
def w16_coverage(spark, sf_dir):
    """The shortest prefix of documents with 50,000 tokens."""
    return running(sizes(spark, sf_dir).select("doc_id", "n"), [], ["doc_id"], ["n"]).filter("before_n < 50000").select("doc_id")


@query("t01_hash_order", "SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', '17', 'order', doc_id)), doc_id) AS place FROM documents")
def t01_hash_order(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", X.ordered_hash(F.lit("17"), F.lit("order"), F.col("doc_id")).alias("k"))
    return running(own, [], ["k", "doc_id"]).select("doc_id", F.col("number").alias("place"))


@query("e19_reblock", f"""
WITH {DOCS}, t AS (SELECT CAST(greatest(0, (sum(n + 1) - 1) // 128 + 1) AS BIGINT) AS seqs FROM docs)
SELECT s // 16 AS old_block, s // 64 AS new_block, CAST(count(*) AS BIGINT) AS sequences FROM (SELECT unnest(range(0, seqs)) AS s FROM t) GROUP BY ALL""")
def e19_reblock(spark, sf_dir):
    """Sequences by their block of 16 and their new block of 64; only their number is needed."""
    from siltstone.operators import packing

    total = docs(spark, sf_dir).agg(F.sum(F.col("n") + 1).alias("t")).select(packing.sequence_count(F.col("t"), 128).alias("seqs"))
    seqs = total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("seqs") - 1)).alias("s"))
    return seqs.groupBy(packing.block_of(F.col("s"), 16).alias("old_block"), packing.block_of(F.col("s"), 64).alias("new_block")).agg(F.count("*").alias("sequences"))


@query("v01_token_range", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS beyond, CAST(max(length(w) * 2600) AS INTEGER) AS largest FROM w WHERE length(w) * 2600 >= 50257 GROUP BY doc_id""")
def v01_token_range(spark, sf_dir):
    """Documents with tokens, for which lengths of words times 2,600 stand, beyond the vocabulary, and how many."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    beyond = F.filter(F.transform(words, lambda w: F.length(w) * 2600), lambda t: t >= 50_257)
    own = table(spark, sf_dir, "documents").select("doc_id", beyond.alias("b")).filter(F.size("b") > 0)
    return own.select("doc_id", F.size("b").cast("long").alias("beyond"), F.array_max("b").alias("largest"))


@query("o02_run_name", "SELECT DISTINCT format('{}-{:05d}', event_type, user_id) AS run FROM events")
def o02_run_name(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.format_string("%s-%05d", "event_type", "user_id").alias("run")).distinct()


@query("o10_attempts", """
SELECT user_id, CAST(count(*) AS BIGINT) AS attempts, max_by(event_id, (ts, event_id)) AS last_attempt, bool_or(event_type = 'error') AS strict FROM events GROUP BY user_id""")
def o10_attempts(spark, sf_dir):
    """Attempts of each batch, the last of them, and whether any was an error."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("attempts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_attempt"), F.bool_or(F.col("event_type") == "error").alias("strict")
    )


@query("x28_elapsed", "SELECT event_id, greatest(CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-15 00:00:00')) AS BIGINT), 0) AS seconds FROM events")
def x28_elapsed(spark, sf_dir):
    """Seconds since a reset, none before it."""
    since = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-15 00:00:00").cast("timestamp"))) / 1_000_000)
    own = table(spark, sf_dir, "events")
    own = own.withColumn("ts", F.col("ts").cast("timestamp"))
    return own.select("event_id", F.greatest(since, F.lit(0)).alias("seconds"))
