"""Queries over conversations, scored tokens, paired outcomes and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltstone.functions import text as X
from siltstone.functions.ordered import running_max
from siltstone.operators import chat, metrics, selection, validation
from siltstone.plans.registry import query, table

#: Ten numbers of an embedding stand for logits, its label for the token that came.
SCORED = """scored AS (
    SELECT vec_id, label, label % 4 AS cluster, [CAST(x AS DOUBLE) * 8 FOR x IN embedding[1:10]] AS z FROM embeddings
), tokens AS (
    SELECT vec_id, label, cluster, ln(list_sum([exp(x - list_max(z)) FOR x IN z])) + list_max(z) - z[label + 1] AS loss,
           len([x FOR x IN z IF x > z[label + 1]]) + 1 AS true_rank, 1 / list_sum([exp(x - list_max(z)) FOR x IN z]) AS conf,
           list_position(z, list_max(z)) - 1 = label AS correct FROM scored)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 8)
    return own.select("vec_id", "label", (F.col("label") % 4).alias("cluster"), z.alias("z")).withColumns(metrics.scored(F.col("z"), F.col("label"))).drop("z")


@query("a11_loss", f"""
WITH {SCORED} SELECT CAST(count(*) AS BIGINT) AS tokens, round(avg(loss), 6) AS loss, round(exp(least(avg(loss), 80)), 6) AS perplexity,
round(sum(loss) / ln(2.0) / sum(label + 1), 6) AS bits_per_byte FROM tokens""")
def a11_loss(spark, sf_dir):
    """Loss, perplexity and bits a byte; a label's number plus one stands for its bytes."""
    own = tokens(spark, sf_dir).agg(F.count("*").alias("tokens"), F.avg("loss").alias("l"), F.sum("loss").alias("s"), F.sum(F.col("label") + 1).alias("b"))
    return own.select(
        "tokens", F.round("l", 6).alias("loss"), F.round(metrics.perplexity(F.col("l")), 6).alias("perplexity"),
        F.round(F.col("s") / F.lit(metrics.LN2) / F.col("b"), 6).alias("bits_per_byte"),
    )


@query("a12_topk", f"WITH {SCORED} SELECT cluster, round(avg((true_rank <= 1)::INT), 9) AS top1, round(avg((true_rank <= 5)::INT), 9) AS top5, round(avg((true_rank <= 10)::INT), 9) AS top10 FROM tokens GROUP BY cluster")
def a12_topk(spark, sf_dir):
    hit = lambda k: F.round(F.avg((F.col("true_rank") <= k).cast("int")), 9).alias(f"top{k}")
    return tokens(spark, sf_dir).groupBy("cluster").agg(hit(1), hit(5), hit(10))


@query("a13_ece", f"""
WITH {SCORED}, bins AS (SELECT CAST(least(floor(conf * 15), 14) AS INTEGER) AS bin, count(*) AS n, avg(conf) AS c, avg(correct::INT) AS a FROM tokens GROUP BY 1)
SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM bins""")
def a13_ece(spark, sf_dir):
    table_ = metrics.calibration(tokens(spark, sf_dir), "top1_probability", "correct")
    return metrics.calibration_error(table_).select(F.round("ece", 6).alias("ece"))


@query("a14_cluster_weighted", f"""
WITH {SCORED}, own AS (SELECT cluster, avg(loss) AS l, count(*) AS n FROM tokens GROUP BY cluster)
SELECT round(avg(l), 6) AS macro, round(sum(l * (cluster + 1)) / sum(cluster + 1), 6) AS weighted, round(max(l), 6) AS worst FROM own""")
def a14_cluster_weighted(spark, sf_dir):
    """Mean over clusters, mean by the mixture's weights, and the worst cluster."""
    own = tokens(spark, sf_dir).groupBy("cluster").agg(F.avg("loss").alias("l"))
    w = F.col("cluster") + 1
    return own.agg(F.round(F.avg("l"), 6).alias("macro"), F.round(F.sum(F.col("l") * w) / F.sum(w), 6).alias("weighted"), F.round(F.max("l"), 6).alias("worst"))


@query("a15_position", f"WITH {SCORED} SELECT CAST((vec_id % 64) * 8 // 64 AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS tokens, round(avg(loss), 6) AS loss FROM tokens GROUP BY 1")
def a15_position(spark, sf_dir):
    bucket = F.floor((F.col("vec_id") % 64) * 8 / 64).alias("bucket")
    return tokens(spark, sf_dir).groupBy(bucket).agg(F.count("*").alias("tokens"), F.round(F.avg("loss"), 6).alias("loss"))


@query("a17_bootstrap", f"""
WITH {SCORED}, units AS (SELECT row_number() OVER (ORDER BY vec_id // 64) - 1 AS i, sum(loss) AS loss, count(*) AS n FROM tokens GROUP BY vec_id // 64),
c AS (SELECT count(*) AS m FROM units),
draws AS (SELECT r, CAST(CAST(concat('0x', substr(md5(concat('17:', r, ':', d)), 1, 15)) AS BIGINT) % m AS BIGINT) AS i FROM c, range(1, 201) t(r), (SELECT unnest(range(0, m)) AS d FROM c)),
ratios AS (SELECT r, sum(loss) / sum(n) AS x FROM draws JOIN units USING (i) GROUP BY r), l AS (SELECT list(x ORDER BY x) AS l FROM ratios)
SELECT round(l[1 + CAST(round_even(0.025 * 199, 0) AS BIGINT)], 9) AS low, round(l[1 + CAST(round_even(0.975 * 199, 0) AS BIGINT)], 9) AS high FROM l""")
def a17_bootstrap(spark, sf_dir):
    """A 95 % interval of the loss over documents drawn again with replacement, 64 tokens a document."""
    own = tokens(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 64).alias("unit")).agg(F.sum("loss").alias("loss"), F.count("*").alias("n"))
    return metrics.bootstrap(own, "unit", "loss", "n", 200, 17).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("a18_teacher_forced", f"""
WITH {SCORED} SELECT cluster, CAST(count(*) AS BIGINT) AS tokens, round(avg(loss), 6) AS mean_loss, round(median(loss), 6) AS median_loss, round(avg(true_rank), 6) AS mean_rank, round(median(true_rank), 6) AS median_rank,
round(avg((true_rank <= 1)::INT), 9) AS rank_1, round(avg((true_rank <= 5)::INT), 9) AS rank_5, round(avg((true_rank <= 10)::INT), 9) AS rank_10, round(avg(exp(-loss)), 6) AS mean_probability,
round(median(exp(-loss)), 6) AS median_probability, round(avg(conf), 6) AS mean_confidence, round(avg((NOT correct AND conf >= 0.5)::INT), 9) AS confidently_wrong FROM tokens GROUP BY cluster""")
def a18_teacher_forced(spark, sf_dir):
    """Statistics of scored tokens by cluster; medians come from places in a spread order, not from one task a cluster."""
    own = tokens(spark, sf_dir)
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    mean = lambda c: F.round(F.avg(c), 6)
    sums = own.groupBy("cluster").agg(
        F.count("*").alias("tokens"), mean("loss").alias("mean_loss"), mean("true_rank").alias("mean_rank"), *[share(F.col("true_rank") <= k).alias(f"rank_{k}") for k in (1, 5, 10)],
        mean("true_probability").alias("mean_probability"), mean("top1_probability").alias("mean_confidence"), share(~F.col("correct") & (F.col("top1_probability") >= 0.5)).alias("confidently_wrong"),
    )
    for value, name in (("loss", "median_loss"), ("true_rank", "median_rank"), ("true_probability", "median_probability")):
        sums = sums.join(metrics.medians(own, "cluster", value).select("cluster", F.round("median", 6).alias(name)), "cluster")
    return sums


@query("x21_entropy", """
WITH s AS (SELECT vec_id, [CAST(x AS DOUBLE) * 8 FOR x IN embedding[1:10]] AS z FROM embeddings),
p AS (SELECT vec_id, [exp(x - list_max(z)) / list_sum([exp(y - list_max(z)) FOR y IN z]) FOR x IN z] AS p FROM s)
SELECT vec_id, round(-list_sum([x * ln(x) FOR x IN p]), 6) AS entropy, round(list_sum(list_reverse_sort(p)[1:5]), 6) AS top5_mass FROM p""")
def x21_entropy(spark, sf_dir):
    return tokens(spark, sf_dir).select("vec_id", F.round("entropy", 6).alias("entropy"), F.round("top5_mass", 6).alias("top5_mass"))


@query("t06_representative", f"""
WITH {SCORED}, wrong AS (SELECT 'confidently_wrong' AS kind, vec_id, round(conf, 6) AS p FROM tokens WHERE NOT correct ORDER BY conf DESC, vec_id LIMIT 5),
low AS (SELECT 'lowest_true' AS kind, vec_id, round(exp(-loss), 9) AS p FROM tokens ORDER BY loss DESC, vec_id LIMIT 5)
SELECT * FROM wrong UNION ALL SELECT * FROM low""")
def t06_representative(spark, sf_dir):
    """The five most confident among wrong predictions, and the five where the true token was least expected."""
    own = tokens(spark, sf_dir)
    wrong = own.filter(~F.col("correct")).orderBy(F.desc("top1_probability"), "vec_id").limit(5).select(F.lit("confidently_wrong").alias("kind"), "vec_id", F.round("top1_probability", 6).alias("p"))
    low = own.orderBy(F.desc("loss"), "vec_id").limit(5).select(F.lit("lowest_true").alias("kind"), "vec_id", F.round("true_probability", 9).alias("p"))
    return wrong.unionByName(low)


@query("x36_interpolate", """
SELECT vec_id, i, round(CAST(embedding[i] AS DOUBLE) + 0.25 * (CAST(embedding[i + 32] AS DOUBLE) - CAST(embedding[i] AS DOUBLE)), 9) AS x
FROM embeddings, range(1, 33) r(i)""")
def x36_interpolate(spark, sf_dir):
    """One half of each vector moved a quarter of the way to the other half, a row a component."""
    half = lambda start: F.transform(F.slice("embedding", start, 32), lambda x: x.cast("double"))
    mixed = F.zip_with(half(1), half(33), lambda a, b: a + 0.25 * (b - a))
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(mixed).alias("p", "x"))
    return own.select("vec_id", (F.col("p") + 1).cast("long").alias("i"), F.round("x", 9).alias("x"))


@query("a27_mcnemar", """
WITH pairs AS (SELECT label, CAST(embedding[1] > 0 AS INT) AS a, CAST(embedding[2] > 0 AS INT) AS b FROM embeddings),
t AS (SELECT label, count(*) FILTER (a < b) AS wins, count(*) FILTER (a > b) AS losses, count(*) FILTER (a = b) AS ties FROM pairs GROUP BY label)
SELECT label, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(ties AS BIGINT) AS ties,
       round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0)) FOR i IN range(0, least(wins, losses) + 1)])) END, 6) AS p
FROM t""")
def a27_mcnemar(spark, sf_dir):
    """Wins, losses and ties of paired outcomes by label, and the exact p of their difference."""
    pairs = table(spark, sf_dir, "embeddings").select("label", (F.get("embedding", F.lit(0)) > 0).cast("int").alias("a"), (F.get("embedding", F.lit(1)) > 0).cast("int").alias("b"))
    counts = pairs.groupBy("label").agg(F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count_if(F.col("a") > F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))
    return counts.withColumn("p", F.round(metrics.mcnemar(F.col("wins"), F.col("losses")), 6))


@query("p05_dialogue", """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
s AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS j, count(*) OVER (PARTITION BY conv_id) AS m FROM t WHERE role <> 'system'),
f AS (SELECT conv_id, bool_or(coalesce(trim(text), '') = '') AS blank, bool_or(role NOT IN ('system', 'user', 'assistant')) AS odd, bool_or(role = 'system' AND i > 1) AS late FROM t GROUP BY conv_id),
g AS (SELECT conv_id, bool_or(j = 1 AND role <> 'user') AS first_bad, bool_or(role <> CASE WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END) AS alt, bool_or(j = m AND role <> 'assistant') AS last_bad FROM s GROUP BY conv_id)
SELECT f.conv_id, CASE WHEN blank THEN 'blank_content' WHEN odd THEN 'unknown_role' WHEN late THEN 'system_not_first' WHEN g.conv_id IS NULL THEN 'no_turns' WHEN first_bad THEN 'not_started_by_user'
       WHEN alt THEN 'not_alternating' WHEN last_bad THEN 'not_ended_by_assistant' ELSE 'accepted' END AS reason FROM f LEFT JOIN g ON f.conv_id = g.conv_id""")
def p05_dialogue(spark, sf_dir):
    return chat.conversations(table(spark, sf_dir, "conversations")).select("conv_id", validation.dialogue_reason(F.col("messages")).alias("reason"))


_SCOPE_SQL = " ".join(
    f"WHEN {' OR '.join(f'regexp_matches(body, $${chr(40)}?is){p}$$)' for p in patterns)} THEN '{name}'" for name, patterns in validation.SCOPE_PATTERNS.items()
)


@query("p04_scope", f"""
WITH c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body, concat('source', conv_id % 4) AS source FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN source = 'source3' THEN 'source_not_allowed' WHEN length(body) > 6000 THEN 'too_many_characters' {_SCOPE_SQL} ELSE 'accepted' END AS reason FROM c""")
def p04_scope(spark, sf_dir):
    own = chat.conversations(table(spark, sf_dir, "conversations"))
    body = F.array_join(F.col("messages.content"), "\n")
    source = F.concat(F.lit("source"), F.col("conv_id") % 4)
    return own.select("conv_id", validation.scope_reason(source, body, ["source0", "source1", "source2"], 6000).alias("reason"))


@query("e10_chat_mask", r"""
WITH t AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '\n|[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id, CAST(1 + sum(2 + n + 1 + CASE WHEN i > 1 THEN 1 ELSE 0 END) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n + 1 ELSE 0 END) AS BIGINT) AS targets FROM t GROUP BY conv_id""")
def e10_chat_mask(spark, sf_dir):
    """Conversations as tokens with a mask of those that are learnt: an assistant's words and their end."""
    own = chat.serialised(chat.conversations(table(spark, sf_dir, "conversations")))
    return own.select("conv_id", F.size("tokens").cast("long").alias("tokens"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("targets"))


@query("w19_fit_context", r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM conversations WHERE role <> 'system'),
s AS (SELECT conv_id, i, sum(n) OVER (PARTITION BY conv_id ORDER BY i DESC) AS left_over FROM t)
SELECT conv_id, CAST(coalesce(min(CASE WHEN left_over <= 200 THEN i // 2 END), -1) AS BIGINT) AS dropped FROM s WHERE i % 2 = 0 GROUP BY conv_id""")
def w19_fit_context(spark, sf_dir):
    """The fewest oldest pairs to drop until 200 words are not exceeded, -1 where none does."""
    own = table(spark, sf_dir, "conversations").filter("role <> 'system'").select("conv_id", "turn", X.word_count(F.col("text")).alias("n"))
    own = own.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return selection.drop_oldest_pairs(own, "conv_id", "i", "n", 200).select("conv_id", F.coalesce("dropped", F.lit(-1)).cast("long").alias("dropped"))


@query("a29_telemetry", """
SELECT event_type, CAST(count(*) AS BIGINT) AS steps, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)), 6) AS largest FROM events GROUP BY event_type""")
def a29_telemetry(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("steps"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), F.round(F.max(F.abs("value")), 6).alias("largest")
    )


@query("a33_ledger", """
WITH c AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18, 4)) * CAST(CASE event_type WHEN 'purchase' THEN 1.25 WHEN 'click' THEN 0.5 ELSE 0.1 END AS DECIMAL(6, 2))) AS DECIMAL(24, 6)) AS cost FROM events GROUP BY user_id)
SELECT user_id, CAST(cost AS DOUBLE) AS cost, CAST(CAST(cost * CAST(1.15 AS DECIMAL(4, 2)) AS DECIMAL(28, 8)) AS DOUBLE) AS planned, cost * CAST(1.15 AS DECIMAL(4, 2)) > 30000 AS over_cap, CAST(greatest(0, 30000 - CAST(cost * CAST(1.15 AS DECIMAL(4, 2)) AS DECIMAL(28, 8))) AS DOUBLE) AS left_over FROM c""")
def a33_ledger(spark, sf_dir):
    """Costs at a rate by kind, in exact decimals, with a safety factor, against a cap."""
    rate = F.when(F.col("event_type") == "purchase", "1.25").when(F.col("event_type") == "click", "0.5").otherwise("0.1").cast("decimal(6,2)")
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,4)") * rate).cast("decimal(24,6)").alias("c"))
    planned = (F.col("c") * F.lit("1.15").cast("decimal(4,2)")).cast("decimal(28,8)")
    left = F.greatest(F.lit(0).cast("decimal(28,8)"), F.lit(30_000).cast("decimal(28,8)") - planned)
    return own.select("user_id", F.col("c").cast("double").alias("cost"), planned.cast("double").alias("planned"), (planned > 30_000).alias("over_cap"), left.cast("double").alias("left_over"))


@query("o03_best_model", """
SELECT event_type, event_id, round(value, 6) AS metric FROM (
    SELECT *, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
WHERE before IS NULL OR value > before""")
def o03_best_model(spark, sf_dir):
    """Where the metric of a run is better than ever before in it."""
    own = running_max(table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value"), ["event_type"], ["ts", "event_id"], "value")
    return own.filter(F.col("before").isNull() | (F.col("value") > F.col("before"))).select("event_type", "event_id", F.round("value", 6).alias("metric"))


@query("w17_schedule", r"""
WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents), c AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id) AS t, sum(n) OVER () AS z FROM d),
g AS (SELECT doc_id, t::DOUBLE AS t, z // 50 AS w, z // 2 AS s, z - z // 50 - z // 2 AS d, z // 10 AS a, z // 20 AS se, z * 8 // 10 AS co, z - z * 8 // 10 AS cd FROM c)
SELECT doc_id, round(CASE WHEN t < w THEN 0.001 * greatest(t, 1) / w WHEN t <= w + s THEN 0.001 WHEN t >= w + s + d THEN 0.0001 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(pi() * (t - w - s) / d)) END, 9) AS plateau,
    round(CASE WHEN t < w THEN 0.001 * greatest(t, 1) / w WHEN t <= a THEN 0.001 WHEN t <= a + se THEN 0.0008 + 0.0002 * 0.5 * (1 + cos(pi() * (t - a) / se)) WHEN t <= co THEN 0.0008 * pow((a + se) / t, 0.5)
        ELSE 0.0008 * pow((a + se) / co::DOUBLE, 0.5) + (0.0001 - 0.0008 * pow((a + se) / co::DOUBLE, 0.5)) * least(1, (t - co) / cd) END, 9) AS power_law FROM g""")
def w17_schedule(spark, sf_dir):
    """Rates of two schedules by committed tokens, after each document."""
    from siltstone.functions.ordered import running
    from siltstone.operators import schedules

    own = running(table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("n")), [], ["doc_id"], ["n"]).withColumn("t", F.col("before_n") + F.col("n"))
    met, z = own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("z")))), F.col("z")
    part = lambda k, m=1: F.floor(z * m / k)
    plateau = schedules.plateau(F.col("t"), 0.001, part(50), part(2), z - part(50) - part(2), 0.1)
    power = schedules.power_law(F.col("t"), 0.001, part(50), part(10), part(20), 0.8, 0.5, part(10, 8), z - part(10, 8), 0.1)
    return met.select("doc_id", F.round(plateau, 9).alias("plateau"), F.round(power, 9).alias("power_law"))


@query("j15_models_modes", """
SELECT m.label, k.event_type, CAST(count(e.event_id) AS BIGINT) AS results FROM (SELECT DISTINCT label FROM embeddings) m CROSS JOIN (SELECT DISTINCT event_type FROM events) k
LEFT JOIN events e ON e.event_type = k.event_type AND e.user_id % 10 = m.label GROUP BY ALL""")
def j15_models_modes(spark, sf_dir):
    """Every model under every mode with its number of results, zero included; both dimensions are short lists of names."""
    models = table(spark, sf_dir, "embeddings").select("label").distinct()
    modes = table(spark, sf_dir, "events").select("event_type").distinct()
    counts = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).cast("int").alias("label"), "event_type").agg(F.count("*").alias("results"))
    return models.crossJoin(modes).join(counts, ["label", "event_type"], "left").fillna(0, ["results"])


@query("a20_grouping_sets", """
SELECT coalesce(event_type, 'all') AS event_type, CAST(coalesce(user_id % 5, -1) AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS cases, round(avg((value > 50)::INT), 9) AS passed
FROM (SELECT *, user_id % 5 AS p FROM events) GROUP BY GROUPING SETS ((), (event_type), (user_id % 5))""")
def a20_grouping_sets(spark, sf_dir):
    """Pass rates in all, by family and by part, from one pass."""
    own = table(spark, sf_dir, "events").withColumn("p", (F.col("user_id") % 5).cast("long"))
    sets = own.groupingSets([[], ["event_type"], ["p"]], "event_type", "p").agg(F.count("*").alias("cases"), F.round(F.avg((F.col("value") > 50).cast("int")), 9).alias("passed"))
    return sets.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("p", F.lit(-1)).alias("part"), "cases", "passed")


@query("st_windowed", """
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def st_windowed(spark, sf_dir):
    """Days of events by kind: the streaming aggregation, over what is there."""
    from siltstone.streaming import events

    return events.daily(table(spark, sf_dir, "events")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("v09_drift", """
WITH d AS (SELECT source, sum(n_chars) AS t FROM documents GROUP BY source)
SELECT source, round(t / (SELECT sum(t) FROM d)::DOUBLE, 9) AS share, abs(t / (SELECT sum(t) FROM d)::DOUBLE - 0.05) <= 0.01 AS within FROM d""")
def v09_drift(spark, sf_dir):
    """Whether each source's share is within a hundredth of a twentieth."""
    own = metrics.shares(table(spark, sf_dir, "documents"), "source", "n_chars")
    return own.select("source", F.round("share", 9).alias("share"), (F.abs(F.col("share") - 0.05) <= 0.01).alias("within"))


@query("j05_durability", """
WITH m AS (SELECT doc_id, n_chars, md5(text) AS h FROM documents), r AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS n_chars, md5(text) AS h FROM documents WHERE doc_id % 31 <> 0)
SELECT m.doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN m.n_chars <> r.n_chars OR m.h <> r.h THEN 'differs' END AS problem
FROM m LEFT JOIN r USING (doc_id) WHERE r.doc_id IS NULL OR m.n_chars <> r.n_chars OR m.h <> r.h""")
def j05_durability(spark, sf_dir):
    """A manifest against a ledger that lacks some rows and has others changed."""
    from siltstone.operators import verify

    own = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5(F.col("text").cast("binary")).alias("h"))
    ledger = own.filter("doc_id % 31 <> 0").withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0))
    return verify.differences(own, ledger, ["doc_id"], ["n_chars", "h"])
