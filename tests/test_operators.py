import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions.ordered import running
from siltstone.operators import chat, metrics, mixture, packing, selection, validation, verify


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_running_equals_a_loop(spark):
    random.seed(1)
    data = [(random.choice("abc"), i, random.randint(0, 9)) for i in range(500)]
    got = rows(running(spark.createDataFrame(data, "g string, i long, n long").repartition(7), ["g"], ["i"], ["n"]), "g", "i", "number", "before_n")
    want, state = [], {}
    for g, i, n in data:
        k, s = state.get(g, (0, 0))
        want.append((g, i, k + 1, s))
        state[g] = (k + 1, s + n)
    assert got == sorted(want)


def test_running_empty(spark):
    assert running(spark.createDataFrame([], "g string, i long, n long"), ["g"], ["i"], ["n"]).count() == 0


@pytest.mark.parametrize("context", [1, 3, 8])
def test_packing_equals_a_list_of_tokens(spark, context):
    lengths = [0, 1, 5, 8, 2, 17, 1]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    got = rows(packing.incidence(packing.positions(df, [], ["doc_id"], "n"), context), "doc_id", "seq", "tokens")
    stream = [d for d, n in enumerate(lengths) for _ in range(n)]
    want = {}
    for p, d in enumerate(stream):
        seq = 0 if p == 0 else (p - 1) // context
        want[d, seq] = want.get((d, seq), 0) + 1
    assert got == sorted((d, s, n) for (d, s), n in want.items())


@pytest.mark.parametrize("total,context,count", [(0, 4, 0), (1, 4, 1), (5, 4, 2), (4, 4, 1), (9, 4, 3)])
def test_sequence_count(spark, total, context, count):
    assert spark.range(1).select(packing.sequence_count(F.lit(total), context)).first()[0] == count


def test_windows(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [9]), (3, [7, 9]), (4, [])], "id long, t array<int>")
    got = rows(packing.windows(df, "t", 2, 9, 0), "id", "window", "valid_targets", "window_tokens")
    assert got == [(1, 0, 2, [1, 2, 3]), (1, 1, 2, [3, 4, 5]), (1, 2, 1, [5, 9, 0]), (3, 0, 1, [7, 9, 0])]


def test_next_fit(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("a", 4, 2), ("b", 1, 10), ("b", 2, 1)], "g string, i long, n long")
    assert rows(packing.next_fit(df, "g", "i", "n", 10), "g", "i", "block") == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, 1), ("b", 1, 0), ("b", 2, 1)]


def test_split_hash_equals_hashlib(spark):
    def want(name, start, p):
        part = lambda s: len(s.encode()).to_bytes(8, "big") + s.encode()
        raw = part("v1") + part("17") + part("main") + part(name) + start.to_bytes(8, "big")
        return int.from_bytes(hashlib.sha256(raw).digest()[:8], "big") < int(p * 2**64)

    data = [(f"fé{i}.jsonl", i * 37) for i in range(200)]
    df = spark.createDataFrame(data, "f string, s long").select("f", "s", X.is_validation("v1", "17", "main", F.col("f"), F.col("s"), 0.3).alias("v"))
    assert [r.v for r in df.orderBy("s").collect()] == [want(f, s, 0.3) for f, s in data]
    assert not df.select(X.is_validation("v1", "1", "m", F.col("f"), F.col("s"), 0.0).alias("v")).filter("v").count()


@pytest.mark.parametrize("n,h", [(3, 1), (100, 1), (250, 2)])
def test_hold_out_sizes(spark, n, h):
    df = spark.range(n).select(F.lit("g").alias("g"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("k"))
    counts = {r.split: r["count"] for r in selection.hold_out(df, ["g"], "k", 0.01).groupBy("split").count().collect()}
    assert counts == {"validation": h, "test": h, "train": n - 2 * h}


def test_parse_output(spark):
    data = ["<think>a</think><answer>b</answer>", "a", "<think>a", "<think></think>b", "<think>a</think>", " <think> a </think> <final> b c </final> ", None]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(x, i) for i, x in enumerate(data)], "o string, i int").orderBy("i").select(X.parsed_output(F.col("o"))).collect()]
    assert got == [("a", "b"), None, None, None, None, ("a", "b c"), None]


def test_budget_includes_the_row_that_reaches_the_target(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "i long, n long")
    assert rows(selection.budget(df, ["i"], "n", 6, 12), "i") == [(1,), (2,)]
    assert rows(selection.budget(df, ["i"], "n", 6, 9), "i") == [(1,)]


def test_deficit_scheduler_equals_its_definition(spark):
    units, data = {1: 2, 2: 1, 3: 1}, [(g, i, 1 + (i * 7 + g) % 5) for g in (1, 2, 3) for i in range(20)]
    got = [r[:2] for r in sorted(rows(mixture.scheduled(spark.createDataFrame(data, "g long, i long, n long"), "g", "i", "n", units, "s"), "g", "i", "place"), key=lambda r: r[2])]
    queues, emitted, total, out = {g: [x for x in data if x[0] == g] for g in units}, dict.fromkeys(units, 0), 0, []
    while any(queues.values()):
        lack = {g: units[g] * total - emitted[g] * 4 for g in queues if queues[g]}
        g = min((g for g in lack if lack[g] == max(lack.values())), key=lambda g: hashlib.sha256(f"s\0{len(out)}\0{g}".encode()).digest())
        _, i, n = queues[g].pop(0)
        emitted[g] += n
        total += n
        out.append((g, i))
    assert got == out


@pytest.mark.parametrize("wins,losses,p", [(0, 0, 1.0), (5, 0, 0.0625), (3, 3, 1.0), (10, 2, 0.03857421875)])
def test_mcnemar(spark, wins, losses, p):
    assert spark.range(1).select(metrics.mcnemar(F.lit(wins).cast("long"), F.lit(losses).cast("long"))).first()[0] == pytest.approx(p)


def test_calibration_last_bin(spark):
    df = spark.createDataFrame([(1.0, True), (0.999, False)], "c double, y boolean")
    assert rows(metrics.calibration(df, "c", "y"), "bin", "n") == [(14, 2)]


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(400).select(F.col("id").alias("unit"), (F.col("id") % 10).cast("double").alias("x"), F.lit(1).alias("n"))
    low, high = metrics.bootstrap(df, "unit", "x", "n", 200, 3).first()
    assert 4.0 < low < 4.5 < high < 5.0


def test_record_reasons(spark):
    cases = [
        ("nonsense", "json_parse_error"), ("[1]", "json_parse_error"), ('{"tokens":[1]}', "missing_cluster_id"), ('{"cluster_id":null,"tokens":[1]}', "missing_cluster_id"),
        ('{"cluster_id":true,"tokens":[1]}', "cluster_id_not_integer"), ('{"cluster_id":0,"tokens":[1]}', "cluster_id_out_of_range"), ('{"cluster_id":1}', "missing_tokens"),
        ('{"cluster_id":1,"tokens":"x"}', "tokens_not_list"), ('{"cluster_id":1,"tokens":[]}', "tokens_empty"), ('{"cluster_id":1,"tokens":[1,true,99999]}', "token_not_integer"),
        ('{"cluster_id":1,"tokens":[1,50257,true]}', "token_out_of_range"), ('{"cluster_id":1,"tokens":[1],"token_count":"1"}', "token_count_not_integer"),
        ('{"cluster_id":1,"tokens":[1],"token_count":2}', "token_count_mismatch"), ('{"cluster_id":1,"tokens":[1,2],"token_count":2,"more":0}', "accepted"),
    ]
    df = spark.createDataFrame([(raw, i) for i, (raw, _) in enumerate(cases)], "raw string, i int").orderBy("i")
    assert [r[0] for r in df.select(validation.record_reason(F.col("raw"))).collect()] == [reason for _, reason in cases]


def test_dialogue_reasons(spark):
    m = lambda *x: [{"role": r, "content": c} for r, c in x]
    cases = [
        (m(("user", "a"), ("assistant", "b")), "accepted"), (m(("system", "s"), ("user", "a"), ("assistant", "b")), "accepted"), (m(("user", "a")), "not_ended_by_assistant"),
        (m(("assistant", "a")), "not_started_by_user"), (m(("user", " "), ("assistant", "b")), "blank_content"), (m(("user", "a"), ("system", "b")), "system_not_first"),
        (m(("user", "a"), ("user", "b"), ("assistant", "c")), "not_alternating"), (m(("bot", "a")), "unknown_role"), (m(("system", "a")), "no_turns"), ([], "empty"),
    ]
    df = spark.createDataFrame([(x, i) for i, (x, _) in enumerate(cases)], "m array<struct<role:string,content:string>>, i int").orderBy("i")
    assert [r[0] for r in df.select(validation.dialogue_reason(F.col("m"))).collect()] == [reason for _, reason in cases]


def test_chat_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    r = chat.serialised(chat.conversations(df)).first()
    assert [t for t, m in zip(r.tokens, r.mask) if m] == ["c", "<end>"] and len(r.tokens) == len(r.mask)


def test_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "w")], "k long, v string")
    assert rows(verify.differences(a, b, ["k"], ["v"]), "k", "problem") == [(2, "differs"), (4, "unexpected")]


def test_streaming_equals_batch(spark, tmp_path):
    from siltstone.streaming import events

    data = spark.range(200).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 1800).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("k").alias("event_type"), F.col("id").cast("double").alias("value")
    )
    data.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.daily(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert rows(spark.table("daily"), "day", "events", "total") == rows(events.daily(data), "day", "events", "total")
