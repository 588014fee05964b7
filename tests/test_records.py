"""Functions and operators on records against plain Python."""

import hashlib
import json
import os
import random
from collections import deque
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siltstone.functions import scalars as S, text as X
from siltstone.functions.ordered import cut, running_max
from siltstone.operators import batching, chat, decontaminate, metrics, mixture, schedules, selection, validation, verify
from siltstone.sources import adapters, frames, jsonl, splits
from siltstone.streaming import frontier, scheduler

TEXTS = ["", " a  b ", "Straße ΣΊΣΥΦΟΣ ﬁne ŉ İ", "tab\there\r\nline  \n\nend \n", 'quote " back \\ \x01 \x7f', "é 😀  x", "\x1c a\x1fb", "ÀÉÎ ẞ", "Ꭰ ꭰ µ ſ"]


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i")
    return [r[0] for r in df.select(make(F.col("t"))).collect()]


def test_folding_equals_python(spark):
    assert column(spark, TEXTS, X.folded) == [" ".join(t.casefold().split()) for t in TEXTS]


def test_json_strings_equal_python(spark):
    assert column(spark, TEXTS, X.json_string) == [json.dumps(t) for t in TEXTS]
    assert column(spark, TEXTS, lambda t: X.canonical_json({"b": X.json_string(t), "a": F.lit("1")})) == [json.dumps({"b": t, "a": 1}, sort_keys=True, separators=(",", ":")) for t in TEXTS]


def test_bare_lines_equal_python(spark):
    assert column(spark, TEXTS, X.bare_lines) == ["\n".join(line.rstrip() for line in t.strip().splitlines()) for t in TEXTS]


def test_quantities(spark):
    cases = {"100M": 10**8, "1,000": 1000, "1_000": 1000, " 2 5 k ": 25_000, "1.5K": 1500, ".5T": 5 * 10**11, "0": None, "-1": None, "1.2": None, "x": None, "": None, "5Q": None, "+3": 3, "7.": 7}
    assert column(spark, list(cases), S.quantity) == list(cases.values())


def test_seed_equals_python(spark):
    assert [int(x) for x in column(spark, ["a", "é"], lambda t: S.seed_of(17, t))] == [int.from_bytes(hashlib.sha256(f"17:{t}".encode()).digest()[:8], "little") for t in ("a", "é")]


def test_rule_checks(spark):
    rules = lambda t: F.struct(*[c.alias(n) for n, c in S.rule_checks(t, exact="Yes!", required=("YES",), regex=r"!$", most_tokens=1, tokens=F.lit(1), most_words=1, suffix="s!", ended=F.lit(True)).items()])
    got = [r.asDict() for r in column(spark, [" Yes! ", "yes!", "User: yes!"], rules)]
    assert [r["passed"] for r in got] == [True, False, False] and got[1]["exact"] is False and got[2]["no_role_leak"] is False and got[2]["maximum_words"] is False


def test_json_lists(spark):
    cases = {"[1]": "[1]", "```json\n[1]\n```": "[1]", "```\n[]\n```  ": "[]", '{"a":1}': None, "```[1]": None, "text": None, "``````": None}
    assert column(spark, list(cases), X.json_list) == list(cases.values())


def test_snippet(spark):
    text = "x" * 50 + " " + "word " * 40 + "target's tail " + "more " * 40
    at = text.index("target") + 2
    got = column(spark, [text], lambda t: X.snippet(t, F.lit(at), F.lit(at + 1)))[0]
    assert got.startswith("...") and got.endswith("...") and " [target's] tail " in got
    assert column(spark, ["a b c"], lambda t: X.snippet(t, F.lit(2), F.lit(3))) == ["a [b] c"]


def test_snippet_of_a_word_after_a_line_end(spark):
    for end in ("\n", "\r", "\r\n", "\u0085", "\u2028"):
        at = len("one two" + end)
        assert column(spark, ["one two" + end + "three four"], lambda t: X.snippet(t, F.lit(at), F.lit(at))) == ["one two [three] four"]


def test_contaminated_equals_all_pairs(spark):
    random.seed(1)
    words = ["a", "bb", "ccc", "dddd", "longerword", "x" * 40]
    some = lambda k: " ".join(random.choice(words) for _ in range(k))
    docs = [(i, some(random.randint(0, 40))) for i in range(150)] + [(500, None), (501, "a bb")]
    probes = ["", "a bb", None, "x" * 32, "x" * 20 + " longerword " + "x" * 10] + [t[random.randint(0, 5) : random.randint(20, 90)].strip() for _, t in docs[:60] if t] + [some(k) for k in range(1, 8) for _ in range(10)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "i long, t string"), spark.createDataFrame([(p,) for p in probes], "p string"), "i", "t", "p")
    want = {i for i, t in docs if t is not None and any(p and (t == p or len(p) >= 32 and p in t) for p in probes if p)}
    assert {r.i for r in got.collect()} == want and 20 < len(want) < 152


def test_running_max_equals_a_loop(spark):
    random.seed(2)
    data = [(random.choice("ab"), i, random.randint(0, 1000)) for i in range(400)]
    got = {r.i: r.before for r in running_max(spark.createDataFrame(data, "g string, i long, n long").repartition(6), ["g"], ["i"], "n").collect()}
    best = {}
    for g, i, n in data:
        assert got[i] == best.get(g)
        best[g] = max(best.get(g, n), n)


def test_medians(spark):
    data = [("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 1.0), ("b", 4.0), ("c", 7.0)]
    got = {r.g: r["median"] for r in metrics.medians(spark.createDataFrame(data, "g string, v double"), "g", "v").collect()}
    assert got == {"a": 2.0, "b": 2.5, "c": 7.0}


def test_first_wins_keeps_whole_rows_and_one_null_key(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "w")], "i long, k string, v string")
    assert sorted(tuple(r) for r in selection.first_wins(df, "k", "i").collect()) == [(1, "a", "x"), (3, None, "z")]


def test_lines_of_all_ends(spark, tmp_path):
    (tmp_path / "f").write_bytes("ab\r\ncd\r\né\nlast".encode())
    got = [(r.record_start, r.raw) for r in splits.lines(spark, str(tmp_path / "f")).orderBy("record_start").collect()]
    assert got == [(0, "ab"), (4, "cd"), (8, "é"), (11, "last")]


def test_split_order_equals_hashlib(spark):
    df = spark.createDataFrame([("f", i * 10) for i in range(30)], "path string, range_start long")
    got = [r.id for r in splits.shuffled(df, "seed").orderBy("place").collect()]
    assert got == sorted((f"f:{i * 10}" for i in range(30)), key=lambda x: hashlib.sha256(b"seed\0" + x.encode()).digest())


@pytest.mark.parametrize("bad,word", [("\n", "blank"), ("[1]\n", "not_an_object"), ("{\n", "invalid")])
def test_strict_lines(spark, tmp_path, bad, word):
    (tmp_path / "f").write_text('{"a": 1}\n{"a": 2}\n')
    assert [r.a for r in jsonl.read_strict(spark, str(tmp_path / "f"), "a int").collect()] == [1, 2]
    (tmp_path / "g").write_text('{"a": 1}\n' + bad + '{"a": 2}\n')
    with pytest.raises(PySparkException, match=f"{word} JSON line at .*g:2"):
        jsonl.read_strict(spark, str(tmp_path / "g"), "a int").collect()


def test_conversations_of_json_lines(spark, tmp_path):
    rows = [{"conversation_id": "1", "source": "s", "messages": [{"role": "user", "content": "x"}]}, {"conversation_id": "2", "messages": []}]
    (tmp_path / "f").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    assert [(r.conversation_id, r.source) for r in jsonl.conversations(spark, str(tmp_path / "f"), default="d").orderBy("conversation_id").collect()] == [("1", "s"), ("2", "d")]
    assert jsonl.conversations(spark, str(tmp_path / "f"), source="s").count() == 1


def test_batches_within_all_limits(spark):
    random.seed(3)
    data = [("ab"[i % 2], i, random.randint(1, 9), random.randint(1, 90)) for i in range(300)]
    got = batching.next_fit(spark.createDataFrame(data, "g string, i long, n long, b long"), "g", ["i"], {"n": 20, "b": 150}, 5).collect()
    groups = {}
    for r in sorted(got, key=lambda r: r.i):
        groups.setdefault((r.g, r.batch), []).append(r)
    for (g, batch), rows in groups.items():
        assert len(rows) <= 5 and sum(r.n for r in rows) <= 20 and sum(r.b for r in rows) <= 150
        later = groups.get((g, batch + 1))
        assert later is None or len(rows) == 5 or sum(r.n for r in rows) + later[0].n > 20 or sum(r.b for r in rows) + later[0].b > 150


def test_bisected_retries():
    calls = []

    def attempt(part):
        calls.append(len(part))
        if any(x % 7 == 3 for x in part):
            raise ValueError("bad item")
        return [x * 2 for x in part]

    results, failed = batching.bisected(list(range(20)), attempt)
    assert results == [x * 2 for x in range(20) if x % 7 != 3] and failed == [3, 10, 17] and calls[0] == 20
    assert batching.bisected([], attempt) == ([], [])


def test_prompts_and_reasoning_tokens(spark):
    messages = [{"role": "system", "content": "s t"}, {"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}, {"role": "user", "content": "c"}]
    df = spark.createDataFrame([(messages,)], "m array<struct<role:string,content:string>>")
    assert df.select(chat.prompt_tokens(F.col("m"))).first()[0] == [
        "<end>", "System:", "\n", "s", "t", "\n", "\n", "User:", "\n", "a", "\n", "\n", "Assistant:", "\n", "b", "<end>", "\n", "User:", "\n", "c", "\n", "\n", "Assistant:", "\n",
    ]
    assert df.select(chat.layout(F.col("m"))).first()[0] == "System:\ns t\n\nUser:\na\n\nAssistant:\nb\nUser:\nc\n"
    assert column(spark, ["a<think>b</think><answer>c d<think"], chat.reasoning_tokens) == [["a", "<think>", "b", "</think>", "<answer>", "c", "d<think"]]


def test_whole_units(spark):
    df = spark.createDataFrame([("a", "0.500"), ("b", "0.250"), ("c", "0.125")], "g string, w string").withColumn("w", F.col("w").cast("decimal(9,3)"))
    assert {r.g: r.units for r in mixture.whole_units(df, "w", 3).collect()} == {"a": 4, "b": 2, "c": 1}


def test_allocation_fills_what_others_lack(spark):
    df = spark.createDataFrame([("a", 1), ("b", 50), ("c", 4)], "s string, n long")
    assert {r.s: r.taken for r in selection.allocated(df, "s", "n", F.lit(30)).collect()} == {"a": 1, "b": 25, "c": 4}


def test_discontinuities(spark):
    df = spark.createDataFrame([("f", 0, 5), ("f", 5, 9), ("f", 8, 12), ("f", 14, 15), ("g", 3, 4)], "f string, s long, e long")
    assert sorted((r.s, r.problem, r.size) for r in verify.discontinuities(df, ["f"], ["s"], "s", "e").collect()) == [(8, "overlap", 1), (14, "gap", 2)]


def test_tree_digest_ignores_order(spark):
    df = spark.createDataFrame([("a", f"line {i}") for i in range(50)], "g string, l string")
    one, two = (verify.tree_digest(d, ["g"], "l").first().digest for d in (df, df.orderBy(F.desc("l")).repartition(5)))
    assert one == two != verify.tree_digest(df.filter("l <> 'line 3'"), ["g"], "l").first().digest


def test_problems_and_kinds(spark):
    df = spark.createDataFrame([(1, 5, "run-SFT".lower()), (2, None, "excluded-sft"), (3, 0, "plain")], "k long, n long, r string")
    assert sorted(tuple(r) for r in verify.problems(df, ["k"], {"low": F.col("n") < 1, "high": F.col("n") > 4}).collect()) == [(1, "high"), (3, "low")]
    assert [r[0] for r in df.orderBy("k").select(validation.run_kind(F.col("r"), ["excluded"], {"sft": ["sft"]})).collect()] == ["sft", None, None]


def test_a_stream_is_published_once_whatever_fails(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    rows = spark.range(0, 100).select("id", (F.col("id") * 2).alias("v"))
    rows.filter("id < 50").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    assert frontier.ready(spark, folder).count() == 0
    frontier.publish(stream(), folder, checkpoint, "id").awaitTermination()
    first = frontier.ready(spark, folder)
    before = spark.createDataFrame(first.collect(), first.schema)
    # an attempt that wrote its rows and failed before they were listed
    rows.filter("id >= 90").write.parquet(f"{folder}/blocks/batch=7")
    assert frontier.published(spark, folder).count() == 50
    rows.filter("id >= 50").repartition(3).write.mode("append").parquet(source)
    frontier.publish(stream(), folder, checkpoint, "id").awaitTermination()
    assert sorted(r.id for r in frontier.published(spark, folder).collect()) == list(range(100))
    assert frontier.faults(spark, folder, before).count() == 0
    # batches that are repeated after the checkpoint is lost are overwritten, not added
    for name in sorted(os.listdir(f"{checkpoint}/commits")):
        os.remove(f"{checkpoint}/commits/{name}")
    frontier.publish(stream(), folder, checkpoint, "id").awaitTermination()
    assert sorted(r.id for r in frontier.published(spark, folder).collect()) == list(range(100))


def test_minimal_prefix_of_a_measure_that_falls_now_and_then():
    random.seed(4)
    for _ in range(200):
        measures, total = [0], 0
        for _ in range(60):
            total += random.randint(0, 9)
            measures.append(total - random.choice([0, 0, 12]))
        target = random.randint(1, 400)
        got = selection.minimal_prefix(60, target, lambda a, b: {k: measures[k] for k in range(a, b + 1)})
        assert got == (next(k for k, m in enumerate(measures) if m >= target) if measures[60] >= target else None)


def test_frames_round_trip_and_faults(spark):
    random.seed(5)
    data = [(i, f"r{i}", "ä", [random.randrange(65_536) for _ in range(n)], [random.random() < 0.5 for _ in range(n - 2)] + [True]) for i, n in enumerate(random.randint(2, 9) for _ in range(40))]
    df = spark.createDataFrame(data, "i long, record_id string, source string, tokens array<int>, mask array<boolean>")
    stored = cut(frames.build(df, "i", 10, 300))
    assert sorted((r.record_id, tuple(r.tokens), tuple(r["mask"])) for r in frames.read(stored).collect()) == sorted((n, tuple(t), tuple(m)) for _, n, _, t, m in data)
    assert frames.faults(stored).count() == 0 and stored.filter("targets > 10").count() == 0
    one = stored.filter("block = 1").first().frame
    flaws = {
        bytes(one[:9]): "truncated", b"X" + bytes(one[1:]): "mark", bytes(one) + b"0": "size", bytes(one).replace(b"lengths", b"lengthz"): "header",
        bytes(one).replace(b'"schema_version":1', b'"schema_version":2'): "version", bytes(one[:-1]) + b"\x07": "mask",
    }
    for bad, word in flaws.items():
        with pytest.raises(ValueError, match=word):
            frames.decode_block(bad)
    changed = stored.withColumn("frame", F.when(F.col("block") == 2, F.concat("frame", F.lit(b"0"))).otherwise(F.col("frame"))).withColumn("cumulative", F.when(F.col("block") == 3, 0).otherwise(F.col("cumulative")))
    assert sorted(tuple(r) for r in frames.faults(changed).collect()) == [(2, "byte_size"), (2, "checksum"), (2, "size"), (3, "cumulative")]


def test_coverage_of_plans(spark):
    files = spark.createDataFrame([("a", 10), ("b", 4), ("c", 3)], "path string, size long")
    items = spark.createDataFrame([("a", 0, 6), ("a", 6, 10), ("b", 0, 3), ("b", 2, 4)], "path string, range_start long, range_end long")
    assert {r.path: r.exact for r in splits.coverage(items, files).collect()} == {"a": True, "b": False, "c": False}
    assert splits.coverage(splits.ranges(files, 3), files).filter("NOT exact").count() == 0


def test_mixer_equals_a_loop(spark):
    shares, target, seed = {"a": 0.5, "b": 0.3, "c": 0.2}, 400, 17
    data = [("abc"[i % 3], i, 1 + (i * 37) % 23) for i in range(120)]
    got = [(r.s, r.i) for r in sorted(mixture.mixed(spark.createDataFrame(data, "s string, i long, n long"), "s", "i", "n", shares, target, seed).collect(), key=lambda r: r.place)]
    heads = {s: iter([x for x in data if x[0] == s]) for s in shares}
    pending = {s: next(h) for s, h in heads.items()}
    taken, left, draw, want = dict.fromkeys(shares, 0), target, random.Random(seed), []
    while left > 0:
        fits = {s: taken[s] / shares[s] for s, x in pending.items() if x and x[2] <= left}
        if not fits:
            break
        ties = sorted(s for s, p in fits.items() if abs(p - min(fits.values())) <= 1e-12)
        s = ties[draw.randrange(len(ties))]
        want.append(pending[s][:2])
        taken[s] += pending[s][2]
        left -= pending[s][2]
        pending[s] = next(heads[s], None)
    assert got == want and left >= 0
    with pytest.raises(ValueError):
        mixture.mixed(spark.createDataFrame(data, "s string, i long, n long"), "s", "i", "n", {"a": 0.5}, target, seed)


def test_mixed_order_is_exact_for_thirds(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("a", 4, 1), ("b", 1, 1), ("b", 2, 1)], "s string, i long, n long")
    got = selection.mixed_order(df, "s", ["i"], "n", {"a": 3, "b": 1}).orderBy("sort_key", "s").collect()
    assert [(r.s, r.i) for r in got] == [("a", 1), ("b", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 2)]


def test_schedules_meet_their_landmarks(spark):
    at = lambda t, f: spark.range(1).select(f(F.lit(float(t)))).first()[0]
    n = lambda x: F.lit(float(x))
    plateau = lambda t: schedules.plateau(t, 1.0, n(10), n(40), n(50), 0.1)
    assert [round(at(t, plateau), 6) for t in (5, 10, 50, 75, 100, 999)] == [0.5, 1.0, 1.0, 0.55, 0.1, 0.1]
    power = lambda t: schedules.power_law(t, 1.0, n(10), n(20), n(5), 0.8, 0.5, n(100), n(10), 0.1)
    assert [round(at(t, power), 6) for t in (5, 20, 25, 100, 105, 110)] == [0.5, 1.0, 0.8, 0.4, 0.25, 0.1]


def test_adapters(spark):
    own = adapters.Adapters()
    own.add("b", 1, lambda s, _: s.createDataFrame([(1, "x", 0)], "id int, text string, more int"))
    own.add("a", 0, lambda s, _: s.createDataFrame([(2, "y")], "id long, text string"))
    assert [tuple(r) for r in own.read(spark, "").orderBy("priority").collect()] == [("a", 0, 2, "y"), ("b", 1, 1, "x")]
    assert own.read(spark, "", ["b"]).count() == 1
    for call in (lambda: own.add("a", 5, None), lambda: own.add("c", 0, None), lambda: own.read(spark, "", ["z"])):
        with pytest.raises(ValueError):
            call()


def plain_scheduler(data, units, seed, limits):
    """One document after another, from the definition."""
    queues, sent, since, out, whole = {g: [] for g in units}, dict.fromkeys(units, 0), 0, [], sum(units.values())

    def send(groups):
        total = sum(sent.values())
        lack = {g: units[g] * total - sent[g] * whole for g in groups}
        g = min((g for g in groups if lack[g] == max(lack.values())), key=lambda t: hashlib.sha256(f"{seed}\0{len(out)}\0{t}".encode()).digest())
        i, n = queues[g].pop(0)
        sent[g] += n
        out.append((g, i))

    for g, i, n in data:
        if len(queues[g]) >= limits.queue:
            send([g])
            since = 0
        queues[g].append((i, n))
        since += 1
        populated = [x for x in queues if queues[x]]
        if (len(populated) >= limits.groups and sum(m for q in queues.values() for _, m in q) >= limits.size) or since >= limits.waiting:
            send(populated)
            since = 0
    so_far = len(out)
    while any(queues.values()):
        send([x for x in queues if queues[x]])
    return out, so_far


def test_queued_scheduler_equals_its_definition(spark):
    random.seed(6)
    units, data = {1: 3, 2: 2, 3: 1}, [(random.choice([1, 1, 1, 2, 3]), i, random.randint(1, 9)) for i in range(400)]
    for limits in (scheduler.Limits(queue=4, groups=2, size=20, waiting=7), scheduler.Limits(queue=100, groups=3, size=60, waiting=1000)):
        got = scheduler.queued(spark.createDataFrame(data, "g long, i long, n long").repartition(5), "g", "i", "n", units, "s", limits).collect()
        assert [(r.g, r.i) for r in sorted(got, key=lambda r: r.place)] == plain_scheduler(data, units, "s", limits)[0]


def test_mixture_bound_is_kept_or_approached():
    random.seed(7)
    units = {1: 1, 2: 1, 3: 2}
    desk = scheduler.Desk(units, "s", scheduler.Limits(queue=1000, groups=1, bound="0.2", window=100))
    before = None
    for i in range(2000):
        for _ in desk.arrive(random.choice([1, 2, 3]), i, random.randint(1, 5)):
            now = desk._error()
            assert before is None or now <= desk_bound or now < before
            before = now
        desk_bound = 0.2
    assert sum(desk.sent.values()) > 1000 and before <= 0.2


def plain_bounded(data, units, seed, limits):
    """The same under a bound: before one leaves, the window that each head would make is summed anew."""
    queues, left, since, whole, bound = {g: [] for g in units}, [], 0, sum(units.values()), Fraction(limits.bound)

    def error(gone):
        last = [g for g, n in gone for _ in range(n)][-limits.window :]
        return max(abs(Fraction(last.count(g), len(last)) - Fraction(u, whole)) for g, u in units.items()) if last else Fraction(0)

    def send(groups):
        sent = {g: sum(n for h, _, n in left if h == g) for g in units}
        lack = {g: units[g] * sum(sent.values()) - sent[g] * whole for g in groups}
        g = min((g for g in groups if lack[g] == max(lack.values())), key=lambda t: hashlib.sha256(f"{seed}\0{len(left)}\0{t}".encode()).digest())
        left.append((g, *queues[g].pop(0)))

    for g, i, n in data:
        if len(queues[g]) >= limits.queue:
            send([g])
            since = 0
        queues[g].append((i, n))
        since += 1
        waiting = [x for x in queues if queues[x]]
        if (len(waiting) >= limits.groups and sum(m for q in queues.values() for _, m in q) >= limits.size) or since >= limits.waiting:
            gone = [(h, m) for h, _, m in left]
            now = error(gone)
            then = {x: error([*gone, (x, queues[x][0][1])]) for x in waiting}
            welcome = [x for x in waiting if not left or (then[x] <= bound if now <= bound else then[x] < now)]
            if welcome:
                send(welcome)
                since = 0
    while any(queues.values()):
        send([x for x in queues if queues[x]])
    return [(g, i) for g, i, _ in left]


@pytest.mark.parametrize("bound, window", [("0.05", 40), ("0.2", 25), ("0", 30), ("0.1", 1000)])
def test_bounded_scheduler_equals_its_definition(bound, window):
    rng, units = random.Random(window), {1: 3, 2: 2, 3: 1, 4: 1}
    limits = scheduler.Limits(queue=6, groups=2, size=15, waiting=9, bound=bound, window=window)
    data = [(rng.choice([1, 1, 2, 3, 4]), i, rng.choice([1, 2, 5, 9, 45])) for i in range(300)]
    desk, out = scheduler.Desk(units, "s", limits), []
    for k, row in enumerate(data):
        out += desk.arrive(*row)
        if k % 50 == 0:  # what is kept of the window is made again with a state
            again = scheduler.Desk(units, "s", limits)
            again.loads(desk.dumps())
            desk = again
    assert [(g, i) for g, i, _, _ in out + desk.finish()] == plain_bounded(data, units, "s", limits)


def test_bounded_scheduler_does_not_read_its_window_for_each_arrival():
    read = 0

    class Counted(deque):
        def __iter__(self):
            nonlocal read
            for x in super().__iter__():
                read += 1
                yield x

        def __reversed__(self):
            nonlocal read
            for x in super().__reversed__():
                read += 1
                yield x

    rng, units = random.Random(9), dict.fromkeys(range(8), 1)
    desk = scheduler.Desk(units, "s", scheduler.Limits(queue=50, groups=4, bound="0.05", window=1000))
    desk.recent = Counted()
    for i in range(3000):
        desk.arrive(rng.randrange(8), i, rng.randint(1, 3))
    assert len(desk.recent) > 400 and read < 20 * 3000


def test_scheduler_state_survives_a_restart(spark, tmp_path):
    random.seed(8)
    units, limits = {1: 3, 2: 2, 3: 1}, scheduler.Limits(queue=6, groups=2, size=15, waiting=9)
    data = [(random.choice([1, 2, 3]), i, random.randint(1, 9)) for i in range(300)]
    rows = spark.createDataFrame(data, "g long, i long, n long")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for k in range(3):  # three runs of the query, each from where the last one ended
        rows.filter(F.col("i").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        left = scheduler.scheduled_stream(stream, "g", "i", "n", units, "s", limits)
        left.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want, so_far = plain_scheduler(data, units, "s", limits)
    got = [(r.g, r.i) for r in spark.read.parquet(out).orderBy("place").collect()]
    assert got == want[:so_far] and 200 < so_far < 300
    other = scheduler.Desk({1: 1}, "s", limits)
    with pytest.raises(ValueError):
        other.loads(scheduler.Desk(units, "s", limits).dumps())
