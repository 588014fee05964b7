from pyspark.sql import functions as F

from siltstone.sources import shards, splits


def test_shards_round_trip_and_problems(spark):
    data = [(i, [i, 50_256, 256 * i % 50_257]) for i in range(21)]
    made = shards.build(spark.createDataFrame(data, "seq long, tokens array<int>").repartition(5), 4, 2)
    assert sorted((r.shard, r.sequences, r.first_block, r.last_block) for r in made.collect()) == [(0, 8, 0, 1), (1, 8, 2, 3), (2, 5, 4, 5)]
    assert sorted((r.seq, r.tokens) for r in shards.decode(made, 3, 4).collect()) == data
    assert shards.problems(made, 3).count() == 0
    bad = made.withColumn("checksum", F.when(F.col("shard") == 1, "0").otherwise(F.col("checksum")))
    assert [tuple(r) for r in shards.problems(bad, 3).collect()] == [(1, "checksum")]
    assert {r.problem for r in shards.problems(made, 4).collect()} == {"size"}
    assert {r.problem for r in shards.problems(made, 3, 50_256).collect()} == {"token_range"}


def test_lines_have_their_offsets(spark, tmp_path):
    rows = ["é" * (i % 5) + str(i) for i in range(50)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part_0.jsonl").write_text("\n".join(rows) + "\n")
    got = sorted((r.record_start, r.raw) for r in splits.lines(spark, str(tmp_path / "in")).collect())
    want, at = [], 0
    for raw in rows:
        want.append((at, raw))
        at += len(raw.encode()) + 1
    assert got == want
    listing = splits.files(spark, str(tmp_path / "in"), "part_*.jsonl")
    assert [(r.range_start, r.range_end) for r in splits.ranges(listing, 100).orderBy("range_start").collect()] == [(s, min(s + 100, at)) for s in range(0, at, 100)]


def test_writers(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("split"))
    shards.write_jsonl(df, str(tmp_path / "j"), "id")
    assert [r.id for r in spark.read.json(str(tmp_path / "j")).orderBy("id").collect()] == list(range(100))
    shards.write_by(df, str(tmp_path / "p"), ["split"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("split = 1").count() == 50
