import os
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import bpe, mixing, queries
from tests.llm.helpers import EDGE, edge

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_equals_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    assert docs.filter("NOT round_trip").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    key = lambda d: sorted((r.doc_id, r.n_tokens) for r in d.select("doc_id", "n_tokens").collect())
    assert key(whole) == key(docs)


def test_stages_are_the_five():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "secrets", "mixing", "byte-level BPE"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_every_stage_takes_edge_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ids that are shared or missing, columns whose names clash."""
    df = edge(spark)
    df.select("doc_id", F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, str(tmp_path))
        assert got.columns == df.columns, name
        kept = Counter((r[0], r[1]) for r in got.collect())
        if name == "near copies":
            assert kept == Counter([EDGE[0], EDGE[3], EDGE[4], EDGE[7], EDGE[8]])  # blank texts are one group, as are the equal ones
        elif name == "mixing":
            assert set(kept) <= set(EDGE) and kept.total() == mixing.mix(df).agg(F.sum("copies")).first()[0]
        else:
            assert kept == Counter(EDGE), name
    got = corpus_pipeline.encode(spark, df, str(tmp_path)).collect()
    assert len(got) == len(EDGE) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}


def test_ids_of_the_last_stage_equal_the_library(spark):
    encoding = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(queries.ranks_path()), special_tokens={})
    got = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.encode(spark, edge(spark), "").collect()}
    assert got == {(i, tuple(encoding.encode_ordinary(t or ""))) for i, t in EDGE}
