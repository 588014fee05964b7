"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import secrets

    return secrets.scan(_table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import html_extract

    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import ann

    return ann.search(_table(spark, sf_dir, "embeddings"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import topk

    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import bpe

    return bpe.digests(_table(spark, sf_dir, "documents"), ranks_path())


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import licences

    return licences.scan(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import mixing

    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import chat

    return chat.render(_table(spark, sf_dir, "conversations"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import simhash

    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from siltstone.llm import chat, mixing

    return {"op7_mixing": mixing.SQL, "op9_chat": chat.SQL}
