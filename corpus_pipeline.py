"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, secrets are masked,
sources are mixed to their target weights, and texts are encoded as byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  run() joins the stages without writing between them.  Nulls, empty texts, repeated
rows, empty tables and further columns are treated as the operators' docstrings say; further columns
stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.llm import bpe, mixing, secrets, simhash, toxicity
from siltstone.llm.common import ByPlace, pick
from siltstone.llm.queries import ranks_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score reaches the threshold; the model is trained on the labelled documents of the input."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return simhash.one_of_each(docs, simhash.near_copies(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked; n_chars is that of the masked text."""
    own = ByPlace(secrets.mask(docs))
    length = F.length(own.name("text")).cast(docs.schema["n_chars"].dataType)
    return own.back(own.df.withColumn(own.name("n_chars"), length))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so that sources have their target weights."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, round_trip): every row's text as token ids, and whether they decode to the text."""
    own = pick(docs, "doc_id", "source", "text").withColumn("e", bpe.round_trip_column(F.col("text"), bpe.codec(ranks_path())))
    return own.select("doc_id", "source", F.size("e.ids").cast("long").alias("n_tokens"), "e.ids", "e.round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: zstandard dictionaries and fingerprints have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
