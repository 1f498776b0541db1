"""A corpus pipeline of five stages, each applying one operator to all that its predecessor kept.

Stages are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; others are left
out. Every stage takes empty tables, null and empty texts, null ids, repeated
rows and ids, and texts of any length; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.llm import exact_dedup, mixing, near_dedup, pieces, toxicity
from rillet.scratch import cut, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; without a single label to learn from, all. Null and empty texts score the intercept."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs.select(*COLUMNS), model, "_score").where(F.col("_score") < toxicity.THRESHOLD).drop("_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the smallest id; rows of one id are judged by their own texts. Rows without an id stay, null texts are empty ones."""
    return exact_dedup.keep(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id. Rows without words or without an id stay."""
    return near_dedup.keep(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often as it is drawn, up to twice, whatever other rows have its id. Texts without words are never drawn; null is a source."""
    return mixing.mixed(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and digests of each row's pieces and decoded text; null and empty texts have no pieces."""
    import public_tokenizers

    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"), ["source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: A learnt model's decisions and random draws aren't SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), folder, f"{k}-{name}")
    return docs
