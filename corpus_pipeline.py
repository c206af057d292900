"""A corpus run end to end: toxic documents go, repeated lines go, one of each near-duplicate group stays,
contaminated documents go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; run() writes each stage's documents to the
shared folder and reads them again. All stages but the last return the columns of documents, in their order, and any others that docs has, whatever their names.

Null and empty texts are documents without sentences, lines, words and hits: they pass the first two stages and the fourth, and as near
duplicates of each other (fingerprint zero) one of them stays; it has no tokens. Rows that repeat id and text are copies, of which one stays. Null ids
come last where an order decides. Ties of ids are broken by the row's key. Empty documents give no rows; without labels nothing is toxic, without a
benchmark nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from tessera.llm.shared import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines one stays; documents stay, if only with what is left. n_chars, where there is one, follows the text; null for null texts."""
    left = line_dedup.deduplicated(docs, counts=False)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.one_of_each(docs)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes of each document."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_contaminated),
    ("byte-level BPE encoding and decoding", encoded),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py compares run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
