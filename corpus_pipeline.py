"""A corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as Parquet and reads
it back as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.llm import langid, line_dedup, mixing, ngram_join, sentencepiece_codec
from ionframe.storage import materialise, table

Stage = DataFrame


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Stage:
    """Drops documents whose language cannot be told."""
    return langid.identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Stage:
    """Drops lines that many documents hold, except where they stay; texts and n_chars follow."""
    found = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct("*").alias("_row_")))
    kept = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[kept.get(c, F.col(f"_row_.`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Stage:
    """Keeps one document of each group of near duplicates: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return ngram_join.first_of_each(docs, k=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Stage:
    """The documents of the mix, as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Stage:
    """Token counts and digests of ids and decoded texts."""
    return sentencepiece_codec.encode_digests(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: Language ID and the tokenizer's merges have no SQL form; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
