"""Corpus preparation: language ID, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is what the stage before
kept, with the columns of ``documents``. Rows with null or empty texts, repeated rows and empty
tables are handled as the operators' docstrings say. A stage first gives back what the one before
left in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import decontaminate, jaccard, langid, packing, pii
from tickerloom.llm.common import free, materialize
from tickerloom.llm.queries import TOKENIZER, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score with which a language is accepted.
MIN_SCORE = 0.5

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found (no letter, or no language ahead of the others).

    The model learns from the labelled documents themselves; where none is labelled, nothing is
    dropped but texts without a letter.
    """
    free()
    model = langid.fit(docs)
    found = langid.identify(docs.select(*COLUMNS), model, "_lang", "_score")
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    return found.where((F.col("_lang") != langid.UNDETERMINED) & (F.col("_score") >= MIN_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the least doc_id, of each group of similar ones (five words, 0.8)."""
    return jaccard.keep_one(docs.select(*COLUMNS), width=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or a near copy of one."""
    free()
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(docs.select(*COLUMNS), benchmark).where(F.size("leaks") == 0).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts by the name of its kind; n_chars follows the new text."""
    free()
    out = pii.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: one row per piece of a document, with its shard, bin and offset."""
    return packing.pack_documents(docs.select(*COLUMNS), tokenizer_path(TOKENIZER))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
