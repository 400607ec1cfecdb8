"""Clean a documents table for training: languages, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and is written to the
shared staging folder before the next one reads it.
"""

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import language, near_dup, packing, quality
from barloom.llm.common import stage_columns
from barloom.llm.queries import WORD_TOKENIZER, table, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language."""
    return language.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the rules and the log-likelihood ratio."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return near_dup.keep_one_of_each(docs, size=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_documents(docs, tokenizer_path(WORD_TOKENIZER))


STAGES = [
    ("language", identify_language),
    ("quality", quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Tokenizers and the n-gram models have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_columns(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
