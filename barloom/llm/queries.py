"""One query for each operator over its whole table, with production parameters, and its SQL if it has one."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    chunk_codec,
    hard_negatives,
    html_text,
    language,
    licenses,
    near_dup,
    packing,
    piece_codec,
    quality,
    sql,
    token_count,
    token_file,
    topk,
    vector_codes,
)

BYTE_TOKENIZER, WORD_TOKENIZER, PIECE_MODEL = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_file_index(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), end_id=2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(table(spark, sf_dir, "pages"))


def op7_chunk_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_codec.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("notices")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.product_codes(table(spark, sf_dir, "embeddings"))


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_exact_top_k,
        op2_near_duplicates,
        op3_packing,
        op4_main_text,
        op5_token_file,
        op6_language_id,
        op6_page_language,
        op7_chunk_codec,
        op8_quality_rules,
        op9_token_counts,
        op10_license_scan,
        op11_hard_negatives,
        op12_vector_codes,
        op13_piece_codec,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_top_k": sql.EXACT_TOP_K,
        "op2_near_duplicates": sql.NEAR_DUPLICATES,
        "op11_hard_negatives": sql.HARD_NEGATIVES,
        "op12_vector_codes": sql.PRODUCT_CODES,
    }
