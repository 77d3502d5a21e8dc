"""Queries that apply each operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, collocations, filter_audit, mixing
from foliant.llm.embed_dedup import embedding_dedup
from foliant.llm.exact_dedup import exact_dedup
from foliant.llm.html_extract import extract_main_text
from foliant.llm.license_scan import scan_licenses
from foliant.llm.line_dedup import dedup_lines
from foliant.llm.minhash import near_dedup
from foliant.llm.pii import find_personal_data
from foliant.llm.quality import classify
from foliant.llm.sharding import shard

TOKENIZER = "byte_bpe_50k.tiktoken"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_digests(docs: DataFrame) -> DataFrame:
    """Per document: id, number of ids, digest of the ids, digest of the bytes they decode to."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read(spark, sf_dir, "documents")).drop("base")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).drop("text")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_digests(read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def license_digest(found: DataFrame) -> DataFrame:
    """Counts, places, labels and score of scanned documents; labels as strings."""
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score"
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(read(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_personal_data": op2_personal_data,
        "op3_line_dedup": op3_line_dedup,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_sharding": op5_sharding,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_mixing": op8_mixing,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_collocations": op11_collocations,
        "op12_license_scan": op12_license_scan,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_mixing": mixing.oracle(),
        "op11_collocations": collocations.oracle(),
        "op13_filter_audit": filter_audit.oracle(),
        "op9_exact_dedup": """
            WITH d AS (
              SELECT doc_id, sha256(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
            g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
            FROM d JOIN g USING (text_sha256)""",
    }
