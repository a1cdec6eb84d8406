"""The registered query of every operator of this subpackage: thin calls over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .ann import nearest
from .html_text import extract_text
from .jaccard import near_groups
from .license_scan import scan_licenses
from .mixing import mix_sources
from .oracles import ORACLES
from .packing import pack_documents
from .quality import judge_quality
from .sharding import shard_documents
from .substrings import removal_report
from .urls import judge_urls


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_block_matrix_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    vectors = read(spark, directory, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return pack_documents(read(spark, directory, "documents"))


def op3_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    return near_groups(read(spark, directory, "documents"))


def op4_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return removal_report(read(spark, directory, "documents"))


def op5_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    return scan_licenses(read(spark, directory, "documents"))


def op6_histogram_sharding(spark: SparkSession, directory: str) -> DataFrame:
    return shard_documents(read(spark, directory, "documents"))


def op7_source_mixing(spark: SparkSession, directory: str) -> DataFrame:
    return mix_sources(read(spark, directory, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_shard", "n_shards")


def op8_html_extraction(spark: SparkSession, directory: str) -> DataFrame:
    return extract_text(read(spark, directory, "pages"))


def op9_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    judged = judge_quality(read(spark, directory, "documents"), read(spark, directory, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    return judge_urls(read(spark, directory, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {f.__name__: f for f in (op1_block_matrix_neighbours, op2_best_fit_packing, op3_jaccard_join, op4_substring_dedup, op5_license_scan, op6_histogram_sharding, op7_source_mixing, op8_html_extraction, op9_quality_rules, op10_url_filter)}
__all__ = ["ORACLES", "QUERIES"]
