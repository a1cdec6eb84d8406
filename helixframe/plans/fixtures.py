"""Sequence tables derived from the text tables, in Spark and in SQL. Whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabets import LOWER, UPPER
from ..sources.sequences import SCHEMA
from ..sources.tables import table

DNA_MAP = ("ACGT" * 7)[:26]
CASE_FROM, CASE_TO = UPPER + LOWER, ("acgt" * 7)[:26] + ("ACGT" * 7)[:26]
HEPTAD = "abcdefg"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def derived(spark: SparkSession, directory: str, source: str, form: str) -> DataFrame:
    """source: documents or benchmark. form: dna, dna_case (mostly swapped case) or aa. Other characters become `-`, which is in no alphabet."""
    key = {"documents": "doc_id", "benchmark": "item_id"}[source]
    b = F.regexp_replace("text", "[^A-Za-z]+", "-")
    seq = {"dna": F.translate(F.upper(b), UPPER, DNA_MAP), "dna_case": F.translate(b, CASE_FROM, CASE_TO), "aa": F.upper(b)}[form]
    rows = table(spark, directory, source).select(F.col(key).cast("long").alias("seq_id"), F.concat(F.lit("s"), F.col(key).cast("string")).alias("name"), seq.alias("seq"))
    heptads = F.substring(F.repeat(F.lit(HEPTAD), F.ceil(F.length("seq") / 7).cast("int")), F.lit(1), F.length("seq"))
    masked = F.when(F.col("seq_id") % 3 == 0, F.translate(heptads, "d", "-")).otherwise(heptads)
    return rows.select("seq_id", "name", "seq", masked.alias("annotation"), (F.col("seq_id") % 5 - 2).cast("int").alias("offset"))


def derived_sql(source: str, form: str) -> str:
    key = {"documents": "doc_id", "benchmark": "item_id"}[source]
    b = "regexp_replace(text, '[^A-Za-z]+', '-', 'g')"
    seq = {"dna": f"translate(upper({b}), '{UPPER}', '{DNA_MAP}')", "dna_case": f"translate({b}, '{CASE_FROM}', '{CASE_TO}')", "aa": f"upper({b})"}[form]
    heptads = f"substr(repeat('{HEPTAD}', CAST(ceil(length(seq) / 7.0) AS INT)), 1, length(seq))"
    inner = f"SELECT CAST({key} AS BIGINT) AS seq_id, {seq} AS seq FROM {source}"
    return f"SELECT seq_id, seq, CASE WHEN seq_id % 3 = 0 THEN translate({heptads}, 'd', '-') ELSE {heptads} END AS annotation, CAST(seq_id % 5 - 2 AS INT) AS off FROM ({inner})"
