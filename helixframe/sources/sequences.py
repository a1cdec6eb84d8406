"""Sequence tables: (seq_id, name, seq, annotation, offset) from rows, files or a generator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alphabets import LOWER, UPPER, alphabet

SCHEMA = "seq_id long, name string, seq string, annotation string, offset int"


def sequences(spark: SparkSession, seqs: Iterable[str] | str, names: Iterable[str] | None = None, annotation: Iterable[str] | None = None, offset: Iterable[int] | None = None) -> DataFrame:
    """A sequence table of given strings; one string is a set of one."""
    seqs = [seqs] if isinstance(seqs, str) else list(seqs)
    if not seqs:
        raise ValueError("no sequences")
    columns = [list(c) if c is not None else [None] * len(seqs) for c in (names, annotation, offset)]
    if any(len(c) != len(seqs) for c in columns):
        raise ValueError("names, annotation and offset must be as many as the sequences")
    for s, a in zip(seqs, columns[1], strict=True):
        if a is not None and len(a) != len(s):
            raise ValueError("an annotation must be as long as its sequence")
    return spark.createDataFrame([(i, n, s, a, o) for i, (s, n, a, o) in enumerate(zip(seqs, *columns, strict=True), 1)], SCHEMA)


def from_table(df: DataFrame, seq_id: str, seq: Column | str, name: str | None = None) -> DataFrame:
    """A sequence table of a DataFrame's columns."""
    return df.select(F.col(seq_id).cast("long").alias("seq_id"), (F.col(name).cast("string") if name else F.lit(None).cast("string")).alias("name"), (F.col(seq) if isinstance(seq, str) else seq).alias("seq"), F.lit(None).cast("string").alias("annotation"), F.lit(None).cast("int").alias("offset"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files; the id is a hash of the name and sequence, and of the turn among equal records, so that no global numbering is needed."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    name = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    return records.select(name.alias("name"), seq.alias("seq")).withColumn("turn", F.row_number().over(Window.partitionBy("name", "seq").orderBy(F.lit(1)))).select(F.xxhash64("name", "seq", "turn").alias("seq_id"), "name", "seq", F.lit(None).cast("string").alias("annotation"), F.lit(None).cast("int").alias("offset"))


def random_sequences(spark: SparkSession, kind: str, number: int, length: int, seed: int = 1) -> DataFrame:
    """Uniform random sequences, the same for the same seed."""
    letters = F.array(*map(F.lit, alphabet(kind).letters))
    seq = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.element_at(letters, (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.size(letters)) + 1).cast("int"))))
    return from_table(spark.range(1, number + 1).withColumn("seq", seq), "id", "seq")


def annotate(seqs: DataFrame, annotation: Column | None) -> DataFrame:
    """Attach an annotation (or remove it with None); rows whose lengths differ fail when they are read."""
    if annotation is None:
        return seqs.withColumn("annotation", F.lit(None).cast("string"))
    checked = F.when(F.length(annotation) == F.length("seq"), annotation).otherwise(F.raise_error(F.lit("an annotation must be as long as its sequence")).cast("string"))
    return seqs.withColumn("annotation", F.when(annotation.isNull(), F.lit(None).cast("string")).otherwise(checked))


def annotation_charset(seqs: DataFrame) -> str:
    """The distinct annotation characters in order, without the masking `-`; at most 32, and no dot."""
    found = seqs.select(F.explode(F.array_distinct(F.split("annotation", ""))).alias("c")).where("c NOT IN ('', '-')").distinct().limit(65).collect()
    letters = "".join(sorted(r["c"] for r in found))
    if len(letters) > 32 or "." in letters:
        raise ValueError("an annotation has at most 32 characters and no dot")
    return letters


def with_offset(seqs: DataFrame, offset: Column | None) -> DataFrame:
    """Attach offsets (or remove them with None): a sequence's first position is 1 - offset."""
    return seqs.withColumn("offset", F.lit(None).cast("int") if offset is None else offset.cast("int"))


def widths(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", F.length("seq").cast("long").alias("width"))


def subset(seqs: DataFrame, ids: DataFrame, negative: bool = False) -> DataFrame:
    """Rows whose id is in `ids` (column seq_id), or all others."""
    return seqs.join(ids.select("seq_id").distinct(), "seq_id", "left_anti" if negative else "left_semi")


def concat(*tables: DataFrame) -> DataFrame:
    """Tables one after the other; metadata that one lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def upper(seq: Column | str) -> Column:
    """Upper case for a-z only, so that the length stays."""
    return F.translate(seq, LOWER, UPPER)


def annotated_lines(seqs: DataFrame, width: int = 50) -> DataFrame:
    """(seq_id, line_no, start, seq_part, ann_part): sequences cut into lines with the annotation beneath.

    Lines are cut by a regular expression, in time linear in the length.
    """
    cut = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    lines = seqs.select("seq_id", F.arrays_zip(cut(F.col("seq")).alias("s"), cut(F.col("annotation")).alias("a")).alias("z"))
    return lines.select("seq_id", F.posexplode("z").alias("n", "z")).select("seq_id", (F.col("n") + 1).cast("long").alias("line_no"), (F.col("n") * width + 1).cast("long").alias("start"), F.col("z.s").alias("seq_part"), F.col("z.a").alias("ann_part"))


def numbered(seqs: DataFrame, by: str) -> DataFrame:
    """Dense ids 1, 2, ... by a column's order, for small named sets."""
    return seqs.withColumn("seq_id", F.row_number().over(Window.orderBy(by)).cast("long"))
