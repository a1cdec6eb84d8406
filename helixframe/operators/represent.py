"""Explicit representations: sparse (seq_id, feature, v) tables, and what is computed on them."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import GappySpec, MismatchSpec, Mixture, MotifSpec, Spec
from .extract import counts
from .ordering import numbered

#: Features that zero_features() spells out at most.
DIMENSION_LIMIT = 1_000_000


def explicit_rep(seqs: DataFrame, spec: Spec, features: DataFrame | None = None) -> DataFrame:
    """(seq_id, feature, v): counts, divided by their Euclidean norm if the kernel is normalized.

    features: keep only these; norms are still of all features. The window over seq_id reuses the partitioning of
    the counts' keys where it can, so that counts are exchanged once more at most.
    """
    if spec.dist_weight is not None or spec.r != 1:
        raise ValueError("no explicit representation for distance weights or powers")
    rows = counts(seqs, spec)
    v = F.col("n").cast("double")
    if spec.normalized:
        v = v / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("seq_id")).cast("double"))
    rows = rows.select("seq_id", "feature", v.alias("v"))
    return rows.join(features.select("feature").distinct(), "feature", "left_semi").select("seq_id", "feature", "v") if features is not None else rows


def mixture_rep(seqs: DataFrame, mixture: Mixture) -> DataFrame:
    """Blocks of several kernels side by side, each scaled by the root of its weight."""
    return reduce(DataFrame.unionByName, [explicit_rep(seqs, s).withColumn("v", F.col("v") * F.sqrt(F.lit(float(c)))) for c, s in mixture.parts])


def feature_space(spark, spec: Spec) -> DataFrame:
    """Every feature of a kernel without annotation, from cross products of the letters, not from data."""
    if spec.annotated or spec.dimension() > DIMENSION_LIMIT:
        raise ValueError("the feature space can't be spelled out")
    if isinstance(spec, MotifSpec):
        return spark.createDataFrame([(m,) for m in spec.motifs], "feature string")
    letters = spec.letters.letters.replace("-", "").replace("+", "")
    length = 2 * spec.k if isinstance(spec, GappySpec) else spec.k
    # Split in two halves on the driver: the rest is a product of two short columns.
    left = ["".join(x) for x in itertools.product(letters, repeat=length // 2)]
    right = ["".join(x) for x in itertools.product(letters, repeat=length - length // 2)]
    both = spark.createDataFrame([(x,) for x in left], "a string").crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in right], "b string"))).select(F.concat("a", "b").alias("feature"))
    if isinstance(spec, GappySpec):
        both = both.select(F.explode(F.array(*(F.concat(F.substring("feature", 1, spec.k), F.lit("." * g), F.substring("feature", spec.k + 1, spec.k)) for g in range(spec.m + 1)))).alias("feature"))
    if spec.rev_complement and not isinstance(spec, (GappySpec, MismatchSpec)):
        both = both.where(F.col("feature") <= F.reverse(F.translate("feature", *spec.letters.pairs)))
    return both


def zero_features(rep: DataFrame, seqs: DataFrame, spec: Spec) -> DataFrame:
    """The representation with a row for every sequence and every feature of the space."""
    everything = seqs.select("seq_id").crossJoin(F.broadcast(feature_space(seqs.sparkSession, spec)))
    return everything.join(rep, ["seq_id", "feature"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def feature_index(rep: DataFrame) -> DataFrame:
    """(feature, feature_ix): used features, numbered from 1 in order."""
    return numbered(rep.select("feature").distinct(), "feature", "feature_ix")


def quadratic_rep(rep: DataFrame) -> DataFrame:
    """Pairs of features F_G, F <= G: squares on the diagonal, root 2 times the product off it. A sequence's features are paired inside one array, without a self-join."""
    rows = rep.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("feature", "v"))).alias("x"))
    rows = rows.select("seq_id", "x", F.posexplode("x").alias("i", "a")).select("seq_id", "a", F.explode(F.slice("x", F.col("i") + 1, F.size("x"))).alias("b"))
    same = F.col("a.feature") == F.col("b.feature")
    return rows.select("seq_id", F.concat_ws("_", "a.feature", "b.feature").alias("feature"), (F.when(same, 1.0).otherwise(F.sqrt(F.lit(2.0))) * F.col("a.v") * F.col("b.v")).alias("v"))


def single_features(quadratic: DataFrame) -> DataFrame:
    return quadratic.select(F.explode(F.split("feature", "_")).alias("feature")).distinct()


def select_rows(rep: DataFrame, ids: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """Slices by sequence and feature."""
    if ids is not None:
        rep = rep.join(ids.select("seq_id").distinct(), "seq_id", "left_semi")
    return rep.join(features.select("feature").distinct(), "feature", "left_semi") if features is not None else rep


def transposed(rep: DataFrame) -> DataFrame:
    return rep.select(F.col("feature").alias("row"), F.col("seq_id").alias("col"), "v")


def times_vector(rep: DataFrame, weights: DataFrame) -> DataFrame:
    """(seq_id, y): the representation times a vector (feature, w)."""
    return rep.join(weights, "feature").groupBy("seq_id").agg(F.sum(F.col("v") * F.col("w")).alias("y"))


def times_matrix(rep: DataFrame, other: DataFrame) -> DataFrame:
    """(row, col, v): the representation times a sparse matrix (feature, col, v); cells without a common feature are left out."""
    joined = rep.select("seq_id", "feature", F.col("v").alias("a")).join(other.select("feature", "col", F.col("v").alias("b")), "feature")
    return joined.groupBy(F.col("seq_id").alias("row"), "col").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def dense(rep: DataFrame, features: list[str]) -> DataFrame:
    """One column a feature, for few named features."""
    return rep.groupBy("seq_id").pivot("feature", features).agg(F.first("v")).na.fill(0.0)


def sparse(wide: DataFrame) -> DataFrame:
    """Back from one column a feature; zeros are left out."""
    features = [c for c in wide.columns if c != "seq_id"]
    return wide.unpivot("seq_id", features, "feature", "v").where("v <> 0")
