"""Feature weights, predictions and prediction profiles from support-vector coefficients."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import GappySpec, MismatchSpec, Mixture, MotifSpec, Spec, motif_elements
from .extract import neighbours, occurrences, windows
from .ordering import before
from .represent import quadratic_rep


def feature_weights(rep: DataFrame, coefficients: DataFrame, limit: float = 0.0) -> DataFrame:
    """(feature, w): sums of coefficient times value over the support vectors (seq_id, coef); small weights are left out. Keeps a column `svm` of the coefficients."""
    keys = [c for c in ("svm",) if c in coefficients.columns]
    out = rep.join(coefficients, "seq_id").groupBy(*keys, "feature").agg(F.sum(F.col("coef") * F.col("v")).alias("w"))
    return out.where(F.abs("w") >= limit) if limit else out


def quadratic_weights(rep: DataFrame, coefficients: DataFrame, limit: float = 0.0) -> DataFrame:
    return feature_weights(quadratic_rep(rep), coefficients, limit)


def positional_weights(seqs: DataFrame, spec: Spec, coefficients: DataFrame) -> DataFrame:
    """(feature, pos, w): at every occurrence in a support vector its coefficient over the sequence's norm, root of the number of occurrences."""
    occ = occurrences(seqs, spec)
    norm = occ.groupBy("seq_id").agg(F.sqrt(F.count("*").cast("double")).alias("norm")) if spec.normalized else occ.select("seq_id").distinct().withColumn("norm", F.lit(1.0))
    return occ.join(coefficients, "seq_id").join(norm, "seq_id").groupBy("feature", "pos").agg(F.sum(F.col("coef") / F.col("norm")).alias("w"))


def convolved(weights: DataFrame, by_distance: tuple[float, ...]) -> DataFrame:
    """Positional weights spread by distance: w(m, p) = sum over q of w(m, q) E(|p - q|)."""
    steps = F.array(*(F.struct(F.lit(s * d).cast("long").alias("d"), F.lit(e).alias("e")) for d, e in enumerate(by_distance) for s in ((1, -1) if d else (1,)) if e))
    return weights.select("feature", "pos", "w", F.inline(steps)).groupBy("feature", (F.col("pos") + F.col("d")).alias("pos")).agg(F.sum(F.col("w") * F.col("e")).alias("w"))


def predict(seqs: DataFrame, rep: DataFrame, weights: DataFrame, offset: float = 0.0) -> DataFrame:
    """(seq_id, decision) of every sequence: offset plus the sum of value times weight; 0 without common features. The join keeps only weighted features."""
    sums = rep.join(weights, "feature").groupBy("seq_id").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return seqs.select("seq_id").join(sums, "seq_id", "left").select("seq_id", (F.coalesce("s", F.lit(0.0)) + offset).alias("decision"))


def predict_positional(seqs: DataFrame, spec: Spec, weights: DataFrame, offset: float = 0.0) -> DataFrame:
    """Decisions from weights (feature, pos, w) at a sequence's own occurrences, over its norm."""
    occ = occurrences(seqs, spec)
    total = F.sum(F.coalesce("w", F.lit(0.0)))
    sums = occ.join(weights, ["feature", "pos"], "left").groupBy("seq_id").agg((total / F.sqrt(F.count("*").cast("double")) if spec.normalized else total).alias("s"))
    return seqs.select("seq_id").join(sums, "seq_id", "left").select("seq_id", (F.coalesce("s", F.lit(0.0)) + offset).alias("decision"))


def labels(decisions: DataFrame, positive: str, negative: str) -> DataFrame:
    """Classes by sign; 0 is the positive class, the larger label."""
    return decisions.withColumn("prediction", F.when(F.col("decision") >= 0, positive).otherwise(negative))


def probabilities(decisions: DataFrame, a: float, b: float) -> DataFrame:
    """Probability of the positive class by a fitted logistic curve 1 / (1 + exp(a d + b))."""
    return decisions.withColumn("probability", 1 / (1 + F.exp(F.col("decision") * a + b)))


def _significant(spec: Spec) -> list[tuple[str | None, list[int]]]:
    """(motif or None, offsets of the positions that carry weight)."""
    if isinstance(spec, MotifSpec):
        return [(m, [i for i, e in enumerate(motif_elements(m)) if e != "."]) for m in spec.motifs]
    return [(None, list(range(spec.k)))]


def profile(seqs: DataFrame, spec: Spec, weights: DataFrame, svm: str | None = None, limit: float = 0.0) -> DataFrame:
    """(seq_id, pos, contrib): every occurrence's weight, over the norm, in equal parts on the positions it matches.

    Gaps, dots and mismatched positions get nothing. Sums over a sequence give its decision without the offset. The
    norm is that of the explicit representation of counts, or with weights (feature, pos, w) the root of the number
    of occurrences. svm: the machine whose weights count, if they have several; limit: smaller weights don't count.
    """
    if svm is not None:
        weights = weights.where(F.col("svm") == svm)
    if limit:
        weights = weights.where(F.abs("w") >= limit)
    positional = "pos" in weights.columns
    if isinstance(spec, MismatchSpec):
        rows = windows(seqs, spec, f"{spec.letters.char_class}{{{spec.k}}}", spec.k)
        near = rows.select("window").distinct().select("window", F.explode(neighbours(F.col("window"), spec)).alias("feature"))
        occ = rows.join(near, "window").select("seq_id", "pos", "feature", F.filter(F.sequence(F.lit(0), F.lit(spec.k - 1)), lambda i: F.substr("window", i + 1, F.lit(1)) == F.substr("feature", i + 1, F.lit(1))).alias("at"))
    else:
        occ = occurrences(seqs, spec).withColumn("at", _positions(spec))
    counted = occ.groupBy("seq_id").agg(F.sqrt(F.count("*").cast("double")).alias("norm")) if positional else occ.groupBy("seq_id", "feature").agg(F.count("*").alias("n")).groupBy("seq_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    norm = counted if spec.normalized else None
    rows = occ.join(weights.select("feature", *(["pos"] if positional else []), "w"), ["feature", "pos"] if positional else "feature")
    if norm is not None:
        rows = rows.join(norm, "seq_id")
    part = F.col("w") / F.size("at") / (F.col("norm") if norm is not None else F.lit(1.0))
    return rows.select("seq_id", "pos", part.alias("part"), F.explode("at").alias("i")).groupBy("seq_id", (F.col("pos") + F.col("i")).alias("pos")).agg(F.sum("part").alias("contrib"))


def _positions(spec: Spec) -> Column:
    if isinstance(spec, GappySpec):
        # The dots in the first half of the feature tell the gap.
        gap = F.length(F.regexp_extract("feature", r"(\.*)[^.]*$", 1)) if not spec.annotated else F.length(F.regexp_extract("feature", rf"^.{{{spec.k}}}(\.*)", 1))
        left = F.array(*map(F.lit, range(spec.k)))
        return F.concat(left, F.transform(left, lambda i: i + spec.k + gap))
    found = _significant(spec)
    if found[0][0] is None:
        return F.array(*map(F.lit, found[0][1]))
    out = None
    for motif, at in found:
        test = F.col("feature").startswith(motif) if spec.annotated else F.col("feature") == motif
        out = F.when(test, F.array(*map(F.lit, at))) if out is None else out.when(test, F.array(*map(F.lit, at)))
    return out


def mixture_profile(seqs: DataFrame, mixture: Mixture, weights: list[DataFrame]) -> DataFrame:
    """Weighted sum of the components' profiles."""
    parts = [profile(seqs, s, w).withColumn("contrib", F.col("contrib") * float(c)) for (c, s), w in zip(mixture.parts, weights, strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy("seq_id", "pos").agg(F.sum("contrib").alias("contrib"))


def baselines(seqs: DataFrame, offset: float) -> DataFrame:
    """The line a profile is drawn against: -offset over the sequence's length."""
    return seqs.select("seq_id", (F.lit(-offset) / F.length("seq")).alias("baseline"))


def smoothed(profiles: DataFrame, window: int) -> DataFrame:
    """Sliding mean of an odd window, clipped at the ends; the sum is divided by the number of positions less one."""
    around = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(-(window // 2), window // 2)
    return profiles.select("seq_id", "pos", (F.sum("contrib").over(around) / F.nullif(F.count("*").over(around) - 1, F.lit(0))).alias("contrib"))


def slice_profile(profiles: DataFrame, ids: DataFrame | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Profiles of the given sequences (column seq_id), between two positions."""
    if ids is not None:
        profiles = profiles.join(ids.select("seq_id").distinct(), "seq_id", "left_semi")
    if first is not None:
        profiles = profiles.where(F.col("pos") >= first)
    return profiles.where(F.col("pos") <= last) if last is not None else profiles


def profile_order(profiles: DataFrame, user: DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """(seq_id, total, rank): sequences by the sum of their profile, largest first; by a given column `place` (seq_id, place) or, with a seed, in random order."""
    totals = profiles.groupBy("seq_id").agg(F.round(F.sum("contrib"), 6).alias("total"))
    one = {"rank": F.lit(1).cast("long")}
    if user is not None:
        placed = totals.join(user.select("seq_id", F.col("place").cast("double").alias("place")), "seq_id")
        out = before(placed, "place", one, ties=("seq_id",)).drop("place")
    elif seed is not None:
        out = before(totals.withColumn("place", F.xxhash64("seq_id", F.lit(seed)).cast("double")), "place", one, ties=("seq_id",)).drop("place")
    else:
        out = before(totals, "total", one, descending=True, ties=("seq_id",))
    return out.select("seq_id", "total", (F.col("rank") + 1).cast("long").alias("rank"))
