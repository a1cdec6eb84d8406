"""Scoring sequences as they arrive: the linear prediction as a stateless step on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import SpectrumSpec
from ..operators.extract import canonical, window_array
from ..sources.sequences import upper

#: Weights up to this number travel as a literal map.
WEIGHT_LIMIT = 100_000


def score_stream(seqs: DataFrame, spec: SpectrumSpec, weights: dict[str, float], offset: float = 0.0) -> DataFrame:
    """Add `decision` to (streaming or batch) sequences of a spectrum kernel without annotation.

    Counts stay inside a row: the windows become an array, the weighted sum and the norm come from it, so that no
    aggregation, watermark or state is needed.
    """
    if spec.annotated or spec.dist_weight is not None or len(weights) > WEIGHT_LIMIT:
        raise ValueError("only plain spectrum kernels with a bounded number of weights are scored in streams")
    seq = F.col("seq") if spec.ignore_lower else upper("seq")
    found = F.filter(window_array(seq, f"{spec.letters.char_class}{{{spec.k}}}"), lambda w: w != "")
    if spec.rev_complement:
        found = F.transform(found, lambda w: canonical(w, spec))
    table = F.create_map(*(F.lit(x) for item in sorted(weights.items()) for x in item)) if weights else F.create_map().cast("map<string,double>")
    rows = seqs.withColumn("_w", F.array_sort(found))
    each, one = F.array_distinct("_w") if spec.presence else F.col("_w"), F.lit(1).cast("long")
    total = F.aggregate(each, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))

    def run(s: Column, w: Column) -> Column:
        """Squares of counts, from the runs of equal windows in order."""
        same = s["last"] == w
        return F.struct(w.alias("last"), F.when(same, s["n"] + 1).otherwise(one).alias("n"), (s["squares"] + F.when(same, 2 * s["n"] + 1).otherwise(one)).alias("squares"))

    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("squares"))
    norm = F.sqrt(F.aggregate(each, start, run, lambda s: s["squares"]).cast("double")) if spec.normalized else F.lit(1.0)
    return rows.withColumn("decision", F.when(F.size("_w") > 0, total / norm).otherwise(0.0) + offset).drop("_w")
