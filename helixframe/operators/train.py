"""Training and prediction in one call each: sequences and labels to a model, a model and sequences to predictions.

The planner chooses between kernel matrices and explicit representations, and between one task and the distributed
solver. A fit that needs a whole kernel runs in one task of the cluster; predictions are joins of the new sequences'
kernel or representation with the coefficients or weights, and never gather anything on the driver but the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import Mixture, PairSpec, Spec
from ..plans.planner import TrainPlan, choose_method
from . import explain
from .learn import MODEL_ROWS, REGRESSIONS, Model, fit, fit_linear_large, gram
from .matrices import kernel_matrix, linear_kernel
from .represent import explicit_rep, mixture_rep

#: What predict() gives.
KINDS = ("response", "decision", "probabilities", "profile")


@dataclass
class Trained:
    """A kernel with its fitted model: coefficients of the training sequences, or feature weights, or both."""

    spec: Spec | Mixture
    plan: TrainPlan
    model: Model
    sequences: DataFrame
    weights: DataFrame | None = None


def representation(spec: Spec | Mixture, seqs: DataFrame) -> DataFrame:
    return mixture_rep(seqs, spec) if isinstance(spec, Mixture) else explicit_rep(seqs, spec)


def fit_in_task(matrix: DataFrame, labels: DataFrame, parameters: dict) -> Model:
    """fit() on a matrix (x_id, y_id, v) in one task of the cluster; only the model comes back."""
    numeric = parameters.get("svm") in REGRESSIONS

    def run(cells: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq_id")
        ids = rows["seq_id"].to_numpy()
        y = rows["y"].astype(float).to_numpy() if numeric else rows["y"].to_numpy()
        return pd.DataFrame(fit(gram(cells, ids, ids), y, ids=ids, **parameters).rows(), columns=[c.split()[0] for c in MODEL_ROWS.split(", ")])

    cells = matrix.select(F.lit(0).alias("one"), "x_id", "y_id", "v")
    known = labels.select(F.lit(0).alias("_one"), "seq_id", F.col("y").cast("string").alias("y"))
    return Model.of_rows(cells.groupBy("one").cogroup(known.groupBy("_one")).applyInPandas(run, MODEL_ROWS).collect())


def train(seqs: DataFrame, labels: DataFrame, spec: Spec | Mixture, svm: str = "C-svc", explicit: str = "auto", weights: bool = True, probability: bool = False, **parameters) -> Trained:
    """Train on sequences with labels (seq_id, y). Sequences without a label take no part; so do labels without a sequence.

    explicit: auto, yes or no, as the planner takes it; weights: also feature weights, where the kernel has them;
    parameters: those of fit(). Two classes or one for the distributed solver, whose positive class is the larger label.
    """
    if isinstance(spec, PairSpec):
        raise ValueError("pairs are trained on pair_matrix() and fit()")
    labels = labels.where("y IS NOT NULL").join(seqs.select("seq_id"), "seq_id", "left_semi")
    known = seqs.join(labels.select("seq_id"), "seq_id", "left_semi")
    plan = choose_method(spec, labels.count(), explicit, probability)
    classes = [] if svm in REGRESSIONS or svm == "one-svc" else sorted((r["y"] for r in labels.select(F.col("y").cast("string").alias("y")).distinct().collect()), reverse=True)
    if plan.method == "representation" and plan.solver == "distributed" and svm == "C-svc" and len(classes) == 2:
        table, offset = fit_linear_large(representation(spec, known), labels, parameters.get("c", 1.0), positive=classes[0])
        model = Model(svm, classes, pd.Index([]).to_numpy(), offsets={f"{classes[0]}/{classes[1]}": offset})
        return Trained(spec, plan, model, known, table.withColumn("svm", F.lit(f"{classes[0]}/{classes[1]}")))
    rep = representation(spec, known) if plan.method == "representation" else None
    matrix = linear_kernel(rep) if rep is not None else kernel_matrix(spec, known)
    model = fit_in_task(matrix, labels, {"svm": svm, "probability": probability, **parameters})
    out = Trained(spec, plan, model, known)
    if weights and (rep is not None or isinstance(spec, Mixture) or (spec.dist_weight is None and spec.r == 1)):
        coefficients = seqs.sparkSession.createDataFrame(model.coefficient_rows(), "svm string, seq_id long, coef double")
        out.weights = explain.feature_weights(rep if rep is not None else representation(spec, known), coefficients)
    return out


def decisions(trained: Trained, seqs: DataFrame) -> DataFrame:
    """(seq_id, svm, decision) of every sequence and machine; without common features a decision is the offset."""
    spark, model = seqs.sparkSession, trained.model
    offsets = F.broadcast(spark.createDataFrame(list(model.offsets.items()), "svm string, b double"))
    if trained.weights is not None:
        sums = representation(trained.spec, seqs).join(trained.weights, "feature").groupBy("seq_id", "svm").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    else:
        coefficients = spark.createDataFrame(model.coefficient_rows(), "svm string, y_id long, coef double")
        support = trained.sequences.join(coefficients.select(F.col("y_id").alias("seq_id")).distinct(), "seq_id", "left_semi")
        matrix = kernel_matrix(trained.spec, seqs, support)
        sums = matrix.join(coefficients, "y_id").groupBy(F.col("x_id").alias("seq_id"), "svm").agg(F.sum(F.col("v") * F.col("coef")).alias("s"))
    return seqs.select("seq_id").crossJoin(offsets).join(sums, ["seq_id", "svm"], "left").select("seq_id", "svm", (F.coalesce("s", F.lit(0.0)) + F.col("b")).alias("decision"))


def predict(trained: Trained, seqs: DataFrame, kind: str = "response", svm: str | None = None) -> DataFrame:
    """Predictions for sequences.

    response: (seq_id, prediction), the class, or the value of a regression; decision: (seq_id, svm, decision);
    probabilities: (seq_id, probability) of the larger label, if the model was trained with it; profile: (seq_id,
    pos, contrib) of one machine, the first if none is named.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    model = trained.model
    if kind == "profile":
        if trained.weights is None or isinstance(trained.spec, Mixture):
            raise ValueError("profiles need feature weights of one kernel")
        return explain.profile(seqs, trained.spec, trained.weights, svm or next(iter(model.offsets)))
    found = decisions(trained, seqs)
    if kind == "decision":
        return found.where(F.col("svm") == svm) if svm else found
    if kind == "probabilities":
        if model.platt is None:
            raise ValueError("the model was trained without probabilities")
        return explain.probabilities(found, *model.platt).select("seq_id", "probability")
    if not model.classes:
        return found.select("seq_id", F.col("decision").alias("prediction"))
    if len(model.classes) == 2 and model.svm not in ("mc-natC", "mc-natW"):
        return explain.labels(found, str(model.classes[0]), str(model.classes[1])).select("seq_id", "prediction")
    if model._pairs:
        # A vote a pair; the class that stands first wins ties.
        pairs = seqs.sparkSession.createDataFrame([(m, str(p), str(q)) for m, (p, q) in model._pairs.items()], "svm string, p string, q string")
        votes = found.join(F.broadcast(pairs), "svm").groupBy("seq_id", F.when(F.col("decision") >= 0, F.col("p")).otherwise(F.col("q")).alias("prediction")).agg(F.count("*").cast("double").alias("decision"))
    else:
        votes = found.withColumnRenamed("svm", "prediction")
    order = F.array_position(F.array(*(F.lit(str(c)) for c in model.classes)), F.col("prediction"))
    best = Window.partitionBy("seq_id").orderBy(F.desc("decision"), order)
    return votes.withColumn("turn", F.row_number().over(best)).where("turn = 1").select("seq_id", "prediction")
