"""Evaluation of predictions (prediction, label[, decision])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import before


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("prediction", "label").agg(F.count("*").alias("n"))


def binary_metrics(predictions: DataFrame, positive: str) -> DataFrame:
    """One row: tp, fp, fn, tn; accuracy, balanced accuracy, sensitivity, specificity and precision in percent; Matthews' coefficient. Null where a class is absent; the coefficient is 0 then."""
    p, y = F.col("prediction") == positive, F.col("label") == positive
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    row = predictions.agg(F.count("*").alias("num"), count(p & y).alias("tp"), count(p & ~y).alias("fp"), count(~p & y).alias("fn"), count(~p & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    over = lambda a, b: F.when(b != 0, a / b)
    sens, spec = over(100 * tp, tp + fn), over(100 * tn, tn + fp)
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return row.select("num", "tp", "fp", "fn", "tn", over(100 * (tp + tn), tp + fp + fn + tn).alias("acc"), ((sens + spec) / 2).alias("bal_acc"), sens.alias("sens"), spec.alias("spec"), over(100 * tp, tp + fp).alias("prec"), F.when(root == 0, 0.0).otherwise((tp * tn - fp * fn) / root).alias("mcc"))


def class_metrics(predictions: DataFrame) -> DataFrame:
    """(label, sens, spec, prec) of every class that is a label, in percent."""
    c = confusion(predictions)
    by_label = c.groupBy("label").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("prediction") == F.col("label"), F.col("n")).otherwise(0)).alias("tp"))
    by_prediction = c.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("p"))
    total = c.agg(F.sum("n").alias("s"))
    j = by_label.join(by_prediction, "label", "left").withColumn("p", F.coalesce("p", F.lit(0))).crossJoin(F.broadcast(total))
    over = lambda a, b: F.when(b != 0, 100.0 * a / b)
    return j.select("label", over(F.col("tp"), F.col("t")).alias("sens"), over(F.col("s") - F.col("t") - F.col("p") + F.col("tp"), F.col("s") - F.col("t")).alias("spec"), over(F.col("tp"), F.col("p")).alias("prec"))


def multiclass_metrics(predictions: DataFrame) -> DataFrame:
    """One row: accuracy and balanced accuracy in percent, and the multiclass Matthews coefficient."""
    c = confusion(predictions)
    t = c.groupBy(F.col("label").alias("k")).agg(F.sum("n").alias("t"))
    p = c.groupBy(F.col("prediction").alias("k")).agg(F.sum("n").alias("p"))
    hit = c.where("prediction = label").select(F.col("label").alias("k"), F.col("n").alias("h"))
    rows = t.join(p, "k", "full").join(hit, "k", "left").na.fill(0, ["t", "p", "h"])
    d = lambda c: F.sum(c).cast("double")
    one = rows.agg(d(F.col("t")).alias("s"), d(F.col("h")).alias("c"), d(F.col("t") * F.col("p")).alias("tp"), d(F.col("t") * F.col("t")).alias("tt"), d(F.col("p") * F.col("p")).alias("pp"), F.avg(F.when(F.col("t") > 0, F.col("h") / F.col("t"))).alias("recall"))
    root = F.sqrt(F.col("s") * F.col("s") - F.col("pp")) * F.sqrt(F.col("s") * F.col("s") - F.col("tt"))
    return one.select((100 * F.col("c") / F.col("s")).alias("acc"), (100 * F.col("recall")).alias("bal_acc"), F.when(root == 0, 0.0).otherwise((F.col("c") * F.col("s") - F.col("tp")) / root).alias("mcc"))


def roc_points(predictions: DataFrame, positive: str) -> DataFrame:
    """(decision, tpr, fpr): rates of rows with at least that decision. Rows are counted by value before they are put in order."""
    y = F.col("label") == positive
    by_value = predictions.groupBy("decision").agg(F.sum(y.cast("long")).alias("p"), F.sum((~y).cast("long")).alias("n"))
    total = by_value.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    rows = before(by_value, "decision", {"p_ahead": F.col("p"), "n_ahead": F.col("n")}, descending=True).crossJoin(F.broadcast(total))
    return rows.select("decision", F.when(F.col("all_p") > 0, (F.col("p_ahead") + F.col("p")) / F.col("all_p")).alias("tpr"), F.when(F.col("all_n") > 0, (F.col("n_ahead") + F.col("n")) / F.col("all_n")).alias("fpr"))


def auc(predictions: DataFrame, positive: str) -> DataFrame:
    """One row `auc`, ties counting half; null if a class is absent."""
    y = F.col("label") == positive
    by_value = predictions.groupBy("decision").agg(F.sum(y.cast("long")).alias("p"), F.sum((~y).cast("long")).alias("n"))
    rows = before(by_value, "decision", {"below": F.col("n")}).select("p", "n", (F.col("p") * (2 * F.col("below") + F.col("n"))).alias("wins"))
    both = F.sum("p") * F.sum("n")
    return rows.agg(F.when(both > 0, F.sum("wins") / (2 * both)).alias("auc"))


def evaluate(predictions: DataFrame, positive: str | None = None, regression: bool = False) -> DataFrame:
    """All measures of predictions (prediction, label[, decision]) in one row: mse of a regression; for two classes counts, rates and, with decisions, auc; else the measures over classes."""
    if regression:
        return mse(predictions)
    if positive is None:
        return multiclass_metrics(predictions)
    out = binary_metrics(predictions, positive)
    return out.crossJoin(F.broadcast(auc(predictions, positive))) if "decision" in predictions.columns else out


def mse(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg(F.pow(F.col("prediction") - F.col("label"), F.lit(2.0))).alias("mse"))
