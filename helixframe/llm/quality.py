"""Quality rules: fixed base rules and a learned decision list over native text statistics.

Native: all statistics are expressions over one document, so the main path is one projection without a shuffle.
The list is fitted on the driver from a bounded sample of labelled rows and becomes one ordered Spark conditional.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base rule: too few words, or more than REPEAT_PERCENT of them in repeated windows.
LEAST_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
#: White space between words, and the characters counted as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Labelled rows the list is fitted on at most, those with the smallest hash of their id.
TRAINING_ROWS = 20_000
#: A rule must cover so many training rows and reach this precision, on the growing and on the pruning part.
LEAST_COVERED = 5
LEAST_PRECISION = 0.9
MOST_RULES = 12
MOST_CONDITIONS = 3
#: Candidate thresholds of a statistic: its quantiles.
THRESHOLDS = 24

FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "mean_word", "log_words", "upper_share")


def window_texts(joined: Column, n_words: Column, window: int = WINDOW) -> Column:
    """All windows of words joined by single spaces, as arrays: element j holds those that start at words j, j + window, and so on.

    Each element is one linear scan by a regular expression, which costs far less than a lambda over the words.
    """
    word = "[^ ]++"
    scan = F.lit(" ".join([word] * window))
    out, start = [], F.lit(1)
    for j in range(window):
        found = F.regexp_extract_all(joined.substr(start, F.length(joined)), scan, F.lit(0))
        out.append(F.when(n_words >= window + j, found).otherwise(F.array().cast("array<string>")))
        start = F.call_function("locate", F.lit(" "), joined, start) + 1
    return F.array(*out)


def repeated_words(windows: Column, window: int = WINDOW) -> Column:
    """Words inside windows that stand twice or more in the text, the first included; windows: as window_texts gives them.

    Where all windows differ, nothing more is done; else their hashes are sorted with their places, those with an
    equal neighbour are kept, and the places' spans are added up without overlaps.
    """
    flat = F.flatten(windows)
    keyed = F.sort_array(F.flatten(F.transform(windows, lambda found, j: F.transform(found, lambda w, m: F.struct(F.xxhash64(w).alias("h"), (m * window + j).alias("i"))))))

    def places(rows: Column) -> Column:
        same = F.filter(rows, lambda x, i: (x["h"] == F.get(rows, i - 1)["h"]) | (x["h"] == F.get(rows, i + 1)["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    # A transform over an array of one binds the sorted array, so that it is sorted once and not once per element.
    once = F.flatten(F.transform(F.array(keyed), places))
    zero = F.struct(F.lit(0).alias("covered"), F.lit(-window).alias("last"))
    total = F.aggregate(once, zero, lambda s, i: F.struct((s["covered"] + F.least(F.lit(window), i - s["last"])).alias("covered"), i.alias("last")), lambda s: s["covered"])
    return F.when(F.size(F.array_distinct(flat)) < F.size(flat), total).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """Add the base statistics and the model's features to documents; their columns stay."""
    text, joined = F.coalesce("text", F.lit("")), F.col("_joined")
    rows = docs.withColumn("_joined", F.trim(F.regexp_replace(text, SPACE, " ")))
    rows = rows.withColumn("_n", F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1))
    rows = rows.withColumn("_windows", window_texts(joined, F.col("_n"))).withColumn("_lines", F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    counts = {
        "n_words": F.col("_n").cast("long"), "word_chars": (F.length(joined) - F.greatest(F.col("_n") - 1, F.lit(0))).cast("long"), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_repeat_words": repeated_words(F.col("_windows")), "_all_lines": F.size("_lines"), "_upper": F.regexp_count(text, F.lit("[A-Z]")),
    }
    # A generator of one row: the optimiser moves no filter on these columns below it, where they would be computed again for every use.
    rows = rows.select(*docs.columns, F.inline(F.array(F.struct(*(c.alias(name) for name, c in counts.items())))))
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumns({
        "base_failed": failed, "symbol_share": F.col("n_symbols") / c, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_all_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / n,
        "mean_word": F.col("word_chars") / n, "log_words": F.log1p(F.col("n_words").cast("double")), "upper_share": F.col("_upper") / c,
    }).drop("_all_lines", "_upper")


Rule = tuple[tuple[int, str, float], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for feature, sign, value in rule:
        out &= x[:, feature] >= value if sign == ">=" else x[:, feature] <= value
    return out


def grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the threshold with the best information gain until no good row is covered or the rule is full."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MOST_CONDITIONS and (bad & inside).any() and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        base = np.log2(p / (p + n))
        best, step = 0.0, None
        for f in range(x.shape[1]):
            v = x[inside, f]
            b = bad[inside]
            for value in np.unique(np.quantile(x[inside & bad, f], np.linspace(0, 1, THRESHOLDS))):
                for sign in (">=", "<="):
                    hit = v >= value if sign == ">=" else v <= value
                    q, m = (hit & b).sum(), (hit & ~b).sum()
                    if q and q * (np.log2(q / (q + m)) - base) > best + 1e-12:
                        best, step = q * (np.log2(q / (q + m)) - base), (f, sign, float(value))
        if step is None:
            break
        rule += (step,)
        inside &= holds((step,), x)
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop last conditions while that raises (bad - good) / covered on rows that the rule wasn't grown on."""
    def worth(r: Rule) -> float:
        hit = holds(r, x)
        return float((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum()) if hit.any() else -1.0

    return max((rule[:i] for i in range(len(rule), 0, -1)), key=worth, default=())


def learn_list(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Sequential covering: rules for rows to reject, in the order found; a row no rule covers is kept."""
    left, rules = np.ones(len(x), bool), []
    part = np.arange(len(x)) % 3 != 2  # two thirds to grow on, one to prune on
    while len(rules) < MOST_RULES and (bad & left).any():
        a, b = left & part, left & ~part
        rule = grow(x[a], bad[a])
        rule = prune(rule, x[b], bad[b]) if rule else ()
        if not rule:
            break
        hit = holds(rule, x) & left
        checked = hit & ~part
        if hit.sum() < LEAST_COVERED or (hit & bad).sum() < LEAST_PRECISION * hit.sum() or (checked & bad).sum() < LEAST_PRECISION * checked.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional: the first rule that holds rejects."""
    out = None
    for rule in rules:
        test = None
        for feature, sign, value in rule:
            c = F.col(FEATURES[feature])
            c = c >= F.lit(value) if sign == ">=" else c <= F.lit(value)
            test = c if test is None else test & c
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> list[Rule]:
    """Learn from at most `limit` labelled documents (quality 1 or 0) that the base rules pass."""
    sample = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = statistics(rows).where("NOT base_failed").select("doc_id", "quality", *FEATURES).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(limit).collect()
    if not rows:
        return []
    x = np.array([[r[f] for f in FEATURES] for r in rows], float)
    return learn_list(x, np.array([r["quality"] == 0 for r in rows]))


def judge_quality(docs: DataFrame, labels: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id and text of every row, with the statistics, `base_failed` and `kept`.

    A null or empty text has no words and fails the base rules. Null ids and repeated rows are judged like others;
    an empty table gives no rows. Without labelled rows the base rules alone decide.
    """
    if rules is None:
        rules = fit(docs, labels) if labels is not None else []
    return statistics(docs.select("doc_id", "text")).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules)))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are kept, with their own columns, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    judged = statistics(rows).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(fit(docs, labels))))
    return judged.where("kept").select("_row.*")
