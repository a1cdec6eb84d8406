"""Kernel matrices in long form (x_id, y_id, v): joins of representations or of positioned occurrences.

Only pairs that share a feature have a row; densify() adds the others. A matrix of a set with itself is computed
for x_id <= y_id and mirrored. What a feature brings is df x df pairs, so kernels are meant for sets whose squares
are affordable; the planner sends larger ones to explicit representations. Sequences are dealt into blocks, and a
feature's pairs into pairs of blocks, so that few features (64 words of three letters) still make many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import Mixture, PairSpec, Spec
from .extract import counts, occurrences

KEYS = ("x_id", "y_id")
#: Sequences in a block on average; a feature brings a pair of blocks at most BLOCK x BLOCK rows or so.
BLOCK = 1_000


def _sided(df: DataFrame, side: str, *value: str) -> DataFrame:
    return df.select(F.col("seq_id").alias(f"{side}_id"), *(F.col(c) for c in df.columns if c not in ("seq_id", *value)), *(F.col(c).alias(f"{side}_{c}") for c in value))


def mirrored(half: DataFrame) -> DataFrame:
    return half.unionByName(half.where("x_id <> y_id").select(F.col("y_id").alias("x_id"), F.col("x_id").alias("y_id"), "v"))


def blocks_of(*sides: DataFrame | None) -> tuple[int, ...]:
    """Numbers of blocks for tables with a row for each sequence; one that isn't given is the first."""
    numbers = [None if s is None else max(1, -(-s.count() // BLOCK)) for s in sides]
    return tuple(n or numbers[0] for n in numbers)


def _met(a: DataFrame, b: DataFrame, keys: list[str], blocks: tuple[int, ...], same: bool) -> DataFrame:
    """Rows of both sides with equal keys, dealt by pairs of blocks; of a set with itself each pair once, as x_id <= y_id."""
    if max(blocks) == 1:
        joined = a.join(b, keys)
        return joined.where("x_id <= y_id") if same else joined
    own = lambda side, n: F.pmod(F.xxhash64(f"{side}_id"), F.lit(n)).cast("int")
    a, b = a.withColumn("_bx", own("x", blocks[0])), b.withColumn("_by", own("y", blocks[1]))
    a = a.withColumn("_by", F.explode(F.sequence(F.col("_bx") if same else F.lit(0), F.lit(blocks[1] - 1))))
    b = b.withColumn("_bx", F.explode(F.sequence(F.lit(0), F.col("_by") if same else F.lit(blocks[0] - 1))))
    joined = a.join(b, [*keys, "_bx", "_by"])
    if not same:
        return joined
    return joined.where("_bx < _by OR x_id <= y_id").withColumns({"x_id": F.least(*KEYS), "y_id": F.greatest(*KEYS)})


def dot_products(x: DataFrame, y: DataFrame | None, value: str = "n", blocks: tuple[int, ...] = (1, 1)) -> DataFrame:
    """(x_id, y_id, v): sums of products over common features; integers stay integers, so that no order of addition shows."""
    a, b = _sided(x, "x", value), _sided(x if y is None else y, "y", value)
    joined = _met(a, b, ["feature"], blocks, y is None)
    return joined.groupBy(*KEYS).agg(F.sum(F.col(f"x_{value}") * F.col(f"y_{value}")).alias("v"))


def _normalized(products: DataFrame, x_squares: DataFrame, y_squares: DataFrame | None) -> DataFrame:
    """v / |x| / |y| from squared norms (seq_id, s)."""
    joined = products.join(_sided(x_squares, "x", "s"), "x_id").join(_sided(x_squares if y_squares is None else y_squares, "y", "s"), "y_id")
    same = F.lit(y_squares is None) & (F.col("x_id") == F.col("y_id"))
    return joined.select(*KEYS, F.when(same, 1.0).otherwise(F.col("v") / F.sqrt(F.col("x_s").cast("double")) / F.sqrt(F.col("y_s").cast("double"))).alias("v"))


def weighted_products(x: DataFrame, y: DataFrame | None, weights: tuple[float, ...], blocks: tuple[int, ...] = (1, 1)) -> DataFrame:
    """Positioned occurrences (seq_id, feature, pos) compared at every distance with a weight.

    The band becomes an equi-join: occurrences are counted by (sequence, feature, position), one side is spread over
    the few distances that count, and both meet on (feature, position).
    """
    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy("seq_id", "feature", "pos").agg(F.count("*").alias("n"))

    cx = counted(x)
    cy = cx if y is None else counted(y)
    steps = F.array(*(F.struct(F.lit(s * d).cast("long").alias("d"), F.lit(w).alias("w")) for d, w in enumerate(weights) for s in ((1, -1) if d else (1,)) if w))
    spread = _sided(cx, "x", "n").select("*", F.inline(steps)).select("x_id", "x_n", "feature", (F.col("pos") + F.col("d")).alias("pos"), "w")
    joined = _met(spread, _sided(cy, "y", "n"), ["feature", "pos"], blocks, y is None)
    return joined.groupBy(*KEYS).agg(F.sum(F.col("x_n") * F.col("y_n") * F.col("w")).alias("v"))


def kernel_matrix(spec: Spec | Mixture | PairSpec, x: DataFrame, y: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """The kernel of all pairs of x, or of x with y.

    longest: the longest distance between positions; if a weight function needs it and it isn't given, the data say.
    """
    if isinstance(spec, Mixture):
        parts = [kernel_matrix(s, x, y, longest).withColumn("v", F.col("v") * float(c)) for c, s in spec.parts]
        return reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(F.sum("v").alias("v"))
    if isinstance(spec, PairSpec):
        raise ValueError("pairs are compared by pair_matrix()")
    blocks = blocks_of(x, y)
    if spec.dist_weight is None:
        cx = counts(x, spec)
        cy = None if y is None else counts(y, spec)
        out = dot_products(cx, cy, blocks=blocks)
        square = lambda c: c.groupBy("seq_id").agg(F.sum(F.col("n") * F.col("n")).alias("s"))
        out = _normalized(out, square(cx), None if cy is None else square(cy)) if spec.normalized else out.withColumn("v", F.col("v").cast("double"))
    else:
        ox, oy = occurrences(x, spec), None if y is None else occurrences(y, spec)
        if callable(spec.dist_weight) and longest is None:
            ends = [s.agg(F.max(F.length("seq") - F.coalesce("offset", F.lit(0))), F.min(1 - F.coalesce("offset", F.lit(0)))).first() for s in ([x] if y is None else [x, y])]
            longest = max(e[0] for e in ends) - min(e[1] for e in ends)
        w = spec.weights(longest or 0)
        out = weighted_products(ox, oy, w, blocks)
        if spec.normalized:
            square = lambda o: weighted_products(o, None, w).where("x_id = y_id").select(F.col("x_id").alias("seq_id"), F.col("v").alias("s"))
            out = _normalized(out, square(ox), None if oy is None else square(oy))
    if spec.r > 1:
        out = out.withColumn("v", F.pow("v", F.lit(float(spec.r))))
    return mirrored(out) if y is None else out


def linear_kernel(x: DataFrame, y: DataFrame | None = None, lower_limit: float | None = None, triangular: bool = False, diagonal: bool = True, blocks: tuple[int, ...] = (1, 1)) -> DataFrame:
    """Products of explicit representations (seq_id, feature, v); only values over a limit, only one triangle, without the diagonal.

    blocks: numbers of blocks of the two sides, blocks_of() their sequences; more than one where a set holds thousands.
    """
    out = dot_products(x, y, "v", blocks)
    if lower_limit is not None:
        out = out.where(F.col("v") > lower_limit)
    if not diagonal:
        out = out.where("x_id <> y_id")
    return out if y is not None or triangular else mirrored(out)


def densify(matrix: DataFrame, x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    """A row for every pair; those without a common feature get 0."""
    pairs = x.select(F.col("seq_id").alias("x_id")).crossJoin((x if y is None else y).select(F.col("seq_id").alias("y_id")))
    return pairs.join(matrix, list(KEYS), "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def centered(matrix: DataFrame) -> DataFrame:
    """Double centring of a dense matrix: less column and row means, plus the grand mean."""
    rows = matrix.groupBy("x_id").agg(F.avg("v").alias("rm"))
    cols = matrix.groupBy("y_id").agg(F.avg("v").alias("cm"))
    mean = matrix.agg(F.avg("v").alias("gm"))
    return matrix.join(rows, "x_id").join(cols, "y_id").crossJoin(F.broadcast(mean)).select(*KEYS, (F.col("v") - F.col("cm") - F.col("rm") + F.col("gm")).alias("v"))


def power(matrix: DataFrame, r: int) -> DataFrame:
    return matrix.withColumn("v", F.pow("v", F.lit(float(r))))


def slice_matrix(matrix: DataFrame, x_ids: DataFrame | None = None, y_ids: DataFrame | None = None) -> DataFrame:
    for ids, key in ((x_ids, "x_id"), (y_ids, "y_id")):
        if ids is not None:
            matrix = matrix.join(ids.select(F.col("seq_id").alias(key)).distinct(), key, "left_semi")
    return matrix.select(*KEYS, "v")


def all_pairs(seqs: DataFrame) -> DataFrame:
    """(pair_id, a, b) of all a < b, named a_b."""
    x, y = seqs.select(F.col("seq_id").alias("a")), seqs.select(F.col("seq_id").alias("b"))
    return x.join(y, F.col("a") < F.col("b")).select(F.concat_ws("_", "a", "b").alias("pair_id"), "a", "b")


def pair_matrix(spec: PairSpec, seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x_pair, y_pair, v) of pairs (pair_id, a, b): mean of the four kernels, or their tensor product. Pairs are matched through the kernel's non-zero cells."""
    cell = kernel_matrix(spec.single, seqs)
    p = pairs.select(F.col("pair_id").alias("x_pair"), F.col("a").alias("a"), F.col("b").alias("b"))
    q = pairs.select(F.col("pair_id").alias("y_pair"), F.col("a").alias("c"), F.col("b").alias("d"))
    if spec.pairing == "mean":
        parts = []
        for mine in ("a", "b"):
            for other in ("c", "d"):
                k = cell.select(F.col("x_id").alias(mine), F.col("y_id").alias(other), "v")
                parts.append(p.join(k, mine).join(q, other).select("x_pair", "y_pair", "v"))
        return reduce(DataFrame.unionByName, parts).groupBy("x_pair", "y_pair").agg((F.sum("v") / 4).alias("v"))

    def product(first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
        k = cell.select(F.col("x_id").alias(first[0]), F.col("y_id").alias(first[1]), F.col("v").alias("v1"))
        m = cell.select(F.col("x_id").alias(second[0]), F.col("y_id").alias(second[1]), F.col("v").alias("v2"))
        return p.join(k, first[0]).join(q, first[1]).join(m, list(second)).select("x_pair", "y_pair", (F.col("v1") * F.col("v2")).alias("v"))

    return product(("a", "c"), ("b", "d")).unionByName(product(("a", "d"), ("b", "c"))).groupBy("x_pair", "y_pair").agg(F.sum("v").alias("v"))


def user_kernel(function: Callable[[str, str], float], x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    """A kernel given as a Python function of two strings, applied to every pair in Arrow batches."""
    apply = F.pandas_udf(lambda a, b: pd.Series([float(function(s, t)) for s, t in zip(a, b, strict=True)]), "double")
    pairs = x.select(F.col("seq_id").alias("x_id"), F.col("seq").alias("s")).crossJoin((x if y is None else y).select(F.col("seq_id").alias("y_id"), F.col("seq").alias("t")))
    return pairs.select(*KEYS, apply("s", "t").alias("v"))
