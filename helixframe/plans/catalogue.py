"""Registered queries of the sequence operators and their SQL equivalents. Every query runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import GappySpec, MismatchSpec, Mixture, MotifSpec, PairSpec, SpectrumSpec, exp_weight, gauss_weight, lin_weight, swd_weight
from ..operators import evaluate, explain, extract, learn, matrices, represent, train
from ..sources import report
from ..sources import sequences as src
from ..sources.tables import table
from . import oracles as sql
from . import planner
from .fixtures import derived, derived_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MOTIFS = ("A.T", "C[AG]C", "G[^T]AC", "TT", "AC.[CT]G")
LINES = 50


def add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; minus zero becomes zero."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def rounded_to(df: DataFrame, places: int) -> DataFrame:
    """Rounded like its SQL, past a nudge: means of rounded values often fall halfway."""
    return df.withColumn("contrib", F.round(F.col("contrib") + 1e-9, places))


def docs(form: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: derived(spark, d, "documents", form)


def bench(form: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: derived(spark, d, "benchmark", form)


# --- sequences and selection ---------------------------------------------------------------------------------------

S_AA, B_DNA, B_AA = (("s", derived_sql(*x)) for x in (("documents", "aa"), ("benchmark", "dna"), ("benchmark", "aa")))

add("seq_width", lambda s, d: src.widths(docs("aa")(s, d)), sql.with_(S_AA) + "SELECT seq_id, CAST(length(seq) AS BIGINT) AS width FROM s")
add("seq_subset", lambda s, d: src.subset(docs("dna")(s, d), table(s, d, "labels").select(F.col("doc_id").alias("seq_id"))).select("seq_id", "seq"), sql.with_(("s", derived_sql("documents", "dna"))) + "SELECT seq_id, seq FROM s WHERE seq_id IN (SELECT doc_id FROM labels)")
add("seq_subset_negative", lambda s, d: src.subset(docs("dna")(s, d), table(s, d, "labels").select(F.col("doc_id").alias("seq_id")), negative=True).select("seq_id", "seq"), sql.with_(("s", derived_sql("documents", "dna"))) + "SELECT seq_id, seq FROM s WHERE seq_id NOT IN (SELECT doc_id FROM labels)")
add("seq_concat", lambda s, d: src.concat(docs("aa")(s, d).select("seq_id", "seq", "annotation"), bench("aa")(s, d).select("seq_id", "seq")), sql.with_(S_AA, ("b", derived_sql("benchmark", "aa"))) + "SELECT seq_id, seq, annotation FROM s UNION ALL SELECT seq_id, seq, NULL FROM b")
add("seq_annotated_lines", lambda s, d: src.annotated_lines(docs("aa")(s, d)), sql.with_(S_AA) + f"SELECT seq_id, CAST(n + 1 AS BIGINT) AS line_no, CAST(n * {LINES} + 1 AS BIGINT) AS start, substr(seq, n * {LINES} + 1, {LINES}) AS seq_part, substr(annotation, n * {LINES} + 1, {LINES}) AS ann_part FROM (SELECT *, unnest(range(0, CAST(ceil(length(seq) / {LINES}.0) AS BIGINT))) AS n FROM s)")
add("annotation_charset", lambda s, d: s.createDataFrame([(src.annotation_charset(docs("aa")(s, d)),)], "charset string"), sql.with_(S_AA) + "SELECT string_agg(c, '' ORDER BY c) AS charset FROM (SELECT DISTINCT unnest(string_split(annotation, '')) AS c FROM s) WHERE c NOT IN ('', '-')")

# --- explicit representations --------------------------------------------------------------------------------------


def rep_entry(name: str, form: str, spec) -> None:
    add(name, lambda s, d: rounded(represent.explicit_rep(docs(form)(s, d), spec), "v"), sql.rep_query("documents", form, spec))


REPS = {
    "spectrum_er_k2": ("dna", SpectrumSpec(k=2, normalized=False)),
    "spectrum_er_norm_k3": ("dna", SpectrumSpec(k=3)),
    "spectrum_er_aa": ("aa", SpectrumSpec("aa", k=2)),
    "spectrum_er_presence": ("dna", SpectrumSpec(k=4, presence=True)),
    "spectrum_er_ignore_lower": ("dna_case", SpectrumSpec(k=2)),
    "spectrum_er_case_insensitive": ("dna_case", SpectrumSpec(k=2, ignore_lower=False)),
    "spectrum_er_iupac": ("aa", SpectrumSpec("dna", k=2, exact=False)),
    "spectrum_er_revcomp": ("dna", SpectrumSpec(k=4, rev_complement=True)),
    "spectrum_er_annotated": ("dna", SpectrumSpec(k=2, annotated=True)),
    "gappy_er_k1m2": ("dna", GappySpec(k=1, m=2)),
    "gappy_er_annotated": ("dna", GappySpec(k=1, m=1, annotated=True)),
    "gappy_er_revcomp": ("dna", GappySpec(k=2, m=1, rev_complement=True)),
    "mismatch_er_k3m1": ("dna", MismatchSpec(k=3, m=1)),
    "mismatch_er_k4m2": ("dna", MismatchSpec(k=4, m=2, normalized=False)),
    "mismatch_er_presence": ("dna", MismatchSpec(k=4, m=1, presence=True)),
    "motif_er": ("dna", MotifSpec(motifs=MOTIFS)),
    "motif_er_annotated": ("dna", MotifSpec(motifs=MOTIFS[:3], annotated=True)),
}
for _name, (_form, _spec) in REPS.items():
    rep_entry(_name, _form, _spec)

D_DNA = ("s", derived_sql("documents", "dna"))
E3 = (D_DNA, ("c", sql.counts("s", SpectrumSpec(k=3))), ("e", sql.rep("c")))
GIVEN = ("AAA", "ACG", "TTT", "CGT", "GGG")


def er3(s: SparkSession, d: str) -> DataFrame:
    return represent.explicit_rep(docs("dna")(s, d), SpectrumSpec(k=3))


add("er_feature_subset", lambda s, d: rounded(represent.explicit_rep(docs("dna")(s, d), SpectrumSpec(k=3), s.createDataFrame([(f,) for f in GIVEN], "feature string")), "v"), sql.with_(*E3) + f"SELECT seq_id, feature, round(v, 6) AS v FROM e WHERE feature IN {GIVEN}")
add("er_zero_features_k2", lambda s, d: rounded(represent.zero_features(represent.explicit_rep(docs("dna")(s, d), SpectrumSpec(k=2)), docs("dna")(s, d), SpectrumSpec(k=2)), "v"), sql.with_(D_DNA, ("c", sql.counts("s", SpectrumSpec(k=2))), ("e", sql.rep("c")), ("l", "SELECT unnest(['A', 'C', 'G', 'T']) AS c")) + "SELECT seq_id, a.c || b.c AS feature, round(coalesce(v, 0.0), 6) AS v FROM s CROSS JOIN l a CROSS JOIN l b LEFT JOIN e USING (seq_id) WHERE FALSE UNION ALL SELECT p.seq_id, p.feature, round(coalesce(e.v, 0.0), 6) FROM (SELECT s.seq_id, a.c || b.c AS feature FROM s, l a, l b) p LEFT JOIN e ON p.seq_id = e.seq_id AND p.feature = e.feature")
add("er_mixture", lambda s, d: rounded(represent.mixture_rep(docs("dna")(s, d), Mixture.by_k(SpectrumSpec(), (0.5, 0.3, 0.2))), "v"), sql.with_(D_DNA, *((f"c{k}", sql.counts("s", SpectrumSpec(k=k))) for k in (1, 2, 3)), *((f"e{k}", sql.rep(f"c{k}")) for k in (1, 2, 3))) + " UNION ALL ".join(f"SELECT seq_id, feature, round(v * sqrt({c}), 6) AS v FROM e{k}" for k, c in ((1, "0.5::DOUBLE"), (2, "0.3::DOUBLE"), (3, "0.2::DOUBLE"))))
add("er_quadratic", lambda s, d: rounded(represent.quadratic_rep(represent.explicit_rep(docs("dna")(s, d), SpectrumSpec(k=2))), "v"), sql.with_(D_DNA, ("c", sql.counts("s", SpectrumSpec(k=2))), ("e", sql.rep("c"))) + "SELECT a.seq_id, a.feature || '_' || b.feature AS feature, round(CASE WHEN a.feature = b.feature THEN 1.0 ELSE sqrt(2.0::DOUBLE) END * a.v * b.v, 6) AS v FROM e a JOIN e b ON a.seq_id = b.seq_id AND a.feature <= b.feature")
add("er_single_features", lambda s, d: represent.single_features(represent.quadratic_rep(represent.explicit_rep(docs("dna")(s, d), SpectrumSpec(k=2)))), sql.with_(D_DNA, ("c", sql.counts("s", SpectrumSpec(k=2)))) + "SELECT DISTINCT feature FROM c")
add("er_feature_index", lambda s, d: represent.feature_index(er3(s, d)), sql.with_(*E3) + "SELECT feature, CAST(row_number() OVER (ORDER BY feature) AS BIGINT) AS feature_ix FROM (SELECT DISTINCT feature FROM e)")
add("er_dense_roundtrip", lambda s, d: rounded(represent.sparse(represent.dense(er3(s, d), list(GIVEN))), "v"), sql.with_(*E3) + f"SELECT seq_id, feature, round(v, 6) AS v FROM e WHERE feature IN {GIVEN}")
add("er_slice", lambda s, d: rounded(represent.select_rows(er3(s, d), table(s, d, "labels").select(F.col("doc_id").alias("seq_id")), s.createDataFrame([(f,) for f in GIVEN], "feature string")).select("seq_id", "feature", "v"), "v"), sql.with_(*E3) + f"SELECT seq_id, feature, round(v, 6) AS v FROM e WHERE seq_id IN (SELECT doc_id FROM labels) AND feature IN {GIVEN}")
add("er_times_matrix", lambda s, d: rounded(represent.times_matrix(er3(s, d), er3(s, d).select("feature").distinct().select("feature", F.substring("feature", 1, 1).alias("col"), F.lit(2.0).alias("v"))).select(F.col("row").alias("seq_id"), "col", "v"), "v"), sql.with_(*E3) + "SELECT seq_id, substr(feature, 1, 1) AS col, round(sum(2 * v), 6) AS v FROM e GROUP BY 1, 2")
add("er_transpose", lambda s, d: rounded(represent.transposed(er3(s, d)), "v"), sql.with_(*E3) + 'SELECT feature AS "row", seq_id AS col, round(v, 6) AS v FROM e')
add("er_transpose_matvec", lambda s, d: rounded(represent.times_vector(er3(s, d), er3(s, d).groupBy("feature").agg(F.count("*").cast("double").alias("w"))), "y"), sql.with_(*E3, ("w", "SELECT feature, CAST(count(*) AS DOUBLE) AS w FROM e GROUP BY feature")) + "SELECT seq_id, round(sum(v * w), 6) AS y FROM e JOIN w USING (feature) GROUP BY seq_id")
add("feature_space_dim", lambda s, d: s.createDataFrame([(n, x.dimension(7)) for n, x in DIMENSIONS.items()], "kernel string, dimension long"), "SELECT * FROM (VALUES ('spectrum_aa5', CAST(21 ^ 5 AS BIGINT)), ('gappy_k1m2', CAST(3 * 4 ^ 2 AS BIGINT)), ('motif', CAST(5 AS BIGINT)), ('spectrum_k2_annotated', CAST(4 ^ 2 * 7 ^ 2 AS BIGINT))) AS t(kernel, dimension)")
DIMENSIONS = {"spectrum_aa5": SpectrumSpec("aa", k=5), "gappy_k1m2": GappySpec(k=1, m=2), "motif": MotifSpec(motifs=MOTIFS), "spectrum_k2_annotated": SpectrumSpec(k=2, annotated=True)}

# --- kernel matrices -----------------------------------------------------------------------------------------------



def km(name: str, spec, form: str = "dna") -> None:
    q = sql.with_(("s", derived_sql("benchmark", form)), ("c", sql.counts("s", spec)), ("k", sql.kernel("c", spec)))
    add(name, lambda s, d: rounded(matrices.kernel_matrix(spec, bench(form)(s, d)), "v"), q + f"SELECT x_id, y_id, round(v{f' ^ {spec.r}' if spec.r > 1 else ''}, 6) AS v FROM k")


for _name, _spec, _form in (
    ("km_spectrum", SpectrumSpec(k=3), "dna"), ("km_unnormalized", SpectrumSpec("aa", k=2, normalized=False), "aa"), ("km_power_r2", SpectrumSpec("aa", k=3, r=2), "aa"), ("km_gappy", GappySpec(k=2, m=2), "dna"),
    ("km_mismatch", MismatchSpec(k=4, m=1), "dna"), ("km_motif", MotifSpec(motifs=MOTIFS), "dna"), ("km_presence", SpectrumSpec("aa", k=3, presence=True), "aa"), ("km_annotated", SpectrumSpec(k=2, annotated=True), "dna"),
):
    km(_name, _spec, _form)


def km_positional(name: str, spec, weights: list[str]) -> None:
    q = sql.with_(B_DNA, ("o", sql.occurrences("s", spec)), ("k", sql.positional_kernel("o", spec, weights)))
    add(name, lambda s, d: rounded(matrices.kernel_matrix(spec, bench("dna")(s, d)), "v"), q + "SELECT x_id, y_id, round(v, 6) AS v FROM k")


def series(f: str, n: int) -> list[str]:
    return [f.format(d=d) for d in range(n)]


km_positional("km_position_specific", SpectrumSpec(k=3, dist_weight=(1.0,)), ["1.0"])
km_positional("km_position_unnormalized", SpectrumSpec(k=2, dist_weight=(1.0,), normalized=False), ["1.0"])
km_positional("km_dist_linear", SpectrumSpec(k=3, dist_weight=lin_weight(4)), series("(1 - {d} / 4.0)", 4))
km_positional("km_dist_exp", SpectrumSpec(k=3, dist_weight=tuple(map(exp_weight(2), range(8)))), series("exp(-{d} / 2.0)", 8))
km_positional("km_dist_gauss", SpectrumSpec(k=4, dist_weight=tuple(map(gauss_weight(9), range(8)))), series("exp(-{d} * {d} / 9.0)", 8))
km_positional("km_dist_swd", SpectrumSpec(k=4, dist_weight=tuple(map(swd_weight(), range(10)))), series("1 / (2.0 * ({d} + 1))", 10))
km_positional("km_gappy_position", GappySpec(k=1, m=2, dist_weight=(1.0, 0.5)), ["1.0", "0.5"])
km_positional("km_motif_position", MotifSpec(motifs=MOTIFS, dist_weight=(1.0, 0.5, 0.25)), ["1.0", "0.5", "0.25"])

add("km_position_offset", lambda s, d: extract.occurrences(src.with_offset(bench("dna")(s, d), F.col("seq_id") % 3), SpectrumSpec(k=6)), sql.with_(("s0", derived_sql("benchmark", "dna")), ("s", "SELECT seq_id, seq, annotation, CAST(seq_id % 3 AS INT) AS off FROM s0")) + sql.occurrences("s", SpectrumSpec(k=6)))


def mixture_sql(component: Callable[[int], str], coefficients: tuple[float, ...]) -> str:
    return " UNION ALL ".join(f"SELECT x_id, y_id, v * {c} AS v FROM ({component(k)})" for k, c in enumerate(coefficients, 1))


MIX = (0.5, 0.3, 0.2)
add("km_mixed_spectrum", lambda s, d: rounded(matrices.kernel_matrix(Mixture.by_k(SpectrumSpec(), MIX), bench("dna")(s, d)), "v"), sql.with_(B_DNA, *((f"c{k}", sql.counts("s", SpectrumSpec(k=k))) for k in (1, 2, 3)), ("m", mixture_sql(lambda k: sql.kernel(f"c{k}", SpectrumSpec(k=k)), MIX))) + "SELECT x_id, y_id, round(sum(v), 6) AS v FROM m GROUP BY x_id, y_id")
add("km_weighted_degree", lambda s, d: rounded(matrices.kernel_matrix(Mixture.by_k(SpectrumSpec(dist_weight=(1.0,), normalized=False), MIX), bench("dna")(s, d)), "v"), sql.with_(B_DNA, *((f"o{k}", sql.occurrences("s", SpectrumSpec(k=k))) for k in (1, 2, 3)), ("m", mixture_sql(lambda k: sql.positional_kernel(f"o{k}", SpectrumSpec(k=k, normalized=False), ["1.0"]), MIX))) + "SELECT x_id, y_id, round(sum(v), 6) AS v FROM m GROUP BY x_id, y_id")

SUPPLIED = "SELECT CAST(item_id AS BIGINT) AS seq_id FROM benchmark"
add("km_rectangular", lambda s, d: rounded(matrices.kernel_matrix(SpectrumSpec("aa", k=4), bench("aa")(s, d), docs("aa")(s, d)), "v"), sql.with_(("s", derived_sql("benchmark", "aa")), ("t", derived_sql("documents", "aa")), ("c", sql.counts("s", SpectrumSpec("aa", k=4))), ("c2", sql.counts("t", SpectrumSpec("aa", k=4))), ("k", sql.kernel("c", SpectrumSpec("aa", k=4), "c2"))) + "SELECT x_id, y_id, round(v, 6) AS v FROM k")

K3 = (B_DNA, ("c", sql.counts("s", SpectrumSpec(k=3))), ("k", sql.kernel("c", SpectrumSpec(k=3))))
KA = (B_AA, ("c", sql.counts("s", SpectrumSpec("aa", k=3))), ("k", sql.kernel("c", SpectrumSpec("aa", k=3))))


def k3(s: SparkSession, d: str) -> DataFrame:
    return matrices.kernel_matrix(SpectrumSpec(k=3), bench("dna")(s, d))


def ka(s: SparkSession, d: str) -> DataFrame:
    return matrices.kernel_matrix(SpectrumSpec("aa", k=3), bench("aa")(s, d))


DENSE_SQL = "SELECT a.seq_id AS x_id, b.seq_id AS y_id, coalesce(v, 0.0) AS v FROM s a CROSS JOIN s b LEFT JOIN k ON a.seq_id = x_id AND b.seq_id = y_id"
add("km_dense", lambda s, d: rounded(matrices.densify(ka(s, d), bench("aa")(s, d)), "v"), sql.with_(*KA) + f"SELECT x_id, y_id, round(v, 6) AS v FROM ({DENSE_SQL})")
add("km_centered", lambda s, d: rounded(matrices.centered(matrices.densify(ka(s, d), bench("aa")(s, d))), "v"), sql.with_(*KA, ("m", DENSE_SQL)) + "SELECT x_id, y_id, round(v - avg(v) OVER (PARTITION BY y_id) - avg(v) OVER (PARTITION BY x_id) + avg(v) OVER (), 6) + 0.0 AS v FROM m")
add("km_linear_sparse_limit", lambda s, d: rounded(matrices.linear_kernel(represent.explicit_rep(bench("aa")(s, d), SpectrumSpec("aa", k=3)), lower_limit=0.25, triangular=True, diagonal=False), "v"), sql.with_(*KA) + "SELECT x_id, y_id, round(v, 6) AS v FROM k WHERE x_id < y_id AND v > 0.25")
add("km_slice", lambda s, d: rounded(matrices.slice_matrix(k3(s, d), table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("seq_id"))), "v"), sql.with_(*K3) + "SELECT x_id, y_id, round(v, 6) AS v FROM k WHERE x_id IN (SELECT r_regionkey FROM region)")
add("km_elementwise_power", lambda s, d: rounded(matrices.power(k3(s, d), 3), "v"), sql.with_(*K3) + "SELECT x_id, y_id, round(v ^ 3, 6) AS v FROM k")

NATIONS = ("SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS b, concat_ws('_', n_nationkey, (n_nationkey * 7 + 3) % 25) AS pair_id FROM nation")


def nation_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of benchmark passages, one for every nation."""
    b = (F.col("n_nationkey") * 7 + 3) % 25
    return table(s, d, "nation").select(F.concat_ws("_", "n_nationkey", b.cast("long")).alias("pair_id"), F.col("n_nationkey").cast("long").alias("a"), b.cast("long").alias("b"))


PAIRED = sql.with_(*K3, ("p", NATIONS), ("m", DENSE_SQL)) + "SELECT p.pair_id AS x_pair, q.pair_id AS y_pair, round(@VALUE@, 6) AS v FROM p CROSS JOIN p q JOIN m ac ON ac.x_id = p.a AND ac.y_id = q.a JOIN m bd ON bd.x_id = p.b AND bd.y_id = q.b JOIN m ad ON ad.x_id = p.a AND ad.y_id = q.b JOIN m bc ON bc.x_id = p.b AND bc.y_id = q.a"
add("km_pair_mean", lambda s, d: rounded(matrices.pair_matrix(PairSpec(SpectrumSpec(k=3)), bench("dna")(s, d), nation_pairs(s, d)), "v"), PAIRED.replace("@VALUE@", "(ac.v + bd.v + ad.v + bc.v) / 4"))
add("km_pair_tppk", lambda s, d: rounded(matrices.pair_matrix(PairSpec(SpectrumSpec(k=3), "tppk"), bench("dna")(s, d), nation_pairs(s, d)), "v"), PAIRED.replace("@VALUE@", "ac.v * bd.v + ad.v * bc.v"))
add("km_all_pairs", lambda s, d: matrices.all_pairs(bench("dna")(s, d)), f"SELECT concat_ws('_', a.seq_id, b.seq_id) AS pair_id, a.seq_id AS a, b.seq_id AS b FROM ({SUPPLIED}) a JOIN ({SUPPLIED}) b ON a.seq_id < b.seq_id")
add("km_user_defined", lambda s, d: matrices.user_kernel(lambda a, b: float(abs(len(a) - len(b))), bench("dna")(s, d)), sql.with_(B_DNA) + "SELECT a.seq_id AS x_id, b.seq_id AS y_id, CAST(abs(length(a.seq) - length(b.seq)) AS DOUBLE) AS v FROM s a CROSS JOIN s b")

# --- weights, predictions, profiles --------------------------------------------------------------------------------

COEF = "SELECT seq_id, CAST(seq_id % 7 - 3 AS DOUBLE) / 10 AS coef FROM s"
OFFSET = 0.25


def coefficients(df: DataFrame) -> DataFrame:
    return df.select("seq_id", ((F.col("seq_id") % 7 - 3).cast("double") / 10).alias("coef"))


def weights3(s: SparkSession, d: str) -> DataFrame:
    return explain.feature_weights(er3(s, d), coefficients(docs("dna")(s, d)))


W3 = (*E3, ("q", COEF), ("w", "SELECT feature, sum(coef * v) AS w FROM e JOIN q USING (seq_id) GROUP BY feature"))
P3 = (*W3, ("p", f"SELECT s.seq_id, coalesce(z, 0.0) + {OFFSET} AS decision FROM s LEFT JOIN (SELECT seq_id, sum(v * w) AS z FROM e JOIN w USING (feature) GROUP BY seq_id) t ON s.seq_id = t.seq_id"))


def decisions3(s: SparkSession, d: str) -> DataFrame:
    return explain.predict(docs("dna")(s, d), er3(s, d), weights3(s, d), OFFSET)


add("feature_weights_linear", lambda s, d: rounded(weights3(s, d), "w"), sql.with_(*W3) + "SELECT feature, round(w, 6) + 0.0 AS w FROM w")
add("feature_weights_pruned", lambda s, d: rounded(explain.feature_weights(er3(s, d), coefficients(docs("dna")(s, d)), 0.5), "w"), sql.with_(*W3) + "SELECT feature, round(w, 6) + 0.0 AS w FROM w WHERE abs(w) >= 0.5")
add("feature_weights_quadratic", lambda s, d: rounded(explain.quadratic_weights(represent.explicit_rep(docs("dna")(s, d), SpectrumSpec(k=1)), coefficients(docs("dna")(s, d))), "w"), sql.with_(D_DNA, ("c", sql.counts("s", SpectrumSpec(k=1))), ("e", sql.rep("c")), ("q", COEF)) + "SELECT a.feature || '_' || b.feature AS feature, round(sum(coef * CASE WHEN a.feature = b.feature THEN 1.0 ELSE sqrt(2.0::DOUBLE) END * a.v * b.v), 6) + 0.0 AS w FROM e a JOIN e b ON a.seq_id = b.seq_id AND a.feature <= b.feature JOIN q ON q.seq_id = a.seq_id GROUP BY 1")
add("predict_linear", lambda s, d: rounded(decisions3(s, d), "decision"), sql.with_(*P3) + "SELECT seq_id, round(decision, 6) + 0.0 AS decision FROM p")
add("predict_labels", lambda s, d: explain.labels(decisions3(s, d), "pos", "neg").select("seq_id", "prediction"), sql.with_(*P3) + "SELECT seq_id, CASE WHEN decision >= 0 THEN 'pos' ELSE 'neg' END AS prediction FROM p")
add("platt_probability", lambda s, d: rounded(explain.probabilities(decisions3(s, d), -1.5, 0.1).select("seq_id", "probability"), "probability"), sql.with_(*P3) + "SELECT seq_id, round(1 / (1 + exp(decision * -1.5 + 0.1)), 6) AS probability FROM p")

PS = SpectrumSpec(k=3, dist_weight=(1.0,))
OCC = (B_DNA, ("o", sql.occurrences("s", PS)), ("z", "SELECT seq_id, sqrt(CAST(count(*) AS DOUBLE)) AS norm FROM o GROUP BY seq_id"), ("q", COEF), ("w", "SELECT feature, pos, sum(coef / norm) AS w FROM o JOIN q USING (seq_id) JOIN z USING (seq_id) GROUP BY feature, pos"))


def positional3(s: SparkSession, d: str) -> DataFrame:
    b = bench("dna")(s, d)
    return explain.positional_weights(b, PS, coefficients(b))


add("feature_weights_positional", lambda s, d: rounded(positional3(s, d), "w"), sql.with_(*OCC) + "SELECT feature, pos, round(w, 6) + 0.0 AS w FROM w")
add("weights_convolved", lambda s, d: rounded(explain.convolved(positional3(s, d), (1.0, 0.5, 0.25)), "w"), sql.with_(*OCC, ("d", "SELECT * FROM (VALUES (-2, 0.25), (-1, 0.5), (0, 1.0), (1, 0.5), (2, 0.25)) AS t(d, e)")) + "SELECT feature, CAST(pos + d AS BIGINT) AS pos, round(sum(w * CAST(e AS DOUBLE)), 6) + 0.0 AS w FROM w, d GROUP BY feature, pos + d")
add("predict_positional", lambda s, d: rounded(explain.predict_positional(bench("dna")(s, d), PS, positional3(s, d), OFFSET), "decision"), sql.with_(*OCC) + f"SELECT seq_id, round(sum(w) / max(norm) + {OFFSET}, 6) + 0.0 AS decision FROM o JOIN w USING (feature, pos) JOIN z USING (seq_id) GROUP BY seq_id")

NORM = "SELECT seq_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM c GROUP BY seq_id"


def unit_weights(s: SparkSession, d: str, spec) -> DataFrame:
    """A weight for every feature of the benchmark: the number of sequences that have it, over 10."""
    return extract.counts(bench("dna")(s, d), spec).groupBy("feature").agg((F.count("*") / 10).alias("w"))


UNIT = ("u", "SELECT feature, count(*) / 10.0::DOUBLE AS w FROM c GROUP BY feature")


def profile_entry(name: str, spec, at: str) -> None:
    """at: SQL list of the offsets that carry the weight of feature f."""
    occ = sql.occurrences("s", spec) if not isinstance(spec, MismatchSpec) else None
    if occ is None:
        w = sql.windows("s", spec, spec.k, f"{spec.letters.char_class}{{{spec.k}}}")
        occ = f"SELECT seq_id, pos, k.w AS w, feature FROM ({w}) k JOIN ({sql.neighbour_table(spec, f'({w})')}) t ON k.w = t.w"
    q = sql.with_(B_DNA, ("c", sql.counts("s", spec)), ("o", occ), ("z", NORM), UNIT, ("l", f"SELECT o.seq_id, pos, feature, {at} AS spots FROM o"))
    add(name, lambda s, d: rounded(explain.profile(bench("dna")(s, d), spec, unit_weights(s, d, spec)), "contrib"), q + "SELECT seq_id, CAST(pos + i AS BIGINT) AS pos, round(sum(part), 6) AS contrib FROM (SELECT l.seq_id, pos, u.w / len(spots) / norm AS part, unnest(spots) AS i FROM l JOIN u USING (feature) JOIN z USING (seq_id)) GROUP BY 1, 2")


MASKS = "CASE feature " + " ".join(f"WHEN '{m}' THEN {at}" for m, at in zip(MOTIFS, ([0, 2], [0, 1, 2], [0, 1, 2, 3], [0, 1], [0, 1, 3, 4]), strict=True)) + " END"
profile_entry("profile_spectrum", SpectrumSpec(k=3), "[0, 1, 2]")
profile_entry("profile_gappy", GappySpec(k=1, m=2), "[0, length(feature) - 1]")
profile_entry("profile_mismatch", MismatchSpec(k=3, m=1), "list_filter([0, 1, 2], lambda i: substr(w, CAST(i + 1 AS INT), 1) = substr(feature, CAST(i + 1 AS INT), 1))")
profile_entry("profile_motif", MotifSpec(motifs=MOTIFS), MASKS)

PROFILE = ORACLES["profile_spectrum"]


def profile3(s: SparkSession, d: str) -> DataFrame:
    return rounded(explain.profile(bench("dna")(s, d), SpectrumSpec(k=3), unit_weights(s, d, SpectrumSpec(k=3))), "contrib")


def unrounded_profile(name: str) -> str:
    return ORACLES[name].replace("round(sum(part), 6) AS contrib", "sum(part) AS contrib")


MIXED = f"SELECT seq_id, pos, round(sum(contrib), 6) + 0.0 AS contrib FROM (SELECT seq_id, pos, 0.6 * contrib AS contrib FROM ({unrounded_profile('profile_spectrum')}) UNION ALL SELECT seq_id, pos, 0.4 * contrib FROM ({unrounded_profile('profile_gappy')})) GROUP BY 1, 2"
add("profile_mixture", lambda s, d: rounded(explain.mixture_profile(bench("dna")(s, d), Mixture(((0.6, SpectrumSpec(k=3)), (0.4, GappySpec(k=1, m=2)))), [unit_weights(s, d, SpectrumSpec(k=3)), unit_weights(s, d, GappySpec(k=1, m=2))]), "contrib"), MIXED)
add("profile_smoothed", lambda s, d: rounded_to(explain.smoothed(profile3(s, d), 5), 4), f"SELECT seq_id, pos, round(sum(contrib) OVER w / nullif(count(*) OVER w - 1, 0) + 1e-9, 4) AS contrib FROM ({PROFILE}) WINDOW w AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
add("profile_row_order", lambda s, d: explain.profile_order(profile3(s, d)), f"SELECT seq_id, total, CAST(row_number() OVER (ORDER BY total DESC, seq_id) AS BIGINT) AS rank FROM (SELECT seq_id, round(sum(contrib), 6) AS total FROM ({PROFILE}) GROUP BY seq_id)")
add("profile_row_order_user", lambda s, d: explain.profile_order(profile3(s, d), user=bench("dna")(s, d).select("seq_id", (F.col("seq_id") % 7).alias("place"))), f"SELECT seq_id, total, CAST(row_number() OVER (ORDER BY seq_id % 7, seq_id) AS BIGINT) AS rank FROM (SELECT seq_id, round(sum(contrib), 6) AS total FROM ({PROFILE}) GROUP BY 1)")
add("profile_slice", lambda s, d: explain.slice_profile(profile3(s, d), table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("seq_id")), 10, 40), f"SELECT * FROM ({PROFILE}) WHERE seq_id IN (SELECT n_nationkey FROM nation) AND pos BETWEEN 10 AND 40")
add("profile_baseline", lambda s, d: rounded(explain.baselines(docs("dna")(s, d), OFFSET), "baseline"), sql.with_(D_DNA) + f"SELECT seq_id, round(-{OFFSET} / length(seq), 6) + 0.0 AS baseline FROM s")

# --- evaluation ----------------------------------------------------------------------------------------------------

TWO = "SELECT doc_id, CAST(quality AS VARCHAR) AS label, CAST(CASE WHEN doc_id * 7 % 10 < 8 THEN quality ELSE 1 - quality END AS VARCHAR) AS prediction, CAST(doc_id * 7919 % 50 AS DOUBLE) / 50 + quality / 4.0::DOUBLE AS decision FROM labels"
MANY = "SELECT CAST(label AS VARCHAR) AS label, CAST((label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR) AS prediction FROM embeddings"


def two_classes(s: SparkSession, d: str) -> DataFrame:
    q = F.col("quality")
    return table(s, d, "labels").select("doc_id", q.cast("string").alias("label"), F.when(F.col("doc_id") * 7 % 10 < 8, q).otherwise(1 - q).cast("string").alias("prediction"), ((F.col("doc_id") * 7919 % 50).cast("double") / 50 + q / F.lit(4.0)).alias("decision"))


def many_classes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("label").cast("string").alias("label"), ((F.col("label") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)) % 10).cast("string").alias("prediction"))


METRICS = ("acc", "bal_acc", "sens", "spec", "prec", "mcc")
_C = "SELECT CAST(count(*) AS BIGINT) AS num, CAST(count(*) FILTER (prediction = '1' AND label = '1') AS BIGINT) AS tp, CAST(count(*) FILTER (prediction = '1' AND label <> '1') AS BIGINT) AS fp, CAST(count(*) FILTER (prediction <> '1' AND label = '1') AS BIGINT) AS fn, CAST(count(*) FILTER (prediction <> '1' AND label <> '1') AS BIGINT) AS tn FROM p"
add("confusion_matrix", lambda s, d: evaluate.confusion(many_classes(s, d)), f"SELECT prediction, label, CAST(count(*) AS BIGINT) AS n FROM ({MANY}) GROUP BY ALL")
add("metrics_binary", lambda s, d: rounded(evaluate.binary_metrics(two_classes(s, d), "1"), *METRICS), sql.with_(("p", TWO), ("c", _C)) + "SELECT num, tp, fp, fn, tn, round(100.0 * (tp + tn) / num, 6) AS acc, round((100.0 * tp / (tp + fn) + 100.0 * tn / (tn + fp)) / 2, 6) AS bal_acc, round(100.0 * tp / (tp + fn), 6) AS sens, round(100.0 * tn / (tn + fp), 6) AS spec, round(100.0 * tp / (tp + fp), 6) AS prec, round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 6) AS mcc FROM c")
add("metrics_by_class", lambda s, d: rounded(evaluate.class_metrics(many_classes(s, d)), "sens", "spec", "prec"), sql.with_(("p", MANY), ("l", "SELECT DISTINCT label AS k FROM p")) + "SELECT k AS label, round(100.0 * count(*) FILTER (label = k AND prediction = k) / count(*) FILTER (label = k), 6) AS sens, round(100.0 * count(*) FILTER (label <> k AND prediction <> k) / count(*) FILTER (label <> k), 6) AS spec, round(100.0 * count(*) FILTER (label = k AND prediction = k) / nullif(count(*) FILTER (prediction = k), 0), 6) AS prec FROM p, l GROUP BY k")
add("metrics_multiclass", lambda s, d: rounded(evaluate.multiclass_metrics(many_classes(s, d)), "acc", "bal_acc", "mcc"), sql.with_(("p", MANY), ("t", "SELECT label AS k, count(*)::DOUBLE AS t, count(*) FILTER (label = prediction)::DOUBLE AS h FROM p GROUP BY label"), ("q", "SELECT prediction AS k, count(*)::DOUBLE AS p FROM p GROUP BY prediction"), ("r", "SELECT sum(t) AS s, sum(h) AS c, sum(t * coalesce(p, 0)) AS tp, sum(t * t) AS tt, (SELECT sum(p * p) FROM q) AS pp, avg(h / t) AS recall FROM t LEFT JOIN q USING (k)")) + "SELECT round(100 * c / s, 6) AS acc, round(100 * recall, 6) AS bal_acc, round((c * s - tp) / (sqrt(s * s - pp) * sqrt(s * s - tt)), 6) AS mcc FROM r")
add("roc_points", lambda s, d: rounded(evaluate.roc_points(two_classes(s, d), "1"), "decision", "tpr", "fpr"), sql.with_(("p", TWO)) + "SELECT DISTINCT round(decision, 6) AS decision, round(count(*) FILTER (label = '1') OVER (ORDER BY decision DESC) / (SELECT count(*) FROM p WHERE label = '1')::DOUBLE, 6) AS tpr, round(count(*) FILTER (label <> '1') OVER (ORDER BY decision DESC) / (SELECT count(*) FROM p WHERE label <> '1')::DOUBLE, 6) AS fpr FROM p")
add("auc", lambda s, d: rounded(evaluate.auc(two_classes(s, d), "1"), "auc"), sql.with_(("p", TWO)) + "SELECT round(avg(CASE WHEN a.decision > b.decision THEN 1.0::DOUBLE WHEN a.decision = b.decision THEN 0.5 ELSE 0 END), 6) AS auc FROM p a, p b WHERE a.label = '1' AND b.label <> '1'")
add("mse", lambda s, d: rounded(evaluate.mse(two_classes(s, d).select(F.col("decision").alias("prediction"), F.col("label").cast("double").alias("label"))), "mse"), sql.with_(("p", TWO)) + "SELECT round(avg((decision - CAST(label AS DOUBLE)) ^ 2), 6) AS mse FROM p")

# --- learning ------------------------------------------------------------------------------------------------------


def labelled(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").select(F.col("doc_id").alias("seq_id"), "quality", (F.col("doc_id") % 7).alias("grp"))


def fold_sql(key: str) -> str:
    return f"SELECT doc_id AS seq_id, CAST(run AS INT) AS run, ('0x' || substr(md5(concat_ws('|', {key}, run, 1)), 1, 8))::BIGINT % 5 AS fold FROM labels, range(0, 2) AS t(run)"


add("cv_folds_plain", lambda s, d: learn.folds(labelled(s, d), 5, 2), fold_sql("doc_id"))
add("cv_folds_grouped", lambda s, d: learn.folds(labelled(s, d), 5, 2, group="grp"), fold_sql("(doc_id % 7)"))
add("cv_folds_leave_one_out", lambda s, d: learn.folds(labelled(s, d), -1), "SELECT doc_id AS seq_id, CAST(0 AS INT) AS run, doc_id AS fold FROM labels")

GRID = [{"svm": "C-svc", "c": 1.0}, {"svm": "C-svc", "c": 10.0}, {"svm": "nu-svc", "nu": 0.2}]


def learning_matrix(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two kernels of the benchmark passages, labelled by the parity of their length."""
    b = bench("dna")(s, d)
    kernels = [("spectrum", SpectrumSpec(k=2)), ("gappy", GappySpec(k=1, m=1))]
    matrix = None
    for name, spec in kernels:
        part = matrices.kernel_matrix(spec, b).withColumn("kernel", F.lit(name))
        matrix = part if matrix is None else matrix.unionByName(part)
    return matrix.select("kernel", "x_id", "y_id", "v"), b.select("seq_id", (F.length("seq") % 2).cast("string").alias("y"))


def cv_cells(s: SparkSession, d: str) -> DataFrame:
    matrix, y = learning_matrix(s, d)
    return learn.cross_validate(matrix, y, learn.folds(y, 4), GRID)


CELLS = "SELECT 'k' || p_size % 3 AS kernel, CAST(p_size % 4 AS INT) AS cell, CAST(p_partkey % 97 AS DOUBLE) / 97 AS error FROM part"


def part_cells(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.concat(F.lit("k"), (F.col("p_size") % 3).cast("string")).alias("kernel"), (F.col("p_size") % 4).cast("int").alias("cell"), ((F.col("p_partkey") % 97).cast("double") / 97).alias("error")).withColumn("acc", 1 - F.col("error"))


add("grid_best_cell", lambda s, d: learn.grid_search(part_cells(s, d)).select("kernel", "cell"), f"SELECT kernel, cell FROM ({CELLS}) GROUP BY ALL ORDER BY round(avg(error), 9), kernel, cell LIMIT 1")
add("cv_metrics", cv_cells)
add("cv_best", lambda s, d: learn.grid_search(cv_cells(s, d)))


def nested_cv(s: SparkSession, d: str) -> DataFrame:
    matrix, y = learning_matrix(s, d)
    return learn.nested(matrix, y, learn.folds(y, 3), 2, GRID[:2])


add("nested_cv", nested_cv)


def stored_decisions(s: SparkSession, d: str) -> DataFrame:
    """Decisions of the benchmark passages from stored coefficients and their kernel."""
    b = bench("dna")(s, d)
    given = {r["seq_id"]: r["coef"] for r in coefficients(b).collect()}
    model = learn.Model("C-svc", ["b", "a"], np.array(list(given)), {"b/a": np.array(list(given.values()))}, {"b/a": OFFSET})
    return train.decisions(train.Trained(SpectrumSpec(k=3), planner.choose_method(SpectrumSpec(k=3), len(given), "no"), model, b), b)


add("predict_stored_model", lambda s, d: rounded(stored_decisions(s, d), "decision"), sql.with_(*K3) + f", q AS ({COEF}) SELECT x_id AS seq_id, 'b/a' AS svm, round(sum(v * coef) + {OFFSET}, 6) + 0.0 AS decision FROM k JOIN q ON q.seq_id = y_id GROUP BY x_id")


def train_predict(s: SparkSession, d: str) -> DataFrame:
    """Classes of all documents by a machine trained on the labelled ones."""
    seqs = docs("dna")(s, d)
    trained = train.train(seqs, table(s, d, "labels").select(F.col("doc_id").alias("seq_id"), F.col("quality").cast("string").alias("y")), SpectrumSpec(k=2))
    return train.predict(trained, seqs)


add("train_predict", train_predict)
add("session_report", lambda s, d: report.session_report(s))
add("seq_shown", lambda s, d: report.shown(docs("aa")(s, d)).select("seq_id", "width", "view"), sql.with_(S_AA) + "SELECT seq_id, CAST(length(seq) AS BIGINT) AS width, CASE WHEN length(seq) > 40 THEN substr(seq, 1, 18) || '...' || right(seq, 18) ELSE seq END AS view FROM s")


def svm_linear_fit(s: SparkSession, d: str) -> DataFrame:
    rep = represent.explicit_rep(docs("dna")(s, d), SpectrumSpec(k=2))
    weights, offset = learn.fit_linear_large(rep, table(s, d, "labels").select(F.col("doc_id").alias("seq_id"), F.col("quality").alias("y")))
    return weights.withColumn("offset", F.lit(offset))


add("svm_linear_fit", svm_linear_fit)
add("random_sequences", lambda s, d: src.random_sequences(s, "dna", 1000, 50))
