"""Patterns, representations and kernels against hand-checked cases and plain loops."""

import itertools
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.functions.kernels import GappySpec, MismatchSpec, Mixture, MotifSpec, PairSpec, SpectrumSpec, exp_weight, gauss_weight, lin_weight, motif_elements, swd_weight
from helixframe.operators import explain, extract, matrices, mismatch, represent
from helixframe.sources.sequences import annotate, annotated_lines, annotation_charset, concat, random_sequences, read_fasta, sequences, subset, with_offset

SEQS = ["ACACGTNACG", "CACGT", "AC", "acgtACGGT", "TTTTT"]


def features(df):
    return sorted(r["feature"] for r in df.collect())


def matrix(df):
    return {(r["x_id"], r["y_id"]): r["v"] for r in df.collect()}


def windows(s, k):
    return [(i, s[i : i + k]) for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")]


def test_gappy_and_mismatch_cases(spark):
    assert features(extract.occurrences(sequences(spark, "CAGAT"), GappySpec(k=1, m=2))) == sorted(["CA", "C.G", "C..A", "AG", "A.A", "A..T", "GA", "G.T", "AT"])
    assert features(extract.counts(sequences(spark, "TA"), MismatchSpec(k=2, m=1))) == sorted("AA CA GA TA TC TG TT".split())


def test_mismatch_two_errors_against_loops(spark):
    got = {(r["seq_id"], r["feature"]): r["n"] for r in extract.counts(sequences(spark, SEQS), MismatchSpec(k=3, m=2)).collect()}
    want = {}
    for i, s in enumerate(SEQS, 1):
        for _, w in windows(s, 3):
            for f in map("".join, itertools.product("ACGT", repeat=3)):
                if sum(a != b for a, b in zip(w, f)) <= 2:
                    want[i, f] = want.get((i, f), 0) + 1
    assert got == want


def test_mismatch_neighbourhoods_are_never_exchanged(spark):
    out = extract.counts(sequences(spark, SEQS), MismatchSpec(k=4, m=2))
    exchanges = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "feature" not in exchanges[0]


def test_mismatch_in_small_pieces_against_loops(monkeypatch):
    rows = [(7, "ACGTNacgtACGGTTTÉACGAC"), (None, "GATTACA"), (7, "CCACGT"), (3, None), (3, "AC"), (None, "TTGAT"), (5, "TTTTTTTTTT"), (7, "")]
    want = {}
    for i, s in rows:
        for _, w in windows((s or "").translate(str.maketrans("acgt", "ACGT")), 4):
            for f in map("".join, itertools.product("ACGT", repeat=4)):
                if sum(a != b for a, b in zip(w, f)) <= 2:
                    want[i, f] = want.get((i, f), 0) + 1
    given = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.string())], ["seq_id", "seq"])
    spec = MismatchSpec(k=4, m=2, ignore_lower=False)
    for piece, states, most in ((5, 8, 1), (3, 64, 2), (1 << 20, 1 << 18, 100)):
        monkeypatch.setattr(mismatch, "PIECE", piece)
        monkeypatch.setattr(mismatch, "STATES", states)
        packed = pa.Table.from_batches(mismatch.counting(spec)(iter([given.slice(0, 3), given.slice(3)]))).sort_by("seq_id").combine_chunks()
        got = [r for b in mismatch.expanding(spec)(iter(packed.to_batches(max_chunksize=most))) for r in b.to_pylist()]
        assert len(got) == len(want) and {(r["seq_id"], r["feature"]): r["n"] for r in got} == want


def test_reverse_complements_share_a_feature(spark):
    assert features(extract.occurrences(sequences(spark, ["ACG", "CGT"]), SpectrumSpec(k=3, rev_complement=True))) == ["ACG", "ACG"]


def test_invalid_short_null_and_lower(spark):
    s = sequences(spark, ["NNN", "A", None, "acg", ""])
    assert extract.occurrences(s, SpectrumSpec(k=2)).count() == 0
    assert features(extract.occurrences(s, SpectrumSpec(k=2, ignore_lower=False))) == ["AC", "CG"]
    assert extract.occurrences(s.limit(0), SpectrumSpec(k=2)).count() == 0


def test_annotation_and_masking(spark):
    s = sequences(spark, ["ACGT"], annotation=["ab-b"])
    assert features(extract.occurrences(s, SpectrumSpec(k=2, annotated=True))) == ["ACab"]
    assert features(extract.occurrences(sequences(spark, ["ACG"], annotation=["aba"]), GappySpec(k=1, m=1, annotated=True))) == ["A.Ga.a", "ACab", "CGba"]
    assert annotation_charset(s) == "ab"
    with pytest.raises(Exception):
        annotate(s, F.lit("x")).collect()
    assert annotate(s, None).first()["annotation"] is None


def test_motifs(spark):
    rows = extract.occurrences(sequences(spark, ["ACACTA"]), MotifSpec(motifs=("A.A", "[^A]A", "C[AT]")))
    assert sorted((r["pos"], r["feature"]) for r in rows.collect()) == [(1, "A.A"), (2, "C[AT]"), (2, "[^A]A"), (4, "C[AT]"), (5, "[^A]A")]
    for bad in ("A[C", "A[CC]", "[C[G]]", "A^C", "A[.]"):
        with pytest.raises(ValueError):
            motif_elements(bad)


def test_limits_and_rules():
    assert SpectrumSpec("aa", k=5).dimension() == 4084101
    for bad in (lambda: SpectrumSpec(k=31), lambda: SpectrumSpec(presence=True, dist_weight=(1.0,)), lambda: MismatchSpec(k=2, m=2), lambda: SpectrumSpec("aa", rev_complement=True), lambda: PairSpec(SpectrumSpec(), "sum")):
        with pytest.raises(ValueError):
            bad()
    assert [f(0) for f in (lin_weight(3), exp_weight(3), gauss_weight(3), swd_weight())] == [1, 1, 1, 0.5]


def test_kernel_of_two(spark):
    p = sequences(spark, ["ACACG", "CACGT"])
    assert matrix(matrices.kernel_matrix(SpectrumSpec(k=2, normalized=False), p))[1, 2] == 4
    assert matrix(matrices.kernel_matrix(SpectrumSpec(k=2), p))[1, 2] == pytest.approx(0.8164965809)


@pytest.mark.parametrize("spec", [SpectrumSpec(k=2, dist_weight=lin_weight(4)), SpectrumSpec(k=2, dist_weight=(1.0,)), SpectrumSpec(k=1, dist_weight=exp_weight(2), normalized=False)])
def test_positions_against_loops(spark, spec):
    offsets = [0, 2, 1, -1, 3]
    got = matrix(matrices.kernel_matrix(spec, sequences(spark, SEQS, offset=offsets), longest=12))
    w = spec.weights(12)
    occ = [[(i - o, f) for i, f in windows(s, spec.k)] for s, o in zip(SEQS, offsets)]
    raw = lambda a, b: sum(w[abs(p - q)] for p, f in occ[a] for q, g in occ[b] if f == g and abs(p - q) < len(w))
    for a in range(5):
        for b in range(5):
            v = raw(a, b)
            if spec.normalized and v:
                v /= math.sqrt(raw(a, a)) * math.sqrt(raw(b, b))
            assert got.get((a + 1, b + 1), 0) == pytest.approx(v)


def test_properties(spark):
    s = sequences(spark, SEQS)
    rep = represent.explicit_rep(s, SpectrumSpec(k=2))
    k = matrix(matrices.kernel_matrix(SpectrumSpec(k=2), s))
    for (x, y), v in matrix(matrices.linear_kernel(rep)).items():
        assert k[x, y] == pytest.approx(v) and k[x, y] == k[y, x] and v <= 1 + 1e-9
    quad, lin = matrix(matrices.linear_kernel(represent.quadratic_rep(rep))), matrix(matrices.linear_kernel(rep))
    assert all(v == pytest.approx(lin[p] ** 2) for p, v in quad.items())
    everywhere = matrix(matrices.kernel_matrix(SpectrumSpec(k=2, dist_weight=(1.0,) * 30), s))
    assert all(v == pytest.approx(k[p]) for p, v in everywhere.items()) and len(everywhere) == len(k)
    mixed = matrix(matrices.kernel_matrix(Mixture(((0.5, SpectrumSpec(k=2)), (0.5, SpectrumSpec(k=2)))), s))
    assert all(v == pytest.approx(k[p]) for p, v in mixed.items())


def test_profiles_sum_to_decisions(spark):
    s = sequences(spark, SEQS)
    for spec in (SpectrumSpec(k=2), GappySpec(k=1, m=2), MismatchSpec(k=3, m=1), MotifSpec(motifs=("A.G", "C[AG]"))):
        rep = represent.explicit_rep(s, spec)
        weights = rep.select("feature").distinct().withColumn("w", F.length("feature") / 3 - F.ascii("feature") / 70)
        decisions = {r["seq_id"]: r["decision"] for r in explain.predict(s, rep, weights).collect()}
        sums = {r["seq_id"]: r["c"] for r in explain.profile(s, spec, weights).groupBy("seq_id").agg(F.sum("contrib").alias("c")).collect()}
        assert all(sums.get(i, 0) == pytest.approx(d) for i, d in decisions.items())


def test_pairs_and_zero_features(spark):
    s = sequences(spark, SEQS[:3])
    k = matrix(matrices.densify(matrices.kernel_matrix(SpectrumSpec(k=2), s), s))
    pairs = matrices.all_pairs(s)
    for kind, f in (("mean", lambda a, b, c, d: (k[a, c] + k[a, d] + k[b, c] + k[b, d]) / 4), ("tppk", lambda a, b, c, d: k[a, c] * k[b, d] + k[a, d] * k[b, c])):
        for r in matrices.pair_matrix(PairSpec(SpectrumSpec(k=2), kind), s, pairs).collect():
            assert r["v"] == pytest.approx(f(*map(int, r["x_pair"].split("_")), *map(int, r["y_pair"].split("_"))))
    full = represent.zero_features(represent.explicit_rep(s, SpectrumSpec(k=2)), s, SpectrumSpec(k=2))
    assert full.count() == 3 * 16


def test_sources(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one first\nACG\nTT\n>two\nGG\n")
    assert sorted((r["name"], r["seq"]) for r in read_fasta(spark, str(tmp_path / "a.fasta")).collect()) == [("one first", "ACGTT"), ("two", "GG")]
    a, b = (random_sequences(spark, "aa", 5, 20, 3).orderBy("seq_id").collect() for _ in range(2))
    assert a == b and all(len(r["seq"]) == 20 for r in a)
    s = sequences(spark, ["ACG", "T"], names=["x", "y"])
    assert concat(s, s.select("seq_id", "seq")).count() == 4
    assert [r["seq_id"] for r in subset(s, s.where("name = 'x'"), negative=True).collect()] == [2]
    assert annotated_lines(sequences(spark, ["A" * 120])).count() == 3
    assert with_offset(s, F.lit(2)).first()["offset"] == 2
    with pytest.raises(ValueError):
        sequences(spark, [])


@pytest.mark.parametrize("spec", [SpectrumSpec(k=2), GappySpec(k=1, m=2, normalized=False), SpectrumSpec(k=2, dist_weight=lin_weight(3)), SpectrumSpec(k=1, dist_weight=(1.0, 0.5), normalized=False)])
def test_blocks_change_no_kernel(spark, monkeypatch, spec):
    x, y = sequences(spark, SEQS * 3, offset=list(range(15)) if spec.dist_weight else None), sequences(spark, SEQS[::-1])
    whole = [matrix(matrices.kernel_matrix(spec, x, other, longest=40)) for other in (None, y)]
    monkeypatch.setattr(matrices, "BLOCK", 2)
    assert matrices.blocks_of(x, y) == (8, 3) and matrices.blocks_of(x, None) == (8, 8)
    for other, want in zip((None, y), whole, strict=True):
        rows = matrices.kernel_matrix(spec, x, other, longest=40).collect()
        got = {(r["x_id"], r["y_id"]): r["v"] for r in rows}
        assert len(got) == len(rows) and got == pytest.approx(want) and len(want) > 10
    rep = represent.explicit_rep(x, SpectrumSpec(k=2))
    half = [matrix(matrices.linear_kernel(rep, triangular=True, diagonal=False, blocks=b)) for b in ((1, 1), (4, 4))]
    assert half[0] == pytest.approx(half[1]) and all(a < b for a, b in half[1])
