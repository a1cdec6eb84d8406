"""Solvers by their optimality, selection by its rules, metrics by plain formulas, streams by the batch result."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import kernels
from helixframe.functions.kernels import PairSpec, SpectrumSpec
from helixframe.operators import evaluate, explain, extract, learn, matrices, ordering, represent, train
from helixframe.plans.planner import choose_method
from helixframe.sources import sequences as source
from helixframe.sources.sequences import random_sequences, sequences
from helixframe.streaming.score import score_stream

RNG = np.random.default_rng(0)
X = RNG.normal(size=(80, 4))
Y = np.where(X[:, 0] + 0.3 * RNG.normal(size=80) > 0, 1.0, -1.0)
K = X @ X.T


@pytest.mark.parametrize("c", [0.1, 1.0, 10.0])
def test_duality_gap(c):
    a, b = learn.c_svc(K, Y, c)
    assert learn.dual_gap(K, Y, a, b, c) < 1e-2 * c and abs(a.sum()) < 1e-8 and np.abs(a).max() <= c + 1e-9


def test_other_machines():
    for f in (lambda: learn.nu_svc(K, Y, 0.3), lambda: learn.bounded_svc(K, Y)):
        a, b = f()
        assert (np.sign(K @ a + b) == Y).mean() > 0.85
    for penalty in ("l2", "l1"):
        w, b = learn.primal(X, Y, 1.0, penalty=penalty)
        assert (np.sign(X @ w + b) == Y).mean() > 0.85
    a, b = learn.eps_svr(K, 2 * X[:, 0] + 1, 10, 0.1)
    assert np.abs(K @ a + b - (2 * X[:, 0] + 1)).max() < 0.11
    rbf = np.exp(-((X[:, None] - X[None]) ** 2).sum(2) / 4)
    a, b = learn.one_svc(rbf, 0.2)
    assert (rbf @ a + b < -1e-3).mean() <= 0.25
    many = np.where(X[:, 0] > 0.4, 2, np.where(X[:, 1] > 0, 1, 0))
    for svm in ("C-svc", "mc-natC", "l2rl2l-svc"):
        data = X if svm.startswith("l2") else K
        assert (learn.fit(data, many, svm).predict(data) == many).mean() > 0.85
    model = learn.fit(K, ["b" if v > 0 else "a" for v in Y], probability=True)
    assert model.classes == ["b", "a"] and model.platt[0] < 0


def test_folds_and_selection(spark):
    s = random_sequences(spark, "dna", 40, 30, 5).withColumn("grp", F.col("seq_id") % 6)
    f = learn.folds(s, 4, 2, group="grp")
    assert f.count() == 80 and f.join(s.select("seq_id", "grp"), "seq_id").groupBy("run", "grp").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert learn.folds(s, -1).select("fold").distinct().count() == 40
    for bad in (0, 1, -2):
        with pytest.raises(ValueError):
            learn.folds(s, bad)
    y = s.select("seq_id", F.when(F.length(F.regexp_replace("seq", "[^AC]", "")) > 15, "1").otherwise("0").alias("y"))
    k = matrices.kernel_matrix(SpectrumSpec(k=1), s).select(F.lit("k1").alias("kernel"), "x_id", "y_id", "v")
    cells = learn.cross_validate(k, y, learn.folds(s, 4), [{"svm": "C-svc", "c": 10.0}, {"svm": "C-svc", "c": 0.01}])
    assert cells.agg(F.min("error")).first()[0] >= 0 and learn.grid_search(cells).first()["kernel"] == "k1"


def test_metrics(spark):
    rows = [("1", "1", 0.9), ("1", "0", 0.9), ("0", "0", 0.1), ("0", "1", 0.4), ("1", "1", 0.7)]
    df = spark.createDataFrame(rows, "prediction string, label string, decision double")
    m = evaluate.binary_metrics(df, "1").first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (2, 1, 1, 1) and m["acc"] == 60
    pos, neg = [d for _, y, d in rows if y == "1"], [d for _, y, d in rows if y == "0"]
    assert evaluate.auc(df, "1").first()["auc"] == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))
    assert evaluate.auc(df.where("label = '1'"), "1").first()["auc"] is None
    assert evaluate.multiclass_metrics(df).first()["mcc"] == pytest.approx(m["mcc"])
    assert evaluate.roc_points(df, "1").count() == 4


def test_large_linear_and_stream(spark, tmp_path):
    s = sequences(spark, ["ACACACGT", "ACACAC", "TTGTTG", "GTTGTT", "ACGACAC", "TGTTGTG"])
    spec = SpectrumSpec(k=2)
    rep = represent.explicit_rep(s, spec)
    w, b = learn.fit_linear_large(rep, s.select("seq_id", F.when(F.col("seq").startswith("AC"), "1").otherwise("0").alias("y")))
    batch = {r["seq_id"]: r["decision"] for r in explain.predict(s, rep, w, b).collect()}
    assert [batch[i] > 0 for i in range(1, 7)] == [True, True, False, False, True, False]
    s.write.parquet(str(tmp_path / "in"))
    scored = score_stream(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")), spec, {r["feature"]: r["w"] for r in w.collect()}, b)
    q = scored.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert {r["seq_id"]: pytest.approx(r["decision"]) for r in spark.table("scored").collect()} == batch


def test_large_linear_has_no_cap_on_features(spark):
    # A million features sort before those that some sequences hold alone.
    common = spark.range(1_000_000).select((F.col("id") % 100).alias("seq_id"), F.concat(F.lit("a"), "id").alias("feature"), F.lit(0.01).alias("v"))
    own = spark.createDataFrame([(i, f"z{i % 2}", 1.0) for i in range(100, 120)], "seq_id long, feature string, v double")
    labels = spark.range(120).select(F.col("id").alias("seq_id"), (F.col("id") % 2).cast("string").alias("y"))
    index, n = learn.feature_index(common.unionByName(own))
    assert n == 1_000_002 and index.agg(F.min("i"), F.max("i"), F.countDistinct("i"), F.countDistinct("feature")).first() == (0, n - 1, n, n)
    w, _ = learn.fit_linear_large(common.unionByName(own), labels, rounds=5)
    got = {r["feature"]: r["w"] for r in w.where("feature LIKE 'z%'").collect()}
    assert w.count() == 1_000_002 and got["z1"] > 0 > got["z0"]


def test_planner():
    assert choose_method(SpectrumSpec(k=3), 100).method == "representation"
    assert choose_method(SpectrumSpec(k=12), 100).method == "matrix"
    assert choose_method(SpectrumSpec(k=12), 6000).solver == "distributed"
    assert choose_method(PairSpec(SpectrumSpec()), 10).method == "matrix"
    with pytest.raises(ValueError):
        choose_method(SpectrumSpec(dist_weight=(1.0,)), 10, explicit="yes")


def test_platt_is_the_least_cross_entropy():
    rng = np.random.default_rng(6)
    d = rng.normal(size=300)
    positive = d + rng.normal(scale=0.7, size=300) > 0.2
    a, b = learn.platt(d, positive)
    t = np.where(positive, (positive.sum() + 1) / (positive.sum() + 2), 1 / ((~positive).sum() + 2))
    cost = lambda a, b: float((np.logaddexp(0, a * d + b) - (1 - t) * (a * d + b)).sum())
    assert a < 0 and all(cost(a, b) <= cost(a + x, b + y) + 1e-9 for x in (-0.01, 0, 0.01) for y in (-0.01, 0, 0.01))
    assert learn.platt(np.array([1.0, 2.0, -1.0, -2.0]), np.array([True, True, False, False]))[0] < 0


def test_regressions_agree():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 3))
    t = x @ np.array([1.0, -2.0, 0.5]) + 0.3
    k = x @ x.T
    for svm in learn.REGRESSIONS:
        model = learn.fit(k, t, svm, c=10.0, nu=0.5, eps=0.05)
        assert np.abs(model.predict(k) - t).max() < 0.3, svm
    beta, _ = learn.nu_svr(k, t + rng.normal(scale=1.0, size=40), 0.1, 0.4)
    assert np.abs(beta).sum() == pytest.approx(0.1 * 0.4 * 40, rel=0.05) and abs(beta.sum()) < 1e-6


def test_native_multiclass_separates():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(loc=c, scale=0.3, size=(15, 2)) for c in ((0, 3), (3, 0), (-3, -3))])
    y = np.repeat(["a", "b", "c"], 15)
    for svm in ("mc-natC", "mc-natW"):
        model = learn.fit(x @ x.T, y, svm)
        assert (model.predict(x @ x.T) == y).mean() > 0.95
        assert np.abs(sum(model.coefficients.values())).max() < 1e-6


def test_class_weights_are_used_or_refused():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 2))
    y = np.where(x[:, 0] + rng.normal(size=60) > 0.8, "yes", "no")
    for svm in learn.WEIGHTED:
        plain, heavy = (learn.fit(x @ x.T, y, svm, class_weights=w).predict(x @ x.T) for w in (None, {"yes": 20.0}))
        assert (heavy == "yes").sum() > (plain == "yes").sum()
    with pytest.raises(ValueError):
        learn.fit(x @ x.T, y, "nu-svc", class_weights={"yes": 2.0})


def test_measures():
    y, p = np.array(["1", "1", "0", "0", "0"]), np.array(["1", "0", "0", "0", "1"])
    s = learn.score(y, p, False, np.array([2.0, -1.0, -1.0, -3.0, 1.0]), "1")
    assert s["mcc"] == pytest.approx((1 * 2 - 1 * 1) / np.sqrt(2 * 2 * 3 * 3)) and s["auc"] == pytest.approx(4.5 / 6) and s["acc"] == 0.6


def test_folds_take_any_id(spark, tmp_path):
    import hashlib

    (tmp_path / "x.fa").write_text(">a\nACGT\n>a\nACGT\n>b\nAC\nGG\n")
    seqs = source.read_fasta(spark, str(tmp_path / "x.fa"))
    assert len({r["seq_id"] for r in seqs.collect()}) == 3
    for r in learn.folds(seqs, 4, 2).collect():
        assert r["fold"] == int(hashlib.md5(f"{r['seq_id']}|{r['run']}|1".encode()).hexdigest()[:8], 16) % 4
    grouped = learn.folds(seqs.withColumn("g", F.col("name")), 4, group="g").join(seqs, "seq_id").collect()
    assert len({r["fold"] for r in grouped if r["name"] == "a"}) == 1


def test_train_predict_and_model_tables(spark, tmp_path):
    rng = np.random.default_rng(10)
    texts = ["".join(rng.choice(list("ACGT"), p=(0.4, 0.1, 0.1, 0.4) if i % 2 else (0.1, 0.4, 0.4, 0.1), size=60)) for i in range(40)]
    seqs = sequences(spark, texts)
    labels = spark.createDataFrame([(i, "p" if i % 2 == 0 else "n") for i in range(1, 31)], "seq_id long, y string")
    spec = kernels.SpectrumSpec(k=2)
    by_rep, by_matrix = (train.train(seqs, labels, spec, explicit=x, probability=True) for x in ("yes", "no"))
    by_matrix.weights = None
    want = {i: "p" if i % 2 == 0 else "n" for i in range(1, 41)}
    first = {r["seq_id"]: r["decision"] for r in train.predict(by_rep, seqs, "decision").collect()}
    second = {r["seq_id"]: r["decision"] for r in train.predict(by_matrix, seqs, "decision").collect()}
    assert all(first[i] == pytest.approx(second[i], abs=1e-3) for i in want)
    assert {r["seq_id"]: r["prediction"] for r in train.predict(by_rep, seqs).collect()} == want
    assert all((r["probability"] > 0.5) == (want[r["seq_id"]] == "p") for r in train.predict(by_rep, seqs, "probabilities").collect())
    offset = next(iter(by_rep.model.offsets.values()))
    sums = {r["seq_id"]: r["s"] for r in train.predict(by_rep, seqs, "profile").groupBy("seq_id").agg(F.sum("contrib").alias("s")).collect()}
    assert all(sums[i] + offset == pytest.approx(first[i], abs=1e-6) for i in want)
    by_rep.model.save(spark, str(tmp_path / "m"))
    again = learn.Model.load(spark, str(tmp_path / "m"))
    k = rng.normal(size=(5, 30))
    assert (again.predict(k) == by_rep.model.predict(k)).all() and again.platt == pytest.approx(by_rep.model.platt)
    three = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(1, 31)], "seq_id long, y string")
    for svm in ("C-svc", "mc-natW"):
        trained = train.train(seqs, three, spec, svm)
        local = learn.Model.of_rows(trained.model.rows())
        matrix = {(r["x_id"], r["y_id"]): r["v"] for r in matrices.kernel_matrix(spec, seqs).collect()}
        k = np.array([[matrix.get((i, j), 0.0) for j in local.ids.tolist()] for i in range(1, 41)])
        assert [r["prediction"] for r in train.predict(trained, seqs).orderBy("seq_id").collect()] == local.predict(k).tolist()


def test_pattern_reads_agree_and_letters_are_checked(spark, monkeypatch):
    seqs = sequences(spark, ["ACGTTGCAACG", "AC", "ACNNGTACGT"])
    for spec in (kernels.GappySpec(k=1, m=2), kernels.MotifSpec(motifs=("A.G", "C[GT]", "TT"))):
        monkeypatch.setattr(extract, "SEPARATE_READS", 32)
        one = sorted(map(tuple, extract.occurrences(seqs, spec).collect()))
        monkeypatch.setattr(extract, "SEPARATE_READS", 1)
        assert one == sorted(map(tuple, extract.occurrences(seqs, spec).collect())) and one
    for motif in ("A+T", "A(T", "AZ", "A[CX]"):
        with pytest.raises(ValueError):
            kernels.MotifSpec(motifs=(motif,))


def test_orders_without_one_partition(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0.5, -2.0, 7.25, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double")
    for descending in (False, True):
        got = {r["id"]: r["n"] for r in ordering.before(df, "x", {"n": F.lit(1)}, descending, ("id",), 16).collect()}
        key = lambda r: ((r[1] is None, -(r[1] or 0)) if descending else (r[1] is not None, r[1] or 0), r[0])
        assert [i for i, _ in sorted(rows, key=key)] == sorted(got, key=got.get)
