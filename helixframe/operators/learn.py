"""Support vector machines on sequence data: solvers, cross validation, grid search and nested selection.

Training data are support vectors' kernels, which a machine holds whole: a fit runs in one task, on at most
SAMPLE_LIMIT sequences. What is parallel is everything around it: each (kernel, parameters, repeat, fold) is one group
of a grouped map. Larger linear problems go to the distributed solver on explicit representations (fit_linear_large).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE_LIMIT = 5_000
#: Groups in which features are numbered.
INDEX_BUCKETS = 1_024
#: Features up to which their numbers are sent to every executor; more are joined by a shuffle.
BROADCAST_FEATURES = 1_000_000


# --- solvers -----------------------------------------------------------------------------------------------------


def box_qp(q: np.ndarray, p: np.ndarray, y: np.ndarray, upper: np.ndarray, start: np.ndarray | None = None, tol: float = 1e-4, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """min a'Qa/2 + p'a with 0 <= a <= upper and y'a fixed at the start's value, by pairs of largest violation. Returns (a, gradient)."""
    a = np.zeros(len(p)) if start is None else start.astype(float).copy()
    g = q @ a + p
    diag = np.diag(q)
    for _ in range(most):
        up = ((y > 0) & (a < upper - 1e-12)) | ((y < 0) & (a > 1e-12))
        low = ((y > 0) & (a > 1e-12)) | ((y < 0) & (a < upper - 1e-12))
        score = -y * g
        if not up.any() or not low.any():
            break
        i = int(np.where(up, score, -np.inf).argmax())
        gap = score[i] - score
        if gap[low].max() < tol:
            break
        # Second-order choice of the partner: the largest decrease along the pair.
        curve = np.maximum(diag[i] + diag - 2 * y[i] * y * q[i], 1e-12)
        j = int(np.where(low & (gap > 0), gap * gap / curve, -np.inf).argmax())
        step = gap[j] / curve[j]
        room_i = upper[i] - a[i] if y[i] > 0 else a[i]
        room_j = a[j] if y[j] > 0 else upper[j] - a[j]
        step = min(step, room_i, room_j)
        di, dj = y[i] * step, -y[j] * step
        a[i] += di
        a[j] += dj
        g += q[:, i] * di + q[:, j] * dj
    return np.clip(a, 0, upper), g


def intercept(a: np.ndarray, g: np.ndarray, y: np.ndarray, upper: np.ndarray) -> float:
    free = (a > 1e-9) & (a < upper - 1e-9)
    s = -y * g
    if free.any():
        return float(s[free].mean())
    up = ((y > 0) & (a < upper - 1e-12)) | ((y < 0) & (a > 1e-12))
    low = ((y > 0) & (a > 1e-12)) | ((y < 0) & (a < upper - 1e-12))
    return float((s[up].max(initial=-1e30) + s[low].min(initial=1e30)) / 2) if up.any() and low.any() else 0.0


def c_svc(k: np.ndarray, y: np.ndarray, c: float = 1.0, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(coefficients alpha * y, b) for labels of +1 and -1; weights multiply the cost of each sample."""
    upper = np.full(len(y), float(c)) * (1 if weights is None else weights)
    a, g = box_qp(k * np.outer(y, y), -np.ones(len(y)), y, upper)
    return a * y, intercept(a, g, y, upper)


def bounded_svc(k: np.ndarray, y: np.ndarray, c: float | np.ndarray = 1.0, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Bound-constrained classification: the offset is part of the kernel, so coordinates are free of each other."""
    q = (k + 1) * np.outer(y, y)
    upper = np.broadcast_to(c, len(y))
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(y)):
            new = min(max(a[i] - g[i] / max(q[i, i], 1e-12), 0.0), upper[i])
            if (d := new - a[i]) != 0:
                g += q[:, i] * d
                a[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-6:
            break
    return a * y, float((a * y).sum())


def nu_svc(k: np.ndarray, y: np.ndarray, nu: float = 0.5) -> tuple[np.ndarray, float]:
    """nu-classification: both classes' coefficients sum to nu n / 2; solved with the two sums kept, then rescaled to margin 1."""
    n, left = len(y), {1.0: nu * len(y) / 2, -1.0: nu * len(y) / 2}
    if nu > 2 * min((y > 0).sum(), (y < 0).sum()) / n:
        raise ValueError("nu is too large for the smaller class")
    a = np.zeros(n)
    for i in range(n):
        a[i] = min(1.0, left[float(y[i])])
        left[float(y[i])] -= a[i]
    q = k * np.outer(y, y)
    g = q @ a
    for _ in range(200_000):
        best = None
        for s in (1.0, -1.0):
            up, low = (y == s) & (a < 1 - 1e-12), (y == s) & (a > 1e-12)
            if up.any() and low.any():
                i, j = int(np.where(up, -g, -np.inf).argmax()), int(np.where(low, g, -np.inf).argmax())
                if best is None or g[j] - g[i] > best[0]:
                    best = (g[j] - g[i], i, j)
        if best is None or best[0] < 1e-4:
            break
        gap, i, j = best
        step = min(gap / max(q[i, i] + q[j, j] - 2 * q[i, j], 1e-12), 1 - a[i], a[j])
        a[i] += step
        a[j] -= step
        g += (q[:, i] - q[:, j]) * step

    def level(s: float) -> float:
        free = (y == s) & (a > 1e-9) & (a < 1 - 1e-9)
        if free.any():
            return float(g[free].mean())
        top, bottom = g[(y == s) & (a >= 1 - 1e-9)], g[(y == s) & (a <= 1e-9)]
        return float((top.max(initial=-1e30 if len(bottom) == 0 else bottom.min()) + bottom.min(initial=1e30 if len(top) == 0 else top.max())) / 2)

    r1, r2 = level(1.0), level(-1.0)
    rho = max((r1 + r2) / 2, 1e-12)
    return a * y / rho, float((r1 - r2) / 2 / rho) * -1.0


def one_svc(k: np.ndarray, nu: float = 0.5) -> tuple[np.ndarray, float]:
    """One-class: decision sum(a k) + b, at or above 0 inside."""
    n = len(k)
    start = np.minimum(1.0, np.maximum(0.0, nu * n - np.arange(n)))
    a, g = box_qp(k, np.zeros(n), np.ones(n), np.ones(n), start)
    return a, intercept(a, g, np.ones(n), np.ones(n))


def eps_svr(k: np.ndarray, t: np.ndarray, c: float = 1.0, eps: float = 0.1) -> tuple[np.ndarray, float]:
    """Regression with a tube of eps: two bounded variables for each sample."""
    n = len(t)
    s = np.concatenate([np.ones(n), -np.ones(n)])
    upper = np.full(2 * n, float(c))
    a, g = box_qp(np.tile(k, (2, 2)) * np.outer(s, s), np.concatenate([eps - t, eps + t]), s, upper)
    return a[:n] - a[n:], intercept(a, g, s, upper)


def primal(x: np.ndarray, y: np.ndarray, c: float = 1.0, loss: str = "l2", penalty: str = "l2", rounds: int = 500) -> tuple[np.ndarray, float]:
    """Linear squared-hinge machines on features: L2 by Newton steps, L1 by coordinate descent with a line search. The last column stands for the offset."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    value = lambda u: (0.5 * u @ u if penalty == "l2" else np.abs(u).sum()) + c * (np.maximum(0, 1 - y * (z @ u)) ** 2).sum()
    if penalty == "l2":
        for _ in range(100):
            active = y * (z @ w) < 1
            za = z[active]
            grad = w - 2 * c * za.T @ (y[active] - za @ w)
            if np.abs(grad).max() < 1e-8 * max(1.0, c):
                break
            step = np.linalg.solve(np.eye(len(w)) + 2 * c * za.T @ za, grad)
            t, now = 1.0, value(w)
            while t > 1e-10 and value(w - t * step) > now - 1e-4 * t * (grad @ step):
                t /= 2
            w = w - t * step
        return w[:-1], float(w[-1])
    margin = y * (z @ w)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            short = np.maximum(0, 1 - margin)
            yz = y * z[:, j]
            grad, curve = -2 * c * (yz @ short), max(2 * c * (yz[short > 0] @ yz[short > 0]), 1e-12)
            d = -(grad + 1) / curve if grad + 1 <= curve * w[j] else -(grad - 1) / curve if grad - 1 >= curve * w[j] else -w[j]
            before = c * (short @ short) + abs(w[j])
            for _ in range(20):
                after = c * (np.maximum(0, 1 - margin - d * yz) ** 2).sum() + abs(w[j] + d)
                if after <= before + 0.01 * (grad * d + abs(w[j] + d) - abs(w[j])):
                    break
                d /= 2
            else:
                continue
            w[j] += d
            margin += d * yz
            moved = max(moved, abs(d))
        if moved < 1e-6:
            break
    return w[:-1], float(w[-1])


def crammer_singer(k: np.ndarray, y: np.ndarray, classes: int, c: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Native multiclass: (samples, classes) coefficients; a sample's row sums to 0 and its own class holds at most c."""
    m = np.zeros((len(y), classes))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(y)):
            kii = max(k[i, i], 1e-12)
            f = k[i] @ m - kii * m[i]
            # Projection: minimise kii/2 |v|^2 + v'(f + [class is another]) with v <= c [own class], sum v = 0.
            b = f + (np.arange(classes) != y[i])
            cap = np.where(np.arange(classes) == y[i], c, 0.0)
            low, high = float((b + 0).min() - kii * c - 1), float(b.max() + kii * c + 1)
            for _ in range(60):
                mid = (low + high) / 2
                v = np.minimum(cap, (mid - b) / kii)
                low, high = (mid, high) if v.sum() < 0 else (low, mid)
            moved = max(moved, float(np.abs(v - m[i]).max()))
            m[i] = v
        if moved < 1e-5:
            break
    return m


def platt(decision: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """(A, B) of 1 / (1 + exp(A d + B)), least in cross entropy to labels drawn towards the middle as a uniform prior does.

    For a given slope the best offset is the root of a falling function; along these offsets the slope's derivative
    rises. So both are found by halving intervals, on decisions brought to spread 1.
    """
    yes, no = int(positive.sum()), int((~positive).sum())
    wanted = np.where(positive, (yes + 1) / (yes + 2), 1 / (no + 2))
    middle, spread = float(decision.mean()), float(decision.std()) or 1.0
    x = (decision - middle) / spread

    def halved(f, low: float, high: float) -> float:
        """The root of a rising function."""
        while f(low) > 0:
            low = 2 * low - high
        while f(high) < 0:
            high = 2 * high - low
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < 0 else (low, mid)
        return (low + high) / 2

    def chance(slope: float, offset: float) -> np.ndarray:
        return 0.5 * (1 + np.tanh((slope * x + offset) / 2))

    def offset_for(slope: float) -> float:
        return halved(lambda o: float((chance(slope, o) - wanted).sum()), -1.0, 1.0)

    slope = halved(lambda s: float((x * (chance(s, offset_for(s)) - wanted)).sum()), -1.0, 1.0) if decision.std() else 0.0
    return -slope / spread, slope * middle / spread - offset_for(slope)


def eps_bsvr(k: np.ndarray, t: np.ndarray, c: float = 1.0, eps: float = 0.1, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Regression with a tube and the offset in the kernel: coordinates are free of each other, each has a closed step."""
    q, beta = k + 1, np.zeros(len(t))
    f = np.zeros(len(t))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(t)):
            curve = max(q[i, i], 1e-12)
            pull = t[i] - f[i] + curve * beta[i]
            new = float(np.clip(np.sign(pull) * max(abs(pull) - eps, 0) / curve, -c, c))
            if new != beta[i]:
                f += q[:, i] * (new - beta[i])
                moved = max(moved, abs(new - beta[i]))
                beta[i] = new
        if moved < 1e-6:
            break
    return beta, float(beta.sum())


def nu_svr(k: np.ndarray, t: np.ndarray, c: float = 1.0, nu: float = 0.5) -> tuple[np.ndarray, float]:
    """Regression whose tube is as wide as lets the coefficients sum to c nu n: the sum falls as the tube widens, so its width is found by halving."""
    low, high = 0.0, float(t.max() - t.min()) / 2
    goal = c * nu * len(t)
    out = eps_svr(k, t, c, low)
    if np.abs(out[0]).sum() > goal:
        for _ in range(30):
            eps = (low + high) / 2
            out = eps_svr(k, t, c, eps)
            low, high = (eps, high) if np.abs(out[0]).sum() > goal else (low, eps)
    return out


def weston_watkins(k: np.ndarray, y: np.ndarray, classes: int, c: float = 1.0, rounds: int = 500) -> np.ndarray:
    """Native multiclass with a slack for every sample and other class: (samples, classes) coefficients; the offset is in the kernel, the margin between two classes' decisions 2."""
    q, a = k + 1, np.zeros((len(y), classes))
    m = np.zeros((len(y), classes))
    f = np.zeros((len(y), classes))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(y)):
            for other in range(classes):
                if other == y[i]:
                    continue
                new = float(np.clip(a[i, other] + (2 - f[i, y[i]] + f[i, other]) / (2 * max(q[i, i], 1e-12)), 0, c))
                d = new - a[i, other]
                if d:
                    a[i, other] = new
                    m[i, y[i]] += d
                    m[i, other] -= d
                    f[:, y[i]] += q[:, i] * d
                    f[:, other] -= q[:, i] * d
                    moved = max(moved, abs(d))
        if moved < 1e-5:
            break
    return m


# --- models ------------------------------------------------------------------------------------------------------

#: Names of machines that fit() takes. The l2rl2l and l1rl2l ones work on features, the others on kernels.
MACHINES = ("C-svc", "C-bsvc", "nu-svc", "one-svc", "eps-svr", "nu-svr", "eps-bsvr", "mc-natC", "mc-natW", "l2rl2l-svc", "l2rl2lp-svc", "l1rl2l-svc")
REGRESSIONS = ("eps-svr", "nu-svr", "eps-bsvr")
#: Machines that take a cost of its own for every class.
WEIGHTED = ("C-svc", "C-bsvc")
#: A model as a table: one row of kind `model` (text holds the rest as JSON), the others a machine's coefficients by sample or feature place.
MODEL_ROWS = "kind string, machine string, id long, value double, text string"


@dataclass
class Model:
    """Coefficients of training samples by machine: one for two classes or regression, one a pair or class otherwise."""

    svm: str
    classes: list
    ids: np.ndarray
    coefficients: dict[str, np.ndarray] = field(default_factory=dict)
    offsets: dict[str, float] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    platt: tuple[float, float] | None = None

    def decisions(self, k: np.ndarray) -> dict[str, np.ndarray]:
        """Decision values for a (new, training) kernel, or (new, features) matrix for the linear machines."""
        return {m: k @ v + self.offsets[m] for m, v in (self.weights or self.coefficients).items()}

    def predict(self, k: np.ndarray) -> np.ndarray:
        d = self.decisions(k)
        if not self.classes:
            return next(iter(d.values()))
        if len(self.classes) == 2:
            positive, negative = self.classes
            return np.where(next(iter(d.values())) >= 0, positive, negative)
        if self.svm in ("mc-natC", "mc-natW") or self.weights:
            return np.array(self.classes)[np.stack([d[str(c)] for c in self.classes], axis=1).argmax(axis=1)]
        votes = np.zeros((len(k), len(self.classes)))
        for m, v in d.items():
            a, b = (self.classes.index(c) for c in self._pairs[m])
            votes[:, a] += v >= 0
            votes[:, b] += v < 0
        return np.array(self.classes)[votes.argmax(axis=1)]

    _pairs: dict[str, tuple] = field(default_factory=dict)

    def support(self, m: str | None = None) -> np.ndarray:
        """Ids with a coefficient."""
        c = self.coefficients[m or next(iter(self.coefficients))]
        return self.ids[np.abs(c) > 1e-9]

    def rows(self) -> list[tuple]:
        """The model as rows of MODEL_ROWS."""
        rest = {"svm": self.svm, "classes": self.classes, "offsets": self.offsets, "platt": self.platt, "pairs": {m: list(p) for m, p in self._pairs.items()}, "ids": [int(i) for i in self.ids]}
        plain = lambda x: x.item() if hasattr(x, "item") else str(x)
        out = [("model", None, None, None, json.dumps(rest, default=plain))]
        out += [("coefficient", m, int(i), float(c), None) for m, v in self.coefficients.items() for i, c in zip(self.ids, v, strict=True)]
        return out + [("weight", m, i, float(c), None) for m, v in self.weights.items() for i, c in enumerate(v)]

    @staticmethod
    def of_rows(rows: Iterable) -> Model:
        """Back from rows()."""
        rows = list(rows)
        rest = json.loads(next(r[4] for r in rows if r[0] == "model"))
        model = Model(rest["svm"], rest["classes"], np.array(rest["ids"], np.int64), offsets=rest["offsets"], platt=tuple(rest["platt"]) if rest["platt"] else None)
        model._pairs = {m: tuple(p) for m, p in rest["pairs"].items()}
        place = {i: n for n, i in enumerate(rest["ids"])}
        for kind, machine, i, value, _ in rows:
            if kind == "coefficient":
                model.coefficients.setdefault(machine, np.zeros(len(place)))[place[i]] = value
            elif kind == "weight":
                model.weights.setdefault(machine, {})[i] = value
        model.weights = {m: np.array([v[i] for i in range(len(v))]) for m, v in model.weights.items()}
        return model

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as a Parquet table of MODEL_ROWS."""
        spark.createDataFrame(self.rows(), MODEL_ROWS).coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        return Model.of_rows(spark.read.parquet(path).collect())

    def coefficient_rows(self) -> list[tuple[str, int, float]]:
        """(svm, seq_id, coef) of the support vectors, for feature_weights()."""
        return [(m, int(i), float(c)) for m, v in self.coefficients.items() for i, c in zip(self.ids, v, strict=True) if abs(c) > 1e-9]


def fit(k: np.ndarray, y: Sequence, svm: str = "C-svc", c: float = 1.0, nu: float = 0.5, eps: float = 0.1, class_weights: dict | None = None, ids: Iterable[int] | None = None, probability: bool = False) -> Model:
    """Train on a kernel (or feature) matrix. The positive class is the larger label; more than two classes are voted by pairs, by classes for the linear machines."""
    if svm not in MACHINES:
        raise ValueError(f"unknown machine {svm!r}")
    ids = np.arange(len(k)) if ids is None else np.asarray(list(ids))
    if len(k) > SAMPLE_LIMIT:
        raise ValueError("too many samples for one task; use fit_linear_large")
    y = np.asarray(y)
    if class_weights and svm not in WEIGHTED:
        raise ValueError(f"{svm} has no class weights")
    if svm in REGRESSIONS:
        t = y.astype(float)
        a, b = eps_svr(k, t, c, eps) if svm == "eps-svr" else nu_svr(k, t, c, nu) if svm == "nu-svr" else eps_bsvr(k, t, c, eps)
        return Model(svm, [], ids, {"svr": a}, {"svr": b})
    if svm == "one-svc":
        a, b = one_svc(k, nu)
        return Model(svm, [], ids, {"one": a}, {"one": b})
    classes = sorted(set(y.tolist()), reverse=True)
    model = Model(svm, classes, ids)
    cost = np.array([(class_weights or {}).get(v, 1.0) for v in y.tolist()])
    if svm in ("mc-natC", "mc-natW"):
        m = (crammer_singer if svm == "mc-natC" else weston_watkins)(k, np.array([classes.index(v) for v in y.tolist()]), len(classes), c)
        model.coefficients = {str(v): m[:, i] for i, v in enumerate(classes)}
        model.offsets = {str(v): float(m[:, i].sum()) if svm == "mc-natW" else 0.0 for i, v in enumerate(classes)}
        return model
    if svm in ("l2rl2l-svc", "l2rl2lp-svc", "l1rl2l-svc"):
        for v in classes[:1] if len(classes) == 2 else classes:
            w, b = primal(k, np.where(y == v, 1.0, -1.0), c, penalty="l1" if svm == "l1rl2l-svc" else "l2")
            model.weights[str(v)], model.offsets[str(v)] = w, b
        return model
    for i, p in enumerate(classes):
        for q in classes[i + 1 :]:
            rows = np.flatnonzero((y == p) | (y == q))
            s, kk = np.where(y[rows] == p, 1.0, -1.0), k[np.ix_(rows, rows)]
            a, b = c_svc(kk, s, c, cost[rows]) if svm == "C-svc" else bounded_svc(kk, s, c * cost[rows]) if svm == "C-bsvc" else nu_svc(kk, s, nu)
            full = np.zeros(len(y))
            full[rows] = a
            name = f"{p}/{q}"
            model.coefficients[name], model.offsets[name], model._pairs[name] = full, b, (p, q)
    if probability and len(classes) == 2:
        model.platt = platt(next(iter(model.decisions(k).values())), y == classes[0])
    return model


def dual_gap(k: np.ndarray, y: np.ndarray, coefficients: np.ndarray, b: float, c: float) -> float:
    """Primal less dual objective of two-class C-svc; near 0 at the optimum."""
    f = k @ coefficients + b
    w2 = coefficients @ k @ coefficients
    return float(0.5 * w2 + c * np.maximum(0, 1 - y * f).sum() - (np.abs(coefficients).sum() - 0.5 * w2))


# --- selection ---------------------------------------------------------------------------------------------------


def folds(samples: DataFrame, k: int, repeats: int = 1, seed: int = 1, group: str | None = None) -> DataFrame:
    """(seq_id, run, fold): k nearly even folds for every run, or leave-one-out with k = -1. A group never spans folds. Numbers come from a hash of the id or group, of any type, so reruns agree."""
    if k == 0 or k == 1 or k < -1:
        raise ValueError("the number of folds is 2 or more, or -1")
    if k == -1:
        if group:
            raise ValueError("leave-one-out has no groups")
        return samples.select("seq_id", F.lit(0).alias("run"), F.col("seq_id").alias("fold"))
    key = group or "seq_id"
    runs = samples.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("run"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("run").cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")
    numbered = runs.withColumn("fold", F.pmod(hashed, F.lit(k)).cast("long"))
    return samples.select("seq_id", *([group] if group else [])).join(numbered, key).select("seq_id", "run", "fold")


def gram(matrix: pd.DataFrame, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """A dense block of a long-form matrix; absent cells are 0."""
    out = np.zeros((len(rows), len(cols)))
    i, j = pd.Index(rows).get_indexer(matrix["x_id"]), pd.Index(cols).get_indexer(matrix["y_id"])
    both = (i >= 0) & (j >= 0)
    out[i[both], j[both]] = matrix["v"].to_numpy()[both]
    return out


#: What cross validation measures; a regression has the error alone.
MEASURES = ("error", "acc", "bacc", "mcc", "auc")


def score(y: np.ndarray, p: np.ndarray, regression: bool, decision: np.ndarray | None = None, positive=None) -> dict[str, float | None]:
    """Measures of predictions; mcc from the confusion matrix of any number of classes, auc from two classes' decisions, ties counting half."""
    out: dict[str, float | None] = dict.fromkeys(MEASURES)
    if regression:
        return out | {"error": float(((p.astype(float) - y.astype(float)) ** 2).mean())}
    classes = np.unique(np.concatenate([y, p]))
    t, g = np.array([(y == c).sum() for c in classes], float), np.array([(p == c).sum() for c in classes], float)
    n, hit = len(y), float((y == p).sum())
    root = np.sqrt((n * n - g @ g) * (n * n - t @ t))
    out |= {"error": 1 - hit / n, "acc": hit / n, "bacc": float(np.mean([(p[y == c] == c).mean() for c in np.unique(y)])), "mcc": float((hit * n - t @ g) / root) if root else 0.0}
    if decision is not None and 0 < (y == positive).sum() < n:
        above = decision[y == positive][:, None] - decision[y != positive][None, :]
        out["auc"] = float(((above > 0) + 0.5 * (above == 0)).mean())
    return out


def cross_validate(matrix: DataFrame, labels: DataFrame, assigned: DataFrame, grid: list[dict]) -> DataFrame:
    """(kernel, cell, run, fold, error, acc, bacc, mcc, auc, n_sv): every cell of a grid on every fold.

    matrix: (kernel, x_id, y_id, v), of kernels or of products of representations; grid: parameters of fit(), by
    position. A (kernel, run, fold) is a task of its own that goes through the grid: it holds one kernel matrix, at most
    SAMPLE_LIMIT squared cells. Matrix and labels are joined per group, not collected on the driver.
    """
    tasks = assigned.select("run", "fold").distinct()
    jobs = matrix.crossJoin(F.broadcast(tasks))
    info = assigned.join(labels, "seq_id").select(F.col("run").alias("r"), F.col("fold").alias("held"), "seq_id", F.col("y").cast("string").alias("y"))
    sides = tasks.crossJoin(F.broadcast(matrix.select("kernel").distinct())).join(info, F.col("run") == F.col("r"))
    # The two sides share ancestors; renamed columns tell them apart.
    sides = sides.select(*(F.col(c).alias(f"_{c}") for c in ("kernel", "run", "fold")), "held", "seq_id", "y")
    regression = dict(labels.dtypes)["y"] in ("double", "float") and any(g.get("svm") in REGRESSIONS for g in grid)
    columns = ["kernel", "cell", "run", "fold", *MEASURES, "n_sv"]

    def run(key: tuple, cells: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        kernel, number, fold = key
        held = rows["held"].to_numpy() == fold
        y = rows["y"].astype(float).to_numpy() if regression else rows["y"].to_numpy()
        ids = rows["seq_id"].to_numpy()
        if held.all() or not held.any() or (not regression and len(set(y[~held])) < 2):
            return pd.DataFrame([], columns=columns)
        k, out = gram(cells, ids, ids), []
        new = k[np.ix_(held, ~held)]
        for cell, parameters in enumerate(grid):
            model = fit(k[np.ix_(~held, ~held)], y[~held], ids=ids[~held], **parameters)
            two = len(model.classes) == 2
            s = score(y[held], model.predict(new), regression, next(iter(model.decisions(new).values())) if two else None, model.classes[0] if two else None)
            out.append((kernel, cell, number, fold, *(s[m] for m in MEASURES), len(model.support()) if model.coefficients else 0))
        return pd.DataFrame(out, columns=columns)

    keys = ["kernel", "run", "fold"]
    measures = ", ".join(f"{m} double" for m in MEASURES)
    return jobs.groupBy(*keys).cogroup(sides.groupBy(*(f"_{k}" for k in keys))).applyInPandas(run, f"kernel string, cell int, run int, fold long, {measures}, n_sv long")


def grid_search(cells: DataFrame, objective: str = "acc") -> DataFrame:
    """One row, the best (kernel, cell): least mean error for acc, else the largest mean of bacc, mcc or auc; the first wins ties."""
    mean = cells.groupBy("kernel", "cell").agg(F.round(F.avg("error"), 9).alias("error"), F.round(F.avg(objective), 9).alias("score"))
    order = [F.asc("error")] if objective == "acc" else [F.desc("score")]
    return mean.orderBy(*order, "kernel", "cell").limit(1)


def nested(matrix: DataFrame, labels: DataFrame, outer: DataFrame, inner_folds: int, grid: list[dict], objective: str = "acc") -> DataFrame:
    """(fold, kernel, cell, error): for every outer fold the cell chosen on the rest and its error on the fold. Inner searches are parallel, outer folds follow each other."""
    spark, out = matrix.sparkSession, []
    for f in sorted(r["fold"] for r in outer.select("fold").distinct().collect()):
        inside = outer.where(F.col("fold") != f).select("seq_id")
        part = matrix.join(inside.withColumnRenamed("seq_id", "x_id"), "x_id", "left_semi").join(inside.withColumnRenamed("seq_id", "y_id"), "y_id", "left_semi")
        best = grid_search(cross_validate(part, labels, folds(inside, inner_folds), grid), objective).first()
        if best is None:
            continue
        cells = cross_validate(matrix.where(F.col("kernel") == best["kernel"]), labels, outer, [grid[best["cell"]]]).where(F.col("fold") == f)
        out += [(int(f), best["kernel"], int(best["cell"]), r["error"]) for r in cells.collect()]
    return spark.createDataFrame(out, "fold long, kernel string, cell int, error double")


def feature_index(rep: DataFrame) -> tuple[DataFrame, int]:
    """((feature, i), number): the features of a representation, numbered from 0 without a gap. The driver holds one count a bucket."""
    # Numbers follow from the features alone, so what is lost of the cached table is made again as it was.
    found = rep.select("feature").where(F.col("feature").isNotNull()).distinct().withColumn("bucket", F.pmod(F.xxhash64("feature"), F.lit(INDEX_BUCKETS))).persist()
    counts = {r["bucket"]: r["count"] for r in found.groupBy("bucket").count().collect()}
    starts = list(itertools.accumulate((counts[b] for b in sorted(counts)), initial=0))
    if starts[-1] >= 2**31:
        raise ValueError(f"{starts[-1]} features are more than a vector can have")
    begin = rep.sparkSession.createDataFrame(list(zip(sorted(counts), starts)), "bucket long, start long")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("feature"))
    return found.withColumn("place", place).join(F.broadcast(begin), "bucket").select("feature", (F.col("start") + F.col("place") - 1).cast("int").alias("i")), starts[-1]


def fit_linear_large(rep: DataFrame, labels: DataFrame, c: float = 1.0, positive: str = "1", rounds: int = 100) -> tuple[DataFrame, float]:
    """((feature, w), b) of a two-class linear machine on an explicit representation of any number of sequences, by Spark's distributed solver.

    All features take part. Sequences are sparse vectors; the solver's own state, about 20 numbers a feature, is
    the driver's.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.linalg import Vectors, VectorUDT

    index, n = feature_index(rep)
    vector = F.udf(lambda cells: Vectors.sparse(n, [x["i"] for x in cells], [x["v"] for x in cells]), VectorUDT())
    rows = rep.join(F.broadcast(index) if n <= BROADCAST_FEATURES else index, "feature").groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("cells")).join(labels, "seq_id")
    data = rows.select(vector("cells").alias("features"), F.when(F.col("y").cast("string") == positive, 1.0).otherwise(0.0).alias("label"))
    model = LinearSVC(regParam=1 / (max(1, data.count()) * c), standardization=False, maxIter=rounds).fit(data)
    weights = rep.sparkSession.createDataFrame(pa.table({"i": pa.array(np.arange(n), pa.int32()), "w": model.coefficients.toArray()}))
    return index.join(weights, "i").select("feature", "w"), float(model.intercept)
