"""Leave-one-out logistic regression without refitting it for every row.

All penalties are fitted together by Newton steps; a step is one pass over the rows that
adds up a gradient and a matrix of features x features for each of them. At the optimum the
score a row would get from the fit on all others follows from that matrix: removing a row
is one Newton step of the rest (the leverage formula), corrected by the third derivatives,
which the last pass adds up as well. The error falls with the square of the number of rows,
or its cube with the correction.

Imputation, scaling and class weights are those of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from fillsight.ml.cluster import standardized
from fillsight.ml.metrics import auc_and_ap
from fillsight.ml.train import LABEL, WEIGHT, with_weights
from fillsight.operators import dataset as D
from fillsight.schema import MARKET
from fillsight.session import materialize

KEYS = ["wallet", MARKET]
# Values of C that are tried unless others are given.
CS = (0.01, 0.03, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 2.0, 5.0)
# Features up to which third derivatives (features cubed) are added up.
THIRD = 40
# Sums of a pass are added up in this many branches first.
BRANCHES = 64
STEPS, SMALL = 60, 1e-10


def design(df: DataFrame, features: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, label, weight and ``x``: the standardized features after a one, written once."""
    rows = df.where(F.col(LABEL).isNotNull()).select(*keys, F.col(LABEL).cast("int").alias(LABEL), *[F.col(c).cast("double").alias(c) for c in features])
    x = F.concat(F.array(F.lit(1.0)), vector_to_array("features"))
    return materialize(with_weights(standardized(rows, features)).select(*keys, LABEL, WEIGHT, "features", x.alias("x")))


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
    return x, b.column(LABEL).to_numpy().astype(float), b.column(WEIGHT).to_numpy()


def _chance(scores: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(scores, -500, 500)))


def _sums(rows: DataFrame, betas: np.ndarray, third: bool = False) -> list[dict[str, np.ndarray]]:
    """Loss, gradient, matrix (and third derivatives) of the weighted loss at each row of ``betas``."""
    n, p = betas.shape
    size = 1 + p + p * p + (p**3 if third else 0)

    def partial(batches):
        total = np.zeros((n, size))
        for b in batches:
            if not b.num_rows:
                continue
            x, y, w = _batch(b)
            for k, beta in enumerate(betas):
                score = x @ beta
                c = _chance(score)
                s = c * (1 - c)
                loss = np.logaddexp(0.0, score) - y * score
                parts = [[w @ loss], x.T @ (w * (c - y)), ((x.T * (w * s)) @ x).ravel()]
                if third:
                    parts.append(np.einsum("n,ni,nj,nk->ijk", w * s * (1 - 2 * c), x, x, x, optimize=True).ravel())
                total[k] += np.concatenate(parts)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(n), pa.int32()), "s": pa.array([t.tobytes() for t in total], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for s in group.column("s").to_pylist():
            total += np.frombuffer(s)
        return pa.table({"k": group.column("k")[:1], "s": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select(LABEL, WEIGHT, "x").mapInArrow(partial, "k int, s binary")
    sums = sums.groupBy("k", (F.spark_partition_id() % BRANCHES).alias("branch")).applyInArrow(add, "k int, s binary")
    sums = sums.groupBy("k").applyInArrow(add, "k int, s binary")
    out: list[dict[str, np.ndarray]] = [{}] * n
    for r in sums.collect():  # one row per penalty
        v = np.frombuffer(bytes(r["s"]))
        out[r["k"]] = {"loss": v[0], "gradient": v[1 : p + 1], "matrix": v[p + 1 : p + 1 + p * p].reshape(p, p)}
        if third:
            out[r["k"]]["third"] = v[p + 1 + p * p :].reshape(p, p, p)
    return out


class Fits:
    """Logistic fits of one design for several penalties: coefficients, matrices at the optimum.

    ``l2``: squared coefficients; ``l1``: absolute ones, where the features that a fit leaves out stay
    out when a row is left out. The intercept has no penalty. ``c`` is the inverse penalty.
    """

    def __init__(self, rows: DataFrame, cs: Sequence[float] = CS, penalty: str = "l2"):
        if penalty not in ("l1", "l2"):
            raise ValueError(f"unknown penalty {penalty}")
        self.rows, self.cs, self.penalty = rows, [float(c) for c in cs], penalty
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no labelled rows")
        p, n = first[0], len(self.cs)
        self.used = np.ones((n, p), bool)
        self.ridge, self.slope = np.zeros((n, p)), np.zeros((n, p))
        start = np.zeros((n, p))
        for k, c in enumerate(self.cs):
            if penalty == "l2":
                self.ridge[k, 1:] = 1.0 / c
            else:
                start[k] = self._sparse(c)
                self.used[k, 1:] = start[k, 1:] != 0
                self.slope[k, 1:] = np.sign(start[k, 1:]) / c
        self.betas = self._newton(start)
        self.third = p <= THIRD + 1
        self.sums = _sums(rows, self.betas, self.third)

    def _sparse(self, c: float) -> np.ndarray:
        weight = self.rows.agg(F.sum(WEIGHT)).first()[0]
        m = LogisticRegression(featuresCol="features", labelCol=LABEL, weightCol=WEIGHT, elasticNetParam=1.0, regParam=1.0 / (c * weight),
                               maxIter=500, tol=1e-10, standardization=False).fit(self.rows)
        return np.r_[m.intercept, m.coefficients.toArray()]

    def _value(self, k: int, loss: float, beta: np.ndarray) -> float:
        return loss + 0.5 * self.ridge[k] @ (beta * beta) + self.slope[k] @ beta

    def _newton(self, betas: np.ndarray) -> np.ndarray:
        """Steps of all fits at once; a step that does not lower a fit's loss is halved."""
        best = [np.inf] * len(betas)
        steps = np.zeros_like(betas)
        kept = betas.copy()
        for _ in range(STEPS):
            moving = False
            for k, s in enumerate(_sums(self.rows, betas)):
                value = self._value(k, s["loss"], betas[k])
                if value > best[k] + 1e-9 * abs(best[k]):
                    steps[k] /= 2
                else:
                    best[k], kept[k] = value, betas[k]
                    use = self.used[k]
                    gradient = (s["gradient"] + self.ridge[k] * betas[k] + self.slope[k])[use]
                    matrix = (s["matrix"] + np.diag(self.ridge[k]))[np.ix_(use, use)]
                    steps[k, use] = np.linalg.lstsq(matrix, gradient, rcond=None)[0]
                moving |= np.abs(steps[k]).max() > SMALL
            if not moving:
                break
            betas = kept - steps
        return kept

    def gradients(self) -> np.ndarray:
        """Gradient of each penalized loss at its fit, over the features it uses."""
        return np.array([(s["gradient"] + self.ridge[k] * self.betas[k] + self.slope[k]) * self.used[k] for k, s in enumerate(self.sums)])

    def _left_out(self, k: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score with all rows, score without the row, coefficients without the row, used ones only)."""
        use = self.used[k]
        z, beta = x[:, use], self.betas[k, use]
        inverse = np.linalg.pinv((self.sums[k]["matrix"] + np.diag(self.ridge[k]))[np.ix_(use, use)])
        score = z @ beta
        c = _chance(score)
        s = c * (1 - c)
        u = z @ inverse
        leverage = np.einsum("ni,ni->n", u, z)
        rest = np.maximum(1 - w * s * leverage, 1e-9)
        a = w * (c - y) / rest
        move = a[:, None] * u
        if self.third:
            t = self.sums[k]["third"][np.ix_(use, use, use)]
            bend = np.einsum("kij,ni,nj->nk", t, move, move, optimize=True)
            bend -= (w * s * (1 - 2 * c) * (leverage * a) ** 2)[:, None] * z
            # the rest's inverse matrix is that of all rows plus a term along the row
            own = (w * s / rest)[:, None] * u
            move = move - 0.5 * (bend @ inverse + own * np.einsum("ni,ni->n", u, bend)[:, None])
        return score, score + np.einsum("ni,ni->n", z, move), beta + move

    def scores(self, keys: Sequence[str] = KEYS) -> DataFrame:
        """keys, label, c, ``raw`` (left out) and ``fitted`` probability of every row and penalty."""
        keys, cs, left_out = list(keys), self.cs, self._left_out
        plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.rows.select(*keys, LABEL).schema)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    x, y, w = _batch(b)
                    for k, c in enumerate(cs):
                        fitted, left, _ = left_out(k, x, y, w)
                        made = [pa.array(np.full(len(y), c)), pa.array(_chance(left)), pa.array(_chance(fitted))]
                        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in (*keys, LABEL)), *made], names=[*keys, LABEL, "c", "raw", "fitted"])

        return self._mapped(run, f"{plain}, c double, raw double, fitted double", keys)

    def _mapped(self, run, schema: str, keys: Sequence[str]) -> DataFrame:
        rows, self.rows = self.rows, None  # the tasks need the arrays, not the frame
        try:
            return rows.select(*keys, LABEL, WEIGHT, "x").mapInArrow(run, schema)
        finally:
            self.rows = rows

    def coefficients(self, features: Sequence[str], c: float, keys: Sequence[str] = KEYS) -> DataFrame:
        """keys, feature, coef: the coefficients of the fit without each row."""
        k, keys, names, left_out, used = self.cs.index(float(c)), list(keys), list(features), self._left_out, self.used
        plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.rows.select(*keys).schema)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    x, y, w = _batch(b)
                    full = np.zeros((len(y), x.shape[1]))
                    full[:, used[k]] = left_out(k, x, y, w)[2]
                    for j, name in enumerate(names, 1):
                        yield pa.RecordBatch.from_arrays(
                            [*(b.column(n) for n in keys), pa.array([name] * len(y)), pa.array(full[:, j].copy())], names=[*keys, "feature", "coef"])

        return self._mapped(run, f"{plain}, feature string, coef double", keys)


def loo_quality(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """c, roc_auc, pr_auc and accuracy of left-out scores, best first: AUC, accuracy, smaller c."""
    right = ((F.col("raw") >= threshold) == (F.col(LABEL) == 1)).cast("double")
    accuracy = scores.groupBy("c").agg(F.avg(right).alias("accuracy"))
    return auc_and_ap(scores, "raw", LABEL, ["c"]).join(accuracy, "c").orderBy(F.col("roc_auc").desc_nulls_last(), F.col("accuracy").desc(), "c")


def tune(df: DataFrame, features: Sequence[str], cs: Sequence[float] = CS, penalty: str = "l2") -> tuple[float, DataFrame, Fits]:
    """The best C by left-out scores, the quality of all, and the fits."""
    fits = Fits(design(df, features), cs, penalty)
    quality = materialize(loo_quality(materialize(fits.scores())))
    best = quality.orderBy(F.col("roc_auc").desc_nulls_last(), F.col("accuracy").desc(), "c").first()["c"]
    return best, quality, fits


def nested(df: DataFrame, features: Sequence[str], cs: Sequence[float] = CS, penalty: str = "l2", outer: int = 5, seed: int = 42) -> DataFrame:
    """keys, label, fold, c, raw: each outer fold scored by a fit on the rest, whose C the rest's left-out scores choose.

    Held-out rows are imputed and scaled as the rest is.
    """
    folded = materialize(D.row_folds(df, outer, seed))
    parts = []
    for k in range(outer):
        rest, held = folded.where(F.col("fold") != k), folded.where(F.col("fold") == k)
        best, _, fits = tune(rest, features, cs, penalty)
        parts.append(_applied(rest, held, features, fits.betas[fits.cs.index(best)]).withColumn("fold", F.lit(k)).withColumn("c", F.lit(best)))
    return D.union_ragged(*parts)


def _applied(rest: DataFrame, held: DataFrame, features: Sequence[str], beta: np.ndarray) -> DataFrame:
    """Scores of ``held`` by a fit on the standardized ``rest``."""
    cast = lambda d: d.where(F.col(LABEL).isNotNull()).select(*KEYS, F.col(LABEL).cast("int").alias(LABEL), *[F.col(c).cast("double").alias(c) for c in features])
    rows = standardized(cast(rest), features, apply_to=cast(held))
    total = F.aggregate(F.zip_with(vector_to_array("features"), F.array(*[F.lit(float(b)) for b in beta[1:]]), lambda a, b: a * b), F.lit(float(beta[0])), lambda s, v: s + v)
    return rows.select(*KEYS, LABEL, (1 / (1 + F.exp(-total))).alias("raw"))
