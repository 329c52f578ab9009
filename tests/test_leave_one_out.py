"""Left-out scores against refits without each row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillsight.ml import leave_one_out as LO

NAMES = ["a", "b", "c", "d"]


def table(spark, n, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    y = (r.random(n) < 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.5 * x[:, 1] - 0.8)))).astype(int)
    rows = [(f"w{i:04}", "m", int(y[i]), *map(float, x[i])) for i in range(n)]
    rows[3] = (*rows[3][:4], None, *rows[3][5:])  # imputed
    return spark.createDataFrame(rows, "wallet string, market_slug string, is_insider int, a double, b double, c double, d double")


def refits(rows, c, columns):
    """Fits without each row of the same design, by Newton steps to the end."""
    x, y, w = (np.array(v, float) for v in zip(*[(r.x, r.is_insider, r.weight) for r in rows]))
    x = x[:, columns]
    ridge = np.r_[0.0, np.full(len(columns) - 1, 1.0 / c)]

    def fit(keep):
        beta = np.zeros(len(columns))
        for _ in range(100):
            p = 1 / (1 + np.exp(-x[keep] @ beta))
            step = np.linalg.solve((x[keep].T * (w[keep] * p * (1 - p))) @ x[keep] + np.diag(ridge), x[keep].T @ (w[keep] * (p - y[keep])) + ridge * beta)
            beta -= step
            if np.abs(step).max() < 1e-12:
                return beta

    every = np.arange(len(y))
    betas = np.array([fit(every != i) for i in every])
    return betas, 1 / (1 + np.exp(-np.einsum("ij,ij->i", x, betas)))


def test_left_out_scores_match_refits(spark):
    rows = LO.design(table(spark, 60, 5), NAMES)
    fits = LO.Fits(rows, [0.05, 0.4, 1.0])
    assert np.abs(fits.gradients()).max() < 1e-7
    plain = rows.orderBy("wallet").collect()
    got = {(r.wallet, r.c): r for r in fits.scores().collect()}
    assert len(got) == 180
    for c in fits.cs:
        betas, want = refits(plain, c, list(range(5)))
        assert max(abs(got[r.wallet, c].raw - w) for r, w in zip(plain, want)) < 1e-3
        coefs = {(r.wallet, r.feature): r.coef for r in fits.coefficients(NAMES, c).collect()}
        assert max(abs(coefs[r.wallet, f] - b[j]) for r, b in zip(plain, betas) for j, f in enumerate(NAMES, 1)) < 0.02
    # without the third derivatives the scores are still close
    fits.third = False
    rough = {(r.wallet, r.c): r.raw for r in fits.scores().collect()}
    assert 0 < max(abs(rough[k] - got[k].raw) for k in got) < 1e-2


def test_sparse_fits_keep_their_features(spark):
    rows = LO.design(table(spark, 300, 9), NAMES)
    fits = LO.Fits(rows, [0.05, 5.0], "l1")
    assert fits.used[0].sum() < 5 and np.abs(fits.gradients()).max() < 1e-6
    moved = fits.scores().filter((F.col("fitted") - F.col("raw")) * (2 * F.col("is_insider") - 1) < -1e-9)
    assert moved.isEmpty()


def test_best_penalty_and_nested_folds(spark):
    d = table(spark, 90, 2)
    best, quality, fits = LO.tune(d, NAMES, [0.01, 0.1, 1.0])
    rows = quality.collect()
    assert best == sorted(rows, key=lambda r: (-r.roc_auc, -r.accuracy, r.c))[0].c and all(r.n == 90 for r in rows)
    scored = LO.nested(d, NAMES, [0.01, 1.0], outer=3)
    assert scored.count() == scored.select("wallet").distinct().count() == 90
    assert scored.groupBy("fold").agg(F.count_distinct("c").alias("n")).filter("n > 1").isEmpty()
    with pytest.raises(ValueError):
        LO.Fits(LO.design(d, NAMES), [1.0], "l3")
