"""Fits side by side give what the same fits give one after the other."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from fillsight.ml import together as TG, train as TR
from tests.conftest import rows


def labelled(spark):
    r = spark.range(360)
    return r.select(
        F.concat(F.lit("w"), "id").alias("wallet"), F.concat(F.lit("m"), F.col("id") % 9).alias("market_slug"),
        (F.col("id") * 37 % 101 / 101).alias("x"), (F.col("id") * 53 % 97 / 97).alias("y"),
        ((F.col("id") * 37 % 101 / 101) + (F.col("id") * 53 % 97 / 97) > 1.1).cast("int").alias("is_insider"))


def test_order_errors_and_nesting(spark):
    seen = []

    def task(n):
        def run():
            time.sleep(0.05 * (5 - n))
            seen.append((n, threading.get_ident(), spark.sparkContext.getLocalProperty("spark.scheduler.pool")))
            if seen[-1][2]:  # in a thread of its own: what is nested stays in it
                assert set(TG.side_by_side(spark, [threading.get_ident] * 2)) == {threading.get_ident()}
            return n * n
        return run

    assert TG.side_by_side(spark, [task(n) for n in range(5)]) == [0, 1, 4, 9, 16]
    assert len({t for _, t, _ in seen}) > 1 and len({p for *_, p in seen}) == 5
    assert TG.side_by_side(spark, [task(3)], 1) == [9] and TG.side_by_side(spark, []) == []

    def bad():
        raise ValueError("no")

    with pytest.raises(ValueError):
        TG.side_by_side(spark, [bad, task(1), task(2)])


def test_same_rows_as_one_after_the_other(spark):
    d = labelled(spark)
    spec = TR.TrainSpec(("x", "y"), estimator="forest", params=dict(numTrees=4, maxDepth=3), n_folds=3, large_rows=10_000, n_large=0, n_small=2, calibrate=False)
    folded = TR.materialize(TR.fold_rows(TR.prepare(d, spec), spec))
    assert rows(TR.oof_predictions(folded, spec, 1)) == rows(TR.oof_predictions(folded, spec, 3))
    specs = {n: TR.replace(spec, params=dict(numTrees=n_, maxDepth=2)) for n, n_ in (("a", 2), ("b", 5))}
    assert rows(TR.search(folded, specs, 1)) == rows(TR.search(folded, specs, 4))
    out = lambda width: rows(TR.leave_markets_out(d, spec, ["m1", "m4", "m7"], width).drop("n"))
    assert out(1) == out(3)


def test_best_of_strategies(spark):
    d = labelled(spark)
    spec = lambda **kw: TR.TrainSpec(("x", "y"), n_folds=2, large_rows=10_000, n_large=0, n_small=2, calibrate=False, **kw)
    specs = {"deep": spec(estimator="forest", params=dict(numTrees=8, maxDepth=5)), "stump": spec(estimator="forest", params=dict(numTrees=1, maxDepth=1))}
    best, quality, trained = TR.train_best(d, specs)
    got = {r.tag: r for r in quality.collect()}
    assert best == max(got, key=lambda t: got[t].cv_mean) and got[best].is_best and trained.spec == specs[best]
    assert TR.train_best(d, {"one": specs["stump"], "two": specs["stump"]})[0] == "one"
