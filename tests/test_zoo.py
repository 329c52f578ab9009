"""Flat models against the pipelines they come from."""

import pytest
from pyspark.sql import functions as F

from fillsight.ml import train as TR, zoo as Z
from fillsight.plans import jobs as J
from fillsight.schema import MARKET
from fillsight.session import materialize

NAMES = ("a", "b", "c", "wide name")


@pytest.fixture(scope="module")
def data(spark):
    r = spark.range(600)
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000)) / 1_000.0
    d = r.select(
        F.concat(F.lit("w"), "id").alias("wallet"), F.concat(F.lit("m"), F.col("id") % 12).alias(MARKET),
        F.when(h(9) > 0.1, h(1)).alias("a"), h(2).alias("b"), F.floor(h(3) * 4).alias("c"), F.when(h(8) > 0.3, h(4) * 100).alias("wide name"),
        (h(1) + h(2) + h(5) / 2 > 1.3).cast("int").alias("is_insider"))
    return materialize(d)


@pytest.fixture(scope="module")
def models(data):
    spec = lambda **kw: TR.TrainSpec(**{"features": NAMES, "n_folds": 2, "large_rows": 10_000, "n_large": 0, "n_small": 3, **kw})
    return {
        "forest": TR.train(data, spec(estimator="forest", params=dict(numTrees=7, maxDepth=5), threshold=0.4)),
        "boosting": TR.train(data, spec(params=dict(maxIter=6, maxDepth=3), missing_indicators=True, threshold=0.3)),
        "logistic": TR.train(data, spec(estimator="logistic", features=("b", "a"), params=dict(max_iter=30), calibrate=False)),
        "stump": TR.train(data, spec(estimator="forest", features=("c",), params=dict(numTrees=2, maxDepth=1), calibrate=False)),
    }


def test_one_pass_equals_every_transform(spark, data, models):
    extra = data.limit(3).withColumns({c: F.lit(None).cast("double") for c in NAMES}).withColumn("wallet", F.concat(F.lit("null-"), "wallet"))
    rows = data.unionByName(extra.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in data.schema]))
    got = {(r.model, r.wallet): r for r in Z.score_zoo(rows, Z.flatten_all(spark, models)).collect()}
    assert len(got) == 603 * 4
    for tag, m in models.items():
        for r in m.score(rows).select("wallet", "pred_prob", "pred_prob_raw", "flagged").collect():
            flat = got[tag, r.wallet]
            assert abs(flat.raw - r.pred_prob_raw) < 1e-9 and abs(flat.score - r.pred_prob) < 1e-9
            assert flat.flagged == r.flagged or abs(r.pred_prob - flat.threshold) < 1e-9


def test_rows_are_scanned_once_for_any_number_of_models(spark, data, models):
    flat = Z.flatten_all(spark, models)
    many = {f"{t}{i}": m for i in range(9) for t, m in flat.items()}
    scored = Z.score_zoo(data, many)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and scored.count() == 600 * 36
    lists = {r.model: r.features for r in Z.feature_lists(spark, flat).collect()}
    assert lists["logistic"] == ["b", "a"]


def test_missing_columns_are_missing_values(spark, data, models):
    flat = {"forest": Z.flatten(spark, models["forest"])}
    without = data.drop("wide name")
    blank = data.withColumn("wide name", F.lit(None).cast("double"))
    score = lambda d: sorted((r.wallet, r.score) for r in Z.score_zoo(d, flat).collect())
    assert score(without) == score(blank) != score(data)
    assert Z.score_zoo(data.limit(0), flat).collect() == []


def test_audit_counts_flags_over_models(spark, data, models):
    out = J.audit_pairs(data, models, {t: m.test_scores for t, m in models.items()}, 0.5)
    assert out.count() == 600 * 4 and out.select("model", "threshold").distinct().count() == 4
    wrong = out.groupBy("wallet", MARKET).agg(F.count_if("flagged").alias("n"), F.max("n_flagged").alias("m"), F.max("n_models").alias("k")).filter("n <> m OR k <> 4")
    assert wrong.isEmpty()
