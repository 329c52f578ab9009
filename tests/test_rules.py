"""Rules of the source data: NULL slugs, cut funder lists, late files, one-class folds."""

import pytest
from pyspark.sql import functions as F

from fillsight import fixtures as X
from fillsight.ml import anomaly as AN, train as TR
from fillsight.operators import dataset as D
from fillsight.plans import metadata as PM
from fillsight.schema import ACTIVITY, FILLS
from fillsight.sources.wallets import read_transfers
from fillsight.streaming import ingest as S


def activity(spark, rows):
    full = [("w", ts, "TRADE", slug, "SELL", usd, 1.0, usd, 0, f"t{ts}", "0") for ts, slug, usd in rows]
    return spark.createDataFrame(full, ACTIVITY)


def test_null_slugs_are_no_market(spark):
    a = activity(spark, [(1, "m1", 10.0), (2, None, 5.0), (3, "m2", 10.0)])
    last = PM.wallet_timeline(a).orderBy(F.desc("ts")).first()
    assert (last.n_markets, last.n_trade_markets, last.vol) == (2, 2, 20_000_000)
    sizes = PM.wallet_sizes(a).first()
    assert sizes.lifetime_micro == 20_000_000 and sizes.total_bet_size_usdc == 25.0


def test_counts_over_the_cap_are_exact_and_cut_lists_give_null(spark, tmp_path):
    (tmp_path / "funder_f1.json").write_text('{"hit_cap": false, "transfers": [%s]}' % ",".join('{"to": "w%d", "ts": %d}' % (i, i) for i in range(9)))
    (tmp_path / "funder_f2.json").write_text('{"hit_cap": true, "transfers": [{"to": "w1", "ts": 1}]}')
    (tmp_path / "funder_f3.json").write_text('{"hit_cap": false, "transfers": []}')
    transfers = read_transfers(spark, f"{tmp_path}/funder_*.json")
    flagged = spark.createDataFrame([("w2",)], "wallet string")
    points = spark.createDataFrame([(f, 5) for f in ("f1", "f2", "f3", "f9")], "funder string, as_of_ts bigint")
    got = {r.funder: (r.n_siblings, r.n_flagged_siblings, r.over_cap) for r in PM.siblings_asof(points, PM.funder_timeline(transfers, flagged, 4)).collect()}
    assert got == {"f1": (6, 1, True), "f2": (None, None, False), "f3": (0, 0, False), "f9": (0, 0, False)}


def test_late_files_are_ingested_once(spark, sf, tmp_path):
    f = X.fills(spark, sf).select(*[F.col(x.name).cast(x.dataType) for x in FILLS])
    middle = f.agg(F.percentile_approx("timestamp", 0.5)).first()[0]
    for part in (f.filter(F.col("timestamp") >= middle), f.filter(F.col("timestamp") < middle), f.limit(50)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        S.ingest_fills(S.fill_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    out = S.ingested(spark, f"{tmp_path}/out")
    assert out.count() == out.select("id").distinct().count() == f.count()


def test_one_class_folds_stop_the_training(spark):
    rows = [(f"w{i}", f"m{i % 3}", float(i), 1 if i % 3 == 0 else 0) for i in range(30)]
    d = spark.createDataFrame(rows, "wallet string, market_slug string, x double, is_insider int")
    spec = TR.TrainSpec(("x",), estimator="logistic", n_folds=3, folds="group")
    folded = TR.prepare(d, spec).withColumn("fold", F.substring("market_slug", 2, 1).cast("int"))
    with pytest.raises(ValueError, match="one class"):
        TR.oof_predictions(folded, spec)


def test_every_tree_has_its_full_sample_and_nulls_become_medians(spark):
    d = spark.range(300).select(F.concat(F.lit("w"), "id").alias("wallet"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("x"))
    forest = AN.fit_forest(d, ["x"], ["wallet"], n_trees=12, sample=64)
    roots = forest.filter("node = 0").collect()
    assert len(roots) == 12 and all(r.size == 64 for r in roots)
    scored = AN.score_forest(d, forest, ["x"])
    middle = scored.filter("x IS NULL").select("anomaly_score").distinct().collect()
    assert len(middle) == 1 and middle[0][0] < 0.6


@pytest.mark.parametrize("name", list(TR.VARIANTS))
def test_every_variant_builds(name):
    spec = TR.variant(name, ("a", "b"))
    stages = TR.pipeline_for(spec, 10.0, "held_out" if spec.early_stop else None).getStages()
    assert {"logistic": "LogisticRegression", "forest": "RandomForestClassifier", "boosting": "GBTClassifier"}[spec.estimator] == type(stages[-1]).__name__
    for key, value in spec.params.items():
        if spec.estimator != "logistic":
            assert stages[-1].getOrDefault(key) == value
    assert not spec.early_stop or stages[-1].getValidationIndicatorCol() == "held_out"


def test_validation_rows_calibrate_and_stop_the_boosting(spark):
    rows = [(f"w{i}", f"m{i % 6}", float((i * 7) % 13), float(i % 6), int((i * 7) % 13 > 8)) for i in range(240)]
    d = spark.createDataFrame(rows, "wallet string, market_slug string, x double, t double, is_insider int")
    spec = TR.variant("time_10_validated", ("x",), time="t", test_markets=("m3",), n_folds=2, params=dict(maxIter=3, maxDepth=2))
    got = TR.train(d, spec)
    assert got.calibrator is not None and got.metrics.first()["roc_auc"] == 1.0
    assert {r.market_slug for r in got.test_scores.select("market_slug").distinct().collect()} == {"m3"}


def test_nested_folds_score_every_row_once(spark):
    rows = [(f"w{i}", f"m{i % 3}", float(i % 10), int(i % 10 > 6)) for i in range(60)]
    d = spark.createDataFrame(rows, "wallet string, market_slug string, x double, is_insider int")
    got = TR.nested_cv(d, TR.TrainSpec(("x",), estimator="logistic", n_folds=2, folds="rows", params=dict(max_iter=5)), [0.1, 1.0], 2)
    assert got.count() == got.select("wallet").distinct().count() == 60


def test_fold_breakdown_lists_the_markets_of_each_fold(spark):
    rows = [(0, "m2", 1), (0, "m10", 0), (0, "m2", 0), (0, None, 1), (1, "m3", 0)]
    d = spark.createDataFrame(rows, "fold int, market_slug string, is_insider int")
    got = {x.fold: (x.n_markets, x.n_rows, x.n_pos, x.markets, x.positive_rate) for x in D.fold_breakdown(d).collect()}
    assert got == {0: (2, 4, 2, "m10,m2", 0.5), 1: (1, 1, 0, "m3", 0.0)}
