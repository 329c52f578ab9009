"""Guards, sources, model jobs and streaming on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from fillsight import fixtures as X
from fillsight.ml import train as TR
from fillsight.operators import dataset as D, parsing as P
from fillsight.plans.behavior import Behavior
from fillsight.schema import FILLS, MARKET
from fillsight.sources import tables as ST, wallets as SW
from fillsight.streaming import ingest as S
from tests.conftest import rows


def test_json_documents(spark, tmp_path):
    (tmp_path / "deposit_0xaa.json").write_text(json.dumps({"from": "0xF", "timestamp": 5, "tx_hash": "h"}))
    (tmp_path / "deposit_0xbb.json").write_text("{}")
    (tmp_path / "funder_0xf.json").write_text(json.dumps({"transfers": [{"to": "0xaa", "ts": 1}, {"to": "0xbb", "ts": 2}], "hit_cap": False}))
    d = {r.wallet: r.first_deposit_ts for r in SW.read_deposits(spark, f"{tmp_path}/deposit_*.json").collect()}
    assert d == {"0xaa": 5, "0xbb": None}
    t = SW.read_transfers(spark, f"{tmp_path}/funder_*.json")
    assert rows(t.select("funder", "to", "ts")) == [("0xf", "0xaa", 1), ("0xf", "0xbb", 2)]


def test_strict_join_guards(spark):
    base = spark.createDataFrame([("A", "m", 1.0), ("b", "m", 2.0)], "wallet string, market_slug string, x double")
    extra = spark.createDataFrame([("a", "m", 3.0), ("B", "m", 4.0)], "wallet string, market_slug string, y double")
    assert D.strict_join(base, extra, ["y"]).count() == 2
    for left, right, cols, text in (
        (base.drop("wallet"), extra, ["y"], "key columns"),
        (base, extra, ["z"], "missing columns"),
        (base.withColumn("y", F.lit(1)), extra, ["y"], "already present"),
        (base, extra.unionByName(extra), ["y"], "not unique"),
        (base, extra.filter("wallet = 'a'"), ["y"], "no match"),
    ):
        with pytest.raises(ValueError, match=text):
            D.strict_join(left, right, cols)


def test_token_for_token_and_self_trades(spark):
    m = spark.createDataFrame([("m", ["Yes", "No"], ["Y", "N"], "Y", "N")], "slug string, outcomes array<string>, token_ids array<string>, yes_token_id string, no_token_id string")
    data = [
        ("a", 1, "W", "W", "0", "Y", 50, 100), ("b", 2, "x", "y", "Y", "N", 100, 100), ("c", 3, "x", "y", "0", "Z", 5, 5), ("d", 4, "x", "y", "N", "0", 0, 0),
    ]
    f = spark.createDataFrame(data, "id string, timestamp long, maker string, taker string, makerAssetId string, takerAssetId string, makerAmountFilled long, takerAmountFilled long")
    f = f.select("*", F.lit("t").alias("transactionHash"), F.lit("o").alias("orderHash"), F.lit("0").alias("fee"), F.lit("m").alias(MARKET))
    t = P.parse_trades(f, m)
    got = {(r.trade_id, r.role): (r.wallet, r.side, r.token_id) for r in t.collect()}
    assert got[("a", "maker")] == ("w", "BUY", "Y") and got[("a", "taker")] == ("w", "SELL", "Y")
    assert got[("b", "maker")] == ("x", "SELL", "Y") and not any(k[0] == "c" for k in got)
    assert P.normalize_trades(t).filter("trade_id = 'd'").isEmpty() and P.invalid_trades(t).count() == 2
    assert [r.trade_id for r in P.price_history(f, m).collect()] == ["a"]
    with pytest.raises(Exception, match="invalid trade"):
        P.normalize_trades(t, strict="raise").collect()


def test_open_market_has_no_outcome(spark, sf):
    m = X.markets(spark, sf).withColumn("closed", F.lit(False))
    b = Behavior(X.fills(spark, sf).filter("market_slug < 'm2'"), m, stage=False)
    assert b.family("path").filter("path_alignment IS NOT NULL").isEmpty()
    assert b.family("unrealized").filter("unrealized_edge_per_open_token IS NOT NULL").isEmpty()


def test_markets_never_straddle_folds(spark, sf):
    e = X.base_events(spark, sf).select(F.concat(F.lit("w"), "user_id").alias("wallet"), F.concat(F.lit("m"), F.col("event_id") % 23).alias(MARKET),
                                        (F.col("user_id") % 7 == 0).cast("int").alias("is_insider"))
    f = D.group_folds(e, 4)
    assert f.groupBy(MARKET).agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    assert f.select("fold").distinct().count() == 4
    s = D.sample_negatives(e.groupBy("wallet", MARKET).agg(F.count("*").alias("volume_micro")), e.filter("is_insider = 1"), e.filter("is_insider = 1"), 1)
    assert rows(s) == rows(s) and s.join(e.filter("is_insider = 1"), "wallet", "left_semi").isEmpty()


def test_training_scores_every_row(spark, sf, tmp_path):
    e = X.base_events(spark, sf)
    d = e.select(F.concat(F.lit("w"), "event_id").alias("wallet"), F.concat(F.lit("m"), F.col("event_id") % 12).alias(MARKET),
                 (F.col("value") > 40).cast("int").alias("is_insider"), F.col("value").alias("a"), (F.col("user_id") % 5).cast("double").alias("b"))
    spec = TR.TrainSpec(("a", "b"), estimator="forest", params=dict(numTrees=5, maxDepth=3), split="pinned", test_markets=("m1", "m2"), n_folds=3)
    t = TR.train(d, spec)
    assert TR.unscored_rows(d.filter(~F.col(MARKET).isin("m1", "m2")), t.oof).isEmpty()
    assert t.metrics.first().roc_auc > 0.9
    t.save(str(tmp_path / "m"))
    again = TR.PipelineModel.load(str(tmp_path / "m/model"))
    sample = TR.prepare_unlabelled(d.limit(50), spec)
    assert rows(TR.score_rows(again, sample).select("wallet", "raw")) == rows(TR.score_rows(t.model, sample).select("wallet", "raw"))
    with pytest.raises(ValueError, match="not in data"):
        TR.train(d, TR.replace(spec, test_markets=("nope",)))


def test_market_overwrite(spark, tmp_path):
    p = str(tmp_path / "f")
    a = spark.createDataFrame([("w", "m1", 1.0), ("w", "m2", 2.0)], "wallet string, market_slug string, x double")
    ST.write_features(a, p)
    ST.overwrite_market(a.filter("market_slug = 'm1'").withColumn("x", F.lit(9.0)), p)
    assert rows(ST.read_features(spark, p).select("market_slug", "x")) == [("m1", 9.0), ("m2", 2.0)]


def test_touched_wallets_are_rescored(spark, sf, tmp_path):
    f = X.fills(spark, sf).select(*[F.col(x.name).cast(x.dataType) for x in FILLS])
    f.write.parquet(str(tmp_path / "all"))
    f.filter("id IN ('e1', 'e2')").write.parquet(str(tmp_path / "new"))
    m = X.markets(spark, sf)

    def score(landed):
        return P.cash_volume(P.parse_trades(landed, m)).select(MARKET, "wallet", "n_trades")

    S.rescore_touched(S.fill_stream(spark, str(tmp_path / "new")), lambda s: s.read.parquet(str(tmp_path / "all")), score, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = S.current_state(spark, str(tmp_path / "out"), [MARKET, "wallet"])
    assert got.count() == 4
    want = score(f).join(got.select(MARKET, "wallet"), [MARKET, "wallet"], "left_semi")
    assert rows(got) == rows(want)
