"""Live features from stored state against the batch features of all fills."""

import pytest
from pyspark.sql import functions as F

from fillsight import fixtures as X
from fillsight.plans.behavior import Behavior
from fillsight.schema import FILLS, MARKET
from fillsight.streaming import ingest as S, live as LV, runs as R
from tests.conftest import rows

KEYS = [MARKET, "wallet"]


@pytest.fixture(scope="module")
def source(spark, sf):
    f = X.fills(spark, sf).select(*[F.col(x.name).cast(x.dataType) for x in FILLS])
    return LV.materialize(f), LV.materialize(X.markets(spark, sf))


def batch_features(fills, markets):
    b = Behavior(fills, markets, stage=False)
    h = b.family("holding").select(*KEYS, "buy_tokens_total", "sell_tokens_total", "net_tokens", "gross_tokens", "net_directional_consistency")
    u = b.family("unrealized").select(*KEYS, "open_position_qty")
    return h.join(b.family("realized"), KEYS, "left").join(u, KEYS, "left")


def check(live, fills, markets):
    want = batch_features(fills, markets)
    got = live.features().select(*want.columns).fillna(0.0, ["open_position_qty"])
    assert rows(got, 6) == rows(want.fillna(0.0, ["open_position_qty"]), 6)
    lots = live.open_lots()
    net = lots.groupBy(*KEYS).agg(F.sum(F.when(F.col("norm_side") == "BUY", F.col("token_micro")).otherwise(-F.col("token_micro"))).alias("q"))
    assert net.join(live.features(), KEYS).filter(F.abs(F.col("q") / 1e6 - F.col("open_position_qty")) > 1e-9).isEmpty()


def days(fills, low, high):
    d = (F.col("timestamp") - X.EPOCH_2024) / 86_400
    return fills.filter((d >= low) & (d < high))


def test_ordered_batches_read_no_earlier_trades(spark, source, tmp_path, monkeypatch):
    fills, markets = source
    live = LV.LiveFeatures(spark, str(tmp_path), markets)
    monkeypatch.setattr(live, "reopened", lambda *a: pytest.fail("landed trades were read"))
    for i, (low, high) in enumerate([(-99, 6), (6, 14), (14, 20), (20, 999)]):
        live.extend(days(fills, low, high), i)
    check(live, fills, markets)


def test_late_fills_reopen_from_their_time_only(spark, source, tmp_path):
    fills, markets = source
    late = F.pmod(F.xxhash64("id"), F.lit(9)) == 0
    live = LV.LiveFeatures(spark, str(tmp_path), markets)
    live.extend(days(fills, -99, 8), 0)
    live.extend(days(fills, 8, 16).filter(~late), 1)
    live.extend(days(fills, 16, 24), 2)
    third = days(fills, 8, 16).filter(late).unionByName(days(fills, 24, 999))
    touched = live.trades(third).groupBy(*KEYS).agg(F.min("ts").alias("from_ts"))
    starts = live.starts(touched, 3)
    again = live.reopened(starts, 3)
    reopened = starts.filter("reopen")
    assert not reopened.isEmpty() and not starts.filter("NOT reopen AND batch IS NOT NULL").isEmpty()
    # what is read again lies after the tail of each wallet, and is all there is after it
    limits = reopened.select(*KEYS, F.coalesce("last_ts", F.lit(0)).alias("since"))
    every = live.trades(days(fills, -99, 8).unionByName(days(fills, 8, 16).filter(~late)).unionByName(days(fills, 16, 24)))
    want = every.join(limits, KEYS).filter("ts > since")
    assert rows(again.select("trade_id", "role_no")) == rows(want.select("trade_id", "role_no"))
    assert again.count() < every.count() / 2
    live.extend(third, 3)
    check(live, fills, markets)


def test_any_order_of_batches_gives_the_batch_features(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(R.Runs.due, "__defaults__", (2,))  # merge often
    fills, markets = source
    part = lambda i: fills.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == i)
    live = LV.LiveFeatures(spark, str(tmp_path), markets)
    seen = None
    for i in range(5):
        live.extend(part(i), i)
        seen = part(i) if seen is None else seen.unionByName(part(i))
        if i == 2:
            check(live, seen, markets)
    assert len(live.tails.runs()) < 5
    check(live, fills, markets)
    live.extend(part(4), 4)  # a retried batch
    check(live, fills, markets)


def test_thinned_tails_keep_the_times_that_decide(spark):
    cols = [*KEYS, *LV.SUMS, "first_ts", "last_ts", "from_ts", "batch"]
    make = lambda batch, from_ts, last_ts: ("m", "w", *[1] * len(LV.SUMS), 0, last_ts, from_ts, batch)
    tails = spark.createDataFrame([make(0, 0, 10), make(1, 5, 20), make(2, 15, 30), make(3, 200_000, 200_010)], cols)
    kept = {r.batch: (r.from_ts, r.last_ts) for r in LV._thinned(tails).collect()}
    assert kept == {2: (0, 30), 3: (200_000, 200_010)} or kept == {2: (5, 30), 3: (200_000, 200_010), 0: (0, 10)}
    assert [r.valid for r in LV._with_validity(LV._thinned(tails)).filter("batch >= 2").collect()] == [True, True]


def test_followed_stream_stores_scores(spark, source, sf, tmp_path):
    fills, markets = source
    for i, part in enumerate([days(fills, 10, 999), days(fills, -99, 10)]):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        S.ingest_fills(S.fill_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        score = lambda f: f.select(*KEYS, "volume", "n_trades", "open_position_qty")
        LV.follow(S.ingested_stream(spark, f"{tmp_path}/out"), f"{tmp_path}/live", markets, f"{tmp_path}/ck-live", score).awaitTermination()
    got = S.current_state(spark, f"{tmp_path}/live/scores", KEYS)
    want = batch_features(fills, markets).select(*KEYS, "open_position_qty", (F.col("gross_tokens") * 0).alias("z"))
    assert rows(got.select(*KEYS, "open_position_qty"), 6) == rows(want.select(*KEYS, F.coalesce("open_position_qty", F.lit(0.0)).alias("open_position_qty")), 6)
