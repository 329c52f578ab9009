"""Operators against straight-line Python on small random inputs."""

import random
from collections import deque

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from fillsight.operators import asof as A, behavior as B, history as H, ledger as L
from fillsight.ml import metrics as M
from tests.conftest import rows

KEEP = dict(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def norm_trades(spark, groups):
    """groups: list of lists of (ts, side, tokens, price)."""
    data = [
        (f"m{g % 3}", f"w{g}", int(ts), f"t{i:05d}", 0, side, float(p), int(q) * 1_000_000, int(q * 1_000_000) * (1 if side == "BUY" else -1), int(q * p * 1_000_000))
        for g, trades in enumerate(groups) for i, (ts, side, q, p) in enumerate(trades)
    ]
    cols = "market_slug string, wallet string, ts long, trade_id string, role_no int, norm_side string, norm_price double, token_micro long, signed_micro long, cash_micro long"
    return spark.createDataFrame(data, cols)


def queue_fifo(trades):
    """Reference queue walk: matches (entry index, exit index, qty, pnl) and open lots."""
    lots, matches = deque(), []
    for i, (_, side, q, p) in enumerate(trades):
        sign, left = (1 if side == "BUY" else -1), q
        while left and lots and lots[0][1] == -sign:
            j, s, rest, price = lots[0]
            m = min(left, rest)
            matches.append((j, i, m, round((p - price) * s, 9)))
            left -= m
            lots[0] = (j, s, rest - m, price)
            if rest == m:
                lots.popleft()
        if left:
            lots.append((i, sign, left, p))
    return matches, [(i, s * q, p) for i, s, q, p in lots]


def random_groups(rng, n):
    out = []
    for _ in range(n):
        k = rng.randint(1, 25)
        ts = sorted(rng.randint(0, 40) for _ in range(k))
        out.append([(t, rng.choice(["BUY", "SELL"]), rng.randint(1, 6), rng.randint(1, 99) / 100) for t in ts])
    return out


@pytest.mark.parametrize("max_rows", [None, 4])
def test_fifo_is_the_queue(spark, max_rows):
    groups = random_groups(random.Random(5), 60)
    # one trade flips long to short, the next flips back
    groups.append([(1, "BUY", 5, 0.2), (2, "SELL", 9, 0.5), (3, "BUY", 9, 0.4)])
    groups.append([(1, "BUY", 5, 0.2), (1, "BUY", 2, 0.3)])
    t = norm_trades(spark, groups)
    cells = L.wallet_cells(t, max_rows=max_rows) if max_rows else None
    seg = L.fifo_segments(L.build_ledger(t, cells), max_rows)
    got_m, got_o = {}, {}
    for r in L.realized_matches(seg).collect():
        got_m.setdefault(r.wallet, []).append((int(r.entry_trade_id[1:]), int(r.exit_trade_id[1:]), r.qty_micro // 1_000_000, round(r.raw_realized_pnl_per_token, 9)))
    for r in L.open_lots(seg).collect():
        got_o.setdefault(r.wallet, []).append((int(r.trade_id[1:]), r.signed_qty_micro // 1_000_000, r.price))
    for g, trades in enumerate(groups):
        m, o = queue_fifo(trades)
        assert sorted(got_m.get(f"w{g}", [])) == sorted(m)
        assert sorted(got_o.get(f"w{g}", [])) == sorted(o)


def test_lot_closing_times(spark):
    trades = [(1, "BUY", 8, 0.2), (5, "SELL", 2, 0.3), (6, "SELL", 2, 0.3), (9, "SELL", 4, 0.3), (10, "SELL", 3, 0.1)]
    seg = L.fifo_segments(L.build_ledger(norm_trades(spark, [trades])))
    lots = {r.trade_id: r for r in L.build_lots(seg).collect()}
    long, short = lots["t00000"], lots["t00004"]
    assert (long.derisk_0p25, long.derisk_0p375, long.derisk_0p5, long.derisk_0p75, long.derisk_1p0) == (5, 6, 6, 9, 9)
    assert long.remaining_micro == 0 and short.remaining_micro == 3_000_000 and short.side_sign == -1


def test_short_sale_is_refused(spark):
    ok = L.build_ledger(norm_trades(spark, [[(1, "BUY", 2, 0.5), (2, "SELL", 2, 0.5)]]))
    assert L.require_no_short(ok).count() == 2
    bad = L.build_ledger(norm_trades(spark, [[(1, "SELL", 2, 0.5)]]))
    with pytest.raises(Exception, match="exceeds long inventory"):
        L.require_no_short(bad).count()


def test_timeline_against_queue(spark):
    groups = random_groups(random.Random(9), 12)
    led = L.build_ledger(norm_trades(spark, groups))
    tl = L.pnl_timeline(led, L.fifo_segments(led)).toPandas()
    for g, trades in enumerate(groups):
        mine = tl[tl.wallet == f"w{g}"].sort_values("trade_id").reset_index(drop=True)
        pnl = 0.0
        for i in range(len(trades)):
            m, o = queue_fifo(trades[: i + 1])
            pnl = sum(q * p for _, _, q, p in m)
            assert mine.cumulative_realized_pnl[i] == pytest.approx(pnl, abs=1e-6)
            assert mine.position_qty[i] == pytest.approx(sum(q for _, q, _ in o))
            assert mine.position_cost_basis[i] == pytest.approx(sum(q * p for _, q, p in o), abs=1e-6)


@settings(max_examples=12, **KEEP)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=20), st.lists(st.integers(-5, 70), min_size=1, max_size=20), st.sampled_from([None, 3]))
def test_asof_is_merge_asof(spark, hist, probe, tol):
    hist = sorted(set(hist))
    h = spark.createDataFrame([("m", t, t / 100) for t in hist], "market_slug string, h_ts long, v double")
    p = spark.createDataFrame([("m", i, t) for i, t in enumerate(probe)], "market_slug string, i long, ts long")
    left = pd.DataFrame({"i": range(len(probe)), "ts": probe}).sort_values("ts", kind="stable")
    right = pd.DataFrame({"h_ts": hist, "v": [t / 100 for t in hist]})
    for d in ("backward", "forward", "nearest"):
        want = pd.merge_asof(left, right, left_on="ts", right_on="h_ts", direction=d, tolerance=tol).sort_values("i")
        got = {r.i: r.v for r in A.asof_join(p, h, ["market_slug"], "ts", "h_ts", ["v"], d, tolerance=tol).collect()}
        assert [None if pd.isna(v) else v for v in want.v] == [got[i] for i in range(len(probe))]


def test_nearest_tie_takes_the_earlier(spark):
    h = spark.createDataFrame([("m", 4, 0.4), ("m", 6, 0.6)], "market_slug string, h_ts long, v double")
    p = spark.createDataFrame([("m", 5)], "market_slug string, ts long")
    assert A.asof_join(p, h, ["market_slug"], "ts", "h_ts", ["v"], "nearest").first().v == 0.4


def test_equal_timestamps(spark):
    h = spark.createDataFrame([("m", 5, 0.1, "a"), ("m", 5, 0.9, "b")], "market_slug string, h_ts long, v double, id string")
    p = spark.createDataFrame([("m", 5), ("m", 9), ("m", 1)], "market_slug string, ts long")
    f = {r.ts: r.v for r in A.asof_join(p, h, ["market_slug"], "ts", "h_ts", ["v"], "forward", clamp=True, tiebreak=["id"]).collect()}
    b = {r.ts: r.v for r in A.asof_join(p, h, ["market_slug"], "ts", "h_ts", ["v"], "backward", clamp=True, tiebreak=["id"]).collect()}
    assert f == {5: 0.1, 9: 0.9, 1: 0.1} and b == {5: 0.9, 9: 0.9, 1: 0.1}


def test_trailing_statistics(spark):
    rng = random.Random(3)
    ts = sorted(rng.sample(range(0, 90_000), 150))
    price = [round(rng.random(), 3) for _ in ts]
    h = spark.createDataFrame([("m", t, p, str(i)) for i, (t, p) in enumerate(zip(ts, price))], "market_slug string, ts long, yes_price double, trade_id string")
    s = pd.Series(price, index=ts)
    for r in H.trailing_stats(h, h).collect():
        w = s[(s.index >= r.ts - 21_600) & (s.index <= r.ts)]
        if len(w) >= 2:
            assert r.trail_std == pytest.approx(w.std(), abs=1e-9)
            assert r.trail_abs_step == pytest.approx(w.diff().abs().mean(), abs=1e-9)
        else:
            assert r.trail_std is None and r.trail_abs_step is None
        if len(w) >= 3:
            x = pd.Series(w.index, dtype=float) - w.index.to_series().mean()
            slope = float((x.values * (w.values - w.mean())).sum() / (x.values**2).sum())
            assert r.trend_slope == pytest.approx(slope, abs=1e-12)
        else:
            assert r.trend_slope is None


def test_flat_price_has_zero_deviation(spark):
    h = spark.createDataFrame([("m", t, 0.3, str(t)) for t in range(1, 8)], "market_slug string, ts long, yes_price double, trade_id string")
    r = H.trailing_stats(h.filter("ts = 7"), h).first()
    assert (r.trail_std, r.trail_abs_step, r.trend_move) == (0.0, 0.0, 0.0)


def test_metrics_by_hand(spark):
    data = [(0.9, 1), (0.8, 0), (0.8, 1), (0.5, 0), (0.2, 1), (0.1, 0)]
    d = spark.createDataFrame(data, "score double, label int")
    pairs = [(p, n) for p, a in data if a for n, b in data if not b]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    ap = 1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5
    r = M.auc_and_ap(d).first()
    assert r.roc_auc == pytest.approx(auc) and r.pr_auc == pytest.approx(ap)
    # unchanged by a monotone map
    z = d.withColumn("score", 1 / (1 + F.exp(-(3 * F.col("score") - 1))))
    assert M.auc_and_ap(z).first().roc_auc == pytest.approx(auc)
    one = M.auc_and_ap(d.filter("label = 1")).first()
    assert one.roc_auc is None and one.pr_auc is None
    same = M.auc_and_ap(d.withColumn("score", F.lit(0.4))).first()
    assert same.roc_auc == 0.5 and same.pr_auc == 0.5


def test_threshold_falls_back(spark):
    d = spark.createDataFrame([(0.9, 0), (0.8, 1), (0.7, 0)], "score double, label int")
    r = M.tune_threshold(d, 0.9).first()
    assert r.ok and not r.reached and r.threshold == 0.8 and r.precision == 0.5
    none = M.tune_threshold(d.filter("label = 0"), 0.9).first()
    assert not none.ok and none.threshold is None
    rec = M.tune_threshold(d, 1.0, "recall").first()
    assert rec.reached and rec.threshold == 0.8


def test_concentration(spark):
    d = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 1.0), ("b", 1, 0.0)], "k string, g int, v double")
    got = {r.k: r.hhi for r in B.herfindahl(d, ["k"], F.col("g"), "v").collect()}
    assert got == {"a": 0.625, "b": None}


def test_helper_rows_ignore_order(spark):
    d = spark.createDataFrame([(2,), (1,)], "a int")
    assert rows(d) == [(1,), (2,)]
