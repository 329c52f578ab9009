"""Over-full groups are split into cells; the results must not change."""

import pytest
from pyspark.sql import functions as F

from fillsight import fixtures as X
from fillsight.ml import metrics as M
from fillsight.operators import asof as A, behavior as B, history as H, ledger as L
from fillsight.operators.scan import percentiles, plan_cells, scan
from fillsight.plans import metadata as PM
from fillsight.plans.behavior import FAMILIES, Behavior
from fillsight.sources.wallets import first_deposits
from tests.conftest import rows


@pytest.fixture(scope="module")
def both(spark, sf):
    f, m = X.fills(spark, sf), X.markets(spark, sf)
    # a third of all rows in one wallet of one market
    hot = f.withColumn("maker", F.when(F.col("timestamp") % 3 == 0, "w7").otherwise(F.col("maker"))).withColumn(
        "timestamp", F.expr("timestamp div 600 * 600")
    )
    plain = Behavior(hot, m)
    split = Behavior(hot, m, max_group_rows=8)
    return plain, split


def test_cells_are_used(both):
    plain, split = both
    assert not plain.wallet_cells.split and not plain.market_cells.split
    assert split.wallet_cells.split and split.market_cells.split


@pytest.mark.parametrize("frame", ["ledger", "segments", "lookups", "facts"])
def test_shared_frames(both, frame):
    plain, split = both
    a, b = getattr(plain, frame), getattr(split, frame)
    cols = [c for c in a.columns if c != "_cell"]
    assert rows(a.select(*cols)) == rows(b.select(*cols))


@pytest.mark.parametrize("family", ["entry", "holding", "path", "grid", "fixed", "realized", "adaptive"])
def test_families(both, family):
    plain, split = both
    assert rows(plain.family(family)) == rows(split.family(family))


def test_ledger_carries_only_what_is_read(both):
    assert not {"transactionHash", "orderHash", "counterparty", "token_id", "fee"} & set(both[0].ledger.columns)


def test_tasks_of_medians_grow_with_the_trades(spark, sf, monkeypatch):
    """No task collects the values of more rows than its share, whatever the engine coalesces."""
    small = Behavior(X.fills(spark, sf), X.markets(spark, sf))
    monkeypatch.setattr(B, "MEDIAN_TASK_ROWS", 20)
    n = small.trades.count()
    assert small.median_plan == {"split": False, "tasks": -(-n // 20)}
    t = small.trades.select("market_slug", "wallet", F.col("price").alias("v"))
    got = B.with_medians(t, {"n": F.count("*")}, {"m": F.col("v")}, **small.median_plan)
    assert got.rdd.getNumPartitions() == -(-n // 20)
    assert rows(got) == rows(t.groupBy("market_slug", "wallet").agg(F.count("*").alias("n"), F.median("v").alias("m")))
    monkeypatch.setattr(B, "MEDIAN_GROUP_ROWS", 1)
    del small.__dict__["median_plan"]
    assert small.median_plan["split"]


def test_pnl_timeline(both):
    plain, split = both
    a = L.pnl_timeline(plain.ledger, plain.segments)
    b = L.pnl_timeline(split.ledger, split.segments, split.wallet_cells)
    assert rows(a, 5) == rows(b, 5)


def test_asof_probe_before_every_cell(spark):
    h = spark.createDataFrame([("m", t, float(t), str(t)) for t in range(100_000, 100_400, 10)], "market_slug string, ts long, p double, id string")
    probes = spark.createDataFrame([("m", i, t) for i, t in enumerate([0, 5, 100_000, 100_003, 100_395, 900_000])], "market_slug string, i int, at long")
    cells = plan_cells(h, ["market_slug"], "ts", max_rows=2)
    for d in ("backward", "forward", "nearest"):
        args = (probes, h, ["market_slug"], "at", "ts", ["p"], d)
        assert rows(A.asof_join(*args, clamp=True, tiebreak=["id"])) == rows(A.asof_join(*args, clamp=True, tiebreak=["id"], cells=cells))


def test_price_percentile(both, spark):
    plain, _ = both
    pts = spark.createDataFrame([(f"m{i % 8}", i / 50.0) for i in range(60)], "market_slug string, p double")
    a = H.price_percentile(pts, plain.history, "p", "q")
    b = H.price_percentile(pts, plain.history, "p", "q", max_rows=5)
    assert rows(a) == rows(b)


def test_exact_percentiles(spark, sf):
    e = X.base_events(spark, sf).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.lit(1.5)).otherwise(F.col("value") - 20))
    q = {"a": 0.1, "b": 0.5, "c": 0.9, "d": 0.0, "e": 1.0}
    assert rows(percentiles(e, ["mk"], "v", q)) == rows(percentiles(e, ["mk"], "v", q, split=True))


def test_metadata(spark, sf):
    a, m = X.activity(spark, sf), X.markets(spark, sf)
    pairs = a.select("wallet", F.col("slug").alias("market_slug")).distinct()
    dep, tra, fl = first_deposits(X.incoming(spark, sf)), X.transfers(spark, sf), X.flagged(spark, sf)
    p = PM.metadata_features(pairs, a, m, dep, tra, fl, cap=30)
    s = PM.metadata_features(pairs, a, m, dep, tra, fl, cap=30, max_rows=6)
    assert rows(p) == rows(s)


def test_ranking_metrics(spark, sf):
    s = X.scores(spark, sf)
    assert rows(M.auc_and_ap(s)) == rows(M.auc_and_ap(s, max_rows=6))
    assert rows(M.ranking_curve(s)) == rows(M.ranking_curve(s, max_rows=6))
    assert rows(M.cumulative_hits(s)) == rows(M.cumulative_hits(s, max_rows=6))


def test_descending_scan(spark, sf):
    e = X.base_events(spark, sf).withColumn("one", F.lit(0))
    cells = plan_cells(e, ["one"], "ts", max_rows=1)
    assert len(cells.hot) > 2
    kw = dict(running={"s": ("sum", F.col("value")), "lo": ("min", F.col("value")), "hi": ("max", F.col("value"))},
              latest={"l": F.when(F.col("event_id") % 5 == 0, F.col("event_id"))}, previous={"p": F.col("event_id")})
    for desc in (False, True):
        a = scan(e, ["one"], ["ts", "event_id"], descending=desc, **kw)
        b = scan(cells.label(e, "ts"), ["one"], ["ts", "event_id"], cells=cells, descending=desc, **kw).drop("_cell")
        assert rows(a, 5) == rows(b, 5)


def test_every_feature_is_present(both):
    assert sum(len(c) for c in FAMILIES.values()) == 319


def test_hot_group_without_a_hot_cell_gets_cells_of_the_right_width(spark):
    """30 days of 100 rows: day cells, none over the limit, and a short carry."""
    e = spark.range(3_000).select(F.lit("hot").alias("k"), (F.expr("id div 100") * 86_400 + F.expr("id % 100") * 800).alias("ts"), "id")
    quiet = spark.range(50).select(F.lit("quiet").alias("k"), (F.col("id") * 86_400).alias("ts"), "id")
    cells = plan_cells(e.unionByName(quiet), ["k"], "ts", max_rows=500)
    assert len(cells.hot) == 1
    per = cells.label(e.unionByName(quiet), "ts").groupBy("k", "_cell").count().collect()
    assert sum(r.k == "hot" for r in per) == 30 and max(r["count"] for r in per) == 100
    assert sum(r.k == "quiet" for r in per) == 1


def test_hot_day_inside_a_hot_group_is_cut_into_hours_only(spark):
    day = spark.range(2_400).select(F.lit("hot").alias("k"), (F.col("id") * 36).alias("ts"), "id")
    rest = spark.range(300).select(F.lit("hot").alias("k"), ((F.col("id") + 1) * 86_400).alias("ts"), "id")
    both = day.unionByName(rest)
    cells = plan_cells(both, ["k"], "ts", max_rows=500)
    labelled = cells.label(both, "ts")
    per = labelled.groupBy("_cell").count().collect()
    assert len(per) == 24 + 300 and max(r["count"] for r in per) == 100
    plain = scan(both, ["k"], ["ts", "id"], running={"n": ("count", F.lit(1))})
    split = scan(labelled, ["k"], ["ts", "id"], running={"n": ("count", F.lit(1))}, cells=cells).drop("_cell")
    assert rows(plain) == rows(split)


def test_wallet_aggregation_does_not_stay_on_the_market_partition(spark, sf, monkeypatch):
    """With a market table too large to broadcast, rows of a heavy market are dealt before and after the join."""
    from fillsight.operators import parsing as P, scan as SC

    monkeypatch.setattr(SC, "JOIN_ROWS", 40)
    fills, markets = X.fills(spark, sf), X.markets(spark, sf)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = P.cash_volume(P.normalize_trades(P.parse_trades(fills, markets)))
        plan = v._jdf.queryExecution().executedPlan().toString()
        got = rows(v)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert any("_salt" in line for line in dealt)
    assert any("market_slug" in line and "wallet" in line for line in dealt)
    assert got == rows(P.cash_volume(P.normalize_trades(P.parse_trades(fills, markets))))


def test_medians_of_all_measures_travel_as_one_list(spark):
    """NULLs are skipped, NaN is largest, a NULL wallet is a group; values of a row are collected once, not once per measure."""
    nan = float("nan")
    data = [("m1", "a", 1.0, None), ("m1", "a", 4.0, None), ("m1", "a", None, None), ("m1", None, nan, 2.0),
            ("m1", None, 7.0, -3.0), ("m1", None, 5.0, 0.5), ("m2", "a", 9.0, 1.0), ("m2", "b", None, None)]
    t = spark.createDataFrame(data, "market_slug string, wallet string, v double, w double")
    med = {"mv": F.col("v"), "mw": F.when(F.col("w") > -1, F.col("w")), "half": F.col("v") / 2}
    got = B.with_medians(t, {"n": F.count("*")}, med, split=False, tasks=3)
    assert got.columns == ["market_slug", "wallet", "n", *med]
    expect = {("m1", "a"): (3, 2.5, None, 1.25), ("m1", None): (3, 7.0, 1.25, 3.5), ("m2", "a"): (1, 9.0, 1.0, 4.5), ("m2", "b"): (1, None, None, None)}
    assert {tuple(r)[:2]: tuple(r)[2:] for r in got.collect()} == expect
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
    none = B.with_medians(t.limit(0), {"n": F.count("*")}, med, split=False)
    assert none.collect() == []
