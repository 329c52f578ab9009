"""What the behavioural vector moves: a series once for all lookups, no trade by market alone, no shuffle file after a table is written."""

import pytest
from pyspark.sql import functions as F

from fillsight.operators import history as H
from fillsight.plans.behavior import FAMILIES, Behavior
from fillsight.schema import MARKET
from fillsight.session import DROP_SHUFFLES, materialize
from tests.conftest import rows
from tests.test_staged_frames import sources


def series(spark, unique):
    """Two markets of uneven steps, some prices unknown, and one of a single row."""
    i = F.col("id")
    h = spark.range(240).select(
        "id", F.when(i == 0, "m9").when(i % 3 == 0, "m1").otherwise("m2").alias(MARKET), F.concat(F.lit("t"), i).alias("trade_id"),
        (1_700_000_000 + i * i * 13 + i % 5).alias("ts"), F.when(i % 11 > 0, ((i * 7919) % 1000) / 1000).alias("yes_price"))
    if not unique:
        h = h.withColumn("ts", F.when(i % 17 > 0, F.expr("ts div 900 * 900")))
    return materialize(h.withColumn("ts", F.when(i != 41, F.col("ts"))))  # some times are unknown too


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("deal", [4_000_000, 50])
def test_one_pass_over_a_series_gives_the_scans_lookups(spark, monkeypatch, unique, deal):
    monkeypatch.setattr(H, "DEAL_ROWS", deal)
    h = series(spark, unique)
    at = F.explode(F.array(F.col("ts"), F.col("ts"), F.col("ts") - 700, F.col("ts") + 90_000))
    seconds = materialize(h.select(MARKET, at.alias("ts")).union(spark.sql("select 'none', 5L union all select 'm1', null")))
    facts = materialize(H.series_facts(h))
    got = H.series_lookups(seconds, h, facts, unique=unique)
    want = H.second_lookups(seconds, h, facts).join(H.trailing_stats(seconds, h), [MARKET, "ts"])
    assert got.columns == want.columns and rows(got) == rows(want)
    trail = H.series_lookups(seconds, h, facts, grid=False, fixed=False, unique=unique)
    assert rows(trail) == rows(H.trailing_stats(seconds, h))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan and "Window" not in plan


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("up", [True, False])
def test_first_major_move_of_arrays(spark, unique, up):
    h = series(spark, unique)
    assert rows(H.first_major_move(h, 3600, 0.4, up, unique)) == rows(H.detect_major_move(h, 3600, 0.4, up))


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("\n").splitlines() if "/shuffle_" in f}
    before, setting = shuffled(), spark.conf.get(DROP_SHUFFLES, None)
    t = materialize(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count())
    assert not shuffled() - before and spark.conf.get(DROP_SHUFFLES, None) == setting
    assert t.count() == 97 and t.agg(F.sum("count")).first()[0] == 10_000


def test_trades_are_not_moved_by_market(spark):
    """Facts and the result of the medians meet their rows where these are; the vector holds what its families give alone."""
    b = Behavior(*sources(spark))
    vector = b.features()
    plan = vector._jdf.queryExecution().executedPlan().toString()
    moved = [line.split("Exchange ")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    trades = [m for m in moved if m.startswith("hashpartitioning(market_slug") and "REPARTITION_BY_NUM" in m]
    assert len(trades) == 1 and not any("_salt" in m for m in moved)
    above = plan[:plan.index("REPARTITION_BY_NUM")].splitlines()[:-1]
    assert any("ArrowEvalPython" in line for line in above) and not any("Exchange hashpartitioning(" in line for line in above)
    for family in ("grid", "fixed", "holding", "adaptive", "major"):
        alone = b.family(family)
        assert rows(vector.select(*alone.columns).distinct()) == rows(alone.distinct()), family
    assert set(vector.columns) == {MARKET, "wallet", *[c for f in FAMILIES.values() for c in f]}
