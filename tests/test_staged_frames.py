"""What the behavioural jobs write: one row per fill, a ledger of what cannot be derived, top wallets once; models side by side."""

import threading

import pytest
from pyspark.sql import functions as F

from fillsight import fixtures as X
from fillsight.ml import train as TR
from fillsight.plans import behavior as PB, jobs as J
from fillsight.plans.behavior import Behavior
from fillsight.schema import MARKET
from tests.conftest import rows


def events(spark, n=400):
    i = F.col("id")
    kinds = F.array(*[F.lit(k) for k in ("purchase", "view", "click", "error")])
    return spark.range(n).select(
        i.alias("event_id"), (i * 7 % 13).alias("user_id"), F.element_at(kinds, (i * 5 % 4 + 1).cast("int")).alias("event_type"),
        (1 + i * 37 % 91 / 10).alias("value"), (X.EPOCH_2024 + i * 977 % 200_000).alias("ts"), (i % 8).alias("mk"))


def sources(spark):
    e = events(spark)
    m = e.groupBy("mk").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    slug = F.concat(F.lit("m"), "mk")
    yes, no = F.concat(slug, F.lit("-Y")), F.concat(slug, F.lit("-N"))
    markets = m.select(
        slug.alias("slug"), F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"), F.array(yes, no).alias("token_ids"), yes.alias("yes_token_id"),
        no.alias("no_token_id"), "start_ts", "end_ts", F.lit(True).alias("closed"), F.array(F.lit(1.0), F.lit(0.0)).alias("outcome_prices"))
    f = X.events_to_fills(e)
    return f.unionByName(f.filter("timestamp % 3 = 0")), markets  # some fills come twice


@pytest.fixture
def kept(monkeypatch):
    written, write = [], PB.materialize

    def record(df):
        out = write(df)
        written.append(out)
        return out

    monkeypatch.setattr(PB, "materialize", record)
    return written


@pytest.mark.parametrize("max_rows", [2_000_000, 2])
def test_ledger_and_trades_are_written_slim(spark, kept, max_rows):
    fills, markets = sources(spark)
    staged, lazy = (Behavior(fills, markets, max_group_rows=max_rows, stage=s) for s in (True, False))
    assert staged.split == (max_rows == 2)
    assert staged.ledger.columns == lazy.ledger.columns and rows(staged.ledger) == rows(lazy.ledger)
    assert staged.trades.columns == lazy.trades.columns and rows(staged.trades) == rows(lazy.trades)
    classified, ledger = kept
    assert classified.count() == 400 and staged.trades.count() == 800
    derived = {"role", "norm_side", "signed_micro", "inventory", "inventory_before", "unit_hi", "open_from", "opened"}
    assert not derived & set(ledger.columns) and derived <= set(staged.ledger.columns)


def test_top_wallets_are_counted_once(spark, kept):
    fills, markets = sources(spark)
    b = Behavior(fills, markets)
    got = J.candidate_features(b, ["gross_tokens", "n_distinct_active_days"], 3)
    assert got.count() == 24 and got.groupBy(MARKET).count().filter("count <> 3").isEmpty()
    assert [d.count() for d in kept if "volume" in d.columns] == [24]


def test_models_are_trained_side_by_side(spark, monkeypatch):
    seen, together = [], threading.Barrier(3, timeout=60)

    def train(df, spec):
        together.wait()  # breaks unless all three run at once
        seen.append(threading.get_ident())
        return spec.estimator

    monkeypatch.setattr(TR, "train", train)
    specs = {n: TR.TrainSpec(("x",), estimator=n) for n in ("forest", "boosting", "logistic")}
    assert TR.train_all(spark.range(1), specs) == {n: n for n in specs} and len(set(seen)) == 3
