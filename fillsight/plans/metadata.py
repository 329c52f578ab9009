"""Leakage-safe wallet metadata per (wallet, market) pair.

Everything "as of the first trade" is a running value of the wallet's own timeline:
the number of markets, squared market volumes, winning markets and squared profits
all change by known amounts with each activity row. They are summed along time once
per wallet and read at each pair's as-of time by an as-of lookup, so a wallet with
many markets and much activity costs its activity plus its pairs, not their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fillsight.operators.asof import build_index, lookup
from fillsight.operators.scan import MAX_GROUP_ROWS, percentiles, plan_cells, scan
from fillsight.schema import MARKET, MICRO, ratio
from fillsight.session import materialize
from fillsight.sources.wallets import scan_activity

METADATA_COLUMNS = (
    "n_markets_traded", "wallet_age_seconds", "market_age_seconds", "wallet_to_market_age_ratio",
    "wallet_minus_market_age_seconds", "winrate", "avg_bet_size_usdc", "median_bet_size_usdc", "total_bet_size_usdc",
    "n_wallets_same_funder", "n_other_wallets_same_funder", "herfindahl_index_markets", "is_first_market",
    "time_since_first_deposit_to_first_trade_seconds", "lifetime_volume_share_on_market", "pnl_sharpe",
    "funder_flagged_wallet_count",
)
RUNNING = ("n_trade_markets", "n_markets", "n_winning", "vol", "vol_sq", "pnl", "pnl_sq")


def _micro(c: str = "usdcSize") -> Column:
    return F.round(F.coalesce(F.col(c), F.lit(0.0)) * MICRO).cast("bigint")


def signed_cash() -> Column:
    """Net cash flow of an activity row: sales and payouts in, purchases out, other trades zero."""
    trade = F.col("type") == "TRADE"
    return (
        F.when(trade & (F.col("side") == "BUY"), -_micro())
        .when(trade & (F.col("side") != "SELL"), F.lit(0).cast("bigint"))
        .otherwise(_micro())
    )


def market_pnl(activity: DataFrame) -> DataFrame:
    """Net cash profit per (wallet, market)."""
    a = scan_activity(activity)
    return a.groupBy("wallet", F.col("slug").alias(MARKET)).agg((F.sum(signed_cash()) / MICRO).alias("pnl"))


def first_trades(trades: DataFrame) -> DataFrame:
    """As-of time of each pair: its wallet's first trade on the market."""
    return trades.groupBy("wallet", MARKET).agg(F.min("ts").alias("as_of_ts"))


def wallet_timeline(activity: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Running wallet state, one row per (wallet, second with activity on a known market).

    Activity without a slug belongs to no market and adds to none of these values.
    """
    a = scan_activity(activity).filter(F.col("slug").isNotNull())
    trade = F.col("type") == "TRADE"
    steps = a.groupBy("wallet", "slug", F.col("timestamp").alias("ts")).agg(
        F.sum(F.when(trade, _micro()).otherwise(0)).alias("v"), F.sum(signed_cash()).alias("p"),
        F.count_if(trade).alias("k"),
    )
    pair_cells = plan_cells(steps, ["wallet", "slug"], "ts", max_rows=max_rows)
    s = scan(
        pair_cells.label(steps, "ts"), ["wallet", "slug"], ["ts"],
        running={
            "vc": ("sum", F.col("v")), "pc": ("sum", F.col("p")), "kc": ("sum", F.col("k")), "rc": ("count", F.lit(1)),
        },
        cells=pair_cells,
    )
    sq = lambda c: (c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)")
    before_p, before_v = F.col("pc") - F.col("p"), F.col("vc") - F.col("v")
    won = lambda c: (c > 0).cast("int")
    per_second = s.groupBy("wallet", "ts").agg(
        F.count_if((F.col("k") > 0) & (F.col("kc") == F.col("k"))).alias("n_trade_markets"),
        F.count_if(F.col("rc") == 1).alias("n_markets"),
        F.sum(won(F.col("pc")) - won(before_p)).alias("n_winning"),
        F.sum("v").alias("vol"), F.sum(sq(F.col("vc")) - sq(before_v)).alias("vol_sq"),
        F.sum("p").alias("pnl"), F.sum(sq(F.col("pc")) - sq(before_p)).alias("pnl_sq"),
    )
    cells = plan_cells(per_second, ["wallet"], "ts", max_rows=max_rows)
    return scan(
        cells.label(per_second, "ts"), ["wallet"], ["ts"],
        running={f"{c}_upto": ("sum", F.col(c)) for c in RUNNING}, cells=cells,
    ).select("wallet", "ts", *[F.col(f"{c}_upto").alias(c) for c in RUNNING])


def wallet_sizes(activity: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Lifetime bet sizes per wallet: mean, exact median, total; lifetime_micro is that of known markets."""
    a = scan_activity(activity, ("TRADE",)).filter(F.col("usdcSize").isNotNull())
    known = F.when(F.col("slug").isNotNull(), _micro()).otherwise(0)
    g = a.groupBy("wallet").agg(F.sum(_micro()).alias("t"), F.sum(known).alias("lifetime_micro"), F.count("*").alias("n"))
    hot = not g.filter(F.col("n") > max_rows).isEmpty()
    med = percentiles(a, ["wallet"], "usdcSize", {"median_bet_size_usdc": 0.5}, split=hot)
    return g.join(med, "wallet", "left").select(
        "wallet", (F.col("t") / MICRO).alias("total_bet_size_usdc"), (F.col("t") / F.col("n") / MICRO).alias("avg_bet_size_usdc"),
        "median_bet_size_usdc", "lifetime_micro",
    )


def funder_timeline(transfers: DataFrame, flagged: DataFrame, cap: int = 1000, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Running counts of distinct recipients (and flagged ones) per funder.

    ``transfers`` is one row per transfer (from, to, ts), or what ``read_transfers`` gives
    (funder, to, ts, hit_cap). ``over_cap`` marks funders with more than ``cap`` recipients over
    all time; their counts are exact like all others. ``hit_cap`` marks funders whose stored
    list was cut at its source, so that no count of it is right.
    """
    funder = F.lower(F.col("from" if "from" in transfers.columns else "funder"))
    cut = F.col("hit_cap") if "hit_cap" in transfers.columns else F.lit(False)
    rows = transfers.select(funder.alias("funder"), F.lower("to").alias("to"), "ts", F.coalesce(cut, F.lit(False)).alias("hit_cap"))
    first = rows.filter((F.col("to") != "") & F.col("ts").isNotNull()).groupBy("funder", "to").agg(F.min("ts").alias("ts"))
    marked = first.join(flagged.select(F.lower("wallet").alias("to"), F.lit(1).alias("hit")).distinct(), "to", "left")
    per_second = marked.groupBy("funder", "ts").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("f"))
    cells = plan_cells(per_second, ["funder"], "ts", max_rows=max_rows)
    run = scan(
        cells.label(per_second, "ts"), ["funder"], ["ts"],
        running={"n_recipients": ("sum", F.col("n")), "n_flagged": ("sum", F.col("f"))}, cells=cells,
    ).select("funder", "ts", "n_recipients", "n_flagged")
    total = per_second.groupBy("funder").agg((F.sum("n") > cap).alias("over_cap"))
    cuts = rows.groupBy("funder").agg(F.max("hit_cap").alias("hit_cap"))
    # a funder whose list is empty still has its marks
    return cuts.join(total, "funder", "left").join(run, "funder", "left").withColumn("over_cap", F.coalesce("over_cap", F.lit(False)))


def siblings_asof(points: DataFrame, timeline: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Recipients of ``funder`` up to ``as_of_ts`` for each point, and whether the funder is over the cap.

    Counts are NULL only for funders whose stored list was cut.
    """
    steps = timeline.filter(F.col("ts").isNotNull())
    sides = steps.select("funder", "ts").unionByName(points.select("funder", F.col("as_of_ts").alias("ts")))
    cells = plan_cells(sides, ["funder"], "ts", max_rows=max_rows)
    index = build_index(steps, ["funder"], "ts", ["n_recipients", "n_flagged"], cells=cells)
    marks = timeline.groupBy("funder").agg(F.max("over_cap").alias("over_cap"), F.max("hit_cap").alias("hit_cap"))
    got = lookup(points, index, ["funder"], "as_of_ts", "h", cells).join(marks, "funder", "left")
    seen = lambda c: F.when(~F.coalesce("hit_cap", F.lit(False)), F.coalesce(F.col(f"h.cur.hi.{c}"), F.lit(0)))
    return got.select(
        *points.columns, seen("n_recipients").alias("n_siblings"), seen("n_flagged").alias("n_flagged_siblings"),
        F.coalesce("over_cap", F.lit(False)).alias("over_cap"),
    )


def metadata_features(
    pairs: DataFrame, activity: DataFrame, markets: DataFrame, deposits: DataFrame, transfers: DataFrame,
    flagged: DataFrame, cap: int = 1000, max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """The 17 metadata features of every pair, plus as_of_ts, funder, first_deposit_ts, funder_over_cap and error.

    Recipient counts are exact at any size; ``funder_over_cap`` marks funders with more than
    ``cap`` of them, for a model that must not see such counts (see ``blank_over_cap``).

    ``pairs`` may carry as_of_ts; where it is missing the first TRADE of the wallet's
    activity on the market stands in. Pairs without either keep their keys, NULL
    features and an error text.
    """
    acts = scan_activity(activity)
    life = acts.filter(F.col("type") == "TRADE").groupBy("wallet", F.col("slug").alias(MARKET)).agg(
        F.min("timestamp").alias("first_trade_ts"), F.sum(_micro()).alias("market_micro")
    )
    p = pairs.withColumn("wallet", F.lower("wallet"))
    if "as_of_ts" not in p.columns:
        p = p.withColumn("as_of_ts", F.lit(None).cast("bigint"))
    p = p.join(life, ["wallet", MARKET], "left").withColumn("as_of_ts", F.coalesce("as_of_ts", "first_trade_ts"))
    starts = markets.select(F.col("slug").alias(MARKET), F.col("start_ts"))
    p = p.join(starts, MARKET, "left").join(deposits.select("wallet", "funder", "first_deposit_ts"), "wallet", "left")
    p = p.join(wallet_sizes(activity, max_rows), "wallet", "left")
    failed = p.filter(F.col("as_of_ts").isNull())
    ready = p.filter(F.col("as_of_ts").isNotNull())

    # written once: planning, the index and its first points all read it
    timeline = materialize(wallet_timeline(activity, max_rows))
    ready = materialize(ready)
    sides = timeline.select("wallet", "ts").unionByName(ready.select("wallet", F.col("as_of_ts").alias("ts")))
    cells = plan_cells(sides, ["wallet"], "ts", max_rows=max_rows)
    index = build_index(timeline, ["wallet"], "ts", list(RUNNING), cells=cells)
    seen = lookup(ready, index, ["wallet"], "as_of_ts", "h", cells)
    at = lambda c: F.coalesce(F.col(f"h.cur.hi.{c}"), F.lit(0))
    seen = seen.select(*ready.columns, *[at(c).alias(f"r_{c}") for c in RUNNING])

    funded = seen.filter(F.col("funder").isNotNull())
    tl = materialize(funder_timeline(transfers, flagged, cap, max_rows))
    funded = siblings_asof(funded, tl, max_rows)
    rest = seen.filter(F.col("funder").isNull())
    x = funded.unionByName(rest, allowMissingColumns=True)

    n, P = F.col("r_n_markets"), F.col("r_pnl")
    spread = n * F.col("r_pnl_sq") - (P.cast("decimal(19,0)") * P.cast("decimal(19,0)"))
    age = F.col("as_of_ts") - F.col("first_deposit_ts")
    market_age = F.col("as_of_ts") - F.col("start_ts")
    dbl = lambda c: c.cast("double")
    here = F.coalesce(F.col("first_trade_ts") <= F.col("as_of_ts"), F.lit(False))
    vol = dbl(F.col("r_vol"))
    zero = F.lit(0.0)
    feats = {
        "n_markets_traded": dbl(F.col("r_n_trade_markets")),
        "wallet_age_seconds": dbl(age),
        "market_age_seconds": dbl(market_age),
        "wallet_to_market_age_ratio": ratio(age, F.greatest(market_age, F.lit(1))),
        "wallet_minus_market_age_seconds": dbl(age - market_age),
        "winrate": F.when(n > 0, ratio(F.col("r_n_winning"), n)),
        "avg_bet_size_usdc": F.coalesce("avg_bet_size_usdc", zero),
        "median_bet_size_usdc": F.coalesce("median_bet_size_usdc", zero),
        "total_bet_size_usdc": F.coalesce("total_bet_size_usdc", zero),
        "n_wallets_same_funder": dbl(F.col("n_siblings")),
        "n_other_wallets_same_funder": F.when(F.col("n_siblings").isNotNull(), dbl(F.greatest(F.col("n_siblings") - 1, F.lit(0)))),
        "herfindahl_index_markets": F.when(vol > 0, ratio(F.col("r_vol_sq"), vol * vol)).otherwise(zero),
        "is_first_market": dbl(((F.col("r_n_trade_markets") == 1) & here).cast("int")),
        "time_since_first_deposit_to_first_trade_seconds": dbl(age),
        "lifetime_volume_share_on_market": F.coalesce(ratio(F.coalesce("market_micro", F.lit(0)), F.col("lifetime_micro")), zero),
        "pnl_sharpe": F.when((n >= 2) & (spread > 0), dbl(P) / F.sqrt(dbl(spread))),
        "funder_flagged_wallet_count": dbl(F.col("n_flagged_siblings")),
    }
    ok = x.select(
        "wallet", MARKET, "as_of_ts", "funder", "first_deposit_ts", F.col("over_cap").alias("funder_over_cap"), F.lit(None).cast("string").alias("error"),
        *[feats[c].alias(c) for c in METADATA_COLUMNS],
    )
    bad = failed.select("wallet", MARKET, F.lit("no TRADE activity on market").alias("error"))
    return ok.unionByName(bad, allowMissingColumns=True)


def blank_over_cap(features: DataFrame) -> DataFrame:
    """Features as a model sees them: recipient counts of funders over the cap are NULL."""
    over = F.coalesce("funder_over_cap", F.lit(False))
    counts = ("n_wallets_same_funder", "n_other_wallets_same_funder", "funder_flagged_wallet_count")
    return features.withColumns({c: F.when(~over, F.col(c)) for c in counts})
