"""Fills to trades, YES-normalized trades, price history and wallet summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fillsight.operators.scan import COUNT, heavy_keys, join_dimension
from fillsight.schema import MARKET, MARKET_WALLET, MICRO, number, ratio, require

CASH_ASSET = "0"

# Identity of a raw fill row including where it was read from.
PROVENANCE_KEY = (
    "id", "timestamp", "transactionHash", "orderHash", "maker", "taker", "makerAssetId", "takerAssetId",
    "makerAmountFilled", "takerAmountFilled", "query_side", "queried_token_id",
)
FILL_ORDER = ("timestamp", "transactionHash", "orderHash", "id")


def dedupe_fills(fills: DataFrame, mode: str = "id") -> DataFrame:
    """Drop repeated fills: by ``id``, or by the full key including provenance tags."""
    if mode == "id":
        return fills.dropDuplicates(["id"])
    if mode == "provenance":
        return fills.dropDuplicates(list(PROVENANCE_KEY))
    raise ValueError("mode must be 'id' or 'provenance'")


def order_fills(fills: DataFrame) -> DataFrame:
    """Total order (timestamp, transactionHash, orderHash, id) as one range-partitioned sort."""
    return fills.orderBy(*FILL_ORDER)


def heavy_markets(fills: DataFrame, rows_per_fill: int = 2) -> DataFrame | None:
    """Markets whose fills (two trades each) are dealt over several tasks where they meet their market's row."""
    return heavy_keys(fills.groupBy(MARKET).agg((rows_per_fill * F.count("*")).alias("n")), [MARKET])


def classify_fills(fills: DataFrame, markets: DataFrame, heavy: DataFrame | None | object = COUNT) -> DataFrame:
    """Give every fill its traded token and maker side; fills of unknown tokens drop out."""
    dim = markets.select(F.col("slug").alias(MARKET), "token_ids", "outcomes")
    f = join_dimension(fills, dim, MARKET, F.col("id"), heavy)
    maker_known = F.array_position("token_ids", F.col("makerAssetId"))
    taker_known = F.array_position("token_ids", F.col("takerAssetId"))
    f = f.withColumn("_mi", maker_known).withColumn("_ti", taker_known)
    maker_pays = (F.col("makerAssetId") == CASH_ASSET) & (F.col("_ti") > 0)
    taker_pays = (F.col("takerAssetId") == CASH_ASSET) & (F.col("_mi") > 0)
    buys = (
        F.when(maker_pays, True).when(taker_pays, False).when(F.col("_mi") > 0, False).when(F.col("_ti") > 0, True)
    )
    f = f.withColumn("maker_buys", buys).filter(F.col("maker_buys").isNotNull())
    pos = F.when(F.col("maker_buys"), F.col("_ti")).otherwise(F.col("_mi")).cast("int")
    maker_amt, taker_amt = number("makerAmountFilled", "bigint"), number("takerAmountFilled", "bigint")
    return f.select(
        MARKET,
        F.col("id").alias("trade_id"),
        F.col("timestamp").cast("bigint").alias("ts"),
        "transactionHash", "orderHash",
        F.lower("maker").alias("maker"), F.lower("taker").alias("taker"),
        "makerAssetId", "takerAssetId", "fee", "maker_buys",
        F.element_at("outcomes", pos).alias("outcome"),
        F.element_at("token_ids", pos).alias("token_id"),
        F.when(F.col("maker_buys"), taker_amt).otherwise(maker_amt).alias("token_micro"),
        F.when(F.col("maker_buys"), maker_amt).otherwise(taker_amt).alias("cash_micro"),
    )


def parse_trades(fills: DataFrame, markets: DataFrame, heavy: DataFrame | None | object = COUNT) -> DataFrame:
    """Two trade rows per fill, one for the maker and one for the taker."""
    return trade_legs(classify_fills(fills, markets, heavy))


def trade_legs(c: DataFrame) -> DataFrame:
    """The trades of maker and taker of every classified fill."""
    side = lambda buys: F.when(buys, F.lit("BUY")).otherwise(F.lit("SELL"))
    legs = F.array(
        F.struct(
            F.col("maker").alias("wallet"), F.lit("maker").alias("role"), F.lit(0).alias("role_no"),
            side(F.col("maker_buys")).alias("side"), F.col("taker").alias("counterparty"),
        ),
        F.struct(
            F.col("taker").alias("wallet"), F.lit("taker").alias("role"), F.lit(1).alias("role_no"),
            side(~F.col("maker_buys")).alias("side"), F.col("maker").alias("counterparty"),
        ),
    )
    keep = [x for x in c.columns if x not in ("maker", "taker", "maker_buys")]
    return c.select(*keep, F.inline(legs)).select(
        "*",
        (F.col("token_micro") / MICRO).alias("token_amount"),
        (F.col("cash_micro") / MICRO).alias("cash_amount"),
    )


def _yes_axis(trades: DataFrame, is_yes: Column) -> DataFrame:
    buy = F.upper("side") == "BUY"
    price = ratio(F.col("cash_micro"), F.col("token_micro"))
    norm_buy = F.when(is_yes, buy).otherwise(~buy)
    return trades.select(
        "*",
        price.alias("price"),
        F.when(norm_buy, F.lit("BUY")).otherwise(F.lit("SELL")).alias("norm_side"),
        F.lit("Yes").alias("norm_outcome"),
        F.when(is_yes, price).otherwise(1 - price).alias("norm_price"),
        F.when(norm_buy, F.col("token_micro")).otherwise(-F.col("token_micro")).alias("signed_micro"),
    )


def invalid_trades(trades: DataFrame) -> DataFrame:
    """Rows the strict normalization refuses, with the reason (the quarantine)."""
    reason = (
        F.when(F.col("token_micro").isNull() | (F.col("token_micro") <= 0), "token_amount must be > 0")
        .when(~F.initcap("outcome").isin("Yes", "No"), "unexpected outcome")
        .when(~F.upper("side").isin("BUY", "SELL"), "unexpected side")
    )
    return trades.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def normalize_trades(trades: DataFrame, strict: str = "quarantine") -> DataFrame:
    """Trades on the YES axis: NO flips the side and mirrors the price.

    ``strict="raise"`` fails the job on the first invalid row, ``"quarantine"``
    leaves such rows to :func:`invalid_trades`.
    """
    valid = (
        F.coalesce(F.col("token_micro") > 0, F.lit(False))
        & F.initcap("outcome").isin("Yes", "No")
        & F.upper("side").isin("BUY", "SELL")
    )
    if strict == "raise":
        failed = F.raise_error(F.concat(F.lit("invalid trade "), F.col("trade_id"))).cast("boolean")
        trades = trades.filter(F.when(valid, F.lit(True)).otherwise(failed))
    else:
        trades = trades.filter(valid)
    return _yes_axis(trades, F.initcap("outcome") == "Yes")


def normalize_trades_tolerant(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Display form keyed by token id, then outcome text; unknown and empty trades are skipped."""
    dim = markets.select(F.col("slug").alias(MARKET), "yes_token_id", "no_token_id")
    t = join_dimension(trades.filter(F.col("token_micro") != 0), dim, MARKET, F.col("wallet"))
    text = F.lower(F.trim("outcome"))
    yes = (F.col("token_id") == F.col("yes_token_id")) | (text == "yes")
    no = (F.col("token_id") == F.coalesce(F.col("no_token_id"), F.lit(""))) | (text == "no")
    t = _yes_axis(t.filter(yes | no), yes)
    buy = F.col("norm_side") == "BUY"
    return t.select(
        MARKET, "wallet", "trade_id", "ts", "transactionHash", "orderHash",
        F.upper("side").alias("original_side"), F.col("outcome").alias("original_outcome"),
        "token_amount", "cash_amount",
        F.col("norm_price").alias("yes_trade_price"),
        F.when(buy, "BUY_YES").otherwise("SELL_YES").alias("yes_action"),
        F.when(buy, F.col("token_amount")).otherwise(-F.col("token_amount")).alias("signed_yes_qty"),
        "role",
    )


def wallet_trades(trades: DataFrame, wallets: DataFrame) -> DataFrame:
    """Trades of the requested wallets, matched without case; the requested spelling is kept."""
    want = wallets.select(F.col("wallet").alias("requested_wallet"), F.lower("wallet").alias("_w")).distinct()
    return trades.join(want, F.lower(trades["wallet"]) == F.col("_w")).drop("_w")


# ---------------------------------------------------------------- price history

HISTORY_COLUMNS = ("trade_id", "ts", "yes_price", "token_id", "token_amount", "cash_amount")


def price_history(
    fills: DataFrame,
    markets: DataFrame,
    same_timestamp: str | None = "last",
    convert_no_to_yes: bool = True,
    drop_duplicates: bool = True,
    heavy: DataFrame | None | object = COUNT,
) -> DataFrame:
    """YES-price series per market from cash-for-token fills.

    ``same_timestamp`` collapses fills of one second: last or first by trade id
    (per column, skipping NULLs), mean, or None to keep every row.
    """
    f = dedupe_fills(fills) if drop_duplicates else fills
    dim = markets.select(F.col("slug").alias(MARKET), "yes_token_id", "no_token_id")
    f = join_dimension(f, dim, MARKET, F.col("id"), heavy)
    outcome_token = lambda c: (F.col(c) == F.col("yes_token_id")) | (F.col(c) == F.col("no_token_id"))
    maker_pays = (F.col("makerAssetId") == CASH_ASSET) & outcome_token("takerAssetId")
    taker_pays = (F.col("takerAssetId") == CASH_ASSET) & outcome_token("makerAssetId")
    maker_amt, taker_amt = number("makerAmountFilled", "bigint"), number("takerAmountFilled", "bigint")
    f = f.select(
        MARKET, "yes_token_id",
        F.col("id").alias("trade_id"),
        F.col("timestamp").cast("bigint").alias("ts"),
        F.when(maker_pays, F.col("takerAssetId")).when(taker_pays, F.col("makerAssetId")).alias("token_id"),
        F.when(maker_pays, taker_amt).when(taker_pays, maker_amt).alias("token_micro"),
        F.when(maker_pays, maker_amt).when(taker_pays, taker_amt).alias("cash_micro"),
    ).filter(F.col("token_id").isNotNull() & (F.col("token_micro") != 0))
    is_yes = F.col("token_id") == F.col("yes_token_id")
    if not convert_no_to_yes:
        f = f.filter(is_yes)
    raw = ratio(F.col("cash_micro"), F.col("token_micro"))
    rows = f.select(
        MARKET, "trade_id", "ts",
        F.when(is_yes, raw).otherwise(1 - raw).alias("yes_price"),
        "token_id",
        (F.col("token_micro") / MICRO).alias("token_amount"),
        (F.col("cash_micro") / MICRO).alias("cash_amount"),
    )
    return collapse_same_timestamp(rows, same_timestamp)


def collapse_same_timestamp(rows: DataFrame, how: str | None) -> DataFrame:
    cols = [c for c in HISTORY_COLUMNS if c != "ts"]
    if how is None:
        return rows.select(MARKET, *HISTORY_COLUMNS)
    if how not in ("last", "first", "mean"):
        raise ValueError("same_timestamp must be one of 'last', 'first', 'mean', None")
    pick = F.min_by if how == "first" else F.max_by
    at = lambda c: pick(F.col(c), F.when(F.col(c).isNotNull(), F.col("trade_id"))).alias(c)
    aggs = [
        F.avg(c).alias(c) if how == "mean" and c in ("yes_price", "token_amount", "cash_amount") else at(c) for c in cols
    ]
    return rows.groupBy(MARKET, "ts").agg(*aggs).select(MARKET, *HISTORY_COLUMNS)


def prepare_history(history: DataFrame) -> DataFrame:
    """Required columns, numeric coercion and removal of incomplete rows."""
    require(history, ["ts", "yes_price"])
    return (
        history.withColumn("ts", number("ts", "bigint"))
        .withColumn("yes_price", number("yes_price"))
        .dropna(subset=["ts", "yes_price"])
    )


def market_volume(fills: DataFrame, markets: DataFrame, cash_assets: Sequence[str] | None = None) -> DataFrame:
    """Market-wide volume rows. Cash assets default to every asset that is no outcome token."""
    require(fills, ["timestamp", "makerAssetId", "takerAssetId", "makerAmountFilled", "takerAmountFilled"])
    dim = markets.select(F.col("slug").alias(MARKET), "yes_token_id", "no_token_id")
    f = fills.withColumn("_m", number("makerAmountFilled", "bigint")).withColumn("_t", number("takerAmountFilled", "bigint"))
    f = join_dimension(f.dropna(subset=["timestamp", "_m", "_t"]), dim, MARKET, F.col("id"))
    token = lambda c: F.coalesce(F.col(c).isin(F.col("yes_token_id"), F.col("no_token_id")), F.lit(False))
    cash = (lambda c: F.col(c).isin(*cash_assets)) if cash_assets is not None else (lambda c: ~token(c))
    gives = token("makerAssetId") & cash("takerAssetId")
    takes = cash("makerAssetId") & token("takerAssetId")
    f = f.filter(gives | takes).select(
        MARKET, F.col("timestamp").alias("ts"),
        F.when(gives, F.col("_t")).otherwise(F.col("_m")).alias("cash_micro"),
        F.when(gives, F.col("_m")).otherwise(F.col("_t")).alias("token_micro"),
        (F.when(gives, F.col("makerAssetId")).otherwise(F.col("takerAssetId")) == F.col("yes_token_id")).alias("_yes"),
    )
    raw = F.when(F.col("token_micro") > 0, ratio(F.col("cash_micro"), F.col("token_micro")))
    return f.select(
        MARKET, "ts",
        (F.col("cash_micro") / MICRO).alias("cash_amount"),
        (F.col("token_micro") / MICRO).alias("token_amount"),
        F.when(F.col("_yes"), "YES").otherwise("NO").alias("outcome"),
        F.when(F.col("_yes"), raw).otherwise(1 - raw).alias("yes_price"),
    )


# ------------------------------------------------------------- wallet summaries

def wallet_summary(trades: DataFrame, outcomes: Sequence[str] = ("Yes", "No"), by: Sequence[str] = MARKET_WALLET) -> DataFrame:
    """Counts and amounts per side and outcome, with totals, net and gross per outcome."""
    aggs, names = [], []
    for side in ("BUY", "SELL"):
        for o in outcomes:
            hit = (F.col("side") == side) & (F.col("outcome") == o)
            aggs += [
                F.count_if(hit).alias(f"{side}_{o}"),
                F.coalesce(F.sum(F.when(hit, F.col("token_micro"))), F.lit(0)).alias(f"{side}_{o}_micro"),
            ]
            names.append(f"{side}_{o}")
    g = trades.groupBy(*by).agg(F.count("*").alias("n_trades"), *aggs)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    amount = sum((F.col(f"{n}_micro") for n in names[1:]), F.col(f"{names[0]}_micro"))
    per_outcome = []
    for o in outcomes:
        buy, sell = F.col(f"BUY_{o}_micro"), F.col(f"SELL_{o}_micro")
        per_outcome += [((buy - sell) / MICRO).alias(f"net_{o}_amount"), ((buy + sell) / MICRO).alias(f"gross_{o}_amount")]
    return g.select(
        *by, "n_trades", *names,
        *[(F.col(f"{n}_micro") / MICRO).alias(f"{n}_amount") for n in names],
        total.alias("total_activity"), (amount / MICRO).alias("total_amount"), *per_outcome,
    )


def binary_summary(summary: DataFrame, first: str = "Yes", second: str = "No", by: Sequence[str] = MARKET_WALLET) -> DataFrame:
    """Two-outcome markets on one axis: selling the second outcome is buying the first."""
    c = F.col
    buy, sell = c(f"BUY_{first}") + c(f"SELL_{second}"), c(f"SELL_{first}") + c(f"BUY_{second}")
    buy_a = c(f"BUY_{first}_amount") + c(f"SELL_{second}_amount")
    sell_a = c(f"SELL_{first}_amount") + c(f"BUY_{second}_amount")
    return summary.select(
        *by, "n_trades",
        buy.alias(f"BUY_{first}_norm"), sell.alias(f"SELL_{first}_norm"),
        buy_a.alias(f"BUY_{first}_norm_amount"), sell_a.alias(f"SELL_{first}_norm_amount"),
        F.least(buy, sell).alias("min_side"), (buy + sell).alias("total_activity_norm"),
        F.least(buy_a, sell_a).alias("min_side_amount"), (buy_a + sell_a).alias("total_activity_norm_amount"),
        (buy_a - sell_a).alias("net_norm_amount"),
    )


# Ranking name -> descending sort keys; equal keys are broken by wallet.
RANKINGS = {
    "total": ["total_activity"],
    "total_amount": ["total_amount", "total_activity"],
    "abs_net_amount": ["abs_net_amount", "total_amount"],
    "min_norm": ["min_side", "total_activity_norm"],
    "total_norm": ["total_activity_norm", "min_side"],
    "total_norm_amount": ["total_activity_norm_amount", "total_activity_norm"],
    "abs_net_norm_amount": ["abs_net_norm_amount", "total_activity_norm_amount"],
}


def rank_wallets(summary: DataFrame, ranking: str, top: int, by: Sequence[str] = (MARKET,)) -> DataFrame:
    """The ``top`` wallets of one ranking per market; the filter becomes a group limit below the shuffle."""
    keys = RANKINGS[ranking]
    df = summary
    if "abs_net_amount" in keys:
        nets = [c for c in df.columns if c.startswith("net_") and c.endswith("_amount") and c != "net_norm_amount"]
        df = df.withColumn("abs_net_amount", F.round(sum((F.abs(c) for c in nets[1:]), F.abs(nets[0])), 6))
    if "abs_net_norm_amount" in keys:
        df = df.withColumn("abs_net_norm_amount", F.abs("net_norm_amount"))
    w = W.partitionBy(*by).orderBy(*[F.col(k).desc() for k in keys], F.col("wallet"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def cash_volume(trades: DataFrame, by: Sequence[str] = MARKET_WALLET) -> DataFrame:
    return trades.groupBy(*by).agg(
        F.sum("cash_micro").alias("volume_micro"), F.sum("token_micro").alias("tokens_micro"),
        F.count("*").alias("n_trades"), F.min("ts").alias("first_trade_ts"),
    )


def top_wallets(trades: DataFrame, n: int = 100, measure: str = "volume_micro") -> DataFrame:
    """Largest wallets per market by cash (or tokens); ``n=0`` keeps all."""
    vol = cash_volume(trades)
    w = W.partitionBy(MARKET).orderBy(F.col(measure).desc(), F.col("wallet"))
    if n == 0:
        return vol
    return vol.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def in_time_range(df: DataFrame, start: int | None, end: int | None, ts: str = "ts") -> DataFrame:
    """Closed time interval; a missing bound is open."""
    if start is not None:
        df = df.filter(F.col(ts) >= start)
    if end is not None:
        df = df.filter(F.col(ts) <= end)
    return df


def active_candidates(trades: DataFrame, min_trades: int, exclude: DataFrame) -> DataFrame:
    """Wallets with more than ``min_trades`` trades in a market, known ones excluded."""
    counts = trades.groupBy(*MARKET_WALLET).agg(F.count("*").alias("n_trades"))
    return counts.filter(F.col("n_trades") > min_trades).join(exclude.select("wallet"), "wallet", "left_anti")
