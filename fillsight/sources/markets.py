"""Market dimension from raw market documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fillsight.functions.scalar import price_list, text_list, unix_seconds


def parse_markets(raw: DataFrame, now_ts: int, keep: Sequence[str] = ()) -> DataFrame:
    """Typed market rows. ``now_ts`` ends markets that are still open, ``keep`` columns stay as they are.

    Raw columns: slug, outcomes, clobTokenIds, acceptingOrdersTimestamp, startDate,
    closed, closedTime, outcomePrices (text). A market with no start date at all
    fails the job.
    """
    start = F.coalesce(
        F.when(F.col("acceptingOrdersTimestamp") != "", F.col("acceptingOrdersTimestamp")), F.col("startDate")
    )
    closed = F.lower(F.coalesce(F.col("closed").cast("string"), F.lit(""))) == "true"
    no_start = F.raise_error(F.concat(F.lit("no start time: "), F.col("slug"))).cast("bigint")
    m = raw.select(
        "slug",
        text_list(F.col("outcomes")).alias("outcomes"),
        text_list(F.col("clobTokenIds")).alias("token_ids"),
        F.when(start.isNull(), no_start).otherwise(unix_seconds(start)).alias("start_ts"),
        F.when(closed, unix_seconds(F.col("closedTime"))).otherwise(F.lit(now_ts).cast("bigint")).alias("end_ts"),
        closed.alias("closed"),
        price_list(F.col("outcomePrices")).alias("outcome_prices"), *keep,
    )
    token = lambda i: F.try_element_at("token_ids", F.lit(i))
    return m.select("*", token(1).alias("yes_token_id"), token(2).alias("no_token_id"))


def token_dimension(markets: DataFrame) -> DataFrame:
    """token id -> market and outcome, for fills that arrive without their market."""
    pos = markets.select(F.col("slug").alias("market_slug"), F.posexplode("token_ids").alias("i", "token_id"), "outcomes")
    return pos.select("market_slug", "token_id", F.try_element_at("outcomes", F.col("i") + 1).alias("outcome"))


def attach_market(fills: DataFrame, markets: DataFrame) -> DataFrame:
    """Add ``market_slug`` to raw fills through their non-cash asset."""
    dim = token_dimension(markets).select("market_slug", "token_id")
    key = F.when(F.col("makerAssetId") != "0", F.col("makerAssetId")).otherwise(F.col("takerAssetId"))
    return fills.drop("market_slug").withColumn("_token", key).join(dim, F.col("_token") == F.col("token_id")).drop("_token", "token_id")


def wallet_markets(trades: DataFrame) -> DataFrame:
    """Distinct markets of each wallet, in order of first appearance."""
    return trades.groupBy("wallet", "market_slug").agg(
        F.min(F.struct("ts", "trade_id")).alias("_f"), F.count("*").alias("n_trades")
    ).select("wallet", "market_slug", F.col("_f.ts").alias("first_ts"), F.col("_f.trade_id").alias("first_trade_id"), "n_trades")
