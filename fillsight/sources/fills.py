"""Fill-event scans and source mappings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fillsight.schema import MARKET, number

PLACEHOLDER_WALLET = "0x" + "0" * 40


def scan_fills(
    fills: DataFrame, tokens: Sequence[str], start: int | None = None, end: int | None = None, side: str = "any"
) -> DataFrame:
    """Fills of a closed time range touching the given tokens; all predicates reach the scan."""
    if start is not None:
        fills = fills.filter(F.col("timestamp") >= start)
    if end is not None:
        fills = fills.filter(F.col("timestamp") <= end)
    maker, taker = F.col("makerAssetId").isin(*tokens), F.col("takerAssetId").isin(*tokens)
    cond = {"maker": maker, "taker": taker, "any": maker | taker}[side]
    return fills.filter(cond)


def tagged_fills(fills: DataFrame, markets: DataFrame) -> DataFrame:
    """Fills once per outcome token and side they touch, tagged with that side and token.

    One scan emits both legs; a fill of two known tokens appears twice.
    """
    dim = markets.select(F.col("slug").alias(MARKET), "token_ids")
    legs = F.array(
        F.struct(F.lit("maker").alias("query_side"), F.col("makerAssetId").alias("queried_token_id")),
        F.struct(F.lit("taker").alias("query_side"), F.col("takerAssetId").alias("queried_token_id")),
    )
    base = fills.drop("query_side", "queried_token_id").join(dim, MARKET)
    return (
        base.select("*", F.inline(legs))
        .filter(F.array_contains("token_ids", F.col("queried_token_id")))
        .drop("token_ids")
    )


def secondary_to_fills(rows: DataFrame) -> DataFrame:
    """User-trade records (proxyWallet, side, asset, size, price, …) in the fill schema.

    Only the user's leg is known: the user becomes the taker, the maker a placeholder.
    Amounts round half to even.
    """
    token = F.rint(number("size") * 1_000_000).cast("bigint")
    cash = F.rint(number("size") * number("price") * 1_000_000).cast("bigint")
    buy = F.upper("side") == "BUY"
    ts = F.col("timestamp").cast("bigint")
    zero = F.lit("0")
    return rows.select(
        F.concat_ws("_", "transactionHash", F.substring("asset", 1, 16), ts.cast("string")).alias("id"),
        ts.alias("timestamp"), "transactionHash", F.lit("").alias("orderHash"),
        F.lit(PLACEHOLDER_WALLET).alias("maker"), F.lower("proxyWallet").alias("taker"),
        F.when(buy, F.col("asset")).otherwise(zero).alias("makerAssetId"),
        F.when(buy, zero).otherwise(F.col("asset")).alias("takerAssetId"),
        F.when(buy, token).otherwise(cash).alias("makerAmountFilled"),
        F.when(buy, cash).otherwise(token).alias("takerAmountFilled"),
        zero.alias("fee"), F.lit("taker").alias("query_side"), F.col("asset").alias("queried_token_id"),
        *[c for c in (MARKET,) if c in rows.columns],
    )


def with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary fills, and all secondary ones of markets the primary lacks."""
    missing = secondary.join(primary.select(MARKET).distinct(), MARKET, "left_anti")
    return primary.unionByName(missing, allowMissingColumns=True)
