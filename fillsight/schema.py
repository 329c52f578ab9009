"""Explicit schemas of the engine's inputs and the names shared by all modules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

MARKET = "market_slug"
WALLET = "wallet"
MARKET_WALLET = (MARKET, WALLET)

# Total order of trades inside one (market, wallet): maker leg before taker leg.
TRADE_ORDER = ("ts", "trade_id", "role_no")

MICRO = 1_000_000

FILLS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("transactionHash", T.StringType()),
    T.StructField("orderHash", T.StringType()),
    T.StructField("maker", T.StringType()),
    T.StructField("taker", T.StringType()),
    T.StructField("makerAssetId", T.StringType()),
    T.StructField("takerAssetId", T.StringType()),
    T.StructField("makerAmountFilled", T.LongType()),
    T.StructField("takerAmountFilled", T.LongType()),
    T.StructField("fee", T.StringType()),
    T.StructField("query_side", T.StringType()),
    T.StructField("queried_token_id", T.StringType()),
    T.StructField(MARKET, T.StringType()),
])

MARKETS = T.StructType([
    T.StructField("slug", T.StringType()),
    T.StructField("outcomes", T.ArrayType(T.StringType())),
    T.StructField("token_ids", T.ArrayType(T.StringType())),
    T.StructField("yes_token_id", T.StringType()),
    T.StructField("no_token_id", T.StringType()),
    T.StructField("start_ts", T.LongType()),
    T.StructField("end_ts", T.LongType()),
    T.StructField("closed", T.BooleanType()),
    T.StructField("outcome_prices", T.ArrayType(T.DoubleType())),
])

ACTIVITY = T.StructType([
    T.StructField("wallet", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("slug", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("size", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("usdcSize", T.DoubleType()),
    T.StructField("outcomeIndex", T.IntegerType()),
    T.StructField("transactionHash", T.StringType()),
    T.StructField("asset", T.StringType()),
])

DEPOSIT = T.StructType([
    T.StructField("from", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("tx_hash", T.StringType()),
])

TRANSFERS = T.StructType([
    T.StructField("transfers", T.ArrayType(T.StructType([
        T.StructField("to", T.StringType()),
        T.StructField("ts", T.LongType()),
    ]))),
    T.StructField("hit_cap", T.BooleanType()),
])


def number(col: str | Column, kind: str = "double") -> Column:
    """Numeric coercion: unparsable text and NaN both become NULL."""
    c = F.col(col) if isinstance(col, str) else col
    out = c.try_cast(kind)
    return F.when(~F.isnan(out), out) if kind in ("double", "float") else out


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where den is NULL or zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def require(df, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
