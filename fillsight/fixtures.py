"""Adapter from the generated test tables to the engine's inputs (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fillsight.schema import MARKET
from fillsight.session import configure

# Fixed values of the adapter.
EPOCH_2024 = 1_704_067_200
N_MARKETS = 8
N_WALLETS = 150


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


def base_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value",
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"),
        (F.col("event_id") % N_MARKETS).alias("mk"),
    )


def fills(spark: SparkSession, sf: str) -> DataFrame:
    return events_to_fills(base_events(spark, sf))


def events_to_fills(e: DataFrame) -> DataFrame:
    """One fill per event; works on batch and streaming frames alike."""
    slug = F.concat(F.lit("m"), F.col("mk"))
    base = (
        100 + F.abs((F.expr("ts div 600") + F.col("mk") * 37) % 1600 - 800) + (F.col("event_id") * 31) % 21 - 10
    )
    jumped = F.col("ts") >= EPOCH_2024 + 86_400 * (10 + 2 * F.col("mk"))
    e = e.select(
        "*",
        slug.alias(MARKET),
        F.when(jumped, 1000 - base).otherwise(base).alias("ypm"),
        (F.col("event_id") % 3 == 0).alias("is_no"),
        F.col("event_type").isin("purchase", "signup", "view").alias("maker_buys"),
        (F.round(F.col("value") * 100).cast("bigint") * 10_000).alias("token"),
    )
    price = F.when(F.col("is_no"), 1000 - F.col("ypm")).otherwise(F.col("ypm"))
    token_id = F.concat(F.col(MARKET), F.when(F.col("is_no"), F.lit("-N")).otherwise(F.lit("-Y")))
    e = e.select("*", (F.col("token") * price).alias("_cash1000"), token_id.alias("token_id"))
    e = e.select("*", F.expr("_cash1000 div 1000").alias("cash"))
    return e.select(
        F.concat(F.lit("e"), F.col("event_id")).alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("t"), F.expr("event_id div 2")).alias("transactionHash"),
        F.concat(F.lit("o"), F.col("event_id")).alias("orderHash"),
        F.concat(F.lit("w"), F.col("user_id")).alias("maker"),
        F.concat(F.lit("w"), (F.col("user_id") * 7 + F.col("event_id")) % N_WALLETS).alias("taker"),
        F.when(F.col("maker_buys"), F.lit("0")).otherwise(F.col("token_id")).alias("makerAssetId"),
        F.when(F.col("maker_buys"), F.col("token_id")).otherwise(F.lit("0")).alias("takerAssetId"),
        F.when(F.col("maker_buys"), F.col("cash")).otherwise(F.col("token")).alias("makerAmountFilled"),
        F.when(F.col("maker_buys"), F.col("token")).otherwise(F.col("cash")).alias("takerAmountFilled"),
        F.lit("0").alias("fee"),
        F.lit("maker").alias("query_side"),
        F.col("token_id").alias("queried_token_id"),
        MARKET,
    )


def markets(spark: SparkSession, sf: str) -> DataFrame:
    return (
        base_events(spark, sf)
        .groupBy("mk").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
        .select(
            F.concat(F.lit("m"), F.col("mk")).alias("slug"),
            F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"),
            F.array(F.concat(F.lit("m"), F.col("mk"), F.lit("-Y")), F.concat(F.lit("m"), F.col("mk"), F.lit("-N"))).alias(
                "token_ids"
            ),
            F.concat(F.lit("m"), F.col("mk"), F.lit("-Y")).alias("yes_token_id"),
            F.concat(F.lit("m"), F.col("mk"), F.lit("-N")).alias("no_token_id"),
            "start_ts", "end_ts",
            F.lit(True).alias("closed"),
            F.array((F.col("mk") % 2).cast("double"), (1 - F.col("mk") % 2).cast("double")).alias("outcome_prices"),
        )
    )


def activity(spark: SparkSession, sf: str) -> DataFrame:
    return base_events(spark, sf).select(
        F.concat(F.lit("w"), F.col("user_id")).alias("wallet"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "error", "REDEEM").otherwise("TRADE").alias("type"),
        F.concat(F.lit("m"), F.col("mk")).alias("slug"),
        F.when(F.col("event_type").isin("purchase", "signup"), "BUY").otherwise("SELL").alias("side"),
        F.col("value").alias("size"),
        F.lit(1.0).alias("price"),
        F.col("value").alias("usdcSize"),
        F.lit(0).alias("outcomeIndex"),
        F.concat(F.lit("t"), F.col("event_id")).alias("transactionHash"),
        F.lit("0").alias("asset"),
    )


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    """Funder -> wallet transfers, one row per order."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("f"), F.col("c_nationkey")).alias("from"),
        F.concat(F.lit("w"), F.col("o_custkey") % N_WALLETS).alias("to"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        F.concat(F.lit("x"), F.col("o_orderkey")).alias("tx_hash"),
        F.col("o_orderkey").alias("seq"),
    )


def incoming(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers into wallets that have deposits at all."""
    return transfers(spark, sf).filter(F.substring("to", 2, 20).cast("bigint") % 11 != 0)


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return (
        base_events(spark, sf).filter(F.col("user_id") % 17 == 0)
        .select(F.concat(F.lit("w"), F.col("user_id")).alias("wallet")).distinct()
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, label, score with many ties."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    doc = table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 97) / 97.0).alias("score"), "source")
    return lab.join(doc, "doc_id")
