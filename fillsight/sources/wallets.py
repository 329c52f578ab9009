"""Wallet activity, deposits and funder transfers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fillsight.schema import DEPOSIT, TRANSFERS, number


def scan_activity(activity: DataFrame, types: Sequence[str] = ("TRADE", "REDEEM"), newest: int | None = None) -> DataFrame:
    """Activity of the given types with numeric fields coerced; rows without time are dropped.

    ``newest`` keeps that many rows per wallet, as a source with a row limit would.
    """
    a = activity.filter(F.col("type").isin(*types)).select(
        F.lower("wallet").alias("wallet"), number("timestamp", "bigint").alias("timestamp"), "type", "slug",
        F.upper(F.coalesce("side", F.lit(""))).alias("side"), number("size").alias("size"), number("price").alias("price"),
        number("usdcSize").alias("usdcSize"), "outcomeIndex", "transactionHash", "asset",
    ).dropna(subset=["timestamp"])
    if newest is None:
        return a
    w = W.partitionBy("wallet").orderBy(F.col("timestamp").desc(), F.col("transactionHash").desc())
    return a.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= newest).drop("_rn")


def first_deposits(transfers: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Earliest incoming transfer per wallet."""
    first = F.min_by(F.struct("from", "ts", "tx_hash"), F.struct(*order)).alias("d")
    return transfers.groupBy(F.lower("to").alias("wallet")).agg(first).select(
        "wallet", F.lower("d.from").alias("funder"), F.col("d.ts").alias("first_deposit_ts"), F.col("d.tx_hash").alias("tx_hash")
    )


def read_deposits(spark: SparkSession, glob: str) -> DataFrame:
    """Deposit documents, one file per wallet; an empty object gives NULL fields."""
    d = spark.read.schema(DEPOSIT).option("multiLine", True).json(glob)
    return d.select(
        F.regexp_extract(F.input_file_name(), r"deposit_([^/]+)\.json$", 1).alias("wallet"),
        F.col("from").alias("funder"), F.col("timestamp").alias("first_deposit_ts"), "tx_hash",
    )


def read_transfers(spark: SparkSession, glob: str) -> DataFrame:
    """Transfer documents, one file per funder, as one row per recipient."""
    d = spark.read.schema(TRANSFERS).option("multiLine", True).json(glob)
    return d.select(
        F.regexp_extract(F.input_file_name(), r"funder_([^/]+)\.json$", 1).alias("funder"),
        F.coalesce("hit_cap", F.lit(False)).alias("hit_cap"), F.inline_outer("transfers"),
    )
