"""Landed JSON documents as VARIANT: markets, deposits and transfers.

A document keeps everything its source sent in ``raw``; the columns the engine needs are
taken out of it by path, with casts that give NULL instead of failing where a source changed
a type. Documents come one per file, named by their key, or one per line with a key column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fillsight.schema import MARKET
from fillsight.sources.markets import parse_markets

# Fields of a market document that the market dimension reads.
MARKET_FIELDS = ("slug", "outcomes", "clobTokenIds", "acceptingOrdersTimestamp", "startDate", "closed", "closedTime", "outcomePrices")


def read_documents(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key, body of one document per file; ``key`` is a pattern whose first group names the document."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), key, 1).alias("key"), F.col("value").alias("body"))


def with_raw(docs: DataFrame, body: str = "body") -> DataFrame:
    """Add ``raw``, the document as VARIANT; NULL where the text is no JSON."""
    return docs.withColumn("raw", F.try_parse_json(F.col(body))).drop(body)


def field(path: str, kind: str, raw: str | Column = "raw") -> Column:
    """A field of a document, NULL where it is missing or does not cast."""
    return F.try_variant_get(F.col(raw) if isinstance(raw, str) else raw, f"$.{path}", kind)


def market_documents(docs: DataFrame, now_ts: int) -> DataFrame:
    """The market dimension (see ``parse_markets``) with ``raw``; lists may come as JSON or as its text.

    Documents without a slug, and text that is no JSON, are left out (see ``broken_documents``).
    """
    d = with_raw(docs).where(field("slug", "string").isNotNull())
    return parse_markets(d.select("raw", *[field(c, "string").alias(c) for c in MARKET_FIELDS]), now_ts, ["raw"])


def broken_documents(docs: DataFrame, required: str) -> DataFrame:
    """Keys of the documents that are no JSON or lack a required field."""
    return with_raw(docs).where(field(required, "string").isNull()).select("key")


def deposit_documents(docs: DataFrame) -> DataFrame:
    """wallet, funder, first_deposit_ts, tx_hash, raw; an empty document gives NULL fields."""
    d = with_raw(docs)
    return d.select(
        F.lower("key").alias("wallet"), F.lower(field("from", "string")).alias("funder"), field("timestamp", "bigint").alias("first_deposit_ts"),
        field("tx_hash", "string").alias("tx_hash"), "raw",
    )


def transfer_documents(docs: DataFrame) -> DataFrame:
    """funder, hit_cap and one row per transfer (to, ts); funders without transfers keep one row."""
    d = with_raw(docs).select(
        F.lower("key").alias("funder"), F.coalesce(field("hit_cap", "boolean"), F.lit(False)).alias("hit_cap"),
        F.explode_outer(field("transfers", "array<variant>")).alias("t"),
    )
    return d.select("funder", "hit_cap", F.lower(field("to", "string", "t")).alias("to"), field("ts", "bigint", "t").alias("ts"))


def facet(markets: DataFrame, path: str, kind: str, name: str) -> DataFrame:
    """slug and any further field of the stored market documents."""
    return markets.select(F.col("slug").alias(MARKET), field(path, kind).alias(name))
