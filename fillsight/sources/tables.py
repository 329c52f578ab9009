"""Feature tables, label tables and result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fillsight.functions.scalar import short_key
from fillsight.schema import MARKET

KEYS = ["wallet", MARKET]

# Accepted spellings of the key and label columns.
WALLET_NAMES = ("wallet", "wallet_address", "address", "proxy_wallet")
SLUG_NAMES = ("market_slug", "slug")
LABEL_NAMES = ("is_insider", "label", "y")

RESULT_LEAD = ("wallet", MARKET, "pred_prob", "pred_prob_raw", "flagged", "volume", "n_trades", "first_trade_ts")


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by market; rows are clustered first so each market writes few files."""
    df.repartition(MARKET, F.pmod(F.xxhash64("wallet"), F.lit(16))).write.mode(mode).partitionBy(MARKET).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; slugs stay text, whatever their folder names look like."""
    found = spark.read.parquet(path).schema
    fixed = T.StructType([T.StructField(f.name, T.StringType()) if f.name == MARKET else f for f in found])
    return spark.read.schema(fixed).parquet(path)


def overwrite_market(df: DataFrame, path: str) -> None:
    """Replace only the markets present in ``df``."""
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        write_features(df, path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def replace_markets(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` plus the rows of all markets it does not mention."""
    kept = existing.join(new.select(MARKET).distinct(), MARKET, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_missing(existing: DataFrame, requested: DataFrame, compute, keys: Sequence[str] = KEYS) -> DataFrame:
    """Requested rows of the table; ``compute(missing_keys)`` supplies those it lacks."""
    want = requested.select(*keys).distinct()
    missing = want.join(existing.select(*keys), list(keys), "left_anti")
    table = existing.unionByName(compute(missing), allowMissingColumns=True)
    return table.join(want, list(keys), "left_semi")


def lead_columns(df: DataFrame, lead: Sequence[str] = RESULT_LEAD) -> DataFrame:
    first = [c for c in lead if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """All rows, and the flagged ones a second time, lead columns first."""
    out = lead_columns(df)
    writer = lambda d, p: d.write.mode("overwrite").option("header", True).format(fmt).save(p)
    writer(out, f"{path}/results")
    writer(out.filter(F.col("flagged")), f"{path}/flagged")


def dataset_schema(df: DataFrame, label: str = "is_insider") -> DataFrame:
    """One-row summary of a labelled dataset."""
    features = [c for c in df.columns if c not in (*KEYS, label)]
    return df.agg(
        F.count("*").alias("n_rows"), F.lit(len(features)).cast("bigint").alias("n_features"),
        F.count_if(F.col(label) == 1).alias("n_positives"), F.count_if(F.col(label) == 0).alias("n_negatives"),
        F.count_distinct(MARKET).alias("n_markets"), F.count_distinct("wallet").alias("n_wallets"),
    )


def labelled_pairs(df: DataFrame) -> DataFrame:
    """(wallet, market_slug, is_insider) from a table using any accepted column names."""
    by_lower = {c.lower(): c for c in df.columns}

    def find(names: Sequence[str], required: bool = True) -> str | None:
        hit = next((by_lower[n] for n in names if n in by_lower), None)
        if hit is None and required:
            raise ValueError(f"none of the columns {names} found")
        return hit

    label = find(LABEL_NAMES, required=False)
    is_pos = F.col(label).cast("int") if label else F.lit(1)
    pairs = df.select(
        F.lower(find(WALLET_NAMES)).alias("wallet"), F.col(find(SLUG_NAMES)).alias(MARKET), is_pos.alias("is_insider")
    )
    return pairs.dropDuplicates(KEYS)


def flagged_wallets(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.lower("wallet").alias("wallet")).distinct()


def with_file_key(df: DataFrame, slug: str = MARKET) -> DataFrame:
    return df.withColumn("file_key", short_key(F.col(slug)))
