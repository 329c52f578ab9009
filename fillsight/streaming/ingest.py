"""Incremental fill ingest and live views with Structured Streaming.

All jobs run with the AvailableNow trigger by default: they take what has landed
since the last run, checkpoint and stop, and are safe to restart after a loss. Tables
grow by one folder per batch, which a retry replaces, and are merged in place
(``streaming.runs``). Views keep no streaming state: a batch writes what it adds, one row per
key it touches, and readers add these up, so a fill counts however late it comes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from fillsight.operators import parsing as P
from fillsight.schema import FILLS, MARKET, MARKET_WALLET
from fillsight.streaming.identity import IdentityIndex
from fillsight.streaming.runs import Runs, read_folders

KEYS = list(MARKET_WALLET)
# Folders of landed fills: markets by hash, then UTC days. The slug itself stays in the files.
MARKET_BUCKETS = 16
PLACE = ("market_bucket", "day")
LANDED = T.StructType([*FILLS, T.StructField("market_bucket", T.IntegerType()), T.StructField("day", T.DateType())])


def fill_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """Stream over landed fill files."""
    return spark.readStream.schema(FILLS).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def run_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``fn(batch, batch_id)`` on what has landed since the last run."""
    return df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def market_bucket():
    return F.pmod(F.xxhash64(MARKET), F.lit(MARKET_BUCKETS)).cast("int")


def _placed(fills: DataFrame) -> DataFrame:
    """Fills with their folder; the rebalance splits folders that hold much of a batch."""
    day = F.to_date(F.timestamp_seconds("timestamp"))
    return fills.withColumn("market_bucket", market_bucket()).withColumn("day", day).hint("rebalance", *PLACE)


def _with_identity(fills: DataFrame) -> DataFrame:
    """``_id``: the fill's id, or a digest of its values where it has none."""
    own = F.concat(F.lit("values:"), F.sha2(F.to_json(F.struct(*[f.name for f in FILLS])), 256))
    return fills.withColumn("_id", F.coalesce("id", own))


def ingest_fills(fills: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Fills once per id to parquet, whenever they arrive and whatever their market is.

    A batch is deduplicated and probed against the index of landed ids; landed fills are not
    read. There is no watermark: a fill that is weeks late is kept like any other. Fills
    without an id are known by all their values.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index, table = IdentityIndex(spark, f"{out}/index"), Runs(spark, f"{out}/fills")
        rows = _with_identity(batch.select(*[f.name for f in FILLS])).dropDuplicates(["_id"])
        known = index.known(rows.select(F.col("_id").alias("id")), batch_id)
        rows = rows.join(known.withColumnRenamed("id", "_id"), "_id", "left_anti").drop("_id")
        table.write(_placed(rows), batch_id, PLACE)
        mine = spark.read.schema(LANDED).parquet(f"{table.path}/new/batch={batch_id}")
        index.add(_with_identity(mine).select(F.col("_id").alias("id")), batch_id)
        merge_fills(spark, out, batch_id)

    return run_batches(fills, run, checkpoint)


def merge_fills(spark: SparkSession, out: str, before: int) -> None:
    """Merge the small folders of landed fills of batches below ``before``, in place.

    The folders of batches stay for the streams that have yet to read them (``retire_fills``).
    """
    table = Runs(spark, f"{out}/fills")

    def write(paths: list[str], target: str) -> None:
        rows = read_folders(spark, paths, LANDED).hint("rebalance", *PLACE)
        rows.write.mode("overwrite").partitionBy(*PLACE).parquet(target)

    table.merge(table.due(before), write, keep=None)


def retire_fills(spark: SparkSession, out: str, last: int) -> None:
    """Delete merged folders of batches up to ``last``, which every stream over them has read."""
    Runs(spark, f"{out}/fills").retire(last)


def landed_fills(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """All ingested fills with their folder columns, for reads that prune by market bucket and day."""
    return Runs(spark, f"{out}/fills").read(LANDED, before)


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """All ingested fills."""
    return landed_fills(spark, out).drop(*PLACE)


def ingested_stream(spark: SparkSession, out: str) -> DataFrame:
    """Stream over the ingested fills, batch by batch; merges are not seen."""
    return fill_stream(spark, f"{out}/fills/new").select(*[f.name for f in FILLS])


# ------------------------------------------------------------------------ views

@dataclass(frozen=True)
class DeltaView:
    """A table of totals per key: ``rows`` turns fills into totals, which add up (or take the greatest)."""

    keys: tuple[str, ...]
    rows: Callable[[DataFrame], DataFrame]
    sums: tuple[str, ...] = ()
    greatest: tuple[str, ...] = ()

    def add_up(self, deltas: DataFrame) -> DataFrame:
        return deltas.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums], *[F.max(c).alias(c) for c in self.greatest])


def positions_view(markets: DataFrame) -> DeltaView:
    """Inventory and volume per (market, wallet); signed sums do not depend on order."""

    def rows(fills: DataFrame) -> DataFrame:
        t = P.normalize_trades(P.parse_trades(fills, markets))
        return t.groupBy(*KEYS).agg(
            F.sum("signed_micro").alias("inventory_micro"), F.sum("cash_micro").alias("volume_micro"),
            F.count("*").alias("n_trades"), F.max("ts").alias("last_ts"),
        )

    return DeltaView(tuple(KEYS), rows, ("inventory_micro", "volume_micro", "n_trades"), ("last_ts",))


def hourly_view(markets: DataFrame, seconds: int = 3600) -> DeltaView:
    """Volume and last YES price per market and tumbling window."""

    def rows(fills: DataFrame) -> DataFrame:
        v = P.market_volume(fills, markets)
        return v.groupBy(MARKET, (F.col("ts") - F.pmod("ts", F.lit(seconds))).alias("start")).agg(
            F.sum("cash_amount").alias("cash"), F.sum("token_amount").alias("tokens"), F.count("*").alias("n_fills"),
            F.max(F.struct("ts", "yes_price")).alias("last"),
        )

    return DeltaView((MARKET, "start"), rows, ("cash", "tokens", "n_fills"), ("last",))


def track(fills: DataFrame, view: DeltaView, out: str, checkpoint: str) -> StreamingQuery:
    """Write what each batch adds to the view; small folders are added up in place.

    ``fills`` hold each id once (see ``ingest_fills``). No state outlives a batch: what is stored
    is one row per key and batch that touched it, and one per key after a merge.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        table = Runs(batch.sparkSession, out)
        table.write(view.rows(batch), batch_id)

        def write(paths: list[str], target: str) -> None:
            view.add_up(read_folders(batch.sparkSession, paths)).write.mode("overwrite").parquet(target)

        table.merge(table.due(batch_id), write)

    return run_batches(fills, run, checkpoint)


def tracked(spark: SparkSession, view: DeltaView, out: str) -> DataFrame:
    """Current totals of a view."""
    return view.add_up(Runs(spark, out).read())


# --------------------------------------------------------------------- versions

def save_version(df: DataFrame, out: str, batch_id: int, keys: list[str]) -> None:
    """Rows a batch has computed anew; older rows of their keys are superseded."""
    table = Runs(df.sparkSession, out)
    table.write(df.withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id)

    def write(paths: list[str], target: str) -> None:
        _newest(read_folders(df.sparkSession, paths), keys).write.mode("overwrite").parquet(target)

    table.merge(table.due(batch_id), write)


def _newest(versions: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")


def current_state(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest version of each key."""
    return _newest(Runs(spark, out).read(), keys).drop("batch")


def touched_wallets(fills: DataFrame) -> DataFrame:
    """(market, wallet) of both sides of every fill."""
    both = F.array(F.struct(F.lower("maker").alias("wallet")), F.struct(F.lower("taker").alias("wallet")))
    return fills.select(MARKET, F.inline(both)).distinct()


def rescore_touched(
    fills: DataFrame, landed: Callable[[SparkSession], DataFrame], score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Re-score the wallets a batch touched on all their landed fills.

    ``landed`` reads the landed fills, ``score`` maps those of the touched markets to scored
    (market, wallet) rows; only touched wallets are written. Use this where a score needs the
    whole history of a market; ``streaming.live`` goes on from stored state instead.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        touched = touched_wallets(batch.dropDuplicates(["id"]))
        markets = touched.select(MARKET).distinct()
        history = landed(batch.sparkSession).join(markets, MARKET, "left_semi").dropDuplicates(["id"])
        save_version(score(history).join(touched, KEYS, "left_semi"), out, batch_id, KEYS)

    return run_batches(fills, run, checkpoint)
