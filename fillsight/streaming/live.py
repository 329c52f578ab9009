"""Live wallet features that go on from stored state instead of re-reading a market.

After every batch a (market, wallet) has a tail: its totals so far, and its open lots, one row
per lot. First in, first out needs no more than that: units matched so far never change, so the
open lots, taken as trades at their own time, followed by the new trades, match as the whole
history would. A batch reads the tails of the wallets it touches and its own fills.

A fill that comes late changes what was matched after it. Its wallet then goes back to the
newest tail that ends before the fill, and only its own trades since that tail are read
again, pruned by market bucket and day. Merges keep the last valid tail of each day.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from fillsight.operators import ledger as L, parsing as P
from fillsight.operators.scan import join_dimension
from fillsight.schema import MARKET, MARKET_WALLET, MICRO, ratio
from fillsight.session import materialize
from fillsight.streaming.ingest import PLACE, market_bucket, run_batches, save_version, touched_wallets
from fillsight.streaming.runs import Run, Runs, read_folders

KEYS = list(MARKET_WALLET)
EARLY_FRAC = 0.5
# Totals of a tail: all add up but for the times.
SUMS = (
    "n_trades", "buy_micro", "sell_micro", "cash_micro", "closing_trades", "matched_micro", "pnl_micro", "wins",
    "early_closing_trades", "early_matched_micro", "early_pnl_micro", "early_wins",
)
# A lot as a trade: what is left of it at its own price and time.
LOT = ("ts", "trade_id", "role_no", "norm_side", "norm_price", "token_micro")
TRADES = T.StructType([
    *[T.StructField(c, T.StringType()) for c in MARKET_WALLET], T.StructField("ts", T.LongType()), T.StructField("trade_id", T.StringType()),
    T.StructField("role_no", T.IntegerType()), T.StructField("norm_side", T.StringType()), T.StructField("norm_price", T.DoubleType()),
    T.StructField("token_micro", T.LongType()), T.StructField("cash_micro", T.LongType()),
    T.StructField("market_bucket", T.IntegerType()), T.StructField("day", T.DateType()),
])
_NEVER = -(2**62)


class LiveFeatures:
    """Tails, open lots and trades below ``path``, extended batch by batch."""

    def __init__(self, spark: SparkSession, path: str, markets: DataFrame):
        self.spark, self.markets = spark, markets
        self.tails, self.lots, self.taken = (Runs(spark, f"{path}/{n}") for n in ("tails", "lots", "trades"))

    # ------------------------------------------------------------------ state

    def versions(self, before: int | None = None) -> DataFrame | None:
        """All tails, with ``valid``: no later batch brought a fill at or before their end."""
        return _with_validity(self.tails.read(before=before)) if self.tails.runs(before) else None

    def current(self, before: int | None = None) -> DataFrame:
        """The newest tail of every (market, wallet)."""
        return self._newest(self.versions(before))

    @staticmethod
    def _newest(tails: DataFrame) -> DataFrame:
        rest = [c for c in tails.columns if c not in KEYS]
        return tails.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "batch").alias("t")).select(*KEYS, "t.*")

    def starts(self, touched: DataFrame, before: int) -> DataFrame:
        """(market, wallet, from_ts) of a batch with the tail each goes on from, if any, and
        ``reopen``: whether landed fills after that tail have to be read again."""
        versions = self.versions(before)
        if versions is None:
            return touched.select(*KEYS, "from_ts", F.lit(None).cast("bigint").alias("last_ts"), F.lit(None).cast("bigint").alias("batch"), F.lit(False).alias("reopen"))
        mine = versions.join(touched.withColumnRenamed("from_ts", "new_ts"), KEYS)
        usable = F.col("valid") & (F.col("last_ts") < F.col("new_ts"))
        found = mine.groupBy(*KEYS).agg(
            F.max(F.when(usable, F.struct("last_ts", "batch"))).alias("t"), F.max("batch").alias("newest"))
        out = touched.join(found, KEYS, "left")
        fresh = F.col("newest").isNull() | F.coalesce(F.col("t.batch") == F.col("newest"), F.lit(False))
        return out.select(*KEYS, "from_ts", F.col("t.last_ts").alias("last_ts"), F.col("t.batch").alias("batch"), (~fresh).alias("reopen"))

    def reopened(self, starts: DataFrame, before: int) -> DataFrame:
        """Trades after the tail of the wallets with late fills; folders are pruned first."""
        late = materialize(starts.where("reopen").select(*KEYS, F.coalesce("last_ts", F.lit(_NEVER)).alias("since")))
        bounds = late.groupBy(market_bucket().alias("market_bucket")).agg(F.min("since").alias("since")).collect()  # one row per bucket
        wanted = F.lit(False)
        for b in bounds:
            here = F.col("market_bucket") == b["market_bucket"]
            if b["since"] > _NEVER:
                here = here & (F.col("day") >= F.lit(datetime.fromtimestamp(b["since"], UTC).date()))
            wanted = wanted | here
        return self.taken.read(TRADES, before).where(wanted).drop(*PLACE).join(late, KEYS).where("ts > since").drop("since")

    # ------------------------------------------------------------------ batch

    def trades(self, fills: DataFrame) -> DataFrame:
        return P.normalize_trades(P.parse_trades(fills, self.markets)).select(*KEYS, *LOT, "cash_micro")

    def extend(self, fills: DataFrame, batch: int) -> None:
        """Take the fills of one batch (each id once, not taken before) into the tails."""
        placed = self.trades(fills).withColumn("market_bucket", market_bucket()).withColumn("day", F.to_date(F.timestamp_seconds("ts")))
        self.taken.write(placed.hint("rebalance", *PLACE), batch, PLACE)
        fresh = self.spark.read.schema(TRADES).parquet(f"{self.taken.path}/new/batch={batch}").drop(*PLACE)
        touched = fresh.groupBy(*KEYS).agg(F.min("ts").alias("from_ts"))
        starts = materialize(self.starts(touched, batch))
        new = fresh
        if not starts.where("reopen").isEmpty():
            new = materialize(fresh.unionByName(self.reopened(starts, batch)))
        lots, totals = self._resume(starts, batch)
        everything = new.select(*KEYS, *LOT)
        if lots is not None:
            everything = everything.unionByName(lots)
        signed = F.when(F.col("norm_side") == "BUY", F.col("token_micro")).otherwise(-F.col("token_micro"))
        segments = materialize(L.fifo_segments(L.build_ledger(everything.withColumn("signed_micro", signed))))
        self._write(new, segments, starts, totals, batch)
        self._merge(batch)

    def _resume(self, starts: DataFrame, batch: int) -> tuple[DataFrame | None, DataFrame | None]:
        """Open lots and totals of the tails the batch goes on from."""
        if not self.tails.runs(batch):
            return None, None
        known = starts.where("batch IS NOT NULL").select(*KEYS, "batch")
        totals = self.tails.read(before=batch).join(known, [*KEYS, "batch"], "left_semi").select(*KEYS, *SUMS, "first_ts")
        lots = self.lots.read(before=batch).join(known, [*KEYS, "batch"], "left_semi").select(*KEYS, *LOT)
        return lots, totals

    def _closings(self, segments: DataFrame) -> DataFrame:
        """Totals of the closing trades among the segments."""
        piece = F.col("qty_micro") * F.col("pnl_per_token")
        trade = segments.where("matched").groupBy(*KEYS, F.col("exit.trade_id").alias("trade_id"), F.col("exit.role_no").alias("role_no"),
                                                  F.col("exit.ts").alias("ts")).agg(F.sum(piece).alias("pnl"), F.sum("qty_micro").alias("matched"))
        bounds = self.markets.select(F.col("slug").alias(MARKET), "start_ts", "end_ts")
        trade = join_dimension(trade, bounds, MARKET, F.col("wallet"))
        early = F.coalesce(F.col("ts") <= F.col("start_ts") + EARLY_FRAC * (F.col("end_ts") - F.col("start_ts")), F.lit(False))
        won = F.round("pnl", 3) > 0

        def of(tag: str, cond: Column) -> list[Column]:
            return [
                F.count_if(cond).alias(f"{tag}closing_trades"), F.sum(F.when(cond, F.col("matched")).otherwise(0)).alias(f"{tag}matched_micro"),
                F.sum(F.when(cond, F.col("pnl")).otherwise(0.0)).alias(f"{tag}pnl_micro"), F.count_if(cond & won).alias(f"{tag}wins"),
            ]

        return trade.groupBy(*KEYS).agg(*of("", F.lit(True)), *of("early_", early))

    def _write(self, new: DataFrame, segments: DataFrame, starts: DataFrame, totals: DataFrame | None, batch: int) -> None:
        buy = F.col("norm_side") == "BUY"
        own = new.groupBy(*KEYS).agg(
            F.count("*").alias("n_trades"), F.sum(F.when(buy, F.col("token_micro")).otherwise(0)).alias("buy_micro"),
            F.sum(F.when(buy, 0).otherwise(F.col("token_micro"))).alias("sell_micro"), F.sum("cash_micro").alias("cash_micro"),
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        )
        made = own.join(self._closings(segments), KEYS, "left").fillna(0, list(SUMS))
        if totals is not None:
            old = totals.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in (*SUMS, "first_ts")])
            made = made.join(old, KEYS, "left")
            sums = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in SUMS]
            made = made.select(*KEYS, *sums, F.least("first_ts", "_first_ts").alias("first_ts"), "last_ts")
        number = F.lit(batch).cast("bigint").alias("batch")
        tails = made.join(starts.select(*KEYS, "from_ts"), KEYS).select(*KEYS, *SUMS, "first_ts", "last_ts", "from_ts", number)
        piece = segments.where(~F.col("matched")).select(
            *KEYS, F.col("entry.ts").alias("ts"), F.col("entry.trade_id").alias("trade_id"), F.col("entry.role_no").alias("role_no"),
            F.when(F.col("entry_sign") == 1, "BUY").otherwise("SELL").alias("norm_side"), F.col("entry.norm_price").alias("norm_price"),
            F.col("qty_micro").alias("token_micro"))
        # the tails are written last: a batch counts once they are there
        self.lots.write(piece.groupBy(*KEYS, *[c for c in LOT if c != "token_micro"]).agg(F.sum("token_micro").alias("token_micro")).withColumn("batch", number), batch)
        self.tails.write(tails, batch)

    def _merge(self, before: int) -> None:
        """Merge small folders of earlier batches; tails that only repeat a day's end or are not valid any more go."""
        def merge_tails(paths: list[str], target: str) -> None:
            _thinned(read_folders(self.spark, paths)).write.mode("overwrite").parquet(target)

        def merge_lots(paths: list[str], target: str) -> None:
            kept = self.spark.read.parquet(target.replace(self.lots.path, self.tails.path)).select(*KEYS, "batch")
            read_folders(self.spark, paths).join(kept, [*KEYS, "batch"], "left_semi").write.mode("overwrite").parquet(target)

        def merge_trades(paths: list[str], target: str) -> None:
            rows = read_folders(self.spark, paths, TRADES).hint("rebalance", *PLACE)
            rows.write.mode("overwrite").partitionBy(*PLACE).parquet(target)

        runs = self.tails.due(before)
        self.tails.merge(runs, merge_tails)
        if runs:
            self.lots.merge([r for r in self.lots.runs(before) if _inside(r, runs)], merge_lots)
        self.taken.merge(self.taken.due(before), merge_trades)

    # --------------------------------------------------------------- features

    def features(self, touched: DataFrame | None = None) -> DataFrame:
        """Realized, open and volume features of the current tails (of ``touched`` wallets only).

        Names and values agree with the batch features of the same names.
        """
        tails = self.current()
        if touched is not None:
            tails = tails.join(touched.select(*KEYS), KEYS, "left_semi")
        cols = []
        for tag in ("", "early_"):
            n, matched, pnl, wins = (F.col(f"{tag}{c}") for c in ("closing_trades", "matched_micro", "pnl_micro", "wins"))
            some = n > 0
            cols += [
                F.when(some, pnl / MICRO).alias(f"{tag}realized_pnl_total"),
                F.when(some, ratio(pnl / MICRO, n)).alias(f"{tag}realized_pnl_per_closing_trade"),
                F.when(some, ratio(pnl, matched)).alias(f"{tag}realized_pnl_per_matched_token"),
                F.when(some, n.cast("double")).alias(f"{tag}n_closing_trades_with_realization"),
                F.when(some, matched / MICRO).alias(f"{tag}matched_tokens_realized"),
                F.when(some, ratio(wins, n)).alias(f"{tag}realized_win_rate_closing_trades"),
            ]
        gross = F.col("buy_micro") + F.col("sell_micro")
        net = F.col("buy_micro") - F.col("sell_micro")
        return tails.select(
            *KEYS, *cols, (F.col("buy_micro") / MICRO).alias("buy_tokens_total"), (F.col("sell_micro") / MICRO).alias("sell_tokens_total"),
            (net / MICRO).alias("net_tokens"), (gross / MICRO).alias("gross_tokens"), (net / MICRO).alias("open_position_qty"),
            F.when(gross > 0, ratio(net, gross)).alias("net_directional_consistency"),
            "n_trades", (F.col("cash_micro") / MICRO).alias("volume"), F.col("first_ts").alias("first_trade_ts"), F.col("last_ts").alias("last_trade_ts"),
        )

    def open_lots(self) -> DataFrame:
        """Open lots of the current tails."""
        return self.lots.read().join(self.current().select(*KEYS, "batch"), [*KEYS, "batch"], "left_semi").drop("batch")


def _inside(run: Run, runs: list[Run]) -> bool:
    return runs[0].first <= run.first and run.last <= runs[-1].last


def _with_validity(tails: DataFrame) -> DataFrame:
    later = W.partitionBy(*KEYS).orderBy(F.desc("batch")).rowsBetween(W.unboundedPreceding, -1)
    earliest = F.min("from_ts").over(later)
    return tails.withColumn("valid", earliest.isNull() | (earliest > F.col("last_ts")))


def _thinned(tails: DataFrame) -> DataFrame:
    """The last valid tail of each day and (market, wallet).

    A tail that goes leaves the time of its earliest fill to the next one kept, as that time
    decides which older tails are valid.
    """
    newest_of_day = W.partitionBy(*KEYS, F.expr("last_ts div 86400")).orderBy(F.desc("valid"), F.desc("batch"))
    kept = F.col("valid") & (F.row_number().over(newest_of_day) == 1)
    newest_first = W.partitionBy(*KEYS).orderBy(F.desc("batch")).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = _with_validity(tails).withColumn("kept", kept).withColumn("group", F.sum(F.col("kept").cast("int")).over(newest_first))
    rest = [c for c in tails.columns if c not in (*KEYS, "from_ts")]
    out = marked.groupBy(*KEYS, "group").agg(F.max_by(F.struct(*rest), "batch").alias("t"), F.min("from_ts").alias("from_ts"))
    return out.select(*KEYS, "t.*", "from_ts").select(*tails.columns)


def follow(fills: DataFrame, path: str, markets: DataFrame, checkpoint: str, score=None) -> StreamingQuery:
    """Extend the tails by every batch of ``fills`` (each id once, see ``ingested_stream``), and
    store the rows of the wallets it touched: their features, or what ``score`` makes of these.

    ``current_state`` of ``path/scores`` gives the newest row of every wallet.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        live = LiveFeatures(batch.sparkSession, path, markets)
        batch = materialize(batch)
        live.extend(batch, batch_id)
        rows = live.features(touched_wallets(batch))
        save_version(score(rows) if score else rows, f"{path}/scores", batch_id, KEYS)

    return run_batches(fills, run, checkpoint)
