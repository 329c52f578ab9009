"""The full behavioural vector: one plan over all markets and wallets."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from fillsight.functions.scalar import final_outcome, grid_tag
from fillsight.ml.together import side_by_side
from fillsight.operators import behavior as B, history as H, ledger as L, parsing as P
from fillsight.operators.history import FIXED_HORIZONS, GRID_FRACS
from fillsight.operators.scan import CELL, MANY_KEYS, MAX_GROUP_ROWS, Cells, join_dimension
from fillsight.schema import MARKET, MARKET_WALLET, TRADE_ORDER
from fillsight.session import materialize

KEYS = list(MARKET_WALLET)
# Columns of the trades that the ledger carries.
LEDGER_COLUMNS = (*KEYS, *TRADE_ORDER, "role", "norm_side", "norm_price", "token_micro", "cash_micro", "signed_micro")
# Columns its shuffle moves; the others follow from them.
MOVED_COLUMNS = (*KEYS, *TRADE_ORDER, "is_buy", "norm_price", "token_micro", "cash_micro")

MAJOR = (
    "major_move_start_price", "major_move_future_price", "major_move_delta", "major_move_time_position_pct",
    "major_move_time_remaining_pct",
)
ENTRY = (
    "entry_price_percentile", "first_entry_time_position_pct", "first_entry_time_remaining_pct",
    "time_to_major_move_pct_of_market", "entry_concentration_hhi", "entry_span_pct_of_market", "pre_entry_price_std",
    "pre_entry_abs_return_mean",
)
UNREALIZED = ("unrealized_edge_per_open_token", "unrealized_edge_per_open_token_sqrt", "open_position_qty")
DAYS = (
    "n_distinct_buy_days", "n_distinct_sell_days", "n_distinct_active_days", "buy_day_concentration_hhi",
    "sell_day_concentration_hhi", "active_day_concentration_hhi", "active_day_frac",
)
REALIZED = tuple(
    f"{e}{n}" for e in ("", "early_") for n in (
        "realized_pnl_total", "realized_pnl_per_closing_trade", "realized_pnl_per_matched_token",
        "n_closing_trades_with_realization", "matched_tokens_realized", "realized_win_rate_closing_trades",
    )
)
GRID = tuple(
    f"{side}_markout_adj_{stat}_{grid_tag(h, lb)}"
    for h in GRID_FRACS for lb in GRID_FRACS for stat in ("mean", "median", "grosswt") for side in ("buy", "sell")
)
FIXED = tuple(f"{side}_markout_{stat}_{h}s" for h in FIXED_HORIZONS for side in ("buy", "sell") for stat in ("mean", "median"))
CONTRARIAN = (
    "cash_at_low_price_frac", "buy_cash_at_low_price_frac", "sell_cash_at_high_price_frac",
    "cash_against_recent_trend_frac", "buy_cash_against_recent_downtrend_frac",
    "sell_cash_against_recent_uptrend_frac", "recent_trend_mean_for_buys", "recent_trend_mean_for_sells",
)
EXTREME = (
    "low_buy_cash_frac_leq_0p1", "high_sell_cash_frac_geq_0p9", "low_buy_building_cash_frac",
    "high_sell_nonflattening_cash_frac", "extreme_trade_nonflattening_cash_frac", "low_buy_building_cash_frac_pctl10",
    "high_sell_nonflattening_cash_frac_pctl90", "extreme_trade_nonflattening_cash_frac_pctl",
    "n_low_buy_building_trades_pctl10", "n_high_sell_nonflattening_trades_pctl90", "n_low_buy_building_trades",
    "n_high_sell_nonflattening_trades", "low_buy_high_sell_pctl",
)
ADAPTIVE = (
    "terminal_start_ts", "terminal_start_time_position", "realized_edge_grosswt", "realized_raw_pnl_grosswt",
    "realized_token_frac",
    *[f"{L.derisk_name(t)}_{s}" for t in L.DERISK_THRESHOLDS for s in ("time_position_mean", "time_position_tokenwt", "token_frac")],
    *[
        name
        for h in GRID_FRACS
        for tag in [f"h{h:.3f}".replace(".", "p")]
        for name in (
            f"adaptive_markout_raw_grosswt_{tag}", f"adaptive_markout_abs_grosswt_{tag}",
            f"adaptive_late_spike_edge_grosswt_{tag}", f"adaptive_late_spike_token_frac_{tag}",
            f"adaptive_held_to_end_token_frac_{tag}", f"adaptive_markout_latespike_adj_grosswt_{tag}",
            *[f"adaptive_{op}_realized_alpha{str(a).replace('.', 'p')}_{tag}" for a in B.REALIZED_ALPHAS for op in ("plus", "minus")],
        )
    ],
)
FAMILIES = {
    "major": MAJOR, "entry": ENTRY, "unrealized": UNREALIZED, "holding": B.HOLDING, "grid": GRID, "fixed": FIXED,
    "realized": REALIZED, "path": B.PATH, "contrarian": CONTRARIAN, "extreme": EXTREME, "days": DAYS,
    "adaptive": ADAPTIVE,
}
# Lookups around trade seconds that a family reads.
LOOKUP_NEEDS = {
    "entry": frozenset({"trail"}), "grid": frozenset({"grid"}), "fixed": frozenset({"fixed"}),
    "contrarian": frozenset({"trail"}), "adaptive": frozenset({"grid"}),
}
# Families that one aggregation of the priced ledger gives together.
POOLED = ("holding", "path", "grid", "fixed", "contrarian", "extreme")
BEHAVIOR_COLUMNS = tuple(c for cols in FAMILIES.values() for c in cols)


@dataclass
class Behavior:
    """Shared frames of the behavioural jobs, each built on first use.

    The ledger, the series, the lookups, the lots' segments and the market facts feed
    several families and are written once to the shared checkpoint folder; everything
    else is computed from them. ``stage=False`` keeps one lazy plan instead.
    """

    fills: DataFrame
    markets: DataFrame
    same_timestamp: str = "last"
    max_group_rows: int = MAX_GROUP_ROWS
    early_frac: float = 0.5
    threshold: float = 0.15
    stage: bool = True

    def _keep(self, df: DataFrame) -> DataFrame:
        return materialize(df) if self.stage else df

    @cached_property
    def clean(self) -> DataFrame:
        return P.dedupe_fills(self.fills)

    @cached_property
    def trades(self) -> DataFrame:
        # one row per fill is written; its two trades are made where they are read
        return P.normalize_trades(P.trade_legs(self._keep(P.classify_fills(self.clean, self._small(self.markets), self._dealt))))

    @cached_property
    def heavy(self) -> DataFrame | None:
        """Markets whose trades are dealt over several tasks where they meet their market's facts."""
        return P.heavy_markets(self.fills)

    @cached_property
    def few_markets(self) -> bool:
        """Whether tables with one row per market go to every task; rows that meet them then stay where they are."""
        return self.stage and self.markets.count() <= MANY_KEYS

    def _small(self, per_market: DataFrame) -> DataFrame:
        return F.broadcast(per_market) if self.few_markets else per_market

    @property
    def _dealt(self) -> DataFrame | None:
        """Heavy markets where rows have to move to meet their market's row."""
        return None if self.few_markets else self.heavy

    @cached_property
    def wallet_cells(self) -> Cells:
        return L.wallet_cells(self.trades, max_rows=self.max_group_rows)

    @cached_property
    def market_cells(self) -> Cells:
        return H.market_cells(self.history, self.trades, max_rows=self.max_group_rows)

    @cached_property
    def series_cells(self) -> Cells:
        """Split plan of the price series alone, for what looks it up in itself."""
        return H.market_cells(self.history, max_rows=self.max_group_rows)

    @cached_property
    def split(self) -> bool:
        return self.wallet_cells.split

    @cached_property
    def median_plan(self) -> dict:
        """How the medians of the trades are found: over how many tasks, or by counting ranks."""
        n = self.trades.groupBy(*KEYS).count().agg(F.sum("count"), F.max("count")).first()
        total, most = n[0] or 0, n[1] or 0
        tasks = max(self.trades.sparkSession.sparkContext.defaultParallelism, -(-total // B.MEDIAN_TASK_ROWS))
        return {"split": self.split or most > B.MEDIAN_GROUP_ROWS, "tasks": tasks}

    @cached_property
    def history(self) -> DataFrame:
        return self._keep(P.price_history(
            self.clean, self._small(self.markets), self.same_timestamp, drop_duplicates=False, heavy=self._dealt
        ))

    @cached_property
    def ledger(self) -> DataFrame:
        # one shuffle moves every trade by (market, wallet): only what the families read goes with it,
        # and what follows from that is computed behind it, and again behind the written table
        t = self.trades.withColumn("is_buy", F.col("norm_side") == "BUY").select(*MOVED_COLUMNS)
        if not self.split:
            t = t.repartition(*KEYS)
        t = L.with_sides(t).select(*LEDGER_COLUMNS)
        full = B.with_previous_sign(L.build_ledger(t, self.wallet_cells), self.wallet_cells)
        if not self.stage:
            return full
        stored = [c for c in full.columns if c in (*L.STORED, "prev_sign", CELL)]
        return L.restore(self._keep(full.select(*stored)), full.columns)

    @cached_property
    def series(self) -> DataFrame:
        return self._small(self._keep(H.series_facts(self.history, self.series_cells.split)))

    @cached_property
    def lookups(self) -> DataFrame:
        """Prices and trailing statistics around every second with a trade."""
        return self.lookups_with(frozenset({"grid", "fixed", "trail"}))

    def lookups_with(self, needs: frozenset[str]) -> DataFrame:
        """Only the requested lookups: grid and fixed horizons, trailing statistics."""
        for have, frame in self._lookups.items():
            if needs <= have:
                return frame
        kinds = {k: k in needs for k in ("grid", "fixed")}
        if self.in_arrays:
            out = H.series_lookups(
                self.ledger, self.history, self.series, **kinds, trail="trail" in needs, unique=self.same_timestamp is not None
            )
        else:
            seconds, parts = self.ledger.select(MARKET, "ts").distinct(), []
            if any(kinds.values()):
                parts.append(H.second_lookups(seconds, self.history, self.series, self.market_cells, **kinds))
            if "trail" in needs:
                parts.append(H.trailing_stats(seconds, self.history, cells=self.market_cells))
            out = parts[0] if len(parts) == 1 else parts[0].join(parts[1], [MARKET, "ts"])
        self._lookups[needs] = self._keep(out)
        return self._lookups[needs]

    @cached_property
    def _lookups(self) -> dict[frozenset[str], DataFrame]:
        return {}

    @cached_property
    def dims(self) -> DataFrame:
        """Market dimension joined with the series facts (one row per market)."""
        m = self.markets.select(
            F.col("slug").alias(MARKET), "start_ts", "end_ts", final_outcome(F.col("closed"), F.col("outcome_prices")).alias("outcome")
        )
        d = m.join(self.series, MARKET, "left").withColumn("yes_wins", F.coalesce(F.col("outcome") == 1, F.lit(False)))
        return self._small(self._keep(d))

    @cached_property
    def moves(self) -> DataFrame:
        if self.in_arrays:
            m = H.first_major_move(self.history, threshold=self.threshold, unique=self.same_timestamp is not None)
        else:
            m = H.detect_major_move(self.history, threshold=self.threshold, cells=self.series_cells)
        return self._small(self._keep(m))

    @cached_property
    def in_arrays(self) -> bool:
        """Whether a task can keep any market's series as arrays; longer ones go by ordered scans over their cells."""
        return (self.series.agg(F.max("h_rows")).first()[0] or 0) <= H.ARRAY_ROWS

    @cached_property
    def facts(self) -> DataFrame:
        spikes = H.terminal_spikes(self.history, self.dims, 0.05, 0.25)
        return self._small(self._keep(self.dims.join(self.moves, MARKET, "left").join(spikes, MARKET, "left")))

    @cached_property
    def segments(self) -> DataFrame:
        full = L.fifo_segments(self.ledger, self.max_group_rows)
        return L.restore_segments(self._keep(full.select(*L.STORED_SEGMENT))) if self.stage else full

    @cached_property
    def lots(self) -> DataFrame:
        return L.build_lots(self.segments)

    @cached_property
    def unnamed_lots(self) -> DataFrame:
        """Lots without the ids of their entries, written once for the two aggregations over them."""
        return self._keep(L.build_lots(self.segments, names=False))

    def _stage(self, names: Iterable[str], needs: frozenset[str]) -> None:
        """Write the shared frames these families read, independent ones side by side."""
        if not self.stage:
            return
        names, spark = set(names), self.fills.sparkSession
        self._dealt, self.clean  # both chains below read them
        side_by_side(spark, [lambda: self.history, lambda: self.ledger])
        after = []
        self.dims, self.in_arrays  # the next read them, and what they are made of
        if needs:
            after.append(lambda: self.lookups_with(needs))
        if names & {"unrealized", "realized", "adaptive"}:
            after.append(lambda: self.unnamed_lots if "adaptive" in names else self.segments)
        if names & {"entry", "adaptive"}:
            after.append(lambda: self.facts)
        side_by_side(spark, after)

    def priced(self, needs: frozenset[str], medians: bool = False) -> DataFrame:
        """Ledger rows with the needed lookups of their second and their market's facts.

        For ``medians`` the rows are dealt by (market, wallet) before they meet the facts, so these are not moved.
        """
        t = self.ledger.select(
            *KEYS, "ts", "seq", "is_buy", "token_micro", "cash_micro", "norm_price", "inventory", "prev_sign"
        )
        f = self.dims.select(MARKET, "outcome", "start_ts", "end_ts", "life", "h_rows", "p10", "p25", "p75", "p90")
        if needs:
            t = t.join(self.lookups_with(needs), [MARKET, "ts"])
        signed = F.when(F.col("is_buy"), F.col("token_micro")).otherwise(-F.col("token_micro"))
        before = F.col("inventory") - signed
        if medians and self.placed:
            # prices that no score reads stay behind
            unread = [c for c in t.columns if c.startswith(("fut", "past"))]
            t = B.by_wallet(t.withColumns({c: F.when(B.building(before), F.col(c)) for c in unread}), self.median_plan["tasks"])
        return join_dimension(t, f, MARKET, F.col("wallet"), self._dealt).withColumn("inventory_before", before)

    @property
    def placed(self) -> bool:
        """Whether rows dealt by (market, wallet) stay there while they meet their market's facts."""
        return self.few_markets and not self.median_plan["split"]

    def family(self, name: str, wanted: set[str] | None = None, needs: frozenset[str] | None = None) -> DataFrame:
        """One feature family as a frame keyed by (market, wallet).

        ``needs`` lets several families share one set of lookups.
        """
        if needs is None:
            needs = LOOKUP_NEEDS.get(name, frozenset())
            if name != "major":
                self._stage([name], needs)
        if name == "major":
            return H.with_move_position(self.moves, self._small(self.markets)).select(MARKET, *MAJOR)
        if name == "entry":
            return B.entry_features(self.ledger, self.lookups_with(needs), self.facts, self.history, max_rows=self.max_group_rows, heavy=self._dealt, few=self.few_markets)
        if name == "unrealized":
            return L.unrealized_features(self.segments, self.dims, self._dealt)
        if name in ("holding", "path"):
            both = B.position_features(self.ledger, self.dims, self.wallet_cells, self.early_frac, self._dealt)
            return both.select(*KEYS, *FAMILIES[name])
        if name == "grid":
            return B.markout_features(self.priced(needs, True), tags=self._tags(wanted), **self.median_plan, placed=self.placed)
        if name == "fixed":
            return B.fixed_markout_features(self.priced(needs, True), **self.median_plan, placed=self.placed)
        if name == "realized":
            return L.realized_features(self.segments, self._small(self.markets), self.early_frac, self._dealt)
        if name == "contrarian":
            return B.aggregate_family(self.priced(needs), B.contrarian_aggs())
        if name == "extreme":
            return B.aggregate_family(self.priced(frozenset()), B.extreme_aggs())
        if name == "days":
            return B.day_features(self.ledger, self.dims, self._dealt)
        if name == "adaptive":
            return B.adaptive_features(self.unnamed_lots, self.segments, self.lookups_with(needs), self.facts, heavy=self._dealt)
        raise KeyError(name)

    def pooled(self, names: list[str], want: set[str] | None, needs: frozenset[str]) -> tuple[DataFrame, list[str]]:
        """Several families of the priced ledger in one aggregation, and the medians still to be found in its ``_values``."""
        medians = bool({"grid", "fixed"} & set(names))
        t, aggs, med = self.priced(needs, medians), {}, {}
        if "grid" in names:
            tags = self._tags(want)
            t = B.with_scores(t, tags=tags)
            found = B.markout_aggs(tags=tags)
            aggs, med = aggs | found[0], med | found[1]
        if "fixed" in names:
            found = B.fixed_markout_aggs()
            aggs, med = aggs | found[0], med | found[1]
        for name, of in (("contrarian", B.contrarian_aggs), ("extreme", B.extreme_aggs)):
            aggs |= of() if name in names else {}
        position = B.position_aggs(self.early_frac, ["seq"]) if {"holding", "path"} & set(names) else {}
        aggs |= {n: c for n, c in position.items() if any(n in FAMILIES[f] for f in names)}
        if medians and self.placed:
            return B.with_values(t, aggs, med), list(med)
        return B.with_medians(t, aggs, med, **self.median_plan) if medians else B.aggregate_family(t, aggs), []

    @staticmethod
    def _tags(want: set[str] | None) -> set[str] | None:
        return None if want is None else {t for t in B.grid_tags() if any(w.endswith(t) for w in want & set(GRID))}

    def features(self, wanted: Iterable[str] | None = None) -> DataFrame:
        """All features, or only the families holding a requested one.

        Families not asked for are never planned: their lookups, segments and
        aggregations do not run. Those of the priced ledger share one aggregation.
        """
        want = set(wanted) if wanted is not None else None
        names = [n for n, cols in FAMILIES.items() if want is None or want & set(cols)]
        needs = frozenset().union(*[LOOKUP_NEEDS.get(n, frozenset()) for n in names])
        self._stage(names, needs)
        pool, open_ = [n for n in names if n in POOLED], []
        frames = []
        if pool:
            found, open_ = self.pooled(pool, want, frozenset().union(*[needs if n in LOOKUP_NEEDS else frozenset() for n in pool]))
            frames.append((pool, found))
        # a row per market comes last: where it is not sent to every task, nothing has to move back
        frames += [([n], self.family(n, want, needs)) for n in sorted(names, key="major".__eq__) if n not in POOLED]
        out, cols = None if pool else self.ledger.select(*KEYS).distinct(), set()
        for members, df in frames:
            if out is None:
                out = df
            else:
                out = out.join(self._small(df), [MARKET], "left") if members == ["major"] else out.join(df, KEYS, "left")
            cols |= {c for n in members for c in FAMILIES[n] if c in df.columns}
        if open_:
            # medians are found after the joins, which they would move all rows for
            out, cols = B.medians_of_values(out, open_), cols | set(open_)
        order = [c for n in names for c in FAMILIES[n] if c in cols and (want is None or c in want)]
        return out.select(*KEYS, *order)


def behavior_features(fills: DataFrame, markets: DataFrame, wanted: Iterable[str] | None = None, **kw) -> DataFrame:
    return Behavior(fills, markets, **kw).features(wanted)
