"""Per-wallet running state (inventory, units bought and sold) and FIFO lot matching.

FIFO has a closed form on integer units: within one (market, wallet) the k-th unit
bought is matched with the k-th unit sold, whatever the direction. Running sums place
every trade on a unit axis, and one descending scan over all trade ends cuts that axis
into segments with a single buy and a single sell each. The earlier of the two is the
entry, the later the exit; a segment with only one of them is still open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fillsight.operators.scan import COUNT, TIME_WIDTHS, UNIT_WIDTHS, Cells, join_dimension, plan_cells, scan
from fillsight.schema import MARKET_WALLET, MICRO, TRADE_ORDER, ratio

KEYS = list(MARKET_WALLET)


def wallet_cells(trades: DataFrame, **kw) -> Cells:
    """Split plan of the (market, wallet) groups along time."""
    return plan_cells(trades, KEYS, "ts", TIME_WIDTHS, **kw)


def build_ledger(trades: DataFrame, cells: Cells | None = None) -> DataFrame:
    """Normalized trades plus running state after each trade.

    buy_hi / sell_hi: units bought / sold so far, inventory: their difference,
    opened: units of the trade that open a lot (the rest closes earlier lots),
    open_from: where those units start on the unit axis.
    """
    is_buy = F.col("norm_side") == "BUY"
    qty = F.col("token_micro")
    df = trades.withColumn("is_buy", is_buy)
    if cells is not None and cells.split:
        df = cells.label(df, "ts")
    df = scan(
        df, KEYS, TRADE_ORDER,
        running={
            "buy_hi": ("sum", F.when(is_buy, qty).otherwise(0)),
            "sell_hi": ("sum", F.when(is_buy, F.lit(0).cast("bigint")).otherwise(qty)),
            "seq": ("count", F.lit(1)),
            "first_buy_ts": ("min", F.when(is_buy, F.col("ts"))),
        },
        cells=cells,
    )
    return with_position(df)


def with_position(df: DataFrame) -> DataFrame:
    """Add what follows from a trade and the units bought and sold up to it."""
    is_buy, qty = F.col("is_buy"), F.col("token_micro")
    hi = F.when(is_buy, F.col("buy_hi")).otherwise(F.col("sell_hi"))
    other = F.when(is_buy, F.col("sell_hi")).otherwise(F.col("buy_hi"))
    # units of the opposite side seen so far are already matched with this side's first units
    start = F.greatest(hi - qty, F.least(hi, other))
    return df.select(
        *df.columns,
        (F.col("buy_hi") - F.col("sell_hi")).alias("inventory"),
        (F.col("buy_hi") - F.col("sell_hi") - F.col("signed_micro")).alias("inventory_before"),
        hi.alias("unit_hi"), start.alias("open_from"), (hi - start).alias("opened"),
    )


# Columns of a stored ledger; all others follow from them row by row (``restore``).
STORED = (*KEYS, *TRADE_ORDER, "is_buy", "norm_price", "token_micro", "cash_micro", "buy_hi", "sell_hi", "seq", "first_buy_ts")


def with_sides(trades: DataFrame) -> DataFrame:
    """Role, side and signed units of trades that carry ``role_no``, ``is_buy`` and their units."""
    return trades.select(
        "*",
        F.when(F.col("role_no") == 0, "maker").otherwise("taker").alias("role"),
        F.when(F.col("is_buy"), "BUY").otherwise("SELL").alias("norm_side"),
        F.when(F.col("is_buy"), F.col("token_micro")).otherwise(-F.col("token_micro")).alias("signed_micro"),
    )


def restore(stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The ledger with ``columns`` from its stored ones."""
    return with_position(with_sides(stored)).select(*columns)


def fifo_segments(ledger: DataFrame, max_rows: int | None = None, cells: Cells | None = None) -> DataFrame:
    """Matched and open unit ranges of every (market, wallet).

    The split plan for the unit axis is counted here unless given.
    """
    info = F.struct("ts", "trade_id", "role_no", "norm_price", "open_from", "opened", "seq")
    ends = ledger.filter(F.col("token_micro") > 0).select(
        *KEYS,
        F.col("unit_hi").alias("pos"),
        F.when(F.col("is_buy"), info).alias("b"),
        F.when(~F.col("is_buy"), info).alias("s"),
    )
    if cells is None:
        cells = plan_cells(ends, KEYS, "pos", UNIT_WIDTHS, **({"max_rows": max_rows} if max_rows else {}))
    ends = cells.label(ends, "pos")
    seg = scan(
        ends, KEYS, ["pos"], latest={"buy": F.col("b"), "sell": F.col("s")}, cells=cells, descending=True, peers=True
    )
    if cells.split:
        # points of equal position share a cell, so one distinct point per position is enough
        seg = seg.groupBy(*KEYS, "pos", *[c for c in ("_cell",) if c in seg.columns]).agg(
            F.max("buy").alias("buy"), F.max("sell").alias("sell")
        )
    seg = scan(seg.withColumn("_pos", F.col("pos")), KEYS, ["pos"], previous={"lo": F.col("_pos")}, cells=cells)
    seg = seg.withColumn("lo", F.coalesce("lo", F.lit(0))).filter(F.col("pos") > F.col("lo"))
    # the unit is opened by its buy when it lies in the opening part of that buy
    buy_first = F.col("buy").isNotNull() & (F.col("lo") >= F.col("buy.open_from"))
    entry = F.when(buy_first, F.col("buy")).otherwise(F.col("sell"))
    exit_ = F.when(buy_first, F.col("sell")).otherwise(F.col("buy"))
    seg = seg.select(
        *KEYS, "lo", F.col("pos").alias("hi"),
        F.when(buy_first, 1).otherwise(-1).alias("entry_sign"), entry.alias("entry"), exit_.alias("exit"),
    )
    return restore_segments(seg)


# Columns of stored segments; all others follow from them row by row (``restore_segments``).
STORED_SEGMENT = (*KEYS, "lo", "hi", "entry_sign", "entry", "exit")


def restore_segments(stored: DataFrame) -> DataFrame:
    """Segments with what follows from their unit range, entry and exit."""
    return stored.select(
        *KEYS, "lo", "hi", (F.col("hi") - F.col("lo")).alias("qty_micro"), "entry_sign", "entry", "exit",
        F.col("exit").isNotNull().alias("matched"),
        (F.col("entry_sign") * (F.col("exit.norm_price") - F.col("entry.norm_price"))).alias("pnl_per_token"),
        (F.col("hi") - F.col("entry.open_from")).alias("closed_upto"),
    )


def realized_matches(segments: DataFrame) -> DataFrame:
    """One row per matched piece: entry, exit, quantity and profit per token."""
    return segments.filter("matched").select(
        *KEYS,
        F.when(F.col("entry_sign") == 1, "BUY").otherwise("SELL").alias("entry_side"), "entry_sign",
        F.col("entry.trade_id").alias("entry_trade_id"), F.col("entry.role_no").alias("entry_role_no"),
        F.col("entry.ts").alias("entry_time"), F.col("entry.norm_price").alias("entry_price"),
        F.col("exit.trade_id").alias("exit_trade_id"), F.col("exit.role_no").alias("exit_role_no"),
        F.col("exit.ts").alias("exit_time"), F.col("exit.norm_price").alias("exit_price"),
        "qty_micro", (F.col("qty_micro") / MICRO).alias("matched_tokens"),
        F.col("pnl_per_token").alias("raw_realized_pnl_per_token"),
    )


DERISK_THRESHOLDS = (0.25, 0.375, 0.5, 0.75, 1.0)


def derisk_name(threshold: float) -> str:
    return f"derisk_{threshold}".replace(".", "p")


def build_lots(segments: DataFrame, thresholds=DERISK_THRESHOLDS, names: bool = True) -> DataFrame:
    """One row per lot: size, what is left of it, and when each share of it was closed.

    Without ``names`` the ids of the entries, which name the lots, are neither moved nor returned.
    """
    of = {"entry_time": "ts", "entry_price": "norm_price", "original_micro": "opened"}
    of = {"trade_id": "trade_id", "role_no": "role_no"} | of if names else of
    # the entry's number tells lots of a (market, wallet) apart, the rest follows from it
    keys = [*KEYS, F.col("entry.seq").alias("_seq"), *[F.col(f"entry.{c}").alias(n) for n, c in of.items()]]
    reached = [
        F.min(F.when(F.col("matched") & (F.col("closed_upto") >= F.col("entry.opened") * t), F.col("exit.ts"))).alias(
            derisk_name(t)
        )
        for t in thresholds
    ]
    lots = segments.groupBy(*keys).agg(
        F.first("entry_sign").alias("side_sign"),
        F.sum(F.when(~F.col("matched"), F.col("qty_micro")).otherwise(0)).alias("remaining_micro"),
        *reached,
    )
    return lots.select(*KEYS, *of, "remaining_micro", "side_sign", *[derisk_name(t) for t in thresholds])


def close_events(segments: DataFrame) -> DataFrame:
    """Lot closings in order, with what remained of the lot after each."""
    return segments.filter("matched").select(
        *KEYS, F.col("entry.trade_id").alias("lot_trade_id"), F.col("entry.role_no").alias("lot_role_no"),
        F.col("exit.ts").alias("time"), F.col("exit.norm_price").alias("price"),
        (F.col("qty_micro") / MICRO).alias("tokens"),
        ((F.col("entry.opened") - F.col("closed_upto")) / MICRO).alias("remaining_after"),
    )


def open_lots(segments: DataFrame) -> DataFrame:
    """Units still open at the end, one row per lot, short quantities negative."""
    return segments.filter(~F.col("matched")).select(
        *KEYS, F.col("entry.trade_id").alias("trade_id"), F.col("entry.role_no").alias("role_no"),
        (F.col("entry_sign") * F.col("qty_micro")).alias("signed_qty_micro"),
        F.col("entry.norm_price").alias("price"),
    )


def lot_intervals(segments: DataFrame) -> DataFrame:
    """Every lot piece with the trades between which it was open.

    ``[from_seq, until_seq)`` counts trades of the (market, wallet); a piece that is
    never closed has no end. This is the linear form of "open lots after each trade".
    """
    return segments.select(
        *KEYS, F.col("entry.seq").alias("from_seq"), F.col("exit.seq").alias("until_seq"),
        (F.col("entry_sign") * F.col("qty_micro") / MICRO).alias("qty"), F.col("entry.norm_price").alias("price"),
    )


def pnl_timeline(ledger: DataFrame, segments: DataFrame, cells: Cells | None = None) -> DataFrame:
    """Realized profit, position, cost basis and average entry price after each trade."""
    signed = F.col("entry_sign") * F.col("qty_micro")
    effects = segments.select(
        *KEYS,
        F.inline(F.array(
            F.struct(
                F.col("entry.seq").alias("seq"), (signed * F.col("entry.norm_price")).alias("d_cost"),
                F.lit(None).cast("double").alias("d_pnl"),
            ),
            F.struct(
                F.col("exit.seq").alias("seq"), (-signed * F.col("entry.norm_price")).alias("d_cost"),
                (F.col("qty_micro") * F.col("pnl_per_token")).alias("d_pnl"),
            ),
        )),
    ).filter(F.col("seq").isNotNull())
    per_trade = effects.groupBy(*KEYS, "seq").agg(F.sum("d_cost").alias("d_cost"), F.sum("d_pnl").alias("d_pnl"))
    base = ledger.select(
        *KEYS, "seq", *TRADE_ORDER, "norm_side", "norm_price", "token_micro", "inventory",
        *[c for c in ("_cell",) if c in ledger.columns],
    )
    df = base.join(per_trade, [*KEYS, "seq"], "left").fillna(0.0, ["d_cost", "d_pnl"])
    df = scan(
        df, KEYS, TRADE_ORDER, running={"cost": ("sum", F.col("d_cost")), "pnl": ("sum", F.col("d_pnl"))}, cells=cells
    )
    position = F.col("inventory") / MICRO
    basis = F.when(F.col("inventory") == 0, F.lit(0.0)).otherwise(F.col("cost") / MICRO)
    return df.select(
        *KEYS, *TRADE_ORDER, "norm_side", "norm_price", (F.col("token_micro") / MICRO).alias("qty"),
        (F.col("d_pnl") / MICRO).alias("realized_pnl_this_trade"),
        (F.col("pnl") / MICRO).alias("cumulative_realized_pnl"),
        position.alias("position_qty"), basis.alias("position_cost_basis"),
        F.when(F.col("inventory") != 0, F.col("cost") / F.col("inventory")).alias("avg_entry_price"),
    )


def require_no_short(ledger: DataFrame) -> DataFrame:
    """The ledger, failing the job on the first sale beyond the long inventory."""
    fail = F.raise_error(F.concat(F.lit("normalized SELL exceeds long inventory at "), F.col("trade_id")))
    return ledger.filter(F.when(F.col("inventory") >= 0, F.lit(True)).otherwise(fail.cast("boolean")))


# -------------------------------------------------------------------- features

def _early(ts: Column, start: Column, end: Column, frac: float) -> Column:
    return ts <= start + frac * (end - start)


def realized_features(segments: DataFrame, markets: DataFrame, early_frac: float = 0.5, heavy: DataFrame | None | object = COUNT) -> DataFrame:
    """Realized profit per (market, wallet): totals, rates per closing trade and early copies."""
    piece = F.col("qty_micro") * F.col("pnl_per_token")
    per_trade = segments.filter("matched").groupBy(*KEYS, F.col("exit.seq").alias("seq"), F.col("exit.ts").alias("ts")).agg(
        F.sum(piece).alias("pnl"), F.sum("qty_micro").alias("matched")
    )
    bounds = markets.select(F.col("slug").alias(KEYS[0]), "start_ts", "end_ts")
    t = join_dimension(per_trade, bounds, KEYS[0], F.col("wallet"), heavy).withColumn("early", _early(F.col("ts"), F.col("start_ts"), F.col("end_ts"), early_frac))
    cols = []
    for tag, cond in (("", F.lit(True)), ("early_", F.coalesce(F.col("early"), F.lit(False)))):
        pnl, matched = F.sum(F.when(cond, F.col("pnl"))), F.sum(F.when(cond, F.col("matched")))
        n = F.count_if(cond)
        some = n > 0
        wins = F.count_if(cond & (F.round("pnl", 3) > 0))
        cols += [
            F.when(some, pnl / MICRO).alias(f"{tag}realized_pnl_total"),
            F.when(some, ratio(pnl / MICRO, n)).alias(f"{tag}realized_pnl_per_closing_trade"),
            F.when(some, ratio(pnl, matched)).alias(f"{tag}realized_pnl_per_matched_token"),
            F.when(some, n.cast("double")).alias(f"{tag}n_closing_trades_with_realization"),
            F.when(some, matched / MICRO).alias(f"{tag}matched_tokens_realized"),
            F.when(some, ratio(wins, n)).alias(f"{tag}realized_win_rate_closing_trades"),
        ]
    return t.groupBy(*KEYS).agg(*cols)


def unrealized_features(segments: DataFrame, market_facts: DataFrame, heavy: DataFrame | None | object = COUNT) -> DataFrame:
    """Edge of the open units against settlement, per gross token ever traded.

    ``market_facts`` carries outcome, price_min and price_max per market. Gross
    tokens follow from the segments themselves: a matched unit was traded twice.
    """
    m = market_facts.select(KEYS[0], "outcome", (F.col("price_max") - F.col("price_min")).alias("range"))
    open_ = ~F.col("matched")
    edge = ratio(F.col("outcome") - F.col("entry.norm_price"), F.col("range")) * F.col("entry_sign")
    g = join_dimension(segments, m, KEYS[0], F.col("wallet"), heavy).groupBy(*KEYS).agg(
        F.sum(F.when(open_, F.col("qty_micro") * edge).otherwise(0.0)).alias("lin"),
        F.sum(F.when(open_, F.sqrt(F.col("qty_micro").cast("double")) * edge).otherwise(0.0)).alias("root"),
        F.sum(F.when(open_, F.col("qty_micro")).otherwise(F.col("qty_micro") * 2)).alias("gross"),
        F.sum(F.when(open_, F.col("qty_micro") * F.col("entry_sign")).otherwise(0)).alias("open_micro"),
        F.max("outcome").alias("outcome"), F.max("range").alias("range"),
    )
    # a flat price has no range to normalize by
    known = F.col("outcome").isNotNull() & ((F.col("range") > 0) | (F.col("open_micro") == 0))
    return g.select(
        *KEYS,
        F.when(known, ratio(F.col("lin"), F.col("gross"))).alias("unrealized_edge_per_open_token"),
        F.when(known, F.col("root") / F.sqrt(F.col("gross").cast("double"))).alias("unrealized_edge_per_open_token_sqrt"),
        (F.col("open_micro") / MICRO).alias("open_position_qty"),
    )
