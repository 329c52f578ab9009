"""Behavioural features per (market, wallet).

Inputs are shared frames built once for all wallets: the ledger (trades with running
state), the per-second price lookups, the per-market facts and the lots. Every family
is one or two hash aggregations on (market, wallet); partial aggregation runs before
each shuffle, so a wallet or market of any size adds rows to map-side buffers only.
Exact medians are the exception and switch plans when groups are split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fillsight.functions.scalar import (
    fraction_tag, grid_tag, negative_part, positive_part, price_weight, relative_gap, time_position, time_remaining,
)
from fillsight.operators.history import FIXED_HORIZONS, GRID_FRACS, price_percentile
from fillsight.operators.ledger import DERISK_THRESHOLDS, derisk_name
from fillsight.operators.scan import COUNT, Cells, join_dimension, percentiles, scan
from fillsight.schema import MARKET, MARKET_WALLET, MICRO, TRADE_ORDER, ratio
from fillsight.session import materialize

KEYS = list(MARKET_WALLET)
MOMENTUM_PENALTY = 0.10
CONTRARIAN_REWARD = 0.30
REALIZED_ALPHAS = (0.25, 0.50, 1.00)


def _buy() -> Column:
    return F.col("is_buy")


def _sell() -> Column:
    return ~F.col("is_buy")


def _sum_if(cond: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0))


def _frac(num: Column, den: Column, empty: float | None = None) -> Column:
    """num / den where den > 0, else ``empty``."""
    out = F.when(den > 0, ratio(num, den))
    return out if empty is None else out.otherwise(F.lit(empty))


def herfindahl(df: DataFrame, keys: Sequence[str], group: Column, value: str, out: str = "hhi") -> DataFrame:
    """Concentration: sum of squared shares of ``value`` over the groups inside ``keys``."""
    parts = df.groupBy(*keys, group.alias("_g")).agg(F.sum(value).cast("double").alias("_v"))
    total = F.sum("_v")
    return parts.groupBy(*keys).agg(_frac(F.sum(F.col("_v") * F.col("_v")), total * total).alias(out))


# ----------------------------------------------------------------------- entry

def entry_features(
    ledger: DataFrame, lookups: DataFrame, facts: DataFrame, history: DataFrame, bin_sec: int = 3600, max_rows: int | None = None,
    heavy: DataFrame | None | object = COUNT, few: bool = False,
) -> DataFrame:
    """When and how the wallet first bought; one row per wallet that bought at all.

    ``facts`` carries start_ts, end_ts and major_move_time; ``few`` says that a row per market fits every task. The hourly bins are
    aggregated first; their totals then give both the concentration and the span.
    """
    bins = (
        ledger.filter("is_buy")
        .groupBy(*KEYS, F.floor((F.col("ts") - F.col("first_buy_ts")) / bin_sec).alias("bin"))
        .agg(
            F.sum("cash_micro").cast("double").alias("cash"), F.min("ts").alias("t_min"), F.max("ts").alias("t_max"),
            F.sum("norm_price").alias("price_sum"), F.count("norm_price").alias("price_n"),
        )
    )
    total = F.sum("cash")
    e = bins.groupBy(*KEYS).agg(
        F.min("t_min").alias("ts"), F.max("t_max").alias("last_ts"),
        ratio(F.sum("price_sum"), F.sum("price_n")).alias("avg_price"),
        _frac(F.sum(F.col("cash") * F.col("cash")), total * total).alias("entry_concentration_hhi"),
    )
    e = e.join(lookups.select(MARKET, "ts", "trail_std", "trail_abs_step"), [MARKET, "ts"], "left")
    # an average of equal prices may miss them by rounding, hence the 1e-12
    e = e.withColumn("_probe", F.col("avg_price") + 1e-12)
    # one row per pair: written once, the split plan and the lookup both read it
    e = price_percentile(materialize(e), history, "_probe", "entry_price_percentile", max_rows, heavy, few)
    e = join_dimension(e, facts.select(MARKET, "start_ts", "end_ts", "major_move_time"), MARKET, F.col("wallet"), heavy)
    a, b = F.col("start_ts"), F.col("end_ts")
    return e.select(
        *KEYS, "entry_price_percentile",
        time_position(F.col("ts"), a, b).alias("first_entry_time_position_pct"),
        time_remaining(F.col("ts"), a, b).alias("first_entry_time_remaining_pct"),
        relative_gap(F.col("ts"), F.col("major_move_time"), a, b).alias("time_to_major_move_pct_of_market"),
        "entry_concentration_hhi",
        F.when(b > a, ratio(F.col("last_ts") - F.col("ts"), b - a)).alias("entry_span_pct_of_market"),
        F.col("trail_std").alias("pre_entry_price_std"), F.col("trail_abs_step").alias("pre_entry_abs_return_mean"),
    )


# ---------------------------------------------------------- position and holding

HOLDING = (
    "net_directional_consistency", "buy_tokens_total", "sell_tokens_total", "net_tokens", "gross_tokens",
    "max_inventory", "min_inventory", "max_abs_inventory", "outcome_alignment", "outcome_alignment_token",
)
PATH = (
    "path_alignment", "early_path_alignment", "avg_abs_position_tokens", "max_abs_position_tokens",
    "final_position_tokens", "position_flips", "position_flip_rate",
)


def with_previous_sign(ledger: DataFrame, cells: Cells | None = None) -> DataFrame:
    """Add ``prev_sign``: the sign of the last non-zero inventory before each trade."""
    inv = F.col("inventory")
    return scan(ledger, KEYS, TRADE_ORDER, previous={"prev_sign": F.when(inv != 0, F.signum(inv.cast("double")))}, cells=cells)


def position_aggs(early_frac: float = 0.5, order: Sequence[str] = TRADE_ORDER) -> dict[str, Column]:
    """Holding totals, outcome alignment and the shape of the inventory path, from trades with ``prev_sign`` and market facts.

    ``order`` tells the trades of a (market, wallet) apart, the last one being the largest.
    """
    inv = F.col("inventory")
    sign = F.when(F.col("outcome") == 1, 1).when(F.col("outcome").isNotNull(), -1)
    s = F.max(sign)
    early = F.col("ts") <= F.col("start_ts") + early_frac * (F.col("end_ts") - F.col("start_ts"))
    buy, sell = _sum_if(_buy(), "token_micro"), _sum_if(_sell(), "token_micro")
    net, gross = buy - sell, buy + sell
    flip = (inv != 0) & F.col("prev_sign").isNotNull() & (F.signum(inv.cast("double")) != F.col("prev_sign"))
    flips, nonzero = F.count_if(flip), F.count_if(inv != 0)
    known = F.max("outcome").isNotNull()
    abs_sum = F.sum(F.abs(inv))
    early_abs = F.sum(F.when(early, F.abs(inv)))
    return {
        "net_directional_consistency": _frac(net, gross),
        "buy_tokens_total": buy / MICRO, "sell_tokens_total": sell / MICRO, "net_tokens": net / MICRO, "gross_tokens": gross / MICRO,
        "max_inventory": F.max(inv) / MICRO, "min_inventory": F.min(inv) / MICRO, "max_abs_inventory": F.max(F.abs(inv)) / MICRO,
        "outcome_alignment": F.signum(net.cast("double")) * s, "outcome_alignment_token": _frac(net * s, gross),
        "path_alignment": F.when(known, _frac(F.sum(inv) * s, abs_sum)),
        "early_path_alignment": F.when(known, _frac(F.sum(F.when(early, inv)) * s, early_abs)),
        "avg_abs_position_tokens": F.when(known, ratio(abs_sum, F.count("*")) / MICRO),
        "max_abs_position_tokens": F.when(known, F.max(F.abs(inv)) / MICRO),
        "final_position_tokens": F.when(known, F.max_by("inventory", F.struct(*order)) / MICRO),
        "position_flips": F.when(known, F.when(nonzero >= 2, flips.cast("double")).otherwise(0.0)),
        "position_flip_rate": F.when(known, F.when(nonzero >= 2, ratio(flips, nonzero - 1)).otherwise(0.0)),
    }


def position_features(
    ledger: DataFrame, facts: DataFrame, cells: Cells | None = None, early_frac: float = 0.5, heavy: DataFrame | None | object = COUNT
) -> DataFrame:
    """``position_aggs`` of every (market, wallet)."""
    df = ledger if "prev_sign" in ledger.columns else with_previous_sign(ledger, cells)
    df = df.select(*KEYS, *TRADE_ORDER, "is_buy", "token_micro", "inventory", "prev_sign")
    df = join_dimension(df, facts.select(MARKET, "outcome", "start_ts", "end_ts"), MARKET, F.col("wallet"), heavy)
    return aggregate_family(df, position_aggs(early_frac))


# -------------------------------------------------------------------- markouts

def building(before: Column) -> Column:
    """Whether a trade builds on the position ``before`` it; markouts of others are not scored."""
    return F.when(_buy(), before >= 0).otherwise(before <= 0)


def with_scores(trades: DataFrame, fracs: Sequence[float] = GRID_FRACS, tags: set[str] | None = None) -> DataFrame:
    """Adjusted markout score of every position-building trade, one column per grid point.

    ``trades`` is the ledger joined with lookups and facts.
    """
    p = F.col("norm_price")
    usable = (F.col("h_rows") >= 2) & (F.col("life") > 0)
    builds = usable & building(F.col("inventory_before"))
    df = trades.withColumn("builds", builds).withColumn(
        "weight", F.when(_buy(), price_weight(p)).otherwise(price_weight(1 - p))
    )
    cols = []
    for i, h in enumerate(fracs):
        for j, lb in enumerate(fracs):
            tag = grid_tag(h, lb)
            if tags is not None and tag not in tags:
                continue
            post, pre = F.col(f"fut{i}") - p, p - F.col(f"past{j}")
            up, down = positive_part(pre), negative_part(pre)
            score = F.when(
                _buy(), F.col("weight") * post - MOMENTUM_PENALTY * up + CONTRARIAN_REWARD * down
            ).otherwise(F.col("weight") * -post - MOMENTUM_PENALTY * down + CONTRARIAN_REWARD * up)
            cols.append(F.when(F.col("builds"), score).alias(f"score_{tag}"))
    return df.select("*", *cols)


def grid_tags(fracs: Sequence[float] = GRID_FRACS) -> list[str]:
    return [grid_tag(h, lb) for h in fracs for lb in fracs]


def markout_aggs(fracs: Sequence[float] = GRID_FRACS, tags: set[str] | None = None) -> tuple[dict[str, Column], dict[str, Column]]:
    """Means and gross-weighted means of the scores per side and grid point, and the values whose medians are wanted."""
    usable = F.max((F.col("h_rows") >= 2) & (F.col("life") > 0))
    gross = F.sum("token_micro")
    aggs, med = {}, {}
    for tag in grid_tags(fracs):
        if tags is not None and tag not in tags:
            continue
        s = F.col(f"score_{tag}")
        for side, cond in (("buy", _buy()), ("sell", _sell())):
            value = F.when(cond, s)
            aggs[f"{side}_markout_adj_mean_{tag}"] = F.avg(value)
            weighted = F.coalesce(ratio(F.sum(value * F.col("token_micro")), gross), F.lit(0.0))
            aggs[f"{side}_markout_adj_grosswt_{tag}"] = F.when(usable, weighted)
            med[f"{side}_markout_adj_median_{tag}"] = value
    return aggs, med


def fixed_markout_aggs(horizons: Sequence[int] = FIXED_HORIZONS) -> tuple[dict[str, Column], dict[str, Column]]:
    """Means of plain markouts per side and horizon, and the values whose medians are wanted."""
    aggs, med = {}, {}
    for h in horizons:
        move = F.col(f"fix{h}") - F.col("norm_price")
        for side, value in (("buy", F.when(_buy(), move)), ("sell", F.when(_sell(), -move))):
            aggs[f"{side}_markout_mean_{h}s"] = F.avg(value)
            med[f"{side}_markout_median_{h}s"] = value
    return aggs, med


def markout_features(
    trades: DataFrame, fracs: Sequence[float] = GRID_FRACS, tags: set[str] | None = None, split: bool = False, tasks: int | None = None,
    placed: bool = False,
) -> DataFrame:
    """Adjusted markouts: mean, median and gross-weighted, per side and grid point."""
    return with_medians(with_scores(trades, fracs, tags), *markout_aggs(fracs, tags), split, tasks, placed)


def fixed_markout_features(
    trades: DataFrame, horizons: Sequence[int] = FIXED_HORIZONS, split: bool = False, tasks: int | None = None, placed: bool = False
) -> DataFrame:
    """Plain markouts at fixed horizons: mean and median per side."""
    return with_medians(trades, *fixed_markout_aggs(horizons), split, tasks, placed)


def _medians_of_lists(names: Sequence[str]) -> Callable:
    """Column function from lists of structs to the medians of their fields, NULL where a group has no value."""
    import pyarrow as pa

    def medians(lists: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        group = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        fields, cols = dict(zip(names, lists.flatten().flatten())), []
        for n in names:
            there = np.asarray(fields[n].is_valid())
            g, v = group[there], fields[n].drop_null().to_numpy()
            # by group, then value; NaN comes last, as in a sorted array of the engine
            v = v[np.lexsort((v, g))]
            size = np.bincount(g, minlength=len(lists))
            some, start = size > 0, np.cumsum(size) - size
            out = np.zeros(len(lists))
            low, high = start[some] + (size[some] - 1) // 2, start[some] + size[some] // 2
            out[some] = (v[low] + v[high]) / 2
            cols.append(pa.array(out, mask=~some))
        return pa.StructArray.from_arrays(cols, names=list(names))

    medians.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(medians, T.StructType([T.StructField(n, T.DoubleType()) for n in names]))


# Rows whose values a task sorts at once for medians, and the rows of one group from which ranks are counted instead.
MEDIAN_TASK_ROWS = 50_000
MEDIAN_GROUP_ROWS = 250_000


def by_wallet(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deal the rows by (market, wallet); over no fewer tasks than other shuffles, so that joins leave the result in place."""
    if not tasks:
        return df.repartition(*KEYS)
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *KEYS)


def with_medians(
    df: DataFrame, aggs: dict[str, Column], med: dict[str, Column], split: bool, tasks: int | None = None, placed: bool = False
) -> DataFrame:
    """One row per (market, wallet) with ``aggs`` and the exact medians of ``med``.

    A task keeps the values of all its groups, so ``tasks`` should grow with the rows; unset, the engine decides.
    ``placed`` says that ``by_wallet`` has dealt the rows.
    """
    if not split:
        return medians_of_values(with_values(df if placed else by_wallet(df, tasks), aggs, med), med)
    # over-full groups: one row per (wallet, measure, value), exact ranks by counting
    long = df.select(
        *KEYS, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in med.items()]))
    ).filter(F.col("value").isNotNull())
    m = percentiles(long, [*KEYS, "name"], "value", {"m": 0.5}, split=True)
    wide = m.groupBy(*KEYS).agg(*[F.max(F.when(F.col("name") == n, F.col("m"))).alias(n) for n in med])
    return df.groupBy(*KEYS).agg(*[c.alias(n) for n, c in aggs.items()]).join(wide, KEYS, "left")


def with_values(df: DataFrame, aggs: dict[str, Column], med: dict[str, Column]) -> DataFrame:
    """One row per (market, wallet) with ``aggs`` and the values of ``med``, which travel as one list ``_values``."""
    values = F.collect_list(F.struct(*[v.cast("double").alias(n) for n, v in med.items()]))
    return df.groupBy(*KEYS).agg(*[c.alias(n) for n, c in aggs.items()], values.alias("_values"))


def medians_of_values(lists: DataFrame, names: Iterable[str]) -> DataFrame:
    """Replace ``_values`` by the medians of its fields, sorted column by column."""
    found = lists.withColumn("_values", _medians_of_lists(list(names))(F.col("_values")))
    return found.select(*[c for c in lists.columns if c != "_values"], "_values.*")


# --------------------------------------------------------- contrarian and extreme

def contrarian_aggs(flat: float = 0.03) -> dict[str, Column]:
    """Cash shares at low / high prices and against the trailing trend."""
    p, move = F.col("norm_price"), F.col("trend_move")
    low, high = p <= F.col("p25"), p >= F.col("p75")
    label = F.when(move > flat, "up").when(move < -flat, "down").when(move.isNotNull(), "flat")
    buy_against = _buy() & F.coalesce(label.isin("flat", "down"), F.lit(False))
    sell_against = _sell() & F.coalesce(label.isin("flat", "up"), F.lit(False))
    cash = F.sum("cash_micro")
    buy, sell = _sum_if(_buy(), "cash_micro"), _sum_if(_sell(), "cash_micro")
    return {
        "cash_at_low_price_frac": _frac(_sum_if(low, "cash_micro"), cash),
        "buy_cash_at_low_price_frac": _frac(_sum_if(_buy() & low, "cash_micro"), buy),
        "sell_cash_at_high_price_frac": _frac(_sum_if(_sell() & high, "cash_micro"), sell),
        "cash_against_recent_trend_frac": _frac(_sum_if(buy_against | sell_against, "cash_micro"), cash),
        "buy_cash_against_recent_downtrend_frac": _frac(_sum_if(buy_against, "cash_micro"), buy),
        "sell_cash_against_recent_uptrend_frac": _frac(_sum_if(sell_against, "cash_micro"), sell),
        "recent_trend_mean_for_buys": F.avg(F.when(_buy(), move)),
        "recent_trend_mean_for_sells": F.avg(F.when(_sell(), move)),
    }


def extreme_aggs(low: float = 0.10, high: float = 0.90) -> dict[str, Column]:
    """Cash shares of building trades at extreme prices, by fixed and by percentile bounds."""
    p, before = F.col("norm_price"), F.col("inventory_before")
    cash = F.sum("cash_micro")
    buy, sell = _sum_if(_buy(), "cash_micro"), _sum_if(_sell(), "cash_micro")
    lo, hi = _buy() & (p <= low), _sell() & (p >= high)
    lo_b, hi_b = lo & (before >= 0), hi & (before <= 0)
    lo_p = _buy() & (p <= F.col("p10")) & (before >= 0)
    hi_p = _sell() & (p >= F.col("p90")) & (before <= 0)
    share = lambda cond, den: _frac(_sum_if(cond, "cash_micro"), den, 0.0)
    return {
        "low_buy_cash_frac_leq_0p1": share(lo, buy),
        "high_sell_cash_frac_geq_0p9": share(hi, sell),
        "low_buy_building_cash_frac": share(lo_b, buy),
        "high_sell_nonflattening_cash_frac": share(hi_b, sell),
        "extreme_trade_nonflattening_cash_frac": share(lo_b | hi_b, cash),
        "low_buy_building_cash_frac_pctl10": share(lo_p, buy),
        "high_sell_nonflattening_cash_frac_pctl90": share(hi_p, sell),
        "extreme_trade_nonflattening_cash_frac_pctl": share(lo_p | hi_p, cash),
        "n_low_buy_building_trades_pctl10": F.count_if(lo_p),
        "n_high_sell_nonflattening_trades_pctl90": F.count_if(hi_p),
        "n_low_buy_building_trades": F.count_if(lo_b),
        "n_high_sell_nonflattening_trades": F.count_if(hi_b),
        "low_buy_high_sell_pctl": (share(hi_p, sell) + share(lo_p, buy)) / 2,
    }


def aggregate_family(trades: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    return trades.groupBy(*KEYS).agg(*[c.alias(n) for n, c in aggs.items()])


def day_features(ledger: DataFrame, facts: DataFrame, heavy: DataFrame | None | object = COUNT) -> DataFrame:
    """Active UTC days per side, cash concentration over days, share of market days active."""
    days = ledger.groupBy(*KEYS, F.expr("ts div 86400").alias("day")).agg(
        F.count_if(_buy()).alias("nb"), F.count_if(_sell()).alias("ns"),
        _sum_if(_buy(), "cash_micro").cast("double").alias("cb"),
        _sum_if(_sell(), "cash_micro").cast("double").alias("cs"),
    )
    hhi = lambda c: _frac(F.sum(c * c), F.sum(c) * F.sum(c))
    d = days.groupBy(*KEYS).agg(
        F.count_if(F.col("nb") > 0).alias("n_distinct_buy_days"),
        F.count_if(F.col("ns") > 0).alias("n_distinct_sell_days"),
        F.count("*").alias("n_distinct_active_days"),
        hhi(F.col("cb")).alias("buy_day_concentration_hhi"),
        hhi(F.col("cs")).alias("sell_day_concentration_hhi"),
        hhi(F.col("cb") + F.col("cs")).alias("active_day_concentration_hhi"),
    )
    span = facts.select(MARKET, F.expr("h_end div 86400 - h_start div 86400 + 1").alias("_days"))
    return join_dimension(d, span, MARKET, F.col("wallet"), heavy).withColumn(
        "active_day_frac", ratio(F.col("n_distinct_active_days"), F.greatest(F.col("_days"), F.lit(1)))
    ).drop("_days")


# -------------------------------------------------------------------- adaptive

def lot_markouts(
    lots: DataFrame, lookups: DataFrame, facts: DataFrame, fracs: Sequence[float] = GRID_FRACS, heavy: DataFrame | None | object = COUNT
) -> DataFrame:
    """Range-normalized markout of each lot with open units, per horizon (``mv0``…).

    The horizon ends no earlier than the time a quarter of the lot was closed and no
    later than the time half of it was; lots never reduced that far run to the end.
    Prices at those times are trade seconds, so they come from the shared lookups.
    """
    f = facts.select(
        MARKET, "h_start", "h_end", "life", "last_price", "terminal_start_ts", (F.col("price_max") - F.col("price_min")).alias("range")
    )
    d25, d50 = F.col(derisk_name(0.25)), F.col(derisk_name(0.5))
    at = lambda name: lookups.select(MARKET, F.col("ts").alias(f"{name}_ts"), F.col("price_at").alias(f"{name}_price"))
    futures = lookups.select(MARKET, F.col("ts").alias("entry_time"), *[f"fut{i}" for i in range(len(fracs))])
    open_ = lots.filter(F.col("remaining_micro") > 0).withColumn("d25_ts", d25).withColumn("d50_ts", d50)
    x = (
        open_.join(futures, [MARKET, "entry_time"], "left")
        .join(at("d25"), [MARKET, "d25_ts"], "left")
        .join(at("d50"), [MARKET, "d50_ts"], "left")
    )
    x = join_dimension(x, f, MARKET, F.col("wallet"), heavy)
    cap_ts = F.coalesce(F.col("d50_ts"), F.col("h_end"))
    cap_price = F.when(F.col("d50_ts").isNotNull(), F.col("d50_price")).otherwise(F.col("last_price"))
    cols = []
    for i, h in enumerate(fracs):
        t = F.col("entry_time") + h * F.col("life")
        inner_ts = F.least(t, cap_ts.cast("double"))
        inner_price = F.when(t <= cap_ts, F.col(f"fut{i}")).otherwise(cap_price)
        future = (
            F.when(F.col("d25_ts").isNull(), F.col("last_price"))
            .when(F.col("d25_ts") >= inner_ts, F.col("d25_price"))
            .otherwise(inner_price)
        )
        cols.append(ratio(F.col("side_sign") * (future - F.col("entry_price")), F.col("range")).alias(f"mv{i}"))
    names = [c for c in ("trade_id", "role_no") if c in lots.columns]
    return x.select(*KEYS, *names, "entry_time", "remaining_micro", "terminal_start_ts", F.col("d25_ts").isNull().alias("held"), *cols)


def adaptive_features(
    lots: DataFrame, segments: DataFrame, lookups: DataFrame, facts: DataFrame,
    fracs: Sequence[float] = GRID_FRACS, thresholds: Sequence[float] = DERISK_THRESHOLDS, spike_lambda: float = 1.0,
    heavy: DataFrame | None | object = COUNT,
) -> DataFrame:
    """Lot-level markouts, realized edge and closing times per (market, wallet).

    ``facts`` carries the history bounds, price range and terminal_start_ts.
    """
    f = facts.select(
        MARKET, "h_start", "life", "h_rows", "terminal_start_ts", (F.col("price_max") - F.col("price_min")).alias("range")
    )
    mk = lot_markouts(lots, lookups, facts, fracs, heavy)
    w = F.col("remaining_micro")
    late = F.coalesce(F.col("entry_time") >= F.col("terminal_start_ts"), F.lit(False))
    aggs = [F.sum(F.when(F.col("held"), w).otherwise(0)).alias("held"), F.sum(F.when(late, w).otherwise(0)).alias("late")]
    for i in range(len(fracs)):
        mv = F.col(f"mv{i}")
        aggs += [
            F.sum(w * mv).alias(f"raw{i}"), F.sum(w * F.abs(mv)).alias(f"abs{i}"),
            F.sum(F.when(late, w * positive_part(mv)).otherwise(0.0)).alias(f"spike{i}"),
        ]
    m = mk.groupBy(*KEYS).agg(*aggs)
    pos = lambda t: ratio(F.col(derisk_name(t)) - F.col("h_start"), F.col("life"))
    size = F.col("original_micro")
    der = []
    for t in thresholds:
        n, hit = derisk_name(t), F.col(derisk_name(t)).isNotNull()
        der += [
            F.avg(pos(t)).alias(f"{n}_time_position_mean"),
            ratio(F.sum(F.when(hit, size * pos(t))), F.sum(F.when(hit, size))).alias(f"{n}_time_position_tokenwt"),
            F.sum(F.when(hit, size).otherwise(0)).alias(f"{n}_hit"),
        ]
    # a matched unit was traded twice, an open one once
    gross = F.sum(size * 2 - F.col("remaining_micro")).alias("gross")
    lot_side = join_dimension(lots, f, MARKET, F.col("wallet"), heavy).groupBy(*KEYS).agg(
        gross, F.max("life").alias("life"), F.max("h_rows").alias("h_rows"), F.max("range").alias("range"),
        F.max("h_start").alias("h_start"), F.max("terminal_start_ts").alias("terminal_start_ts"), *der,
    )
    piece = F.when(F.col("matched"), F.col("qty_micro"))
    real = segments.groupBy(*KEYS).agg(
        F.coalesce(F.sum(piece * F.col("pnl_per_token")), F.lit(0.0)).alias("pnl"),
        F.coalesce(F.sum(piece), F.lit(0)).alias("matched"),
    )
    x = lot_side.join(real, KEYS).join(m, KEYS, "left")
    g = F.col("gross")
    usable = (F.col("life") > 0) & (F.col("h_rows") >= 2)
    scaled = usable & ((F.col("range") > 0))
    zero = lambda c: F.coalesce(ratio(F.col(c), g), F.lit(0.0))
    edge = F.when(scaled, ratio(ratio(F.col("pnl"), F.col("range")), g))
    out = {
        "terminal_start_ts": F.when(usable, F.col("terminal_start_ts").cast("double")),
        "terminal_start_time_position": F.when(usable, ratio(F.col("terminal_start_ts") - F.col("h_start"), F.col("life"))),
        "realized_edge_grosswt": edge,
        "realized_raw_pnl_grosswt": F.when(usable, ratio(F.col("pnl"), g)),
        "realized_token_frac": F.when(usable, ratio(F.col("matched"), g)),
    }
    for t in thresholds:
        n = derisk_name(t)
        out[f"{n}_time_position_mean"] = F.col(f"{n}_time_position_mean")
        out[f"{n}_time_position_tokenwt"] = F.col(f"{n}_time_position_tokenwt")
        out[f"{n}_token_frac"] = F.when(usable, ratio(F.col(f"{n}_hit"), g))
    for i, h in enumerate(fracs):
        tag = f"h{fraction_tag(h)}"
        raw, spike = F.when(scaled, zero(f"raw{i}")), F.when(scaled, zero(f"spike{i}"))
        adj = raw - spike_lambda * spike
        out[f"adaptive_markout_raw_grosswt_{tag}"] = raw
        out[f"adaptive_markout_abs_grosswt_{tag}"] = F.when(scaled, zero(f"abs{i}"))
        out[f"adaptive_late_spike_edge_grosswt_{tag}"] = spike
        out[f"adaptive_late_spike_token_frac_{tag}"] = F.when(usable, zero("late"))
        out[f"adaptive_held_to_end_token_frac_{tag}"] = F.when(usable, zero("held"))
        out[f"adaptive_markout_latespike_adj_grosswt_{tag}"] = adj
        for a in REALIZED_ALPHAS:
            at = str(a).replace(".", "p")
            out[f"adaptive_plus_realized_alpha{at}_{tag}"] = adj + a * edge
            out[f"adaptive_minus_realized_alpha{at}_{tag}"] = adj - a * edge
    return x.select(*KEYS, *[c.alias(n) for n, c in out.items()])
