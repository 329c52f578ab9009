"""Registered queries on scans, parsing, joins, lots, series and rankings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fillsight import fixtures as X
from fillsight.functions import scalar as S
from fillsight.operators import asof as A, behavior as B, dataset as D, history as H, ledger as L, parsing as P
from fillsight.plans import report as R
from fillsight.schema import MARKET, MICRO
from fillsight.session import materialize, shared_folder
from fillsight.sources import documents as SD, fills as SF, markets as SM, tables as ST, wallets as SW
from registry.core import context, query, r

NOW = 1_706_659_200  # stands in for the current time


# ---------------------------------------------------------------- scans, sources

@query
def fills_time_asset_scan(spark, sf):
    f = SF.scan_fills(X.fills(spark, sf), ["m1-Y", "m2-N"], 1_704_500_000, 1_705_500_000)
    return f.select("id", "timestamp", "maker", "taker", "makerAssetId", "takerAssetId")


@query
def fills_tagged_legs(spark, sf):
    return SF.tagged_fills(X.fills(spark, sf), X.markets(spark, sf)).select("id", "query_side", "queried_token_id")


@query
def fills_source_fallback(spark, sf):
    f = X.fills(spark, sf)
    primary = f.filter(F.col(MARKET) < "m3")
    return SF.with_fallback(primary, f).select("id", MARKET, "timestamp")


def user_trades(spark, sf):
    """User-side trade records as a secondary source would list them."""
    e = X.base_events(spark, sf)
    return e.select(
        F.concat(F.lit("W"), F.col("user_id")).alias("proxyWallet"),
        F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("side"),
        F.concat(F.lit("asset-number-"), F.col("event_id")).alias("asset"),
        F.col("value").alias("size"), F.lit(0.25).alias("price"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("t"), F.col("event_id")).alias("transactionHash"),
    )


@query
def secondary_fill_mapping(spark, sf):
    return SF.secondary_to_fills(user_trades(spark, sf))


def raw_markets(spark, sf):
    """Market documents with text-typed fields, one per user group of events."""
    g = X.base_events(spark, sf).groupBy((F.col("user_id") % 50).alias("g")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    iso = lambda c, tail: F.concat(F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(tail))
    slug = F.concat(F.lit("raw-"), F.col("g"))
    return g.select(
        slug.alias("slug"),
        F.when(F.col("g") % 5 == 0, F.lit("Solo")).otherwise(F.lit('["Yes", "No"]')).alias("outcomes"),
        F.when(F.col("g") % 5 == 0, slug).otherwise(F.concat(F.lit('["'), slug, F.lit('-Y","'), slug, F.lit('-N"]'))).alias("clobTokenIds"),
        F.when(F.col("g") % 3 == 0, F.lit("")).otherwise(iso("a", "Z")).alias("acceptingOrdersTimestamp"),
        iso(F.col("a") - 3600, "+00").alias("startDate"),
        F.when(F.col("g") % 4 == 0, "false").otherwise("True").alias("closed"),
        iso("b", "+0000").alias("closedTime"),
        F.when(F.col("g") % 7 == 0, F.lit("[]")).otherwise(F.lit('["1", "0"]')).alias("outcomePrices"),
    )


@query
def market_dimension(spark, sf):
    m = SM.parse_markets(raw_markets(spark, sf), NOW)
    return m.select(
        "slug", F.array_join("outcomes", "|").alias("outcomes"), "yes_token_id", "no_token_id", "start_ts", "end_ts", "closed",
        F.size("outcome_prices").cast("bigint").alias("n_prices"),
        S.final_outcome(F.col("closed"), F.col("outcome_prices")).alias("final_outcome"),
    )


def _land_documents(docs, name):
    """One JSON document per file, in a folder named by its key."""
    path = _folder(docs.sparkSession, name)
    docs.select("key", "body").repartition(4, "key").write.partitionBy("key").text(path)
    return path


def _read_landed(spark, path):
    return SD.read_documents(spark, f"{path}/key=*/*.txt", r"/key=([^/]+)/")


@query
def landed_markets(spark, sf):
    """Market documents whose fields change type from one to the next, with what else they say."""
    m = X.markets(spark, sf).withColumn("k", F.substring("slug", 2, 9).cast("int"))
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lists = lambda c: F.to_json(F.col(c))
    odd = F.col("k") % 2 == 1
    text = lambda body: F.concat(F.lit('"'), F.replace(body, F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = F.concat(
        F.lit('{"slug": "'), "slug", F.lit('", "outcomes": '), F.when(odd, lists("outcomes")).otherwise(text(lists("outcomes"))),
        F.lit(', "clobTokenIds": '), F.when(odd, text(lists("token_ids"))).otherwise(lists("token_ids")),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit(', "startDate": "'), iso("start_ts"), F.lit('"')))
        .otherwise(F.concat(F.lit(', "acceptingOrdersTimestamp": "'), iso("start_ts"), F.lit('"'))),
        F.lit(', "closed": '), F.when(odd, F.lit("true")).otherwise(F.lit('"True"')), F.lit(', "closedTime": "'), iso("end_ts"), F.lit('"'),
        F.lit(', "outcomePrices": '), F.when(odd, lists("outcome_prices")).otherwise(text(lists("outcome_prices"))),
        F.lit(', "extra": {"depth": '), F.col("k").cast("string"), F.lit("}}"),
    )
    docs = m.select(F.col("slug").alias("key"), body.alias("body")).unionByName(
        spark.createDataFrame([("broken", '{"slug": '), ("empty", "{}")], "key string, body string"))
    landed = _read_landed(spark, _land_documents(docs, "markets"))
    got = SD.market_documents(landed, NOW)
    return got.select(
        "slug", F.array_join("outcomes", "|").alias("outcomes"), F.array_join("token_ids", "|").alias("token_ids"), "start_ts", "end_ts", "closed",
        F.element_at("outcome_prices", 1).alias("first_price"), SD.field("extra.depth", "int").alias("depth"),
        F.lit(SD.broken_documents(landed, "slug").count()).alias("broken"))


@query
def landed_deposits(spark, sf):
    """Deposit documents, times as numbers or text; wallets without a deposit have an empty one."""
    from registry.models import deposits

    d = deposits(spark, sf)
    time = F.when(F.col("first_deposit_ts") % 2 == 0, F.col("first_deposit_ts").cast("string")).otherwise(
        F.concat(F.lit('"'), F.col("first_deposit_ts").cast("string"), F.lit('"')))
    body = F.concat(F.lit('{"from": "'), F.upper("funder"), F.lit('", "timestamp": '), time, F.lit(', "tx_hash": "'), "tx_hash", F.lit('"}'))
    none = X.transfers(spark, sf).select(F.lower("to").alias("wallet")).distinct().join(d, "wallet", "left_anti")
    docs = d.select(F.col("wallet").alias("key"), body.alias("body")).unionByName(none.select(F.col("wallet").alias("key"), F.lit("{}").alias("body")))
    return SD.deposit_documents(_read_landed(spark, _land_documents(docs, "deposits"))).drop("raw")


@query
def landed_transfers(spark, sf):
    """Transfer documents of funders; some say that their list was cut, one is empty."""
    t = X.transfers(spark, sf).select(F.col("from").alias("funder"), "to", "ts")
    one = F.to_json(F.array_sort(F.collect_list(F.struct(F.upper("to").alias("to"), "ts"))))
    flag = F.when(F.col("funder").endswith("3"), F.lit(', "hit_cap": true')).otherwise(F.lit(""))
    docs = t.groupBy("funder").agg(one.alias("list")).select(
        F.col("funder").alias("key"), F.concat(F.lit('{"transfers": '), "list", flag, F.lit("}")).alias("body"))
    docs = docs.unionByName(spark.createDataFrame([("f-none", "{}")], "key string, body string"))
    got = SD.transfer_documents(_read_landed(spark, _land_documents(docs, "transfers")))
    return got.groupBy("funder", "to").agg(F.min("ts").alias("first_ts"), F.count("ts").alias("n"), F.bool_or("hit_cap").alias("hit_cap"))


@query
def wallet_market_order(spark, sf):
    return SM.wallet_markets(context(spark, sf).trades)


@query
def attached_markets(spark, sf):
    f = SM.attach_market(X.fills(spark, sf).drop(MARKET), X.markets(spark, sf))
    return f.groupBy(MARKET).agg(F.count("*").alias("n"), F.sum("takerAmountFilled").alias("taker_micro"))


@query
def activity_scan(spark, sf):
    a = SW.scan_activity(X.activity(spark, sf))
    return a.select("wallet", "timestamp", "slug", "side", "usdcSize", "transactionHash")


@query
def first_deposits(spark, sf):
    return SW.first_deposits(X.incoming(spark, sf))


@query
def dataset_summary(spark, sf):
    return ST.dataset_schema(labelled(spark, sf))


@query
def labelled_pairs(spark, sf):
    raw = X.base_events(spark, sf).select(
        F.concat(F.lit("W"), F.col("user_id")).alias("Address"), F.concat(F.lit("m"), F.col("mk")).alias("slug"),
        (F.col("user_id") % 7 == 0).cast("int").alias("y"),
    )
    return ST.labelled_pairs(raw)


@query
def flagged_wallet_set(spark, sf):
    pairs = X.base_events(spark, sf).filter(F.col("user_id") % 17 == 0).select(F.concat(F.lit("W"), F.col("user_id")).alias("wallet"))
    return ST.flagged_wallets(pairs)


@query
def feature_upsert(spark, sf):
    c = context(spark, sf)
    have = P.cash_volume(c.trades).filter(F.col(MARKET) < "m4").select("wallet", MARKET, "volume_micro")
    want = X.flagged(spark, sf).join(c.trades.select("wallet", MARKET).distinct(), "wallet")
    return ST.upsert_missing(have, want, lambda keys: P.cash_volume(c.trades.join(keys, ["wallet", MARKET], "left_semi")).select("wallet", MARKET, "volume_micro"))


@query
def market_replacement(spark, sf):
    old = labels(spark, sf)
    new = old.filter(F.col(MARKET) == "m3").withColumn("is_insider", 1 - F.col("is_insider"))
    return ST.replace_markets(old, new)


@query
def file_keys(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", F.concat(F.col("source"), F.lit("-"), F.repeat(F.col("lang"), (F.col("n_chars") % 120).cast("int"))).alias(MARKET))
    return ST.with_file_key(d).select("doc_id", "file_key")


@query
def result_slices(spark, sf):
    """Flagged rows of the scored table, lead columns first."""
    v = P.cash_volume(context(spark, sf).trades)
    scored = v.select("wallet", MARKET, "n_trades", (F.col("volume_micro") / MICRO).alias("volume"), (F.col("tokens_micro") % 997 / 997).alias("pred_prob"))
    flagged = R.flag_scores(scored, 0.8).filter((F.col("volume") > 100) & F.col("flagged"))
    return r(ST.lead_columns(flagged))


def _folder(spark, name):
    """A new folder in the session's shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query
def stored_features(spark, sf):
    """Feature table written by market, one market replaced, and read back."""
    days = context(spark, sf).family("days").select("wallet", MARKET, "active_day_frac", "n_distinct_active_days")
    path = _folder(spark, "features")
    ST.write_features(days, path)
    ST.overwrite_market(days.filter(F.col(MARKET) == "m3"), path)
    return r(ST.read_features(spark, path))


@query
def stored_results(spark, sf):
    """Scored rows and flagged rows as written by the result sink."""
    v = P.cash_volume(context(spark, sf).trades)
    scored = v.select("wallet", MARKET, (F.col("volume_micro") / MICRO).alias("volume"), (F.col("tokens_micro") % 997 / 997).alias("pred_prob"))
    path = _folder(spark, "results")
    ST.write_results(R.flag_scores(scored, 0.8), path, "parquet")
    parts = [spark.read.parquet(f"{path}/{p}").withColumn("part", F.lit(p)) for p in ("results", "flagged")]
    return r(parts[0].unionByName(parts[1]).select("part", "wallet", MARKET, "pred_prob", "flagged", "volume"))


# --------------------------------------------------------- parsing, normalization

@query
def deduplicated_fills(spark, sf):
    f = X.fills(spark, sf)
    again = f.filter("timestamp % 5 = 0").withColumn("query_side", F.lit("taker"))
    both = P.dedupe_fills(f.unionByName(again).unionByName(f.filter("timestamp % 7 = 0")), "provenance")
    one = P.dedupe_fills(both, "id")
    n = lambda d, name: d.groupBy(MARKET).agg(F.count("*").alias(name))
    return n(both, "n_provenance").join(n(one, "n_id"), MARKET)


@query
def ordered_fills(spark, sf):
    return P.order_fills(X.fills(spark, sf)).select("timestamp", "transactionHash", "orderHash", "id")


@query
def parsed_trades(spark, sf):
    t = P.parse_trades(X.fills(spark, sf), X.markets(spark, sf))
    return t.select(MARKET, "trade_id", "ts", "wallet", "role", "side", "outcome", "token_id", "token_amount", "cash_amount", "counterparty")


@query
def quarantined_trades(spark, sf):
    t = P.parse_trades(X.fills(spark, sf), X.markets(spark, sf))
    odd = t.withColumn("token_micro", F.when(F.col("ts") % 11 == 0, 0).otherwise(F.col("token_micro"))).withColumn(
        "outcome", F.when(F.col("ts") % 13 == 0, "Maybe").otherwise(F.col("outcome"))
    )
    return P.invalid_trades(odd).groupBy("reason").agg(F.count("*").alias("n"))


@query
def yes_trades(spark, sf):
    t = context(spark, sf).trades
    return r(t.select(MARKET, "trade_id", "wallet", "role", "norm_side", "norm_outcome", "price", "norm_price", (F.col("signed_micro") / MICRO).alias("signed_yes_amount")))


@query
def display_trades(spark, sf):
    t = P.normalize_trades_tolerant(P.parse_trades(X.fills(spark, sf), X.markets(spark, sf)), X.markets(spark, sf))
    return r(t.select(MARKET, "wallet", "trade_id", "role", "original_side", "original_outcome", "yes_trade_price", "yes_action", "signed_yes_qty"))


def _history(spark, sf, how, **kw):
    return P.price_history(X.fills(spark, sf).withColumn("timestamp", F.expr("timestamp div 3600 * 3600")), X.markets(spark, sf), how, **kw)


@query
def price_history(spark, sf):
    return r(context(spark, sf).history)


@query
def hourly_history_first(spark, sf):
    return r(_history(spark, sf, "first"))


@query
def hourly_history_mean(spark, sf):
    return r(_history(spark, sf, "mean"))


@query
def history_yes_only(spark, sf):
    return r(_history(spark, sf, None, convert_no_to_yes=False))


@query
def prepared_history(spark, sf):
    e = X.table(spark, sf, "events").select(
        F.concat(F.lit("m"), F.col("event_id") % 8).alias(MARKET),
        F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.col("event_id").cast("string")).alias("ts"),
        F.when(F.col("event_id") % 9 == 0, "NaN").otherwise(F.col("value").cast("string")).alias("yes_price"),
    )
    return P.prepare_history(e)


@query
def market_volume(spark, sf):
    return r(P.market_volume(X.fills(spark, sf), X.markets(spark, sf)))


@query
def wallet_ledger(spark, sf):
    return context(spark, sf).ledger.select(MARKET, "wallet", "trade_id", "role", "seq", "inventory", "inventory_before")


@query
def plot_window(spark, sf):
    """The price curve and the trades on it within a time range."""
    c, bounds = context(spark, sf), (1_704_400_000, 1_704_800_000)
    curve, trades = R.plot_window(c.history, R.plot_trades(c.trades, c.history, cells=c.market_cells), *bounds)
    return r(curve.select(F.lit("curve").alias("part"), MARKET, "ts", F.lit(None).cast("string").alias("wallet"), "yes_price").unionByName(
        trades.select(F.lit("trade").alias("part"), MARKET, "ts", "wallet", F.col("history_yes_price").alias("yes_price"))))


@query
def top_volume_report(spark, sf):
    t = P.top_wallets(context(spark, sf).trades, 20)
    return r(t.filter(F.col("volume_micro") > 100 * MICRO).select(MARKET, "wallet", (F.col("volume_micro") / MICRO).alias("volume"), "n_trades", F.col("rank").cast("bigint").alias("rank")))


@query
def feature_subset(spark, sf):
    """Only the families of the requested names are computed."""
    names = ["path_alignment", "buy_markout_mean_300s", "n_distinct_active_days"]
    return r(context(spark, sf).features(names))


@query
def model_matrix(spark, sf):
    names = ["n_distinct_active_days", "no_such_feature", "active_day_frac"]
    return r(D.model_matrix(context(spark, sf).family("days"), names))


@query
def selected_wallet_trades(spark, sf):
    want = X.base_events(spark, sf).filter("user_id % 25 = 0").select(F.concat(F.lit("W"), F.col("user_id")).alias("wallet")).distinct()
    t = P.wallet_trades(P.parse_trades(X.fills(spark, sf), X.markets(spark, sf)), want)
    return t.select("requested_wallet", "wallet", MARKET, "trade_id", "role", "side", "token_amount")


@query
def active_candidates(spark, sf):
    return P.active_candidates(context(spark, sf).trades, 15, X.flagged(spark, sf))


@query
def wallet_summary(spark, sf):
    return r(P.wallet_summary(context(spark, sf).trades))


@query
def binary_summary(spark, sf):
    return r(P.binary_summary(P.wallet_summary(context(spark, sf).trades)))


@query
def wallet_rankings(spark, sf):
    """All seven rankings, ten wallets per market each."""
    s = materialize(P.wallet_summary(context(spark, sf).trades))
    both = s.join(P.binary_summary(s).drop("n_trades"), [MARKET, "wallet"])
    out = None
    for name in P.RANKINGS:
        part = P.rank_wallets(both, name, 10).select(F.lit(name).alias("ranking"), MARKET, "wallet", F.col("rank").cast("bigint").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def top_wallets(spark, sf):
    """Top 20 wallets by cash volume with their net and gross position per market."""
    c = context(spark, sf)
    top = P.top_wallets(c.trades, 20).select(MARKET, "wallet", "volume_micro", F.col("rank").cast("bigint").alias("rank"))
    s = P.wallet_summary(c.trades).select(MARKET, "wallet", "net_Yes_amount", "gross_Yes_amount", "net_No_amount", "gross_No_amount")
    return r(top.join(s, [MARKET, "wallet"]))


# -------------------------------------------------------------------- time joins

def _probes(spark, sf):
    return X.base_events(spark, sf).select(F.concat(F.lit("m"), (F.col("mk") + 3) % 8).alias(MARKET), "event_id", "ts")


def _cells(spark, sf, probes=None):
    """Split plan of the series for lookups of these rows."""
    return H.market_cells(context(spark, sf).history, probes)


@query
def nearest_history(spark, sf):
    m = H.map_trades_to_history(_probes(spark, sf), context(spark, sf).history, cells=_cells(spark, sf, _probes(spark, sf)))
    return r(m.select("event_id", "history_ts", "history_yes_price"))


@query
def nearest_history_within(spark, sf):
    m = H.map_trades_to_history(_probes(spark, sf), context(spark, sf).history, 300, _cells(spark, sf, _probes(spark, sf)))
    return r(m.select("event_id", "history_ts", "history_yes_price"))


def _asof(spark, sf, direction, shift):
    h = context(spark, sf).history.select(MARKET, F.col("ts").alias("h_ts"), "yes_price", F.col("trade_id").alias("h_id"))
    p = _probes(spark, sf).withColumn("at", F.col("ts") + shift)
    cells = _cells(spark, sf, p.select(MARKET, F.col("at").alias("ts")))
    found = A.asof_join(p, h, [MARKET], "at", "h_ts", ["yes_price"], direction, clamp=True, tiebreak=["h_id"], cells=cells)
    return r(found.select("event_id", "yes_price"))


@query
def price_at_or_after(spark, sf):
    return _asof(spark, sf, "forward", 86_400)


@query
def price_at_or_before(spark, sf):
    return _asof(spark, sf, "backward", -86_400)


@query
def trailing_windows(spark, sf):
    t = H.trailing_stats(context(spark, sf).ledger, context(spark, sf).history, cells=context(spark, sf).market_cells)
    return r(t.select(MARKET, "ts", F.round("trend_move", 6).alias("trend_move"), "trail_std", "trail_abs_step"))


@query
def realized_matches(spark, sf):
    m = L.realized_matches(context(spark, sf).segments)
    return r(m.select(MARKET, "wallet", "entry_side", "entry_trade_id", "entry_role_no", "exit_trade_id", "exit_role_no", "qty_micro", "raw_realized_pnl_per_token"))


@query
def open_lots(spark, sf):
    return r(L.open_lots(context(spark, sf).segments))


@query
def lot_table(spark, sf):
    return r(context(spark, sf).lots)


@query
def lot_close_events(spark, sf):
    return r(L.close_events(context(spark, sf).segments))


@query
def lot_intervals(spark, sf):
    return r(L.lot_intervals(context(spark, sf).segments))


@query
def pnl_timeline(spark, sf):
    c = context(spark, sf)
    t = L.pnl_timeline(c.ledger, c.segments, c.wallet_cells)
    return r(t.select(MARKET, "wallet", "trade_id", "role_no", "realized_pnl_this_trade", "cumulative_realized_pnl", "position_qty", "position_cost_basis", "avg_entry_price"), 6)


@query
def lot_markouts(spark, sf):
    c = context(spark, sf)
    return r(B.lot_markouts(c.lots, c.lookups, c.facts).drop("terminal_start_ts"))


@query
def price_lookups(spark, sf):
    cols = ["price_at", "fut0", "fut4", "past0", "past4", "fix300", "fix86400"]
    return r(context(spark, sf).lookups.select(MARKET, "ts", *cols))


@query
def given_move_times(spark, sf):
    t = X.markets(spark, sf).select(F.col("slug").alias(MARKET), F.expr("(start_ts + end_ts) div 2").alias("major_move_time"))
    return r(H.given_major_moves(t, context(spark, sf).history, _cells(spark, sf)).select(MARKET, "major_move_time", "major_move_start_price"))


@query
def terminal_spikes(spark, sf):
    return context(spark, sf).facts.select(MARKET, "terminal_start_ts")


@query
def market_facts(spark, sf):
    return r(context(spark, sf).dims.select(MARKET, "outcome", "h_start", "h_end", "h_rows", "price_min", "price_max", "last_price", "p10", "p25", "p75", "p90"))


@query
def price_changes(spark, sf):
    return r(H.price_changes(context(spark, sf).history, _cells(spark, sf)).select(MARKET, "ts", "ret"))


@query
def step_series(spark, sf):
    return r(H.step_series(context(spark, sf).history, _cells(spark, sf)))


@query
def entry_markers(spark, sf):
    t = R.first_trades(context(spark, sf).trades)
    return r(t.select("wallet", MARKET, "trade_id", "role", "ts", "norm_price"))


@query
def market_concentration(spark, sf):
    """Herfindahl index of each wallet's cash over markets."""
    return r(B.herfindahl(context(spark, sf).trades, ["wallet"], F.col(MARKET), "cash_micro"))


@query
def plot_trades(spark, sf):
    c = context(spark, sf)
    ranked = P.top_wallets(c.trades, 5)
    t = R.plot_trades(c.trades.select("wallet", MARKET, "trade_id", "role", "ts", "token_amount"), c.history, ranked, cells=c.market_cells)
    return r(t.select("wallet", MARKET, "trade_id", "role", F.col("rank").cast("bigint").alias("rank"), "history_yes_price", "marker_size"))


@query
def plot_limits(spark, sf):
    c = context(spark, sf)
    mapped = H.map_trades_to_history(c.trades.select("wallet", MARKET, "ts"), c.history, cells=c.market_cells)
    return r(R.y_limits(c.history, mapped))


# ------------------------------------------------------------------ labels shared

def labels(spark, sf):
    return X.base_events(spark, sf).select(
        F.concat(F.lit("w"), F.col("user_id")).alias("wallet"), F.concat(F.lit("m"), F.col("mk")).alias(MARKET),
        (F.col("user_id") % 7 == 0).cast("int").alias("is_insider"),
    ).distinct()


def labelled(spark, sf):
    """Day features with labels (wallets that only take have none and drop out)."""
    return D.with_labels(context(spark, sf).family("days"), labels(spark, sf))


@query
def display_scalars(spark, sf):
    c = X.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("v"), F.concat(F.lit("will-"), F.col("c_name"), F.lit("-of-"), F.col("c_mktsegment")).alias("slug")
    )
    return c.select(
        "c_custkey", S.abbreviated(F.array("slug")).alias("short_market"), S.slug8(F.col("slug")).alias("slug8"),
        F.round(S.platt(F.col("v") / 10000, -2.0, 0.5), 8).alias("calibrated"),
        F.round(S.platt(F.col("v") / 10000, -2.0, 0.5, reversed_classes=True), 8).alias("calibrated_rev"),
        F.round(S.price_weight(F.col("v") / 10000), 8).alias("weight"),
        F.round(S.min_max_clip(F.col("v"), F.lit(0.0), F.lit(5000.0)), 8).alias("clipped"),
        F.round(S.marker_size(F.col("v")), 8).alias("marker"),
    )


@query
def unit_labels(spark, sf):
    c = X.table(spark, sf, "customer").select("c_custkey", F.floor("c_acctbal").alias("v"))
    return c.select(
        "c_custkey", S.format_unit(F.col("v"), "usdc").alias("usdc"), S.format_unit(F.col("v") / 1.0, "count").alias("n"),
        S.ratio_label(F.col("v") * 1.0, F.col("c_custkey") % 3 * 1.0).alias("ratio"),
    )


@query
def scheme_labels(spark, sf):
    """Report names of fold and split settings, one pair per order key, and shortened market lists."""
    o = X.table(spark, sf, "orders")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("k") % len(values) + 1).cast("int"))
    g = o.groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("ms"), F.max("o_orderkey").alias("k"))
    return g.select(
        "o_custkey", S.labelled(pick(("rows", "stratified_group", "group", "time")), S.FOLD_LABELS).alias("scheme"),
        S.labelled(pick(("rows", "group", "pinned", "random_market", "time")), S.SPLIT_LABELS).alias("kind"),
        S.abbreviated(F.col("ms"), 2).alias("markets"),
    )
