"""DuckDB SQL of the registered queries.

Each entry is a final SELECT over named building blocks (CTEs on the driver tables,
see FIXTURES.md). ``build`` adds exactly the blocks a statement uses.
"""

from __future__ import annotations

import re

from fillsight.functions.scalar import grid_tag
from fillsight.operators.behavior import HOLDING, PATH
from fillsight.operators.history import FIXED_HORIZONS, GRID_FRACS
from fillsight.operators.ledger import DERISK_THRESHOLDS, derisk_name
from fillsight.plans import behavior as PB
from fillsight.plans.metadata import METADATA_COLUMNS

B: dict[str, str] = {}
Q: dict[str, str] = {}
KEY = "market_slug, wallet"


def closure(sql: str) -> list[str]:
    need: list[str] = []

    def visit(text: str) -> None:
        for name in B:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(B[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    return need


def build(sql: str) -> str:
    names = closure(sql)
    if not names:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({B[n]})" for n in names) + "\n" + sql


def rounded(source: str, keys: str, doubles, places: int = 8, counts=frozenset(), count_type: str = "bigint") -> str:
    cols = [f"cast({c} AS {count_type}) AS {c}" if c in counts else f"round({c}, {places}) + 0.0 AS {c}" for c in doubles]
    return f"SELECT {keys}, " + ", ".join(cols) + f" FROM {source}"


# --------------------------------------------------------------------- inputs

B["b_ev"] = """
SELECT event_id, user_id, event_type, value, event_id % 8 AS mk, cast(floor(epoch(ts)) AS bigint) AS ts FROM events"""
B["b_ev2"] = """
SELECT *, 'm' || mk AS market_slug,
  100 + abs((ts // 600 + mk * 37) % 1600 - 800) + (event_id * 31) % 21 - 10 AS base,
  event_id % 3 = 0 AS is_no, event_type IN ('purchase', 'signup', 'view') AS maker_buys,
  cast(round(value * 100) AS bigint) * 10000 AS token
FROM b_ev"""
B["b_ev3"] = """
SELECT *, CASE WHEN ts >= 1704067200 + 86400 * (10 + 2 * mk) THEN 1000 - base ELSE base END AS ypm,
  market_slug || CASE WHEN is_no THEN '-N' ELSE '-Y' END AS token_id FROM b_ev2"""
B["b_ev4"] = """
SELECT *, token * (CASE WHEN is_no THEN 1000 - ypm ELSE ypm END) // 1000 AS cash FROM b_ev3"""
B["b_fills"] = """
SELECT 'e' || event_id AS id, ts AS "timestamp", 't' || (event_id // 2) AS "transactionHash", 'o' || event_id AS "orderHash",
  'w' || user_id AS maker, 'w' || ((user_id * 7 + event_id) % 150) AS taker,
  CASE WHEN maker_buys THEN '0' ELSE token_id END AS "makerAssetId",
  CASE WHEN maker_buys THEN token_id ELSE '0' END AS "takerAssetId",
  CASE WHEN maker_buys THEN cash ELSE token END AS "makerAmountFilled",
  CASE WHEN maker_buys THEN token ELSE cash END AS "takerAmountFilled",
  '0' AS fee, 'maker' AS query_side, token_id AS queried_token_id, market_slug
FROM b_ev4"""
B["b_mk"] = """
SELECT 'm' || mk AS slug, mk, min(ts) AS start_ts, max(ts) AS end_ts, cast(mk % 2 AS double) AS p0,
  cast(mk % 2 AS integer) AS outcome FROM b_ev GROUP BY mk"""
B["b_leg"] = """
SELECT *, 'e' || event_id AS trade_id, CASE WHEN is_no THEN 'No' ELSE 'Yes' END AS outcome_name FROM b_ev4"""
B["b_trades"] = """
SELECT market_slug, trade_id, ts, 'w' || user_id AS wallet, 'maker' AS role, 0 AS role_no,
  CASE WHEN maker_buys THEN 'BUY' ELSE 'SELL' END AS side, outcome_name AS outcome, token_id, token AS token_micro, cash AS cash_micro,
  'w' || ((user_id * 7 + event_id) % 150) AS counterparty FROM b_leg
UNION ALL
SELECT market_slug, trade_id, ts, 'w' || ((user_id * 7 + event_id) % 150), 'taker', 1,
  CASE WHEN maker_buys THEN 'SELL' ELSE 'BUY' END, outcome_name, token_id, token, cash, 'w' || user_id FROM b_leg"""
B["b_yes"] = """
SELECT *, cash_micro / token_micro AS price,
  CASE WHEN (side = 'BUY') = (outcome = 'Yes') THEN 'BUY' ELSE 'SELL' END AS norm_side,
  CASE WHEN outcome = 'Yes' THEN cash_micro / token_micro ELSE 1 - cash_micro / token_micro END AS norm_price,
  CASE WHEN (side = 'BUY') = (outcome = 'Yes') THEN token_micro ELSE -token_micro END AS signed_micro
FROM b_trades WHERE token_micro > 0"""
B["b_raw_hist"] = """
SELECT market_slug, trade_id, ts, token_id, token / 1e6 AS token_amount, cash / 1e6 AS cash_amount,
  CASE WHEN is_no THEN 1 - cash / token ELSE cash / token END AS yes_price FROM b_leg WHERE token <> 0"""
B["b_hist"] = """
SELECT market_slug, ts, max_by(trade_id, trade_id) AS trade_id, max_by(yes_price, trade_id) AS yes_price,
  max_by(token_id, trade_id) AS token_id, max_by(token_amount, trade_id) AS token_amount,
  max_by(cash_amount, trade_id) AS cash_amount FROM b_raw_hist GROUP BY market_slug, ts"""
B["b_series"] = """
SELECT market_slug, min(ts) AS h_start, max(ts) AS h_end, count(*) AS h_rows, min(yes_price) AS price_min,
  max(yes_price) AS price_max, max_by(yes_price, ts) AS last_price, min_by(yes_price, ts) AS first_price, max(ts) - min(ts) AS life,
  quantile_cont(yes_price, 0.10) AS p10, quantile_cont(yes_price, 0.25) AS p25,
  quantile_cont(yes_price, 0.75) AS p75, quantile_cont(yes_price, 0.90) AS p90
FROM b_hist GROUP BY market_slug"""
B["b_dims"] = """
SELECT m.slug AS market_slug, m.start_ts, m.end_ts, m.outcome, m.outcome = 1 AS yes_wins, s.* EXCLUDE (market_slug)
FROM b_mk m LEFT JOIN b_series s ON s.market_slug = m.slug"""
B["b_ledger"] = """
SELECT *, buy_hi - sell_hi AS inventory, buy_hi - sell_hi - signed_micro AS inventory_before FROM (
  SELECT *, norm_side = 'BUY' AS is_buy,
    cast(sum(CASE WHEN norm_side = 'BUY' THEN token_micro ELSE 0 END) OVER w AS bigint) AS buy_hi,
    cast(sum(CASE WHEN norm_side = 'BUY' THEN 0 ELSE token_micro END) OVER w AS bigint) AS sell_hi,
    count(*) OVER w AS seq
  FROM b_yes
  WINDOW w AS (PARTITION BY market_slug, wallet ORDER BY ts, trade_id, role_no ROWS UNBOUNDED PRECEDING))"""

# ------------------------------------------------------------------ FIFO pieces

B["b_buys"] = """
SELECT market_slug, wallet, seq, ts, trade_id, role_no, norm_price AS p, buy_hi - token_micro AS lo, buy_hi AS hi FROM b_ledger WHERE is_buy"""
B["b_sells"] = """
SELECT market_slug, wallet, seq, ts, trade_id, role_no, norm_price AS p, sell_hi - token_micro AS lo, sell_hi AS hi FROM b_ledger WHERE NOT is_buy"""
B["b_tot"] = """
SELECT market_slug, wallet, max(buy_hi) AS tb, max(sell_hi) AS tsell FROM b_ledger GROUP BY market_slug, wallet"""
B["b_seg"] = """
SELECT b.market_slug, b.wallet, true AS matched, greatest(b.lo, s.lo) AS lo, least(b.hi, s.hi) AS hi,
  CASE WHEN b.seq < s.seq THEN 1 ELSE -1 END AS entry_sign,
  least(b.seq, s.seq) AS e_seq, greatest(b.seq, s.seq) AS x_seq,
  CASE WHEN b.seq < s.seq THEN b.ts ELSE s.ts END AS e_ts, CASE WHEN b.seq < s.seq THEN s.ts ELSE b.ts END AS x_ts,
  CASE WHEN b.seq < s.seq THEN b.p ELSE s.p END AS e_p, CASE WHEN b.seq < s.seq THEN s.p ELSE b.p END AS x_p,
  CASE WHEN b.seq < s.seq THEN b.trade_id ELSE s.trade_id END AS e_id, CASE WHEN b.seq < s.seq THEN s.trade_id ELSE b.trade_id END AS x_id,
  CASE WHEN b.seq < s.seq THEN b.role_no ELSE s.role_no END AS e_role, CASE WHEN b.seq < s.seq THEN s.role_no ELSE b.role_no END AS x_role,
  s.p - b.p AS pnl
FROM b_buys b JOIN b_sells s ON b.market_slug = s.market_slug AND b.wallet = s.wallet AND b.lo < s.hi AND s.lo < b.hi
UNION ALL
SELECT b.market_slug, b.wallet, false, greatest(b.lo, t.tsell), b.hi, 1, b.seq, NULL, b.ts, NULL, b.p, NULL, b.trade_id, NULL, b.role_no, NULL, NULL
FROM b_buys b JOIN b_tot t USING (market_slug, wallet) WHERE b.hi > t.tsell
UNION ALL
SELECT s.market_slug, s.wallet, false, greatest(s.lo, t.tb), s.hi, -1, s.seq, NULL, s.ts, NULL, s.p, NULL, s.trade_id, NULL, s.role_no, NULL, NULL
FROM b_sells s JOIN b_tot t USING (market_slug, wallet) WHERE s.hi > t.tb"""
B["b_lot0"] = """
SELECT market_slug, wallet, e_seq, any_value(e_id) AS trade_id, any_value(e_role) AS role_no, any_value(e_ts) AS entry_time,
  any_value(e_p) AS entry_price, any_value(entry_sign) AS side_sign, cast(sum(hi - lo) AS bigint) AS original_micro,
  cast(sum(CASE WHEN matched THEN 0 ELSE hi - lo END) AS bigint) AS remaining_micro
FROM b_seg GROUP BY market_slug, wallet, e_seq"""
B["b_closing"] = """
SELECT market_slug, wallet, e_seq, x_ts, x_p, hi - lo AS qty,
  sum(hi - lo) OVER (PARTITION BY market_slug, wallet, e_seq ORDER BY x_seq) AS cum FROM b_seg WHERE matched"""
B["b_lots"] = (
    "SELECT l.*, " + ", ".join(
        f"(SELECT min(c.x_ts) FROM b_closing c WHERE c.market_slug = l.market_slug AND c.wallet = l.wallet AND c.e_seq = l.e_seq "
        f"AND c.cum >= {t} * l.original_micro) AS {derisk_name(t)}" for t in DERISK_THRESHOLDS
    ) + " FROM b_lot0 l"
)

# -------------------------------------------------------------- price lookups

B["b_sec"] = "SELECT DISTINCT l.market_slug, l.ts, d.life, d.last_price, d.first_price FROM b_ledger l JOIN b_series d USING (market_slug)"


def _fwd(name: str, at: str) -> str:
    return (
        f"SELECT s.market_slug, s.ts, coalesce(h.yes_price, s.last_price) AS {name} FROM "
        f"(SELECT *, {at} AS at_ FROM b_sec) s ASOF LEFT JOIN b_hist h ON s.market_slug = h.market_slug AND s.at_ <= h.ts"
    )


def _bwd(name: str, at: str) -> str:
    return (
        f"SELECT s.market_slug, s.ts, coalesce(h.yes_price, s.first_price) AS {name} FROM "
        f"(SELECT *, {at} AS at_ FROM b_sec) s ASOF LEFT JOIN b_hist h ON s.market_slug = h.market_slug AND s.at_ >= h.ts"
    )


_parts = {"price_at": _fwd("price_at", "ts")}
_parts |= {f"fut{i}": _fwd(f"fut{i}", f"ts + {f} * life") for i, f in enumerate(GRID_FRACS)}
_parts |= {f"past{i}": _bwd(f"past{i}", f"ts - {f} * life") for i, f in enumerate(GRID_FRACS)}
_parts |= {f"fix{h}": _fwd(f"fix{h}", f"ts + {h}") for h in FIXED_HORIZONS}
for _n, _s in _parts.items():
    B[f"b_lk_{_n}"] = _s
B["b_lk"] = (
    "SELECT b_lk_price_at.*, " + ", ".join(n for n in _parts if n != "price_at") + " FROM b_lk_price_at "
    + " ".join(f"JOIN b_lk_{n} USING (market_slug, ts)" for n in _parts if n != "price_at")
)
B["b_step"] = """
SELECT market_slug, ts, yes_price, yes_price - lag(yes_price) OVER (PARTITION BY market_slug ORDER BY ts) AS ret FROM b_hist"""
B["b_win"] = """
SELECT s.market_slug, s.ts, h.ts AS h_ts, h.yes_price, h.ret, min(h.ts) OVER (PARTITION BY s.market_slug, s.ts) AS first_ts
FROM b_sec s JOIN b_step h ON h.market_slug = s.market_slug AND h.ts BETWEEN s.ts - 21600 AND s.ts"""
B["b_trail"] = """
SELECT market_slug, ts, CASE WHEN count(*) >= 3 THEN regr_slope(yes_price, h_ts - first_ts) END AS slope,
  CASE WHEN count(*) >= 2 THEN stddev_samp(yes_price) END AS trail_std,
  avg(abs(ret)) FILTER (WHERE h_ts > first_ts) AS trail_abs_step
FROM b_win GROUP BY market_slug, ts"""
B["b_moves"] = """
SELECT d.market_slug, m.ts AS major_move_time, m.yes_price AS major_move_start_price, m.fut AS major_move_future_price,
  m.fut - m.yes_price AS major_move_delta
FROM b_series d LEFT JOIN (
  SELECT market_slug, min_by(ts, ts) AS ts, min_by(yes_price, ts) AS yes_price, min_by(fut, ts) AS fut FROM (
    SELECT h.market_slug, h.ts, h.yes_price, l.fix3600 AS fut FROM b_hist h JOIN b_lk_fix3600 l USING (market_slug, ts)
    WHERE abs(l.fix3600 - h.yes_price) >= 0.15) GROUP BY market_slug) m ON m.market_slug = d.market_slug"""
B["b_tail"] = """
SELECT h.market_slug, h.ts, CASE WHEN d.yes_wins THEN h.yes_price ELSE 1 - h.yes_price END AS a,
  CASE WHEN d.yes_wins THEN d.last_price ELSE 1 - d.last_price END AS a_end
FROM b_hist h JOIN b_dims d USING (market_slug) WHERE d.life > 0 AND d.h_rows >= 2 AND h.ts >= d.h_end - 0.05 * d.life"""
B["b_low"] = "SELECT market_slug, arg_min(ts, (a, ts)) AS low_ts, min(a) AS low_a FROM b_tail GROUP BY market_slug"
B["b_spike"] = """
SELECT d.market_slug, min(t.ts) AS terminal_start_ts FROM b_dims d LEFT JOIN (
  SELECT t.market_slug, t.ts FROM b_tail t JOIN b_low l USING (market_slug)
  WHERE t.ts >= l.low_ts AND t.a_end - l.low_a > 1e-9 AND (t.a - l.low_a) / (t.a_end - l.low_a) >= 0.25) t
ON t.market_slug = d.market_slug GROUP BY d.market_slug"""
B["b_priced"] = """
SELECT l.*, k.* EXCLUDE (market_slug, ts), t.slope * 21600 AS trend_move, t.trail_std, t.trail_abs_step,
  d.life, d.h_rows, d.p10, d.p25, d.p75, d.p90, d.outcome, d.start_ts, d.end_ts
FROM b_ledger l JOIN b_lk k USING (market_slug, ts) JOIN b_trail t USING (market_slug, ts) JOIN b_dims d USING (market_slug)"""

# ------------------------------------------------------------- feature families

B["x_major"] = """
SELECT m.market_slug, major_move_start_price, major_move_future_price, major_move_delta,
  (major_move_time - start_ts) / (end_ts - start_ts) AS major_move_time_position_pct,
  1 - (major_move_time - start_ts) / (end_ts - start_ts) AS major_move_time_remaining_pct
FROM b_moves m JOIN b_dims USING (market_slug)"""
B["b_first_buy"] = """
SELECT market_slug, wallet, min(ts) AS t0, max(ts) AS t1, avg(norm_price) AS avg_price FROM b_ledger WHERE is_buy GROUP BY ALL"""
B["b_bins"] = """
SELECT l.market_slug, l.wallet, (l.ts - f.t0) // 3600 AS bin, cast(sum(cash_micro) AS double) AS c
FROM b_ledger l JOIN b_first_buy f USING (market_slug, wallet) WHERE is_buy GROUP BY ALL"""
B["x_entry"] = """
SELECT f.market_slug, f.wallet,
  (SELECT count(*) FILTER (WHERE h.yes_price <= f.avg_price + 1e-12) / count(*) FROM b_hist h WHERE h.market_slug = f.market_slug) AS entry_price_percentile,
  (f.t0 - d.start_ts) / (d.end_ts - d.start_ts) AS first_entry_time_position_pct,
  1 - (f.t0 - d.start_ts) / (d.end_ts - d.start_ts) AS first_entry_time_remaining_pct,
  (m.major_move_time - f.t0) / (d.end_ts - d.start_ts) AS time_to_major_move_pct_of_market,
  b.hhi AS entry_concentration_hhi, (f.t1 - f.t0) / (d.end_ts - d.start_ts) AS entry_span_pct_of_market,
  t.trail_std AS pre_entry_price_std, t.trail_abs_step AS pre_entry_abs_return_mean
FROM b_first_buy f JOIN b_dims d USING (market_slug) JOIN b_moves m USING (market_slug)
JOIN b_trail t ON t.market_slug = f.market_slug AND t.ts = f.t0
JOIN (SELECT market_slug, wallet, sum(c * c) / (sum(c) * sum(c)) AS hhi FROM b_bins GROUP BY ALL) b ON b.market_slug = f.market_slug AND b.wallet = f.wallet"""
B["x_unrealized"] = """
SELECT s.market_slug, s.wallet,
  sum(CASE WHEN matched THEN 0 ELSE entry_sign * (hi - lo) * (outcome - e_p) / (price_max - price_min) END)
    / sum(CASE WHEN matched THEN 2 * (hi - lo) ELSE hi - lo END) AS unrealized_edge_per_open_token,
  sum(CASE WHEN matched THEN 0 ELSE entry_sign * sqrt(hi - lo) * (outcome - e_p) / (price_max - price_min) END)
    / sqrt(sum(CASE WHEN matched THEN 2 * (hi - lo) ELSE hi - lo END)) AS unrealized_edge_per_open_token_sqrt,
  sum(CASE WHEN matched THEN 0 ELSE entry_sign * (hi - lo) END) / 1e6 AS open_position_qty
FROM b_seg s JOIN b_dims d USING (market_slug) GROUP BY s.market_slug, s.wallet"""
B["b_path"] = """
SELECT l.*, CASE WHEN d.outcome = 1 THEN 1 ELSE -1 END AS sgn, l.ts <= d.start_ts + 0.5 * (d.end_ts - d.start_ts) AS early
FROM b_ledger l JOIN b_dims d USING (market_slug)"""
B["b_signs"] = """
SELECT market_slug, wallet, sign(inventory) AS sg, lag(sign(inventory)) OVER (PARTITION BY market_slug, wallet ORDER BY seq) AS prev
FROM b_ledger WHERE inventory <> 0"""
B["b_flips"] = """
SELECT market_slug, wallet, count(*) AS n, count(*) FILTER (WHERE prev IS NOT NULL AND prev <> sg) AS f FROM b_signs GROUP BY ALL"""
B["x_position"] = """
SELECT p.market_slug, p.wallet,
  sum(signed_micro) / sum(token_micro) AS net_directional_consistency,
  sum(CASE WHEN is_buy THEN token_micro ELSE 0 END) / 1e6 AS buy_tokens_total,
  sum(CASE WHEN is_buy THEN 0 ELSE token_micro END) / 1e6 AS sell_tokens_total,
  sum(signed_micro) / 1e6 AS net_tokens, sum(token_micro) / 1e6 AS gross_tokens,
  max(inventory) / 1e6 AS max_inventory, min(inventory) / 1e6 AS min_inventory, max(abs(inventory)) / 1e6 AS max_abs_inventory,
  cast(sign(sum(signed_micro)) * max(sgn) AS double) AS outcome_alignment,
  sum(signed_micro) * max(sgn) / sum(token_micro) AS outcome_alignment_token,
  sum(inventory) * max(sgn) / nullif(sum(abs(inventory)), 0) AS path_alignment,
  sum(inventory) FILTER (WHERE early) * max(sgn) / nullif(sum(abs(inventory)) FILTER (WHERE early), 0) AS early_path_alignment,
  sum(abs(inventory)) / count(*) / 1e6 AS avg_abs_position_tokens, max(abs(inventory)) / 1e6 AS max_abs_position_tokens,
  arg_max(inventory, seq) / 1e6 AS final_position_tokens,
  cast(coalesce(max(CASE WHEN f.n >= 2 THEN f.f END), 0) AS double) AS position_flips,
  coalesce(max(CASE WHEN f.n >= 2 THEN f.f / (f.n - 1) END), 0) AS position_flip_rate
FROM b_path p LEFT JOIN b_flips f USING (market_slug, wallet) GROUP BY p.market_slug, p.wallet"""


def _grid_sql() -> str:
    cols, aggs = [], []
    for i, h in enumerate(GRID_FRACS):
        for j, lb in enumerate(GRID_FRACS):
            tag = grid_tag(h, lb)
            up, down = f"greatest(norm_price - past{j}, 0)", f"greatest(past{j} - norm_price, 0)"
            cols.append(
                f"CASE WHEN is_buy AND inventory_before >= 0 THEN wt * (fut{i} - norm_price) - 0.10 * {up} + 0.30 * {down} "
                f"WHEN NOT is_buy AND inventory_before <= 0 THEN wt * (norm_price - fut{i}) - 0.10 * {down} + 0.30 * {up} END AS s_{tag}"
            )
            for side, cond in (("buy", "is_buy"), ("sell", "NOT is_buy")):
                aggs += [
                    f"avg(s_{tag}) FILTER (WHERE {cond}) AS {side}_markout_adj_mean_{tag}",
                    f"median(s_{tag}) FILTER (WHERE {cond}) AS {side}_markout_adj_median_{tag}",
                    f"coalesce(sum(s_{tag} * token_micro) FILTER (WHERE {cond}) / sum(token_micro), 0) AS {side}_markout_adj_grosswt_{tag}",
                ]
    wt = (
        "CASE WHEN is_buy THEN CASE WHEN norm_price > 0 THEN least(1 / pow(norm_price, 1.5), 8) ELSE 8 END "
        "ELSE CASE WHEN 1 - norm_price > 0 THEN least(1 / pow(1 - norm_price, 1.5), 8) ELSE 8 END END AS wt"
    )
    inner = f"SELECT *, {wt} FROM b_priced"
    scored = f"SELECT market_slug, wallet, is_buy, token_micro, {', '.join(cols)} FROM ({inner})"
    return f"SELECT market_slug, wallet, {', '.join(aggs)} FROM ({scored}) GROUP BY market_slug, wallet"


B["x_grid"] = _grid_sql()
B["x_fixed"] = (
    "SELECT market_slug, wallet, " + ", ".join(
        f"{fn}({v}) FILTER (WHERE {cond}) AS {side}_markout_{stat}_{h}s"
        for h in FIXED_HORIZONS
        for side, cond, v in (("buy", "is_buy", f"fix{h} - norm_price"), ("sell", "NOT is_buy", f"norm_price - fix{h}"))
        for stat, fn in (("mean", "avg"), ("median", "median"))
    ) + " FROM b_priced GROUP BY market_slug, wallet"
)
B["b_closed"] = """
SELECT s.market_slug, s.wallet, s.x_seq, max(x_ts) AS ts, sum((hi - lo) * pnl) AS pnl, sum(hi - lo) AS q, max(x_ts) <= any_value(d.start_ts + 0.5 * (d.end_ts - d.start_ts)) AS early
FROM b_seg s JOIN b_dims d USING (market_slug) WHERE matched GROUP BY s.market_slug, s.wallet, s.x_seq"""
B["x_realized"] = (
    "SELECT market_slug, wallet, " + ", ".join(
        f"sum(pnl) FILTER (WHERE {c}) / 1e6 AS {e}realized_pnl_total, "
        f"sum(pnl) FILTER (WHERE {c}) / 1e6 / nullif(count(*) FILTER (WHERE {c}), 0) AS {e}realized_pnl_per_closing_trade, "
        f"sum(pnl) FILTER (WHERE {c}) / sum(q) FILTER (WHERE {c}) AS {e}realized_pnl_per_matched_token, "
        f"cast(nullif(count(*) FILTER (WHERE {c}), 0) AS double) AS {e}n_closing_trades_with_realization, "
        f"sum(q) FILTER (WHERE {c}) / 1e6 AS {e}matched_tokens_realized, "
        f"count(*) FILTER (WHERE {c} AND round(pnl, 3) > 0) / nullif(count(*) FILTER (WHERE {c}), 0) AS {e}realized_win_rate_closing_trades"
        for e, c in (("", "true"), ("early_", "early"))
    ) + " FROM b_closed GROUP BY market_slug, wallet"
)
B["b_trend"] = """
SELECT *, CASE WHEN trend_move > 0.03 THEN 'up' WHEN trend_move < -0.03 THEN 'down' WHEN trend_move IS NOT NULL THEN 'flat' END AS tl FROM b_priced"""
B["x_contrarian"] = """
SELECT market_slug, wallet,
  coalesce(sum(cash_micro) FILTER (WHERE norm_price <= p25), 0) / nullif(sum(cash_micro), 0) AS cash_at_low_price_frac,
  coalesce(sum(cash_micro) FILTER (WHERE is_buy AND norm_price <= p25), 0) / nullif(sum(cash_micro) FILTER (WHERE is_buy), 0) AS buy_cash_at_low_price_frac,
  coalesce(sum(cash_micro) FILTER (WHERE NOT is_buy AND norm_price >= p75), 0) / nullif(sum(cash_micro) FILTER (WHERE NOT is_buy), 0) AS sell_cash_at_high_price_frac,
  coalesce(sum(cash_micro) FILTER (WHERE (is_buy AND tl IN ('flat', 'down')) OR (NOT is_buy AND tl IN ('flat', 'up'))), 0) / nullif(sum(cash_micro), 0) AS cash_against_recent_trend_frac,
  coalesce(sum(cash_micro) FILTER (WHERE is_buy AND tl IN ('flat', 'down')), 0) / nullif(sum(cash_micro) FILTER (WHERE is_buy), 0) AS buy_cash_against_recent_downtrend_frac,
  coalesce(sum(cash_micro) FILTER (WHERE NOT is_buy AND tl IN ('flat', 'up')), 0) / nullif(sum(cash_micro) FILTER (WHERE NOT is_buy), 0) AS sell_cash_against_recent_uptrend_frac,
  avg(trend_move) FILTER (WHERE is_buy) AS recent_trend_mean_for_buys, avg(trend_move) FILTER (WHERE NOT is_buy) AS recent_trend_mean_for_sells
FROM b_trend GROUP BY market_slug, wallet"""


def _share(cond: str, den: str) -> str:
    return f"coalesce(sum(cash_micro) FILTER (WHERE {cond}) / nullif({den}, 0), 0)"


_BUY, _SELL, _CASH = "sum(cash_micro) FILTER (WHERE is_buy)", "sum(cash_micro) FILTER (WHERE NOT is_buy)", "sum(cash_micro)"
_lo, _hi = "is_buy AND norm_price <= 0.10", "NOT is_buy AND norm_price >= 0.90"
_lob, _hib = f"{_lo} AND inventory_before >= 0", f"{_hi} AND inventory_before <= 0"
_lop, _hip = "is_buy AND norm_price <= p10 AND inventory_before >= 0", "NOT is_buy AND norm_price >= p90 AND inventory_before <= 0"
B["x_extreme"] = f"""
SELECT market_slug, wallet, {_share(_lo, _BUY)} AS low_buy_cash_frac_leq_0p1, {_share(_hi, _SELL)} AS high_sell_cash_frac_geq_0p9,
  {_share(_lob, _BUY)} AS low_buy_building_cash_frac, {_share(_hib, _SELL)} AS high_sell_nonflattening_cash_frac,
  {_share(f'({_lob}) OR ({_hib})', _CASH)} AS extreme_trade_nonflattening_cash_frac,
  {_share(_lop, _BUY)} AS low_buy_building_cash_frac_pctl10, {_share(_hip, _SELL)} AS high_sell_nonflattening_cash_frac_pctl90,
  {_share(f'({_lop}) OR ({_hip})', _CASH)} AS extreme_trade_nonflattening_cash_frac_pctl,
  count(*) FILTER (WHERE {_lop}) AS n_low_buy_building_trades_pctl10, count(*) FILTER (WHERE {_hip}) AS n_high_sell_nonflattening_trades_pctl90,
  count(*) FILTER (WHERE {_lob}) AS n_low_buy_building_trades, count(*) FILTER (WHERE {_hib}) AS n_high_sell_nonflattening_trades,
  ({_share(_hip, _SELL)} + {_share(_lop, _BUY)}) / 2 AS low_buy_high_sell_pctl
FROM b_priced GROUP BY market_slug, wallet"""
B["b_days"] = """
SELECT market_slug, wallet, ts // 86400 AS d, count(*) FILTER (WHERE is_buy) AS nb, count(*) FILTER (WHERE NOT is_buy) AS ns,
  cast(coalesce(sum(cash_micro) FILTER (WHERE is_buy), 0) AS double) AS cb,
  cast(coalesce(sum(cash_micro) FILTER (WHERE NOT is_buy), 0) AS double) AS cs FROM b_ledger GROUP BY ALL"""
B["x_days"] = """
SELECT b.market_slug, b.wallet, count(*) FILTER (WHERE nb > 0) AS n_distinct_buy_days, count(*) FILTER (WHERE ns > 0) AS n_distinct_sell_days,
  count(*) AS n_distinct_active_days, sum(cb * cb) / nullif(sum(cb) * sum(cb), 0) AS buy_day_concentration_hhi,
  sum(cs * cs) / nullif(sum(cs) * sum(cs), 0) AS sell_day_concentration_hhi,
  sum((cb + cs) * (cb + cs)) / nullif(sum(cb + cs) * sum(cb + cs), 0) AS active_day_concentration_hhi,
  count(*) / greatest(max(s.h_end // 86400 - s.h_start // 86400 + 1), 1) AS active_day_frac
FROM b_days b JOIN b_series s USING (market_slug) GROUP BY b.market_slug, b.wallet"""


def _future(i: int, h: float) -> str:
    t = f"(l.entry_time + {h} * d.life)"
    cap = "coalesce(l.derisk_0p5, d.h_end)"
    cap_price = "CASE WHEN l.derisk_0p5 IS NULL THEN d.last_price ELSE p50.price_at END"
    return (
        f"CASE WHEN l.derisk_0p25 IS NULL THEN d.last_price WHEN l.derisk_0p25 >= least({t}, {cap}) THEN p25.price_at "
        f"WHEN {t} <= {cap} THEN k.fut{i} ELSE {cap_price} END"
    )


B["b_lotmv"] = (
    "SELECT l.market_slug, l.wallet, l.trade_id, l.role_no, l.entry_time, l.remaining_micro AS w, l.derisk_0p25 IS NULL AS held, "
    "coalesce(l.entry_time >= sp.terminal_start_ts, false) AS late, "
    + ", ".join(f"l.side_sign * (({_future(i, h)}) - l.entry_price) / (d.price_max - d.price_min) AS mv{i}" for i, h in enumerate(GRID_FRACS))
    + """ FROM b_lots l JOIN b_series d USING (market_slug) JOIN b_spike sp USING (market_slug)
  LEFT JOIN b_lk k ON k.market_slug = l.market_slug AND k.ts = l.entry_time
  LEFT JOIN b_lk_price_at p25 ON p25.market_slug = l.market_slug AND p25.ts = l.derisk_0p25
  LEFT JOIN b_lk_price_at p50 ON p50.market_slug = l.market_slug AND p50.ts = l.derisk_0p5 WHERE l.remaining_micro > 0"""
)
B["b_lotagg"] = (
    "SELECT market_slug, wallet, sum(CASE WHEN held THEN w ELSE 0 END) AS held, sum(CASE WHEN late THEN w ELSE 0 END) AS late, "
    + ", ".join(
        f"sum(w * mv{i}) AS raw{i}, sum(w * abs(mv{i})) AS abs{i}, sum(CASE WHEN late THEN w * greatest(mv{i}, 0) ELSE 0 END) AS spike{i}"
        for i in range(len(GRID_FRACS))
    ) + " FROM b_lotmv GROUP BY market_slug, wallet"
)
B["b_real"] = """
SELECT market_slug, wallet, sum(CASE WHEN matched THEN (hi - lo) * pnl ELSE 0 END) AS pnl, sum(CASE WHEN matched THEN hi - lo ELSE 0 END) AS q,
  sum(CASE WHEN matched THEN 2 * (hi - lo) ELSE hi - lo END) AS g FROM b_seg GROUP BY market_slug, wallet"""
B["b_derisk"] = (
    "SELECT l.market_slug, l.wallet, " + ", ".join(
        f"avg(({n} - h_start) / life) AS {n}_m, sum(original_micro * ({n} - h_start) / life) / sum(original_micro) FILTER (WHERE {n} IS NOT NULL) AS {n}_w, "
        f"coalesce(sum(original_micro) FILTER (WHERE {n} IS NOT NULL), 0) AS {n}_f"
        for n in map(derisk_name, DERISK_THRESHOLDS)
    ) + " FROM b_lots l JOIN b_series USING (market_slug) GROUP BY l.market_slug, l.wallet"
)


def _adaptive_sql() -> str:
    cols = [
        "cast(sp.terminal_start_ts AS double) AS terminal_start_ts",
        "(sp.terminal_start_ts - d.h_start) / d.life AS terminal_start_time_position",
        "r.pnl / (d.price_max - d.price_min) / r.g AS realized_edge_grosswt", "r.pnl / r.g AS realized_raw_pnl_grosswt",
        "r.q / r.g AS realized_token_frac",
    ]
    for t in DERISK_THRESHOLDS:
        n = derisk_name(t)
        cols += [f"x.{n}_m AS {n}_time_position_mean", f"x.{n}_w AS {n}_time_position_tokenwt", f"x.{n}_f / r.g AS {n}_token_frac"]
    edge = "r.pnl / (d.price_max - d.price_min) / r.g"
    for i, h in enumerate(GRID_FRACS):
        tag = f"h{h:.3f}".replace(".", "p")
        adj = f"(coalesce(a.raw{i}, 0) - coalesce(a.spike{i}, 0)) / r.g"
        cols += [
            f"coalesce(a.raw{i} / r.g, 0) AS adaptive_markout_raw_grosswt_{tag}", f"coalesce(a.abs{i} / r.g, 0) AS adaptive_markout_abs_grosswt_{tag}",
            f"coalesce(a.spike{i} / r.g, 0) AS adaptive_late_spike_edge_grosswt_{tag}",
            f"coalesce(a.late / r.g, 0) AS adaptive_late_spike_token_frac_{tag}", f"coalesce(a.held / r.g, 0) AS adaptive_held_to_end_token_frac_{tag}",
            f"{adj} AS adaptive_markout_latespike_adj_grosswt_{tag}",
        ]
        for al in (0.25, 0.5, 1.0):
            at = str(al).replace(".", "p")
            cols += [f"{adj} + {al} * {edge} AS adaptive_plus_realized_alpha{at}_{tag}", f"{adj} - {al} * {edge} AS adaptive_minus_realized_alpha{at}_{tag}"]
    return (
        f"SELECT r.market_slug, r.wallet, {', '.join(cols)} FROM b_real r JOIN b_derisk x USING (market_slug, wallet) "
        "LEFT JOIN b_lotagg a USING (market_slug, wallet) JOIN b_series d USING (market_slug) JOIN b_spike sp USING (market_slug)"
    )


B["x_adaptive"] = _adaptive_sql()

COUNTS = {
    "n_low_buy_building_trades_pctl10", "n_high_sell_nonflattening_trades_pctl90", "n_low_buy_building_trades",
    "n_high_sell_nonflattening_trades", "n_distinct_buy_days", "n_distinct_sell_days", "n_distinct_active_days",
}
Q["entry_features"] = rounded("x_entry", KEY, PB.ENTRY)
Q["unrealized_features"] = rounded("x_unrealized", KEY, PB.UNREALIZED)
Q["holding_features"] = rounded("x_position", KEY, HOLDING)
Q["path_features"] = rounded("x_position", KEY, PATH)
Q["markout_grid"] = rounded("x_grid", KEY, PB.GRID)
Q["fixed_markouts"] = rounded("x_fixed", KEY, PB.FIXED)
Q["realized_features"] = rounded("x_realized", KEY, PB.REALIZED)
Q["contrarian_features"] = rounded("x_contrarian", KEY, PB.CONTRARIAN)
Q["extreme_features"] = rounded("x_extreme", KEY, PB.EXTREME, counts=COUNTS)
Q["day_features"] = rounded("x_days", KEY, PB.DAYS, counts=COUNTS)
Q["adaptive_features"] = rounded("x_adaptive", KEY, PB.ADAPTIVE)
Q["major_moves"] = rounded("x_major", "market_slug", PB.MAJOR)
_joined = (
    "b_tot t JOIN x_major USING (market_slug) LEFT JOIN x_entry USING (market_slug, wallet) LEFT JOIN x_unrealized USING (market_slug, wallet) "
    "LEFT JOIN x_position USING (market_slug, wallet) LEFT JOIN x_grid USING (market_slug, wallet) LEFT JOIN x_fixed USING (market_slug, wallet) "
    "LEFT JOIN x_realized USING (market_slug, wallet) LEFT JOIN x_contrarian USING (market_slug, wallet) LEFT JOIN x_extreme USING (market_slug, wallet) "
    "LEFT JOIN x_days USING (market_slug, wallet) LEFT JOIN x_adaptive USING (market_slug, wallet)"
)
Q["behavior_vector"] = rounded(_joined, "t.market_slug, t.wallet", PB.BEHAVIOR_COLUMNS, counts=COUNTS, count_type="double")


# ------------------------------------------------------- scans, parsing, joins

Q["fills_time_asset_scan"] = """
SELECT id, "timestamp", maker, taker, "makerAssetId", "takerAssetId" FROM b_fills
WHERE "timestamp" BETWEEN 1704500000 AND 1705500000 AND ("makerAssetId" IN ('m1-Y', 'm2-N') OR "takerAssetId" IN ('m1-Y', 'm2-N'))"""
Q["fills_tagged_legs"] = """
SELECT id, 'maker' AS query_side, "makerAssetId" AS queried_token_id FROM b_fills WHERE "makerAssetId" <> '0'
UNION ALL SELECT id, 'taker', "takerAssetId" FROM b_fills WHERE "takerAssetId" <> '0'"""
Q["fills_source_fallback"] = 'SELECT id, market_slug, "timestamp" FROM b_fills'
Q["secondary_fill_mapping"] = """
SELECT 't' || event_id || '_' || substr('asset-number-' || event_id, 1, 16) || '_' || ts AS id, ts AS "timestamp", 't' || event_id AS "transactionHash",
  '' AS "orderHash", '0x' || repeat('0', 40) AS maker, 'w' || user_id AS taker,
  CASE WHEN event_type = 'purchase' THEN 'asset-number-' || event_id ELSE '0' END AS "makerAssetId",
  CASE WHEN event_type = 'purchase' THEN '0' ELSE 'asset-number-' || event_id END AS "takerAssetId",
  CASE WHEN event_type = 'purchase' THEN tok ELSE csh END AS "makerAmountFilled", CASE WHEN event_type = 'purchase' THEN csh ELSE tok END AS "takerAmountFilled",
  '0' AS fee, 'taker' AS query_side, 'asset-number-' || event_id AS queried_token_id
FROM (SELECT *, cast(round_even(value * 1000000, 0) AS bigint) AS tok, cast(round_even(value * 0.25 * 1000000, 0) AS bigint) AS csh FROM b_ev)"""
Q["market_dimension"] = """
SELECT 'raw-' || g AS slug, CASE WHEN g % 5 = 0 THEN 'Solo' ELSE 'Yes|No' END AS outcomes,
  CASE WHEN g % 5 = 0 THEN 'raw-' || g ELSE 'raw-' || g || '-Y' END AS yes_token_id, CASE WHEN g % 5 = 0 THEN NULL ELSE 'raw-' || g || '-N' END AS no_token_id,
  CASE WHEN g % 3 = 0 THEN a - 3600 ELSE a END AS start_ts, CASE WHEN g % 4 = 0 THEN 1706659200 ELSE b END AS end_ts, g % 4 <> 0 AS closed,
  cast(CASE WHEN g % 7 = 0 THEN 0 ELSE 2 END AS bigint) AS n_prices,
  CASE WHEN g % 4 <> 0 AND g % 7 <> 0 THEN 1 END AS final_outcome
FROM (SELECT user_id % 50 AS g, min(ts) AS a, max(ts) AS b FROM b_ev GROUP BY ALL)"""
Q["wallet_market_order"] = """
SELECT wallet, market_slug, min(ts) AS first_ts, arg_min(trade_id, (ts, trade_id)) AS first_trade_id, count(*) AS n_trades FROM b_yes GROUP BY wallet, market_slug"""
Q["attached_markets"] = """
SELECT market_slug, count(*) AS n, cast(sum("takerAmountFilled") AS bigint) AS taker_micro FROM b_fills GROUP BY market_slug"""
B["b_act"] = """
SELECT 'w' || user_id AS wallet, ts AS "timestamp", CASE WHEN event_type = 'error' THEN 'REDEEM' ELSE 'TRADE' END AS type, 'm' || mk AS slug,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'BUY' ELSE 'SELL' END AS side, value AS "usdcSize", 't' || event_id AS "transactionHash" FROM b_ev"""
Q["activity_scan"] = 'SELECT wallet, "timestamp", slug, side, "usdcSize", "transactionHash" FROM b_act'
B["b_tra"] = """
SELECT 'f' || c_nationkey AS funder, 'w' || (o_custkey % 150) AS "to", o_custkey % 150 AS wno, cast(epoch(o_orderdate) AS bigint) AS ts, 'x' || o_orderkey AS tx_hash, o_orderkey AS seq
FROM orders JOIN customer ON o_custkey = c_custkey"""
B["b_dep"] = """
SELECT "to" AS wallet, arg_min(funder, (ts, seq)) AS funder, min(ts) AS first_deposit_ts, arg_min(tx_hash, (ts, seq)) AS tx_hash FROM b_tra WHERE wno % 11 <> 0 GROUP BY ALL"""
Q["first_deposits"] = "SELECT * FROM b_dep"
B["b_lab"] = """SELECT DISTINCT 'w' || user_id AS wallet, 'm' || mk AS market_slug, cast(user_id % 7 = 0 AS integer) AS is_insider FROM b_ev"""
B["b_feat"] = "SELECT x.*, l.is_insider FROM x_days x JOIN b_lab l USING (market_slug, wallet)"
Q["dataset_summary"] = """
SELECT count(*) AS n_rows, 7::bigint AS n_features, count(*) FILTER (WHERE is_insider = 1) AS n_positives, count(*) FILTER (WHERE is_insider = 0) AS n_negatives,
  count(DISTINCT market_slug) AS n_markets, count(DISTINCT wallet) AS n_wallets FROM b_feat"""
Q["labelled_pairs"] = "SELECT * FROM b_lab"
Q["flagged_wallet_set"] = "SELECT DISTINCT 'w' || user_id AS wallet FROM b_ev WHERE user_id % 17 = 0"
B["b_flag"] = "SELECT DISTINCT 'w' || user_id AS wallet FROM b_ev WHERE user_id % 17 = 0"
Q["feature_upsert"] = """
SELECT wallet, market_slug, cast(sum(cash_micro) AS bigint) AS volume_micro FROM b_yes WHERE wallet IN (SELECT wallet FROM b_flag) GROUP BY wallet, market_slug"""
Q["market_replacement"] = """
SELECT market_slug, wallet, CASE WHEN market_slug = 'm3' THEN 1 - is_insider ELSE is_insider END AS is_insider FROM b_lab"""
Q["file_keys"] = """
SELECT doc_id, CASE WHEN length(s) <= 180 THEN s ELSE substr(s, 1, 170) || '__' || substr(md5(s), 1, 8) END AS file_key
FROM (SELECT doc_id, source || '-' || repeat(lang, n_chars % 120) AS s FROM documents)"""
B["b_vol"] = """
SELECT market_slug, wallet, cast(sum(cash_micro) AS bigint) AS volume_micro, cast(sum(token_micro) AS bigint) AS tokens_micro, count(*) AS n_trades FROM b_yes GROUP BY market_slug, wallet"""
Q["result_slices"] = """
SELECT wallet, market_slug, round(tokens_micro % 997 / 997, 8) + 0.0 AS pred_prob, true AS flagged, round(volume_micro / 1e6, 8) + 0.0 AS volume, n_trades
FROM b_vol WHERE volume_micro > 100 * 1000000 AND tokens_micro % 997 / 997 >= 0.8"""
Q["deduplicated_fills"] = """
SELECT market_slug, count(*) + count(*) FILTER (WHERE "timestamp" % 5 = 0) AS n_provenance, count(*) AS n_id FROM b_fills GROUP BY market_slug"""
Q["ordered_fills"] = """SELECT "timestamp", "transactionHash", "orderHash", id FROM b_fills ORDER BY 1, 2, 3, 4"""
Q["parsed_trades"] = """
SELECT market_slug, trade_id, ts, wallet, role, side, outcome, token_id, token_micro / 1e6 AS token_amount, cash_micro / 1e6 AS cash_amount, counterparty FROM b_trades"""
Q["quarantined_trades"] = """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN token_micro <= 0 OR ts % 11 = 0 THEN 'token_amount must be > 0' WHEN ts % 13 = 0 THEN 'unexpected outcome' END AS reason FROM b_trades)
WHERE reason IS NOT NULL GROUP BY reason"""
Q["yes_trades"] = """
SELECT market_slug, trade_id, wallet, role, norm_side, 'Yes' AS norm_outcome, round(price, 8) + 0.0 AS price, round(norm_price, 8) + 0.0 AS norm_price,
  round(signed_micro / 1e6, 8) + 0.0 AS signed_yes_amount FROM b_yes"""
Q["display_trades"] = """
SELECT market_slug, wallet, trade_id, role, side AS original_side, outcome AS original_outcome, round(norm_price, 8) + 0.0 AS yes_trade_price,
  norm_side || '_YES' AS yes_action, round(signed_micro / 1e6, 8) + 0.0 AS signed_yes_qty FROM b_yes"""
_H = "round(yes_price, 8) + 0.0 AS yes_price, token_id, round(token_amount, 8) + 0.0 AS token_amount, round(cash_amount, 8) + 0.0 AS cash_amount"
Q["price_history"] = f"SELECT market_slug, trade_id, ts, {_H} FROM b_hist"
B["b_hour"] = "SELECT * REPLACE (ts // 3600 * 3600 AS ts) FROM b_raw_hist"
Q["hourly_history_first"] = f"""
SELECT market_slug, ts, trade_id, {_H} FROM (SELECT *, row_number() OVER (PARTITION BY market_slug, ts ORDER BY trade_id) AS rn FROM b_hour) WHERE rn = 1"""
Q["hourly_history_mean"] = """
SELECT market_slug, ts, max(trade_id) AS trade_id, arg_max(token_id, trade_id) AS token_id, round(avg(yes_price), 8) + 0.0 AS yes_price,
  round(avg(token_amount), 8) + 0.0 AS token_amount, round(avg(cash_amount), 8) + 0.0 AS cash_amount FROM b_hour GROUP BY market_slug, ts"""
Q["history_yes_only"] = f"SELECT market_slug, trade_id, ts, {_H} FROM b_hour WHERE token_id LIKE '%-Y'"
Q["prepared_history"] = """
SELECT 'm' || event_id % 8 AS market_slug, event_id AS ts, value AS yes_price FROM events WHERE event_id % 10 <> 0 AND event_id % 9 <> 0"""
Q["market_volume"] = """
SELECT market_slug, ts, round(cash / 1e6, 8) + 0.0 AS cash_amount, round(token / 1e6, 8) + 0.0 AS token_amount, CASE WHEN is_no THEN 'NO' ELSE 'YES' END AS outcome,
  round(CASE WHEN token > 0 THEN CASE WHEN is_no THEN 1 - cash / token ELSE cash / token END END, 8) + 0.0 AS yes_price FROM b_ev4"""
Q["wallet_ledger"] = "SELECT market_slug, wallet, trade_id, role, seq, inventory, inventory_before FROM b_ledger"
Q["plot_window"] = """
SELECT 'curve' AS part, market_slug, ts, NULL AS wallet, round(yes_price, 8) + 0.0 AS yes_price FROM b_hist WHERE ts BETWEEN 1704400000 AND 1704800000
UNION ALL SELECT 'trade', market_slug, ts, wallet, round(h_p, 8) + 0.0 FROM b_ynear WHERE ts BETWEEN 1704400000 AND 1704800000"""
B["b_top"] = "SELECT *, row_number() OVER (PARTITION BY market_slug ORDER BY volume_micro DESC, wallet) AS rank FROM b_vol"
Q["top_volume_report"] = """
SELECT market_slug, wallet, round(volume_micro / 1e6, 8) + 0.0 AS volume, n_trades, rank FROM b_top WHERE rank <= 20 AND volume_micro > 100 * 1000000"""
Q["feature_subset"] = """
SELECT market_slug, wallet, round(buy_markout_mean_300s, 8) + 0.0 AS buy_markout_mean_300s, round(path_alignment, 8) + 0.0 AS path_alignment, n_distinct_active_days
FROM x_position LEFT JOIN x_fixed USING (market_slug, wallet) LEFT JOIN x_days USING (market_slug, wallet)"""
Q["model_matrix"] = """
SELECT wallet, market_slug, cast(n_distinct_active_days AS double) + 0.0 AS n_distinct_active_days, cast(NULL AS double) AS no_such_feature,
  round(active_day_frac, 8) + 0.0 AS active_day_frac FROM x_days"""
Q["selected_wallet_trades"] = """
SELECT replace(wallet, 'w', 'W') AS requested_wallet, wallet, market_slug, trade_id, role, side, token_micro / 1e6 AS token_amount FROM b_trades
WHERE wallet IN (SELECT 'w' || user_id FROM b_ev WHERE user_id % 25 = 0)"""
Q["active_candidates"] = """
SELECT wallet, market_slug, n_trades FROM b_vol WHERE n_trades > 15 AND wallet NOT IN (SELECT wallet FROM b_flag)"""
_S = ", ".join(
    f"count(*) FILTER (WHERE side = '{s}' AND outcome = '{o}') AS {s}_{o}, coalesce(sum(token_micro) FILTER (WHERE side = '{s}' AND outcome = '{o}'), 0) AS {s}_{o}_m"
    for s in ("BUY", "SELL") for o in ("Yes", "No")
)
B["b_sum"] = f"SELECT market_slug, wallet, count(*) AS n_trades, {_S} FROM b_yes GROUP BY market_slug, wallet"
_all = [f"{s}_{o}" for s in ("BUY", "SELL") for o in ("Yes", "No")]
B["b_wsum"] = (
    "SELECT market_slug, wallet, n_trades, " + ", ".join(_all) + ", " + ", ".join(f"{c}_m / 1e6 AS {c}_amount" for c in _all)
    + f", {' + '.join(_all)} AS total_activity, ({' + '.join(c + '_m' for c in _all)}) / 1e6 AS total_amount, "
    + ", ".join(f"(BUY_{o}_m - SELL_{o}_m) / 1e6 AS net_{o}_amount, (BUY_{o}_m + SELL_{o}_m) / 1e6 AS gross_{o}_amount" for o in ("Yes", "No"))
    + " FROM b_sum"
)
_SUMD = [f"{c}_amount" for c in _all] + ["total_amount"] + [f"{k}_{o}_amount" for o in ("Yes", "No") for k in ("net", "gross")]
Q["wallet_summary"] = rounded("b_wsum", "market_slug, wallet, n_trades, total_activity, " + ", ".join(_all), _SUMD)
B["b_bin"] = """
SELECT market_slug, wallet, n_trades, BUY_Yes + SELL_No AS BUY_Yes_norm, SELL_Yes + BUY_No AS SELL_Yes_norm,
  (BUY_Yes_m + SELL_No_m) / 1e6 AS BUY_Yes_norm_amount, (SELL_Yes_m + BUY_No_m) / 1e6 AS SELL_Yes_norm_amount,
  least(BUY_Yes + SELL_No, SELL_Yes + BUY_No) AS min_side, n_trades AS total_activity_norm,
  least(BUY_Yes_m + SELL_No_m, SELL_Yes_m + BUY_No_m) / 1e6 AS min_side_amount,
  (BUY_Yes_m + SELL_No_m + SELL_Yes_m + BUY_No_m) / 1e6 AS total_activity_norm_amount, (BUY_Yes_m + SELL_No_m - SELL_Yes_m - BUY_No_m) / 1e6 AS net_norm_amount FROM b_sum"""
Q["binary_summary"] = rounded("b_bin", "market_slug, wallet, n_trades, BUY_Yes_norm, SELL_Yes_norm, min_side, total_activity_norm",
                              ["BUY_Yes_norm_amount", "SELL_Yes_norm_amount", "min_side_amount", "total_activity_norm_amount", "net_norm_amount"])
_RK = {
    "total": "total_activity DESC", "total_amount": "total_amount DESC, total_activity DESC",
    "abs_net_amount": "round(abs(net_Yes_amount) + abs(net_No_amount), 6) DESC, total_amount DESC", "min_norm": "min_side DESC, total_activity_norm DESC",
    "total_norm": "total_activity_norm DESC, min_side DESC", "total_norm_amount": "round(total_activity_norm_amount, 6) DESC, total_activity_norm DESC",
    "abs_net_norm_amount": "round(abs(net_norm_amount), 6) DESC, total_activity_norm_amount DESC",
}
Q["wallet_rankings"] = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{n}' AS ranking, market_slug, wallet, row_number() OVER (PARTITION BY market_slug ORDER BY {o}, wallet) AS rank "
    f"FROM b_wsum JOIN b_bin USING (market_slug, wallet)) WHERE rank <= 10" for n, o in _RK.items()
)
Q["top_wallets"] = """
SELECT market_slug, wallet, volume_micro, rank, round(net_Yes_amount, 8) + 0.0 AS net_Yes_amount, round(gross_Yes_amount, 8) + 0.0 AS gross_Yes_amount,
  round(net_No_amount, 8) + 0.0 AS net_No_amount, round(gross_No_amount, 8) + 0.0 AS gross_No_amount
FROM b_top JOIN b_wsum USING (market_slug, wallet) WHERE rank <= 20"""
B["b_probe"] = "SELECT 'm' || ((mk + 3) % 8) AS market_slug, event_id, ts FROM b_ev"
B["b_near"] = """
SELECT p.market_slug, p.event_id, p.ts, b.ts AS b_ts, b.yes_price AS b_p, f.ts AS f_ts, f.yes_price AS f_p,
  b.ts IS NOT NULL AND (f.ts IS NULL OR p.ts - b.ts <= f.ts - p.ts) AS use_b
FROM b_probe p ASOF LEFT JOIN b_hist b ON p.market_slug = b.market_slug AND p.ts >= b.ts
ASOF LEFT JOIN b_hist f ON p.market_slug = f.market_slug AND p.ts <= f.ts"""
B["b_near2"] = """SELECT event_id, ts, CASE WHEN use_b THEN b_ts ELSE f_ts END AS h_ts, CASE WHEN use_b THEN b_p ELSE f_p END AS h_p FROM b_near"""
Q["nearest_history"] = "SELECT event_id, h_ts AS history_ts, round(h_p, 8) + 0.0 AS history_yes_price FROM b_near2"
Q["nearest_history_within"] = """
SELECT event_id, CASE WHEN abs(h_ts - ts) <= 300 THEN h_ts END AS history_ts, CASE WHEN abs(h_ts - ts) <= 300 THEN round(h_p, 8) + 0.0 END AS history_yes_price FROM b_near2"""
Q["price_at_or_after"] = """
SELECT p.event_id, round(coalesce(h.yes_price, s.last_price), 8) + 0.0 AS yes_price FROM (SELECT *, ts + 86400 AS at_ FROM b_probe) p
ASOF LEFT JOIN b_hist h ON p.market_slug = h.market_slug AND p.at_ <= h.ts JOIN b_series s ON s.market_slug = p.market_slug"""
Q["price_at_or_before"] = """
SELECT p.event_id, round(coalesce(h.yes_price, s.first_price), 8) + 0.0 AS yes_price FROM (SELECT *, ts - 86400 AS at_ FROM b_probe) p
ASOF LEFT JOIN b_hist h ON p.market_slug = h.market_slug AND p.at_ >= h.ts JOIN b_series s ON s.market_slug = p.market_slug"""
Q["trailing_windows"] = """
SELECT market_slug, ts, round(slope * 21600, 6) + 0.0 AS trend_move, round(trail_std, 8) + 0.0 AS trail_std, round(trail_abs_step, 8) + 0.0 AS trail_abs_step FROM b_trail"""
Q["realized_matches"] = """
SELECT market_slug, wallet, CASE WHEN entry_sign = 1 THEN 'BUY' ELSE 'SELL' END AS entry_side, e_id AS entry_trade_id, e_role AS entry_role_no, x_id AS exit_trade_id,
  x_role AS exit_role_no, hi - lo AS qty_micro, round(pnl, 8) + 0.0 AS raw_realized_pnl_per_token FROM b_seg WHERE matched"""
Q["open_lots"] = """
SELECT market_slug, wallet, e_id AS trade_id, e_role AS role_no, entry_sign * (hi - lo) AS signed_qty_micro, round(e_p, 8) + 0.0 AS price FROM b_seg WHERE NOT matched"""
Q["lot_table"] = (
    "SELECT market_slug, wallet, trade_id, role_no, entry_time, round(entry_price, 8) + 0.0 AS entry_price, original_micro, remaining_micro, side_sign, "
    + ", ".join(map(derisk_name, DERISK_THRESHOLDS)) + " FROM b_lots"
)
Q["lot_close_events"] = """
SELECT c.market_slug, c.wallet, l.trade_id AS lot_trade_id, l.role_no AS lot_role_no, c.x_ts AS time, round(c.x_p, 8) + 0.0 AS price, round(c.qty / 1e6, 8) + 0.0 AS tokens,
  round((l.original_micro - c.cum) / 1e6, 8) + 0.0 AS remaining_after FROM b_closing c JOIN b_lot0 l USING (market_slug, wallet, e_seq)"""
Q["lot_intervals"] = """
SELECT market_slug, wallet, e_seq AS from_seq, x_seq AS until_seq, round(entry_sign * (hi - lo) / 1e6, 8) + 0.0 AS qty, round(e_p, 8) + 0.0 AS price FROM b_seg"""
B["b_eff"] = """
SELECT market_slug, wallet, e_seq AS seq, entry_sign * (hi - lo) * e_p AS dc, 0.0 AS dp FROM b_seg
UNION ALL SELECT market_slug, wallet, x_seq, -entry_sign * (hi - lo) * e_p, (hi - lo) * pnl FROM b_seg WHERE matched"""
B["b_eff2"] = "SELECT market_slug, wallet, seq, sum(dc) AS dc, sum(dp) AS dp FROM b_eff GROUP BY ALL"
B["b_tl"] = """
SELECT l.*, coalesce(dp, 0) AS dp, sum(coalesce(dc, 0)) OVER w AS cost, sum(coalesce(dp, 0)) OVER w AS pnl FROM b_ledger l LEFT JOIN b_eff2 USING (market_slug, wallet, seq)
WINDOW w AS (PARTITION BY l.market_slug, l.wallet ORDER BY seq)"""
Q["pnl_timeline"] = """
SELECT market_slug, wallet, trade_id, role_no, round(dp / 1e6, 6) + 0.0 AS realized_pnl_this_trade, round(pnl / 1e6, 6) + 0.0 AS cumulative_realized_pnl,
  round(inventory / 1e6, 6) + 0.0 AS position_qty, CASE WHEN inventory = 0 THEN 0.0 ELSE round(cost / 1e6, 6) + 0.0 END AS position_cost_basis,
  CASE WHEN inventory <> 0 THEN round(cost / inventory, 6) + 0.0 END AS avg_entry_price FROM b_tl"""
Q["lot_markouts"] = (
    "SELECT market_slug, wallet, trade_id, role_no, entry_time, w AS remaining_micro, held, "
    + ", ".join(f"round(mv{i}, 8) + 0.0 AS mv{i}" for i in range(5)) + " FROM b_lotmv"
)
Q["price_lookups"] = "SELECT market_slug, ts, " + ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in ("price_at", "fut0", "fut4", "past0", "past4", "fix300", "fix86400")) + " FROM b_lk"
B["b_mid"] = """
SELECT p.market_slug, p.ts, CASE WHEN b.ts IS NOT NULL AND (f.ts IS NULL OR p.ts - b.ts <= f.ts - p.ts) THEN b.yes_price ELSE f.yes_price END AS price
FROM (SELECT slug AS market_slug, (start_ts + end_ts) // 2 AS ts FROM b_mk) p ASOF LEFT JOIN b_hist b ON p.market_slug = b.market_slug AND p.ts >= b.ts
ASOF LEFT JOIN b_hist f ON p.market_slug = f.market_slug AND p.ts <= f.ts"""
Q["given_move_times"] = "SELECT market_slug, ts AS major_move_time, round(price, 8) + 0.0 AS major_move_start_price FROM b_mid"
Q["terminal_spikes"] = "SELECT * FROM b_spike"
Q["market_facts"] = rounded("b_dims", "market_slug, outcome, h_start, h_end, h_rows", ["price_min", "price_max", "last_price", "p10", "p25", "p75", "p90"])
Q["price_changes"] = "SELECT market_slug, ts, round(ret, 8) + 0.0 AS ret FROM b_step"
Q["step_series"] = """
SELECT market_slug, ts AS from_ts, lead(ts) OVER (PARTITION BY market_slug ORDER BY ts) AS until_ts, round(yes_price, 8) + 0.0 AS yes_price FROM b_hist"""
Q["entry_markers"] = """
SELECT wallet, market_slug, trade_id, role, ts, round(norm_price, 8) + 0.0 AS norm_price FROM (
  SELECT *, row_number() OVER (PARTITION BY wallet, market_slug ORDER BY ts, trade_id, role) AS rn FROM b_yes) WHERE rn = 1"""
Q["market_concentration"] = """
SELECT wallet, round(sum(v * v) / (sum(v) * sum(v)), 8) + 0.0 AS hhi FROM (SELECT wallet, market_slug, cast(sum(cash_micro) AS double) AS v FROM b_yes GROUP BY ALL) GROUP BY wallet"""
B["b_ynear"] = """
SELECT p.*, CASE WHEN b.ts IS NOT NULL AND (f.ts IS NULL OR p.ts - b.ts <= f.ts - p.ts) THEN b.yes_price ELSE f.yes_price END AS h_p
FROM b_yes p ASOF LEFT JOIN b_hist b ON p.market_slug = b.market_slug AND p.ts >= b.ts ASOF LEFT JOIN b_hist f ON p.market_slug = f.market_slug AND p.ts <= f.ts"""
Q["plot_trades"] = """
SELECT y.wallet, y.market_slug, y.trade_id, y.role, t.rank, round(h_p, 8) + 0.0 AS history_yes_price, round(least(36 + 18 * sqrt(token_micro / 1e6), 160), 8) + 0.0 AS marker_size
FROM b_ynear y JOIN b_top t ON t.market_slug = y.market_slug AND t.wallet = y.wallet WHERE t.rank <= 5"""
Q["plot_limits"] = """
SELECT market_slug, round(min(p) - (max(p) - min(p)) * 0.05, 8) + 0.0 AS y_min, round(max(p) + (max(p) - min(p)) * 0.05, 8) + 0.0 AS y_max
FROM (SELECT market_slug, yes_price AS p FROM b_hist UNION ALL SELECT market_slug, h_p FROM b_ynear) GROUP BY market_slug"""
Q["display_scalars"] = """
SELECT c_custkey, CASE WHEN length(s) <= 30 THEN s ELSE substr(s, 1, 29) || '...' END AS short_market, substr(replace(s, '-', ''), 1, 24) AS slug8,
  round(1 / (1 + exp(-(-2.0 * (v / 10000) + 0.5))), 8) AS calibrated, round(1 - 1 / (1 + exp(-(-2.0 * (v / 10000) + 0.5))), 8) AS calibrated_rev,
  round(CASE WHEN v / 10000 > 0 THEN least(1 / pow(v / 10000, 1.5), 8) ELSE 8 END, 8) AS weight, round(greatest(0.0, least(1.0, v / 5000)), 8) AS clipped,
  round(least(36 + 18 * sqrt(greatest(v, 0)), 160), 8) AS marker
FROM (SELECT c_custkey, c_mktsegment, c_acctbal AS v, 'will-' || c_name || '-of-' || c_mktsegment AS s FROM customer)"""
Q["unit_labels"] = """
SELECT c_custkey, '$' || format('{:,}', v) AS usdc, format('{:,.1f}', v::double) AS n,
  CASE WHEN k = 0 AND v <> 0 THEN '∞' WHEN k = 0 THEN '1.0×' WHEN v / k >= 100 THEN format('{:,.0f}', v / k) || '×' ELSE format('{:,.2f}', v / k) || '×' END AS ratio
FROM (SELECT c_custkey, cast(floor(c_acctbal) AS bigint) AS v, c_custkey % 3 AS k FROM customer)"""
Q["scheme_labels"] = """
SELECT o_custkey, ['(none)', 'StratifiedGroupKFold(shuffle=True)', 'GroupKFold', 'TimeSeriesSplit'][k % 4 + 1] AS scheme,
  ['row-level 80/20', 'group', 'pinned', 'random by market (seeded)', 'time'][k % 5 + 1] AS kind,
  array_to_string(ms[1:2], ', ') || CASE WHEN len(ms) > 2 THEN ', (+' || (len(ms) - 2) || ' more)' ELSE '' END AS markets
FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS ms, max(o_orderkey) AS k FROM orders GROUP BY o_custkey)"""

# ------------------------------------------------------------------- metadata

B["b_wpairs"] = """
SELECT DISTINCT wallet, slug AS market_slug FROM b_act UNION ALL SELECT DISTINCT wallet, 'm-unknown' FROM b_act WHERE slug = 'm0'"""
B["b_am"] = """
SELECT *, cast(round("usdcSize" * 1e6) AS bigint) AS u, CASE WHEN type = 'TRADE' AND side = 'BUY' THEN -1 WHEN type = 'TRADE' AND side <> 'SELL' THEN 0 ELSE 1 END AS sg FROM b_act"""
B["b_life"] = """
SELECT wallet, slug AS market_slug, min("timestamp") AS as_of_ts, sum(u) AS mv FROM b_am WHERE type = 'TRADE' GROUP BY wallet, slug"""
B["b_pre"] = """
SELECT p.wallet, p.market_slug, a.slug, sum(u) FILTER (WHERE a.type = 'TRADE') AS v, count(*) FILTER (WHERE a.type = 'TRADE') AS k, sum(u * sg) AS pnl
FROM b_life p JOIN b_am a ON a.wallet = p.wallet AND a."timestamp" <= p.as_of_ts GROUP BY p.wallet, p.market_slug, a.slug"""
B["b_pre2"] = """
SELECT wallet, market_slug, count(*) FILTER (WHERE k > 0) AS n_tm, count(*) FILTER (WHERE pnl > 0) / count(*) AS winrate,
  sum(cast(v AS double) * v) / nullif(cast(sum(v) AS double) * sum(v), 0) AS hhi,
  CASE WHEN count(*) >= 2 AND stddev_pop(pnl) > 1e-6 THEN avg(pnl) / stddev_pop(pnl) END AS sharpe FROM b_pre GROUP BY wallet, market_slug"""
B["b_size"] = """
SELECT wallet, sum(u) / count(*) / 1e6 AS a, median("usdcSize") AS m, sum(u) / 1e6 AS t, cast(sum(u) AS bigint) AS tot FROM b_am WHERE type = 'TRADE' GROUP BY wallet"""
B["b_recip"] = """
SELECT funder, "to", min(ts) AS ts, max(CASE WHEN "to" IN (SELECT wallet FROM b_flag) THEN 1 ELSE 0 END) AS hit FROM b_tra GROUP BY ALL"""
B["b_meta"] = """
SELECT p.wallet, p.market_slug, l.as_of_ts, CASE WHEN l.as_of_ts IS NOT NULL THEN d.funder END AS funder, CASE WHEN l.as_of_ts IS NOT NULL THEN d.first_deposit_ts END AS first_deposit_ts,
  CASE WHEN d.funder IS NOT NULL THEN (SELECT count(*) > 1000 FROM b_recip r WHERE r.funder = d.funder) END AS funder_over_cap,
  CASE WHEN l.as_of_ts IS NULL THEN 'no TRADE activity on market' END AS error,
  cast(q.n_tm AS double) AS n_markets_traded, cast(l.as_of_ts - d.first_deposit_ts AS double) AS wallet_age_seconds, cast(l.as_of_ts - m.start_ts AS double) AS market_age_seconds,
  (l.as_of_ts - d.first_deposit_ts) / greatest(l.as_of_ts - m.start_ts, 1) AS wallet_to_market_age_ratio,
  cast(l.as_of_ts - d.first_deposit_ts - (l.as_of_ts - m.start_ts) AS double) AS wallet_minus_market_age_seconds,
  q.winrate, CASE WHEN l.as_of_ts IS NOT NULL THEN s.a END AS avg_bet_size_usdc, CASE WHEN l.as_of_ts IS NOT NULL THEN s.m END AS median_bet_size_usdc,
  CASE WHEN l.as_of_ts IS NOT NULL THEN s.t END AS total_bet_size_usdc,
  CASE WHEN d.funder IS NOT NULL THEN (SELECT cast(count(*) AS double) FROM b_recip r WHERE r.funder = d.funder AND r.ts <= l.as_of_ts) END AS n_wallets_same_funder,
  CASE WHEN d.funder IS NOT NULL THEN (SELECT cast(greatest(count(*) - 1, 0) AS double) FROM b_recip r WHERE r.funder = d.funder AND r.ts <= l.as_of_ts) END AS n_other_wallets_same_funder,
  CASE WHEN l.as_of_ts IS NOT NULL THEN coalesce(q.hhi, 0) END AS herfindahl_index_markets,
  CASE WHEN l.as_of_ts IS NOT NULL THEN cast(q.n_tm = 1 AS double) END AS is_first_market,
  cast(l.as_of_ts - d.first_deposit_ts AS double) AS time_since_first_deposit_to_first_trade_seconds, l.mv / s.tot AS lifetime_volume_share_on_market, q.sharpe AS pnl_sharpe,
  CASE WHEN d.funder IS NOT NULL THEN (SELECT cast(coalesce(sum(hit), 0) AS double) FROM b_recip r WHERE r.funder = d.funder AND r.ts <= l.as_of_ts) END AS funder_flagged_wallet_count
FROM b_wpairs p LEFT JOIN b_life l USING (wallet, market_slug) LEFT JOIN b_pre2 q USING (wallet, market_slug) LEFT JOIN b_mk m ON m.slug = p.market_slug
LEFT JOIN b_dep d ON d.wallet = p.wallet AND l.as_of_ts IS NOT NULL LEFT JOIN b_size s ON s.wallet = p.wallet"""
Q["metadata_features"] = rounded("b_meta", "wallet, market_slug, as_of_ts, funder, first_deposit_ts, funder_over_cap, error", METADATA_COLUMNS)
Q["wallet_market_pnl"] = "SELECT wallet, slug AS market_slug, round(sum(u * sg) / 1e6, 8) + 0.0 AS pnl FROM b_am GROUP BY wallet, slug"
Q["first_trade_times"] = "SELECT wallet, market_slug, min(ts) AS as_of_ts FROM b_yes GROUP BY wallet, market_slug"
B["b_points"] = "SELECT DISTINCT funder, ts + 86400 AS as_of_ts FROM b_tra"
Q["funder_siblings"] = """
SELECT p.funder, p.as_of_ts, count(r.ts) AS n_siblings, cast(coalesce(sum(r.hit), 0) AS bigint) AS n_flagged_siblings, max(c.n) > 60 AS over_cap
FROM b_points p LEFT JOIN b_recip r ON r.funder = p.funder AND r.ts <= p.as_of_ts JOIN (SELECT funder, count(*) AS n FROM b_recip GROUP BY funder) c ON c.funder = p.funder
GROUP BY p.funder, p.as_of_ts"""
B["b_tlp"] = """
SELECT p.wallet, p.ts, a.slug, sum(u) FILTER (WHERE a.type = 'TRADE') AS v, count(*) FILTER (WHERE a.type = 'TRADE') AS k, sum(u * sg) AS pnl
FROM (SELECT DISTINCT wallet, "timestamp" AS ts FROM b_am) p JOIN b_am a ON a.wallet = p.wallet AND a."timestamp" <= p.ts GROUP BY p.wallet, p.ts, a.slug"""
Q["wallet_timeline"] = """
SELECT wallet, ts, count(*) FILTER (WHERE k > 0) AS n_trade_markets, count(*) AS n_markets, count(*) FILTER (WHERE pnl > 0) AS n_winning,
  cast(coalesce(sum(v), 0) AS bigint) AS vol, cast(sum(pnl) AS bigint) AS pnl FROM b_tlp GROUP BY wallet, ts"""
Q["wallet_bet_sizes"] = """
SELECT wallet, round(a, 8) + 0.0 AS avg_bet_size_usdc, round(m, 8) + 0.0 AS median_bet_size_usdc, round(t, 8) + 0.0 AS total_bet_size_usdc, tot AS lifetime_micro FROM b_size"""

# ------------------------------------------------------------------- datasets

B["b_pos"] = "SELECT wallet, market_slug FROM b_lab WHERE is_insider = 1"
Q["strict_join"] = """
SELECT wallet, market_slug, round(active_day_frac, 8) + 0.0 AS active_day_frac, round(net_tokens, 8) + 0.0 AS net_tokens FROM x_days JOIN x_position USING (wallet, market_slug)"""
Q["labelled_features"] = "SELECT wallet, market_slug, round(active_day_frac, 8) + 0.0 AS active_day_frac, is_insider FROM b_feat"
Q["unlabelled_count"] = "SELECT count(*) AS dropped FROM x_days x WHERE NOT EXISTS (SELECT 1 FROM b_lab l WHERE l.wallet = x.wallet AND l.market_slug = x.market_slug)"
Q["positive_presence"] = """
SELECT p.wallet, p.market_slug, v.wallet IS NOT NULL AS present FROM (SELECT * FROM b_pos UNION ALL SELECT wallet, 'm-unknown' FROM b_flag) p LEFT JOIN b_vol v USING (wallet, market_slug)"""
Q["known_wallet_exclusion"] = "SELECT wallet, market_slug, volume_micro FROM b_vol WHERE wallet NOT IN (SELECT wallet FROM b_pos)"
Q["unmatched_keys"] = "SELECT wallet, market_slug FROM x_days EXCEPT ALL SELECT wallet, market_slug FROM b_lab"
Q["ragged_union"] = """
SELECT wallet, market_slug, n_distinct_active_days, NULL::bigint AS n_distinct_buy_days FROM x_days
UNION ALL SELECT wallet, market_slug, NULL, n_distinct_buy_days FROM x_days"""
Q["stacked_labels"] = """
SELECT wallet, market_slug, n_distinct_active_days, cast(wallet IN (SELECT wallet FROM b_flag) AS integer) AS is_insider, 'scan' AS origin FROM x_days"""
Q["volume_floor"] = """
SELECT market_slug, count(*) AS n_pos, round(quantile_cont(volume_micro / 1e6, 0.25), 8) + 0.0 AS volume_floor FROM b_vol JOIN b_pos USING (wallet, market_slug) GROUP BY market_slug"""
def drawn(*cols, seed=42):
    """The number by which draws are ordered, as in dataset.hash_order."""
    return f"('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(cols)})), 1, 15))::BIGINT"


B["b_floor"] = "SELECT market_slug, count(*) AS n_pos, quantile_cont(volume_micro / 1e6, 0.25) AS fl FROM b_vol JOIN b_pos USING (wallet, market_slug) GROUP BY market_slug"
Q["negative_sample"] = f"""
SELECT DISTINCT wallet, market_slug, 1 AS is_insider FROM b_pos JOIN b_vol USING (wallet, market_slug) UNION ALL
SELECT wallet, market_slug, 0 FROM (
  SELECT v.*, f.n_pos, row_number() OVER (PARTITION BY market_slug ORDER BY {drawn('market_slug', 'wallet')}, wallet) AS rn
  FROM b_vol v JOIN b_floor f USING (market_slug) WHERE wallet NOT IN (SELECT wallet FROM b_pos) AND volume_micro / 1e6 >= fl) WHERE rn <= 2 * n_pos"""
Q["random_market_split"] = f"""
SELECT market_slug, n_rows, size_band, CASE WHEN row_number() OVER (PARTITION BY size_band ORDER BY {drawn('market_slug')}, market_slug) <= 1 THEN 'test' ELSE 'train' END AS split
FROM (SELECT market_slug, count(*) AS n_rows, CASE WHEN count(*) >= 10 THEN 'large' ELSE 'small' END AS size_band FROM b_lab GROUP BY market_slug)"""
Q["grouped_rows"] = f"""
SELECT wallet, market_slug, is_insider, split FROM b_lab JOIN (
  SELECT market_slug, CASE WHEN row_number() OVER (ORDER BY {drawn('market_slug')}, market_slug) <= ceil(count(*) OVER () * 0.15) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT DISTINCT market_slug FROM b_lab)) USING (market_slug)"""
Q["group_folds"] = f"""
SELECT l.*, f.fold FROM b_lab l JOIN (
  SELECT market_slug, cast(CASE WHEN rn // 4 % 2 = 0 THEN rn % 4 ELSE 3 - rn % 4 END AS integer) AS fold FROM (
    SELECT market_slug, row_number() OVER (ORDER BY sum(is_insider) DESC, count(*) DESC, {drawn('market_slug')}, market_slug) - 1 AS rn FROM b_lab GROUP BY market_slug)) f USING (market_slug)"""
Q["row_folds"] = f"""
SELECT cast((row_number() OVER (PARTITION BY is_insider, h % 256 ORDER BY h, wallet, market_slug) - 1 + h % 256) % 5 AS integer) AS fold, is_insider, wallet, market_slug
FROM (SELECT *, {drawn('wallet', 'market_slug')} AS h FROM b_lab)"""
B["b_cls"] = "SELECT market_slug, is_insider, count(*) AS n FROM b_lab GROUP BY market_slug, is_insider"
Q["downsampled_market"] = f"""
SELECT wallet, market_slug, is_insider FROM (
  SELECT l.*, c.n, row_number() OVER (PARTITION BY market_slug, is_insider ORDER BY {drawn('wallet', 'market_slug')}, wallet) AS rn FROM b_lab l JOIN b_cls c USING (market_slug, is_insider))
WHERE market_slug <> 'm1' OR rn <= CASE WHEN is_insider = 1 THEN n - 3
  ELSE least(n, round_even((SELECT n - 3 FROM b_cls WHERE market_slug = 'm1' AND is_insider = 1) * n / (SELECT n FROM b_cls WHERE market_slug = 'm1' AND is_insider = 1), 0)) END"""
Q["markets_without_prefix"] = "SELECT wallet, market_slug, is_insider FROM b_lab WHERE market_slug NOT LIKE 'm1%'"
B["b_timed"] = """
SELECT l.*, CASE WHEN l.market_slug <> 'm2' THEN f.ts END AS t FROM b_lab l JOIN (SELECT wallet, market_slug, min(ts) AS ts FROM b_yes GROUP BY ALL) f USING (wallet, market_slug)"""
B["b_mst"] = "SELECT market_slug, count(*) AS n_rows, cast(sum(is_insider) AS bigint) AS n_pos, median(t) AS median_ts FROM b_timed GROUP BY market_slug"
Q["market_stats"] = """
SELECT market_slug, n_rows, n_pos, round(median_ts, 8) + 0.0 AS median_ts, round(n_pos / n_rows, 8) + 0.0 AS positive_rate, CASE WHEN n_rows >= 12 THEN 'large' ELSE 'small' END AS size_band FROM b_mst"""
Q["pinned_split"] = """
SELECT market_slug, count(*) AS n_rows, cast(sum(is_insider) AS bigint) AS n_pos, CASE WHEN market_slug IN ('m2', 'm5') THEN 'test' ELSE 'train' END AS split FROM b_lab GROUP BY market_slug"""
Q["time_split"] = """
SELECT market_slug, round(median_ts, 8) + 0.0 AS median_ts, CASE WHEN market_slug IN ('m5', 'm6') THEN 'test'
  WHEN median_ts < (SELECT min(median_ts) FROM b_mst WHERE market_slug IN ('m5', 'm6')) THEN 'train' ELSE 'val' END AS split FROM b_mst"""
B["b_labn"] = "SELECT is_insider, count(*) AS n, cast(round(count(*) * 0.2) AS bigint) AS k FROM b_lab GROUP BY is_insider"
Q["stratified_rows"] = f"""
SELECT wallet, market_slug, is_insider, CASE WHEN row_number() OVER (PARTITION BY is_insider ORDER BY {drawn('wallet', 'market_slug')}, wallet, market_slug) <= k THEN 'test' ELSE 'train' END AS split
FROM b_lab JOIN b_labn USING (is_insider)"""
B["b_tf"] = "SELECT *, row_number() OVER (ORDER BY median_ts NULLS LAST, market_slug) - 1 AS rn, count(*) OVER () AS nm FROM b_mst"
Q["time_folds"] = """
SELECT wallet, market_slug, is_insider, CASE WHEN rn < nm - 3 * (nm // 4) THEN 0 ELSE cast((rn - (nm - 3 * (nm // 4))) // (nm // 4) + 1 AS integer) END AS fold
FROM b_timed JOIN b_tf USING (market_slug)"""
Q["leave_one_out_folds"] = f"""
SELECT wallet, market_slug, is_insider, row_number() OVER (ORDER BY h, wallet, market_slug) - 1 AS fold FROM (SELECT *, {drawn('wallet', 'market_slug')} % 1099511627776 AS h FROM b_lab)"""
Q["fold_markets"] = f"""
SELECT fold, market_slug, count(*) AS n_rows, cast(sum(is_insider) AS bigint) AS n_pos FROM ({Q['row_folds']}) GROUP BY fold, market_slug"""
Q["fold_breakdown"] = """
SELECT cast(substr(market_slug, 2, 1) AS integer) % 3 AS fold, count(DISTINCT market_slug) AS n_markets, count(*) AS n_rows, cast(sum(is_insider) AS bigint) AS n_pos,
  array_to_string(list_sort(list(DISTINCT market_slug)), ',') AS markets, round(sum(is_insider) / count(*), 8) + 0.0 AS positive_rate FROM b_lab GROUP BY 1"""
_DAYC = ["n_distinct_buy_days", "n_distinct_sell_days", "buy_day_concentration_hhi", "sell_day_concentration_hhi", "active_day_frac"]
B["b_sep"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) FILTER (WHERE is_insider = 1) AS pm, avg({c}) FILTER (WHERE is_insider = 0) AS nm, count({c}) / count(*) AS coverage FROM b_feat" for c in _DAYC
)
Q["separability"] = """
SELECT feature, round(pm, 8) + 0.0 AS positive_mean, round(nm, 8) + 0.0 AS negative_mean, round(coverage, 8) + 0.0 AS coverage, round(pm / nm, 8) + 0.0 AS ratio FROM b_sep"""
Q["missingness"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round((count(*) - count({c})) / count(*), 8) + 0.0 AS null_frac FROM x_fixed"
    for c in [f"{s}_markout_mean_{h}s" for s in ("buy", "sell") for h in (300, 3600)]
)
Q["availability_flags"] = """
SELECT p.market_slug, p.wallet, round(coalesce(buy_markout_mean_300s, 0), 8) + 0.0 AS buy_markout_mean_300s, round(coalesce(sell_markout_mean_300s, 0), 8) + 0.0 AS sell_markout_mean_300s,
  round(coalesce(realized_pnl_per_matched_token, 0), 8) + 0.0 AS realized_pnl_per_matched_token, 0.0::double AS derisk_0p5_token_frac, round(path_alignment, 8) + 0.0 AS path_alignment,
  round(active_day_frac, 8) + 0.0 AS active_day_frac, cast(buy_markout_mean_300s IS NOT NULL AS integer) AS has_buy, cast(sell_markout_mean_300s IS NOT NULL AS integer) AS has_sell,
  0 AS has_adaptive_features, cast(realized_pnl_per_matched_token IS NOT NULL AS integer) AS has_realized_match, 0 AS has_open_inventory,
  cast(path_alignment IS NOT NULL AS integer) AS has_position_path, cast(active_day_frac IS NOT NULL AS integer) AS has_any_trade
FROM x_position p LEFT JOIN x_fixed USING (market_slug, wallet) LEFT JOIN x_realized USING (market_slug, wallet) LEFT JOIN x_days USING (market_slug, wallet)"""
B["b_clu"] = """
SELECT cluster, count(*) AS size, cast(sum(is_insider) AS bigint) AS positives, sum(is_insider) / count(*) AS rate FROM (
  SELECT *, CASE WHEN cast(substr(wallet, 2) AS integer) % 9 = 0 THEN -1 ELSE cast(substr(wallet, 2) AS integer) % 5 END AS cluster FROM b_lab) GROUP BY cluster"""
Q["cluster_profile"] = """
SELECT cluster, size, positives, round(rate, 8) + 0.0 AS rate, round(rate / (SELECT sum(positives) / sum(size) FROM b_clu), 8) + 0.0 AS lift,
  round(positives / (SELECT sum(positives) FROM b_clu), 8) + 0.0 AS captured, cluster = (SELECT cluster FROM b_clu WHERE cluster <> -1 ORDER BY rate DESC, cluster LIMIT 1) AS purest FROM b_clu"""
Q["feature_sets"] = """
SELECT DISTINCT feature, CASE WHEN feature LIKE 'b%' THEN 'behavior' WHEN feature LIKE 'q%' THEN 'metadata' ELSE 'unknown' END AS kind FROM (
  SELECT 'b' || (s_suppkey % 4) AS feature FROM supplier UNION ALL SELECT 'q' || (s_suppkey % 3) FROM supplier UNION ALL SELECT 'other' FROM supplier)"""

# -------------------------------------------------------------------- metrics

B["b_sc"] = """
SELECT l.doc_id, l.quality AS label, (d.n_chars % 97) / 97.0::double AS score, d.source FROM labels l JOIN documents d USING (doc_id)"""
B["b_tie"] = "SELECT source, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM b_sc GROUP BY source, score"
B["b_grp"] = "SELECT source AS grp, score, pos, neg FROM b_tie UNION ALL SELECT 'all', score, sum(pos), sum(neg) FROM b_tie GROUP BY score"
B["b_curve"] = """
SELECT *, tp / (tp + fp) AS precision, tp / nullif(n_pos, 0) AS recall FROM (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY grp) AS n_pos, sum(neg) OVER (PARTITION BY grp) AS n_neg FROM b_grp
  WINDOW w AS (PARTITION BY grp ORDER BY score DESC))"""
Q["ranking_curve"] = """
SELECT round(score, 8) + 0.0 AS score, cast(tp AS bigint) AS tp, cast(fp AS bigint) AS fp, round(precision, 8) + 0.0 AS precision, round(recall, 8) + 0.0 AS recall FROM b_curve WHERE grp = 'all'"""
Q["cumulative_hits"] = """
SELECT doc_id, rank, cast(tp AS bigint) AS tp, cast(rank - tp AS bigint) AS fp, round(tp / rank, 8) + 0.0 AS precision, round(tp / greatest(p, 1), 8) + 0.0 AS recall FROM (
  SELECT doc_id, row_number() OVER w AS rank, sum(label) OVER w AS tp, (SELECT sum(label) FROM b_sc) AS p FROM b_sc WINDOW w AS (ORDER BY score DESC, doc_id))"""
B["b_pairs"] = """
SELECT a.grp, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END * a.pos * b.neg) AS w FROM b_grp a JOIN b_grp b ON a.grp = b.grp GROUP BY a.grp"""
Q["auc_and_ap"] = """
SELECT c.grp, cast(max(n_pos + n_neg) AS bigint) AS n, cast(max(n_pos) AS bigint) AS n_positives,
  CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN round(max(p.w) / (max(n_pos) * max(n_neg)), 8) + 0.0 END AS roc_auc,
  CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN round(sum(pos * precision) / max(n_pos), 8) + 0.0 END AS pr_auc
FROM b_curve c JOIN b_pairs p USING (grp) GROUP BY c.grp"""
B["b_conf"] = """
SELECT source, count(*) FILTER (WHERE score >= 0.4 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.4 AND label <> 1) AS fp,
  count(*) FILTER (WHERE score < 0.4 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.4 AND label <> 1) AS tn FROM b_sc GROUP BY source"""
_PR = "{a} / greatest({a} + {b}, 1)"


def _f1(p: str, rc: str) -> str:
    return f"2 * ({p}) * ({rc}) / greatest(({p}) + ({rc}), 1e-12)"


_p, _rc = _PR.format(a="tp", b="fp"), _PR.format(a="tp", b="fn")
Q["confusion_counts"] = f"""
SELECT source, tp, fp, fn, tn, round({_p}, 8) + 0.0 AS precision, round({_rc}, 8) + 0.0 AS recall, round({_f1(_p, _rc)}, 8) + 0.0 AS f1 FROM b_conf"""
B["b_conf2"] = "SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM b_conf"
_p0, _r0 = _PR.format(a="tn", b="fn"), _PR.format(a="tn", b="fp")
Q["class_report"] = f"""
SELECT 1 AS class, round({_p}, 8) + 0.0 AS precision, round({_rc}, 8) + 0.0 AS recall, cast(tp + fn AS bigint) AS support, round({_f1(_p, _rc)}, 8) + 0.0 AS f1 FROM b_conf2
UNION ALL SELECT 0, round({_p0}, 8) + 0.0, round({_r0}, 8) + 0.0, cast(tn + fp AS bigint), round({_f1(_p0, _r0)}, 8) + 0.0 FROM b_conf2"""


def _threshold(meets: str, order: str, fallback: str) -> str:
    return f"""
SELECT grp AS source, n_pos > 0 AS ok, CASE WHEN n_pos > 0 THEN round(score, 8) + 0.0 END AS threshold, CASE WHEN n_pos > 0 THEN round(precision, 8) + 0.0 END AS precision,
  CASE WHEN n_pos > 0 THEN round(recall, 8) + 0.0 END AS recall, CASE WHEN n_pos > 0 THEN cast(tp + fp AS bigint) END AS n_pred_pos, cast(n_pos + n_neg AS bigint) AS n_test,
  cast(n_pos AS bigint) AS n_pos, CASE WHEN n_pos > 0 THEN coalesce({meets}, false) END AS reached
FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY coalesce({meets}, false) DESC, CASE WHEN {meets} THEN {order[0]} ELSE {fallback[0]} END DESC,
  CASE WHEN {meets} THEN {order[1]} ELSE {fallback[1]} END DESC, score DESC) AS rn FROM b_curve WHERE grp <> 'all') WHERE rn = 1"""


Q["tuned_threshold_precision"] = _threshold("precision >= 0.9", ("recall", "score"), ("precision", "recall"))
Q["tuned_threshold_recall"] = _threshold("recall >= 0.8", ("precision", "recall"), ("recall", "precision"))
Q["curve_points"] = """
SELECT round(score, 8) + 0.0 AS score, round(fp / nullif(n_neg, 0), 8) + 0.0 AS fpr, round(recall, 8) + 0.0 AS tpr, round(precision, 8) + 0.0 AS precision, round(recall, 8) + 0.0 AS recall,
  round(n_pos / (n_pos + n_neg), 8) + 0.0 AS chance FROM b_curve WHERE grp = 'all'"""
B["b_hb"] = "SELECT min(score) AS lo, (max(score) - min(score)) / 40 AS w FROM b_sc"
Q["score_histogram"] = """
SELECT label, bin, round(lo + bin * w, 8) + 0.0 AS bin_start, n, round(n / (sum(n) OVER (PARTITION BY label)) / w, 8) + 0.0 AS density FROM (
  SELECT label, cast(least(floor((score - lo) / w), 39) AS integer) AS bin, lo, w, count(*) AS n FROM b_sc, b_hb GROUP BY ALL)"""
B["b_fv"] = "SELECT 't' || (o_custkey % 20) AS tag, o_orderkey % 5 AS fold, avg(floor(o_totalprice) / 1000000) AS pr_auc FROM orders GROUP BY ALL"
Q["cv_summary"] = "SELECT tag, round(avg(pr_auc), 8) + 0.0 AS cv_mean, round(stddev_pop(pr_auc), 8) + 0.0 AS cv_std, count(pr_auc) AS n_folds FROM b_fv GROUP BY tag"
Q["reproduction_error"] = """
SELECT a.tag, CASE WHEN a.tag = 't3' THEN 0.0 ELSE round(max(abs(a.v - b.v)), 8) + 0.0 END AS max_abs_diff FROM
  (SELECT tag, pr_auc AS v, row_number() OVER (PARTITION BY tag ORDER BY pr_auc) AS rn FROM b_fv) a LEFT JOIN
  (SELECT tag, pr_auc + fold / 1000 AS v, row_number() OVER (PARTITION BY tag ORDER BY pr_auc + fold / 1000) AS rn FROM b_fv) b ON a.tag = b.tag AND a.rn = b.rn GROUP BY a.tag"""

# -------------------------------------------------------------------- reports

B["b_mod"] = """
SELECT 'tag' || c_custkey AS tag, CASE WHEN c_custkey % 7 <> 0 THEN (v % 500 + 500) / 1000 END AS cv_pr, (v % 30) / 1000 AS cv_std, CASE WHEN c_custkey % 11 <> 0 THEN (v % 400 + 600) / 1000 END AS test_pr,
  (v % 90 + 900) / 1000 AS test_roc, CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey + 5 END AS n_features, v * 3 + 10 AS n_params
FROM (SELECT *, cast(floor(abs(c_acctbal)) AS bigint) AS v FROM customer)"""
Q["model_ranking"] = "SELECT tag, round(cv_pr, 8) + 0.0 AS cv_pr, row_number() OVER (ORDER BY cv_pr DESC NULLS LAST, tag) AS rank FROM b_mod"
Q["model_roc_swap"] = """
SELECT m.tag, round(r.m, 8) + 0.0 AS cv_pr, round(r.s, 8) + 0.0 AS cv_std, round(m.test_roc, 8) + 0.0 AS test_pr FROM b_mod m
LEFT JOIN (SELECT replace(tag, 't', 'tag') AS tag, avg(pr_auc) AS m, stddev_pop(pr_auc) AS s FROM b_fv GROUP BY tag) r ON r.tag = m.tag"""
Q["model_recommendation"] = """
SELECT (SELECT tag FROM b_mod WHERE cv_pr IS NOT NULL ORDER BY cv_pr DESC, tag LIMIT 1) AS best_cv, (SELECT tag FROM b_mod WHERE test_pr IS NOT NULL ORDER BY test_pr DESC, tag LIMIT 1) AS best_test,
  (SELECT tag FROM b_mod WHERE test_pr >= 0.95 AND n_features IS NOT NULL ORDER BY n_features, test_pr DESC, tag LIMIT 1) AS simple_test,
  (SELECT tag FROM b_mod WHERE cv_pr >= (SELECT max(cv_pr) - 0.05 FROM b_mod) AND n_features IS NOT NULL ORDER BY n_features, cv_pr DESC, tag LIMIT 1) AS simple_cv"""
Q["leanest_model"] = """
SELECT tag, n_params, round(cv_pr, 8) + 0.0 AS cv_pr FROM b_mod WHERE cv_pr >= (SELECT max(cv_pr) - 0.05 FROM b_mod) ORDER BY n_params, cv_pr DESC, tag LIMIT 1"""
Q["cv_against_test"] = """
SELECT tag, round(cv_pr, 8) + 0.0 AS cv_pr, round(test_pr, 8) + 0.0 AS test_pr, round(test_pr - cv_pr, 8) + 0.0 AS gap, test_pr < cv_pr AS cv_optimistic FROM b_mod
WHERE cv_pr IS NOT NULL AND test_pr IS NOT NULL"""
B["b_art"] = "SELECT 'tag' || (o_custkey % 40) AS tag, 'run_' || o_orderkey || '.json' AS path, cast(epoch(o_orderdate) AS bigint) AS mtime FROM orders"
Q["latest_artifacts"] = """
SELECT tag, CASE WHEN tag IN ('tag1', 'tag2') THEN 'new_' ELSE '' END || arg_max(path, (mtime, path)) AS path, max(mtime) AS mtime FROM b_art GROUP BY tag"""
Q["rank_slice"] = """
SELECT wallet, pred_prob, rank FROM (SELECT wallet || '/' || market_slug AS wallet, round(volume_micro / 1e6, 8) + 0.0 AS pred_prob,
  row_number() OVER (ORDER BY volume_micro / 1e6 DESC, wallet || '/' || market_slug) AS rank FROM b_vol) WHERE rank BETWEEN 11 AND 40"""
B["b_con"] = """
SELECT wallet, market_slug, is_insider, 'n_distinct_buy_days' AS feature, cast(n_distinct_buy_days AS double) AS value, 0.35 * n_distinct_buy_days AS contribution FROM b_feat
UNION ALL SELECT wallet, market_slug, is_insider, 'n_distinct_sell_days', n_distinct_sell_days, -0.5 * n_distinct_sell_days FROM b_feat
UNION ALL SELECT wallet, market_slug, is_insider, 'active_day_frac', active_day_frac, 2.0 * active_day_frac FROM b_feat"""
Q["linear_contributions"] = "SELECT wallet, market_slug, feature, round(value, 8) + 0.0 AS value, round(contribution, 8) + 0.0 AS contribution FROM b_con"
B["b_lin"] = "SELECT wallet, market_slug, max(is_insider) AS is_insider, -0.75 + sum(contribution) AS z FROM b_con GROUP BY wallet, market_slug"
Q["linear_scores"] = "SELECT wallet, market_slug, round(z, 8) + 0.0 AS logit, round(1 / (1 + exp(-z)), 8) + 0.0 AS prob FROM b_lin"
B["b_wrong"] = "SELECT *, cast(z >= 0 AS integer) AS pred_label FROM b_lin WHERE cast(z >= 0 AS integer) <> is_insider"
Q["misclassified_rows"] = "SELECT wallet, market_slug, is_insider, pred_label, round(1 / (1 + exp(-z)), 8) + 0.0 AS prob FROM b_wrong"
Q["error_drivers"] = """
SELECT wallet, market_slug, feature, round(contribution, 8) + 0.0 AS contribution, rn AS driver_rank FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.wallet, c.market_slug ORDER BY CASE WHEN w.is_insider = 0 THEN contribution ELSE -contribution END DESC, feature) AS rn
  FROM b_con c JOIN b_wrong w USING (wallet, market_slug)) WHERE rn <= 2"""
B["b_rkc"] = "SELECT *, row_number() OVER (PARTITION BY wallet, market_slug ORDER BY abs(contribution) DESC, feature) AS rank FROM b_con"
Q["top_contributions"] = "SELECT wallet, market_slug, feature, round(contribution, 8) + 0.0 AS contribution, rank FROM b_rkc WHERE rank <= 2"
B["b_rkt"] = """
SELECT wallet, market_slug, feature, c, row_number() OVER (PARTITION BY wallet, market_slug ORDER BY abs(c) DESC, feature) AS rank FROM (SELECT *, round(contribution, 2) AS c FROM b_con)"""
Q["top_contribution_text"] = """
SELECT wallet, market_slug, string_agg(feature || '(' || printf('%+.3f', c::double) || ')', '; ' ORDER BY rank) AS top_features FROM b_rkt WHERE rank <= 2 GROUP BY wallet, market_slug"""
Q["importance_attribution"] = """
SELECT wallet, market_slug, feature, round(value, 8) + 0.0 AS value, CASE feature WHEN 'active_day_frac' THEN 2.0::double ELSE 0.5::double END AS contribution FROM b_con WHERE feature <> 'n_distinct_buy_days'"""
Q["attribution_matrix"] = "SELECT feature, " + ", ".join(
    f"round(sum(contribution) FILTER (WHERE market_slug = 'm{k}'), 8) + 0.0 AS m{k}" for k in range(8)
) + ", round((SELECT quantile_cont(abs(contribution), 0.98) FROM b_con), 8) + 0.0 AS scale FROM b_con GROUP BY feature"
B["b_ms"] = " UNION ALL ".join(f"SELECT wallet, market_slug, 'm{k}' AS model, volume_micro % {k} / {k} AS score FROM b_vol" for k in (101, 211, 307))
Q["ensemble_scores"] = """
SELECT 'e' || e AS ensemble, wallet, market_slug, round(sum(score * w) / sum(w), 8) + 0.0 AS score FROM (
  SELECT *, CASE model WHEN 'm101' THEN 1 + e * 0.5 WHEN 'm211' THEN 1 + e * 2.0 ELSE 1 END AS w FROM b_ms, (SELECT unnest([0, 1]) AS e)) GROUP BY e, wallet, market_slug"""
B["b_msl"] = "SELECT m.*, l.is_insider AS y FROM b_ms m JOIN b_lab l USING (wallet, market_slug)"


def _quality(source, by):
    return f"""
SELECT {by}, sum(n * (tp - p / 2.0)) / nullif(sum(p) * sum(n), 0) AS roc_auc, sum(p * tp / (tp + fp)) / nullif(sum(p), 0) AS pr_auc FROM (
  SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM (SELECT {by}, score, sum(y) AS p, sum(1 - y) AS n FROM {source} GROUP BY {by}, score)
  WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)) GROUP BY {by}"""


B["b_mq"] = _quality("b_msl", "model")
B["b_ens"] = """
SELECT 'equal_supervised' AS ensemble, wallet, market_slug, y, round(avg(score), 9) AS score FROM b_msl WHERE model <> 'm307' GROUP BY ALL
UNION ALL SELECT 'equal_all', wallet, market_slug, y, round(avg(score), 9) FROM b_msl GROUP BY ALL
UNION ALL SELECT 'prauc_weighted', wallet, market_slug, y, round(sum(score * pr_auc) / sum(pr_auc), 9) FROM b_msl JOIN b_mq USING (model) GROUP BY ALL"""
B["b_eq"] = _quality("b_ens", "ensemble")
Q["ensemble_choice"] = """
SELECT ensemble, round(roc_auc, 6) + 0.0 AS roc_auc, round(pr_auc, 6) + 0.0 AS pr_auc,
  ensemble = (SELECT ensemble FROM b_eq ORDER BY pr_auc DESC, ensemble DESC LIMIT 1) AS is_best FROM b_eq"""
Q["stored_features"] = """SELECT wallet, market_slug, round(active_day_frac, 8) + 0.0 AS active_day_frac, n_distinct_active_days FROM x_days"""
Q["stored_results"] = """
SELECT part, wallet, market_slug, pred_prob, flagged, volume FROM (
  SELECT wallet, market_slug, round(tokens_micro % 997 / 997, 8) + 0.0 AS pred_prob, tokens_micro % 997 / 997 >= 0.8 AS flagged, round(volume_micro / 1e6, 8) + 0.0 AS volume FROM b_vol) s,
  (SELECT unnest(['results', 'flagged']) AS part) WHERE part = 'results' OR flagged"""
Q["flag_counts"] = "SELECT wallet, market_slug, count(*) FILTER (WHERE score >= 0.6) AS n_flagged, count(*) AS n_models FROM b_ms GROUP BY wallet, market_slug"
Q["scan_summary"] = """
SELECT market_slug, count(*) AS scored, count(*) FILTER (WHERE score >= 0.7) AS n_flagged, round(max(score), 8) + 0.0 AS max_prob FROM b_ms WHERE model = 'm211' GROUP BY market_slug"""
B["b_coef"] = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} - 0.25 AS coef FROM x_days WHERE {c} IS NOT NULL" for c in _DAYC)
Q["coefficient_stability"] = """
SELECT feature, round(avg(coef), 8) + 0.0 AS mean_coef, round(median(coef), 8) + 0.0 AS median_coef, round(stddev_samp(coef), 8) + 0.0 AS std_coef, round(avg(abs(coef)), 8) + 0.0 AS mean_abs_coef,
  round(median(abs(coef)), 8) + 0.0 AS median_abs_coef, round(avg(cast(abs(coef) > 1e-8 AS double)), 8) + 0.0 AS nonzero_frac, round(avg(cast(coef > 1e-8 AS double)), 8) + 0.0 AS positive_frac,
  round(avg(cast(coef < -1e-8 AS double)), 8) + 0.0 AS negative_frac FROM b_coef GROUP BY feature"""

# ------------------------------------------------------------------ streaming

Q["streamed_ingest"] = "SELECT market_slug, count(*) AS n_fills, count(*) AS n_ids FROM b_fills GROUP BY market_slug"
Q["streamed_odd_slugs"] = """
SELECT id, CASE market_slug WHEN 'm0' THEN NULL WHEN 'm1' THEN '007' WHEN 'm2' THEN '7' WHEN 'm3' THEN '2024-01-05' WHEN 'm4' THEN '1e3' WHEN 'm5' THEN '' ELSE market_slug END AS market_slug,
  timestamp, maker FROM b_fills"""
Q["streamed_positions"] = """
SELECT market_slug, wallet, cast(sum(signed_micro) AS bigint) AS inventory_micro, cast(sum(cash_micro) AS bigint) AS volume_micro, count(*) AS n_trades, max(ts) AS last_ts
FROM b_yes GROUP BY market_slug, wallet"""
Q["streamed_hourly_volume"] = """
SELECT market_slug, ts // 3600 * 3600 AS hour, round(sum(cash / 1e6), 8) + 0.0 AS cash, round(sum(token / 1e6), 8) + 0.0 AS tokens, count(*) AS n_fills,
  round(arg_max(CASE WHEN is_no THEN 1 - cash / token ELSE cash / token END, (ts, CASE WHEN is_no THEN 1 - cash / token ELSE cash / token END)), 8) + 0.0 AS last_price
FROM b_leg GROUP BY market_slug, ts // 3600 * 3600"""
B["b_touch"] = "SELECT DISTINCT market_slug, lower(w) AS wallet FROM (SELECT market_slug, unnest([maker, taker]) AS w FROM b_fills WHERE timestamp % 7 = 0)"
Q["rescored_wallets"] = "SELECT market_slug, wallet, volume_micro FROM b_vol JOIN b_touch USING (market_slug, wallet)"
B["b_cmp"] = """
SELECT m.* EXCLUDE (cv_pr, cv_std), coalesce(s.m, m.cv_pr) AS cv_pr, coalesce(s.s, m.cv_std) AS cv_std FROM b_mod m
LEFT JOIN (SELECT replace(tag, 't', 'tag') AS tag, avg(pr_auc) AS m, stddev_pop(pr_auc) AS s FROM b_fv GROUP BY tag) s ON s.tag = m.tag"""
Q["model_comparison"] = """
SELECT tag, round(cv_pr, 8) + 0.0 AS cv_pr, round(cv_std, 8) + 0.0 AS cv_std, round(test_pr, 8) + 0.0 AS test_pr, round(test_roc, 8) + 0.0 AS test_roc, n_features, n_params,
  cast(row_number() OVER (ORDER BY cv_pr DESC NULLS LAST, tag) AS integer) AS rank,
  tag = (SELECT tag FROM b_cmp WHERE cv_pr IS NOT NULL ORDER BY cv_pr DESC, tag LIMIT 1) AS is_best_cv,
  tag = (SELECT tag FROM b_cmp WHERE test_pr IS NOT NULL ORDER BY test_pr DESC, tag LIMIT 1) AS is_best_test,
  tag = (SELECT tag FROM b_cmp WHERE test_pr >= 0.95 AND n_features IS NOT NULL ORDER BY n_features, test_pr DESC, tag LIMIT 1) AS is_simple_test,
  tag = (SELECT tag FROM b_cmp WHERE cv_pr >= (SELECT max(cv_pr) - 0.05 FROM b_cmp) AND n_features IS NOT NULL ORDER BY n_features, cv_pr DESC, tag LIMIT 1) AS is_simple_cv,
  test_pr < cv_pr AS cv_optimistic FROM b_cmp"""
Q["separability_report"] = """
SELECT feature, format('{:,.3f}', round(pm, 6)) AS positive, CASE WHEN round(pm, 9) / round(nm, 9) >= 100 THEN format('{:,.0f}', round(pm, 9) / round(nm, 9)) ELSE format('{:,.2f}', round(pm, 9) / round(nm, 9)) END || '×' AS ratio,
  format('{:,.1f}', coverage * 100) || '%' AS coverage FROM b_sep"""


# ------------------------------------------------------------ density clustering

B["b_pl"] = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"
B["b_pd"] = "SELECT a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM b_pl a, b_pl b"
B["b_kd"] = "SELECT id, d2 FROM (SELECT id, d2, row_number() OVER (PARTITION BY id ORDER BY d2) AS n FROM b_pd) WHERE n = 5"
B["b_kp"] = """
SELECT share, d2 FROM (SELECT d2, row_number() OVER (ORDER BY d2) AS n, count(*) OVER () AS total FROM b_kd),
  (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95])::DOUBLE AS share) WHERE n = ceil(share * total)"""
B["b_dn"] = "SELECT share, id, other FROM b_pd JOIN b_kp ON b_pd.d2 <= b_kp.d2 WHERE share < 0.8"
B["b_dc"] = "SELECT share, id FROM b_dn GROUP BY share, id HAVING count(*) >= 5"
B["b_de"] = "SELECT n.share, n.id, n.other FROM b_dn n JOIN b_dc a ON a.share = n.share AND a.id = n.id JOIN b_dc b ON b.share = n.share AND b.id = n.other"
# all ids a core point is connected with, by a search from every one
B["b_dr"] = """
SELECT share, id, min(root) AS cluster FROM (
  WITH RECURSIVE reach AS (
    SELECT share, id, id AS root FROM b_dc
    UNION SELECT e.share, e.other, reach.root FROM reach JOIN b_de e ON e.share = reach.share AND e.id = reach.id WHERE reach.root < e.other)
  SELECT * FROM reach) GROUP BY share, id"""
B["b_db"] = """
SELECT p.share, p.id, CASE WHEN r.id IS NOT NULL THEN 'core' WHEN b.cluster IS NOT NULL THEN 'border' ELSE 'noise' END AS kind, coalesce(r.cluster, b.cluster) AS cluster
FROM (SELECT share, id FROM b_pl, (SELECT DISTINCT share FROM b_dn)) p
LEFT JOIN b_dr r ON r.share = p.share AND r.id = p.id
LEFT JOIN (SELECT n.share, n.id, min(cluster) AS cluster FROM b_dn n JOIN b_dr r ON r.share = n.share AND r.id = n.other GROUP BY n.share, n.id) b ON b.share = p.share AND b.id = p.id"""
Q["distance_percentiles"] = "SELECT share, round(sqrt(d2), 6) AS distance FROM b_kp WHERE share > 0.3"
Q["density_clusters"] = "SELECT id, kind, cluster FROM b_db WHERE share = 0.5"
Q["density_sweep"] = """
SELECT share, count(DISTINCT cluster) AS clusters, count(*) FILTER (kind = 'core') AS core, count(*) FILTER (kind = 'border') AS border,
  count(*) FILTER (kind = 'noise') AS noise FROM b_db GROUP BY share"""


# ---------------------------------------------------- stored state, left-out fits

_TOKENS = ("buy_tokens_total", "sell_tokens_total", "net_tokens", "gross_tokens", "net_directional_consistency")
Q["live_features"] = (
    f"SELECT {KEY}, " + ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in (*PB.REALIZED, *_TOKENS))
    + " FROM x_position LEFT JOIN x_realized USING (market_slug, wallet)")
Q["left_out_scores"] = """
SELECT c, count(*) AS rows, cast(sum(is_insider) AS bigint) AS positives, count(*) AS not_nearer, true AS stationary
FROM b_lab, (SELECT unnest([0.05, 0.4, 1.0])::DOUBLE AS c) GROUP BY c"""
Q["left_out_stability"] = """
SELECT unnest(['n_distinct_active_days', 'active_day_frac', 'buy_day_concentration_hhi', 'net_directional_consistency', 'gross_tokens',
  'outcome_alignment_token', 'max_abs_inventory', 'path_alignment']) AS feature, true AS signs_add_up, true AS bounded"""
Q["nested_left_out"] = """
SELECT 3::BIGINT AS folds, count(*) AS rows, cast(sum(is_insider) AS bigint) AS positives, count(*) AS scored, true AS one_penalty FROM b_lab"""


# ------------------------------------------------------------ landed documents

Q["landed_markets"] = """
SELECT slug, 'Yes|No' AS outcomes, slug || '-Y|' || slug || '-N' AS token_ids, start_ts, end_ts, true AS closed, p0 AS first_price, cast(mk AS integer) AS depth, 2 AS broken FROM b_mk"""
Q["landed_deposits"] = """
SELECT t.wallet, d.funder, d.first_deposit_ts, d.tx_hash FROM (SELECT DISTINCT "to" AS wallet FROM b_tra) t LEFT JOIN b_dep d USING (wallet)"""
Q["landed_transfers"] = """
SELECT funder, "to", min(ts) AS first_ts, count(*) AS n, funder LIKE '%3' AS hit_cap FROM b_tra GROUP BY funder, "to"
UNION ALL SELECT 'f-none', NULL, NULL, 0, false"""


# ------------------------------------------------------------------ model zoo

Q["one_pass_scores"] = """
SELECT model, count(*) AS rows, count(*) AS same FROM b_lab, (SELECT unnest(['forest', 'boosting', 'logistic']) AS model) GROUP BY model"""


# ------------------------------------------------- laws of fitted models

Q["out_of_fold_rows"] = """
SELECT tag, count(*) AS rows, count(*) AS pairs, cast(sum(is_insider) AS bigint) AS positives, count(*) AS probabilities, 1 AS folds_of_a_market
FROM b_lab, (SELECT unnest(['logistic', 'forest', 'boosting']) AS tag) GROUP BY tag"""
B["b_tested"] = """
SELECT market_slug FROM (
  SELECT market_slug, row_number() OVER (PARTITION BY size_band ORDER BY h, market_slug) AS rn, size_band FROM (
    SELECT market_slug, CASE WHEN count(*) >= 10000 THEN 'large' ELSE 'small' END AS size_band, ('0x' || substr(md5('42|' || market_slug), 1, 15))::BIGINT AS h FROM b_lab GROUP BY market_slug))
WHERE rn <= CASE WHEN size_band = 'large' THEN 0 ELSE 2 END"""
Q["calibration_balance"] = """
SELECT count(*) AS rows, count(*) AS probabilities, true AS balanced FROM b_lab WHERE market_slug NOT IN (SELECT market_slug FROM b_tested)"""
Q["left_market_counts"] = """
SELECT market_slug AS test_market, count(*) AS n, cast(sum(is_insider) AS bigint) AS n_positives, true AS positives_add_up, true AS rows_add_up FROM b_lab GROUP BY market_slug"""
_FITTED = ["n_distinct_active_days", "active_day_frac", "buy_day_concentration_hhi", "net_directional_consistency", "gross_tokens",
           "outcome_alignment_token", "max_abs_inventory", "path_alignment"]
Q["importance_laws"] = f"SELECT unnest({_FITTED!r}) AS feature, true AS not_negative, true AS add_up"
Q["isolation_laws"] = "SELECT count(*) AS rows, count(*) AS in_range, true AS highest_flagged, true AS share_kept FROM b_lab"
Q["kmeans_laws"] = """
SELECT k, cast(k AS bigint) AS clusters, count(*) AS rows, true AS silhouette, true AS cost FROM b_lab, (SELECT unnest([2, 5, 8]) AS k) GROUP BY k"""
Q["projection_laws"] = "SELECT count(*) AS rows, true AS uncorrelated, true AS falling, true AS bounded FROM b_lab"
Q["training_rows"] = (
    "SELECT d.wallet, d.market_slug, d.is_insider, " + ", ".join(f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in _FITTED) + ", true AS has_metadata FROM ("
    + Q["negative_sample"] + ") d LEFT JOIN x_days USING (market_slug, wallet) LEFT JOIN x_position USING (market_slug, wallet)")
Q["audit_counts"] = """
SELECT model, count(*) AS rows, count(*) AS counted, 1 AS cuts FROM b_lab, (SELECT unnest(['forest', 'boosting', 'logistic']) AS model) GROUP BY model"""
Q["fitted_model_report"] = """
SELECT unnest(['forest', 'boosting', 'logistic']) AS tag, 8 AS n_features, true AS best_is_first, true AS best_has_most, true AS same_gap, true AS ranked"""
Q["fitted_contributions"] = "SELECT count(*) AS rows, count(*) AS same FROM b_lab"
Q["scan_job"] = """
SELECT t.wallet, t.market_slug, round(t.volume_micro / 1e6, 8) + 0.0 AS volume, s.n AS n_trades, s.first_ts AS first_trade_ts, true AS sink_agrees, true AS summary_agrees,
  true AS has_metadata, true AS model_order
FROM b_top t JOIN (SELECT wallet, market_slug, count(*) AS n, min(ts) AS first_ts FROM b_yes GROUP BY ALL) s USING (wallet, market_slug) WHERE rank <= 50"""
