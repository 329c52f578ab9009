"""Market-level facts of a price series and price lookups around trade seconds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fillsight.functions.scalar import time_position, time_remaining
from fillsight.operators.asof import asof_join, backward, build_index, forward, lookup, nearest
from fillsight.operators.scan import COUNT, PRICE_WIDTHS, TIME_WIDTHS, Cells, heavy_keys, join_dimension, percentiles, plan_cells, scan
from fillsight.schema import MARKET, ratio

GRID_FRACS = (0.01, 0.03, 0.07, 0.15, 0.20)
FIXED_HORIZONS = (300, 3600, 21600, 86400)
TREND_WINDOW = 21_600
# Prices enter the running sums as integers of 1e-10, so sums and their differences are exact.
PRICE_SCALE = 10**10
SUMS = ("n", "sx", "sy", "sxx", "sxy", "syy", "sad")


def market_cells(history: DataFrame, probes: DataFrame | None = None, **kw) -> Cells:
    """Split plan of the market series along time; ``probes`` are the rows looked up in it."""
    rows = history.select(MARKET, "ts")
    if probes is not None:
        rows = rows.unionByName(probes.select(MARKET, "ts"))
    return plan_cells(rows, [MARKET], "ts", TIME_WIDTHS, **kw)


def series_facts(history: DataFrame, split: bool = False) -> DataFrame:
    """Bounds, end prices, price range and the price percentiles of each market."""
    g = history.groupBy(MARKET).agg(
        F.min("ts").alias("h_start"), F.max("ts").alias("h_end"), F.count("*").alias("h_rows"),
        F.min("yes_price").alias("price_min"), F.max("yes_price").alias("price_max"),
        F.max_by("yes_price", F.struct("ts", "trade_id")).alias("last_price"),
    )
    pct = percentiles(history, [MARKET], "yes_price", {"p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90}, split)
    return g.join(pct, MARKET, "left").withColumn("life", F.col("h_end") - F.col("h_start"))


def price_index(history: DataFrame, cells: Cells | None = None) -> DataFrame:
    """As-of index of the series' prices."""
    h = history.select(MARKET, "ts", "trade_id", "yes_price")
    return build_index(h, [MARKET], "ts", ["yes_price"], tiebreak=["ts", "trade_id"], cells=cells)


def sums_index(history: DataFrame, cells: Cells | None = None) -> DataFrame:
    """As-of index of running sums for trailing-window statistics.

    Time is centred on the market's first second. ``sad`` sums the absolute step
    from the previous row.
    """
    origin = history.groupBy(MARKET).agg(F.min("ts").alias("t0"))
    h = history.select(MARKET, "ts", "trade_id", "yes_price")
    # without over-full groups every market fits a task, which the scans below rely on as well
    h = join_dimension(h, origin, MARKET, F.col("ts")) if cells is not None and cells.split else h.join(origin, MARKET)
    x = (F.col("ts") - F.col("t0")).cast("decimal(20,0)")
    y = F.round(F.col("yes_price") * PRICE_SCALE).cast("bigint")
    h = h.select("*", x.alias("x"), y.cast("decimal(20,0)").alias("y"))
    if cells is not None and cells.split:
        h = cells.label(h, "ts")
    order = ["ts", "trade_id"]
    h = scan(h, [MARKET], order, previous={"y_prev": F.col("y")}, cells=cells)
    wide = "decimal(38,0)"
    h = scan(
        h, [MARKET], order,
        running={
            "n": ("count", F.lit(1)),
            "sx": ("sum", F.col("x").cast(wide)), "sy": ("sum", F.col("y").cast(wide)),
            "sxx": ("sum", (F.col("x") * F.col("x")).cast(wide)),
            "sxy": ("sum", (F.col("x") * F.col("y")).cast(wide)),
            "syy": ("sum", (F.col("y") * F.col("y")).cast(wide)),
            "sad": ("sum", F.coalesce(F.abs(F.col("y") - F.col("y_prev")), F.lit(0)).cast(wide)),
        },
        cells=cells,
    )
    return build_index(h, [MARKET], "ts", list(SUMS), tiebreak=order, cells=cells)


def window_sums(at_end: Column, before_start: Column) -> dict[str, Column]:
    """Sums of the rows in a window from the running sums at its two edges."""
    zero = F.lit(0).cast("decimal(38,0)")
    out = {}
    for s in SUMS[:-1]:
        out[s] = F.coalesce(at_end[s].cast("decimal(38,0)"), zero) - F.coalesce(before_start[s].cast("decimal(38,0)"), zero)
    return out


def window_slope(s: dict[str, Column]) -> Column:
    """Least-squares slope of price on time; NULL below three rows or at zero time variance."""
    num = s["n"] * s["sxy"] - s["sx"] * s["sy"]
    den = s["n"] * s["sxx"] - s["sx"] * s["sx"]
    return F.when((s["n"] >= 3) & (den > 0), ratio(num, den) / PRICE_SCALE)


def window_std(s: dict[str, Column]) -> Column:
    """Sample standard deviation of the price; NULL below two rows."""
    var = ratio(s["n"] * s["syy"] - s["sy"] * s["sy"], s["n"] * (s["n"] - 1))
    return F.when(s["n"] >= 2, F.sqrt(var) / PRICE_SCALE)


def second_lookups(
    seconds: DataFrame,
    history: DataFrame,
    facts: DataFrame,
    cells: Cells | None = None,
    fracs: Sequence[float] = GRID_FRACS,
    horizons: Sequence[int] = FIXED_HORIZONS,
    grid: bool = True,
    fixed: bool = True,
) -> DataFrame:
    """Prices around every distinct (market, second) of ``seconds``.

    All probes of a second (its own time, horizons, look-backs) go through one as-of
    pass. Results depend on the second only, so trades of one second share them, and a
    market contributes at most one row per second of its life however many trades it
    has. Columns: price_at (first price at or after), near_price, fut<i>/past<i> for
    the grid, fix<h> for fixed horizons.
    """
    s = seconds.select(MARKET, "ts").distinct().join(facts.select(MARKET, "life"), MARKET)
    probe = lambda k, at: F.struct(F.lit(k).alias("kind"), at.cast("bigint").alias("at"))
    ts, life = F.col("ts"), F.col("life")
    names = ["own"]
    probes = [probe(0, ts)]
    if grid:
        names += [f"fut{i}" for i in range(len(fracs))] + [f"past{i}" for i in range(len(fracs))]
        ats = [F.ceil(ts + f * life) for f in fracs] + [F.floor(ts - f * life) for f in fracs]
        probes += [probe(len(probes) + i, a) for i, a in enumerate(ats)]
    if fixed:
        names += [f"fix{h}" for h in horizons]
        probes += [probe(len(probes) + i, ts + h) for i, h in enumerate(horizons)]
    back = [i for i, n in enumerate(names) if n.startswith("past")]
    p = s.select(MARKET, "ts", F.inline(F.array(*probes)))
    hit = lookup(p, price_index(history, cells), [MARKET], "at", "hit", cells)
    price = forward("hit", F.col("at"), "yes_price")
    if back:
        price = F.when(F.col("kind").between(back[0], back[-1]), backward("hit", "yes_price")).otherwise(price)
    slim = hit.select(
        MARKET, "ts", "kind", price.alias("price"), F.when(F.col("kind") == 0, nearest("hit", F.col("at"), "yes_price")).alias("near")
    )
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("price")))
    cols = [at(0).alias("price_at"), F.max("near").alias("near_price")]
    return slim.groupBy(MARKET, "ts").agg(*cols, *[at(k).alias(n) for k, n in enumerate(names) if k])


def trailing_stats(seconds: DataFrame, history: DataFrame, window: int = TREND_WINDOW, cells: Cells | None = None) -> DataFrame:
    """Statistics of the history rows in ``[ts - window, ts]`` for every distinct (market, second).

    Slope, implied move over the window, sample deviation and mean absolute step, all
    from running sums at the two window edges: no row is visited once per window.
    """
    s = seconds.select(MARKET, "ts").distinct()
    p = s.select(MARKET, "ts", F.inline(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("ts").alias("at")),
        F.struct(F.lit(1).alias("kind"), (F.col("ts") - window - 1).alias("at")),
    )))
    hit = lookup(p, sums_index(history, cells), [MARKET], "at", "hit", cells)
    sums = F.struct(*[F.col(f"hit.cur.hi.{c}").alias(c) for c in SUMS])
    slim = hit.select(MARKET, "ts", "kind", sums.alias("sums"), F.col("hit.nxt.lo.sad").alias("first_sad"))
    edge = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    e = slim.groupBy(MARKET, "ts").agg(
        edge(0, "sums").alias("end_sums"), edge(1, "sums").alias("start_sums"),
        # running step sum at the first row inside the window
        edge(1, "first_sad").alias("first_sad"),
    )
    w = window_sums(F.col("end_sums"), F.col("start_sums"))
    return e.select(
        MARKET, "ts",
        window_slope(w).alias("trend_slope"),
        (window_slope(w) * window).alias("trend_move"),
        window_std(w).alias("trail_std"),
        F.when(w["n"] >= 2, ratio(F.col("end_sums.sad") - F.col("first_sad"), w["n"] - 1) / PRICE_SCALE).alias("trail_abs_step"),
    )


# History rows of a market that a task keeps as arrays (16 bytes each), and those from which its seconds go to several tasks.
ARRAY_ROWS = 24_000_000
DEAL_ROWS = 4_000_000
TREND_COLUMNS = ("trend_slope", "trend_move", "trail_std", "trail_abs_step")


def series_lookups(
    seconds: DataFrame, history: DataFrame, facts: DataFrame, fracs: Sequence[float] = GRID_FRACS, horizons: Sequence[int] = FIXED_HORIZONS,
    window: int = TREND_WINDOW, grid: bool = True, fixed: bool = True, trail: bool = True, unique: bool = False,
) -> DataFrame:
    """``second_lookups`` and ``trailing_stats`` of every distinct (market, second) in one pass, moving rows once.

    Series and seconds of a market meet in one task in order of time; the task keeps the series as two arrays
    and streams the seconds past them, so ``ARRAY_ROWS`` bounds the rows of a series. The seconds of a long series are
    dealt over several tasks by time. ``unique`` says that the history has one row per (market, second).
    """
    order = ["ts"] if unique else ["ts", "trade_id"]
    h = history.select(MARKET, F.lit(0).alias("kind"), *order, F.col("yes_price").alias("price"))
    s = seconds.filter(F.col("ts").isNotNull()).select(MARKET, F.lit(1).alias("kind"), "ts", F.lit(None).cast("double").alias("price"))
    long = facts.filter(F.col("h_rows") > DEAL_ROWS).select(
        MARKET, "h_start", "life", F.ceil(F.col("h_rows") / DEAL_ROWS).cast("int").alias("_deals")
    )
    keys = [MARKET]
    if not long.isEmpty():
        # few rows: a series here holds over DEAL_ROWS rows; each deal gets a copy of its series
        long, keys = F.broadcast(long), [MARKET, "_deal"]
        deals, at = F.coalesce("_deals", F.lit(1)), F.floor((F.col("ts") - F.col("h_start")) / (F.col("life") + 1) * F.col("_deals"))
        own = F.coalesce(F.greatest(F.lit(0), F.least(at.cast("int"), deals - 1)), F.lit(0))
        s = s.join(long, MARKET, "left").select(*s.columns, own.alias("_deal"))
        h = h.join(long, MARKET, "left").select(*h.columns, F.explode(F.sequence(F.lit(0), deals - 1)).alias("_deal"))
    rows = h.unionByName(s, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "kind", *order)
    names = ["price_at", "near_price"] if grid or fixed else []
    names += [f"{w}{i}" for w in ("fut", "past") for i in range(len(fracs))] if grid else []
    names += [f"fix{h_}" for h_ in horizons] if fixed else []
    names += TREND_COLUMNS if trail else []
    fields = [T.StructField(MARKET, T.StringType()), T.StructField("ts", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]]
    find = partial(_look_up, list(keys), list(fracs) if grid else [], list(horizons) if fixed else [], window if trail else None, names)
    return rows.select(*keys, "kind", "ts", "price").mapInArrow(find, T.StructType(fields))


def _look_up(
    keys: list[str], fracs: list[float], horizons: list[int], window: int | None, names: list[str], batches: Iterator
) -> Iterator:
    """Lookups of the seconds (kind 1) of each group in its series (kind 0), which comes before them; both in order of time."""
    import numpy as np
    import pyarrow as pa

    group, parts, undated, series, last = None, [], [], None, None
    for batch in batches:
        for (*own, kind), part in _runs(batch, [*keys, "kind"]):
            if own != group:
                group, parts, undated, series, last = own, [], [], None, None
            if kind == 0:
                # rows without a time come first
                dated = part.num_rows - part.column(part.schema.get_field_index("ts")).null_count
                undated.append(_prices(part.slice(0, part.num_rows - dated)))
                parts.append(_arrays(part.slice(part.num_rows - dated)))
                continue
            ts = _arrays(part)[0]
            if series is None:
                none = np.zeros(0, dtype="int64"), np.zeros(0)
                series, parts = tuple(np.concatenate([p[i] for p in [none, *parts]]) for i in (0, 1)), []
                undated = [np.concatenate([none[1], *undated])]
            fresh = np.ones(len(ts), dtype=bool)
            fresh[1:] = ts[1:] != ts[:-1]
            fresh[0] = last is None or ts[0] != last
            last, ts = ts[-1], ts[fresh]
            if not len(ts) or not len(series[0]) and "price_at" in names:
                continue
            found = prices_around(*series, ts, fracs, horizons) if "price_at" in names else {}
            if window is not None:
                found |= trend_before(*series, ts, window, undated[0])
            cols = [pa.array([group[0]] * len(ts), pa.string()), pa.array(ts)]
            cols += [pa.array(found[c], mask=np.isnan(found[c])) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=[MARKET, "ts", *names])


def _runs(batch, keys: list[str]) -> Iterator:
    """Neighbouring rows of a batch with equal keys, and these."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    of = [batch.column(batch.schema.get_field_index(k)) for k in keys]
    changes = np.zeros(max(n - 1, 0), dtype=bool)
    for v in of if n else []:
        other = pc.fill_null(pc.not_equal(v.slice(1), v.slice(0, n - 1)), True)
        changes |= other.to_numpy(zero_copy_only=False).astype(bool)
    starts = [0, *(np.flatnonzero(changes) + 1).tolist(), n] if n else []
    for a, b in zip(starts, starts[1:]):
        yield tuple(v[a].as_py() for v in of), batch.slice(a, b - a)


def _arrays(part) -> tuple:
    """Times and prices (NaN where unknown) of a batch as arrays of their own."""
    return part.column(part.schema.get_field_index("ts")).to_numpy(zero_copy_only=False).astype("int64"), _prices(part)


def _prices(part):
    return part.column(part.schema.get_field_index("price")).to_numpy(zero_copy_only=False).astype("float64")


def prices_around(at, price, ts, fracs, horizons) -> dict:
    """Prices (NaN where unknown) of a series in order of time around each second of ``ts``."""
    import numpy as np

    n, life = len(at), float(at[-1] - at[0])

    def forward(t):
        return price[np.minimum(np.searchsorted(at, t, "left"), n - 1)]

    def backward(t):
        r = np.searchsorted(at, t, "right")
        v, following = price[np.maximum(r - 1, 0)], price[np.minimum(r, n - 1)]
        return np.where(np.isnan(v) & (r < n), following, v)

    r = np.searchsorted(at, ts, "right")
    before, after = np.maximum(r - 1, 0), np.minimum(r, n - 1)
    use_before = (r > 0) & ((r == n) | (ts - at[before] <= at[after] - ts))
    out = {"price_at": forward(ts), "near_price": price[np.where(use_before, before, after)]}
    for i, f in enumerate(fracs):
        out[f"fut{i}"] = forward(np.ceil(ts + f * life).astype("int64"))
        out[f"past{i}"] = backward(np.floor(ts - f * life).astype("int64"))
    return out | {f"fix{h}": forward(ts + h) for h in horizons}


def trend_before(at, price, ts, window: int, undated) -> dict:
    """``trailing_stats`` of each second of ``ts`` from a series in order of time.

    Windows that reach back before the first row count the prices of rows without a time as if they stood there.

    Sums of whole numbers modulo 2^64, prices in two limbs. Taken about the window's first row
    they fit 64 bits, so they are exact whatever the running sums do.
    """
    import numpy as np

    l, r = np.searchsorted(at, ts - window, "left"), np.searchsorted(at, ts, "right")
    lo, hi = (l[r > l].min(), r.max()) if (r > l).any() else (0, 0)
    if lo < hi and np.isnan(price[lo]):
        lo = max([0, *np.flatnonzero(~np.isnan(price[:lo]))[-1:]])  # the last known price leads into the window
    x, y, early = at[lo:hi], price[lo:hi], 0
    if not lo and len(x) and len(undated):
        x, y, early = np.concatenate([np.full(len(undated), x[0]), x]), np.concatenate([undated, y]), len(undated)
    y = y * PRICE_SCALE
    known = ~np.isnan(y)
    y = np.where(known, y, 0.0)
    y = (np.sign(y) * np.floor(np.abs(y) + 0.5)).astype("int64")
    x = x - x[0] if len(x) else x
    bits = 17
    yh, yl = y >> bits, y & ((1 << bits) - 1)
    dated, b = np.clip(l - lo + early, 0, len(x)), np.clip(r - lo + early, 0, len(x))
    b = np.maximum(dated, b)
    a = np.where((l == 0) & (r > 0), dated - early, dated)
    n = b - a

    def total(v, a=a):
        p = np.concatenate([np.zeros(1, dtype="int64"), np.cumsum(v, dtype="int64")])
        return p[b] - p[a]

    first = np.minimum(a, max(len(x) - 1, 0))
    c, dh, dl = (v[first] if len(v) else np.zeros(len(ts), dtype="int64") for v in (x, yh, yl))
    rx, rh, rl = total(x), total(yh), total(yl)
    big = np.longdouble
    sx, sh, sl = ((s - n * d).astype(big) for s, d in ((rx, c), (rh, dh), (rl, dl)))
    sxx = (total(x * x) - 2 * c * rx + n * c * c).astype(big)
    sxh = (total(x * yh) - c * rh - dh * rx + n * c * dh).astype(big)
    sxl = (total(x * yl) - c * rl - dl * rx + n * c * dl).astype(big)
    shh = (total(yh * yh) - 2 * dh * rh + n * dh * dh).astype(big)
    shl = (total(yh * yl) - dh * rl - dl * rh + n * dh * dl).astype(big)
    sll = (total(yl * yl) - 2 * dl * rl + n * dl * dl).astype(big)
    unit = big(1 << bits)
    sy, sxy, syy = sh * unit + sl, sxh * unit + sxl, (shh * unit + 2 * shl) * unit + sll
    den = n * sxx - sx * sx
    some = (n >= 3) & (den > 0)
    slope = np.where(some, ((n * sxy - sx * sy) / np.where(some, den, 1)).astype("float64") / PRICE_SCALE, np.nan)
    two = n >= 2
    var = np.maximum(n * syy - sy * sy, 0) / np.where(two, big(1) * n * (n - 1), 1)
    # steps from the last known price; the first row's step leads into the window
    filled = np.maximum.accumulate(np.where(known, np.arange(len(y)), -1))
    step = np.zeros(len(y), dtype="int64")
    if len(y):
        step[1:] = np.where(known[1:] & (filled[:-1] >= 0), np.abs(y[1:] - y[filled[:-1]]), 0)
    steps = total(step, np.minimum(dated + 1, b))
    return {
        "trend_slope": slope, "trend_move": slope * window,
        "trail_std": np.where(two, np.sqrt(var).astype("float64") / PRICE_SCALE, np.nan),
        "trail_abs_step": np.where(two, steps / np.where(two, n - 1, 1) / PRICE_SCALE, np.nan),
    }


def price_changes(history: DataFrame, cells: Cells | None = None) -> DataFrame:
    """Step from the previous price of the market; NULL on the first row."""
    h = cells.label(history, "ts") if cells is not None and cells.split else history
    h = scan(h, [MARKET], ["ts", "trade_id"], previous={"_p": F.col("yes_price")}, cells=cells)
    return h.withColumn("ret", F.col("yes_price") - F.col("_p")).drop("_p", "_cell")


# ---------------------------------------------------------------- market events

def detect_major_move(
    history: DataFrame, lookahead: int = 3600, threshold: float = 0.15, upward_only: bool = False, cells: Cells | None = None
) -> DataFrame:
    """First second of each market whose future price is at least ``threshold`` away."""
    probes = history.select(MARKET, "ts", "trade_id", "yes_price", (F.col("ts") + lookahead).alias("_at"))
    found = asof_join(
        probes, history.select(MARKET, F.col("ts").alias("h_ts"), F.col("yes_price").alias("h_price"), F.col("trade_id").alias("h_id")),
        [MARKET], "_at", "h_ts", ["h_price"], "forward", clamp=True, tiebreak=["h_id"], cells=cells,
    )
    delta = F.col("h_price") - F.col("yes_price")
    size = delta if upward_only else F.abs(delta)
    m = F.min_by(
        F.struct(
            F.col("ts").alias("major_move_time"), F.col("yes_price").alias("major_move_start_price"),
            F.col("h_price").alias("major_move_future_price"), delta.alias("major_move_delta"),
        ),
        F.when(size >= threshold, F.struct("ts", "trade_id")),
    )
    return found.groupBy(MARKET).agg(m.alias("m")).select(MARKET, "m.*")


def first_major_move(
    history: DataFrame, lookahead: int = 3600, threshold: float = 0.15, upward_only: bool = False, unique: bool = False
) -> DataFrame:
    """``detect_major_move`` with the series of a market as arrays in one task (see ``series_lookups``)."""
    order = ["ts"] if unique else ["ts", "trade_id"]
    h = history.filter(F.col("ts").isNotNull()).select(MARKET, *order, F.col("yes_price").alias("price"))
    names = ("major_move_start_price", "major_move_future_price", "major_move_delta")
    fields = [T.StructField(MARKET, T.StringType()), T.StructField("major_move_time", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]]
    rows = h.repartition(MARKET).sortWithinPartitions(MARKET, *order).select(MARKET, "ts", "price")
    return rows.mapInArrow(partial(_first_moves, lookahead, threshold, upward_only, [f.name for f in fields]), T.StructType(fields))


def _first_moves(lookahead: int, threshold: float, upward_only: bool, names: list[str], batches: Iterator) -> Iterator:
    """A row per market: the first row of its series whose future price is far enough away, NULL without one."""
    import numpy as np
    import pyarrow as pa

    def found(market, parts):
        at, price = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        future = price[np.minimum(np.searchsorted(at, at + lookahead, "left"), len(at) - 1)]
        delta = future - price
        hits = np.flatnonzero((delta if upward_only else np.abs(delta)) >= threshold)
        row = (at[hits[0]], price[hits[0]], future[hits[0]], delta[hits[0]]) if len(hits) else (None,) * 4
        types = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((market, *row), types)], names=names)

    parts, market = [], None
    for batch in batches:
        for own, part in _runs(batch, [MARKET]):
            if parts and own != market:
                yield found(*market, parts)
                parts = []
            market = own
            parts.append(_arrays(part))
    if parts:
        yield found(*market, parts)


def given_major_moves(times: DataFrame, history: DataFrame, cells: Cells | None = None) -> DataFrame:
    """Caller-supplied move times: the start price is the nearest one, the rest is unknown."""
    h = history.select(MARKET, F.col("ts").alias("h_ts"), "yes_price", F.col("trade_id").alias("h_id"))
    got = asof_join(times.select(MARKET, "major_move_time"), h, [MARKET], "major_move_time", "h_ts", ["yes_price"],
                    "nearest", tiebreak=["h_id"], cells=cells)
    null = F.lit(None).cast("double")
    return got.select(
        MARKET, "major_move_time", F.col("yes_price").alias("major_move_start_price"),
        null.alias("major_move_future_price"), null.alias("major_move_delta"),
    )


def with_move_position(moves: DataFrame, markets: DataFrame) -> DataFrame:
    m = markets.select(F.col("slug").alias(MARKET), "start_ts", "end_ts")
    t, a, b = F.col("major_move_time"), F.col("start_ts"), F.col("end_ts")
    return moves.join(m, MARKET).select(
        *moves.columns,
        time_position(t, a, b).alias("major_move_time_position_pct"),
        time_remaining(t, a, b).alias("major_move_time_remaining_pct"),
    )


def terminal_spikes(
    history: DataFrame, facts: DataFrame, last_frac: float = 0.05, progress: float = 0.25, eps: float = 1e-9
) -> DataFrame:
    """Start of the closing run-up per market, NULL where there is none.

    ``facts`` carries h_end, life, h_rows, last_price and yes_wins. Within the last
    part of the life: the first time at or after the (first) minimum of the
    outcome-aligned price at which the given share of the remaining rise is done.
    """
    f = facts.select(MARKET, "h_end", "life", "h_rows", "last_price", "yes_wins")
    side = lambda p: F.when(F.col("yes_wins"), p).otherwise(1 - p)
    # a market's rows are dealt by second, so the aggregations below combine in every task
    heavy = heavy_keys(f.select(MARKET, F.col("h_rows").alias("n")), [MARKET])
    tail = (
        join_dimension(history.select(MARKET, "ts", "trade_id", "yes_price"), f, MARKET, F.col("ts"), heavy)
        .filter((F.col("life") > 0) & (F.col("h_rows") >= 2) & (F.col("ts") >= F.col("h_end") - last_frac * F.col("life")))
        .withColumn("aligned", side(F.col("yes_price")))
    )
    low = tail.groupBy(MARKET).agg(F.min(F.struct("aligned", "ts")).alias("low"))
    move = side(F.col("last_price")) - F.col("low.aligned")
    hit = join_dimension(tail, low, MARKET, F.col("ts"), heavy).filter(
        (F.col("ts") >= F.col("low.ts")) & (move > eps) & (ratio(F.col("aligned") - F.col("low.aligned"), move) >= progress)
    )
    return f.select(MARKET).join(hit.groupBy(MARKET).agg(F.min("ts").alias("terminal_start_ts")), MARKET, "left")


# -------------------------------------------------------------------- mappings

def map_trades_to_history(
    trades: DataFrame, history: DataFrame, tolerance: int | None = None, cells: Cells | None = None
) -> DataFrame:
    """Attach the history row nearest in time (the earlier one on a tie)."""
    h = history.select(
        MARKET, F.col("ts").alias("history_ts"), F.col("yes_price").alias("history_yes_price"),
        F.col("trade_id").alias("history_trade_id"),
    )
    return asof_join(
        trades, h, [MARKET], "ts", "history_ts", ["history_ts", "history_yes_price", "history_trade_id"], "nearest",
        tolerance=tolerance, tiebreak=["history_trade_id"], cells=cells,
    )


def price_percentile(
    points: DataFrame, history: DataFrame, price: str, out: str, max_rows: int | None = None, heavy: DataFrame | None | object = COUNT,
    few: bool = False,
) -> DataFrame:
    """Share of the market's history rows priced at or below ``price``.

    An as-of lookup on the price axis against cumulative row counts. ``few`` says that a row per market fits every task.
    """
    counts = history.groupBy(MARKET, F.col("yes_price").alias("h_price")).agg(F.count("*").alias("_k"))
    sides = counts.select(MARKET, "h_price").unionByName(points.select(MARKET, F.col(price).alias("h_price")))
    cells = plan_cells(sides, [MARKET], "h_price", PRICE_WIDTHS, **({"max_rows": max_rows} if max_rows else {}))
    labelled = cells.label(counts, "h_price")
    ranked = scan(labelled, [MARKET], ["h_price"], running={"_upto": ("sum", F.col("_k"))}, cells=cells)
    totals = counts.groupBy(MARKET).agg(F.sum("_k").alias("_rows"))
    got = asof_join(points, ranked.select(MARKET, "h_price", "_upto"), [MARKET], price, "h_price", ["_upto"], cells=cells)
    totals, heavy = (F.broadcast(totals), None) if few else (totals, heavy)
    share = F.when(F.col(price).isNotNull(), F.coalesce(F.col("_upto"), F.lit(0)) / F.col("_rows"))
    return join_dimension(got, totals, MARKET, F.col(price), heavy).withColumn(out, share).drop("_upto", "_rows")


def step_series(history: DataFrame, cells: Cells | None = None) -> DataFrame:
    """Post-step display intervals: each price holds from its second to the next one."""
    h = cells.label(history, "ts") if cells is not None and cells.split else history
    h = scan(h, [MARKET], ["ts", "trade_id"], previous={"next_ts": F.col("ts")}, cells=cells, descending=True)
    return h.select(MARKET, F.col("ts").alias("from_ts"), F.col("next_ts").alias("until_ts"), "yes_price")
