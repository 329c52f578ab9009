"""Column functions (everything here is a Catalyst expression)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fillsight.schema import ratio


def text_list(col: Column) -> Column:
    """JSON array text, or a bare string as a one-element list."""
    t = F.trim(col)
    parsed = F.from_json(t, "array<string>")
    return F.when(t.isNull(), None).when(t.startswith("[") & t.endswith("]"), parsed).otherwise(F.array(t))


def price_list(col: Column) -> Column:
    """List of prices as doubles; missing means an empty list."""
    return F.coalesce(F.transform(text_list(col), lambda x: x.try_cast("double")), F.array().cast("array<double>"))


def unix_seconds(col: Column) -> Column:
    """ISO-8601 text with ``Z``, ``+00``, ``+0000`` or ``+00:00`` to unix seconds."""
    t = F.regexp_replace(F.trim(col), "Z$", "+00:00")
    t = F.regexp_replace(t, r"([+-]\d{2})$", "$1:00")
    t = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    # the date's own '-dd' tail is not an offset
    t = F.when(F.trim(col).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.trim(col), F.lit("T00:00:00+00:00"))).otherwise(t)
    return F.unix_timestamp(F.try_to_timestamp(t))


def time_position(ts: Column, start: Column, end: Column) -> Column:
    """Place of ``ts`` on the lifetime, NULL unless the lifetime is positive."""
    return F.when(end > start, ratio(ts - start, end - start))


def time_remaining(ts: Column, start: Column, end: Column) -> Column:
    return 1 - time_position(ts, start, end)


def relative_gap(t1: Column, t2: Column, start: Column, end: Column) -> Column:
    return F.when(end > start, ratio(t2 - t1, end - start))


def final_outcome(closed: Column, prices: Column) -> Column:
    """1 / 0 for a closed market by its first outcome price, else NULL."""
    return F.when(closed & (F.size(prices) > 0), F.when(F.try_element_at(prices, F.lit(1)) >= 0.5, 1).otherwise(0))


def platt(raw: Column, a: float | Column, b: float | Column, reversed_classes: bool = False) -> Column:
    """Sigmoid calibration; ``reversed_classes`` when the fitted class order is (1, 0)."""
    a = a if isinstance(a, Column) else F.lit(float(a))
    b = b if isinstance(b, Column) else F.lit(float(b))
    p = 1 / (1 + F.exp(-(a * raw + b)))
    return 1 - p if reversed_classes else p


def price_weight(price: Column, alpha: float = 1.5, cap: float = 8.0) -> Column:
    """min(1 / max(price, 0)^alpha, cap); the cap where price is not positive."""
    return F.when(price > 0, F.least(1 / F.pow(price, F.lit(alpha)), F.lit(cap))).otherwise(F.lit(cap))


def positive_part(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def negative_part(x: Column) -> Column:
    return F.greatest(-x, F.lit(0.0))


def _grouped(value: Column, places: int) -> Column:
    return F.format_number(value, places)


# Fixed display values. Unit: (times, divided by), text before, text after, and the decimal places
# from a magnitude on, largest first.
UNITS = {
    "count": ((1, 1), "", "", ((0, 1),)),
    "days": ((1, 86_400), "", "d", ((1000, 0), (10, 1), (0, 2))),
    "plain": ((1, 1), "", "", ((0, 3),)),
    "ratio": ((1, 1), "", "×", ((100, 0), (0, 2))),
    "share": ((100, 1), "", "%", ((0, 1),)),
    "usdc": ((1, 1), "$", "", ((0, 0),)),
}


def format_unit(value: Column, unit: str) -> Column:
    """Display text of a value by the table ``UNITS``; a dash where it is NULL."""
    (times, parts), before, after, places = UNITS.get(unit, UNITS["plain"])
    shown = value * times / parts
    number = F.coalesce(*[F.when(F.abs(shown) >= least, _grouped(shown, n)) for least, n in places])
    return F.coalesce(F.concat(F.lit(before), number, F.lit(after)), F.lit("—"))


def ratio_label(pos: Column, neg: Column) -> Column:
    """How many times the first mean is the second, keeping the sign."""
    r = ratio(pos, neg)
    places = F.when((r >= 0) & (r >= 100), _grouped(r, 0)).otherwise(_grouped(r, 2))
    return (
        F.when(pos.isNull() | neg.isNull(), F.lit("—"))
        .when((neg == 0) & (pos != 0), F.lit("∞"))
        .when(neg == 0, F.lit("1.0×"))
        .otherwise(F.concat(places, F.lit("×")))
    )


def fraction_tag(frac: float, places: int = 3) -> str:
    return f"{frac:.{places}f}".replace(".", "p")


def grid_tag(horizon: float, lookback: float) -> str:
    return f"h{fraction_tag(horizon)}_lb{fraction_tag(lookback)}"


def short_key(slug: Column, limit: int = 180, keep: int = 170) -> Column:
    """File-system safe key: the slug, or its head plus eight md5 digits when long."""
    return F.when(F.length(slug) <= limit, slug).otherwise(
        F.concat(F.substring(slug, 1, keep), F.lit("__"), F.substring(F.md5(slug), 1, 8))
    )


def slug8(slug: Column) -> Column:
    """Key used in result file names: the slug without dashes, cut to 24 characters."""
    return F.substring(F.replace(slug, F.lit("-"), F.lit("")), 1, 24)


def marker_size(amount: Column) -> Column:
    """Marker area growing with the square root of the amount, capped."""
    return F.least(36 + 18 * F.sqrt(F.greatest(amount, F.lit(0.0))), F.lit(160.0))


def min_max_clip(x: Column, lo: Column, hi: Column) -> Column:
    """Scale by training bounds and clip to [0, 1]; flat bounds give 0."""
    return F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))).otherwise(F.lit(0.0))


# The names under which reports show the fold and split settings of a training run.
FOLD_LABELS = {
    "rows": "(none)", "stratified_group": "StratifiedGroupKFold(shuffle=True)", "group": "GroupKFold", "time": "TimeSeriesSplit",
}
SPLIT_LABELS = {"rows": "row-level 80/20", "pinned": "pinned", "random_market": "random by market (seeded)"}


def labelled(setting: Column, labels: dict[str, str]) -> Column:
    """Report name of a setting; settings without one keep their own."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(names, setting), setting)


def abbreviated(items: Column, keep: int = 6, width: int = 30) -> Column:
    """Items of a list in one line: long ones clipped to ``width``, and how many follow after ``keep``."""
    shown = F.transform(F.slice(items, 1, keep), lambda x: F.regexp_replace(x, f"^(.{{{width - 1}}}).{{2,}}$", "$1..."))
    more = F.filter(F.array(F.size(items) - keep), lambda n: n > 0)
    return F.array_join(F.concat(shown, F.transform(more, lambda n: F.format_string("(+%d more)", n))), ", ")
