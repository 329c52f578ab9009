"""Ordered scans that stay parallel when one group holds a large share of all rows.

A window over ``PARTITION BY market`` runs each market in one task. That is the
right plan while every group fits a task, and the wrong one for a market (or
wallet) with a third of the data. ``plan_cells`` counts the groups first. If all
are small it returns cells without splits and every scan below is one ordinary
window. Otherwise rows of over-full groups are split along their ordered axis
into cells (day, hour, minute, second of a time axis), each scan runs per
``(group, cell)``, and what a cell needs from its neighbours is carried in from a
table with one row per cell. Results are identical in both modes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fillsight.session import materialize

CELL = "_cell"
# Rows one window partition may hold before its group is split.
MAX_GROUP_ROWS = 2_000_000
TIME_WIDTHS = (86_400, 3_600, 60, 1)
# Positions on the matched-unit axis are micro-tokens.
UNIT_WIDTHS = (10**13, 10**11, 10**9, 10**7, 10**5)
PRICE_WIDTHS = (0.1, 0.01, 0.001, 0.0001, 0.000001)


def floor_to(axis: Column, width: float) -> Column:
    if isinstance(width, int):
        return axis - F.pmod(axis, F.lit(width))
    return (F.floor(axis / F.lit(width)) * F.lit(width)).cast("double")


@dataclass(frozen=True)
class Cells:
    """Which groups are split, and how finely along the axis."""

    keys: tuple[str, ...]
    widths: tuple = TIME_WIDTHS
    # hot[0]: over-full groups; hot[i]: over-full cells of width widths[i-1]
    hot: tuple[DataFrame, ...] = field(default=())

    @property
    def split(self) -> bool:
        return bool(self.hot)

    def label(self, df: DataFrame, axis: str) -> DataFrame:
        """Add the cell of each row; a pure function of (keys, axis)."""
        if not self.split:
            return df
        kind = "bigint" if isinstance(self.widths[0], int) else "double"
        # rows of the finest over-full cells get the next width, all others the one they fit
        cell = floor_to(F.col(axis), self.widths[len(self.hot) - 1])
        conds = []
        for i, table in enumerate(self.hot):
            flag = f"_hot{i}"
            on = list(self.keys)
            if i:
                df = df.withColumn(f"_c{i}", floor_to(F.col(axis), self.widths[i - 1]).cast(kind))
                on.append(f"_c{i}")
            df = df.join(table.withColumn(flag, F.lit(True)), on, "left")
            conds.append(flag)
        for i in range(len(self.hot) - 1, 0, -1):
            cell = F.when(F.col(conds[i]), cell).otherwise(floor_to(F.col(axis), self.widths[i - 1]))
        cell = F.when(F.col(conds[0]), cell).otherwise(F.lit(0))
        drop = conds + [f"_c{i}" for i in range(1, len(self.hot))]
        return df.withColumn(CELL, cell.cast(kind)).drop(*drop)


def plan_cells(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    widths: Sequence = TIME_WIDTHS,
    max_rows: int = MAX_GROUP_ROWS,
) -> Cells:
    """Count rows per group (one map-side combined job) and decide the splits.

    A table of over-full groups or cells has at most ``total_rows / max_rows`` rows; the
    optimizer decides from its size how it is joined. A group gets about as many cells as
    its rows need, so the carry over its cells is short.
    """
    keys = tuple(keys)
    over = F.col("count") > max_rows
    base = df.select(*keys, F.col(axis).alias("_axis")).filter(F.col("_axis").isNotNull())
    hot_groups = base.groupBy(*keys).count().filter(over).select(*keys)
    if hot_groups.isEmpty():
        return Cells(keys, tuple(widths))
    kind = "bigint" if isinstance(widths[0], int) else "double"
    # small tables read by every label() of the job: written once, not recomputed
    hot = [materialize(hot_groups)]
    hot_groups = hot[0]
    rows = base.join(hot_groups, list(keys), "left_semi")
    for i, width in enumerate(widths[:-1], start=1):
        name = f"_c{i}"
        rows = rows.withColumn(name, floor_to(F.col("_axis"), width).cast(kind))
        table = rows.groupBy(*keys, name).count().filter(over).select(*keys, name)
        table = materialize(table)
        if table.isEmpty():
            break
        hot.append(table)
        rows = rows.join(table, [*keys, name], "left_semi")
    return Cells(keys, tuple(widths), tuple(hot))


def _orders(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    running: dict[str, tuple[str, Column]] | None = None,
    latest: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    cells: Cells | None = None,
    descending: bool = False,
    peers: bool = False,
) -> DataFrame:
    """Add running values along ``order`` within ``keys``.

    running:  out -> (sum|min|max|count, expr) over all rows up to the current one
    latest:   out -> last non-null value of expr up to the current row
    previous: out -> last non-null value of expr strictly before the current row
    ``peers`` lets rows with equal order see each other (RANGE frame).
    With splitting cells the frame must already carry the cell column.
    """
    running, latest, previous = running or {}, latest or {}, previous or {}
    split = cells is not None and cells.split
    parts = [*keys, CELL] if split else list(keys)
    w = W.partitionBy(*parts).orderBy(*_orders(order, descending))
    upto = w.rangeBetween(W.unboundedPreceding, W.currentRow) if peers else w.rowsBetween(W.unboundedPreceding, 0)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    fns = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    cols = {o: fns[f](e).over(upto) for o, (f, e) in running.items()}
    cols |= {o: F.last(e, True).over(upto) for o, e in latest.items()}
    cols |= {o: F.last(e, True).over(before) for o, e in previous.items()}
    out = df.select("*", *[c.alias(o) for o, c in cols.items()])
    if not split:
        return out

    position = F.struct(*[F.col(c) for c in order])
    pick = F.min_by if descending else F.max_by
    totals = [fns[f](e).alias(o) for o, (f, e) in running.items()]
    totals += [pick(e, F.when(e.isNotNull(), position)).alias(o) for o, e in (latest | previous).items()]
    per_cell = df.groupBy(*parts).agg(*totals)
    cw = W.partitionBy(*keys).orderBy(*_orders([CELL], descending)).rowsBetween(W.unboundedPreceding, -1)
    merge = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}
    carry = [merge[f](F.col(o)).over(cw).alias(f"_in_{o}") for o, (f, _) in running.items()]
    carry += [F.last(F.col(o), True).over(cw).alias(f"_in_{o}") for o in (latest | previous)]
    carried = per_cell.select(*parts, *carry)
    joined = out.join(carried, parts, "left")
    final = []
    for c in out.columns:
        if c in running:
            fn, inner, outer = running[c][0], F.col(c), F.col(f"_in_{c}")
            if fn in ("sum", "count"):
                both = F.coalesce(inner + outer, inner, outer)
            else:
                both = F.least(inner, outer) if fn == "min" else F.greatest(inner, outer)
            final.append(both.alias(c))
        elif c in latest or c in previous:
            final.append(F.coalesce(F.col(c), F.col(f"_in_{c}")).alias(c))
        else:
            final.append(F.col(c))
    return joined.select(*final)


def following(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, value: Column, cells: Cells | None = None
) -> DataFrame:
    """Add the value of the next row along ``order`` (NULL on the last row)."""
    return scan(df, keys, order, previous={out: value}, cells=cells, descending=True)


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], split: bool = False
) -> DataFrame:
    """Exact interpolated percentiles per group.

    ``split=False`` is the built-in aggregate. It keeps every distinct value of a
    group in one buffer, so for over-full groups values are first counted, then
    located through a coarse monotone cell, and only the cells that hold a wanted
    rank are ordered.
    """
    keys = list(keys)
    if not split:
        return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(q)).alias(n) for n, q in points.items()])
    v = F.col(value)
    counts = (
        df.filter(v.isNotNull())
        .groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))
        .withColumn(CELL, F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * 20_000))
    )
    by_cell = counts.groupBy(*keys, CELL).agg(F.sum("_n").alias("_cn"))
    cw = W.partitionBy(*keys).orderBy(CELL).rowsBetween(W.unboundedPreceding, 0)
    ranks = []
    for name, q in points.items():
        pos = (F.col("_total") - 1) * F.lit(q)
        ranks += [
            F.struct(F.lit(name).alias("name"), F.floor(pos).alias("rank"), (1 - (pos - F.floor(pos))).alias("w")),
            F.struct(F.lit(name).alias("name"), F.ceil(pos).alias("rank"), (pos - F.floor(pos)).alias("w")),
        ]
    located = (
        by_cell.withColumn("_hi", F.sum("_cn").over(cw))
        .join(by_cell.groupBy(*keys).agg(F.sum("_cn").alias("_total")), keys)
        .select(*keys, CELL, (F.col("_hi") - F.col("_cn")).alias("_lo"), "_hi", F.explode(F.array(*ranks)).alias("r"))
        .filter((F.col("r.rank") >= F.col("_lo")) & (F.col("r.rank") < F.col("_hi")))
    )
    wanted = located.select(*keys, CELL, "_lo").distinct()
    vw = W.partitionBy(*keys, CELL).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    inside = (
        counts.join(wanted, [*keys, CELL])
        .withColumn("_top", F.col("_lo") + F.sum("_n").over(vw))
        .select(*keys, CELL, "_v", (F.col("_top") - F.col("_n")).alias("_from"), "_top")
    )
    hits = located.drop("_lo", "_hi").join(inside, [*keys, CELL]).filter(
        (F.col("r.rank") >= F.col("_from")) & (F.col("r.rank") < F.col("_top"))
    )
    return hits.groupBy(*keys).agg(*[
        F.sum(F.when((F.col("r.name") == n) & (F.col("r.w") > 0), F.col("_v") * F.col("r.w"))).alias(n) for n in points
    ])


def with_scalars(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame as a scalar subquery (NULL when it has no row)."""
    values = row.select(F.struct(*row.columns).alias("s")).scalar()
    return df.withColumn("_s", values).select(*df.columns, *[F.col(f"_s.{c}").alias(c) for c in row.columns])


# Tells ``join_dimension`` to count the keys itself.
COUNT = object()


def join_dimension(df: DataFrame, dim: DataFrame, key: str, spread: Column, heavy: DataFrame | None | object = COUNT) -> DataFrame:
    """Inner join with one row per ``key`` that keeps no hot key in one task.

    Where the dimension is too large to be broadcast, a plain join leaves all rows of a key
    in one task, and later aggregations by (key, more) would stay there. The rows of a heavy
    key are dealt over as many salts as its rows need. ``heavy`` (the result of ``heavy_keys``)
    spares the count of the keys where several joins share it.
    """
    if heavy is COUNT:
        heavy = heavy_keys(df.groupBy(key).agg(F.count("*").alias("n")), [key])
    return _salted_join(df, dim, [key], heavy, spread)


# Rows of one key that a counted join leaves under one key, and the most keys it deals out.
JOIN_ROWS = 200_000
MANY_KEYS = 50_000


def heavy_keys(counts: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """keys and ``_salts`` of the keys with more rows (``n``) than a task should get at once; None without any.

    What counts as many grows with the table, so at most ``MANY_KEYS`` keys are heavy and the
    result may be broadcast at any size of the table.
    """
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    bound = max(JOIN_ROWS, (total or 0) // MANY_KEYS)
    if (most or 0) <= bound:
        return None
    return materialize(counts.where(F.col("n") > bound).select(*keys, (F.floor(F.col("n") / bound) + 1).cast("int").alias("_salts")))


def join_counted(df: DataFrame, dim: DataFrame, keys: Sequence[str], counts: DataFrame, spread: Column) -> DataFrame:
    """Inner join of ``df`` with one row per key, where ``counts`` has the rows ``n`` of each (NULL-free) key of ``df``.

    The rows of a heavy key are dealt by ``spread`` over as many tasks as they need, and its row of
    ``dim`` is copied to each; all other keys are joined as they are.
    """
    return _salted_join(df, dim, list(keys), heavy_keys(counts, keys), spread)


def _salted_join(df: DataFrame, dim: DataFrame, keys: list[str], heavy: DataFrame | None, spread: Column) -> DataFrame:
    if heavy is None:
        return df.join(dim, keys)
    salts = F.coalesce("_salts", F.lit(1))
    heavy = F.broadcast(heavy)
    dealt = df.join(heavy, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    copies = dim.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def numbered(df: DataFrame, order: Sequence[Column], out: str = "_rn") -> DataFrame:
    """Add the place (from 0) of each row in the whole order, which must be total.

    Rows are dealt by ranges of the order and numbered inside; each range starts after the
    rows of those before it. Only one count per range reaches the driver.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    start = F.get(F.array(*[F.lit(b).cast("bigint") for b in before or [0]]), F.col("_part"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return placed.withColumn(out, start + own - 1).drop("_part")


HASH_BITS, HASH_STEP = 60, 10


def mark_first(
    df: DataFrame, groups: Sequence[str], want: DataFrame, ties: Sequence[str], hashed: str = "_h", out: str = "_first",
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Mark the first ``_want`` rows of each group in the order of (hash, ties); no group is ordered.

    ``want`` has one row per group, ``hashed`` is a hash of ``HASH_BITS`` bits. Rows are counted by the
    leading bits of the hash; whole parts go in until one would hold too many. Only rows of
    that part are ordered, after it was taken apart by further bits while it has over ``max_rows``.
    """
    groups, w = list(groups), W.partitionBy(*groups).orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    prefix = lambda shift: F.call_function("shiftright", F.col(hashed), shift.cast("int") if isinstance(shift, Column) else F.lit(shift))
    rows, left, done, shift = df.select(*groups, hashed), want.select(*groups, "_want"), [], HASH_BITS - HASH_STEP
    counts = None
    while True:
        parts = materialize(rows.groupBy(*groups, prefix(shift).alias("_p")).agg(F.count("*").alias("_n")))
        if counts is None:
            counts = parts.groupBy(*groups).agg(F.sum("_n").alias("n"))
        upto = parts.withColumn("_upto", F.sum("_n").over(w)).join(left, groups).where(F.col("_upto") >= F.col("_want"))
        cut = upto.groupBy(*groups).agg(F.min(F.struct("_p", "_n", "_upto", "_want")).alias("c"))
        cut = materialize(cut.select(*groups, F.lit(shift).alias("_shift"), "c._p", "c._n", (F.col("c._want") - F.col("c._upto") + F.col("c._n")).alias("_want")))
        over = (F.col("_n") > max_rows) & (F.col("_want") < F.col("_n"))
        if shift == 0 or cut.where(over).isEmpty():
            done.append(cut)
            break
        done.append(cut.where(~over))
        left = cut.where(over).select(*groups, "_want", F.col("_p").alias("_cut"))
        rows = rows.join(left.drop("_want"), groups).where(prefix(shift) == F.col("_cut")).drop("_cut")
        left = left.drop("_cut")
        shift -= HASH_STEP
    cuts = done[0]
    for more in done[1:]:
        cuts = cuts.unionByName(more)
    # a group without a cut has no more rows than are wanted
    cuts = want.select(*groups, F.col("_want").alias("_all")).join(cuts.drop("_n"), groups, "left")
    placed = join_counted(df, cuts, groups, counts, F.col(hashed))
    own = prefix(F.coalesce("_shift", F.lit(0)))
    side = F.when(F.col("_p").isNull(), -1).otherwise(F.signum((own - F.col("_p")).cast("double")).cast("int"))
    inner = W.partitionBy(*groups, "_side", F.when(F.col("_side") != 0, F.col(hashed))).orderBy(hashed, *ties)
    first = (F.col("_side") < 0) | ((F.col("_side") == 0) & (F.row_number().over(inner) <= F.col("_want")))
    return placed.withColumn("_side", side).withColumn(out, first).drop("_side", "_shift", "_p", "_want", "_all")
