"""As-of joins built from one ordered scan.

The right side becomes an index whose rows know their successor, so a single
backward scan answers backward, forward and nearest lookups alike. Left rows are
merged in by a union and carried through as they are: no join back, no
comparison of all left with all right rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fillsight.operators.scan import Cells, following, scan


def build_index(
    right: DataFrame,
    by: Sequence[str],
    axis: str,
    values: Sequence[str],
    tiebreak: Sequence[str] = (),
    cells: Cells | None = None,
) -> DataFrame:
    """One row per (by, axis): ``cur`` and ``nxt`` structs of first/last values.

    Each struct holds ``at`` (axis), ``lo`` (values of the first row at that axis
    point) and ``hi`` (values of the last one). One extra row per group with a NULL
    ``cur`` stands before the first point, so lookups before it see it as ``nxt``.
    """
    by = list(by)
    vals = F.struct(*values)
    rows = right.filter(F.col(axis).isNotNull())
    if tiebreak:
        pos = F.struct(*tiebreak)
        points = rows.groupBy(*by, axis).agg(F.min_by(vals, pos).alias("lo"), F.max_by(vals, pos).alias("hi"))
    else:
        points = rows.select(*by, axis, vals.alias("lo"), vals.alias("hi"))
    points = points.select(*by, F.col(axis).alias("at"), F.struct(F.col(axis).alias("at"), "lo", "hi").alias("cur"))
    split = cells is not None and cells.split
    labelled = cells.label(points, "at") if split else points
    linked = following(labelled, by, ["at"], "nxt", F.col("cur"), cells).select(*by, "at", "cur", "nxt")
    before = points.groupBy(*by).agg(F.min_by("cur", "at").alias("nxt"))
    head = before.select(
        *by, F.col("nxt.at").alias("at"), F.lit(None).cast(points.schema["cur"].dataType).alias("cur"), "nxt"
    )
    return linked.withColumn("head", F.lit(0)).unionByName(head.withColumn("head", F.lit(1)))


def lookup(
    left: DataFrame, index: DataFrame, by: Sequence[str], axis: str, out: str = "hit", cells: Cells | None = None
) -> DataFrame:
    """Add ``out = struct(cur, nxt)``: the index row at or before ``axis``, and its successor."""
    by = list(by)
    hit_type = index.select(F.struct("cur", "nxt").alias("h")).schema["h"].dataType
    row_type = left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType
    axis_type = left.schema[axis].dataType
    # the head row of a group sorts before every probe (seq -1 with a NULL axis)
    table = index.select(
        *by,
        F.when(F.col("head") == 0, F.col("at")).cast(axis_type).alias("_at"),
        F.lit(0).alias("_seq"),
        F.struct("cur", "nxt").alias("_hit"),
        F.lit(None).cast(row_type).alias("_row"),
        F.col("at").cast(axis_type).alias("_cell_at"),
    )
    probes = left.select(
        *by,
        F.col(axis).alias("_at"),
        F.lit(1).alias("_seq"),
        F.lit(None).cast(hit_type).alias("_hit"),
        F.struct(*left.columns).alias("_row"),
        F.col(axis).alias("_cell_at"),
    ).filter(F.col("_at").isNotNull())
    both = table.unionByName(probes)
    split = cells is not None and cells.split
    if split:
        both = cells.label(both, "_cell_at")
    found = scan(both, by, ["_at", "_seq"], latest={out: F.col("_hit")}, cells=cells)
    found = found.filter(F.col("_seq") == 1).select("_row.*", out)
    if split:
        # a probe in a cell before the group's first index row has seen no head row yet
        first = index.filter(F.col("head") == 1).select(*by, F.struct("cur", "nxt").alias("_head"))
        found = (
            found.join(first, by, "left")
            .withColumn(out, F.coalesce(F.col(out), F.col("_head")))
            .drop("_head")
        )
    return found


def backward(hit: str, value: str, clamp: bool = True) -> Column:
    """Value at the last point <= axis; the first point's value when there is none."""
    v = F.col(f"{hit}.cur.hi.{value}")
    return F.coalesce(v, F.col(f"{hit}.nxt.lo.{value}")) if clamp else v


def forward(hit: str, axis: Column, value: str, clamp: bool = True) -> Column:
    """Value at the first point >= axis; the last point's value when there is none."""
    exact = F.col(f"{hit}.cur.at") == axis
    nxt = F.when(exact, F.col(f"{hit}.cur.lo.{value}")).otherwise(F.col(f"{hit}.nxt.lo.{value}"))
    if not clamp:
        return nxt
    at_end = F.col(f"{hit}.nxt.at").isNull() & ~F.coalesce(exact, F.lit(False))
    return F.when(at_end, F.col(f"{hit}.cur.hi.{value}")).otherwise(nxt)


def nearest(hit: str, axis: Column, value: str, tolerance: int | None = None) -> Column:
    """Value at the closest point; on equal distance the earlier one."""
    back = axis - F.col(f"{hit}.cur.at")
    fwd = F.col(f"{hit}.nxt.at") - axis
    use_back = F.col(f"{hit}.cur.at").isNotNull() & (F.col(f"{hit}.nxt.at").isNull() | (back <= fwd))
    picked = F.when(use_back, F.col(f"{hit}.cur.hi.{value}")).otherwise(F.col(f"{hit}.nxt.lo.{value}"))
    if tolerance is None:
        return picked
    dist = F.when(use_back, back).otherwise(fwd)
    return F.when(dist <= tolerance, picked)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    direction: str = "backward",
    tolerance: int | None = None,
    clamp: bool = False,
    prefix: str = "",
    tiebreak: Sequence[str] = (),
    cells: Cells | None = None,
) -> DataFrame:
    """Attach ``values`` of the as-of matching right row to every left row."""
    index = build_index(right, by, right_on, list(dict.fromkeys([*values, right_on])), tiebreak, cells)
    found = lookup(left, index, by, left_on, "_h", cells)
    axis = F.col(left_on)

    def pick(v: str) -> Column:
        if direction == "backward":
            return backward("_h", v, clamp)
        if direction == "forward":
            return forward("_h", axis, v, clamp)
        if direction == "nearest":
            return nearest("_h", axis, v, tolerance)
        raise ValueError("direction must be backward, forward or nearest")

    out = []
    for v in values:
        c = pick(v)
        if tolerance is not None and direction != "nearest":
            c = F.when(F.abs(pick(right_on) - axis) <= tolerance, c)
        out.append(c.alias(f"{prefix}{v}"))
    return found.select(*left.columns, *out)
