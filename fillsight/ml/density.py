"""Density clustering (DBSCAN) of points on the plane, in time that grows with the points.

Cells have sides of eps / sqrt(2), so points of one cell are neighbours and what a point has
to look at lies in the 5 x 5 cells around it.

* A cell of at least ``min_points`` rows makes all its points core points. The points of all
  other cells are fewer than that per cell, so the questions asked of a cell come from at most
  25 x (min_points - 1) points. They travel to the cells as one bounded list; the rows of a
  cell, however many, meet that list and only counts come back.
* Neighbouring cells belong together where two of their core points are neighbours. That is
  decided on bounding boxes: far boxes are out, near ones linked, and what is undecided is
  halved and looked at again. No list of pairs of points is made.
* Clusters are the components of the cell graph. A border point goes to the cluster with
  the smallest key among those of its core neighbours.

Percentiles of the k-th neighbour distance follow from the same counts: a point's distance is
at most r where the point is a core point at radius r. Cell counts alone bracket a percentile,
core points at a few radii narrow the bracket to a factor of two, and only the points
undecided there are looked at again, with all radii of a round from one list of questions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fillsight.operators.components import components
from fillsight.operators.scan import join_counted
from fillsight.session import materialize

MIN_POINTS = 5
# Boxes are split this often along each axis.
SPLIT = 4
# Radii tried at once where ids repeat.
RADII = 12
# Parts a bracket of a percentile is cut into at once, and how far it is narrowed, relative to its end.
PARTS = 4096
TOLERANCE = 1e-7
# Sides of cells relative to eps: a hair shorter than its half diagonal, so rounding never breaks a cell's promise.
SIDE = 0.5**0.5 * (1 - 1e-9)
_CELL = ["cx", "cy"]


def _square(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def with_cells(points: DataFrame, eps: Column) -> DataFrame:
    """cx, cy: the cell of each point."""
    side = eps * SIDE
    return points.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))


def _around(reach: int = 2) -> Column:
    steps = range(-reach, reach + 1)
    return F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j")) for i in steps for j in steps])


def _reached(eps: Column) -> Column:
    """The steps to those of the cells around a point that reach within ``eps`` of it."""
    side, slack = eps * SIDE, 1e-14 * (F.abs("x") + F.abs("y"))

    def gap(at, cell, step):
        low = (F.col(cell) + step) * side
        return F.greatest(low - F.col(at), F.col(at) - low - side, F.lit(0.0))

    far = eps * (1 + 1e-6) + slack
    return F.filter(_around(), lambda o: _square(gap("x", "cx", o["i"]), gap("y", "cy", o["j"])) <= far * far)


def _ask(points: DataFrame, sparse: DataFrame, counts: DataFrame, keys: Sequence[str], eps: Column) -> DataFrame:
    """``points`` with ``q``: each sparse point that is a neighbour of theirs, one row each.

    ``counts`` has the rows of each cell of ``points``, ``keys`` the columns beside the cell.
    """
    asked = (
        sparse.select(*keys, "cx", "cy", F.struct("id", "x", "y").alias("q"), F.explode(_reached(eps)).alias("o"))
        .groupBy(*keys, (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
        .agg(F.collect_list("q").alias("qs"))
    )
    near = F.filter("qs", lambda q: _square(q["x"] - F.col("x"), q["y"] - F.col("y")) <= eps * eps)
    met = join_counted(points, asked, [*keys, *_CELL], counts, F.col("id"))
    return met.withColumn("q", F.explode(near)).drop("qs")


def _core(points: DataFrame, keys: Sequence[str], min_points: int, eps: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts per cell, points of sparse cells, their neighbours by id with ``n``)."""
    counts = materialize(points.groupBy(*keys, *_CELL).agg(F.count("*").alias("n")))
    sparse = materialize(points.join(counts.where(F.col("n") < min_points).drop("n"), [*keys, *_CELL], "left_semi"))
    found = _ask(points, sparse, counts, keys, eps).groupBy(*keys, F.col("q.id").alias("id")).agg(F.count("*").alias("n"))
    return counts, sparse, found


def core_counts(points: DataFrame, radii: Sequence[float], min_points: int = MIN_POINTS) -> dict[float, int]:
    """Number of points with ``min_points`` neighbours (themselves included) at each radius."""
    radius = F.explode(F.array(*[F.lit(float(r)) for r in radii]))
    many = with_cells(points.select("id", "x", "y", radius.alias("eps")), F.col("eps"))
    counts, _, found = _core(many, ["eps"], min_points, F.col("eps"))
    dense = counts.where(F.col("n") >= min_points).groupBy("eps").agg(F.sum("n").alias("c"))
    rest = found.where(F.col("n") >= min_points).groupBy("eps").agg(F.count("*").alias("c"))
    out = dict.fromkeys(map(float, radii), 0)
    for row in dense.unionByName(rest).groupBy("eps").agg(F.sum("c").alias("c")).collect():  # one row per radius
        out[row["eps"]] = row["c"]
    return out


def _undecided(points: DataFrame, radius: float, k: int) -> tuple[int, DataFrame]:
    """(number of points with ``k`` neighbours, themselves included, within the radius; the points with fewer)."""
    eps = F.lit(float(radius))
    counts, sparse, found = _core(with_cells(points, eps), [], k, eps)
    more = materialize(found.where(F.col("n") >= k).select("id"))
    dense = counts.agg(F.sum(F.when(F.col("n") >= k, F.col("n")))).first()[0] or 0
    return dense + more.count(), sparse.select("id", "x", "y").join(more, "id", "left_anti")


def _part_of(points: DataFrame, few: DataFrame, lo: float, hi: float, k: int) -> DataFrame:
    """``few`` (points with fewer than ``k`` neighbours within ``lo``) with ``part``: in which of
    ``PARTS`` equal parts of (lo, hi] the distance to the k-th neighbour lies. Farther ones drop out.
    """
    eps = F.lit(float(hi))
    placed = with_cells(points, eps)
    counts = placed.groupBy(*_CELL).agg(F.count("*").alias("n"))
    met = _ask(placed, with_cells(few, eps), counts, [], eps)
    far = F.sqrt(_square(F.col("q.x") - F.col("x"), F.col("q.y") - F.col("y")))
    part = F.greatest(F.ceil((far - lo) / ((hi - lo) / PARTS)), F.lit(0))
    n = met.groupBy(F.col("q").alias("q"), F.least(part, F.lit(PARTS)).alias("part")).agg(F.count("*").alias("n"))
    w = W.partitionBy("q").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    upto = n.select("q", "part", F.sum("n").over(w).alias("upto")).where(F.col("upto") >= k)
    return upto.groupBy("q").agg(F.greatest(F.min("part"), F.lit(1)).alias("part")).select("q.*", "part")


def _by_counts(points: DataFrame, at: Sequence[float], k: int, n: int, top: float) -> dict[float, float]:
    """The percentiles from counts of core points alone, ``RADII`` radii of each bracket at a time."""
    smallest = top * 1e-7
    brackets = dict.fromkeys(at, (0.0, top))
    while True:
        tries = set()
        for lo, hi in set(brackets.values()):
            if hi - lo > TOLERANCE * hi and hi > smallest:
                # small distances are looked for by ratio, the rest by difference
                low = max(lo, smallest / 2)
                step = [low * (hi / low) ** (i / (RADII + 1)) for i in range(RADII + 1)] if hi > 4 * low else [lo + (hi - lo) * i / (RADII + 1) for i in range(1, RADII + 1)]
                tries |= {r for r in step if lo < r < hi}
        if not tries:
            return {p: hi for p, (_, hi) in brackets.items()}
        counts = core_counts(points, sorted(tries), k)
        for p, (lo, hi) in brackets.items():
            enough = [r for r in tries if lo < r < hi and counts[r] >= p * n]
            short = [r for r in tries if lo < r < hi and counts[r] < p * n]
            brackets[p] = (max(short, default=lo), min(enough, default=hi))


def distance_percentiles(points: DataFrame, at: Sequence[float], k: int = MIN_POINTS) -> dict[float, float]:
    """The distance to the k-th neighbour (the point itself is the first) that a share of the points stays within.

    The smallest distance d such that at least the share has its k-th neighbour within d, to
    ``TOLERANCE``. NaN where fewer than k points exist. Where an ``id`` repeats, its rows cannot be
    told apart in the answers and the bracket is narrowed by counts of core points alone.
    """
    lo_x, hi_x, lo_y, hi_y, n = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if n < k:
        return dict.fromkeys(at, float("nan"))
    top = max(((hi_x - lo_x) ** 2 + (hi_y - lo_y) ** 2) ** 0.5, 1e-9)
    points = points.select("id", "x", "y")
    least = top * 5e-8  # smaller distances count as this
    if not points.groupBy("id").count().where("count > 1").isEmpty():
        return _by_counts(points, at, k, n, top)
    filled, cores, parts = {}, {}, {}

    def in_full_cells(level):
        # all points of a cell with k of them have their k-th neighbour within its diagonal
        if level not in filled:
            cells = with_cells(points, F.lit(least * 2.0**level)).groupBy(*_CELL).agg(F.count("*").alias("n"))
            filled[level] = cells.agg(F.sum(F.when(F.col("n") >= k, F.col("n")))).first()[0] or 0
        return filled[level]

    def core(radius):
        if radius not in cores:
            c, few = _undecided(points, radius, k)
            cores[radius] = (c, materialize(few))
        return cores[radius]

    def place(few, lo, hi):
        if (lo, hi) not in parts:
            placed = materialize(_part_of(points, few, lo, hi, k))
            sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most PARTS rows
            parts[lo, hi] = placed, sizes
        return parts[lo, hi]

    def percentile(p):
        low, high = 0, 26
        while low < high:  # the first level whose full cells hold the share
            middle = (low + high) // 2
            low, high = (low, middle) if in_full_cells(middle) >= p * n else (middle + 1, high)
        hi = least * 2.0**low
        while hi > least and core(hi / 2)[0] >= p * n:
            hi /= 2
        if hi <= least:
            return least
        lo = hi / 2
        below, few = core(lo)
        while hi - lo > TOLERANCE * hi:
            placed, sizes = place(few, lo, hi)
            part = next((j for j in sorted(sizes) if below + sum(c for i, c in sizes.items() if i <= j) >= p * n), None)
            if part is None:  # lost to rounding at the end of the bracket
                return hi
            below += sum(c for i, c in sizes.items() if i < part)
            width = (hi - lo) / PARTS
            lo, hi, few = lo + (part - 1) * width, lo + part * width, placed.where(F.col("part") == part).select("id", "x", "y")
        return hi * (1 + 1e-12)

    return {p: percentile(p) for p in at}


def _gap(side: str) -> Column:
    """Distance of two boxes along an axis, 0 where they overlap."""
    return F.greatest(F.col(f"b_lo_{side}") - F.col(f"a_hi_{side}"), F.col(f"a_lo_{side}") - F.col(f"b_hi_{side}"), F.lit(0.0))


def _reach(side: str) -> Column:
    """Largest distance of two boxes along an axis."""
    return F.greatest(F.col(f"b_hi_{side}") - F.col(f"a_lo_{side}"), F.col(f"a_hi_{side}") - F.col(f"b_lo_{side}"))


def _boxes(core: DataFrame) -> DataFrame:
    """Bounding box and one point of the core points of each (cell, box)."""
    sides = [f(s).alias(f"{n}_{s}") for s in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]
    return core.groupBy("cell", "box").agg(*sides, F.min(F.struct("x", "y")).alias("one"))


def _paired(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pairs (a, b, box_a, box_b) of cells' boxes with the boxes of both sides."""
    for side in ("a", "b"):
        named = boxes.select(F.col("cell").alias(side), F.col("parent").alias(f"box_{side}"), F.col("box").alias(f"{side}_box"),
                             *[F.col(c).alias(f"{side}_{c}") for c in ("lo_x", "hi_x", "lo_y", "hi_y", "one")])
        pairs = pairs.join(named, [side, f"box_{side}"])
    return pairs


def cell_links(core: DataFrame, eps: float) -> DataFrame:
    """(a, b): neighbouring cells that hold core points within ``eps`` of each other.

    ``core`` has x, y, cx, cy. A round takes the undecided pairs of boxes apart; a pair of cells
    leaves with its first link, a pair of boxes once it is too far apart.
    """
    cell = F.struct("cx", "cy")
    core = materialize(core.select("x", "y", cell.alias("cell"), F.lit("").alias("box")))
    cells = core.select("cell").distinct()
    half = F.filter(_around(), lambda o: (o["i"] > 0) | ((o["i"] == 0) & (o["j"] > 0)))
    pairs = cells.select(F.col("cell").alias("a"), F.explode(half).alias("o")).select(
        "a", F.struct((F.col("a.cx") + F.col("o.i")).alias("cx"), (F.col("a.cy") + F.col("o.j")).alias("cy")).alias("b"))
    pairs = materialize(pairs.join(cells.withColumnRenamed("cell", "b"), "b", "left_semi").withColumns({"box_a": F.lit(""), "box_b": F.lit("")}))
    boxes, linked, depth = _boxes(core).withColumn("parent", F.col("box")), [], 0
    square = float(eps) * float(eps)
    while True:
        both = _paired(pairs, materialize(boxes))
        one = _square(F.col("a_one.x") - F.col("b_one.x"), F.col("a_one.y") - F.col("b_one.y"))
        near = F.least(one, _square(_reach("x"), _reach("y"))) <= square
        both = materialize(both.where(_square(_gap("x"), _gap("y")) <= square).select("a", "b", "a_box", "b_box", near.alias("near")))
        linked.append(materialize(both.where("near").select("a", "b").distinct()))
        pairs = materialize(both.join(linked[-1], ["a", "b"], "left_anti").select("a", "b", F.col("a_box").alias("box_a"), F.col("b_box").alias("box_b")))
        if pairs.isEmpty():
            out = linked[0]
            for more in linked[1:]:
                out = out.unionByName(more)
            return out
        wanted = pairs.select(F.col("a").alias("cell"), F.col("box_a").alias("box")).union(pairs.select("b", "box_b")).distinct()
        depth += 1
        # a box splits between its own ends, so one distinct point is a box without extent
        frame = materialize(boxes.join(wanted, ["cell", "box"], "left_semi").drop("parent", "one"))
        core = materialize(_split(core.join(frame, ["cell", "box"])))
        boxes = _boxes(core).withColumn("parent", F.substring_index("box", "/", depth))


def _split(core: DataFrame) -> DataFrame:
    """Core points of undecided boxes in the parts of their box."""
    def part(side):
        lo, hi = F.col(f"lo_{side}"), F.col(f"hi_{side}")
        return F.when(hi > lo, F.least(F.floor((F.col(side) - lo) / (hi - lo) * SPLIT), F.lit(SPLIT - 1))).otherwise(0)

    name = F.concat("box", F.lit("/"), part("x").cast("string"), F.lit(","), part("y").cast("string"))
    return core.select("x", "y", "cell", name.alias("box"))


def dbscan(points: DataFrame, eps: float, min_points: int = MIN_POINTS) -> DataFrame:
    """id, kind (core, border or noise) and cluster of ``points`` (id, x, y).

    ``id`` is unique and orderable. A cluster is named by its smallest core id; noise has
    none. Points with a NULL or non-finite coordinate are noise. Repeated points count each.
    """
    if not eps > 0:
        raise ValueError("eps must be positive")
    finite = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    radius = F.lit(float(eps))
    placed = materialize(with_cells(points.where(finite).select("id", "x", "y"), radius))
    counts, sparse, found = _core(placed, [], min_points, radius)
    dense = placed.join(counts.where(F.col("n") >= min_points).drop("n"), _CELL, "left_semi")
    more = sparse.join(found.where(F.col("n") >= min_points).select("id"), "id", "left_semi")
    core = materialize(dense.unionByName(more.select(*dense.columns)))
    number = lambda c: F.concat(F.col(f"{c}.cx").cast("string"), F.lit(","), F.col(f"{c}.cy").cast("string"))
    links = cell_links(core, eps).select(number("a").alias("a"), number("b").alias("b"))
    roots = components(links)
    here = core.groupBy(*_CELL).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    here = here.withColumn("node", F.concat(F.col("cx").cast("string"), F.lit(","), F.col("cy").cast("string")))
    here = materialize(here.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    names = here.groupBy("root").agg(F.min("first").alias("cluster"))
    cells = materialize(here.join(names, "root").select(*_CELL, "cluster", "n"))
    labelled = materialize(join_counted(core, cells.drop("n"), _CELL, cells.select(*_CELL, "n"), F.col("id")))
    rest = sparse.join(core.select("id"), "id", "left_anti")
    border = _ask(labelled, rest, cells.select(*_CELL, "n"), [], radius).groupBy(F.col("q.id").alias("id")).agg(F.min("cluster").alias("cluster"))
    known = labelled.select("id", F.lit("core").alias("kind"), "cluster").unionByName(border.select("id", F.lit("border").alias("kind"), "cluster"))
    return points.select("id").join(known, "id", "left").withColumn("kind", F.coalesce("kind", F.lit("noise")))
