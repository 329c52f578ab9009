"""Labelled datasets: guarded joins, sampling, splits, folds and profiles.

Random choices are ordered by a hash of (seed, keys): the same seed gives the same
rows on any cluster and partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fillsight.operators.scan import MAX_GROUP_ROWS, join_counted, join_dimension, mark_first, numbered, plan_cells, scan, with_scalars
from fillsight.schema import MARKET, MICRO, ratio
from fillsight.session import materialize

KEYS = ["wallet", MARKET]
LABEL = "is_insider"
BUCKET_ROWS = 500_000


def hash_order(seed: int, *cols: str) -> Column:
    """60 bits of an md5 of (seed, columns) as a bigint; other engines compute the same."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


# ------------------------------------------------------------------------ joins

def strict_join(base: DataFrame, extra: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One-to-one left join on (lower(wallet), market) that refuses anything looser.

    Checks, each its own error: key columns present, requested columns present, no
    name collisions, unique keys on both sides, every base key matched.
    """
    for name, df in (("base", base), ("extra", extra)):
        missing = [k for k in keys if k not in df.columns]
        if missing:
            raise ValueError(f"{name} is missing key columns {missing}")
    absent = [c for c in columns if c not in extra.columns]
    if absent:
        raise ValueError(f"extra is missing columns {absent}")
    clash = [c for c in columns if c in base.columns]
    if clash:
        raise ValueError(f"columns already present in base: {clash}")
    left = base.withColumn("wallet", F.lower("wallet"))
    right = extra.withColumn("wallet", F.lower("wallet")).select(*keys, *columns)
    for name, df in (("base", left), ("extra", right)):
        if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"{name} keys are not unique")
    if not left.join(right, list(keys), "left_anti").isEmpty():
        raise ValueError("some base keys have no match")
    return left.join(right, list(keys), "left")


def with_labels(features: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Labelled feature rows (inner part of a left join; see :func:`unlabelled_count`)."""
    return features.join(labels.select(*keys, LABEL), list(keys), "left").filter(F.col(LABEL).isNotNull())


def unlabelled_count(features: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return features.join(labels.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias("dropped"))


def positives_presence(positives: DataFrame, traded: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positive pairs with whether they occur in the trades."""
    seen = traded.select(*keys).distinct().withColumn("present", F.lit(True))
    return positives.join(seen, list(keys), "left").withColumn("present", F.coalesce("present", F.lit(False)))


def exclude_wallets(df: DataFrame, known: DataFrame) -> DataFrame:
    return df.join(known.select("wallet").distinct(), "wallet", "left_anti")


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys (with multiplicity) of ``left`` that ``right`` lacks."""
    return left.select(*keys).exceptAll(right.select(*keys))


def union_ragged(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def stack_labelled(positive: DataFrame, negative: DataFrame, constants: dict[str, object] | None = None) -> DataFrame:
    """Positives and negatives with their label and constant columns; a pair in both is positive."""
    both = positive.withColumn(LABEL, F.lit(1)).unionByName(negative.withColumn(LABEL, F.lit(0)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in KEYS]
    best = F.max_by(F.struct(*rest), F.col(LABEL)).alias("r")
    out = both.groupBy(*KEYS).agg(best).select(*KEYS, "r.*")
    for name, value in (constants or {}).items():
        out = out.withColumn(name, F.lit(value))
    return out


# --------------------------------------------------------------------- sampling

def volume_floor(volumes: DataFrame, positives: DataFrame, q: float = 0.25) -> DataFrame:
    """Per market: number of positives that traded and the ``q`` quantile of their volume."""
    pos = volumes.join(positives.select(*KEYS).distinct(), KEYS, "left_semi")
    # positives are a hand-labelled list, so the exact aggregate stays small
    return pos.groupBy(MARKET).agg(
        F.count("*").alias("n_pos"), F.percentile(F.col("volume_micro") / MICRO, F.lit(q)).alias("volume_floor")
    )


def sample_negatives(
    volumes: DataFrame, positives: DataFrame, known: DataFrame, per_positive: int = 6, seed: int = 42, q: float = 0.25,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Negatives per market: wallets at or above the floor, never a known one, ``per_positive`` per positive.

    A market with too few candidates gives all of them.
    """
    floor = volume_floor(volumes, positives, q)
    floor = materialize(floor)
    pool = join_dimension(exclude_wallets(volumes, known), floor, MARKET, F.col("wallet"))
    pool = pool.filter(F.col("volume_micro") / MICRO >= F.col("volume_floor"))
    want = floor.select(MARKET, (per_positive * F.col("n_pos")).alias("_want"))
    drawn = mark_first(pool.select(*KEYS, hash_order(seed, MARKET, "wallet").alias("_h")), [MARKET], want, ["wallet"], max_rows=max_rows)
    return drawn.filter("_first").select(*KEYS, F.lit(0).alias(LABEL))


def labelled_set(volumes: DataFrame, positives: DataFrame, known: DataFrame, **kw) -> DataFrame:
    present = positives.select(*KEYS).distinct().join(volumes.select(*KEYS), KEYS, "left_semi")
    return present.withColumn(LABEL, F.lit(1)).unionByName(sample_negatives(volumes, positives, known, **kw))


def downsample_market(df: DataFrame, market: str, hide_positives: int, seed: int = 42, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Shrink one market by ``hide_positives`` positives, keeping its class ratio."""
    here = F.col(MARKET) == market
    counts = df.filter(here).agg(
        F.count_if(F.col(LABEL) == 1).alias("p"), F.count_if(F.col(LABEL) == 0).alias("n")
    )
    keep_p = F.col("p") - hide_positives
    keep_n = F.least(F.rint(keep_p * F.col("n") / F.greatest(F.col("p"), F.lit(1))).cast("bigint"), F.col("n"))
    too_few = F.raise_error(F.lit("hiding that many positives leaves none")).cast("bigint")
    sizes = counts.select(F.when(keep_p >= 1, keep_p).otherwise(too_few).alias("keep_p"), keep_n.alias("keep_n"))
    want = sizes.select(F.inline(F.array(
        F.struct(F.lit(1).alias(LABEL), F.col("keep_p").alias("_want")), F.struct(F.lit(0).alias(LABEL), F.col("keep_n").alias("_want")))))
    drawn = mark_first(df.filter(here).withColumn("_h", hash_order(seed, *KEYS)), [LABEL], want, ["wallet"], max_rows=max_rows)
    return df.filter(~here).unionByName(drawn.filter("_first").select(*df.columns))


def drop_markets(df: DataFrame, prefix: str) -> DataFrame:
    return df.filter(~F.col(MARKET).startswith(prefix))


# ----------------------------------------------------------------------- splits

def market_stats(df: DataFrame, time: str | None = None, large: int = 100) -> DataFrame:
    """Rows, positives, rate, size band and (optionally) median time of each market."""
    aggs = [F.count("*").alias("n_rows"), F.sum(F.col(LABEL)).alias("n_pos")]
    if time:
        aggs.append(F.median(time).alias("median_ts"))
    s = df.groupBy(MARKET).agg(*aggs)
    return s.withColumn("positive_rate", ratio(F.col("n_pos"), F.col("n_rows"))).withColumn(
        "size_band", F.when(F.col("n_rows") >= large, "large").otherwise("small")
    )


def require_markets(stats: DataFrame, wanted: Sequence[str]) -> None:
    """Fail when a pinned market is not in the data (``wanted`` is a short given list)."""
    have = {r[0] for r in stats.filter(F.col(MARKET).isin(*wanted)).select(MARKET).collect()}
    missing = sorted(set(wanted) - have)
    if missing:
        raise ValueError(f"pinned test markets not in data: {missing}")


def pinned_split(stats: DataFrame, test: Sequence[str]) -> DataFrame:
    return stats.withColumn("split", F.when(F.col(MARKET).isin(*test), "test").otherwise("train"))


def random_market_split(stats: DataFrame, n_large: int, n_small: int, seed: int = 42) -> DataFrame:
    """Whole markets to test: the given number of large and small ones, hash-drawn."""
    want = stats.select("size_band").distinct().withColumn("_want", F.when(F.col("size_band") == "large", n_large).otherwise(n_small).cast("bigint"))
    marked = mark_first(stats.withColumn("_h", hash_order(seed, MARKET)), ["size_band"], want, [MARKET])
    return marked.select(*stats.columns, F.when(F.col("_first"), "test").otherwise("train").alias("split"))


def time_split(stats: DataFrame, test: Sequence[str]) -> DataFrame:
    """Train before the oldest test market by median time; other and timeless markets validate."""
    cut = stats.filter(F.col(MARKET).isin(*test)).agg(
        F.min("median_ts").alias("_cut"), F.count_if(F.col("median_ts").isNull()).alias("_bad")
    )
    s = with_scalars(stats, cut)
    bad = F.raise_error(F.lit("test markets need a median time")).cast("string")
    split = (
        F.when(F.col("_bad") > 0, bad)
        .when(F.col(MARKET).isin(*test), "test")
        .when(F.col("median_ts") < F.col("_cut"), "train")
        .otherwise("val")
    )
    return s.withColumn("split", split).drop("_cut", "_bad")


def stratified_split(
    df: DataFrame, test_frac: float = 0.2, seed: int = 42, keys: Sequence[str] = KEYS, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Row split with the exact test share in each class, in hash order."""
    want = df.groupBy(LABEL).agg(F.round(F.count("*") * test_frac).cast("bigint").alias("_want"))
    marked = mark_first(df.withColumn("_h", hash_order(seed, *keys)), [LABEL], want, keys, max_rows=max_rows)
    return marked.select(*df.columns, F.when(F.col("_first"), "test").otherwise("train").alias("split"))


def group_split(df: DataFrame, test_frac: float = 0.15, seed: int = 42, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Whole markets to test by hash; the share holds for markets, not rows."""
    rows = df.groupBy(MARKET).agg(F.count("*").alias("n"))
    markets = rows.select(MARKET, F.lit(0).alias("_all"), hash_order(seed, MARKET).alias("_h"))
    want = markets.groupBy("_all").agg(F.ceil(F.count("*") * test_frac).alias("_want"))
    marked = mark_first(markets.withColumnRenamed("_all", "_g"), ["_g"], want.withColumnRenamed("_all", "_g"), [MARKET], max_rows=max_rows)
    split = marked.select(MARKET, F.when(F.col("_first"), "test").otherwise("train").alias("split"))
    return _onto_markets(df, split, rows)


def _onto_markets(df: DataFrame, marked: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` with the columns its market has in ``marked``; ``rows`` counts ``df`` by market."""
    return join_counted(df, marked, [MARKET], rows.select(MARKET, "n"), F.col("wallet"))


# ------------------------------------------------------------------------ folds

def group_folds(df: DataFrame, k: int = 5, stratified: bool = True, seed: int = 42) -> DataFrame:
    """Fold column with whole markets per fold.

    Markets are dealt in snake order of (positives, rows) or rows alone, so folds
    come out balanced; one row per market is ordered, never the dataset.
    """
    s = market_stats(df).select(MARKET, "n_rows", "n_pos")
    keys = [F.col("n_pos").desc(), F.col("n_rows").desc()] if stratified else [F.col("n_rows").desc()]
    s = numbered(s, [*keys, hash_order(seed, MARKET), F.col(MARKET)])
    step = F.pmod("_rn", F.lit(k))
    fold = F.when(F.pmod(F.floor(F.col("_rn") / k), F.lit(2)) == 0, step).otherwise(k - 1 - step)
    return _onto_markets(df, s.select(MARKET, fold.cast("int").alias("fold")), s.select(MARKET, F.col("n_rows").alias("n")))


def time_folds(df: DataFrame, time: str, k: int = 5) -> DataFrame:
    """Expanding-window folds over markets ordered by median time.

    ``fold`` is the validation fold of a market (0 = training only); fold i trains on
    all markets of lower fold. Test size is ⌊n / (k + 1)⌋ markets.
    """
    s = df.groupBy(MARKET).agg(F.median(time).alias("_t"), F.count("*").alias("n"))
    s = numbered(s, [F.col("_t").asc_nulls_last(), F.col(MARKET)])
    s = with_scalars(s, s.agg(F.count("*").alias("_n")))
    size = F.floor(F.col("_n") / (k + 1))
    first = F.col("_n") - k * size
    fold = F.when(F.col("_rn") < first, 0).otherwise(F.floor((F.col("_rn") - first) / size) + 1)
    return _onto_markets(df, s.select(MARKET, fold.cast("int").alias("fold")), s)


def row_folds(df: DataFrame, k: int = 5, seed: int = 42, stratified: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """Row-level folds; stratified ones deal every class round robin inside hash buckets.

    There are 256 buckets, and more where those would hold over ``BUCKET_ROWS`` rows.
    """
    if not stratified:
        return df.withColumn("fold", F.pmod(hash_order(seed, *keys), F.lit(k)).cast("int"))
    h = hash_order(seed, *keys)
    buckets = 256
    while buckets * BUCKET_ROWS < df.count():
        buckets *= 2
    b = F.pmod(h, F.lit(buckets))
    w = W.partitionBy(LABEL, b).orderBy(h, *keys)
    # the bucket offsets the deal so that small buckets do not all start at fold 0
    return df.withColumn("fold", F.pmod(F.row_number().over(w) - 1 + b, F.lit(k)).cast("int"))


def loo_folds(df: DataFrame, keys: Sequence[str] = KEYS, seed: int = 42, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """One fold per row, numbered by a split scan along a hash of the keys."""
    d = df.withColumn("_all", F.lit(0)).withColumn("_h", F.pmod(hash_order(seed, *keys), F.lit(2**40)))
    cells = plan_cells(d, ["_all"], "_h", (2**30, 2**20, 2**10, 1), max_rows=max_rows)
    d = scan(cells.label(d, "_h"), ["_all"], ["_h", *keys], running={"fold": ("count", F.lit(1))}, cells=cells)
    return d.select(*df.columns, (F.col("fold") - 1).alias("fold"))


def fold_breakdown(df: DataFrame) -> DataFrame:
    """Markets, rows and positives of each fold; its markets are counted and listed by name."""
    # rows are counted per market first, so the list takes each market once and the shuffle one row of it
    return fold_markets(df).groupBy("fold").agg(
        F.count(MARKET).alias("n_markets"), F.sum("n_rows").alias("n_rows"), F.sum("n_pos").alias("n_pos"),
        F.array_join(F.sort_array(F.collect_list(MARKET)), ",").alias("markets"),
    ).withColumn("positive_rate", ratio(F.col("n_pos"), F.col("n_rows")))


def fold_markets(df: DataFrame) -> DataFrame:
    """The markets of each fold with their rows and positives, one row each."""
    return df.groupBy("fold", MARKET).agg(F.count("*").alias("n_rows"), F.sum(LABEL).alias("n_pos"))


# --------------------------------------------------------------------- profiles

def melt(df: DataFrame, columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Long form (ids, feature, value)."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), list(columns), "feature", "value")


def separability(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean by label, ratio and non-null share per feature; one row, then turned long."""
    n = F.count("*")
    per = [
        F.struct(
            F.lit(c).alias("feature"), F.avg(F.when(F.col(LABEL) == 1, F.col(c))).alias("positive_mean"),
            F.avg(F.when(F.col(LABEL) == 0, F.col(c))).alias("negative_mean"), ratio(F.count(c), n).alias("coverage"),
        ).alias(f"s{i}")
        for i, c in enumerate(columns)
    ]
    one = df.agg(*per)
    out = one.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))
    return out.withColumn("ratio", ratio(F.col("positive_mean"), F.col("negative_mean")))


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of NULLs per column, largest first."""
    n = F.count("*")
    one = df.agg(*[F.struct(F.lit(c).alias("feature"), ratio(n - F.count(c), n).alias("null_frac")).alias(f"s{i}") for i, c in enumerate(columns)])
    return one.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))]))).orderBy(
        F.col("null_frac").desc(), "feature"
    )


AVAILABILITY = {
    "has_buy": ("buy_markout", "low_buy"),
    "has_sell": ("sell_markout", "high_sell"),
    "has_adaptive_features": ("adaptive_", "realized_edge", "realized_raw_pnl", "derisk_", "terminal_"),
}
AVAILABILITY_SINGLE = {
    "has_realized_match": "realized_pnl_per_matched_token",
    "has_open_inventory": "unrealized_edge_per_open_token",
    "has_position_path": "path_alignment",
    "has_any_trade": "active_day_frac",
}


def impute_with_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Seven availability flags, then zero for NULL; absent columns count as NULL."""
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    flags = []
    for name, prefixes in AVAILABILITY.items():
        group = [c for c in columns if c.startswith(prefixes)]
        any_ = F.coalesce(*[F.col(c).cast("double") for c in group]).isNotNull().cast("int") if group else F.lit(0)
        flags.append(any_.alias(name))
    for name, c in AVAILABILITY_SINGLE.items():
        flags.append((F.col(c).isNotNull().cast("int") if c in df.columns else F.lit(0)).alias(name))
    return df.select("*", *flags).fillna(0.0, list(columns))


def model_matrix(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = KEYS) -> DataFrame:
    """Columns in exact model order; absent ones are NULL."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(c).cast("double") if c in have else F.lit(None).cast("double")).alias(c) for c in columns])


def feature_sets(sets: DataFrame, behavior: Sequence[str], metadata: Sequence[str]) -> DataFrame:
    """Union of the feature lists of many models, divided into behavioural and metadata names.

    ``sets`` holds one array column ``features`` per model.
    """
    u = sets.select(F.explode("features").alias("feature")).distinct()
    kind = F.when(F.col("feature").isin(*behavior), "behavior").when(F.col("feature").isin(*metadata), "metadata").otherwise("unknown")
    return u.select("feature", kind.alias("kind"))


def cluster_profile(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size, positives, rate and lift per cluster, share of all positives, and the purest one.

    Cluster -1 is noise and never the purest.
    """
    g = df.groupBy(cluster).agg(F.count("*").alias("size"), F.sum(LABEL).alias("positives"))
    # a handful of clusters from here on
    w = W.partitionBy()
    rate = ratio(F.col("positives"), F.col("size"))
    g = g.withColumn("rate", rate).withColumn("base_rate", ratio(F.sum("positives").over(w), F.sum("size").over(w)))
    best = F.max_by(F.col(cluster), F.when(F.col(cluster) != -1, F.struct(F.col("rate"), -F.col(cluster)))).over(w)
    return g.select(
        cluster, "size", "positives", "rate", F.coalesce(ratio(F.col("rate"), F.col("base_rate")), F.lit(0.0)).alias("lift"),
        ratio(F.col("positives"), F.sum("positives").over(w)).alias("captured"), (F.col(cluster) == best).alias("purest"),
    )
