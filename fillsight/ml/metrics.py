"""Exact ranking metrics from one cumulative pass over distinct scores.

Rows are first counted per (group, score). The curve is then a descending scan with
one row per distinct score, split along the score axis when a group is too large, so
even a single group with every row never passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fillsight.operators.scan import MAX_GROUP_ROWS, PRICE_WIDTHS, plan_cells, scan, with_scalars
from fillsight.schema import ratio

ALL = "_all"


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(ALL, F.lit(0)), [ALL])


def ranking_curve(
    df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """One row per distinct score (a tie block is one cut): cumulative counts, precision, recall."""
    df, keys = _grouped(df, by)
    points = df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    cells = plan_cells(points, keys, "score", PRICE_WIDTHS, max_rows=max_rows)
    run = scan(
        cells.label(points, "score"), keys, ["score"],
        running={"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, cells=cells, descending=True,
    )
    sums = [F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")]
    # without groups the totals are one row; a join on a constant key would pair all rows
    out = run.join(points.groupBy(*keys).agg(*sums), keys) if by else with_scalars(run, points.agg(*sums))
    return out.select(
        *(keys if by else []), "score", "pos", "neg", "tp", "fp", "n_pos", "n_neg",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
        ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
    )


def auc_and_ap(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), **kw) -> DataFrame:
    """ROC-AUC with ties counted half, and average precision; NULL with one class only."""
    c, keys = _grouped(ranking_curve(df, score, label, by, **kw), by)
    # pairs of a positive ranked above a negative, doubled to stay in integers
    pairs = F.sum((F.col("neg") * (2 * (F.col("tp") - F.col("pos")) + F.col("pos"))).cast("decimal(38,0)"))
    both = (F.max("n_pos") > 0) & (F.max("n_neg") > 0)
    n = F.max("n_pos").cast("double") * F.max("n_neg").cast("double")
    out = c.groupBy(*keys).agg(
        (F.max("n_pos") + F.max("n_neg")).alias("n"), F.max("n_pos").alias("n_positives"),
        F.when(both, ratio(pairs, 2 * n)).alias("roc_auc"),
        F.when(both, F.sum(F.col("pos") * F.col("precision")) / F.max("n_pos")).alias("pr_auc"),
    )
    return out if by else out.drop(ALL)


def confusion(df: DataFrame, threshold: float | Column, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall and F1 at a threshold."""
    df, keys = _grouped(df, by)
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, pos = F.col(score) >= thr, F.col(label) == 1
    g = df.groupBy(*keys).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"),
    )
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    out = g.select("*", p.alias("precision"), r.alias("recall")).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    )
    return out if by else out.drop(ALL)


def class_report(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support per class."""
    c = confusion(df, threshold, score, label)
    rows = F.array(
        F.struct(F.lit(1).alias("class"), F.col("tp").alias("hit"), F.col("fp").alias("wrong"), F.col("fn").alias("missed")),
        F.struct(F.lit(0).alias("class"), F.col("tn").alias("hit"), F.col("fn").alias("wrong"), F.col("fp").alias("missed")),
    )
    x = c.select(F.inline(rows))
    p = F.col("hit") / F.greatest(F.col("hit") + F.col("wrong"), F.lit(1))
    r = F.col("hit") / F.greatest(F.col("hit") + F.col("missed"), F.lit(1))
    return x.select(
        "class", p.alias("precision"), r.alias("recall"), (F.col("hit") + F.col("missed")).alias("support")
    ).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))


def tune_threshold(
    df: DataFrame, target: float = 0.8, objective: str = "precision", score: str = "score", label: str = "label",
    by: Sequence[str] = (), **kw,
) -> DataFrame:
    """Cut that is best on one measure while the other stays at or above ``target``.

    ``precision``: most recall with precision >= target; ``recall``: most precision
    with recall >= target. When no cut reaches the target, the best one on the
    constrained measure, with reached = false. No positives: ok = false.
    """
    c, keys = _grouped(ranking_curve(df, score, label, by, **kw), by)
    p, r = F.col("precision"), F.col("recall")
    cut = F.struct(F.col("score").alias("threshold"), p.alias("precision"), r.alias("recall"), (F.col("tp") + F.col("fp")).alias("n_pred_pos"))
    if objective == "precision":
        meets, order, fallback = p >= target, F.struct(r, F.col("score")), F.struct(p, r, F.col("score"))
    elif objective == "recall":
        meets, order, fallback = r >= target, F.struct(p, r, F.col("score")), F.struct(r, p, F.col("score"))
    else:
        raise ValueError("objective must be 'precision' or 'recall'")
    g = c.groupBy(*keys).agg(
        F.max_by(cut, F.when(meets, order)).alias("met"), F.max_by(cut, fallback).alias("fb"),
        F.max("n_pos").alias("n_pos"), (F.max("n_pos") + F.max("n_neg")).alias("n_test"),
    )
    best = F.coalesce("met", "fb")
    ok = F.col("n_pos") > 0
    out = g.select(
        *keys, ok.alias("ok"), *[F.when(ok, best[f]).alias(f) for f in ("threshold", "precision", "recall", "n_pred_pos")],
        "n_test", "n_pos", F.when(ok, F.col("met").isNotNull()).alias("reached"),
    )
    return out if by else out.drop(ALL)


def cumulative_hits(df: DataFrame, score: str = "score", label: str = "label", tie: str = "doc_id", max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Row-wise ranking with cumulative hits; equal scores ordered by ``tie``."""
    d = df.withColumn(ALL, F.lit(0)).withColumn("_neg", -F.col(score))
    cells = plan_cells(d, [ALL], "_neg", PRICE_WIDTHS, max_rows=max_rows)
    r = scan(
        cells.label(d, "_neg"), [ALL], ["_neg", tie],
        running={
            "rank": ("count", F.lit(1)), "tp": ("sum", (F.col(label) == 1).cast("bigint")),
            "fp": ("sum", (F.col(label) != 1).cast("bigint")),
        },
        cells=cells,
    )
    n = df.agg(F.count_if(F.col(label) == 1).alias("_p"))
    return with_scalars(r, n).select(
        *df.columns, "rank", "tp", "fp", (F.col("tp") / F.col("rank")).alias("precision"),
        (F.col("tp") / F.greatest(F.col("_p"), F.lit(1))).alias("recall"),
    )


def curve_points(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), **kw) -> DataFrame:
    """ROC and precision-recall points per distinct score, plus the chance rate."""
    c = ranking_curve(df, score, label, by, **kw)
    return c.select(
        *by, "score", "fpr", F.col("recall").alias("tpr"), "precision", "recall",
        ratio(F.col("n_pos"), F.col("n_pos") + F.col("n_neg")).alias("chance"),
    )


def score_histogram(df: DataFrame, score: str = "score", label: str = "label", bins: int = 40) -> DataFrame:
    """Density histogram by label over equal bins of [min, max] (the last bin includes max)."""
    span = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    d = with_scalars(df, span)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(score) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    g = d.groupBy(label, b.alias("bin"), "_lo", width.alias("_w")).agg(F.count("*").alias("n"))
    n = F.sum("n").over(W.partitionBy(label))  # at most `bins` rows per label
    return g.select(
        label, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"), "n", (F.col("n") / n / F.col("_w")).alias("density")
    )


def cv_summary(folds: DataFrame, value: str = "pr_auc", by: Sequence[str] = ("tag",)) -> DataFrame:
    """Mean and population deviation over folds with a value."""
    return folds.groupBy(*by).agg(
        F.avg(value).alias("cv_mean"), F.stddev_pop(value).alias("cv_std"), F.count(value).alias("n_folds")
    )


def reproduction_error(ours: DataFrame, stored: DataFrame, value: str = "pr_auc", by: Sequence[str] = ("tag",)) -> DataFrame:
    """Largest difference between the sorted fold values of two runs; 0 where fold counts differ.

    Fold lists hold a handful of values per model.
    """
    pack = lambda df, name: df.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias(name))
    j = pack(ours, "a").join(pack(stored, "b"), list(by), "left")
    diff = F.array_max(F.transform(F.arrays_zip("a", "b"), lambda z: F.abs(z["a"] - z["b"])))
    same = F.col("b").isNotNull() & (F.size("a") == F.size("b"))
    return j.select(*by, F.when(same, diff).otherwise(F.lit(0.0)).alias("max_abs_diff"))
