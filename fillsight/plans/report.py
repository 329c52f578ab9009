"""Rankings, model comparison, audits and plot-ready tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from fillsight.functions.scalar import marker_size
from fillsight.ml.metrics import auc_and_ap
from fillsight.operators.history import map_trades_to_history
from fillsight.operators.parsing import in_time_range
from fillsight.operators.scan import Cells, numbered, with_scalars
from fillsight.schema import MARKET, ratio


# --------------------------------------------------------------------- rankings

def rank_scores(df: DataFrame, start: int = 1, end: int = 100, score: str = "pred_prob", tie: str = "wallet") -> DataFrame:
    """Ranks ``start`` to ``end`` by score.

    The slice is cut by a distributed top-k first; only those rows are numbered.
    """
    order = [F.col(score).desc(), F.col(tie)]
    top = df.orderBy(*order).limit(end)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order))).filter(F.col("rank") >= start)


def top_features(importances: DataFrame, k: int, by: Sequence[str] = (), value: str = "contribution") -> DataFrame:
    """The k features of largest absolute value per entity."""
    size = F.abs(F.col(value))
    if not by:
        return importances.orderBy(size.desc(), "feature").limit(k)
    w = W.partitionBy(*by).orderBy(size.desc(), F.col("feature"))
    return importances.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_feature_text(attributions: DataFrame, by: Sequence[str], k: int = 6) -> DataFrame:
    """The k strongest contributions of each entity as one line of text."""
    t = top_features(attributions, k, by)
    item = F.struct("rank", F.concat("feature", F.lit("("), F.format_string("%+.3f", F.col("contribution")), F.lit(")")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"])  # k entries per entity
    return t.groupBy(*by).agg(F.array_join(ordered, "; ").alias("top_features"))


# ------------------------------------------------------------- model comparison

def latest_artifacts(files: DataFrame, skip: Sequence[str] = (), extra: DataFrame | None = None) -> DataFrame:
    """Newest artifact per tag without the skipped tags; ``extra`` fills tags that have none."""
    new = lambda d: d.groupBy("tag").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"), F.max("mtime").alias("mtime"))
    main = new(files.filter(~F.col("tag").isin(*skip)) if skip else files)
    if extra is None:
        return main
    return main.unionByName(new(extra).join(main.select("tag"), "tag", "left_anti"))


def with_recomputed_roc(models: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Replace PR columns by recomputed ROC; models without one lose their CV value."""
    r = recomputed.select("tag", F.col("roc_mean").alias("_m"), F.col("roc_std").alias("_s"))
    j = models.join(r, "tag", "left")
    return j.withColumn("cv_pr", F.col("_m")).withColumn("cv_std", F.col("_s")).withColumn("test_pr", F.col("test_roc")).drop("_m", "_s")


def rank_models(models: DataFrame) -> DataFrame:
    """By CV value, models without one last."""
    return numbered(models, [F.col("cv_pr").desc_nulls_last(), F.col("tag")], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def recommend(models: DataFrame, strong_test: float = 0.95, cv_margin: float = 0.05) -> DataFrame:
    """Best by CV, best by test, and the smallest model that is good by each."""
    c = F.col
    cv, test, nf = c("cv_pr"), c("test_pr"), c("n_features")
    best = models.agg(F.max("cv_pr").alias("_best_cv"))
    m = with_scalars(models, best)
    # ties go to the first tag, so tags rank in reverse inside max_by
    good_test = (test >= strong_test) & nf.isNotNull()
    good_cv = (cv >= c("_best_cv") - cv_margin) & nf.isNotNull()
    pick = m.agg(
        F.min_by("tag", F.when(cv.isNotNull(), F.struct(-cv, c("tag")))).alias("best_cv"),
        F.min_by("tag", F.when(test.isNotNull(), F.struct(-test, c("tag")))).alias("best_test"),
        F.min_by("tag", F.when(good_test, F.struct(nf, -test, c("tag")))).alias("_st"),
        F.min_by("tag", F.when(good_cv, F.struct(nf, -cv, c("tag")))).alias("_sc"),
    )
    return pick.select(
        "best_cv", "best_test", F.coalesce("_st", "best_test").alias("simple_test"), F.coalesce("_sc", "best_cv").alias("simple_cv")
    )


def leanest_strong(models: DataFrame, cv_margin: float = 0.05) -> DataFrame:
    """Fewest parameters within ``cv_margin`` of the best CV value."""
    m = models.filter(F.col("cv_pr").isNotNull() & F.col("n_params").isNotNull())
    best = m.agg(F.max("cv_pr").alias("_b"))
    strong = with_scalars(m, best).filter(F.col("cv_pr") >= F.col("_b") - cv_margin)
    return strong.agg(F.min_by(F.struct("tag", "n_params", "cv_pr"), F.struct(F.col("n_params"), -F.col("cv_pr"), F.col("tag"))).alias("m")).select("m.*")


def cv_against_test(models: DataFrame) -> DataFrame:
    """Models with both values; cv_optimistic where test falls below CV."""
    return models.filter(F.col("cv_pr").isNotNull() & F.col("test_pr").isNotNull()).select(
        "tag", "cv_pr", "test_pr", (F.col("test_pr") - F.col("cv_pr")).alias("gap"), (F.col("test_pr") < F.col("cv_pr")).alias("cv_optimistic")
    )


def coefficient_stability(coefs: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Spread of each coefficient over folds."""
    c = F.col("coef")
    return coefs.groupBy("feature").agg(
        F.avg(c).alias("mean_coef"), F.median(c).alias("median_coef"), F.stddev_samp(c).alias("std_coef"),
        F.avg(F.abs(c)).alias("mean_abs_coef"), F.median(F.abs(c)).alias("median_abs_coef"),
        F.avg((F.abs(c) > tol).cast("double")).alias("nonzero_frac"), F.avg((c > tol).cast("double")).alias("positive_frac"),
        F.avg((c < -tol).cast("double")).alias("negative_frac"),
    )


# ---------------------------------------------------------------- explanations

def linear_contributions(long: DataFrame, coefs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """value * coefficient for every entity and feature of a long feature table."""
    return long.join(coefs, "feature").select(
        *ids, "feature", "value", "coef", (F.coalesce("value", F.lit(0.0)) * F.col("coef")).alias("contribution")
    )


def linear_scores(contributions: DataFrame, intercept: float, ids: Sequence[str]) -> DataFrame:
    z = F.lit(intercept) + F.sum("contribution")
    return contributions.groupBy(*ids).agg(z.alias("logit")).withColumn("prob", 1 / (1 + F.exp(-F.col("logit"))))


def misclassified(scored: DataFrame, threshold: float = 0.5, prob: str = "prob", label: str = "is_insider") -> DataFrame:
    """Rows on the wrong side of the threshold, lowest probability first."""
    pred = (F.col(prob) >= threshold).cast("int")
    return scored.withColumn("pred_label", pred).filter(F.col("pred_label") != F.col(label)).orderBy(prob)


def error_drivers(contributions: DataFrame, wrong: DataFrame, ids: Sequence[str], k: int = 5, label: str = "is_insider") -> DataFrame:
    """Features that pushed a wrong row the wrong way: upward for false positives, downward for misses."""
    j = contributions.join(wrong.select(*ids, label, "pred_label"), list(ids))
    push = F.when(F.col(label) == 0, F.col("contribution")).otherwise(-F.col("contribution"))
    w = W.partitionBy(*ids).orderBy(push.desc(), F.col("feature"))
    return j.withColumn("driver_rank", F.row_number().over(w)).filter(F.col("driver_rank") <= k)


def importance_attribution(long: DataFrame, importances: DataFrame, ids: Sequence[str], k: int = 10) -> DataFrame:
    """Global importances standing in for contributions where a model has no local form."""
    a = long.join(importances.select("feature", F.col("importance").alias("contribution")), "feature")
    return top_features(a, k, ids)


def attribution_matrix(attributions: DataFrame, models: Sequence[str], q: float = 0.98) -> DataFrame:
    """Features by models, with the shared colour scale (a high percentile of absolute values)."""
    a = attributions.filter(F.col("model").isin(*models))
    scale = a.agg(F.percentile(F.abs("contribution"), F.lit(q)).alias("scale"))
    wide = a.groupBy("feature").pivot("model", list(models)).agg(F.sum("contribution"))
    return with_scalars(wide, scale)


# --------------------------------------------------------------------- ensembles

def ensemble_scores(scores: DataFrame, weights: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Weighted mean of model scores per entity and ensemble.

    scores: ids, model, score; weights: ensemble, model, weight.
    """
    w = weights.select("ensemble", "model", "weight")
    return scores.join(w, "model").groupBy("ensemble", *ids).agg(
        ratio(F.sum(F.col("weight") * F.col("score")), F.sum("weight")).alias("score")
    )


def ensemble_weights(models: DataFrame) -> DataFrame:
    """Weights of the three ensembles: equal over supervised models, equal over all, by PR-AUC over all.

    models: model, supervised, pr_auc.
    """
    kinds = F.array(
        F.struct(F.lit("equal_supervised").alias("ensemble"), F.when(F.col("supervised"), 1.0).alias("weight")),
        F.struct(F.lit("equal_all").alias("ensemble"), F.lit(1.0).alias("weight")),
        F.struct(F.lit("prauc_weighted").alias("ensemble"), F.col("pr_auc").alias("weight")),
    )
    return models.select("model", F.inline(kinds)).filter(F.col("weight").isNotNull())


def best_ensemble(scored: DataFrame) -> DataFrame:
    """Quality of each ensemble (ensemble, score, label) and which one has the highest PR-AUC.

    The name decides between equals. Scores are compared at nine decimals, so that sums in
    another order make no new ranks.
    """
    q = auc_and_ap(scored.withColumn("score", F.round("score", 9)), "score", "label", ["ensemble"])
    top = q.select(F.max_by("ensemble", F.struct("pr_auc", "ensemble")).alias("best"))
    return with_scalars(q, top).withColumn("is_best", F.col("ensemble") == F.col("best")).drop("best")


def flag_counts(results: DataFrame, ids: Sequence[str]) -> DataFrame:
    """How many of the models flag each entity."""
    return results.groupBy(*ids).agg(F.count_if("flagged").alias("n_flagged"), F.count("*").alias("n_models"))


def flag_scores(scored: DataFrame, threshold: float, score: str = "pred_prob") -> DataFrame:
    return scored.withColumn("flagged", F.col(score) >= threshold)


def scan_summary(flagged: DataFrame) -> DataFrame:
    """Wallets scored and flagged per market, with the highest score."""
    return flagged.groupBy(MARKET).agg(
        F.count("*").alias("scored"), F.count_if("flagged").alias("n_flagged"), F.max("pred_prob").alias("max_prob")
    )


# -------------------------------------------------------------------- plot data

def plot_trades(trades: DataFrame, history: DataFrame, ranked: DataFrame | None = None, tolerance: int | None = None, cells: Cells | None = None) -> DataFrame:
    """Trades on the price curve with marker size, for ranked wallets if given."""
    t = trades if ranked is None else trades.join(ranked.select("wallet", MARKET, "rank"), ["wallet", MARKET])
    mapped = map_trades_to_history(t, history, tolerance, cells)
    return mapped.withColumn("marker_size", marker_size(F.col("token_amount")))


def plot_window(history: DataFrame, mapped: DataFrame | None, start: int | None = None, end: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The curve and the trades on it from ``start`` to ``end``, both inclusive; a bound that is None is open."""
    return in_time_range(history, start, end), None if mapped is None else in_time_range(mapped, start, end)


def y_limits(history: DataFrame, mapped: DataFrame, pad: float = 0.05, by: Sequence[str] = (MARKET,)) -> DataFrame:
    """Padded price limits over the curve and the trades."""
    prices = history.select(*by, F.col("yes_price").alias("p")).unionByName(mapped.select(*by, F.col("history_yes_price").alias("p")))
    g = prices.groupBy(*by).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    m = F.when(flat, F.greatest(F.lit(0.01), F.abs("lo") * pad)).otherwise((F.col("hi") - F.col("lo")) * pad)
    return g.select(*by, (F.col("lo") - m).alias("y_min"), (F.col("hi") + m).alias("y_max"))


def first_trades(trades: DataFrame, keys: Sequence[str] = ("wallet", MARKET)) -> DataFrame:
    """First trade of each wallet and market (the entry marker)."""
    rest = [c for c in trades.columns if c not in keys]
    return trades.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("ts", "trade_id", "role")).alias("f")).select(*keys, "f.*")
