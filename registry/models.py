"""Registered queries on metadata, datasets, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillsight import fixtures as X
from fillsight.functions import scalar as S
from fillsight.ml import metrics as M
from fillsight.operators import dataset as D, parsing as P
from fillsight.plans import metadata as PM, report as R
from fillsight.schema import MARKET, MICRO
from registry.core import context, query, r
from registry.trades import labelled, labels


# --------------------------------------------------------------------- metadata

def _pairs(spark, sf):
    """Every (wallet, market) of the activity plus pairs that never traded there."""
    a = X.activity(spark, sf)
    real = a.select("wallet", F.col("slug").alias(MARKET)).distinct()
    ghost = real.filter(F.col(MARKET) == "m0").select("wallet", F.lit("m-unknown").alias(MARKET))
    return real.unionByName(ghost)


@query
def metadata_features(spark, sf):
    m = PM.metadata_features(
        _pairs(spark, sf), X.activity(spark, sf), X.markets(spark, sf), deposits(spark, sf), X.transfers(spark, sf),
        X.flagged(spark, sf), cap=1000,
    )
    return r(m)


def deposits(spark, sf):
    from fillsight.sources.wallets import first_deposits

    return first_deposits(X.incoming(spark, sf))


@query
def wallet_market_pnl(spark, sf):
    return r(PM.market_pnl(X.activity(spark, sf)))


@query
def first_trade_times(spark, sf):
    return PM.first_trades(context(spark, sf).trades)


@query
def funder_siblings(spark, sf):
    """Recipients of each funder up to given times; some funders have more than the cap."""
    t = X.transfers(spark, sf)
    points = t.select(F.col("from").alias("funder"), (F.col("ts") + 86_400).alias("as_of_ts")).distinct()
    tl = PM.funder_timeline(t, X.flagged(spark, sf), cap=60)
    return PM.siblings_asof(points, tl)


@query
def wallet_timeline(spark, sf):
    t = PM.wallet_timeline(X.activity(spark, sf))
    return t.select("wallet", "ts", "n_trade_markets", "n_markets", "n_winning", "vol", "pnl")


@query
def wallet_bet_sizes(spark, sf):
    return r(PM.wallet_sizes(X.activity(spark, sf)))


# --------------------------------------------------------------------- datasets

def positives(spark, sf):
    return labels(spark, sf).filter("is_insider = 1").select("wallet", MARKET)


@query
def strict_join(spark, sf):
    base = context(spark, sf).family("days").select("wallet", MARKET, "active_day_frac")
    extra = context(spark, sf).family("holding").select(F.upper("wallet").alias("wallet"), MARKET, "net_tokens")
    return r(D.strict_join(base, extra, ["net_tokens"]))


@query
def labelled_features(spark, sf):
    return r(labelled(spark, sf).select("wallet", MARKET, "active_day_frac", "is_insider"))


@query
def unlabelled_count(spark, sf):
    return D.unlabelled_count(context(spark, sf).family("days"), labels(spark, sf))


@query
def positive_presence(spark, sf):
    extra = X.flagged(spark, sf).select("wallet", F.lit("m-unknown").alias(MARKET))
    return D.positives_presence(positives(spark, sf).unionByName(extra), context(spark, sf).trades)


@query
def known_wallet_exclusion(spark, sf):
    v = P.cash_volume(context(spark, sf).trades).select("wallet", MARKET, "volume_micro")
    return D.exclude_wallets(v, positives(spark, sf))


@query
def unmatched_keys(spark, sf):
    return D.unmatched_keys(context(spark, sf).family("days"), labels(spark, sf))


@query
def ragged_union(spark, sf):
    d = context(spark, sf).family("days")
    a = d.select("wallet", MARKET, "n_distinct_active_days")
    b = d.select("wallet", MARKET, "n_distinct_buy_days")
    return D.union_ragged(a, b)


@query
def stacked_labels(spark, sf):
    d = context(spark, sf).family("days").select("wallet", MARKET, "n_distinct_active_days")
    return D.stack_labelled(d.join(X.flagged(spark, sf), "wallet", "left_semi"), d, {"origin": "scan"})


@query
def volume_floor(spark, sf):
    return r(D.volume_floor(P.cash_volume(context(spark, sf).trades), positives(spark, sf)))


@query
def negative_sample(spark, sf):
    """Positives and the hash-ordered draw of negatives per market."""
    t = context(spark, sf).trades
    return D.labelled_set(P.cash_volume(t), positives(spark, sf), positives(spark, sf), per_positive=2)


@query
def downsampled_market(spark, sf):
    """Rows left of one market by a hash-ordered draw, and all others."""
    return D.downsample_market(labels(spark, sf), "m1", 3).select("wallet", MARKET, "is_insider")


@query
def markets_without_prefix(spark, sf):
    return D.drop_markets(labels(spark, sf), "m1").select("wallet", MARKET, "is_insider")


def _timed(spark, sf):
    first = PM.first_trades(context(spark, sf).trades)
    return labels(spark, sf).join(first, ["wallet", MARKET]).withColumn("t", F.when(F.col(MARKET) != "m2", F.col("as_of_ts")))


@query
def market_stats(spark, sf):
    return r(D.market_stats(_timed(spark, sf), "t", 12))


@query
def pinned_split(spark, sf):
    return D.pinned_split(D.market_stats(labels(spark, sf)), ["m2", "m5"]).select(MARKET, "n_rows", "n_pos", "split")


@query
def time_split(spark, sf):
    return r(D.time_split(D.market_stats(_timed(spark, sf), "t"), ["m5", "m6"]).select(MARKET, "median_ts", "split"))


@query
def random_market_split(spark, sf):
    return D.random_market_split(D.market_stats(labels(spark, sf), large=10), 1, 1).select(MARKET, "n_rows", "size_band", "split")


@query
def stratified_rows(spark, sf):
    return D.stratified_split(labels(spark, sf)).select("wallet", MARKET, "is_insider", "split")


@query
def grouped_rows(spark, sf):
    return D.group_split(labels(spark, sf)).select("wallet", MARKET, "is_insider", "split")


@query
def group_folds(spark, sf):
    return D.group_folds(labels(spark, sf), 4)


@query
def time_folds(spark, sf):
    return D.time_folds(_timed(spark, sf), "t", 3).select("wallet", MARKET, "is_insider", "fold")


@query
def row_folds(spark, sf):
    return D.row_folds(labels(spark, sf)).select("fold", "is_insider", "wallet", MARKET)


@query
def leave_one_out_folds(spark, sf):
    return D.loo_folds(labels(spark, sf)).select("wallet", MARKET, "is_insider", "fold")


@query
def fold_breakdown(spark, sf):
    by_market = labels(spark, sf).withColumn("fold", (F.substring(MARKET, 2, 1).cast("int") % 3))
    return r(D.fold_breakdown(by_market))


@query
def fold_markets(spark, sf):
    return D.fold_markets(D.row_folds(labels(spark, sf)))


DAY_COLUMNS = ["n_distinct_buy_days", "n_distinct_sell_days", "buy_day_concentration_hhi", "sell_day_concentration_hhi", "active_day_frac"]


@query
def separability(spark, sf):
    return r(D.separability(labelled(spark, sf), DAY_COLUMNS))


@query
def separability_report(spark, sf):
    """Display form of the group means."""
    s = D.separability(labelled(spark, sf), DAY_COLUMNS)
    return s.select(
        "feature", S.format_unit(F.round("positive_mean", 6), "plain").alias("positive"), S.ratio_label(F.round("positive_mean", 9), F.round("negative_mean", 9)).alias("ratio"),
        S.format_unit(F.col("coverage"), "share").alias("coverage"),
    )


@query
def missingness(spark, sf):
    return r(D.missingness(context(spark, sf).family("fixed"), [f"{s}_markout_mean_{h}s" for s in ("buy", "sell") for h in (300, 3600)]))


@query
def availability_flags(spark, sf):
    c = context(spark, sf)
    df = c.features(["buy_markout_mean_300s", "sell_markout_mean_300s", "realized_pnl_per_matched_token", "path_alignment", "active_day_frac"])
    cols = ["buy_markout_mean_300s", "sell_markout_mean_300s", "realized_pnl_per_matched_token", "derisk_0p5_token_frac"]
    return r(D.impute_with_flags(df, cols))


@query
def cluster_profile(spark, sf):
    c = labels(spark, sf).withColumn("cluster", F.when(F.substring("wallet", 2, 9).cast("int") % 9 == 0, -1).otherwise(F.substring("wallet", 2, 9).cast("int") % 5))
    return r(D.cluster_profile(c))


@query
def feature_sets(spark, sf):
    m = X.table(spark, sf, "supplier").select(
        F.array(F.concat(F.lit("b"), F.col("s_suppkey") % 4), F.concat(F.lit("q"), F.col("s_suppkey") % 3), F.lit("other")).alias("features")
    )
    return D.feature_sets(m, ["b0", "b1", "b2", "b3"], ["q0", "q1", "q2"])


# ---------------------------------------------------------------------- metrics

@query
def ranking_curve(spark, sf):
    return r(M.ranking_curve(X.scores(spark, sf)).select("score", "tp", "fp", "precision", "recall"))


@query
def cumulative_hits(spark, sf):
    h = M.cumulative_hits(X.scores(spark, sf).drop("source"))
    return r(h.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "tp", "fp", "precision", "recall"))


@query
def auc_and_ap(spark, sf):
    s = X.scores(spark, sf)
    both = M.auc_and_ap(s).withColumn("grp", F.lit("all")).unionByName(M.auc_and_ap(s.withColumn("grp", F.col("source")), by=["grp"]))
    return r(both)


@query
def confusion_counts(spark, sf):
    return r(M.confusion(X.scores(spark, sf), 0.4, by=["source"]))


@query
def class_report(spark, sf):
    return r(M.class_report(X.scores(spark, sf), 0.4))


@query
def tuned_threshold_precision(spark, sf):
    return r(M.tune_threshold(X.scores(spark, sf), 0.9, "precision", by=["source"]))


@query
def tuned_threshold_recall(spark, sf):
    return r(M.tune_threshold(X.scores(spark, sf), 0.8, "recall", by=["source"]))


@query
def curve_points(spark, sf):
    return r(M.curve_points(X.scores(spark, sf)))


@query
def score_histogram(spark, sf):
    return r(M.score_histogram(X.scores(spark, sf)))


def fold_values(spark, sf):
    o = X.table(spark, sf, "orders")
    return o.groupBy(F.concat(F.lit("t"), F.col("o_custkey") % 20).alias("tag"), (F.col("o_orderkey") % 5).alias("fold")).agg(
        F.avg(F.floor(F.col("o_totalprice")) / 1_000_000).alias("pr_auc")
    )


@query
def cv_summary(spark, sf):
    return r(M.cv_summary(fold_values(spark, sf)))


@query
def reproduction_error(spark, sf):
    a = fold_values(spark, sf)
    b = a.withColumn("pr_auc", F.col("pr_auc") + F.col("fold") / 1000).filter("NOT (tag = 't3' AND fold = 1)")
    return r(M.reproduction_error(a, b))


# ---------------------------------------------------------------------- reports

def model_table(spark, sf):
    """One made-up model per customer of the first nations: tag, CV and test values, sizes."""
    c = X.table(spark, sf, "customer")
    v = F.floor(F.abs("c_acctbal"))
    return c.select(
        F.concat(F.lit("tag"), F.col("c_custkey")).alias("tag"),
        F.when(F.col("c_custkey") % 7 != 0, (v % 500 + 500) / 1000).alias("cv_pr"), ((v % 30) / 1000).alias("cv_std"),
        F.when(F.col("c_custkey") % 11 != 0, (v % 400 + 600) / 1000).alias("test_pr"), ((v % 90 + 900) / 1000).alias("test_roc"),
        F.when(F.col("c_custkey") % 13 != 0, F.col("c_nationkey") + 5).alias("n_features"), (v * 3 + 10).cast("bigint").alias("n_params"),
    )


@query
def model_ranking(spark, sf):
    m = R.rank_models(model_table(spark, sf))
    return r(m.select("tag", "cv_pr", F.col("rank").cast("bigint").alias("rank")))


@query
def model_roc_swap(spark, sf):
    roc = fold_values(spark, sf).groupBy("tag").agg(F.avg("pr_auc").alias("roc_mean"), F.stddev_pop("pr_auc").alias("roc_std"))
    roc = roc.withColumn("tag", F.replace("tag", F.lit("t"), F.lit("tag")))
    return r(R.with_recomputed_roc(model_table(spark, sf), roc).select("tag", "cv_pr", "cv_std", "test_pr"))


@query
def model_recommendation(spark, sf):
    return R.recommend(model_table(spark, sf))


@query
def leanest_model(spark, sf):
    return r(R.leanest_strong(model_table(spark, sf)))


@query
def cv_against_test(spark, sf):
    return r(R.cv_against_test(model_table(spark, sf)))


@query
def latest_artifacts(spark, sf):
    o = X.table(spark, sf, "orders").select(
        F.concat(F.lit("tag"), F.col("o_custkey") % 40).alias("tag"), F.concat(F.lit("run_"), F.col("o_orderkey"), F.lit(".json")).alias("path"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("mtime"),
    )
    extra = o.filter("tag IN ('tag1', 'tag2', 'tag3')").withColumn("path", F.concat(F.lit("new_"), F.col("path")))
    return R.latest_artifacts(o, ["tag1", "tag2"], extra)


@query
def rank_slice(spark, sf):
    v = P.cash_volume(context(spark, sf).trades).select(F.concat_ws("/", "wallet", MARKET).alias("wallet"), (F.col("volume_micro") / MICRO).alias("pred_prob"))
    return r(R.rank_scores(v, 11, 40).select("wallet", "pred_prob", F.col("rank").cast("bigint").alias("rank")))


COEFS = {"n_distinct_buy_days": 0.35, "n_distinct_sell_days": -0.5, "active_day_frac": 2.0}
INTERCEPT = -0.75


def _coefs(spark, sf):
    """Coefficient table of a linear model over day features."""
    names = F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(v).alias("coef")) for k, v in COEFS.items()])
    return X.table(spark, sf, "region").filter("r_regionkey = 0").select(F.inline(names))


def _contributions(spark, sf):
    return R.linear_contributions(D.melt(labelled(spark, sf), list(COEFS), ["wallet", MARKET, "is_insider"]), _coefs(spark, sf), ["wallet", MARKET, "is_insider"])


@query
def linear_contributions(spark, sf):
    return r(_contributions(spark, sf).select("wallet", MARKET, "feature", "value", "contribution"))


@query
def linear_scores(spark, sf):
    return r(R.linear_scores(_contributions(spark, sf), INTERCEPT, ["wallet", MARKET]))


@query
def misclassified_rows(spark, sf):
    s = R.linear_scores(_contributions(spark, sf), INTERCEPT, ["wallet", MARKET, "is_insider"])
    return r(R.misclassified(s, 0.5).select("wallet", MARKET, "is_insider", "pred_label", "prob"))


@query
def error_drivers(spark, sf):
    ids = ["wallet", MARKET]
    c = _contributions(spark, sf)
    wrong = R.misclassified(R.linear_scores(c, INTERCEPT, [*ids, "is_insider"]), 0.5)
    d = R.error_drivers(c.drop("is_insider"), wrong, ids, 2)
    return r(d.select(*ids, "feature", "contribution", F.col("driver_rank").cast("bigint").alias("driver_rank")))


@query
def top_contributions(spark, sf):
    t = R.top_features(_contributions(spark, sf), 2, ["wallet", MARKET])
    return r(t.select("wallet", MARKET, "feature", "contribution", F.col("rank").cast("bigint").alias("rank")))


@query
def top_contribution_text(spark, sf):
    c = _contributions(spark, sf).withColumn("contribution", F.round("contribution", 2))
    return R.top_feature_text(c, ["wallet", MARKET], 2)


@query
def importance_attribution(spark, sf):
    long = D.melt(labelled(spark, sf), list(COEFS), ["wallet", MARKET])
    imp = _coefs(spark, sf).select("feature", F.abs("coef").alias("importance"))
    a = R.importance_attribution(long, imp, ["wallet", MARKET], 2)
    return r(a.select("wallet", MARKET, "feature", "value", "contribution"))


@query
def attribution_matrix(spark, sf):
    a = _contributions(spark, sf).withColumnRenamed(MARKET, "model")
    return r(R.attribution_matrix(a, [f"m{k}" for k in range(8)]))


def _model_scores(spark, sf):
    v = P.cash_volume(context(spark, sf).trades)
    s = lambda k: (F.col("volume_micro") % k / k).alias(f"m{k}")
    return v.select("wallet", MARKET, s(101), s(211), s(307)).unpivot(["wallet", MARKET], ["m101", "m211", "m307"], "model", "score")


@query
def ensemble_scores(spark, sf):
    w = X.table(spark, sf, "region").filter("r_regionkey < 2").select(
        F.concat(F.lit("e"), F.col("r_regionkey")).alias("ensemble"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("model"), (F.lit(x) + F.col("r_regionkey") * y).alias("weight")) for m, x, y in (("m101", 1.0, 0.5), ("m211", 1.0, 2.0), ("m307", 1.0, 0.0))])),
    )
    return r(R.ensemble_scores(_model_scores(spark, sf), w, ["wallet", MARKET]))


@query
def ensemble_choice(spark, sf):
    """Three ensembles of the model scores, their quality on the labels, and the best one."""
    l = labels(spark, sf).withColumnRenamed("is_insider", "label")
    scores = _model_scores(spark, sf).join(l, ["wallet", MARKET])
    each = M.auc_and_ap(scores, "score", "label", ["model"]).select("model", (F.col("model") != "m307").alias("supervised"), "pr_auc")
    mixed = R.ensemble_scores(scores, R.ensemble_weights(each), ["wallet", MARKET]).join(l, ["wallet", MARKET])
    return r(R.best_ensemble(mixed).select("ensemble", "roc_auc", "pr_auc", "is_best"), 6)


@query
def flag_counts(spark, sf):
    return R.flag_counts(_model_scores(spark, sf).withColumn("flagged", F.col("score") >= 0.6), ["wallet", MARKET])


@query
def scan_summary(spark, sf):
    s = _model_scores(spark, sf).filter("model = 'm211'").withColumnRenamed("score", "pred_prob")
    return r(R.scan_summary(R.flag_scores(s, 0.7)))


@query
def coefficient_stability(spark, sf):
    d = context(spark, sf).family("days")
    c = D.melt(d, DAY_COLUMNS, ["wallet", MARKET]).filter("value IS NOT NULL").select("feature", (F.col("value") - 0.25).alias("coef"))
    return r(R.coefficient_stability(c))
