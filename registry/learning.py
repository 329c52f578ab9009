"""Registered model, clustering and streaming queries (no SQL equivalent)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fillsight import fixtures as X
from fillsight.ml import anomaly as AN, cluster as CL, density as DE, leave_one_out as LO, train as TR, zoo as Z
from fillsight.operators import dataset as D, parsing as PR
from fillsight.plans import jobs as J, report as R
from fillsight.schema import FILLS, MARKET
from fillsight.session import materialize, shared_folder
from fillsight.streaming import ingest as ST, live as LV
from registry.core import context, query, r
from registry.models import deposits, fold_values, model_table, positives
from registry.trades import labels

FEATURES = (
    "n_distinct_active_days", "active_day_frac", "buy_day_concentration_hhi", "net_directional_consistency", "gross_tokens",
    "outcome_alignment_token", "max_abs_inventory", "path_alignment",
)
META = ("n_markets_traded", "winrate", "median_bet_size_usdc", "wallet_age_seconds")
FOREST = dict(estimator="forest", params=dict(numTrees=10, maxDepth=4), n_folds=3)
BOOST = dict(estimator="boosting", params=dict(maxIter=5, maxDepth=2), n_folds=3, missing_indicators=True)


def dataset(spark, sf):
    """Labelled rows, written once per context: the boundary between features and models."""
    c = context(spark, sf)
    if "labelled" not in c.__dict__:
        c.__dict__["labelled"] = materialize(D.with_labels(c.features(FEATURES), labels(spark, sf)))
    return c.__dict__["labelled"]


def spec(**kw):
    return TR.TrainSpec(FEATURES, **{"large_rows": 10_000, "n_large": 0, "n_small": 2, **kw})


def _oof(spark, sf, s):
    folded = materialize(TR.fold_rows(TR.prepare(dataset(spark, sf), s), s))
    return TR.oof_predictions(folded, s)


@query
def logistic_out_of_fold(spark, sf):
    return r(_oof(spark, sf, spec(estimator="logistic", params=dict(c=0.4, max_iter=30), n_folds=3)), 4)


@query
def forest_out_of_fold(spark, sf):
    return r(_oof(spark, sf, spec(**FOREST)), 4)


@query
def boosting_out_of_fold(spark, sf):
    return r(_oof(spark, sf, spec(**BOOST)), 4)


def _left_out(spark, sf, penalty="l2", cs=(0.05, 0.4, 1.0)):
    c = context(spark, sf)
    if "loo_design" not in c.__dict__:
        c.__dict__["loo_design"] = LO.design(dataset(spark, sf), FEATURES)
    return LO.Fits(c.__dict__["loo_design"], cs, penalty)


@query
def left_out_scores(spark, sf):
    """Left-out scores of every row: a row's score without it lies no nearer to its own label than with it."""
    fits = _left_out(spark, sf)
    still = [F.struct(F.lit(c).alias("c"), F.lit(bool(abs(g).max() < 1e-6)).alias("stationary")) for c, g in zip(fits.cs, fits.gradients())]
    still = spark.range(1).select(F.inline(F.array(*still)))
    toward = (F.col("raw") - F.col("fitted")) * (2 * F.col(D.LABEL) - 1) <= 1e-9
    each = fits.scores().groupBy("c").agg(F.count("*").alias("rows"), F.sum(D.LABEL).alias("positives"), F.count_if(toward).alias("not_nearer"))
    return each.join(still, "c")


@query
def left_out_tuning(spark, sf):
    """Quality of each penalty by left-out scores, best first."""
    fits = _left_out(spark, sf, cs=LO.CS)
    return r(LO.loo_quality(materialize(fits.scores())), 4)


@query
def left_out_stability(spark, sf):
    """Stability of the coefficients over the fits without each row."""
    fits = _left_out(spark, sf, cs=(0.4,))
    s = R.coefficient_stability(fits.coefficients(FEATURES, 0.4).select("feature", "coef"))
    signs = F.round(F.col("positive_frac") + F.col("negative_frac"), 9) == F.round("nonzero_frac", 9)
    return s.select("feature", signs.alias("signs_add_up"), (F.col("mean_abs_coef") >= F.abs("mean_coef") - 1e-12).alias("bounded"))


@query
def nested_left_out(spark, sf):
    """Held-out scores of outer folds whose penalty the left-out scores of the rest choose."""
    n = LO.nested(dataset(spark, sf), FEATURES, (0.05, 0.4), outer=3)
    each = n.groupBy("fold").agg(F.count("*").alias("rows"), F.sum(D.LABEL).alias("positives"), (F.count_distinct("c") == 1).alias("one_penalty"),
                                 F.count_if((F.col("raw") > 0) & (F.col("raw") < 1)).alias("scored"))
    return each.agg(F.count("*").alias("folds"), F.sum("rows").alias("rows"), F.sum("positives").alias("positives"), F.sum("scored").alias("scored"),
                    F.bool_and("one_penalty").alias("one_penalty"))


@query
def penalty_tuning(spark, sf):
    s = spec(estimator="logistic", n_folds=3, folds="rows", params=dict(max_iter=20))
    folded = materialize(TR.fold_rows(TR.prepare(dataset(spark, sf), s), s))
    return r(TR.tune_penalty(folded, s, [0.01, 0.05, 0.4, 2.0]), 4)


@query
def parameter_search(spark, sf):
    base = spec(**FOREST)
    folded = materialize(TR.fold_rows(TR.prepare(dataset(spark, sf), base), base))
    sets = TR.random_param_sets({"numTrees": [5, 10], "maxDepth": [2, 4]}, 4)
    return r(TR.search(folded, {f"set{i}": spec(**{**FOREST, "params": p}) for i, p in enumerate(sets)}), 4)


@query
def grid_search(spark, sf):
    """Cross-validated grid over the fold column: mean average precision of each parameter set."""
    base = spec(**FOREST)
    folded = materialize(TR.fold_rows(TR.prepare(dataset(spark, sf), base), base))
    grid = {"numTrees": [5, 10], "maxDepth": [2, 4]}
    fitted = TR.tune(folded, base, grid)
    rows = [({p.name: str(v) for p, v in m.items()}, float(a)) for m, a in zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics)]
    out = spark.createDataFrame([(d["numTrees"], d["maxDepth"], a, a == max(x for _, x in rows)) for d, a in rows],
                                "num_trees string, max_depth string, pr_auc double, is_best boolean")
    return r(out, 4)


@query
def best_strategy(spark, sf):
    """Three strategies trained side by side, the best by out-of-fold average precision marked."""
    specs = {
        "forest": spec(**FOREST), "boosting": spec(**BOOST, calibrate=False),
        "logistic": spec(estimator="logistic", params=dict(max_iter=20), n_folds=3, calibrate=False),
    }
    best, quality, trained = TR.train_best(dataset(spark, sf), specs)
    return r(quality.select("tag", "cv_mean", "cv_std", "is_best").withColumn("held_out_rows", F.lit(trained.test_scores.count())), 4)


def _zoo(spark, sf):
    """Three trained models, kept for the session's context."""
    c = context(spark, sf)
    if "zoo" not in c.__dict__:
        d = dataset(spark, sf)
        specs = {"forest": spec(**FOREST), "boosting": spec(**BOOST), "logistic": spec(estimator="logistic", params=dict(max_iter=20), n_folds=3, calibrate=False)}
        c.__dict__["zoo"] = TR.train_all(d, specs)
    return c.__dict__["zoo"]


@query
def calibrated_training(spark, sf):
    """Market split, out-of-fold calibration, refit, held-out metrics."""
    return r(TR.train(dataset(spark, sf), spec(**FOREST, threshold=0.15)).metrics, 4)


@query
def leave_markets_out(spark, sf):
    s = spec(**{**FOREST, "n_folds": 2, "params": dict(numTrees=5, maxDepth=3)}, calibrate=False)
    return r(TR.leave_markets_out(dataset(spark, sf), s, [f"m{k}" for k in range(8)]), 4)


@query
def feature_importances(spark, sf):
    s = spec(**FOREST)
    d = TR.prepare(dataset(spark, sf), s)
    m = TR.pipeline_for(s).fit(d)
    return r(TR.importances(m, s).withColumn("n_params", F.lit(TR.parameter_count(m))), 4)


@query
def isolation_scores(spark, sf):
    d = dataset(spark, sf).select("wallet", MARKET, *[F.col(c).cast("double").alias(c) for c in FEATURES])
    forest = AN.fit_forest(d, FEATURES, ["wallet", MARKET], n_trees=20, sample=64)
    return r(AN.score_forest(d, forest, FEATURES, 0.1).select("wallet", MARKET, "anomaly_score", "anomaly"), 6)


def matrix(spark, sf):
    """Imputed, standardized feature vectors of the labelled rows."""
    d = dataset(spark, sf)
    return CL.standardized(d.select("wallet", MARKET, D.LABEL, *[F.col(c).cast("double").alias(c) for c in FEATURES]), FEATURES)


@query
def kmeans_sweep(spark, sf):
    return r(CL.kmeans_sweep(matrix(spark, sf)), 4)


@query
def kmeans_profile(spark, sf):
    return r(D.cluster_profile(CL.kmeans_assign(matrix(spark, sf), 5)), 6)


@query
def plane_projection(spark, sf):
    return r(CL.project(matrix(spark, sf)).select("wallet", MARKET, F.abs("x").alias("x"), F.abs("y").alias("y")), 4)


@query
def embedding_clusters(spark, sf):
    e = CL.from_array(X.table(spark, sf, "embeddings"), "embedding")
    return CL.kmeans_assign(e, 8).select("vec_id", "cluster")


def plane(spark, sf):
    """Two components of every embedding as points on the plane."""
    e = X.table(spark, sf, "embeddings")
    return materialize(e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")))


def _eps(points, share):
    return DE.distance_percentiles(points, (share,))[share]


@query
def distance_percentiles(spark, sf):
    """Distance to the fifth neighbour that shares of the points stay within."""
    found = DE.distance_percentiles(plane(spark, sf), (0.5, 0.75, 0.9, 0.95))
    return spark.createDataFrame([(p, round(d, 6)) for p, d in found.items()], "share double, distance double")


@query
def density_clusters(spark, sf):
    points = plane(spark, sf)
    return DE.dbscan(points, _eps(points, 0.5))


@query
def density_sweep(spark, sf):
    """Clusters and noise at the radii of three percentiles."""
    points, parts = plane(spark, sf), []
    for share, eps in DE.distance_percentiles(points, (0.25, 0.5, 0.75)).items():
        d = DE.dbscan(points, eps)
        parts.append(d.agg(
            F.lit(share).alias("share"), F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("kind") == "core").alias("core"),
            F.count_if(F.col("kind") == "border").alias("border"), F.count_if(F.col("kind") == "noise").alias("noise")))
    return D.union_ragged(*parts)


@query
def density_profile(spark, sf):
    """Size and share of positives of each density cluster of the labelled rows on their principal plane."""
    p = materialize(CL.project(matrix(spark, sf)).select(F.xxhash64(MARKET, "wallet").alias("id"), "x", "y", D.LABEL))
    found = DE.dbscan(p.select("id", "x", "y"), _eps(p, 0.75)).fillna(-1, ["cluster"])
    return r(D.cluster_profile(found.join(p.select("id", D.LABEL), "id")), 6)


@query
def market_scan(spark, sf):
    """Top wallets of every market scored and flagged by a model trained on the labels."""
    model = TR.train(dataset(spark, sf), spec(**FOREST, threshold=0.15))
    scored, _ = J.market_scan(context(spark, sf), model, 50)
    return r(scored.select("wallet", MARKET, "pred_prob", "flagged", "volume", "n_trades"), 4)


@query
def training_set(spark, sf):
    c = context(spark, sf)
    pos = positives(spark, sf)
    d = J.training_set(
        c, pos, pos, 2, (*FEATURES, *META), activity=X.activity(spark, sf), deposits=deposits(spark, sf), transfers=X.transfers(spark, sf)
    )
    return r(d, 6)


@query
def pair_audit(spark, sf):
    d, models = dataset(spark, sf), _zoo(spark, sf)
    return r(J.audit_pairs(d, models, {t: m.test_scores for t, m in models.items()}, 0.3), 4)


@query
def one_pass_scores(spark, sf):
    """Scores of all models from one scan: rows of each, and whether they equal the model's own pipeline."""
    d, models = dataset(spark, sf), _zoo(spark, sf)
    flat = materialize(Z.score_zoo(d, Z.flatten_all(spark, models)))
    own = D.union_ragged(*[m.score(d).select("wallet", MARKET, "pred_prob", "pred_prob_raw", F.lit(t).alias("model")) for t, m in models.items()])
    same = (F.abs(F.col("score") - F.col("pred_prob")) < 1e-9) & (F.abs(F.col("raw") - F.col("pred_prob_raw")) < 1e-9)
    return flat.join(own, ["wallet", MARKET, "model"]).groupBy("model").agg(F.count("*").alias("rows"), F.count_if(same).alias("same"))


@query
def model_comparison(spark, sf):
    f = fold_values(spark, sf).withColumn("tag", F.replace("tag", F.lit("t"), F.lit("tag")))
    return r(J.compare_models(model_table(spark, sf), f))


# -------------------------------------------------------------------- streaming

def _folder(spark):
    return f"{shared_folder(spark)}/landing-{uuid.uuid4().hex[:12]}"


def _fills(spark, sf):
    f = X.fills(spark, sf)
    return f.select(*[F.col(x.name).cast(x.dataType) for x in FILLS])


def _land(spark, root, parts):
    """Land the parts one after the other and ingest after each."""
    for part in parts:
        part.repartition(4, F.expr("timestamp div 86400")).write.mode("append").parquet(f"{root}/fills")
        ST.ingest_fills(ST.fill_stream(spark, f"{root}/fills"), f"{root}/out", f"{root}/ck").awaitTermination()
    return f"{root}/out"


def _ingested(spark, sf):
    """Fills with repeats that land in two parts, the later half first."""
    f = _fills(spark, sf)
    f = f.unionByName(f.filter("timestamp % 5 = 0"))
    middle = f.select(F.percentile_approx("timestamp", 0.5).alias("m")).first()["m"]
    late = f.filter((F.col("timestamp") < middle) | (F.col("timestamp") % 10 == 0))
    return _land(spark, _folder(spark), [f.filter(F.col("timestamp") >= middle), late])


@query
def streamed_ingest(spark, sf):
    out = ST.ingested(spark, _ingested(spark, sf))
    return out.groupBy(MARKET).agg(F.count("*").alias("n_fills"), F.count_distinct("id").alias("n_ids"))


@query
def streamed_odd_slugs(spark, sf):
    """Ingested fills, row by row, where slugs look like numbers, dates or nothing at all and repeats land late."""
    f = _fills(spark, sf)
    k = F.substring(MARKET, 2, 9).cast("int")
    slug = F.when(k == 0, F.lit(None)).when(k == 1, "007").when(k == 2, "7").when(k == 3, "2024-01-05").when(k == 4, "1e3").when(k == 5, "").otherwise(F.col(MARKET))
    f = f.withColumn(MARKET, slug)
    again = f.filter("timestamp % 3 = 0")
    out = ST.ingested(spark, _land(spark, _folder(spark), [f.filter("timestamp % 2 = 1"), f.unionByName(again), again]))
    return out.select("id", MARKET, "timestamp", "maker")


@query
def streamed_positions(spark, sf):
    out, view = _ingested(spark, sf), ST.positions_view(X.markets(spark, sf))
    ST.track(ST.ingested_stream(spark, out), view, f"{out}-positions", f"{out}-ck-positions").awaitTermination()
    return ST.tracked(spark, view, f"{out}-positions")


@query
def streamed_hourly_volume(spark, sf):
    out, view = _ingested(spark, sf), ST.hourly_view(X.markets(spark, sf))
    ST.track(ST.ingested_stream(spark, out), view, f"{out}-volume", f"{out}-ck-volume").awaitTermination()
    s = ST.tracked(spark, view, f"{out}-volume")
    return r(s.select(MARKET, F.col("start").alias("hour"), "cash", "tokens", "n_fills", F.col("last.yes_price").alias("last_price")))


@query
def rescored_wallets(spark, sf):
    """Wallets touched by the fills that land last, scored on all their landed fills."""
    out = _ingested(spark, sf)
    _fills(spark, sf).filter("timestamp % 7 = 0").write.parquet(f"{out}-new")

    def score(landed):
        return PR.cash_volume(PR.normalize_trades(PR.parse_trades(landed, X.markets(landed.sparkSession, sf)))).select("wallet", MARKET, "volume_micro")

    stream = ST.fill_stream(spark, f"{out}-new")
    ST.rescore_touched(stream, lambda s: ST.ingested(s, out), score, f"{out}-scores", f"{out}-ck-scores").awaitTermination()
    return ST.current_state(spark, f"{out}-scores", ["market_slug", "wallet"])


@query
def live_features(spark, sf):
    """Features of stored tails after three batches: the middle third, then the last, then the first with what is missing."""
    f, root = materialize(_fills(spark, sf)), _folder(spark)
    low, high = f.select(F.percentile_approx("timestamp", [0.33, 0.66])).first()[0]
    late, t = F.pmod(F.xxhash64("id"), F.lit(10)) == 0, F.col("timestamp")
    live = LV.LiveFeatures(spark, root, materialize(X.markets(spark, sf)))
    for i, part in enumerate([f.filter((t >= low) & (t < high) & ~late), f.filter((t >= high) & ~late), f.filter((t < low) | late)]):
        live.extend(part, i)
    names = [*LV_REALIZED, "buy_tokens_total", "sell_tokens_total", "net_tokens", "gross_tokens", "net_directional_consistency"]
    return r(live.features().select(MARKET, "wallet", *names), 9)


LV_REALIZED = tuple(
    f"{e}{n}" for e in ("", "early_") for n in (
        "realized_pnl_total", "realized_pnl_per_closing_trade", "realized_pnl_per_matched_token", "n_closing_trades_with_realization",
        "matched_tokens_realized", "realized_win_rate_closing_trades",
    )
)
