"""Registered queries of fitted models that return what SQL can know of them: counts and laws that must hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fillsight import fixtures as X
from fillsight.ml import anomaly as AN, cluster as CL, train as TR
from fillsight.operators import dataset as D
from fillsight.plans import jobs as J, report as R
from fillsight.schema import MARKET
from fillsight.session import materialize, shared_folder
from registry.core import context, query, r
from registry.learning import BOOST, FEATURES, FOREST, META, _oof, _zoo, dataset, matrix, spec
from registry.models import deposits, positives

IDS = ["wallet", MARKET]


@query
def out_of_fold_rows(spark, sf):
    """Every row is scored once by each estimator, by a model that did not see its market."""
    specs = {"logistic": spec(estimator="logistic", params=dict(max_iter=20), n_folds=3), "forest": spec(**FOREST), "boosting": spec(**BOOST)}
    scored = D.union_ragged(*[_oof(spark, sf, s).withColumn("tag", F.lit(t)) for t, s in specs.items()])
    folds = scored.groupBy("tag", MARKET).agg(F.count_distinct("fold").alias("f")).groupBy("tag").agg(F.max("f").alias("folds_of_a_market"))
    return scored.groupBy("tag").agg(
        F.count("*").alias("rows"), F.count_distinct(*IDS).alias("pairs"), F.sum(D.LABEL).alias("positives"),
        F.count_if((F.col("raw") >= 0) & (F.col("raw") <= 1)).alias("probabilities"),
    ).join(folds, "tag")


@query
def calibration_balance(spark, sf):
    """The calibrator gives probabilities that add up to the positives."""
    t = _zoo(spark, sf)["forest"]
    a, b = t.calibrator
    p = t.oof.select(D.LABEL, "raw", (1 / (1 + F.exp(-(a * F.col("raw") + b)))).alias("p"))
    return p.agg(F.count("*").alias("rows"), F.count_if((F.col("p") > 0) & (F.col("p") < 1)).alias("probabilities"),
                 (F.abs(F.sum("p") - F.sum(D.LABEL)) < 0.001 * F.count("*")).alias("balanced"))


@query
def left_market_counts(spark, sf):
    """Rows and positives that each left-out market is tested on, and whether its decisions add up."""
    s = spec(**{**FOREST, "n_folds": 2, "params": dict(numTrees=3, maxDepth=2)}, calibrate=False)
    m = TR.leave_markets_out(dataset(spark, sf), s, [f"m{k}" for k in range(8)])
    return m.select("test_market", "n", "n_positives", (F.col("tp") + F.col("fn") == F.col("n_positives")).alias("positives_add_up"),
                    (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") == F.col("n")).alias("rows_add_up"))


@query
def importance_laws(spark, sf):
    """Importances of a forest: one per feature, none negative, adding up to one."""
    i = TR.importances(_zoo(spark, sf)["forest"].model, spec(**FOREST))
    total = i.agg(F.sum("importance").alias("t"))
    return i.join(total).select("feature", (F.col("importance") >= 0).alias("not_negative"), (F.abs(F.col("t") - 1) < 1e-9).alias("add_up"))


@query
def isolation_laws(spark, sf):
    """Anomaly scores lie between 0 and 1, the flagged rows are the highest, at most the tenth that is asked for."""
    d = dataset(spark, sf).select(*IDS, *[F.col(c).cast("double").alias(c) for c in FEATURES])
    forest = AN.fit_forest(d, FEATURES, IDS, n_trees=20, sample=64)
    s = materialize(AN.score_forest(d, forest, FEATURES, 0.1).select("anomaly_score", "anomaly"))
    low = F.min(F.when(F.col("anomaly"), F.col("anomaly_score")))
    high = F.max(F.when(~F.col("anomaly"), F.col("anomaly_score")))
    n = F.count_if("anomaly")
    return s.agg(F.count("*").alias("rows"), F.count_if((F.col("anomaly_score") > 0) & (F.col("anomaly_score") < 1)).alias("in_range"),
                 (low > high).alias("highest_flagged"), ((n >= 1) & (n <= F.ceil(0.1 * F.count("*")))).alias("share_kept"))


@query
def kmeans_laws(spark, sf):
    """Every row has one of k clusters, and of every k the silhouette is one."""
    m = materialize(matrix(spark, sf))
    sizes = D.union_ragged(*[CL.kmeans_assign(m, k).groupBy("cluster").agg(F.count("*").alias("n")).agg(
        F.lit(k).alias("k"), F.count("*").alias("clusters"), F.sum("n").alias("rows")) for k in (2, 5, 8)])
    sweep = CL.kmeans_sweep(m, (2, 5, 8))
    return sizes.join(sweep, "k").select("k", "clusters", "rows", F.col("silhouette").between(-1, 1).alias("silhouette"), (F.col("cost") > 0).alias("cost"))


@query
def projection_laws(spark, sf):
    """Principal axes: no correlation, falling variance, no more of it than the features have."""
    p = CL.project(matrix(spark, sf))
    scale = F.sqrt(F.var_samp("x") * F.var_samp("y"))
    return p.agg(F.count("*").alias("rows"), (F.abs(F.covar_samp("x", "y")) < 1e-9 * scale).alias("uncorrelated"),
                 (F.var_samp("x") >= F.var_samp("y")).alias("falling"), (F.var_samp("x") + F.var_samp("y") <= len(FEATURES) + 1e-9).alias("bounded"))


@query
def training_rows(spark, sf):
    """The training set of the job: drawn pairs, their labels and behavioural features."""
    c, pos = context(spark, sf), positives(spark, sf)
    d = J.training_set(c, pos, pos, 2, (*FEATURES, *META), activity=X.activity(spark, sf), deposits=deposits(spark, sf), transfers=X.transfers(spark, sf))
    known = F.col("n_markets_traded").isNotNull().alias("has_metadata")
    return r(d.select(*IDS, D.LABEL, *[F.col(f).cast("double").alias(f) for f in FEATURES], known), 6)


@query
def audit_counts(spark, sf):
    """Rows and positives of every model in the audit; each pair is counted once per model."""
    d, models = dataset(spark, sf), _zoo(spark, sf)
    a = materialize(J.audit_pairs(d, models, {t: m.test_scores for t, m in models.items()}, 0.3))
    own = a.groupBy(*IDS).agg(F.count_if("flagged").alias("_f"), F.count("*").alias("_n"))
    ok = (F.col("_f") == F.col("n_flagged")) & (F.col("_n") == F.col("n_models"))
    return a.join(own, IDS).groupBy("model").agg(F.count("*").alias("rows"), F.count_if(ok).alias("counted"), F.count_distinct("threshold").alias("cuts"))


@query
def fitted_model_report(spark, sf):
    """The comparison reports on models fitted here: ranks, the recommended ones, and what must hold of them."""
    table = materialize(J.model_rows(_zoo(spark, sf)))
    c = J.compare_models(table)
    lean = R.leanest_strong(table).first()["tag"]
    gaps = R.cv_against_test(table).select("tag", "cv_optimistic")
    top = F.col("cv_pr") == F.lit(table.agg(F.max("cv_pr")).first()[0])
    return c.select("tag", "n_features", (F.col("rank") == 1).eqNullSafe(F.col("is_best_cv")).alias("best_is_first"),
                    (~F.col("is_best_cv") | top).alias("best_has_most"), (F.col("tag") == lean).alias("_lean"), "cv_optimistic").join(
        gaps.withColumnRenamed("cv_optimistic", "_o"), "tag").select(
        "tag", "n_features", "best_is_first", "best_has_most", F.col("_o").eqNullSafe(F.col("cv_optimistic")).alias("same_gap"), F.col("_lean").isNotNull().alias("ranked"))


@query
def fitted_contributions(spark, sf):
    """Contributions of a fitted linear model add up to the log odds of its own scores."""
    t, d = _zoo(spark, sf)["logistic"], dataset(spark, sf)
    flat = _flat(spark, t)
    filled = d.select(*IDS, *[F.coalesce(F.col(c).cast("double"), F.lit(float(m))).alias(c) for c, m in zip(FEATURES, flat.medians)])
    coefs = spark.createDataFrame([(f, float(v)) for f, v in zip(FEATURES, flat.coefficients)], "feature string, coef double")
    s = R.linear_scores(R.linear_contributions(D.melt(filled, FEATURES, IDS), coefs, IDS), float(flat.intercept), IDS)
    own = t.score(d).select(*IDS, "pred_prob_raw")
    return s.join(own, IDS).agg(F.count("*").alias("rows"), F.count_if(F.abs(F.col("prob") - F.col("pred_prob_raw")) < 1e-9).alias("same"))


def _flat(spark, trained):
    from fillsight.ml.zoo import flatten

    return flatten(spark, trained)


@query
def scan_job(spark, sf):
    """The scan with behavioural and metadata features, as read back from its sinks."""
    c, pos = context(spark, sf), positives(spark, sf)
    sources = dict(activity=X.activity(spark, sf), deposits=deposits(spark, sf), transfers=X.transfers(spark, sf))
    d = materialize(J.training_set(c, pos, pos, 2, (*FEATURES, *META), **sources))
    model = TR.train(d, TR.replace(spec(**FOREST, threshold=0.3), features=(*FEATURES, *META)))
    path = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex[:12]}"
    J.scan_job(c, model, path, 50, flagged=X.flagged(spark, sf), **sources)
    rows, flagged, summary = (spark.read.parquet(f"{path}/{n}") for n in ("results", "flagged", "summary"))
    ordered = rows.columns[-len(model.spec.features):] == list(model.spec.features)
    sunk = rows.join(flagged.select(*IDS, F.lit(True).alias("_sunk")), IDS, "left").join(summary, MARKET)
    every = rows.groupBy(MARKET).agg(F.count("*").alias("_n"), F.count_if("flagged").alias("_f"))
    out = sunk.join(every, MARKET).select(
        "wallet", MARKET, "volume", "n_trades", "first_trade_ts", (F.coalesce("_sunk", F.lit(False)) == F.col("flagged")).alias("sink_agrees"),
        ((F.col("_n") == F.col("scored")) & (F.col("_f") == F.col("n_flagged"))).alias("summary_agrees"),
        F.col("n_markets_traded").isNotNull().alias("has_metadata"), F.lit(ordered).alias("model_order"))
    return r(out)
