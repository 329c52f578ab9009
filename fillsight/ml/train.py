"""Classifier jobs: pipelines, folds, tuning, calibration, scoring.

Every fit is one distributed Spark ML fit. Folds, parameter sets and pinned markets are
fitted side by side (``ml.together``); the driver never loops over rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import partial
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from fillsight.functions.scalar import platt
from fillsight.ml.metrics import auc_and_ap, confusion, cv_summary
from fillsight.ml.together import WIDTH, side_by_side
from fillsight.operators import dataset as D
from fillsight.operators.scan import with_scalars
from fillsight.schema import MARKET
from fillsight.session import materialize

LABEL = D.LABEL
WEIGHT = "weight"


@dataclass(frozen=True)
class TrainSpec:
    """One trainer variant: what differs between the model families is all here."""

    features: tuple[str, ...]
    estimator: str = "boosting"  # logistic | forest | boosting
    params: dict = field(default_factory=dict)
    split: str = "random_market"  # rows | group | pinned | random_market | time
    test_markets: tuple[str, ...] = ()
    time: str | None = None
    large_rows: int = 100
    n_large: int = 1
    n_small: int = 5
    folds: str = "stratified_group"  # stratified_group | group | time | rows
    n_folds: int = 5
    calibrate: bool = True
    calibrate_on: str = "folds"  # folds (out-of-fold scores) | validation (rows of split "val")
    early_stop: bool = False  # boosting stops by the rows of split "val"
    threshold: float = 0.5
    positive_weight: float | str = "balanced"
    missing_indicators: bool = False
    seed: int = 42


# Parameter sets of the trainer variants; feature lists come from the caller or from
# ``select_features``.
VARIANTS: dict[str, dict] = {
    "rows_14": dict(split="rows", folds="rows", calibrate=False, params=dict(maxIter=60, maxDepth=4)),
    "rows_30": dict(split="rows", folds="rows", calibrate=False, params=dict(maxIter=60, maxDepth=4)),
    "rows_50": dict(split="rows", folds="rows", calibrate=False, params=dict(maxIter=60, maxDepth=4)),
    "rows_forest": dict(split="rows", folds="rows", estimator="forest", calibrate=False),
    "rows_logistic": dict(split="rows", folds="rows", estimator="logistic", calibrate=False),
    "market_10": dict(threshold=0.5),
    "market_20_calibrated": dict(threshold=0.15),
    "market_20_raw": dict(calibrate=False, threshold=0.5),
    "pinned": dict(split="pinned", threshold=0.15),
    "pinned_metadata": dict(split="pinned", threshold=0.15),
    "time_10": dict(split="time", folds="time", threshold=0.30, params=dict(maxDepth=4)),
    "time_10_shallow": dict(split="time", folds="time", threshold=0.30, params=dict(maxDepth=2)),
    "time_10_validated": dict(
        split="time", folds="time", threshold=0.30, calibrate_on="validation", early_stop=True, params=dict(maxDepth=4)
    ),
    "time_30": dict(split="time", folds="time", threshold=0.30, params=dict(maxDepth=4)),
    "time_forest": dict(split="time", folds="time", estimator="forest", threshold=0.5),
    "leave_market_out_forest": dict(split="pinned", folds="group", estimator="forest", threshold=0.5),
    "downsampled_boosting": dict(split="group", threshold=0.5),
    "downsampled_forest": dict(split="group", estimator="forest", threshold=0.5),
}


def variant(name: str, features: Sequence[str], **overrides) -> TrainSpec:
    return replace(TrainSpec(tuple(features)), **{**VARIANTS[name], **overrides})


# ------------------------------------------------------------------- pipelines

def with_weights(df: DataFrame, positive_weight: float | str = "balanced") -> DataFrame:
    """Class weight column: a factor for positives, or n / (2 n_class)."""
    if positive_weight != "balanced":
        return df.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, float(positive_weight)).otherwise(1.0))
    n = df.agg(F.count("*").alias("_n"), F.sum(LABEL).alias("_p"))
    own = F.when(F.col(LABEL) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    j = with_scalars(df, n)
    return j.withColumn(WEIGHT, F.col("_n") / (2.0 * own)).drop("_n", "_p")


def _inputs(features: Sequence[str], impute: bool, indicators: bool) -> tuple[list, str]:
    cols = list(features)
    stages = []
    if impute:
        out = [f"{c}__i" for c in cols]
        stages.append(Imputer(strategy="median", inputCols=cols, outputCols=out, relativeError=0.0))
        cols = out
    if indicators:
        cols = cols + [f"{c}__null" for c in features]
    stages.append(VectorAssembler(inputCols=cols, outputCol="raw_features", handleInvalid="keep"))
    return stages, "raw_features"


def with_indicators(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}__null") for c in features])


def logistic_pipeline(features: Sequence[str], c: float = 0.4, n_weight: float = 1.0, l1_ratio: float = 1.0, max_iter: int = 100, **_) -> Pipeline:
    """Median imputation, standardization, logistic regression.

    ``c`` is the inverse penalty on the summed loss; Spark averages it, so the penalty
    becomes 1 / (c * total weight). Scaling uses the sample deviation.
    """
    stages, col = _inputs(features, True, False)
    stages += [
        StandardScaler(inputCol=col, outputCol="features", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="features", labelCol=LABEL, weightCol=WEIGHT, elasticNetParam=l1_ratio, regParam=1.0 / (c * n_weight),
            maxIter=max_iter, standardization=False,
        ),
    ]
    return Pipeline(stages=stages)


def forest_pipeline(features: Sequence[str], indicators: bool = False, seed: int = 42, **params) -> Pipeline:
    stages, col = _inputs(features, True, indicators)
    p = {"numTrees": 60, "maxDepth": 6, **params}
    return Pipeline(stages=[*stages, RandomForestClassifier(featuresCol=col, labelCol=LABEL, weightCol=WEIGHT, seed=seed, **p)])


def boosting_pipeline(features: Sequence[str], indicators: bool = True, seed: int = 42, validation: str | None = None, **params) -> Pipeline:
    """Boosted trees; missing values are imputed and kept visible through indicator columns.

    ``validation`` names a boolean column whose true rows stop the boosting early.
    """
    stages, col = _inputs(features, True, indicators)
    p = {"maxIter": 30, "maxDepth": 3, "stepSize": 0.1, **params}
    if validation:
        p["validationIndicatorCol"] = validation
    return Pipeline(stages=[*stages, GBTClassifier(featuresCol=col, labelCol=LABEL, weightCol=WEIGHT, seed=seed, **p)])


def pipeline_for(spec: TrainSpec, total_weight: float = 1.0, validation: str | None = None) -> Pipeline:
    if spec.estimator == "logistic":
        return logistic_pipeline(spec.features, n_weight=total_weight, **spec.params)
    if spec.estimator == "forest":
        return forest_pipeline(spec.features, spec.missing_indicators, spec.seed, **spec.params)
    if spec.estimator == "boosting":
        return boosting_pipeline(spec.features, spec.missing_indicators, spec.seed, validation, **spec.params)
    raise ValueError(f"unknown estimator {spec.estimator}")


def prepare(df: DataFrame, spec: TrainSpec) -> DataFrame:
    keep = [c for c in ("wallet", MARKET, LABEL, "fold", "split", spec.time) if c and c in df.columns]
    keep = list(dict.fromkeys(keep))
    m = D.model_matrix(df, [f for f in spec.features if f not in keep], keep)
    m = with_weights(m, spec.positive_weight)
    return with_indicators(m, spec.features) if spec.missing_indicators else m


def probability() -> Column:
    return vector_to_array(F.col("probability"))[1]


def score_rows(model: PipelineModel, df: DataFrame, out: str = "raw") -> DataFrame:
    """Probability of the positive class and the decision score."""
    s = model.transform(df)
    return s.withColumn(out, probability()).withColumn("decision", vector_to_array(F.col("rawPrediction"))[1]).drop(
        "probability", "rawPrediction", "prediction", "features", "raw_features"
    )


# ------------------------------------------------------------- splits and folds

def split_rows(df: DataFrame, spec: TrainSpec) -> DataFrame:
    """Add ``split`` (train / val / test)."""
    if spec.split == "rows":
        return D.stratified_split(df, 0.2, spec.seed)
    if spec.split == "group":
        return D.group_split(df, 0.15, spec.seed)
    stats = D.market_stats(df, spec.time, spec.large_rows)
    if spec.split == "pinned":
        D.require_markets(stats, spec.test_markets)
        marked = D.pinned_split(stats, spec.test_markets)
    elif spec.split == "random_market":
        marked = D.random_market_split(stats, spec.n_large, spec.n_small, spec.seed)
    elif spec.split == "time":
        D.require_markets(stats, spec.test_markets)
        marked = D.time_split(stats, spec.test_markets)
    else:
        raise ValueError(f"unknown split {spec.split}")
    return df.join(marked.select(MARKET, "split"), MARKET)


def fold_rows(df: DataFrame, spec: TrainSpec) -> DataFrame:
    if spec.folds == "time":
        return D.time_folds(df, spec.time, spec.n_folds)
    if spec.folds == "rows":
        return D.row_folds(df, spec.n_folds, spec.seed)
    return D.group_folds(df, spec.n_folds, spec.folds == "stratified_group", spec.seed)


def _usable(df: DataFrame) -> bool:
    return df.select(LABEL).distinct().count() == 2


def oof_predictions(train: DataFrame, spec: TrainSpec, width: int = WIDTH) -> DataFrame:
    """Out-of-fold probabilities: each row scored by the model that did not see its fold.

    Time folds train on earlier folds only and leave fold 0 unscored. ``width`` fits run at once.
    """
    expanding = spec.folds == "time"

    def fold(k: int) -> DataFrame:
        fit_on = train.filter(F.col("fold") < k if expanding else F.col("fold") != k)
        held = train.filter(F.col("fold") == k)
        if held.isEmpty():
            raise ValueError(f"fold {k} of {spec.n_folds} has no rows")
        if not _usable(fit_on):
            raise ValueError(f"the rows outside fold {k} have one class only: {held.count()} rows would stay unscored")
        model = pipeline_for(spec, _total_weight(fit_on)).fit(fit_on)
        return score_rows(model, held).select("wallet", MARKET, LABEL, "fold", "raw")

    folds = range(1, spec.n_folds + 1) if expanding else range(spec.n_folds)
    return D.union_ragged(*side_by_side(train.sparkSession, [partial(fold, k) for k in folds], width))


def _total_weight(df: DataFrame) -> float:
    return float(df.agg(F.sum(WEIGHT)).first()[0] or 1.0)


def unscored_rows(train: DataFrame, oof: DataFrame) -> DataFrame:
    """Rows without an out-of-fold score (must be none for complete folds)."""
    return train.select("wallet", MARKET).join(oof.filter(F.col("raw").isNotNull()), ["wallet", MARKET], "left_anti")


def fit_calibrator(oof: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the sigmoid fitted on out-of-fold probabilities.

    The slope has a unit penalty on the summed loss (Spark averages the loss), so separable
    scores do not run away.
    """
    v = VectorAssembler(inputCols=["raw"], outputCol="v").transform(oof)
    m = LogisticRegression(featuresCol="v", labelCol=LABEL, regParam=1.0 / max(v.count(), 1), maxIter=100, standardization=False).fit(v)
    return float(m.coefficients[0]), float(m.intercept)


def insider_score(df: DataFrame, calibrator: tuple[float, float] | None) -> DataFrame:
    """Common suspicion score: calibrated probability, raw probability, or negated anomaly value."""
    if "raw" in df.columns:
        score = platt(F.col("raw"), *calibrator) if calibrator else F.col("raw")
    else:
        score = -F.col("anomaly_decision")
    return df.withColumn("score", score)


# ------------------------------------------------------------------------ train

@dataclass
class Trained:
    spec: TrainSpec
    model: PipelineModel
    calibrator: tuple[float, float] | None
    oof: DataFrame
    cv: DataFrame
    test_scores: DataFrame
    metrics: DataFrame

    def score(self, df: DataFrame) -> DataFrame:
        s = score_rows(self.model, prepare_unlabelled(df, self.spec))
        p = platt(F.col("raw"), *self.calibrator) if self.calibrator else F.col("raw")
        return s.withColumn("pred_prob", p).withColumn("pred_prob_raw", F.col("raw")).withColumn("flagged", p >= self.spec.threshold)

    def save(self, path: str) -> None:
        """Model, then its meta row as JSON next to it."""
        self.model.write().overwrite().save(f"{path}/model")
        meta = self.metrics.select(
            F.array(*[F.lit(f) for f in self.spec.features]).alias("features"), F.lit(self.spec.threshold).alias("threshold"),
            F.lit(self.calibrator[0] if self.calibrator else None).cast("double").alias("platt_a"),
            F.lit(self.calibrator[1] if self.calibrator else None).cast("double").alias("platt_b"),
            F.lit(len(self.spec.features)).alias("n_features"), F.lit(self.spec.estimator).alias("estimator"), "roc_auc", "pr_auc",
        )
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def prepare_unlabelled(df: DataFrame, spec: TrainSpec) -> DataFrame:
    keep = [c for c in ("wallet", MARKET, LABEL) if c in df.columns]
    rest = [c for c in df.columns if c not in keep and c not in spec.features]
    m = D.model_matrix(df, list(spec.features), keep + rest).withColumn(WEIGHT, F.lit(1.0))
    return with_indicators(m, spec.features) if spec.missing_indicators else m


def evaluate(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """ROC-AUC, average precision and threshold metrics in one row."""
    return with_scalars(auc_and_ap(scored, score, LABEL), confusion(scored, threshold, score, LABEL))


def train(df: DataFrame, spec: TrainSpec) -> Trained:
    """Split, out-of-fold scores, calibration, refit on all training rows, test metrics.

    With a time split, the rows of ``val`` can fit the calibrator (``calibrate_on``) and stop
    the boosting (``early_stop``); they are never trained on.
    """
    prepared = materialize(prepare(split_rows(df, spec), spec))
    train_rows = prepared.filter(F.col("split") == "train")
    folded = materialize(fold_rows(train_rows, spec))
    oof = materialize(oof_predictions(folded, spec))
    due = folded.filter("fold > 0") if spec.folds == "time" else folded
    missing = unscored_rows(due, oof).count()
    if missing:
        raise ValueError(f"{missing} training rows have no out-of-fold score")
    held = prepared.filter(F.col("split") == "val")
    if (spec.early_stop or (spec.calibrate and spec.calibrate_on == "validation")) and not _usable(held):
        raise ValueError("the validation split must hold both classes")
    if spec.early_stop and spec.estimator == "boosting":
        marked = prepared.filter(F.col("split") != "test").withColumn("held_out", F.col("split") == "val")
        model = pipeline_for(spec, _total_weight(train_rows), "held_out").fit(marked)
    else:
        model = pipeline_for(spec, _total_weight(train_rows)).fit(train_rows)
    calibrator = None
    if spec.calibrate:
        calibrator = fit_calibrator(score_rows(model, held) if spec.calibrate_on == "validation" else oof)
    test = insider_score(score_rows(model, prepared.filter(F.col("split") == "test")), calibrator)
    cv = cv_summary(auc_and_ap(oof, "raw", LABEL, ["fold"]).withColumn("tag", F.lit(spec.estimator)))
    return Trained(spec, model, calibrator, oof, cv, test, evaluate(test, spec.threshold))


def leave_markets_out(df: DataFrame, spec: TrainSpec, markets: Sequence[str], width: int = WIDTH) -> DataFrame:
    """One fit and one row of test metrics per left-out market; ``width`` of them run at once."""
    def without(m: str) -> DataFrame:
        return train(df, replace(spec, split="pinned", test_markets=(m,))).metrics.withColumn("test_market", F.lit(m))

    return D.union_ragged(*side_by_side(df.sparkSession, [partial(without, m) for m in markets], width))


def train_all(df: DataFrame, specs: dict[str, TrainSpec], width: int = WIDTH) -> dict[str, Trained]:
    """Every specification trained on the same rows; ``width`` of them run at once."""
    return dict(zip(specs, side_by_side(df.sparkSession, [partial(train, df, s) for s in specs.values()], width)))


def train_best(df: DataFrame, specs: dict[str, TrainSpec], width: int = WIDTH) -> tuple[str, DataFrame, Trained]:
    """Train by every strategy and keep the one with the best out-of-fold average precision.

    Returns its name, the quality of all (the first name wins a tie) and the trained model.
    Strategies may differ in estimator, parameters, split and folds.
    """
    names = list(specs)
    trained = train_all(df, specs, width)
    quality = D.union_ragged(*[trained[n].cv.withColumn("tag", F.lit(n)) for n in names])
    best = quality.orderBy(F.col("cv_mean").desc_nulls_last(), F.array_position(F.array(*[F.lit(n) for n in names]), F.col("tag"))).first()["tag"]
    return best, quality.withColumn("is_best", F.col("tag") == best), trained[best]


# ----------------------------------------------------------------------- tuning

class AveragePrecision(Evaluator):
    """Exact average precision (Spark's area under PR interpolates and bins)."""

    def _evaluate(self, dataset: DataFrame) -> float:
        s = dataset.select(F.col(LABEL).alias("label"), probability().alias("score"))
        value = auc_and_ap(s).first()["pr_auc"]
        return float(value) if value is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True


def param_grid(stage, grid: dict[str, Sequence]) -> list:
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(getattr(stage, name), list(values))
    return b.build()


def tune(folded: DataFrame, spec: TrainSpec, grid: dict[str, Sequence], parallelism: int = 2):
    """Grid search by average precision over the given fold column."""
    p = pipeline_for(spec, _total_weight(folded))
    cv = CrossValidator(
        estimator=p, estimatorParamMaps=param_grid(p.getStages()[-1], grid), evaluator=AveragePrecision(),
        numFolds=spec.n_folds, foldCol="fold", parallelism=parallelism, seed=spec.seed,
    )
    return cv.fit(folded)


def random_param_sets(space: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """``n`` distinct parameter sets drawn from a grid."""
    import random

    sets = [dict(zip(space, v)) for v in product(*space.values())]
    random.Random(seed).shuffle(sets)
    return sets[:n]


def search(folded: DataFrame, specs: dict[str, TrainSpec], width: int = WIDTH) -> DataFrame:
    """Out-of-fold quality of several specifications (parameter sets or strategies), best first."""
    found = side_by_side(folded.sparkSession, [partial(oof_predictions, folded, s) for s in specs.values()], width)
    parts = [p.select("*", F.lit(n).alias("tag")) for n, p in zip(specs, found)]
    return auc_and_ap(D.union_ragged(*parts), "raw", LABEL, ["tag"]).orderBy(F.col("pr_auc").desc_nulls_last(), "tag")


def tune_penalty(folded: DataFrame, spec: TrainSpec, cs: Sequence[float], threshold: float = 0.5, width: int = WIDTH) -> DataFrame:
    """Penalty grid for the logistic model: by AUC, then accuracy, then the smaller C."""
    specs = [replace(spec, estimator="logistic", params={**spec.params, "c": c}) for c in cs]
    found = side_by_side(folded.sparkSession, [partial(oof_predictions, folded, s) for s in specs], width)
    parts = [p.withColumn("c", F.lit(float(c))) for c, p in zip(cs, found)]
    oof = D.union_ragged(*parts)
    acc = oof.groupBy("c").agg(F.avg(((F.col("raw") >= threshold) == (F.col(LABEL) == 1)).cast("double")).alias("accuracy"))
    return auc_and_ap(oof, "raw", LABEL, ["c"]).join(acc, "c").orderBy(F.col("roc_auc").desc(), F.col("accuracy").desc(), "c")


def nested_cv(df: DataFrame, spec: TrainSpec, cs: Sequence[float], outer: int = 3) -> DataFrame:
    """Outer folds scored by the penalty that the inner folds of the rest prefer."""
    outer_df = D.row_folds(df, outer, spec.seed).withColumnRenamed("fold", "outer_fold")
    outer_df = materialize(outer_df)
    parts = []
    for k in range(outer):
        rest = prepare(D.row_folds(outer_df.filter(F.col("outer_fold") != k).drop("outer_fold"), spec.n_folds, spec.seed + 1), spec)
        best = tune_penalty(rest, spec, cs).first()["c"]
        chosen = replace(spec, estimator="logistic", params={**spec.params, "c": best})
        model = pipeline_for(chosen, _total_weight(rest)).fit(rest)
        held = prepare(outer_df.filter(F.col("outer_fold") == k), spec)
        parts.append(score_rows(model, held).select("wallet", MARKET, LABEL, "raw", F.lit(k).alias("fold"), F.lit(best).alias("c")))
    return D.union_ragged(*parts)


# ------------------------------------------------------------------- inspection

def importances(model: PipelineModel, spec: TrainSpec) -> DataFrame:
    """Importance per feature (absolute coefficient for linear models)."""
    last = model.stages[-1]
    names = list(spec.features) + ([f"{c}__null" for c in spec.features] if spec.missing_indicators else [])
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = [(n, float(abs(v))) for n, v in zip(names, values.toArray())]
    return _session().createDataFrame(rows, "feature string, importance double")


def coefficients(model: PipelineModel, spec: TrainSpec) -> DataFrame:
    last = model.stages[-1]
    rows = [(n, float(v)) for n, v in zip(spec.features, last.coefficients.toArray())]
    return _session().createDataFrame(rows, "feature string, coef double")


def select_features(model: PipelineModel, spec: TrainSpec, k: int) -> list[str]:
    """Names of the k most important features (at most the feature list is collected)."""
    top = importances(model, spec).orderBy(F.col("importance").desc(), "feature").limit(k)
    return [r["feature"] for r in top.collect()]


def parameter_count(model: PipelineModel) -> int:
    """Nodes of a tree ensemble, coefficients plus intercept of a linear model."""
    last = model.stages[-1]
    return int(last.totalNumNodes) if hasattr(last, "totalNumNodes") else int(last.coefficients.size) + 1


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()
