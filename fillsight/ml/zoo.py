"""Many trained models scored in one pass over the rows.

A trained pipeline is flattened once: medians of the imputer, and coefficients with the means
and deviations of the scaler, or the nodes of all trees as arrays. Rows are read once for any
number of models; every Arrow batch is imputed and walked through all of them at once, and
each row leaves one result per model. What is sent to the executors is the arrays, whose
size is that of the models.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import ImputerModel, StandardScalerModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from fillsight.ml.train import Trained
from fillsight.schema import MARKET
from fillsight.session import shared_folder

KEYS = ["wallet", MARKET]


@dataclass
class FlatModel:
    """Arrays of one trained model; ``apply`` gives the probability of the positive class."""

    features: tuple[str, ...]
    threshold: float
    medians: np.ndarray
    indicators: bool
    calibrator: tuple[float, float] | None
    link: str  # average of the trees, sigmoid of their sum, or linear
    # linear: coefficients on raw values, intercept. Trees: one entry per node of all of them.
    coefficients: np.ndarray | None = None
    intercept: float = 0.0
    roots: np.ndarray | None = None
    weights: np.ndarray | None = None
    feature: np.ndarray | None = None
    cut: np.ndarray | None = None
    left: np.ndarray | None = None
    right: np.ndarray | None = None
    value: np.ndarray | None = None
    depth: int = 0

    def apply(self, x: np.ndarray) -> np.ndarray:
        missing = np.isnan(x)
        x = np.where(missing, self.medians, x)
        if self.indicators:
            x = np.concatenate([x, missing.astype(float)], 1)
        if self.link == "linear":
            return _sigmoid(x @ self.coefficients + self.intercept)
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):  # leaves point at themselves
            node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        total = self.value[node] @ self.weights
        return total / self.weights.sum() if self.link == "average" else _sigmoid(2 * total)

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw and calibrated probability."""
        raw = self.apply(x)
        if self.calibrator is None:
            return raw, raw
        a, b = self.calibrator
        return raw, _sigmoid(a * raw + b)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-v))


def flatten(spark: SparkSession, trained: Trained) -> FlatModel:
    """The arrays of a trained model; its trees are read from the table a saved model has of its nodes."""
    spec, model = trained.spec, trained.model
    imputer = next(s for s in model.stages if isinstance(s, ImputerModel))
    row = imputer.surrogateDF.first()
    medians = np.array([float(row[c]) for c in spec.features])
    base = dict(features=tuple(spec.features), threshold=float(spec.threshold), medians=medians, indicators=spec.missing_indicators and spec.estimator != "logistic",
                calibrator=trained.calibrator)
    last = model.stages[-1]
    if hasattr(last, "coefficients"):
        scaler = next(s for s in model.stages if isinstance(s, StandardScalerModel))
        std, mean = scaler.std.toArray(), scaler.mean.toArray()
        scale = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
        coefficients = last.coefficients.toArray() * scale
        return FlatModel(**base, link="linear", coefficients=coefficients, intercept=float(last.intercept - coefficients @ mean))
    return FlatModel(**base, link="average" if spec.estimator == "forest" else "sum", **_trees(spark, last))


def _trees(spark: SparkSession, model) -> dict:
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    n = "nodeData"
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", *[F.col(f"{n}.{c}").alias(c) for c in ("id", "prediction", "impurityStats", "leftChild", "rightChild")],
        F.col(f"{n}.split.featureIndex").alias("feature"), F.get(F.col(f"{n}.split.leftCategoriesOrThreshold"), F.lit(0)).alias("cut"),
    ).orderBy("treeID", "id").toPandas()  # the nodes of one model
    meta = spark.read.parquet(f"{path}/treesMetadata")
    weights = {r[0]: float(r[2]) for r in meta.collect()}
    tree, ids = nodes["treeID"].to_numpy(), nodes["id"].to_numpy()
    first = {t: int(np.flatnonzero(tree == t)[0]) for t in weights}
    offset = np.array([first[t] for t in tree])
    if not (ids == np.arange(len(ids)) - offset).all():
        raise ValueError("nodes of a tree are not numbered one after the other")
    here, left, right = np.arange(len(tree)), nodes["leftChild"].to_numpy(), nodes["rightChild"].to_numpy()
    leaf = left < 0
    classes = all(len(s) == 2 for s in nodes["impurityStats"])
    value = np.array([s[1] / (s[0] + s[1]) if s[0] + s[1] else 0.0 for s in nodes["impurityStats"]]) if classes else nodes["prediction"].to_numpy()
    left, right = np.where(leaf, here, left + offset), np.where(leaf, here, right + offset)
    roots, depth, level = np.array([first[t] for t in sorted(weights)]), 0, None
    level = roots
    while not leaf[level].all():
        level, depth = np.unique(np.concatenate([left[level], right[level]])), depth + 1
    return dict(
        roots=roots, weights=np.array([weights[t] for t in sorted(weights)]), feature=np.where(leaf, 0, nodes["feature"].to_numpy()),
        cut=np.where(leaf, 0.0, nodes["cut"].fillna(0.0).to_numpy()), left=left, right=right, value=value, depth=depth,
    )


def score_zoo(rows: DataFrame, models: Mapping[str, FlatModel], keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, model, raw, score, threshold, flagged: every row by every model, each on its own features.

    Features that ``rows`` lacks are missing values. The rows are scanned once.
    """
    keys, names = list(keys), list(models)
    union = list(dict.fromkeys(f for m in models.values() for f in m.features))
    safe = [f"f{i}" for i in range(len(union))]  # a feature may have the name of a key
    have = set(rows.columns)
    x = rows.select(*keys, *[(F.col(f"`{c}`").cast("double") if c in have else F.lit(None).cast("double")).alias(s) for c, s in zip(union, safe)])
    place = {m: [union.index(f) for f in models[m].features] for m in names}
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(dict(models))

    def run(batches):
        zoo = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            values = np.column_stack([b.column(s).cast(pa.float64()).to_numpy(zero_copy_only=False) for s in safe]) if safe else np.zeros((b.num_rows, 0))
            for name in names:
                raw, score = zoo[name].scores(values[:, place[name]])
                threshold = zoo[name].threshold
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k) for k in keys), pa.array([name] * b.num_rows), pa.array(raw), pa.array(score),
                     pa.array(np.full(b.num_rows, threshold)), pa.array(score >= threshold)],
                    names=[*keys, "model", "raw", "score", "threshold", "flagged"])

    return x.mapInArrow(run, f"{plain}, model string, raw double, score double, threshold double, flagged boolean")


def feature_lists(spark: SparkSession, models: Mapping[str, FlatModel]) -> DataFrame:
    """model, features: what each model reads."""
    return spark.createDataFrame([(m, list(f.features)) for m, f in models.items()], "model string, features array<string>")


def flatten_all(spark: SparkSession, trained: Mapping[str, Trained]) -> dict[str, FlatModel]:
    return {tag: flatten(spark, t) for tag, t in trained.items()}

