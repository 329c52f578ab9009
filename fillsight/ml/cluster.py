"""Cluster exploration: k-means sweep and assignment, projection onto the plane."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

KS = (2, 3, 4, 5, 6, 8, 10)


def standardized(df: DataFrame, columns: Sequence[str], apply_to: DataFrame | None = None) -> DataFrame:
    """Median-imputed, standardized ``features`` vector of the given columns.

    ``apply_to`` gets the medians, means and deviations of ``df`` instead of ``df`` itself.
    """
    filled = [f"{c}__i" for c in columns]
    imputer = Imputer(strategy="median", inputCols=list(columns), outputCols=filled, relativeError=0.0).fit(df)
    assembler = VectorAssembler(inputCols=filled, outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(assembler.transform(imputer.transform(df)))
    rows = df if apply_to is None else apply_to
    return scaler.transform(assembler.transform(imputer.transform(rows))).drop("_raw", *filled)


def from_array(df: DataFrame, column: str) -> DataFrame:
    """Standardized ``features`` vector of an array column."""
    d = df.withColumn("_raw", array_to_vector(F.col(column).cast("array<double>")))
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(d).transform(d).drop("_raw")


def kmeans_sweep(df: DataFrame, ks: Sequence[int] = KS, seed: int = 42) -> DataFrame:
    """Silhouette and cost per k (squared Euclidean distance)."""
    data = df.persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    for k in ks:
        m = KMeans(k=k, seed=seed, featuresCol="features").fit(data)
        s = ClusteringEvaluator(featuresCol="features").evaluate(m.transform(data))
        rows.append((k, float(s), float(m.summary.trainingCost)))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, cost double")


def kmeans_assign(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    m = KMeans(k=k, seed=seed, featuresCol="features").fit(df)
    return m.transform(df).withColumnRenamed("prediction", "cluster")


def project(df: DataFrame) -> DataFrame:
    """First two principal components as ``x`` and ``y``."""
    m = PCA(k=2, inputCol="features", outputCol="_pc").fit(df)
    xy = vector_to_array("_pc")
    return m.transform(df).withColumn("x", xy[0]).withColumn("y", xy[1]).drop("_pc")
