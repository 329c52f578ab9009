"""Isolation forest: trees on hashed sub-samples, scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fillsight.operators.dataset import hash_order
from fillsight.operators.scan import percentiles, with_scalars
from fillsight.session import materialize

NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, size int, depth int"


def path_norm(n: float) -> float:
    """Average path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int, tree: int) -> list[tuple]:
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, "")]
    while stack:
        rows, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, len(rows), depth])
        if parent >= 0:
            nodes[parent][4 if side == "l" else 5] = me
        sub = x[rows]
        span = np.flatnonzero(sub.max(axis=0) > sub.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(span) == 0:
            continue
        f = int(rng.choice(span))
        cut = float(rng.uniform(sub[:, f].min(), sub[:, f].max()))
        low = sub[:, f] <= cut
        nodes[me][2:4] = [f, cut]
        stack.append((rows[~low], depth + 1, me, "r"))
        stack.append((rows[low], depth + 1, me, "l"))
    return [tuple(n) for n in nodes]


def medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Median of each feature (0 where it has no value); one row comes back."""
    row = df.agg(*[F.median(F.col(c).cast("double")).alias(c) for c in features]).first()
    return {c: 0.0 if row[c] is None else float(row[c]) for c in features}


def fit_forest(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], n_trees: int = 100, sample: int = 256, seed: int = 42,
    fill: dict[str, float] | None = None,
) -> DataFrame:
    """Node table of the forest; every tree has its own draw of ``sample`` rows.

    A row is offered to a tree when a hash of (row, tree) falls under a rate that gives about
    twice the rows needed; the first ``sample`` of them by hash are taken, so trees overlap
    and each has its full sample whatever the input size. Missing values become medians.
    """
    fill = fill or medians(df, features)
    x = df.select(*keys, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) for c in features]).alias("x"))
    x = x.withColumn("_h", hash_order(seed, *keys))
    rate = min(1.0, (2 * sample + 64) / max(df.count(), 1))
    bits = 1 << 30
    draw = lambda t: F.pmod(F.xxhash64("_h", t), F.lit(bits)) < int(rate * bits)
    offered = x.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), draw)))
    order = Window.partitionBy("tree").orderBy(F.xxhash64("_h", "tree"), *keys)
    part = offered.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample).select("tree", "_n", "x")
    limit = math.ceil(math.log2(max(sample, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        tree = int(pdf["tree"].iloc[0])
        rows = _grow(np.vstack(pdf["x"].to_numpy()), np.random.default_rng([seed, tree]), limit, tree)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "left", "right", "size", "depth"])

    return part.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def score_forest(
    df: DataFrame, forest: DataFrame, features: Sequence[str], contamination: float | None = 0.1, fill: dict[str, float] | None = None
) -> DataFrame:
    """Anomaly score in (0, 1), decision (negative = anomalous) and flag.

    The forest has at most ``2 * sample`` nodes per tree, a size fixed by its
    parameters, so it travels to the tasks as a broadcast value. The cut is the score
    percentile given by ``contamination``, or 0.5 without one.
    """
    spark = df.sparkSession
    fill = fill or medians(df, features)
    nodes = forest.toPandas().sort_values(["tree", "node"])
    trees = [g for _, g in nodes.groupby("tree")]
    packed = [
        {c: g[c].to_numpy() for c in ("feature", "cut", "left", "right")}
        | {"length": g["depth"].to_numpy() + np.array([path_norm(s) for s in g["size"]])}
        for g in trees
    ]
    norm = path_norm(float(np.mean([g["size"].iloc[0] for g in trees])))
    shared = spark.sparkContext.broadcast(packed)
    cols = list(features)
    out_schema = T.StructType([*df.schema.fields, T.StructField("anomaly_score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest_ = shared.value
        for pdf in batches:
            x = pdf[cols].astype(float).fillna(fill).to_numpy()
            total = np.zeros(len(x))
            for t in forest_:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = t["feature"][at]
                    live = np.flatnonzero(f >= 0)
                    if len(live) == 0:
                        break
                    low = x[live, f[live]] <= t["cut"][at[live]]
                    at[live] = np.where(low, t["left"][at[live]], t["right"][at[live]])
                total += t["length"][at]
            yield pdf.assign(anomaly_score=np.power(2.0, -total / len(forest_) / norm))

    scored = df.mapInPandas(run, out_schema)
    if contamination is None:
        cut = F.lit(0.5)
        return scored.withColumn("anomaly_decision", cut - F.col("anomaly_score")).withColumn("anomaly", F.col("anomaly_score") > cut)
    scored = materialize(scored)
    one = scored.select(F.lit(0).alias("_one"), "anomaly_score")
    bound = percentiles(one, ["_one"], "anomaly_score", {"_cut": 1 - contamination}, split=True).select("_cut")
    s = with_scalars(scored, bound)
    return s.withColumn("anomaly_decision", F.col("_cut") - F.col("anomaly_score")).withColumn("anomaly", F.col("anomaly_score") > F.col("_cut")).drop("_cut")
