"""Registered queries on fills, series, lots and behavioural features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fillsight import fixtures as X
from fillsight.plans import behavior as PB
from fillsight.plans.behavior import Behavior

QUERIES = {}
_contexts: dict[tuple, Behavior] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def context(spark: SparkSession, sf: str) -> Behavior:
    """Frames shared by the queries of one session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _contexts:
        _contexts[key] = Behavior(X.fills(spark, sf), X.markets(spark, sf))
    return _contexts[key]


def reset() -> None:
    """Drop the shared frames (used between timed runs)."""
    _contexts.clear()


def r(df: DataFrame, places: int = 8) -> DataFrame:
    """Round double columns so engines summing in different order agree."""
    return df.select(*[
        (F.round(f"`{f.name}`", places) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema
    ])


def _family(name: str, family: str, keys=("market_slug", "wallet")):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return r(context(spark, sf).family(family))

    run.__name__ = name
    QUERIES[name] = run


for _n, _f in {
    "entry_features": "entry", "unrealized_features": "unrealized", "holding_features": "holding", "path_features": "path",
    "markout_grid": "grid", "fixed_markouts": "fixed", "realized_features": "realized", "contrarian_features": "contrarian",
    "extreme_features": "extreme", "day_features": "days", "adaptive_features": "adaptive", "major_moves": "major",
}.items():
    _family(_n, _f)


@query
def behavior_vector(spark, sf):
    return r(context(spark, sf).features().withColumns({c: F.col(c).cast("double") for c in PB.EXTREME + PB.DAYS}))
