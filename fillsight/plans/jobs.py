"""Composite jobs: market scan, training-set build, pair audit, model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fillsight.ml.metrics import cv_summary, tune_threshold
from fillsight.ml.train import parameter_count
from fillsight.ml.zoo import FlatModel, flatten, score_zoo
from fillsight.operators import dataset as D, parsing as P
from fillsight.operators.scan import with_scalars
from fillsight.plans import report as R
from fillsight.plans.behavior import BEHAVIOR_COLUMNS, Behavior
from fillsight.plans.metadata import METADATA_COLUMNS, first_trades, metadata_features
from fillsight.schema import MARKET, MARKET_WALLET, MICRO
from fillsight.session import materialize
from fillsight.sources.tables import write_results

KEYS = list(MARKET_WALLET)


def wanted_families(features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Requested names divided into behavioural and metadata ones (unknown names stay NULL)."""
    return [f for f in features if f in BEHAVIOR_COLUMNS], [f for f in features if f in METADATA_COLUMNS]


def candidate_features(
    b: Behavior, features: Sequence[str], top_n: int, activity: DataFrame | None = None, deposits: DataFrame | None = None,
    transfers: DataFrame | None = None, flagged: DataFrame | None = None,
) -> DataFrame:
    """Feature rows of the largest wallets per market (``top_n=0``: all wallets).

    Prices and series always come from all fills; wallet-level work is cut to the
    candidates before any per-wallet family runs.
    """
    behavior, metadata = wanted_families(features)
    # read by the cut of the trades, their split plan and the result: counted once
    top = b._keep(P.top_wallets(b.trades, top_n).select(
        *KEYS, (F.col("volume_micro") / MICRO).alias("volume"), "n_trades", "first_trade_ts"
    ))
    picked = Behavior(b.fills, b.markets, b.same_timestamp, b.max_group_rows, b.early_frac, b.threshold, b.stage)
    for shared in ("history", "heavy", "few_markets"):
        picked.__dict__[shared] = getattr(b, shared)
    picked.__dict__["trades"] = b.trades.join(top.select(*KEYS), KEYS, "left_semi") if top_n else b.trades
    out = top.join(picked.features(behavior), KEYS, "left") if behavior else top
    if metadata:
        pairs = top.select("wallet", MARKET, F.col("first_trade_ts").alias("as_of_ts"))
        m = metadata_features(pairs, activity, b.markets, deposits, transfers, flagged)
        out = out.join(m.select("wallet", MARKET, *metadata), ["wallet", MARKET], "left")
    return out


def market_scan(b: Behavior, model, top_n: int = 100, **sources) -> tuple[DataFrame, DataFrame]:
    """Rank, score and flag wallets; returns the scored rows and the per-market summary.

    ``model`` is a trained model with ``spec`` and ``score``.
    """
    rows = candidate_features(b, model.spec.features, top_n, **sources)
    scored = model.score(rows)
    keep = [c for c in ("wallet", MARKET, "pred_prob", "pred_prob_raw", "flagged", "volume", "n_trades", "first_trade_ts") if c in scored.columns]
    lean = scored.select(*keep, *[c for c in model.spec.features if c in scored.columns])
    return lean, R.scan_summary(lean)


def scan_job(b: Behavior, model, path: str, top_n: int = 100, fmt: str = "parquet", **sources) -> tuple[DataFrame, DataFrame]:
    """``market_scan`` into its sinks: all rows, the flagged ones, and the summary of each market.

    Rows carry the model's features in its own order after the lead columns. What is returned is
    read back from the sinks' tables, so nothing is computed twice.
    """
    rows, _ = market_scan(b, model, top_n, **sources)
    rows = materialize(rows)
    write_results(rows, path, fmt)
    summary = materialize(R.scan_summary(rows))
    summary.write.mode("overwrite").option("header", True).format(fmt).save(f"{path}/summary")
    return rows, summary


def training_set(
    b: Behavior, positives: DataFrame, known: DataFrame, per_positive: int = 6, features: Sequence[str] | None = None, seed: int = 42, **sources
) -> DataFrame:
    """Labelled feature rows: positives present in the fills and hash-drawn negatives.

    Only sampled pairs get per-wallet features; metadata joins one to one.
    """
    volumes = P.cash_volume(b.trades)
    pairs = D.labelled_set(volumes, positives, known, per_positive=per_positive, seed=seed)
    pairs = materialize(pairs)
    behavior, metadata = wanted_families(features or (*BEHAVIOR_COLUMNS, *METADATA_COLUMNS))
    part = Behavior(b.fills, b.markets, b.same_timestamp, b.max_group_rows, b.early_frac, b.threshold, b.stage)
    part.__dict__["history"] = b.history
    part.__dict__["trades"] = b.trades.join(pairs.select(*KEYS), KEYS, "left_semi")
    base = D.with_labels(part.features(behavior), pairs)
    if not metadata or "activity" not in sources:
        return base
    asof = first_trades(b.trades).join(pairs.select("wallet", MARKET), ["wallet", MARKET], "left_semi")
    m = metadata_features(asof, sources["activity"], b.markets, sources["deposits"], sources["transfers"], known)
    return D.strict_join(base, m, metadata, ["wallet", MARKET])


def audit_pairs(rows: DataFrame, models: dict, test_scores: dict[str, DataFrame] | None = None, target: float = 0.8) -> DataFrame:
    """Every model scores every pair with its own features and cut, in one pass over the pairs.

    ``models`` are trained ones or their flat form. ``test_scores`` (held-out rows with score and
    label per model) moves each model's cut to the best recall at the target precision;
    otherwise its own threshold holds.
    """
    spark = rows.sparkSession
    zoo = {tag: m if isinstance(m, FlatModel) else flatten(spark, m) for tag, m in models.items()}
    s = materialize(score_zoo(rows, zoo).drop("flagged"))
    if test_scores:
        held = D.union_ragged(*[t.select("score", F.col(D.LABEL).alias("label"), F.lit(tag).alias("model")) for tag, t in test_scores.items()])
        cuts = tune_threshold(held, target, by=["model"]).select("model", F.col("threshold").alias("_t"))
        s = s.join(F.broadcast(cuts), "model", "left").withColumn("threshold", F.coalesce("_t", "threshold")).drop("_t")  # one row per model
    out = s.withColumn("flagged", F.col("score") >= F.col("threshold"))
    return out.join(R.flag_counts(out, ["wallet", MARKET]), ["wallet", MARKET])


def model_rows(models: dict) -> DataFrame:
    """One row per trained model for the comparison reports: CV and test values, features, parameters."""
    parts = []
    for tag, t in models.items():
        cv = t.cv.select(F.col("cv_mean").alias("cv_pr"), F.col("cv_std"))
        test = t.metrics.select(F.col("pr_auc").alias("test_pr"), F.col("roc_auc").alias("test_roc"))
        parts.append(with_scalars(cv, test).select(
            F.lit(tag).alias("tag"), "cv_pr", "cv_std", "test_pr", "test_roc", F.lit(len(t.spec.features)).alias("n_features"),
            F.lit(parameter_count(t.model)).cast("bigint").alias("n_params")))
    return D.union_ragged(*parts)


def compare_models(models: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """Ranked model table with recommendation marks; ``folds`` (tag, fold, pr_auc) refreshes CV values."""
    m = models
    if folds is not None:
        s = cv_summary(folds).select("tag", F.col("cv_mean").alias("_m"), F.col("cv_std").alias("_s"))
        m = m.join(s, "tag", "left").withColumn("cv_pr", F.coalesce("_m", "cv_pr")).withColumn("cv_std", F.coalesce("_s", "cv_std")).drop("_m", "_s")
    rec = R.recommend(m)
    marked = with_scalars(R.rank_models(m), rec)
    return marked.select(
        *m.columns, "rank", *[(F.col("tag") == F.col(c)).alias(f"is_{c}") for c in ("best_cv", "best_test", "simple_test", "simple_cv")],
        (F.col("test_pr") < F.col("cv_pr")).alias("cv_optimistic"),
    )
