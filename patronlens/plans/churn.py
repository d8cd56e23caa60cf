"""Train, evaluate, score and explain over the feature panel."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.fixed_values import LABEL_COLUMN, TREES
from patronlens.operators import attribution, boosting, evaluation, scoring, training
from patronlens.sources.storage import stash


def train_and_evaluate(panel: DataFrame, trees: int = TREES) -> tuple[PipelineModel, DataFrame]:
    """Fit on the older dates and report on the newest: (model, metric rows).

    Besides the model's metrics the rows hold the validation AUC of every round, and the
    test AUC and kept trees of the boosted trees that learn where missing values go.
    ``panel`` should be a stored table; published panels are partitioned by date, so
    the split reads only its own partitions.
    """
    older, newest = evaluation.time_split(panel)
    older = stash(older, "train-dates")
    model, aucs = training.train_rounds(older, trees=trees)
    scored = stash(
        training.predict(model, newest).select("churn_probability", LABEL_COLUMN), "scored-test"
    )
    booster = boosting.train(older, trees=trees)
    other = boosting.predict(booster, newest).select("churn_probability", LABEL_COLUMN)
    rows = [("model trees", "kept", float(model.stages[-1].getNumTrees))]
    rows += [("validation roc_auc", f"round {n}", auc) for n, auc in enumerate(aucs, 1)]
    rows += [("missing-aware model trees", "kept", float(len(booster.trees)))]
    rows += [("missing-aware model validation roc_auc", f"round {n}", auc) for n, auc in enumerate(booster.aucs, 1)]
    other_auc = evaluation.roc_auc(other).select(
        F.lit("missing-aware model ranking roc_auc").alias("metric"), F.lit("all").alias("detail"), F.col("roc_auc").alias("value")
    )
    rounds = newest.sparkSession.createDataFrame(rows, "metric string, detail string, value double")
    return model, metric_rows(scored).unionByName(rounds).unionByName(other_auc)


def metric_rows(scored: DataFrame) -> DataFrame:
    """AUC, classification report and calibration as (metric, detail, value) rows."""
    def rows(df: DataFrame, metric: str, detail: Column, columns: list[str]) -> DataFrame:
        entries = [
            F.struct(
                F.concat_ws(" ", F.lit(metric), F.lit(c)).alias("metric"),
                detail.cast("string").alias("detail"),
                F.col(c).cast("double").alias("value"),
            )
            for c in columns
        ]
        return df.select(F.inline(F.array(*entries)))

    parts = [
        rows(evaluation.roc_auc(scored), "ranking", F.lit("all"), ["roc_auc", "positives", "negatives"]),
        rows(
            evaluation.classification_report(scored),
            "class",
            F.col("label"),
            ["precision", "recall", "f1_score", "support"],
        ),
        rows(
            evaluation.calibration_table(scored),
            "calibration",
            F.col("bucket"),
            ["mean_pred", "mean_actual", "n_rows"],
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def score_latest(model: PipelineModel, panel: DataFrame, scored_at: Column | None = None) -> DataFrame:
    """Predictions for the latest snapshot of every customer."""
    latest = scoring.latest_snapshot(panel)
    scored = stash(
        training.predict(model, latest).select("customer_id", "snapshot_date", "churn_probability"), "scored"
    )
    return scoring.with_risk_bands(scored, scored_at)


def explain_latest(model: PipelineModel, panel: DataFrame) -> DataFrame:
    """Explanations for the latest snapshot of every customer."""
    return attribution.explanations(attribution.attribute(model, scoring.latest_snapshot(panel)))
