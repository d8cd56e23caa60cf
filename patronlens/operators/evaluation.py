"""Time split and model evaluation as distributed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.fixed_values import HOLDOUT_FRACTION, LABEL_COLUMN
from patronlens.functions.values import count_where, exact_mean
from patronlens.operators.order_statistics import quantiles
from patronlens.sources.storage import stash


# --- time split ------------------------------------------------------------------------------

def cutoff_date(panel: DataFrame, holdout_fraction: float = HOLDOUT_FRACTION) -> Column:
    """The first held-out snapshot date, as a scalar subquery.

    Only the distinct dates, one per month, are collected into the sorted array.
    """
    dates = panel.select("snapshot_date").distinct().agg(
        F.sort_array(F.collect_list("snapshot_date")).alias("dates")
    )
    at = F.floor(F.size("dates") * F.lit(1 - holdout_fraction)).cast("int")
    chosen = F.when(at < F.size("dates"), F.element_at("dates", at + 1)).otherwise(
        F.raise_error(F.lit("the hold-out fraction leaves no test dates"))
    )
    return dates.select(chosen.alias("cutoff")).scalar()


def time_split(panel: DataFrame, holdout_fraction: float = HOLDOUT_FRACTION) -> tuple[DataFrame, DataFrame]:
    """(train, test) by snapshot date; never by row."""
    cutoff = cutoff_date(panel, holdout_fraction)
    return panel.filter(F.col("snapshot_date") < cutoff), panel.filter(F.col("snapshot_date") >= cutoff)


def time_split_summary(panel: DataFrame, holdout_fraction: float = HOLDOUT_FRACTION) -> DataFrame:
    cutoff = cutoff_date(panel, holdout_fraction)
    return (
        panel.groupBy(F.when(F.col("snapshot_date") < cutoff, "train").otherwise("test").alias("split"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("snapshot_date").alias("first_date"),
            F.max("snapshot_date").alias("last_date"),
        )
    )


# --- label statistics ------------------------------------------------------------------------

def label_balance(panel: DataFrame, label: str = LABEL_COLUMN) -> DataFrame:
    """Share of each label value. The window runs over the label values, not the rows."""
    counts = panel.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    total = panel.agg(F.count(F.lit(1))).scalar()
    return counts.select(label, "n_rows", F.round(F.col("n_rows") / total, 6).alias("share"))


def class_weight(train: DataFrame, label: str = LABEL_COLUMN) -> DataFrame:
    """One row: negatives, positives and their ratio, the weight of a positive row."""
    counts = train.agg(
        count_where(F.col(label) == 0).alias("negatives"), count_where(F.col(label) == 1).alias("positives")
    )
    return counts.withColumn(
        "positive_weight", F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives"))
    )


# --- evaluation of (score, label) rows -------------------------------------------------------

def roc_auc(scored: DataFrame, score: str = "churn_probability", label: str = LABEL_COLUMN) -> DataFrame:
    """Area under the ROC curve from rank sums, ties counting half; one row.

    Rows are first merged by distinct score. The running count of lower-scored
    negatives needs a total order: the distinct scores are range-partitioned and stored
    with their part number, running sums run inside the parts, and the totals of the
    earlier parts (one row per part) are added on top.
    """
    by_score = scored.groupBy(score).agg(
        count_where(F.col(label) == 1).alias("positives"), count_where(F.col(label) == 0).alias("negatives")
    )
    parts = stash(by_score.repartitionByRange(score).withColumn("part", F.spark_partition_id()), "auc")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.sum("negatives").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    pairs = parts.withColumn("below", F.coalesce(F.sum("negatives").over(inside), F.lit(0))).join(offsets, "part")
    # twice the pair count stays a whole number, so the sum is exact
    won = F.sum((F.col("positives") * (2 * (F.col("before") + F.col("below")) + F.col("negatives"))).cast("decimal(38,0)"))
    return pairs.agg(
        won.alias("won"), F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives")
    ).select(
        "positives",
        "negatives",
        F.when(
            (F.col("positives") > 0) & (F.col("negatives") > 0),
            F.round(F.col("won").cast("double") / 2 / F.col("positives") / F.col("negatives"), 6),
        ).alias("roc_auc"),
    )


def classification_report(
    scored: DataFrame, score: str = "churn_probability", label: str = LABEL_COLUMN, threshold: float = 0.5
) -> DataFrame:
    """Precision, recall, F1 and support per class plus accuracy, macro and weighted rows.

    The rows are reduced to the four confusion counts at once; an undefined ratio is 0.
    """
    predicted, actual = F.col(score) >= threshold, F.col(label) == 1
    counts = scored.agg(
        count_where(predicted & actual).alias("tp"),
        count_where(predicted & ~actual).alias("fp"),
        count_where(~predicted & actual).alias("fn"),
        count_where(~predicted & ~actual).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def safe(a: Column, b: Column) -> Column:
        return F.when(b != 0, a / b).otherwise(0.0)

    def metrics(hit: Column, false_hit: Column, miss: Column) -> tuple[Column, Column, Column, Column]:
        return safe(hit, hit + false_hit), safe(hit, hit + miss), safe(2 * hit, 2 * hit + false_hit + miss), hit + miss

    zero, one = metrics(tn, fn, fp), metrics(tp, fp, fn)
    total = tp + fp + fn + tn
    accuracy = safe(tp + tn, total)
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3])]
    weighted = [safe(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3])]

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            F.round(precision, 6).alias("precision"),
            F.round(recall, 6).alias("recall"),
            F.round(f1, 6).alias("f1_score"),
            support.cast("long").alias("support"),
        )

    lines = F.array(
        line("0", *zero),
        line("1", *one),
        line("accuracy", accuracy, accuracy, accuracy, total),
        line("macro avg", *macro, total),
        line("weighted avg", *weighted, total),
    )
    return counts.select(F.inline(lines))


def calibration_table(
    scored: DataFrame,
    score: str = "churn_probability",
    label: str = LABEL_COLUMN,
    buckets: int = 10,
) -> DataFrame:
    """Mean prediction and outcome per quantile bucket; equal edges merge buckets."""
    edges = sorted(set(quantiles(scored, score, [i / buckets for i in range(buckets + 1)])))
    inner = edges[1:-1]
    bucket = sum(((F.col(score) > e).cast("int") for e in inner), F.lit(1))
    return (
        scored.filter(F.col(score).isNotNull())
        .groupBy(bucket.alias("bucket"))
        .agg(
            F.round(exact_mean(F.col(score)), 6).alias("mean_pred"),
            F.round(F.avg(label), 6).alias("mean_actual"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )
