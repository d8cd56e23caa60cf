"""Churn model: gradient-boosted trees over the panel features.

The trees see a feature only by its bin, of which it has at most BINS. So values are binned
once, before the fit, and rows that agree in all bins and the label become one row that
weighs as much as all of them: the same sums and splits, over as many rows as there are
different ones. The bins belong to the model, which takes raw rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isfinite

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronlens.fixed_values import (
    FEATURE_COLUMNS,
    HOLDOUT_FRACTION,
    LABEL_COLUMN,
    LEARNING_RATE,
    PATIENCE,
    SEED,
    TREE_DEPTH,
    TREES,
)
from patronlens.operators.boosting import bin_edges
from patronlens.operators.evaluation import class_weight, cutoff_date
from patronlens.operators.panel import assert_no_leakage
from patronlens.sources.storage import scratch_path, stash

BINS = 32  # of a feature; as many as Spark's trees use
ROWS_PER_TASK = 20_000  # merged rows that one task fits, about
SCORE_CELLS = 1 << 20  # for the AUC of a round; scores in a cell count as equal
VALUE, MISSING = "__value", "__missing"


def model_columns(features: tuple[str, ...]) -> list[str]:
    """Per feature the bin of the value, of 0 where it is NULL, and a flag for NULL."""
    return [f + suffix for f in features for suffix in (VALUE, MISSING)]


def feature_edges(rows: DataFrame, features: tuple[str, ...], bins: int = BINS) -> list[list[float]]:
    """Per feature at most ``bins - 1`` edges; bin n holds the values above n of them.

    Edges are quantiles. Places that frequent values leave open, as they are several
    quantiles at once, go to quantiles of the other values. NULL counts as 0. Two scans.
    """
    values = rows.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    common = [[e for e in edges if isfinite(e)] for edges in bin_edges(values, features, bins + 1)]
    others = [F.when(~F.col(f).isin(edges), F.col(f)).alias(f) if edges else F.col(f) for f, edges in zip(features, common)]
    found = []
    for edges, rest in zip(common, bin_edges(values.select(*others), features, bins + 1)):
        rest, room = [e for e in rest if isfinite(e)], bins - 1 - len(edges)
        rest = rest if len(rest) <= room else [rest[n * len(rest) // room] for n in range(room)]
        found.append(sorted({*edges, *rest}))
    return found


def _bin(value: str, edges: list[float], below: int = 0) -> str:
    """The number of edges under a value, by halving."""
    if not edges:
        return f"{below}D"
    mid = len(edges) // 2
    left, right = _bin(value, edges[:mid], below), _bin(value, edges[mid + 1 :], below + mid + 1)
    return f"if({value} <= {edges[mid]!r}D, {left}, {right})"


def model_stages(features: tuple[str, ...], edges: list[list[float]], trees: int) -> tuple[SQLTransformer, VectorAssembler, GBTClassifier]:
    columns = ", ".join(
        f"{_bin(f'coalesce(cast({f} AS double), 0D)', of)} AS {f}{VALUE}, cast({f} IS NULL AS double) AS {f}{MISSING}"
        for f, of in zip(features, edges)
    )
    return (
        SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__"),
        VectorAssembler(inputCols=model_columns(features), outputCol="features_vector"),
        GBTClassifier(
            featuresCol="features_vector",
            labelCol="label",
            weightCol="row_weight",
            maxIter=trees,
            maxDepth=TREE_DEPTH,
            maxBins=BINS,
            stepSize=LEARNING_RATE,
            seed=SEED,
        ),
    )


def train(
    train_rows: DataFrame,
    features: tuple[str, ...] = FEATURE_COLUMNS,
    trees: int = TREES,
    validation_fraction: float = HOLDOUT_FRACTION,
    patience: int = PATIENCE,
) -> PipelineModel:
    """The model of ``train_rounds`` alone."""
    return train_rounds(train_rows, features, trees, validation_fraction, patience)[0]


def train_rounds(
    train_rows: DataFrame,
    features: tuple[str, ...] = FEATURE_COLUMNS,
    trees: int = TREES,
    validation_fraction: float = HOLDOUT_FRACTION,
    patience: int = PATIENCE,
) -> tuple[PipelineModel, list[float]]:
    """Fit the model on the training dates; also the AUC of every round.

    Positive rows weigh negatives / positives. ``trees`` rounds are fitted once, without the
    newest training dates, on which the AUC of every round is then taken; the test dates
    stay unseen. The model is cut to the rounds up to the best one, judged as if boosting
    had ended when ``patience`` rounds in a row brought no higher AUC. Pass a stored table:
    it is read several times. The trees are fitted on its merged rows.
    """
    assert_no_leakage(train_rows.select(*features))
    weight = class_weight(train_rows).first()["positive_weight"]
    if not weight:
        raise ValueError("training needs rows of both classes")
    label = F.col(LABEL_COLUMN).cast("double")
    is_validation = F.col("snapshot_date") >= cutoff_date(train_rows, validation_fraction)
    prepared = train_rows.select(*features, label.alias("label"), is_validation.alias("is_validation"))
    binning, assembler, gbt = model_stages(features, feature_edges(prepared.filter("NOT is_validation"), features), trees)
    columns = model_columns(features)
    merged = stash(
        binning.transform(prepared).groupBy("is_validation", "label", *columns).agg(F.count(F.lit(1)).alias("n_rows")),
        "training-rows",
    )
    one = F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(1.0)
    fitted = spread(merged.filter("NOT is_validation").withColumn("row_weight", one * F.col("n_rows")))
    model = PipelineModel([binning, assembler, gbt.fit(assembler.transform(fitted))])
    aucs = _merged_aucs(model, merged.filter("is_validation"))
    return cut(model, best_round([-auc for auc in aucs], patience)), aucs


def spread(stored: DataFrame) -> DataFrame:
    """The rows over as many tasks as they keep busy: few rows take one, many all cores."""
    tasks = max(1, ceil(stored.count() / ROWS_PER_TASK))
    return stored.repartition(min(tasks, stored.sparkSession.sparkContext.defaultParallelism))


def best_round(losses: list[float], patience: int) -> int:
    """The number of rounds with the least loss, if rounds end after ``patience`` ones without a lower one."""
    best = 0
    for n, loss in enumerate(losses):
        if loss < losses[best]:
            best = n
        elif n - best >= patience:
            break
    return best + 1


def cut(model: PipelineModel, trees: int) -> PipelineModel:
    """The model with its first ``trees`` trees only; nothing is fitted again."""
    gbt = model.stages[-1]
    if trees >= gbt.getNumTrees:
        return model
    context = SparkSession.active().sparkContext
    jvm, whole = context._jvm, gbt._java_obj
    kept = context._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, trees)
    weights = context._gateway.new_array(jvm.double, trees)
    for n, (tree, weight) in enumerate(zip(list(whole.trees())[:trees], whole.treeWeights())):
        kept[n], weights[n] = tree, weight
    smaller = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        whole.uid(), kept, weights, whole.numFeatures(), whole.numClasses()
    )
    params = whole.extractParamMap()
    return PipelineModel([*model.stages[:-1], GBTClassificationModel._from_java(smaller.copy(params))])


def tree_nodes(spark: SparkSession, gbt: GBTClassificationModel) -> dict[int, dict[int, tuple]]:
    """Of each tree and node: prediction, cover, children, feature and threshold. One small row per node."""
    path = scratch_path(spark, "trees")
    gbt.save(path)
    node = F.col("nodeData")
    rows = (
        spark.read.parquet(f"{path}/data")
        .select(
            "treeID",
            node["id"],
            node["prediction"],
            node["impurityStats"][0],
            node["leftChild"],
            node["rightChild"],
            node["split"]["featureIndex"],
            F.when(node["leftChild"] >= 0, node["split"]["leftCategoriesOrThreshold"][0]),
        )
        .collect()
    )
    trees: dict[int, dict[int, tuple]] = {}
    for tree, node_id, *rest in rows:
        trees.setdefault(tree, {})[node_id] = tuple(rest)
    return trees


def margins_by_round(trees: list[dict[int, tuple]], weights: list[float], x: np.ndarray) -> Iterator[np.ndarray]:
    """The rows' sums of weighted predictions after each tree."""
    total = np.zeros(len(x))
    for nodes, weight in zip(trees, weights):
        ids = sorted(nodes)
        value, left, right, column, threshold = (
            np.array([nodes[i][k] if nodes[i][k] is not None else -1 for i in ids]) for k in (0, 2, 3, 4, 5)
        )
        at = np.zeros(len(x), np.int64)
        while (inner := left[at] >= 0).any():
            goes_left = x[np.arange(len(x)), np.maximum(column[at], 0).astype(np.int64)] <= threshold[at]
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
        total = total + weight * value[at]
        yield total


def round_aucs(model: PipelineModel, rows: DataFrame, label: str = "label") -> list[float]:
    """The AUC of the first 1, 2, ... trees on ``rows``; 0.5 where they hold one class only."""
    columns = model_columns(model_features(model))
    binned = model.stages[0].transform(rows).select(*columns, F.col(label).alias("label"))
    return _merged_aucs(model, binned.groupBy("label", *columns).agg(F.count(F.lit(1)).alias("n_rows")))


def _merged_aucs(model: PipelineModel, merged: DataFrame) -> list[float]:
    """The AUCs on rows of bins and label that stand for ``n_rows`` each.

    Each task adds up its rows by round and score cell; the counts of all tasks are then
    summed and ranked round by round. A round has at most SCORE_CELLS cells, so no task
    grows with the rows.
    """
    gbt = model.stages[-1]
    by_tree = tree_nodes(merged.sparkSession, gbt)
    trees, weights = [by_tree[n] for n in sorted(by_tree)], gbt.treeWeights
    columns = model_columns(model_features(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            positive, held = batch["label"].to_numpy() == 1, batch["n_rows"].to_numpy()
            x = batch[columns].to_numpy(dtype=float)
            for n, margin in enumerate(margins_by_round(trees, weights, x)):
                p = 1.0 / (1.0 + np.exp(-2.0 * margin))
                cell, at = np.unique((p * SCORE_CELLS).astype(np.int64), return_inverse=True)
                # sums of whole numbers below 2**53 stay exact
                counts = [np.bincount(at[k], held[k], len(cell)).astype(np.int64) for k in (positive, ~positive)]
                yield pd.DataFrame({"round": n, "cell": cell, "positives": counts[0], "negatives": counts[1]})

    counted = merged.select("label", "n_rows", *columns).mapInPandas(run, "round int, cell long, positives long, negatives long")
    cells = counted.groupBy("round", "cell").agg(F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"))
    lower = Window.partitionBy("round").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("negatives").over(lower), F.lit(0))
    won = F.sum(F.col("positives").cast("double") * (F.col("below") + F.col("negatives") / 2))
    pairs = F.sum("positives").cast("double") * F.sum("negatives")
    aucs = (
        cells.withColumn("below", below)
        .groupBy("round")
        .agg(F.when(pairs > 0, won / pairs).otherwise(0.5).alias("auc"))
        .collect()
    )
    found = {r["round"]: r["auc"] for r in aucs}
    return [found.get(n, 0.5) for n in range(len(trees))]


def model_features(model: PipelineModel) -> tuple[str, ...]:
    """The raw features, as stored with the model."""
    inputs = model.stages[1].getInputCols()
    return tuple(c.removesuffix(VALUE) for c in inputs if c.endswith(VALUE))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` plus ``churn_probability``."""
    scored = model.transform(rows).withColumn("churn_probability", vector_to_array("probability")[1])
    return scored.select(*rows.columns, "churn_probability")
