"""Per-row feature attribution for the boosted trees (path-dependent tree SHAP).

Values follow the published algorithm (Lundberg et al. 2018, arXiv:1802.03888). With
trees of depth d a leaf depends on at most d features, and its contribution is fixed
by which of them satisfy the leaf's conditions. So each leaf gets a table with one row
per combination (at most 2^d) ahead of time, and explaining a batch of rows is a table
lookup per leaf. Batches are explained where they lie; nothing is shuffled.

Impacts are in log-odds, so base value + impacts = log-odds of the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronlens.fixed_values import TOP_FEATURES
from patronlens.operators.training import model_columns, model_features, tree_nodes

ROWS_PER_STEP = 256


@dataclass
class LeafGroup:
    """Leaves that depend on the same number of features."""

    feature: np.ndarray  # leaf x feature: model column
    low: np.ndarray  # satisfied if low < x <= high
    high: np.ndarray
    table: np.ndarray  # leaf x combination of satisfied features x feature


def _leaf_paths(nodes: dict[int, tuple], scale: float) -> Iterator[tuple[float, float, dict]]:
    """(value, reach, {column: [low, high, share]}) of each leaf, starting at node 0."""
    stack = [(0, {}, 1.0)]
    while stack:
        node, path, reach = stack.pop()
        value, cover, left, right, column, threshold = nodes[node]
        if left < 0:
            yield scale * value, reach, path
            continue
        for child, is_left in ((left, True), (right, False)):
            share = nodes[child][1] / cover
            low, high, old = path.get(column, (-np.inf, np.inf, 1.0))
            bounds = (low, min(high, threshold)) if is_left else (max(low, threshold), high)
            stack.append((child, {**path, column: (*bounds, old * share)}, reach * share))


def _tables(value: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of each leaf for each combination of satisfied features."""
    leaves, m = share.shape
    out = np.zeros((leaves, 2**m, m))
    for code in range(2**m):
        on = [j for j in range(m) if code >> j & 1]
        for j in range(m):
            others = [g for g in range(m) if g != j]
            weight = np.zeros(leaves)
            for size in range(len(others) + 1):
                coefficient = factorial(size) * factorial(m - size - 1) / factorial(m)
                for chosen in combinations(others, size):
                    if all(g in on for g in chosen):
                        rest = [g for g in others if g not in chosen]
                        weight += coefficient * share[:, rest].prod(axis=1)
            out[:, code, j] = value * weight * ((j in on) - share[:, j])
    return out


def leaf_groups(spark: SparkSession, model: PipelineModel) -> tuple[list[LeafGroup], float]:
    """Lookup tables and base value. Reads one small row per tree node."""
    gbt = model.stages[-1]
    trees = tree_nodes(spark, gbt)
    base, by_size = 0.0, {}
    for tree, nodes in trees.items():
        # the probability is 1 / (1 + exp(-2 F)), so log-odds are 2 F
        for value, reach, path_of in _leaf_paths(nodes, 2.0 * gbt.treeWeights[tree]):
            base += value * reach
            if path_of:
                by_size.setdefault(len(path_of), []).append((value, path_of))
    groups = []
    for leaves in by_size.values():
        columns = np.array([list(p) for _, p in leaves])
        bounds = np.array([list(p.values()) for _, p in leaves])
        values = np.array([v for v, _ in leaves])
        groups.append(LeafGroup(columns, bounds[..., 0], bounds[..., 1], _tables(values, bounds[..., 2])))
    return groups, base


def impacts(groups: list[LeafGroup], x: np.ndarray) -> np.ndarray:
    """Row x model column."""
    out = np.zeros_like(x)
    for g in groups:
        leaf = np.arange(len(g.feature))
        m = g.feature.shape[1]
        to_column = np.zeros((m, len(leaf), x.shape[1]))
        for j in range(m):
            to_column[j, leaf, g.feature[:, j]] = 1.0
        for start in range(0, len(x), ROWS_PER_STEP):
            part = x[start : start + ROWS_PER_STEP]
            code = np.zeros((len(part), len(leaf)), dtype=np.int64)
            for j in range(m):
                seen = part[:, g.feature[:, j]]
                code |= ((seen > g.low[:, j]) & (seen <= g.high[:, j])).astype(np.int64) << j
            for j in range(m):
                out[start : start + ROWS_PER_STEP] += g.table[leaf, code, j] @ to_column[j]
    return out


def top_features(impacts_by_name: list[tuple[str, Column]], count: int = TOP_FEATURES) -> Column:
    """The ``count`` largest impacts by size as an array of (name, impact)."""
    entries = F.array(
        *[
            F.struct((-F.abs(impact)).alias("rank"), F.lit(i).alias("position"), F.lit(name).alias("name"), impact.alias("impact"))
            for i, (name, impact) in enumerate(impacts_by_name)
        ]
    )
    return F.transform(
        F.slice(F.array_sort(entries), 1, count),
        lambda e: F.struct(e["name"].alias("name"), F.round(e["impact"], 4).alias("impact")),
    )


def attribute(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``customer_id, snapshot_date, churn_probability, base_value, impact_<feature>...``

    The value and missing-flag columns of a feature share one impact.
    """
    features = model_features(model)
    columns = model_columns(features)
    groups, base = leaf_groups(rows.sparkSession, model)
    shared = rows.sparkSession.sparkContext.broadcast(groups)
    scored = model.transform(rows).select(
        "customer_id",
        "snapshot_date",
        vector_to_array("probability")[1].alias("churn_probability"),
        *columns,
    )
    out_names = [f"impact_{f}" for f in features]
    schema = T.StructType(
        scored.schema.fields[:3] + [T.StructField(n, T.DoubleType()) for n in ["base_value", *out_names]]
    )

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by_column = impacts(shared.value, batch[columns].to_numpy(dtype=float))
            by_feature = by_column.reshape(len(batch), len(features), 2).sum(axis=2)
            out = batch[["customer_id", "snapshot_date", "churn_probability"]].copy()
            out["base_value"] = base
            out[out_names] = by_feature
            yield out

    return scored.mapInPandas(explain, schema)


def explanations(attributed: DataFrame, count: int = TOP_FEATURES) -> DataFrame:
    """Rounded probability and the top features of every row."""
    named = [(c.removeprefix("impact_"), F.col(c)) for c in attributed.columns if c.startswith("impact_")]
    return attributed.select(
        "customer_id",
        F.col("snapshot_date").cast("date").alias("snapshot_date"),
        F.round("churn_probability", 4).alias("churn_probability"),
        top_features(named, count).alias("top_features"),
    )
