"""Boosted trees with second-order splits and a learned direction for missing values.

Features become bins once, between approximate quantiles; bin 0 holds the missing values.
Rows that agree in all bins, label and role become one row that counts for all of them. A tree grows level by level: one pass adds up gradients and hessians per node, feature and
bin inside every task, Spark sums them, and the driver takes at most nodes x features x
bins rows and picks each node's split, trying the missing values on both sides. The pass
of a tree's first level also counts the validation rows by score and label, which gives
the AUC of the trees so far. Training ends when it hasn't risen for ``patience`` rounds,
and the model is cut to its best round: rows are fitted once. Margins are stored every
STORED_EVERY trees, so a pass applies few trees and a lost executor costs little.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronlens.fixed_values import (
    FEATURE_COLUMNS,
    HOLDOUT_FRACTION,
    LABEL_COLUMN,
    LEARNING_RATE,
    PATIENCE,
    TREE_DEPTH,
    TREES,
)
from patronlens.operators.evaluation import class_weight, cutoff_date
from patronlens.operators.panel import assert_no_leakage
from patronlens.sources.storage import stash

BINS = 256  # of a feature, that of missing values included
SMOOTHING, LEAST_WEIGHT = 1.0, 1.0  # added to a node's hessian; least hessian of a child
STORED_EVERY = 10
SCORE_CELLS = 1 << 16  # for the AUC; scores in a cell count as equal
_UNIT = float(1 << 20)  # sums are whole multiples of 1 / _UNIT, the same in any order
_VALIDATION = -1
_HISTOGRAM = "node int, feature int, bin int, gradient long, hessian long"


@dataclass
class Tree:
    """Node i's children are 2 i + 1 and 2 i + 2; a leaf has feature -1."""

    feature: list[int]
    bin: list[int]  # present values up to this bin go left
    missing_left: list[bool]
    value: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls([-1] * n, [0] * n, [False] * n, [0.0] * n)

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each row (rows x features) after so many levels, or its leaf."""
        feature, limit, missing = (np.array(x) for x in (self.feature, self.bin, self.missing_left))
        at = np.zeros(len(bins), np.int64)
        depth = (len(self.feature) + 1).bit_length() - 2
        for _ in range(depth if levels is None else levels):
            f = feature[at]
            x = bins[np.arange(len(bins)), np.maximum(f, 0)]
            left = np.where(x == 0, missing[at], x <= limit[at])
            at = np.where(f < 0, at, 2 * at + np.where(left, 1, 2))
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Booster:
    """``edges`` of each feature: bin b holds the values above edges[b - 2] and up to edges[b - 1]."""

    features: tuple[str, ...]
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    aucs: list[float] = field(default_factory=list)  # of all rounds on the validation rows, those cut off included

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bins of rows x features; NaN is missing."""
        out = np.empty(values.shape, np.int16)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(values[:, j]), 0, np.searchsorted(edges, values[:, j], "left") + 1)
        return out

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        return sum((t.margins(bins) for t in self.trees[first:]), np.zeros(len(bins)))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Booster:
        of = json.loads(text)
        return cls(tuple(of["features"]), of["edges"], [Tree(**t) for t in of["trees"]], of["aucs"])


def bin_edges(rows: DataFrame, features: tuple[str, ...], bins: int = BINS) -> list[list[float]]:
    """Distinct approximate quantiles of each feature, at most ``bins - 2``, in one scan."""
    fractions = [i / (bins - 1) for i in range(1, bins - 1)]
    found = rows.agg(
        *[F.percentile_approx(F.col(f).cast("double"), fractions, 100 * bins).alias(f"q{j}") for j, f in enumerate(features)]
    ).first()
    return [sorted(set(q or [])) for q in found]


def _numbers(batch: pd.DataFrame, columns: tuple[str, ...] | list[str]) -> np.ndarray:
    return batch[list(columns)].to_numpy(dtype=float, na_value=np.nan)


def _binned(rows: DataFrame, booster: Booster) -> DataFrame:
    """The rows' bins as bytes, with label, weight, role, number of rows and a margin of 0; equal rows merged."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = booster.bins(_numbers(batch, booster.features))
            yield pd.DataFrame(
                {
                    "bins": [b.tobytes() for b in bins],
                    "label": batch["label"],
                    "weight": batch["weight"],
                    "validation": batch["validation"],
                }
            )

    columns = [F.col(f).cast("double").alias(f) for f in booster.features]
    schema = "bins binary, label double, weight double, validation boolean"
    binned = rows.select(*columns, "label", "weight", "validation").mapInPandas(run, schema)
    merged = binned.groupBy("bins", "label", "weight", "validation").agg(F.count(F.lit(1)).cast("double").alias("held"))
    return merged.withColumn("margin", F.lit(0.0))


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.int16).reshape(-1, width)
    return bins, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "validation", "held", "margin"))


def _with_margins(stored: DataFrame, booster: Booster, first: int) -> DataFrame:
    """The rows with the margins of the trees from ``first`` on added."""
    width = len(booster.features)

    def run(batches):
        for batch in batches:
            bins, *_, margin = _read(batch, width)
            at = batch.schema.get_field_index("margin")
            yield batch.set_column(at, "margin", pa.array(margin + booster.margins(bins, first)))

    return stored.mapInArrow(run, stored.schema)


def histogram(
    bins: np.ndarray, node: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, nodes: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sums per node x feature x bin."""
    width = bins.shape[1]
    cell = (node[:, None] * width + np.arange(width)) * BINS + bins
    size = nodes * width * BINS
    shape = (nodes, width, BINS)
    return tuple(
        np.bincount(cell.ravel(), np.repeat(x, width), minlength=size).reshape(shape) for x in (gradient, hessian)
    )


def _pass(booster: Booster, first: int, tree: Tree, level: int):
    """A task's sums for the nodes of one level; on the first level also the validation rows by score."""
    width, nodes = len(booster.features), 2**level

    def run(batches):
        sums = np.zeros((2, nodes, width, BINS))
        cells = np.zeros((2, SCORE_CELLS))
        for batch in batches:
            bins, label, weight, validation, held, margin = _read(batch, width)
            p = 1.0 / (1.0 + np.exp(-(margin + booster.margins(bins, first))))
            if level == 0 and validation.any():
                cell = np.minimum((p[validation] * SCORE_CELLS).astype(np.int64), SCORE_CELLS - 1)
                of = [label[validation] == k for k in (1, 0)]
                cells += [np.bincount(cell[k], held[validation][k], SCORE_CELLS) for k in of]
            at = tree.nodes(bins, level) - (nodes - 1)
            kept = ~validation & (at >= 0)  # rows in a leaf above are done
            weight = weight * held
            g, h = (weight * (p - label))[kept], (weight * p * (1 - p))[kept]
            sums += histogram(bins[kept], at[kept], g, h, nodes)
        node, feature, at = np.nonzero(sums[1])
        seen = np.flatnonzero(cells.sum(0))
        columns = [
            np.concatenate([node, np.full(len(seen), _VALIDATION)]).astype(np.int32),
            np.concatenate([feature, np.zeros(len(seen))]).astype(np.int32),
            np.concatenate([at, seen]).astype(np.int32),
            *(np.concatenate([np.rint(s[node, feature, at] * _UNIT), c[seen]]).astype(np.int64) for s, c in zip(sums, cells)),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "feature", "bin", "gradient", "hessian"])

    return run


def best_split(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, int, int, bool, tuple, tuple] | None:
    """The split of one node (feature x bin sums) with the most gain, or None if none gains.

    (gain, feature, last bin on the left, missing left, left sums, right sums). Ties go to
    the first feature, then to the lowest bin, then to missing values on the left.
    """
    g_all, h_all = gradient[0].sum(), hessian[0].sum()

    def worth(g, h):
        return g * g / (h + SMOOTHING)

    best = None
    for missing_left in (True, False):
        g = np.cumsum(gradient[:, 1:], axis=1) + (gradient[:, :1] if missing_left else 0)
        h = np.cumsum(hessian[:, 1:], axis=1) + (hessian[:, :1] if missing_left else 0)
        gain = worth(g, h) + worth(g_all - g, h_all - h) - worth(g_all, h_all)
        gain[(h < LEAST_WEIGHT) | (h_all - h < LEAST_WEIGHT)] = -np.inf
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        key = (-round(float(gain[f, b]), 9), int(f), int(b))
        if gain[f, b] > 1e-9 and (best is None or key < best[0]):
            left = float(g[f, b]), float(h[f, b])
            right = float(g_all - g[f, b]), float(h_all - h[f, b])
            best = key, (float(gain[f, b]), int(f), int(b) + 1, missing_left, left, right)
    return best and best[1]


def _leaf(g: float, h: float, rate: float) -> float:
    return -rate * g / (h + SMOOTHING)


def score_auc(positives: np.ndarray, negatives: np.ndarray) -> float:
    """Area under the ROC curve from counts by ascending score; 0.5 with one class only."""
    below = np.cumsum(negatives) - negatives
    pairs = float(positives.sum()) * float(negatives.sum())
    return float((positives * (below + negatives / 2)).sum() / pairs) if pairs else 0.5


def _sums(stored: DataFrame, booster: Booster, first: int, tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients and hessians by node, feature and bin, and the validation counts by score cell."""
    counted = stored.mapInArrow(_pass(booster, first, tree, level), _HISTOGRAM)
    found = counted.groupBy("node", "feature", "bin").agg(F.sum("gradient").alias("g"), F.sum("hessian").alias("h")).toArrow()
    node, feature, at, g, h = (found.column(c).to_numpy() for c in ("node", "feature", "bin", "g", "h"))
    sums, cells = np.zeros((2, 2**level, len(booster.features), BINS)), np.zeros((2, SCORE_CELLS))
    for x, out, scored in zip((g, h), sums, cells):
        out[node[node >= 0], feature[node >= 0], at[node >= 0]] = x[node >= 0] / _UNIT
        scored[at[node < 0]] = x[node < 0]
    return sums[0], sums[1], cells


def _grow(tree: Tree, level: int, gradients: np.ndarray, hessians: np.ndarray, rate: float) -> bool:
    """Split the nodes of a level; whether any was split."""
    split_any = False
    for n in range(2**level):
        at = 2**level - 1 + n
        split = best_split(gradients[n], hessians[n])
        if split is None:
            continue
        _, tree.feature[at], tree.bin[at], tree.missing_left[at], *sides = split
        for child, (g, h) in zip((2 * at + 1, 2 * at + 2), sides):
            tree.value[child] = _leaf(g, h, rate)
        split_any = True
    return split_any


def train(
    train_rows: DataFrame,
    features: tuple[str, ...] = FEATURE_COLUMNS,
    trees: int = TREES,
    depth: int = TREE_DEPTH,
    rate: float = LEARNING_RATE,
    validation_fraction: float = HOLDOUT_FRACTION,
    patience: int = PATIENCE,
) -> Booster:
    """Fit on the older of the training dates; the newest ones decide when to stop.

    Positive rows weigh negatives / positives. Pass a stored table.
    """
    assert_no_leakage(train_rows.select(*features))
    ratio = class_weight(train_rows).first()["positive_weight"]
    if not ratio:
        raise ValueError("training needs rows of both classes")
    label = F.col(LABEL_COLUMN).cast("double")
    prepared = train_rows.select(
        *features,
        label.alias("label"),
        F.when(label == 1, F.lit(float(ratio))).otherwise(1.0).alias("weight"),
        (F.col("snapshot_date") >= cutoff_date(train_rows, validation_fraction)).alias("validation"),
    )
    prepared = stash(prepared, "boosting-rows")
    booster = Booster(tuple(features), bin_edges(prepared.filter("NOT validation"), features))
    stored, first = stash(_binned(prepared, booster), "boosting-bins"), 0
    best = 0
    while True:
        tree = Tree.empty(depth)
        gradients, hessians, cells = _sums(stored, booster, first, tree, 0)
        if booster.trees:
            booster.aucs.append(score_auc(*cells))
            best = max(best, len(booster.aucs), key=lambda n: (booster.aucs[n - 1] if n else -1.0, -n))
            if len(booster.aucs) == trees or len(booster.aucs) - best >= patience:
                break
        tree.value[0] = _leaf(float(gradients[0][0].sum()), float(hessians[0][0].sum()), rate)
        level = 0
        while _grow(tree, level, gradients, hessians, rate) and level + 1 < depth:
            level += 1
            gradients, hessians, _ = _sums(stored, booster, first, tree, level)
        booster.trees.append(tree)
        if len(booster.trees) - first == STORED_EVERY:
            stored, first = stash(_with_margins(stored, booster, first), "boosting-margins"), len(booster.trees)
    booster.trees = booster.trees[:best]
    return booster


def predict(booster: Booster, rows: DataFrame) -> DataFrame:
    """``rows`` plus ``churn_probability``."""
    names = [f"_feature_{j}" for j in range(len(booster.features))]
    given = rows.select("*", *[F.col(f).cast("double").alias(n) for n, f in zip(names, booster.features)])
    schema = T.StructType([*rows.schema.fields, T.StructField("churn_probability", T.DoubleType())])

    def run(batches):
        for batch in batches:
            values = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
            p = 1.0 / (1.0 + np.exp(-booster.margins(booster.bins(values))))
            kept = batch.select([c for c in batch.schema.names if c not in names])
            yield kept.append_column("churn_probability", pa.array(p))

    return given.mapInArrow(run, schema)
