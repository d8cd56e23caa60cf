from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from patronlens.fixed_values import FEATURE_COLUMNS
from patronlens.operators import boosting, evaluation, training
from patronlens.sources.storage import stash


def plain_auc(scores, labels):
    """Share of pairs won, ties counting half."""
    p, n = scores[labels == 1], scores[labels == 0]
    return float(np.mean((p[:, None] > n) + 0.5 * (p[:, None] == n)))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(6, 60))
def test_best_split_equals_trying_every_one(seed, n):
    draw = np.random.default_rng(seed)
    bins = draw.integers(0, 6, (n, 3))  # 0: missing
    g, h = draw.normal(size=n), draw.uniform(0.1, 1.0, n)
    sums = boosting.histogram(bins, np.zeros(n, np.int64), g, h, 1)
    found = boosting.best_split(sums[0][0], sums[1][0])

    def worth(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + 1)

    best = 1e-9
    for feature in range(3):
        x = bins[:, feature]
        for limit in range(1, 6):
            for missing_left in (True, False):
                left = np.where(x == 0, missing_left, x <= limit)
                if h[left].sum() >= 1 and h[~left].sum() >= 1:
                    best = max(best, worth(left) + worth(~left) - worth(np.ones(n, bool)))
    if found is None:
        assert best <= 1e-9
        return
    gain, feature, limit, missing_left, left_sums, right_sums = found
    left = np.where(bins[:, feature] == 0, missing_left, bins[:, feature] <= limit)
    assert gain == pytest.approx(best, abs=1e-9) and gain == pytest.approx(worth(left) + worth(~left) - worth(np.ones(n, bool)))
    assert left_sums == pytest.approx((g[left].sum(), h[left].sum())) and right_sums == pytest.approx((g[~left].sum(), h[~left].sum()))


def test_missing_values_go_where_they_gain():
    gradient, hessian = np.zeros((1, boosting.BINS)), np.zeros((1, boosting.BINS))
    hessian[0, :3] = 10
    for sign in (1, -1):
        gradient[0, :3] = [5 * sign, -5, 5]  # missing rows are like those of bin 2, or of bin 1
        _, _, limit, missing_left, left, right = boosting.best_split(gradient, hessian)
        assert (limit, missing_left) == (1, sign < 0)
        assert left[1] + right[1] == 30


def test_auc_from_counts_equals_pairs():
    draw = np.random.default_rng(3)
    cell, label = draw.integers(0, 12, 200), draw.integers(0, 2, 200)
    counts = [np.bincount(cell[label == k], minlength=12) for k in (1, 0)]
    assert boosting.score_auc(*counts) == pytest.approx(plain_auc(cell, label))
    assert boosting.score_auc(np.ones(3), np.zeros(3)) == 0.5


@pytest.fixture(scope="module")
def features(spark):
    """Churn rises where money is missing, which no single fill value tells."""
    def u(seed):
        return F.expr(f"pmod(xxhash64(id, {seed}), 1000) / 1000.0D")

    df = spark.range(4000).select(
        (F.col("id") % 400).alias("customer_id"),
        F.add_months(F.lit("2023-01-01").cast("date"), (F.col("id") / 400).cast("int")).cast("timestamp_ntz").alias("snapshot_date"),
        (u(1) * 10).cast("long").alias("frequency_180d"),
        F.when(u(2) > 0.3, u(3) * 1000).alias("monetary_180d"),
        *[F.when(u(10 + i) > 0.1, u(20 + i)).alias(c) for i, c in enumerate(FEATURE_COLUMNS[2:])],
    )
    risk = 0.7 - 0.05 * F.col("frequency_180d") + F.when(F.col("monetary_180d").isNull(), 0.3).otherwise(F.col("monetary_180d") / 4000)
    label = (F.expr("pmod(xxhash64(customer_id, snapshot_date, 7), 1000) / 1000.0D") < risk).cast("int")
    return stash(df.withColumn("churned_next_90d", label), "test-features")


def test_training_equals_plain_boosting(spark, features, monkeypatch):
    """The same trees, margins and AUCs as a plain loop over all rows in memory."""
    monkeypatch.setattr(boosting, "STORED_EVERY", 2)
    older, newest = evaluation.time_split(features)
    booster = boosting.train(older, trees=5, patience=10)
    rows = older.toPandas()
    cutoff = sorted(rows["snapshot_date"].unique())[int(rows["snapshot_date"].nunique() * 0.8)]
    validation = (rows["snapshot_date"] >= cutoff).to_numpy()
    bins = booster.bins(rows[list(FEATURE_COLUMNS)].to_numpy(dtype=float, na_value=np.nan))
    label = rows["churned_next_90d"].to_numpy()
    weight = np.where(label == 1, (label == 0).sum() / (label == 1).sum(), 1.0)
    margin, aucs, trees = np.zeros(len(rows)), [], []
    for _ in range(5):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - label), weight * p * (1 - p)
        tree = boosting.Tree.empty(4)
        for level in range(4):
            at = tree.nodes(bins, level) - (2**level - 1)
            kept = ~validation & (at >= 0)
            sums = boosting.histogram(bins[kept], at[kept], g[kept], h[kept], 2**level)
            boosting._grow(tree, level, *sums, 0.05)
        margin = margin + tree.margins(bins)
        trees.append(tree)
        cells = (1 / (1 + np.exp(-margin[validation])) * boosting.SCORE_CELLS).astype(int)
        aucs.append(plain_auc(cells, label[validation]))
    assert booster.aucs == pytest.approx(aucs, abs=1e-9)
    best = int(np.argmax(aucs)) + 1
    assert [(t.feature, t.bin, t.missing_left) for t in booster.trees] == [(t.feature, t.bin, t.missing_left) for t in trees[:best]]
    assert np.allclose([t.value[1:] for t in booster.trees], [t.value[1:] for t in trees[:best]], atol=1e-5)
    again = boosting.Booster.from_json(booster.to_json())
    scored = boosting.predict(again, newest)
    expected = 1 / (1 + np.exp(-booster.margins(booster.bins(newest.toPandas()[list(FEATURE_COLUMNS)].to_numpy(dtype=float, na_value=np.nan)))))
    assert np.allclose(scored.toPandas()["churn_probability"], expected)
    assert evaluation.roc_auc(scored).first()["roc_auc"] > 0.6


def test_one_class_or_leaking_columns_cannot_train(features):
    with pytest.raises(ValueError, match="both classes"):
        boosting.train(features.filter("churned_next_90d = 0"))
    with pytest.raises(ValueError, match="leaking"):
        boosting.train(features.withColumn("days_since_last_order", F.lit(1)), features=(*FEATURE_COLUMNS, "days_since_last_order"))


def test_rounds_have_their_own_auc_and_the_model_is_cut(spark, features, monkeypatch):
    older, newest = evaluation.time_split(features)
    whole, aucs = training.train_rounds(older, trees=6, patience=6)
    assert len(aucs) == 6
    gbt_trees = whole.stages[-1].getNumTrees
    assert gbt_trees == int(np.argmax(aucs)) + 1
    smaller = training.cut(whole, 1)
    assert smaller.stages[-1].getNumTrees == 1
    # the AUC of a cut model by Spark's own evaluator, and of the first round by plain recomputation
    rows = newest.select("*", F.col("churned_next_90d").cast("double").alias("label"))
    scored = training.predict(smaller, newest)
    taken = training.round_aucs(smaller, rows)
    pandas = scored.toPandas()
    assert taken == pytest.approx([plain_auc(pandas["churn_probability"].to_numpy(), pandas["churned_next_90d"].to_numpy())], abs=1e-6)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="churn_probability", labelCol="churned_next_90d")
    assert training.round_aucs(whole, rows)[-1] == pytest.approx(evaluator.evaluate(training.predict(whole, newest)), abs=2e-3)
