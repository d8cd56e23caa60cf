"""Training on rows that are merged where no tree can tell them apart."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronlens.fixed_values import FEATURE_COLUMNS
from patronlens.operators import boosting, evaluation, training
from patronlens.sources.storage import stash


@pytest.fixture(scope="module")
def older(spark):
    """Many customers, few different rows."""
    df = spark.range(4000).select(
        (F.col("id") % 400).alias("customer_id"),
        F.add_months(F.lit("2023-01-01").cast("date"), (F.col("id") / 400).cast("int")).cast("timestamp_ntz").alias("snapshot_date"),
        F.expr("pmod(xxhash64(id, 1), 5)").alias("frequency_180d"),
        F.expr("CASE WHEN pmod(xxhash64(id, 2), 3) > 0 THEN pmod(xxhash64(id, 3), 4) * 10.5 END").alias("monetary_180d"),
        *[F.lit(None).cast("double").alias(c) for c in FEATURE_COLUMNS[2:]],
    )
    risk = 0.8 - 0.12 * F.col("frequency_180d") + F.when(F.col("monetary_180d").isNull(), 0.15).otherwise(0)
    label = (F.expr("pmod(xxhash64(customer_id, snapshot_date, 7), 1000) / 1000.0D") < risk).cast("int")
    return stash(df.withColumn("churned_next_90d", label), "merge-features")


def test_trees_are_fitted_on_different_rows_only(older, monkeypatch):
    seen, fit = [], training.GBTClassifier.fit
    monkeypatch.setattr(training.GBTClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    model, aucs = training.train_rounds(older, trees=4, patience=4)
    assert seen[0] <= 5 * 5 * 2  # frequencies x amounts and NULL x labels, of 3200 rows
    assert len(aucs) == 4
    # each leaf of the first tree holds the weighted rows and the mean label that all rows have there
    dates = sorted(r[0] for r in older.select("snapshot_date").distinct().collect())
    pandas = older.filter(F.col("snapshot_date") < dates[int(len(dates) * 0.8)]).toPandas()
    label = pandas["churned_next_90d"].to_numpy()
    both = older.groupBy("churned_next_90d").count().collect()
    counts = {r[0]: r[1] for r in both}
    weight = np.where(label == 1, counts[0] / counts[1], 1.0)
    nodes = training.tree_nodes(older.sparkSession, model.stages[-1])[0]
    assert nodes[0][1] == pytest.approx(weight.sum())
    assert nodes[0][0] == pytest.approx((weight * (2 * label - 1)).sum() / weight.sum())


def test_boosting_stores_different_rows_only(older, monkeypatch):
    stored = {}
    monkeypatch.setattr(boosting, "stash", lambda df, label: stored.setdefault(label, stash(df, label)))
    boosting.train(older, trees=2)
    bins = stored["boosting-bins"]
    assert bins.count() <= 5 * 5 * 2 * 2  # and fitted or validation
    assert bins.agg(F.sum("held")).first()[0] == 4000


def test_bins_split_raw_rows_as_the_trees_do(spark, older):
    """Edges hold every value of a column with few; a rare tail has edges too; bins count the edges below."""
    rows = spark.range(10_000).select(
        (F.col("id") % 7).alias("few"),
        F.when(F.col("id") < 100, F.col("id") * 1.5).otherwise(0.0).alias("tail"),
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"),
    )
    names = ("few", "tail", "half")
    edges = training.feature_edges(rows, names)
    assert set(range(6)) <= set(edges[0])
    assert 0.0 in edges[1] and len(edges[1]) > 20
    assert all(len(e) <= training.BINS - 1 and e == sorted(set(e)) for e in edges)
    binning = training.model_stages(names, edges, 1)[0]
    pandas = binning.transform(rows).toPandas()
    for name, of in zip(names, edges):
        value = pandas[name].fillna(0.0).to_numpy(dtype=float)
        assert (pandas[name + training.VALUE] == np.searchsorted(of, value, "left")).all()
        assert (pandas[name + training.MISSING] == pandas[name].isna()).all()


def test_merged_scores_rank_as_all_rows(older):
    model, _ = training.train_rounds(older, trees=3, patience=3)
    rows = older.withColumn("label", F.col("churned_next_90d").cast("double"))
    scored = training.predict(model, older)
    assert training.round_aucs(model, rows)[-1] == pytest.approx(evaluation.roc_auc(scored).first()["roc_auc"], abs=1e-5)
