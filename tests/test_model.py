from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from patronlens.fixed_values import FEATURE_COLUMNS
from patronlens.operators import attribution, evaluation, scoring, training
from patronlens.plans import churn
from patronlens.sources.storage import stash


@pytest.fixture(scope="module")
def features(spark):
    """A panel with a learnable label: activity lowers churn, NULL money raises it."""
    def u(seed):
        return F.expr(f"pmod(xxhash64(id, {seed}), 1000) / 1000.0D")

    df = spark.range(6000).select(
        (F.col("id") % 500).alias("customer_id"),
        F.add_months(F.lit("2023-01-01").cast("date"), (F.col("id") / 500).cast("int")).cast("timestamp_ntz").alias("snapshot_date"),
        (u(1) * 10).cast("long").alias("frequency_180d"),
        F.when(u(2) > 0.3, u(3) * 1000).alias("monetary_180d"),
        *[F.when(u(10 + i) > 0.1, u(20 + i)).alias(c) for i, c in enumerate(FEATURE_COLUMNS[2:])],
    )
    risk = 0.9 - 0.08 * F.col("frequency_180d") + F.when(F.col("monetary_180d").isNull(), 0.3).otherwise(0)
    label = (F.expr("pmod(xxhash64(customer_id, snapshot_date, 7), 1000) / 1000.0D") < risk).cast("int")
    return stash(df.withColumn("churned_next_90d", label), "test-features")


@pytest.fixture(scope="module")
def model(features):
    older, _ = evaluation.time_split(features)
    return training.train(older, trees=12)


def test_time_split_is_by_date(features):
    older, newest = evaluation.time_split(features)
    assert older.agg(F.max("snapshot_date")).first()[0] < newest.agg(F.min("snapshot_date")).first()[0]
    assert older.count() + newest.count() == 6000
    # 12 dates: index int(12 * 0.8) = 9
    assert newest.select("snapshot_date").distinct().count() == 3


def test_split_without_test_dates_fails(features):
    with pytest.raises(Exception, match="no test dates"):
        evaluation.time_split(features, 0.0)[0].count()


def test_model_learns_and_survives_storage(features, model, tmp_path):
    _, newest = evaluation.time_split(features)
    scored = training.predict(model, newest)
    auc = evaluation.roc_auc(scored).first()["roc_auc"]
    reference = BinaryClassificationEvaluator(rawPredictionCol="churn_probability", labelCol="churned_next_90d")
    assert auc == pytest.approx(reference.evaluate(scored), abs=2e-3)
    assert auc > 0.7
    path = str(tmp_path / "model")
    training.save_model(model, path)
    loaded = training.load_model(path)
    assert training.model_features(loaded) == FEATURE_COLUMNS
    assert training.predict(loaded, newest).exceptAll(scored).count() == 0


def test_forbidden_columns_cannot_train(features):
    with pytest.raises(ValueError, match="leaking"):
        training.train(features.withColumn("days_since_last_order", F.lit(1)), features=(*FEATURE_COLUMNS, "days_since_last_order"))


def test_one_class_cannot_train(features):
    with pytest.raises(ValueError, match="both classes"):
        training.train(features.filter("churned_next_90d = 0"))


def test_impacts_add_up_to_the_log_odds(features, model):
    rows = attribution.attribute(model, scoring.latest_snapshot(features))
    impact = sum((F.col(f"impact_{c}") for c in FEATURE_COLUMNS), F.col("base_value"))
    p = F.col("churn_probability")
    worst = rows.agg(F.max(F.abs(impact - F.ln(p / (1 - p)))), F.count("*")).first()
    assert worst[1] == 500 and worst[0] < 1e-9


def _expected_value(nodes, node, row, known):
    value, cover, left, right, column, threshold = nodes[node]
    if left < 0:
        return value
    if column in known:
        return _expected_value(nodes, left if row[column] <= threshold else right, row, known)
    parts = [(nodes[c][1], _expected_value(nodes, c, row, known)) for c in (left, right)]
    return sum(w * v for w, v in parts) / cover


def test_leaf_tables_equal_brute_force_shapley():
    """Shapley values from their definition, on random trees that repeat features."""
    rng = np.random.default_rng(5)
    columns = 4
    for _ in range(10):
        nodes, count = {}, [0]

        def grow(depth, cover):
            me = count[0]
            count[0] += 1
            if depth == 4 or cover < 4:
                nodes[me] = (float(rng.normal()), cover, -1, -1, None, None)
                return me
            share = int(rng.integers(1, cover))
            column, threshold = int(rng.integers(columns)), float(rng.normal())
            left, right = grow(depth + 1, share), grow(depth + 1, cover - share)
            nodes[me] = (0.0, cover, left, right, column, threshold)
            return me

        grow(0, 100)
        by_size = {}
        for value, _, path in attribution._leaf_paths(nodes, 1.0):
            by_size.setdefault(len(path), []).append((value, path))
        groups = []
        for leaves in by_size.values():
            bounds = np.array([list(p.values()) for _, p in leaves])
            groups.append(
                attribution.LeafGroup(
                    np.array([list(p) for _, p in leaves]), bounds[..., 0], bounds[..., 1],
                    attribution._tables(np.array([v for v, _ in leaves]), bounds[..., 2]),
                )
            )
        x = rng.normal(size=(6, columns))
        got = attribution.impacts(groups, x)
        for row, impacts in zip(x, got):
            for j in range(columns):
                others = [g for g in range(columns) if g != j]
                expected = 0.0
                for size in range(columns):
                    weight = factorial(size) * factorial(columns - size - 1) / factorial(columns)
                    for chosen in combinations(others, size):
                        expected += weight * (
                            _expected_value(nodes, 0, row, {*chosen, j}) - _expected_value(nodes, 0, row, set(chosen))
                        )
                assert impacts[j] == pytest.approx(expected, abs=1e-9)


def test_explanations_and_display(features, model):
    found = churn.explain_latest(model, features)
    row = found.first()
    assert len(row["top_features"]) == 3
    sizes = [abs(f["impact"]) for f in row["top_features"]]
    assert sizes == sorted(sizes, reverse=True)
    assert found.count() == 500


def test_scored_bands_are_terciles(features, model):
    bands = churn.score_latest(model, features)
    counts = {r["risk_band"]: r["count"] for r in bands.groupBy("risk_band").count().collect()}
    assert set(counts) <= {"low", "medium", "high"} and sum(counts.values()) == 500


def test_equal_scores_do_not_fail(spark):
    df = spark.createDataFrame([(i, None, 0.5) for i in range(5)], "customer_id long, snapshot_date timestamp_ntz, churn_probability double")
    assert {r["risk_band"] for r in scoring.with_risk_bands(df).collect()} == {"low"}


def test_report_matches_a_hand_count(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 0), (0.2, 0), (0.1, 1), (0.5, 1)]
    df = spark.createDataFrame(rows, "churn_probability double, churned_next_90d int")
    report = {r["label"]: r for r in evaluation.classification_report(df).collect()}
    assert (report["1"]["precision"], report["1"]["recall"], report["1"]["support"]) == (0.75, 0.75, 4)
    assert (report["0"]["precision"], report["0"]["recall"], report["0"]["support"]) == (0.5, 0.5, 2)
    assert report["accuracy"]["precision"] == 0.666667
    assert report["weighted avg"]["f1_score"] == 0.666667
    # no positive prediction at all: undefined ratios are 0
    none = evaluation.classification_report(df.withColumn("churn_probability", F.lit(0.0))).filter("label = '1'").first()
    assert (none["precision"], none["recall"], none["f1_score"]) == (0.0, 0.0, 0.0)
    assert evaluation.roc_auc(df).first()["roc_auc"] == 0.625


def test_auc_with_one_class_is_null(spark):
    df = spark.createDataFrame([(0.5, 1), (0.6, 1)], "churn_probability double, churned_next_90d int")
    assert evaluation.roc_auc(df).first()["roc_auc"] is None


def test_calibration_merges_equal_edges(spark):
    df = spark.createDataFrame([(0.5, i % 2) for i in range(30)] + [(0.9, 1)], "churn_probability double, churned_next_90d int")
    rows = evaluation.calibration_table(df).collect()
    assert sum(r["n_rows"] for r in rows) == 31 and len(rows) <= 2
