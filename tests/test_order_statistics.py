from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from patronlens.operators.order_statistics import Order, keys_at, quantiles, with_ntiles

values = st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e6, 1e6, allow_subnormal=False))


def frame(spark, xs):
    return spark.createDataFrame(list(enumerate(xs)), "id long, x double").coalesce(2)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(xs=st.lists(values, min_size=1, max_size=40), tiles=st.integers(2, 6))
def test_ntiles_equal_the_window_function(spark, xs, tiles):
    df = frame(spark, xs)
    got = with_ntiles(df, {"up": ("x", False), "down": ("x", True)}, "id", tiles)
    up = Window.orderBy(F.col("x").asc_nulls_last(), "id")
    down = Window.orderBy(F.col("x").desc_nulls_first(), "id")
    wrong = got.join(
        df.select("id", F.ntile(tiles).over(up).alias("up2"), F.ntile(tiles).over(down).alias("down2")), "id"
    ).filter("up <> up2 OR down <> down2")
    assert wrong.count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(xs=st.lists(values, min_size=1, max_size=60).filter(lambda v: any(x is not None for x in v)))
def test_quantiles_equal_numpy(spark, xs):
    fractions = [0.0, 1 / 3, 0.5, 2 / 3, 0.9, 1.0]
    got = quantiles(frame(spark, xs), "x", fractions)
    expected = np.quantile([x for x in xs if x is not None], fractions)
    assert got == pytest.approx(list(expected), rel=1e-12, abs=1e-9)


def test_one_value_holding_most_rows(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(7).cast("double").alias("x"))
    got = with_ntiles(df, {"t": ("x", False)}, "id", 5)
    expected = df.select("id", F.ntile(5).over(Window.orderBy("x", "id")).alias("u"))
    assert got.join(expected, "id").filter("t <> u").count() == 0
    assert [r["n"] for r in got.groupBy("t").agg(F.count("*").alias("n")).collect()] == [1000] * 5


def test_tercile_example(spark):
    got = quantiles(frame(spark, [1.0, 2.0, 3.0, 4.0, 10.0]), "x", [0, 1 / 3, 2 / 3, 1])
    assert got == pytest.approx([1, 7 / 3, 11 / 3, 10])


def test_no_values(spark):
    with pytest.raises(ValueError, match="no values"):
        quantiles(frame(spark, [None]), "x", [0.5])


def test_skewed_and_odd_values(spark):
    """Magnitudes from denormal to the largest, infinities, negative zero, NULLs and heavy ties, in several orders at once."""
    xs = [0.0, -0.0, 5e-324, 1e-300, -1e-300, 1e300, -1.7e308, 1.7e308, float("inf"), float("-inf"), None, None, 3.0]
    xs = (xs * 40) + [1.0 + k * 2.0**-52 for k in range(50)] + [float(2**k) for k in range(-60, 60)]
    df = spark.createDataFrame([(i * 7919 % 100_003 - 50_000, x) for i, x in enumerate(xs)], "id long, x double").repartition(3).cache()
    scores = {"up": ("x", False), "down": ("x", True), "by_id": ("id", False)}
    got = with_ntiles(df, scores, "id", 7)
    windows = {
        "up": Window.orderBy(F.col("x").asc_nulls_last(), "id"),
        "down": Window.orderBy(F.col("x").desc_nulls_first(), "id"),
        "by_id": Window.orderBy("id"),
    }
    expected = df.select("id", *[F.ntile(7).over(w).alias(f"{n}2") for n, w in windows.items()])
    assert got.join(expected, "id").filter(" OR ".join(f"{n} <> {n}2" for n in windows)).count() == 0
    finite = [x for x in xs if x is not None and abs(x) < 1e299]
    kept = df.filter("abs(x) < 1e299")
    assert quantiles(kept, "x", [0.0, 0.1, 0.5, 0.77, 1.0]) == list(np.quantile(finite, [0.0, 0.1, 0.5, 0.77, 1.0]))


def test_rows_are_neither_sorted_nor_shuffled(spark):
    df = frame(spark, [float(i % 17) for i in range(200)])
    plan = with_ntiles(df, {"a": ("x", False), "b": ("x", True)}, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_places_beyond_the_rows_are_an_error(spark):
    with pytest.raises(ValueError, match="place 3 of 3"):
        keys_at(frame(spark, [1.0, 2.0, None]), [Order("x", False, "id")], [[3]])
