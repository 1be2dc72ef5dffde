import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from supportlens.operators import charts as H, profile as P, quantiles as Q
from supportlens.operators.quantiles import exact_quantiles


def numbers(spark, values, kind="DOUBLE"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}").repartition(3)


@pytest.mark.parametrize("accuracy, rank_rows", [(10_000, 100_000), (20, 5), (7, 1)])
@pytest.mark.parametrize("shape", ["normal", "ties", "hot", "outlier"])
def test_quantiles_equal_sorting(spark, shape, accuracy, rank_rows):
    rng = np.random.default_rng(3)
    values = {
        "normal": rng.normal(size=997),
        "ties": rng.integers(0, 5, 1000).astype(float),
        "hot": np.concatenate([np.full(400, 2.5), rng.normal(size=601)]),
        "outlier": np.concatenate([rng.random(500), [1e300, -1e300]]),
    }[shape]
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = exact_quantiles(numbers(spark, values.tolist()), ["x"], probabilities, accuracy, rank_rows)["x"]
    for p in probabilities:
        assert found[p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_quantiles_of_any_list(spark, values):
    found = exact_quantiles(numbers(spark, values, "INT"), ["x"], [0.25, 0.5], 10, 3)["x"]
    assert [found[0.25], found[0.5]] == pytest.approx(list(np.quantile(values, [0.25, 0.5])))


def test_quantiles_skip_nulls_and_nan(spark):
    found = exact_quantiles(numbers(spark, [1.0, None, float("nan"), 3.0]), ["x"], [0.5])
    assert found["x"][0.5] == 2.0
    assert exact_quantiles(numbers(spark, [None, None]), ["x"], [0.5]) == {"x": {0.5: None}}


def test_half_missing_column_stays(spark):
    frame = spark.createDataFrame(
        [(1, None, None), (2, None, None), (3, 1, None), (4, 1, 1)], "a INT, half INT, most INT"
    )
    assert P.drop_sparse_columns(frame).columns == ["a", "half"]


def test_fill_median_and_mode(spark):
    frame = spark.createDataFrame(
        [("b", 1.0), ("a", 4.0), ("b", None), ("a", 2.0), (None, 9.0)], "s STRING, x DOUBLE"
    )
    filled = P.fill_mode(P.fill_median(frame)).collect()
    assert sorted(r.x for r in filled) == [1.0, 2.0, 3.0, 4.0, 9.0]
    assert sorted(r.s for r in filled) == ["a", "a", "a", "b", "b"]


def test_clip_stays_in_bounds_and_keeps_nulls(spark):
    frame = numbers(spark, [1.0, 2.0, 3.0, 4.0, 100.0, None])
    clipped = [r.x for r in P.clip_outliers(frame, ["x"]).collect()]
    _, _, low, high = P.iqr_bounds(frame, ["x"])["x"]
    assert clipped.count(None) == 1
    assert all(low <= x <= high for x in clipped if x is not None)
    assert max(x for x in clipped if x is not None) == high
    assert P.outlier_count(frame, ["x"]).first().outliers == 1


def test_constant_column_scales_to_zero(spark):
    scaled = P.standardize(numbers(spark, [5.0, 5.0, 5.0]), ["x"], minmax=True).collect()
    assert {(r.x, r.x_minmax) for r in scaled} == {(0.0, 0.0)}


def test_scaling_uses_the_population_deviation(spark):
    values = [1.0, 2.0, 4.0]
    scaled = sorted(r.x for r in P.standardize(numbers(spark, values), ["x"]).collect())
    assert scaled == pytest.approx(list((np.array(values) - np.mean(values)) / np.std(values)))


def test_duplicates_and_balance(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 2), (None, 2)], "s STRING, x INT")
    assert tuple(P.duplicate_count(frame).first()) == (5, 3, 2)
    balance = P.class_balance(frame).first()
    assert (balance.max_percent, balance.min_percent, balance.imbalanced) == (40.0, 20.0, False)


def test_correlation_uses_complete_pairs(spark):
    frame = spark.createDataFrame(
        [(1.0, 2.0), (2.0, 4.0), (3.0, 6.5), (None, 9.0), (4.0, None)], "a DOUBLE, b DOUBLE"
    )
    found = {(r.a, r.b): r.r for r in P.correlation_matrix(frame, ["a", "b"]).collect()}
    expected = np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1]
    assert found["a", "b"] == found["b", "a"] == pytest.approx(expected, abs=1e-6)
    assert found["a", "a"] == 1.0


def test_cardinality_limit_is_exact(spark):
    frame = spark.range(51).select(
        F.col("id").cast("string").alias("at_51"),
        F.when(F.col("id") < 50, F.col("id").cast("string")).otherwise("0").alias("at_50"),
        F.when(F.col("id") < 50, F.col("id").cast("string")).alias("at_50_and_null"),
    )
    assert P.distinct_up_to(frame, frame.columns) == ["at_50"]


def test_histogram_matches_numpy_and_handles_constants(spark):
    values = [0, 1, 1, 2, 3, 5, 8, 13, 50]
    found = sorted(H.histogram(numbers(spark, values, "INT"), "x", 10).collect())
    assert [r.n for r in found] == np.histogram(values, bins=10)[0].tolist()
    assert sum(r.n for r in H.histogram(numbers(spark, [7.0, 7.0]), "x").collect()) == 2


def test_density_integrates_to_about_one(spark):
    rng = np.random.default_rng(1)
    curve = sorted(H.kde_curve(numbers(spark, rng.normal(size=2000).tolist()), "x", points=200).collect())
    area = np.trapezoid([r.density for r in curve], [r.x for r in curve])
    assert area == pytest.approx(1.0, abs=0.02)


def test_daily_counts_fill_empty_days(spark):
    frame = spark.createDataFrame(
        [("2024-01-01 05:00:00", 1), ("2024-01-03 23:59:59", None)], "t STRING, v INT"
    ).withColumn("t", F.col("t").cast("timestamp"))
    found = sorted(H.daily_counts(frame, "t", ["v"]).collect())
    assert [r.v for r in found] == [1, 0, 0]


def test_clean_frame_counts_duplicates_after_scaling(spark):
    """Rows that differ only beyond the clip bound become equal, and are kept."""
    rows = [(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 1000, 2000]]
    cleaned = P.clean_frame(spark.createDataFrame(rows, "x DOUBLE"))
    counts = P.duplicate_count(cleaned).first()
    assert (counts.total_records, counts.duplicate_records) == (10, 1)


def test_quantiles_between_frequent_values(spark):
    # Two heavy values hold most rows; every bracket that ends in them holds all values between.
    between = [10.0 + i / 1000 for i in range(1, 2001)]
    rows = [10.0] * 9000 + between + [15.0] * 9000 + [20.0]
    frame = spark.createDataFrame([(v,) for v in rows], "v DOUBLE").repartition(4)
    asked = [0.0, 0.1, 0.449, 8999 / 20000, 0.44998, 0.46, 0.5, 0.54, 0.55, 0.99, 1.0]
    found = Q.exact_quantiles(frame, ["v"], asked, accuracy=200, rank_rows=50)["v"]
    for p in asked:
        assert found[p] == pytest.approx(np.quantile(rows, p), abs=1e-9), p
    targets = Q._whole_range(frame, ["v"], [0.5], 200)
    while targets[0].inside > 50 and targets[0].answer is None:
        Q._narrow(frame, targets, 200)
    assert targets[0].answer or targets[0].inside <= 50
