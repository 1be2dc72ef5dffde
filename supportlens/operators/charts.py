"""The tables behind the charts: bins, curves, boxes, bars and series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from supportlens import constants as C
from supportlens.operators.aggregates import as_rows
from supportlens.operators.profile import correlation_matrix, distinct_up_to
from supportlens.operators.quantiles import exact_quantiles, number


def histograms(df: DataFrame, columns: dict[str, Column], bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from minimum to maximum per value, the last one closed, empty ones kept; NaN is missing.

    All values share one pass for the ranges and one for the counts.
    """
    names = list(columns)
    wide = df.select(*[F.nanvl(columns[name].cast("double"), F.lit(None)).alias(f"_{i}") for i, name in enumerate(names)])
    ranges = wide.agg(
        F.array(
            *[
                F.struct(F.min(f"_{i}").alias("lo"), F.max(f"_{i}").alias("hi"))
                for i in range(len(names))
            ]
        )
    ).scalar()
    own = ranges[F.col("which")]
    low, width = own.lo, own.hi - own.lo
    # A constant value falls into the middle bin of a range one wide.
    flat = width == 0.0
    position = F.floor((F.col("x") - low) * float(bins) / F.nullif(width, F.lit(0.0)))
    bin_of = F.least(F.coalesce(position, F.lit(bins // 2)), F.lit(bins - 1)).cast("int")
    counts = (
        wide.select(F.posexplode(F.array(*wide.columns)).alias("which", "x"))
        .where(F.col("x").isNotNull())
        .groupBy("which", bin_of.alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = df.sparkSession.range(len(names) * bins).select(
        F.floor(F.col("id") / bins).cast("int").alias("which"), (F.col("id") % bins).cast("int").alias("bin")
    )
    start = F.when(flat, low - 0.5).otherwise(low)
    step = F.when(flat, 1.0).otherwise(width) / bins
    return grid.join(counts, ["which", "bin"], "left").select(
        F.get(F.array(*[F.lit(name) for name in names]), "which").alias("column"),
        "bin",
        F.round(start + F.col("bin") * step, 6).alias("bin_start"),
        F.round(start + (F.col("bin") + 1) * step, 6).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram(df: DataFrame, value: Column | str, bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    column = F.col(value) if isinstance(value, str) else value
    return histograms(df, {"value": column}, bins).drop("column")


def kde_curve(df: DataFrame, value: str, points: int = 50, bins: int = 200) -> DataFrame:
    """Gaussian density over a grid, computed from a fine histogram.

    The bandwidth is deviation * n^(-1/5). Every bin adds to every grid point, which
    is bins * points numbers however many rows there are.
    """
    x = number(df, value)
    stats = df.agg(
        F.struct(
            F.count(x).alias("n"),
            F.min(x).alias("lo"),
            F.max(x).alias("hi"),
            F.nullif(F.stddev_samp(x), F.lit(0.0)).alias("std"),
        )
    ).scalar()
    bandwidth = stats.std * F.pow(stats.n, F.lit(-0.2))
    step = (stats.hi - stats.lo) / (points - 1)
    centre = stats.lo + (F.col("bin") + 0.5) * (stats.hi - stats.lo) / bins
    on_grid = histogram(df, x, bins).where("n > 0").select(
        centre.alias("centre"), "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    )
    grid_x = stats.lo + F.col("point") * step
    kernel = F.exp(-0.5 * F.pow((grid_x - F.col("centre")) / bandwidth, 2)) * F.col("n")
    return on_grid.groupBy("point").agg(
        F.round(F.first(grid_x), 6).alias("x"),
        F.round(F.sum(kernel) / F.first(stats.n * bandwidth * math.sqrt(2 * math.pi)), 9).alias("density"),
    )


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whiskers (last values within the IQR reach) and outliers per column."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    boxes = []
    for column in columns:
        q1, median, q3 = (quartiles[column][p] for p in (0.25, 0.5, 0.75))
        if q1 is None:
            continue
        reach = C.IQR_FACTOR * (q3 - q1)
        value = number(df, column)
        inside = F.when(value.between(q1 - reach, q3 + reach), value)
        boxes.append(
            F.struct(
                F.lit(column).alias("column"),
                F.round(F.lit(q1), 6).alias("q1"),
                F.round(F.lit(median), 6).alias("median"),
                F.round(F.lit(q3), 6).alias("q3"),
                F.min(inside).alias("whisker_low"),
                F.max(inside).alias("whisker_high"),
                (F.count(value) - F.count(inside)).alias("outliers"),
            ).alias(column)
        )
    stats = df.agg(*boxes)
    return as_rows(stats, [F.col(c) for c in stats.columns])


def category_bars(df: DataFrame, columns: list[str], limit: int = C.MAX_PLOT_VALUES) -> DataFrame:
    """Counts per value of every column with at most ``limit`` distinct values."""
    chosen = distinct_up_to(df, columns, limit)
    if not chosen:
        return df.sparkSession.createDataFrame([], "`column` STRING, value STRING, n BIGINT")
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in chosen]
    return df.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(F.count("*").alias("n"))


def correlation_heatmap(df: DataFrame, columns: list[str]) -> DataFrame:
    return correlation_matrix(df, columns)


def pair_points(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """Points of every pair of columns, one row per point."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    points = F.array(
        *[
            F.struct(
                F.lit(a).alias("x_column"),
                F.lit(b).alias("y_column"),
                F.col(a).cast("double").alias("x"),
                F.col(b).cast("double").alias("y"),
            )
            for a, b in pairs
        ]
    )
    return df.select(id_column, F.inline(points))


def daily_counts(df: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """Non-null values per day and column, days without rows as zeros."""
    per_day = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(
        *[F.count(c).alias(c) for c in columns]
    )
    days = df.agg(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("day")
    )
    return days.join(per_day, "day", "left").fillna(0, columns)
