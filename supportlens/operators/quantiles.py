"""Exact quantiles without holding a column in one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def number(df: DataFrame, column: str) -> Column:
    """The column as a double with NaN read as missing."""
    value = F.col(column).cast("double")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(value), value)
    return value


@dataclass
class _Target:
    """One wanted quantile: its position and the bracket known to hold it."""

    column: str
    probability: float
    position: float
    low: float
    high: float
    below: int
    inside: int
    margin: float
    answer: tuple[float, float] | None = None

    def holds(self, below: int, inside: int) -> bool:
        return below <= math.floor(self.position) and math.ceil(self.position) < below + inside

    def close_in(self, counted) -> None:
        """Take the bracket without its end values, or the answer if that touches them."""
        low, high = self.low, self.high
        first, last = math.floor(self.position) - self.below, math.ceil(self.position) - self.below
        upper = self.inside - counted.at_high
        if last < counted.at_low:
            self.answer = (low, low)
        elif first >= upper:
            self.answer = (high, high)
        elif first < counted.at_low:
            self.answer = (low, counted.after_low)
        elif last >= upper:
            self.answer = (counted.before_high, high)
        else:
            self.low, self.high = counted.after_low, counted.before_high
            self.below += counted.at_low
            self.inside = upper - counted.at_low


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    accuracy: int = 10_000,
    rank_rows: int = 100_000,
    known: dict[str, tuple[int, float, float]] | None = None,
    brackets: dict[tuple[str, float], tuple[float, float]] | None = None,
) -> dict[str, dict[float, float | None]]:
    """Linear-interpolation quantiles of every column, as plain numbers.

    A sketch brackets each quantile and the rows below and inside the bracket are
    counted, again and again until at most ``rank_rows`` rows are inside; their
    distinct values are then ranked. Where a narrower bracket still holds more, the values at its
    ends are counted apart and taken off, so frequent ones cannot keep it wide. A bracket that misses the position is thrown
    away and drawn wider, so results are exact. All quantiles share every pass, and
    only a few numbers per column reach the driver.

    ``known`` gives count, minimum and maximum of each column, and ``brackets`` where to look first, if
    they are there already; a bracket that misses its position costs a pass and nothing else.
    """
    values = df.select(*[number(df, c).alias(c) for c in columns])
    targets = _targets(known, columns, probabilities, accuracy) if known else _whole_range(values, columns, probabilities, accuracy)
    first = [t for t in targets if t.inside > rank_rows and t.low < t.high and (t.column, t.probability) in (brackets or {})]
    if first:
        _count(values, first, [brackets[t.column, t.probability] for t in first], accuracy, rank_rows)
    while True:
        wide = [t for t in targets if t.inside > rank_rows and t.low < t.high and t.answer is None]
        if not wide:
            break
        _narrow(values, wide, accuracy, rank_rows)
    result: dict[str, dict[float, float | None]] = {
        c: {p: None for p in probabilities} for c in columns
    }
    for target, (left, right) in zip(targets, _ranked(values, targets)):
        fraction = target.position - math.floor(target.position)
        result[target.column][target.probability] = left + (right - left) * fraction
    return result


def _whole_range(values, columns, probabilities, accuracy) -> list[_Target]:
    row = values.agg(
        *[
            F.struct(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return _targets({c: (stats.n, stats.low, stats.high) for c, stats in zip(columns, row)}, columns, probabilities, accuracy)


def _targets(known, columns, probabilities, accuracy) -> list[_Target]:
    out = []
    for c in columns:
        n, low, high = known[c]
        out += [_Target(c, p, (n - 1) * p, low, high, 0, n, 2.0 / accuracy) for p in probabilities if n]
    return out


def _narrow(values: DataFrame, targets: list[_Target], accuracy: int, rank_rows: int = 0) -> None:
    """Draw a narrower bracket for every target and keep it if it holds the position."""
    wanted = [(t.position - t.below) / (t.inside - 1) for t in targets]
    # Targets that still share a range share one sketch.
    asked: dict[tuple, list[float]] = {}
    for target, q in zip(targets, wanted):
        sides = [max(q - target.margin, 0.0), min(q + target.margin, 1.0)]
        asked.setdefault((target.column, target.low, target.high), []).extend(sides)
    drawn = values.agg(
        *[
            F.percentile_approx(F.when(F.col(c).between(low, high), F.col(c)), sides, accuracy)
            for (c, low, high), sides in asked.items()
        ]
    ).first()
    answers = {key: iter(row) for key, row in zip(asked, drawn)}
    sketches = [
        [next(answers[t.column, t.low, t.high]) for _ in range(2)] for t in targets
    ]
    brackets = [
        (
            t.low if q <= t.margin else left,
            t.high if q >= 1.0 - t.margin else right,
        )
        for t, q, (left, right) in zip(targets, wanted, sketches)
    ]
    _count(values, targets, brackets, accuracy, rank_rows)


def _count(values: DataFrame, targets: list[_Target], brackets: list[tuple[float, float]], accuracy: int, rank_rows: int) -> None:
    """Count the rows below and inside the brackets and keep those that hold their positions."""
    counts = values.agg(
        *[
            F.struct(
                F.count_if(F.col(t.column) < low).alias("below"),
                F.count_if(F.col(t.column).between(low, high)).alias("inside"),
            ).alias(f"_{k}")
            for k, (t, (low, high)) in enumerate(zip(targets, brackets))
        ]
    ).first()
    crowded = []
    for target, (low, high), counted in zip(targets, brackets, counts):
        if not target.holds(counted.below, counted.inside):
            target.margin *= 10.0
            continue
        target.low, target.high, target.below, target.inside = low, high, counted.below, counted.inside
        target.margin = 2.0 / accuracy
        if counted.inside > rank_rows and low < high:
            crowded.append(target)
    if crowded:
        _without_ends(values, crowded)


def _without_ends(values: DataFrame, targets: list[_Target]) -> None:
    """Take the values at the ends off the brackets that hold too many rows."""
    ends = values.agg(
        *[
            F.struct(
                F.count_if(F.col(t.column) == t.low).alias("at_low"),
                F.count_if(F.col(t.column) == t.high).alias("at_high"),
                F.min(F.when((F.col(t.column) > t.low) & (F.col(t.column) <= t.high), F.col(t.column))).alias("after_low"),
                F.max(F.when((F.col(t.column) < t.high) & (F.col(t.column) >= t.low), F.col(t.column))).alias("before_high"),
            ).alias(f"_{k}")
            for k, t in enumerate(targets)
        ]
    ).first()
    for target, counted in zip(targets, ends):
        target.close_in(counted)


def _ranked(values: DataFrame, targets: list[_Target]) -> list[tuple[float, float]]:
    """The values left and right of every position."""
    # A bracket of one value is the answer already.
    found = {k: t.answer or (t.low, t.low) for k, t in enumerate(targets) if t.answer or t.low == t.high}
    if len(found) == len(targets):
        return [found[k] for k in range(len(targets))]
    inside = [
        F.when(
            F.col(t.column).between(t.low, t.high),
            F.struct(F.lit(k).alias("k"), F.col(t.column).alias("value")),
        )
        for k, t in enumerate(targets)
        if k not in found
    ]
    counted = (
        values.select(F.explode(F.array(*inside)).alias("item"))
        .where(F.col("item").isNotNull())
        .groupBy("item.k", "item.value")
        .agg(F.count("*").alias("n"))
    )
    end = F.sum("n").over(Window.partitionBy("k").orderBy("value")) + _by_target(
        [t.below for t in targets]
    )
    around = (
        counted.withColumn("end", end)
        .where(F.col("end") - F.col("n") <= _by_target([math.ceil(t.position) for t in targets]))
        .where(F.col("end") > _by_target([math.floor(t.position) for t in targets]))
        .groupBy("k")
        .agg(F.min("value").alias("left"), F.max("value").alias("right"))
    )
    found.update({row.k: (row.left, row.right) for row in around.collect()})
    return [found[k] for k in range(len(targets))]


def _by_target(numbers: list[int]) -> Column:
    """The number of the target ``k`` of a row."""
    return F.element_at(F.array(*[F.lit(n).cast("bigint") for n in numbers]), F.col("k") + 1)


def quantile_table(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    found = exact_quantiles(df, columns, probabilities)
    rows = [(c, p, found[c][p]) for c in columns for p in probabilities]
    return df.sparkSession.createDataFrame(
        rows, "`column` STRING, probability DOUBLE, value DOUBLE"
    )
