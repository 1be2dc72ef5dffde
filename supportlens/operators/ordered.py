"""Operators that need an order inside a group and stay safe when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_next_row(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], block: Column
) -> DataFrame:
    """Add ``next_row``, a struct of the following row of the group, null at its end.

    The result also has ``block`` and is partitioned by (keys, block).

    ``block`` must grow with ``order``, which is unique in a group. The window runs
    per (keys, block), so a huge group is spread over many tasks. The end of a block
    then looks up the first row of the next one: block starts come from an aggregate
    over keys and order alone, and rows are fetched for groups of several blocks only.
    """
    row = F.struct(*order, *columns)
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    blocked = df.withColumn("block", block)
    inside = Window.partitionBy(*keys, "block").orderBy(*order)
    starts = blocked.groupBy(*keys, "block").agg(F.min(position).alias("_start"))
    following = (
        starts.withColumn("_position", F.lead("_start").over(Window.partitionBy(*keys).orderBy("block")))
        .where(F.col("_position").isNotNull())
        .select(*keys, "block", "_position")
    )
    fetched = (
        df.select(*keys, position.alias("_position"), row.alias("_row"))
        .join(following, [*keys, "_position"])
        .groupBy(*keys, "block")
        .agg(F.min("_row").alias("_carried"))
    )
    return (
        blocked.withColumn("_next", F.lead(row).over(inside))
        .join(fetched, [*keys, "block"], "left")
        .withColumn("next_row", F.coalesce("_next", "_carried"))
        .drop("_next", "_carried")
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key; null keys are equal. Copies collapse before the shuffle."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*[F.col(key).alias(f"_key_{key}") for key in keys]).agg(first).select("_row.*")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key, e.g. the latest feedback of a session."""
    last = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*[F.col(key).alias(f"_key_{key}") for key in keys]).agg(last).select("_row.*")


def first_n_per_group(
    df: DataFrame, group: str, order: list[Column | str], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per group; Spark cuts each partition to ``n`` rows before the shuffle."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def examples_per_category(
    df: DataFrame, group: str, order: str, n: int = 3
) -> DataFrame:
    """First ``n`` rows per group, and in ``more`` how many the group has beyond them."""
    sizes = df.groupBy(group).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return first_n_per_group(df, group, [order], n).join(sizes, group)
