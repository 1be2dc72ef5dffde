"""Row filters, set operations and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from supportlens import constants as C


def filter_category(df: DataFrame, value: str, column: str = "category") -> DataFrame:
    return df.where(F.col(column) == value)


def filter_topic(
    df: DataFrame,
    question: str = "question",
    answer: str = "answer",
    category: str = "category",
    word: str = C.TOPIC_WORD,
) -> DataFrame:
    """Rows of the topic categories whose question or answer mentions ``word``."""

    def mentions(column: str) -> Column:
        return F.coalesce(F.lower(column).contains(word), F.lit(False))

    return df.where(
        F.col(category).isin(C.TOPIC_CATEGORIES) & (mentions(question) | mentions(answer))
    )


def filter_user_turns(df: DataFrame, role: str = "role") -> DataFrame:
    return df.where(F.col(role) == "user")


def _rating_ok(rating: str) -> Column:
    low, high = C.RATING_RANGE
    return F.coalesce(F.col(rating).between(low, high), F.lit(False))


def valid_ratings(df: DataFrame, rating: str = "rating") -> DataFrame:
    return df.where(_rating_ok(rating))


def rejected_ratings(df: DataFrame, rating: str = "rating") -> DataFrame:
    """The quarantined rest of ``valid_ratings``."""
    return df.where(~_rating_ok(rating))


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Concatenate by column name; columns a source lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def _bucket(id_column: str, buckets: int) -> Column:
    """Stable bucket of a row, the same on every run and every partitioning."""
    digest = F.substring(F.md5(F.col(id_column).cast("string")), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(buckets))


def split_train_test(df: DataFrame, id_column: str, test_percent: int = C.TEST_PERCENT) -> DataFrame:
    """Add ``split``; the choice depends only on the row id, so no shuffle is needed."""
    return df.withColumn(
        "split", F.when(_bucket(id_column, 100) < test_percent, "test").otherwise("train")
    )


def sample_rows(df: DataFrame, id_column: str, size: int = 100) -> DataFrame:
    """At most ``size`` rows in a random but repeatable order."""
    return df.orderBy(F.md5(F.col(id_column).cast("string")), id_column).limit(size)


def head(df: DataFrame, order: list[str], size: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(size)
