"""Look-ups in small fixed tables, and joins of feedback with conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from supportlens import constants as C
from supportlens.operators.ordered import keep_last


def next_steps_table(spark: SparkSession) -> DataFrame:
    rows = [
        (language, intent, steps)
        for language, by_intent in C.NEXT_STEPS.items()
        for intent, steps in by_intent.items()
    ]
    return spark.createDataFrame(rows, "language STRING, intent STRING, next_steps ARRAY<STRING>")


def actions_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(C.SUGGESTED_ACTIONS.items()), "intent STRING, actions ARRAY<STRING>"
    )


def translations_table(spark: SparkSession) -> DataFrame:
    rows = [
        (language, key, text)
        for language, entries in C.TRANSLATIONS.items()
        for key, text in entries.items()
    ]
    return spark.createDataFrame(rows, "language STRING, phrase_key STRING, translation STRING")


# The tables above have at most 16 rows, whatever the data, so broadcasting them is safe.


def with_suggested_actions(df: DataFrame, intent: str = "intent") -> DataFrame:
    table = actions_table(df.sparkSession).withColumnRenamed("intent", intent)
    default = F.array(*[F.lit(action) for action in C.DEFAULT_ACTIONS])
    return df.join(F.broadcast(table), intent, "left").withColumn(
        "actions", F.coalesce("actions", default)
    )


def with_next_steps(df: DataFrame, intent: str = "intent", language: str = "language") -> DataFrame:
    """Add the follow-up questions; an unknown intent gets the general ones, any
    language but Vietnamese the English ones."""
    known = F.coalesce(F.col(intent).isin(C.CATEGORIES), F.lit(False))
    keyed = df.withColumn(
        "_intent", F.when(known, F.col(intent)).otherwise(C.DEFAULT_CATEGORY)
    ).withColumn("_language", F.when(F.col(language) == "vi", "vi").otherwise("en"))
    table = next_steps_table(df.sparkSession).select(
        F.col("intent").alias("_intent"), F.col("language").alias("_language"), "next_steps"
    )
    return keyed.join(F.broadcast(table), ["_intent", "_language"]).drop("_intent", "_language")


def with_translation(df: DataFrame, step: str, language: str) -> DataFrame:
    """Add ``translated``: the phrase for the step's key, or the step itself."""
    key = F.regexp_replace(F.lower(F.col(step)), f"[{C.WHITESPACE}]+", "_")
    table = translations_table(df.sparkSession).withColumnRenamed("language", "_language")
    return (
        df.withColumn("phrase_key", key)
        .withColumn("_language", F.col(language))
        .join(F.broadcast(table), ["_language", "phrase_key"], "left")
        .withColumn("translated", F.coalesce("translation", step))
        .drop("_language", "phrase_key", "translation")
    )


def decode_labels(df: DataFrame, classes: DataFrame, class_id: str = "class_id") -> DataFrame:
    """Replace class ids by labels; ``classes`` has one row per class id."""
    return df.join(classes, class_id)


def category_of_cluster(df: DataFrame, names: DataFrame) -> DataFrame:
    """Add the category of each row's cluster; clusters without a name are general."""
    return df.join(names, "cluster", "left").withColumn(
        "category", F.coalesce("category", F.lit(C.DEFAULT_CATEGORY))
    )


def known_sessions(df: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """Rows whose session exists."""
    return df.join(sessions.select(session).distinct(), session, "left_semi")


def orphan_sessions(df: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """Rows whose session does not exist, i.e. the rejected requests."""
    return df.join(sessions.select(session).distinct(), session, "left_anti")


def latest_by_session(
    df: DataFrame, session: str = "session_id", order: tuple[str, ...] = ("ts", "event_id")
) -> DataFrame:
    """Last row per session, as if every write replaced the one before."""
    return keep_last(df, [session], list(order))


def feedback_with_conversation(feedback: DataFrame, conversations: DataFrame) -> DataFrame:
    """Latest feedback of known sessions with the conversation, one row per message block."""
    latest = latest_by_session(feedback)
    return latest.join(
        conversations.withColumnRenamed("conv_id", "session_id"), "session_id"
    )
