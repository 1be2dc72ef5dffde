"""The live metrics as Structured Streaming queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from supportlens.functions import text as X
from supportlens.operators.lookups import with_next_steps
from supportlens.session import work_folder
from supportlens.sinks.keyed_store import BUCKETS, KeyedStore

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Event files as a stream; a watermark needs ``ts`` with a time zone."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


# --- queries --------------------------------------------------------------------------


def message_counts(events: DataFrame, label: str = "event_type") -> DataFrame:
    """Running count per label."""
    return events.groupBy(label).agg(F.count("*").alias("n"))


def hourly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Messages per hour; an hour is final once the watermark has passed it.

    In append mode only final hours are given out, in update mode each hour that changed.
    """
    window = F.window("ts", "1 hour")
    return (
        events.withWatermark("ts", delay)
        .groupBy(window)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("hour_start"), "n")
    )


def session_activity(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Length and size of every user session, closed after ``gap`` without a message.

    In append mode a session is given out when the watermark closes it, and its state ends.
    """
    session = F.session_window("ts", gap)
    return (
        events.withWatermark("ts", delay)
        .groupBy(session, "user_id")
        .agg(F.count("*").alias("n"))
        .select(
            "user_id",
            F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"),
            "n",
        )
    )


def response_times(
    messages: DataFrame, question: Column, answer: Column, horizon: str = "30 minutes", delay: str = "1 hour"
) -> DataFrame:
    """Seconds from every question to the next message of its user, if that is an answer and comes within ``horizon``.

    A question meets the messages after it in an interval join, whose state on both sides ends with
    the watermarks; the first of them decides, once no other can come. So every row is final, and
    questions that may still be answered are not there yet. Both sides are dealt by user and stretch of
    time, so a busy user is spread over tasks. ``question`` and ``answer`` are conditions on a message.
    """
    width = pd.Timedelta(horizon).total_seconds()
    stretch = F.floor(F.unix_micros("ts") / F.lit(int(width * 1_000_000)))
    timed = messages.where(F.col("ts").isNotNull())
    asked = (
        timed.where(question)
        .select("user_id", F.col("ts").alias("asked_at"), F.col("event_id").alias("asked_id"), F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
        .withWatermark("asked_at", delay)
    )
    said = timed.select(
        F.col("user_id").alias("_user"), "ts", "event_id", answer.alias("answers"), stretch.alias("_stretch")
    ).withWatermark("ts", delay)
    after = (F.col("ts") > F.col("asked_at")) | ((F.col("ts") == F.col("asked_at")) & (F.col("event_id") > F.col("asked_id")))
    within = (F.col("ts") >= F.col("asked_at")) & (F.col("ts") <= F.col("asked_at") + F.expr(f"INTERVAL {horizon}"))
    same = F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("stretch") == F.col("_stretch"))
    first = F.min(F.struct("ts", "event_id", "answers")).alias("first")
    return (
        asked.join(said, same & within & after)
        .groupBy("user_id", "asked_id", "asked_at")
        .agg(first)
        .where("first.answers")
        .select("user_id", "asked_id", "asked_at", ((F.unix_micros("first.ts") - F.unix_micros("asked_at")) / 1e6).alias("seconds"))
    )


def scored_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    """Language, intent and follow-up questions for every incoming message."""
    labelled = messages.withColumns(
        {"language": X.detect_language(text), "intent": X.keyword_category(text)}
    )
    return with_next_steps(labelled)


# --- running ------------------------------------------------------------------------------


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there into parquet files and return them as a table."""
    spark = stream.sparkSession
    out = work_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", work_folder(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _run_into(store: KeyedStore, stream: DataFrame, name: str, mode: str, progress: str | None) -> DataFrame:
    """Commit every micro-batch to ``store``; one that runs again counts once."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, name, batch_id)

    query = (
        stream.writeStream.foreachBatch(commit)
        .outputMode(mode)
        .option("checkpointLocation", progress or work_folder(stream.sparkSession, f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store.read()


def run_changes(
    stream: DataFrame, name: str, keys: list[str], folder: str | None = None, progress: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Keep the newest row per key of a stream in update mode; return it after what is there.

    With ``folder`` and ``progress`` of an earlier run the stream goes on where that ended.
    """
    spark = stream.sparkSession
    store = KeyedStore(spark, folder or work_folder(spark, name), stream.schema, keys, buckets=buckets)
    return _run_into(store, stream, name, "update", progress)


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """The whole result after what is there, open windows included.

    Spark keeps the state of all windows here; a stream without an end takes ``run_append``.
    Every micro-batch replaces its own folder, and the last one is the result.
    """
    spark = stream.sparkSession
    out = work_folder(spark, name)
    last: list[int] = []

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last[:] = [batch_id]

    query = (
        stream.writeStream.foreachBatch(store)
        .outputMode("complete")
        .option("checkpointLocation", work_folder(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={last[0]}")


def run_feedback_upsert(
    feedback: DataFrame, name: str, folder: str | None = None, progress: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Keep the latest feedback, or transfer request, per session up to date; return it after what is there."""
    spark = feedback.sparkSession
    store = KeyedStore(spark, folder or work_folder(spark, name), feedback.schema, ["session_id"], ("ts", "event_id"), buckets)
    return _run_into(store, feedback, name, "append", progress)
