"""Operators over conversations: one row per (conv_id, turn)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from supportlens import constants as C
from supportlens.functions import text as X
from supportlens.operators.filters import filter_user_turns, valid_ratings
from supportlens.operators.lookups import known_sessions, latest_by_session
from supportlens.operators.ordered import keep_last, with_next_row

# A nested list holds at most this many messages or pairs; longer groups take more rows.
BLOCK = 1000


def _block(column: str, size: int):
    return F.floor(F.col(column) / size)


def last_user_message(turns: DataFrame) -> DataFrame:
    return keep_last(filter_user_turns(turns), ["conv_id"], ["turn"])


def with_next_turn(turns: DataFrame, block_size: int = BLOCK) -> DataFrame:
    return with_next_row(
        turns, ["conv_id"], ["turn"], ["role", "text"], _block("turn", block_size)
    )


def pair_turns(turns: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """Every user turn with the assistant turn that follows it, if one does."""
    answered = F.col("next_row.role") == "assistant"
    return (
        with_next_turn(turns, block_size)
        .where(F.col("role") == "user")
        .select(
            "conv_id",
            "turn",
            F.col("text").alias("question"),
            F.when(answered, F.col("next_row.text")).alias("answer"),
        )
    )


def _nested(blocked: DataFrame) -> DataFrame:
    message = F.struct("turn", "role", "text")
    return blocked.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(message)).alias("messages")
    )


def message_blocks(turns: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """Nested conversations: ordered message lists of at most ``block_size`` messages.

    A conversation up to that length is one row (block 0).
    """
    return _nested(turns.withColumn("block", _block("turn", block_size)))


def history_before_last(turns: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """The history handed over with the last message: everything but the final turn."""
    return _nested(with_next_turn(turns, block_size).where(F.col("next_row").isNotNull()))


def group_pairs(
    df: DataFrame, id_column: str, group: str = "category", block_size: int = BLOCK
) -> DataFrame:
    """Question/answer pairs nested per category.

    ``id_column`` is a unique integer; ids of one block go into one list, so a list
    never exceeds ``block_size`` pairs however large its category is.
    """
    entities = X.extract_entities("question")
    pair = F.struct(
        F.col(id_column).alias("id"),
        "question",
        "answer",
        F.struct(
            F.coalesce("source", F.lit("unknown")).alias("source"),
            F.col(group).alias("category"),
            F.when(F.size(entities) > 0, entities).alias("entities"),
        ).alias("metadata"),
    )
    return df.groupBy(group, _block(id_column, block_size).alias("block")).agg(
        F.array_sort(F.collect_list(pair)).alias("pairs")
    )


def group_examples(
    df: DataFrame,
    id_column: str,
    group: str = "intent",
    example: str = "instruction",
    block_size: int = BLOCK,
) -> DataFrame:
    """Instructions nested per intent, in lists of at most ``block_size``."""
    item = F.struct(F.col(id_column).alias("id"), F.col(example).alias("example"))
    return df.groupBy(group, _block(id_column, block_size).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x.example).alias("examples")
    )


def latest_ratings(feedback: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Latest valid rating per session, of the sessions given only.

    Sessions are reduced to one row before the join, so a busy one is no burden there.
    """
    latest = latest_by_session(valid_ratings(feedback))
    return latest if sessions is None else known_sessions(latest, sessions)


def average_rating(feedback: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Mean of the latest valid rating per session; null when there is none."""
    return latest_ratings(feedback, sessions).agg(
        F.round(F.avg("rating"), 6).alias("average_rating")
    )


def satisfaction_rate(feedback: DataFrame, satisfied_from: int = 4) -> DataFrame:
    """Percent of sessions whose latest valid rating is ``satisfied_from`` or more."""
    return latest_ratings(feedback).agg(
        F.round(
            F.avg(F.when(F.col("rating") >= satisfied_from, 100.0).otherwise(0.0)), 6
        ).alias("satisfaction_percent")
    )


def label_last_messages(turns: DataFrame, model_outputs: DataFrame) -> DataFrame:
    """Last user message per conversation with language, intent and sentiment.

    ``model_outputs`` holds the raw intent and sentiment answers per ``conv_id``.
    """
    return (
        last_user_message(turns)
        .join(model_outputs, "conv_id", "left")
        .select(
            "conv_id",
            "text",
            X.detect_language("text").alias("language"),
            X.normalize_intent("raw_intent").alias("intent"),
            X.normalize_sentiment("raw_sentiment").alias("sentiment"),
        )
    )


def conversation_analytics(
    turns: DataFrame, feedback: DataFrame, model_outputs: DataFrame
) -> DataFrame:
    """Long table (metric, key, value): sessions, mean rating and label counts.

    Sessions without a user message count in the total only; ratings of unknown
    sessions are not accepted.
    """
    total = turns.agg(F.countDistinct("conv_id").cast("double").alias("value"))
    sessions = turns.select(F.col("conv_id").alias("session_id"))
    rating = average_rating(feedback, sessions).withColumnRenamed("average_rating", "value")
    labels = label_last_messages(turns, model_outputs).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("metric"), F.col(name).alias("key"))
                    for name in ("language", "intent", "sentiment")
                ]
            )
        ).alias("label")
    )
    counts = labels.groupBy("label.metric", "label.key").agg(
        F.count("*").cast("double").alias("value")
    )

    def single(frame: DataFrame, metric: str) -> DataFrame:
        return frame.select(F.lit(metric).alias("metric"), F.lit("all").alias("key"), "value")

    return (
        single(total, "total_conversations")
        .unionByName(single(rating, "average_rating"))
        .unionByName(counts)
    )


def response_times(
    messages: DataFrame, session: str, ts: str, order: list[str], question, answer
) -> DataFrame:
    """Seconds from every question to the next message of its session if that is an answer.

    ``question`` and ``answer`` are conditions on a message. The order is split by
    hour, so that one busy session does not end up in one task.
    """
    hour = F.date_trunc("hour", F.col(ts))
    marked = messages.select(
        session, ts, *[c for c in order if c != ts], question.alias("_asks"), answer.alias("_answers")
    )
    following = with_next_row(marked, [session], order, ["_answers"], hour)
    seconds = F.unix_micros(F.col(f"next_row.{ts}").cast("timestamp")) - F.unix_micros(
        F.col(ts).cast("timestamp")
    )
    return following.where("_asks AND next_row._answers").select(
        session, ts, (seconds / 1e6).alias("seconds")
    )


def common_issues(
    feedback: DataFrame, turns: DataFrame, n: int = 10, unhappy_to: int = 2, salts: int = 16
) -> DataFrame:
    """Most frequent cleaned words in the user turns of sessions rated ``unhappy_to`` or less.

    A word counts once per session, so long conversations do not dominate. The turns
    of a session are joined in ``salts`` parts, so a long one does not hold up a task.
    """
    unhappy = (
        latest_ratings(feedback)
        .where(F.col("rating") <= unhappy_to)
        .select(
            F.col("session_id").alias("conv_id"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
        )
    )
    salt = F.pmod(F.xxhash64("turn"), F.lit(salts)).cast("int")
    words = (
        filter_user_turns(turns)
        .withColumn("_salt", salt)
        .join(unhappy, ["conv_id", "_salt"], "left_semi")
        .select("conv_id", F.explode(F.split(X.clean_text("text"), " ")).alias("word"))
        .where(F.col("word") != "")
        .distinct()
    )
    return (
        words.groupBy("word")
        .agg(F.count("*").alias("sessions"))
        .orderBy(F.desc("sessions"), "word")
        .limit(n)
    )


def retrieved_context(matches: DataFrame, documents: DataFrame, id_column: str, text: str) -> DataFrame:
    """Texts of the few retrieved documents per query, nearest first."""
    texts = documents.select(F.col(id_column).alias("match_id"), F.col(text).alias("_text"))
    found = F.array_sort(F.collect_list(F.struct("rank", "_text")))
    return (
        matches.join(texts, "match_id")
        .groupBy("query_id")
        .agg(F.transform(found, lambda item: item["_text"]).alias("context"))
    )


def _filled(lines: list[str], indent: str, values: dict[str, Column]) -> Column:
    """Lines joined with their indent; every ``{slot}`` takes its column, in line order."""
    template = f"\n{indent}".join(lines)
    for slot in values:
        template = template.replace("{" + slot + "}", "%s")
    return F.format_string(template, *values.values())


def prompts(messages: DataFrame) -> DataFrame:
    """Add ``prompt``, the full text handed to a language model.

    Needs the columns message, language, intent, sentiment and context (an array of
    retrieved documents).
    """
    base = f"\n{C.SYSTEM_PROMPT_INDENT}".join(C.SYSTEM_PROMPT_LINES)
    tone = F.when(F.col("sentiment") == "negative", "\n" + C.NEGATIVE_PROMPT_LINE).when(
        F.col("sentiment") == "positive", "\n" + C.POSITIVE_PROMPT_LINE
    ).otherwise("")
    language = F.when(F.col("language") == "vi", "\n" + C.VIETNAMESE_PROMPT_LINE).otherwise("")
    values = {
        "system": F.concat(F.lit(base), tone, language),
        "context": F.coalesce(F.array_join("context", "\n\n"), F.lit("")),
        "intent": F.col("intent"),
        "message": F.col("message"),
    }
    return messages.withColumn(
        "prompt", _filled(C.CHAT_PROMPT_LINES, C.CHAT_PROMPT_INDENT, values)
    )


def short_prompts(messages: DataFrame) -> DataFrame:
    """Add ``prompt`` in the short form: context and message only."""
    values = {
        "context": F.coalesce(F.array_join("context", "\n"), F.lit("")),
        "message": F.col("message"),
    }
    return messages.withColumn(
        "prompt", _filled(C.SHORT_PROMPT_LINES, C.SHORT_PROMPT_INDENT, values)
    )


def label_prompts(messages: DataFrame, message: str = "message") -> DataFrame:
    """Add the prompts whose answers ``normalize_intent`` and ``normalize_sentiment`` read."""
    values = {"message": F.col(message)}
    return messages.withColumns(
        {
            "intent_prompt": _filled(C.INTENT_PROMPT_LINES, C.LABEL_PROMPT_INDENT, values),
            "sentiment_prompt": _filled(C.SENTIMENT_PROMPT_LINES, C.LABEL_PROMPT_INDENT, values),
        }
    )


def analyze_pairs(pairs: DataFrame) -> DataFrame:
    """Question/answer pairs with cleaned texts, word counts and entities."""
    return pairs.withColumns(
        {
            "question_clean": X.clean_text("question"),
            "answer_clean": X.clean_text("answer"),
            "question_length": X.word_count("question"),
            "answer_length": X.word_count("answer"),
            "entities": X.extract_entities("question"),
        }
    )
