"""Streaming queries, run over what is there and returned as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportlens import schemas
from supportlens.operators.lookups import known_sessions
from supportlens.plans import oracle_text as O
from supportlens.plans.registry import query
from supportlens.streaming import streams as S
from supportlens.streaming.session_state import last_state


def _path(sf_dir, table):
    """The table's path as a pattern, which may name a folder as well as a single file."""
    return f"{sf_dir}/{table[:-1]}[{table[-1]}].parquet"


def _events(spark, sf_dir):
    return S.read_events(spark, _path(sf_dir, "events"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_message_counts(spark, sf_dir):
    return S.run_changes(S.message_counts(_events(spark, sf_dir)), "counts", ["event_type"])


@query(
    """SELECT CAST(epoch_us(hour_start) AS BIGINT) AS hour_start_us, n
       FROM (SELECT date_trunc('hour', ts) AS hour_start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1)"""
)
def stream_hourly(spark, sf_dir):
    """All hours, with those still open as they stand."""
    hours = S.run_changes(S.hourly_counts(_events(spark, sf_dir)), "hourly", ["hour_start"])
    return hours.select(F.unix_micros("hour_start").alias("hour_start_us"), "n")


@query(
    """WITH marked AS (
           SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM marked)
       SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n
       FROM numbered WHERE ts IS NOT NULL GROUP BY user_id, no"""
)
def stream_sessions(spark, sf_dir):
    """All sessions, with those still open as they stand."""
    sessions = S.run_complete(S.session_activity(_events(spark, sf_dir)), "sessions")
    return sessions.select(
        "user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n"
    )


@query(
    """WITH marked AS (
           SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
           FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM marked)
       SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS turns, arg_max(event_id, (ts, event_id)) AS event_id,
              arg_max(event_type, (ts, event_id)) AS event_type,
              no < max(no) OVER (PARTITION BY user_id)
                OR max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS closed
       FROM numbered GROUP BY user_id, no"""
)
def stream_last_state(spark, sf_dir):
    """The sessions of all users; those closed have left the state."""
    state = S.run_changes(last_state(_events(spark, sf_dir)), "state", ["user_id", "session_start"])
    return state.select(
        "user_id", F.unix_micros("session_start").alias("start_us"), "turns", "event_id", "event_type", "closed"
    )


@query(
    """SELECT count(*) AS answers, round(avg(seconds), 6) AS avg_seconds FROM (
           SELECT event_type, ts, lead(event_type) OVER w AS next_type,
                  (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS seconds
           FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       WHERE event_type = 'view' AND next_type = 'click' AND seconds <= 1800
         AND ts < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"""
)
def stream_response_times(spark, sf_dir):
    """Mean of the answers that are final, up to two hours before the last message."""
    kind = F.col("event_type")
    events = _events(spark, sf_dir)
    answers = S.run_append(S.response_times(events, kind == "view", kind == "click"), "answers")
    last = spark.read.parquet(_path(sf_dir, "events")).agg((F.max("ts") - F.expr("INTERVAL 2 HOURS")).cast("timestamp"))
    closed = answers.where(F.col("asked_at") < last.scalar())
    return closed.agg(F.count("*").alias("answers"), F.round(F.avg("seconds"), 6).alias("avg_seconds"))


@query(
    """SELECT session_id, event_id, rating, comment FROM feedback
       QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1""",
    "feedback",
)
def stream_feedback_upsert(spark, sf_dir):
    feedback = _events(spark, sf_dir).select(
        "event_id",
        F.col("user_id").alias("session_id"),
        (F.col("event_id") % 6 + 1).cast("int").alias("rating"),
        F.col("event_type").alias("comment"),
        "ts",
    )
    return S.run_feedback_upsert(feedback, "upsert").select("session_id", "event_id", "rating", "comment")


@query(
    """SELECT CAST(session_id AS VARCHAR) AS session_id, event_id, comment AS reason FROM feedback
       WHERE session_id IN (SELECT conv_id FROM conversations)
       QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1""",
    "feedback",
)
def stream_transfers(spark, sf_dir):
    """Requests for a human agent: the last one of every session that exists."""
    requests = _events(spark, sf_dir).select(
        "event_id", F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("reason"), "ts"
    )
    known = spark.read.parquet(_path(sf_dir, "conversations")).select(F.col("conv_id").cast("string").alias("session_id"))
    stored = S.run_feedback_upsert(known_sessions(requests, known), "transfers")
    return stored.select("session_id", "event_id", "reason")


@query(
    f"""SELECT conv_id, turn, m.language AS language, m.intent AS intent, array_to_string(steps, ' / ') AS next_steps
        FROM (SELECT conv_id, turn, {O.language('text')} AS language, {O.category('text')} AS intent
              FROM conversations WHERE role = 'user') m
        JOIN ({O.next_steps_values()}) s(language, intent, steps)
          ON s.intent = m.intent AND s.language = m.language"""
)
def stream_score(spark, sf_dir):
    messages = (
        spark.readStream.schema(schemas.CONVERSATION_TURN)
        .parquet(_path(sf_dir, "conversations"))
        .where("role = 'user'")
    )
    scored = S.scored_messages(messages).select(
        "conv_id", "turn", "language", "intent", F.array_join("next_steps", " / ").alias("next_steps")
    )
    return S.run_append(scored, "scored")
