import pandas as pd
import pytest
from pyspark.sql import functions as F

from supportlens.streaming import streams as S
from supportlens.streaming.session_state import SessionState, last_state, session_states

ROWS = [
    # (event_id, ts, user_id, event_type); user 1 sends most of the rows
    (1, "2024-01-01 10:00:00", 1, "view"),
    (2, "2024-01-01 10:10:00", 1, "click"),
    (3, "2024-01-01 10:45:00", 1, "view"),
    (4, "2024-01-01 12:00:00", 2, "view"),
    (5, "2024-01-02 09:00:00", 1, "click"),
    (6, "2024-01-02 09:29:59", 1, "click"),
    (7, "2024-01-02 13:00:00", 1, "error"),
]
LATE = (8, "2024-01-01 10:20:00", 1, "late")


def event_rows(spark, rows):
    frame = spark.createDataFrame(rows, "event_id BIGINT, ts STRING, user_id BIGINT, event_type STRING")
    return frame.select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value")
    )


@pytest.fixture
def folder(spark, tmp_path):
    """One file per day, written in order, and a late row in the last file."""
    path = str(tmp_path / "events")
    for rows in (ROWS[:4], ROWS[4:], [LATE]):
        event_rows(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return S.read_events(spark, folder, files_per_batch=1)


def test_counts_equal_the_batch_result(spark, folder):
    found = S.run_changes(S.message_counts(stream(spark, folder)), "counts", ["event_type"]).collect()
    assert {r.event_type: r.n for r in found} == {"view": 3, "click": 3, "error": 1, "late": 1}


def states(frame):
    return sorted((r.user_id, str(r.session_start)[5:16], r.event_id, r.turns, r.closed) for r in frame.collect())


def test_idle_sessions_leave_the_state_and_late_turns_replace_nothing(spark, folder):
    found = S.run_changes(last_state(stream(spark, folder)), "state", ["user_id", "session_start"])
    # Event 8 is behind the watermark of the day before and left out.
    assert states(found) == [
        (1, "01-01 10:00", 2, 2, True), (1, "01-01 10:45", 3, 1, True), (1, "01-02 09:00", 6, 2, True),
        (1, "01-02 13:00", 7, 1, False), (2, "01-01 12:00", 4, 1, True),
    ]


def test_late_turns_inside_the_watermark_count_but_replace_nothing(spark, folder):
    found = S.run_changes(last_state(stream(spark, folder), gap="2 days", delay="9 days"), "state", ["user_id", "session_start"])
    assert states(found) == [(1, "01-01 10:00", 7, 7, False), (2, "01-01 12:00", 4, 1, False)]


def test_state_goes_on_after_a_restart(spark, tmp_path):
    path, store, progress = (str(tmp_path / name) for name in ("events", "store", "progress"))
    run = lambda: states(
        S.run_changes(last_state(S.read_events(spark, path)), "state", ["user_id", "session_start"], store, progress)
    )
    add = lambda *rows: event_rows(spark, rows).coalesce(1).write.mode("append").parquet(path)
    add(ROWS[0])
    assert run() == [(1, "01-01 10:00", 1, 1, False)]
    add(ROWS[1])
    assert run() == [(1, "01-01 10:00", 2, 2, False)]
    versions = len(list((tmp_path / "store" / "manifest").glob("*.json")))
    assert run() == [(1, "01-01 10:00", 2, 2, False)]
    assert len(list((tmp_path / "store" / "manifest").glob("*.json"))) <= versions + 1
    add(ROWS[4])
    assert run() == [(1, "01-01 10:00", 2, 2, True), (1, "01-02 09:00", 5, 1, False)]


def test_state_begins_with_a_snapshot(spark, tmp_path):
    path = str(tmp_path / "events")
    event_rows(spark, [(9, "2024-01-01 12:20:00", 2, "click"), (10, "2024-01-01 12:25:00", 3, "view")]).write.parquet(path)
    before = event_rows(spark, ROWS[:4]).withColumn("ts", F.col("ts").cast("timestamp"))
    newest = session_states(before).where("event_id IN (3, 4)")
    found = S.run_changes(last_state(S.read_events(spark, path), snapshot=newest), "state", ["user_id", "session_start"])
    # The session of user 1 is known from the snapshot alone and ends by its timer.
    assert states(found) == [(1, "01-01 10:45", 3, 1, True), (2, "01-01 12:00", 9, 2, False), (3, "01-01 12:25", 10, 1, False)]


def test_answers_are_final_and_equal_the_batch(spark, tmp_path):
    rows = [
        (1, "2024-01-01 10:00:00", 1, "view"), (2, "2024-01-01 10:00:00", 1, "click"), (3, "2024-01-01 10:05:00", 1, "view"),
        (4, "2024-01-01 10:06:00", 1, "view"), (5, "2024-01-01 10:36:00", 1, "click"), (6, "2024-01-01 11:00:00", 2, "view"),
        (7, "2024-01-01 11:31:00", 2, "click"), (8, "2024-01-01 12:00:00", 2, "view"), (9, "2024-01-01 12:10:00", 2, "error"),
        (10, "2024-01-01 12:20:00", 2, "click"), (11, "2024-01-02 12:00:00", 1, "view"), (12, "2024-01-02 12:00:10", 1, "click"),
    ]
    path = str(tmp_path / "events")
    for part in (rows[:3], rows[3:6], rows[6:11], rows[11:]):
        event_rows(spark, part).coalesce(1).write.mode("append").parquet(path)
    kind = F.col("event_type")
    answers = S.run_append(S.response_times(stream(spark, path), kind == "view", kind == "click"), "answers")
    assert sorted((r.asked_id, r.seconds) for r in answers.collect()) == [(1, 0.0), (4, 1800.0)]
    assert answers.select("user_id", "asked_at").columns == ["user_id", "asked_at"]


def test_hours_are_final_and_late_rows_dropped(spark, folder):
    found = S.run_append(S.hourly_counts(stream(spark, folder)), "hourly").collect()
    hours = {str(r.hour_start): r.n for r in found}
    assert hours == {
        "2024-01-01 10:00:00": 3, "2024-01-01 12:00:00": 1, "2024-01-02 09:00:00": 2,
    }


def test_sessions_close_after_the_gap(spark, folder):
    found = S.run_append(S.session_activity(stream(spark, folder)), "sessions").collect()
    assert sorted((r.user_id, str(r.session_start), r.n) for r in found) == [
        (1, "2024-01-01 10:00:00", 2),
        (1, "2024-01-01 10:45:00", 1),
        (1, "2024-01-02 09:00:00", 2),
        (2, "2024-01-01 12:00:00", 1),
    ]


def test_open_hours_and_sessions_are_in_the_whole_result(spark, folder):
    hours = S.run_changes(S.hourly_counts(stream(spark, folder)), "open-hours", ["hour_start"]).collect()
    assert {str(r.hour_start): r.n for r in hours}["2024-01-02 13:00:00"] == 1
    assert len(hours) == 4
    found = S.run_complete(S.session_activity(stream(spark, folder)), "open-sessions").collect()
    assert sorted((r.user_id, str(r.session_start), r.n) for r in found)[-2:] == [
        (1, "2024-01-02 13:00:00", 1), (2, "2024-01-01 12:00:00", 1),
    ]
    assert sum(r.n for r in found) >= len(ROWS)


def test_feedback_upsert_ignores_late_rows(spark, folder):
    feedback = stream(spark, folder).select(
        "event_id", F.col("user_id").alias("session_id"), F.col("event_type").alias("comment"), "ts"
    )
    found = S.run_feedback_upsert(feedback, "upsert").collect()
    assert {r.session_id: r.event_id for r in found} == {1: 7, 2: 4}


def test_messages_are_scored(spark, folder):
    messages = stream(spark, folder).withColumn("text", F.lit("Where is my order?"))
    found = S.run_append(S.scored_messages(messages).select("event_id", "intent", "next_steps"), "scored").collect()
    assert len(found) == len(ROWS) + 1
    assert {r.intent for r in found} == {"order_tracking"}
    assert found[0].next_steps[0] == "When will my order arrive?"


class OneRead:
    """A state value and its handle that offer one read a call, as each is a trip to the JVM."""

    def __init__(self, value=None):
        self.value, self.reads, self.timers = value, 0, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.reads += 1
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_user_costs_one_read_of_the_state():
    handle, state = OneRead(), SessionState(gap_us=1000)
    state.init(handle)
    names = ["user_id", "start_us", "last_us", "event_id", "event_type", "turns"]
    frames = [pd.DataFrame([(7, 9000, 9500, 3, "b", 2)], columns=names), pd.DataFrame([(7, 1000, 2000, 1, "a", 2), (7, 2500, 2500, 2, None, 1)], columns=names)]
    rows = pd.concat(state.handleInputRows((7,), iter(frames), None))
    assert rows.astype(object).where(rows.notna(), None).values.tolist() == [
        [7, 1000, 2500, 2, None, 3, True], [7, 9000, 9500, 3, "b", 2, False]
    ]
    assert handle.reads == 1 and handle.timers == [11] and handle.value == (9000, 9500, 3, "b", 2)
    closed = pd.concat(state.handleExpiredTimer((7,), None, None))
    assert closed.values.tolist() == [[7, 9000, 9500, 3, "b", 2, True]]
    assert handle.reads == 2 and handle.value is None
    assert list(state.handleExpiredTimer((7,), None, None)) == []
