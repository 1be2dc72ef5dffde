import json

import pytest

from supportlens.operators import filters as L, lookups as J
from supportlens.sinks import writers as W
from supportlens.sources import messages as M, readers as R

QA = "question STRING, answer STRING, category STRING, source STRING, timestamp STRING"


def qa(spark):
    return spark.createDataFrame(
        [
            ('He said "hi", then left', "a,b\nc", "general", "s", "2024-01-01 00:00:00"),
            ("  spaces kept ", None, "returns", "s", "2024-01-01 00:00:00"),
        ],
        QA,
    )


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_csv_keeps_quotes_commas_line_breaks_and_blanks(spark, tmp_path):
    path = W.write_csv_dated(qa(spark), str(tmp_path), "20240101")
    assert rows(R.read_qa_csv(spark, path)) == rows(qa(spark))


def test_latest_csv_is_the_last_name(spark, tmp_path):
    W.write_csv_dated(qa(spark), str(tmp_path), "20240101")
    W.write_csv_dated(qa(spark).limit(1), str(tmp_path), "20240215")
    W.write_csv_dated(qa(spark), str(tmp_path), "20240131")
    W.write_csv_dated(qa(spark), str(tmp_path), "99999999", prefix="other_")
    assert R.latest_dataset(spark, str(tmp_path), "combined_data_").endswith("combined_data_20240215")
    assert R.read_latest_csv(spark, str(tmp_path)).count() == 1


def test_latest_single_files_and_none(spark, tmp_path):
    for day in ("20240101", "20240302"):
        (tmp_path / f"combined_data_{day}.csv").write_text("question,answer,category,source,timestamp\nq,a,c,s,t\n")
    assert R.latest_dataset(spark, str(tmp_path), "combined_data_").endswith("20240302.csv")
    with pytest.raises(FileNotFoundError):
        R.latest_dataset(spark, str(tmp_path), "nothing_")
    with pytest.raises(FileNotFoundError):
        R.latest_dataset(spark, str(tmp_path / "absent"), "combined_data_")


def test_json_array_files(spark, tmp_path):
    record = {"instruction": "i", "response": "đ", "category": "c", "intent": "n"}
    (tmp_path / "a.json").write_text(json.dumps([record, record], indent=2))
    found = R.read_json_records(spark, str(tmp_path), array=True).collect()
    assert [(r.response, r.flags) for r in found] == [("đ", None)] * 2


def test_grouped_json_document(spark, tmp_path):
    document = {
        "returns": [{"question": "q", "answer": "a", "metadata": {"source": "s", "category": "returns"}}],
        "payment": [
            {"question": "p", "answer": "b", "metadata": {"category": "payment", "entities": ["ORDER_ID:1"]}}
        ],
    }
    (tmp_path / "all.json").write_text(json.dumps(document, indent=2))
    found = R.read_grouped_qa(spark, str(tmp_path), whole=True)
    assert rows(found) == [
        ("payment", "p", "b", "unknown", ["ORDER_ID:1"]),
        ("returns", "q", "a", "s", []),
    ]


def test_feedback_reader_skips_broken_and_unrated_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"session_id": "1", "rating": 4, "comments": "ok"}, indent=1))
    (tmp_path / "b.json").write_text('{"session_id": "2", "rating": 5')
    (tmp_path / "c.json").write_text(json.dumps({"session_id": "3", "comment": "no rating"}))
    (tmp_path / "d.json").write_text(json.dumps({"session_id": "4", "rating": 2, "comment": "bad"}))
    found = R.read_feedback(spark, str(tmp_path), array=True).orderBy("session_id").collect()
    assert [(r.session_id, r.rating, r.comment) for r in found] == [("1", 4, "ok"), ("4", 2, "bad")]


def test_upsert_replaces_older_rows_only(spark, tmp_path):
    schema = "session_id INT, rating INT, ts STRING, event_id INT"
    first = spark.createDataFrame([(1, 1, "t1", 1), (2, 2, "t5", 2)], schema)
    later = spark.createDataFrame([(1, 5, "t2", 3), (2, 4, "t4", 4), (3, 3, "t1", 5)], schema)
    W.upsert_by_session(first, str(tmp_path / "store"))
    found = W.upsert_by_session(later, str(tmp_path / "store")).collect()
    assert sorted((r.session_id, r.rating) for r in found) == [(1, 5), (2, 2), (3, 3)]


def test_products_get_two_or_three_questions(spark):
    products = spark.createDataFrame(
        [("A", "8GB", "9.99", "Gaming"), ("B", "x", "1", "Workstation Budget"), ("Student C", "y", "2", "Creator"), ("D", "z", "3", "Business")],
        "name STRING, specs STRING, price STRING, category STRING",
    )
    found = M.expand_product_qa(products).collect()
    assert len(found) == 11
    assert "The A features 8GB. It's priced at $9.99." in {r.answer for r in found}
    use_cases = {r.question for r in found if r.category == "product_recommendation"}
    assert use_cases == {
        "Is the A good for gaming?",
        "Can I use the B for video editing?",
        "Is the Student C suitable for students?",
    }


def test_product_messages_and_rejects(spark):
    requests = spark.createDataFrame(
        [("7", "x"), (None, "mouse"), ("", "pad"), ("", ""), (None, None)], "product_id STRING, product_name STRING"
    )
    assert [r.message for r in M.product_messages(requests).collect()] == [
        "Can you tell me about product #7?", "Can you tell me about mouse?", "Can you tell me about pad?",
    ]
    assert M.rejected_product_requests(requests).count() == 2


def test_ratings_are_split_without_loss(spark):
    frame = spark.createDataFrame([(r,) for r in (0, 1, 5, 6, None)], "rating INT")
    assert [r.rating for r in L.valid_ratings(frame).collect()] == [1, 5]
    assert [r.rating for r in L.rejected_ratings(frame).collect()] == [0, 6, None]


def test_lookups_fall_back(spark):
    frame = spark.createDataFrame(
        [("returns", "vi"), ("unheard", "vi"), (None, "fr")], "intent STRING, language STRING"
    )
    steps = {r.intent: r.next_steps[0] for r in J.with_next_steps(frame).collect()}
    assert steps == {
        "returns": "Làm thế nào để trả lại sản phẩm?",
        "unheard": "Làm thế nào để liên hệ với bộ phận hỗ trợ khách hàng?",
        None: "How can I contact customer support?",
    }
    actions = {r.intent: r.actions for r in J.with_suggested_actions(frame).collect()}
    assert actions["returns"] == ["Start Return", "View Return Policy"]
    assert actions["unheard"] == actions[None] == ["Contact Support"]


def test_sessions_split_without_loss(spark):
    feedback = spark.createDataFrame([(1, 5), (1, 4), (9, 3)], "session_id INT, rating INT")
    sessions = spark.createDataFrame([(1,), (1,), (2,)], "session_id INT")
    assert J.known_sessions(feedback, sessions).count() == 2
    assert [r.session_id for r in J.orphan_sessions(feedback, sessions).collect()] == [9]


def test_topic_filter_treats_null_as_no_match(spark):
    frame = spark.createDataFrame(
        [("a LAPTOP", None, "product_info"), (None, None, "product_info"), ("laptop", "x", "returns")],
        "question STRING, answer STRING, category STRING",
    )
    assert [r.question for r in L.filter_topic(frame).collect()] == ["a LAPTOP"]


def test_split_is_stable_and_about_a_fifth(spark):
    frame = spark.range(2000).withColumnRenamed("id", "k")
    one = {r.k: r.split for r in L.split_train_test(frame, "k").collect()}
    two = {r.k: r.split for r in L.split_train_test(frame.repartition(7), "k").collect()}
    assert one == two
    assert 300 < sum(v == "test" for v in one.values()) < 500


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "a INT, b STRING")
    b = spark.createDataFrame([("y",)], "b STRING")
    assert rows(L.union_sources(a, b).select("a", "b")) == [(1, "x"), (None, "y")]
