import random

from pyspark.sql import functions as F

from supportlens.operators import conversations as V, ordered as D


def conversation_rows():
    """One conversation with a third of all turns, gaps in the turns, and many short ones."""
    rng = random.Random(7)
    rows = []
    for conv, size in [(0, 120), *[(c, rng.randint(1, 8)) for c in range(1, 50)]]:
        turn = rng.randint(0, 30)
        for _ in range(size):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), f"t{conv}-{turn}"))
            turn += rng.choice([1, 1, 1, 2, 40])
    rng.shuffle(rows)
    return rows


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")


def by_conversation(rows):
    grouped = {}
    for row in sorted(rows):
        grouped.setdefault(row[0], []).append(row)
    return grouped


def test_next_turn_across_blocks_and_gaps(spark):
    rows = conversation_rows()
    expected = {}
    for group in by_conversation(rows).values():
        for row, following in zip(group, [*group[1:], None]):
            expected[row[:2]] = following and (following[1], following[2], following[3])
    for block_size in (5, 1000):
        found = V.with_next_turn(turns(spark, rows), block_size).collect()
        assert {(r.conv_id, r.turn): r.next_row and tuple(r.next_row) for r in found} == expected


def test_pair_turns_takes_direct_answers_only(spark):
    rows = conversation_rows()
    expected = set()
    for group in by_conversation(rows).values():
        for row, following in zip(group, [*group[1:], None]):
            if row[2] == "user":
                answer = following[3] if following and following[2] == "assistant" else None
                expected.add((row[0], row[1], row[3], answer))
    assert {tuple(r) for r in V.pair_turns(turns(spark, rows), 7).collect()} == expected


def test_history_leaves_out_the_last_turn_and_bounds_lists(spark):
    rows = conversation_rows()
    found = V.history_before_last(turns(spark, rows), 10).collect()
    assert max(len(r.messages) for r in found) <= 10
    got = sorted((r.conv_id, m.turn, m.role, m.text) for r in found for m in r.messages)
    assert got == sorted(row for g in by_conversation(rows).values() for row in g[:-1])
    assert all([m.turn for m in r.messages] == sorted(m.turn for m in r.messages) for r in found)


def test_last_user_message(spark):
    rows = conversation_rows()
    expected = {}
    for conv, group in by_conversation(rows).items():
        user = [r for r in group if r[2] == "user"]
        if user:
            expected[conv] = user[-1][1]
    found = V.last_user_message(turns(spark, rows)).collect()
    assert {r.conv_id: r.turn for r in found} == expected


def test_keep_first_treats_nulls_as_equal_and_is_idempotent(spark):
    frame = spark.createDataFrame(
        [(3, "a", 1), (1, "a", None), (2, None, 5), (4, None, 6), (5, "b", 7)], "id INT, k STRING, v INT"
    )
    first = D.keep_first(frame, ["k"], ["id"])
    assert sorted(map(tuple, first.collect())) == [(1, "a", None), (2, None, 5), (5, "b", 7)]
    assert sorted(map(tuple, D.keep_first(first, ["k"], ["id"]).collect())) == sorted(map(tuple, first.collect()))


def test_first_null_row_removes_its_key(spark):
    """Duplicates go before incomplete rows, so a key whose first row is incomplete vanishes."""
    from supportlens.functions.text import normalize_instruction

    frame = spark.createDataFrame([(1, "Hi", None), (2, "hi ", "ok")], "id INT, i STRING, r STRING")
    normal = frame.withColumn("i", normalize_instruction("i"))
    assert D.keep_first(normal, ["i"], ["id"]).na.drop("any").count() == 0


def test_examples_per_category_with_one_large_category(spark):
    frame = spark.range(100).select(
        F.col("id"), F.when(F.col("id") < 40, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 20)).alias("g")
    )
    found = D.examples_per_category(frame, "g", "id").collect()
    assert [r.id for r in found if r.g == "hot"] == [0, 1, 2]
    assert {r.more for r in found if r.g == "hot"} == {37}
    assert {r.more for r in found if r.g != "hot"} == {0}


def test_grouped_lists_are_bounded_and_whole(spark):
    pairs = spark.range(250).select(
        "id",
        F.concat(F.lit("order #"), "id").alias("question"),
        F.lit("a").alias("answer"),
        F.lit(None).cast("string").alias("source"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("rest").alias("category"),
    )
    found = V.group_pairs(pairs, "id", block_size=20).collect()
    assert max(len(r.pairs) for r in found) <= 20
    assert sorted(p.id for r in found for p in r.pairs) == list(range(250))
    first = min((p for r in found for p in r.pairs), key=lambda p: p.id)
    assert first.metadata.entities == ["ORDER_ID:0"] and first.metadata.source == "unknown"


def test_response_times_across_hours(spark):
    rows = [
        (1, "2024-01-01 00:59:50", 1, "q"),
        (1, "2024-01-01 01:00:05", 2, "a"),
        (1, "2024-01-01 05:00:00", 3, "q"),
        (1, "2024-01-01 09:00:00", 4, "q"),
        (1, "2024-01-01 09:00:02", 5, "a"),
        (2, "2024-01-01 09:00:00", 6, "q"),
    ]
    frame = spark.createDataFrame(rows, "s INT, t STRING, id INT, kind STRING").withColumn(
        "t", F.col("t").cast("timestamp")
    )
    kind = F.col("kind")
    found = V.response_times(frame, "s", "t", ["t", "id"], kind == "q", kind == "a").collect()
    assert sorted(r.seconds for r in found) == [2.0, 15.0]
