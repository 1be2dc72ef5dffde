import random

import pytest
from pyspark.sql import types as T

from supportlens.sinks.keyed_store import Conflict, KeyedStore

SCHEMA = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("ts", T.IntegerType()), T.StructField("value", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(store):
    return sorted(map(tuple, store.read().collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), SCHEMA, ["key"], ("ts",), buckets=4)


def names(store):
    return {bucket: [name for name, _ in held] for bucket, held in store.manifest()["generations"].items()}


def test_an_empty_store_has_no_rows(spark, store):
    assert rows(store) == []
    store.upsert(frame(spark, []))
    assert rows(store) == [] and store.manifest()["version"] == 1


def test_the_newest_row_wins_and_equal_ones_go_by_commit(spark, store):
    store.upsert(frame(spark, [(1, 1, "a"), (1, 3, "b"), (2, 5, "c"), (None, 1, "n")]))
    store.upsert(frame(spark, [(1, 2, "late"), (2, 5, "again"), (None, 2, "m"), (3, None, "no time")]))
    assert rows(store) == sorted([(1, 3, "b"), (2, 5, "again"), (None, 2, "m"), (3, None, "no time")], key=str)


def test_untouched_buckets_are_not_written_again(spark, store):
    store.upsert(spark.range(40_000).selectExpr("cast(id AS int) AS key", "0 AS ts", "cast(id AS string) AS value"))
    before = names(store)
    assert len(before) == 4
    store.upsert(frame(spark, [(7, 1, "y")]))
    after = names(store)
    changed = [bucket for bucket in before if before[bucket] != after[bucket]]
    assert len(changed) == 1 and after[changed[0]][0] == before[changed[0]][0] and len(after[changed[0]]) == 2


def test_a_batch_that_runs_again_changes_nothing(spark, store):
    assert store.upsert(frame(spark, [(1, 1, "a")]), "w", 0) == 1
    assert store.upsert(frame(spark, [(1, 9, "z")]), "w", 0) == 1
    assert store.upsert(frame(spark, [(1, 1, "b")]), "other", 0) == 2
    assert rows(store) == [(1, 1, "b")]


def test_generations_are_merged_and_cleaned(spark, store):
    draw = random.Random(5)
    expected = {}
    for number in range(9):
        changes = [(draw.randrange(60), draw.randrange(100), f"{number}-{i}") for i in range(0 if number == 4 else 25)]
        # Equal times inside a commit have no defined winner.
        changes = list({(k, t): (k, t, v) for k, t, v in changes}.values())
        store.upsert(frame(spark, changes), "w", number)
        for k, t, v in sorted(changes, key=lambda c: c[1]):
            if k not in expected or t >= expected[k][1]:
                expected[k] = (k, t, v)
    assert rows(store) == sorted(expected.values(), key=str)
    for held in store.manifest()["generations"].values():
        sizes = [size for _, size in held]
        assert all(size >= 2 * sum(sizes[i + 1 :]) for i, size in enumerate(sizes))
    kept = {name for held in names(store).values() for name in held}
    lost = store.clean(keep=1)
    assert lost and not kept & set(lost) and rows(store) == sorted(expected.values(), key=str)
    assert store.clean(keep=1) == []


def test_two_writers_conflict(spark, store):
    store.upsert(frame(spark, [(1, 1, "a")]))
    other = KeyedStore(spark, store.folder.path, SCHEMA, ["key"], ("ts",), buckets=9)
    assert other.buckets == 4
    stale = other.manifest()
    store.upsert(frame(spark, [(1, 2, "b")]))
    other.manifest = lambda: stale
    with pytest.raises(Conflict):
        other.upsert(frame(spark, [(1, 3, "c")]))
    assert rows(store) == [(1, 2, "b")]


def test_a_manifest_that_is_being_written_is_not_read(spark, store):
    store.upsert(frame(spark, [(1, 1, "a")]))
    store.folder.create("manifest/0000000002.json", '{"version": 2, "buck')
    assert store.manifest()["version"] == 1 and rows(store) == [(1, 1, "a")]
