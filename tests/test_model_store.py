import json

import pytest
from pyspark.sql import functions as F

from supportlens.operators import aggregates as A, evaluate as E, models as M
from supportlens.operators.model_store import LabelDictionary, ModelStore
from supportlens.sources import run_files as RF


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(i, f"{'track my order' if i % 2 else 'refund this return'} please {i % 7}", "order" if i % 2 else "returns") for i in range(200)]
    frame = spark.createDataFrame(rows, "id INT, t STRING, y STRING")
    return frame, *M.train_intent_classifier(frame, "id", "t", "y")


def test_a_stored_model_scores_alike_in_another_session(spark, trained, tmp_path):
    frame, model, scored = trained
    store = ModelStore(spark, str(tmp_path / "models"))
    with pytest.raises(LookupError):
        store.load()
    assert [store.save(model, {"accuracy": 1.0}), store.save(model)] == [1, 2]
    other = ModelStore(spark.newSession(), str(tmp_path / "models"))
    assert other.versions() == [1, 2] and other.described(1) == {"version": 1, "labels": ["order", "returns"], "metrics": {"accuracy": 1.0}}
    scorer = other.load(1)
    unlabelled = frame.select("id", "t")
    got = {r.id: (r.predicted, r.confidence, r.model_version) for r in scorer.score(unlabelled).collect()}
    assert scorer.score(unlabelled).columns == ["id", "t", "predicted", "confidence", "model_version"]
    for r in M.score_labels(scored, model, "id", "y").collect():
        assert got[r.id][0] == r.predicted and got[r.id][1] == pytest.approx(r.confidence) and got[r.id][2] == 1
    with pytest.raises(LookupError):
        other.load(3)


def test_a_model_without_a_manifest_does_not_exist(spark, trained, tmp_path):
    store = ModelStore(spark, str(tmp_path / "models"))
    trained[1].write().save(str(tmp_path / "models" / "models" / "000001"))
    assert store.versions() == [] and store.save(trained[1]) == 1 and store.load().labels == ["order", "returns"]


def test_old_labels_keep_their_ids(spark, tmp_path):
    labels = lambda *names: spark.createDataFrame([(n,) for n in names], "y STRING")
    dictionary = LabelDictionary(spark, str(tmp_path / "labels"))
    ids = lambda: {r.label: (r.class_id, r.since) for r in dictionary.read().collect()}
    assert dictionary.add(labels("m", "c", None, "m"), "y") == 1
    assert ids() == {"c": (0, 1), "m": (1, 1)}
    assert dictionary.add(labels("z", "a", "m"), "y") == 2
    assert ids() == {"c": (0, 1), "m": (1, 1), "a": (2, 2), "z": (3, 2)}
    assert dictionary.add(labels("z", "a", "m"), "y") == 2 and dictionary.add(labels(), "y") == 2
    assert dictionary.add(labels("b"), "y") == 3 and ids()["b"] == (4, 3)
    encoded = LabelDictionary(spark, str(tmp_path / "labels")).encode(labels("a", "new", None), "y").collect()
    assert {(r.y, r.y_id) for r in encoded} == {("a", 2), ("new", None), (None, None)}


def test_run_files_of_both_shapes(spark, tmp_path):
    one = {
        "run_id": "a", "training_loss_history": [3.0, 2.0, 2.5], "validation_loss_history": [4.0, 1.0], "class_names": ["x", "y"],
        "confusion_matrix": [[3, 1], [2, 4]], "training_accuracy_history": [10, 20, 30], "validation_accuracy_history": [5.5, 50.0, 7.0],
    }
    two = {"performance_metrics": {"accuracy": 1, "confusion_matrix": [[5, 0], [0, 2]]}, "timestamp": 1.5}
    for name, run in (("one", one), ("two", two)):
        (tmp_path / f"{name}.json").write_text(json.dumps(run, indent=1))
    runs = RF.read_runs(spark, str(tmp_path))
    history = sorted(map(tuple, RF.histories(runs).collect()))
    assert history == [("a", 1, 3.0, 4.0, 10.0, 5.5), ("a", 2, 2.0, 1.0, 20.0, 50.0), ("a", 3, 2.5, None, 30.0, 7.0)]
    summary = A.run_history_summary(RF.histories(runs)).first().asDict()
    assert summary == {
        "run_id": "a", "epochs": 3, "final_loss": None, "final_training_loss": 2.5, "final_accuracy": 7.0, "final_training_accuracy": 30.0,
        "best_loss": 1.0, "best_training_loss": 2.0, "best_accuracy": 50.0, "best_training_accuracy": 30.0, "best_epoch": 2,
    }
    cells = RF.confusions(runs)
    assert {(r.run_id, r.actual, r.predicted, r.n) for r in cells.collect()} == {
        ("a", "x", "x", 3), ("a", "x", "y", 1), ("a", "y", "x", 2), ("a", "y", "y", 4),
        ("two", "0", "0", 5), ("two", "0", "1", 0), ("two", "1", "0", 0), ("two", "1", "1", 2),
    }
    found = E.weighted_metrics(cells.where("run_id = 'a'"), n="n").first()
    assert found.accuracy == 0.7 and found.recall == 0.7 and found.precision == pytest.approx((4 * 0.6 + 6 * 0.8) / 10)


def test_sorted_importance(spark):
    table = spark.createDataFrame([("b", 0.2), ("a", 0.2), ("c", 0.6), ("d", None)], "feature STRING, importance DOUBLE")
    assert [(r.feature, r["rank"]) for r in M.sort_importance(table).orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3), ("d", 4)]


def test_gaps_are_found_by_one_job(spark):
    from supportlens.operators import profile as P

    frame = spark.createDataFrame([(1.0, None, "x", i) for i in range(4)] + [(None, 2.0, None, 9)], "a DOUBLE, b DOUBLE, c STRING, d INT")
    group = "gaps"
    spark.sparkContext.setJobGroup(group, group)
    P._columns_with_nulls(frame)
    one = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    for fill in (P.fill_mode, P.fill_median):
        name = fill.__name__
        spark.sparkContext.setJobGroup(name, name)
        filled = fill(frame)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        assert jobs <= one + 6 and filled.count() == 5
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
