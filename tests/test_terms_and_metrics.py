import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from supportlens.operators import aggregates as A, evaluate as E, models as M, terms as T

DOCUMENTS = ["order track order", "return item", "order item item x", "", "track"]


def expected_weights(documents, size):
    tokens = [[w for w in d.split() if len(w) > 1] for d in documents]
    totals = Counter(w for t in tokens for w in t)
    terms = sorted(totals, key=lambda w: (-totals[w], w))[:size]
    spread = Counter(w for t in tokens for w in set(t) & set(terms))
    found = {}
    for i, t in enumerate(tokens):
        raw = {
            w: n * (math.log((1 + len(documents)) / (1 + spread[w])) + 1)
            for w, n in Counter(t).items()
            if w in terms
        }
        norm = math.sqrt(sum(x * x for x in raw.values()))
        found.update({(i, w): x / norm for w, x in raw.items()})
    return found


@pytest.mark.parametrize("size", [1000, 3])
def test_tfidf_weights(spark, size):
    frame = T.with_terms(spark.createDataFrame(list(enumerate(DOCUMENTS)), "id INT, c STRING"), "c")
    found = {(r.id, r.term): r.weight for r in T.tfidf_weights(frame, "id", size).collect()}
    assert found == pytest.approx(expected_weights(DOCUMENTS, size))


def test_cluster_names_follow_the_category_order(spark):
    top = spark.createDataFrame(
        [(0, "product"), (0, "order"), (1, "recommendation"), (1, "x"), (2, "nothing")],
        "cluster INT, term STRING",
    )
    assert {r.cluster: r.category for r in T.name_clusters(top).collect()} == {
        0: "order_tracking", 1: "product_recommendation", 2: "general",
    }


def test_clustering_gives_every_row_a_category(spark):
    texts = ["order track parcel", "return refund item", "pay payment card"] * 8
    frame = spark.createDataFrame(list(enumerate(texts)), "id INT, c STRING")
    found = T.cluster_categories(T.with_terms(frame, "c")).collect()
    assert len(found) == 24
    by_text = {}
    for row in found:
        by_text.setdefault(row.c, set()).add(row.category)
    assert by_text["order track parcel"] == {"order_tracking"}
    assert by_text["pay payment card"] == {"payment"}


PREDICTED = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")] + [("b", "d")]


def predictions(spark):
    return spark.createDataFrame(PREDICTED, "actual STRING, predicted STRING")


def test_confusion_matrix_keeps_zeros_and_sums_to_the_rows(spark):
    found = {(r.actual, r.predicted): r.n for r in E.confusion_matrix(predictions(spark)).collect()}
    assert len(found) == 16 and sum(found.values()) == len(PREDICTED)
    assert found["a", "b"] == 2 and found["d", "a"] == 0


def test_metrics_by_hand(spark):
    scores = {"a": (5 / 6, 5 / 7, 7), "b": (3 / 5, 3 / 4, 4), "c": (0, 0, 1), "d": (0, 0, 0)}
    f1 = {k: 2 * p * r / (p + r) if p + r else 0 for k, (p, r, _) in scores.items()}
    found = E.weighted_metrics(predictions(spark)).first()
    assert found.accuracy == pytest.approx(8 / 12, abs=1e-6)
    assert found.precision == pytest.approx(sum(p * s for p, _, s in scores.values()) / 12, abs=1e-6)
    assert found.recall == pytest.approx(8 / 12, abs=1e-6)
    assert found.f1 == pytest.approx(sum(f1[k] * scores[k][2] for k in scores) / 12, abs=1e-6)
    report = {r.label: r for r in E.class_report(predictions(spark)).collect()}
    assert report["macro avg"].f1 == pytest.approx(sum(f1.values()) / 4, abs=1e-6)
    assert report["d"].support == 0 and report["weighted avg"].support == 12


def test_top_labels_break_ties_by_class(spark):
    frame = spark.createDataFrame([(1, [0.2, 0.4, 0.2, 0.2])], "id INT, p ARRAY<DOUBLE>")
    found = E.top_labels(frame, "id", "p").collect()
    assert [(r.rank, r.class_id, r.confidence) for r in found] == [(1, 1, 0.4), (2, 0, 0.2), (3, 2, 0.2)]


def test_label_ids_are_alphabetical_over_many_ranges(spark):
    labels = [f"l{i:03d}" for i in range(300)]
    frame = spark.createDataFrame([(x,) for x in labels * 2 + [None]], "x STRING").repartition(8)
    found = {r.label: r.class_id for r in M.label_index(frame, "x").collect()}
    assert found == {label: i for i, label in enumerate(labels)}


def test_intent_classifier_learns_separable_texts(spark):
    rows = [
        (i, f"{'track my order' if i % 2 else 'refund this return'} please {i % 7}", "order" if i % 2 else "returns")
        for i in range(200)
    ]
    frame = spark.createDataFrame(rows, "id INT, t STRING, y STRING")
    model, scored = M.train_intent_classifier(frame, "id", "t", "y")
    assert scored.count() == 200
    found = E.weighted_metrics(M.score_labels(scored.where("split = 'test'"), model, "id", "y")).first()
    assert found.accuracy > 0.95
    fresh = model.transform(frame.where("id < 2"))
    assert fresh.where(F.col("prediction") == F.col("class_id")).count() == 2


def test_forest_importance_sums_to_one(spark):
    rows = [(i, float(i % 5), float(i % 2), "x" if i % 2 else "y") for i in range(120)]
    frame = spark.createDataFrame(rows, "id INT, a DOUBLE, b DOUBLE, y STRING")
    model, scored = M.train_category_forest(frame, "id", ["a", "b"], "y", trees=10)
    importance = M.feature_importance(model, ["a", "b"], frame).collect()
    assert importance[0].feature == "b"
    assert sum(r.importance for r in importance) == pytest.approx(1.0)
    assert scored.count() == frame.count() - model.transform(frame).join(scored, "id", "left_anti").count()


def test_neighbours_that_belong_together_are_one_term(spark):
    import math
    from collections import Counter

    from supportlens.operators import aggregates as A

    texts = ["new york is big"] * 12 + ["a b c d e f g h"] * 3 + ["york", "", "new day is new"] + [f"x{i} y{i}" for i in range(40)]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t STRING")
    words = [t.split() for t in texts]
    single = Counter(w for ws in words for w in ws)
    pairs = Counter(p for ws in words for p in zip(ws, ws[1:], strict=False))
    t = sum(single.values())

    def score(a, b):
        k, na, nb = pairs[a, b], single[a], single[b]
        cells = [(k, na, nb), (na - k, na, t - nb), (nb - k, t - na, nb), (t - na - nb + k, t - na, t - nb)]
        return 2 * sum(c * math.log(c * t / (r * s)) for c, r, s in cells if c > 0)

    found = {(r.a, r.b): (r.n, r.score) for r in A.word_pairs(frame, "t", least=20.0).collect()}
    assert ("new", "york") in found
    assert found == {p: (n, pytest.approx(score(*p))) for p, n in pairs.items() if score(*p) > 20}
    terms = {r.term: r.n for r in A.term_frequencies(frame, "t", n=500, least=20.0).collect()}
    expected = Counter(single)
    for (a, b), (n, _) in found.items():
        expected[a] -= n
        expected[b] -= n
        expected[f"{a} {b}"] += n
    assert terms == {term: n for term, n in expected.items() if n > 0}


def ratio(k, na, nb, t):
    cells = ((k, na, nb), (na - k, na, t - nb), (nb - k, t - na, nb), (t - na - nb + k, t - na, t - nb))
    return 2 * sum(c * math.log(c * t / (row * column)) for c, row, column in cells if c > 0)


def test_pairs_that_cannot_reach_the_floor_are_left_out_and_no_others(spark):
    rng = random.Random(4)
    words = [f"w{min(int(rng.expovariate(0.25)), 40)}" for _ in range(6000)]
    words[1000:1040] = ["left", "right"] * 20
    # Two frequent words that never stand together but once: a high ratio from a low count.
    words = [w for pair in zip(words, words[1:]) if set(pair) != {"w0", "w1"} for w in pair[:1]]
    lines = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + ["w0 w1", "alone", ""]
    texts = [line.split() for line in lines]
    single = Counter(w for t in texts for w in t)
    pairs = Counter(p for t in texts for p in zip(t, t[1:]))
    total = sum(single.values())
    scores = {p: ratio(n, single[p[0]], single[p[1]], total) for p, n in pairs.items()}
    frame = spark.createDataFrame([(line,) for line in lines], "t STRING")
    counted, found, n_words = A._counted(frame, "t")
    assert n_words == total and {r.word: r.n for r in counted.collect()} == dict(single)
    assert {(r.a, r.b): r.n for r in found.collect()} == dict(pairs)
    for floor in (3.0, 30.0, 100.0):
        kept = {(r.a, r.b) for r in A.pairs_that_reach(found, counted, n_words, floor).collect()}
        assert {p for p, s in scores.items() if s >= floor} <= kept
    assert ("left", "right") in kept and len(kept) < len(pairs) / 2
    best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:15]
    top = A.word_pairs(frame, "t", n=15, least=1.0).collect()
    assert [round(r.score, 6) for r in top] == [round(s, 6) for _, s in best]


def test_words_of_nothing(spark):
    frame = spark.createDataFrame([("",), (None,)], "t STRING")
    assert A.word_pairs(frame, "t").count() == 0 and A.term_frequencies(frame, "t").count() == 0
