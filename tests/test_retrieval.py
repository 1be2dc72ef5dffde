import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from supportlens.operators import conversations as V, retrieval as R, vector_index as I

SCHEMA = "id BIGINT, v ARRAY<FLOAT>, g STRING"


def vectors(n=90, width=6, seed=5):
    """Vectors with a third of them equal, and one group holding most rows."""
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(n, width)).astype(np.float32)
    matrix[: n // 3] = matrix[0]
    return [(i, matrix[i].tolist(), "hot" if i % 10 < 7 else f"g{i % 3}") for i in range(n)]


def brute_force(rows, k, same_group=False, skip_self=True):
    found = {}
    for i, v, g in rows:
        scored = [
            (round(float(((np.array(v) - np.array(w)) ** 2).sum()), 6), j)
            for j, w, h in rows
            if (j != i or not skip_self) and (g == h or not same_group)
        ]
        found[i] = [j for _, j in sorted(scored)[:k]]
    return found


def matches(frame):
    found = {}
    for row in frame.orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append(row.match_id)
    return found


@pytest.mark.parametrize("broadcast_bytes, block_rows", [(1 << 20, 4096), (1 << 20, 7), (0, 4096), (0, 11)])
def test_topk_is_exact_on_every_path(spark, broadcast_bytes, block_rows):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = R.vector_topk(
        frame, frame, "id", "v", 3, skip_self=True, broadcast_bytes=broadcast_bytes, block_rows=block_rows
    )
    assert matches(found) == brute_force(rows, 3)


@pytest.mark.parametrize("block_rows", [4096, 9])
def test_topk_within_groups_splits_the_large_group(spark, block_rows):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA)
    found = R.vector_topk_within(frame, frame, "id", "v", ["g"], 3, True, block_rows)
    assert matches(found) == {i: m for i, m in brute_force(rows, 3, same_group=True).items() if m}


def test_small_corpus_and_no_queries(spark):
    frame = spark.createDataFrame(vectors(2), SCHEMA)
    assert matches(R.vector_topk(frame, frame, "id", "v", 3, skip_self=True)) == {0: [1], 1: [0]}
    assert R.vector_topk(frame.where("id < 0"), frame, "id", "v").count() == 0


def test_general_queries_search_everything(spark):
    rows = [(i, v, "general" if i % 4 == 0 else g) for i, v, g in vectors()]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = matches(R.retrieve(frame, frame, "id", "v", "g", skip_self=True))
    anywhere, within = brute_force(rows, 3), brute_force(rows, 3, same_group=True)
    for i, _, g in rows:
        assert found.get(i, []) == (anywhere if g == "general" else within)[i]


def clustered(n_clusters=60, each=25, width=24, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, width))
    points = np.concatenate([c + 0.05 * rng.normal(size=(each, width)) for c in centres])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    return points[rng.permutation(len(points))]


def test_ann_of_clusters_reads_less_than_a_tenth_of_all_pairs(spark):
    frame = spark.createDataFrame([(i, p.tolist(), "") for i, p in enumerate(clustered())], SCHEMA).repartition(3)
    index = I.VectorIndex.build(frame, "id", "v", 4)
    exact = R.vector_topk(frame, frame, "id", "v", 3, skip_self=True)
    found = I.recall(exact, index.search(frame, "id", "v", 3, skip_self=True, probes=4)).first()
    work = index.work(frame, "id", "v", probes=4).first()
    assert found.recall > 0.95 and work.share_read < 0.1 and work.share_compared < 0.03
    assert index.codes.count() == 1500


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_ann_of_vectors_without_structure(spark, monkeypatch, block):
    monkeypatch.setattr(I, "BLOCK_CODES", block)
    monkeypatch.setattr(I, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 20))
    points[:100] = points[0]
    frame = spark.createDataFrame([(i, p.tolist(), "") for i, p in enumerate(points)], SCHEMA)
    exact = R.vector_topk(frame, frame, "id", "v", 3, skip_self=True)
    assert I.recall(exact, I.ann_topk(frame, frame, "id", "v", 3, skip_self=True, probes=28)).first().recall > 0.95


def test_ann_with_all_lists_and_candidates_is_exact(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA)
    assert matches(I.ann_topk(frame, frame, "id", "v", 3, skip_self=True, probes=99, ranked=99)) == brute_force(rows, 3)


def test_codes_keep_most_of_the_distance():
    points = clustered()
    fitted = I.fit(points, 40)
    lists, codes = I.encode(points, fitted)
    assert codes.shape == (1500, 16) and codes.dtype == np.uint8
    for number in (0, 7):
        rows = np.flatnonzero(lists == number)
        rough = I.rough_distances(points[:50], fitted.centres[number], codes[rows], fitted)
        true = ((points[:50, None] - points[rows][None]) ** 2).sum(2)
        assert np.abs(rough - true).max() < 0.2


def test_pivots_rule_out_most_cells_of_clusters(spark):
    points = clustered(20, 40, 8)
    rows = [(i, p.tolist(), "hot" if i % 3 else "cold") for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>, g STRING")
    for keys in ([], ["g"]):
        found = R.vector_topk_within(frame, frame, "id", "v", keys, 3, True, block_rows=40)
        assert matches(found) == brute_force(rows, 3, same_group=bool(keys))
    side = frame.select("id", F.col("v").alias("vector"))
    cells, held = R.pivot_cells(side, 40)
    kth = held.withColumn("kth", F.lit(0.15))
    sent = R.cells_within_reach(kth, cells).count()
    assert len(cells.pivots) == 40 and sent < 0.25 * 800 * 39


def test_pivots_of_equal_and_far_vectors(spark):
    rng = np.random.default_rng(8)
    points = np.concatenate([np.ones((30, 4)), 1e6 + rng.normal(size=(30, 4)), rng.normal(size=(30, 4))])
    rows = [(i, p.tolist(), "") for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>, g STRING")
    found = R.vector_topk(frame, frame, "id", "v", 3, skip_self=True, broadcast_bytes=0, block_rows=9)
    assert matches(found) == brute_force(rows, 3)


@pytest.mark.parametrize("n", [1, 2, 4, 5])
def test_ann_fills_up_on_small_tables(spark, n):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist(), "") for i in range(n)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = matches(I.ann_topk(frame, frame, "id", "v", 3, skip_self=True))
    assert {i: len(found.get(i, [])) for i, _, _ in rows} == {i: min(3, n - 1) for i, _, _ in rows}
    if n <= 4:
        assert {i: found.get(i, []) for i, _, _ in rows} == brute_force(rows, 3)


def test_ann_of_few_rows(spark):
    frame = spark.createDataFrame(vectors(2), SCHEMA)
    assert matches(I.ann_topk(frame, frame, "id", "v", 3, skip_self=True)) == {0: [1], 1: [0]}
    assert I.ann_topk(frame, frame.where("id < 0"), "id", "v").count() == 0
    assert I.ann_topk(frame.where("id < 0"), frame, "id", "v").count() == 0


def test_normalized_vectors_have_unit_length(spark):
    frame = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v ARRAY<DOUBLE>")
    found = [r[0] for r in frame.select(R.normalize_vector("v")).collect()]
    assert found == [[0.6, 0.8], [0.0, 0.0]]


def test_fixed_chunks_cover_the_text(spark):
    texts = ["", "x" * 1000, "y" * 1001, "".join(chr(97 + i % 26) for i in range(5000)), None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    found = {}
    for row in R.chunk_documents(frame, "id", "t").orderBy("id", "chunk_no").collect():
        found.setdefault(row.id, []).append(row.chunk)
    assert sorted(found) == [1, 2, 3]
    for i, chunks in found.items():
        assert chunks == [texts[i][a : a + 1000] for a in range(0, max(len(texts[i]) - 100, 1), 900)]
        assert chunks[0] + "".join(c[100:] for c in chunks[1:]) == texts[i]


def test_separator_chunks():
    words = " ".join(f"word{i}" for i in range(60))
    text = f"{words}\n\n{words}\nshort line\n\nend"
    chunks = R.split_text(text, size=100, overlap=20)
    assert all(0 < len(c) <= 100 for c in chunks)
    seen = set(" ".join(chunks).split())
    assert seen == set(text.split())
    assert R.split_text("one\n\ntwo", 100, 10) == ["one\n\ntwo"]
    assert R.split_text("a" * 250, 100, 20) == ["a" * 100, "a" * 100, "a" * 90]
    assert R.split_text("aaaa bbbb cccc dddd", 10, 5) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]
    assert R.split_text("  ", 100, 10) == []


def test_separator_chunks_as_a_job(spark):
    frame = spark.createDataFrame([(1, "hello world"), (2, None)], "id INT, t STRING")
    assert [tuple(r) for r in R.chunk_at_separators(frame, "id", "t").collect()] == [(1, 0, "hello world")]


def test_prompt_layout(spark):
    message = spark.createDataFrame(
        [("hi", "vi", "returns", "negative", ["doc a", "doc b"])],
        "message STRING, language STRING, intent STRING, sentiment STRING, context ARRAY<STRING>",
    )
    prompt = V.prompts(message).first().prompt
    gap = "\n" + " " * 12
    assert prompt.startswith("System: You are a helpful customer support assistant")
    assert "company.\n        You help" in prompt and "in English.\n        \n        If" in prompt
    assert "\nThe user seems frustrated or upset." in prompt and "Respond in Vietnamese." in prompt
    assert prompt.endswith(
        f"{gap}{gap}Context:{gap}doc a\n\ndoc b{gap}{gap}User intent: returns{gap}{gap}User: hi{gap}{gap}Assistant:"
    )


def test_nearest_of_equal_vectors_stays_in_memory():
    matches = np.ones((4096, 256))
    queries = np.ones((512, 256))
    tracemalloc.start()
    found = R._nearest(np.arange(512), queries, np.arange(4096)[::-1], matches, 3, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    assert found.groupby("query_id").match_id.apply(list).map(lambda ids: ids == [0, 1, 2]).all()
    assert len(found) == 512 * 3


def test_nearest_of_long_vectors():
    # Long vectors that lie close together: their product keeps too few digits to rank them.
    rng = np.random.default_rng(7)
    vectors = np.full((300, 64), 1e6 / 8) + rng.normal(scale=1e-3, size=(300, 64))
    found = R._nearest(np.arange(300), vectors, np.arange(300), vectors, 3, True)
    for i in range(300):
        distance = np.round(((vectors - vectors[i]) ** 2).sum(1), 6)
        nearest = sorted((d, j) for j, d in enumerate(distance) if j != i)[:3]
        assert list(found[found.query_id == i].match_id) == [j for _, j in nearest]


def test_parts_hold_the_lists_that_are_asked_for():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(400, 8))
    fitted = I.fit(points, 40, lists_per_part=20)
    assert len(set(fitted.part_of_list)) == 2
    assert len(set(I.fit(points, 40).part_of_list)) > 2


def test_candidates_of_many_lists_stay_in_memory():
    rng = np.random.default_rng(9)
    points = rng.normal(size=(20000, 8))
    fitted = I.fit(points[:4000], 500)
    lists, codes = I.encode(points, fitted)
    held = pd.DataFrame({"id": np.arange(len(points)), "list": lists, "code": [c.tobytes() for c in codes]})
    asked = pd.DataFrame({"id": np.arange(2000), "vector": list(points[:2000]), "lists": [np.arange(500)] * 2000})
    tracemalloc.start()
    found = I.closest_codes(asked, held, fitted, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert found.groupby("query_id").size().eq(4).all()
    rough = np.concatenate([I.rough_distances(points[:50], fitted.centres[n], codes[lists == n], fitted) for n in range(500)], axis=1)
    nearest = np.sort(rough, axis=1)[:, :4]
    kept = found[found.query_id < 50].sort_values(["query_id", "distance"]).distance.to_numpy().reshape(50, 4)
    assert np.allclose(kept, nearest)


def test_queries_go_once_to_a_region_of_many_cells(spark):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(600, 16))
    rows = [(i, p.tolist(), f"g{i % 5}") for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>, g STRING")
    found = R.vector_topk_within(frame, frame, "id", "v", ["g"], 3, True, block_rows=20)
    assert matches(found) == brute_force(rows, 3, same_group=True)
    side = frame.select("id", F.col("v").alias("vector"), "g")
    cells, held = R.pivot_cells(side, 20)
    regions = R._regions(held, cells, ["g"], 160)
    assert len(cells.pivots) == 60 and set(regions) == {0}
    everywhere = held.withColumn("kth", F.lit(1e9))
    assert R.cells_within_reach(everywhere, cells, regions).count() == 600
    assert R.cells_within_reach(everywhere, cells).count() == 600 * 59
    assert set(R._regions(held, cells, [], 160)) == {0, 1, 2, 3}


def test_bounds_known_before_change_no_result():
    rng = np.random.default_rng(12)
    queries, found = rng.normal(size=(300, 5)), np.round(rng.normal(size=(900, 5)), 1)
    true = R._nearest(np.arange(300), queries, np.arange(900), found, 4, False)
    best = R.Nearest(np.arange(300), queries, 4, true.groupby("query_id").distance.max().to_numpy())
    for rows in (np.arange(0, 300, 2), np.arange(1, 300, 2)):
        best.add(np.arange(500), found[:500], rows=rows)
        best.add(np.arange(500, 900), found[500:], rows=rows)
    assert best.frame().equals(true)


def test_chunks_of_a_large_batch_leave_a_few_texts_at_a_time():
    texts = [f"{i} " + "word " * 4000 for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["_id", "_text"])
    tracemalloc.start()
    found = {}
    for part in R._split_batches(1000, 100)(iter([batch])):
        assert part.num_rows <= R.SPLIT_TEXTS
        for i, chunks in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            found[i] = len(chunks), chunks[0][:3]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6
    assert len(found) == 1000 and all(n > 20 and head.startswith(str(i)[:3]) for i, (n, head) in found.items())


def test_batches_of_long_texts_end_by_their_bytes(spark):
    frame = spark.range(0, 600, 1, 1).withColumn("t", F.repeat(F.lit("word "), 40000))
    sizes = frame.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 600 and max(r.n for r in sizes) < 200
