import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from supportlens.llm import exact_dedup, mixing, quality
from test_dedup import expected_components
from test_text_operators import tokens_of


def run(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path))


def pieces_of(rows):
    """Token counts of the documents that pieces make up, by doc_id; the pieces of a copy are not told apart."""
    total, lengths = Counter(), defaultdict(set)
    for r in rows:
        total[r["doc_id"]] += len(r["ids"]) // 4
        lengths[r["doc_id"]].add(r["doc_tokens"])
    return total, lengths


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
def test_odd_and_empty_tables(request, spark, tmp_path, name):
    docs = request.getfixturevalue(name)
    rows = run(spark, tmp_path, docs).collect()
    assert (rows == []) == (name == "no_docs")
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}


def test_small_table_against_brute_force(spark, tmp_path, small_docs):
    total, lengths = pieces_of(run(spark, tmp_path, small_docs).collect())
    good = {r["doc_id"] for r in quality.judge(small_docs).where("kept").collect()}
    texts = {r["doc_id"]: (r["text"] or "") for r in small_docs.collect() if r["doc_id"] in good}
    lower = {i: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for i, t in texts.items()}
    newest = {}
    for i, t in sorted(lower.items()):
        newest[t] = i
    once = sorted(newest.values())
    components = expected_components([(i, texts[i]) for i in once])
    left = [i for i in once if components[i][1] == i]
    mixed = mixing.mix(small_docs.where(F.col("doc_id").isin(left))).collect()
    passes = {r["doc_id"]: r["epochs"] + r["chosen"] for r in mixed}
    assert {i for i, n in passes.items() if n} == set(total)
    for i, n in passes.items():
        if n:
            tokens = len(tokens_of(texts[i]))
            assert lengths[i] == {tokens} and total[i] == n * tokens


def test_column_names_with_backticks_and_texts_that_differ_in_case(spark):
    rows = [(7, "Same Text " * 9, "x"), (7, "same text " * 9, "y"), (3, "SAME text " * 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd ``name` string")
    kept = [exact_dedup.keep_one_copy(docs.repartition(n)).collect() for n in (1, 3)]
    assert kept[0] == kept[1] and len(kept[0]) == 1 and kept[0][0]["doc_id"] == 7


def test_rows_of_one_id_with_other_texts_have_passes_of_their_own(spark):
    rows = [(1, f"text {k} " * (k + 1), "s") for k in range(30)] + [(2, "other words here", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter(zlib.crc32(r["text"].encode()) for r in mixing.mixed_rows(docs).collect())
    wanted = sum(r["epochs"] + r["chosen"] for r in mixing.mix(docs).collect())
    assert sum(taken.values()) == wanted
