import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from supportlens.llm import spelling


def expected_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    return {word: n for word, n in counts.items() if n >= 3}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected_rows(counts):
    forms, near_of = {}, {}
    for word, n in counts.items():
        near = [other for other in counts if is_near(word, other)]
        near_of[word] = len(near)
        best = min(near, key=lambda other: (-counts[other], other), default=None)
        forms[word] = best if best is not None and counts[best] >= 2 * n else None
    rows = set()
    for word, n in counts.items():
        root = word
        while forms[root]:
            root = forms[root]
        rows.add((word, forms[word], root, n, near_of[word], counts[forms[word]] if forms[word] else None))
    return rows


def found(docs, **options):
    rows = spelling.spelling_variants(docs, **options).collect()
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


def invented(seed, letters, sizes, number):
    """Texts of words over few letters, so that near words are common."""
    draw = random.Random(seed)
    words = ["".join(draw.choice(letters) for _ in range(draw.choice(sizes))) for _ in range(number)]
    return [(i, " ".join(draw.choices(words, weights=[1 / (k + 1) for k in range(number)], k=300))) for i in range(12)]


@pytest.mark.parametrize("bucket_words", [2048, 3, 1])
@pytest.mark.parametrize("letters, sizes, number", [("ab", (5, 6, 7), 60), ("abcé×", (4, 5, 6, 9), 150), ("aB", (11, 12, 13), 100)])
def test_variants_equal_brute_force(spark, letters, sizes, number, bucket_words):
    rows = invented(number, letters, sizes, number)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs, bucket_words=bucket_words) == expected_rows(expected_words(rows))


def test_every_kind_of_edit_at_every_place(spark):
    word = "abcdefgh"
    others = {word[:i] + x + word[i + k :] for i in range(9) for x in ("", "z", "é") for k in (0, 1)} - {word}
    rows = [(i, f"{other} " * 3) for i, other in enumerate(sorted(others))] + [(-1, f"{word} " * 50)]
    counts = expected_words(rows)
    assert expected_rows(counts) == found(spark.createDataFrame(rows, "doc_id long, text string"), bucket_words=5)


@pytest.mark.parametrize("name", ["odd_docs", "small_docs"])
def test_variants_of_tables(request, name):
    docs = request.getfixturevalue(name)
    docs = docs if name == "odd_docs" else docs.where("doc_id < 60")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts = expected_words(rows)
    assert counts and found(docs) == expected_rows(counts)


def test_no_documents(no_docs):
    assert found(no_docs) == set()


def test_long_words_and_slices(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    rows = [(1, "Longer words É cross the sliceborders " * 3)]
    assert dict(spelling.runs(1, rows[0][1].lower())).keys() == expected_words(rows).keys() - {"É"}
    long = "x" * 30_000
    rows = [(i, f"{long} {long}y {long[:-5]}y{long[:4]}") for i in range(4)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected_rows(expected_words(rows))


def test_chains_of_forms_reach_their_end(spark):
    words = ["aaaaa" + "b" * k + "c" * (40 - k) for k in range(20)]
    forms = spark.createDataFrame([(words[k], words[k + 1]) for k in range(19)], "word string, form string")
    roots = spelling.last_forms(forms).collect()
    assert len(roots) == 19 and {r["root"] for r in roots} == {words[-1]}


def test_buckets_are_bounded(spark):
    words = [("abcde" + "".join(chr(97 + (i // 26**k) % 26) for k in range(3)), 3) for i in range(4000)]
    placed = spelling._bounded(spelling._placed(spark.createDataFrame(words, "word string, n long")), 100)
    large = placed.groupBy(*spelling.BUCKET).count().where("count > 100 AND high - low > 1")
    assert large.count() == 0 and placed.agg(F.count("*")).first()[0] < 4000 * 16
