import hashlib
import re
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from supportlens.llm import exact_dedup, near_dedup
from supportlens.llm.shingles import shingle_sets

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def folded(text):
    return (text or "").translate(LOWER)


def expected_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[folded(text)].append(doc_id)
    out = []
    for doc_id, text in rows:
        members = groups[folded(text)]
        keep = max((m for m in members if m is not None), default=None)
        sha = hashlib.sha256(folded(text).encode()).hexdigest()
        out.append((doc_id, keep, len(members), doc_id == keep, sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.crc32(c.cast("binary")).cast("string").substr(1, 1).cast("binary")])
@pytest.mark.parametrize("name", ["odd_docs", "small_docs"])
def test_exact_groups_even_when_digests_collide(request, name, digest):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(docs, digest).collect()), key=str)
    assert got == expected_groups(rows)


def test_exact_empty(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.keep_one_copy(no_docs).columns == no_docs.columns


def test_keep_one_copy(odd_docs):
    kept = exact_dedup.keep_one_copy(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [folded(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({folded(r["text"]) for r in odd_docs.collect()})


def shingles(text):
    words = WORD.findall(folded(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected_components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= 75 * (len(x) + len(y) - common):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("name", ["odd_docs", "small_docs"])
def test_components_match_all_pairs(request, name):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    expected = expected_components(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_large_group_of_near_copies(spark, monkeypatch, block_rows):
    """A chain: neighbours are linked, the ends share nothing; and copies that differ at random."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block_rows)
    chain = [(1000 - i, " ".join(f"w{k}" for k in range(4 * i, 4 * i + 100))) for i in range(60)]
    base = [f"b{k}" for k in range(120)]
    copies = []
    for i in range(150):
        words = list(base)
        words[(7 * i) % 120] = f"x{i}"
        words[(11 * i + 3) % 120] = f"y{i}"
        copies.append((2000 + i, " ".join(words)))
    lone = [(5000 + i, " ".join(f"l{i}-{k}" for k in range(30)) + " shared line of eight words in all texts") for i in range(80)]
    rows = chain + copies + lone
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = expected_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == expected


def test_one_large_group_sends_its_rows_once(spark, monkeypatch):
    """The rows of a component that fills a bucket go to the other texts of it, not to each other."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 10)
    monkeypatch.setattr(near_dedup, "JOINING_ROWS", 2)
    rows = [(7, i, 205, 1 if i < 200 else i) for i in range(205)] + [(8, 900 + i, 30, 900 + i % 2) for i in range(30)]
    rows += [(9, i, 3, i) for i in range(3)]
    frame = spark.createDataFrame(rows, "key long, doc long, size long, part long")
    placed = near_dedup._placed(frame).collect()
    met = defaultdict(set)
    for r in placed:
        met[r["key"], r["low"], r["high"]].add((r["doc"], r["block"]))
    part = {(k, d): p for k, d, _, p in rows}
    pairs = defaultdict(int)
    for (key, low, high), members in met.items():
        for a, x in members:
            for b, y in members:
                if a < b and part[key, a] != part[key, b] and (low == high or x != y):
                    pairs[key, a, b] += 1
    wanted = {(k, a, b) for (k, a) in part for (l, b) in part if k == l and a < b and part[k, a] != part[k, b]}
    assert set(pairs) == wanted and set(pairs.values()) == {1}
    sent = sum(1 for r in placed if r["key"] == 7)
    assert sent <= 200 + 5 * 25
    first = near_dedup._placed_first(frame.drop("part")).collect()
    assert {(r["key"], r["doc"]) for r in first} == {(k, d) for k, d, _, _ in rows}
    assert len(first) < 3 * len(rows)


def test_ids_repeated_with_other_texts(spark):
    """Each text of an id is linked on its own, and a component has its smallest id."""
    text = {c: " ".join(f"{c}{k}" for k in range(100)) for c in "abcd"}
    near = {c: t.replace(f"{c}50", "other") for c, t in text.items()}
    rows = [(5, text["a"]), (5, text["b"]), (5, text["c"]), (5, text["c"])]
    rows += [(7, near["a"]), (8, near["b"]), (9, near["c"]), (9, near["a"]), (3, near["b"] + " end"), (1, text["d"]), (1, "alone"), (6, near["d"])]
    rows += [(None, near["c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    numbered = {i + 1: t for i, (d, t) in enumerate(rows)}
    roots = {i: root for i, (_, root) in expected_components(list(numbered.items())).items()}
    least = {}
    for i, root in roots.items():
        if rows[i - 1][0] is not None:
            least[root] = min(least.get(root, 99), rows[i - 1][0])
    expected = sorted((d, least[roots[i + 1]]) for i, (d, _) in enumerate(rows) if d is not None)
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == expected
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(5, False)]
    kept = sorted((r["doc_id"], r["text"]) for r in near_dedup.keep_one_of_each(docs).collect())
    assert kept == sorted([(5, text["a"]), (5, text["c"]), (5, text["c"]), (3, near["b"] + " end"), (1, text["d"]), (1, "alone")])


def test_near_empty_and_columns(no_docs, odd_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0
    kept = near_dedup.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 4 in ids and 5 not in ids and 6 in ids and 7 not in ids


def test_shingle_hashes_match_sets():
    texts = ["a b c d e f a b c d e f", "A B C D E F", "", "x", "x y", " \n", "ä ß é ü ñ ö", "a b c d"]
    got = []
    for hashes, borders in shingle_sets([t.encode() for t in texts]):
        got += [set(hashes[borders[i] : borders[i + 1]].tolist()) for i in range(len(borders) - 1)]
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert got[1] < got[0] and not got[7] & got[0]
    assert list(shingle_sets([])) == []


def test_signatures_under_threshold_share_a_key():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype("<u2")
    for _ in range(200):
        other = one.copy()
        places = rng.choice(near_dedup.SYMBOLS, near_dedup.MAX_DISTANCE, replace=False)
        other[places] ^= 1
        batch = pa.RecordBatch.from_pydict({"doc": [1, 2], "signature": [one.tobytes(), other.tobytes()]})
        keys = [set(), set()]
        for part in near_dedup._index([batch]):
            for key, doc in zip(part.column("key").to_pylist(), part.column("doc").to_pylist(), strict=True):
                keys[doc - 1].add(key)
        assert keys[0] & keys[1]
