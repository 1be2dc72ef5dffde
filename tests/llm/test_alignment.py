from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from supportlens.llm import alignment, queries, tokens

TEXTS = [
    "", " ", "  ", " a", "a ", "  a  b ", "a b\nc  d\n\n e", "it's  we'll x y 　z", "<|endoftext|> <s> a </s>",
    "naïve 12 3½ Ⅷ ²", "\ta b", "日本 語 \U0001f600\U0001f468‍\U0001f469", "a▁b", "x ▁", "\x00\x1c \x85 end",
]


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.pieces())


def byte_spans(text, coders):
    """Ids with their byte ranges from the two libraries themselves, or nothing."""
    a, b = coders
    whole = (" " + text).encode() if text else b""
    if not text:
        return [], []
    decoded = tokens.byte_vocabulary(queries.vocabulary()).bytes
    pieces = []
    for i in b.encode(text):
        name = b.id_to_piece(i)
        pieces.append((i, bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()))
    both = [[(i, decoded[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], pieces]
    out = []
    for side in both:
        if b"".join(x for _, x in side) != whole:
            return [], []
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def expected(texts, coders):
    """All rows by comparing every A token with every B token."""
    spans = [byte_spans(text, coders) for text in texts]
    linked = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for a, b in spans]
    held = Counter(pair for pairs in linked for pair in set(pairs))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for (a, b), pairs in zip(spans, linked, strict=True):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in (a, b)))
            low = cut
        named = sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((len(a), len(b), len(cuts), len(pairs), sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs), named))
    return rows


def found(docs, **options):
    rows = alignment.links(docs, queries.vocabulary(), queries.pieces(), **options.pop("links", {}))
    scored = alignment.with_counts(rows, tokens.piece_vocabulary(queries.pieces()).size, **options)
    named = scored.withColumn("groups_sha256", queries.hashed_groups("groups")).collect()
    return [
        (r["doc_id"], (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]))
        for r in named
    ]


@pytest.mark.parametrize("options", [{}, {"frequent": 20}, {"frequent": 0}, {"links": {"place_bytes": 3}}])
def test_alignment_equals_brute_force(spark, coders, options):
    texts = TEXTS + ["the cat sat on the mat, the end. Straße überall " * k for k in range(1, 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(found(docs, **options)) == list(enumerate(expected(texts, coders)))


@pytest.mark.parametrize("name", ["odd_docs", "small_docs"])
def test_alignment_of_tables(request, coders, name):
    docs = request.getfixturevalue(name)
    if name == "small_docs":
        docs = docs.withColumn("text", F.substring("text", 1, 600))
    else:
        docs = docs.withColumn("text", F.when(F.length("text") > 10000, F.substring("text", 1, 3000)).otherwise(F.col("text")))
    rows = docs.collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(found(docs), key=key) == sorted(zip([r["doc_id"] for r in rows], expected([r["text"] for r in rows], coders), strict=True), key=key)


def test_no_documents(no_docs):
    assert found(no_docs) == []


def test_very_long_texts_and_words(spark):
    texts = ["long words " * 100_000, "x" * 200_000, "é" * 30_001]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for doc_id, row in found(docs):
        n_a, n_b, n_groups, n_links, *_ = row
        # Every group of x A and y B tokens has x + y - 1 links.
        assert n_links == n_a + n_b - n_groups and n_groups > 0, doc_id


def test_cached_ids_equal_the_libraries(coders, small_docs):
    a, b = coders
    known_a, known_b = tokens.byte_vocabulary(queries.vocabulary()), tokens.piece_vocabulary(queries.pieces())
    for text in [t for t in TEXTS if t and "▁" not in t] + [r["text"] for r in small_docs.limit(40).collect()]:
        pieces = tokens.CUT.split(text)
        assert np.frombuffer(known_a.words(pieces), dtype="<u4").tolist() == a.encode(" " + text, add_special_tokens=False).ids
        assert np.frombuffer(known_b.words(pieces), dtype="<u4").tolist() == b.encode(text)


def test_words_are_forgotten_in_turn():
    words = tokens.Words(lambda text: list(text.encode()), [bytes([i]) for i in range(256)], limit=3)
    read = lambda *pieces: np.frombuffer(words(list(pieces)), dtype="<u4").tolist()
    for pieces in (["a", "b"], ["c", "d"], ["a"], ["e", "a"], ["f"], ["g"], ["h", ""], ["a", "é "]):
        assert read(*pieces) == list("".join(" " + piece for piece in pieces).encode())
    assert len(words.held) <= 4 and len(words.older) <= 4
