"""Spelling variants by a bit-sliced position index.

Two words that differ by one code point have the same letters before and behind one place. So
the places of a word are cut into windows: words of about one length that agree before and
behind a window form a bucket, and a pair meets in the bucket of the window with its first
different letter. A bucket with too many words is cut into smaller windows, down to one letter.

Inside a bucket there is one bit per word, the most frequent word first, and one bitset per
(position, letter). For a word, whole bitsets of others are moved along its letters at once:
those without an error so far, and those with one letter replaced, inserted or deleted, the
last two read at shifted positions. The lowest bit left is the most frequent near word.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from supportlens.llm.common import text_of
from supportlens.session import materialize

#: Code points and occurrences that a word needs.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run is changed where its checksum is a multiple of this number.
CHANGED_EACH = 97
#: A form occurs at least so many times as often as the word.
FORM_RATIO = 2
RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
LETTER = re.compile(r"[A-Za-zÀ-ÿ]*")
#: Characters of a text that are read at a time.
SLICE = 1 << 20
#: Words that a task counts before it hands them on.
HELD_WORDS = 1 << 18
#: Words of a bucket from which its window is cut.
BUCKET_WORDS = 2048
BUCKET = ["size", "low", "high", "head", "tail"]
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])


def _slices(text: str) -> Iterator[str]:
    """The text in pieces that do not cut a run of letters."""
    at = 0
    while at < len(text):
        end = LETTER.match(text, min(at + SLICE, len(text))).end()
        yield text[at:end]
        at = end


def runs(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """Long words of a text, lower-cased in A-Z and changed by their checksum, with their counts."""
    seen: Counter[str] = Counter()
    for part in _slices(text):
        seen.update(RUN.findall(part))
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in seen.items():
        checksum = crc32(word.encode(), start)
        if checksum % CHANGED_EACH == 0:
            at = checksum % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < LEAST_LENGTH:
                continue
        yield word, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = defaultdict(int)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], schema=COUNTS)

    for batch in batches:
        # bytes.lower() knows no letters but A-Z.
        texts = batch.column("text").cast(pa.binary())
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            for word, n in runs(doc_id, text.as_py().lower().decode()):
                held[word] += n
            if len(held) >= HELD_WORDS:
                yield rows()
                held.clear()
    yield rows()


def words(docs: DataFrame) -> DataFrame:
    """Words of at least five code points that occur at least three times, as word and n."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return (
        texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    )


# --- buckets --------------------------------------------------------------------------


def _window(size: Column, low: Column, high: Column) -> Column:
    """The bucket of a word for pairs whose shorter word has ``size`` letters and whose first
    different letter is in [low, high)."""
    behind = F.greatest(size - high, F.lit(0))
    return F.struct(
        size.alias("size"),
        low.alias("low"),
        high.alias("high"),
        F.substr("word", F.lit(1), low).alias("head"),
        F.substr("word", F.char_length("word") - behind + 1, behind).alias("tail"),
    )


def _halves(size: Column, low: Column, high: Column) -> list[Column]:
    middle = F.floor((low + high) / 2).cast("int")
    return [_window(size, low, middle), _window(size, middle, high)]


def _placed(vocabulary: DataFrame) -> DataFrame:
    """Every word in both halves of its places, as the shorter and as the longer word of a pair."""
    length = F.char_length("word")
    pieces = [half for size in (length, length - 1) for half in _halves(size, F.lit(0), size + 1)]
    bucket = F.explode(F.filter(F.array(*pieces), lambda b: b["size"] >= LEAST_LENGTH))
    return vocabulary.select("word", "n", bucket.alias("bucket")).select("word", "n", "bucket.*")


def _bounded(placed: DataFrame, limit: int) -> DataFrame:
    """Cut the windows of large buckets until none is left that could be cut."""
    done = []
    while True:
        sizes = placed.groupBy(*BUCKET).count()
        large = materialize(sizes.where((F.col("count") > limit) & (F.col("high") - F.col("low") > 1)).select(*BUCKET), "large-buckets")
        if large.isEmpty():
            break
        done.append(placed.join(large, BUCKET, "left_anti"))
        halves = F.explode(F.array(*_halves(F.col("size"), F.col("low"), F.col("high"))))
        cut = placed.join(large, BUCKET, "left_semi").select("word", "n", halves.alias("bucket"))
        placed = materialize(cut.select("word", "n", "bucket.*"), "cut-buckets")
    for part in done:
        placed = placed.unionByName(part.select(*placed.columns))
    return placed


# --- inside a bucket --------------------------------------------------------------------


def near_words(middles: list[str], size: int, open_end: bool) -> Iterator[int]:
    """For every word of a bucket the bitset of those near it whose first different letter is in the window.

    ``middles`` are the letters inside the window, ``size`` of them in the shorter words and
    one more in the longer ones. With ``open_end`` the window goes up to the end of the words, where
    a letter may follow; otherwise words that agree in the whole window belong to a later one.
    """
    index: dict[tuple[int, str], int] = defaultdict(int)
    shorter = 0
    for i, letters in enumerate(middles):
        bit = 1 << i
        for place in enumerate(letters):
            index[place] |= bit
        if len(letters) == size:
            shorter |= bit
    everyone = (1 << len(middles)) - 1
    longer = everyone ^ shorter
    has = index.get
    for i, letters in enumerate(middles):
        same = everyone ^ (1 << i)
        if len(letters) == size:
            replaced = inserted = 0
            for at, letter in enumerate(letters):
                here = has((at, letter), 0)
                inserted = (inserted | same) & has((at + 1, letter), 0)
                replaced = (replaced & here) | (same & ~here)
                same &= here
                if not (same or replaced or inserted):
                    break
            inserted |= same
            found = (replaced & shorter) | (inserted & longer)
        else:
            deleted = before = 0
            for at, letter in enumerate(letters):
                before = same
                deleted = (deleted & has((at - 1, letter), 0)) | same
                same &= has((at, letter), 0)
                if not (same or deleted):
                    break
            found, same = deleted & shorter, before
        yield found if open_end else found & ~same


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted buckets; a bucket may span batches."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(name).to_pylist() for name in [*BUCKET, "word", "n"]), strict=True)

    out: list[tuple] = []
    for (size, low, high, head, tail), group in groupby(rows(), key=itemgetter(0, 1, 2, 3, 4)):
        members = [row[5:] for row in group]
        if len(members) > 1:
            middles = [word[len(head) : len(word) - len(tail)] for word, _ in members]
            for (word, _), found in zip(members, near_words(middles, size - low - len(tail), high > size), strict=True):
                if found:
                    form, form_n = members[(found & -found).bit_length() - 1]
                    out.append((word, found.bit_count(), form, form_n))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(NEAR.names, row, strict=True)) for row in out], schema=NEAR)
            out = []
    yield pa.RecordBatch.from_pylist([dict(zip(NEAR.names, row, strict=True)) for row in out], schema=NEAR)


def near_forms(vocabulary: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Number of near words and the most frequent one, for the words that have any.

    ``vocabulary`` holds distinct words of at least five code points, and n. Returns word,
    n_near, form and form_n; ties go to the smaller word in code-point order.
    """
    placed = _bounded(_placed(vocabulary), bucket_words)
    dealt = placed.repartition(*BUCKET).sortWithinPartitions(*BUCKET, F.desc("n"), "word")
    found = dealt.select(*BUCKET, "word", "n").mapInArrow(_search, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), F.col("form")))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", "best.form", (-F.col("best.rank")).alias("form_n"))
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """The end of every word's chain of forms, by doubling; ``forms`` holds word and form, none null.

    Counts at least double with every form, so chains end, and a few rounds reach all ends.
    """
    steps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(
            steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        steps = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Words of ``docs`` (doc_id, text) grouped by spelling.

    Returns word, n (occurrences), n_near (words that differ by one inserted, deleted or replaced
    code point), form (the near word of largest n, if it occurs at least twice as often, else null),
    form_n (its n, or null) and root (the last form of the forms, or the word itself). Ties go to
    the smaller word in code-point order.

    Null and empty texts hold no words; a null doc_id counts as an empty one in the checksums;
    rows that repeat a doc_id or a text count once each; texts are read in slices, however long;
    further columns are ignored; an empty table gives an empty result.
    """
    vocabulary = materialize(words(docs), "vocabulary")
    near = materialize(near_forms(vocabulary, bucket_words), "near-words")
    frequent = F.col("form_n") >= FORM_RATIO * F.col("n")
    formed = vocabulary.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(frequent, F.col("form")).alias("form"),
        F.when(frequent, F.col("form_n")).alias("form_n"),
    )
    formed = materialize(formed, "forms")
    roots = last_forms(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
