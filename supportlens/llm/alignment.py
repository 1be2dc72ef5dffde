"""Cross-tokenizer alignment by lockstep merging.

Tokens of both vocabularies are byte ranges of one text. A NumPy state vector holds a pair of
pointers, one into the A and one into the B tokens, for every place of a batch of documents; a
step emits the pair of each place as a link, advances the pointer whose token ends first, or
both and a cut where they end together, and drops the places that are done. A long document
has several places, ``PLACE_BYTES`` apart, so that all places need about as many steps.

How many documents hold a pair of ids linked is counted over the corpus. The most frequent
pairs, a bounded number, go to all tasks; links of the other ones are joined with their counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from supportlens.llm.common import text_of
from supportlens.llm.tokens import CUT, ID, UnequalBytes, byte_vocabulary, piece_vocabulary
from supportlens.session import materialize

#: Bytes between the places of one document in the state vector.
PLACE_BYTES = 1024
#: Documents are merged together up to this many bytes of text.
BATCH_BYTES = 4 << 20
#: Pairs of ids whose counts go to every task (12 bytes each).
FREQUENT_PAIRS = 1 << 18
#: Pairs that a task counts before it hands them on.
HELD_PAIRS = 1 << 20
#: Steps of a power of two in the histogram of counts.
COUNT_STEPS = 16

LINKED = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()),
    ]
)
LINKED_DDL = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"
)


def merge(ends_a: np.ndarray, ends_b: np.ndarray, borders: np.ndarray, place_bytes: int = PLACE_BYTES):
    """Links and cuts between tokens given by their ends; document i has the bytes up to ``borders[i + 1]``.

    Returns the A and B token numbers of all links, in any order, and for every token whether
    a group ends with it.
    """
    starts_a = np.concatenate(([0], ends_a))
    starts_b = np.concatenate(([0], ends_b))
    sizes = np.diff(borders)
    per_document = -(-sizes // place_bytes)
    first = np.repeat(borders[:-1], per_document)
    number = np.arange(len(first)) - np.repeat(np.cumsum(per_document) - per_document, per_document)
    at = first + number * place_bytes
    stop = np.minimum(at + place_bytes, np.repeat(borders[1:], per_document))
    # A place begins where the first token of either kind does.
    begin = np.minimum(starts_a[np.searchsorted(starts_a, at)], starts_b[np.searchsorted(starts_b, at)])
    begin, stop = begin[begin < stop], stop[begin < stop]
    a = np.searchsorted(ends_a, begin, side="right")
    b = np.searchsorted(ends_b, begin, side="right")
    links_a, links_b = [a[:0]], [b[:0]]
    closes_a, closes_b = np.zeros(len(ends_a), dtype=bool), np.zeros(len(ends_b), dtype=bool)
    while len(a):
        links_a.append(a)
        links_b.append(b)
        end_a, end_b = ends_a[a], ends_b[b]
        cut = end_a == end_b
        closes_a[a[cut]] = True
        closes_b[b[cut]] = True
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        left = np.minimum(end_a, end_b) < stop
        if not left.all():
            a, b, stop = a[left], b[left], stop[left]
    return np.concatenate(links_a), np.concatenate(links_b), closes_a, closes_b


def written(ids_a: np.ndarray, ids_b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray, size: int):
    """``a1,a2|b1;`` of all groups in one array of characters, and where each A token begins in it.

    All ids are below ``size``.
    """
    group_a = np.cumsum(closes_a) - closes_a
    group_b = np.cumsum(closes_b) - closes_b
    upto_a = np.flatnonzero(closes_a) + 1
    from_b = np.concatenate(([0], np.flatnonzero(closes_b) + 1))
    n = len(ids_a) + len(ids_b)
    place_a = np.arange(len(ids_a)) + from_b[group_a]
    place_b = np.arange(len(ids_b)) + upto_a[group_b]
    ids, ends = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    ends[place_a] = np.where(closes_a, ord("|"), ord(","))
    ends[place_b] = np.where(closes_b, ord(";"), ord(","))
    characters, digits = _decimals(size)
    width = characters.shape[1]
    digits = digits[ids]
    lines = characters[ids]
    lines[np.arange(n), digits] = ends
    begins = np.cumsum(digits + 1) - digits - 1
    return lines[np.arange(width) <= digits[:, None]], begins[place_a]


@lru_cache(maxsize=1)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``size`` as rows of characters with room for one more, and their lengths."""
    numbers = np.arange(size)
    names = numbers.astype(f"S{len(str(size)) + 1}")
    return names.view(np.uint8).reshape(size, -1), np.char.str_len(names)


class _Batch:
    """Documents whose tokens are merged together."""

    def __init__(self):
        self.doc_ids, self.a, self.b, self.sizes = [], [], [], []
        self.bytes = 0

    def add(self, doc_id, text: str | None, vocabulary_a, vocabulary_b) -> None:
        a = b = b""
        size = 0
        if text:
            try:
                pieces = CUT.split(text)
                a, b = vocabulary_a.words(pieces), vocabulary_b.words(pieces)
                size = 1 + len(text.encode())
            except UnequalBytes:
                a = b = b""
        self.doc_ids.append(doc_id)
        self.a.append(a)
        self.b.append(b)
        self.sizes.append(size)
        self.bytes += size

    def rows(self, lengths_a, lengths_b, first_row: int, place_bytes: int) -> pa.RecordBatch:
        n = len(self.doc_ids)
        ids_a = np.frombuffer(b"".join(self.a), dtype=ID).astype(np.int64)
        ids_b = np.frombuffer(b"".join(self.b), dtype=ID).astype(np.int64)
        n_a = np.array([len(x) // ID.itemsize for x in self.a], dtype=np.int64)
        n_b = np.array([len(x) // ID.itemsize for x in self.b], dtype=np.int64)
        borders = np.concatenate(([0], np.cumsum(np.array(self.sizes, dtype=np.int64))))
        links_a, links_b, closes_a, closes_b = merge(
            np.cumsum(lengths_a[ids_a]), np.cumsum(lengths_b[ids_b]), borders, place_bytes
        )
        document = np.repeat(np.arange(n), n_a)
        of_link = document[links_a]
        keys = of_link << 32 | ids_a[links_a] * len(lengths_b) + ids_b[links_b]
        keys, times = np.unique(keys, return_counts=True)
        cuts = np.searchsorted(keys, np.arange(n + 1) << 32)
        pairs, times = (keys & 0xFFFFFFFF).astype(ID), times.astype(ID)
        characters, begins = written(ids_a, ids_b, closes_a, closes_b, max(len(lengths_a), len(lengths_b)))
        begins = np.concatenate((begins, [len(characters)]))[np.concatenate(([0], np.cumsum(n_a)))]
        text = characters.tobytes()
        groups = [text[x : max(x, y - 1)] for x, y in zip(begins[:-1], begins[1:], strict=True)]
        split = lambda values: [values[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        arrays = [
            pa.array(np.arange(first_row, first_row + n)), pa.array(self.doc_ids, pa.int64()), pa.array(n_a), pa.array(n_b),
            pa.array(np.bincount(document[closes_a], minlength=n).astype(np.int64)),
            pa.array(np.bincount(of_link, minlength=n).astype(np.int64)),
            pa.array(groups, pa.binary()).cast(pa.string()), pa.array(split(pairs), pa.binary()), pa.array(split(times), pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=LINKED)


def links(docs: DataFrame, path_a: str, path_b: str, place_bytes: int = PLACE_BYTES) -> DataFrame:
    """Groups and links of every row of ``docs`` (doc_id, text); the paths must exist on all executors.

    Returns row (a number of its own for each row, fixed once the result is written), doc_id,
    n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), and pairs and times: the
    distinct linked id pairs, as A id times the size of vocabulary B plus B id, and how often
    each occurs, as little-endian unsigned 32-bit numbers.

    Texts that are null, empty, or not given back by the tokens of a vocabulary have no tokens:
    zeros and ''. Strings of special tokens are ordinary text. Rows that repeat a doc_id, or
    have none, are documents of their own; further columns are ignored; an empty table gives
    an empty result. A task holds about ``BATCH_BYTES`` of text with its tokens, or one text
    if that is longer.
    """
    if byte_vocabulary(path_a).size * piece_vocabulary(path_b).size > 1 << 32:
        raise ValueError("the id pairs of these vocabularies need more than 32 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_vocabulary(path_a), piece_vocabulary(path_b)
        lengths_a, lengths_b = a.words.lengths, b.words.lengths
        row = TaskContext.get().partitionId() << 40
        held = _Batch()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                held.add(doc_id, text.as_py(), a, b)
                if held.bytes >= BATCH_BYTES:
                    yield held.rows(lengths_a, lengths_b, row, place_bytes)
                    row += len(held.doc_ids)
                    held = _Batch()
        yield held.rows(lengths_a, lengths_b, row, place_bytes)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(run, LINKED_DDL)


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal codes once, with the sum of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, dtype=np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per pair, added up within the task as long as few pairs are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def batch_of(codes, counts):
        return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    def together():
        return _added(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    waiting = 0
    for batch in batches:
        for one in batch.column("pairs"):
            codes = np.frombuffer(one.as_buffer(), dtype=ID)
            held.append((codes, np.ones(len(codes), dtype=np.int64)))
            waiting += len(codes)
            if waiting >= 4 * HELD_PAIRS:
                held = [together()]
                waiting = len(held[0][0])
                if waiting >= HELD_PAIRS:
                    yield batch_of(*held[0])
                    held, waiting = [], 0
    if held:
        yield batch_of(*together())


def _frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent pairs, at most ``limit``: those above a step of the histogram of counts."""
    step = F.floor(F.log2("n") * COUNT_STEPS)
    bars = sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"])
    room, least = limit, math.inf
    for bar in bars:
        room -= bar["count"]
        if room < 0:
            break
        least = bar["step"]
    return counts.where(step >= F.lit(float(least)))


def with_counts(linked: DataFrame, size_b: int, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """``linked`` with the corpus counts of its links.

    ``linked`` has the columns row, pairs and times of ``links`` and any others. Pairs and times
    give way to n_best, the links whose pair is held by as many documents as any pair of their A id, and
    count_sum, the counts of all links added up. ``frequent`` pairs are looked up in the task; the
    links of all others are joined with the counts.
    """
    spark = linked.sparkSession
    linked = materialize(linked, "linked")
    counts = materialize(
        linked.select("pairs").mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs"
    )
    of_a = F.floor(F.col("pair") / size_b).cast("long")
    highest = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("highest"))
    # At most one row per id of vocabulary A.
    top = highest.toPandas()
    best = np.zeros(int(top["a"].max()) + 1 if len(top) else 0, dtype=np.int64)
    best[top["a"].to_numpy()] = top["highest"].to_numpy()
    known = _frequent(counts, frequent).toPandas().sort_values("pair")
    sent = spark.sparkContext.broadcast((known["pair"].to_numpy(dtype=ID), known["n"].to_numpy(dtype=np.int64), best))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counted, best = sent.value
        for batch in batches:
            sums, bests, rare, rare_times = [], [], [], []
            for pairs, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
                pair, time = np.frombuffer(pairs.as_buffer(), dtype=ID), np.frombuffer(times.as_buffer(), dtype=ID)
                place = np.searchsorted(codes, pair)
                found = place < len(codes)
                found[found] = codes[place[found]] == pair[found]
                n, often = counted[place[found]], time[found].astype(np.int64)
                sums.append(int((n * often).sum()))
                bests.append(int(often[n == best[pair[found] // size_b]].sum()))
                rare.append(pair[~found].tobytes())
                rare_times.append(time[~found].tobytes())
            kept = [batch.column(name) for name in batch.schema.names if name not in ("pairs", "times")]
            more = [pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), pa.array(rare, pa.binary()), pa.array(rare_times, pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=[*others.names, "n_best", "count_sum", "pairs", "times"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pairs, times in zip(batch.column("row"), batch.column("pairs"), batch.column("times"), strict=True):
                pair, time = np.frombuffer(pairs.as_buffer(), dtype=ID), np.frombuffer(times.as_buffer(), dtype=ID)
                columns = [np.full(len(pair), row.as_py()), pair.astype(np.int64), time.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "pair", "times"])

    others = linked.drop("pairs", "times").schema
    schema = T.StructType(list(others.fields))
    for name, kind in (("n_best", "long"), ("count_sum", "long"), ("pairs", "binary"), ("times", "binary")):
        schema = schema.add(name, kind)
    scored = materialize(linked.mapInArrow(score, schema), "scored")
    rare = scored.where(F.octet_length("pairs") > 0).select("row", "pairs", "times").mapInArrow(unpacked, "row long, pair long, times long")
    counted = counts.select("pair", "n", of_a.alias("a")).join(highest, "a")
    added = (
        rare.join(counted, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)).alias("_best"),
            F.sum(F.col("n") * F.col("times")).alias("_sum"),
        )
    )
    total = lambda name, more: (F.col(name) + F.coalesce(F.col(more), F.lit(0))).alias(name)
    return scored.join(added, "row", "left").select(*others.names, total("n_best", "_best"), total("count_sum", "_sum"))
