"""Bounded-space online packing of token sequences.

A task keeps a fixed number of open windows. The end of a document goes to the window that it
fits best; if none has room, the fullest is topped up with its head and emitted. What is open
at the end of a task is merged within the task, and the rest of each task, less than one
window, is merged over groups of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from supportlens.llm.common import text_of
from supportlens.llm.tokens import ID, byte_vocabulary
from supportlens.session import materialize

WINDOW = 2048
OPEN_WINDOWS = 64
#: Tasks whose rests are merged together: at most this many windows meet in one group.
MERGED_TASKS = 256
END_ID = 1
END = END_ID.to_bytes(ID.itemsize, "little")
#: Rows as they leave a task; ``ids`` holds little-endian unsigned 32-bit token ids.
PIECE_SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, task int"
ARROW_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("task", pa.int32()),
    ]
)


def encode(text: str, path: str) -> np.ndarray:
    """Token ids of a text and the end id; strings of special tokens are these tokens."""
    return np.frombuffer(byte_vocabulary(path).marked(text) + END, dtype=ID)


Piece = tuple  # (doc_id, start, ids, doc_tokens)


def _cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    doc_id, start, ids, total = piece
    return (doc_id, start, ids[:at], total), (doc_id, start + at, ids[at:], total)


class Packer:
    """Open windows of one task; ``take`` and ``close`` yield whole sequences of pieces."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.limit = window, open_windows
        self.free: list[int] = []
        self.held: list[list[Piece]] = []

    def take(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece[2]) >= self.window:
            head, piece = _cut(piece, self.window)
            yield [head]
        while len(piece[2]):
            n = len(piece[2])
            fits = [i for i, free in enumerate(self.free) if free >= n]
            if fits:
                best = min(fits, key=self.free.__getitem__)
                self.held[best].append(piece)
                self.free[best] -= n
                if not self.free[best]:
                    yield self._emit(best)
                return
            if len(self.free) < self.limit:
                self.free.append(self.window - n)
                self.held.append([piece])
                return
            fullest = min(range(len(self.free)), key=self.free.__getitem__)
            head, piece = _cut(piece, self.free[fullest])
            self.held[fullest].append(head)
            yield self._emit(fullest)

    def _emit(self, place: int) -> list[Piece]:
        self.free.pop(place)
        return self.held.pop(place)

    def rest(self) -> list[Piece]:
        """Pieces of the open windows, the fullest window first."""
        order = sorted(range(len(self.free)), key=self.free.__getitem__)
        pieces = [piece for i in order for piece in self.held[i]]
        self.free, self.held = [], []
        return pieces


def merged(pieces: list[Piece], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill windows in order, cutting at their ends; returns the full ones and the rest."""
    full: list[list[Piece]] = []
    current: list[Piece] = []
    room = window
    for piece in pieces:
        while len(piece[2]) >= room:
            head, piece = _cut(piece, room)
            full.append([*current, head])
            current, room = [], window
        if len(piece[2]):
            current.append(piece)
            room -= len(piece[2])
    return full, current


def in_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Cut a rest into sequences whose lengths are powers of two, which need no padding."""
    out = []
    left = sum(len(piece[2]) for piece in pieces)
    while left:
        length = 1 << (left.bit_length() - 1)
        full, pieces_after = merged(pieces, length)
        out.append(full[0])
        pieces = [piece for sequence in full[1:] for piece in sequence] + pieces_after
        left -= length
    return out


def _rows(sequences: list[tuple[int, list[Piece]]], task: int) -> pa.RecordBatch:
    rows = []
    for sequence_id, pieces in sequences:
        offset = 0
        for doc_id, start, ids, total in pieces:
            rows.append((doc_id, start, ids.tobytes(), total, sequence_id, offset, task))
            offset += len(ids)
    columns = zip(*rows, strict=True) if rows else [[]] * len(ARROW_SCHEMA)
    arrays = [pa.array(list(c), type=field.type) for c, field in zip(columns, ARROW_SCHEMA, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW_SCHEMA)


def _packed(path: str, window: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, count = Packer(window, open_windows), 0
        for batch in batches:
            done = []
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(doc_ids, batch.column("text"), strict=True):
                ids = encode(text.as_py(), path)
                for pieces in packer.take((doc_id, 0, ids, len(ids))):
                    done.append(((task << 32) + count, pieces))
                    count += 1
            yield _rows(done, task)
        full, rest = merged(packer.rest(), window)
        yield _rows([((task << 32) + count + i, pieces) for i, pieces in enumerate(full)] + [(-1, rest)], task)

    return run


def _merge_rests(window: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda row: (row["task"], row["offset"]))
        number = rows[0]["task"] // MERGED_TASKS
        pieces = [
            (row["doc_id"], row["start"], np.frombuffer(row["ids"], dtype=ID), row["doc_tokens"]) for row in rows
        ]
        full, rest = merged(pieces, window)
        first = (1 << 62) + (number << 32)
        sequences = [(first + i, pieces) for i, pieces in enumerate(full + in_powers(rest))]
        return pa.Table.from_batches([_rows(sequences, -1)])

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Token pieces of each row of ``docs`` (doc_id, text), packed into sequences.

    Returns doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and
    offset. A sequence holds ``window`` tokens, or fewer if that is a power of two. Null or
    empty text is the end id alone; rows that repeat a doc_id, or have none, are documents of
    their own; strings of the file's special tokens in a text are read as these tokens, as the
    tokenizer does by default. Further columns are ignored; an empty table gives an empty result. ``path`` names the vocabulary, present on all
    executors. ``window`` must be a power of two.

    The packed pieces are written to the shared folder before rests are merged, so a task
    that runs again cannot pack differently from what its rest was taken from.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    pieces = materialize(texts.mapInArrow(_packed(path, window, open_windows), PIECE_SCHEMA), "pieces")
    rests = pieces.where("sequence_id < 0").withColumn("part", F.floor(F.col("task") / MERGED_TASKS))
    last = rests.groupBy("part").applyInArrow(_merge_rests(window), PIECE_SCHEMA)
    return pieces.where("sequence_id >= 0").unionByName(last).drop("task")


def padding(lengths: list[int], window: int = WINDOW) -> int:
    """Padding of sequences of these lengths."""
    return sum(0 if n & (n - 1) == 0 else window - n for n in lengths)
