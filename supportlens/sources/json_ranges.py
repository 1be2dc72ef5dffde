"""One large JSON array or object, read by many tasks.

A file is cut into byte ranges. A first pass takes, for each range, the number of its quotes and
how it changes the nesting depth, for both cases of its first byte, inside or outside of a string. Running
sums over the ranges of a file then tell the state in which each begins, and a second pass gives the
elements that begin in it, each read up to its end, which may lie in a later range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from supportlens.session import materialize

#: Bytes of a range, and bytes looked at together.
RANGE_BYTES, PIECE = 32 << 20, 1 << 20
#: Ranges are dealt to at most so many tasks for each core.
TASKS_PER_CORE = 8
QUOTE, BACKSLASH, COMMA, COLON = b'"\\,:'
OPENING, CLOSING = b"[{", b"]}"
RANGE_DDL = "path string, start long, stop long, length long"


def _opened(path: str):
    system, place = pafs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def _read(file, start: int, stop: int) -> bytes:
    file.seek(start)
    return file.read(max(0, stop - start))


def _escaped_at(file, start: int) -> bool:
    """Whether an odd run of backslashes ends right before ``start``."""
    run, at = 0, start
    while at > 0:
        before = _read(file, max(0, at - 64), at)
        left = len(before.rstrip(b"\\"))
        run += len(before) - left
        if left:
            break
        at -= len(before)
    return run % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Where strings begin or end, and whether the byte after ``data`` is escaped."""
    slash = data == BACKSLASH
    place = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, place))
    run_before = np.concatenate(([0], (place - last_other)[:-1]))
    # A run from the beginning goes on from the byte before.
    run_before += escaped & (run_before == place)
    run_after = len(data) - 1 - last_other[-1] + (escaped and last_other[-1] < 0)
    return (data == QUOTE) & (run_before % 2 == 0), bool(run_after % 2)


class Events:
    """Structural bytes of a stretch of a file, piece by piece."""

    def __init__(self, file, start: int, in_string: bool, depth: int):
        self.file, self.at, self.in_string, self.depth = file, start, in_string, depth
        self.escaped = _escaped_at(file, start)

    def next(self, stop: int) -> tuple[bytes, int, np.ndarray, np.ndarray, np.ndarray] | None:
        """The next piece: its bytes, where it begins, and of brackets, commas and colons outside of strings
        the places, the bytes and the depths behind them."""
        raw = _read(self.file, self.at, min(self.at + PIECE, stop))
        if not raw:
            return None
        data = np.frombuffer(raw, dtype=np.uint8)
        quotes, self.escaped = _quotes(data, self.escaped)
        inside = (np.cumsum(quotes) - quotes + self.in_string) % 2 == 1
        opens = np.isin(data, list(OPENING)) & ~inside
        closes = np.isin(data, list(CLOSING)) & ~inside
        depths = self.depth + np.cumsum(opens.astype(np.int64) - closes)
        places = np.flatnonzero(opens | closes | ((data == COMMA) | (data == COLON)) & ~inside)
        begin = self.at
        self.at += len(raw)
        self.in_string = bool((self.in_string + quotes.sum()) % 2)
        self.depth = int(depths[-1])
        return raw, begin, places, data[places], depths[places]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each range, and how it changes the depth if it begins outside, or inside, a string."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            with _opened(row["path"]) as file:
                quotes, change = 0, [0, 0]
                escaped = _escaped_at(file, row["start"])
                for at in range(row["start"], row["stop"], PIECE):
                    data = np.frombuffer(_read(file, at, min(at + PIECE, row["stop"])), dtype=np.uint8)
                    marks, escaped = _quotes(data, escaped)
                    odd = (np.cumsum(marks) - marks + quotes) % 2 == 1
                    steps = np.isin(data, list(OPENING)).astype(np.int64) - np.isin(data, list(CLOSING))
                    change[0] += int(steps[~odd].sum())
                    change[1] += int(steps[odd].sum())
                    quotes += int(marks.sum())
            rows.append(row | {"quotes": quotes, "outside": change[0], "inside": change[1]})
        yield pa.RecordBatch.from_pylist(rows)


def _key_before(file, colon: int) -> str:
    """The key that ends before a colon, read backwards in pieces."""
    data, at = b"", colon
    while True:
        begin = max(0, at - 4096)
        data, at = _read(file, begin, at) + data, begin
        end = data.rfind(b'"')
        first = end
        while first > 0:
            first = data.rfind(b'"', 0, first)
            slashes = first - len(data[:first].rstrip(b"\\")) if first >= 0 else 0
            # A run of backslashes at the very beginning may be longer.
            if first < 0 or first == slashes and at > 0:
                first = -1
                break
            if slashes % 2 == 0:
                return json.loads(data[first : end + 1])
        if at == 0:
            raise ValueError("a colon without a key")


def _elements(level: int):
    """Elements of the arrays at a depth that begin in each range, and the last key of depth 1 before each."""

    def of_range(row: dict) -> Iterator[dict]:
        number, key = 0, None
        with _opened(row["path"]) as file:
            events = Events(file, row["start"], row["in_string"], row["depth"])
            held: bytearray | None = None
            named = lambda **more: {"path": row["path"], "start": row["start"], **more}
            while held is not None or events.at < row["stop"]:
                piece = events.next(row["stop"] if events.at < row["stop"] else row["length"])
                if piece is None:
                    raise ValueError(f"{row['path']} ends inside an element")
                raw, begin, places, kinds, depths = piece
                own = begin < row["stop"]
                wanted = (depths == level) & ((kinds == COMMA) | (kinds == OPENING[0])) | (depths == level - 1) & np.isin(kinds, list(CLOSING))
                if level > 1 and own:
                    wanted |= (depths == 1) & (kinds == COLON)
                at = 0
                for place, kind, depth in zip(places[wanted].tolist(), kinds[wanted].tolist(), depths[wanted].tolist(), strict=True):
                    if kind == COLON:
                        key = _key_before(file, begin + place)
                        continue
                    if held is not None:
                        text = bytes(held + raw[at:place]).strip()
                        held = None
                        if text:
                            number += 1
                            yield named(number=number, key=key, element=text.decode())
                    # An opening bracket inside of an array of this depth has a greater depth.
                    if depth == level and own:
                        held, at = bytearray(), place + 1
                if held is not None:
                    held += raw[at:]
                if not own and held is None:
                    break
            if level > 1:
                yield named(number=0, key=key, element=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("key", pa.string()), ("element", pa.string())])
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                for element in of_range(row):
                    rows.append(element)
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """All ranges of the files under ``path`` with the state in which they begin; a row per range is shuffled."""
    # Only names and lengths are read.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    cut = files.where("length > 0").select("path", "length", F.explode(starts).alias("start"))
    ranges = cut.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("stop"), "length")
    n = max(1, min(ranges.count(), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    summed = materialize(
        ranges.repartition(n).mapInArrow(_summaries, RANGE_DDL + ", quotes long, outside long, inside long"), "json-ranges"
    )
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.coalesce(F.sum("quotes").over(before), F.lit(0))
    marked = summed.withColumn("in_string", quotes % 2 == 1)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    depth = F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth")
    states = marked.withColumn("change", change).select("path", "start", "stop", "length", "in_string", depth)
    return materialize(states, "json-states").repartition(n)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects of files that hold one array each, like ``multiLine``, but a file is read by many tasks.

    An element that is no object gives a row of nulls. Empty files and arrays give no rows.
    """
    elements = _ranges(spark, path, range_bytes).mapInArrow(_elements(1), "path string, start long, number long, key string, element string")
    return elements.select(F.from_json("element", schema).alias("row")).select("row.*")


def read_json_groups(spark: SparkSession, path: str, item: T.DataType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Files that hold one object group -> list of items each, as rows of group and item, read by many tasks.

    Where a range begins inside of a list, its key is the last one of the ranges before.
    """
    found = materialize(
        _ranges(spark, path, range_bytes).mapInArrow(_elements(2), "path string, start long, number long, key string, element string"),
        "json-elements",
    )
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.where("number = 0").select("path", "start", F.last("key", ignorenulls=True).over(before).alias("carried"))
    rows = found.where("number > 0").join(carried, ["path", "start"])
    parsed = F.from_json(F.concat(F.lit("["), "element", F.lit("]")), T.ArrayType(item)).getItem(0)
    return rows.select(F.coalesce("key", "carried").alias("group"), parsed.alias("item"))
