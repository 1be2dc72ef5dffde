"""Chunking and exact nearest-neighbour search over vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from supportlens import constants as C
from supportlens.functions import text as X
from supportlens.session import materialize, spread, work_tasks

# Texts that are cut into chunks at a time.
SPLIT_TEXTS = 64
# Queries up to this many bytes of vectors go to every task; more are joined in blocks.
BROADCAST_BYTES = 64 << 20
# Vectors per side of a block pair.
BLOCK_ROWS = 4096
# Blocks that are sent as one where all vectors may have to meet, if they are no larger than this.
JOINED_BLOCKS, JOINED_BYTES = 8, 16 << 20
# Distances a task holds at a time.
CELLS = 1 << 20
#: Queries compared with ``CELLS`` divided by them at a time.
TILE_ROWS = 256
#: Numbers of candidate vectors compared at a time.
VALUES = 1 << 20
# Cells that vectors are sent by at most, and rows at most that their pivots are chosen from.
MAX_CELLS = 256
FIT_ROWS = 1 << 14
# Squared distances are compared at this precision, so that equal vectors tie.
DIGITS = 6

MATCH_SCHEMA = "query_id BIGINT, match_id BIGINT, distance DOUBLE"


# --- chunks -------------------------------------------------------------------------


def chunk_documents(
    df: DataFrame, id_column: str, text: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP
) -> DataFrame:
    """Fixed windows of ``size`` characters, each starting ``overlap`` before the last one's end."""
    stride = size - overlap
    length = F.length(text)
    last = F.greatest(F.ceil((length - size) / F.lit(stride)), F.lit(0)).cast("int")
    return (
        df.where(length > 0)
        .select(id_column, text, F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
        .select(
            id_column,
            "chunk_no",
            F.substr(F.col(text), F.col("chunk_no") * stride + 1, F.lit(size)).alias("chunk"),
        )
    )


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to ``size``, repeating about ``overlap`` characters."""
    window: list[str] = []
    length = 0
    for piece in pieces:
        if window and length + len(piece) > size:
            yield "".join(window)
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.pop(0))
        window.append(piece)
        length += len(piece)
    if window:
        yield "".join(window)


def _cut(text: str, size: int, overlap: int, separators: list[str]) -> Iterator[str]:
    separator, *finer = separators
    while finer and separator not in text:
        separator, *finer = finer
    if separator:
        head, *rest = text.split(separator)
        pieces = [head, *(separator + part for part in rest)]
    else:
        pieces = list(text)
    small: list[str] = []
    for piece in filter(None, pieces):
        if len(piece) < size:
            small.append(piece)
            continue
        yield from _packed(small, size, overlap)
        small = []
        yield from _cut(piece, size, overlap, finer) if finer else [piece]
    yield from _packed(small, size, overlap)


def split_text(text: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> list[str]:
    """Chunks of about ``size`` characters, cut at the coarsest separator that fits."""
    chunks = (chunk.strip() for chunk in _cut(text, size, overlap, C.CHUNK_SEPARATORS))
    return [chunk for chunk in chunks if chunk]


def _split_batches(size: int, overlap: int):
    """Ids with the chunks of their texts, of few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SPLIT_TEXTS):
                ids, texts = batch.slice(at, SPLIT_TEXTS).columns
                chunks = [split_text(t, size, overlap) if t else [] for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(chunks, pa.list_(pa.string()))], names=["_id", "_chunks"])

    return run


def chunk_at_separators(
    df: DataFrame, id_column: str, text: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP
) -> DataFrame:
    """Chunks cut at paragraphs, lines or words where possible; Arrow batches, no shuffle."""
    rows = df.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    schema = T.StructType([rows.schema["_id"], T.StructField("_chunks", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(_split_batches(size, overlap), schema).select(
        F.col("_id").alias(id_column), F.posexplode("_chunks").alias("chunk_no", "chunk")
    )


def qa_documents(pairs: DataFrame) -> DataFrame:
    """Question/answer pairs as documents with their metadata."""
    return pairs.select(
        "*", X.qa_document("question", "answer").alias("page_content")
    )


# --- vectors --------------------------------------------------------------------------


def normalize_vector(vector: Column | str) -> Column:
    """Scale to unit length; a zero vector stays as it is."""
    column = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(column, lambda x: x / norm)).otherwise(column)


class Nearest:
    """The ``k`` nearest matches so far of a bounded set of queries.

    A matrix product picks candidates; their distances are then computed directly,
    so that a pair has the same distance in whatever block it occurs. The product loses
    digits as the vectors grow, so the margin for candidates grows with their squared norms.
    Candidates are taken in pieces of at most ``VALUES`` numbers, each cut to ``k`` per query,
    as equal vectors may all be candidates. A query's k-th distance so far bounds what follows;
    ``bound`` holds such distances known before.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, bound: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.distance = np.full((len(ids), k), np.inf)
        self.match_id = np.zeros((len(ids), k), dtype=np.int64)
        self.bound = np.full(len(ids), np.inf) if bound is None else np.array(bound, dtype=np.float64)

    def add(self, match_ids: np.ndarray, matches: np.ndarray, skip_self: bool = False, rows: np.ndarray | None = None) -> None:
        """Compare the queries, or those at ``rows``, with ``matches``."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        tile = max(1, CELLS // TILE_ROWS)
        norms = (matches**2).sum(1)
        for at in range(0, len(rows), TILE_ROWS):
            some = rows[at : at + TILE_ROWS]
            asked = self.vectors[some].astype(np.float64)
            own = (asked**2).sum(1)
            for start in range(0, len(matches), tile):
                part = slice(start, start + tile)
                self._compare(some, asked, own, match_ids[part], matches[part], norms[part], skip_self)

    def _compare(self, some, asked, own, match_ids, matches, norms, skip_self: bool) -> None:
        width = max(1, matches.shape[1])
        piece = max(1, VALUES // width)
        rough = asked @ matches.T
        rough *= -2.0
        rough += norms
        rough += own[:, None]
        if skip_self:
            rough[self.ids[some][:, None] == match_ids[None, :]] = np.inf
        limit = self.bound[some]
        open_ = np.flatnonzero(np.isinf(limit))
        if len(open_):
            kth = min(self.k, rough.shape[1]) - 1
            limit[open_] = np.partition(rough[open_], kth, axis=1)[:, kth]
        error = 4.0 * (width + 3) * np.finfo(np.float64).eps * (own + norms.max(initial=0.0))
        limit = np.minimum(limit + 2.0 * 10.0**-DIGITS + error, np.finfo(np.float64).max)
        rows, columns = np.nonzero(rough <= limit[:, None])
        for cut in range(0, len(rows), piece):
            r, c = rows[cut : cut + piece], columns[cut : cut + piece]
            self._keep(some[r], match_ids[c], np.round(((asked[r] - matches[c]) ** 2).sum(1), DIGITS))

    def _keep(self, rows: np.ndarray, match_ids: np.ndarray, distance: np.ndarray) -> None:
        """Merge candidates with those kept before; ties go to the smaller id."""
        held = np.unique(rows)
        r, c = np.nonzero(np.isfinite(self.distance[held]))
        rows = np.concatenate([held[r], rows])
        match_ids = np.concatenate([self.match_id[held[r], c], match_ids])
        distance = np.concatenate([self.distance[held[r], c], distance])
        order = np.lexsort((match_ids, distance, rows))
        first = np.searchsorted(rows[order], held)
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept, place = order[place < self.k], place[place < self.k]
        self.distance[rows[kept], place] = distance[kept]
        self.match_id[rows[kept], place] = match_ids[kept]
        self.bound[held] = np.minimum(self.bound[held], self.distance[held, -1])

    def frame(self) -> pd.DataFrame:
        rows, place = np.nonzero(np.isfinite(self.distance))
        return pd.DataFrame(
            {"query_id": self.ids[rows], "match_id": self.match_id[rows, place], "distance": self.distance[rows, place]}
        )


def _nearest(query_ids, queries, match_ids, matches, k: int, skip_self: bool) -> pd.DataFrame:
    """The ``k`` nearest matches per query among two bounded sets of vectors."""
    best = Nearest(query_ids, queries, k)
    best.add(match_ids, matches, skip_self)
    return best.frame()


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _final_rank(partial: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of the partial results; partitions are cut to ``k`` before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("distance", "match_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _as_side(df: DataFrame, id_column: str, vector: str, keys: list[str]) -> DataFrame:
    # Aliased, since both sides are often the same table.
    return df.where(F.col(vector).isNotNull()).select(
        *[F.col(key).alias(key) for key in keys], F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("vector")
    )


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    id_column: str,
    vector: str,
    k: int = C.RETRIEVED_DOCUMENTS,
    skip_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact ``k`` nearest corpus vectors per query by squared Euclidean distance.

    Few queries travel to the corpus, which is then read once without a shuffle and
    keeps ``k`` candidates per query and task. Queries beyond ``broadcast_bytes`` are
    joined block by block instead (see ``vector_topk_within``).
    """
    asked = _as_side(queries, id_column, vector, [])
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if size.n * (size.width or 0) * 8 > broadcast_bytes:
        return vector_topk_within(
            queries, corpus, id_column, vector, [], k, skip_self, block_rows
        )
    rows = asked.toPandas()
    if rows.empty:
        return queries.sparkSession.createDataFrame([], MATCH_SCHEMA + ", rank INT")
    # As wide as the numbers of the column; they become doubles some at a time.
    sent = queries.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), np.stack(rows["vector"].to_numpy())))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Nearest(*sent.value, k)
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                part = batch.iloc[at : at + block_rows]
                best.add(part["id"].to_numpy(), _matrix(part["vector"]), skip_self)
        yield best.frame()

    held = spread(_as_side(corpus, id_column, vector, []), "id")
    return _final_rank(held.mapInPandas(nearest, MATCH_SCHEMA), k)


def vector_topk_within(
    queries: DataFrame,
    corpus: DataFrame,
    id_column: str,
    vector: str,
    keys: list[str],
    k: int = C.RETRIEVED_DOCUMENTS,
    skip_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact ``k`` nearest corpus vectors per query among rows with equal ``keys``.

    Equal vectors are searched once: of equal corpus vectors only those with the
    smallest ids can be in a result, and equal queries share theirs. What is left is
    split into blocks of about ``block_rows`` vectors on both sides, however large a
    group is; where there are more, blocks follow cells around pivots, and cells that cannot hold a
    match of a query are not compared with it. A task compares one pair of blocks and keeps the best matches per
    query; the pairs themselves are never emitted.
    """
    wanted = k + 1 if skip_self else k
    asked, distinct, found = _distinct_sides(queries, corpus, id_column, vector, keys, wanted)
    distinct, found = materialize(distinct, "asked-vectors"), materialize(found, "found-vectors")
    if found.limit(block_rows + 1).count() > block_rows:
        shared = compare_cells(distinct, found, keys, wanted, block_rows)
    else:
        shared = _compare_blocks(distinct, found, keys, wanted, block_rows)
    return _shared_out(asked, distinct, shared, keys, k, skip_self)


def _distinct_sides(queries, corpus, id_column, vector, keys, wanted) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All queries, one query per vector, and of equal corpus vectors those that a result can hold."""
    asked = _as_side(queries, id_column, vector, keys)
    distinct = asked.groupBy(*keys, "vector").agg(F.min("id").alias("id"))
    copies = Window.partitionBy(*keys, "vector").orderBy("id")
    found = (
        _as_side(corpus, id_column, vector, keys)
        .withColumn("_copy", F.row_number().over(copies))
        .where(F.col("_copy") <= wanted)
        .drop("_copy")
    )
    return asked, distinct, found


def _shared_out(asked, distinct, shared, keys, k, skip_self) -> DataFrame:
    """The matches of one query per vector, given to all queries with that vector."""
    own = (
        asked.withColumnRenamed("id", "query_id")
        .join(distinct.withColumnRenamed("id", "_shared_id"), [*keys, "vector"])
        .join(shared.withColumnsRenamed({"query_id": "_shared_id"}), [*keys, "_shared_id"])
        .select("query_id", "match_id", "distance")
    )
    if skip_self:
        own = own.where(F.col("query_id") != F.col("match_id"))
    # A query may be in several groups.
    return _final_rank(own.distinct() if keys else own, k)


def _compare_blocks(
    left: DataFrame, right: DataFrame, keys: list[str], k: int, block_rows: int
) -> DataFrame:
    """Best ``k`` matches of every left vector in the right vectors of its group, with the keys."""
    group = [*keys, "_all"]
    left, right = left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0))

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(block_rows)).alias(name))

    counts = blocks(left, "left_blocks").join(blocks(right, "right_blocks"), group)

    def placed(side: DataFrame, own: str, other: str, own_part: str, other_part: str) -> DataFrame:
        """Each vector in its own block, once per block of the other side."""
        return (
            side.join(counts, group)
            .withColumn(own_part, F.pmod(F.xxhash64("id"), F.col(own)))
            .withColumn(other_part, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
            .drop("left_blocks", "right_blocks")
        )

    cell = [*group, "left_part", "right_part"]
    schema = T.StructType(
        [left.schema[key] for key in keys]
        + T.StructType.fromDDL(MATCH_SCHEMA).fields
    )

    def nearest(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or found.empty:
            return pd.DataFrame({name: [] for name in schema.names})
        bound = asked["kth"].to_numpy() if "kth" in asked else None
        best = Nearest(asked["id"].to_numpy(), np.stack(asked["vector"].to_numpy()), k, bound)
        if "reached" in asked:
            for rows, part in _meetings(asked["reached"], found):
                best.add(part["id"].to_numpy(), _matrix(part["vector"]), rows=rows)
        else:
            best.add(found["id"].to_numpy(), _matrix(found["vector"]))
        return best.frame().assign(**{key: asked[key].iloc[0] for key in keys})[schema.names]

    asked = placed(left, "left_blocks", "right_blocks", "left_part", "right_part")
    found = placed(right, "right_blocks", "left_blocks", "right_part", "left_part")
    # Few bytes and much work, so the tasks are not to be merged by their bytes.
    tasks = work_tasks(left.sparkSession)
    asked, found = asked.repartition(tasks, *cell), found.repartition(tasks, *cell)
    partial = asked.groupBy(*cell).cogroup(found.groupBy(*cell)).applyInPandas(nearest, schema)
    order = Window.partitionBy(*keys, "query_id").orderBy("distance", "match_id")
    return partial.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def _meetings(reached: pd.Series, found: pd.DataFrame) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    """Rows of queries, and the vectors of the cells that they reach.

    Cells that at least half of the queries reach are taken together for all of them.
    """
    wanted = np.unpackbits(np.frombuffer(b"".join(reached), dtype=np.uint8).reshape(len(reached), -1), axis=1).astype(bool)
    cells = found["cell"].to_numpy()
    common = wanted.mean(0) >= 0.5
    if common[cells].any():
        yield np.arange(len(reached)), found[common[cells]]
    for cell, part in found[~common[cells]].groupby("cell"):
        rows = np.flatnonzero(wanted[:, cell])
        if len(rows):
            yield rows, part


class Cells(NamedTuple):
    """Pivots, each the centre of a cell, and the largest distance of a corpus vector in the cell."""

    pivots: np.ndarray
    radius: np.ndarray


def _to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> Iterator[np.ndarray]:
    """Distances to all pivots, some vectors at a time, without the lost digits of a matrix product."""
    step = max(1, VALUES // max(1, pivots.size))
    for at in range(0, len(vectors), step):
        yield np.sqrt(((vectors[at : at + step, None] - pivots[None]) ** 2).sum(2))


def _in_cells(side: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``side`` with the ``cell`` of its nearest pivot, and the distance to it as ``reach``."""
    sent = side.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*side.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())])

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = list(_to_pivots(_matrix(batch["vector"]), sent.value))
                yield batch.assign(cell=np.concatenate([f.argmin(1) for f in far]), reach=np.concatenate([f.min(1) for f in far]))

    return side.mapInPandas(placed, schema)


def pivot_cells(found: DataFrame, block_rows: int, max_cells: int = MAX_CELLS, fit_rows: int = FIT_ROWS) -> tuple[Cells, DataFrame]:
    """Cells of about half a block of vectors, at most ``max_cells``, and ``found`` with its cells.

    Pivots are vectors of a bounded sample, each the one farthest from those before it.
    """
    n = found.count()
    sample = _matrix(found.orderBy(F.xxhash64("id"), "id").limit(fit_rows).toPandas()["vector"])
    chosen = [0]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(max_cells, len(sample), math.ceil(2 * n / block_rows)):
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(nearest.argmax()))
    placed = materialize(_in_cells(found, sample[chosen]), "cells")
    radius = np.zeros(len(chosen))
    for row in placed.groupBy("cell").agg(F.max("reach").alias("radius")).collect():
        radius[row["cell"]] = row["radius"]
    return Cells(sample[chosen], radius), placed.drop("reach")


def _regions(held: DataFrame, cells: Cells, keys: list[str], region_rows: int) -> np.ndarray:
    """The region of every cell: neighbouring cells, so many that a group has about ``region_rows`` vectors in it."""
    sizes = np.zeros(len(cells.pivots))
    for row in held.groupBy("cell").count().collect():
        sizes[row["cell"]] = row["count"]
    largest = held.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else sizes.sum()
    n = min(len(sizes), math.ceil(largest / region_rows))
    # The first pivots lie far apart; each is followed by the cells around it.
    around = np.concatenate([far.argmin(1) for far in _to_pivots(cells.pivots, cells.pivots[:n])])
    order = np.argsort(around, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    regions = np.zeros(len(sizes), dtype=np.int64)
    regions[order] = np.minimum(before * n // max(1.0, sizes.sum()), n - 1)
    return regions


def cells_within_reach(asked: DataFrame, cells: Cells, regions: np.ndarray | None = None) -> DataFrame:
    """``asked`` (…, vector, cell, kth) once for every other cell that may hold a nearer vector than its ``kth`` so far.

    By the triangle inequality no vector of a cell is nearer than the pivot's distance less the cell's radius.
    With ``regions``, one for each cell, a row leaves for every region with such cells: ``cell`` is the
    region, and ``reached`` has a bit for each of its cells.
    """
    area = np.arange(len(cells.pivots)) if regions is None else regions
    inside = area[:, None] == np.arange(area.max() + 1)
    sent = asked.sparkSession.sparkContext.broadcast((cells, inside))
    schema = T.StructType([*asked.schema.fields, *([] if regions is None else [T.StructField("reached", T.BinaryType())])])

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (pivots, radius), inside = sent.value
        for batch in batches:
            if not len(batch):
                continue
            at = 0
            for far in _to_pivots(_matrix(batch["vector"]), pivots):
                part = batch.iloc[at : at + len(far)]
                at += len(far)
                least = np.maximum(far * (1 - 1e-9) - radius * (1 + 1e-9), 0.0) ** 2
                wanted = least <= part["kth"].to_numpy()[:, None] + 2.0 * 10.0**-DIGITS
                wanted[np.arange(len(part)), part["cell"].to_numpy()] = False
                row, region = np.nonzero(wanted.astype(np.float32) @ inside.astype(np.float32))
                rows = part.iloc[row].assign(cell=region)
                if regions is not None:
                    bits = np.packbits(wanted[row] & inside[:, region].T, axis=1)
                    rows = rows.assign(reached=[b.tobytes() for b in bits])
                yield rows

    return asked.mapInPandas(reached, schema)


def compare_cells(left: DataFrame, right: DataFrame, keys: list[str], k: int, block_rows: int) -> DataFrame:
    """Like ``_compare_blocks``, but vectors meet only where their distance to pivots allows a match.

    Every query first searches the cell of its nearest pivot; its k-th distance there then
    rules out the cells that are too far away. For the others it is sent once to a region of many cells, as a
    copy for each would be most of the bytes.
    """
    cells, held = pivot_cells(right, block_rows)
    asked = materialize(_in_cells(left, cells.pivots).drop("reach"), "asked-cells")
    own = materialize(_compare_blocks(asked, held, [*keys, "cell"], k, block_rows), "own-cell").drop("cell")
    kth = own.groupBy(*keys, "query_id").agg(F.when(F.count("*") == k, F.max("distance")).alias("kth")).withColumnRenamed("query_id", "id")
    bounded = asked.join(kth, [*keys, "id"], "left").withColumn("kth", F.coalesce("kth", F.lit(math.inf)))
    region_rows = max(block_rows, min(JOINED_BLOCKS * block_rows, JOINED_BYTES // (8 * max(1, cells.pivots.shape[1]))))
    regions = _regions(held, cells, keys, region_rows)
    rest = materialize(cells_within_reach(bounded, cells, regions).withColumnRenamed("cell", "region"), "reached-cells")
    region = F.element_at(F.array(*[F.lit(int(r)) for r in regions]), F.col("cell") + 1)
    other = _compare_blocks(rest, held.withColumn("region", region), [*keys, "region"], k, region_rows).drop("region")
    order = Window.partitionBy(*keys, "query_id").orderBy("distance", "match_id")
    # Where most queries reach a cell, all are compared with it, also those it is the own cell of.
    both = own.unionByName(other).repartition(*keys, "query_id").distinct()
    return both.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def retrieve(
    queries: DataFrame,
    corpus: DataFrame,
    id_column: str,
    vector: str,
    category: str,
    k: int = C.RETRIEVED_DOCUMENTS,
    skip_self: bool = False,
) -> DataFrame:
    """Nearest documents of the query's own category; general queries search everything."""
    general = F.coalesce(F.col(category) == C.DEFAULT_CATEGORY, F.lit(True))
    within = vector_topk_within(
        queries.where(~general), corpus, id_column, vector, [category], k, skip_self
    )
    anywhere = vector_topk(queries.where(general), corpus, id_column, vector, k, skip_self)
    return within.unionByName(anywhere)


def retrieved_labels(matches: DataFrame, corpus: DataFrame, id_column: str, label: str) -> DataFrame:
    """Label of the nearest match of every query."""
    nearest = matches.where(F.col("rank") == 1).select("query_id", "match_id")
    labels = corpus.select(F.col(id_column).alias("match_id"), F.col(label).alias("retrieved_label"))
    return nearest.join(labels, "match_id")
