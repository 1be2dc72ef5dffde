"""Approximate nearest vectors through inverted lists of product codes.

Every vector is in the list of its nearest centre, and what is left of it after the centre is
cut into stretches, each replaced by the number of the nearest codeword. A query reads a fixed
number of lists: per list a table of its distances to all codewords, added up along the codes. The
best few candidates are then ranked by their true distances. Centres and codewords are fitted on
a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from supportlens import constants as C
from supportlens.operators.retrieval import (
    CELLS,
    DIGITS,
    MATCH_SCHEMA,
    _as_side,
    _distinct_sides,
    _final_rank,
    _matrix,
    _shared_out,
    vector_topk,
)
from supportlens.session import materialize, work_tasks

#: Inverted lists at most, and rows and bytes at most that centres and codewords are fitted on.
MAX_LISTS, FIT_ROWS, FIT_BYTES = 4096, 1 << 16, 64 << 20
#: Stretches of a vector, and codewords for each.
STRETCHES, CODEWORDS = 16, 256
#: Lists that a query reads, and candidates whose true distances are taken.
PROBES, RANKED = 8, 32
#: Neighbouring lists that are read together, at least, and the codes that a part of more lists holds by expectation.
LISTS_PER_PART, PART_CODES = 8, 1 << 15
#: Codes and queries of a part that meet in a task; larger parts are cut.
BLOCK_CODES, BLOCK_QUERIES = 1 << 16, 1 << 12
#: Queries that are placed, or compared with a list, at a time.
PLACED_ROWS = 1 << 9


class Fitted(NamedTuple):
    """Centres in the order of their parts, where each part begins, and the codewords of each stretch."""

    centres: np.ndarray
    part_of_list: np.ndarray
    codewords: list[np.ndarray]


def nearest_centres(points: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The numbers of the ``n`` nearest centres of each point, the nearest first; ties by number."""
    half = 0.5 * (centres**2).sum(1)
    out = []
    step = max(1, CELLS // max(1, len(centres)))
    for at in range(0, len(points), step):
        rough = half - points[at : at + step] @ centres.T
        out.append(rough.argmin(1)[:, None] if n == 1 else np.argsort(rough, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, min(n, len(centres))), dtype=np.int64)


def centres_of(points: np.ndarray, k: int, rounds: int = 10, seed: int = C.SEED) -> np.ndarray:
    """Lloyd's means from ``k`` of the points; a mean that loses all its points stays where it was."""
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.choice(len(points), min(k, len(points)), replace=False))].copy()
    for _ in range(rounds):
        owner = nearest_centres(points, centres)[:, 0]
        sizes = np.bincount(owner, minlength=len(centres))
        order = np.argsort(owner, kind="stable")
        held = np.flatnonzero(sizes)
        sums = np.add.reduceat(points[order], (np.cumsum(sizes) - sizes)[held], axis=0)
        centres[held] = sums / sizes[held, None]
    return centres


def _stretches(width: int, n: int) -> list[slice]:
    borders = np.linspace(0, width, min(n, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(borders[:-1], borders[1:], strict=True)]


def fit(
    sample: np.ndarray, n_lists: int, stretches: int = STRETCHES, codewords: int = CODEWORDS, lists_per_part: int = LISTS_PER_PART
) -> Fitted:
    centres = centres_of(sample, n_lists)
    # Lists whose centres are near each other form a part, so a query visits few parts.
    parts = centres_of(centres, -(-len(centres) // lists_per_part))
    part_of_list = nearest_centres(centres, parts)[:, 0]
    left = sample - centres[nearest_centres(sample, centres)[:, 0]]
    words = [centres_of(left[:, part], codewords) for part in _stretches(sample.shape[1], stretches)]
    return Fitted(centres, part_of_list.astype(np.int64), words)


def encode(points: np.ndarray, fitted: Fitted) -> tuple[np.ndarray, np.ndarray]:
    """The list of each point and its code, a byte per stretch."""
    lists = nearest_centres(points, fitted.centres)[:, 0]
    left = points - fitted.centres[lists]
    parts = _stretches(points.shape[1], len(fitted.codewords))
    codes = [nearest_centres(left[:, part], words)[:, 0] for part, words in zip(parts, fitted.codewords, strict=True)]
    return lists, np.stack(codes, axis=1).astype(np.uint8)


def rough_distances(queries: np.ndarray, centre: np.ndarray, codes: np.ndarray, fitted: Fitted) -> np.ndarray:
    """Squared distances of queries to coded vectors of one list, from a table per query."""
    left = queries - centre
    # A row for each code, so that whole rows of a table are copied.
    out = np.zeros((len(codes), len(queries)))
    for s, (part, words) in enumerate(zip(_stretches(queries.shape[1], len(fitted.codewords)), fitted.codewords, strict=True)):
        own = left[:, part]
        table = (own**2).sum(1) - 2.0 * words @ own.T + (words**2).sum(1)[:, None]
        out += table[codes[:, s]]
    return out.T


class Closest:
    """The ``n`` candidates with the smallest rough distances of each of some queries, whatever number of them is seen."""

    def __init__(self, queries: int, n: int):
        self.distance = np.full((queries, n), np.inf)
        self.match_id = np.zeros((queries, n), dtype=np.int64)

    def add(self, rows: np.ndarray, match_ids: np.ndarray, rough: np.ndarray) -> None:
        """Take the candidates ``match_ids`` of the queries ``rows`` into account, with a row of distances for each query."""
        n = self.distance.shape[1]
        kept = min(n, rough.shape[1])
        rough = np.ascontiguousarray(rough)
        places = np.argpartition(rough, kept - 1, axis=1)[:, :kept]
        distance = np.hstack([self.distance[rows], np.take_along_axis(rough, places, 1)])
        ids = np.hstack([self.match_id[rows], match_ids[places]])
        places = np.argpartition(distance, n - 1, axis=1)[:, :n]
        self.distance[rows] = np.take_along_axis(distance, places, 1)
        self.match_id[rows] = np.take_along_axis(ids, places, 1)

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        rows, places = np.nonzero(np.isfinite(self.distance))
        return pd.DataFrame(
            {"query_id": query_ids[rows], "match_id": self.match_id[rows, places], "distance": self.distance[rows, places]}
        )


def closest_codes(asked: pd.DataFrame, held: pd.DataFrame, fitted: Fitted, ranked: int) -> pd.DataFrame:
    """The ``ranked`` nearest of the codes ``held`` (id, list, code) for every query ``asked`` (id, vector, lists).

    Of a query only these are kept, from list to list, however many lists it reads.
    """
    found = Closest(len(asked), ranked)
    if len(asked) and len(held):
        vectors = _matrix(asked["vector"])
        owner = np.repeat(np.arange(len(asked)), asked["lists"].map(len))
        wanted = np.concatenate(asked["lists"].to_numpy())
        order = np.argsort(wanted, kind="stable")
        owner, wanted = owner[order], wanted[order]
        for number, rows in held.groupby("list"):
            asking = owner[slice(*np.searchsorted(wanted, [number, number + 1]))]
            codes = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
            match_ids = rows["id"].to_numpy()
            step = max(1, min(PLACED_ROWS, CELLS // len(rows)))
            for at in range(0, len(asking), step):
                some = asking[at : at + step]
                found.add(some, match_ids, rough_distances(vectors[some], fitted.centres[number], codes, fitted))
    return found.frame(asked["id"].to_numpy())


class VectorIndex:
    """An index over one table of vectors.

    ``corpus`` holds id and vector of every indexed row; of equal vectors only those with the smallest ids that
    a result of ``wanted`` matches can hold are there. ``codes`` holds id, list, part and code.
    """

    def __init__(self, corpus: DataFrame, codes: DataFrame, fitted: Fitted | None, wanted: int):
        self.corpus, self.codes, self.fitted, self.wanted = corpus, codes, fitted, wanted

    @classmethod
    def build(cls, corpus: DataFrame, id_column: str, vector: str, wanted: int, lists: int | None = None) -> VectorIndex:
        """Index ``corpus`` for results of up to ``wanted`` matches, a query itself included.

        There are about 2 * sqrt(rows) lists, at most ``MAX_LISTS``. The sample are the first rows by the hash of their id.
        """
        *_, found = _distinct_sides(corpus, corpus, id_column, vector, [], wanted)
        found = materialize(found, "indexed-vectors")
        spark = corpus.sparkSession
        n, width = found.agg(F.count("*"), F.max(F.size("vector"))).first()
        if not n:
            return cls(found, spark.createDataFrame([], "id BIGINT, list INT, part INT, code BINARY"), None, wanted)
        rows = max(1, min(FIT_ROWS, FIT_BYTES // (8 * width)))
        sample = found.orderBy(F.xxhash64("id"), "id").limit(rows).toPandas()
        n_lists = min(lists or math.ceil(2 * math.sqrt(n)), MAX_LISTS, n)
        fitted = fit(_matrix(sample["vector"]), n_lists, lists_per_part=max(LISTS_PER_PART, PART_CODES * n_lists // n))
        sent = spark.sparkContext.broadcast(fitted)

        def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = sent.value
            for batch in batches:
                if len(batch):
                    numbers, codes = encode(_matrix(batch["vector"]), held)
                    yield pd.DataFrame(
                        {"id": batch["id"], "list": numbers, "part": held.part_of_list[numbers], "code": [row.tobytes() for row in codes]}
                    )

        codes = materialize(found.mapInPandas(coded, "id BIGINT, list INT, part INT, code BINARY"), "vector-codes")
        return cls(found, codes, fitted, wanted)

    # --- search ---------------------------------------------------------------------

    def probed(self, queries: DataFrame, probes: int = PROBES) -> DataFrame:
        """``queries`` (id, vector) once for each part that holds some of its nearest lists, with these."""
        sent = queries.sparkSession.sparkContext.broadcast(self.fitted)

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = sent.value
            for batch in batches:
                # A row leaves for every part, so few rows at a time.
                for at in range(0, len(batch), PLACED_ROWS):
                    some = batch.iloc[at : at + PLACED_ROWS]
                    lists = nearest_centres(_matrix(some["vector"]), held.centres, min(probes, len(held.centres)))
                    part = held.part_of_list[lists]
                    order = np.argsort(part, axis=1, kind="stable")
                    lists, part = np.take_along_axis(lists, order, 1), np.take_along_axis(part, order, 1)
                    first = np.ones(part.shape, dtype=bool)
                    first[:, 1:] = part[:, 1:] != part[:, :-1]
                    place = np.nonzero(first)[0]
                    yield pd.DataFrame(
                        {
                            "id": some["id"].to_numpy()[place],
                            "vector": some["vector"].to_numpy()[place],
                            "part": part[first],
                            "lists": np.split(lists.ravel(), np.flatnonzero(first)[1:]),
                        }
                    )

        asked = queries.select("id", "vector")
        kind = asked.schema["vector"].dataType.simpleString()
        return asked.mapInPandas(placed, f"id BIGINT, vector {kind}, part INT, lists ARRAY<INT>")

    def candidates(self, probed: DataFrame, ranked: int = RANKED) -> DataFrame:
        """The ``ranked`` vectors with the smallest rough distances to each query, as query_id, match_id and distance.

        Parts are cut into blocks on both sides, and a block of queries meets a block of codes in one task; only
        the best candidates leave it.
        """
        sent = probed.sparkSession.sparkContext.broadcast(self.fitted)
        blocks = lambda side, name, n: side.groupBy("part").agg(F.ceil(F.count("*") / F.lit(n)).alias(name))
        cell = ["part", "q_block", "c_block"]
        # Few bytes and much work, so the tasks are not to be merged by their bytes.
        tasks = work_tasks(probed.sparkSession)
        counts = blocks(probed, "q_blocks", BLOCK_QUERIES).join(blocks(self.codes, "c_blocks", BLOCK_CODES), "part")

        def placed(side: DataFrame, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
            return (
                side.join(counts, "part")
                .withColumn(own_block, F.pmod(F.xxhash64("id"), F.col(own)))
                .withColumn(other_block, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
                .drop("q_blocks", "c_blocks")
                .repartition(tasks, *cell)
            )

        def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            return closest_codes(asked, held, sent.value, ranked)

        asked = placed(probed, "q_blocks", "c_blocks", "q_block", "c_block")
        held = placed(self.codes, "c_blocks", "q_blocks", "c_block", "q_block")
        partial = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInPandas(best, MATCH_SCHEMA)
        return _final_rank(partial, ranked)

    def matches(self, candidates: DataFrame, queries: DataFrame) -> DataFrame:
        """Candidates with their true distances, squared and rounded like those of exact search."""
        pair = (
            candidates.select("query_id", "match_id")
            .join(self.corpus.select(F.col("id").alias("match_id"), F.col("vector").alias("_match")), "match_id")
            .join(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("_query")), "query_id")
        )
        gaps = F.zip_with(
            F.col("_query").cast("array<double>"), F.col("_match").cast("array<double>"), lambda x, y: (x - y) * (x - y)
        )
        distance = F.round(F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x), DIGITS)
        return pair.select("query_id", "match_id", distance.alias("distance"))

    def search(
        self, queries: DataFrame, id_column: str, vector: str, k: int, skip_self: bool = False, probes: int = PROBES, ranked: int = RANKED
    ) -> DataFrame:
        """About the ``k`` nearest vectors of every query, as ``vector_topk`` returns them.

        Queries that find fewer than they could are searched exactly. Equal queries are searched once.
        """
        wanted = k + 1 if skip_self else k
        if wanted > self.wanted:
            raise ValueError(f"the index holds results of up to {self.wanted} matches")
        spark = queries.sparkSession
        if self.fitted is None:
            return spark.createDataFrame([], MATCH_SCHEMA + ", rank INT")
        asked = _as_side(queries, id_column, vector, [])
        distinct = materialize(asked.groupBy("vector").agg(F.min("id").alias("id")), "asked-vectors")
        chosen = self.candidates(materialize(self.probed(distinct, probes), "probed-lists"), max(ranked, wanted))
        shared = _final_rank(self.matches(chosen, distinct), wanted).drop("rank")
        near = materialize(_shared_out(asked, distinct, shared, [], k, skip_self), "near-vectors")
        # A query that is in the corpus has one other vector less, which only a table of k rows shows.
        others = self.corpus.limit(k).count()
        full = near.groupBy("query_id").count().where(F.col("count") >= others).select("query_id")
        short = materialize(asked.join(full, asked["id"] == full["query_id"], "left_anti"), "short-queries")
        if short.isEmpty():
            return near
        exact = vector_topk(short, self.corpus, "id", "vector", k, skip_self)
        return near.join(full, "query_id", "left_semi").unionByName(exact)

    def work(self, queries: DataFrame, id_column: str, vector: str, probes: int = PROBES, ranked: int = RANKED) -> DataFrame:
        """What a search does, as shares of all pairs: codes read, and true distances taken."""
        asked = _as_side(queries, id_column, vector, []).groupBy("vector").agg(F.min("id").alias("id"))
        read = (
            self.probed(asked, probes)
            .select("id", F.explode("lists").alias("list"))
            .join(self.codes.groupBy("list").agg(F.count("*").alias("n")), "list")
            .groupBy("id")
            .agg(F.sum("n").alias("n"))
        )
        pairs = F.count("*") * self.corpus.agg(F.count("*")).scalar()
        return read.agg(
            F.round(F.sum("n") / pairs, 6).alias("share_read"),
            F.round(F.sum(F.least("n", F.lit(ranked))) / pairs, 6).alias("share_compared"),
        )


def ann_topk(
    queries: DataFrame, corpus: DataFrame, id_column: str, vector: str, k: int = C.RETRIEVED_DOCUMENTS,
    skip_self: bool = False, lists: int | None = None, probes: int = PROBES, ranked: int = RANKED,
) -> DataFrame:
    """Build an index and search it once. Vectors that form clusters need few ``probes``; those without any
    structure need most of the lists for a recall of 0.9, so measure it and choose."""
    index = VectorIndex.build(corpus, id_column, vector, k + 1 if skip_self else k, lists)
    return index.search(queries, id_column, vector, k, skip_self, probes, ranked)


def recall(exact: DataFrame, near: DataFrame) -> DataFrame:
    """Share of the exact matches that an approximate search found, as one row."""
    hits = exact.select("query_id", "match_id").join(
        near.select("query_id", "match_id", F.lit(1).alias("hit")), ["query_id", "match_id"], "left"
    )
    return hits.agg(F.count("*").alias("n_exact"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
