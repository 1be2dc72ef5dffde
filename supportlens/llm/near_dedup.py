"""Near-duplicate detection by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 72 symbols of 16 bits. Two texts with 3/4 of their shingles in common differ
in 18 symbols on average, and in more than 35 about once in 230,000 cases. By the pigeonhole
principle, signatures that differ in at most 35 of 72 symbols differ in at most one symbol of
one of 18 chunks of four; so each chunk is indexed four times, each time without one symbol.
All pairs under the threshold meet in a bucket. Links are confirmed on whole shingle sets.

Equal sets count as one text, whatever documents hold it. In the buckets of the first chunks, a text proposes its nearest
neighbours; once their links are confirmed and components known, all buckets that still hold
several components are read, and all pairs under the threshold that join different ones are
compared. So no link between components is lost, and a group of copies costs about as many
links as it has texts. That last step takes the sets to the buckets and returns links, so the
pairs themselves are never rows; a bucket of many texts is cut into blocks, and tasks hold two
blocks at a time, of which one component never fills both. Only numbers are shuffled to find those buckets; signatures go to them alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from supportlens.llm.common import packed, text_of
from supportlens.llm.shingles import mixed, shingle_sets
from supportlens.session import materialize

SYMBOLS, CHUNK = 72, 4
CHUNKS = SYMBOLS // CHUNK
#: Signatures that differ in more symbols are not compared.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Link when 100 * common >= 75 * union.
SIMILARITY = 75
#: Chunks whose buckets propose pairs first; the last step reads the buckets of all chunks.
FIRST_CHUNKS = 4
#: Symbols in which a pair that is proposed first may differ: the mean of the least similar links.
FIRST_DISTANCE = SYMBOLS // 4
#: Nearest neighbours that a text proposes first in each bucket.
NEAREST = 1
#: 64-bit words of the table that keeps most unwanted texts out of a shuffle (2 MB).
FILTER_WORDS = 1 << 18
#: Cells of the distance table that a task holds at a time.
CELLS = 1 << 18
#: Rows of a bucket from which it is cut into blocks.
BLOCK_ROWS = 4096
#: Rows of such a bucket that are in all its blocks when pairs are proposed first, by expectation.
JOINING_ROWS = 64

_RNG = np.random.default_rng(72)
_MULTIPLY = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)

SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.string()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("signature", pa.binary())]
)
KEYED = pa.schema([("key", pa.int64()), ("doc", pa.int64())])
PLACED = pa.schema(
    [("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("doc", pa.int64()), ("block", pa.int32())]
)
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SETS = pa.schema([("doc", pa.int64()), ("hashes", pa.binary())])


def signatures(hashes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """One row of 16-bit symbols per text; texts without shingles have zeros."""
    filled = np.flatnonzero(np.diff(borders))
    out = np.zeros((len(borders) - 1, SYMBOLS), dtype="<u2")
    if len(filled):
        starts = borders[filled]
        for j in range(SYMBOLS):
            least = np.minimum.reduceat((hashes ^ _FLIP[j]) * _MULTIPLY[j], starts)
            out[filled, j] = (mixed(least) & np.uint64(0xFFFF)).astype("<u2")
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _digest(hashes: bytes) -> bytes:
    return hashlib.blake2b(hashes, digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, signed = [], [], []
        for hashes, borders in shingle_sets(_texts(batch)):
            sizes.append(np.diff(borders))
            for i in range(len(borders) - 1):
                part = hashes[borders[i] : borders[i + 1]]
                digests.append(_digest(part.tobytes()))
            signed += [row.tobytes() for row in signatures(hashes, borders)]
        n = np.concatenate(sizes) if sizes else np.zeros(0, dtype="int64")
        arrays = [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, schema=SIGNED)


def _as_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, SYMBOLS)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """72 keys per signature: the number of chunk and gap above the three symbols left."""
    for batch in batches:
        docs = batch.column("doc").to_numpy()
        chunks = _as_matrix(batch.column("signature")).astype(np.int64).reshape(-1, CHUNKS, CHUNK)
        for c in range(CHUNKS):
            for gap in range(CHUNK):
                x, y, z = (chunks[:, c, k] for k in range(CHUNK) if k != gap)
                keys = np.int64(c * CHUNK + gap) << 48 | x << 32 | y << 16 | z
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs)], schema=KEYED)


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows cut between groups of equal ``names`` only, and the borders of the groups."""
    kept: list[pa.RecordBatch] = []

    def borders(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for name in names:
            column = table.column(name).to_numpy()
            new |= column[1:] != column[:-1]
        return np.concatenate(([0], np.flatnonzero(new) + 1, [table.num_rows]))

    for batch in batches:
        if not batch.num_rows:
            continue
        if kept and all(kept[0].column(n)[0] == batch.column(n)[batch.num_rows - 1] for n in names):
            kept.append(batch)
            continue
        table = pa.Table.from_batches([*kept, batch])
        cuts = borders(table)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]), cuts[:-1]
        kept = table.slice(cuts[-2]).to_batches()
    if kept:
        table = pa.Table.from_batches(kept)
        yield table, borders(table)


def _shared(first: DataFrame) -> DataFrame:
    """(key, doc, size) for the keys that several documents have.

    Counts are combined before the shuffle and the join can be split, so no task holds a key.
    """
    keys = first.select("doc", "signature").mapInArrow(_index, "key long, doc long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return keys.join(sizes, "key").select("key", "doc", "size")


def _allowed(bucket: Bucket, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Distances of these rows to the rows before the last of them, and which pairs to propose.

    A pair is proposed in the first bucket that it shares, by chunk and gap; within the
    distance; if the sizes of the sets allow a link; and not within one component or, where
    a bucket is cut into blocks, within one block that meets another.
    """
    upto = rows.stop
    chunk, gap = divmod(int(bucket.key) >> 48, CHUNK)
    left, right = bucket.matrix[rows], bucket.matrix[:upto]
    distance = np.zeros((len(left), upto), dtype=np.int16)
    owned = np.ones(distance.shape, dtype=bool)
    for c in range(CHUNKS):
        differing = np.zeros(distance.shape, dtype=np.int16)
        for j in range(c * CHUNK, (c + 1) * CHUNK):
            differing += left[:, j, None] != right[None, :, j]
        distance += differing
        if c < chunk:
            owned &= differing > 1
        elif c == chunk and gap:
            owned &= differing == 1
    sizes, parts = bucket.sizes, bucket.parts
    small, large = np.minimum(sizes[rows, None], sizes[:upto]), np.maximum(sizes[rows, None], sizes[:upto])
    allowed = owned & (distance <= MAX_DISTANCE) & (100 * small >= SIMILARITY * large)
    allowed &= (np.arange(upto) < np.arange(rows.start, upto)[:, None]) & (parts[rows, None] != parts[:upto])
    if bucket.low != bucket.high:
        allowed &= bucket.blocks[rows, None] != bucket.blocks[:upto]
    return distance, allowed


class Bucket(NamedTuple):
    key: int
    low: int
    high: int
    docs: np.ndarray
    sizes: np.ndarray
    parts: np.ndarray
    blocks: np.ndarray
    matrix: np.ndarray
    sets: list | None

    def slices(self) -> Iterator[slice]:
        n = len(self.docs)
        step = max(1, CELLS // n)
        return (slice(start, min(n, start + step)) for start in range(0, n, step))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    """Buckets, or pairs of their blocks, that hold more than one component."""
    for table, borders in _whole_groups(batches, ["key", "low", "high"]):
        number = {n: table.column(n).to_numpy() for n in ("key", "low", "high", "doc", "n_shingles", "part", "block")}
        parts = number["part"]
        mixed_parts = np.minimum.reduceat(parts, borders[:-1]) != np.maximum.reduceat(parts, borders[:-1])
        signed = table.column("signature")
        hashes = table.column("hashes") if "hashes" in table.column_names else None
        for i in np.flatnonzero(mixed_parts):
            rows = slice(int(borders[i]), int(borders[i + 1]))
            n = rows.stop - rows.start
            yield Bucket(
                *(number[k][rows.start] for k in ("key", "low", "high")),
                *(number[k][rows] for k in ("doc", "n_shingles", "part", "block")),
                _as_matrix(signed.slice(rows.start, n)),
                hashes.slice(rows.start, n).to_pylist() if hashes is not None else None,
            )


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    rows = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(rows.min(axis=1)), pa.array(rows.max(axis=1))], schema=PAIRS)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text of a bucket the pairs with its nearest texts before it."""
    found: list[tuple[int, int]] = []
    for bucket in _buckets(batches):
        for rows in bucket.slices():
            distance, allowed = _allowed(bucket, rows)
            allowed &= distance <= FIRST_DISTANCE
            for _ in range(NEAREST):
                ranked = np.where(allowed, distance, np.int16(SYMBOLS + 1))
                best = ranked.argmin(axis=1)
                for i in np.flatnonzero(allowed[np.arange(len(best)), best]):
                    allowed[i, best[i]] = False
                    found.append((bucket.docs[best[i]], bucket.docs[rows.start + i]))
        if len(found) > 100_000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def _taking_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of buckets that are in any pair to propose."""
    for bucket in _buckets(batches):
        wanted = np.zeros(len(bucket.docs), dtype=bool)
        for rows in bucket.slices():
            _, allowed = _allowed(bucket, rows)
            wanted[rows] |= allowed.any(axis=1)
            wanted[: rows.stop] |= allowed.any(axis=0)
        if wanted.any():
            n = int(wanted.sum())
            arrays = [pa.array(np.full(n, x)) for x in (bucket.key, bucket.low, bucket.high)]
            arrays += [pa.array(bucket.docs[wanted]), pa.array(bucket.blocks[wanted])]
            yield pa.RecordBatch.from_arrays(arrays, schema=PLACED)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links that join components in a bucket; pairs already joined there are skipped."""
    for bucket in _buckets(batches):
        sets = [np.frombuffer(held, dtype="<u8") for held in bucket.sets]
        root = {int(p): int(p) for p in bucket.parts}

        def top(p: int, root=root) -> int:
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        found = []
        for rows in bucket.slices():
            _, allowed = _allowed(bucket, rows)
            for i, k in zip(*np.nonzero(allowed), strict=True):
                p, q = top(int(bucket.parts[rows.start + i])), top(int(bucket.parts[k]))
                if p != q and _linked(sets[k], sets[rows.start + i]):
                    root[max(p, q)] = min(p, q)
                    found.append((bucket.docs[k], bucket.docs[rows.start + i]))
        if found:
            yield _pairs(found)


def _linked(p: np.ndarray, q: np.ndarray) -> bool:
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    common = int(np.count_nonzero(q[at] == p))
    return 100 * common >= SIMILARITY * (len(p) + len(q) - common)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts that have the wanted one; a document may have other texts, too."""
    for batch in batches:
        out = [
            hashes[borders[i] : borders[i + 1]].tobytes()
            for hashes, borders in shingle_sets(_texts(batch))
            for i in range(len(borders) - 1)
        ]
        wanted = batch.column("set_id").to_pylist()
        right = pa.array([_digest(held) == digest for held, digest in zip(out, wanted, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.binary())], schema=SETS).filter(right)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = [
            _linked(*(np.frombuffer(side.as_buffer(), dtype="<u8") for side in pair))
            for pair in zip(batch.column("first"), batch.column("second"), strict=True)
        ]
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _whole_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, hashes) of the sets in ``wanted`` (doc), read from the documents that hold them.

    A bit table of fixed size, whatever the corpus, keeps out most texts that are not wanted;
    the join after it is exact.
    """
    wanted = sets.select("doc", "doc_id", "set_id").join(wanted.distinct(), "doc", "left_semi")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(64 * FILTER_WORDS))
    bits = wanted.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
    table = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).where("doc_id IS NOT NULL")
    likely = (
        texts.withColumn("place", place)
        .withColumn("word", F.shiftright("place", 6))
        .join(F.broadcast(table), "word")
        .where(F.getbit("bits", F.col("place") % 64) == 1)
        .select("doc_id", "text")
    )
    return likely.join(wanted, "doc_id").select("doc", "set_id", "text").mapInArrow(_sets, "doc long, hashes binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links, by whole sets."""
    first = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("first"))
    second = sets.select(F.col("doc").alias("b"), F.col("hashes").alias("second"))
    return pairs.join(first, "a").join(second, "b").mapInArrow(_confirm, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(doc, part) of every linked document: the smallest document it can reach.

    Labels pass along links and to the label's own document until none changes; the number
    of rounds grows with the logarithm of a chain's length.
    """
    both = materialize(
        links.select(F.col("a").alias("doc"), F.col("b").alias("other")).union(links.select("b", "a")), "links"
    )
    labels = materialize(both.groupBy("doc").agg(F.min("other").alias("part")).select("doc", F.least("doc", "part").alias("part")), "labels")
    while True:
        known = labels.select(F.col("doc").alias("other"), F.col("part").alias("near"))
        offered = both.join(known, "other").groupBy("doc").agg(F.min("near").alias("near"))
        lowered = labels.join(offered, "doc").select("doc", "part", F.least("part", "near").alias("new"))
        heads = lowered.groupBy(F.col("part").alias("head")).agg(F.min("new").alias("to"))
        moved = lowered.join(heads, F.col("part") == F.col("head")).select("doc", "part", F.least("new", "to").alias("new"))
        jumped = materialize(moved, "moved")
        heads = jumped.select(F.col("doc").alias("head"), F.col("new").alias("to"))
        labels = materialize(
            jumped.join(heads, F.col("new") == F.col("head"), "left").select(
                "doc", F.least("new", F.coalesce("to", "new")).alias("part"), (F.col("part") != F.least("new", F.coalesce("to", "new"))).alias("changed")
            ),
            "labels",
        )
        if labels.where("changed").isEmpty():
            return labels.select("doc", "part")
        labels = labels.drop("changed")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc"))


def _unsettled(shared: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of the buckets that hold more than one component."""
    held = shared.join(labelled.select("doc", "part"), "doc").groupBy("key")
    several = held.agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most")
    return shared.join(several.select("key"), "key", "left_semi").join(labelled.select("doc", "part"), "doc")


def _placed_first(shared: DataFrame) -> DataFrame:
    """Rows of large buckets cut into blocks that do not meet; a few texts are in all of them.

    Which rows these are is decided by a hash. They join the blocks of one group of copies,
    so that a bucket sends its rows about once.
    """
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    hashed = F.xxhash64("doc", "key")
    everywhere = F.pmod(hashed, F.greatest(F.floor(F.col("size") / JOINING_ROWS), F.lit(1))) == 0
    own = F.pmod(F.shiftright(hashed, 32), blocks).cast("int")
    places = F.when(everywhere, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    block = F.explode(places).alias("block")
    return shared.select("key", "doc", block).select("key", F.col("block").alias("low"), F.col("block").alias("high"), "doc", "block")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (key, doc, size, part) of buckets cut into blocks that meet all blocks they have to.

    A component of more than a block's rows gets blocks of its own, which do not meet each
    other; all other rows of the bucket share blocks. So the rows of one large group of copies
    go to the blocks of the other texts alone.
    """
    whole = rows.where(F.col("size") <= BLOCK_ROWS)
    zero = F.lit(0)
    together = whole.select("key", zero.alias("low"), zero.alias("high"), "doc", zero.alias("block"))
    large = rows.where(F.col("size") > BLOCK_ROWS)
    held = large.groupBy("key", "size", "part").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK_ROWS)
    blocks = F.ceil(F.col("held") / BLOCK_ROWS).cast("int")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = held.select(
        "key", "part", blocks.alias("n_own"), F.coalesce(F.sum(blocks).over(before), F.lit(0)).cast("int").alias("own_before")
    )
    taken = held.groupBy("key").agg(F.sum("held").alias("taken"), F.sum(blocks).cast("int").alias("n_taken"))
    hashed = F.xxhash64("doc")
    cut = (
        large.join(own, ["key", "part"], "left")
        .join(taken, "key", "left")
        .withColumn("n_shared", F.ceil((F.col("size") - F.coalesce("taken", F.lit(0))) / BLOCK_ROWS).cast("int"))
        .withColumn("start", F.col("n_shared") + F.col("own_before"))
        .withColumn("block", F.coalesce(F.col("start") + F.pmod(hashed, "n_own"), F.pmod(hashed, "n_shared")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_shared") + F.coalesce("n_taken", F.lit(0)) - 1)))
        .where("start IS NULL OR other < start OR other >= start + n_own")
    )
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return together.union(cut.select("key", low.alias("low"), high.alias("high"), "doc", "block"))


def _in_buckets(placed: DataFrame, *tables: DataFrame) -> DataFrame:
    """``placed`` with the columns that ``tables`` hold by doc, sorted by bucket."""
    for table in tables:
        placed = placed.join(table, "doc")
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "low", "high"]
    return placed.repartition(n, *order).sortWithinPartitions(*order, "doc")


def _named(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """(set_id, component) of every set: the smallest doc_id of all sets that it is linked with."""
    linked = parts.join(sets.select("doc", "doc_id"), "doc")
    least = linked.groupBy(F.col("part").alias("head")).agg(F.min("doc_id").alias("component"))
    placed = linked.join(least, F.col("part") == F.col("head")).select("doc", "component")
    return sets.join(placed, "doc", "left").select("set_id", F.coalesce("component", "doc_id").alias("component"))


def _judged(docs: DataFrame, key: Column) -> DataFrame:
    """``near_duplicates`` with the column ``key`` of each row.

    Sets are numbered; ``doc`` is the number of a set in all steps, ``doc_id`` the smallest
    document that has it. A document with several texts may so stand for several sets.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text_of().alias("text"))
    signed = materialize(
        texts.mapInArrow(_sign, "doc_id long, key string, n_shingles long, set_id binary, signature binary"), "signatures"
    )
    sets = materialize(
        signed.where("n_shingles > 0")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("doc_id"))
        .withColumn("doc", F.monotonically_increasing_id()),
        "set-holders",
    )
    # Sets that only rows without an id have are linked with nothing.
    holders = sets.where("doc_id IS NOT NULL")
    first = materialize(
        signed.select("doc_id", "set_id", "n_shingles", "signature")
        .join(holders, ["doc_id", "set_id"])
        .dropDuplicates(["doc"])
        .select("doc", "n_shingles", "signature")
        .withColumn("part", F.col("doc")),
        "first-of-sets",
    )
    shared = materialize(_shared(first), "shared-keys")
    early = shared.where(F.col("key") < FIRST_CHUNKS * CHUNK << 48)
    pairs = materialize(_in_buckets(_placed_first(early), first).mapInArrow(_nearest, "a long, b long").distinct(), "near-pairs")
    links = materialize(_confirmed(pairs, _whole_sets(docs, holders, _ends(pairs))), "near-links")
    parts = components(links)
    labelled = first.drop("part").join(parts, "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    labelled = materialize(labelled, "labelled")
    rest = _in_buckets(_placed(_unsettled(shared, labelled)), labelled).mapInArrow(
        _taking_part, "key long, low int, high int, doc long, block int"
    )
    rest = materialize(rest, "unsettled")
    whole = _whole_sets(docs, holders, rest.select("doc"))
    joining = materialize(
        _in_buckets(rest, labelled, whole).mapInArrow(_joined, "a long, b long").distinct(), "joining-links"
    )
    if not joining.isEmpty():
        parts = components(links.union(joining))
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return signed.join(_named(sets, parts), "set_id", "left").select(
        "key",
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Component of each row of ``docs`` (doc_id, text) under shingle similarity.

    Returns doc_id, n_shingles, component_id and kept. The set of a text holds its distinct
    runs of five words, A-Z lower-cased, or all words if they are fewer; texts without words,
    null included, are linked with nothing. ``component_id`` is the smallest doc_id that can
    be reached over links; that document is kept. A row without a doc_id is counted in its
    set's group but links to nothing else, and it is its own component (null, kept) unless
    a document of the same set has an id. Rows that repeat a doc_id and text share the
    result; rows that repeat a doc_id with other texts are judged one by one, each by its
    text, and a row is kept if its own component is named by its doc_id. Further columns are
    ignored; an empty table gives an empty result.
    """
    return _judged(docs, F.lit(None).cast("string")).drop("key")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: one document per component, all columns as they were.

    Rows are found by doc_id and text.
    """
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(text_of())).alias("key")
    kept = _judged(docs, named).where("kept").select("key").distinct()
    return packed(docs, named).join(kept, "key", "left_semi").select("row.*")
