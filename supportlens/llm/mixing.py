"""Mix sources to target weights by weighted sampling without replacement.

Every document gets an exponential key scaled by its quality weight, drawn from a hash
of its id, so reruns agree. Whole epochs of a source come first; the rest of its target
is filled in key order by a prefix sum. The prefix sum runs over cells of the key range
first and over the rows of a cell then, so no task holds a whole source. Cells are even
steps of the key's logarithm: an exponential key, whatever its weight, falls into a step of
width e * t with a chance of at most t, and so does any mixture of weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from supportlens.llm.common import WORD, packed, text_of
from supportlens.session import materialize

#: Weights of the sources in order, repeating, and what they share of all words.
SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: No source is taken more often than this.
MAX_EPOCHS = 2
#: Rows that a cell holds at most, by expectation.
CELL_ROWS = 5000


def uniform(seed: int) -> Column:
    """A number in (0, 1) from the document's id, the same in every run."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def quality_weight() -> Column:
    """From 1 for plain prose down to 1/21 for nothing but markup signs."""
    text = text_of()
    signs = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    return 1.0 / (1.0 + 20.0 * signs / F.greatest(F.length(text), F.lit(1)))


def cell_of(rank_key: Column, n_rows: Column) -> Column:
    """The cell of a key in a source of ``n_rows``; cells follow the order of the keys."""
    bounded = F.least(F.greatest(rank_key, F.lit(1e-300)), F.lit(1e300))
    return F.floor(F.ceil(n_rows / CELL_ROWS) / math.e * F.log(bounded)).cast("long")


def source_targets(sources: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE) -> DataFrame:
    """Add ``target`` to one row per source (source_key, source_size).

    Targets are proportional to the weights and stop at ``MAX_EPOCHS`` times the source;
    what is over goes to the others. That is least(cap, level * weight) for one level, and
    the level is the largest of (rest of the words) / (rest of the weights) over the
    sources in order of cap / weight.
    """
    place = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    capped = sources.withColumn("weight", weight).withColumns(
        {
            "cap": F.col("source_size") * float(MAX_EPOCHS),
            "words": F.sum("source_size").over(whole) * F.lit(share),
        }
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = capped.withColumn("level", rest / F.sum("weight").over(onward))
    return level.select(
        "source_key",
        "source_size",
        "n_rows",
        F.least("cap", F.max("level").over(whole) * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame, quality: Column | None = None, seed: int = 20, weights=SOURCE_WEIGHTS, share=SHARE, row_key: Column | None = None
) -> DataFrame:
    """How many words of each row of ``docs`` (doc_id, source, text) the mix takes.

    Returns doc_id, source, size, source_size, target, epochs (whole passes), chosen (one
    more pass) and taken. Null text has size 0 and is never chosen; a null source is one
    source, last in order. ``quality`` weighs documents (default: ``quality_weight``); a
    null or non-positive weight counts as the smallest. Equal keys fall back on doc_id and
    size; rows that repeat a doc_id are sampled as rows. The last document is chosen if
    that comes nearer the target. ``row_key`` is carried along. An empty table gives an empty result.
    """
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    weight = F.greatest(F.coalesce(quality if quality is not None else quality_weight(), F.lit(0.0)), F.lit(1e-3))
    stats = materialize(
        docs.select(
            "doc_id", "source", key.alias("source_key"), size.alias("size"),
            (-F.log(uniform(seed)) / weight).alias("rank_key"), *([] if row_key is None else [row_key.alias("row_key")]),
        ),
        "mix-sizes",
    )
    sources = stats.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = materialize(source_targets(sources, weights, share), "mix-targets")
    rows = stats.join(targets, "source_key").withColumn("cell", cell_of(F.col("rank_key"), F.col("n_rows")))
    in_order = Window.partitionBy("source_key").orderBy("cell")
    cells = (
        rows.groupBy("source_key", "cell")
        .agg(F.sum("size").alias("words"))
        .withColumn("cell_start", F.sum("words").over(in_order) - F.col("words"))
        .drop("words")
    )
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    in_cell = Window.partitionBy("source_key", "cell").orderBy("rank_key", "doc_id", "size")
    before = F.col("cell_start") + F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    return (
        rows.join(cells, ["source_key", "cell"])
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("chosen", (F.col("size") > 0) & (2 * before + F.col("size") <= 2 * budget))
        .select(
            "doc_id", "source", "size", "source_size", "target", "epochs", "chosen",
            (F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))).alias("taken"), *([] if row_key is None else ["row_key"]),
        )
    )


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: a row once per pass, all columns as they were.

    Rows are found by doc_id, source and text; rows that agree in all of them share their passes.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "source")]
    key = F.concat_ws(":", *named, F.md5(text_of()))
    passes = (
        mix(docs, row_key=key, **how)
        .groupBy("row_key")
        .agg(F.max(F.col("epochs") + F.col("chosen").cast("long")).cast("int").alias("passes"))
        .where("passes > 0")
    )
    repeated = F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass")
    return packed(docs, key.alias("row_key")).join(passes, "row_key").select("row", repeated).select("row.*")
