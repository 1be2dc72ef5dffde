"""Exact deduplication through content-defined chunk recipes.

A text is cut where its content says so. Every chunk gets an identifier, which is
verified: the distinct (digest, chunk) pairs are gathered once, and a digest that
stands for two chunks is told apart by the chunk's rank. Documents are then compared
by their ordered identifier lists, so long texts move once at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from supportlens.llm.common import lower_ascii, packed, text_of
from supportlens.session import materialize

#: A chunk ends at the first line or sentence end after 1024 characters, or at 4096.
CUT = r"(?s).{1024,4095}?[\n.]|.{1,4096}"


def sha256(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def _recipes(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    normalised = lower_ascii(text_of())
    chunks = F.regexp_extract_all(normalised, F.lit(CUT), F.lit(0))
    return docs.select(
        "doc_id",
        F.sha2(normalised, 256).alias("text_sha256"),
        F.transform(chunks, digest).alias("recipe"),
    )


def _placed_chunks(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    normalised = lower_ascii(text_of())
    chunks = F.regexp_extract_all(normalised, F.lit(CUT), F.lit(0))
    return docs.select(
        "doc_id", F.sha2(normalised, 256).alias("text_sha256"), F.posexplode(chunks).alias("place", "chunk")
    ).withColumn("digest", digest(F.col("chunk")))


def _ranked_recipes(docs: DataFrame, recipes: DataFrame, shared: DataFrame, digest) -> DataFrame:
    """Recipes whose identifiers tell apart the chunks of the digests in ``shared``."""
    clashing = _placed_chunks(docs, digest).join(shared, "digest", "left_semi")
    by_digest = Window.partitionBy("digest").orderBy("chunk")
    ranks = clashing.select("digest", "chunk").distinct().withColumn("rank", F.row_number().over(by_digest))
    marks = (
        clashing.join(ranks, ["digest", "chunk"])
        .groupBy("doc_id", "text_sha256")
        .agg(F.sort_array(F.collect_set(F.struct("place", "rank"))).alias("marks"))
        .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "marks")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha"))
    mark = F.transform("marks", lambda m: F.concat_ws(":", m.place, m.rank).cast("binary"))
    return recipes.join(marks, same, "left").select(
        "doc_id", "text_sha256", F.concat("recipe", F.coalesce(mark, F.array())).alias("recipe")
    )


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which text it repeats and whether it stays.

    Texts are equal when identical after lower-casing A-Z; null equals the empty text.
    Of equal texts the largest doc_id stays, a null doc_id only if no other is there.
    ``doc_id`` names a document: rows that repeat it with an equal text share the verdict
    and count in ``group_size``. Further columns of ``docs`` are ignored; an empty table
    gives an empty result. ``digest`` need not be free of collisions.
    """
    recipes = materialize(_recipes(docs, digest), "recipes")
    seen = _placed_chunks(docs, digest).select("digest", "chunk").distinct()
    shared = materialize(seen.groupBy("digest").count().where("count > 1").select("digest"), "shared-digests")
    if not shared.isEmpty():
        recipes = _ranked_recipes(docs, recipes, shared, digest)
    # Written, so that the join gets two shuffles and Spark can split a large group.
    groups = materialize(
        recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    return recipes.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies: one row per text, all columns as they were.

    Where rows of the doc_id that stays have texts that differ in case, the text whose MD5 is smallest
    stays; of rows that agree in doc_id and text, any.
    """
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    kept = exact_dedup(docs).where("kept").select(F.concat_ws(":", named, "text_sha256").alias("key"))
    key = F.concat_ws(":", named, F.sha2(lower_ascii(text_of()), 256)).alias("key")
    rows = packed(docs, key, F.md5(text_of()).alias("exact")).join(kept, "key", "left_semi")
    return rows.groupBy("key").agg(F.min_by("row", "exact").alias("row")).select("row.*")
