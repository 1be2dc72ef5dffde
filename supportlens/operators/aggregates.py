"""Counts, shares and summary numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from supportlens import constants as C
from supportlens.functions import text as X
from supportlens.session import materialize


def as_rows(one_row: DataFrame, rows: list[Column]) -> DataFrame:
    """Turn the one row of an aggregate into one row per struct in ``rows``."""
    return one_row.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts and percent of all non-null values, one decimal."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 1))


def top_n(counts: DataFrame, label: str, n: int, count: str = "n") -> DataFrame:
    return counts.orderBy(F.desc(count), F.asc(label)).limit(n)


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def basic_stats(df: DataFrame) -> DataFrame:
    length = X.char_length("instruction")
    return df.agg(
        F.count("*").alias("total_samples"),
        F.countDistinct("category").alias("unique_categories"),
        F.countDistinct("intent").alias("unique_intents"),
        F.round(F.avg(length), 6).alias("avg_text_length"),
        F.max(length).alias("max_text_length"),
    )


def length_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.round(F.avg(F.length(c)), 6).alias(c) for c in columns])
    return as_rows(
        means, [F.struct(F.lit(c).alias("column"), F.col(c).alias("mean_length")) for c in columns]
    )


def topic_term_counts(
    df: DataFrame, question: str = "question", terms: list[str] = C.TOPIC_TERMS
) -> DataFrame:
    """For every term the number of questions containing it, zeros included."""
    lowered = F.lower(question)
    counts = df.agg(*[F.count_if(lowered.contains(term)).alias(term) for term in terms])
    return as_rows(
        counts, [F.struct(F.lit(t).alias("term"), F.col(t).alias("n")) for t in terms]
    )


def word_frequencies(df: DataFrame, cleaned: str, n: int = 100) -> DataFrame:
    """The ``n`` most frequent words of cleaned text."""
    counts = (
        df.select(F.explode(F.split(cleaned, " ")).alias("word"))
        .where(F.col("word") != "")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    return top_n(counts, "word", n)


#: Log-likelihood ratio from which two neighbours count as one term; the usual threshold of word clouds.
PAIR_SCORE = 30.0


#: The most frequent pairs that are scored first, for a score that the best ones reach.
FIRST_PAIRS = 10_000


def _counted(df: DataFrame, cleaned: str) -> tuple[DataFrame, DataFrame, float]:
    """Counts of words and of neighbouring words, and the number of all words; the texts are cleaned once.

    Every word but a text's last one is the first of a pair, and the last one is paired with null.
    """
    words = df.select(F.filter(F.split(cleaned, " "), lambda w: w != "").alias("words"))
    after = F.transform("words", lambda w, i: F.struct(w.alias("a"), F.get("words", i + 1).alias("b")))
    counts = words.select(F.inline(after)).groupBy("a", "b").agg(F.count("*").alias("n"))
    counts = materialize(counts, "pair-counts")
    single = materialize(counts.groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n")), "words")
    total = single.agg(F.sum("n")).first()[0]
    return single, counts.where(F.col("b").isNotNull()), float(total or 0)


def _scored(pairs: DataFrame, single: DataFrame, total: float) -> DataFrame:
    """Pairs with the log-likelihood ratio of their two words.

    The ratio compares how often they stand together with what their own counts let expect, over the
    four cells of their contingency table.
    """
    first = single.select(F.col("word").alias("a"), F.col("n").cast("double").alias("na"))
    second = single.select(F.col("word").alias("b"), F.col("n").cast("double").alias("nb"))
    cells = pairs.join(first, "a").join(second, "b").withColumns({"k": F.col("n").cast("double"), "t": F.lit(total)})
    k, na, nb, t = (F.col(name) for name in ("k", "na", "nb", "t"))

    def part(cell, row, column):
        return F.when(cell > 0, cell * F.log(cell * t / (row * column))).otherwise(0.0)

    score = 2 * (part(k, na, nb) + part(na - k, na, t - nb) + part(nb - k, t - na, nb) + part(t - na - nb + k, t - na, t - nb))
    return cells.select("a", "b", "n", score.alias("score"))


def pairs_that_reach(pairs: DataFrame, single: DataFrame, total: float, floor: float) -> DataFrame:
    """All pairs whose ratio may be ``floor`` or more, by bounds that need no join with all words.

    Words that attract each other have the highest ratio for their count where they occur in no other pair,
    as it falls with the count of either. Words that avoid each other have at most twice Pearson's statistic,
    which grows with both counts, so both must be frequent.
    """
    k = F.col("n").cast("double")
    rest = F.when(k < total, (total - k) * F.log(total / (total - k))).otherwise(0.0)
    likely = 2 * (k * F.log(total / k) + rest) * (1 + 1e-9) + 1e-6 >= floor
    most = single.agg(F.max("n")).first()[0] or 0
    n = F.col("n").cast("double")
    frequent = 2 * n * most * total * (1 + 1e-9) >= floor * (total - n) * (total - most)
    # Written, so that its size is known, and a small table needs no shuffle of all pairs.
    often = materialize(single.where(frequent).select("word"), "frequent-words")
    both = pairs.where(~likely)
    for side in ("a", "b"):
        both = both.join(often.select(F.col("word").alias(side)), side, "left_semi").select("a", "b", "n")
    return pairs.where(likely).select("a", "b", "n").unionByName(both)


def word_pairs(df: DataFrame, cleaned: str, n: int = 100, least: float = PAIR_SCORE) -> DataFrame:
    """The ``n`` neighbouring words with the highest log-likelihood ratio above ``least``.

    The ratios of the most frequent pairs show what the best ``n`` reach at least; only pairs that may
    reach it are joined with the counts of their words.
    """
    single, pairs, total = _counted(df, cleaned)
    first = _scored(pairs.orderBy(F.desc("n"), "a", "b").limit(FIRST_PAIRS), single, total)
    best = first.where(F.col("score") > least).orderBy(F.desc("score")).limit(n).select("score").collect()
    floor = min(r.score for r in best) if len(best) == n else least
    scored = _scored(pairs_that_reach(pairs, single, total, floor), single, total)
    return scored.where(F.col("score") > least).orderBy(F.desc("score"), "a", "b").limit(n)


def term_frequencies(df: DataFrame, cleaned: str, n: int = 100, least: float = PAIR_SCORE) -> DataFrame:
    """The ``n`` most frequent terms: pairs above ``least``, and words without what they occur in such pairs."""
    single, pairs, total = _counted(df, cleaned)
    scored = _scored(pairs_that_reach(pairs, single, total, least), single, total)
    chosen = materialize(scored.where(F.col("score") > least), "pairs")
    parts = F.explode(F.array("a", "b")).alias("word")
    used = chosen.select(parts, "n").groupBy("word").agg(F.sum("n").alias("used"))
    rest = single.join(used, "word", "left").select(F.col("word").alias("term"), (F.col("n") - F.coalesce("used", F.lit(0))).alias("n"))
    terms = chosen.select(F.concat_ws(" ", "a", "b").alias("term"), "n").unionByName(rest).where(F.col("n") > 0)
    return top_n(terms, "term", n)


def language_distribution(df: DataFrame, text: str) -> DataFrame:
    return df.groupBy(X.detect_language(text).alias("language")).agg(F.count("*").alias("n"))


def hourly_distribution(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))


def run_history_summary(df: DataFrame) -> DataFrame:
    """Final and best losses and accuracies per run; the lowest loss and the highest accuracy are the best."""
    measures = {
        "loss": ("validation_loss", F.min), "training_loss": ("training_loss", F.min),
        "accuracy": ("validation_accuracy", F.max), "training_accuracy": ("training_accuracy", F.max),
    }
    return df.groupBy("run_id").agg(
        F.max("epoch").alias("epochs"),
        *[F.max_by(column, "epoch").alias(f"final_{name}") for name, (column, _) in measures.items()],
        *[best(column).alias(f"best_{name}") for name, (column, best) in measures.items()],
        F.min_by("epoch", F.when(F.col("validation_loss").isNotNull(), F.struct("validation_loss", "epoch"))).alias("best_epoch"),
    )
