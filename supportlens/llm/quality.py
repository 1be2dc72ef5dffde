"""Quality rules as weak supervision.

Rules over a document's counts vote good or bad, or abstain. Expectation-maximisation over
the counts of vote patterns (at most 3 to the number of rules, whatever the corpus) estimates
how often each rule votes how on good and on bad documents; a document stays when its
posterior probability of being good is at least one half.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from supportlens.llm.common import BLANKS, WORD, packed, text_of
from supportlens.session import materialize

#: A word of letters, with inner hyphens or apostrophes and one sign at its end at most.
PLAIN_WORD = rf"(?<![^{BLANKS}])\p{{L}}[\p{{L}}\p{{M}}'’-]*[.,;:!?]?(?![^{BLANKS}])"
WINDOW = 5
#: Words in which their variety is measured.
VARIETY_RUN = 500
ROUNDS = 100


def _n_repeat_words(words: Column) -> Column:
    """Words inside a window of five that occurs twice or more, the first included.

    Windows are hashed and sorted with their places; neighbours of equal hash give the
    repeated places, and each adds the words up to the next one.
    """
    last = F.size(words) - WINDOW
    hashed = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, WINDOW)).alias("h"), i.alias("i")),
    )
    return F.when(last >= 1, hashed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _repeated_places(sorted_windows: Column) -> Column:
    n = F.size(sorted_windows)
    pairs = F.zip_with(
        F.slice(sorted_windows, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(sorted_windows, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")),
    )
    return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: F.size(p) > 0))))


def _covered(places: Column) -> Column:
    n = F.size(places)
    gaps = F.zip_with(
        F.slice(places, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(places, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    return F.when(n > 0, F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, g: s + g)).otherwise(F.lit(0).cast("long"))


def with_counts(docs: DataFrame) -> DataFrame:
    """Add the struct ``_q`` of counts over the whole text; null text has no words.

    The counts pass through a generator of one row, below which Spark pushes no filter: a
    filter on them would otherwise take them again for every word.
    """
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(rf"[^{BLANKS}]"))
    return (
        docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
        .withColumn("_windows", F.sort_array(_n_repeat_words(F.col("_words"))))
        .withColumn("_places", _repeated_places(F.col("_windows")))
        .withColumn(
            "_counts",
            F.struct(
                F.size("_words").cast("long").alias("n_words"),
                F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _covered(F.col("_places")).alias("n_repeat_words"),
                _distinct_in_runs("_words").alias("n_distinct"),
                F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                F.regexp_count(text, F.lit(PLAIN_WORD)).cast("long").alias("n_plain"),
            ),
        )
        .withColumn("_q", F.explode(F.array("_counts")))
        .drop("_words", "_windows", "_places", "_counts")
    )


def _distinct_in_runs(words: str) -> Column:
    """Different words of every run of ``VARIETY_RUN`` words, added up; long texts repeat words without being poor."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(VARIETY_RUN))
    in_run = lambda start: F.size(F.array_distinct(F.slice(words, start + 1, F.lit(VARIETY_RUN))))
    return F.aggregate(F.transform(starts, in_run), F.lit(0).cast("long"), lambda total, n: total + n)


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, F.lit(-1))
    return (vote if good is None else vote.when(good, F.lit(1))).otherwise(F.lit(0))


def votes(q: str = "_q") -> dict[str, Column]:
    """Per rule 1 for good, -1 for bad, 0 to abstain; short texts are left to the first rule.

    A rule that looks for one defect abstains where it finds none, as that says little about
    the others; every defect is looked for by two rules.
    """
    c = lambda name: F.col(f"{q}.{name}")
    n, letters, plain = c("n_words"), c("word_chars"), c("n_plain")
    enough = n >= 10
    return {
        "length": _vote(n < 10),
        "repeats": _vote(enough & (100 * c("n_repeat_words") > 20 * n)),
        "variety": _vote(enough & (8 * c("n_distinct") < n), enough & (2 * c("n_distinct") > n)),
        "lines": _vote(enough & (2 * c("n_dup_lines") > c("n_lines"))),
        "symbols": _vote(enough & (4 * c("n_symbols") > n)),
        "plain_words": _vote(enough & (10 * plain < 6 * n), enough & (10 * plain >= 9 * n)),
        "capitals": _vote(enough & (2 * c("n_upper") > letters)),
        "word_length": _vote(enough & ((letters < 2 * n) | (letters > 14 * n)), enough & letters.between(3 * n, 9 * n)),
    }


def base_failed(q: str = "_q") -> Column:
    n, repeated = F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words")
    return (n < 10) | (100 * repeated > 20 * n)


class VoteModel:
    """How often rules vote -1 and 1 on bad and on good documents, and the share of good ones."""

    def __init__(self, share: float, chances: list[dict[int, tuple[float, float]]]):
        self.share, self.chances = share, chances

    def score(self, rule: int, vote: int) -> float:
        bad, good = self.chances[rule][vote]
        return math.log(good / bad)

    def log_odds(self, pattern: tuple[int, ...]) -> float:
        # An abstaining rule says nothing.
        heard = sum(self.score(r, v) for r, v in enumerate(pattern) if v)
        return math.log(self.share / (1 - self.share)) + heard

    def posterior(self, rules: dict[str, Column]) -> Column:
        odds = F.lit(math.log(self.share / (1 - self.share)))
        for r, vote in enumerate(rules.values()):
            odds = odds + F.when(vote == 1, self.score(r, 1)).when(vote == -1, self.score(r, -1)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], width: int, rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over (pattern, count). Starts from: any bad vote means bad.

    Votes are smoothed by one document. A rule may lean no way but its own: a good vote
    never counts against a document, nor a bad vote for it. No rows leave all even.
    """
    good = {p: 0.02 if min(p, default=0) < 0 else 0.98 for p, _ in patterns}
    model = VoteModel(0.5, [{v: (0.5, 0.5) for v in (-1, 1)} for _ in range(width)])
    for _ in range(rounds):
        n_good = sum(n * good[p] for p, n in patterns)
        n_bad = sum(n * (1 - good[p]) for p, n in patterns)
        share = (n_good + 1) / (n_good + n_bad + 2)
        chances = []
        for r in range(width):
            g = {v: (sum(n * good[p] for p, n in patterns if p[r] == v) + 1) / (n_good + 3) for v in (-1, 1)}
            b = {v: (sum(n * (1 - good[p]) for p, n in patterns if p[r] == v) + 1) / (n_bad + 3) for v in (-1, 1)}
            lean = {-1: (max(b[-1], g[-1]), g[-1]), 1: (min(b[1], g[1]), g[1])}
            chances.append(lean)
        model = VoteModel(share, chances)
        new = {p: 1 / (1 + math.exp(-max(-500.0, min(500.0, model.log_odds(p))))) for p, _ in patterns}
        moved = max((abs(new[p] - good[p]) for p in new), default=0.0)
        good = new
        if moved < 1e-9:
            break
    return model


def fit_votes(voted: DataFrame, names: list[str]) -> VoteModel:
    """The model of a table with one vote column per rule; only pattern counts reach the driver."""
    counts = voted.groupBy(*names).count().orderBy(*names).collect()
    return fit([(tuple(row[name] for name in names), row["count"]) for row in counts], len(names))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, votes and verdict of each row of ``docs`` (doc_id, text).

    Null and empty texts have no words and fail the base rules. Repeated rows are judged
    alike, as votes depend on the text alone. Further columns of ``docs`` are ignored; an
    empty table gives an empty result.
    """
    counted = materialize(with_counts(docs.select("doc_id", "text")).select("doc_id", "_q"), "quality-counts")
    rules = votes()
    model = fit_votes(counted.select(*[v.alias(k) for k, v in rules.items()]), list(rules))
    return counted.select(
        "doc_id", "_q.*", *[v.alias(f"vote_{k}") for k, v in rules.items()],
        base_failed().alias("base_failed"), model.posterior(rules).alias("posterior"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, all columns as they were.

    Rows and counts are written once, so counting is not repeated for the verdict and no row
    has to be found again by its id.
    """
    rules = votes()
    counted = materialize(with_counts(packed(docs, "text")).select("row", "_q"), "counted-rows")
    model = fit_votes(counted.select(*[v.alias(k) for k, v in rules.items()]), list(rules))
    return counted.where(~base_failed() & (model.posterior(rules) >= 0.5)).select("row.*")
