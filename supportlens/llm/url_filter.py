"""URL filters as a sort-merge range join.

A host is written with its labels reversed, so a rule for a host and its subdomains covers
an interval of keys. Keys are cut into ranges of about equal size; a rule goes to every range
that its interval meets, which beyond one copy each is only the nest around a cut. A sorted
sweep over a range keeps the stack of active nested rules.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from supportlens.llm.common import lower_ascii

#: Sampled keys per range; they decide the balance of the ranges, never a result.
SAMPLE_PER_RANGE = 100
LABEL_END, HOST_END = "\x01", "\x00"
JUDGED = pa.schema(
    [("page_id", pa.int64()), *((name, pa.string()) for name in ("host", "path", "rule", "verdict"))]
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, A-Z lower-cased, and path up to ? or #; both empty without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda group: F.coalesce(F.regexp_extract(url, pattern, group), F.lit(""))
    return lower_ascii(part(1)), part(2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), LABEL_END), F.lit(LABEL_END))


def _range_of(bounds: list[str], key: Column) -> Column:
    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(bounds, k)).astype("int32")

    return place(key)


def _fits(rule_host: str, host: str) -> bool:
    return host == rule_host or host.endswith("." + rule_host)


class Sweep:
    """The rules active at the current key: a stack of nested hosts, each with its paths."""

    def __init__(self):
        self.at, self.stack = None, []

    def move(self, part: int, key: str) -> None:
        if part != self.at:
            self.at, self.stack = part, []
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}))
        by_length = self.stack[-1][1].setdefault((host, len(path)), {})
        by_length[path] = min(verdict, by_length.get(path, verdict))

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = (-1, -1, None, None)
        for _, frames in self.stack:
            for (rule_host, n), paths in frames.items():
                rank = (len(rule_host) + n, len(rule_host))
                if rank > best[:2] and path[:n] in paths and _fits(rule_host, host):
                    best = (*rank, rule_host + path[:n], paths[path[:n]])
        return best[2:]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = Sweep()
    for batch in batches:
        out = []
        for part, key, page_id, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sweep.move(part, key)
            if verdict is not None:
                sweep.add(key, host, path, verdict)
            else:
                out.append((page_id, host, path, *sweep.longest(host, path)))
        columns = zip(*out, strict=True) if out else [[]] * len(JUDGED)
        arrays = [pa.array(list(c), type=field.type) for c, field in zip(columns, JUDGED, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=JUDGED)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Verdict on each row of ``pages`` (page_id, url) under ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with the rule's; the
    longest rule (host and path) wins, of equal length the one with the longer host, and of
    a rule given twice the verdict that sorts first. A null url, or one without ://, has an
    empty host and path. Rules with a null host, path or verdict are ignored; without a
    fitting rule the verdict is ``default``. Repeated rows are judged one by one; further
    columns are ignored; without pages the result is empty.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    # The id spreads equal urls over the ranges between two cuts.
    tail = F.concat(F.lit(HOST_END), F.col("path"), F.lit(HOST_END), F.coalesce(F.xxhash64("page_id"), F.lit(0)).cast("string"))
    urls = urls.withColumn("key", F.concat(host_key(F.col("host")), tail))
    n_rows = urls.count()
    share = min(1.0, SAMPLE_PER_RANGE * ranges / max(1, n_rows))
    sample = sorted(row["key"] for row in urls.select("key").sample(share, seed=1).collect())
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    named = rules.dropna(subset=["host", "path", "verdict"]).withColumn("key", host_key(F.col("host")))
    last = F.concat("key", F.lit("\U0010ffff"))
    placed_rules = named.withColumn(
        "part", F.explode(F.sequence(_range_of(bounds, F.col("key")), _range_of(bounds, last)))
    ).select("part", "key", F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    placed_urls = urls.select(
        _range_of(bounds, F.col("key")).alias("part"), "key", "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")
    )
    sorted_rows = (
        placed_urls.unionByName(placed_rules).repartition(ranges, "part").sortWithinPartitions("part", "key")
    )
    swept = sorted_rows.mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
