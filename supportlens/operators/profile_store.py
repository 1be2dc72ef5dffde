"""A numeric profile kept current: sketches per input file, merged for all files.

An update reads only files that are new, or newer than their sketches. Counts, means, deviations and
ranges are merged exactly; quantile sketches give the brackets from which exact quantiles are counted,
and distinct values are estimated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from supportlens.operators.quantiles import exact_quantiles, number
from supportlens.session import materialize
from supportlens.sinks.keyed_store import KeyedStore

#: Size of the quantile sketches, and the share of rows by which a bracket exceeds their error.
SKETCH_SIZE, MARGIN = 800, 0.01
SKETCHES = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("file", "column")]
    + [T.StructField(name, T.LongType()) for name in ("modified", "n_rows", "n")]
    + [T.StructField(name, T.DoubleType()) for name in ("mean", "spread", "low", "high")]
    + [T.StructField(name, T.BinaryType()) for name in ("quantiles", "values")]
)


class ProfileStore:
    """Sketches of the numeric ``columns`` of parquet files, in a keyed store under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, columns: list[str]):
        self.spark, self.schema, self.columns = spark, schema, columns
        self.store = KeyedStore(spark, folder, SKETCHES, ["file", "column"], ("modified",))

    def update(self, path: str) -> list[str]:
        """Sketch the files under ``path`` that are not known as they are; returns their names.

        The file names come to the driver, as a reader needs them. Files that were deleted stay in the profile.
        """
        listed = (
            self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        ).select(F.col("path").alias("file"), F.unix_micros("modificationTime").alias("modified"))
        known = self.store.read().groupBy("file").agg(F.max("modified").alias("known"))
        new = listed.join(known, "file", "left").where("known IS NULL OR known < modified").select("file", "modified")
        names = sorted(row["file"] for row in new.collect())
        if names:
            rows = self.spark.read.schema(self.schema).parquet(*names)
            self.store.upsert(self._sketched(rows))
        return names

    def _sketched(self, rows: DataFrame) -> DataFrame:
        values = {c: number(rows, c) for c in self.columns}
        named = rows.select(
            F.col("_metadata.file_path").alias("_file"),
            F.unix_micros("_metadata.file_modification_time").alias("_modified"),
            *[value.alias(c) for c, value in values.items()],
        )
        sketch = lambda c: F.struct(
            F.lit(c).alias("column"),
            F.count("*").alias("n_rows"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            (F.var_pop(c) * F.count(c)).alias("spread"),
            F.min(c).alias("low"),
            F.max(c).alias("high"),
            F.kll_sketch_agg_double(c, SKETCH_SIZE).alias("quantiles"),
            F.hll_sketch_agg(F.col(c).cast("string")).alias("values"),
        )
        sketches = named.groupBy("_file", "_modified").agg(*[sketch(c).alias(f"_{i}") for i, c in enumerate(self.columns)])
        listed = F.array(*[F.col(f"_{i}") for i in range(len(self.columns))])
        return sketches.select(F.col("_file").alias("file"), F.col("_modified").alias("modified"), F.inline(listed)).select(*SKETCHES.names)

    def merged(self) -> DataFrame:
        """One row per column: counts, mean, sample deviation, range, the quantile sketch and about how many values."""
        held = self.store.read()
        middle = held.groupBy("column").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_mean"))
        apart = F.col("spread") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
        return (
            held.join(middle, "column")
            .groupBy("column")
            .agg(
                F.sum("n_rows").alias("n_rows"),
                F.sum("n").alias("n"),
                F.first("_mean", ignorenulls=True).alias("mean"),
                F.sqrt(F.try_divide(F.sum(apart), F.sum("n") - 1)).alias("std"),
                F.min("low").alias("low"),
                F.max("high").alias("high"),
                F.kll_merge_agg_double("quantiles").alias("quantiles"),
                F.hll_sketch_estimate(F.hll_union_agg("values")).alias("about_distinct"),
            )
        )

    def describe(self, rows: DataFrame) -> DataFrame:
        """The rows of ``describe_numeric``, with the quartiles of ``rows``, which are those of the sketched files.

        Only the quartiles read ``rows``: one pass counts the brackets that the sketches give, one ranks what is inside.
        """
        merged = materialize(self.merged(), "merged-profile")
        wanted = [0.25, 0.5, 0.75]
        sides = [min(max(p + side, 0.0), 1.0) for p in wanted for side in (-MARGIN, MARGIN)]
        drawn = F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(side)) for side in sides])
        start = {
            row["column"]: (row["n"], row["low"], row["high"], row["sides"])
            for row in merged.select("column", "n", "low", "high", F.when(F.col("n") > 0, drawn).alias("sides")).collect()
        }
        brackets = {(c, p): tuple(s[3][2 * i : 2 * i + 2]) for c, s in start.items() if s[0] for i, p in enumerate(wanted)}
        found = exact_quantiles(rows, self.columns, wanted, known={c: s[:3] for c, s in start.items()}, brackets=brackets)
        table = [(c, found[c][0.25], found[c][0.5], found[c][0.75]) for c in self.columns]
        quartiles = self.spark.createDataFrame(table, "`column` STRING, q25 DOUBLE, q50 DOUBLE, q75 DOUBLE")
        return merged.join(quartiles, "column").select(
            "column",
            F.col("n").alias("count"),
            F.round("mean", 6).alias("mean"),
            F.round("std", 6).alias("std"),
            F.col("low").alias("min"),
            *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")],
            F.col("high").alias("max"),
        )
