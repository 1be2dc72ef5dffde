"""Writers. Every one is a distributed write; nothing is gathered first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from supportlens.sinks.keyed_store import KeyedStore


def write_csv_dated(df: DataFrame, folder: str, day: str, prefix: str = "combined_data_") -> str:
    """CSV under a name that ends in the day (yyyyMMdd)."""
    path = f"{folder}/{prefix}{day}"
    df.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return path


def write_json_records(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)
    return path


def write_grouped_json(grouped: DataFrame, path: str, group: str, items: str) -> str:
    """One object {group: [items]} per line; a large group takes several lines."""
    grouped.select(F.to_json(F.create_map(group, items)).alias("value")).write.mode(
        "overwrite"
    ).text(path)
    return path


def _enclosed(first: str, last: str):
    """The rows of a partition between two brackets, with commas between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = first
        for batch in batches:
            lines = [("" if i else lead) + ("," if i or lead != first else "") + line for i, line in enumerate(batch.column(0).to_pylist())]
            if lines:
                lead = ""
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([lead + last])], names=["value"])

    return run


def write_json_arrays(df: DataFrame, path: str) -> str:
    """Files of one array each; a task writes one file."""
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.mapInArrow(_enclosed("[", "]"), "value string").write.mode("overwrite").text(path)
    return path


def write_json_objects(grouped: DataFrame, path: str, group: str, items: str) -> str:
    """Files of one object each, group -> items; a group of several rows is a key several times."""
    listed = F.to_json(F.array(F.col(group)))
    key = F.substr(listed, F.lit(2), F.length(listed) - 2)
    line = F.concat(key, F.lit(":"), F.to_json(items))
    grouped.select(line.alias("value")).mapInArrow(_enclosed("{", "}"), "value string").write.mode("overwrite").text(path)
    return path


def write_report(report: DataFrame, path: str) -> str:
    """Long report table, one folder per section."""
    report.write.mode("overwrite").partitionBy("section").json(path)
    return path


def append_records(df: DataFrame, path: str) -> str:
    df.write.mode("append").json(path)
    return path


def session_store(
    spark: SparkSession, folder: str, schema: T.StructType, session: str = "session_id", order: tuple[str, ...] = ("ts", "event_id")
) -> KeyedStore:
    """The store of the last feedback, or transfer request, of every session."""
    return KeyedStore(spark, folder, schema, [session], order)


def upsert_by_session(
    changes: DataFrame, folder: str, session: str = "session_id", order: tuple[str, ...] = ("ts", "event_id")
) -> DataFrame:
    """Commit ``changes`` to the store in ``folder``, a new one if there is none; returns its rows."""
    store = session_store(changes.sparkSession, folder, changes.schema, session, order)
    store.upsert(changes)
    return store.read()
