"""Stored models and label ids, for sessions and streams that did not train them."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from supportlens.operators.models import label_index
from supportlens.session import materialize
from supportlens.sinks.keyed_store import Folder, KeyedStore


class ModelStore:
    """Versions of a fitted pipeline under one folder.

    A version is written first and named by a manifest then, so one that was not finished does not
    exist. The manifest keeps its labels, in the order of their ids, and its metrics. The pipeline's
    first stage indexes the labels and is left out of scoring, as new messages have none.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)

    def versions(self) -> list[int]:
        return [int(name.split(".")[0]) for name in self.folder.names("manifest")]

    def save(self, model: PipelineModel, metrics: dict[str, float] | None = None) -> int:
        """Store a model as the next version; a second writer of the same version gets a ``Conflict``."""
        version = max(self.versions(), default=0) + 1
        model.write().overwrite().save(f"{self.folder.path}/models/{version:06d}")
        described = {"version": version, "labels": list(model.stages[0].labels), "metrics": metrics or {}}
        self.folder.create(f"manifest/{version:06d}.json", json.dumps(described))
        return version

    def described(self, version: int | None = None) -> dict:
        """Manifest of a version, the last one by default."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise LookupError(f"no model version {version or ''} under {self.folder.path}")
        return json.loads(self.folder.read(f"manifest/{version or max(known):06d}.json"))

    def load(self, version: int | None = None) -> Scorer:
        described = self.described(version)
        model = PipelineModel.load(f"{self.folder.path}/models/{described['version']:06d}")
        return Scorer(model, described["labels"], described["version"])


class Scorer:
    """A stored model that labels rows, of a table or of a stream."""

    def __init__(self, model: PipelineModel, labels: list[str], version: int):
        self.stages, self.labels, self.version = PipelineModel(model.stages[1:]), labels, version

    def score(self, rows: DataFrame, label: str = "predicted") -> DataFrame:
        """Add the most probable label, its probability as ``confidence`` and ``model_version``.

        Rows keep their other columns; those that the model works with are dropped again.
        """
        names = F.array(*[F.lit(name) for name in self.labels])
        probabilities = vector_to_array("probability")
        return self.stages.transform(rows).select(
            *rows.columns,
            F.element_at(names, (F.col("prediction") + 1).cast("int")).alias(label),
            F.array_max(probabilities).alias("confidence"),
            F.lit(self.version).alias("model_version"),
        )


class LabelDictionary:
    """Ids of labels that never change: labels that appear later get the next ids.

    The labels of a batch are numbered in alphabetical order behind those known before, so the first
    batch is numbered like ``label_index``, and a batch that runs again adds nothing.
    """

    SCHEMA = T.StructType(
        [T.StructField("label", T.StringType()), T.StructField("class_id", T.LongType()), T.StructField("since", T.LongType())]
    )

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.store = KeyedStore(spark, folder, self.SCHEMA, ["label"], buckets=buckets)

    def read(self) -> DataFrame:
        """label, class_id and the version ``since`` which it is known."""
        return self.store.read()

    def add(self, df: DataFrame, column: str) -> int:
        """Number the labels of ``column`` that are new; returns the version. Nulls are no label."""
        known = self.read()
        new = materialize(
            df.select(F.col(column).alias("label")).where("label IS NOT NULL").distinct().join(known, "label", "left_anti"), "new-labels"
        )
        version = self.store.manifest()["version"]
        if new.isEmpty():
            return version
        last = known.agg(F.coalesce(F.max("class_id"), F.lit(-1))).first()[0]
        numbered = label_index(new, "label").select(
            "label", (F.col("class_id") + last + 1).alias("class_id"), F.lit(version + 1).cast("long").alias("since")
        )
        return self.store.upsert(numbered)

    def encode(self, df: DataFrame, column: str) -> DataFrame:
        """Add ``<column>_id``, null for unknown labels."""
        ids = self.read().select(F.col("label").alias(column), F.col("class_id").alias(f"{column}_id"))
        return df.join(ids, column, "left")
