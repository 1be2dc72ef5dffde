"""A table with one row per key, kept up to date by small commits.

Keys are dealt to a fixed number of buckets by hash. A commit reduces its changes to one row
per key and writes them, by bucket, as a new generation; a manifest names the generations of
every bucket, so what no manifest names does not exist. In a bucket every generation is at
least twice as large as all later ones together: where a new one breaks that rule, the last
ones are merged. So buckets without changes are never written again, a row is rewritten a
logarithmic number of times, and a read costs about the live rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from supportlens.operators.ordered import keep_last

#: Buckets of a store; choose more for large ones, so that a bucket holds some 100 MB.
BUCKETS = 16
VERSION, BUCKET = "_version", "_bucket"


class Conflict(RuntimeError):
    """Another writer committed in between; apply the changes again."""


class Folder:
    """Small files of a folder in any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark._jvm
        self.files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        place = self._at(name)
        return sorted(s.getPath().getName() for s in self.files.listStatus(place)) if self.files.exists(place) else []

    def size(self, name: str) -> int:
        return self.files.getContentSummary(self._at(name)).getLength()

    def read(self, name: str) -> str:
        source = self.files.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def create(self, name: str, text: str) -> None:
        """Fails where the file exists already."""
        try:
            target = self.files.create(self._at(name), False)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise Conflict(name) from None
            raise
        target.write(text.encode())
        target.close()

    def delete(self, name: str) -> None:
        self.files.delete(self._at(name), True)


class KeyedStore:
    """The newest row per key of everything that was put in.

    ``order`` names the columns whose largest values are the newest; equal ones go by commit, and without
    ``order`` the last commit wins. Null keys are equal. Two writers may not commit at a time: the second
    gets a ``Conflict`` and its files are left for ``clean``. The number of buckets is fixed by the first commit.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], order: tuple[str, ...] = (), buckets: int = BUCKETS
    ):
        self.spark, self.schema, self.keys, self.order = spark, schema, keys, order
        self.folder = Folder(spark, folder)
        self.buckets = buckets
        self.buckets = self.manifest()["buckets"]

    # --- manifests ------------------------------------------------------------------

    def manifest(self) -> dict:
        """The last whole manifest; one that is being written is not there yet."""
        for name in reversed(self.folder.names("manifest")):
            try:
                return json.loads(self.folder.read(f"manifest/{name}"))
            except ValueError:
                continue
        return {"version": 0, "buckets": self.buckets, "applied": {}, "generations": {}}

    def _stored(self) -> T.StructType:
        return T.StructType(self.schema.fields + [T.StructField(VERSION, T.LongType())])

    def _paths(self, generations: dict[str, list[list]]) -> list[str]:
        return [f"{self.folder.path}/data/{name}/{BUCKET}={b}" for b, held in generations.items() for name, _ in held]

    def _rows(self, generations: dict[str, list[list]]) -> DataFrame:
        paths = self._paths(generations)
        stored = self._stored()
        return self.spark.read.schema(stored).parquet(*paths) if paths else self.spark.createDataFrame([], stored)

    def _newest(self, rows: DataFrame) -> DataFrame:
        return keep_last(rows, self.keys, [*self.order, VERSION])

    # --- reading and writing -----------------------------------------------------------

    def read(self) -> DataFrame:
        """One row per key. Buckets of a single generation are read as they are."""
        held = self.manifest()["generations"]
        settled = {b: names for b, names in held.items() if len(names) == 1}
        layered = {b: names for b, names in held.items() if len(names) > 1}
        rows = self._rows(settled)
        if layered:
            rows = rows.unionByName(self._newest(self._rows(layered)))
        return rows.drop(VERSION)

    def _write(self, rows: DataFrame, version: int, kind: str) -> dict[str, list]:
        """Write a generation; returns its name and size for every bucket it has rows of."""
        name = f"{version:010d}-{kind}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))
        dealt = rows.withColumn(BUCKET, bucket).repartition(BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.folder.path}/data/{name}")
        written = [entry for entry in self.folder.names(f"data/{name}") if entry.startswith(f"{BUCKET}=")]
        return {entry.split("=")[1]: [name, self.folder.size(f"data/{name}/{entry}")] for entry in written}

    def upsert(self, changes: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """Commit ``changes`` and return the version; rows of a key compete with each other, too.

        A ``batch`` number that ``writer`` has committed before changes nothing, so a
        micro-batch that runs again counts once.
        """
        before = self.manifest()
        applied = dict(before["applied"])
        if writer is not None:
            if batch <= applied.get(writer, -1):
                return before["version"]
            applied[writer] = batch
        version = before["version"] + 1
        rows = changes.select(*self.schema.names).withColumn(VERSION, F.lit(version).cast("long"))
        generations = {b: list(names) for b, names in before["generations"].items()}
        for bucket, added in self._write(self._newest(rows), version, "changes").items():
            generations.setdefault(bucket, []).append(added)
        self._merge(generations, version)
        manifest = {"version": version, "buckets": self.buckets, "applied": applied, "generations": generations}
        self.folder.create(f"manifest/{version:010d}.json", json.dumps(manifest))
        return version

    def _merge(self, generations: dict[str, list[list]], version: int) -> None:
        """Merge the last generations of the buckets where one is too small for those after it."""
        merged = {}
        for bucket, held in generations.items():
            keep, tail = len(held) - 1, held[-1][1]
            while keep and held[keep - 1][1] < 2 * tail:
                keep -= 1
                tail += held[keep][1]
            if keep < len(held) - 1:
                merged[bucket] = held[keep:]
                del held[keep:]
        if merged:
            for bucket, added in self._write(self._newest(self._rows(merged)), version, "merged").items():
                generations[bucket].append(added)

    def clean(self, keep: int = 10) -> list[str]:
        """Delete what the last ``keep`` manifests do not name; returns the deleted generations.

        Readers of older manifests, and a commit that is under way, must have ended.
        """
        manifests = self.folder.names("manifest")
        for name in manifests[:-keep]:
            self.folder.delete(f"manifest/{name}")
        named = set()
        for name in manifests[-keep:]:
            held = json.loads(self.folder.read(f"manifest/{name}"))["generations"]
            named |= {generation for names in held.values() for generation, _ in names}
        lost = [name for name in self.folder.names("data") if name not in named]
        for name in lost:
            self.folder.delete(f"data/{name}")
        return lost
