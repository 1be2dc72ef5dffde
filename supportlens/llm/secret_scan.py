"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger records which (blob, rule
pack) pairs were scanned and what they hold; a run scans only the pairs it lacks, each blob
once however many paths hold it, and joins the findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from supportlens.llm.common import text_of
from supportlens.session import materialize, work_folder

Span = tuple[str, int, int]

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_NAMES = ("passw", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----")
#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "pem")
BASE_KINDS = KINDS[:3]


def _base(text: str) -> Iterator[Span]:
    lowered = text.lower()
    if any(name in lowered for name in ASSIGN_NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _pem(text: str) -> Iterator[Span]:
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            yield "pem", m.start(), m.end()


#: Rule packs by name and version; a changed rule gets a new version and is scanned anew.
PACKS: dict[str, Callable[[str], Iterator[Span]]] = {"base:1": _base, "pem:1": _pem}
LEDGER_SCHEMA = "blob binary, pack string, findings array<struct<kind:string,start:bigint,end:bigint>>"


def _scanner(packs):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (blob, name, [{"kind": k, "start": a, "end": b} for k, a, b in packs[name](text)])
                for blob, names, text in batch.itertuples(index=False, name=None)
                for name in names
            ]
            yield pd.DataFrame(out, columns=["blob", "pack", "findings"])

    return scan


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A pair that was written twice, by runs side by side, counts once."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(folder).dropDuplicates(["blob", "pack"])


def scan_versions(versions: DataFrame, ledger: str | None = None, packs=PACKS) -> DataFrame:
    """Findings of each row of ``versions`` (doc_id, text); null text counts as empty.

    Returns doc_id, blob and findings, an array of (kind, start, end) in code points, end
    exclusive. ``ledger`` is a folder that keeps what was scanned between runs (a new one
    by default). Rows that repeat a text share its scan; rows that repeat a doc_id are
    versions of their own; a null doc_id is a path like any other. Further columns are
    ignored; an empty table gives an empty result.
    """
    spark = versions.sparkSession
    folder = ledger or work_folder(spark, "ledger")
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(folder)
    text = text_of()
    blob = F.unhex(F.sha2(text, 256))
    paths = versions.select("doc_id", blob.alias("blob"))
    known = _ledger(spark, folder).where(F.col("pack").isin(*packs)).select("blob", "pack")
    wanted = paths.groupBy("blob").agg(F.min("doc_id").alias("holder"))
    pending = (
        wanted.withColumn("pack", F.explode(F.array(*[F.lit(name) for name in packs])))
        .join(known, ["blob", "pack"], "left_anti")
        .groupBy(F.col("blob").alias("_blob"), "holder")
        .agg(F.sort_array(F.collect_set("pack")).alias("packs"))
    )
    held = versions.select("doc_id", blob.alias("blob"), text.alias("text"))
    same = (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("holder"))
    unseen = held.join(pending, same).select("blob", "packs", "text")
    unseen.mapInPandas(_scanner(packs), LEDGER_SCHEMA).write.mode("append").parquet(folder)
    # Written, so that the join gets two shuffles and Spark can split a blob with many paths.
    found = materialize(
        _ledger(spark, folder)
        .where(F.col("pack").isin(*packs) & (F.size("findings") > 0))
        .groupBy("blob")
        .agg(F.flatten(F.collect_list("findings")).alias("findings")),
        "findings",
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("findings", none).alias("findings"))


def count_of(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: f.kind == kind)).cast("long")


def listed(findings: Column, kinds=KINDS) -> Column:
    """``kind:start:end`` of the given kinds by start, then kind, comma-joined."""
    place = lambda f: F.array_position(F.array(*[F.lit(k) for k in KINDS]), f.kind)
    chosen = F.filter(findings, lambda f: f["kind"].isin(*kinds))
    ordered = F.array_sort(F.transform(chosen, lambda f: F.struct(f.start, place(f).alias("p"), f.end, f.kind)))
    return F.array_join(F.transform(ordered, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")
