"""Web archives: one gzip member per record, written by tasks and read back sequentially.

Spark decides which payloads are stored and which are revisits of an equal one; every task
writes files of its own, and the list of files is a table, which names those of tasks that
ended well. The reader inflates a file piece by piece, takes each record by its content
length, and checks its digests and that the member ends with it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from supportlens.session import materialize, work_folder

#: Payloads of at least this many bytes are stored once.
LEAST_SHARED = 1000
#: A task begins another file after this many compressed bytes.
FILE_BYTES = 64 << 20
#: Bytes read, inflated or deflated at a time, and bytes that the fields of a record may take.
PIECE, HEAD_BYTES = 1 << 18, 1 << 16
DATE = "1970-01-01T00:00:00Z"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
FILES_DDL = "path string, records long, bytes long"
RECORDS_DDL = (
    "path string, offset long, length long, record_type string, record_id string, refers_to string, url string, "
    "fields map<string,string>, payload binary, payload_bytes long, payload_digest string, fault string"
)
RECORDS = pa.schema(
    [
        ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()),
        ("record_id", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fault", pa.string()),
    ]
)


# --- writing --------------------------------------------------------------------------


def decided(pages: DataFrame) -> DataFrame:
    """Each row's payload with its digest, and the page that holds an equal payload, if it is another one."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    shared = F.col("payload_bytes") >= LEAST_SHARED
    # Small payloads have keys of their own, so that no task gets them all.
    rows = rows.withColumn(
        "key", F.when(shared, F.sha2("payload", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url")))
    )
    held = (
        rows.where(shared)
        .groupBy("key")
        .agg(F.max(F.struct("page_id", "url")).alias("holder"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("key", "holder")
    )
    other = F.col("holder.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder.page_id"))
    return rows.join(held, "key", "left").select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(other, F.col("holder.page_id")).alias("holder_id"),
        F.when(other, F.col("holder.url")).alias("holder_url"),
    )


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record_id: Column) -> Column:
    """The page_id in a record's name; null where it holds none."""
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def _labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _uri(url: str) -> str:
    """Control characters and blanks would end or bend a field."""
    return re.sub(r"[\x00-\x20\x7f]", lambda found: f"%{ord(found[0]):02X}", url)


def _fields(kind: str, name: str, content_type: str, block: list[bytes], more: list[tuple[str, str | None]], date: str) -> bytes:
    digest = hashlib.sha1()
    for part in block:
        digest.update(part)
    named = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", name),
        ("WARC-Date", date),
        *more,
        ("Content-Type", content_type),
        ("WARC-Block-Digest", _labelled(digest.digest())),
        ("Content-Length", str(sum(map(len, block)))),
    ]
    return f"{VERSION}\r\n{''.join(f'{k}: {v}' + chr(13) + chr(10) for k, v in named if v is not None)}\r\n".encode()


def page_record(row: dict, date: str = DATE) -> list[bytes]:
    """The parts of the record of one row of ``decided``."""
    payload = row["payload"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["holder_id"] is not None
    block = [head] if revisit else [head, payload]
    uri = lambda url: None if url is None else _uri(url)
    more = [
        ("WARC-Target-URI", uri(row["url"])),
        ("WARC-Payload-Digest", _labelled(bytes.fromhex(row["payload_digest"]))),
    ]
    if revisit:
        more += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_name(row["holder_id"])),
            ("WARC-Refers-To-Target-URI", uri(row["holder_url"])),
            ("WARC-Refers-To-Date", date),
        ]
    kind = "revisit" if revisit else "response"
    return [_fields(kind, record_name(row["page_id"]), "application/http;msgtype=response", block, more, date), *block, END]


def info_record(name: str, date: str = DATE) -> list[bytes]:
    block = [f"format: {VERSION}\r\nfile: {name}\r\n".encode()]
    return [_fields("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", "application/warc-fields", block, [], date), *block, END]


class _File:
    """An archive that is being written."""

    def __init__(self, folder: str, date: str):
        self.path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        system, place = pafs.FileSystem.from_uri(self.path)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(place, compression=None)
        self.records = self.bytes = 0
        self.add(info_record(self.path.rsplit("/", 1)[1], date))

    def add(self, parts: list[bytes]) -> None:
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        for part in parts:
            for at in range(0, len(part), PIECE):
                self._write(member.compress(part[at : at + PIECE]))
        self._write(member.flush())
        self.records += 1

    def _write(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        return pa.RecordBatch.from_pylist([{"path": self.path, "records": self.records, "bytes": self.bytes}])


def write_archives(pages: DataFrame, folder: str | None = None, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the files as path, records and bytes.

    The payload is the html in UTF-8, nothing for null. Of rows with equal payloads of at least
    1000 bytes, those with the largest page_id are responses and the others revisits of it; all
    other rows are responses. So rows that repeat the largest page_id are stored once each, and
    where no row of a group has a page_id all are responses. Each file begins with a warcinfo
    record, which ``records`` counts. A record is named after its page_id, without one after nothing;
    control characters and blanks in urls are percent-encoded, a null url has no field; further
    columns are ignored; an empty table gives files without pages.

    ``folder`` is a path or URI that all executors can write to, a new one in the shared folder by default.
    A task that runs again writes new files, and only those of the run that ended well are returned.
    """
    folder = folder or work_folder(pages.sparkSession, "archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            for i in range(batch.num_rows):
                if file is not None and file.bytes >= file_bytes:
                    yield file.close()
                    file = None
                file = file or _File(folder, date)
                file.add(page_record(batch.slice(i, 1).to_pylist()[0], date))
        if file is not None:
            yield file.close()

    return materialize(decided(pages).mapInArrow(run, FILES_DDL), "archive-files")


# --- reading --------------------------------------------------------------------------


class Damaged(ValueError):
    """What a record lacks."""


class _Source:
    """A file read in pieces, where the next piece begins at ``at``."""

    def __init__(self, file):
        self.file, self.at, self.size = file, 0, file.size()

    def take(self) -> bytes:
        self.file.seek(self.at)
        piece = self.file.read(PIECE)
        self.at += len(piece)
        return piece

    def next_member(self, start: int) -> bool:
        """Go to the first place from ``start`` on that looks like a member."""
        self.at = start
        while self.at < self.size:
            begin = self.at
            found = self.take().find(MAGIC)
            if found >= 0:
                self.at = begin + found
                return True
            if self.at < self.size:
                self.at -= len(MAGIC) - 1
        return False


class _Member:
    """One gzip member, inflated as far as it is asked for."""

    def __init__(self, source: _Source):
        self.source, self.inflater, self.held = source, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        if self.inflater.eof:
            return False
        piece = self.inflater.unconsumed_tail or self.source.take()
        try:
            inflated = self.inflater.decompress(piece, PIECE)
        except zlib.error:
            raise Damaged("compression") from None
        if not (piece or inflated or self.inflater.eof):
            raise Damaged("cut off")
        self.held += inflated
        if self.inflater.eof:
            self.source.at -= len(self.inflater.unused_data)
        return True

    def head(self) -> bytes:
        """What comes before the first empty line."""
        seen = 0
        while (end := self.held.find(END, max(0, seen - 3))) < 0:
            seen = len(self.held)
            if seen > HEAD_BYTES or not self.more():
                raise Damaged("fields")
        out = bytes(self.held[:end])
        del self.held[: end + len(END)]
        return out

    def body(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.held and not self.more():
                raise Damaged("length")
            piece = bytes(self.held[:length])
            del self.held[: len(piece)]
            length -= len(piece)
            if piece:
                yield piece

    def finish(self) -> None:
        """The record's end has to be the member's."""
        while self.more():
            if len(self.held) > len(END):
                raise Damaged("length")
        if self.held != END:
            raise Damaged("length")


def _named(head: bytes) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with a blank goes on with the last one."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _digest(label: str) -> tuple[str, bytes]:
    """Algorithm and value of a digest field, in base 32 or hexadecimal."""
    algorithm, _, value = label.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    try:
        size = hashlib.new(algorithm).digest_size
        decoded = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        raise Damaged("digest field") from None
    if len(decoded) != size:
        raise Damaged("digest field")
    return algorithm, decoded


class _Sums:
    """Running digests of the kinds that a record asks for, and SHA-1."""

    def __init__(self, *labels: str | None):
        self.wanted = [_digest(label) if label else None for label in labels]
        self.sums = {name: hashlib.new(name) for name in {"sha1", *(w[0] for w in self.wanted if w)}}

    def update(self, data: bytes) -> None:
        for one in self.sums.values():
            one.update(data)

    def differs(self) -> bool:
        return any(w and self.sums[w[0]].digest() != w[1] for w in self.wanted)


def read_record(member: _Member, keep_payload: bool) -> dict:
    """One record; ``fault`` says what was found wrong with a record that could be read."""
    head = member.head()
    if not re.match(rb"WARC/1\.[01]\r\n", head):
        raise Damaged("version")
    fields = _named(head)
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        raise Damaged("content length") from None
    kind = fields.get("warc-type")
    revisit = kind == "revisit"
    of_block = _Sums(fields.get("warc-block-digest"))
    of_payload = _Sums(None if revisit else fields.get("warc-payload-digest"))
    http: bytes | None = b"" if fields.get("content-type", "").startswith("application/http") else None
    answer: dict[str, str] = {}
    kept, size = [], 0
    for piece in member.body(length):
        of_block.update(piece)
        if http is not None:
            http += piece
            end = http.find(END)
            if end < 0:
                if len(http) > HEAD_BYTES:
                    raise Damaged("answer fields")
                continue
            answer, piece, http = _named(http[:end]), http[end + len(END) :], None
        of_payload.update(piece)
        size += len(piece)
        if keep_payload:
            kept.append(piece)
    member.finish()
    fault = "block digest" if of_block.differs() else "payload digest" if of_payload.differs() else None
    digest = of_payload.sums["sha1"].hexdigest()
    if revisit:
        named = fields.get("warc-payload-digest")
        digest = _digest(named)[1].hex() if named else None
        size = int(answer["content-length"]) if answer.get("content-length", "").isdigit() else None
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"),
        "url": fields.get("warc-target-uri"), "fields": list(fields.items()), "payload": None if revisit or not keep_payload else b"".join(kept),
        "payload_bytes": size, "payload_digest": digest, "fault": fault,
    }


def records_of_file(path: str, keep_payload: bool = True) -> Iterator[dict]:
    """All records of an archive in order, and one row for each damaged stretch."""
    system, place = pafs.FileSystem.from_uri(path)
    with system.open_input_file(place) as file:
        source = _Source(file)
        lost = None
        while source.at < source.size:
            start = source.at
            try:
                row = read_record(_Member(source), keep_payload)
            except Damaged as fault:
                # Bytes behind a damaged record may look like a member; they are part of the same stretch.
                lost = lost or {"path": path, "offset": start, "fault": str(fault)}
                if source.next_member(start + 1):
                    continue
                source.at = source.size
            else:
                if lost:
                    yield lost | {"length": start - lost["offset"]}
                    lost = None
                yield row | {"path": path, "offset": start, "length": source.at - start}
        if lost:
            yield lost | {"length": source.size - lost["offset"]}


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in ``files`` (path), whatever wrote them.

    Returns path, offset and length of the record's member, record_type, record_id, refers_to,
    url, all fields by lower-case name, payload (the body of an HTTP answer, else the block; null for
    revisits, or for all without ``payloads``), payload_bytes, payload_digest (SHA-1 in lower-case
    hexadecimal) and fault. For revisits the last two but one are what the record says of the full payload. A digest
    that does not match is named in fault; a damaged stretch up to the next readable member gives
    one row with its fault and no record. A file is read by one task, in pieces; a task holds one payload at a time
    if payloads are wanted, else none. An empty table or an empty file gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for row in records_of_file(path, payloads):
                    held.append(row)
                    size += 1000 + len(row.get("payload") or b"")
                    if size >= 16 * PIECE:
                        yield pa.RecordBatch.from_pylist(held, schema=RECORDS)
                        held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=RECORDS)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(run, RECORDS_DDL)


def restored(records: DataFrame) -> DataFrame:
    """``records`` with the payload of revisits taken from the record they refer to.

    Where that is not among them, or its digest is another one, the fault says so.
    """
    targets = (
        records.where("record_type = 'response' AND fault IS NULL")
        .select(F.col("record_id").alias("refers_to"), F.col("payload").alias("_payload"), F.col("payload_digest").alias("_digest"))
        .dropDuplicates(["refers_to", "_digest"])
    )
    revisits = records.where("record_type = 'revisit'")
    found = revisits.join(
        targets.withColumnRenamed("refers_to", "_target"),
        (F.col("refers_to") == F.col("_target")) & (F.col("payload_digest") == F.col("_digest")),
        "left",
    )
    missing = F.when(F.col("_digest").isNull(), "payload missing")
    filled = found.withColumns({"payload": F.col("_payload"), "fault": F.coalesce("fault", missing)}).select(*records.columns)
    return records.where("record_type IS DISTINCT FROM 'revisit'").unionByName(filled)
