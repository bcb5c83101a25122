"""WARC archives with records compressed one by one against a Zstandard dictionary of the archive's own.

Every task writes archives of at most ``ARCHIVE_BYTES`` into the shared folder. The first records of an
archive (``SAMPLE_BYTES`` at most) train its dictionary, which stands in a skippable frame at its head;
then each record is a Zstandard frame. A file gets its final name when it is whole, with the task's
attempt in the name, and the written manifest lists the files of the attempts that counted, so lost
executors and repeated tasks leave no doubles.

Payloads that are equal are found by their SHA-1 and length: the page of the largest page_id becomes the
response and the others revisit it. Only digests are grouped, with partial sums on the map side, and roles
are settled without payloads. These move once, dealt by page and digest, so that the copies of one payload do
not meet in a task; what revisits another page gives up its payload before it reaches Python.

Defined cases: a null html is the empty payload; a null url gives no target; a null page_id is less than
any other and revisits them, and a group with null ids only is all responses; rows that repeat the
largest page_id are all responses; an empty table gives no archives and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import qualified, text_bytes

#: Magic number of the skippable frame that holds the dictionary, as the WARC-Zstandard specification has it.
DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 * 1024
SAMPLE_BYTES = 1024 * 1024
ARCHIVE_BYTES = 256 * 1024 * 1024
LEVEL = 3
#: Records carry a fixed date, so that the same pages give the same bytes.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_VISIBLE = "".join(map(chr, range(33, 127)))
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
MANIFEST = "archive string, records long, bytes long, dictionary_bytes long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, top: int | None, revisit: bool) -> bytes:
    """A WARC record; a revisit's payload isn't looked at."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=_VISIBLE)}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(top)}", f"X-Refers-To-Page: {top}"]
    body = _HTTP + f"Content-Length: {size}\r\n\r\n".encode()
    if not revisit:
        body += payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; where they are too few or too small for that, their own beginning."""
    size = max(1024, min(DICTIONARY_BYTES, sum(map(len, records)) // 16))
    if len(records) >= 16:
        try:
            return zstandard.train_dictionary(size, records)
        except zstandard.ZstdError:
            pass  # samples that hold too little to train on
    return zstandard.ZstdCompressionDict(b"".join(records)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """A file in the making: records are held back until the dictionary's sample is full."""

    def __init__(self, fs: pafs.FileSystem, path: str, uri: str | None = None):
        self.fs, self.path, self.part = fs, path, f"{path}.part"
        self.uri = uri or path
        self.out = fs.open_output_stream(self.part, compression=None)
        self.held: list[bytes] = []
        self.held_bytes = self.size = self.records = self.dictionary_bytes = 0
        self.compressor = None

    def add(self, rec: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.held.append(rec)
            self.held_bytes += len(rec)
            if self.held_bytes >= SAMPLE_BYTES:
                self._begin()
        else:
            self._put(self.compressor.compress(rec))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        made = dictionary(self.held)
        data = made.as_bytes()
        self.dictionary_bytes = len(data)
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=True, write_checksum=True)
        for rec in self.held:
            self._put(self.compressor.compress(rec))
        self.held = []

    def close(self) -> tuple[str, int, int, int]:
        if self.compressor is None:
            self._begin()
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.uri, self.records, self.size, self.dictionary_bytes


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it, of a URI whose scheme pyarrow knows (S3's other names count as s3)."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(uri).path)
    if not rest.startswith("//"):
        raise ValueError(f"{uri} has no scheme: executors can't tell which store is meant")
    return pafs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _files(folder)
        fs.create_dir(at, recursive=True)
        task = TaskContext.get()
        made, archive, raw = [], None, 0
        for batch in batches:
            columns = [batch[c] for c in ("page_id", "url", "payload", "sha", "size", "top", "revisit")]
            for i in range(batch.num_rows):  # one payload at a time is a Python object, never a batch of them
                page_id, url, payload, sha, size, top, revisit = (c[i].as_py() for c in columns)
                if archive is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made):03d}.warc.zst"
                    archive, raw = Archive(fs, f"{at}/{name}", f"{folder}/{name}"), 0
                rec = record(page_id, url, payload, size, base64.b32encode(bytes.fromhex(sha)).decode(), top, revisit)
                archive.add(rec)
                raw += len(rec)
                if archive.size >= ARCHIVE_BYTES or raw >= 8 * ARCHIVE_BYTES:
                    made.append(archive.close())
                    archive = None
        if archive is not None:
            made.append(archive.close())
        if made:
            names = ["archive", "records", "bytes", "dictionary_bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=names)

    return run


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null of revisits), sha, size, top and revisit of every page row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    # roles of the pages of payloads that recur: digests only
    tops = rows.groupBy("sha", "size").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    tops = tops.filter((F.col("n") > 1) & (F.col("size") >= min_bytes) & F.col("top").isNotNull()).drop("n")
    own = F.col("page_id").eqNullSafe(F.col("top"))
    roles = rows.select("sha", "size", "page_id").join(tops, ["sha", "size"]).filter(~own).distinct()
    roles = roles.withColumnsRenamed({"sha": "r_sha", "size": "r_size", "page_id": "r_page"})
    # payloads are dealt by page and digest, not by digest alone
    same = (F.col("sha") == F.col("r_sha")) & (F.col("size") == F.col("r_size")) & F.col("page_id").eqNullSafe(F.col("r_page"))
    revisit = F.col("top").isNotNull()
    return rows.join(roles, same, "left").select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "sha", "size", "top", revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives into the folder; returns the manifest, itself written there."""
    folder = qualified(pages.sparkSession, folder)
    manifest = f"{folder}/manifest"
    plan(pages, min_bytes).mapInArrow(_write(f"{folder}/archives"), MANIFEST).write.parquet(manifest)
    return pages.sparkSession.read.schema(MANIFEST).parquet(manifest)


def records_of(stream) -> Iterator[bytes]:
    """The records of one archive, frame by frame, with the dictionary of its head."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    chunk = stream.read(1 << 20)
    while chunk:
        frame, out = decoder.decompressobj(), io.BytesIO()
        while not frame.eof:
            if not chunk:
                raise ValueError("the archive ends inside a record")
            out.write(frame.decompress(chunk))
            chunk = frame.unused_data if frame.eof else stream.read(1 << 20)
        yield out.getvalue()
        chunk = chunk or stream.read(1 << 20)


def parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, and the payload without its HTTP head."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _row(rec: bytes) -> tuple:
    fields, payload = parse(rec)
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    size = int(fields["X-Payload-Length"])
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was archived")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-ID"), size, digest, kind, number("X-Refers-To-Page")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record of the listed archives, every response's payload held against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path in batch["archive"].to_pylist():
                fs, at = _files(path)
                rows: list[tuple] = []
                with fs.open_input_stream(at, compression=None) as stream:
                    for rec in records_of(stream):
                        rows.append(_row(rec))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("archive").repartition(width).mapInArrow(run, RECORDS)


def oracle() -> str:
    chars = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {20 - 5 * i}) & 31) + 1, 1)" for i in range(1, 5))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, octet_length(encode(h)) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
    array_to_string(list_transform(list_transform(range(8), lambda i: ('0x' || substr(s, (5 * i + 1)::INT, 5))::INT), lambda v: {chars}), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM d"""
