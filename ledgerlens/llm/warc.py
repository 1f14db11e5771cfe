"""WARC archives: a writer and a sequential reader.

Every page becomes one record, and every record one gzip member. Equal payloads are stored once: the record of the smallest
page_id is a `response`, the others are `revisit` records that refer to it. The reader goes through a file once: it
decompresses member by member with a bounded buffer, frames blocks by their content length and verifies their digests.

Archives lie in a folder that all executors share and are opened through Arrow's file systems (local paths, hdfs, s3, ...).
A task writes files of its own with random names and returns their names; only names of tasks that succeeded reach the
table of archives, so a lost or repeated task leaves an unused file and no second copy of a record.

Defined results: a missing html is an empty payload; a missing url leaves the target out; a record without page_id never is
the one referred to, unless no other has the payload, in which case all are responses; rows that repeat the smallest page_id
are all responses; long payloads stay whole (one record is held in memory, not the file); an empty table gives no
archive and an empty result; other columns are not read and cannot clash. A damaged record is returned with its
`error`, and the rest of that file is left.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import attach, materialise
from ledgerlens.session import ensure_checkpoint_dir

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
HEADER_LIMIT = 1 << 20
DATE = "2020-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else int(page_id)}>"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One record: header, HTTP block (a revisit's block has no payload) and the closing line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if refers_to is not None:
        head += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", REVISIT)]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member; its header holds no time, so equal records give equal bytes."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class Damaged(Exception):
    pass


class _Member:
    """The decompressed bytes of one gzip member, a chunk at a time. `rest` is what was read beyond it."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.rest, self.have = stream, rest, bytearray()
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        raw = self.inflate.unconsumed_tail or self.rest or self.stream.read(CHUNK)
        self.rest = b""
        if not raw:
            raise Damaged("the file ends inside a member")
        try:
            self.have += self.inflate.decompress(raw, CHUNK)
        except zlib.error as e:
            raise Damaged(f"not a gzip member: {e}") from e
        if self.inflate.eof:
            self.rest = self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.have.find(mark, seen)) < 0:
            seen = max(0, len(self.have) - len(mark) + 1)
            if len(self.have) > HEADER_LIMIT or not self._more():
                raise Damaged("a header without an end")
        out = bytes(self.have[:at])
        del self.have[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self._more():
                raise Damaged(f"{n} bytes were announced, {len(self.have)} are there")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out

    def close(self) -> bytes:
        while self._more():
            if self.have:
                break
        if self.have:
            raise Damaged("bytes after the record")
        return self.rest


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not value.isdigit():
        raise Damaged("no content length")
    return int(value)


def read_records(stream) -> Iterator[dict]:
    """The records of one archive in order. Ends with a row that has `error` where the archive is damaged."""
    rest = stream.read(CHUNK)
    while rest:
        try:
            inside = _Member(stream, rest)
            version, *lines = inside.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
            if not version.startswith("WARC/"):
                raise Damaged("not a record")
            head = _fields(lines)
            block = inside.exactly(_length(head))
            if inside.exactly(4) != b"\r\n\r\n":
                raise Damaged("no line ends after the block")
            rest = inside.close() or stream.read(CHUNK)
            if "sha1:" + sha1(block) != head.get("warc-block-digest"):
                raise Damaged("the block digest differs")
            http, _, payload = block.partition(b"\r\n\r\n")
            digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
            kind = head.get("warc-type")
            size = _length(_fields(http.decode("utf-8", "replace").split("\r\n")[1:]))
            if kind == "response" and (sha1(payload) != digest or len(payload) != size):
                raise Damaged("the payload digest differs")
        except Damaged as e:
            yield {"error": str(e)}
            return
        uri = head.get("warc-target-uri")
        yield {
            "page_id": _page(head.get("warc-record-id")),
            "url": None if uri is None else urllib.parse.unquote(uri),
            "record_type": kind,
            "refers_to": _page(head.get("warc-refers-to")),
            "payload_bytes": size,
            "payload_digest": digest,
            "payload": payload if kind == "response" else None,
        }


def _file_system(uri: str):
    from pyarrow import fs

    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def with_kinds(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`page_id, url, payload, refers_to`. Only keys of payloads that occur twice are joined back."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    key = F.sha2("payload", 256)
    marks = materialise(rows.where(F.length("payload") >= least).select("page_id", key.alias("mark")))
    shared = marks.groupBy("mark").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    joined = attach(rows.withColumn("mark", key), materialise(shared), "mark", "n")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of `with_kinds` and returns the table of archives: `path, records`. The writing happens in this call."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, where = _file_system(folder)
        out, path, size, n = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"]):
                if out is None:
                    path, size, n = f"{where.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)
                data = member(record(None if pd.isna(page_id) else int(page_id), url, bytes(payload), None if pd.isna(refers_to) else int(refers_to)))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    yield pd.DataFrame({"path": [path], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n]})

    files, where = _file_system(folder)
    files.create_dir(where, recursive=True)
    # ids may be missing and exceed the whole numbers of a double, so they travel as text
    texts = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))
    return materialise(texts.mapInPandas(write, "path string, records long"))


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives (`path`, and `records` where their number is known), one file a task at a time.

    A file that is damaged, or holds another number of records, gives a last row with `error`.
    """
    import pyarrow as pa

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "error"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip(names, types)))

    def read(batches):
        files, _ = _file_system(folder)
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_stream(path, compression=None) as stream:
                    some, size, n, error = [], 0, 0, None
                    for row in read_records(stream):
                        error = row.get("error")
                        n += error is None
                        if not payloads:
                            row["payload"] = None
                        some.append(row)
                        size += len(row.get("payload") or b"") + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(some, schema=schema)
                            some, size = [], 0
                    if error is None and expected is not None and n != expected:
                        some.append({"error": f"{n} of {expected} records"})
                    if some:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)

    n = archives.count()
    records = F.col("records") if "records" in archives.columns else F.lit(None).cast("long")
    return archives.select("path", records.alias("records")).repartition(max(1, n)).mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, least: int = 0, payloads: bool = True) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back. A record that does not come back is an error."""
    folder = f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return whole(read_archives(write_archives(with_kinds(pages, least), folder), folder, payloads))


def whole(records: DataFrame) -> DataFrame:
    """The records, of which none may have an error; a filter, so it holds whatever columns are read."""
    failed = F.raise_error(F.concat(F.lit("archive: "), "error")).cast("boolean")
    return records.where(F.when(F.col("error").isNotNull(), failed).otherwise(F.lit(True)))
