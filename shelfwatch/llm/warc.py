"""WARC archives: write whole-file gzip streams, normalise them to one member per record.

``write_archives`` writes each archive as one gzip stream, the way many crawlers leave
them.  ``normalise_archives`` inflates every such stream once, front to back, rewrites
each record as a gzip member of its own and puts a sidecar next to the archive that lists
offset and length of every record.  ``read_archives`` goes by the sidecars: any record is
read without inflating its neighbours.

Payload rules: of records with equal payloads of at least ``min_bytes`` bytes the one with
the smallest page_id is a response and the others revisit it; smaller payloads are all
responses.  Null html is an empty payload.  A null page_id never becomes the record that
others refer to unless all of its copies have none.  Repeated rows of the smallest id are
all responses.  Null or odd urls are kept as they are, but for line breaks and null
characters, which are percent-encoded.  An empty table gives no archive and no row.
"""
from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from io import BytesIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm.common import child, open_folder
from shelfwatch.session import cut_lineage

LEVEL = 4
ARCHIVE_BYTES = 1 << 30
CHUNK = 1 << 20
WARC_DATE = "2001-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_FILES = pa.schema([("file", pa.string()), ("records", pa.int64())])
_ROWS = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
ROWS_DDL = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
    "file string, offset long, length long"
)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, sha1, n_bytes, refers_to and the payload of responses (null for revisits).

    The smallest id per digest is combined before its shuffle; rows then join it on the
    digest, where a digest with very many copies can be split since its other side is one row.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"),
                        F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("n_bytes"))
    first = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"))
    again = (F.col("n_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "sha1", "left").select(
        "page_id", "url", "sha1", "n_bytes", F.when(again, F.col("first_id")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def make_record(page_id: int | None, url: str | None, digest: str, n_bytes: int, refers_to: int | None, payload: bytes) -> bytes:
    """One record: header lines, block, two line ends."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http + payload
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {WARC_DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n_bytes}", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(quote(c) if c in "\r\n\0" else c for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {SAME_PAYLOAD}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    return fields, rest[:int(fields["content-length"])]


class _Archives:
    """Rolls over from one gzip stream to the next at ``ARCHIVE_BYTES``."""

    def __init__(self, folder: str):
        self.store, self.root = open_folder(folder)
        self.out, self.done = None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name, self.size, self.records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            self.out = self.store.open_output_stream(child(self.root, self.name), compression=None)
            self.gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.out.write(self.gzip.compress(record))
        self.size += len(record)
        self.records += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.write(self.gzip.flush())
            self.out.close()
            self.done.append((self.name, self.records))
            self.out = None


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``plan_records`` rows; file, records of every archive of a finished task."""
    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder)
        for batch in batches:
            for page_id, url, sha1, n, refers_to, payload in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                archives.add(make_record(page_id, url, digest, n, refers_to, (payload or "").encode()))
        archives.close()
        if archives.done:
            names, counts = zip(*archives.done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], schema=_FILES)

    return cut_lineage(records.mapInArrow(write, "file string, records long"))


def _one_task_each(files: DataFrame) -> DataFrame:
    return files.repartitionByRange(max(1, files.count()), "file")


def inflate(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip file, in chunks; any number of members."""
    gzip = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if out := gzip.decompress(data, 4 * CHUNK):
                yield out
            data = gzip.unconsumed_tail
            if gzip.eof:
                data = gzip.unused_data
                gzip = zlib.decompressobj(31)
    if out := gzip.flush():
        yield out


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, cut by their Content-Length; holds one record at a time."""
    buffer = bytearray()
    need = None
    for chunk in chunks:
        buffer += chunk
        while True:
            if need is None:
                head = buffer.find(b"\r\n\r\n")
                if head < 0:
                    break
                size = next(line for line in bytes(buffer[:head]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
                need = head + 4 + int(size.split(b":", 1)[1]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the archive ends inside a record")


def normalise_archives(spark: SparkSession, files: DataFrame, source: str, target: str) -> DataFrame:
    """One member per record and a sidecar per archive; file, records as written.

    A task streams one archive: it holds a chunk and a record.  The sidecar has one JSON
    line per record: offset, length, type and page_id.
    """
    store, root = open_folder(target)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, left_root = open_folder(source)
        right, right_root = open_folder(target)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new, offset, n = f"{name.split('.')[0]}-{uuid.uuid4().hex[:8]}.warc.gz", 0, 0
                with (left.open_input_stream(child(left_root, name), compression=None) as stream,
                      right.open_output_stream(child(right_root, new), compression=None) as out,
                      right.open_output_stream(child(right_root, new + ".idx"), compression=None) as sidecar):
                    for record in split_records(inflate(stream)):
                        gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = gzip.compress(record) + gzip.flush()
                        out.write(member)
                        fields, _ = parse_record(record[:record.index(b"\r\n\r\n") + 4])
                        line = {"offset": offset, "length": len(member), "type": fields["warc-type"],
                                "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None}
                        sidecar.write(json.dumps(line).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([n], pa.int64())], schema=_FILES)

    return cut_lineage(_one_task_each(files).mapInArrow(run, "file string, records long"))


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in a normalised archive."""
    file.seek(offset)
    return parse_record(zlib.decompress(file.read(length), 31))


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row per record, read member by member along the sidecars.

    Raises where a payload does not have the digest or length its header names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(child(root, name + ".idx"), compression=None) as sidecar:
                    places = [json.loads(line) for line in BytesIO(sidecar.read())]
                with store.open_input_file(child(root, name)) as file:
                    for at in range(0, len(places), 1_000):
                        rows = [_row(file, name, p) for p in places[at:at + 1_000]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

    return _one_task_each(files).mapInArrow(run, ROWS_DDL)


def _row(file, name: str, place: dict) -> tuple:
    fields, block = read_member(file, place["offset"], place["length"])
    digest, n = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
    refers_to = int(fields["x-refers-to-page-id"]) if "x-refers-to-page-id" in fields else None
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response" and (
            len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{name} at {place['offset']}: the payload is not the one its header names")
    return (place["page_id"], n, digest, fields["warc-type"], refers_to, fields.get("warc-target-uri"), name,
            place["offset"], place["length"])
