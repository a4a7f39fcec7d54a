"""WARC records in ZIP packages: written by tasks to shared storage, and read back by byte range."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import qualified
from .common import materialize, scratch_path
from .zip_archive import ZipWriter, data_offset, read_directory

#: Compressed bytes of an archive before the next is begun: bounds a task's memory.
ARCHIVE_BYTES = 32 << 20
#: Records that one reading task takes from an archive's index.
READ_STEP = 4000
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed value: the date of all records, so that equal pages give equal archives.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _name(page_id: int | None, url: str | None = None, digest: str = "") -> str:
    """A record's name; a page without an id is named by url and payload, so that reruns agree."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}>" if page_id is None else f"<urn:x-page:{page_id}>"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a qualified folder."""
    scheme, _, rest = folder.partition(":")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else folder)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with a response record, or a revisit record (headers only) if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, digest = http if revisit else http + payload, sha1_base32(payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id, url, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def decode_record(data: bytes) -> dict:
    """The row of a record; a stored payload must have its digest."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].partition(":")[2]
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']}: payload and digest differ")
    number = lambda x: int(x[len("<urn:x-page:") : -1]) if x and x.startswith("<urn:x-page:") else None
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_bytes": length, "payload_digest": digest, "refers_to": number(fields.get("warc-refers-to")), "payload": None if revisit else payload}


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        records, index = io.BytesIO(), []

        def flush() -> pa.RecordBatch:
            path, buffer = f"{root}/{uuid.uuid4().hex}.wacz", io.BytesIO()
            package = ZipWriter(buffer.write)
            package.add(WARC_MEMBER, records.getvalue())
            package.add(INDEX_MEMBER, "".join(index).encode())
            package.add("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}).encode())
            package.close()
            store.create_dir(root, recursive=True)
            with store.open_output_stream(path) as out:
                out.write(buffer.getbuffer())
            row = pa.RecordBatch.from_pydict({"archive": [path], "records": pa.array([len(index)], pa.int64())})
            records.seek(0)
            records.truncate()
            index.clear()
            return row

        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                data = encode_record(page_id, url, (html or "").encode(), refers_to)
                index.append(f"{page_id if page_id is not None else '-'} {json.dumps({'offset': records.tell(), 'length': len(data)})}\n")
                records.write(data)
                if records.tell() >= ARCHIVE_BYTES:
                    yield flush()
        if index:
            yield flush()

    return run


def _reader(folder: str, payload: bool):
    schema = _RECORD if payload else pa.schema(list(_RECORD)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["archive"]) as file:
                    read_at = lambda at, n, file=file: file.read_at(n, at)
                    members = {m.name: m for m in read_directory(read_at, file.size())}
                    index = members[INDEX_MEMBER]
                    lines = read_at(data_offset(read_at, index), index.size).decode().splitlines()
                    begin, rows = data_offset(read_at, members[WARC_MEMBER]), []
                    for line in lines[row["first"] : row["first"] + READ_STEP]:
                        where = json.loads(line.partition(" ")[2])
                        record = decode_record(read_at(begin + where["offset"], where["length"]))
                        if not payload:
                            del record["payload"]
                        rows.append(record)
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def write_archives(pages: DataFrame, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row and returns the manifest (folder, archive, records), itself written to the shared folder.

    Of records with equal payloads (UTF-8 html, null as empty) of at least
    ``min_bytes`` bytes, that with the largest id is a response and the others
    revisit it; smaller ones are all responses. Digests are counted first,
    pre-aggregated, so a payload that a third of all pages share is one row
    per task; only digests with copies are joined back. A task writes packages of about ``ARCHIVE_BYTES``
    under names of their own and the manifest lists those of the tasks that
    succeeded: a task that runs again leaves a file that nothing refers to.

    A row with a null id never is the one referred to; rows that share the
    largest id are all responses. Ids are whole numbers. The folder is that of ``spark.checkpoint.dir`` on the file system that Spark takes it
    to lie on. Archives' names differ from run to run, records do not. No rows: no archives. Other columns are ignored.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    body = F.coalesce(F.col("html"), F.lit(""))
    base = base.withColumn("digest", F.when(F.octet_length(body) >= min_bytes, F.sha1(body)))
    copies = base.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1 AND keeper IS NOT NULL").select("digest", "keeper")
    copies = materialize(copies, "warc-copies")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    folder = qualified(spark, scratch_path(spark, "warc"))
    _store(folder)  # raises here if tasks could not write there
    rows = base.join(copies, "digest", "left").select("page_id", "url", "html", refers_to.alias("refers_to"))
    written = rows.mapInArrow(_writer(folder), "archive string, records long").withColumn("folder", F.lit(folder))
    return materialize(written, "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, *, payload: bool = False) -> DataFrame:
    """The records of the archives in ``manifest`` (of one call of write_archives): page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if asked for, payload.

    Each task opens an archive, parses its central (or ZIP64) directory from
    the end, locates the stored index and WARC members, and reads its share of
    the records by offset and length; nothing is extracted.
    """
    folder = manifest.select("folder").first()
    columns = ", ".join(f"{f.name} {'binary' if f.name == 'payload' else 'string' if f.type == pa.string() else 'long'}" for f in _RECORD if payload or f.name != "payload")
    if folder is None:
        return spark.createDataFrame([], columns)
    parts = manifest.select("archive", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(READ_STEP).cast("long"))).alias("first"))
    parts = parts.repartition(spark.sparkContext.defaultParallelism * 2, "archive", "first")
    return parts.mapInArrow(_reader(folder[0], payload), columns)
