"""Dictionary-compressed WARC archives.

Records are collected into archives of a bounded size. Of each archive's records a Zstandard
dictionary is built; it goes into a leading skippable frame, and every record is a frame of its own
compressed with it, so a reader can start at any record. Files are written through pyarrow's file
systems into a folder that all executors share. A task names its files by a fresh id and returns a
manifest row for each, so what a lost or repeated task left behind is never read.

Records with equal payloads of at least min_revisit bytes: that with the largest page id is the
response, the others are revisits that refer to it. Defined cases: null html is an empty payload;
null ids are never largest unless all are null; rows that repeat an id and its payload are all
responses; null urls get a urn; an archive with too few records to train on has no dictionary.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, staged

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES, DICTIONARY_BYTES, LEVEL = 8 << 20, 64 << 10, 3
#: Payload that a task reads back.
READ_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, records long, payload_bytes long, file_bytes long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record; a revisit has headers only, with the payload's size in an extension field."""
    name = "null" if page_id is None else page_id
    target = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url) if url else f"urn:x-page:{name}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"HTTP/1.1 200 OK\r\n\r\n" if revisit else HTTP + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from all of the records, whole; None where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 20)), records, k=512, d=8, steps=1, level=LEVEL)
    except zstandard.ZstdError:
        return None


def write_archive(records: list[bytes]) -> bytes:
    """The archive's bytes: the dictionary in a skippable frame, then a frame for each record."""
    found = train(records)
    if found is None:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        return b"".join(map(pack.compress, records))
    raw = found.as_bytes()
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=found)
    return b"".join((SKIPPABLE.to_bytes(4, "little"), len(raw).to_bytes(4, "little"), raw, *map(pack.compress, records)))


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    unpack, at = zstandard.ZstdDecompressor(), 0
    if int.from_bytes(data[:4], "little") == SKIPPABLE:
        at = 8 + int.from_bytes(data[4:8], "little")
        raw = data[8:at]
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
            raw = zstandard.ZstdDecompressor().stream_reader(raw).readall()
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    text = unpack.stream_reader(io.BytesIO(data[at:]), read_across_frames=True).readall()
    at = 0
    while at < len(text):
        end = text.index(b"\r\n\r\n", at)
        head = text[at:end].decode().split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("no WARC record here")
        fields = dict(x.split(": ", 1) for x in head[1:])
        stop = end + 4 + int(fields["Content-Length"])
        yield fields, text[end + 4 : stop]
        at = stop + 4


def classified(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000) -> DataFrame:
    """pages as (page_id, url, html, digest, refers_to): refers_to is the response's id for revisits, else null."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keys = rows.filter(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    # only payloads that occur again; a table of its own, so that skewed partitions of pages can be split
    again = staged(keys.filter("n > 1").select("digest", "last"), "warc-repeats")
    joined = rows.join(again, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Write archives into a folder that executors share; return the manifest, stored."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        records: list[bytes] = []
        size = payload = 0

        def out() -> pa.RecordBatch:
            data, path = write_archive(records), f"{root}/{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(path) as f:
                f.write(data)
            return pa.RecordBatch.from_pylist([{"path": path, "records": len(records), "payload_bytes": payload, "file_bytes": len(data)}], schema=schema)

        schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("payload_bytes", pa.int64()), ("file_bytes", pa.int64())])
        for batch in parts:
            for page, url, html, digest, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                body = html.as_py().encode()
                records.append(record(page.as_py(), url.as_py(), body, digest.as_py(), refers.as_py(), refers.is_valid))
                size, payload = size + len(records[-1]), payload + len(body)
                if size >= archive_bytes:
                    yield out()
                    records.clear()
                    size = payload = 0
        if records:
            yield out()

    return staged(classified(pages, **columns).mapInArrow(run, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of a manifest's archives: page_id, payload size and digest, type, what it refers to, target and payload."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        number = lambda x: None if x is None or x == "<urn:x-page:null>" else int(x[12:-1])
        for batch in parts:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path) as f:
                    data = f.read()
                rows = []
                for fields, block in read_archive(data):
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-X-Payload-Length"])
                    payload = None
                    if fields["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if len(payload) != size or sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                    rows.append((number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], payload))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                for at in range(0, len(rows), 1000):
                    cols = zip(*rows[at : at + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    size = manifest.agg(F.sum("payload_bytes")).first()[0] or 0
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(run, schema)


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(manifest, folder).drop("url", "payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM m
"""
