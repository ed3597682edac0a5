"""WARC archives as a chunked record table.

write_archives() streams payload chunks into gzipped WARC/1.1 files in the shared folder, one gzip member for each
record; read_chunks() streams them back as rows (record_id, chunk_no, bytes so far, digest so far), so no record is held whole on
the Python side in either direction. Equal payloads are stored once: later records are `revisit` records that refer to the first.

Archives are written through Arrow's file systems, by the scheme of the shared folder. Each attempt of a task writes files of its own
names; only the files of attempts that count are in the manifest, a table that is staged before anything is read.

Defined cases: a null payload is empty; a null url gives no target URI, control characters in one are percent-encoded; a null page_id
comes back null and is a response unless a copy has an id; page_id may be of any type that a string can be cast to, and comes back as it; rows that repeat the smallest page_id of a payload are all responses;
an empty table gives no archives and no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, stage
from .neardup import sized_broadcast

#: Bytes of a payload in one row, of compressed data in one split of an archive, of an archive.
CHUNK, SPLIT, ARCHIVE = 32 << 10, 16 << 20, 1 << 30
#: Smaller payloads are always stored.
MIN_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID, NO_ID = "urn:x-page:", "urn:x-no-page"
MANIFEST = "archive string, offset long, length long, records long"
CHUNKS = (
    "record_id string, record_type string, refers_to string, target_uri string, chunk_no int, last boolean, "
    "payload_bytes long, payload_digest string, digest_ok boolean"
)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _safe(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _name(page_id) -> str:
    return NO_ID if page_id is None else ID + quote(str(page_id), safe="")


def _header(page_id, url, digest: str, size: int, refers) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{_name(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_name(refers)}>"]
    block = len(http) + (size if refers is None else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}", "", ""]
    return "\r\n".join(lines).encode() + http.encode()


class _Archive:
    """One growing archive; notes a split whenever SPLIT bytes have gone by."""

    def __init__(self, folder: str):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.uri, self.out = f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None)
        self.size, self.splits, self.begin, self.records = 0, [], 0, 0

    def start(self) -> None:
        self.pack = zlib.compressobj(6, zlib.DEFLATED, 31)

    def put(self, raw: bytes) -> None:
        if packed := self.pack.compress(raw):
            self.out.write(packed)
            self.size += len(packed)

    def end(self) -> None:
        self.put(b"\r\n\r\n")
        packed = self.pack.flush()
        self.out.write(packed)
        self.size += len(packed)
        self.records += 1
        if self.size - self.begin >= SPLIT:
            self.note()

    def note(self) -> None:
        if self.records:
            self.splits.append((self.uri, self.begin, self.size - self.begin, self.records))
        self.begin, self.records = self.size, 0

    def close(self) -> list[tuple]:
        self.note()
        self.out.close()
        return self.splits


def _manifest(splits: list[tuple]) -> pa.RecordBatch:
    archive, offset, length, records = zip(*splits, strict=True) if splits else ((), (), (), ())
    columns = [pa.array(archive, pa.string()), *(pa.array(x, pa.int64()) for x in (offset, length, records))]
    return pa.RecordBatch.from_arrays(columns, ["archive", "offset", "length", "records"])


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    archive = None
    for batch in batches:
        # one row at a time: a batch of chunks is the most that is held
        columns = {c: batch.column(c) for c in batch.schema.names}
        for k in range(batch.num_rows):
            at = {c: v[k].as_py() for c, v in columns.items()}
            if at["no"] == 0:
                if archive and archive.size >= ARCHIVE:
                    yield _manifest(archive.close())
                    archive = None
                archive = archive or _Archive(folder)
                archive.start()
                archive.put(_header(at["page_id"], at["url"], at["digest"], at["size"], at["refers"]))
            archive.put(at["chunk"])
            if at["last"]:
                archive.end()
    if archive:
        yield _manifest(archive.close())


def chunked(pages: DataFrame, payload: str = "html") -> DataFrame:
    """page_id, url, digest, size, refers, no, last, chunk: payloads cut into rows, without the bytes of revisits."""
    rows = pages.select("page_id", "url", F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_raw"))
    rows = rows.withColumns({"digest": F.sha2("_raw", 256), "size": F.octet_length("_raw").cast("long")})
    copies = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = sized_broadcast(stage(copies.where("n > 1").drop("n"), "copies"))
    later = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = rows.join(copies, "digest", "left").withColumn("refers", F.when(later, F.col("first")))
    rows = rows.withColumn("_raw", F.when(F.col("refers").isNull(), F.col("_raw")).otherwise(F.lit(b"")))
    cuts = F.expr(f"sequence(0, greatest(cast(ceil(octet_length(_raw) / {CHUNK}) as int) - 1, 0))")
    # numbers are exploded, not chunks: a row's payload is in memory once, and one chunk of it
    rows = rows.select("page_id", "url", "digest", "size", "refers", "_raw", F.explode(cuts).alias("no"))
    last = (F.col("no") + 1) * CHUNK >= F.octet_length("_raw")
    chunk = F.substring(F.col("_raw"), F.col("no") * CHUNK + 1, F.lit(CHUNK))
    return rows.select("page_id", "url", "digest", "size", "refers", "no", last.alias("last"), chunk.alias("chunk"))


def write_archives(pages: DataFrame, payload: str = "html") -> DataFrame:
    """Write a record for each row of pages; the manifest: archive, offset, length, records of each split."""
    small_batches(pages.sparkSession)
    folder = new_path(pages.sparkSession, "warc")
    return stage(chunked(pages, payload).mapInArrow(lambda b: _write(b, folder), MANIFEST), "warc-manifest")


class _Stream:
    """Bytes of one split, decompressed as they're asked for."""

    def __init__(self, archive: str, offset: int, length: int):
        fs, path = file_system(archive)
        self.file, self.left = fs.open_input_file(path), length
        self.file.seek(offset)
        self.packed, self.ready, self.unpack = b"", bytearray(), None

    def more(self) -> bool:
        """Decompress a little; False at the end of the split."""
        if not self.packed:
            self.packed = self.file.read(min(CHUNK, self.left))
            self.left -= len(self.packed)
            if not self.packed:
                return False
        if self.unpack is None:
            self.unpack = zlib.decompressobj(31)
        self.ready += self.unpack.decompress(self.packed, CHUNK)
        self.packed = self.unpack.unconsumed_tail or self.unpack.unused_data
        if self.unpack.eof:
            self.unpack = None
        return True

    def take(self, n: int) -> bytes:
        """Up to n bytes, less only at the end."""
        while len(self.ready) < n and self.more():
            pass
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def head(self) -> dict[str, str] | None:
        """Header lines up to the next empty line."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        lines = self.take(end + 4).decode().split("\r\n")
        return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def read_records(stream: _Stream, with_payload: bool) -> Iterator[tuple]:
    while (head := stream.head()) is not None:
        kind, stated = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
        http = stream.head()
        size = int(http["content-length"])
        name = [head["warc-record-id"].strip("<>"), kind, head.get("warc-refers-to", "").strip("<>") or None, head.get("warc-target-uri")]
        if kind == "revisit":
            yield (*name, 0, True, size, stated, True, *([b""] * with_payload))
        else:
            digest, done, no = hashlib.sha256(), 0, 0
            while True:
                chunk = stream.take(min(CHUNK, size - done))
                if len(chunk) < min(CHUNK, size - done):
                    raise ValueError(f"record {name[0]} is cut off")
                done += len(chunk)
                digest.update(chunk)
                so_far, last = digest.copy().hexdigest(), done == size
                yield (*name, no, last, done, so_far, not last or so_far == stated, *([chunk] * with_payload))
                no += 1
                if last:
                    break
        stream.take(4)


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CHUNKS.split(", ")] + ["chunk"] * with_payload
    kinds = [pa.string()] * 4 + [pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * with_payload
    most = 200 if with_payload else 5000
    for batch in batches:
        for at in batch.to_pylist():
            rows = []
            for row in read_records(_Stream(at["archive"], at["offset"], at["length"]), with_payload):
                rows.append(row)
                if len(rows) == most:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_chunks(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each chunk of each record, with the number of bytes and the SHA-256 up to and with it."""
    n = max(1, manifest.count())
    schema = CHUNKS + (", chunk binary" if with_payload else "")
    return manifest.repartition(n).mapInArrow(lambda b: _read(b, with_payload), schema)


def page_records(pages: DataFrame) -> DataFrame:
    """Write pages to archives, read them back, and return a row for each record."""
    got = read_chunks(write_archives(pages), with_payload=False).where("last")
    kind = pages.schema["page_id"].dataType

    def page(c: str):
        return F.when(F.startswith(F.col(c), F.lit(ID)), F.url_decode(F.substring(F.col(c), len(ID) + 1, 1 << 30)).cast(kind))

    return got.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "digest_ok",
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, TRUE AS digest_ok
FROM d LEFT JOIN f USING (payload_digest)
"""
