"""WARC records as a chunked table.

An archive is a table of (archive, record_id, chunk, data): chunk 0 has a record's header, the
others slices of its payload, the last one the closing line ends. Sorted by record and chunk, the
data column of an archive is a valid WARC/1.1 file. Writer and reader hold one chunk at a time:
digests are carried from chunk to chunk, a record is never put together in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Payloads under this many bytes are always written whole.
REVISIT_FROM = 100
END = b"\r\n\r\n"
_ORDER = ["archive", "record_id", "chunk"]


def header(record_id: str, kind: str, url: str, digest: str, length: int, refers_to: int | None, page_id: int | None) -> bytes:
    """A record's header; a revisit has no block of its own, its payload's length is kept beside."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(c for c in url if c not in chr(13) + chr(10))}", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {length}", "Content-Type: text/html", f"Content-Length: {length if kind == 'response' else 0}",
    ]
    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] * (kind == "revisit")
    lines += [f"X-Page-ID: {page_id}"] * (page_id is not None) + [f"X-Refers-To-Page-ID: {refers_to}"] * (refers_to is not None)
    return "\r\n".join(lines).encode() + END


def chunks(payload: memoryview, size: int) -> Iterator[memoryview]:
    for a in range(0, len(payload), size):
        yield payload[a : a + size]


#: Bytes of chunks that a writer holds, and what a row counts besides its data: headers, revisits and empty payloads count too.
_FLUSH, _ROW_BYTES = 8 << 20, 256


def _write_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def table():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.binary()))], [*_ORDER, "data"])

        for batch in batches:
            at = {n: batch.column(n) for n in batch.schema.names}
            html = at["t"].cast(pa.large_binary())
            for i in range(batch.num_rows):
                value = html[i].as_buffer()
                payload = memoryview(value) if value is not None else memoryview(b"")
                kind = "response" if at["refers_to"][i].as_py() is None else "revisit"
                record, archive = at["record_id"][i].as_py(), at["archive"][i].as_py()
                rows.append((archive, record, 0, header(record, kind, at["url"][i].as_py() or "", at["digest"][i].as_py(), len(payload), at["refers_to"][i].as_py(), at["page_id"][i].as_py())))
                held += len(rows[-1][3]) + _ROW_BYTES
                n = 1
                for part in chunks(payload, size) if kind == "response" else ():
                    rows.append((archive, record, n, bytes(part)))
                    held += len(part) + _ROW_BYTES
                    n += 1
                    if held > _FLUSH:
                        yield table()
                        rows, held = [], 0
                rows.append((archive, record, n, END))
                held += len(END) + _ROW_BYTES
                if held > _FLUSH:
                    yield table()
                    rows, held = [], 0
        if rows:
            yield table()

    return run


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_bytes: int = 1 << 20, archives: int = 64) -> DataFrame:
    """The chunk table of all pages, written to the shared folder.

    Null html is an empty payload, a null url an empty address. Of records with equal payloads of at
    least REVISIT_FROM bytes, those with the smallest page_id are responses (several if that id is
    repeated), the others revisit it; rows without id are responses. Only digests are grouped, so
    a payload shared by a third of all pages moves no payload at all; the digests that occur under
    several ids are joined back.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("t"))
    rows = rows.withColumn("digest", F.sha2(F.col("t").cast("binary"), 256))
    first = rows.where(F.octet_length("t") >= REVISIT_FROM).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("d", "first")
    rows = rows.join(stored(first, "warc-shared"), (F.col("digest") == F.col("d")), "left")
    again = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    # The id tells repeated rows apart; it is fixed once the table is written, nothing is joined on it before.
    unique = F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), "digest", F.spark_partition_id().cast("string"), F.monotonically_increasing_id().cast("string")), 256)
    uuid = F.concat_ws("-", *(F.substring(unique, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    rows = rows.select("page_id", "url", "t", "digest", again.alias("refers_to"), uuid.alias("record_id")).withColumn("archive", F.pmod(F.xxhash64("record_id"), F.lit(archives)).cast("int"))
    return stored(rows.mapInArrow(_write_batches(chunk_bytes), "archive int, record_id string, chunk long, data binary"), "warc")


def records(rows: Iterable[tuple[str, int, bytes]]) -> Iterator[tuple[dict[str, str], int, str]]:
    """Headers, payload bytes and payload digest of each record, from chunks sorted by record and number; one chunk is held at a time. A gap, a missing end or a wrong length raises ValueError."""
    head: dict[str, str] | None = None
    own, want, due, size, sha = "", 0, 0, 0, hashlib.sha256()
    for record, n, data in rows:
        if head is None:
            if n or not data.startswith(b"WARC/1.1\r\n") or not data.endswith(END):
                raise ValueError(f"record {record} has no header")
            head = dict(line.split(": ", 1) for line in data[:-4].decode().split("\r\n")[1:])
            own, want, due, size, sha = record, 1, int(head["Content-Length"]), 0, hashlib.sha256()
            continue
        if record != own or n != want:
            raise ValueError(f"record {own} ends early")
        if size < due:
            size += len(data)
            sha.update(data)
            want += 1
            if size > due:
                raise ValueError(f"record {own} is longer than it says")
        else:
            if data != END:
                raise ValueError(f"record {own} has no end")
            yield head, size, sha.hexdigest()
            head = None
    if head is not None:
        raise ValueError(f"record {own} ends early")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            record, chunk, data = (b.column(n) for n in ("record_id", "chunk", "data"))
            for i in range(b.num_rows):
                yield record[i].as_py(), chunk[i].as_py(), data[i].as_py()

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    out: list[tuple] = []
    table = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
    for head, size, digest in records(rows()):
        said = head["WARC-Payload-Digest"].removeprefix("sha256:")
        response = head["WARC-Type"] == "response"
        if response and said != digest:
            raise ValueError(f"{head['WARC-Record-ID']}: the payload does not have its digest")
        number = lambda k: int(head[k]) if k in head else None  # noqa: E731, B023
        out.append((number("X-Page-ID"), head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest if response else said, head["WARC-Type"], number("X-Refers-To-Page-ID")))
        if len(out) >= 4096:
            yield table()
            out = []
    if out:
        yield table()


def read(archived: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of a chunk table; payload digests are computed anew and checked."""
    ordered = archived.repartition("archive", "record_id").sortWithinPartitions(*_ORDER)
    return ordered.mapInArrow(_read_batches, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_file(archived: DataFrame, number: int) -> Iterator[bytes]:
    """The bytes of one archive as a WARC file, piece by piece."""
    for r in archived.where(F.col("archive") == number).orderBy(*_ORDER).select("data").toLocalIterator():
        yield bytes(r["data"])


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Query: archive all pages, read the archives back."""
    return read(archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
     f AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.m < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.m < p.page_id THEN f.m END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
