"""Web archives with an index that comes first.

A record per page goes to WARC 1.1 files, each record a gzip member of its own. While a
file is written, every record's offset, length, URL and digest are noted: this
index is the commit record of the archive. A file's name has a token of the attempt that
wrote it, and only files the index names are ever read, so an attempt that is lost
leaves nothing but a file nobody looks at. Reading begins with the index: records are selected there,
and their byte ranges, sorted and coalesced, are read from each file.

Files lie in a folder every executor reaches, by a path that ``pyarrow.fs`` opens
(a local or mounted folder, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm import common

INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()),
                   ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
INDEX_DDL = "file string, offset long, length long, url string, payload_digest string, page_id long, record_type string, refers_to long"
RECORD_DDL = "page_id long, record_type string, refers_to long, url string, digest string, payload binary"
FILE_BYTES = 1 << 28
RANGE_BYTES, GAP_BYTES = 1 << 23, 1 << 16
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. A revisit has the HTTP head alone; header values cannot hold line ends."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_name(page_id, digest)), ("WARC-Date", date),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))).replace("%", ""))))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; the block's length is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if not first.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:n]


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _write(folder: str, date: str, file_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        out, name, offset = None, "", 0
        for part, payloads in common.chunks(batches, "html"):
            rows = []
            for page, url, digest, refers_to, payload in zip(*(part.column(i).to_pylist() for i in (0, 1, 3, 4)), payloads):
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                raw = record(page, url, payload, digest, refers_to, date)
                squeezer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = squeezer.compress(raw) + squeezer.flush()
                out.write(data)
                rows.append((name, offset, len(data), url, digest, page, "response" if refers_to is None else "revisit", refers_to))
                offset += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), INDEX)], schema=INDEX)
        if out is not None:
            out.close()

    return run


def write_archive(pages: DataFrame, folder: str, least: int = 1000, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages(page_id, url, html)`` and return the index, written beside the files.

    Of pages with equal payloads of at least ``least`` bytes the one with the
    largest page_id is a response, and so is any repeated row of it; the others are revisits that refer to it. All other
    pages are responses. A null html is empty, a null url has no target, a null page_id is a
    response and never referred to. Other columns are not looked at. An empty table gives an empty index.
    """
    keyed = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "digest", F.sha1(F.col("html").cast("binary")))
    slim = keyed.where(F.octet_length("html") >= least).select("page_id", "digest")
    whole = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1").drop("k")
    revisits = slim.join(whole, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    rows = keyed.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    rows.mapInArrow(_write(folder, date, file_bytes), INDEX_DDL).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def coalesced(offsets: np.ndarray, lengths: np.ndarray, most: int = RANGE_BYTES, gap: int = GAP_BYTES) -> list[tuple[int, int, int, int]]:
    """``(first record, end record, offset, bytes)`` of the ranges that cover sorted records; small gaps are read over, a range stays near ``most`` bytes."""
    out: list[tuple[int, int, int, int]] = []
    start = 0
    for k in range(1, len(offsets) + 1):
        end = int(offsets[k - 1] + lengths[k - 1])
        if k == len(offsets) or offsets[k] - end > gap or offsets[k] + lengths[k] - offsets[start] > most:
            out.append((start, k, int(offsets[start]), end - int(offsets[start])))
            start = k
    return out


def _read(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                        ("digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        name, source = "", None
        for batch in batches:
            files = batch.column(0).to_pylist()
            offsets, lengths = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)] if files else []
            for a, b in zip(first[:-1], first[1:]):
                if files[a] != name:
                    if source is not None:
                        source.close()
                    name, source = files[a], system.open_input_file(f"{path}/{files[a]}")
                for i, j, at, n in coalesced(offsets[a:b], lengths[a:b]):
                    data = source.read_at(n, at)
                    rows = []
                    for k in range(a + i, a + j):
                        fields, block = parsed(zlib.decompress(data[offsets[k] - at:offsets[k] - at + lengths[k]], 31))
                        revisit = fields["WARC-Type"] == "revisit"
                        said = fields.get("X-Page-ID")
                        rows.append((None if said is None else int(said), fields["WARC-Type"], int(fields["X-Refers-To-Page-ID"]) if revisit else None,
                                     fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                                     None if revisit else block.partition(b"\r\n\r\n")[2]))
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
        if source is not None:
            source.close()

    return run


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """``(page_id, record_type, refers_to, url, digest, payload)`` of the records that rows of the index select; a revisit's payload is null.

    Rows are dealt by ranges of file and offset, so that a large file is read by several tasks.
    """
    rows = selected.select("file", "offset", "length")
    return rows.repartitionByRange(common.partitions(selected), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_read(folder), RECORD_DDL)


