"""WARC archives with a two-level capture index.

Archives hold one gzip member per record, so that a record is a range of bytes. The index sorts captures by
their reversed-host URL key (``com,example,www)/path``) and writes them as compressed blocks; a sparse directory
has the first and last key and the place of each block. A lookup finds its block in the directory, then the
captures by binary search in the block, then reads their ranges.

Files are written from the executors into the shared folder under names of their own for each task attempt, and
only rows of attempts that Spark commits refer to them; so a lost executor or a repeated task does no harm.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import parallelism, shared_dir, stash

LEAST_REVISIT = 1000
BLOCK = 1000
#: About so many captures are one task's when all are read.
CAPTURES = 20_000
ARCHIVE_BYTES = 256 << 20
ENTRY = "surt string, page_id long, archive string, offset long, length long"


def filesystem(folder: str):
    """(file system, path) of a folder as Spark names it; Spark's names of S3 are pyarrow's ``s3``."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def surt(url: str | None) -> str:
    """Key with the host reversed: ``http://www.example.com:80/a?b`` gives ``com,example,www:80)/a?b``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has no block and says which record has its payload."""
    body = b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    if len(body) != int(headers["content-length"]):
        raise ValueError("truncated WARC record")
    return headers, body


def _gzip(data: bytes, level: int = 5) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _page(urn: str | None) -> int | None:
    return int(urn.rstrip(">").rpartition(":")[2]) if urn else None


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``page_id, url, payload, sha1, refers_to`` rows as archives; one index entry per record."""

    def run(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            entries = []
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                page, url, payload, sha1, refers = (x.as_py() for x in row)
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = _gzip(record(page, url, payload, sha1, refers))
                out.write(data)
                entries.append((surt(url), page, name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries, strict=True) if entries else [[]] * 5, (
                pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["surt", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return stash(pages.mapInArrow(run, ENTRY), "captures")


def write_index(entries: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Sorts the captures by key into compressed blocks; returns the directory, one row per block.

    The page id breaks ties of the key, so that a host or URL with very many captures spreads over tasks.
    """

    def run(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, at, lines, directory = None, f"{uuid.uuid4().hex}.cdx.gz", 0, [], []

        def flush():
            nonlocal out, at
            out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
            data = _gzip("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode("utf-8", "surrogatepass"))
            out.write(data)
            directory.append((lines[0][0], lines[-1][0], name, at, len(data), len(lines)))
            at += len(data)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(row)
                if len(lines) == block:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
        if directory:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*directory, strict=True)], names=["first_key", "last_key", "file", "offset", "length", "captures"])

    order = [F.col("surt"), F.col("page_id"), F.col("archive"), F.col("offset")]
    ranged = entries.repartitionByRange(*order).sortWithinPartitions(*order).select("surt", "page_id", "archive", "offset", "length")
    return stash(ranged.mapInArrow(run, "first_key string, last_key string, file string, offset long, length long, captures long"), "directory")


def _range(fs, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


class Directory:
    """The sparse directory for look-ups: loaded once, one row for each block of ``BLOCK`` captures, and searched by bisection.

    A directory of more than ``most`` blocks stays a table, and Spark finds the blocks by the ranges of its sorted files.
    """

    def __init__(self, table: DataFrame, folder: str, most: int = 1_000_000) -> None:
        self.folder, self.table, self.blocks = folder, table, None
        if table.count() <= most:
            self.blocks = sorted(table.collect(), key=lambda b: (b["first_key"], b["last_key"]))
            self.last = [b["last_key"] for b in self.blocks]

    def find(self, key: str):
        """The blocks that may hold ``key``, in order. Both ends of blocks rise, as the captures are sorted."""
        if self.blocks is None:
            yield from self.table.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("first_key", "last_key").toLocalIterator()
            return
        i = bisect.bisect_left(self.last, key)
        while i < len(self.blocks) and self.blocks[i]["first_key"] <= key:
            yield self.blocks[i]
            i += 1

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """All records of a URL: blocks by bisection of the directory, captures by bisection of a block, then ranges of archives."""
        key, found = surt(url), []
        fs, base = filesystem(self.folder)
        for b in self.find(key):
            lines = [json.loads(x) for x in zlib.decompress(_range(fs, f"{base}/{b['file']}", b["offset"], b["length"]), 31).splitlines()]
            here = lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]
            for name in dict.fromkeys(line[2] for line in here):
                with fs.open_input_file(f"{base}/{name}") as f:
                    found += [parse(zlib.decompress(f.read_at(line[4], line[3]), 31)) for line in here if line[2] == name]
        return found


def lookup(directory: DataFrame, folder: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """All records of one URL; for many, make a :class:`Directory` once."""
    return Directory(directory, folder).lookup(url)


def read_all(directory: DataFrame, folder: str) -> DataFrame:
    """Every record through the index: blocks go to tasks, each reads its captures' ranges in archive order.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``; responses are hashed anew, and a digest
    that differs from the record's header is an error.
    """

    def run(batches):
        fs, base = filesystem(folder)
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                lines = [json.loads(x) for x in zlib.decompress(_range(fs, f"{base}/{file}", offset, length), 31).splitlines()]
                rows, name, archive = [], None, None
                for line in sorted(lines, key=lambda x: x[2:4]):
                    if line[2] != name:
                        if archive is not None:
                            archive.close()
                        name, archive = line[2], fs.open_input_file(f"{base}/{line[2]}")
                    head, body = parse(zlib.decompress(archive.read_at(line[4], line[3]), 31))
                    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"digest of {head.get('warc-record-id')} differs")
                    rows.append((_page(head.get("warc-record-id")), int(head["warc-payload-length"]), digest, kind, _page(head.get("warc-refers-to"))))
                if archive is not None:
                    archive.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                    pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # a row stands for many captures, so the number of tasks comes from these, not from the rows' bytes
    captures = directory.agg(F.sum("captures")).collect()[0][0] or 0
    parts = max(1, min(directory.count(), max(parallelism(directory.sparkSession), captures // CAPTURES)))
    spread = directory.select("file", "offset", "length").repartition(parts, F.col("file"), F.col("offset"))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT):
    """Writes archives and index of ``pages``; returns (directory, folder).

    Of records with equal payloads of at least ``least`` bytes, that with the largest id is the response and the
    others revisit it; smaller ones are all responses. A null payload is empty. Null ids are less than any id; a
    group without any id is all responses, as nothing can be referred to; repeated rows of the response are
    responses too. An empty table gives an empty directory. Other columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digest = F.sha2("payload", 256).alias("sha2")
    same = rows.where(F.octet_length("payload") >= least).groupBy(digest).agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    same = stash(same.where("n > 1 and last is not null").select("sha2", "last"), "same")
    joined = rows.withColumn("sha2", digest).join(same, "sha2", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    entries = write_archives(joined.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), refers), folder)
    return write_index(entries, folder), folder


def op3_warc(spark, sf_dir: str) -> DataFrame:
    return read_all(*archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM g)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM r
"""
