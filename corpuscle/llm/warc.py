"""WARC archives with a two-level capture index.

Each task writes the records of its rows to an archive file of its own in the shared
folder, one gzip member a record, and returns one capture line a record. The lines
are sorted by reversed-host URL key over ranges; each range becomes a file of
compressed blocks and a sparse directory of the blocks' first keys. A look-up
bisects the ranges, then that range's directory, reads and searches one block, and
then reads just the record's bytes. File names are unique to a task attempt and
only those in the committed table of lines are ever read, so a lost or repeated
task leaves unused files at worst.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.words import batches
from corpuscle.util import fresh_path, pin, table

LEAST_PAYLOAD, BLOCK_LINES, DATE = 100, 2000, "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LOWEST = -(1 << 63)


def surt(url: Column) -> Column:
    """A URL's sort key: host labels reversed, then the rest; empty for null."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", ""))


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int, str] | None) -> bytes:
    """One WARC record, not compressed; refers makes it a revisit of that page and URL key."""
    block = HTTP if refers else HTTP + payload
    head = {"WARC-Type": "revisit" if refers else "response", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    if refers:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers[0]}>", "X-Refers-To-Key": json.dumps(refers[1])}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    head = dict(x.decode("utf-8", "surrogatepass").split(": ", 1) for x in top.split(b"\r\n")[1:])
    return head, rest[: int(head["Content-Length"])].partition(b"\r\n\r\n")[2]


def _page(field: str) -> int | None:
    n = field.removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


LINE = "surt string, page_id long, file string, offset long, length long"


def _write(folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches(it):
            lines = []
            for page_id, url, key, html, digest, refers_to, refers_key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, base = _fs(folder)
                    fs.create_dir(base)
                    name, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(_fs(name)[1], compression=None)  # records are members already
                payload = (html or "").encode("utf-8", "surrogatepass")
                data = gzip.compress(record(page_id, url, payload, digest, None if refers_to is None else (refers_to, refers_key)), 3, mtime=0)
                out.write(data)
                lines.append((key, page_id, name, offset, len(data)))
                offset += len(data)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["surt", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


RANGE = "first_surt string, first_page long, blocks string, directory string, n long"


def _index(folder: str, block_lines: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, directory, offset, n = None, [], [], 0, 0

        def flush() -> None:
            nonlocal offset
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            out.write(data)
            directory.append((held[0][0], held[0][1], offset, len(data)))
            offset += len(data)
            held.clear()

        for batch in it:
            for key, page_id, file, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, base = _fs(folder)
                    fs.create_dir(base)
                    name = f"{folder}/{uuid.uuid4().hex}"
                    out = fs.open_output_stream(_fs(f"{name}.blocks")[1])
                held.append((key, LOWEST if page_id is None else page_id, file, at, length))
                n += 1
                if len(held) >= block_lines:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            with fs.open_output_stream(_fs(f"{name}.directory")[1]) as d:
                d.write(zlib.compress(json.dumps(directory).encode(), 6))
            yield pa.record_batch([pa.array([x], t) for x, t in ((directory[0][0], pa.string()), (directory[0][1], pa.int64()), (f"{name}.blocks", pa.string()), (f"{name}.directory", pa.string()), (n, pa.int64()))], ["first_surt", "first_page", "blocks", "directory", "n"])

    return run


class Index:
    """Look-ups in the ranges [(first key, first page, blocks file, directory file)], sorted."""

    def __init__(self, ranges: list[tuple[str, int, str, str]], most: int = 64) -> None:
        self.ranges, self.firsts, self.most = ranges, [r[:2] for r in ranges], most
        self.directories: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()

    def _kept(self, cache: OrderedDict, key, make):
        if key not in cache:
            cache[key] = make()
            if len(cache) > self.most:
                cache.popitem(last=False)
        cache.move_to_end(key)
        return cache[key]

    def find(self, key: str, page_id: int) -> tuple[str, int, int] | None:
        """(file, offset, length) of a capture."""
        at = bisect.bisect_right(self.firsts, (key, page_id)) - 1
        if at < 0:
            return None
        _, _, blocks, directory = self.ranges[at]
        rows = self._kept(self.directories, directory, lambda: [tuple(x) for x in json.loads(zlib.decompress(read(directory)))])
        _, _, offset, length = rows[bisect.bisect_right(rows, (key, page_id, 1 << 62)) - 1]
        lines = self._kept(self.blocks, (blocks, offset), lambda: [tuple(x) for x in json.loads(b"[" + zlib.decompress(read(blocks, offset, length)).replace(b"\n", b",") + b"]")])
        i = bisect.bisect_left(lines, (key, page_id))
        return lines[i][2:] if i < len(lines) and lines[i][:2] == (key, page_id) else None


def read(path: str, offset: int = 0, length: int | None = None) -> bytes:
    """A range of a file's bytes; the whole file without a length."""
    fs, at = _fs(path)
    with fs.open_input_file(at) as f:
        return f.read_at(f.size() if length is None else length, offset)


def records(path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive file one by one; memory holds a chunk and a record."""
    fs, at = _fs(path)
    with fs.open_input_stream(at, compression=None) as f:
        member, parts, data = zlib.decompressobj(31), [], f.read(chunk)
        while data:
            parts.append(member.decompress(data))
            if member.eof:
                yield b"".join(parts)
                data, member, parts = member.unused_data, zlib.decompressobj(31), []
                data = data or f.read(chunk)
            else:
                data = f.read(chunk)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(ranges: list[tuple[str, int, str, str]]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sizes = Index(ranges), {}

        def original(key: str, page_id: int) -> tuple[int, str]:
            if page_id not in sizes:
                if len(sizes) > 100_000:
                    sizes.clear()
                found = index.find(key, page_id)
                if found is None:
                    raise ValueError(f"page {page_id} is not in the index")
                payload = parse(gzip.decompress(read(*found)))[1]
                sizes[page_id] = len(payload), hashlib.sha256(payload).hexdigest()
            return sizes[page_id]

        for batch in it:
            for path in batch.column(0).to_pylist():
                rows = []
                for data in records(path):
                    head, payload = parse(data)
                    stated, kind, refers = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"], None
                    n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if kind == "revisit":
                        refers = _page(head["WARC-Refers-To"])
                        n, digest = original(json.loads(head["X-Refers-To-Key"]), refers)
                    if digest != stated:
                        raise ValueError(f"{path}: payload of {head['WARC-Record-ID']} does not match its digest")
                    rows.append((_page(head["WARC-Record-ID"]), n, digest, kind, refers))
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])


def write_archives(pages: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """The capture lines (surt, page_id, file, offset, length) of archives written for (page_id, url, html).

    Of equal payloads of least_payload bytes or more the smallest page_id is the
    response and larger ones revisit it; a row without page_id is a response. Null
    html is an empty payload, a null URL sorts first; repeated rows are all written.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    facts = pages.select("page_id", surt(F.col("url")).alias("surt"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"))
    facts = pin(facts.where(F.col("page_id").isNotNull() & (F.col("n") >= least_payload)).select("page_id", "surt", "digest"), "payloads")
    first = facts.groupBy("digest").agg(F.min(F.struct("page_id", "surt")).alias("o"), F.max("page_id").alias("last")).where("o.page_id < last").select("digest", "o")
    revisits = facts.join(first, "digest").where("page_id > o.page_id").select("page_id", "digest", F.col("o.page_id").alias("refers_to"), F.col("o.surt").alias("refers_key"))
    revisits = pin(revisits.distinct(), "revisits")
    rows = pages.select("page_id", "url", surt(F.col("url")).alias("surt"), F.col("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "surt", "html", "digest", "refers_to", "refers_key")
    return pin(rows.mapInArrow(_write(fresh_path(spark, "warc")), LINE), "captures")


def write_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> list[tuple[str, int, str, str]]:
    """The ranges of a two-level index over the captures: one entry a partition, which bounds what the driver holds."""
    spark = captures.sparkSession
    order = captures.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
    ranges = pin(order.mapInArrow(_index(fresh_path(spark, "cdx"), block_lines), RANGE), "ranges")
    return sorted((r.first_surt, LOWEST if r.first_page is None else r.first_page, r.blocks, r.directory) for r in ranges.collect())


def read_archives(captures: DataFrame, ranges: list[tuple[str, int, str, str]]) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read from the archives.

    Whole payloads are hashed; a revisit's is read from the record that the index finds.
    """
    files = captures.groupBy("file").agg(F.count("*").alias("n")).select("file")
    return files.repartition(max(files.count(), 1), "file").mapInArrow(_read(ranges), READ)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    captures = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_archives(captures, write_index(captures))


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM q
"""
