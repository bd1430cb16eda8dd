"""Web archives with a two-level capture index: sorted compressed blocks and a sparse directory of them."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubframe.llm.common import join_counted, shared_folder, stored

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 256 << 20
DIRECTORY_ROWS = 100_000
BLOCK_ROWS = 3000
DATE = "2024-01-01T00:00:00Z"
DIRECTORY = "first_key string, first_page bigint, last_key string, last_page bigint, file string, offset bigint, length bigint, n bigint"


def url_key(url: str | None) -> str:
    """The host reversed by labels with commas, then ``)`` and path with query in lower case; empty for no URL."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host.rstrip("."))
    port_part = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{port_part}){(parts.path or '/').lower()}{'?' + parts.query.lower() if parts.query else ''}"


def _keys(urls: pa.Array) -> list[str]:
    return [url_key(u) for u in urls.to_pylist()]


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def with_keys(pages: DataFrame) -> DataFrame:
    """Add ``url_key`` to page_id, url and html."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_keys(batch.column("url")), pa.string())], [*batch.schema.names, "url_key"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(run, f"{names}, url_key string")


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Add payload_bytes, digest (SHA-1) and refers_to: of payloads equal by length, SHA-1 and SHA-256 and at least ``least``
    bytes long the largest page_id is the response, all others refer to it."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("bigint"), "digest": F.sha1(payload)})
    rows = rows.withColumn("same", F.when(F.col("payload_bytes") >= least, F.concat_ws(":", "digest", F.sha2(payload, 256))))
    groups = rows.where("same is not null").groupBy("same").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = stored(groups, "warc-groups")
    joined = join_counted(rows, groups, "same", "copies")
    return joined.withColumn("refers_to", F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))).drop("same", "top", "copies")


def record(page_id: int | None, url: str | None, html: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own."""
    payload = b"" if refers_to is not None else (html or "").encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {json.dumps(url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    raw = "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


class _Writer:
    """Writes the records and index blocks of one task to new files; only files of a finished task are in the directory."""

    def __init__(self, root: str, block_rows: int, most: int) -> None:
        self.files, self.base = _filesystem(root)
        self.files.create_dir(self.base, recursive=True)
        self.block_rows, self.most = block_rows, most
        self.stem, self.no, self.archive, self.index = uuid.uuid4().hex, 0, None, None
        self.lines: list[tuple] = []
        self.at = self.index_at = 0
        self.done: list[tuple] = []

    def add(self, key: str, page_id: int | None, member: bytes) -> None:
        if self.archive is None or self.at > self.most:
            if self.archive is not None:
                self.archive.close()
            self.name, self.at = f"{self.stem}-{self.no}.warc.gz", 0
            self.no += 1
            self.archive = self.files.open_output_stream(f"{self.base}/{self.name}", compression=None)
        self.archive.write(member)
        self.lines.append((key, page_id, self.name, self.at, len(member)))
        self.at += len(member)
        if len(self.lines) >= self.block_rows:
            self.end_block()

    def end_block(self) -> None:
        if not self.lines:
            return
        if self.index is None:
            self.index = self.files.open_output_stream(f"{self.base}/{self.stem}.idx")
        block = zlib.compress("\n".join(json.dumps(line) for line in self.lines).encode(), 6)
        self.index.write(block)
        self.done.append((*self.lines[0][:2], *self.lines[-1][:2], f"{self.stem}.idx", self.index_at, len(block), len(self.lines)))
        self.index_at += len(block)
        self.lines = []

    def close(self) -> list[tuple]:
        self.end_block()
        for stream in (self.archive, self.index):
            if stream is not None:
                stream.close()
        return self.done


def write_archive(pages: DataFrame, root: str, block_rows: int | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages as archives with their index below ``root`` (a folder every executor reaches); returns the directory.

    Rows are range-partitioned by (url_key, page_id), so an URL or host may hold any share of them, and each task writes
    the archives and sorted index blocks of its range. The directory has a row per block; blocks grow with the input so
    that it stays below ``DIRECTORY_ROWS`` rows plus one per task. It is stored at once: a task that runs again writes new
    files, and what a lost attempt left is in no directory.
    """
    rows = with_keys(pages.select("page_id", "url", "html"))
    flagged = revisits(rows)
    n = pages.count()
    size = block_rows or max(BLOCK_ROWS, -(-n // DIRECTORY_ROWS))
    ordered = flagged.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id", "payload_bytes", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("url_key", "page_id", "url", "html", "payload_bytes", "digest", "refers_to"))
            for key, page_id, *rest in zip(*columns, strict=True):
                writer = writer or _Writer(root, size, archive_bytes)
                writer.add(key, page_id, record(page_id, *rest))
        if writer is not None:
            columns = list(zip(*writer.close(), strict=True))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["first_key", "first_page", "last_key", "last_page", "file", "offset", "length", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return stored(ordered.mapInArrow(run, DIRECTORY), "warc-directory")


def _rank(page_id: int | None) -> int:
    return -(1 << 63) if page_id is None else page_id


def _order() -> list[Column]:
    return [F.col("first_key"), F.col("first_page").asc_nulls_first(), F.col("last_key"), F.col("last_page").asc_nulls_first(), F.col("file"), F.col("offset")]


def lookup(directory: DataFrame, wanted: DataFrame, root: str) -> DataFrame:
    """Captures of the wanted (url, page_id), each read from its archive.

    The directory (of bounded size, see ``write_archive``) is sorted and sent to the tasks. A wanted capture is found by
    binary search in it; the wanted rows of a block then meet in one task, which reads and unpacks that block once, binary-
    searches it and reads the byte ranges of the records, neighbours at one go. Wanted rows are taken once each; a page
    stored twice comes back twice, one that is not stored does not come back.
    """
    spark = directory.sparkSession
    blocks = [tuple(r) for r in directory.orderBy(*_order()).collect()]
    shared = spark.sparkContext.broadcast(blocks)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lasts = [(b[2], _rank(b[3])) for b in shared.value]
        firsts = [(b[0], _rank(b[1])) for b in shared.value]
        for batch in batches:
            out = []
            for key, page_id in zip(_keys(batch.column("url")), batch.column("page_id").to_pylist(), strict=True):
                at = bisect_left(lasts, (key, _rank(page_id)))
                while at < len(firsts) and firsts[at] <= (key, _rank(page_id)):
                    out.append((at, key, page_id))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))],
                                             ["block", "url_key", "page_id"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(root)
        now, lines, keys = None, [], []
        for batch in batches:
            spans = []
            for block, key, page_id in zip(*(batch.column(c).to_pylist() for c in ("block", "url_key", "page_id")), strict=True):
                if block != now:
                    _, _, _, _, name, offset, length, _ = shared.value[block]
                    with files.open_input_file(f"{base}/{name}") as f:
                        lines = [json.loads(x) for x in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]
                    now, keys = block, [(x[0], _rank(x[1])) for x in lines]
                at = bisect_left(keys, (key, _rank(page_id)))
                while at < len(keys) and keys[at] == (key, _rank(page_id)):
                    spans.append((*lines[at][2:], page_id))
                    at += 1
            yield from _read_spans(files, base, spans)

    found = wanted.select("url", F.col("page_id").cast("bigint")).distinct().mapInArrow(route, "block bigint, url_key string, page_id bigint").distinct()
    placed = found.repartition("block").sortWithinPartitions("block", "url_key", "page_id")
    return placed.mapInArrow(fetch, "page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def _read_spans(files: fs.FileSystem, base: str, spans: list[tuple], at_once: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Read records by byte range; ranges that follow each other in a file are read together, up to ``at_once`` bytes."""
    spans.sort()
    k = 0
    while k < len(spans):
        name, low = spans[k][0], spans[k][1]
        end, high = k, low
        while end < len(spans) and spans[end][0] == name and spans[end][1] == high and (end == k or high - low < at_once):
            high += spans[end][2]
            end += 1
        with files.open_input_file(f"{base}/{name}") as f:
            data = f.read_at(high - low, low)
        rows = []
        for _, offset, length, page_id in spans[k:end]:
            fields, payload = parse_record(data[offset - low:offset - low + length])
            refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if refers is None and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"page {page_id}: payload and digest differ")
            rows.append((page_id, fields["WARC-Type"], int(fields["X-Payload-Length"]), digest, int(refers.group(1)) if refers else None, payload))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        k = end


def archived(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write all pages to archives and read every one of them back through the index.

    Columns: page_id, record_type, payload_bytes and payload_digest (of the full payload, also for a revisit), refers_to
    and payload (empty for a revisit). Null html is an empty payload, a null url has the empty key, a null page_id sorts
    first and is found as such. Rows repeated in full give as many records; several rows with the largest page_id of equal
    payloads are all responses. An empty table writes nothing. Other columns are ignored.
    """
    root = root or shared_folder(pages.sparkSession, "warc")
    return lookup(write_archive(pages, root), pages, root)
