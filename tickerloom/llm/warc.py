"""WARC archives with a two-level capture index.

*Archives.* Every record is one gzip member, written by Spark's text writer: the member's bytes are
the row, and the line separator is an empty gzip member, so each part file is a plain ``.warc.gz``
stream that any reader of concatenated members can read, on any store that Spark can reach.

*Index.* A capture's key is its URL with the host reversed, then its page id. Keys are sorted by a
range shuffle and packed into compressed blocks of ``BLOCK`` entries (file, offset, length); the
first key of each block is the sparse directory. A look-up bisects the directory, decompresses one
block, bisects it, gets the record's place, and reads that byte range of the archive; ranges that
lie side by side are read at once. Ranges are read through Arrow's file systems (local and mounted
folders, S3, GCS, HDFS). In a store that these do not reach, only the archive files asked for are
loaded, whole, by Spark's reader.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, project, string_column, work_path, writing
from .components import salted

#: Payloads under this many bytes are always stored whole.
MIN_REVISIT = 100
#: Entries in a block of the index.
BLOCK = 256
#: Records in one archive file, and bytes after which the next one begins: they bound what a task holds.
FILE_RECORDS = 2000
FILE_BYTES = 32 << 20
#: Bytes that are read in vain rather than by another read, and bytes of one read.
GAP = 1 << 14
READ_BYTES = 4 << 20
#: Archive files that are named to Spark's reader one by one.
NAMED_FILES = 1000
CAPTURED = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_EMPTY = _member(b"")
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    h = hashlib.sha256(f"page:{page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def field_url(url: str) -> str:
    """A URL as a header field holds it: on one line, without blanks around it."""
    return url.replace("\r", "%0D").replace("\n", "%0A").strip(" \t")


def make_record(page_id: int | None, url: str | None, html: str, digest: str, first: int | None) -> bytes:
    """One WARC/1.1 record: a response with an HTTP head, or a revisit that refers to page ``first``."""
    payload = html.encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        fields.insert(4, "WARC-Target-URI: " + field_url(url))
    if page_id is not None:
        fields.append(f"X-Page-Id: {page_id}")
    if first is not None:
        fields += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page: {first}"]
    return "\r\n".join(fields).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one record; a revisit's payload is empty."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def members(data: bytes, window: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each non-empty gzip member."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpacker, start, parts = zlib.decompressobj(31), at, []
        while not unpacker.eof:
            part = view[at : at + window]
            if not len(part):
                raise ValueError("an archive ends inside a record")
            parts.append(unpacker.decompress(part))
            at += len(part) - len(unpacker.unused_data)
        content = b"".join(parts)
        if content:
            yield start, at - start, content


def host_key(url: str | None) -> str:
    """The URL with its host's labels reversed, without scheme: ``com,example)/path?query``."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return f"){url}"
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + path


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sort key of a capture; control characters, which would break a block's lines, are replaced."""
    host = "".join(c if c >= " " else "%" for c in host_key(None if url is None else field_url(url)))
    return f"{host}\t" + ("" if page_id is None else f"{page_id + (1 << 63):020d}")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one record per page; pages are rows of page_id, url, html.

    Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest
    page_id is a response and those with a larger one revisit it. A null html is an empty payload,
    a null url leaves the field out, a null page_id is always a response, repeated rows are each
    written. Only (page_id, digest) pairs meet in the join by digest, a payload's pages in several parts;
    the texts move once, by page_id. A file ends after ``FILE_RECORDS`` records or ``FILE_BYTES`` bytes.
    """
    bounded_batches(pages.sparkSession)
    rows = project(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    keys = rows.where((F.octet_length("html") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    revisits = salted(keys, firsts, ["digest"], "page_id").where("page_id > first").dropDuplicates(["page_id", "digest"])
    joined = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "first")

    def run(batches):
        size = 0
        for batch in batches:
            records, chunks = [], []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records.append(_member(make_record(*values)))
                chunks.append(size // FILE_BYTES)
                size += len(records[-1])
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()), pa.array(chunks, pa.int64())], names=["record", "chunk"])

    packed = joined.mapInArrow(run, "record binary, chunk long").select(F.col("record").cast("string").alias("value"), "chunk")
    writer = packed.write.mode("overwrite").options(**writing(path)).partitionBy("chunk").option("maxRecordsPerFile", FILE_RECORDS)
    writer.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("latin-1")).text(path)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0")


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _listed(spark, path).select(F.col("path").alias("file"), "content")


def write_index(spark: SparkSession, archives: str, path: str) -> None:
    """Scan the archives once and write the sorted, compressed blocks, each with its first key."""
    bounded_batches(spark)

    def scan(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = []
                for offset, length, record in members(content.as_buffer()):
                    fields, _ = parse_record(record)
                    page = fields.get("x-page-id")
                    found.append((capture_key(fields.get("warc-target-uri"), None if page is None else int(page)), file, offset, length))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])

    entries = _files(spark, archives).mapInArrow(scan, "key string, file string, offset long, length long")
    ordered = entries.repartitionByRange("key").sortWithinPartitions("key", "file", "offset")

    def pack(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), []

        def block(rows):
            data = zlib.compress("\n".join(f"{k}\x1f{f}\x1f{o}\x1f{n}" for k, f, o, n in rows).encode(), 6)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([rows[0][0]]), pa.array([len(rows)], pa.int64()), pa.array([data], pa.binary())], names=["part", "first_key", "n", "block"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield block(held)

    ordered.mapInArrow(pack, "part long, first_key string, n long, block binary").write.mode("overwrite").options(**writing(path)).parquet(path)


class Directory:
    """Blocks of one part of the index, found through their first keys."""

    def __init__(self, blocks: list[tuple[str, bytes]]):
        self.blocks = sorted(blocks)
        self.firsts = [b[0] for b in self.blocks]
        self._open: tuple[int, list[str], list[tuple[str, int, int]]] = (-1, [], [])

    def _block(self, i: int):
        if self._open[0] != i:
            rows = [line.split("\x1f") for line in zlib.decompress(self.blocks[i][1]).decode().split("\n")]
            self._open = (i, [r[0] for r in rows], [(r[1], int(r[2]), int(r[3])) for r in rows])
        return self._open[1:]

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """File, offset and length of every capture with this key."""
        found, i = [], max(bisect_left(self.firsts, key) - 1, 0)
        while i < len(self.blocks) and self.firsts[i] <= key:
            keys, places = self._block(i)
            found += places[bisect_left(keys, key) : bisect_right(keys, key)]
            i += 1
        return found


def locate(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Places (file, offset, length) of the captures with the keys of ``wanted`` (column key).

    Both sides meet by part of the key range, whose bounds (one key for each part) the driver reads.
    Equal keys never straddle parts: a range shuffle sends them to one.
    """
    bounds = sorted((r.key, r.part) for r in index.groupBy("part").agg(F.min("first_key").alias("key")).collect())
    firsts, parts = [b[0] for b in bounds], [b[1] for b in bounds]

    def assign(batches):
        for batch in batches:
            keys = string_column(batch.column(0))
            at = [parts[max(bisect_right(firsts, k) - 1, 0)] if parts else -1 for k in keys.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), keys], names=["part", "key"])

    def search(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        directory = Directory(list(zip(blocks["first_key"].to_pylist(), blocks["block"].to_pylist(), strict=True)))
        found = [place for key in sorted(queries["key"].to_pylist()) for place in directory.find(key)]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"file": pa.array(columns[0], pa.string()), "offset": pa.array(columns[1], pa.int64()), "length": pa.array(columns[2], pa.int64())})

    dealt = wanted.select("key").distinct().mapInArrow(assign, "part long, key string")
    return dealt.groupBy("part").cogroup(index.select("part", "first_key", "block").groupBy("part")).applyInArrow(search, "file string, offset long, length long")


def range_uri(file: str) -> str:
    """An address as Arrow's file systems know it."""
    return re.sub("^s3[an]:", "s3:", re.sub("^file:/(?!//)/*", "file:///", file))


def reads_ranges(file: str) -> bool:
    """Whether Arrow's file systems reach a file's store."""
    try:
        store, path = fs.FileSystem.from_uri(range_uri(file))
        return store.get_file_info(path).type == fs.FileType.File
    except (pa.ArrowException, OSError, ValueError):
        return False


def read_ranges(file, places: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes at each (offset, length), ascending, of an open file; neighbouring places share a read."""
    low = 0
    while low < len(places):
        high, begin = low + 1, places[low][0]
        end = begin + places[low][1]
        while high < len(places) and places[high][0] <= end + GAP and places[high][0] + places[high][1] - begin <= READ_BYTES:
            end = max(end, places[high][0] + places[high][1])
            high += 1
        data = memoryview(file.read_at(end - begin, begin))
        for offset, length in places[low:high]:
            yield bytes(data[offset - begin : offset - begin + length])
        low = high


def _summary(member: bytes) -> tuple:
    """A record's row of RESULT, from its gzip member; a response's size and digest are those of the payload read."""
    fields, payload = parse_record(zlib.decompress(member, 31))
    kind = fields["warc-type"]
    size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    page, first = fields.get("x-page-id"), fields.get("x-refers-to-page")
    return None if page is None else int(page), size, digest, kind, None if first is None else int(first)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_records(spark: SparkSession, archives: str, places: DataFrame) -> DataFrame:
    """The records at the given places (file, offset, length), each read as its byte range of the archive file."""
    bounded_batches(spark)
    some = _listed(spark, archives).select("path").first()
    if some is None or not reads_ranges(some.path):
        return _read_files(spark, archives, places)

    def read(batches):
        name, held = None, []
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name or len(held) == BLOCK:
                    yield from _from_file(name, held)
                    name, held = file, []
                held.append((offset, length))
        yield from _from_file(name, held)

    ordered = places.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, RESULT)


def _from_file(name: str | None, places: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if places:
        store, path = fs.FileSystem.from_uri(range_uri(name))
        with store.open_input_file(path) as file:
            yield _result([_summary(member) for member in read_ranges(file, places)])


def _read_files(spark: SparkSession, archives: str, places: DataFrame) -> DataFrame:
    """As ``read_records``, through Spark's reader: of the files asked for, where they are few enough to name, else of all."""
    # at most FILE_RECORDS places for a file
    by_file = places.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
    named = [r.file for r in by_file.select("file").limit(NAMED_FILES + 1).collect()]
    if not named:
        return spark.createDataFrame([], RESULT)
    source = archives if len(named) > NAMED_FILES else named
    joined = _files(spark, source).join(by_file, "file").select("content", "places")

    def read(batches):
        for batch in batches:
            for content, places_ in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                yield _result([_summary(bytes(view[p["offset"] : p["offset"] + p["length"]])) for p in places_])

    return joined.mapInArrow(read, RESULT)


def capture_keys(pages: DataFrame) -> DataFrame:
    """The index keys (column key) of pages given by page_id and url."""
    bounded_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string())], names=["key"])

    return project(pages, page_id="long", url="string").mapInArrow(run, "key string")


def _any_file(spark: SparkSession, path: str) -> bool:
    """Whether a folder, also one without partitions, holds an archive."""
    return not spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("length").where("length > 0").isEmpty()


def round_trip(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Write archives and index, look every page up and read its record back.

    One row per page: page_id, payload_bytes, payload_digest (SHA-256 of the full payload),
    record_type, refers_to. An empty table gives no rows; see ``write_archives`` for nulls.
    """
    spark = pages.sparkSession
    base = out or work_path(spark, "warc")
    write_archives(pages, f"{base}/archives")
    if not _any_file(spark, f"{base}/archives"):
        return spark.createDataFrame([], RESULT)
    write_index(spark, f"{base}/archives", f"{base}/index")
    index = spark.read.parquet(f"{base}/index")
    return read_records(spark, f"{base}/archives", locate(index, capture_keys(pages)))
