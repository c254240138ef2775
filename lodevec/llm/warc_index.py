"""WARC archives with a two-level capture index.

``write_archives`` stores one record a page, each its own gzip member, and lists the captures.
``build_index`` sorts the captures by reversed-host key, packs them into compressed blocks and ends each
index file with a sparse directory of its blocks. A lookup sorts the keys that are asked for, binary-searches the files'
key ranges and then the directories for blocks, deals these out and reads each by one range read; records are read the same way.

An index file is: blocks (zlib, one JSON line a capture), directory (zlib, JSON rows of first key,
offset, length, lines), and a trailer of two u64 with the directory's offset and length.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm.common import map_rows, schema_of, scratch, settle, text_or_empty
from lodevec.llm.shared_files import RangeReader, write_new

ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 256
READ_AHEAD = 4 << 20
DATE = "2024-01-01T00:00:00Z"
TRAILER = "<2Q"


def host_and_rest(url: str) -> tuple[str, str]:
    _, mark, after = url.partition("://")
    if not mark:
        return "", url
    end = next((i for i, c in enumerate(after) if c in "/?#"), len(after))
    return after[:end].lower(), after[end:]


def sort_key(url: str | None) -> str:
    """``https://a.example.org/x`` becomes ``org,example,a)/x``; without ``://`` the whole url follows the bracket."""
    host, rest = host_and_rest(url or "")
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + rest


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed. A revisit keeps the HTTP head, which names the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {_clean(url)}")
    fields.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Type, page id, url, payload length and digest, refers_to and payload (None for a revisit) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(next(v for k, _, v in (x.partition(b": ") for x in http.split(b"\r\n")) if k.lower() == b"content-length"))
    number = lambda urn: int(urn[len("<urn:page:") : -1]) if len(urn) > len("<urn:page:>") else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != declared or sha1_base32(payload) != digest):
        raise ValueError("payload doesn't match its digest")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": None if url is None else _plain(url), "record_type": fields["WARC-Type"],
        "payload_bytes": declared, "payload_digest": digest, "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


CAPTURES = "key string, page_id bigint, path string, at bigint, size bigint"


def write_archives(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record a page below ``folder`` and give the captures ``(key, page_id, path, at, size)``.

    Of pages with equal payloads of at least ``least_bytes`` bytes, those with the smallest id are responses and
    the others revisit it. A page with a null id is a revisit where another page of its payload has an id.
    A null html is empty, a null url has the key ``)``; repeated rows are records of their own; an empty table gives no
    captures; other columns aren't looked at.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    source = source.withColumn("sha1", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    # who refers to whom is found without the texts; a payload of many pages is a hot key of narrow rows only
    narrow = source.where(F.octet_length("html") >= least_bytes).select("page_id", "sha1")
    shared = narrow.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    others = settle(narrow.join(shared, "sha1").where(~F.col("first").eqNullSafe(F.col("page_id"))).distinct(), "revisits")
    others = others.select(F.col("page_id").alias("other"), F.col("sha1").alias("other_sha1"), F.col("first").alias("refers_to"))
    ready = source.join(others, F.col("page_id").eqNullSafe(F.col("other")) & (F.col("sha1") == F.col("other_sha1")), "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()  # type: ignore[union-attr]
        members: list[bytes] = []
        rows: list[tuple] = []
        at = files = 0

        def flush() -> pa.RecordBatch:
            nonlocal members, rows, at, files
            path = write_new(folder, f"part-{place:05d}-{files:05d}", ".warc.gz", b"".join(members))
            keys, ids, starts, sizes = zip(*rows, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array([path] * len(rows)), pa.array(starts), pa.array(sizes)], ["key", "page_id", "path", "at", "size"])
            members, rows, at, files = [], [], 0, files + 1
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    member = _gzip(record(page_id, url, payload, sha1_base32(payload), refers_to))
                    rows.append((sort_key(url), page_id, at, len(member)))
                    members.append(member)
                    at += len(member)
                    if at >= ARCHIVE_BYTES:
                        yield flush()
        if rows:
            yield flush()

    return settle(ready.mapInArrow(run, schema_of(CAPTURES)), "captures")


def build_index(captures: DataFrame, folder: str | None = None, lines: int = BLOCK_LINES) -> DataFrame:
    """Index files of sorted captures; gives one row a file: ``(path, first_key, last_key, blocks, captures)``.

    Captures of one key are in order of page id, and may lie in several blocks and files.
    """
    folder = folder or scratch(captures.sparkSession, "cdx")
    out = schema_of("path string, first_key string, last_key string, blocks int, captures bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()  # type: ignore[union-attr]
        parts: list[bytes] = []
        directory: list[list] = []
        waiting: list[tuple] = []
        at = total = 0
        last = ""

        def close_block() -> None:
            nonlocal waiting, at, last, total
            data = zlib.compress("\n".join(json.dumps(row) for row in waiting).encode())
            directory.append([waiting[0][0], at, len(data), len(waiting)])
            parts.append(data)
            at += len(data)
            total += len(waiting)
            last, waiting = waiting[-1][0], []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(row)
                if len(waiting) == lines:
                    close_block()
        if waiting:
            close_block()
        if directory:
            tail = zlib.compress(json.dumps(directory).encode())
            path = write_new(folder, f"index-{place:05d}", ".cdx", b"".join((*parts, tail, struct.pack(TRAILER, at, len(tail)))))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((path, pa.string()), (directory[0][0], pa.string()), (last, pa.string()), (len(directory), pa.int32()), (total, pa.int64()))], ["path", "first_key", "last_key", "blocks", "captures"])

    ordered = captures.select("key", "page_id", "path", "at", "size").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "path", "at")
    return settle(ordered.mapInArrow(run, out), "index")


def read_directory(source: RangeReader) -> list[list]:
    at, size = struct.unpack(TRAILER, source.read(source.size - 16, 16))
    return json.loads(zlib.decompress(source.read(at, size)))


def read_block(source: RangeReader, at: int, size: int) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(source.read(at, size)).decode().split("\n")]


def captures_of(index: DataFrame) -> DataFrame:
    """All captures, read from the blocks of the index, without a search. An empty index has none."""

    def directories():
        def work(paths: list) -> list[tuple]:
            rows = []
            for path in paths:
                with RangeReader(path) as source:
                    rows += [(path, at, size) for _, at, size, _ in read_directory(source)]
            return rows

        return work

    def blocks():
        def work(paths: list, starts: list, sizes: list) -> list[tuple]:
            rows = []
            for path, at, size in zip(paths, starts, sizes, strict=True):
                with RangeReader(path) as source:
                    rows += [tuple(row) for row in read_block(source, at, size)]
            return rows

        return work

    tasks = index.sparkSession.sparkContext.defaultParallelism * 4
    listed = map_rows(index.select("path").repartition(tasks), directories, schema_of("path string, at bigint, size bigint"))
    return map_rows(listed.repartition(tasks), blocks, schema_of(CAPTURES))


def read_records(captures: DataFrame) -> DataFrame:
    """The records of captures: ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)``.

    Captures are dealt out by archive and offset, and neighbours are fetched by one range read. Captures that repeat give
    their record again; no captures give no rows. A record that doesn't fit its digest is an error.
    """
    out = schema_of("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")

    def setup():
        def work(paths: list, starts: list, sizes: list) -> list[tuple]:
            rows = []
            for path, begin, ranges in _together(paths, starts, sizes):
                with RangeReader(path) as source:
                    data = source.read(begin, ranges[-1][0] + ranges[-1][1] - begin)
                for at, size in ranges:
                    r = parse_record(zlib.decompress(data[at - begin : at - begin + size], 31))
                    rows.append((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
            return rows

        return work

    dealt = captures.select("path", "at", "size").repartitionByRange("path", "at").sortWithinPartitions("path", "at")
    return map_rows(dealt, setup, out)


def _together(paths: list, starts: list, sizes: list) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Neighbouring ranges of one file, up to ``READ_AHEAD`` bytes."""
    held: list[tuple[int, int]] = []
    of = None
    for path, at, size in zip(paths, starts, sizes, strict=True):
        if held and (path != of or at != held[-1][0] + held[-1][1] or at + size - held[0][0] > READ_AHEAD):
            yield of, held[0][0], held
            held = []
        of = path
        held.append((at, size))
    if held:
        yield of, held[0][0], held  # type: ignore[misc]


def lookup(spark: SparkSession, index: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Captures of the urls of a DataFrame, by binary search: ``(key, page_id, path, at, size)``.

    Urls are asked for by key, each once, however often they repeat; a null url has the key of an empty one. Urls
    without captures, and an empty index, give no rows. The key ranges of the index files, one row a file and so at
    most one a partition of the build, go to all tasks. Keys are sorted, so a task meets neighbouring blocks of
    few files; the blocks of a key that many captures have are read by many tasks.
    """
    files = sorted((tuple(r) for r in index.select("last_key", "first_key", "path").collect()))
    shared = spark.sparkContext.broadcast(files)

    def keys():
        return lambda urls: [(sort_key(u),) for u in urls]

    def search():
        files, held = shared.value, {}

        def directory(path: str) -> list[list]:
            if path not in held:
                held.clear()  # keys come in order, so a directory that was left isn't met again
                with RangeReader(path) as source:
                    held[path] = read_directory(source)
            return held[path]

        def work(asked: list) -> list[tuple]:
            rows = []
            for key in asked:
                for place in range(bisect.bisect_left(files, key, key=lambda f: f[0]), len(files)):
                    _, first, path = files[place]
                    if first > key:
                        break
                    blocks = directory(path)
                    at = max(0, bisect.bisect_left(blocks, key, key=lambda b: b[0]) - 1)
                    while at < len(blocks) and blocks[at][0] <= key:
                        rows.append((key, path, blocks[at][1], blocks[at][2]))
                        at += 1
            return rows

        return work

    def read():
        held: dict[str, RangeReader] = {}
        block: tuple = (None, None, {})

        def work(asked: list, paths: list, starts: list, sizes: list) -> list[tuple]:
            nonlocal block
            rows = []
            for key, path, at, size in zip(asked, paths, starts, sizes, strict=True):
                if path not in held:
                    for source in held.values():
                        source.__exit__()
                    held.clear()
                    held[path] = RangeReader(path)
                if block[:2] != (path, at):
                    found: dict[str, list[tuple]] = {}
                    for row in read_block(held[path], at, size):
                        found.setdefault(row[0], []).append(tuple(row))
                    block = (path, at, found)
                rows += block[2].get(key, ())
            return rows

        return work

    asked = map_rows(urls.select(F.col(url_col).cast("string")).distinct(), keys, schema_of("key string")).distinct()
    asked = asked.repartitionByRange("key").sortWithinPartitions("key")
    blocks = map_rows(asked, search, schema_of("key string, path string, at bigint, size bigint"))
    dealt = blocks.repartition("path", "at").sortWithinPartitions("path", "at")
    return map_rows(dealt, read, schema_of(CAPTURES))


#: What reading the archives of the table ``pages`` must give. DuckDB has no base32, so 40 bits at a time are spelt out.
ORACLE_SQL = """
WITH bytes AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages
), firsts AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first,
        list_aggregate([
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)]
            for i in range(32)
        ], 'string_agg', '') AS payload_digest
    FROM bytes
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""
