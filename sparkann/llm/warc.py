"""WARC archives: writing, reading, and resolving repeated payloads to revisit records.

A file holds one gzip member for each record, so that a record can be read from its offset alone, and ends with an empty
member. Tasks make whole files of some FILE_BYTES, which Spark's own writer puts in place: its commit protocol covers lost
executors, and any store that Spark reaches will do. Only headers are shuffled; a payload goes from the file that it is read
from to the one that it is written to within one task.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import scratch_path, stored

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header of ours, which archives may have besides the standard's: the key of the row that a record was made from.
KEY = "Source-Key"
#: HTTP headers of pages that come without any.
HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
#: Smaller payloads are kept as they are: a revisit record's headers would be as long.
MIN_PAYLOAD = 100
#: Bytes of a file, but for records that are larger by themselves; zlib's level.
FILE_BYTES, LEVEL = 32 << 20, 6
#: Revisits are told to the executors so many at a time; where there are more, files are rewritten in several jobs.
MAX_BROADCAST_REVISITS = 500_000
#: A payload that very many records share is dealt out over so many groups.
SALTS = 16

_CHUNK = 16 << 10
_LINE_END = re.compile("[\\r\\n]+")
#: A gzip member of nothing.
_END = bytes.fromhex("1f8b0800000000000003" + "0300" + "0000000000000000")

FIELDS = "file string, record long, offset long, id string, record_id string, uri string, date string, record_type string, refers_to string, payload_bytes long, payload_digest string, told_digest string"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member; line ends within a header's value become spaces, and Content-Length is added."""
    lines = "".join(f"{n}: {_LINE_END.sub(' ', v)}{CRLF}" for n, v in headers)
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1{CRLF}{lines}Content-Length: {len(block)}{CRLF}{CRLF}".encode() + block + b"\r\n\r\n") + packer.flush()


def _files(members: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Members put together to files, a batch of one row for each."""
    held, size = [], 0
    for m in members:
        if held and size + len(m) > FILE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])
            held, size = [], 0
        held.append(m)
        size += len(m)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])


def _write(files: DataFrame, path: str) -> None:
    """A file for each row (content), through Spark's text writer: what it puts after a row, and so at a file's end, is the empty member."""
    out = files.select(F.col("content").cast("string").alias("value")).write.mode("append").option("maxRecordsPerFile", 1)
    out.option("encoding", "ISO-8859-1").option("lineSep", _END.decode("latin-1")).text(path)


def write_archive(records: DataFrame, path: str) -> None:
    """Writes records (headers: array of (name, value) without Content-Length; block: binary) to new files in path.

    Null values leave their header out, a null block is empty. An empty table makes an archive without records.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for headers, block in zip(b.column(0), b.column(1), strict=True):
                yield member([(h["name"], h["value"]) for h in headers.as_py() or [] if h["value"] is not None], block.as_py() or b"")

    _write(records.select("headers", "block").mapInArrow(lambda batches: _files(members(batches)), "content binary"), path)


def _unpacked(content: memoryview) -> Iterator[tuple[int, bytes, int | None]]:
    """Offset of a member, some of its bytes unpacked, in order, and with the last ones where it ends; ValueError for a member that is broken or cut short."""
    at = 0
    while at < len(content):
        begun, d = at, zlib.decompressobj(31)
        while not d.eof:
            piece = content[at : at + _CHUNK]
            if not len(piece):
                raise ValueError(f"the gzip member at byte {begun} is cut short")
            try:
                out = d.decompress(piece)
            except zlib.error as e:
                raise ValueError(f"no gzip member at byte {begun}: {e}") from None
            at += len(piece) - len(d.unused_data)
            if out or d.eof:
                yield begun, out, at if d.eof else None


def _whole(content: bytes) -> Iterator[tuple[bytes | None, list[tuple[str, str]], bytes]]:
    """The records of a file as parse() has them, each with the gzip member that it fills alone, if there is one."""
    if content[:2] != b"\x1f\x8b":
        yield from ((None, h, b) for _, h, b in parse(content))
        return
    view, parts, begun = memoryview(content), [], 0
    for at, out, end in _unpacked(view):
        parts.append(out)
        if end is None:
            continue
        try:
            found = list(parse(b"".join(parts)))
        except ValueError:  # a record goes on in the next member
            yield from ((None, h, b) for _, h, b in parse(content[begun:]))
            return
        for _, headers, block in found:
            yield bytes(view[at:end]) if len(found) == 1 else None, headers, block
        parts, begun = [], end


def parse(content: bytes) -> Iterator[tuple[int, list[tuple[str, str]], bytes]]:
    """Offset, headers in order, and block of each record of an archive file, gzipped or not; ValueError if it is malformed.

    The offset is that of the gzip member in which the record begins, or the record's own in a file that is not gzipped.
    """
    packed = content[:2] == b"\x1f\x8b"
    source = _unpacked(memoryview(content)) if packed else iter([(0, content)])
    held, pos, start, marks = b"", 0, 0, deque()  # start: where held stands in what is unpacked; marks: where chunks begin there, and their members

    def grow(n: int) -> bool:
        """Makes held longer, so that n bytes stand after pos; whether it could."""
        nonlocal held, pos, start
        parts, size = [held[pos:]], len(held) - pos
        start, pos = start + pos, 0
        while size < n and (more := next(source, None)):
            if more[1]:
                marks.append((start + size, more[0]))
                parts.append(more[1])
                size += len(more[1])
        held = b"".join(parts)
        return size >= n

    while len(held) > pos or grow(1):
        while len(marks) > 1 and marks[1][0] <= start + pos:
            marks.popleft()
        offset = marks[0][1] if packed else start + pos
        while (end := held.find(b"\r\n\r\n", pos)) < 0:
            if not grow(len(held) - pos + 1):
                raise ValueError(f"no whole headers in the record at byte {offset}")
        first, *lines = held[pos:end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {offset}")
        headers: list[tuple[str, str]] = []
        for line in lines:
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if line[:1] in (b" ", b"\t") and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.decode('utf-8', 'replace').strip()}")
            elif not colon:
                raise ValueError(f"a malformed header in the record at byte {offset}")
            else:
                headers.append((name, value.strip()))
        length = next((v for n, v in headers if n.lower() == "content-length"), "")
        if not length.isdecimal():
            raise ValueError(f"no length in the record at byte {offset}")
        pos, n = end + 4, int(length)
        if (len(held) - pos < n + 4 and not grow(n + 4)) or held[pos + n : pos + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {offset} is cut short")
        yield offset, headers, held[pos : pos + n]
        pos += n + 4


def _own_id(*parts: object) -> str:
    """A record id from what tells a record apart."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b('/'.join(map(str, parts)).encode(), digest_size=16).digest(), version=4)}>"


def _split(headers: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """The HTTP headers of a block, if it has any, and the payload."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return b"", block
    head, blank, body = block.partition(b"\r\n\r\n")
    return head + blank, body


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives in path: FIELDS, and payload (binary) if asked for; record counts a file's records from 0.

    payload_bytes and payload_digest (SHA-256) are computed from what the record holds; for a revisit, which holds none, they are null and its header's
    digest. told_digest is the header's, with its algorithm. A record without id gets one of its file's name and its number. One file at a time is
    unpacked, a record at a time; what a task holds is a file and its largest record.
    """

    def rows(file: str, content: bytes) -> Iterator[tuple]:
        for k, (offset, headers, block) in enumerate(parse(content)):
            h = {n.lower(): v for n, v in headers}
            _, body = _split(h, block)
            told = h.get("warc-payload-digest")
            if (kind := h.get("warc-type", "")) == "revisit":
                found = (None, told and told.removeprefix("sha256:"), told, None)
            else:
                found = (len(body), hashlib.sha256(body).hexdigest(), told, body)
            yield file, k, offset, h.get(KEY.lower()), h.get("warc-record-id") or _own_id(_name(file), k), h.get("warc-target-uri"), h.get("warc-date"), kind, h.get("warc-refers-to"), *found

    names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * payloads
    types = [pa.int64() if x.endswith("long") else pa.string() for x in FIELDS.split(", ")] + [pa.binary()] * payloads

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                held, size = [], 0
                for r in rows(file.as_py(), content.as_py()):
                    held.append(r if payloads else r[:-1])
                    size += (len(r[-1] or b"") if payloads else 0) + 500
                    if size > 8 << 20:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, FIELDS + ", payload binary" * payloads)


def joined(many: DataFrame, few: DataFrame, key: str, spread: Column) -> DataFrame:
    """many left-joined to few, which has a row for each key at most, where a key may hold a large share of many: rows of
    a key are dealt over SALTS groups by spread, and those of few are repeated for each."""
    salts = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salts, [key, "__salt"], "left").drop("__salt")


def resolve(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """The records among headers (FIELDS, and rank: what to order originals by) that are to be revisits: file, record, to (record_id, uri, date).

    Of the responses of at least min_payload bytes with the same digest, the one of least (rank, file, record) is the
    original, which the others become revisits of; nulls rank last. A record that is a revisit already is joined to the least response of the same told digest, if there
    is one. Counts and minima are taken before the shuffle, so a payload that many records share is a few rows there.
    """
    at, to = F.struct(F.col("rank").isNull().alias("last"), "rank", "file", "record").alias("at"), F.struct("record_id", "uri", "date").alias("to")
    whole = headers.where("record_type = 'response'").select("file", "record", "payload_bytes", "payload_digest", "told_digest", at, to)
    large = whole.where(F.col("payload_bytes") >= min_payload).select("file", "record", "payload_digest", "at", "to")
    first = large.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min_by(F.struct("at", "to"), "at").alias("o")).where("n > 1")
    first = first.select("payload_digest", F.col("o.at").alias("first_at"), F.col("o.to").alias("first"))
    ours = joined(large.drop("to"), first, "payload_digest", F.col("record")).where("first_at is not null and at <> first_at").select("file", "record", F.col("first").alias("to"))
    again = headers.where("record_type = 'revisit' and told_digest is not null").select("file", "record", "told_digest")
    told = whole.join(again.select("told_digest").distinct(), "told_digest", "left_semi").groupBy("told_digest").agg(F.min_by("to", "at").alias("to"))
    return ours.unionByName(joined(again, told, "told_digest", F.col("record")).where("to is not null").select("file", "record", "to"))


def _literal(path: str) -> str:
    """A path in which no character stands for others."""
    return "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in path)


def deduplicate_archive(spark: SparkSession, source: str, target: str, revisits: DataFrame, date: str | None = None) -> None:
    """Writes the records of source to target; those that revisits (file, record, to) names get the headers of a revisit of the record in to.

    HTTP headers, unknown fields, ids and dates stay as they are; a missing id or date is added. Other records are written whole, and as the member that they
    are if they lack nothing. Revisits are
    aggregated to a row for each file, which is told to the task that reads the file. The files are cut into blocks of MAX_BROADCAST_REVISITS or of one file,
    a job each; a file's name and count reach the driver, as they do for any scan.
    """
    counts = revisits.groupBy("file").agg(F.count("*").alias("n"))
    if revisits.limit(MAX_BROADCAST_REVISITS + 1).count() <= MAX_BROADCAST_REVISITS:
        _rewrite(spark, [source], target, revisits, date)
        return
    listed = spark.read.format("binaryFile").load(source).select(F.col("path").alias("file")).join(counts, "file", "left")
    blocks, size = [[]], 0
    for r in listed.orderBy("file").toLocalIterator():
        if blocks[-1] and size + (r.n or 0) > MAX_BROADCAST_REVISITS:
            blocks.append([])
            size = 0
        blocks[-1].append(r.file)
        size += r.n or 0
    of = F.broadcast(spark.createDataFrame([(f, k) for k, files in enumerate(blocks) for f in files], "file string, block int"))
    at = scratch_path(spark, "blocks")
    revisits.join(of, "file").repartition("block", "file").write.partitionBy("block").parquet(at)
    cut = spark.read.schema(StructType([*revisits.schema.fields, StructField("block", IntegerType())])).parquet(at)
    for k, files in enumerate(blocks):
        _rewrite(spark, [_literal(f) for f in files], target, cut.where(F.col("block") == k).drop("block"), date)


def _rewrite(spark: SparkSession, sources: list[str], target: str, revisits: DataFrame, date: str | None) -> None:
    """deduplicate_archive() for files whose revisits can be broadcast."""
    now = date or _now()

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for path, content, named in zip(*b.columns, strict=True):
                file = path.as_py()
                to = {x["record"]: x["to"] for x in named.as_py() or []}
                for k, (packed, headers, block) in enumerate(_whole(content.as_py())):
                    if packed and k not in to and {"warc-record-id", "warc-date"} <= {n.lower() for n, _ in headers}:
                        yield packed
                    else:
                        yield member(*_fresh(headers, block, to.get(k), _own_id(_name(file), k), now))

    few = revisits.groupBy("file").agg(F.collect_list(F.struct("record", "to")).alias("named"))
    files = spark.read.format("binaryFile").load(sources).select("path", "content")
    files = files.join(F.broadcast(few), files.path == few.file, "left").select("path", "content", "named")
    _write(files.mapInArrow(lambda batches: _files(members(batches)), "content binary"), target)


def _fresh(headers: list[tuple[str, str]], block: bytes, to: dict | None, own: str, date: str) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a record as they are to be written: of a revisit if to is there."""
    h = {n.lower(): v for n, v in headers}
    added = [(n, v) for n, v in (("WARC-Record-ID", own), ("WARC-Date", date)) if n.lower() not in h]
    if to is not None:
        head, body = _split(h, block)
        gone = {"warc-type", "warc-profile", "warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date", "warc-block-digest"}
        added += [("WARC-Profile", PROFILE), ("WARC-Refers-To", to["record_id"]), ("WARC-Refers-To-Target-URI", to["uri"]), ("WARC-Refers-To-Date", to["date"])]
        if "warc-payload-digest" not in h:
            added.append(("WARC-Payload-Digest", f"sha256:{hashlib.sha256(body).hexdigest()}"))
        block = head
        headers = [("WARC-Type", "revisit"), *[x for x in headers if x[0].lower() not in gone]]
    return [x for x in [*headers, *added] if x[1] is not None and x[0].lower() != "content-length"], block


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def archive_pages(pages: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, date: str | None = None, head: str = HEAD) -> None:
    """Archives rows as responses with head as HTTP headers. A null payload is empty; a null url or id has no header. Record ids are made of the
    path, the task and the row's number there."""
    now, salt = date or _now(), path

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for key, url, body in zip(*b.columns, strict=True):
                key, url, body = key.as_py(), url.as_py(), body.as_py() or b""
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", _own_id(salt, task, n)), ("WARC-Date", now), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(body).hexdigest()}"), (KEY, key), ("Content-Type", "application/http;msgtype=response")]
                yield member([x for x in headers if x[1] is not None], head.encode() + body)
                n += 1

    rows = pages.select(F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.col(payload_col).cast("binary"))
    _write(rows.mapInArrow(lambda batches: _files(members(batches)), "content binary"), path)


def archive_round_trip(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Archives pages, resolves revisits, writes deduplicated archives and reads those: a row for each page.

    path gets raw/ and deduplicated/. Returns page_id, payload_bytes, payload_digest (SHA-256), record_type, refers_to. A null payload
    is empty, a null url has no header, a null id stays null and ranks last; where the original has none, refers_to is null. Of rows with the same id and
    payload one is the original. Columns beside the three named are not read.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    archive_pages(pages, f"{path}/raw", id_col, url_col, payload_col)
    headers = stored(read_archive(spark, f"{path}/raw"), "headers").withColumn("rank", F.col("id").cast(kind))
    revisits = stored(resolve(headers, min_payload), "revisits")
    deduplicate_archive(spark, f"{path}/raw", f"{path}/deduplicated", revisits)
    back = stored(read_archive(spark, f"{path}/deduplicated"), "records")
    again = back.where("record_type = 'revisit'")
    seen = back.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("id").alias("original"), F.col("payload_bytes").alias("original_bytes"))
    seen = seen.join(again.select("refers_to").distinct(), "refers_to", "left_semi")
    again = joined(again, seen, "refers_to", F.col("record"))
    one = lambda df, size, to: df.select(F.col("id").cast(kind).alias("page_id"), F.col(size).alias("payload_bytes"), "payload_digest", "record_type", to.cast(kind).alias("refers_to"))
    return one(back.where("record_type <> 'revisit'"), "payload_bytes", F.lit(None)).unionByName(one(again, "original_bytes", F.col("original")))
