"""WARC archives: writing with revisits and segments, reading with segment reassembly.

Writing.  Of pages with equal payloads the one with the smallest id is a response and
the others are revisits without payload.  Responses are HTTP messages in chunked
transfer framing; blocks over ``segment_bytes`` are cut into a first record and
continuation records.  Each task writes gzip members to a file of its own in the shared
folder; only files named in the committed manifest are ever read, so a lost or repeated
task does no harm.

Reading.  Tasks parse ranges of whole members.  Segments are grouped by the record
they continue, ordered by number and checked against the total length; then the chunked
framing is decoded and the payload checked against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import hot_keys, salted_join
from .scratch import new_folder, store

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Compressed bytes that a reading task gets at a time.
RANGE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = "urn:rillflow:page"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PART = "id string, number int, total bigint, type string, page_id bigint, refers_to bigint, digest string, content binary"
_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, problem string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframe(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are passed over.  ValueError if it is cut short."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("cut chunk")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n")[1:])
    return unframe(body) if chunked else body


def record(kind: str, name: str, block: bytes, headers: dict[str, object]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": DATE, "Content-Length": len(block)} | headers
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, first: int | None, tag: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a response in one or more segments, or a revisit of page ``first``."""
    digest = base32_sha1(payload)
    common = {"WARC-Target-URI": "".join((url or "").split()), "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    name = f"{NAMESPACE}:{'' if page_id is None else page_id}:{digest}#{tag}"
    if first is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield record("revisit", name, block, common | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{NAMESPACE}:{first}:{digest}>"})
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + frame(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record("response", name, block, common)
        return
    yield record("response", name, parts[0], common | {"WARC-Segment-Number": 1})
    for k, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}
        yield record("continuation", f"{name}.{k}", part, {"WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": k} | last)


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def write_archives(pages: DataFrame, *, segment_bytes: int = SEGMENT_BYTES, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html); returns the manifest (path, offset, size, records).

    Payloads under ``least_bytes`` are never revisits.  A null html is an empty payload, a
    null url an empty target.  Rows without an id are responses.  A repeated row of the
    smallest id is a response again.  No rows: files without pages, or none.  Other
    columns are left out.  ``folder`` is an URI that pyarrow opens on every executor
    (file on a shared disk, hdfs, s3, gs).  A task holds one whole payload at a time, at
    any length; nothing is deleted, the archives are the result.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", _payload(F.col("html")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    narrow = rows.where(F.col("page_id").isNotNull() & (F.length("payload") >= least_bytes)).select("page_id", "digest")
    firsts = store(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first"), "first-pages")
    # one payload may be a third of all pages, so hot digests are dealt out by page
    narrow = store(narrow, "page-digests")
    revisits = store(salted_join(narrow, firsts, "digest", hot_keys(narrow, "digest"), spread="page_id").where("page_id > first").distinct(), "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        system.create_dir(root, recursive=True)
        ranges, offset, size, n, row = [], 0, 0, 0, 0
        with system.open_output_stream(path, compression=None) as out:

            def put(data: bytes) -> int:
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                out.write(data := packer.compress(data) + packer.flush())
                return len(data)

            size += put(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", {"Content-Type": "application/warc-fields"}))
            for b in batches:
                for page_id, url, payload, first in zip(*(b.column(c) for c in ("page_id", "url", "payload", "first")), strict=True):
                    for data in page_records(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py(), f"{part}-{row}", segment_bytes):
                        size += put(data)
                        n += 1
                        if size >= RANGE_BYTES:
                            ranges.append((path, offset, size, n))
                            offset, size, n = offset + size, 0, 0
                    row += 1
        if n:
            ranges.append((path, offset, size, n))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "offset", "size", "records"), r, strict=True)) for r in ranges], pa.schema([("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("records", pa.int64())]))

    full = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "first")
    manifest = store(full.mapInArrow(run, "path string, offset bigint, size bigint, records bigint"), "warc-manifest")
    return manifest.withColumn("root", F.lit(folder))


def _members(stream, size: int, step: int = 1 << 16) -> Iterator[bytes]:
    """Contents of the gzip members in the next ``size`` bytes."""
    left, rest = size, b""
    while left or rest:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                rest = stream.read(min(step, left))
                left -= len(rest)
                if not rest:
                    raise ValueError("cut archive")
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> dict[str, object]:
    """One record as a row of _PART; ``number`` is null for records in one piece."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    name = lambda key: h[key].strip("<>") if key in h else None
    page = lambda uri: int(uri.split("#")[0].split(":")[3]) if uri and uri.split("#")[0].split(":")[3] else None
    number = h.get("warc-segment-number")
    total = h.get("warc-segment-total-length")
    origin = name("warc-segment-origin-id") or name("warc-record-id")
    return {
        "id": origin,
        "number": int(number) if number else None,
        "total": int(total) if total else None,
        "type": h["warc-type"],
        "page_id": page(origin) if origin.startswith(NAMESPACE) else None,
        "refers_to": page(name("warc-refers-to")),
        "digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "content": rest[: int(h["content-length"])],
    }


def _parts(manifest: DataFrame) -> DataFrame:
    """All records of the archives but warcinfo, as rows of _PART."""
    schema = pa.schema([("id", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                system, _ = fs.FileSystem.from_uri(r["root"])
                rows, held = [], 0
                with system.open_input_file(r["path"]) as f:
                    f.seek(r["offset"])
                    for data in _members(f, r["size"]):
                        row = parse(data)
                        if row["type"] == "warcinfo":
                            continue
                        rows.append(row)
                        held += len(data)
                        if held >= 1 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    ranges = manifest.select("root", "path", "offset", "size")
    parallel = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism, 100_000))
    return ranges.repartition(parallel, "path", "offset").mapInArrow(run, _PART)


def _finish(row: dict, block: bytes | None, problem: str | None, payloads: bool) -> tuple:
    """A row of _RECORD from a whole block."""
    if problem is None and row["type"] == "revisit":
        lines = dict(x.lower().split(": ", 1) for x in block.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
        return row["page_id"], int(lines["content-length"]), row["digest"], "revisit", row["refers_to"], None, None
    payload = None
    if problem is None:
        try:
            payload = payload_of(block)
        except ValueError:
            problem = "framing"
    if payload is not None and row["digest"] not in (None, base32_sha1(payload)):
        problem = "digest"
    if problem:
        return row["page_id"], None, row["digest"], row["type"], None, problem, None
    return row["page_id"], len(payload), base32_sha1(payload), row["type"], None, None, payload if payloads else None


def join_segments(numbers: list[int], totals: list[int | None], contents: list[bytes]) -> tuple[bytes | None, str | None]:
    """The block of segments in any order, or what is wrong: a gap, a repeated or missing segment, or a total that doesn't fit."""
    order = sorted(range(len(numbers)), key=numbers.__getitem__)
    if [numbers[i] for i in order] != list(range(1, len(order) + 1)):
        return None, "segments"
    total = totals[order[-1]]
    if total is None or sum(1 for t in totals if t is not None) != 1:
        return None, "no end"
    block = b"".join(contents[i] for i in order)
    return (block, None) if len(block) == total else (None, "length")


def read_archives(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """A row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to, problem, payload.

    ``payload`` is null for revisits, for damaged records (``problem`` says what is wrong:
    segments, no end, length, framing or digest) and with ``payloads`` off.  A row of the
    manifest is read as often as it is there; a segment read twice makes its record
    damaged ("segments").  A record without a page id has a null one; an empty manifest
    gives an empty result.  A task holds the segments of one record at a time.
    """
    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("problem", pa.string()), ("payload", pa.binary())])
    parts = _parts(manifest)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = [_finish(r, r["content"], None, payloads) for r in b.slice(i, 256).to_pylist()]
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in rows], out)

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        numbers = [int(x) for x in group["number"]]
        totals = [None if pd.isna(x) else int(x) for x in group["total"]]
        block, problem = join_segments(numbers, totals, list(group["content"]))
        first = group.iloc[numbers.index(min(numbers))]
        row = {"page_id": None if pd.isna(first["page_id"]) else int(first["page_id"]), "type": "response", "digest": first["digest"], "refers_to": None}
        return pd.DataFrame([_finish(row, block, problem, payloads)], columns=out.names)

    whole = parts.where("number is null").mapInArrow(single, _RECORD)
    cut = parts.where("number is not null").groupBy("id").applyInPandas(joined, _RECORD)
    return whole.unionByName(cut)


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads the archives back and returns each record without its payload."""
    return read_archives(write_archives(pages), payloads=False).drop("payload")
