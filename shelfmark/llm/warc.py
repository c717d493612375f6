"""WARC archives: a writer, and a reader that splits gzip archives at any byte.

Every record is a gzip member of its own. A split is a byte range of an archive. Its task
looks for the gzip magic, takes a place for a member only if it inflates to the start of a
WARC header, and owns the records whose member begins inside its range, reading on past the
end of the range to finish the last one. Members that follow each other directly need no
search. No task reads more than its range and one record, and no index is needed.

Archives are opened with Arrow's file systems, so they may lie in any folder that driver
and executors share.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import checkpoint_root, cut

MAGIC = b"\x1f\x8b\x08"
LEAST_REVISIT = 100
SPLIT_BYTES = 8 << 20
ROLL_BYTES = 1 << 30
READ_BYTES = 1 << 18
HEADER_BYTES = 1 << 16
SALTS = 32
RECORD = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary"
)


def file_system(path: str):
    """The Arrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else "file://" + path)


def header_value(value: str) -> str:
    """A value that cannot end its header line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, page: str, uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One record as a gzip member; a revisit has the digest and size of its payload, not the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {header_value(uri)}")
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def with_revisits(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """``pages`` with ``record_type`` and ``refers_to``.

    Of rows with one payload of at least 100 bytes those with the smallest key are responses,
    the others revisit it. Null keys are never the smallest, unless a payload has no other:
    then all its rows are responses. Only payloads that occur more than once are joined back,
    salted, so a payload of a third of all rows is spread.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    digest = F.when(F.octet_length(body) >= LEAST_REVISIT, F.sha2(body, 256))
    firsts = (
        pages.select(F.col(key).alias("first_key"), digest.alias("digest")).where("digest is not null")
        .groupBy("digest").agg(F.count("*").alias("n"), F.min("first_key").alias("first_key")).where("n > 1").drop("n")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    marked = pages.withColumns({"digest": digest, "salt": F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")})
    again = F.col("first_key").isNotNull() & ~F.col(key).eqNullSafe(F.col("first_key"))
    return marked.join(firsts, ["digest", "salt"], "left").select(
        *pages.columns, F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_key")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, key: str, uri: str, payload: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Write rows (with ``record_type`` and ``refers_to``) as archives; the manifest (path, bytes, records).

    A file has a name of its own for every attempt, and only files in the manifest count, so
    a task that ran twice leaves no records behind. Null payloads are written as empty ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        out, path, size, n = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{path}"], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())}
            )

        for batch in batches:
            columns = [batch.column(c) for c in (key, uri, payload, "record_type", "refers_to")]
            for row in zip(*columns, strict=True):
                page, url, body, kind, refers = (v.as_py() for v in row)
                if out is None:
                    path, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{path}", compression=None)
                member = record(kind, str(page), url, None if refers is None else str(refers), (body or "").encode())
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= roll:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    used = pages.select(*dict.fromkeys([key, uri, payload, "record_type", "refers_to"]))
    return used.mapInArrow(run, "path string, bytes long, records long")


class Range:
    """Bytes of a file read on demand, forward, with what is passed forgotten."""

    def __init__(self, read: Callable[[int, int], bytes], start: int) -> None:
        self.read, self.start, self.held, self.ended = read, start, b"", False

    def at(self, position: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``position``, which never goes back."""
        while not self.ended and self.start + len(self.held) < position + n:
            more = self.read(self.start + len(self.held), READ_BYTES)
            self.ended = not more
            self.held += more
        if position - self.start > READ_BYTES:
            self.held = self.held[position - self.start :]
            self.start = position
        return self.held[position - self.start : position - self.start + n]


def member(data: Range, position: int) -> tuple[bytes, int] | None:
    """The inflated record whose member begins at ``position`` and the place after it; None if there is none."""
    if data.at(position, 3) != MAGIC:
        return None
    inflate, out, at = zlib.decompressobj(31), [], position
    try:
        while not inflate.eof:
            part = data.at(at, READ_BYTES)
            if not part:
                return None
            out.append(inflate.decompress(part))
            at += len(part) - len(inflate.unused_data)
            if len(out) == 1 and not out[0].startswith(b"WARC/1."[: max(len(out[0]), 1)]):
                return None
    except zlib.error:
        return None
    raw = b"".join(out)
    return (raw, at) if raw.startswith(b"WARC/1.") and b"\r\n\r\n" in raw else None


def looks_like_member(data: Range, position: int) -> bool:
    """True if the bytes at ``position`` inflate to the start of a WARC header."""
    try:
        head = zlib.decompressobj(31).decompress(data.at(position, 4096), 64)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.")


def members(data: Range, start: int, end: int) -> Iterator[bytes]:
    """Records whose member begins in ``start`` to ``end``; damaged places are passed over."""
    position = start
    while position < end:
        found = member(data, position) if looks_like_member(data, position) else None
        if found:
            raw, position = found
            yield raw
            continue
        position += 1
        while position < end:
            part = data.at(position, READ_BYTES)
            hit = part.find(MAGIC)
            if hit >= 0:
                position += hit
                break
            if len(part) < len(MAGIC):
                return
            position += len(part) - 2


def parsed(raw: bytes) -> tuple:
    """The fields of ``RECORD``. A response's digest and size are those of the bytes read."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = block[: int(fields.get("content-length", len(block)))]
    kind = fields.get("warc-type")
    ident = lambda v: v and v.removeprefix("<urn:page:").removesuffix(">")
    payload = block.partition(b"\r\n\r\n")[2]
    if kind == "revisit":
        digest, size, payload = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["warc-payload-length"]), None
    else:
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    return ident(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), ident(fields.get("warc-refers-to")), digest, size, payload


def read_archives(manifest: DataFrame, split: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the archives in ``manifest`` (path, bytes), in splits of ``split`` bytes.

    A record is read once, by the split its member begins in. Empty files give no rows,
    damaged members are left out. ``payloads=False`` leaves the payload column null.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long")))
    splits = manifest.where("bytes > 0").select("path", starts.alias("start"))
    tasks = max(1, splits.count())
    splits = splits.repartition(tasks, F.xxhash64("path", "start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]

        def rows(held: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = file_system(path)
                held, size = [], 0
                with fs.open_input_file(place) as file:
                    data = Range(lambda at, n, f=file: f.read_at(n, at) if at < f.size() else b"", start)
                    for raw in members(data, start, start + split):
                        row = parsed(raw)
                        held.append(row if payloads else (*row[:6], None))
                        size += len(raw)
                        if len(held) >= 1000 or size >= 8 << 20 and payloads:
                            yield rows(held)
                            held, size = [], 0
                if held:
                    yield rows(held)

    return splits.mapInArrow(run, RECORD)


def archived(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", split: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives with revisits and read them back: one row per page, as in ``RECORD``.

    A null key has the record id "None". Other columns are not written. An empty table gives
    no archive and no rows. Equal rows are records of their own.
    """
    folder = f"{checkpoint_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = cut(write_archives(with_revisits(pages.select(key, uri, payload), key, payload), folder, key, uri, payload))
    return read_archives(manifest, split, payloads=False)
