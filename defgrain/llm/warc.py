"""WARC archives: a writer, and a reader that splits gzip files by bytes.

Each record is a gzip member of its own. A reading task gets a byte range of a file. It looks for the
gzip magic, takes a candidate for a record only if it decodes and begins with a WARC header whose
Content-Length agrees with the member, and reads the records that start inside its range, the last
one beyond its end if need be. So each record has one owner and no index is needed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, stage

LEAST_REVISIT = 100  # payloads of fewer bytes are always stored
SPLIT = 16 << 20
FILE_BYTES = 1 << 30
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_HEADER = 1 << 16

RECORD = (
    "file string, offset long, warc_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_length long, payload binary"
)
_NAMES = [part.split()[0] for part in RECORD.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _files(uri: str):
    """The file system and path of a folder; any that pyarrow knows, local paths included."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _clean(value: str | None) -> str:
    return "" if value is None else "".join("%%%02X" % ord(c) if ord(c) < 33 or ord(c) == 127 else c for c in value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, is_revisit: bool = False) -> bytes:
    """One gzip member. A revisit has the HTTP header, with the full length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    lines = [
        "WARC/1.1",
        "WARC-Type: " + ("revisit" if is_revisit else "response"),
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + _clean(url),
        "WARC-Payload-Digest: sha256:" + digest,
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        lines[3:3] = [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple | None:
    """The fields of a decoded member from warc_type on, or None if it is no whole record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
        return None
    length = int(fields["content-length"])
    if len(rest) != length + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    block, payload, full = rest[:length], rest[:length], length
    if fields.get("content-type", "").startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        full = int(sizes[0]) if sizes and re.fullmatch(rb"[0-9]{1,18}", sizes[0]) else len(payload)
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    if kind != "revisit":
        full, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return (
        kind,
        fields.get("warc-record-id"),
        fields.get("warc-target-uri"),
        fields.get("warc-refers-to"),
        digest,
        full,
        None if kind == "revisit" else payload,
    )


class _Window:
    """Bytes of a file around a moving place."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.data = source, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.source.seek(at)
            self.at, self.data = at, self.source.read(min(max(n, _READ), self.size - at))
        return self.data[at - self.at : at - self.at + n]

    def find(self, pattern: bytes, at: int) -> int:
        """The next place of ``pattern``, or -1; looks at the bytes held before it reads more."""
        while at < self.size:
            self.read(at, min(len(pattern), self.size - at))
            hit = self.data.find(pattern, at - self.at)
            if hit >= 0:
                return self.at + hit
            after = self.at + len(self.data)
            if after >= self.size:
                return -1
            at = max(at + 1, after - len(pattern) + 1)
        return -1


def member(window: _Window, at: int) -> tuple[tuple, int] | None:
    """The record whose member begins at ``at``, and where the member ends; None if there is none."""
    opened = zlib.decompressobj(31)
    parts, place, probed = [], at, False
    try:
        while not opened.eof:
            data = window.read(place, min(_HEADER if not probed else _READ, window.size - place))
            if not data:
                return None
            parts.append(opened.decompress(data))
            place += len(data)
            if not probed and sum(map(len, parts)) >= 5:
                if not parts[0].startswith(b"WARC/"):
                    return None
                probed = True
    except zlib.error:
        return None
    found = parse(b"".join(parts))
    return None if found is None else (found, place - len(opened.unused_data))


def records(source, start: int, end: int, size: int) -> Iterator[tuple[int, tuple]]:
    """(offset, fields) of the records of a file that start in [start, end)."""
    window, at = _Window(source, size), start
    while (at := window.find(_MAGIC, at)) >= 0 and at < end:
        found = member(window, at)
        if found is None:
            at += 1
        else:
            yield at, found[0]
            at = found[1]


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write a record per page under ``folder`` and return the written files (file, size, records).

    Of the pages with equal payloads of at least 100 bytes, those with the least page_id are stored
    and the others refer to it. Null html is an empty payload. A page without page_id is stored
    unless a page with one has its payload. A task writes under a name of its own and renames when
    it is done, so a task that is run again replaces what it wrote."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    marked = rows.withColumn("digest", F.sha2("payload", 256))
    # Digests alone are counted first, combined before the shuffle; few of them are shared.
    shared = (
        marked.where(F.length("payload") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
        .select("digest", "first_id")
    )
    # Written first: between two plain shuffles Spark can split the partition of a hot digest.
    joined = marked.join(stage(shared, "shared"), "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    )

    def run(batches):
        files, root = _files(folder)
        part, number, done = TaskContext.get(), 0, []
        sink, name, size, n = None, "", 0, 0

        def close():
            sink.close()
            final = f"{root}/part-{part.partitionId():06d}-{number:04d}.warc.gz"
            if files.get_file_info(final).is_file:  # from an earlier attempt; some systems don't replace
                files.delete_file(final)
            files.move(name, final)
            done.append((final, size, n))

        for batch in batches:
            for page_id, url, data, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    files.create_dir(root, recursive=True)
                    name = f"{root}/.part-{part.partitionId():06d}-{number:04d}.{part.taskAttemptId()}"
                    sink, size, n = files.open_output_stream(name), 0, 0
                data = record(page_id, url, data, digest, refers_to, refers_to is not None)
                sink.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    close()
                    sink, number = None, number + 1
        if sink is not None:
            close()
        if done:
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["file", "size", "records"]
            )

    return stage(joined.mapInArrow(run, "file string, size long, records long"), "archives")


def read_archives(files: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """The records of gzip WARC files (file, size), one task per byte range of ``split`` bytes.
    ``folder`` names the file system. Files without records give none; broken members are passed
    over."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))
    ranges = files.where("size > 0").select("file", "size", F.explode(starts).alias("start"))
    n = max(1, ranges.count())

    def run(batches):
        system, _ = _files(folder)
        for batch in batches:
            for file, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                held, weight = [], 0
                with system.open_input_file(file) as source:
                    for offset, fields in records(source, start, min(start + split, size), size):
                        held.append((file, offset, *fields))
                        weight += len(fields[-1] or b"") + 500
                        if weight >= 16 << 20:
                            yield _batch(held)
                            held, weight = [], 0
                if held:
                    yield _batch(held)

    return ranges.repartition(min(n, 10_000), "file", "start").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def folder_for(spark: SparkSession) -> str:
    return new_folder(spark, "warc")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to archives in the shared checkpoint folder and read the archives back: one
    row per page with page_id, payload_bytes, payload_digest, record_type and refers_to, as the
    records have them. Null html is empty; a null page_id stays null; repeated pages are records of
    their own, stored again where they repeat the stored page_id. An empty table gives none."""
    folder = folder_for(pages.sparkSession)
    files = write_archives(pages, folder, id_col, url_col, html_col)

    def number(name):
        return F.regexp_extract(F.coalesce(F.col(name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1)

    return read_archives(files, folder).select(
        F.when(number("record_id") != "", number("record_id").cast("long")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.when(number("refers_to") != "", number("refers_to").cast("long")).alias("refers_to"),
    )
