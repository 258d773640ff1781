"""WARC archives of individually compressed records with a shared dictionary.

A task gathers records up to ``ARCHIVE_BYTES``, builds a Zstandard dictionary from
them, writes it into a leading skippable frame (magic 0x184D2A5D) and every record
into a frame of its own, so that each can be read alone from its offset. Equal
payloads are stored once: the page of the least id has the response, the others
are revisits that name it.

An archive counts when Spark has committed the manifest row of its task. Every
attempt writes a new file name, so what a lost executor left is never read.
Archives lie in a folder that all executors reach (a mounted path, or a store
that ``pyarrow.fs`` knows by its URI); rows are read back by tasks that stream
the archives, frame by frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import materialize, scratch_path

ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: A dictionary is built from about this many times its size, spread over the archive's records.
SAMPLE_TIMES = 64
LEAST_SAMPLES = 8
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the file format: frame magics, and the profile of revisits to equal payloads.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records bigint, raw_bytes bigint, stored_bytes bigint, dictionary_bytes bigint"
RECORDS = ("archive string, offset bigint, page_id bigint, url string, record_type string, payload_bytes bigint, "
           "payload_digest string, refers_to bigint, payload binary")


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, digest: str) -> str:
    """Record id of a page's capture, the same in every run."""
    named = hashlib.sha256(f"{page_id}:{digest}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=named[:16], version=4)}>"


def _block(kind: str, fields: list[tuple[str, str]], body: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{name}: {value}" for name, value in fields],
             f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str,
                refers_to: int | None, date: str = DATE) -> bytes:
    """One response, or a revisit when ``refers_to`` is given; ``size`` and ``digest`` are the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = record_name(page_id, digest)
    target = re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()),
                    url or name[1:-1])
    fields = [("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", target),
              ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    if refers_to is None:
        return _block("response", fields, head + payload)
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_name(refers_to, digest)),
               ("Refers-To-Page-Id", str(refers_to)), ("WARC-Truncated", "length")]
    return _block("revisit", fields, head)


def _dictionary(records: list[bytes], raw: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary built from records spread evenly over the archive; none where there is too little to learn from."""
    size = min(DICTIONARY_BYTES, raw // SAMPLE_TIMES)
    step = max(1, raw // (SAMPLE_TIMES * DICTIONARY_BYTES))
    samples = records[::step]
    if len(samples) < LEAST_SAMPLES or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL)
    except zstandard.ZstdError:  # records without anything in common
        return None


def _create(folder: str) -> tuple[str, pa.NativeFile]:
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}.warc.zst"
    files.create_dir(root, recursive=True)
    return f"{folder.rstrip('/')}/{name}", files.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)


def write_archive(folder: str, records: list[bytes], date: str = DATE) -> tuple[str, int, int, int, int]:
    """Write one archive; its manifest row."""
    info = b"software: rankloom\r\nformat: WARC File Format 1.1\r\n"
    raw = sum(map(len, records))
    dictionary = _dictionary(records, raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    archive, stream = _create(folder)
    stored = 0
    with stream:
        content = b""
        if dictionary is not None:
            content = dictionary.as_bytes()
            frame = DICTIONARY_MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content
            stored += stream.write(frame)
        first = _block("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                                    ("Content-Type", "application/warc-fields")], info)
        for record in (first, *records):
            stored += stream.write(packer.compress(record))
    return archive, len(records), raw, stored, len(content)


def archive_frames(stream: pa.NativeFile, piece: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every frame that is not skippable, one at a time."""
    held, offset, unpacker = b"", 0, zstandard.ZstdDecompressor()

    def more(least: int) -> bytes:
        kept = held
        while len(kept) < least and (got := stream.read(piece)):
            kept += got
        return kept

    while held := more(8):
        if len(held) < 8:
            raise ValueError("the archive ends inside a frame")
        magic, size = (int.from_bytes(held[k:k + 4], "little") for k in (0, 4))
        if magic & ~0xF == SKIPPABLE_MAGIC:
            held = more(8 + size)
            if len(held) < 8 + size:
                raise ValueError("the archive ends inside a skippable frame")
            if magic == DICTIONARY_MAGIC and offset == 0:
                content = held[8:8 + size]
                if int.from_bytes(content[:4], "little") == FRAME_MAGIC:  # other writers may compress it
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            held, offset = held[8 + size:], offset + 8 + size
            continue
        one, parts, used = unpacker.decompressobj(), [], 0
        while True:
            parts.append(one.decompress(held))
            used += len(held)
            if one.eof:
                break
            held = stream.read(piece)
            if not held:
                raise ValueError("the archive ends inside a record")
        held = one.unused_data
        used -= len(held)
        yield offset, b"".join(parts)
        offset += used


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


@dataclass(frozen=True)
class PageRecord:
    page_id: int | None
    url: str
    record_type: str
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes | None


def parse_record(record: bytes) -> PageRecord | None:
    """The page capture in a record; None for records of other types. Lengths and
    the digest of a stored payload are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    kind, size = fields["warc-type"], int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields['warc-record-id']} has another length than it says")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    told, digest = int(_fields(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != told or base32_digest(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']} has another payload than it says")
    page, other = (int(fields[k]) if k in fields else None for k in ("page-id", "refers-to-page-id"))
    return PageRecord(page, fields["warc-target-uri"], kind, told, digest, other,
                      payload if kind == "response" else None)


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): what is to be written for each row.

    ``refers_to`` is the least page_id of an equal payload of ``least_bytes`` or
    more, where that is another page's; the payload is then null. Payloads are
    equal when their SHA-1 digests and sizes are. Digests fold per task, and the
    repeated ones are stored, so a payload that a third of all pages have can be
    split over tasks in the join.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload")).withColumns(
        {"size": F.octet_length("payload").cast("long"), "digest": F.unhex(F.sha1("payload"))})
    repeated = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(
        F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    repeated = materialize(repeated.select("digest", "size", "first"), "repeated_payloads")
    other = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return rows.join(repeated, ["digest", "size"], "left").withColumn("refers_to", other).select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest",
        "refers_to")


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write a record for every row of ``pages``; the stored manifest, one row per archive.

    ``folder`` is a path or URI that every executor reaches; without one it is made
    under ``spark.checkpoint.dir``. Pages carry no time, so ``date`` is that of all
    records. See ``archived_pages`` for awkward rows.
    """
    folder = folder or scratch_path(pages.sparkSession, "archives")
    if folder.startswith("/"):
        folder = f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            done = []
            for row in range(batch.num_rows):
                page_id, url, payload, length, digest, other = (column[row].as_py() for column in batch.columns)
                held.append(page_record(page_id, url, payload, length, base64.b32encode(digest).decode(), other, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    done.append(write_archive(folder, held, date))
                    held, size = [], 0
            yield _rows(done, MANIFEST)
        if held:
            yield _rows([write_archive(folder, held, date)], MANIFEST)

    return materialize(captures(pages, least_bytes).mapInArrow(run, MANIFEST), "manifest")


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(field.split(" ") for field in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)],
                                      names=list(names))


def read_archives(archives: DataFrame, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """Every page record of ``archives(archive)``; payloads are null where ``payloads`` is false.

    Archives are dealt one by one over the tasks; a task holds one record and one
    output batch at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                files, path = pyarrow.fs.FileSystem.from_uri(archive)
                held, size = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for offset, record in archive_frames(stream):
                        page = parse_record(record)
                        if page is None:
                            continue
                        payload = page.payload if payloads else None
                        held.append((archive, offset, page.page_id, page.url, page.record_type, page.payload_bytes,
                                     page.payload_digest, page.refers_to, payload))
                        size += 256 + len(payload or b"")
                        if size >= batch_bytes:
                            yield _rows(held, RECORDS)
                            held, size = [], 0
                if held:
                    yield _rows(held, RECORDS)

    names = archives.select("archive")
    tasks = max(1, min(names.count(), 100_000))
    return names.repartition(tasks).mapInArrow(run, RECORDS)


def archives_in(spark, folder: str) -> DataFrame:
    """(archive): the archives that lie in a folder, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return found.select(F.regexp_replace("path", r"^file:/+", "file:///").alias("archive"))


def archived_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from its archive.

    A null html is the empty payload, which is a payload like others. Rows that
    repeat the least page_id of a payload are copies of one page: each is a
    response. A null page_id stays null and is never referred to; it refers to the
    least id of its payload, if any row has one. A null url is replaced by the
    record's own name. An empty table writes nothing. Other columns are not
    archived.
    """
    manifest = write_archives(pages, folder, least_bytes)
    return read_archives(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
