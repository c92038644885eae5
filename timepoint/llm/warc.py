"""WARC archives in seekable Zstandard bundles.

Each task streams its records into bundle files. Records are gathered into frames of about ``FRAME`` bytes, each an
independent Zstandard frame; after the last one stands a seek table (a skippable frame of compressed and plain sizes of
all frames, with the magic number of the seekable format at the very end). The index maps a record's id to its bundle,
frame and place within the frame, so any record is read by the seek table and one frame.

Payloads that occur more than once are found by digest before anything is written; only those digests are joined to the
pages. The page with the smallest id is written as a response, others as revisits without payload that refer to it.

A lost task writes its bundles again under new names; only what a finished task reported is in the index, which Spark
commits. Files are reached by pyarrow's file systems, so the folder may be in any store that pyarrow opens.

Defined results: a null payload is empty; null ids come after all others, and where only null ids share a payload all
are responses; rows that repeat the smallest id are responses too; line breaks in a URL are percent-encoded, a null URL
is left out; empty tables give an empty index. Extra columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timepoint.llm.common import column, written

FRAME = 1 << 20
BUNDLE = 256 << 20
#: Bytes of records that a task unpacks, and neighbouring frames that stay together.
READ_BYTES = 64 << 20
RUN = 16
LEVEL = 3
#: Numbers of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id bigint, bundle string, frame int, at int, size int"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None) -> bytes:
    """One record, header and block."""
    block = b"" if revisits else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisits:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>")
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """A record's fields; a response whose payload does not have its digest raises an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"no whole record: {first}")
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (digest(block) != sha1 or len(block) != int(fields["X-Payload-Length"])):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")

    def page(name: str) -> int | None:
        inner = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(inner) if inner else None

    return {
        "page_id": page("WARC-Record-ID"), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": sha1,
        "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "url": fields.get("WARC-Target-URI"),
        "payload": None if fields["WARC-Type"] == "revisit" else block,
    }


class Bundle:
    """Writes one file of frames and, at its end, the seek table."""

    def __init__(self, folder: str, frame: int):
        self.system, path = place(folder)
        self.name, self.limit = f"{uuid.uuid4().hex}.warc.zst", frame
        self.file = self.system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.sizes: list[tuple[int, int]] = []
        self.pending, self.pending_size, self.written = [], 0, 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame and place of the record."""
        spot = len(self.sizes), self.pending_size
        self.pending.append(raw)
        self.pending_size += len(raw)
        if self.pending_size >= self.limit:
            self._flush()
        return spot

    def _flush(self) -> None:
        if self.pending:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(self.pending))
            self.file.write(packed)
            self.sizes.append((len(packed), self.pending_size))
            self.written += len(packed)
            self.pending, self.pending_size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


def seek_table(file: pyarrow.NativeFile) -> list[tuple[int, int, int]]:
    """Offset, packed size and plain size of each frame, from the end of a bundle."""
    end = file.size()
    count, _, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    frames, offset = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read_at(8 * count, end - 9 - 8 * count)):
        frames.append((offset, packed, plain))
        offset += packed
    return frames


def read_frame(file: pyarrow.NativeFile, frame: tuple[int, int, int]) -> bytes:
    offset, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(file.read_at(packed, offset), max_output_size=plain)


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html (binary), revisits and refers_to; the pages themselves are shuffled only if many payloads repeat."""
    key = F.sha2("html", 256)
    known = pages.select("page_id", key.alias("key"), F.octet_length("html").alias("n"))
    # A table of its own, so that its size is known: few repeated payloads are then broadcast, many are not.
    repeated = written(
        known.where(F.col("n") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("key", "first"),
        "repeated",
    )
    later = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return (
        pages.withColumn("key", key).join(repeated, "key", "left")
        .select("page_id", "url", "html", later.alias("revisits"), F.when(later, F.col("first")).alias("refers_to"))
    )


def write_archive(
    pages: DataFrame,
    folder: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit_bytes: int = 0,
    frame: int = FRAME,
    bundle: int = BUNDLE,
) -> DataFrame:
    """Write a record for each row; returns the index (``INDEX``), from a written table."""
    rows = pages.select(
        column(pages, page_id).cast("bigint").alias("page_id"), column(pages, url).alias("url"),
        F.coalesce(column(pages, html).cast("binary"), F.lit(b"")).alias("html"),
    )
    system, path = place(folder)
    system.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, names = None, ["page_id", "bundle", "frame", "at", "size"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            spots = []
            for values in zip(*(batch.column(c) for c in ("page_id", "url", "html", "revisits", "refers_to"))):
                number, *rest = (v.as_py() for v in values)
                if out is None:
                    out = Bundle(folder, frame)
                raw = record(number, *rest)
                spots.append((number, out.name, *out.add(raw), len(raw)))
                if out.written >= bundle:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*spots), types)] if spots else [pa.array([], t) for t in types], names)
        if out is not None:
            out.close()

    return written(with_revisits(rows, min_revisit_bytes).mapInArrow(write, INDEX), "warc-index")


def read_archive(index: DataFrame, folder: str, *, payloads: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records of an index (``RECORD``), each frame of which is read and unpacked once.

    Frames are dealt over tasks by what they unpack to, which the index alone does not show.
    """
    unpacked = index.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    tasks = max(1, -(-unpacked // read_bytes))
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("page_id", "at", "size")).alias("records"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = place(folder)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        name, file, table = None, None, []
        for batch in batches:
            for bundle, number, records in zip(*(batch.column(c) for c in ("bundle", "frame", "records"))):
                if bundle.as_py() != name:
                    if file is not None:
                        file.close()
                    name = bundle.as_py()
                    file = system.open_input_file(f"{path}/{name}")
                    table = seek_table(file)
                plain, rows = read_frame(file, table[number.as_py()]), []
                for spot in records.as_py():
                    row = parsed(plain[spot["at"] : spot["at"] + spot["size"]])
                    if row["page_id"] != spot["page_id"]:
                        raise ValueError(f"another record stands where {spot['page_id']} should")
                    rows.append({**row, "payload": row["payload"] if payloads else None})
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)
        if file is not None:
            file.close()

    return frames.repartition(tasks, "bundle", F.floor(F.col("frame") / RUN)).sortWithinPartitions("bundle", "frame").mapInArrow(read, RECORD)
