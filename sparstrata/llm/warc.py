"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of a few records, that
ends with a seek table in a skippable frame. Any Zstandard reader unpacks it
whole; with the table one frame is read by its place. The index maps record
identifiers to (bundle, frame, offset in the frame).
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, fresh_path, restored, saved, with_groups

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
#: Tasks at most that read bundles back.
READ_TASKS = 4096

# Fixed values of the seekable format: a skippable frame's magic number, the table's own, and its flags.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
NO_CHECKSUMS = 0

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame of (packed, unpacked) sizes and a footer of 9 bytes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), NO_CHECKSUMS, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """Frames of an open bundle as (place, packed size, unpacked size)."""
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags != NO_CHECKSUMS:
        raise ValueError("not a bundle with a seek table")
    file.seek(size - 9 - 8 * count)
    numbers = struct.unpack(f"<{2 * count}I", file.read(8 * count))
    frames, at = [], 0
    for packed, unpacked in zip(numbers[::2], numbers[1::2], strict=True):
        frames.append((at, packed, unpacked))
        at += packed
    return frames


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(parts))}>"


def one_line(value: str) -> str:
    """A header value: line ends and per cent signs are escaped."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in value for c in "\r\n") else value


def make_record(own_id: str, page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record. A revisit holds the HTTP header alone, which tells the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record starts here")
    header = dict(line.split(": ", 1) for line in lines[1:])
    begin = stop + 4
    end = begin + int(header["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return header, data[begin:end], end + 4


@dataclass
class Bundle:
    """A bundle being written: records gather into frames, frames into the file."""

    frame_bytes: int
    name: str = ""
    file: io.BytesIO = field(default_factory=io.BytesIO)
    frames: list[tuple[int, int]] = field(default_factory=list)
    open_frame: list[bytes] = field(default_factory=list)
    open_bytes: int = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset in it."""
        place = len(self.frames), self.open_bytes
        self.open_frame.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= self.frame_bytes:
            self.close_frame()
        return place

    def close_frame(self) -> None:
        if self.open_frame:
            import zstandard

            packed = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(self.open_frame))
            self.file.write(packed)
            self.frames.append((len(packed), self.open_bytes))
            self.open_frame, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        self.file.write(seek_table(self.frames))
        return self.file.getvalue()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row into bundles under ``folder``; the written index of them.

    Of records with equal payloads of ``min_revisit_bytes`` or more, that with the
    smallest id is the response and the others revisit it. Rows that repeat
    both id and payload are responses alike. A null payload is empty, a null
    url too. Rows with a null id are always responses and never referred to.
    Tasks name files uniquely and the index lists those of successful tasks
    alone, so a task that runs again leaves no doubt.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"),
    )
    known = rows.where(F.col("id").isNotNull() & (F.col("n") >= min_revisit_bytes))
    copies = known.groupBy("digest", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = saved(copies, "copies")
    decided = with_groups(rows, copies, ["digest", "n"], "copies", F.col("id")).select(
        carried("id").alias("id"), "url", "payload", F.when(F.col("first") < F.col("id"), F.col("first")).cast("string").alias("refers_to")
    )
    kind = pages.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("record_id", T.StringType()), T.StructField("id", T.StringType()), T.StructField("bundle", T.StringType())]
        + [T.StructField("frame", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        bundle, index = None, []

        def close() -> pd.DataFrame:
            with files.open_output_stream(f"{path}/{bundle.name}", compression=None) as out:
                out.write(bundle.finish())
            found = pd.DataFrame(index, columns=schema.names)
            index.clear()
            return found

        for pdf in batches:
            for page, url, text, first in zip(pdf["id"].tolist(), pdf["url"], pdf["payload"], pdf["refers_to"].tolist(), strict=True):
                data = text.encode()
                digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
                own_id = record_id(page, digest)
                if bundle is None:
                    bundle = Bundle(frame_bytes, f"{uuid.uuid4().hex}.warc.zst")
                index.append((own_id, page, bundle.name, *bundle.add(make_record(own_id, page, url, data, digest, first))))
                if bundle.file.tell() >= bundle_bytes:
                    yield close()
                    bundle = None
        if bundle is not None:
            yield close()

    return saved(decided.mapInPandas(write, schema).withColumn("id", restored("id", kind)), "warc-index")


RECORD = "record_id string, id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string"
NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _typed(records: DataFrame, id_col: str, kind: T.DataType) -> DataFrame:
    ids = {"id": restored("id", kind).alias(id_col), "refers_to": restored("refers_to", kind).alias("refers_to")}
    return records.select(*[ids.get(c, F.col(c)) for c in NAMES])


def _parsed(header: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
    digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
    if header["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {header['WARC-Record-ID']} is damaged")
    return header["WARC-Record-ID"], header.get("X-Page-ID"), length, digest, header["WARC-Type"], header.get("X-Refers-To-Page-ID"), header["WARC-Target-URI"]


def read_bundles(index: DataFrame, folder: str, id_col: str = "page_id") -> DataFrame:
    """Read whole bundles, frame by frame through their seek tables; one row per record, payloads checked.

    Ids are null where they were, url and payload are those written. An empty
    index gives no rows.
    """
    kind = index.schema["id"].dataType

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        files, path = _filesystem(folder)
        for pdf in batches:
            for name in pdf["bundle"]:
                size = files.get_file_info(f"{path}/{name}").size
                with files.open_input_file(f"{path}/{name}") as f:
                    for at, packed, unpacked in read_seek_table(f, size):
                        f.seek(at)
                        data, place, rows = zstandard.ZstdDecompressor().decompress(f.read(packed), unpacked), 0, []
                        while place < len(data):
                            header, block, place = read_record(data, place)
                            rows.append(_parsed(header, block))
                        yield pd.DataFrame(rows, columns=NAMES)

    # names are small but stand for whole files: a set number of partitions is not coalesced by their size
    bundles = index.select("bundle").distinct()
    found = bundles.repartition(max(1, min(bundles.count(), READ_TASKS)), "bundle").mapInPandas(read, RECORD)
    return _typed(found, id_col, kind)


def lookup(index: DataFrame, folder: str, wanted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Records of ``wanted`` ids, each by one seek: only the frames that hold them are read.

    Ids that repeat are looked up once, those that are null or not in the index
    give no row; an id of several records gives all of them.
    """
    kind = index.schema["id"].dataType

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        files, path = _filesystem(folder)
        for pdf in batches:
            rows = []
            for name, part in pdf.groupby("bundle"):
                size = files.get_file_info(f"{path}/{name}").size
                with files.open_input_file(f"{path}/{name}") as f:
                    frames = read_seek_table(f, size)
                    for frame, places in part.groupby("frame")["offset"]:
                        at, packed, unpacked = frames[frame]
                        f.seek(at)
                        data = zstandard.ZstdDecompressor().decompress(f.read(packed), unpacked)
                        rows += [_parsed(*read_record(data, place)[:2]) for place in places]
            yield pd.DataFrame(rows, columns=NAMES)

    ids = wanted.select(F.col(id_col).alias("id")).distinct()
    found = index.join(ids, "id", "left_semi").select("bundle", "frame", "offset")
    return _typed(found.mapInPandas(read, RECORD), id_col, kind)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write archives into the shared folder and read them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    index = write_bundles(pages, folder, id_col, url_col, payload_col, min_revisit_bytes)
    return read_bundles(index, folder, id_col)
