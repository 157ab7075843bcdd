"""WARC records in seekable Zstandard bundles: independent frames, a footer seek table, and an index of records by frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkrow.llm._common import new_path, slices, stored

#: Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: A frame is closed at so many bytes of records, a bundle at so many bytes of frames.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
DATE = "2020-01-01T00:00:00Z"
INDEX = "record_id string, key string, path string, frame long, offset long, length long"


def filesystem(uri: str):
    """(file system, path in it) of a folder that all executors see."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def response_id(key: str, sha1: str) -> str:
    """Record id of the response for a key and payload: revisits name it without a look at the response. Rows that repeat both share it."""
    return str(uuid.uuid5(uuid.NAMESPACE_OID, f"{key} {sha1}"))


def written(kind: str, record_id: str, more: list[str], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}", f"Content-Length: {len(block)}", *more]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(record_id: str, key: str | None, url: str, payload: bytes, size: int, sha1: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: a response with its HTTP head and payload, or a revisit, whose block is the HTTP head alone.

    Both have size and digest of the full payload in their headers. Keys are in X-Key and X-Refers-To-Key, beside the standard fields; a null key has none.
    """
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    more = [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {size}"]
    if key is not None:
        more.append(f"X-Key: {quote(key)}")
    if refers_to is None:
        return written("response", record_id, more, block + payload)
    more += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{response_id(refers_to, sha1)}>", f"X-Refers-To-Key: {quote(refers_to)}"]
    return written("revisit", record_id, more, block)


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP head."""
    return block.partition(b"\r\n\r\n")[2]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return fields, rest[:n]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame: (compressed, plain) bytes of each frame, their number, flags and the magic number."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int]]:
    """(start, compressed bytes) of each frame, from the end of the file."""
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    file.seek(size - 9 - entry * n)
    raw, out, at = file.read(entry * n), [], 0
    for i in range(n):
        (compressed,) = struct.unpack_from("<I", raw, i * entry)
        out.append((at, compressed))
        at += compressed
    return out


class Bundle:
    """Writes one bundle; the records of a frame become readable without those of others."""

    def __init__(self, folder: str):
        self.fs, where = filesystem(folder)
        # the name is this attempt's own, so that a task that runs again leaves what the index of another refers to
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.where = f"{folder}/{self.name}", f"{where}/{self.name}"
        self.file = self.fs.open_output_stream(self.where, compression=None)
        self.frames, self.size, self.part, self.held = [], 0, [], 0
        self.add(written("warcinfo", str(uuid.uuid4()), ["Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n"))

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record."""
        place = len(self.frames), self.held
        self.part.append(raw)
        self.held += len(raw)
        if self.held >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.part:
            out = zstandard.ZstdCompressor(level=3).compress(b"".join(self.part))
            self.file.write(out)
            self.frames.append((len(out), self.held))
            self.size += len(out)
            self.part, self.held = [], 0

    def close(self) -> None:
        self.flush()
        self.file.write(seek_table(self.frames))
        self.file.close()


def with_first(pages: DataFrame, key: str, payload: str, least_bytes: int) -> DataFrame:
    """pages with payload (binary, null as empty), sha1 (hex) and refers_to: the smallest key of an equal payload, null for that record itself, for null keys alone and for payloads under least_bytes."""
    body = F.coalesce(F.encode(payload, "UTF-8"), F.lit(b""))
    own = pages.select(F.col(key).alias("key"), F.coalesce("url", F.lit("")).alias("url"), body.alias("payload")).withColumns({"sha1": F.sha1("payload"), "size": F.length("payload").cast("long")})
    # keys only, summed up on each side before the shuffle
    first = own.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("sha1", "size", "first")
    joined = own.join(first, ["sha1", "size"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record for every row of pages (key, url, payload) and returns the index, one row per record.

    Equal payloads of at least least_bytes bytes are written once, for the smallest key; the others become revisits
    of it, also those with a null key. Rows that repeat key and payload of a response are responses too. Null payload
    counts as empty, null url as the empty one. Every task writes bundles of its own; index rows point to those of
    the attempt that succeeded: path, frame, offset and length in the plain frame.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    fs, where = filesystem(folder)
    fs.create_dir(where, recursive=True)

    def run(batches):
        bundle = None
        for batch in slices(batches, 200):
            out = []
            for row in batch.to_pylist():
                if bundle and bundle.size >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
                bundle = bundle or Bundle(folder)
                own = None if row["key"] is None else str(row["key"])
                sha1 = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                refers = None if row["refers_to"] is None else str(row["refers_to"])
                record_id = str(uuid.uuid4()) if own is None or refers is not None else response_id(own, sha1)
                raw = record(record_id, own, row["url"], row["payload"], row["size"], sha1, refers)
                frame, offset = bundle.add(raw)
                out.append((record_id, own, bundle.path, frame, offset, len(raw)))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["record_id", "key", "path", "frame", "offset", "length"])
        if bundle:
            bundle.close()

    return stored(with_first(pages, key, payload, least_bytes).mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, verify: bool = True) -> DataFrame:
    """The records that the rows of index point to: key, record_type, refers_to, payload_bytes, payload_digest and block (a response's payload; a revisit has none).

    Each row is looked up in the seek table of its bundle; only its frame is read, and all columns, keys too, come from the record. With verify, a
    response whose payload doesn't have the digest in its header fails. Index rows that stand in order of path and frame read each frame once.
    """

    def run(batches):
        path, file, table, at, plain = None, None, None, None, b""
        for batch in slices(batches, 200):
            out = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    fs, where = filesystem(row["path"])
                    file, path, at = fs.open_input_file(where), row["path"], None
                    table = read_seek_table(file, file.size())
                if row["frame"] != at:
                    at = row["frame"]
                    start, n = table[at]
                    file.seek(start)
                    plain = zstandard.ZstdDecompressor().decompress(file.read(n))
                fields, block = parse(plain[row["offset"] : row["offset"] + row["length"]])
                sha1, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                size = int(fields["X-Payload-Length"])
                payload = payload_of(block)
                if kind == "response":
                    if verify and (digest(payload), len(payload)) != (sha1, size):
                        raise ValueError(f"record {row['record_id']} doesn't have the payload that its header names")
                own, refers = (None if x is None else unquote(x) for x in (fields.get("X-Key"), fields.get("X-Refers-To-Key")))
                out.append((own, kind, refers, size, sha1, payload))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "record_type", "refers_to", "payload_bytes", "payload_digest", "block"])

    return index.mapInArrow(run, "key string, record_type string, refers_to string, payload_bytes long, payload_digest string, block binary")


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The records of the given keys (column key), by seeking."""
    return read(index.join(keys.select(F.col("key").cast("string")).distinct(), "key", "left_semi").sortWithinPartitions("path", "frame", "offset"))


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the archives of pages, reads them back and returns one row per page: key, payload_bytes, payload_digest, record_type, refers_to."""
    kind = pages.schema[key].dataType
    index = write(pages, key=key, payload=payload, least_bytes=least_bytes)
    return read(index).select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
