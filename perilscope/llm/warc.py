"""Zstandard WARC archives: written by tasks, read back frame by frame.

An archive starts with a skippable frame that holds the dictionary of all other frames; each
record is a frame of its own. The dictionary is trained from the first records of its archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.llm.frames import col_of, join_counted, materialise, small

# fixed values of the formats
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

DATE = "2025-01-01T00:00:00Z"
RECORD_ID = "<urn:perilscope:page:{}>"
#: Payload bytes of an archive, from which the next one is begun.
ARCHIVE_BYTES = 32 * 1024 * 1024
#: Bytes of the first records from which an archive's dictionary is trained, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 1024 * 1024, 16 * 1024

RECORDS = pa.schema(
    [
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("refers_to_id", pa.string()),
        ("target_uri", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean_uri(uri: str) -> str:
    """A header value must not hold line breaks or other control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def record_bytes(
    kind: str, record_id: str, payload: bytes, uri: str | None = None, refers_to: str | None = None
) -> bytes:
    """A response with its payload, or a revisit with the headers alone."""
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n" % len(payload)
    )
    block = http + payload if kind == "response" else http
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if uri is not None:
        headers.append(("WARC-Target-URI", clean_uri(uri)))
    if kind == "revisit":
        headers += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_frame(samples: list[bytes], size: int = DICTIONARY_BYTES) -> tuple[bytes, object]:
    """The leading skippable frame and the dictionary in it; empty if there is too little."""
    try:
        found = zstandard.train_dictionary(size, samples) if len(samples) >= 8 else None
    except zstandard.ZstdError:
        found = None
    data = found.as_bytes() if found else b""
    return struct.pack("<II", DICTIONARY_FRAME, len(data)) + data, found


def read_dictionary(data: bytes) -> tuple[object | None, int]:
    """The dictionary of an archive and where its records begin.

    The frame may hold the dictionary as it is or compressed. An archive without such a frame
    has no dictionary; one that is cut short is an error.
    """
    if len(data) < 8 or struct.unpack("<I", data[:4])[0] != DICTIONARY_FRAME:
        return None, 0
    end = 8 + struct.unpack("<I", data[4:8])[0]
    if end > len(data):
        raise WarcError("the dictionary frame is cut short")
    body = data[8:end]
    if body[:4] == ZSTD_FRAME:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return (zstandard.ZstdCompressionDict(body) if body else None), end


def parse_headers(raw: bytes, where: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"{where}: header line {line!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(data: bytes, where: str) -> dict:
    """A record checked against the format: version, headers, lengths, end and digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise WarcError(f"{where}: no WARC record")
    headers = parse_headers(lines, where)
    missing = [h for h in REQUIRED if h not in headers]
    if missing:
        raise WarcError(f"{where}: without {', '.join(missing)}")
    if not re.fullmatch(r"\d+", headers["content-length"]):
        raise WarcError(f"{where}: Content-Length {headers['content-length']!r}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"{where}: {len(rest) - 4} bytes in the block, not {length}")
    kind = headers["warc-type"]
    out = {
        "record_type": kind,
        "record_id": headers["warc-record-id"],
        "refers_to_id": headers.get("warc-refers-to"),
        "target_uri": headers.get("warc-target-uri"),
    }
    if kind not in ("response", "revisit"):
        return out | {"payload_bytes": length, "payload_digest": None, "payload": rest[:length]}
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap:
        raise WarcError(f"{where}: the HTTP headers have no end")
    inner = parse_headers(http.partition(b"\r\n")[2], where)
    full = int(inner.get("content-length", len(payload)))
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        if full != len(payload):
            raise WarcError(f"{where}: {len(payload)} payload bytes, not {full}")
        if digest is not None and digest != sha1_base32(payload):
            raise WarcError(f"{where}: the payload has another digest")
    elif out["refers_to_id"] is None or payload:
        raise WarcError(f"{where}: a revisit needs a reference and no payload")
    return out | {
        "payload_bytes": full,
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def read_archive(data: bytes, name: str) -> Iterator[dict]:
    """The records of an archive in order, one frame at a time.

    Raises WarcError for damaged frames, for a frame with other than one record, and for
    records that break the format.
    """
    dictionary, at = read_dictionary(data)
    view = memoryview(data)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        where = f"{name} at {at}"
        if bytes(view[at : at + 4]) != ZSTD_FRAME:
            raise WarcError(f"{where}: no frame")
        frame = reader.decompressobj()
        try:
            parts, step, pos = [], 1 << 16, at
            while not frame.eof and pos < len(data):
                parts.append(frame.decompress(view[pos : pos + step]))
                pos += step
        except zstandard.ZstdError as error:
            raise WarcError(f"{where}: {error}") from error
        if not frame.eof:
            raise WarcError(f"{where}: the frame is cut short")
        end = min(pos, len(data)) - len(frame.unused_data)
        yield {"archive": name, "offset": at} | parse_record(b"".join(parts), where)
        at = end


def archives_of(
    records: Iterable[tuple[bytes, int]], archive_bytes: int, sample_bytes: int
) -> Iterator[tuple[bytes, int]]:
    """Archives, with their numbers of records, of ``(record, payload bytes)``.

    Holds one archive at a time, with the records of its sample before they are compressed.
    """
    waiting: list[bytes] = []
    waited, compress, frames, size, count = 0, None, [], 0, 0

    def begin() -> None:
        nonlocal compress
        head, dictionary = dictionary_frame(waiting)
        # records of some kilobytes: the content size and a checksum are worth their bytes
        compress = zstandard.ZstdCompressor(
            level=3, dict_data=dictionary, write_checksum=True, write_content_size=True
        ).compress
        frames.append(head)
        frames.extend(compress(w) for w in waiting)

    for record, _ in records:
        size, count = size + len(record), count + 1
        if compress is None:
            waiting.append(record)
            waited += len(record)
            if waited >= sample_bytes:
                begin()
                waiting = []
        else:
            frames.append(compress(record))
        if size >= archive_bytes:
            if compress is None:
                begin()
            yield b"".join(frames), count
            waiting, waited, compress, frames, size, count = [], 0, None, [], 0, 0
    if count:
        if compress is None:
            begin()
        yield b"".join(frames), count


def plan_records(
    pages: DataFrame, id: str, url: str, html: str, min_bytes: int = 0
) -> DataFrame:
    """``id``, ``url``, ``html`` and ``refers_to`` of each page: the smallest id with an equal
    payload where that is another one, else null.

    Payloads of fewer than ``min_bytes`` bytes refer to nothing. Null ids come after all
    others, and with nothing but null ids every record is a response.
    """
    base = pages.select(
        col_of(id).alias("page_id"),
        col_of(url).cast("string").alias("url"),
        F.coalesce(col_of(html).cast("string"), F.lit("")).alias("html"),
    ).withColumn("_digest", F.sha2(F.col("html").cast("binary"), 256))
    equal = F.when(F.octet_length("html") >= min_bytes, F.col("_digest"))
    groups = materialise(
        base.select("page_id", equal.alias("_digest"))
        .where(F.col("_digest").isNotNull())
        .groupBy("_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
    )
    joined = join_counted(base.withColumn("_digest", equal), groups, ["_digest"], "n")
    other = ~F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    return joined.select(
        "page_id", "url", "html", F.when(other, F.col("first_id")).alias("refers_to")
    )


def write_archives(
    planned: DataFrame,
    folder: str,
    archive_bytes: int = ARCHIVE_BYTES,
    sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """Write the planned records under ``folder``, which all executors must reach; returns the
    finished archives: ``path``, ``records``, ``bytes``.

    A task attempt writes files of its own names, so a repeated or lost attempt disturbs
    nothing; only the files that the result names belong to the run.
    """

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                page, uri, html, refers = (v.as_py() for v in row)
                payload = html.encode()
                yield (
                    record_bytes(
                        "response" if refers is None else "revisit",
                        RECORD_ID.format("" if page is None else page),
                        payload,
                        uri,
                        None if refers is None else RECORD_ID.format(refers),
                    ),
                    len(payload),
                )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        # Hadoop writes file:/path where a URI has file:///path
        store, root = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))
        store.create_dir(root, recursive=True)
        for data, count in archives_of(records(batches), archive_bytes, sample_bytes):
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            yield pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{name}"], "records": [count], "bytes": [len(data)]}
            )

    return materialise(
        planned.select("page_id", "url", "html", "refers_to").mapInArrow(
            write, "path string, records bigint, bytes bigint"
        )
    )


def read_archives(
    spark: SparkSession,
    folder: str,
    written: DataFrame | None = None,
    with_payload: bool = True,
) -> DataFrame:
    """The records of the archives in a folder, one row each, in the columns of ``RECORDS``.

    Spark lists and reads the files, so any store will do that it knows; a file is one row of
    bytes, decoded one frame at a time. An archive with a fault ends the job with WarcError.
    With the result of ``write_archives``, files that it does not name are passed over.
    """
    schema = RECORDS if with_payload else RECORDS.remove(RECORDS.get_field_index("payload"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for record in read_archive(content.as_buffer().to_pybytes(), path.as_py()):
                    held += len(record["payload"] or b"") + 256
                    rows.append({f: record[f] for f in schema.names})
                    if held >= 8 * 1024 * 1024 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    types = {"int64": "bigint", "binary": "binary", "string": "string"}
    ddl = ", ".join(f"`{f.name}` {types[str(f.type)]}" for f in schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    if written is not None:
        name = F.regexp_extract("path", r"[^/]+$", 0)
        named = written.select(name.alias("name"))
        if small(named, 100):
            named = F.broadcast(named)
        files = files.withColumn("name", name).join(named, "name", "left_semi")
    return files.select("path", "content").mapInArrow(decode, ddl)


def page_of(record_id: str) -> object:
    """The page id in a record id, as text; null if there is none."""
    return F.nullif(F.regexp_extract(col_of(record_id), r"^<urn:perilscope:page:(.*)>$", 1), F.lit(""))


__all__ = [
    "RECORDS", "WarcError", "archives_of", "page_of", "plan_records",
    "read_archive", "read_archives", "record_bytes", "write_archives",
]
