"""Zstandard-compressed web archives: one frame for each record, the dictionary in a leading skippable frame.

``write_archives`` writes rolled archives of bounded size into a folder that all executors share, and returns
their list; ``read_archives`` reads such files as rows and validates every header, length and digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, written

#: Fixed values of the formats: magic numbers of the dictionary's skippable frame and of a frame; the profile of a revisit.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_PROFILES = (
    REVISIT_PROFILE,
    "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
    "http://netpreserve.org/warc/1.1/revisit/server-not-modified",
    "http://netpreserve.org/warc/1.0/revisit/server-not-modified",
)
#: Skippable frames are those whose magic number is one of 16 from this one on.
SKIPPABLE_MAGIC = 0x184D2A50

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLES = 200
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

RECORDS = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, archive string, error string"
)


def _record_id(page_id: int | None, digest: str) -> str:
    value = uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}") if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, digest)
    return f"<urn:uuid:{value}>"


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: its header, an HTTP response (without the payload for a revisit) and the two line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Fields that every record has, and types of records beside responses and revisits: these are passed through.
NEEDED = {"warc-type", "warc-record-id", "warc-date", "content-length"}
OTHER_TYPES = {"warcinfo", "request", "metadata", "resource", "conversion", "continuation"}


def _is_digest_of(label: str, data: bytes) -> bool:
    """Whether a labelled digest (sha256 or sha1, as hex or base 32) is that of ``data``; other algorithms are not held against it."""
    algorithm, colon, value = label.partition(":")
    if not colon or not value:
        raise ValueError("bad digest")
    if algorithm.lower() not in ("sha1", "sha256"):
        return True
    digest = hashlib.new(algorithm.lower(), data).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def _parse_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no record header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if line[:1] in " \t" and fields:  # a folded line goes on with the one before
            fields[next(reversed(fields))] += " " + line.strip()
            continue
        if not colon or not name or name.lower() in fields and name.lower() != "warc-concurrent-to":
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    return fields


def parse_record(data: bytes) -> dict:
    """The fields of one record; ValueError if a header, a length or a digest is wrong.

    Responses and revisits of web pages have their payload's length and SHA-256; where a record names another digest, it is checked
    as well. Records of other types are passed through with their block as payload.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    fields = _parse_fields(head)
    if not gap:
        raise ValueError("no record header")
    if lost := NEEDED - fields.keys():
        raise ValueError(f"missing {', '.join(sorted(lost))}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    block, kind = rest[:-4], fields["warc-type"]
    if "warc-block-digest" in fields and not _is_digest_of(fields["warc-block-digest"], block):
        raise ValueError("the block does not have its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    out = {"page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("x-refers-to-page-id")}
    web = fields.get("content-type", "application/http").lower().startswith("application/http")
    if kind in OTHER_TYPES or kind == "response" and not web:
        return out | {"payload": block, "payload_bytes": len(block), "payload_digest": hashlib.sha256(block).hexdigest()}
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?mi)^content-length: *(\d+)\r?$", http)
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    label = fields.get("warc-payload-digest", "")
    own = label.removeprefix("sha256:") if re.fullmatch("sha256:[0-9a-f]{64}", label) else None
    if kind == "response":
        # Bodies that were sent in chunks or compressed have lengths of their own, if any.
        encoded = re.search(rb"(?mi)^(transfer|content)-encoding:", http)
        if length and not encoded and len(payload) != int(length[1]) or label and not _is_digest_of(label, payload):
            raise ValueError("the payload does not have its length or digest")
        return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": own or hashlib.sha256(payload).hexdigest()}
    if kind != "revisit" or payload or fields.get("warc-profile") not in REVISIT_PROFILES or "warc-refers-to" not in fields and "warc-refers-to-target-uri" not in fields:
        raise ValueError(f"bad record of type {kind[:20]}")
    if not re.fullmatch("[A-Za-z0-9]+:[A-Za-z0-9=+/_-]+", label):
        raise ValueError("bad payload digest")
    return out | {"payload": None, "payload_bytes": int(length[1]) if length else None, "payload_digest": own or label}


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends: its block headers are followed; ValueError if it is cut off."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError("no frame")
    flags = data[at + 4]
    single, size_flag = flags >> 5 & 1, flags >> 6
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[size_flag]
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last = block & 1
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive; a bad frame or record gives a row with ``error`` instead.

    A dictionary is read from a skippable frame at the beginning, other skippable frames are passed over; frames need not tell
    the size of their content.
    """
    import zstandard

    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw, at = bytes(data[8 : 8 + size]), 8 + size
        if len(raw) != size:
            yield {"error": "the dictionary is cut off"}
            return
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        dictionary = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] & ~15 == SKIPPABLE_MAGIC:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                yield {"error": "a skippable frame is cut off"}
            continue
        try:
            end = frame_end(data, at)
        except ValueError as e:
            yield {"error": str(e)}
            return  # what follows can't be told apart
        try:
            yield parse_record(reader.decompressobj().decompress(data[at:end]))
        except (ValueError, zstandard.ZstdError) as e:
            yield {"error": str(e)[:200] or "bad record"}
        at = end


def compress_archive(records: list[bytes]) -> bytes:
    """An archive of these records, its dictionary trained on some of them."""
    import zstandard

    step = max(1, len(records) // SAMPLES)
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, [r[: 16 << 10] for r in records[::step]], k=256, d=8)
    except (zstandard.ZstdError, ValueError):  # too few or too small samples
        dictionary = zstandard.ZstdCompressionDict(records[0][:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(writer.compress, records)])


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> + payload, payload_bytes, payload_digest, refers_to.

    Of rows with equal payloads of at least ``MIN_REVISIT_BYTES``, all but the smallest page_id refer to it.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", payload.alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    large = F.col("payload_bytes") >= MIN_REVISIT_BYTES
    copies = written(
        p.where(large).groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"),
        "copies",
    )
    # A short payload has a key of its own, so that null keys don't meet in one task.
    key = F.when(large, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    p = p.withColumn("_key", key)
    joined = p.join(copies, p["_key"] == copies["_digest"], "left")
    other = F.col("page_id").isNull() | (F.col("refers_to") != F.col("page_id"))
    return joined.withColumn("refers_to", F.when(other, F.col("refers_to"))).drop("_key", "_digest")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``with_revisits`` into archives under ``folder`` (a URI); returns name, n_records, n_bytes.

    Each attempt of a task writes under names of its own; only those of the attempt that succeeds are in
    the returned list, so a lost executor leaves no record twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def flush(ready: list[bytes]) -> pa.RecordBatch:
            name, content = f"{uuid.uuid4().hex}.warc.zst", compress_archive(ready)
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(content)
            return pa.RecordBatch.from_pydict({"name": [name], "n_records": pa.array([len(ready)], pa.int64()), "n_bytes": pa.array([len(content)], pa.int64())})

        ready, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                ready.append(format_record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"], r["refers_to"] is not None))
                size += len(ready[-1])
                if size >= archive_bytes:
                    yield flush(ready)
                    ready, size = [], 0
        if ready:
            yield flush(ready)

    cols = records.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return written(cols.mapInArrow(write, "name string, n_records long, n_bytes long"), "archives")


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """(path, content) rows, as of ``binaryFile``, -> a row for each record (``RECORDS``); bad ones have ``error``."""
    import pyarrow as pa

    fields = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "error"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(fields, types, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                out, size = [], 0
                for r in read_archive(content or b""):
                    size += len(r.get("payload") or b"")
                    out.append({k: None for k in fields} | r | {"archive": path} | ({} if with_payload else {"payload": None}))
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return files.select("path", "content").mapInArrow(read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into the shared folder and read them back.

    Null html is an empty payload; a null page_id or url has no such header. Repeated rows each have their
    record; rows equal in payload and page_id to the smallest are responses as well. A page of any length is one record, and an archive of its own
    if it is longer than those. An empty table gives no rows; other columns are not archived.
    """
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    made = write_archives(with_revisits(pages), folder)
    if made.isEmpty():
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").load(f"{folder}/*.warc.zst")
    name = F.element_at(F.split("path", "/"), -1)
    # Archives of attempts that failed aren't in the list.
    files = files.select("path", "content", name.alias("name")).join(made.select("name"), "name", "left_semi")
    return read_archives(files, with_payload=False)
