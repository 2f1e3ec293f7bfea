"""WARC archives in Zstandard, written and read back.

An archive starts with a skippable frame that holds the compression dictionary (trained on the archive's first
records); after it each record is a frame of its own, so records can be read one by one. The reader loads the
dictionary, decodes frame after frame, and checks the version line, mandatory headers, lengths, the record's end and
the payload's digest. Archives hold about ARCHIVE bytes of payload, are made in the task that reads their pages, and
are rows of a table in the shared folder.

Of records with equal payloads of at least LEAST bytes, the one with the smallest page_id is a response and the
others are revisits without payload. Digests are grouped in Spark, and only those that repeat meet the pages again.

Defined results: a null html is an empty payload, a null url a record without target. Line breaks in a url, and
blanks at its ends, come back percent-encoded. Rows that repeat a page_id and payload are all responses if that id
is the smallest. A null page_id never is the smallest unless all are null. An empty table gives an empty result.
Columns other than page_id, url and html are ignored. A damaged record has its error in a column, and null elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kawara.llm.common import BROADCAST_IDS, bounded_batches, written

LEAST = 100
ARCHIVE = 4 << 20
LEVEL = 3
#: A dictionary is trained from this many payloads, and has this size at most.
SAMPLES, DICTIONARY = 64, 16 << 10
MAGIC = (0x184D2A5D).to_bytes(4, "little")
_ZSTD = (0xFD2FB528).to_bytes(4, "little")
_SKIPPABLE = 0x184D2A5
MANDATORY = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length")
#: Records say when they were made; a fixed time keeps archives of equal pages equal.
DATE = "2024-01-01T00:00:00Z"

_ID = re.compile(r"<urn:page:(-?\d*)>")
_DIGEST = re.compile(r"sha256:([0-9a-f]{64})")


def _one_line(url: str) -> str:
    """A url as a header's value: line breaks and outer blanks, which a header cannot hold, percent-encoded."""
    ends = url[: len(url) - len(url.lstrip())], url[len(url.rstrip()) :] if url.strip() else ""
    inner = url[len(ends[0]) : len(url) - len(ends[1])]
    return quote(ends[0]) + inner.replace("\r", "%0D").replace("\n", "%0A") + quote(ends[1])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """The bytes of a record: a response, or a revisit if refers_to is given."""
    name = "" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_one_line(url)}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        lines.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    try:
        trained = zstandard.train_dictionary(DICTIONARY, [r[:16384] for r in records[:SAMPLES]]).as_bytes() if len(records) >= 8 else b""
    except zstandard.ZstdError:  # too little to learn from
        trained = b""
    head = zstandard.ZstdCompressor(level=LEVEL).compress(trained) if trained else b""
    known = zstandard.ZstdCompressionDict(trained) if trained else None
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *map(pack.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at a place ends, from its header and its blocks' headers; nothing is decoded or copied."""
    head = bytes(data[at : at + 18])
    end, checksum = at + zstandard.frame_header_size(head), zstandard.get_frame_parameters(head).has_checksum
    while True:
        block = int.from_bytes(data[end : end + 3], "little")
        if end + 3 > len(data) or block >> 1 & 3 == 3:
            raise ValueError(f"the frame at byte {at} is cut off or damaged")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a run is one byte
        if block & 1:
            break
    end += 4 * checksum
    if end > len(data):
        raise ValueError(f"the frame at byte {at} is cut off")
    return end


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one from each frame. The dictionary may be plain or compressed itself.

    Skippable frames further on are passed over. The time is in proportion to the archive's length.
    """
    known, at = None, 0
    if data[:4] == MAGIC:
        size = int.from_bytes(data[4:8], "little")
        held, at = data[8 : 8 + size], 8 + size
        if len(held) < size:
            raise ValueError("the dictionary's frame is cut off")
        if held[:4] == _ZSTD:
            held = zstandard.ZstdDecompressor().decompress(held)
        known = zstandard.ZstdCompressionDict(held) if held else None
    view = memoryview(data)
    unpack = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(data):
        mark = int.from_bytes(view[at : at + 4], "little")
        if mark >> 4 == _SKIPPABLE:
            at += 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if at > len(data):
                raise ValueError("a skippable frame is cut off")
            continue
        if bytes(view[at : at + 4]) != _ZSTD:
            raise ValueError(f"no frame at byte {at}")
        end = frame_end(view, at)
        yield unpack.decompressobj().decompress(view[at:end])
        at = end


def fields(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def read_record(data: bytes) -> dict:
    """The checked contents of one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    own = fields(lines[1:])
    if missing := [x for x in MANDATORY if x.lower() not in own]:
        raise ValueError(f"missing headers: {missing}")
    length = int(own["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}; the block has {len(rest) - 4} bytes")
    block = rest[:length]
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP head")
    size = int(fields(http.decode().split("\r\n")[1:])["content-length"])
    name, digest = _ID.fullmatch(own["warc-record-id"]), _DIGEST.fullmatch(own.get("warc-payload-digest", ""))
    if not name or not digest:
        raise ValueError("no usable WARC-Record-ID or WARC-Payload-Digest")
    kind, refers = own["warc-type"], None
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest[1]:
            raise ValueError("the payload differs from its length or digest")
    elif kind == "revisit":
        refers = _ID.fullmatch(own.get("warc-refers-to", ""))
        if payload or not refers:
            raise ValueError("a revisit has a payload or refers to nothing")
        refers = int(refers[1])
    else:
        raise ValueError(f"unknown WARC-Type {kind!r}")
    return {
        "page_id": int(name[1]) if name[1] else None, "url": own.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": digest[1], "record_type": kind, "refers_to": refers, "payload": payload, "error": None,
    }


def written_archives(pages: DataFrame) -> DataFrame:
    """The pages' records as rows (archive): written to the shared folder."""
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = rows.where(F.octet_length("payload") >= LEAST)
    again = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    short = again.limit(BROADCAST_IDS // 8 + 1).count() <= BROADCAST_IDS // 8
    rows = rows.join(F.broadcast(again) if short else again, "digest", "left")
    other = (F.octet_length("payload") >= LEAST) & ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    rows = rows.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, payload, digest, len(payload), refers_to))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([archive(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([archive(held)], pa.binary())})

    return written(rows.mapInArrow(run, "archive binary"), "warc")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of archives, a DataFrame whose first column is binary: a table of archives, or the content column
    of Spark's binaryFile source. With payloads, a column has the payload (null for revisits)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = READ + ", payload binary" * payloads
    target = to_arrow_schema(_parse_datatype_string(schema))

    def records(data: bytes) -> Iterator[dict]:
        try:
            for frame in frames(data):
                try:
                    yield read_record(frame)
                except (ValueError, KeyError) as e:
                    yield {"error": str(e)}
        except (ValueError, zstandard.ZstdError) as e:
            yield {"error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = list(records(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in target], schema=target)

    return archives.select(archives.columns[0]).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Each page's record as read back from the archives that it was written to."""
    return read_archives(written_archives(pages))
