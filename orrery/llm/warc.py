"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import Staging, cut, delete, join_small, shared_dir

#: Fixed values of the public formats (Zstandard frames, WARC-Zstandard, WARC 1.1).
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame: what Spark's text writer puts behind each frame in place of a line end.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"

RECORD_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


class ArchiveError(ValueError):
    """An archive that breaks the format, or a record whose headers, lengths or digest do not fit."""


# --- frames --------------------------------------------------------------------------------------------------------


def frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic, bytes) of each frame: a whole Zstandard frame, or a skippable frame's content. Nothing is decoded."""
    at, end = 0, len(data)
    while at < end:
        if end - at < 8:
            raise ArchiveError(f"{end - at} stray bytes at {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            if at + 8 + size > end:
                raise ArchiveError(f"skippable frame at {at} runs past the end")
            yield magic, data[at + 8 : at + 8 + size]
            at += 8 + size
        elif magic == FRAME_MAGIC:
            stop = _frame_end(data, at)
            yield magic, data[at:stop]
            at = stop
        else:
            raise ArchiveError(f"no frame at {at}")


def _frame_end(data: memoryview, at: int) -> int:
    try:
        flags = data[at + 4]
        single = flags >> 5 & 1
        sizes = (single, 2, 4, 8)[flags >> 6] if flags >> 6 or single else 0
        pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + sizes
        last = False
        while not last:
            head = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            if kind == 3:
                raise ArchiveError(f"reserved block in the frame at {at}")
            pos += 3 + (1 if kind == 1 else size)
        pos += 4 * (flags >> 2 & 1)
    except IndexError:
        pos = len(data) + 1
    if pos > len(data):
        raise ArchiveError(f"frame at {at} runs past the end")
    return pos


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


# --- records -------------------------------------------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit of refers_to that keeps the payload's HTTP headers and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header_value(uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"bad header line {line[:80]!r}")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def parse_record(record: bytes) -> dict:
    """The record's fields; version, required headers, lengths and digest are checked."""
    first, _, rest = record.partition(b"\r\n")
    if not first.startswith(b"WARC/1."):
        raise ArchiveError(f"no WARC version: {first[:40]!r}")
    head, blank, body = rest.partition(b"\r\n\r\n")
    if not blank:
        raise ArchiveError("headers do not end")
    h = _headers(head)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ArchiveError(f"{name} is missing")
    if not h["content-length"].isdigit() or len(body) != int(h["content-length"]) + 4 or body[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"content-length {h['content-length']} does not fit {len(body)} bytes")
    block = body[:-4]
    http_head, blank, payload = block.partition(b"\r\n\r\n")
    if not blank or not http_head.startswith(b"HTTP/"):
        raise ArchiveError("no HTTP headers in the block")
    told = _headers(http_head.partition(b"\r\n")[2]).get("content-length", "")
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = h["warc-type"]
    if kind == "response" and (told != str(len(payload)) or digest != base32_sha1(payload)):
        raise ArchiveError("the payload's length or digest does not fit")
    if kind == "revisit" and (payload or "warc-refers-to" not in h or not told.isdigit()):
        raise ArchiveError("a revisit holds a payload, or lacks its reference or length")
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"record type {kind!r}")
    bare = lambda x: x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x
    return {"record_id": bare(h["warc-record-id"]), "record_type": kind, "target_uri": h.get("warc-target-uri"), "refers_to": bare(h.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": int(told), "payload": payload}


def read_archive(data: bytes | memoryview) -> Iterator[dict]:
    """The records of one archive; its dictionary is the content of the leading skippable frame, if it has one."""
    decoder = zstandard.ZstdDecompressor()
    for n, (magic, content) in enumerate(frames(memoryview(data).cast("B"))):
        if n == 0 and magic == DICTIONARY_MAGIC:
            raw = bytes(content)
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the format lets the dictionary be compressed itself
                raw = zstandard.ZstdDecompressor().decompress(raw)
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == FRAME_MAGIC:
            try:
                plain = decoder.decompress(content, max_output_size=0)
            except zstandard.ZstdError as e:
                raise ArchiveError(f"frame {n}: {e}") from None
            yield parse_record(plain)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most size bytes; where samples are too few or too alike, their own first bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return record_bytes("urn:page:0", "http://", b"", base32_sha1(b""), None) + b"".join(samples)[: size // 2]


# --- tables --------------------------------------------------------------------------------------------------------


def write_archives(df: DataFrame, path: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0, records: int = 2000, dictionary_bytes: int = 32_768, samples: int = 128, sample_bytes: int = 8192, level: int = 3, archive_bytes: int = 32 << 20) -> None:
    """One record per row into archives under path, by Spark's own text writer.

    An archive has at most `records` records and archive_bytes bytes, or a single record: a reader's task holds one.
    Of rows with equal payloads of at least revisit_bytes bytes the one with the largest id is the response and the
    others revisit it; rows that repeat that id as well are responses too. A null payload is empty, a null URI has no
    header, a null id is written as null and counts as the smallest. The dictionary is fitted on the `samples`
    payloads whose ids hash lowest, sample_bytes of each: the only rows that reach the driver. Payloads are not
    shuffled unless there are more repeated payloads than a broadcast may hold; then Spark joins by digest, which AQE
    splits where one payload is very frequent.
    """
    raw = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{id_col}`").alias("order"), F.col(f"`{uri_col}`").alias("uri"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = raw.withColumn("sha", F.sha1("payload"))
    stage = Staging(df.sparkSession)
    try:
        twice = stage.table(keyed.where(F.length("payload") >= revisit_bytes).groupBy("sha").agg(F.max("order").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n"))
        share = min(1.0, 2 * (samples + 50) / max(1, raw.count()))  # so that sorting sees about 2 * samples rows at any size
        hashed = raw.select(F.shiftrightunsigned(F.xxhash64("id"), 24).alias("h"), "id", F.substring("payload", 1, sample_bytes).alias("p"))
        shown = hashed.where(F.col("h") < int(share * 2**40)).orderBy("h", "id").limit(samples).collect()
        dictionary = train_dictionary([bytes(r["p"]) for r in shown if r["p"]], dictionary_bytes)
        linked = join_small(keyed, twice.withColumnRenamed("sha", "s"), (F.col("sha") == F.col("s")) & (F.length("payload") >= revisit_bytes), "left")
        revisits = F.col("s").isNotNull() & ~F.col("order").eqNullSafe(F.col("target"))
        ready = linked.select("id", "uri", "payload", "sha", F.when(revisits, F.col("target").cast("string")).alias("target"))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
            lead = skippable(DICTIONARY_MAGIC, dictionary)
            held: list[bytes] = []
            size = 0

            def archive() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([lead, b"".join(held)], pa.binary())], ["frame"])

            for batch in batches:
                columns = [batch.column(i) for i in range(5)]
                for i in range(batch.num_rows):
                    ident, uri, payload, sha, target = (c[i].as_py() for c in columns)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    plain = record_bytes(f"urn:page:{'null' if ident is None else ident}", uri, payload, digest, None if target is None else f"urn:page:{target}")
                    frame = coder.compress(plain)
                    if held and (len(held) == records or size + len(frame) > archive_bytes):
                        yield archive()
                        held, size = [], 0
                    held.append(frame)
                    size += len(frame)
            if held:
                yield archive()

        # bytes pass a cast to string unchanged; a file is two rows, the dictionary and the records' frames
        encoded = ready.mapInArrow(encode, "frame binary").select(F.col("frame").cast("string").alias("value"))
        encoded.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 2).text(path)
    finally:
        stage.close()


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under path (RECORD_SCHEMA), checked; without payloads that column is null.

    A broken archive or record fails the job with ArchiveError.
    """
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] if payloads or n != "payload" else None for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for r in read_archive(memoryview(data.as_buffer())):
                    rows.append(r)
                    held += len(r["payload"]) if payloads else 200
                    if not payloads:
                        r["payload"] = None
                    if held > 8 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(decode, RECORD_SCHEMA)


def op10_query(spark, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/orrery-warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:page:(.*)$', 1) as bigint)")
    back = read_archives(spark, root, payloads=False)
    try:
        return cut(back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")))
    finally:
        delete(spark, root)
