"""WARC archives: writing records in segments, and reassembling them.

A payload is framed as a chunked HTTP response. A record whose block is longer than the segment size is written as a first
segment and continuation records, in any file. The reader parses files record by record, groups segments by the
origin's identifier, orders them by segment number, verifies the total length and decodes the chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT = 32_768
CHUNK = 8_192
#: With SEGMENT, bounds the size of one archive file.
RECORDS_PER_FILE = 2_000

_SEGMENTS = "origin string, segment int, total long, kind string, refers string, digest string, block binary"
_RECORDS = "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, complete boolean"


def record_id(page_id: int | None, sha1_hex: str, nth: int) -> str:
    """A version 8 UUID that holds the page's id, 32 bits of its payload's digest and the number among equal rows."""
    p = (page_id or 0) % (1 << 64)
    top = int(sha1_hex[:8], 16) << 16 | min(nth, 0xFFFF)
    mid = 8 << 12 | (page_id is None) << 2 | p >> 62
    return f"urn:uuid:{uuid.UUID(int=top << 80 | mid << 64 | 2 << 62 | p & (1 << 62) - 1)}"


def page_of(identifier: str) -> int | None:
    """The page's id in a record's; null for identifiers that others made."""
    try:
        n = uuid.UUID(identifier.rpartition(":")[2]).int
    except ValueError:
        return None
    mid = n >> 64
    p = (mid & 3) << 62 | n & (1 << 62) - 1
    return None if mid >> 2 & 1 else p - (1 << 64) * (p >> 63)


def base32_sha1(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            n = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        if body[line + 2 + n : line + 4 + n] != b"\r\n":
            return None
        out.append(body[line + 2 : line + 2 + n])
        at = line + 4 + n


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends behind it, which the writer of lines sets."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block


def page_records(page_id, url, payload: bytes, sha1_hex: str, nth: int, refers: str | None, segment: int = SEGMENT, chunk: int = CHUNK):
    own, digest = record_id(page_id, sha1_hex, nth), "sha1:" + base32_sha1(bytes.fromhex(sha1_hex))
    uri = None if url is None else "".join(c if "!" <= c <= "~" else "%{:02X}".format(ord(c)) if ord(c) < 128 else c for c in url)
    same = [("WARC-Record-ID", f"<{own}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = [("Content-Type", "application/http;msgtype=response")]
    if refers is not None:
        yield record([("WARC-Type", "revisit"), *same, *kind, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers}>")], http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *same, *kind], block)
        return
    count = -(-len(block) // segment)
    for k in range(count):
        part = block[k * segment : (k + 1) * segment]
        if k == 0:
            yield record([("WARC-Type", "response"), *same, *kind, ("WARC-Segment-Number", "1")], part)
        else:
            name = str(uuid.uuid5(uuid.UUID(own.rpartition(":")[2]), str(k + 1)))
            last = [("WARC-Segment-Total-Length", str(len(block)))] if k == count - 1 else []
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", f"<{own}>"), ("WARC-Segment-Number", str(k + 1)), *last], part)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Writes a record per row to gzip files under path.

    Of rows with equal payloads of at least min_bytes bytes the one with the largest id is a response and the others
    revisit it; null ids count as smallest, of rows alike in id and payload the first is taken. Null payloads are empty.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    shared = rows.filter(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # one key without nulls for both steps, so that payloads move once
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "sha1").alias("key")
    roles = rows.select(key, "sha1").distinct().join(shared, "sha1").select("key", "winner", F.lit(True).alias("shared"))
    numbered = rows.select("*", key).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("url")))
    ruled = numbered.join(roles, "key", "left")
    revisit = F.col("shared").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("winner")) & (F.col("nth") == 1))

    def run(batches):
        for batch in batches:
            out = []
            for page, url, body, sha1, nth, again, winner in zip(*(c.to_pylist() for c in batch.columns)):
                out += page_records(page, url, body, sha1, nth, record_id(winner, sha1, 1) if again else None, segment, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = ruled.select("page_id", "url", "payload", "sha1", "nth", revisit.alias("again"), "winner").mapInArrow(run, "value binary")
    # the record's bytes as they are: Spark's line writer adds the separator, keeps to any file system and commits whole files
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes):
    """(fields, block) of each record of a file; ends at the first byte that begins no record, and at a head that is cut or names no length or id. A block may be cut."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        fields = {}
        for line in data[at : max(end, at)].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        if not fields.get("content-length", "").isdecimal() or not {"warc-type", "warc-record-id"} <= set(fields):
            return
        n = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdecimal() else None


def inflated(data: bytes) -> bytes:
    """The bytes of a file, of one or many gzip members or none; up to the damage if there is any."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(47)
        try:
            out.append(z.decompress(data))
        except zlib.error:
            break
        data = z.unused_data
    return b"".join(out) if out else data


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives: record_id, page_id, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits) and complete.

    A record of which a segment is missing, whose total length, framing or digest is wrong, has complete = false and
    no payload. A damaged file gives the records before the damage. An empty folder gives an empty result.
    """

    def split(segmented: bool):
        def run(batches):
            for batch in batches:
                for content in batch.column(0):
                    rows = []
                    for f, block in parse(inflated(content.as_py())):
                        if ("warc-segment-number" in f) == segmented and f["warc-type"] in ("response", "revisit", "continuation"):
                            total = f.get("warc-segment-total-length")
                            origin = f.get("warc-segment-origin-id", f["warc-record-id"]).strip("<>")
                            rows.append((origin, _number(f.get("warc-segment-number")) or 0, _number(total), f["warc-type"], f.get("warc-refers-to", "").strip("<>") or None, f.get("warc-payload-digest"), block))
                        if len(rows) >= 500:
                            yield _batch(rows, _SPLIT)
                            rows = []
                    if rows:
                        yield _batch(rows, _SPLIT)

        return run

    def decode(batches):
        for batch in batches:
            rows = []
            for origin, parts in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(_record(origin, sorted(parts, key=lambda p: p["segment"])))
            yield _batch(rows, _DECODED)

    files = spark.read.format("binaryFile").load(path).select("content")
    part = F.struct("segment", "total", "kind", "refers", "digest", "block")
    # the files are parsed once for whole records, which stay where they are, and once for segments, which meet by origin
    whole = files.mapInArrow(split(False), _SEGMENTS).select("origin", F.array(part).alias("parts"))
    parts = files.mapInArrow(split(True), _SEGMENTS).groupBy("origin").agg(F.collect_list(part).alias("parts"))
    return whole.union(parts).mapInArrow(decode, _RECORDS)


_SPLIT = [("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("block", pa.binary())]
_DECODED = [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("complete", pa.bool_())]


def _batch(rows: list[tuple], kinds) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])


def _record(origin: str, parts: list[dict]) -> tuple:
    first, block = parts[0], b"".join(p["block"] for p in parts)
    if first["kind"] == "continuation" or first["digest"] is None:
        return origin, page_of(origin), "response", None, None, None, None, False
    digest = first["digest"].removeprefix("sha1:")
    whole = first["segment"] == 0 and len(parts) == 1 or [p["segment"] for p in parts] == [*range(1, len(parts) + 1)] and len(parts) > 1 and parts[-1]["total"] == len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if first["kind"] == "revisit":
        return origin, page_of(origin), "revisit", page_of(first["refers"]) if first["refers"] else None, int(n) if (n := fields.get(b"content-length", b"")).isdigit() else None, digest, None, whole and n.isdigit()
    payload = (dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body[: int(n) if (n := fields.get(b"content-length", b"")).isdigit() else len(body)]) if whole else None
    if payload is None or base32_sha1(hashlib.sha1(payload).digest()) != digest:
        return origin, page_of(origin), "response", None, None, digest, None, False
    return origin, page_of(origin), "response", None, len(payload), digest, payload, True


def op8_warc(spark, sf_dir):
    """All pages written as archives and read back."""
    from .store import new_folder, table

    path = new_folder(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
