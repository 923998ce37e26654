"""WARC archives with Zstandard: a dictionary in a leading skippable frame, one frame per record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain or as a
frame of its own; every record is one frame compressed with it. Spark's own line writer puts the
frames on any file system under its commit protocol: its line end is an empty skippable frame, which
every reader of the format passes over.

Records whose payload occurs again are written once: of equal payloads the record of the largest page
id is the response, the others are revisits that refer to it and carry the headers alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, byte_rows

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
LINE_END = struct.pack("<II", SKIPPABLE_FIRST, 0).decode()
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ARCHIVE_BYTES = 64 << 20
_EPOCH = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _safe(url: str) -> str:
    """A URL as a header value: blanks and control characters are escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of one WARC record; a revisit (``refers_to`` given) has no payload."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http + (payload if refers_to is None else b"")
    headers = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
               f"WARC-Record-ID: {_page_uri(page_id)}", f"WARC-Date: {_EPOCH}",
               "Content-Type: application/http; msgtype=response"]
    if url is not None:
        headers.append(f"WARC-Target-URI: {_safe(url)}")
    headers.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        headers += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_page_uri(refers_to)}"]
    headers += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary trained on the samples; with too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or record(0, "", b"", None)


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


def write_archives(records: DataFrame, path: str, dictionary: bytes, level: int = 3) -> None:
    """Write (page_id, url, payload, refers_to), an archive per partition, one frame per record."""
    sent = records.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        plain = sent.value
        packer = zstandard.ZstdCompressor(level, dict_data=zstandard.ZstdCompressionDict(plain), write_checksum=True)
        head = _skippable(DICTIONARY_MAGIC, zstandard.ZstdCompressor(19).compress(plain))
        begun = False
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [] if begun else [head]
                begun = True
                for i, url, refers, payload in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(),
                                                   part.column("refers_to").to_pylist(), byte_rows(part.column("payload"))):
                    out.append(packer.compress(record(i, url, payload.tobytes(), refers)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    arrow_map(records.select("page_id", "url", "payload", "refers_to"), run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", LINE_END).text(path)


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every frame of an archive, decoded with the dictionary of its first frame."""
    view, at, unpacker = memoryview(data), 0, None
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if len(view) - at >= 8 else (0, 0)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            if at + 8 + size > len(view):
                raise ValueError(f"cut off at byte {at}")
            if at == 0 and magic == DICTIONARY_MAGIC:
                body = bytes(view[8:8 + size])
                if body[:4] == FRAME_MAGIC:
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                unpacker = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        one = (unpacker or zstandard.ZstdDecompressor()).decompressobj()
        begin, out, step = at, [], 16 << 10
        while not one.eof:
            if at >= len(view):
                raise ValueError(f"cut off at byte {begin}")
            piece = view[at:at + step]
            out.append(one.decompress(piece))
            at += len(piece) - (len(one.unused_data) if one.eof else 0)
            step = min(4 * step, 4 << 20)
        yield begin, b"".join(out)


def parse(content: bytes) -> dict:
    """The fields of one record, its headers and lengths checked; ValueError says what is wrong."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise ValueError(f"broken header line {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, not {size}")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
    if not gap or not said:
        raise ValueError("no HTTP header")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != int(said[1]) or digest != base32_sha1(payload)):
        raise ValueError("payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("broken revisit")
    return {"type": kind, "id": fields["warc-record-id"], "url": fields.get("warc-target-uri"), "payload": payload,
            "payload_bytes": int(said[1]), "payload_digest": digest, "refers_to": fields.get("warc-refers-to")}


def _id_in(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, offset (of the frame),
    payload (null for revisits), error of every record below ``path``.

    A record that fails a check has its reason in ``error`` and nulls elsewhere; an archive that can't
    be followed any further gives one such row at the offset where it breaks.
    """

    def run(batches):
        for batch in batches:
            for data in byte_rows(batch.column("content")):
                rows, held = [], 0
                for row in _rows(data.tobytes()):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return arrow_map(files, run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
                                 "refers_to long, offset long, payload binary, error string")


_FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64()),
                     ("payload", pa.binary()), ("error", pa.string())])


def _rows(data: bytes) -> Iterator[dict]:
    nothing = dict.fromkeys(_FIELDS.names)
    at = 0
    try:
        for at, content in frames(data):
            try:
                r = parse(content)
            except ValueError as e:
                yield nothing | {"offset": at, "error": str(e)}
                continue
            yield {"page_id": _id_in(r["id"]), "url": r["url"], "record_type": r["type"], "payload_bytes": r["payload_bytes"],
                   "payload_digest": r["payload_digest"], "refers_to": _id_in(r["refers_to"]), "offset": at,
                   "payload": r["payload"] if r["type"] == "response" else None, "error": None}
    except (ValueError, zstandard.ZstdError) as e:
        yield nothing | {"offset": at, "error": str(e)}


def round_trip(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               samples: int = 500) -> DataFrame:
    """Write a record per row of ``pages`` to ``path`` and read the archives back (:func:`read_archives`).

    Null payloads are empty; a null url has no header. Of rows with equal payloads those of the largest
    id are responses and the rest revisits, rows without an id too; if no row of them has an id, all are
    responses. An empty table gives no rows. The dictionary is trained on the first 8 KiB of at most
    ``samples`` payloads.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    some = [bytes(r[0]) for r in rows.select(F.substring("payload", 1, 8192)).limit(samples).collect()]
    # one key for a page and its payload, so that the rows are dealt into archives and joined by one shuffle
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn(
        "key", F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("sha1")))
    keys = rows.select("page_id", "sha1", "key", F.length("payload").alias("n"))
    total = keys.agg(F.sum(F.col("n") + 512)).first()[0] or 0
    last = keys.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("c")).where("c > 1 and last is not null")
    revisits = keys.select("page_id", "sha1", "key").distinct().join(last.drop("c"), "sha1").where(
        ~F.col("page_id").eqNullSafe(F.col("last"))).select("key", F.col("last").alias("refers_to"))
    dealt = rows.drop("sha1").repartition(max(1, -(-int(total) // _ARCHIVE_BYTES)), "key")
    write_archives(dealt.join(revisits, "key", "left"), path, train_dictionary(some))
    return read_archives(spark, path)
