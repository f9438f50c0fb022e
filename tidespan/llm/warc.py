"""WARC archives: writing, reading, and assembly of transactions.

Each page becomes three records: a request, a response (or a revisit, where an equal payload is a response elsewhere) and a metadata
record; the last two name the request in WARC-Concurrent-To. Spark's text writer puts the records, each followed by two line ends,
into gzip files on any file system it knows (one member a file, as that writer makes them). Reading takes archives of any number of
members, a member a record among them, inflates them piece by piece and goes by Content-Length, so payloads may hold anything.
Assembly joins the three records of a capture through the identifiers into one nested row.

Payloads are the bytes of ``html`` in UTF-8, null and empty alike empty. Equal payloads elect the largest page_id; smaller ones than
``least_bytes`` are all responses. Rows that repeat the elected id are responses too, rows without an id are revisits of it; where no row of
a payload has an id all are responses. A url of null is an empty target. Repeated rows stay; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.llm.scratch import Scratch, slices

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of records in one file, about; a reader holds one compressed file and one record at a time.
FILE_BYTES = 32 << 20
#: Payloads with copies up to which the elected ids are broadcast (some 60 bytes each); a shuffled join serves beyond.
BROADCAST_HEADS = 200_000


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payload(x: str | None) -> bytes:
    return (x or "").encode("utf-8", "surrogatepass")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data = [_payload(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(x) for x in data], pa.string()), pa.array([len(x) for x in data], pa.int64())], names=[*batch.schema.names, "payload_digest", "payload_bytes"])


def _id(*parts: object) -> str:
    h = hashlib.sha1("\x00".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def _head(kind: str, own: str, uri: str, content_type: str, length: int, more: list[tuple[str, str]]) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"Content-Type: {content_type}", *(f"{k}: {v}" for k, v in more), f"Content-Length: {length}"]
    return "\r\n".join(lines) + END


def _clean(x: str | None) -> str:
    return (x or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if x and ("\r" in x or "\n" in x) else x or ""


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for r in batch.to_pylist():
            uri, sha, body = _clean(r["url"]), r["payload_digest"], r["html"] or ""
            request, own = _id("request", r["row"]), _id("page", sha, r["page_id"]) if r["row"] == r["head_row"] else _id("row", r["row"])
            path = "/" + uri.partition("://")[2].partition("/")[2].partition("#")[0]
            ask = f"GET {path} HTTP/1.1\r\nHost: {uri.partition('://')[2].partition('/')[0]}{END}"
            out.append(_head("request", request, uri, "application/http; msgtype=request", len(ask.encode()), []) + ask)
            more = [("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Concurrent-To", request)]
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}{END}"
            if r["refers_to"] is None:
                out.append(_head("response", own, uri, "application/http; msgtype=response", len(http) + r["payload_bytes"], more) + http + body)
            else:
                more += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id("page", sha, r["refers_to"]))]
                out.append(_head("revisit", _id("revisit", r["row"]), uri, "application/http; msgtype=response", len(http), more) + http)
            told = f"pageId: {'' if r['page_id'] is None else r['page_id']}\r\npayloadBytes: {r['payload_bytes']}\r\n"
            told += "" if r["refers_to"] is None else f"refersToPageId: {r['refers_to']}\r\n"
            out.append(_head("metadata", _id("metadata", r["row"]), uri, "application/warc-fields", len(told), [("WARC-Concurrent-To", request)]) + told)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write(pages: DataFrame, path: str, scratch: Scratch, least_bytes: int = 0) -> None:
    """pages: page_id, url, html. Files of gzip-compressed records under ``path``."""
    rows = pages.select("page_id", "url", "html")
    narrow = rows.select("page_id", "html").mapInArrow(_digests, "page_id long, html string, payload_digest string, payload_bytes long").drop("html")
    narrow = scratch.keep(narrow.withColumn("row", F.monotonically_increasing_id()), "digests")
    total = narrow.agg(F.count("*").alias("n"), F.sum("payload_bytes").alias("b")).first()
    heads = narrow.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("m")).filter("n > 1 and m is not null").select("payload_digest", F.col("m.page_id").alias("head"), F.col("m.row").alias("head_row"))
    heads = scratch.keep(heads, "heads")
    keyed = rows.mapInArrow(_digests, "page_id long, url string, html string, payload_digest string, payload_bytes long").withColumn("row", F.monotonically_increasing_id())
    keyed = keyed.join(F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads, "payload_digest", "left")
    keyed = keyed.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("head"), F.col("head").isNotNull()), F.col("head"))).drop("head")
    size = (total.b or 0) / max(1, total.n) + 1500
    keyed.mapInArrow(_records, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(3 * FILE_BYTES / size))).text(path)


def inflate(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of all gzip members of a file, piece by piece; an archive that is not compressed as it is."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            part = view[at : at + step]
            yield member.decompress(part)
            at += len(part) - len(member.unused_data)
        while at < len(view) and view[at] == 0:  # padding between members
            at += 1


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with names in lower case, block) of every record of an archive; a record cut off at the end gives what there is of its block."""
    held, at = bytearray(), 0

    def until(enough) -> bool:
        """Reads on until enough() holds or nothing is left."""
        nonlocal held, at
        while not enough():
            if (piece := next(pieces, None)) is None:
                return False
            del held[:at]
            at = 0
            held += piece
        return True

    while True:
        while until(lambda: len(held) > at) and held[at] in b"\r\n":
            at += 1
        if not until(lambda: held.find(b"\r\n\r\n", at) >= 0):
            return
        start = held.index(b"\r\n\r\n", at) + 4
        head: dict[str, str] = {}
        for line in held[at : start - 4].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            head.setdefault(k.strip().lower(), v.strip())
        at, size = start, int(head.get("content-length", 0))
        until(lambda: len(held) - at >= size)
        yield head, bytes(held[at : at + size])
        at = min(at + size, len(held))


RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, payload_bytes long, payload_digest string, page_id long, told_bytes long, refers_to_page long, payload binary"
_KINDS = (*((k, pa.string()) for k in ("record_id", "type", "concurrent_to", "refers_to", "uri", "date")), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("told_bytes", pa.int64()), ("refers_to_page", pa.int64()), ("payload", pa.binary()))


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives under ``path``; digests of responses are taken from the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for head, block in parse(inflate(content.as_py())):
                    kind, r = head.get("warc-type"), dict.fromkeys(k for k, _ in _KINDS)
                    r |= {"record_id": head.get("warc-record-id"), "type": kind, "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date")}
                    if kind == "response":
                        body = block[block.find(b"\r\n\r\n") + 4 :]
                        r |= {"payload_bytes": len(body), "payload_digest": digest(body), "payload": body if payloads else None}
                        held += len(body)
                    elif kind == "revisit":
                        r["payload_digest"] = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    elif kind == "metadata":
                        told = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                        r |= {"page_id": int(told["pageId"]) if told.get("pageId") else None, "told_bytes": int(told["payloadBytes"]), "refers_to_page": int(told["refersToPageId"]) if "refersToPageId" in told else None}
                    rows.append(r)
                    if len(rows) >= 10_000 or held > FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in _KINDS], names=[k for k, _ in _KINDS])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in _KINDS], names=[k for k, _ in _KINDS])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (of type response or revisit) and metadata, joined on the request's identifier."""
    request = records.filter("type = 'request'").select(F.col("record_id").alias("capture"), F.struct("record_id", "uri", "date").alias("request"))
    response = records.filter("type in ('response', 'revisit')").select(F.col("concurrent_to").alias("capture"), F.struct("record_id", "type", "refers_to", "payload_bytes", "payload_digest", "payload").alias("response"))
    metadata = records.filter("type = 'metadata'").select(F.col("concurrent_to").alias("capture"), F.struct("record_id", "page_id", "told_bytes", "refers_to_page").alias("metadata"))
    return request.join(response, "capture", "left").join(metadata, "capture", "left")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives, reads them back and returns page_id, payload_bytes, payload_digest, record_type and refers_to of each capture."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archive")
    write(pages, path, scratch, least_bytes)
    found = assemble(scratch.keep(read(pages.sparkSession, path, payloads=False).drop("payload"), "records").withColumn("payload", F.lit(None).cast("binary")))
    revisit = F.col("response.type") == "revisit"
    return found.select(
        F.col("metadata.page_id").alias("page_id"), F.when(revisit, F.col("metadata.told_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(revisit, F.col("metadata.refers_to_page")).alias("refers_to"),
    )
