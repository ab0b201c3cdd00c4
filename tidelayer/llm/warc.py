"""WARC archives: writing pages as captures, and assembling captures from archives.

A capture is written as a response (or a revisit of the response that has the same payload), a request and a metadata
record; the latter two name the former in WARC-Concurrent-To. Files are written by Spark's text writer with the end of a
WARC record as line end, gzipped, so they lie wherever Spark can write. They are read by Spark's text reader, a file at a
time and in pieces; a record ends where its Content-Length says, whatever its block holds. Requests, responses and metadata
are then joined through the concurrent-to identifiers to one nested row per capture.

Of pages with equal payloads the one with the largest id is the response; rows that share that id all are. Ids that are null
count as smallest. Revisits name the payload's digest, by which they find the response. A null or empty payload is one of no
bytes; payloads under `least_bytes` never become revisits. Rows that occur twice become captures of their own. A null URL
writes no Target-URI, line breaks in one are taken out. Other columns are not looked at. An empty table gives an archive
without records, which reads as an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer.llm.texts import importable

END = "\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_type STRING, record_id STRING, concurrent_to STRING, refers_to STRING, target_uri STRING, "
    "payload_bytes BIGINT, payload_digest STRING, block BINARY"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are eight times twenty, and twenty bits are four digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str, number: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}|"), number.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(fields: dict[str, Column], block: Column) -> Column:
    """Head and block; fields whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, length), F.lit(END), block)


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE
) -> None:
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"same": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("bigint")})
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("same").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("k"))
    first = first.where("k > 1").select(F.col("same").alias("group"), "first_id")
    marked = rows.join(first, (F.col("same") == F.col("group")) & (F.col("bytes") >= least_bytes), "left")
    revisit = F.col("group").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    marked = marked.withColumn("number", F.monotonically_increasing_id())

    capture = _record_id("capture", F.col("number"))
    uri = F.regexp_replace("url", r"[\r\n]", "")
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    main = _record(
        {
            "WARC-Type": F.when(revisit, "revisit").otherwise("response"),
            "WARC-Record-ID": capture,
            "WARC-Date": F.lit(date),
            "WARC-Target-URI": uri,
            "WARC-Payload-Digest": digest,
            "WARC-Profile": F.when(revisit, PROFILE),
            "Content-Type": F.lit("application/http; msgtype=response"),
        },
        F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))),
    )
    request = _record(
        {
            "WARC-Type": F.lit("request"),
            "WARC-Record-ID": _record_id("request", F.col("number")),
            "WARC-Date": F.lit(date),
            "WARC-Target-URI": uri,
            "WARC-Concurrent-To": capture,
            "Content-Type": F.lit("application/http; msgtype=request"),
        },
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END)),
    )
    metadata = _record(
        {
            "WARC-Type": F.lit("metadata"),
            "WARC-Record-ID": _record_id("metadata", F.col("number")),
            "WARC-Date": F.lit(date),
            "WARC-Target-URI": uri,
            "WARC-Concurrent-To": capture,
            "Content-Type": F.lit("application/warc-fields"),
        },
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
    )
    marked.select(F.explode(F.array(request, main, metadata))).write.option("lineSep", END).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


class RecordReader:
    """Cuts a stream of bytes into records by their Content-Length."""

    def __init__(self):
        self.held, self.need, self.size, self.head = [], 1, 0, None

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held.append(piece)
        self.size += len(piece)
        if self.size < self.need:
            return
        data, at, end = b"".join(self.held), 0, END.encode()
        while True:
            if self.head is None:
                while data.startswith(b"\r\n", at):
                    at += 2
                stop = data.find(end, at)
                if stop < 0:
                    self.need = 0
                    break
                self.head, at = _fields(data[at:stop]), stop + 4
            length = int(self.head.get("content-length", "0"))
            if len(data) - at < length:
                self.need = length
                break
            yield self.head, data[at : at + length]
            self.head, at, self.need = None, at + length, 0
        self.held, self.size = [data[at:]], len(data) - at


def _parsed(head: dict[str, str], block: bytes) -> dict:
    """A row of RECORD. A response's payload is digested anew and has to agree with its head."""
    kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    row = {"record_type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to")}
    row |= {"target_uri": head.get("warc-target-uri"), "payload_bytes": None, "payload_digest": digest, "block": block}
    if kind == "response":
        payload = block.partition(END.encode())[2]
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest not in (None, found):
            raise ValueError(f"the payload of {row['record_id']} has digest {found}, its head says {digest}")
        row |= {"payload_bytes": len(payload), "payload_digest": found}
    elif kind == "revisit" and (length := _fields(block).get("content-length", "")).isdigit():
        row["payload_bytes"] = int(length)
    return row


def read_archives(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of gzipped archives (`*.gz`) at a path; their blocks are left empty if not asked for, but for metadata."""
    importable(spark)
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, reader = None, None
        for batch in batches:
            rows = []
            for name, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if name != file:
                    file, reader = name, RecordReader()
                for head, block in reader.feed(piece + END.encode()):
                    row = _parsed(head, block)
                    if not blocks and row["record_type"] != "metadata":
                        row["block"] = None
                    rows.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)

    return pieces.mapInArrow(parse, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: `record_id`, `response` (or revisit), `requests`, `metadata`.

    Requests and metadata without a capture are left out; a capture may lack either.
    """
    main = records.where("record_type IN ('response', 'revisit')").select("record_id", F.struct(*[c for c in records.columns if c != "record_id"]).alias("response"))

    def concurrent(kind: str, name: str) -> DataFrame:
        own = records.where(F.col("record_type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct("target_uri", "block").alias("x"))
        return own.groupBy("record_id").agg(F.collect_list("x").alias(name))

    return main.join(concurrent("request", "requests"), "record_id", "left").join(concurrent("metadata", "metadata"), "record_id", "left")


def page_captures(records: DataFrame) -> DataFrame:
    """`page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to` (a page id) per capture."""
    whole = captures(records)
    page = F.regexp_extract(F.element_at("metadata", 1)["block"].cast("string"), r"(?m)^page-id: (-?[0-9]+)", 1)
    flat = whole.select("record_id", page.try_cast("bigint").alias("page_id"), "response.*")
    target = flat.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("target")).agg(F.max("page_id").alias("target_page"))
    found = flat.join(target, (F.col("payload_digest") == F.col("target")) & (F.col("record_type") == "revisit"), "left")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("target_page").alias("refers_to"))
