"""WARC archives with revisit records (operator 2).

`deduplicate` shuffles headers (digest and page_id) and names, for each payload of at least MIN_BYTES, the record
with the smallest page_id as the original. Payloads stay where they are if at most MOST_ORIGINALS payloads have
copies; these go to the records by broadcast, and beyond that by a join that moves payloads once. `write_archive`
writes response and revisit records with fresh headers, `read_archive` parses archives, `resolve_revisits` joins
revisits to their originals.

Defined results. Null html: an empty payload, always a response. Null page_id: written with an id of its digest and
read back as null; a copy of an original that has an id is a revisit. Rows that repeat the smallest page_id
of a payload are all responses. Payloads below MIN_BYTES are all responses. An empty table gives an archive without
records, which reads back as no rows. Archives are rolled at about FILE_BYTES of payloads, and have one payload
where that is larger; one above 2 GB, which no column can hold, isn't read. Columns other than page_id, url and
html are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, new_path, stored, table

MIN_BYTES = 100
#: Payloads with copies whose digests are broadcast: some 100 bytes each.
MOST_ORIGINALS = 200_000
#: Bounds an archive file, which is read whole by one task: so many records of at most so many bytes.
FILE_BYTES = 1 << 26
SIZES = (1 << 16, 1 << 20, 1 << 24, 1 << 31)
#: Compressed bytes that are inflated at once.
PIECE = 1 << 14
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_CRLF = "\r\n"


def to_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (html, null as empty), payload_digest and payload_bytes of each row."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"payload_digest": F.sha2(F.encode("payload", "UTF-8"), 256), "payload_bytes": F.octet_length("payload").cast("long")})


def deduplicate(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds record_type and refers_to. Only digest and id are grouped, with partial sums."""
    heads = records.where(F.col("payload_bytes") >= min_bytes).select("payload_digest", "page_id")
    firsts = heads.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and original is not null").select("payload_digest", "original")
    firsts = stored(firsts, "originals")
    firsts = F.broadcast(firsts) if firsts.count() <= MOST_ORIGINALS else firsts.hint("merge")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return records.join(firsts, "payload_digest", "left").withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("original"))}).drop("original")


def _header(name: str, value) -> F.Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))).otherwise("")


def write_archive(records: DataFrame, path: str) -> None:
    """One WARC 1.1 record a row, in gzip files: Spark's text writer with the record separator as line end.

    Files go below path by the size of payloads, so that few large ones and many small ones make a file.
    """
    clean = F.regexp_replace("url", r"[\r\n]", "%0A")
    urn = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">")))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}{_CRLF}"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), F.col("record_type"), F.lit(f"{_CRLF}WARC-Date: {DATE}{_CRLF}"),
        _header("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:sha256:"), F.col("payload_digest"), F.lit(">")))), _header("WARC-Target-URI", clean), _header("WARC-Refers-To", urn(F.col("refers_to"))),
        F.when(revisit, f"WARC-Profile: {PROFILE}{_CRLF}").otherwise(""),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), F.octet_length("block").cast("string"), F.lit(_CRLF + _CRLF),
    )
    size = F.col("payload_bytes")
    classes = [r["size"] for r in records.select(sum((F.when(size > s, 1).otherwise(0) for s in SIZES[:-1]), F.lit(0)).alias("size")).distinct().collect()]
    for c in sorted(classes) or [0]:
        least, most = ([-1, *SIZES])[c], SIZES[c]
        some = records.where((size > least) & (size <= most)) if len(classes) > 1 else records
        lines = some.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))
        lines.write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_BYTES // most)).text(f"{path}/{most}")


class _Inflated:
    """Reads plain or gzip bytes, of any number of members, without holding what was read."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.gzip, self.member = data[:2] == b"\x1f\x8b", None

    def _more(self) -> bool:
        piece = self.data[self.at : self.at + PIECE]
        if not len(piece):
            return False
        self.at += len(piece)
        if not self.gzip:
            self.held += piece
            return True
        self.member = self.member or zlib.decompressobj(31)
        self.held += self.member.decompress(piece)
        if self.member.eof:
            self.at -= len(self.member.unused_data)
            self.member = None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before mark, which is read too; None at the end."""
        looked = 0
        while (i := self.held.find(mark, looked)) < 0:
            looked = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held:
                    raise ValueError("a record's head has no end")
                return None
        out = bytes(self.held[:i])
        del self.held[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError("a record is cut short")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive, plain or gzip, by their Content-Length; one record is held at a time."""
    source = _Inflated(data)
    while (text := source.until(b"\r\n\r\n")) is not None:
        lines = text.decode("utf-8", "replace").split(_CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = source.take(int(head["content-length"]))
        source.take(4)
        yield head | {"payload": block.partition(b"\r\n\r\n")[2] if "msgtype" in head.get("content-type", "") else block}


def _id(x: str | None) -> int | None:
    return int(x.removeprefix("<urn:page:").rstrip(">")) if x and x.startswith("<urn:page:") else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for data in batch.column(0):
            rows, size = [], 0
            for r in parse(data.as_py()):
                full = r["warc-type"] == "response"
                stated = r.get("warc-payload-digest", "").partition(":")[2] or None
                digest = hashlib.sha256(r["payload"]).hexdigest() if full else stated
                if full and stated not in (None, digest):
                    raise ValueError(f"payload of {r.get('warc-record-id')} doesn't have its digest")
                rows.append({"page_id": _id(r.get("warc-record-id")), "url": r.get("warc-target-uri"), "record_type": r["warc-type"], "refers_to": _id(r.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": len(r["payload"]) if full else None, "payload": r["payload"] if full else None})
                size += len(r["payload"])
                if len(rows) == 512 or size > 1 << 24:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path; digests of responses are computed anew and compared."""
    return in_arrow(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content"), _read, RECORD, rows=1)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Headers only: a revisit gets the payload length of the response with its digest; null if there is none."""
    heads = records.select("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes")
    originals = heads.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("original_bytes"))
    revisits = heads.where("record_type = 'revisit'").join(originals, "payload_digest", "left").withColumn("payload_bytes", F.col("original_bytes")).select(heads.columns)
    return heads.where("record_type = 'response'").unionByName(revisits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(deduplicate(to_records(table(spark, sf_dir, "pages"))), path)
    return resolve_revisits(read_archive(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
m AS (SELECT h, min(page_id) AS original FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN m.original < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.original < d.page_id THEN m.original END AS refers_to
FROM d LEFT JOIN m ON d.h = m.h
"""
