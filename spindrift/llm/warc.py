"""WARC archives: written from pages, read back, and joined into one row per capture.

Each capture is a transaction of three records: the request and the metadata name the
response (or revisit) that they go with in WARC-Concurrent-To. Of captures with equal
payloads the one with the largest id is the response; the others are revisits of it.
Payloads count as equal if their SHA-1 digests are. Archives are gzip files of whole
records, of at most ``FILE_BYTES`` of payload or one capture, so a reader task holds the
packed bytes of one such file and one record at a time.

Cases: a null payload counts as empty; a null url becomes a urn of the page's id; control
characters in urls are percent-encoded; payloads of any bytes and length are kept whole;
each row is a capture, rows that repeat id and payload too (record ids hold the row's
number), and all rows with the largest id of a payload are responses; a null id is below
every other, written as such and read as null; an empty table gives no archives' rows;
other columns are ignored. Of foreign archives all requests and metadata records of a
capture are kept, as are repeated WARC-Concurrent-To fields.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import discard, lookup, materialise, new_path, read_table, small_batches, text_or_empty

END = "\r\n\r\n"
FIXED_DATE = "2024-01-01T00:00:00Z"
#: Payload bytes in a file, but for a single larger capture.
FILE_BYTES = 32 << 20
#: Captures in a file.
FILE_CAPTURES = 2048


def crlf(*lines):
    """Lines (columns), each with its line end, and the empty line after them."""
    return F.concat(*[x for line in lines for x in (line, F.lit("\r\n"))], F.lit("\r\n"))


def named(name: str, *value):
    return F.concat(F.lit(f"{name}: "), *value)


def payload_digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("html"), F.sha1(text_or_empty(text_col).cast("binary")).alias("sha"))


def base32_of_hex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded = [base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coded)], names=[*batch.schema.names, "digest"])


def write_archives(spark: SparkSession, df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0) -> None:
    """``df`` as WARC files under ``path``. Payloads under ``min_revisit`` bytes are all responses."""
    pages = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    # A row's number depends on the scan alone, so it is the same in both uses of it and in each attempt.
    pages = pages.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("row", F.monotonically_increasing_id())
    sizes = pages.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("x"), F.count(F.lit(1)).alias("n")).select("sha", F.col("x.id").alias("first"), F.col("x.row").alias("first_row"), "n")
    sizes = materialise(spark, sizes.mapInArrow(base32_of_hex, "sha string, first bigint, first_row bigint, n bigint, digest string"), "payloads")
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = lookup(pages, sizes, "sha", "n", n)
    text_id = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    urn = lambda i, row, kind: F.concat(F.lit("<urn:capture:"), i, F.lit(":"), row.cast("string"), F.lit(":"), F.col("digest"), F.lit(f":{kind}>"))
    revisit = ~F.col("id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= min_revisit)
    encoded = F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), text_id))
    for code in (0x25, 0x0D, 0x0A):
        encoded = F.replace(encoded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    rows = rows.select("html", "digest", text_id.alias("tid"), encoded.alias("uri"), revisit.alias("revisit"), F.coalesce(F.col("first").cast("string"), F.lit("null")).alias("first"), "row", "first_row")
    own = lambda kind: urn(F.col("tid"), F.col("row"), kind)
    main = own("main")
    http = crlf(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), named("Content-Length", F.octet_length("html").cast("string")))
    ask = crlf(F.lit("GET / HTTP/1.1"), F.lit("Accept: text/html"))
    about = F.concat(named("page-id", F.col("tid")), F.lit("\r\n"), named("payload-length", F.octet_length("html").cast("string")), F.lit("\r\n"))

    def record(kind, record_id, block, *more):
        head = [F.lit("WARC/1.0"), named("WARC-Type", kind), named("WARC-Record-ID", record_id), named("WARC-Date", F.lit(FIXED_DATE)), named("WARC-Target-URI", F.col("uri")), *more, named("Content-Length", F.octet_length(block).cast("string"))]
        return F.concat(crlf(*head), block)

    body = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    refer = F.when(F.col("revisit"), F.concat(F.lit("\r\nWARC-Refers-To: "), urn(F.col("first"), F.col("first_row"), "main"), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(F.lit(""))
    records = F.array(
        record(F.lit("request"), own("request"), ask, named("WARC-Concurrent-To", main), F.lit("Content-Type: application/http; msgtype=request")),
        record(F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), main, body, named("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest"), refer), F.lit("Content-Type: application/http; msgtype=response")),
        record(F.lit("metadata"), own("metadata"), about, named("WARC-Concurrent-To", main), F.lit("Content-Type: application/warc-fields")),
    )
    # Rows of like size share files: a task's rows are cut into slots of as many as FILE_BYTES
    # can hold of their size's upper bound, a power of two.
    room = FILE_BYTES // FILE_CAPTURES
    doublings = F.greatest(F.lit(0), F.ceil(F.log2((F.octet_length("html") + 1) / room))).cast("int")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    slotted = rows.withColumn("size", F.least(doublings, F.lit(FILE_CAPTURES.bit_length() - 1))).withColumn("place", place)
    slotted = slotted.withColumn("slot", F.floor(F.col("place") / F.pow(F.lit(2.0), F.lit(FILE_CAPTURES.bit_length() - 1) - F.col("size"))))
    each = slotted.select("size", "slot", F.explode(records).alias("value"))
    each.write.option("lineSep", END).option("compression", "gzip").partitionBy("size", "slot").text(path)


class Inflating(io.RawIOBase):
    """Reads what is in gzip members, one after another, or plain bytes."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.plain = memoryview(raw), 0, raw[:2] != b"\x1f\x8b"
        self.unzip = None if self.plain else zlib.decompressobj(31)
        self.ready = b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.ready and self.at < len(self.raw):
            chunk = self.raw[self.at : self.at + 65536]
            if self.plain:
                self.ready, self.at = bytes(chunk), self.at + len(chunk)
                break
            self.ready = self.unzip.decompress(chunk)  # at most about a thousand times 64 KB
            self.at += len(chunk) - len(self.unzip.unused_data)
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
        n = min(len(out), len(self.ready))
        out[:n] = self.ready[:n]
        self.ready = self.ready[n:]
        return n


def records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        name = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and name:
                headers[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                # Only this field may stand several times in a record.
                before = headers.get(name, "") + "\n" if name == "warc-concurrent-to" and name in headers else ""
                headers[name] = before + value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a WARC record ends early")
        yield headers, block


RECORD = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("payload", pa.binary())])
RECORD_DDL = "type string, record_id string, concurrent_to array<string>, refers_to string, uri string, digest string, page_id string, payload_bytes bigint, payload_sha1 string, payload binary"


def parser(with_payload: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD)], schema=RECORD)
        for batch in batches:
            for raw in batch.column(0):
                rows, size = [], 0
                for h, block in records(io.BufferedReader(Inflating(raw.as_py()), 1 << 20)):
                    kind, page, n, sha, payload = h.get("warc-type"), None, None, None, None
                    if kind in ("response", "revisit"):
                        payload = block.partition(b"\r\n\r\n")[2]
                        if kind == "response":
                            n, sha = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                        page, n = fields.get("page-id"), int(fields["payload-length"]) if "payload-length" in fields else None
                    rows.append((kind, h.get("warc-record-id"), h["warc-concurrent-to"].split("\n") if "warc-concurrent-to" in h else [], h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").rpartition(":")[2] or None, page, n, sha, payload if with_payload else None))
                    size += len(payload or b"") if with_payload else 0
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield give(rows)
                        rows, size = [], 0
                if rows:
                    yield give(rows)

    return parse


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per WARC record under ``path``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # one archive at a time
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parser(with_payload), RECORD_DDL)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: the records joined by what they are concurrent to.

    A response or revisit is a capture; other records belong to the capture that they name,
    those that name several records to each of these that is a capture (without any, to the
    first named). Requests and metadata are arrays by record id. ``found`` is read three
    times, so records fresh from archives are best written first.
    """
    fields = F.struct("record_id", "uri", "digest", "refers_to", "page_id", "payload_bytes", "payload_sha1", "payload")
    is_main = F.col("type").isin("response", "revisit")
    rows = found.select("type", "record_id", "concurrent_to", is_main.alias("main"), fields.alias("fields"))
    several = ~F.col("main") & (F.size("concurrent_to") > 1)
    capture = F.when(F.col("main"), F.col("record_id")).otherwise(F.coalesce(F.get("concurrent_to", F.lit(0)), F.col("record_id")))
    plain = rows.filter(~several).select(capture.alias("capture_id"), "type", "fields")
    # Most records name one other, so what is left to look up is little or nothing.
    named_by = rows.filter(several).select("type", "fields", F.explode("concurrent_to").alias("to"), F.col("concurrent_to")[0].alias("one"))
    mains = rows.filter("main").select(F.col("record_id").alias("main_id"))
    met = named_by.join(mains, F.col("to") == F.col("main_id"), "left").groupBy("type", "fields", "one").agg(F.collect_set("main_id").alias("ids"))
    looked_up = met.select(F.explode(F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array("one"))).alias("capture_id"), "type", "fields")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("fields"))))
    main = F.when(F.col("type").isin("response", "revisit"), F.struct(F.col("type").alias("record_type"), "fields"))
    nested = plain.unionByName(looked_up).groupBy("capture_id").agg(F.max_by(main, F.when(F.col("type").isin("response", "revisit"), F.coalesce("fields.record_id", F.lit("")))).alias("main"), of("request").alias("request"), of("metadata").alias("metadata"))
    return nested.select("capture_id", F.col("main.record_type").alias("record_type"), "request", F.col("main.fields").alias("response"), "metadata")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_archives(spark, read_table(spark, sf_dir, "pages"), path)
    each = materialise(spark, read_records(spark, path), "records")  # archives are unpacked once
    found = materialise(spark, assemble(each), "captures")
    discard(spark, each)
    small_batches(spark)
    refers = F.regexp_extract("response.refers_to", r"^<urn:capture:(-?[0-9]+):", 1)
    about = F.get("metadata", F.lit(0))
    return found.select(
        about["page_id"].try_cast("bigint").alias("page_id"), F.coalesce("response.payload_bytes", about["payload_bytes"]).alias("payload_bytes"),
        F.coalesce("response.payload_sha1", "response.digest").alias("payload_digest"), "record_type",
        F.when(F.col("record_type") == "revisit", refers.try_cast("bigint")).alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (
  SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS first,
    array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, g * 5 + 1, 5))::BIGINT >> s) & 31) + 1)::BIGINT, 1)), '')), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""
