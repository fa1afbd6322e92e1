"""WARC archives: write captures, read them back, assemble transactions.

Writing: every page becomes one transaction of three records: the request, a response (or a
revisit that refers to the response holding the same payload) and a metadata record; request
and metadata name the response or revisit in WARC-Concurrent-To. Spark's text writer puts
transactions into gzip files of a bounded number of pages. Payload groups are found by
SHA-256; a group that holds a third of all pages is split by input partition.

Reading: files are read as binary rows and parsed record by record, lengths taken from
Content-Length alone, so a payload may hold anything. Assembly joins request and metadata
records to responses and revisits through their concurrent-to identifiers and emits one
nested row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrisk.llm.common import attach, numbered, text_of
from sparkrisk.workspace import run_dir

MIN_REVISIT_BYTES = 100
PAGES_PER_FILE = 2000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"
RECORDS = ("record_id string, record_type string, concurrent_to string, refers_to string, "
           "payload_digest string, block_bytes long, payload_bytes long, found_digest string, "
           "head string, fields string, payload binary")
_FIELDS = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()),
    ("refers_to", pa.string()), ("payload_digest", pa.string()), ("block_bytes", pa.int64()),
    ("payload_bytes", pa.int64()), ("found_digest", pa.string()), ("head", pa.string()),
    ("fields", pa.string()), ("payload", pa.binary())])


def _identifier(kind: str, row: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(kind), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column, ident: Column, headers: list[tuple[str, Column]], media: str,
            block: Column) -> Column:
    """A record without the two line ends that close it; headers that are null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind),
             F.concat(F.lit("WARC-Record-ID: "), ident), F.lit(f"WARC-Date: {DATE}"),
             *[F.concat(F.lit(f"{name}: "), value) for name, value in headers],
             F.lit(f"Content-Type: {media}"),
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", min_revisit: int = MIN_REVISIT_BYTES,
               pages_per_file: int = PAGES_PER_FILE) -> None:
    """Write one transaction per row to gzip files under ``path``.

    Null payloads are empty ones. Of rows with equal payloads of at least ``min_revisit``
    bytes the one with the smallest id (null ids last; of equal ids any one) is the response,
    the others are revisits. An empty table writes no record.
    """
    rows = numbered(pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        text_of(html_col).alias("html")).withColumns({
            "digest": F.sha2("html", 256), "n_bytes": F.octet_length("html")}), "captures")
    first = F.min(F.struct(F.col("page_id").isNull().alias("late"), "page_id", "rid"))
    slim = rows.select("rid", "run", "page_id", "digest", "n_bytes").where(
        F.col("n_bytes") >= min_revisit)
    reps = slim.groupBy("digest").agg(first.alias("first"))
    other = attach(slim, reps, ["digest"]).where("rid <> first.rid").select(
        "rid", F.col("first.rid").alias("source"))
    row = rows.join(other, "rid", "left")

    revisit = F.col("source").isNotNull()
    main = _identifier("main", F.col("rid"))
    # a target URI is one line of visible characters; the exact one is in the metadata
    target = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END
                          + "Content-Length: "), F.col("n_bytes").cast("string"),
                    F.lit(END + END))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), main,
        [("WARC-Target-URI", target),
         ("WARC-Refers-To", F.when(revisit, _identifier("main", F.col("source")))),
         ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))],
        "application/http; msgtype=response",
        F.when(revisit, http).otherwise(F.concat(http, "html")))
    request = _record(
        F.lit("request"), _identifier("request", F.col("rid")),
        [("WARC-Target-URI", target), ("WARC-Concurrent-To", main)],
        "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")),
                 F.lit(" HTTP/1.1" + END + "Accept: text/html" + END + END)))
    metadata = _record(
        F.lit("metadata"), _identifier("metadata", F.col("rid")),
        [("WARC-Target-URI", target), ("WARC-Concurrent-To", main)], "application/json",
        F.to_json(F.struct("page_id", "url", F.col("n_bytes").alias("payload_bytes"))))
    gap = END + END
    (row.select(F.concat_ws(gap, request, response, metadata).alias("value"))
     .write.option("lineSep", gap).option("compression", "gzip")
     .option("maxRecordsPerFile", pages_per_file).text(path))


def parse_records(content: bytes) -> Iterator[dict]:
    """Records of one archive, gzip (of one or many members) or plain."""
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record must begin with its version, not {line[:40]!r}")
        headers = {}
        for line in iter(stream.readline, b""):
            if not line.strip():
                break
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        kind = headers["warc-type"]
        record = {
            "record_id": headers["warc-record-id"], "record_type": kind,
            "concurrent_to": headers.get("warc-concurrent-to"),
            "refers_to": headers.get("warc-refers-to"),
            "payload_digest": headers.get("warc-payload-digest", "").rpartition(":")[2] or None,
            "block_bytes": len(block)}
        if headers.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            record["head"] = head.decode("utf-8", "replace")
            if kind == "response":
                record |= {"payload": payload, "payload_bytes": len(payload),
                           "found_digest": hashlib.sha256(payload).hexdigest()}
        else:
            record["fields"] = block.decode("utf-8", "replace")
        yield record


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives under ``path``."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[dict] = []
                size = 0
                for record in parse_records(content.as_py()):
                    if not payloads:
                        record.pop("payload", None)
                    rows.append(record)
                    size += record["block_bytes"]
                    if len(rows) >= 2000 or size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
             .select("content"))
    return files.mapInArrow(parse, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, record_type, refers_to, request, response, metadata.

    Request and metadata records are joined to the response or revisit that they name in
    ``concurrent_to``; a capture without one of them has null there, and of several the one
    with the smallest record id is taken. Records that name no capture are left out.
    """
    def beside(kind: str, name: str, *columns: str) -> DataFrame:
        return (records.where(F.col("record_type") == kind).groupBy("concurrent_to")
                .agg(F.min(F.struct("record_id", *columns)).alias(name))
                .withColumnRenamed("concurrent_to", "record_id"))

    main = records.where(F.col("record_type").isin("response", "revisit"))
    parts = [c for c in ("payload_digest", "found_digest", "payload_bytes", "head", "payload")
             if c in records.columns]
    rest = [c for c in ("run",) if c in records.columns]
    return (main.select("record_id", "record_type", "refers_to", *rest,
                        F.struct(*parts).alias("response"))
            .join(beside("request", "request", "head"), "record_id", "left")
            .join(beside("metadata", "metadata", "fields"), "record_id", "left"))


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                    html_col: str = "html", min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives, read them back, one row per capture.

    page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response
    a revisit refers to), url, intact (the payload read has the digest its record names; a
    revisit's payload is the response's).
    """
    spark = pages.sparkSession
    path = f"{run_dir(spark)}/warc-{uuid.uuid4().hex[:8]}"
    write_warc(pages, path, id_col, url_col, html_col, min_revisit)
    records = numbered(read_warc(spark, path, payloads=False).drop("payload"), "records")
    kind = dict(pages.select(F.col(id_col).alias("id")).dtypes)["id"]
    captures = assemble(records).withColumn("own", F.from_json(
        "metadata.fields", f"page_id {kind}, url string, payload_bytes bigint")).select(
        "record_id", "record_type", "refers_to", "run", "response", "own")
    sources = captures.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("own.page_id").alias("source"),
        F.col("response.found_digest").alias("held"))
    revisits = attach(captures.where("record_type = 'revisit'"), sources, ["refers_to"])
    out = captures.where("record_type = 'response'").withColumns({
        "source": F.lit(None).cast(kind), "held": F.col("response.found_digest")}
        ).unionByName(revisits)
    return out.select(
        F.col("own.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "own.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), "record_type",
        F.col("source").alias("refers_to"), F.col("own.url").alias("url"),
        (F.col("held") == F.col("response.payload_digest")).alias("intact"))


def op7_warc(spark, sf_dir):
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
d AS (SELECT page_id, url, n, sha256(body) AS digest FROM p),
r AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS f
  FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to, url, true AS intact
FROM r
"""
