"""WARC archives: writing captures, reading records, assembling transactions.

:func:`write` turns each page into three records (response or revisit, request,
metadata) that name one another by ``WARC-Concurrent-To`` and writes them with
Spark's text writer; record blocks carry their lengths, so payloads may hold
any text.  :func:`read` parses archives back into one row a record.
:func:`assemble` joins request, response and metadata records through the
concurrent-to identifiers into one nested row a capture.

Of pages with equal payloads of at least ``least_bytes`` the one of the least
page_id is a response and the others revisit it, and name its record in
``WARC-Refers-To``; a page without an id is always a response and is never
referred to.  A null payload is an empty one, a null url an empty one.  Rows that
repeat an id, url and payload are one capture that is archived as often: their
records have equal names, and each makes a row.  Those that repeat the least
page_id of a payload are all responses.  Columns other than page_id, url and html
are not read.  Tables without rows make empty archives.

Archives are bounded by bytes.  Pages are written by size class, and an archive
of a class holds as many captures as stay within ``archive_bytes`` at the class's
largest size; only a page that is larger by itself makes a larger archive.  An
archive is read by one task, record by record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "capture string, id string, type string, concurrent_to string, refers_to string, uri string, "
    "payload_digest string, payload_bytes long, fields map<string,string>, payload string"
)


def _record(kind: str, id_: Column, block: Column, headers: list[tuple[str, Column]]) -> Column:
    """One record without its closing CRLF CRLF; null header values are left out."""
    lines = [F.lit("WARC/1.0"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), id_), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Add payload, payload_bytes, payload_digest and, for revisits, refers_to (a page_id) and refers_to_capture.

    Only digests that stand twice are joined back; they are broadcast if a count
    shows that they are few, and shuffled otherwise.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.withColumns({"payload": html, "payload_bytes": F.octet_length(html).cast("long"), "payload_digest": F.sha2(html.cast("binary"), 256)})
    large = pages.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    own = F.struct("page_id", capture_of(F.col("page_id"), F.col("url"), F.col("payload_digest")).alias("capture"))
    first = large.groupBy(F.col("payload_digest").alias("_d")).agg(F.min(own).alias("_first"), F.max("page_id").alias("_last"))
    first = small(cut(first.where("_first.page_id < _last").select("_d", F.col("_first.page_id").alias("refers_to"), F.col("_first.capture").alias("refers_to_capture"))))
    return pages.join(first, (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") > F.col("refers_to")), "left").drop("_d")


def capture_of(page_id: Column, url: Column, digest: Column) -> Column:
    """The part that the names of a capture's records share."""
    name = F.coalesce(page_id.cast("string"), F.lit("none"))
    return F.concat(F.lit("<urn:page:"), name, F.lit(":"), F.hex(F.xxhash64(F.coalesce(url, F.lit("")), digest)))


def write(pages: DataFrame, path: str, least_bytes: int = 100, archive_bytes: int = 8 << 20) -> None:
    """Write ``pages(page_id, url, html)`` as WARC archives under ``path``."""
    pages = pages.select("page_id", "url", "html")
    # classes of up to 8 KB, and of up to 8 times as much each
    size = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) + F.octet_length(F.coalesce(F.col("url"), F.lit(""))) * 5
    kind = F.greatest(F.lit(0), F.ceil((F.log2(F.greatest(size, F.lit(1)).cast("double")) - 13) / 3)).cast("int")
    rows = with_revisits(pages, least_bytes)
    found = sorted(r.k for r in pages.select(kind.alias("k")).distinct().collect())  # some ten at most
    for k in found or [0]:
        most = (8192 << 3 * k) + 2048  # with the headers of its three records
        _records(rows.where(kind == k) if found else rows).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, archive_bytes // most)).text(path)


def _records(rows: DataFrame) -> DataFrame:
    """One row ``value`` a capture: its three records, without the last one's end."""
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ")
    capture = capture_of(F.col("page_id"), F.col("url"), F.col("payload_digest"))
    main, request, meta = (F.concat(capture, F.lit(f":{x}>")) for x in ("main", "request", "metadata"))
    revisit = F.col("refers_to").isNotNull()
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    target = ("WARC-Target-URI", url)
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")))
    refers = F.concat(F.col("refers_to_capture"), F.lit(":main>"))
    body = F.when(
        revisit,
        _record("revisit", main, http, [target, digest, ("WARC-Refers-To", refers), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response"))]),
    ).otherwise(_record("response", main, F.concat(http, F.col("payload")), [target, digest, ("Content-Type", F.lit("application/http; msgtype=response"))]))
    asks = _record("request", request, F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n\r\n")), [target, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))])
    # the metadata names the request, so that assembling has to follow two steps
    fields = F.concat_ws("\r\n", F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.concat(F.lit("payloadBytes: "), F.col("payload_bytes").cast("string")))
    notes = _record("metadata", meta, fields, [target, ("WARC-Concurrent-To", request), ("Content-Type", F.lit("application/warc-fields"))])
    return rows.select(F.concat(body, F.lit(END), asks, F.lit(END), notes).alias("value"))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an uncompressed archive, one at a time."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(head.get("content-length", 0))
        yield head, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of the archives under ``path``, as ``RECORD`` says.

    Digest and length are those of the payload as read; without ``payloads``
    the payload itself is left out.
    """
    import hashlib

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data in part["content"]:
                out = []
                for head, block in parse(data if isinstance(data, bytes) else bytes(data)):
                    kind, digest, size, fields, payload = head.get("warc-type"), None, None, None, None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else block
                        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                        payload = payload.decode("utf-8", "replace") if payloads else None
                    elif kind == "revisit":
                        digest = head.get("warc-payload-digest", "").partition(":")[2] or None
                    elif kind == "metadata":
                        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k}
                    elif kind != "request":
                        continue
                    out.append((None, head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest, size, fields, payload))
                    if len(out) >= 500:
                        yield _frame(out)
                        out = []
                yield _frame(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, RECORD).drop("capture")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["capture", "id", "type", "concurrent_to", "refers_to", "uri", "payload_digest", "payload_bytes", "fields", "payload"], dtype=object)
    return out.assign(payload_bytes=out["payload_bytes"].astype("Int64"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: uri, response, request and metadata.

    A request or metadata record belongs to the response or revisit that it is
    concurrent to, directly or through one more record (a metadata record that
    names the request).  Of several requests or metadata records of a capture
    the one of the least id is nested, and ``n_requests`` and ``n_metadata``
    tell how many there are.  ``records`` is read several times; cut it.  Captures without a request or metadata have null
    there; such records without a response are left out.
    """
    main = records.where(F.col("type").isin("response", "revisit"))
    others = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull()).select("id", "type", "concurrent_to", "uri", "fields")
    steps = others.groupBy(F.col("id").alias("_via")).agg(F.min("concurrent_to").alias("_to"))  # a repeated record is one step
    others = others.join(steps, F.col("concurrent_to") == F.col("_via"), "left").withColumn("main", F.coalesce("_to", "concurrent_to"))
    own = F.struct("id", "uri", "fields")
    of = lambda kind: F.min_by(F.when(F.col("type") == kind, own), F.when(F.col("type") == kind, F.col("id")))
    n = lambda kind: F.count_if(F.col("type") == kind)
    tied = others.groupBy("main").agg(of("request").alias("request"), of("metadata").alias("metadata"), n("request").alias("n_requests"), n("metadata").alias("n_metadata"))
    out = main.join(tied, F.col("id") == F.col("main"), "left")
    response = F.struct("id", "type", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response")
    return out.select("uri", response, "request", "metadata", F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))
