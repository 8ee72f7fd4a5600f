"""WARC archives of web pages: write captures, read records back, assemble transactions.

A capture is a transaction of three records. The request and the metadata record name the response
(or revisit) in ``WARC-Concurrent-To``; :func:`assemble` joins the three through these identifiers and
returns one nested row per capture.

Writing goes through Spark's text writer, so archives land in any store that Spark reaches: a row is a
record, and the line separator is the blank lines that end a record. Files are compressed whole (gzip)
and hold at most ``per_file`` captures. Reading takes files through ``binaryFile`` and walks them by
``Content-Length``, so payloads may hold anything, separators included; a task keeps one compressed file
and one record in memory.

Payloads of at least ``REVISIT_BYTES`` bytes that several rows share are archived once: the rows with the
largest page_id are responses, all others revisit the last of these by URL.

Odd input: null html is an empty payload; a null URL gives no target; control characters of a URL are
written as ``%XX``. A null page_id is below any other and comes back as null. Rows that are alike in
page_id, URL and html are alike in every record, and come back as many times as they went in; rows alike in
page_id and payload but not in URL are all responses where that page_id is the largest. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planeweave.llm.common import shared_folder, stored, whole

REVISIT_BYTES = 1000
PER_FILE = 1000
END = "\r\n"
REQUEST, RESPONSE, REVISIT, METADATA = "request", "response", "revisit", "metadata"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows handed to Arrow together: as many records as reach this size, at least one.
BATCH_BYTES = 4 << 20
CHUNK = 1 << 20
SALTS = 64

RECORDS_DDL = ("kind string, record_id string, concurrent_to string, refers_to string, uri string, date string, "
               "declared_digest string, http string, fields string, payload binary")


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def _identifier(kind: str, page_id: Column, url: Column, digest: Column) -> Column:
    """A record's URN: equal for equal rows only."""
    lengths = [F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in (_shown(page_id), F.coalesce(F.concat(F.lit("+"), url), F.lit("-")))]
    m = F.md5(F.concat(F.lit(kind), *lengths, digest).cast("binary"))
    parts = [F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _uri(url: Column) -> Column:
    """The URL with control characters as ``%XX``, so that it stays on its header line."""
    out = url
    for code in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), out).otherwise(url)


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; those with a null value are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit("")) for name, value in pairs])


def _record(kind: Column | str, record_id: Column, uri: Column, date: str, block: Column, media: str, *more: tuple[str, Column]) -> Column:
    head = _lines(("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(date)),
                  ("WARC-Target-URI", uri), *more, ("Content-Type", F.lit(media)), ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.lit(f"WARC/1.1{END}"), head, F.lit(END), block)


def captures_to_write(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, first``: first is the identifier of the response that the row revisits,
    null for responses. Digests are counted in map-side aggregates; only those that several page_ids share
    meet the rows again, in a join that Spark broadcasts by size or splits by skew."""
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), whole("html").alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    known = F.count("page_id")
    groups = p.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "url")).alias("_first"),
        ((F.max("page_id") != F.min("page_id")) | ((known > 0) & (known < F.count(F.lit(1))))).alias("_shared"))
    out = p.join(groups.where("_shared").select("digest", "_first"), "digest", "left")
    mine = F.col("_first.page_id").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "html", "digest", F.when(F.col("_first").isNotNull() & ~mine, _identifier(
        RESPONSE, F.col("_first.page_id"), F.col("_first.url"), F.col("digest"))).alias("first"))


def records(captures: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Three rows with one column ``record`` for every capture."""
    page_id, url, digest, first = (F.col(c) for c in ("page_id", "url", "digest", "first"))
    uri = _uri(url)
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\x00-\x20]*)", 1)
    path = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    main_id = F.when(first.isNull(), _identifier(RESPONSE, page_id, url, digest)).otherwise(_identifier(REVISIT, page_id, url, digest))
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size, F.lit(END * 2))
    ask = F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{END}Host: "), F.coalesce(host, F.lit("")), F.lit(END * 2))
    about = _lines(("page_id", page_id.cast("string")), ("via", F.lit("pages")))
    proof = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest))
    near = ("WARC-Concurrent-To", F.col("_main"))
    c = captures.withColumn("_main", main_id)
    reply = F.when(first.isNull(), _record(RESPONSE, F.col("_main"), uri, date, F.concat(http, F.col("html")), "application/http; msgtype=response", proof)).otherwise(
        _record(REVISIT, F.col("_main"), uri, date, http, "application/http; msgtype=response", proof, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", first)))
    return c.select(F.explode(F.array(
        _record(REQUEST, _identifier(REQUEST, page_id, url, digest), uri, date, ask, "application/http; msgtype=request", near),
        reply,
        _record(METADATA, _identifier(METADATA, page_id, url, digest), uri, date, about, "application/warc-fields", near))).alias("record"))


def write_archives(pages: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Archives of all pages below ``path``, at most ``per_file`` captures a file."""
    records(captures_to_write(pages)).write.option("compression", "gzip").option("lineSep", END * 2).option(
        "maxRecordsPerFile", 3 * per_file).text(path)


class _Bytes:
    """Bytes of a compressed file, drawn as they are needed."""

    def __init__(self, content: bytes):
        self.rest, self.held, self.at = memoryview(content), b"", 0
        self.zip = zlib.decompressobj(47) if content[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        out = b""
        while not out:
            if self.zip is None:
                out, self.rest = bytes(self.rest[:CHUNK]), self.rest[CHUNK:]
                if not out:
                    return False
            else:
                given = self.zip.unconsumed_tail or bytes(self.rest[:CHUNK])
                if not self.zip.unconsumed_tail:
                    self.rest = self.rest[CHUNK:]
                if not given:
                    return False
                out = self.zip.decompress(given, CHUNK)
                if self.zip.eof:  # a file may be several gzip members
                    left = self.zip.unused_data
                    self.zip = zlib.decompressobj(47)
                    self.rest = memoryview(left + bytes(self.rest)) if left else self.rest
        self.held, self.at = self.held[self.at:] + out, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is passed; None at the end of the file."""
        seen = self.at
        while (found := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) - self.at)
            if not self.more():
                return None
        out, self.at = self.held[self.at:found], found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts = []
        while n > 0:
            if self.at == len(self.held) and not self.more():
                raise ValueError("archive ends inside a record")
            part = self.held[self.at:self.at + n]
            parts.append(part)
            self.at += len(part)
            n -= len(part)
        return b"".join(parts)


def _walk(content: bytes) -> Iterator[tuple]:
    """The records of one archive in order, as RECORDS_DDL has them."""
    stream = _Bytes(content)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").lstrip(END).split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(named["content-length"]))
        stream.take(4)
        http = fields = payload = None
        if named.get("content-type", "").startswith("application/http"):
            top, _, body = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
            payload = body if named["warc-type"] == RESPONSE else None
        else:
            fields = block.decode("utf-8")
        yield (named["warc-type"], named["warc-record-id"], named.get("warc-concurrent-to"), named.get("warc-refers-to"), named.get("warc-target-uri"),
               named.get("warc-date"), named.get("warc-payload-digest"), http, fields, payload)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record below ``path``: headers, the metadata fields, a response's payload, and
    ``payload_digest`` and ``payload_bytes`` as counted from what was read (null without a payload)."""
    columns = [c.split()[0] for c in RECORDS_DDL.split(", ")]

    def run(batches):
        for batch in batches:
            for content in batch.content:
                rows, size = [], 0
                for row in _walk(content):
                    rows.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    out = files.mapInPandas(run, RECORDS_DDL)
    return out.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})


def _looked_up(rows: DataFrame, key: str, row_id: str, found: DataFrame) -> DataFrame:
    """The rows with what ``found`` has for their key (one row a key), nulls where it has nothing. A key of
    very many rows is dealt to SALTS tasks: what is found goes once to each that has rows of the key."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)))
    wanted = salted.where(F.col(key).isNotNull()).select(key, "_salt").distinct()
    return salted.join(wanted.join(found, key), [key, "_salt"], "left").drop("_salt")


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, uri, date, request, response, metadata`` (structs),
    and the payload's digest and size; a revisit takes them from the response that it refers to.

    Equal records are counted before the joins, so that captures written twice come back twice and no
    identifier meets itself. Where ``found`` has the payload, so has the row; give a stored table then,
    since each kind of record is read on its own. A capture without request or metadata has nulls there;
    a revisit whose response is missing has a null digest.
    """
    carried = [c for c in ("payload", "payload_digest", "payload_bytes") if c in found.columns]

    def side(kind: str, *fields: str) -> DataFrame:
        return found.where(F.col("kind") == kind).groupBy(F.col("concurrent_to").alias("capture_id")).agg(
            F.min(F.struct("record_id", *fields)).alias(kind))

    main = found.where(F.col("kind").isin(RESPONSE, REVISIT)).groupBy("record_id").agg(
        F.count(F.lit(1)).alias("_copies"), *[F.first(c).alias(c) for c in ("kind", "refers_to", "uri", "date", "declared_digest", "http", *carried)])
    bodies = main.where(F.col("kind") == RESPONSE).select(F.col("record_id").alias("refers_to"), *[F.col(c).alias(f"_{c}") for c in carried])
    own = main.where(F.col("kind") == RESPONSE).select("*", *[F.col(c).alias(f"_{c}") for c in carried])
    again = _looked_up(main.where(F.col("kind") == REVISIT), "refers_to", "record_id", bodies).select(own.columns)
    c = own.unionByName(again).withColumnRenamed("record_id", "capture_id")
    c = c.join(side(REQUEST, "http"), "capture_id", "left").join(side(METADATA, "fields"), "capture_id", "left")
    reply = F.struct("kind", "refers_to", "declared_digest", "http").alias("response")
    return c.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(
        "capture_id", "uri", "date", REQUEST, reply, METADATA, *[F.col(f"_{x}").alias(x) for x in carried])


def page_id_of(fields: Column) -> Column:
    """The page_id that a metadata record carries, null where it has none."""
    return F.nullif(F.regexp_extract(fields, r"(?m)^page_id: (-?\d+)\r?$", 1), F.lit("")).cast("long")


def round_trip(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Archives written to the shared folder and read back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to`` per page."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, per_file)
    got = assemble(stored(read_archives(spark, path).drop("payload")))
    got = got.select(F.col("capture_id"), page_id_of(F.col("metadata.fields")).alias("page_id"), "payload_bytes", "payload_digest",
                     F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("_to"))
    named = got.where(F.col("record_type") == RESPONSE).groupBy(F.col("capture_id").alias("_to")).agg(F.first("page_id").alias("refers_to"))
    return _looked_up(got, "_to", "capture_id", named).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < {REVISIT_BYTES} OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM m"""
