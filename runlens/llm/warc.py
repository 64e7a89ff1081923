"""WARC archives as a table of chunks.

A payload is cut into rows (record, chunk number) of at most ``CHUNK`` bytes, and every chunk carries
the digest of the payload up to its own end, so that no later step holds a payload as a whole and a
damaged chunk is found where it lies. Each chunk becomes one record of the archive: the first
of them a ``response``, the others ``continuation`` records with segment number and origin, as WARC/1.1
cuts oversized records. Payloads that were met before become ``revisit`` records without a body.

Archives are written and read by Spark's text source, so any file system Spark knows will do. A row
is one record and the end of a line is what ends a record; on reading, rows are cut where a record ends and the next
begins. A chunk also ends inside every place where its payload has the first line of a record itself,
so that line stands nowhere but between records.

Defined results: a null payload is empty. Rows with a null or repeated id are records of their own; null
ids count as smallest, and of rows with one id and payload the one with the larger record number is the response.
An empty table gives archives without records. Other columns than id, address and payload are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.registry import query, stored, table
from runlens.session import work_path

CHUNK = 1 << 20
VERSION = "WARC/1.1"
DATE = "2000-01-01T00:00:00Z"
#: What stands between two records: the two empty lines after a block and the next record's first line.
_END, _BETWEEN = "\r\n", f"\r\n\r\n{VERSION}\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(hexadecimal: Column) -> Column:
    """The base-32 writing of a SHA-1 digest, from its hexadecimal one: five of these digits are four of those."""
    digits = [F.lpad(F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), _HEX, _BASE32)


def cuts(payload: memoryview, size: int = CHUNK) -> list[int]:
    """Ends of the chunks: every ``size`` bytes, and inside each place that reads like the first line of a record."""
    mark, ends, found, raw = VERSION.encode(), [], [], payload.obj
    at = raw.find(mark)
    while at >= 0:
        found.append(at + 1)
        at = raw.find(mark, at + 1)
    last = 0
    for end in [*found, len(payload)]:
        while end - last > size:
            last += size
            ends.append(last)
        if end > last:
            last = end
            ends.append(last)
    return ends or [0]


def chunks(pages: DataFrame, row_id: str = "page_id", uri: str | None = "url", payload: str = "html", size: int = CHUNK) -> DataFrame:
    """The stored table of chunks: record, row, uri, chunk from 0, data, digest so far, bytes so far, and on the last chunk ``content``, the SHA-256 of all."""
    address = F.col(uri).cast("string") if uri else F.lit(None).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(row_id).cast("long").alias("row"), address.alias("uri"),
                        F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    schema = "record long, row long, uri string, chunk int, data binary, digest string, so_far long, content string"

    def address(where: str | None) -> str | None:
        return None if where is None else quote(where, safe="!#$%&'()*+,/:;=?@[]~")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string()]
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for record, row, where, data in zip(batch[0], batch[1], batch[2], batch[3]):
                body = memoryview(data.as_py())
                sha1, sha256, first = hashlib.sha1(), hashlib.sha256(), 0
                ends = cuts(body, size)
                for k, end in enumerate(ends):
                    part = body[first:end]
                    sha1.update(part)
                    sha256.update(part)
                    out.append((record.as_py(), row.as_py(), address(where.as_py()) if k == 0 else None, k, part, sha1.hexdigest(), end,
                                sha256.hexdigest() if k == len(ends) - 1 else None))
                    held += len(part) + 200
                    first = end
                    if held > 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return stored(rows.mapInArrow(cut, schema), "warc-chunks")


def revisits(table: DataFrame, least: int = 0) -> DataFrame:
    """(record, refers): records whose payload of at least ``least`` bytes another record brings, and that record."""
    ends = table.where(F.col("content").isNotNull() & (F.col("so_far") >= least)).select("record", "row", "content", "so_far")
    # One row for each content that several records have, however many they are.
    first = (ends.groupBy("content", "so_far").agg(F.max(F.struct("row", "record")).alias("stays"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("content", "so_far", F.col("stays.record").alias("refers")))
    return stored(ends.join(first, ["content", "so_far"]).where("record <> refers").select("record", "refers"), "warc-revisits")


def _uuid(salt: str, record: Column) -> Column:
    h = F.md5(F.concat(F.lit(salt), record.cast("string")))
    return F.concat(F.lit("urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in
                                          ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)])


def _header(name: str, value: Column) -> Column:
    """A line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _records(table: DataFrame, again: DataFrame, date: str, salt: str) -> DataFrame:
    """The text of one WARC record per chunk that is written."""
    with_refers = table.join(again, "record", "left")
    first, last, revisit = F.col("chunk") == 0, F.col("content").isNotNull(), F.col("refers").isNotNull()
    # A revisit is written from its last chunk, which has the whole digest; its body stays away.
    written = with_refers.where(~revisit | last)
    body = (F.when(revisit, F.encode(F.lit(_HTTP), "UTF-8"))
            .when(first, F.concat(F.encode(F.lit(_HTTP), "UTF-8"), F.col("data"))).otherwise(F.col("data")))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        _header("WARC-Record-ID", F.concat(F.lit("<"), F.when(first | revisit, _uuid(salt, F.col("record"))).otherwise(
            _uuid(salt, F.concat_ws("/", F.col("record").cast("string"), F.col("chunk").cast("string")))), F.lit(">"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("uri")),
        _header("WARC-Row-ID", F.col("row")),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.concat(F.lit("<"), _uuid(salt, F.col("refers")), F.lit(">"))),
        _header("WARC-Segment-Number", F.when(~revisit & ~(first & last), F.col("chunk") + 1)),
        _header("WARC-Segment-Origin-ID", F.when(~revisit & ~first, F.concat(F.lit("<"), _uuid(salt, F.col("record")), F.lit(">")))),
        _header("WARC-Segment-Total-Length", F.when(~revisit & ~first & last, F.col("so_far") + len(_HTTP))),
        _header("WARC-Payload-Digest", F.when(last, F.concat(F.lit("sha1:"), base32_sha1(F.col("digest"))))),
        _header("WARC-Digest-So-Far", F.when(~last, F.concat(F.lit("sha1:"), base32_sha1(F.col("digest"))))),
        _header("Content-Type", F.when(first | revisit, F.lit("application/http; msgtype=response"))),
        _header("Content-Length", F.octet_length(body)), F.lit("\r\n"))
    return written.select(F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit(_END), "UTF-8")).cast("string").alias("value"))


def write(pages: DataFrame, path: str, *, row_id: str = "page_id", uri: str | None = "url", payload: str = "html", least: int = 0,
          size: int = CHUNK, date: str = DATE, compression: str = "gzip") -> None:
    """Archives of one record per row below ``path``; payloads of at least ``least`` bytes are written once, under the largest id."""
    parts = chunks(pages, row_id, uri, payload, size)
    _records(parts, revisits(parts, least), date, path).write.option("lineSep", _END).option("compression", compression).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table of chunks of the archives below ``path``: type, id, origin, segment, row, uri, refers, declared digest and lengths, and the data.

    ``whole`` is false where a block is not as long as its record says.
    """
    lines = spark.read.option("lineSep", _BETWEEN).text(path).where("value <> ''")
    # Only the first record of a file still has its version line, only the last one its closing lines.
    text = F.regexp_replace(F.substring_index(F.col("value"), "\r\n\r\n", 1), f"^{VERSION}\r\n", "")
    start = F.octet_length(F.substring_index(F.col("value"), "\r\n\r\n", 1)) + 4
    block = F.expr("substring(cast(value as binary), start + 1)")
    rows = lines.select(text.alias("head"), start.alias("start"), "value").select("head", block.alias("block"))

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: <?([^\r\n>]*)", 1), F.lit(""))

    length, segment = field("Content-Length").cast("long"), F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1))
    kind = field("WARC-Type")
    http = (segment == 1) & F.coalesce(field("Content-Type").startswith("application/http"), F.lit(False))
    rows = rows.select(
        kind.alias("kind"), F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record"), segment.alias("segment"),
        field("WARC-Row-ID").cast("long").alias("row"), field("WARC-Target-URI").alias("uri"), field("WARC-Refers-To").alias("refers"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        F.regexp_replace(field("WARC-Digest-So-Far"), "^sha1:", "").alias("digest_so_far"),
        field("WARC-Segment-Total-Length").cast("long").alias("total"), field("WARC-Segment-Number").isNotNull().alias("segmented"),
        length.alias("length"), http.alias("http"), "block")
    # Octets up to the declared length are the block; the last record of a file has its end after them.
    block = F.when(F.octet_length("block") >= F.col("length"), F.expr("substring(block, 1, cast(length as int))"))
    body = F.when(F.col("http"), F.expr("substring(block, 5 + octet_length(substring_index(cast(block as string), '\\r\\n\\r\\n', 1)))")).otherwise(F.col("block"))
    return (rows.withColumn("block", block).withColumn("data", body)
            .withColumn("whole", F.col("data").isNotNull())
            .withColumn("skipped", F.octet_length("block") - F.octet_length("data")).drop("block", "http", "length"))


def _segmented(parts: DataFrame) -> DataFrame:
    """Size and digest of payloads of several chunks, chunk after chunk in order; a chunk that does not fit ends the record as damaged."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, sha1, n, size, row, intact, closed = None, None, 0, 0, None, True, False
        done: list[tuple] = []

        def end():
            if record is not None:
                done.append((record, row, size, sha1.hexdigest(), intact and closed))

        for batch in batches:
            for who, segment, r, data, total, whole, declared, so_far, skipped in zip(*batch.columns):
                if who.as_py() != record:
                    end()
                    record, sha1, n, size, row, intact, closed = who.as_py(), hashlib.sha1(), 0, 0, r.as_py(), True, False
                    head = skipped.as_py() or 0
                n += 1
                if whole.as_py():
                    part = memoryview(data.as_buffer())
                    sha1.update(part)
                    size += len(part)
                want = declared.as_py() or so_far.as_py()
                intact &= whole.as_py() and segment.as_py() == n and want == _b32(sha1.digest())
                if total.as_py() is not None:
                    closed = total.as_py() == size + head
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
                done = []
        end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

    names, kinds = ["record", "row", "payload_bytes", "sha1", "intact"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return (parts.repartition("record").sortWithinPartitions("record", "segment")
            .select("record", "segment", "row", "data", "total", "whole", "digest", "digest_so_far", "skipped")
            .mapInArrow(follow, "record string, row long, payload_bytes long, sha1 string, intact boolean"))


def _b32(raw: bytes) -> str:
    import base64

    return base64.b32encode(raw).decode()


def records(parts: DataFrame) -> DataFrame:
    """One row per record: row, kind, size and digest of the full payload, row of the record it refers to, and whether all of it is intact.

    Only payloads of several chunks are shuffled. A revisit takes its size from the record it refers to.
    """
    is_revisit = F.col("kind") == "revisit"
    single = parts.where((F.col("kind") == "response") & ~F.col("segmented")).select(
        "record", "row", F.octet_length("data").cast("long").alias("payload_bytes"), F.sha1("data").alias("sha1"),
        (F.col("whole") & (base32_sha1(F.sha1("data")) == F.col("digest"))).alias("intact"))
    full = single.union(_segmented(parts.where(F.col("segmented") | (F.col("kind") == "continuation"))))
    full = full.select("record", "row", "payload_bytes", base32_sha1(F.col("sha1")).alias("payload_digest"), F.coalesce("intact", F.lit(False)).alias("intact"))
    again = (parts.where(is_revisit).select(F.col("row").alias("_row"), F.col("refers").alias("record"), "digest")
             .join(full.withColumnRenamed("row", "refers_to"), "record", "left"))
    return (full.select("row", F.lit("response").alias("kind"), "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"), "intact")
            .union(again.select("_row", F.lit("revisit"), "payload_bytes", "digest", "refers_to",
                                F.coalesce(F.col("intact") & (F.col("digest") == F.col("payload_digest")), F.lit(False)))))


@query("op12_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, lower(sha1(h)) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) % 32 AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to,
       TRUE AS intact
FROM d
""")
def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "warc")
    write(table(spark, folder, "pages"), path)
    return records(read(spark, path)).select(
        F.col("row").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "intact")
