"""WARC archives with revisit resolution.

``resolve`` decides over headers alone: identities (page, address, digest) are
counted, the first page of each payload digest is its response and every other
record revisits it. ``write_archives`` joins the payload to response records only
and writes whole WARC records with fresh headers by Spark's text writer, whose line
separator is the record separator. ``read_archives`` walks the files record by
record by Content-Length and ``restore`` joins revisits to their responses again.

Defined results: a null html is an empty payload, a null url an empty target; rows
that repeat a page are records of their own, the first of them the response if the
page is; a null page_id sorts after all others; a payload of fewer than
``min_bytes`` bytes is never revisited. An empty table gives no records. Further
columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.llm.common import arrow_step, cut, shared_dir

CRLF = "\r\n"
#: Payload bytes from which on, and the records in a file at most: what a reader holds stays under 256 MB, or is one record.
FILE_CLASSES = ((0, 1000), (256 << 10, 32), (8 << 20, 1))
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "record_id string, record_type string, page_id long, payload_digest string, content_bytes long, refers_to_record string, target_uri string, payload binary"


def base32(hexed: Column) -> Column:
    """Bare upper-case base32 of a hex SHA-1: each 5 hex digits are 20 bits, so 4 characters."""
    parts = []
    for g in range(8):
        number = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), 1, 32).substr(F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes and payload_sha1 (hex, the key of all joins) of each row."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    return rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_sha1": F.sha1(F.encode("html", "UTF-8"))})


def resolve(head: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A row for each record: page_id, url, payload_bytes, payload_sha1, payload_digest (base32), copy (0, 1, ... of equal rows), record_type, refers_to and refers_url.

    Equal identities are counted before the shuffle by digest, and the smallest page
    of a digest is an aggregate, so a payload that a third of all pages share costs a
    row for each page and task.
    """
    key = ["page_id", "url", "payload_sha1", "payload_bytes"]
    # Written: it is used twice, and pages are hashed for it.
    counted = cut(head.groupBy(*key).agg(F.count("*").alias("n")))
    # Nulls last: the flag sorts before the number.
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = counted.groupBy("payload_sha1").agg(F.min(rank).alias("first"))
    rows = counted.join(first, "payload_sha1").select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("url") == F.col("first.url")) & (F.col("copy") == 0)
    response = is_first | (F.col("payload_bytes") < min_bytes)
    return rows.select(
        *key,
        base32(F.col("payload_sha1")).alias("payload_digest"),
        "copy",
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("first.page_id")).alias("refers_to"),
        F.when(~response, F.col("first.url")).alias("refers_url"),
    )


def record_id(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    """A fresh UUID that is the same each time a task is run again."""
    h = F.sha1(F.concat_ws("\n", page_id.cast("string"), url, digest, copy.cast("string")))
    cut = lambda a, b: F.substring(h, a, b)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def write_archives(records: DataFrame, head: DataFrame, path: str) -> None:
    """Writes gzipped WARC/1.1 files to ``path``: full responses, and revisits that name them. Payloads are shuffled once a digest; large ones go to files of their own, fewer to a file."""
    largest = records.agg(F.max("payload_bytes")).first()[0] or 0
    for k, (least, per_file) in enumerate(FILE_CLASSES):
        below = FILE_CLASSES[k + 1][0] if k + 1 < len(FILE_CLASSES) else 1 << 62
        fits = (F.col("payload_bytes") >= least) & (F.col("payload_bytes") < below)
        if k == 0 or largest >= least:
            out = record_texts(records.filter(fits), head.filter(fits))
            out.write.mode("append" if k else "overwrite").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def record_texts(records: DataFrame, head: DataFrame) -> DataFrame:
    """value: the whole record of each row of ``records``."""
    payloads = head.groupBy("payload_sha1").agg(F.first("html").alias("html"))
    reply = records.filter("record_type = 'response'").join(payloads, "payload_sha1")
    again = records.filter("record_type = 'revisit'").withColumn("html", F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    safe = lambda url: F.regexp_replace(url, r"[\r\n]", " ")
    first_id = record_id(F.col("refers_to"), F.col("refers_url"), F.col("payload_sha1"), F.lit(0))
    block = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("payload_sha1"), F.col("copy"))),
        line("WARC-Date", F.lit(WARC_DATE)),
        line("WARC-Target-URI", safe(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", first_id), line("WARC-Refers-To-Target-URI", safe(F.col("refers_url"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length("html").cast("string")),
        F.lit(CRLF),
        F.col("html"),
    )
    return reply.unionByName(again).select(block.alias("value"))


def parse_records(stream) -> list:
    """The records of one archive: (record id, type, page, digest, content length, refers to, target, content)."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.lower()] = value.strip()
        content = stream.read(length := int(fields["content-length"]))
        if len(content) < length:
            raise ValueError("the archive ends inside a record")
        page = fields.get("x-page-id")
        yield fields["warc-record-id"], fields["warc-type"], page and int(page), fields["warc-payload-digest"].removeprefix("sha1:"), length, fields.get("warc-refers-to"), fields.get("warc-target-uri"), content


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives in ``path``; without ``payload`` the contents are null."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("content_bytes", pa.int64()), ("refers_to_record", pa.string()), ("target_uri", pa.string()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for row in parse_records(gzip.open(io.BytesIO(data.as_py()))):
                    rows.append(row if payload else (*row[:-1], None))
                    held += len(row[-1]) * payload
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return arrow_step(files, run, RECORD_SCHEMA)


def restore(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record, revisits joined to their originals; a revisit without its response raises."""
    originals = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("first_page"), F.col("content_bytes").alias("first_bytes"), F.lit(True).alias("found"))
    joined = records.drop("payload").join(originals, "refers_to_record", "left")
    revisit = F.col("record_type") == "revisit"
    n = F.when(~revisit, F.col("content_bytes")).when(F.col("found"), F.col("first_bytes")).otherwise(F.raise_error(F.lit("a revisit record has no response")))
    return joined.select("page_id", n.cast("long").alias("payload_bytes"), "payload_digest", "record_type", F.when(revisit, F.col("first_page")).alias("refers_to"))


def deduplicated(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as deduplicated archives to ``path`` (else a fresh folder beside the checkpoints) and returns what ``restore`` reads back."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    head = headers(pages)
    write_archives(resolve(head.drop("html"), min_bytes), head, path)
    return restore(read_archives(spark, path, payload=False))


def _base32_sql() -> str:
    number = "CAST('0x' || substr(h, 5 * g + 1, 5) AS INTEGER)"
    one = lambda s: f"substr('{BASE32}', (({number} >> {s}) & 31) + 1, 1)"
    return f"array_to_string(list_transform(range(8), lambda g: {' || '.join(map(one, (15, 10, 5, 0)))}), '')"


PAGES_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT page_id, html, h, row_number() OVER (PARTITION BY h ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_base32_sql()} AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM r"""
