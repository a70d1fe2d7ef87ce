"""Legacy ARC archives turned into WARC archives.

An ARC file opens with a ``filedesc`` record that names its version and the fields of every
later header line: five fields in version 1, ten in version 2, the last always the declared
length of the content. The converter walks the file by these lengths, never by separators,
and makes the WARC headers that an ARC record lacks: identifier, date, type and digests.

Archives are written by Spark's text writer, whose line separator ends a record, so the
writer's commit protocol covers lost executors and any file system that Spark knows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugewatch.llm.common import stage
from gaugewatch.session import scratch_dir

#: Bytes of payload that an archive file gets on average; a file also holds its longest record.
FILE_BYTES = 16 * 2**20

# The header fields of the two ARC versions, the ends of records, the revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_END, WARC_END = "\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"

CONVERTED = "page_id long, uri string, date string, http string, payload string, payload_bytes long, payload_digest string"
RECORDS = "record_id string, record_type string, page_id long, refers_to_id string, payload_bytes long, payload_digest string"


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    content: bytes


def read_arc(data: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records after the ``filedesc`` record, cut by their declared lengths."""
    first = data.readline().decode()
    if not first:
        return
    if not first.startswith("filedesc://"):
        raise ValueError("an ARC file starts with a filedesc record")
    about = data.read(int(first.rsplit(" ", 1)[1])).decode().split("\n")
    version, names = int(about[0].split(" ")[0]), about[1].split(" ")
    if ARC_FIELDS.get(version) != " ".join(names):
        raise ValueError(f"unknown ARC version {version}")
    while line := data.readline():
        if line == b"\n":  # the end of the record before
            continue
        values = line.decode().rstrip("\n").split(" ")
        if len(values) != len(names):
            raise ValueError(f"an ARC header line of {len(values)} fields, not {len(names)}")
        fields = dict(zip(names, values))
        declared = int(fields["Archive-length"])
        content = data.read(declared)
        if len(content) != declared:
            raise ValueError("an ARC record ends early")
        yield ArcRecord(fields, content)


def read_warc(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks, cut by the declared lengths."""
    while line := data.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        headers = {}
        while (line := data.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(":")
            headers[name] = value.strip()
        yield headers, data.read(int(headers["Content-Length"]))


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """The header part, its fields, and the payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return head.decode() + "\r\n\r\n", fields, payload


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _files(total_bytes: int) -> int:
    return max(1, -(-int(total_bytes) // FILE_BYTES))


def write_arc(pages: DataFrame, path: str, version: Column) -> None:
    """``pages`` (page_id, url, html) as gzipped ARC files, one version to a file.

    ``version`` is 1 or 2 and a function of the row. The archive date of a page is a fixed
    moment plus its id in seconds. A null url is ``unknown:``; blanks and controls in one are
    percent-encoded, as header lines are split at blanks. A null html is an empty payload.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("unknown:")), r"[\s\p{Cntrl}]", "%20").alias("uri"),
        html.alias("html"),
        version.cast("int").alias("version"),
        F.monotonically_increasing_id().alias("row"),
    )
    files = _files(rows.agg(F.coalesce(F.sum(F.octet_length("html") + 400), F.lit(0))).first()[0])
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.lit(f"{PAGE_HEADER}: "),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit("\r\n\r\n"),
    )
    seconds = F.lit(946684800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))
    rows = rows.withColumn("content", F.concat(head, "html")).withColumn(
        "date", F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss")
    )
    length = F.octet_length("content").cast("string")
    lead = F.concat_ws(" ", "uri", F.lit("0.0.0.0"), "date", F.lit("text/html"))
    line = F.when(F.col("version") == 1, F.concat_ws(" ", lead, length)).otherwise(
        F.concat_ws(" ", lead, F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("pages.arc.gz"), length)
    )
    for number, fields in ARC_FIELDS.items():
        about = f"{number} 0 pages\n{fields}\n"
        opening = f"filedesc://pages.arc 0.0.0.0 20000101000000 text/plain {len(about)}\n{about}"
        # Dealt by the row's place in the table: pages without identifier, or of one, fill many files.
        records = rows.where(F.col("version") == number).repartition(files, "row")
        records = records.select(F.concat(line, F.lit("\n"), "content").alias("value"))
        records = records.mapInArrow(_opened(opening), "value string")
        records.write.option("lineSep", ARC_END).option("compression", "gzip").text(f"{path}/v{number}")


def _opened(record: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts the ``filedesc`` record before the others of a file."""

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([record])], ["value"])
        for batch in batches:
            yield pa.record_batch([batch.column(0)], ["value"])

    return before


def _archives(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
    return found.load(path).select("content")


def _rows(batches: Iterator[pa.RecordBatch], rows_of: Callable, schema: pa.Schema, at_once: int) -> Iterator[pa.RecordBatch]:
    """The rows of every archive, some at a time."""
    for batch in batches:
        for content in batch.column(0):
            ready = []
            for row in rows_of(io.BytesIO(gzip.decompress(content.as_py()))):
                ready.append(row)
                if len(ready) == at_once:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)
                    ready = []
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)


def convert_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """What WARC records need of every ARC record: identifier, date, HTTP header, payload and its digest.

    The identifier comes from the place of the capture alone (address, date, page), so that
    another run makes the same one. Without ``payloads`` that column is null and nothing of
    the texts leaves the parser.
    """

    def rows_of(data: io.BytesIO) -> Iterator[tuple]:
        for fields, content in read_arc(data):
            http, about, payload = split_http(content)
            stamp, uri = fields["Archive-date"], fields["URL"]
            page = about.get(PAGE_HEADER) or None
            date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
            yield (
                f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {stamp} {page}')}>",
                int(page) if page else None,
                uri,
                date,
                http,
                payload.decode() if payloads else None,
                len(payload),
                digest(payload),
            )

    from_arrow = pa.schema(
        [("record_id", pa.string()), ("page_id", pa.int64())]
        + [(n, pa.string()) for n in ("uri", "date", "http", "payload")]
        + [("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    )
    return _archives(spark, path, ".txt.gz").mapInArrow(
        lambda batches: _rows(batches, rows_of, from_arrow, 256), f"record_id string, {CONVERTED}"
    )


def write_warc(spark: SparkSession, arc_path: str, path: str) -> None:
    """The ARC archives under ``arc_path`` as gzipped WARC files.

    Of records with equal payloads the one of the largest page id is the response and the
    others are revisits without payload; a payload is equal if its SHA-1 and its length are.
    """
    slim = convert_arc(spark, arc_path, payloads=False)
    keeper = F.max(F.struct("page_id", "record_id", "uri", "date")).alias("keeper")
    keepers = stage(slim.groupBy("payload_digest", "payload_bytes").agg(keeper))
    records = convert_arc(spark, arc_path).join(keepers, ["payload_digest", "payload_bytes"])
    revisit = ~F.col("page_id").eqNullSafe(F.col("keeper.page_id"))
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    pairs = [
        (F.lit("WARC-Type"), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        (F.lit("WARC-Record-ID"), F.col("record_id")),
        (F.lit("WARC-Date"), F.col("date")),
        (F.lit("WARC-Target-URI"), F.col("uri")),
        (F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), "payload_digest")),
        (F.lit("WARC-Refers-To"), F.when(revisit, F.col("keeper.record_id"))),
        (F.lit("WARC-Refers-To-Target-URI"), F.when(revisit, F.col("keeper.uri"))),
        (F.lit("WARC-Refers-To-Date"), F.when(revisit, F.col("keeper.date"))),
        (F.lit("WARC-Profile"), F.when(revisit, F.lit(REVISIT_PROFILE))),
        (F.lit("Content-Type"), F.lit("application/http; msgtype=response")),
        (F.lit("Content-Length"), F.octet_length(block).cast("string")),
    ]
    # A field without value is null, and concat_ws leaves it out.
    headers = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(name, F.lit(": "), value) for name, value in pairs])
    lines = records.select(F.concat(headers, F.lit("\r\n\r\n"), block).alias("value"))
    lines.write.option("lineSep", WARC_END).option("compression", "gzip").text(path)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record, with the payload's size and digest as its headers have them.

    The payload of a response is digested again and must agree with its header.
    """

    def rows_of(data: io.BytesIO) -> Iterator[tuple]:
        for headers, block in read_warc(data):
            _, about, payload = split_http(block)
            declared = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            n_bytes = int(about["Content-Length"])
            if headers["WARC-Type"] == "response" and (len(payload), digest(payload)) != (n_bytes, declared):
                raise ValueError(f"payload and headers of {headers['WARC-Record-ID']} disagree")
            page = about.get(PAGE_HEADER) or None
            yield (
                headers["WARC-Record-ID"],
                headers["WARC-Type"],
                int(page) if page else None,
                headers.get("WARC-Refers-To"),
                n_bytes,
                declared,
            )

    text, number = pa.string(), pa.int64()
    from_arrow = pa.schema(
        [("record_id", text), ("record_type", text), ("page_id", number), ("refers_to_id", text)]
        + [("payload_bytes", number), ("payload_digest", text)]
    )
    return _archives(spark, path, ".txt.gz").mapInArrow(lambda batches: _rows(batches, rows_of, from_arrow, 10_000), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` as ARC files of both versions, converted to WARC files, read back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to (page id of the
    response, null for a response). A page without html has an empty payload. Repeated rows
    of one page id that hold equal payloads are all responses; a row without page id is a
    revisit where a row with one has the same payload. An empty table gives no rows.
    """
    spark = pages.sparkSession
    base = f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{base}/arc", 1 + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2)))
    write_warc(spark, f"{base}/arc", f"{base}/warc")
    records = stage(read_warc_files(spark, f"{base}/warc"))
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    kept = records.where(F.col("record_type") == "response").select(*shown, F.lit(None).cast("long").alias("refers_to"))
    # A page may stand there more than once: one row for each identifier.
    names = records.where(F.col("record_type") == "response").groupBy(F.col("record_id").alias("refers_to_id"))
    names = names.agg(F.max("page_id").alias("refers_to"))
    others = records.where(F.col("record_type") == "revisit").join(names, "refers_to_id", "left")
    return kept.unionByName(others.select(*shown, "refers_to"))
