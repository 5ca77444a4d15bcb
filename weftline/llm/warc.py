"""WARC archives with an index: written by record, read back by coalesced byte ranges.

Every task writes archives of bounded size (one gzip member per record, so a record can be
read alone) and gives an index row per record: archive, offset, length, url, digest. The index is a table;
archives that a failed attempt left behind are in no row of it. To read selected
records, their index rows are ordered by archive and offset, neighbours with small gaps are
put together to ranges of bounded size, and each range is read once.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from weftline.llm.common import bound_batches
from weftline.plans.lineage import materialize, scratch_path

ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 50_000
RANGE_BYTES = 4 << 20  # a range ends when it holds this much
GAP_BYTES = 64 << 10  # unselected bytes that are read over rather than opening a new range
LEAST_REVISIT_BYTES = 100
DEDUPLICATION_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
STAMP = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")  # pages carry no time of capture

INDEX = (
    "archive string, offset long, length long, url string, payload_digest string, page_id long, "
    "record_type string, refers_to long, payload_bytes long"
)


def _record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, uncompressed. A revisit holds no payload but its digest and size."""
    kind = "response" if refers_to is None else "revisit"
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": _record_id(page_id),
        "WARC-Date": STAMP,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(len(payload)),
    }
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        body += payload
    else:
        head |= {"WARC-Profile": DEDUPLICATION_PROFILE, "WARC-Refers-To": _record_id(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a record")
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("the record is cut short")
    fields["payload"] = body.partition(b"\r\n\r\n")[2]
    return fields


def _page_of(record_id: str | None):
    own = (record_id or "")[len("<urn:page:") : -1]
    return int(own) if own else None


# The schemes by which Spark's readers name stores that the archive reader and writer name otherwise
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def store_uri(folder: str) -> str:
    """The folder as Spark names it, in the scheme that opens the same store in the workers; plain paths are local files."""
    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        return f"file://{folder}"
    if scheme == "file":  # Spark writes file:/path too
        return f"file:///{rest.lstrip('/')}"
    return f"{SCHEMES.get(scheme.lower(), scheme)}:{rest}"


def _writer(folder: str):
    def write(batches):
        files, base = fs.FileSystem.from_uri(store_uri(folder))
        files.create_dir(base, recursive=True)
        rows, out, name, at = [], None, "", 0

        def index():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            names = [c.split(" ")[0] for c in INDEX.split(", ")]
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                payload = (html or "").encode()
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = member.compress(record(page, url, payload, digest, refers)) + member.flush()
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data)
                kind = "response" if refers is None else "revisit"
                rows.append((name, at, len(data), url, digest, page, kind, refers, len(payload)))
                at += len(data)
                if at >= ARCHIVE_BYTES or len(rows) >= ARCHIVE_RECORDS:
                    out.close()
                    yield index()
                    rows, out = [], None
        if out is not None:
            out.close()
            yield index()

    return write


def first_captures(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html, payload_digest, refers_to): equal payloads of 100 bytes or more refer to the smallest id."""
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256).alias("payload_digest"),
    )
    facts = materialize(
        keyed.where(F.octet_length("html") >= LEAST_REVISIT_BYTES).select("page_id", "payload_digest"), "warc-digests"
    )
    firsts = facts.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts.select("payload_digest", "first"), "warc-firsts")
    # only ids and digests meet here; payloads move once, by their own id
    revisits = facts.join(firsts, "payload_digest").where("first is not null and not page_id <=> first")
    revisits = revisits.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("first").alias("refers_to"))
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    return keyed.join(revisits.distinct(), same, "left").select("page_id", "url", "html", "payload_digest", "refers_to")


def write_archives(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write a record per row of ``pages`` (page_id, url, html); gives the index table and the folder.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of at
    least 100 bytes the one with the smallest page_id is a response and the others are revisits of it;
    all smaller ones are responses.

    * Null url: the record has no target; line ends inside a url are percent-encoded in the archive.
    * Null page_id: such a record is a revisit where an equal payload has an id, else a response.
    * Rows that repeat page_id and payload are written each, as the same type. Equal ids with other payloads are independent.
    * Other columns are not read. An empty table gives an empty index and no archives.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or scratch_path(spark, "warc")
    folder = folder if ":" in folder else f"file://{folder}"
    index = first_captures(pages.select("page_id", "url", "html")).mapInArrow(_writer(folder), INDEX)
    return materialize(index, "warc-index"), folder


def ranges(index: DataFrame) -> DataFrame:
    """Selected index rows put together to ranges: (archive, start, stop, records array<struct<offset, length>>).

    Windows are per archive, whose size and number of records are bounded.
    """
    order = Window.partitionBy("archive").orderBy("offset")
    end = F.col("offset") + F.col("length")
    before = F.lag(end).over(order)
    jump = F.coalesce((F.col("offset") - before > GAP_BYTES), F.lit(True))
    # a new range as well where the selected bytes pass a multiple of RANGE_BYTES
    sized = index.select("archive", "offset", "length", jump.alias("jump"), F.sum("length").over(order).alias("sum"))
    part = F.floor((F.col("sum") - F.col("length")) / RANGE_BYTES)
    cut = F.col("jump") | (part != F.coalesce(F.lag(part).over(order), part))
    numbered = sized.withColumn("range", F.sum(cut.cast("int")).over(order))
    return numbered.groupBy("archive", "range").agg(
        F.min("offset").alias("start"), F.max(end).alias("stop"),
        F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"),
    ).select("archive", "start", "stop", "records")


def _reader(folder: str):
    def read(batches):
        files, base = fs.FileSystem.from_uri(store_uri(folder))
        for batch in batches:
            for archive, start, stop, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.open_input_file(f"{base}/{archive}") as file:
                    file.seek(start)
                    data = memoryview(file.read(stop - start))
                rows = []
                for r in records:
                    at = r["offset"] - start
                    found = parse(zlib.decompress(data[at : at + r["length"]], 31))
                    revisit = found["WARC-Type"] == "revisit"
                    payload = None if revisit else found["payload"]
                    digest = found["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {found['WARC-Record-ID']} differs from its digest")
                    rows.append((
                        archive, r["offset"], _page_of(found["WARC-Record-ID"]), found.get("WARC-Target-URI"), found["WARC-Type"],
                        digest, int(found["X-Payload-Length"]) if revisit else len(payload), _page_of(found.get("WARC-Refers-To")), payload,
                    ))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                names = [c.split(" ")[0] for c in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return read


RECORDS = (
    "archive string, offset long, page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
    "refers_to long, payload binary"
)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows, read from the archives and checked against their digests.

    (archive, offset, page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload); revisits have a
    null payload, with digest and size of the payload they stand for.
    """
    bound_batches(index.sparkSession)
    found = ranges(index.select("archive", "offset", "length"))
    # ranges have a bounded size, so few of them fit in one Arrow batch
    return found.repartition("archive", "start").mapInArrow(_reader(folder), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages and read all records back."""
    index, folder = write_archives(pages)
    return read_records(index, folder)
