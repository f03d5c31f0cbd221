"""WARC archives with a Zstandard dictionary, and reading them back.

Pages are dealt by a hash to archives of bounded size.  The task that writes an
archive trains a dictionary on its first records, puts it at the start of the file
in a skippable frame and compresses every record as a frame of its own, so that any
record can be read by its offset.  A file is written under a temporary name and
renamed when complete, so a task that runs twice leaves one complete file.

Of records whose payloads are equal and at least ``MIN_REVISIT`` bytes long, the one
with the smallest page id is a ``response``, the others are ``revisit`` records that
refer to it and carry no payload.  Rows that repeat the smallest page id with the
same payload are responses too.  Null html is the empty payload, a null page id or
url is written without that header; an empty table writes no archive.  Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship_by_value
from loomgraph.llm.shared import whole_text, written

ship_by_value(__name__)

MIN_REVISIT = 100
#: Source bytes of an archive, on average, and the most one file takes before the next is begun.
ARCHIVE_BYTES = 16 << 20
MOST_BYTES = 64 << 20
#: Records and bytes that a dictionary is trained on, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 4 << 20, 64 << 10
LEVEL = 3
_READ_BYTES = 8 << 10
#: A skippable frame with this number holds the dictionary of a .warc.zst file.
DICTIONARY_FRAME = 0x184D2A5D
_FRAME = "<II"
_DATE = "2000-01-01T00:00:00Z"

_FILES = "path string, records bigint, bytes bigint"
_RECORDS = "page_id bigint, url string, record_type string, payload_digest string, refers_to bigint, payload binary, path string, offset bigint"


def planned(pages: DataFrame, archives: int, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to``, dealt to ``archives`` tasks and sorted there.

    ``refers_to`` is set for revisits only.  Payloads are shuffled once; the revisits are found
    from digests and join them in place.
    """
    page_id, payload = F.col(key).cast("bigint").alias("page_id"), F.encode(whole_text(html), "UTF-8")
    digest = F.sha2(payload, 256).alias("payload_digest")
    known = pages.select(page_id, digest, F.octet_length(payload).alias("n")).filter(F.col("n") >= MIN_REVISIT)
    firsts = (
        known.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies"))
        .filter("copies > 1 AND refers_to IS NOT NULL").drop("copies")
    )
    firsts = written(firsts, "first_payloads")
    revisits = (
        known.join(firsts, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("rid"), F.col("payload_digest").alias("rdigest"), "refers_to").distinct()
    )
    # One key for both sides that is never null, so that the join takes the partitions as they are.
    deal = F.xxhash64("page_id", "payload_digest")
    rows = pages.select(page_id, F.col(url).cast("string").alias("url"), payload.alias("payload"), digest)
    dealt = rows.withColumn("deal", deal).repartition(archives, "deal")
    found = revisits.withColumn("rdeal", F.xxhash64("rid", "rdigest")).repartition(archives, "rdeal")
    # The rest is no join key, else the planner would deal by it again.
    same_page = F.coalesce(F.col("page_id") == F.col("rid"), F.col("page_id").isNull() & F.col("rid").isNull())
    here = (F.col("deal") == F.col("rdeal")) & same_page & F.coalesce(F.col("payload_digest") == F.col("rdigest"), F.lit(False))
    met = dealt.join(found, here, "left")
    return met.select("page_id", "url", "payload", "payload_digest", "refers_to").sortWithinPartitions("page_id", "payload_digest", "refers_to")


def _header_text(value: str) -> str:
    """A header's value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record."""
    seed = f"{page_id}|{digest}|{refers_to}"
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}|{digest}|None')}>",
            f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
        payload = b""
    block = http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]}")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from some records; with too few to train on, their content itself serves."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def archive_bytes(records: list[bytes]) -> bytes:
    """An archive: the dictionary's skippable frame, then a frame for every record."""
    held, samples = 0, []
    for record in records[:SAMPLE_RECORDS]:
        if held >= SAMPLE_BYTES:
            break
        samples.append(record[: 64 << 10])
        held += len(samples[-1])
    dictionary = train_dictionary(samples)
    writer = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
    out = io.BytesIO()
    out.write(struct.pack(_FRAME, DICTIONARY_FRAME, len(dictionary)) + dictionary)
    for record in records:
        out.write(writer.compress(record))
    return out.getvalue()


def archive_records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of every record of an archive."""
    kind, size = struct.unpack_from(_FRAME, content)
    if kind != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    at = 8 + size
    view = memoryview(content)
    while at < len(content):
        # Only the reader knows where a frame ends, so it gets a little at a time.
        one, parts, stop = reader.decompressobj(), [], at
        while not one.eof:
            if stop >= len(content):
                raise ValueError(f"the record at {at} is cut off")
            parts.append(one.decompress(view[stop : stop + _READ_BYTES]))
            stop = min(stop + _READ_BYTES, len(content))
        yield at, b"".join(parts)
        at = stop - len(one.unused_data)


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Write an archive, or some, per task below ``folder`` (a URI every executor can write to).

    The rows are ``path, records, bytes`` of each archive.  A task's rows are the same whenever it
    runs, so a second run writes the same files.
    """
    store, root = _store(folder)
    store.create_dir(root, recursive=True)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _store(folder)
        number, held, size, done = TaskContext.get().partitionId(), [], 0, []

        def flush() -> None:
            content = archive_bytes(held)
            name = f"{root}/archive-{number:08d}-{len(done):04d}.warc.zst"
            part = f"{name}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write(content)
            store.move(part, name)
            done.append((name.rpartition("/")[2], len(held), len(content)))
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in range(5)), strict=True):
                if held and size >= MOST_BYTES:
                    flush()
                    size = 0
                held.append(record_bytes(*row))
                size += len(held[-1])
        if held:
            flush()
        yield _rows(done, _FILES)

    return plan.mapInArrow(stage, _FILES)


def _store(folder: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    types = [kinds[field.split()[1]] for field in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``folder``, with the file and offset of its frame.

    Without ``payloads`` a payload is checked against its digest and its length is returned in its place.
    """
    schema = _RECORDS if payloads else _RECORDS.replace("payload binary", "payload_bytes bigint")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for offset, record in archive_records(content.as_py()):
                    headers, payload = parse_record(record)
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind, refers = headers["WARC-Type"], headers.get("WARC-Refers-To-Page-ID")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: the payload at {offset} does not have its digest")
                    page = headers["WARC-Page-ID"]
                    body = payload if payloads else len(payload)
                    rows.append((int(page) if page else None, headers.get("WARC-Target-URI"), kind, digest, int(refers) if refers else None, body, path, offset))
                    size += len(payload) if payloads else 0
                    if size > 8 << 20 or len(rows) >= 10_000:
                        yield _rows(rows, schema)
                        rows, size = [], 0
                yield _rows(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(stage, schema)


def archive_pages(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write ``pages`` to archives below ``folder``; returns the list of files, already written."""
    spark = pages.sparkSession
    html = columns.get("html", "html")
    total = pages.agg(F.sum(F.octet_length(whole_text(html)))).first()[0] or 0
    plan = planned(pages, max(1, -(-total // ARCHIVE_BYTES)), **columns)
    manifest = f"{folder.rstrip('/')}/manifest"
    write_archives(plan, f"{folder.rstrip('/')}/archives").write.mode("overwrite").parquet(manifest)
    return spark.read.schema(_FILES).parquet(manifest)


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``; a revisit has its response's length."""
    records = read_archives(spark, f"{folder.rstrip('/')}/archives", payloads=False)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = written(records.select(*columns), "warc_records")
    lengths = own.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"))
    met = own.join(lengths, "payload_digest", "left")
    return met.withColumn("payload_bytes", F.coalesce("full", "payload_bytes")).select(*columns)
